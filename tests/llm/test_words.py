import random

import brute
import numpy as np
import pyarrow as pa

from tessera.llm import words as W


def _words(texts, **kw):
    data, rows = W.text_bytes(pa.array(texts))
    return W.Words(data, rows, **kw)


def test_words_equal_the_pattern():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aB é\n\t\x0b\x1f ßÉ.,0\U0001F600 ") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", " ", "x"]
    for alphabet, pattern in ((W.SPACE_SEPARATED, brute.SPACED), (W.ALPHANUMERIC, brute.ALNUM)):
        found = _words(texts, alphabet=alphabet)
        raw = found.data.tobytes()
        got = [raw[a:b].decode() for a, b in zip(found.starts, found.ends)]
        want = [pattern.findall(brute.fold(t)) for t in texts]
        assert got == [w for ws in want for w in ws]
        assert found.counts.tolist() == [len(w) for w in want]


def test_hashes_depend_on_the_word_only(monkeypatch):
    rng = random.Random(3)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 90))) for _ in range(50)]
    texts = [" ".join(rng.choice(pool) for _ in range(30)) for _ in range(40)]
    whole = _words(texts).hashes()
    by_word = {}
    for h, w in zip(whole.tolist(), [w for t in texts for w in t.split()]):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    # Words over many blocks, and longer than one.
    monkeypatch.setattr(W, "BLOCK_BYTES", 64)
    monkeypatch.setattr(W, "_powers", None)
    assert (_words(texts).hashes() == whole).all()
    monkeypatch.setattr(W, "_powers", None)


def test_hashes_are_the_same_in_any_steps(monkeypatch):
    texts = ["some words and " + "x" * 300, "", "more " * 50, None]
    whole = _words(texts).hashes()
    for step in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(W, "HASH_BYTES", step)
        assert (_words(texts).hashes() == whole).all()


def test_windows_and_minima():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 20, 200).astype(np.uint64)
    for width in (1, 2, 5, 8, 35):
        g = W.gram_hashes(h, width)
        seen = {}
        for i in range(len(h) - width + 1):
            key = tuple(h[i : i + width].tolist())
            assert seen.setdefault(key, g[i]) == g[i]
        assert len({*seen.values()}) == len(seen)
        assert (W.sliding(h, width) == [h[i : i + width].min() for i in range(len(h) - width + 1)]).all()
    assert len(W.gram_hashes(h[:3], 4)) == 0


def test_slices_cover_all_rows():
    texts = ["a" * n for n in (0, 5, 100, 3, 3, 3, 0, 50)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(9))], ["text", "i"])
    for view in (batch, batch.slice(2, 5)):
        got = []
        for rows, data, bounds in W.slices(view, "text", 10):
            got += [(i, data[a:b].tobytes().decode()) for i, a, b in zip(rows.column(1).to_pylist(), bounds[:-1], bounds[1:])]
        assert got == [(i, t or "") for i, t in zip(view.column(1).to_pylist(), view.column(0).to_pylist())]
