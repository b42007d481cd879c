"""Whitening, line rules and fill-in-middle against plain passes over small tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

import brute
from tessera.llm import fill_in_middle as M, line_rules as R, whitening as W
from tessera.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


# --- whitening -----------------------------------------------------------------------


def vectors_table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    if extra:
        for name in ("deviation", "whitened", "component", "n", "block", "ids", "matrix"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df.repartition(5)


def plain_whitening(rows, most=8):
    """{vec_id: (deviation, whitened)} with shares, in numpy and whole numbers."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in good]
    d = max(set(lengths), key=lambda k: (lengths.count(k), k))
    good = [(i, v) for i, v in good if len(v) == d]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array(x, float) - np.array(sums) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return [i for i, _ in good], n, deviation, centred @ axes / np.sqrt(values), values / np.trace(cov)


def some_vectors(n=700, d=12, seed=3):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, d)) @ np.diag(np.linspace(0.5, 3, d)) @ rng.normal(size=(d, d)) * 0.1 + rng.normal(size=d)
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]


def check_whitening(result, rows, most=8):
    ids, n, deviation, whitened, share = plain_whitening(rows, most)
    got = {}
    for r in result.collect():
        got.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(got) == list(range(1, whitened.shape[1] + 1))
    for c, of_id in got.items():
        assert sorted(of_id) == sorted(ids)
        mine = np.array([of_id[i].whitened for i in ids])
        sign = np.sign(mine @ whitened[:, c - 1])
        assert np.abs(sign * mine - whitened[:, c - 1]).max() < 1e-8
        assert [of_id[i].deviation for i in ids] == deviation
        assert {of_id[i].n for i in ids} == {n}
        assert abs(of_id[ids[0]].explained - share[c - 1]) < 1e-9
        assert of_id[ids[0]].identity_error < 1e-9


def test_whitening_equals_numpy(spark):
    rows = some_vectors()
    odd = [
        (9001, None), (9002, []), (9003, [1.0] * 11), (9004, [float("nan")] + [0.0] * 11), (9005, [float("inf")] + [0.0] * 11),
        (9006, [None] + [0.0] * 11), (9007, [1.0] * 13), (9008, [3e38] + [0.0] * 11),
    ]
    check_whitening(W.whiten(vectors_table(spark, rows + odd)), rows)


def test_whitening_in_many_blocks(spark, monkeypatch):
    """Blocks of 16 rows, several to a task and several tasks to a product."""
    monkeypatch.setattr(W, "BLOCK_BYTES", 16 * 8 * 12)
    monkeypatch.setattr(W, "TASK_BYTES", 3 * 16 * 16 * 12)
    rows = some_vectors(seed=4)
    check_whitening(W.whiten(vectors_table(spark, rows)), rows)


def test_whitening_of_few_dimensions(spark):
    rows = some_vectors(n=200, d=3, seed=5)
    result = W.whiten(vectors_table(spark, rows), copy=True)
    assert result.select("component").distinct().count() == 3
    check_whitening(result, rows)


def test_whitening_of_nothing_and_of_constants(spark):
    empty = W.whiten(vectors_table(spark, []))
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "component", "n"]
    assert W.whiten(vectors_table(spark, [(1, None), (2, [])])).count() == 0
    same = W.whiten(vectors_table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(same) == 6
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, None, 0.0, None)}
    flat = W.whiten(vectors_table(spark, [(i, [float(i), 1.0]) for i in range(5)])).collect()
    assert {r.component for r in flat if r.whitened is None} == {2}


def test_deviation_beyond_a_long_is_null():
    plan = W.Plan(2, {0: 2}, [3 << 40, 0])
    assert W.deviations(np.array([[1 << 40, 0], [0, 0]]) - plan.centre, plan) == [None, None]
    small = W.Plan(1, {0: 2}, [5])
    assert W.deviations(np.array([[2], [3]]) - small.centre, small) == [1, 1]


def test_whitening_query_covers_the_whole_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check_whitening(QUERIES["op11_embedding_whitening"](spark, SMALL), rows)


# --- line rules ----------------------------------------------------------------------


def plain_rules(text, rules=R.Rules()):
    """Counts and cleaned text of one document, line by line."""
    text = text or ""
    words = brute.SPACED.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {p for i, g in enumerate(windows) if windows.count(g) > 1 for p in (i, i + 1, i + 2)}
    seen, stays, dup, gone, lost = set(), [], 0, 0, 0
    for line in text.split("\n"):
        own = brute.SPACED.findall(line)
        if not own:
            continue
        again = line in seen
        seen.add(line)
        n = len(own)
        upper = [w for w in own if len(re.findall("[A-Z]", w)) >= 2 and not re.search("[a-z]", w)]
        between = [w for w in own if w in R.SEPARATORS]
        fails = (
            again
            or any(p in brute.fold(line) for p in R.PHRASES)
            or 100 * sum(bool(re.search(r"[#*$%&|<>]", w)) for w in own) > rules.symbols * n
            or 100 * sum(w.endswith(("!!", "??")) for w in own) > rules.shouted * n
            or (100 * len(upper) > rules.capitals * n and n >= rules.capital_words)
            or (100 * len(between) > rules.separators * n and len(between) >= 2)
        )
        dup += again
        gone += fails
        lost += n if fails else 0
        if not fails:
            stays.append(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup, "n_repeat_words": len(inside), "base_failed": failed,
        "kept": not failed and 100 * lost <= rules.lost * len(words),
        "n_lines_removed": gone, "n_words_removed": lost, "cleaned": "\n".join(stays),
    }


def odd_texts(seed=1, n=150):
    rng = random.Random(seed)
    pool = ["word", "Wort", "été", "STOP", "A", "||", "|", ">", "»", "go!!", "wh??", "x#y", "50%", "end.", "日本", "all", "rights", "reserved", " ", "\x0b", "\r"]
    lines = ["A line that comes again and again.", "Home | News | About", "ALL CAPS LINE WITHOUT END", "", "  ", "Copyright, All Rights Reserved"]
    out = [None, "", " ", "\n\n", "one", "a b c " * 40, "日本 " * 60, "#" * 300, "x" * 5000]
    for _ in range(n):
        made = []
        for _ in range(rng.randrange(12)):
            made.append(rng.choice(lines) if rng.random() < 0.3 else " ".join(rng.choice(pool) + rng.choice(["", str(rng.randrange(40))]) for _ in range(rng.randrange(1, 25))))
        out.append("\n".join(made))
    return out


def test_line_rules_equal_a_plain_pass(spark, documents, sample):
    rows = list(enumerate(odd_texts())) + [(1000 + i, t) for i, t in sample]
    rows += [(5, "again"), (5, "again"), (None, "no id")]
    got = R.clean_lines(documents(rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append({k: r[k] for k in plain_rules("")})
    expected = {}
    for i, t in rows:
        expected.setdefault(i, []).append(plain_rules(t))
    order = lambda rs: sorted(rs, key=str)
    for i in expected:
        assert order(by_id[i]) == order(expected[i]), i


def test_line_rules_on_a_very_long_text_and_no_rows(spark, documents):
    long = "\n".join(f"Line {i} has words{i} that{i} no{i} rule{i} drops{i} here{i}, {i * 7}." for i in range(120_000))
    row = R.clean_lines(documents([(1, long)])).first()
    assert row.kept and row.n_lines_removed == 0 and row.cleaned == long and row.n_words == len(long.split())
    assert R.clean_lines(documents([])).count() == 0


def test_kept_documents_of_labelled_quality(spark):
    folder = "/root/testdata/sf0.1"
    found = QUERIES["op12_quality_rules"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = found.filter("not base_failed").selectExpr("quality", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(junk) <= 0.05 * len(junk)


# --- fill in the middle ---------------------------------------------------------------


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def middle_texts(seed=2, n=200):
    rng = random.Random(seed)
    pieces = ["é", "日本語", "a", " ", "\n", "\n\n", "<", "P>", "<P", "S>", "M>", "word ", "\r", " ", "𝒳"]
    passage = "".join(f"A shared passage, sentence {i}, with ümlauts.\n" for i in range(60))
    out = [None, "", "\n", "a", "a\n", "\n\n\n", "<P>", "x<S>y", "<M", "a" * 100_000, "\n" * 50_000, "<P" * 9000, "x" * 8191 + "<M>", "x" * 8190 + "<M>"]
    for _ in range(n):
        made = "".join(rng.choice(pieces) for _ in range(rng.randrange(400)))
        out.append(made.replace("<P>", "").replace("<S>", "").replace("<M>", "") if rng.random() < 0.7 else made)
    return out + [f"{i}\n" * i + passage + "tail" * i for i in range(40)]


def test_fill_in_middle_equals_a_plain_pass(spark, documents, sample):
    rows = list(enumerate(middle_texts())) + [(1000 + i, t) for i, t in sample] + [(None, "no\nid\n"), (3, "again\nx"), (3, "again\nx")]
    got = M.restored(M.fill_in_middle(documents(rows))).collect()
    mine = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.restored) for r in got)
    expected = []
    for i, t in rows:
        n, form, p, m, output = plain_middle(i, t)
        expected.append((str(i), n, form, str(p), str(m), output, t or ""))
    assert mine == sorted(expected)


def test_chunks_do_not_depend_on_what_stands_before():
    rng = np.random.default_rng(5)
    passage = rng.integers(32, 127, 40_000).astype(np.uint8)
    ends = []
    for n in (0, 1, 977, 5000):
        data = np.concatenate([rng.integers(32, 127, n).astype(np.uint8), passage])
        own = M.chunk_ends(data, np.array([0, len(data)])) - n
        ends.append(set(own[own > 9000].tolist()))
    assert ends[0] == ends[1] == ends[2] == ends[3] and len(ends[0]) > 30


def test_chunks_cover_rows_and_are_bounded():
    rng = np.random.default_rng(6)
    data = np.concatenate([rng.integers(0, 256, 60_000).astype(np.uint8), np.full(50_000, 97, np.uint8)])
    rows = np.array([0, 0, 10, 70, 70, 60_005, len(data), len(data)])
    ends = M.chunk_ends(data, rows)
    assert set(rows[1:].tolist()) - {0} <= set(ends.tolist())
    assert np.diff(ends, prepend=0).max() <= M.LONGEST


def test_the_cache_remembers_and_forgets():
    passage = b"".join(b"line %d of a passage\n" % i for i in range(2000))
    cache = M.Cache()
    for k in range(4):
        text = b"%d" % k * (k * 50) + passage
        ends = M.chunk_ends(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        made = M.Text(text, ends.tolist(), cache)
        assert made.units == text.count(b"\n") + (not text.endswith(b"\n"))
        for unit in (0, 1, 7, 1999, made.units):
            cut = b"".join(text.splitlines(True)[:unit])
            assert made.cut(unit) == (len(cut), len(cut.decode()))
    assert cache.hits > 0.6 * cache.asked
    small = M.Cache(limit=10_000)
    for i in range(100):
        small.get(b"%d" % i * 300)
    assert small.size <= 10_000 and len(small.kept) < 30


@pytest.mark.parametrize("percent, spm, forms", [(0, 50, {"plain"}), (100, 100, {"spm"}), (100, 0, {"psm"})])
def test_shares_are_parameters(spark, documents, percent, spm, forms):
    rows = [(i, f"a {i}\nb\nc") for i in range(30)]
    assert {r.form for r in M.fill_in_middle(documents(rows), percent, spm).collect()} == forms


def test_fill_in_middle_of_no_rows(spark, documents):
    assert M.restored(M.fill_in_middle(documents([]))).count() == 0
