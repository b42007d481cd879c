import hashlib
import random

import brute
from pyspark.sql import functions as F

from tessera.llm import blocks, substring_dedup
from tessera.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def _check(documents, rows):
    got = [(str(r["doc_id"]), r["n_words"], r["kept"]) for r in substring_dedup.duplicate_factors(documents(rows)).collect()]
    want = [(str(d), n, kept) for d, n, _, kept in brute.repeats(rows)]
    assert sorted(got) == sorted(want)


def test_equals_brute_force(documents, sample):
    _check(documents, sample)


def test_across_blocks_and_odd_rows(documents, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    prose = lambda n: [word() for _ in range(n)]
    passages = [prose(rng.randint(30, 90)) for _ in range(5)]
    rows = []
    for i in range(120):
        parts = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            parts += rng.choice(passages)[rng.randint(0, 5) :] + prose(rng.randint(0, 40))
        rows.append((i, "  ".join(parts)))
    rows += [
        (None, None), (200, None), (201, ""), (202, " \t\n"), (203, "one two"), (204, "same word " * 40), (205, "x " * 35), (206, "x " * 36),
        (207, "É é É"), (208, "Case " * 34 + "a"), (209, "case " * 34 + "a"), (210, rows[3][1]), (210, rows[3][1]), (211, "y " * 50_000), (None, rows[5][1]),
    ]
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(blocks.blocks, "__defaults__", (2000,))
    _check(documents, rows)
    assert substring_dedup.duplicate_factors(documents([])).count() == 0


def test_query(spark, sample):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op1_substring_dedup"](spark, SMALL).collect()}
    want = {d: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute.repeats(sample)}
    assert got == want
