"""Ordered work against one sequential pass, with a key that spans partitions."""

import random
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.operators import chunking as C, monitoring as M
from tessera.operators.ordered import PART, _segments, last_values, ordered_fold, ordered_scan, range_sorted, running_totals


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def skewed_rows(n=3000, seed=5):
    """Two thirds of the rows belong to one key."""
    rng = random.Random(seed)
    keys = ["hot" if rng.random() < 0.67 else f"k{rng.randrange(40)}" for _ in range(n)]
    return [(k, i, rng.randrange(0, 50)) for i, k in enumerate(keys)]


def by_key(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return groups


def table(spark, rows):
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    return range_sorted(spark.createDataFrame(shuffled, "k string, o long, v long"), ["k"], ["o"])


def test_hot_key_spans_partitions(spark):
    ordered = table(spark, skewed_rows())
    spans = ordered.where("k = 'hot'").select(PART).distinct().count()
    assert spans >= 4


def test_running_totals(spark):
    rows = skewed_rows()
    out = running_totals(table(spark, rows), ["k"], ["o"], {"s": F.col("v"), "n": F.lit(1)}, {"all": F.lit(1)})
    got = {(r.k, r.o): (r.s, r.n, r["all"]) for r in out.collect()}
    for key, group in by_key(rows).items():
        total = 0
        for place, (_, o, v) in enumerate(group, 1):
            total += v
            assert got[key, o] == (total, place, len(group))


def test_running_totals_without_key_totals(spark):
    rows = skewed_rows(seed=8)
    got = {(r.k, r.o): r.n for r in running_totals(table(spark, rows), ["k"], ["o"], {"n": F.lit(1)}).collect()}
    for key, group in by_key(rows).items():
        assert [got[key, o] for _, o, _ in group] == list(range(1, len(group) + 1))


def test_last_values_cross_partitions(spark):
    rows = [(k, o, v if o % 997 == 5 else None) for k, o, v in skewed_rows()] + [(None, 1, 7), (None, 2, None)]
    out = last_values(table(spark, rows), ["k"], ["o"], "v", "seen").collect()
    got = {(r.k, r.o): r.seen for r in out}
    assert len(out) == len(rows)
    for key, group in by_key(rows).items():
        seen = None
        for _, o, v in group:
            seen = v if v is not None else seen
            assert got[key, o] == seen


def drifting(state, v):
    """A machine that never forgets: every partition depends on all before it."""
    state = (state * 31 + v) % 1_000_003
    return state, (state,)


def test_scan_that_never_settles(spark):
    rows = skewed_rows()
    out = ordered_scan(table(spark, rows), ["k"], ["v"], drifting, 7, "s long")
    got = {(r.k, r.o): r.s for r in out.collect()}
    for key, group in by_key(rows).items():
        state = 7
        for _, o, v in group:
            state, (want,) = drifting(state, v)
            assert got[key, o] == want


def test_fold_gives_one_row_per_key(spark):
    rows = skewed_rows()
    out = ordered_fold(table(spark, rows), ["k"], ["o"], ["v"], lambda s, v: drifting(s, v)[0], 7, "s long").collect()
    groups = by_key(rows)
    assert len(out) == len(groups)
    for r in out:
        state = 7
        for _, _, v in groups[r.k]:
            state, _ = drifting(state, v)
        assert r.s == state


def pack(tokens, limit):
    out, used, group = [], None, 0
    for t in tokens:
        if used is None or used + t > limit:
            used, group = t, group + 1
        else:
            used += t
        out.append(group)
    return out


def test_packing_equals_one_pass(spark):
    rows = skewed_rows()
    pages = spark.createDataFrame(rows, "site string, page_ord long, tokens long")
    got = {(r.site, r.page_ord): r.chunk_no for r in C.page_packing(pages, 120).collect()}
    for key, group in by_key(rows).items():
        assert [got[key, o] for _, o, _ in group] == pack([v for *_, v in group], 120)


def test_packing_golden(spark):
    pages = spark.createDataFrame([("s", i, t) for i, t in enumerate([5, 5, 5, 9, 1])], "site string, page_ord long, tokens long")
    got = C.page_packing(pages, 10).orderBy("page_ord").collect()
    assert [r.chunk_no for r in got] == [1, 1, 2, 3, 3]


def test_last_latencies(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.8 else "p", i * 10, i, float(rng.randrange(100))) for i in range(1500)]
    df = spark.createDataFrame(rows, "provider string, t_us long, call_id long, latency_ms double")
    got = {r.call_id: r.avg_latency for r in M.last_n_latency(df).collect()}
    seen = {}
    for provider, _, call, value in rows:
        window = seen.setdefault(provider, [])
        window.append(value)
        assert abs(got[call] - sum(window[-50:]) / len(window[-50:])) < 1e-9


def test_missing_keys_are_a_key(spark):
    rows = [(None if i % 2 else i % 5, i, i % 7) for i in range(1200)]
    shape = "k long, o long, v long"
    ordered = range_sorted(spark.createDataFrame(rows, shape), ["k"], ["o"])
    assert ordered.where("k is null").select(PART).distinct().count() > 1
    totals = running_totals(ordered, ["k"], ["o"], {"n": F.lit(1)}, {"all": F.lit(1)}).collect()
    scanned = {(r.k, r.o): r.s for r in ordered_scan(ordered, ["k"], ["v"], drifting, 7, "s long").collect()}
    folded = {r.k: r.s for r in ordered_fold(ordered, ["k"], ["o"], ["v"], lambda s, v: drifting(s, v)[0], 7, "s long").collect()}
    counted = {(r.k, r.o): (r.n, r["all"]) for r in totals}
    for key, group in by_key(rows).items():
        state = 7
        for place, (_, o, v) in enumerate(group, 1):
            state, _ = drifting(state, v)
            assert scanned[key, o] == state and counted[key, o] == (place, len(group))
        assert folded[key] == state


def test_nothing_in_nothing_out(spark):
    ordered = range_sorted(spark.createDataFrame([], "k string, o long, v long"), ["k"], ["o"])
    assert ordered_scan(ordered, ["k"], ["v"], drifting, 7, "s long").count() == 0
    assert ordered_fold(ordered, ["k"], ["o"], ["v"], lambda s, v: s, 7, "s long").count() == 0
    assert running_totals(ordered, ["k"], ["o"], {"n": F.lit(1)}).count() == 0


def test_moving_mean_over_tiny_stretches(spark):
    """One hot provider over many partitions, some with a single row of it."""
    from tessera.operators import monitoring as Q

    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.6 else f"p{rng.randrange(9)}", i, i, float(rng.randrange(1000))) for i in range(700)]
    for width, n in ((40, 50), (3, 7), (64, 2), (5, 1)):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            calls = spark.createDataFrame(rows, "provider string, t_us long, call_id long, latency_ms double")
            got = {r.call_id: r.avg_latency for r in Q.last_n_latency(calls, n).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        seen = {}
        for provider, _, call, latency in rows:
            recent = seen.setdefault(provider, [])
            recent.append(latency)
            window = recent[-n:]
            assert abs(got[call] - sum(window) / len(window)) < 1e-9


def test_stretches_of_spanning_keys():
    bounds = {0: ("a", "b"), 1: ("b", "b"), 3: ("b", "c"), 4: ("c", "c"), 5: ("d", "e"), 6: ("e", "e")}
    assert _segments({p: ((a,), (b,)) for p, (a, b) in bounds.items()}) == [
        (("b",), 0, 0, False), (("b",), 1, 1, False), (("b",), 2, 3, True),
        (("c",), 0, 3, False), (("c",), 1, 4, True),
        (("e",), 0, 5, False), (("e",), 1, 6, True),
    ]
    assert _segments({0: (("a",), ("b",)), 1: (("c",), ("c",))}) == []


def test_fold_over_many_tiny_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        rows = skewed_rows(n=200, seed=9)
        out = ordered_fold(table(spark, rows), ["k"], ["o"], ["v"], lambda s, v: f"{s},{v}", "", "s string").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.k: r.s for r in out} == {k: "".join(f",{v}" for *_, v in g) for k, g in by_key(rows).items()}


def test_packing_batches_equal_one_row_at_a_time():
    rng = random.Random(12)
    for _ in range(300):
        limit = rng.choice([0, 3, 10, 40])
        rows = [(rng.choice("ab"), rng.choice([0, 0, 1, 5, 11, 60])) for _ in range(rng.randrange(1, 40))]
        rows.sort(key=lambda r: r[0])
        want, used, before = [], -1, None
        for site, tokens in rows:
            opens = site != before or used + tokens > limit
            used, before = (tokens if opens else used + tokens), site
            want.append(int(opens))
        step, state, got, at, before = C._pack_step(limit), -1, [], 0, None
        while at < len(rows):
            batch = rows[at : at + rng.randrange(1, 9)]
            new = [before is not None and batch[0][0] != before] + [a[0] != b[0] for a, b in zip(batch, batch[1:])]
            state, (opens,) = step(state, np.array(new), pd.Series([t for _, t in batch]))
            got += opens.tolist()
            at, before = at + len(batch), batch[-1][0]
        assert got == want and state == used


def test_packing_of_missing_sites_and_small_batches(spark):
    rng = random.Random(13)
    rows = [(rng.choice([None, "hot", "hot", "hot", "x"]), i, rng.choice([0, 3, 7, 30])) for i in range(900)]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        pieces = spark.createDataFrame(rows, "site string, page_ord long, tokens long")
        got = {r.page_ord: r.chunk_no for r in C.page_packing(pieces, 25).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    for _, group in by_key(rows).items():
        used, chunk = 99, 0
        for _, place, tokens in group:
            used, chunk = (tokens, chunk + 1) if used + tokens > 25 else (used + tokens, chunk)
            assert got[place] == chunk


def test_answers_of_a_hot_key_are_shared_from_their_making(spark):
    """A repeat just over the full hour is a hit, one over the time is not, and empty answers are not kept."""
    ttl, hour = M.FETCH_TTL_US, 3_600_000_000
    state, out = M.fetch_step(M.FETCH_START, 0, True)
    assert (state, out) == (0, (False, 0))
    assert M.fetch_step(state, ttl, True) == (0, (True, 0))
    assert M.fetch_step(state, ttl + 1, False) == (M.FETCH_START, (False, ttl + 1))
    rng = random.Random(7)
    rows = [("a", hour - 5, 0, True), ("a", hour + 5, 1, True), ("a", 2 * hour - 5, 2, False), ("a", 2 * hour + 5, 3, False), ("a", 2 * hour + 6, 4, True)]
    now = 0
    for i in range(5, 2500):
        now += rng.choice([1, hour // 9, hour // 2])
        rows.append(("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", now, i, rng.random() < 0.6))
    want, made = {}, {}
    for key, t, call, has in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[call] = hit = key in made and t - made[key] <= ttl
        if not hit:
            made.pop(key, None)
            if has:
                made[key] = t
    assert [want[i] for i in range(5)] == [False, True, True, False, False]
    df = spark.createDataFrame(rows, "key string, t_us long, call_id long, has_results boolean").repartition(5)
    assert {r.call_id: r.is_hit for r in M.request_coalesce(df).collect()} == want
    total = M.cache_hit_rate(M.request_coalesce(df)).first()
    assert (total.hits, total.misses) == (sum(want.values()), len(want) - sum(want.values()))
    assert total.hit_rate == sum(want.values()) / len(want)
