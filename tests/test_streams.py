"""Streams give what their batch forms give, over several micro-batches."""

import random

import __spark_entry__ as entry
from tessera.catalog import calls as C
from tessera.catalog.registry import Tables
from tessera.operators import monitoring as M
from tessera.session import scratch_folder
from tessera.streaming import keyed, stages

SMALL = "/root/testdata/sf0.001"


def rows(spark, name, *columns):
    return sorted(tuple(r) for r in entry.queries()[name](spark, SMALL).select(*columns).collect())


def run(stream, spark, out, mark):
    running = stages.append_stream(stream, out, mark)
    running.awaitTermination()
    assert running.exception() is None
    return running.recentProgress


def folders(spark, *names):
    return [scratch_folder(spark, f"test-{n}") for n in names]


def sessions(attempts, gap):
    """Outages in plain Python: (domain, from, to, failures)."""
    out, open_ = [], {}
    for domain, t, ok in sorted(attempts):
        if ok:
            continue
        if domain in open_ and t - open_[domain][1] <= gap:
            open_[domain][1:] = [t, open_[domain][2] + 1]
        else:
            out.append(open_[domain] if domain in open_ else None)
            open_[domain] = [t, t, 1]
            out[-1] = out[-1] and (domain, *out[-1])
    return sorted([o for o in out if o] + [(d, *o) for d, o in open_.items()])


def test_outages_of_a_hot_domain(spark):
    rng = random.Random(3)
    rows, now = [], 0
    for _ in range(3000):
        now += rng.choice([1, 9, 10, 11, 40])
        rows.append(("hot" if rng.random() < 0.8 else f"d{rng.randrange(4)}", now, rng.random() < 0.5))
    df = spark.createDataFrame(rows, "domain string, t_us long, ok boolean").repartition(6)
    got = sorted(tuple(r) for r in M.outage_sessions(df, gap_us=10).collect())
    assert got == sessions(rows, 10)


def test_late_attempts_are_dropped_and_counted(spark):
    """A row older than the watermark of the micro-batch before adds to nothing; state goes once passed."""
    source, out, mark = folders(spark, "in", "out", "mark")
    minute = 60_000_000
    batches = [
        [("a", 1 * minute, False), ("a", 2 * minute, False)],
        [("a", 60 * minute, False), ("b", 61 * minute, True)],
        [("b", 62 * minute, True)],
        [("a", 3 * minute, False), ("a", 59 * minute, False), ("a", 200 * minute, True)],
        [("b", 400 * minute, True)],
    ]
    shape = "domain string, t_us long, ok boolean"
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
    stream = stages.file_stream(spark, source, spark.createDataFrame([], shape).schema, per_trigger=1)
    progress = run(M.outage_sessions(stream, 2 * minute, 5 * minute), spark, out, mark)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("domain", "from_us", "to_us", "failures").collect())
    assert got == [("a", 1 * minute, 2 * minute, 2), ("a", 59 * minute, 60 * minute, 2)]
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 1
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0 and len(progress) >= 4


def test_first_requests_over_micro_batches(spark):
    source, out, mark = folders(spark, "in", "out", "mark")
    shape, hour = "key string, t_us long", 3_600_000_000
    asked = [[("a", 5), ("a", 9), ("b", hour - 1)], [("a", 7), ("a", hour), ("b", hour + 3)], [("a", 9 * hour), ("b", 9 * hour + 1)], [("a", 9 * hour + 5), ("c", 30 * hour)]]
    for rows in asked:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
    stream = stages.file_stream(spark, source, spark.createDataFrame([], shape).schema, per_trigger=1)
    progress = run(M.first_requests(stream), spark, out, mark)
    table = spark.createDataFrame([r for rows in asked for r in rows], shape)
    pairs = lambda df: sorted(tuple(r) for r in df.select("key", "hour").collect())
    assert pairs(spark.read.parquet(out)) == pairs(M.first_requests(table)) == [("a", 0), ("a", 1), ("a", 9), ("b", 0), ("b", 1), ("b", 9), ("c", 30)]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert held[-1] < max(held)


def test_health_goes_on_after_a_restart(spark):
    """Two ranges of time, then the others with the same checkpoint: as in one batch."""
    source, out, mark = folders(spark, "in", "out", "mark")
    tables = Tables(spark, SMALL)
    stream = lambda: C.calls(stages.file_stream(spark, source, tables.events.schema, per_trigger=C.SLOT_FILES))
    for slots in ([0, 1], [2, 3, 4]):
        C.write_slots(tables.events, "ts", source, only=slots)
        C._finish(keyed.health_stream(stream(), out, mark), tables, out)
    numbers = keyed.score_now(keyed.latest_health(spark, out), C.AS_OF_US).select("provider", "total", "health_score")
    assert spark.read.parquet(out).select("epoch").distinct().count() == C.SLOTS
    batch = entry.queries()["provider_health"](spark, SMALL).select("provider", "total", "health_score")
    assert sorted(map(tuple, numbers.collect())) == sorted(map(tuple, batch.collect()))


def test_health_over_micro_batches(spark):
    columns = ("provider", "health_score", "status")
    assert rows(spark, "health_stream", *columns) == rows(spark, "provider_health", *columns)


def test_upserts_over_micro_batches_in_any_order(spark, tmp_path):
    """Three files, the newest rows first: the table ends with the newest row of each key."""
    source, table, mark = (scratch_folder(spark, f"test-{n}") for n in ("in", "table", "mark"))
    schema = "k long, ts long, v string"
    for ts in (3, 1, 2):
        spark.range(20).selectExpr("id % 7 as k", f"{ts} * 100 + id as ts", f"concat('v', {ts} * 100 + id) as v").coalesce(1).write.mode("append").parquet(source)
    stream = stages.file_stream(spark, source, spark.createDataFrame([], schema).schema, per_trigger=1)
    running = stages.stage_stream(stream, lambda batch: batch.withColumn("tie", batch.ts), table, mark, "k", "ts", "tie")
    running.awaitTermination()
    assert running.exception() is None and len(running.recentProgress) >= 3
    got = {r.k: r.v for r in spark.read.parquet(table).collect()}
    assert got == {k: f"v{300 + max(i for i in range(20) if i % 7 == k)}" for k in range(7)}
