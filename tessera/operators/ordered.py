"""Work that depends on the order of rows within a key, for keys of any size.

A window or ``applyInPandas`` puts all rows of a key into one task. That fails
when one key holds a third of a large table. Here rows are range-partitioned by
(key, order), so a big key spans many partitions, each a contiguous stretch.

* ``running_totals``: sums up to each row. Every partition sums on its own, then
  the totals of earlier partitions of the same key are added.
* ``ordered_scan``: a state machine over each key. What a partition hands to the
  next is the state of its last key, so only the rows of that key are looked at
  first. Partitions wholly inside one key start from a guess and are run again
  until the states agree. Then all rows are labelled in one pass. The result
  equals one sequential pass per key.

* ``last_values``: the newest value up to each row, carried the same way.
* ``ordered_fold``: one value per key. Values of keys that span partitions pass from
  stretch to stretch as rows of written tables.

The sorted rows are checkpointed: range bounds come from a sample, and a lost
executor must not lead to other bounds halfway through.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from tessera.session import input_width, pinned, scratch_folder, staged

PART = "_part"


def range_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows sorted by (keys, order) over the whole table, with their partition number.

    ``order`` must make rows of a key distinct. Pass narrow rows: they are
    shuffled once and written once.
    """
    by = [*keys, *order]
    return pinned(
        df.repartitionByRange(input_width(df), *by)
        .sortWithinPartitions(*by)
        .withColumn(PART, F.spark_partition_id())
    )


def _join_same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join that also matches missing keys with missing keys."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(right, same, how).drop(*[f"_r_{c}" for c in on])


def running_totals(
    ordered: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    key_totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Add sums over each key up to and including the row.

    ``key_totals`` adds sums over the whole key. ``ordered`` comes from
    ``range_sorted`` or ``ordered_scan``.
    """
    keys = list(keys)
    on = [PART, *keys]
    within = (
        Window.partitionBy(*on)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ordered.select("*", *[F.sum(c).over(within).alias(n) for n, c in totals.items()])
    parts = ordered.groupBy(*on).agg(
        *[F.sum(c).alias(f"_sum_{n}") for n, c in {**totals, **(key_totals or {})}.items()]
    )
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        *on,
        *[F.sum(f"_sum_{n}").over(before).alias(f"_before_{n}") for n in totals],
        *[F.sum(f"_sum_{n}").over(whole).alias(n) for n in key_totals or {}],
    )
    if not key_totals:
        # Only the first key of a partition can have rows in an earlier one, so
        # this side has at most one row per partition.
        first = next(iter(totals))
        carried = F.broadcast(carried.where(F.col(f"_before_{first}").isNotNull()))
    joined = _join_same(local, carried, on, "left")
    return joined.withColumns(
        {n: F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n in totals}
    ).drop(*[f"_before_{n}" for n in totals])


def last_values(ordered: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the last value that is not null of the row's key, up to and including the row.

    Each partition gives the last value of each of its keys; only the first key of a
    partition can have one in an earlier partition, so the side that is joined has at most
    one row a partition.
    """
    keys, on = list(keys), [PART, *keys]
    within = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ordered.withColumn(name, F.last(value, ignorenulls=True).over(within))
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    parts = ordered.groupBy(*on).agg(F.max_by(value, known).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*on, F.last("_last", ignorenulls=True).over(before).alias("_before"))
    joined = _join_same(local, F.broadcast(carried.where(F.col("_before").isNotNull())), on, "left")
    return joined.withColumn(name, F.coalesce(name, "_before")).drop("_before")


def earlier_values(ordered: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int, name: str) -> DataFrame:
    """Add the last up to ``n`` values of the row's key from before the row's partition.

    Only the first key of a partition has any. Each partition gives the tail of each of
    its keys; as it holds at least one row of the key, the last ``n`` values lie in the
    tails of the ``n`` partitions before. The side that is joined has at most one row a
    partition.
    """
    keys = list(keys)
    back = Window.partitionBy(PART, *keys).orderBy(*[F.col(c).desc() for c in order])
    tails = (
        ordered.withColumn("_back", F.row_number().over(back))
        .where(F.col("_back") <= n)
        .groupBy(PART, *keys)
        .agg(F.sort_array(F.collect_list(F.struct(*order, value))).alias("_tail"))
        .select(PART, *keys, F.transform("_tail", lambda r: r[value]).alias("_tail"))
    )
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(-n, -1)
    earlier = F.flatten(F.collect_list("_tail").over(before))
    halos = tails.select(PART, *keys, F.slice(earlier, F.greatest(F.size(earlier) - n, F.lit(0)) + 1, n).alias(name))
    return _join_same(ordered, F.broadcast(halos.where(F.size(name) > 0)), [PART, *keys], "left")


Step = Callable[..., tuple[Any, tuple]]
BatchStep = Callable[..., tuple[Any, list]]


def _values(column: pd.Series) -> list:
    """Plain values of a column, ``None`` for missing ones."""
    if column.isna().any():
        column = column.astype(object).where(column.notna(), None)
    return column.tolist()


def _key_changes(pdf: pd.DataFrame, keys, before) -> np.ndarray:
    """Whether a key begins at each row; ``before`` is the key of the last row before, None at the start."""
    new = np.zeros(len(pdf), bool)
    for k in keys:
        values, missing = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
        differ = values[1:] != values[:-1]
        new[1:] |= (differ | missing[1:] | missing[:-1]) & ~(missing[1:] & missing[:-1])
    new[0] = before is not None and before != _row_key(pdf, keys, 0)
    return new


def _row_key(pdf: pd.DataFrame, keys, at: int) -> tuple:
    return tuple(_values(pdf[k].iloc[[at]])[0] for k in keys)


def _each_row(step: Step, start: Any) -> BatchStep:
    """A step for one row at a time as a step for a batch."""

    def run(state, new, *columns):
        outputs = []
        for begins, values in zip(new.tolist(), zip(*[_values(c) for c in columns])):
            state, out = step(start if begins else state, *values)
            outputs.append(out)
        return state, list(zip(*outputs))

    return run


def _walk(batches, keys, inputs, step, start, entries, on_batch):
    """Fold the rows of one partition; ends with (part, entered, state).

    ``entries`` holds the state of the first key of a partition where it is not
    the start state; ``entered`` tells which one was used.
    """
    part = key = state = entered = None
    for pdf in batches:
        if len(pdf) == 0:
            continue
        if part is None:
            part = int(pdf[PART].iloc[0])
            state = entered = entries.get(part, start)
        new = _key_changes(pdf, keys, key)
        key = _row_key(pdf, keys, -1)
        state, outputs = step(state, new, *[pdf[c] for c in inputs])
        if on_batch is not None:
            yield on_batch(pdf, outputs)
    if part is not None and on_batch is None:
        yield part, entered, state


def _key_bounds(ordered: DataFrame, keys: list[str]) -> dict:
    """First and last key of each partition: one small row per partition."""
    key = F.struct(*keys)
    rows = ordered.groupBy(PART).agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()
    return {r[PART]: (tuple(r["first"]), tuple(r["last"])) for r in rows}


def _last_key_rows(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the last key of each partition, in their places.

    Only these can matter to a later partition. The joined side has one row per
    partition.
    """
    last = ordered.groupBy(PART).agg(F.max(F.struct(*keys)).alias("_last")).select(PART, "_last.*")
    return _join_same(ordered, F.broadcast(last), [PART, *keys], "left_semi")


def _ends(tails, keys, inputs, step, start, entries) -> dict:
    """State in which each partition's last key ends, one small row per partition."""

    def run(batches):
        for end in _walk(batches, keys, inputs, step, start, entries, None):
            yield pd.DataFrame({"end": [pickle.dumps(end)]})

    rows = tails.mapInPandas(run, "end binary").collect()
    return {end[0]: end for end in (pickle.loads(bytes(r["end"])) for r in rows)}


def _arrivals(bounds: dict, ends: dict) -> dict:
    """The state in which the first key of each partition arrives from the one before."""
    arrivals, previous = {}, None
    for part in sorted(bounds):
        first, last = bounds[part]
        if previous is not None and previous[0] == first:
            arrivals[part] = previous[1]
        previous = (last, ends[part][2])
    return arrivals


def settled(ordered, keys, inputs, step, start) -> tuple[dict, dict]:
    """Key bounds of all partitions, and the states their first keys arrive in.

    A partition's last key starts inside it, and its end is known at once, unless
    the partition lies wholly inside one key. Such partitions are run from the
    start state first, and again only where that guess was wrong.
    """
    bounds = _key_bounds(ordered, keys)
    tails = _last_key_rows(ordered, keys)
    ends = _ends(tails, keys, inputs, step, start, {})
    while True:
        arrivals = _arrivals(bounds, ends)
        stale = [
            part
            for part, (first, last) in bounds.items()
            if first == last and arrivals.get(part, start) != ends[part][1]
        ]
        if not stale:
            return bounds, arrivals
        known = {part: arrivals[part] for part in stale if part in arrivals}
        again = tails.where(F.col(PART).isin(stale))
        ends.update(_ends(again, keys, inputs, step, start, known))


def ordered_scan(
    ordered: DataFrame,
    keys: Sequence[str],
    inputs: Sequence[str],
    step: Step,
    start: Any,
    outputs: str,
    batched: bool = False,
) -> DataFrame:
    """Add the outputs of a state machine that runs over each key in order.

    ``step(state, *inputs) -> (state, outputs)`` must be a plain function of its
    arguments; states are compared with ``==``. ``outputs`` is a DDL string.
    A ``batched`` step takes many rows at once, ``step(state, new, *columns) -> (state,
    output columns)``: ``state`` is that of the key of the first row, and ``new`` says where
    later keys begin, each from ``start``. What reaches the driver is one small row per
    partition.
    """
    keys, inputs = list(keys), list(inputs)
    step = step if batched else _each_row(step, start)
    _, arrivals = settled(ordered, keys, inputs, step, start)
    names = [field.strip().split(" ")[0] for field in outputs.split(",")]

    def label(pdf, rows):
        return pdf.assign(**{n: list(v) for n, v in zip(names, rows)})

    def run(batches):
        yield from _walk(batches, keys, inputs, step, start, arrivals, label)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.mapInPandas(run, f"{schema}, {outputs}")


def _same(value):
    return value


def _segments(bounds: dict) -> list[tuple]:
    """Stretches of the keys that span partitions: (key, place in its chain, partition, is the last)."""
    out: list[tuple] = []
    parts = sorted(bounds)
    for before, part in zip(parts, parts[1:]):
        first, last = bounds[part]
        if bounds[before][1] != first:
            continue
        if not out or out[-1][2] != before or out[-1][3]:
            out.append((first, 0, before, False))
        out.append((first, out[-1][1] + 1, part, first != last))
    # A chain also ends where the next partition starts with another key.
    return [
        (key, at, part, last or i + 1 == len(out) or out[i + 1][1] == 0) for i, (key, at, part, last) in enumerate(out)
    ]


def ordered_fold(
    ordered: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    step: Callable[..., Any],
    start: Any,
    output: str,
    enter: Callable[[Any], Any] = _same,
    leave: Callable[[Any], Any] = _same,
) -> DataFrame:
    """The value each key's fold ends in: one row per key.

    ``step(state, *inputs) -> state`` runs over the rows of a key in order, from
    ``enter(start)``; ``leave(state)`` is the value, and ``output`` names and types it.
    A key inside one partition is folded there. A key that spans partitions is a chain of
    stretches: the first ones of all keys are folded at once, then the second ones from
    the values of the first, and so on. Values pass from one step to the next as rows of a
    written table, next to the rows of the stretch that needs them, never through the
    driver. Each stretch is read once, so the work is linear whatever the machine does;
    the number of steps is the number of partitions of the longest key.
    """
    keys, order, inputs = list(keys), list(order), list(inputs)
    spark = ordered.sparkSession
    bounds = _key_bounds(ordered, keys)
    chains = _segments(bounds)
    comes_in = {part for _, at, part, _ in chains if at > 0}
    goes_on = {part for _, _, part, last in chains if not last}
    name = output.split(" ")[0]
    types = ", ".join(f"`{k}` {ordered.schema[k].dataType.simpleString()}" for k in keys)

    def frame(done):
        columns = {k: [d[0][i] for d in done] for i, k in enumerate(keys)}
        return pd.DataFrame({**columns, name: [leave(d[1]) for d in done]})

    def inside(batches):
        """Keys that begin and end in the partition."""
        held, part, first = None, None, True
        for pdf in batches:
            if len(pdf) == 0:
                continue
            done = []
            part = int(pdf[PART].iloc[0])
            for row_key, values in zip(zip(*[_values(pdf[k]) for k in keys]), zip(*[_values(pdf[c]) for c in inputs])):
                if held is None or held[0] != row_key:
                    if held is not None:
                        if not (first and part in comes_in):
                            done.append(held)
                        first = False
                    held = (row_key, enter(start))
                if first and part in comes_in:
                    continue
                held = (row_key, step(held[1], *values))
            if done:
                yield frame(done)
        if held is not None and part not in goes_on and not (first and part in comes_in):
            yield frame([held])

    whole = ordered.mapInPandas(inside, f"{types}, {output}")
    if not chains:
        return whole

    places = spark.createDataFrame(
        [(*key, at, part, last) for key, at, part, last in chains],
        f"{types}, _at int, {PART} int, _ends boolean",
    )
    folder = scratch_folder(spark, "stretches")
    spanning = _join_stretches(ordered, places, keys)
    spanning.select(*dict.fromkeys([*keys, *order, *inputs]), "_at", "_ends").write.partitionBy("_at").parquet(folder)

    def stretch(batches):
        """Stretches of one step, each after the value that it starts from."""
        held, ends = None, None
        for pdf in batches:
            done = []
            rows = zip(*[_values(pdf[k]) for k in keys])
            values = zip(*[_values(pdf[c]) for c in inputs])
            for row_key, taken, is_value, value, last in zip(rows, values, pdf["_is_value"].tolist(), pdf["_value"].tolist(), pdf["_ends"].tolist()):
                if held is None or held[0] != row_key:
                    if held is not None:
                        done.append((*held, ends))
                    held = (row_key, enter(value if is_value else start))
                if not is_value:
                    held, ends = (row_key, step(held[1], *taken)), last
            if done:
                yield frame(done).assign(_ends=[d[2] for d in done])
        if held is not None:
            yield frame([held]).assign(_ends=[ends])

    value_type = output.split(" ", 1)[1]
    found, carried = [whole], None
    for at in range(1 + max(at for _, at, _, _ in chains)):
        rows = spark.read.parquet(f"{folder}/_at={at}").withColumns({"_is_value": F.lit(False), "_value": F.lit(start).cast(value_type)})
        if carried is not None:
            rows = rows.unionByName(carried, allowMissingColumns=True)
        rows = rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("_is_value"), *order)
        folded = staged(rows.mapInPandas(stretch, f"{types}, {output}, _ends boolean"), f"folded-{at}")
        found.append(folded.where("_ends").drop("_ends"))
        # Numbers stay whole numbers in pandas only where none is missing.
        unused = [F.lit(0).cast(rows.schema[c].dataType).alias(c) for c in inputs if isinstance(rows.schema[c].dataType, NumericType)]
        carried = folded.where("not _ends").select(
            *keys, *unused, F.lit(True).alias("_is_value"), F.col(name).alias("_value"), F.lit(False).alias("_ends")
        )
    return reduce(DataFrame.unionByName, found)


def _join_stretches(ordered: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of spanning keys with their place in the chain; the other side has two rows a partition at most."""
    return _join_same(ordered, F.broadcast(places), [PART, *keys], "inner")
