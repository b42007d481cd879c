"""Documents in compressed blocks, and questions from blocks to a distributed index.

A block is a few megabytes of consecutive documents as one row. An operator that needs
to know something of the whole corpus for each of a block's many keys asks by bucket:
every block sends each bucket the sorted distinct keys that fall to it, a bucket sees
the keys of all blocks and answers each in the same order. A key is sent once a block
however often it occurs, so no key is hot, and a bucket holds the keys of about
``BLOCKS_PER_BUCKET`` blocks' size, however many blocks there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only
from tessera.llm.words import slices
from tessera.session import staged

BLOCK_BYTES = 4 << 20
BLOCKS_PER_BUCKET = 6


def blocks(docs: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """block, doc_ids, sizes, data: the rows (doc_id, text) of ``docs``, zstd-compressed.

    Null text counts as empty; a document longer than ``limit`` is a block of its own.
    Written, so that numbers and order stay the same in every pass.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            nonlocal number
            data = b"".join(x[2] for x in held)
            number += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number - 1]),
                    pa.array([[i for x in held for i in x[0]]], pa.list_(held[0][3])),
                    pa.array([[n for x in held for n in x[1]]], pa.list_(pa.int64())),
                    pa.array([pa.compress(data, codec="zstd", asbytes=True)], pa.binary()),
                ],
                ["block", "doc_ids", "sizes", "data"],
            )

        for batch in batches:
            for rows, data, bounds in slices(batch, "text", limit):
                if held and size + len(data) > limit:
                    yield row()
                    held, size = [], 0
                ids = rows.column(0)
                held.append((ids.to_pylist(), np.diff(bounds).tolist(), data.tobytes(), ids.type))
                size += len(data)
        if held:
            yield row()

    return staged(
        only(docs, "doc_id", "text").mapInArrow(run, f"block bigint, doc_ids array<{kind}>, sizes array<bigint>, data binary"), "blocks"
    )


class Block:
    """One row of ``blocks``: ids, bytes and row bounds."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.number = batch.column("block")[i].as_py()
        self.doc_ids = batch.column("doc_ids")[i].values
        sizes = batch.column("sizes")[i].values.to_numpy(zero_copy_only=False)
        self.rows = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        packed = batch.column("data")[i].as_py()
        raw = pa.decompress(packed, decompressed_size=int(self.rows[-1]), codec="zstd", asbytes=True) if self.rows[-1] else b""
        self.data = np.frombuffer(raw, np.uint8)
        self.batch, self.index = batch, i

    def told(self, column: str) -> dict[int, bytes]:
        """The answers this block got, by bucket."""
        got = self.batch.column(column)[self.index].as_py() or []
        return {x["bucket"]: x["payload"] for x in got}


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch, i)


def buckets_for(found: DataFrame) -> int:
    return max(1, -(-found.count() // BLOCKS_PER_BUCKET))


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the keys (sorted uint64) of each bucket start, and the end."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def questions(number: int, bounds: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row a bucket that keys fall to: the columns of its keys, one after the other."""
    full = np.flatnonzero(np.diff(bounds))
    payload = [b"".join(c[bounds[b] : bounds[b + 1]].tobytes() for c in columns) for b in full]
    return pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array([number] * len(full), pa.int64()), pa.array(payload, pa.binary())],
        ["bucket", "block", "payload"],
    )


QUESTION = "bucket int, block bigint, payload binary"


def split_payload(payload: bytes, *kinds) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    n, at, out = len(payload) // width, 0, []
    for k in kinds:
        out.append(np.frombuffer(payload, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


#: Block number of the rows in which a bucket says something about all its keys.
SUMMARY = -1


def answer(asked: DataFrame, kinds: tuple, reply: Callable[..., np.ndarray], pack: bool, summary: Callable[..., bytes] | None = None) -> DataFrame:
    """block, bucket, payload: what each block is told for each question.

    ``reply(own, *columns)`` gets all keys of a bucket, with the number of the asking
    block within the bucket, and returns one value for each; with ``pack`` as one bit.
    ``summary(*columns)`` makes one more row a bucket, for block ``SUMMARY``. Written, as
    the answers are read more than once.
    """

    def run(table: pa.Table) -> pa.Table:
        columns = [split_payload(p.as_buffer().to_pybytes(), *kinds) for p in table.column("payload")]
        sizes = [len(c[0]) for c in columns]
        own = np.repeat(np.arange(len(sizes)), sizes)
        joined = [np.concatenate([c[k] for c in columns]) for k in range(len(kinds))]
        parts = np.split(reply(own, *joined), np.cumsum(sizes)[:-1])
        payload = [(np.packbits(v) if pack else v).tobytes() for v in parts]
        numbers, buckets = table.column("block").to_pylist(), table.column("bucket").to_pylist()
        if summary:
            payload.append(summary(*joined))
            numbers.append(SUMMARY)
            buckets.append(buckets[0])
        return pa.table({"block": pa.array(numbers, pa.int64()), "bucket": pa.array(buckets, pa.int32()), "payload": pa.array(payload, pa.binary())})

    return staged(asked.groupBy("bucket").applyInArrow(run, "block bigint, bucket int, payload binary"), "answers")


def with_answers(found: DataFrame, **answers: DataFrame) -> DataFrame:
    """Blocks with one more column for each set of answers; null where nothing was asked."""
    for name, told in answers.items():
        own = told.filter(F.col("block") != SUMMARY).groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias(name))
        found = found.join(own.hint("merge"), "block", "left")
    return found


def flags(bounds: np.ndarray, told: dict[int, bytes]) -> np.ndarray:
    """The packed bits of all buckets, in the order of the keys."""
    out = np.zeros(bounds[-1], bool)
    for b, payload in told.items():
        n = bounds[b + 1] - bounds[b]
        out[bounds[b] : bounds[b + 1]] = np.unpackbits(np.frombuffer(payload, np.uint8), count=int(n)).astype(bool)
    return out


def values(bounds: np.ndarray, told: dict[int, bytes], kind) -> np.ndarray:
    out = np.zeros(bounds[-1], kind)
    for b, payload in told.items():
        out[bounds[b] : bounds[b + 1]] = np.frombuffer(payload, kind)
    return out
