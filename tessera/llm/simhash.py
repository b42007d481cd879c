"""Near-duplicates by SimHash, found through an inverted index of byte positions.

Two 64-bit fingerprints that differ in at most two bits share at least six of their
eight positional bytes. The index is therefore kept by conjunctions of six positions:
posting list (positions, their bytes) holds the fingerprints with those bytes, and two
fingerprints meet in some list exactly if their tally of shared positional bytes is six
or more. Single-byte lists would hold a 256th of all fingerprints each, and tallying
their pairs grows with the square of the input; a list of six bytes leaves 16 bits free,
so it never holds more than 65,536 fingerprints, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, only
from tessera.llm.components import components
from tessera.llm.words import text_bytes
from tessera.session import staged

SHINGLE = 3
SEED = 42
BITS_APART = 2
POSITIONS = 8
MATCHES = POSITIONS - BITS_APART
#: Lists up to this long are compared member by member, longer ones by bit flips.
SMALL_LIST = 256
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of a text: the bits set in over half of their XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(joined, SEED)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    count = len(words) - shingle + 1
    set_bits = np.zeros(64, np.int64)
    for i in range(0, count, HASHES_AT_ONCE):
        to = min(count, i + HASHES_AT_ONCE)
        pieces = zip(at[i:to].tolist(), (at[i + shingle : to + shingle] - 1).tolist())
        hashes = np.array([hashed(joined[a:b], SEED) for a, b in pieces], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * set_bits > count].sum(dtype=np.uint64))


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            data = data.tobytes() if len(bounds) < 2 else memoryview(np.ascontiguousarray(data))
            found = [fingerprint(bytes(data[a:b]), shingle) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fingerprint"]
            )

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the 64-bit fingerprint (as a signed long) of each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return only(docs, "doc_id", "text").mapInArrow(_fingerprints(shingle), f"doc_id {kind}, fingerprint bigint")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _verified(members: np.ndarray, positions: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a posting list at most two bits apart."""
    n = len(members)
    if n <= SMALL_LIST:
        apart = members[:, None] ^ members[None, :]
        by_byte = apart[:, :, None].view(np.uint8).reshape(n, n, POSITIONS)
        tally = (by_byte == 0).sum(axis=2)
        i, j = np.nonzero(np.triu(tally >= MATCHES, 1))
        near = _popcount(apart[i, j]) <= BITS_APART
        return i[near], j[near]
    # Only the free positions can differ: flip each one or two of their bits and look it up.
    free = [8 * p + b for p in range(POSITIONS) if p not in positions for b in range(8)]
    flips = [np.uint64(1 << a) for a in free] + [np.uint64(1 << a | 1 << b) for a, b in combinations(free, 2)]
    order = np.argsort(members)
    ordered = members[order]
    left, right = [], []
    for flip in flips:
        wanted = members ^ flip
        at = np.minimum(np.searchsorted(ordered, wanted), n - 1)
        hit = np.flatnonzero((ordered[at] == wanted) & (wanted > members))
        left.append(hit)
        right.append(order[at[hit]])
    return np.concatenate(left), np.concatenate(right)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member each member reaches."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


_CHOICES = list(combinations(range(POSITIONS), MATCHES))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by posting list; a list may span batches."""
    held: list[np.ndarray] = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def lists_of(choice, key, fp) -> pa.RecordBatch:
        edge = np.ones(len(key) + 1, bool)
        edge[1:-1] = (key[1:] != key[:-1]) | (choice[1:] != choice[:-1])
        bounds = np.flatnonzero(edge)
        a, b = [], []
        for k in np.flatnonzero(np.diff(bounds) > 1):
            members = np.unique(fp[bounds[k] : bounds[k + 1]].view(np.uint64))
            if len(members) < 2:
                continue
            i, j = _verified(members, _CHOICES[choice[bounds[k]]])
            root = _forest(len(members), i, j)
            child = np.flatnonzero(root != np.arange(len(members)))
            a.append(members[child])
            b.append(members[root[child]])
        none = np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([*x, none]).view(np.int64)) for x in (a, b)], ["a", "b"]
        )

    for batch in batches:
        now = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
        if not len(now[0]):
            continue
        last = np.flatnonzero((now[1] != now[1][-1]) | (now[0] != now[0][-1]))
        cut = last[-1] + 1 if len(last) else 0
        held = [x[cut:] for x in now]
        if cut:
            yield lists_of(*(x[:cut] for x in now))
    if len(held[0]):
        yield lists_of(*held)


def links(prints: DataFrame) -> DataFrame:
    """Verified links (a, b) between different fingerprints.

    Of the pairs of one posting list a forest is kept that joins the same fingerprints,
    so a dense list gives one row a member and not one a pair.
    """
    masks = [sum(0xFF << 8 * p for p in c) for c in _CHOICES]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = prints.select("fingerprint").distinct().select(
        F.posexplode(F.array(*(F.col("fingerprint").bitwiseAND(F.lit(m)) for m in signed))).alias("choice", "key"),
        "fingerprint",
    )
    return rows.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(_links, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (signed long), component_id.

    component_id is the smallest doc_id reachable through links of at most two differing
    bits, the row's own included. Words are split at space and 0x09 to 0x0D after A to Z
    are lower-cased; shingles are three words, repeats included; a shorter text is one
    shingle, a null, empty or blank one has fingerprint zero and is linked like any
    other. Equal fingerprints are always linked. Null doc_ids are passed over in the
    minimum; a component of nothing else has a null id. Repeated rows give repeated
    rows, no documents none.
    """
    prints = staged(fingerprints(docs, shingle), "fingerprints")
    return with_components(prints)


def with_components(prints: DataFrame) -> DataFrame:
    roots = staged(components(links(prints)), "roots")
    classes = (
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
        .join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
        .select("fingerprint", "least", "size", F.coalesce("root", "fingerprint").alias("root"))
    )
    classes = staged(classes, "classes")
    ids = staged(classes.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("size").alias("members")), "ids")
    named = staged(classes.select("fingerprint", "root").join(ids.hint("merge"), "root").select("fingerprint", "component_id"), "named")
    return prints.join(named.hint("merge"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with their columns.

    The row with the smallest doc_id stays; among rows without one, or with the same,
    the one with the smallest text hash. Of rows equal in both one stays.
    """
    key, plain = fresh(docs, "row_key"), "doc_id"
    rows = docs.withColumn(key, F.xxhash64(docs["doc_id"], docs["text"]))
    place = F.struct(rows["doc_id"].isNull().alias("no_id"), rows["doc_id"].alias("id"), F.col(key).alias("key"))
    placed = rows.select(place.alias(plain), rows["text"].alias("text"))
    found = with_components(staged(fingerprints(placed, shingle), "fingerprints"))
    stay = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.key").alias(key), F.col("doc_id.id").alias(fresh(docs, "stay_id"))).distinct()
    rows = rows.join(stay.hint("merge"), key).filter(F.col("doc_id").eqNullSafe(F.col(fresh(docs, "stay_id"))))
    return rows.dropDuplicates([key, "doc_id"]).select(*docs.columns)
