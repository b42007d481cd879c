"""Url filtering: a blocked Bloom filter first, an exact hash join for what it passes.

A list holds canonical url prefixes (host, path) with a verdict. A url is looked up
under every suffix of its host and every path length the list has. The filter answers
most of these look-ups inside the scan; only possible hits reach the join, which
removes the filter's false positives, and the longest entry decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import UPPER, only
from tessera.session import staged

WORDS_IN_BLOCK = 8
KEYS_IN_BLOCK = 32  # 16 bits a key: below one false positive in a thousand
MAX_FILTER_BYTES = 32 << 20
MAX_PATH_LENGTHS = 8192
#: A list of at most this many entries is broadcast to the exact join.
SMALL_LIST = 10_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; else empty."""
    at = F.locate("://", url)
    host = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0)
    return F.coalesce(F.when(at > 0, F.translate(host, UPPER, UPPER.lower())), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


class BlockedBloom:
    """Blocks of eight 64-bit words; a key sets one bit in each word of its block.

    Blocks are combined with ``bit_or`` on the cluster, and the filter is collected only
    where its size, known from the number of keys, is within ``MAX_FILTER_BYTES``. A
    longer list has no filter (``blocks`` 0): every look-up then goes to the exact join.
    """

    def __init__(self, keys: DataFrame, key: str):
        n = keys.count()
        blocks = max(1, -(-n // KEYS_IN_BLOCK))
        self.blocks = blocks if blocks * WORDS_IN_BLOCK * 8 <= MAX_FILTER_BYTES else 0
        self.words = np.zeros((max(1, self.blocks), WORDS_IN_BLOCK), np.int64)
        if not self.blocks:
            return
        h, bits = _hashes(F.col(key))
        rows = keys.select(F.pmod(h, F.lit(self.blocks)).cast("int").alias("block"), bits.alias("bits"))
        masks = [
            F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(bits, {6 * i}) & 63L))")).alias(f"w{i}")
            for i in range(WORDS_IN_BLOCK)
        ]
        for r in rows.groupBy("block").agg(*masks).collect():
            self.words[r["block"]] = [r[f"w{i}"] for i in range(WORDS_IN_BLOCK)]

    def may_have(self, h: Column, bits: Column) -> Column:
        """Of two equal-long arrays of hashes, which keys may be listed."""
        if not self.blocks:
            return F.transform(h, lambda _: F.lit(True))
        blocks = self.blocks
        shared = self._shared

        @F.pandas_udf("array<boolean>")
        def probe(h: pd.Series, bits: pd.Series) -> pd.Series:
            words = shared.value
            sizes = np.fromiter((0 if x is None else len(x) for x in h), np.int64, len(h))
            if not sizes.sum():
                return pd.Series([[] for _ in sizes])
            hs = np.concatenate([x for x in h if x is not None and len(x)])
            bs = np.concatenate([x for x in bits if x is not None and len(x)]).astype(np.uint64)
            block = np.mod(hs, blocks)
            found = np.ones(len(hs), bool)
            for i in range(WORDS_IN_BLOCK):
                bit = (bs >> np.uint64(6 * i)) & np.uint64(63)
                found &= (words[block, i].view(np.uint64) >> bit) & np.uint64(1) == 1
            return pd.Series(np.split(found, np.cumsum(sizes)[:-1]))

        return probe(h, bits)

    def share(self, spark) -> BlockedBloom:
        self._shared = spark.sparkContext.broadcast(self.words)
        return self


def judge_urls(pages: DataFrame, listed: DataFrame, otherwise: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``listed`` has host, path, verdict. An entry fits its host and all subdomains if the
    url's path starts with the entry's path. The longest (host and path together, then
    the longer host) decides; of entries with the same host and path, ``allow`` comes
    before ``block``. A url without a fitting entry, a null url and one without ``://``
    get ``otherwise`` and a null rule. Entries with a null or empty host or a null path
    fit nothing. Repeated pages give repeated rows, no pages none, and columns besides
    page_id and url are not read.
    """
    spark = pages.sparkSession
    rules = staged(
        only(listed, "host", "path", "verdict")
        .filter("host <> '' and path is not null")
        .groupBy(F.translate("host", UPPER, UPPER.lower()).alias("host"), "path")
        .agg(F.min("verdict").alias("verdict"))
        .withColumn("key", F.concat_ws("\x00", "host", "path")),
        "listed",
    )
    bloom = BlockedBloom(rules, "key").share(spark)
    lengths = [r[0] for r in rules.select(F.length("path").alias("n")).distinct().limit(MAX_PATH_LENGTHS + 1).collect()]
    if len(lengths) > MAX_PATH_LENGTHS:
        raise ValueError("paths of more different lengths than any url can have")
    rows = only(pages, "page_id", "url").select(
        F.monotonically_increasing_id().alias("row"),
        "page_id",
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
    )
    dots = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(dots)), lambda i: F.array_join(F.slice(dots, i, F.size(dots)), ".")
    )
    sizes = F.filter(F.array(*(F.lit(n) for n in sorted(lengths))).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(
        F.transform(suffixes, lambda s: F.transform(sizes, lambda n: F.concat(s, F.lit("\x00"), F.substr("path", F.lit(1), n))))
    )
    rows = rows.withColumn("keys", F.when(F.col("host") != "", keys).otherwise(F.array().cast("array<string>")))
    first = F.transform("keys", lambda k: _hashes(k)[0])
    second = F.transform("keys", lambda k: _hashes(k)[1])
    rows = rows.withColumn("maybe", bloom.may_have(first, second))
    hits = F.transform(
        F.filter(F.arrays_zip("keys", "maybe"), lambda x: x["maybe"]), lambda x: x["keys"]
    )
    rows = rows.select("row", "page_id", "host", "path", F.explode_outer(hits).alias("key"))
    entries = rules.select("key", F.struct(
        (F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"),
        F.concat("host", "path").alias("rule"), "verdict").alias("entry"))
    exact = F.broadcast(entries) if rules.count() <= SMALL_LIST else entries.hint("shuffle_hash")
    best = rows.join(exact, "key", "left").groupBy("row", "page_id", "host", "path").agg(F.max("entry").alias("entry"))
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("entry.rule").alias("rule"),
        F.coalesce("entry.verdict", F.lit(otherwise)).alias("verdict"),
    )
