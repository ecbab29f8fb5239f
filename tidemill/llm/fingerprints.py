"""Document fingerprints from prefix polynomial hashes.

prefix[i] is the hash of the first i code points, as a sum of code point x base^place modulo a prime. From this array
the hash of any span comes by one subtraction and one product, equal spans compare in constant time, and the
longest common extension of two places is found by binary search. Two bases give 62 bits.

A fingerprint is the least hashes of all spans of SPAN code points, so it can be compared: the share of common
hashes among the least of both estimates the Jaccard likeness of the span sets.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import small_batches, table

PRIME = np.uint64((1 << 31) - 1)
BASES = (911_382_323, 972_663_749)
SPAN, KEPT = 24, 64
_31 = np.uint64(31)


def reduce(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^62."""
    x = (x & PRIME) + (x >> _31)
    x = (x & PRIME) + (x >> _31)
    return x - PRIME * (x >= PRIME)


class Powers:
    """Powers of a base and of its inverse, grown by doubling."""

    def __init__(self, base: int):
        p = int(PRIME)
        self.base, self.inverse = base, pow(base, p - 2, p)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, reduce(self.up * np.uint64(pow(self.base, k, int(PRIME))))])
            self.down = np.concatenate([self.down, reduce(self.down * np.uint64(pow(self.inverse, k, int(PRIME))))])


POWERS = tuple(map(Powers, BASES))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefixes:
    """Prefix arrays of one text."""

    def __init__(self, points: np.ndarray):
        self.n = n = len(points)
        self.arrays = []
        for powers in POWERS:
            powers.grow(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(reduce((points.astype(np.uint64) + np.uint64(1)) * powers.up[:n]), out=sums[1:])
            self.arrays.append(reduce(sums))

    def spans(self, start, length) -> np.ndarray:
        """62-bit hashes of the spans [start, start + length), moved to place 0 so that they compare across texts."""
        start, length = np.broadcast_arrays(np.asarray(start, np.int64), np.asarray(length, np.int64))
        parts = [reduce(reduce(a[start + length] + PRIME - a[start]) * w.down[start]) for a, w in zip(self.arrays, POWERS, strict=True)]
        return (parts[0] << _31) | parts[1]

    def every(self, width: int) -> np.ndarray:
        """spans() at every place, by slices."""
        count = self.n - width + 1
        parts = [reduce(reduce(a[width:] + PRIME - a[:count]) * w.down[:count]) for a, w in zip(self.arrays, POWERS, strict=True)]
        return (parts[0] << _31) | parts[1]

    def equal(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        if min(i, j, length) < 0 or i + length > self.n or j + length > other.n:
            return False
        return bool(self.spans(i, length) == other.spans(j, length))

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """The longest common extension: how far the texts agree from i and j on."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(i, other, j, middle) else (low, middle - 1)
        return low

    def least(self, width: int = SPAN, kept: int = KEPT) -> np.ndarray:
        """The least mixed 32-bit hashes of all spans; a text shorter than a span is one span; empty: none."""
        if not self.n:
            return np.zeros(0, np.uint32)
        x = self.every(min(width, self.n))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = ((x ^ (x >> np.uint64(32))) >> np.uint64(13)).astype(np.uint32)
        near = 4 * kept
        while near < len(x):
            found = np.unique(np.partition(x, near)[:near])
            if len(found) > kept:
                return found[:kept]
            near *= 8
        return np.unique(x)[:kept]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Of two fingerprints, 0 to 1: common hashes among the least of both together. Two empty ones are alike."""
    both = np.union1d(a, b)[:kept]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def text_form(least: np.ndarray) -> str:
    return least.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _constant(values: list, kind: str):
    """One constant, whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _bucket(key, bounds: list[int]):
    """One more than the number of bounds at or below the key: counted among every side-th bound, then within that block."""
    side = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    below = lambda values: F.size(F.filter(values, lambda x: x <= key))
    block = below(_constant([b[0] for b in blocks], "array<bigint>")) - 1
    within = F.coalesce(F.get(_constant(blocks, "array<array<bigint>>"), F.greatest(block, F.lit(0))), F.array().cast("array<bigint>"))
    return F.greatest(block, F.lit(0)) * side + below(within) + 1


def with_following(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """A partition a bucket of rows (bucket, key, text, ghost) such that in each bucket, by (key descending, nulls last, text), every row but ghosts
    is followed by the document after it; the first document of all comes after the last.

    Quantiles of the key bound the buckets (their number is that of shuffle partitions), and only keys are read for
    them. A bucket's first document goes to the bucket before as well, as a ghost.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = rows.agg(F.percentile_approx("_key", [i / wanted for i in range(1, wanted)] or [0.5], 10_000)).first()[0]
    bounds = sorted(set(at or ()))
    rows = rows.withColumn("_bucket", F.when(F.col("_key").isNull(), 0).otherwise(_bucket(F.col("_key"), bounds)))
    # one row a bucket
    heads = sorted(((r["_bucket"], r["k"]) for r in rows.groupBy("_bucket").agg(F.max("_key").alias("k")).collect()), reverse=True)
    first, before = [None] * (len(bounds) + 2), [None] * (len(bounds) + 2)
    for i, (bucket, k) in enumerate(heads):
        first[bucket], before[bucket] = k, heads[i - 1][0]
    of_own = lambda values, kind: F.get(_constant(values, f"array<{kind}>"), F.col("_bucket").cast("int"))
    ghost = F.when(F.col("_key").eqNullSafe(of_own(first, "bigint")), of_own(before, "int"))
    own = F.struct(F.col("_bucket").cast("int").alias("bucket"), F.lit(False).alias("ghost"))
    sent = F.when(ghost.isNotNull(), F.array(own, F.struct(ghost.alias("bucket"), F.lit(True).alias("ghost")))).otherwise(F.array(own))
    rows = rows.select("_key", "_text", F.explode(sent).alias("_to")).select(F.col("_to.bucket").alias("bucket"), F.col("_to.ghost").alias("ghost"), F.col("_key").alias(key), F.col("_text").alias("text"))
    return rows.repartitionById(len(bounds) + 2, F.col("bucket")).sortWithinPartitions("bucket", "ghost", F.col(key).desc_nulls_last(), "text")


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_start", pa.int64())]
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_start long"


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> fingerprints of each text and of its edited text, and their likeness.

    common_start is the longest common extension of both from their starts. Null text: empty; documents of one id follow each
    other by text; a null id comes last. A single document follows itself; an empty table gives no rows. Workers stream sorted buckets and hold two documents.
    """
    schema = pa.schema(FIELDS)
    rows = small_batches(with_following(docs, buckets=buckets), 1000)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for bucket, ghost, key, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ghost", "doc_id", "text")), strict=True):
                own = Prefixes(code_points(text))
                least = own.least()
                if last is not None and last[0] == bucket and not last[1]:
                    changed = edited(last[3], text)
                    other = Prefixes(code_points(changed))
                    far = other.least()
                    out.append((last[2], last[4].n, hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), text_form(last[5]), text_form(far), likeness(last[5], far), likeness(last[5], least), last[4].extension(0, other, 0)))
                last = (bucket, ghost, key, text, own, least)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(work, _DDL)


def op5_fingerprints(spark, sf_dir) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
