"""Media payloads in content-defined chunks.

A rolling gear hash over the last 32 bytes cuts payloads where its top bits are zero, so equal passages give equal
chunks wherever they stand. Chunks are stored once each by digest, found by Spark grouping, and a medium is the
ordered list of its chunk digests. Reading a medium back joins list and store, and checks the payload's SHA-256.

Equal payloads are one medium: bytes move once to the store and once to the medium, however many rows refer to it.
"""

from __future__ import annotations

import bz2
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import blocks, small_batches, table, text_bytes

#: Least, typical and greatest bytes of a chunk. Payloads are padded to a multiple of BLOCK.
LEAST, TYPICAL, GREATEST, BLOCK = 2048, 8192, 65536, 64
#: One random number a byte value.
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of GEAR[b] << age over 32 bytes, by doubling the window five times."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k].copy() << np.uint32(k)
    return h


def cuts(data: np.ndarray, least: int = LEAST, typical: int = TYPICAL, greatest: int = GREATEST) -> list[int]:
    """Ends of the chunks of one payload, its length last."""
    n = len(data)
    if n <= least:
        return [n]
    marks = np.flatnonzero(gear(data) >> np.uint32(32 - (typical.bit_length() - 1)) == 0) + 1
    ends, at = [], 0
    while n - at > least:
        i = int(np.searchsorted(marks, at + least))
        end = int(marks[i]) if i < len(marks) else n
        at = min(end, at + greatest, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def stored(chunk: bytes) -> bytes:
    """A chunk as it is stored: bz2, or as it is where that is not smaller; the first byte tells."""
    packed = bz2.compress(chunk)
    return b"\1" + packed if len(packed) < len(chunk) else b"\0" + chunk


def loaded(form: bytes) -> bytes:
    return bz2.decompress(form[1:]) if form[:1] == b"\1" else form[1:]


def payloads(column: pa.Array) -> Iterator[bytes]:
    data, ends = text_bytes(column)
    for a, b in blocks(ends, 1 << 22):
        raw = data[ends[a] : ends[b]].tobytes()
        at = (ends[a : b + 1] - ends[a]).tolist()
        for x, y in zip(at, at[1:], strict=False):
            yield raw[x:y] + bytes(-(y - x) % BLOCK or (BLOCK if x == y else 0))


def _each(texts: DataFrame, schema: pa.Schema, ddl: str, rows_of) -> DataFrame:
    """Rows for each different payload of a task; what a task has seen, it leaves out."""

    def work(batches):
        known: set[bytes] = set()
        seen: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for payload in payloads(batch.column(0)):
                if (medium := hashlib.sha256(payload).digest()) not in known:
                    known.add(medium)
                    out += rows_of(payload, medium, seen)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return texts.mapInArrow(work, ddl)


def _chunks(payload: bytes) -> Iterator[bytes]:
    at = 0
    for end in cuts(np.frombuffer(payload, np.uint8)):
        yield payload[at:end]
        at = end


def manifests(texts: DataFrame) -> DataFrame:
    """-> medium, place, digest: the ordered chunk list of each different payload."""
    schema = pa.schema([("medium", pa.binary()), ("place", pa.int32()), ("digest", pa.binary())])
    rows = lambda payload, medium, seen: [(medium, i, hashlib.sha256(c).digest()) for i, c in enumerate(_chunks(payload))]
    return _each(texts, schema, "medium binary, place int, digest binary", rows).dropDuplicates(["medium", "place"])


def chunk_store(texts: DataFrame) -> DataFrame:
    """-> digest, form: each different chunk once."""
    schema = pa.schema([("digest", pa.binary()), ("form", pa.binary())])

    def rows(payload, medium, seen):
        out = []
        for c in _chunks(payload):
            if (digest := hashlib.sha256(c).digest()) not in seen:
                seen.add(digest)
                out.append((digest, stored(c)))
        return out

    return _each(texts, schema, "digest binary, form binary", rows).groupBy("digest").agg(F.first("form").alias("form"))


def media(texts: DataFrame) -> DataFrame:
    """One string column -> a row a medium, read back from list and store.

    medium, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, chunks, feature. The feature is
    chunks, sum, sum of squares and middle crossings of the 8-bit samples. Raises where a payload isn't what its id says.
    A worker holds one medium at a time, which is one document.
    """
    texts = small_batches(texts)
    parts = manifests(texts).join(chunk_store(texts), "digest").select("medium", "place", "form")
    parts = parts.repartition("medium").sortWithinPartitions("medium", "place")
    schema = pa.schema([("medium", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("chunks", pa.int64()), ("feature", pa.string())])

    def close(medium: bytes, forms: list[bytes]) -> dict:
        payload = b"".join(map(loaded, forms))
        digest = hashlib.sha256(payload).digest()
        if digest != medium:
            raise ValueError(f"medium {medium.hex()} read back as {digest.hex()}")
        container = b"".join(len(f).to_bytes(4, "little") + f for f in forms)
        samples = np.frombuffer(payload, np.uint8)
        crossings = int(np.count_nonzero(np.diff((samples >= 128).view(np.int8))))
        feature = f"chunks={len(forms)};sum={int(samples.sum(dtype=np.int64))};squares={int(np.square(samples, dtype=np.int64).sum())};crossings={crossings}"
        return {"medium": medium.hex(), "payload_bytes": len(payload), "payload_sha256": digest.hex(), "tail_crc32": zlib.crc32(payload[-BLOCK:]), "media_bytes": len(container), "media_sha256": hashlib.sha256(container).hexdigest(), "chunks": len(forms), "feature": feature}

    def work(batches):
        key, forms = None, []
        for batch in batches:
            done = []
            for medium, form in zip(batch.column("medium").to_pylist(), batch.column("form").to_pylist(), strict=True):
                if medium != key:
                    if forms:
                        done.append(close(key, forms))
                    key, forms = medium, []
                forms.append(form)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if forms:
            yield pa.RecordBatch.from_pylist([close(key, forms)], schema=schema)

    return parts.mapInArrow(work, "medium string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, chunks long, feature string")


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs -> key, n_bytes and the columns of media(). Null text: empty, a payload of 64 zero bytes. Repeated rows each have a row."""
    rows = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("_text"))
    n = F.octet_length("_text")
    pad = F.when(n == 0, BLOCK).otherwise((BLOCK - n % BLOCK) % BLOCK)
    payload = F.concat(F.encode("_text", "UTF-8"), F.unhex(F.repeat(F.lit("00"), pad.cast("int"))))
    refs = rows.select(key, n.cast("long").alias("n_bytes"), F.sha2(payload, 256).alias("medium"))
    return refs.join(media(rows.select("_text")), "medium").drop("medium")


def op1_media(spark, sf_dir) -> DataFrame:
    return store_media(table(spark, sf_dir, "documents"))
