"""Packing by concatenate and cut.

Pass 1 tokenizes whole texts once and writes ids with a running offset inside each partition. Partition totals
are summed, and a running sum over partitions (a few rows each) gives every partition's global offset. Pass 2 cuts
the one long row of tokens into fixed windows: a document's piece is a boundary record (window, place, length).
Only the last window of all is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import light, saved, small_batches, table

WINDOW = 1024
STOP = (0).to_bytes(2, "little")  # the id after each document


def tokenized(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """-> part, start (tokens before it in its part), key, n, ids (16-bit, the stop id last). Null text: empty."""
    rows = small_batches(docs.select(F.col(key).cast("long").alias(key), F.coalesce(text, F.lit("")).alias("text")), 1000)
    schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), (key, pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemill.llm.tokens import encoder

        own, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [x + STOP for x in own.encode(batch.column("text").to_pylist())]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), batch.column(key), pa.array(n), pa.array(ids, pa.binary())], schema=schema)
            at = int(ends[-1]) if len(n) else at

    return rows.mapInArrow(work, f"part int, start long, {key} long, n long, ids binary")


def cut(tokens: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """tokenized() rows, read from a table -> one row a piece: start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # one row a partition of pass 1, not of the data; sent to the executors if few, so that tokens don't move
    base = saved(totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base")), "offsets")
    placed = tokens.join(light(base), "part").select(key, "n", "ids", (F.col("base") + F.col("start")).alias("at"))
    schema = pa.schema([(key, pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "at"))
            pieces = (at + n - 1) // window - at // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = at[row] // window + nth
            begin = np.maximum(at[row], sequence * window)
            length = np.minimum(at[row] + n[row], (sequence + 1) * window) - begin
            start = begin - at[row]
            column = batch.column("ids").to_pylist()
            ids = [column[r][2 * s : 2 * (s + k)] for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            crc = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4")) for x in ids]
            keys = batch.column(key).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([keys, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * window), pa.array(ids, pa.binary())], schema=schema)

    return placed.mapInArrow(work, f"{key} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """docs -> pieces with their ids. A document without text is its stop id alone; repeated documents each have pieces.

    The ids are kept as a table in the shared scratch folder, so offsets hold even if a task is run again.
    """
    return cut(saved(tokenized(docs, tokenizer), "tokens"), window)


def op9_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
