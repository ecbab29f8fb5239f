"""Language identification by a byte convolutional network.

A text's bytes are cut into windows of fixed length, all of them. Each byte has a small vector; filters of several
widths slide over a window, the greatest response of each is kept, and a softmax over these gives the languages.
The network is trained here in numpy, on windows drawn from a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import blocks, crc_fold, few_enough, light, saved, small_batches, table, text_bytes, unit_hash

WINDOW, DEPTH, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 16
#: Most labelled documents a language and windows a document that training sees.
DOCS_EACH, WINDOWS_EACH = 500, 4
LETTER = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])


@dataclass
class Network:
    languages: list[str]
    table: np.ndarray = field(repr=False)  # 256 x DEPTH
    filters: np.ndarray = field(repr=False)  # widest x DEPTH, filters; zero beyond a filter's own width
    bias: np.ndarray = field(repr=False)
    out: np.ndarray = field(repr=False)
    out_bias: np.ndarray = field(repr=False)

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """Windows of bytes -> rows of the vectors of WIDTHS[-1] neighbouring bytes."""
        x = self.table[windows]
        places = windows.shape[1] - WIDTHS[-1] + 1
        return np.concatenate([x[:, i : i + places] for i in range(WIDTHS[-1])], axis=2)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        return np.maximum((self.columns(windows) @ self.filters).max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray, batch: int = 64) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), batch):
            z = self.pooled(windows[i : i + batch]) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + batch] = z / z.sum(axis=1, keepdims=True)
        return out


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 12, batch: int = 64, rate: float = 4e-3, seed: int = 5) -> Network:
    """Adam on cross entropy. Windows are cut at random lengths as they are seen, for short texts; bytes 0 fill them."""
    rng = np.random.default_rng(seed)
    wide, n = WIDTHS[-1] * DEPTH, FILTERS * len(WIDTHS)
    mask = np.repeat(np.concatenate([np.arange(wide)[:, None] < w * DEPTH for w in WIDTHS], axis=1), FILTERS, axis=1)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(languages, normal(256, DEPTH, scale=0.5), normal(wide, n, scale=0.2) * mask, np.zeros(n, np.float32), normal(n, len(languages), scale=0.1), np.zeros(len(languages), np.float32))
    net.table[0] = 0
    names = ("table", "filters", "bias", "out", "out_bias")
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = windows[rows].copy(), labels[rows]
            short = rng.random(len(rows)) < 0.3
            length = np.where(short, rng.integers(6, WINDOW, len(rows)), WINDOW)
            x[np.arange(WINDOW)[None, :] >= length[:, None]] = 0
            columns = net.columns(x)
            z = columns @ net.filters
            place = z.argmax(axis=1)
            best = np.take_along_axis(z, place[:, None], axis=1)[:, 0] + net.bias
            keep = (rng.random(best.shape) < 0.8) / np.float32(0.8)
            hidden = np.maximum(best, 0) * keep
            p = hidden @ net.out + net.out_bias
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y] -= 1
            p /= len(rows)
            back = (p @ net.out.T) * keep * (best > 0)
            rows_at = columns[np.arange(len(rows))[:, None], place]  # batch, filters, wide
            grown = {"out": hidden.T @ p, "out_bias": p.sum(0), "bias": back.sum(0), "filters": np.einsum("bfw,bf->wf", rows_at, back) * mask}
            touched = np.einsum("bf,wf->bfw", back, net.filters).reshape(len(rows), n, WIDTHS[-1], DEPTH)
            places = place[:, :, None] + np.arange(WIDTHS[-1])
            grown["table"] = np.zeros_like(net.table)
            np.add.at(grown["table"], x[np.arange(len(rows))[:, None, None], places], touched)
            grown["table"][0] = 0
            step += 1
            for k in names:
                g = grown[k].astype(np.float32)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                value = getattr(net, k)
                value -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def windows_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of each row's bytes, the last filled with 0, and the row of each; an empty row has none."""
    n = np.diff(ends)
    count = -(-n // WINDOW)
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = ends[row] + nth * WINDOW
    length = np.minimum(ends[row + 1] - start, WINDOW) if len(row) else start
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start] if len(row) else np.zeros((0, WINDOW), np.uint8)
    out = np.where(np.arange(WINDOW)[None, :] < length[:, None], out, np.uint8(0))
    return out, row


def fit(docs: DataFrame, fold: int | None = 1, folds: int = 3, docs_each: int = DOCS_EACH, windows_each: int = WINDOWS_EACH) -> Network | None:
    """Learn from documents with a language and a letter outside the fold. None if there are none.

    At most docs_each documents a language, the least by a hash of their ids, and windows_each windows of each; every
    language has its part, however rare. What training holds grows with the number of languages, not with the table.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if fold is not None:
        known = known.filter(crc_fold("doc_id", folds) != fold)
    # language and hash of every document that may be learned from; texts are read again for the chosen ones only
    ids = saved(known.select("doc_id", "lang", unit_hash(F.col("doc_id"), "langid").alias("_u")).distinct(), "langids")
    counts = light(ids.groupBy("lang").agg(F.count("*").alias("_all")))
    near = ids.join(counts, "lang").filter(few_enough(F.col("_u"), docs_each, F.col("_all")))
    chosen = near.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_u", "doc_id"))).filter(F.col("_n") <= docs_each)
    chosen = light(saved(chosen.groupBy("doc_id", "lang").agg(F.first("_u").alias("_u")), "langsample"))
    sample = known.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"]).select("lang", "_u", "text")
    schema = pa.schema([("lang", pa.string()), ("window", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, u, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rng = np.random.default_rng(int(u * 2**52))
                for at in rng.integers(0, max(1, len(raw) - WINDOW), windows_each if len(raw) > WINDOW else 1):
                    out.append((lang, raw[at : at + WINDOW].ljust(WINDOW, b"\0")))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], t.type) for t in schema], schema=schema)

    rows = sorted((r["lang"], bytes(r["window"])) for r in sample.mapInArrow(work, "lang string, window binary").collect())
    if not rows:
        return None
    languages = sorted({x for x, _ in rows})
    number = {x: i for i, x in enumerate(languages)}
    windows = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.array([number[x] for x, _ in rows]), languages)


def identify(docs: DataFrame, network: Network | None, carry: str = "doc_id") -> DataFrame:
    """docs -> the column to carry, lang_pred, score: the mean of the probabilities of all windows, weighed by their letters.

    `und` with score 0 where the text is null or has no letter, or where there was nothing to learn from. Of languages with
    equal sums the first by name is taken. Equal texts, repeated rows among them, have equal results but for float rounding by
    batch. Very long texts are worked on alone, all their windows in turn. An empty table gives no rows.
    """
    rows = small_batches(docs.select(carry, F.coalesce(F.when(F.col("text").rlike(r"\p{L}"), F.col("text")), F.lit("")).alias("_text")))
    sent = docs.sparkSession.sparkContext.broadcast(network)
    added = T.StructType.fromDDL("lang_pred string, score double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            data, ends = text_bytes(batch.column("_text"))
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for a, b in blocks(ends) if net else ():
                windows, row = windows_of(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                if not len(windows):
                    continue
                weight = LETTER[windows].sum(axis=1).astype(np.float64)
                p = net.probabilities(windows) * weight[:, None]
                total = np.zeros((b - a, len(net.languages)))
                np.add.at(total, row, p)
                mass = np.bincount(row, weight, b - a)
                has = mass > 0
                best[a:b][has] = total[has].argmax(axis=1)
                score[a:b][has] = total[has].max(axis=1) / mass[has]
            names = [net.languages[i] if i >= 0 else "und" for i in best.tolist()] if net else ["und"] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], names=[carry, "lang_pred", "score"])

    return rows.mapInArrow(work, T.StructType(docs.select(carry).schema.fields + added.fields))


def keep_known(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """docs without those in no known language: no letter at all, or windows that go to no language more than others; all its columns stay.

    Null and blank texts go; repeated rows and rows without an id are decided by their text. Where nothing can be learned all go; an
    empty table stays empty.
    """
    held = docs.select("text", F.struct("*").alias("_row"))
    return identify(held, fit(docs), "_row").filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("_row.*")


def op2_langid(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
