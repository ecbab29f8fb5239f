"""Toxicity by nearest labelled examples.

Texts are TF-IDF vectors over all their terms: words, and the first bytes of longer ones for inflected forms. Terms that no
example has can't add to a cosine, but count in a text's length, with the greatest weight that a term can have. The
nearest examples by exact cosine come from a block-max inverted index: a term's postings stand in blocks by falling
weight, and the blocks of a text's terms are added in the order of what each can give at most. What the blocks left can
add bounds every sum, so that fewer and fewer examples can be among the best, and only those are compared whole.
A neighbour's vote is the part of its cosine that comes of terms that tell of the label, so that near examples outvote far
ones; a logistic curve fitted on the examples' own votes turns votes into scores. An example of the very same text never
votes, so no row meets its own label; what a term tells is learned from all examples.

The labelled sample is bounded in rows and bytes, so what the driver and a worker hold of it is too. Document frequencies are
counted over all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import crc_fold, few_enough, saved, small_batches, table, text_bytes, unit_hash
from tidemill.llm.hashed import ALPHA, Vocabulary, lists, terms

#: Most labelled examples a label that the model holds, and the most bytes of an example's text; longer ones aren't examples.
EXAMPLES_EACH, EXAMPLE_BYTES = 1500, 1 << 18
#: Postings of a block, and examples that may be left when whole vectors are compared.
BLOCK, FEW = 64, 100
#: One part of the examples in so many makes a term common.
COMMON = 6
#: Part of what a text's terms can give that is left after the first blocks are added; each further round leaves a third.
FIRST = 0.1
#: Chi-square of a term with the label, and how many times as common it is under one label, from which it tells all; below
#: in proportion, and nothing under LEAST.
CHI_SQUARE, TIMES, LEAST = 20.0, 3.0, 0.1
#: Neighbours that vote; votes that each label has beforehand; bytes of a word start; the least slope of the curve.
NEIGHBOURS, EVEN, START, LEAST_SLOPE = 200, 0.006, 5, 0.2


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def bags(column: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, float]]:
    """Of each text of a column its bytes, its known terms in order and how often each stands there, and of the terms beyond them the sum of (1 + log count)^2."""
    data, ends = text_bytes(column)
    at = 0
    for a, b, h, row in terms(column, ALPHA, START):
        size, place, tf = vocabulary.bags(h, row, b - a)
        other = np.ones(len(h), bool)
        other[vocabulary.find(h)[0]] = False
        # the row stands in the low bits of what is left of the hash
        low = max(1, (b - a).bit_length())
        key, count = np.unique((h[other] << low) | row[other], return_counts=True)
        beyond = np.bincount(key & ((1 << low) - 1), (1 + np.log(count)) ** 2, b - a)
        stops = np.cumsum(size)
        for i in range(b - a):
            s = slice(stops[i] - size[i], stops[i])
            yield data[ends[at + i] : ends[at + i + 1]].tobytes(), place[s], tf[s], float(beyond[i])
        at += b - a


def _ranges(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges end to end."""
    return np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)


@dataclass
class Index:
    """The examples. What is sent to executors is small; a worker lays out the postings when it first needs them.

    Terms that many examples have stand as dense rows, one product for a batch of texts; the others' postings in blocks.
    """

    idf: np.ndarray = field(repr=False)  # of each term
    greatest_idf: float  # of a term that no example has
    ids: np.ndarray = field(repr=False)  # of the examples
    labels: np.ndarray = field(repr=False)
    row_starts: np.ndarray = field(repr=False)  # of each example, into the rows
    row_terms: np.ndarray = field(repr=False)
    row_counts: np.ndarray = field(repr=False)
    digests: dict[bytes, list[int]] = field(default_factory=dict, repr=False)  # examples by their text
    _ready: bool = field(default=False, repr=False)

    def weigh(self, terms: np.ndarray, counts: np.ndarray, beyond: float = 0.0) -> np.ndarray:
        """The text's vector at the known terms; its length is that of the whole vector."""
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum() + beyond * self.greatest_idf**2) if len(w) else w

    def __getstate__(self):
        names = ("idf", "greatest_idf", "ids", "labels", "row_starts", "row_terms", "row_counts", "digests")
        return {n: getattr(self, n) for n in names} | {"_ready": False}

    def lay_out(self) -> None:
        examples = len(self.ids)
        self.row_sizes = np.diff(self.row_starts)
        example = np.repeat(np.arange(examples, dtype=np.int32), self.row_sizes)
        w = (1 + np.log(self.row_counts)) * self.idf[self.row_terms]
        w /= np.sqrt(np.bincount(example, w * w, examples))[example]
        self.row_weights = w
        by = np.lexsort((-w, self.row_terms))  # by term, then by falling weight
        self.posted, self.weights = example[by], w[by]
        n = np.bincount(self.row_terms, minlength=len(self.idf))
        starts = np.cumsum(n) - n
        self.telling = self._telling(example, n)
        common = np.flatnonzero(n > max(BLOCK, examples / COMMON))
        self.dense_row = np.full(len(n), -1, np.int32)
        self.dense_row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), examples))
        for i, t in enumerate(common):
            self.dense[i, self.posted[starts[t] : starts[t] + n[t]]] = self.weights[starts[t] : starts[t] + n[t]]
        self.starts, self.sizes = starts, n
        blocks = np.where(self.dense_row < 0, -(-n // BLOCK), 0)
        self.first = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int32)  # block of each term
        of = np.repeat(np.arange(len(n), dtype=np.int32), blocks)
        self.block_starts = starts[of] + (np.arange(len(of)) - self.first[of]) * BLOCK
        self.block_sizes = (np.minimum(self.block_starts + BLOCK, (starts + n)[of]) - self.block_starts).astype(np.int32)
        self.greatest = self.weights[self.block_starts]
        # how much less the next block of the term can give
        following = np.append(self.greatest[1:], 0.0)
        following[self.first[1:][blocks > 0] - 1] = 0.0
        self.falls = self.greatest - following
        self.room = np.zeros(len(self.idf))
        self._ready = True

    def _telling(self, example: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How much each term tells of the label, from 0 to 1; under LEAST it tells nothing."""
        n1, n0 = (int((self.labels == y).sum()) for y in (1, 0))
        a = np.bincount(self.row_terms, self.labels[example], len(n))
        b = n - a
        chi = (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b + 1e-9) * (n1 + n0 - a - b + 1e-9) * max(1, n1) * max(1, n0))
        ratio = np.abs(np.log(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))))
        told = np.minimum(1, chi / CHI_SQUARE) * np.minimum(1, ratio / np.log(TIMES))
        return np.where(told < LEAST, 0.0, told)

    def common(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of each text, given as terms and weights, what its common terms add to each example's cosine."""
        if not self._ready:
            self.lay_out()
        w = np.zeros((len(texts), len(self.dense)))
        for i, (terms, weights) in enumerate(texts):
            row = self.dense_row[terms]
            w[i, row[row >= 0]] = weights[row >= 0]
        return w @ self.dense

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine above 0, ties by place, and the cosines; exact. sums: what common() has for this text."""
        n = len(self.ids)
        if not len(terms) or not n:
            return np.zeros(0, np.int64), np.zeros(0)
        sums = self.common([(terms, weights)])[0] if sums is None else sums
        count = self.first[terms + 1] - self.first[terms]
        block, of = _ranges(self.first[terms], count), np.repeat(weights, count)
        order = np.argsort(-of * self.greatest[block])
        block, of = block[order], of[order]
        # what all blocks from each place on can add to one example
        rest = np.append(np.cumsum((of * self.falls[block])[::-1])[::-1], 0.0)
        some, at, left = np.arange(n), 0, rest[0] * FIRST
        while at < len(block) and len(some) > max(FEW, k):
            end = min(max(at + 1, int(np.searchsorted(-rest, -left))), len(block))
            end = len(block) if rest[end] < 1e-3 * rest[0] else end
            size = self.block_sizes[block[at:end]]
            places = _ranges(self.block_starts[block[at:end]], size)
            sums = sums + np.bincount(self.posted[places], self.weights[places] * np.repeat(of[at:end], size), n)
            at, left = end, rest[end] / 3
            worst = np.partition(sums[some], len(some) - k)[len(some) - k]
            some = some[sums[some] >= worst - rest[at] - 1e-9]
        if at == len(block):
            score = sums[some]
        else:
            self.room[terms] = weights
            some = some[self.row_sizes[some] > 0]
            size = self.row_sizes[some]
            places = _ranges(self.row_starts[some], size)
            score = np.add.reduceat(self.room[self.row_terms[places]] * self.row_weights[places], np.cumsum(size) - size) if len(some) else np.zeros(0)
            self.room[terms] = 0
        top = np.lexsort((some, -np.round(score, 12)))[:k]
        top = top[score[top] > 1e-12]
        return some[top], score[top]

    def votes(self, texts: list[tuple[bytes, np.ndarray, np.ndarray, float]], k: int = NEIGHBOURS) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text, given as bags() does: how many times the odds of label 1 among the neighbours are those among all who could vote, as a logarithm; the neighbours and their cosines.

        A neighbour's vote is the part of its cosine that comes of telling terms. Few such votes draw the odds to even.
        """
        for a in range(0, len(texts), 64):
            part = texts[a : a + 64]
            weights = [self.weigh(*x[1:]) for x in part]
            for (text, terms, _, _), w, sums in zip(part, weights, self.common([(x[1], w) for x, w in zip(part, weights, strict=True)]), strict=True):
                same = self.digests.get(digest(text), [])
                near, cosine = self.nearest(terms, w, k + len(same), sums)
                if same:
                    others = ~np.isin(near, same)
                    near, cosine = near[others][:k], cosine[others][:k]
                own = np.flatnonzero(self.telling[terms])
                size = self.sizes[terms[own]]
                places = _ranges(self.starts[terms[own]], size)
                told = np.bincount(self.posted[places], self.weights[places] * np.repeat(w[own] * self.telling[terms[own]], size), len(self.ids))[near]
                one, all_ = (told * self.labels[near]).sum() + EVEN, told.sum() + 2 * EVEN
                ones = self.labels.sum() - self.labels[same].sum()
                yield float(np.log(one / (all_ - one)) - np.log((ones + 0.5) / (len(self.labels) - len(same) - ones + 0.5))), near, cosine


@dataclass
class Model:
    terms: Broadcast  # Vocabulary
    index: Broadcast
    curve: np.ndarray
    blank: float  # rate of label 1 among texts without any known term


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Coefficients of columns 1, log odds of the vote and nearest cosine, drawn to the vote itself. A vote never counts against its label: its slope is LEAST_SLOPE at least."""
    start = np.array([0.0, 1.0, 0.0])
    beta = start.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.5 * np.eye(3)
        slope = x.T @ (w * (y - p)) - 0.5 * (beta - start)
        free = np.array([0, 2] if beta[1] <= LEAST_SLOPE and slope[1] <= 0 else [0, 1, 2])
        after = beta.copy()
        after[free] += np.clip(np.linalg.solve(hessian[np.ix_(free, free)], slope[free]), -2, 2)
        after[1] = max(after[1], LEAST_SLOPE)
        beta, before = after, beta
        if np.abs(beta - before).max() < 1e-6:
            break
    return beta


def _features(odds: float, cosine: np.ndarray) -> tuple[float, float, float]:
    return 1.0, odds, float(cosine[0]) if len(cosine) else 0.0


def _sample(texts: DataFrame, labels: DataFrame, fold: int | None, folds: int, examples_each: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, text) of at most examples_each documents a label, the least by a hash of their ids; and how many there are."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if fold is not None:
        known = known.filter(crc_fold("doc_id", folds) != fold)
    short = texts.filter(F.octet_length("text") <= EXAMPLE_BYTES)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).join(short.select("doc_id"), "doc_id", "left_semi")
    known = saved(known.withColumn("_u", unit_hash(F.col("doc_id"), "toxicity")), "labelled")
    there = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    near = known.filter(few_enough(F.col("_u"), examples_each, F.when(F.col("label") == 1, there.get(1, 0)).otherwise(there.get(0, 0))))
    by = Window.partitionBy("label").orderBy("_u", "doc_id")
    chosen = near.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= examples_each).select("doc_id", "label")
    return saved(small_batches(short).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "toxicity"), there


def _vocabulary(sample: DataFrame) -> Vocabulary:
    """All terms of the examples, as hashes."""

    def work(batches):
        for batch in batches:
            found = [np.unique(h) for _, _, h, _ in terms(batch.column(0), ALPHA, START)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found or [np.zeros(0, np.int64)])))], names=["term"])

    return Vocabulary(sample.select("text").mapInArrow(work, "term long").distinct().toArrow()["term"].to_numpy())


def _document_frequencies(texts: DataFrame, known: Broadcast, size: int) -> np.ndarray:
    """Documents that hold each term, over the whole corpus, and last the number of all; summed by task and then by term."""

    def count(batches):
        vocabulary = known.value
        df, rows = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for a, b, h, row in terms(batch.column(0), ALPHA, START):
                df += np.bincount(vocabulary.bags(h, row, b - a)[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, some), pa.int32()), pa.array(np.append(rows, df[some]), pa.int64())], names=["term", "n"])

    counted = texts.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1)
    df[counted["term"].to_numpy()] = counted["n"].to_numpy()
    return df


def fit(docs: DataFrame, labels: DataFrame, fold: int | None = 0, folds: int = 5, examples_each: int = EXAMPLES_EACH) -> Model | None:
    """Learn from labelled documents outside the fold; None where both labels aren't there.

    At most examples_each documents a label, the least by a hash of their ids, of at most EXAMPLE_BYTES bytes; a document
    labelled twice counts once, as 1 if any says so, and of the texts of one id the least is taken. Driver and executors
    hold the examples' terms, 8 bytes each, and nothing that grows with the table.
    """
    texts = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    sample, there = _sample(texts, labels, fold, folds, examples_each)
    if len(there) < 2:
        return None
    spark = docs.sparkSession
    vocabulary = _vocabulary(sample)
    known = spark.sparkContext.broadcast(vocabulary)
    df = _document_frequencies(texts, known, len(vocabulary))
    idf = np.log((df[-1] + 1) / (df[:-1] + 0.5))

    def vectors(batches):
        for batch in batches:
            found = list(bags(batch.column("text"), known.value))
            size = np.array([len(x[1]) for x in found], np.int64)
            held = [lists(size, np.concatenate([x[i] for x in found] or [np.zeros(0)]), pa.int32()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([digest(x[0]) for x in found], pa.binary()), *held], names=["doc_id", "label", "digest", "terms", "counts"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(vectors, "doc_id long, label int, digest binary, terms array<int>, counts array<int>").toArrow().sort_by("doc_id").combine_chunks()
    held = [rows[c].chunk(0) if rows.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("terms", "counts")]
    digests: dict[bytes, list[int]] = {}
    for i, d in enumerate(rows["digest"].to_pylist()):
        digests.setdefault(d, []).append(i)
    own = Index(idf, float(np.log((df[-1] + 1) / 0.5)), rows["doc_id"].to_numpy(), rows["label"].to_numpy(), held[0].offsets.to_numpy() - held[0].offsets[0].as_py(), held[0].flatten().to_numpy(), held[1].flatten().to_numpy(), digests)
    return _calibrated(known, spark.sparkContext.broadcast(own), sample, there)


def _calibrated(known: Broadcast, index: Broadcast, sample: DataFrame, there: dict[int, int]) -> Model:
    """The curve that turns the examples' own votes, each without its text, into rates; labels weigh as in the whole learning set."""

    def votes(batches):
        own = index.value
        for batch in batches:
            texts = list(bags(batch.column("text"), known.value))
            out = [(label, len(x[1]) == 0, *_features(odds, cosine)[1:]) for label, x, (odds, _, cosine) in zip(batch.column("label").to_pylist(), texts, own.votes(texts), strict=True)]
            kinds = (pa.int32(), pa.bool_(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["label", "blank", "odds", "cosine"])

    rows = sample.select("label", "text").mapInArrow(votes, "label int, blank boolean, odds double, cosine double").orderBy("label", "blank", "odds", "cosine").toArrow()
    label, blank = rows["label"].to_numpy(), rows["blank"].to_numpy()
    each = np.array([there[y] / max(1, int((label == y).sum())) for y in (0, 1)])
    empty = each * [int((blank & (label == y)).sum()) for y in (0, 1)]
    x = np.stack([np.ones(len(label)), rows["odds"].to_numpy(), rows["cosine"].to_numpy()], axis=1)[~blank]
    y = label[~blank]
    return Model(known, index, _logistic(x, y.astype(float), each[y]), float((empty[1] + 0.1) / (empty.sum() + 1)))


def score(docs: DataFrame, model: Model | None, carry: list[str] | None = None) -> DataFrame:
    """docs -> doc_id (or the columns to carry), score, predicted, evidence (nearest examples), cosines.

    A text without any term of the examples, empty and null ones too, has the rate of such examples and no evidence;
    without a model all score 0. Equal texts, repeated rows among them, have equal scores; of examples at the same
    cosine the lower doc_id comes first. A very long text is one vector like any other. An empty table gives no rows.
    """
    carry = carry or ["doc_id"]
    rows = small_batches(docs.select(*carry, F.coalesce("text", F.lit("")).alias("_text")))
    known, index, curve, blank = (model.terms, model.index, model.curve, model.blank) if model else (None, None, None, 0.0)
    added = T.StructType.fromDDL("score double, predicted int, evidence array<long>, cosines array<double>")
    names = [*carry, *added.names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value if index else None
        seen: dict[bytes, tuple[float, list[int], list[float]]] = {}  # what this task found for earlier texts

        def found(texts: list) -> list:
            keys = [digest(x[0]) for x in texts]
            new = {k: x for k, x in zip(keys, texts, strict=True) if k not in seen}
            for (key, x), (odds, near, cosine) in zip(new.items(), own.votes(list(new.values())), strict=True):
                z = float(np.clip(curve @ _features(odds, cosine), -30, 30))
                seen[key] = (float(1 / (1 + np.exp(-z))), own.ids[near[:3]].tolist(), cosine[:3].tolist()) if len(x[1]) else (blank, [], [])
            out = [seen[k] for k in keys]
            if len(seen) > 20_000:
                seen.clear()
            return out

        for batch in batches:
            got = found(list(bags(batch.column("_text"), known.value))) if own else [(0.0, [], [])] * batch.num_rows
            kinds = (pa.float64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()))
            values = zip(*((x[0], int(x[0] >= 0.5), x[1], x[2]) for x in got), strict=True) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(carry))] + [pa.array(list(v), k) for v, k in zip(values, kinds, strict=True)], names=names)

    return rows.mapInArrow(work, T.StructType(docs.select(*carry).schema.fields + added.fields))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) without those that are predicted toxic; all its columns stay.

    Null and empty texts stay unless most such examples are toxic; rows that repeat, or have no id, are decided by their
    text alone. Without labels of both kinds all rows stay. An empty table stays empty.
    """
    held = docs.select("doc_id", "text", F.struct("*").alias("_row"))
    return score(held, fit(docs, labels), ["_row"]).filter("predicted = 0").select("_row.*")


def op3_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence", "cosines")
