"""Ranked lexical search by a dual tree: every item's best documents, exactly.

Items and documents are vectors over the items' terms: a term's weight in an item, its saturated frequency in a document.
Both stand in hierarchies whose nodes hold the greatest value of each coordinate below them, so that the product of two
nodes bounds every score between them. A pair of nodes whose bound is under the weakest k-th score of its items is
dropped whole; what is left is split, first the items, then the documents, down to leaves that are scored exactly.

Spark does it in three steps over all documents. Texts are cut into terms once and kept as short vectors over the items'
terms; sums over them give document frequencies. A thirty-second of the vectors, by hash, gives each item a first k-th
score. Then every partition searches its documents with these as thresholds and returns what can still be among the
best, about k x 32 rows an item in all whatever the table's size, which a window ranks. A threshold is the k-th score of
real documents, so nothing that belongs to the result is under it.

Items are taken in blocks of a bounded number of terms; only a block's vectors are sent to the executors. Terms are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import saved, small_batches, table
from tidemill.llm.hashed import Vocabulary, lists, terms

TOP = 50
#: Terms of all items of a block, and of a tree of items; one part in so many documents that gives the first thresholds.
BLOCK_TERMS, TREE_TERMS, SEED = 1 << 21, 1 << 14, 32
#: Children of a node, documents of a tree.
FAN, ROWS = 8, 512


def item_terms(items: DataFrame) -> DataFrame:
    """items (item_id, text) -> item_id, terms: the hashes of an item's different terms. An item without terms has no row."""

    def work(batches):
        for batch in batches:
            for a, b, h, row in terms(batch.column(1)):
                own = [np.unique(h[row == i]) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists(np.array([len(x) for x in own]), np.concatenate(own), pa.int64())], names=["item_id", "terms"])

    return small_batches(items.select("item_id", "text")).mapInArrow(work, "item_id long, terms array<long>").filter("size(terms) > 0")


def vectors(docs: DataFrame, known: Broadcast) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n (its terms, repeats counted), at and tf: the vocabulary's terms in it. Texts without terms have no row."""

    def work(batches):
        vocabulary = known.value
        for batch in batches:
            for a, b, h, row in terms(batch.column(1)):
                n = np.bincount(row, minlength=b - a)
                size, at, tf = vocabulary.bags(h, row, b - a)
                arrays = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), lists(size, at, pa.int32()), lists(size, tf, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "at", "tf"]).filter(pa.array(n > 0))

    return small_batches(docs.select("doc_id", "text")).mapInArrow(work, "doc_id long, n long, at array<int>, tf array<int>")


class Tree:
    """Some items and the hierarchy over them. A level holds, by term and node, the greatest weight of the term in any item below."""

    def __init__(self, numbers: np.ndarray, of: np.ndarray, at: np.ndarray, weights: np.ndarray):
        """numbers: of the items; of, at: each item's (by place in numbers) terms; weights: of all terms."""
        self.numbers = numbers
        self.terms, place = np.unique(at, return_inverse=True)
        own = np.zeros((len(self.terms), len(numbers)))
        own[place, of] = weights[at]
        self.wide = own.sum(0).max(initial=0) * 1e6 >= 2**53  # sums that doubles don't hold exactly
        self.levels, self.starts = [own], [np.arange(len(numbers))]
        while self.levels[0].shape[1] > 1:
            self.levels.insert(0, np.maximum.reduceat(self.levels[0], np.arange(0, self.levels[0].shape[1], FAN), axis=1))
            self.starts.insert(0, self.starts[0][::FAN])


class Forest:
    """The items of a block, near those they share their heaviest term with, in trees of a bounded number of terms."""

    def __init__(self, starts: np.ndarray, held: np.ndarray, weights: np.ndarray):
        self.starts, self.held, self.weights = starts, held, weights
        self.trees: list[Tree] | None = None

    def __getstate__(self):
        return {"starts": self.starts, "held": self.held, "weights": self.weights, "trees": None}

    def grow(self) -> list[Tree]:
        """Grown where it is first needed; what is sent is the items' terms."""
        if self.trees is None:
            sizes = np.diff(self.starts)
            of = np.repeat(np.arange(len(sizes)), sizes)
            by = np.lexsort((-self.weights[self.held], of))
            order = np.argsort(self.held[by[self.starts[:-1]]], kind="stable")
            group = np.cumsum(sizes[order]) // TREE_TERMS
            self.trees = []
            for g in np.unique(group):
                own = order[group == g]
                at = np.concatenate([self.held[self.starts[i] : self.starts[i + 1]] for i in own])
                self.trees.append(Tree(own, np.repeat(np.arange(len(own)), sizes[own]), at, self.weights))
        return self.trees


class Search:
    """The best documents of each item among those that it is given. floors: a k-th score that the item is known to have; 0 if none."""

    def __init__(self, forest: Forest, floors: np.ndarray, top: int = TOP):
        self.forest, self.floors, self.top = forest, floors.astype(np.int64), top
        self.best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.scored = 0

    def keep(self, item: int, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """Adds documents; of equal scores the lower id comes first, documents without an id last."""
        if item in self.best:
            score, ids, none = (np.concatenate(x) for x in zip(self.best[item], (score, ids, none), strict=True))
        first = np.lexsort((ids, none, -score))[: self.top]
        self.best[item] = score[first], ids[first], none[first]
        if len(first) == self.top:
            self.floors[item] = max(self.floors[item], score[first[-1]])

    def search(self, ids: np.ndarray, none: np.ndarray, of: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        """Documents' ids (none: it has no id), and entries: document, term and saturated frequency."""
        for tree in self.forest.grow():
            place = np.minimum(np.searchsorted(tree.terms, at), len(tree.terms) - 1)
            own = np.flatnonzero(tree.terms[place] == at)
            if not len(own):
                continue
            column, place = np.unique(place[own], return_inverse=True)
            # documents by the term that gives most, so that those of a node are alike
            by = np.lexsort((-value[own] * self.forest.weights[at[own]], of[own]))
            there, first = np.unique(of[own][by], return_index=True)
            order = there[np.argsort(place[by[first]], kind="stable")]
            rank = np.full(len(ids), -1)
            rank[order] = np.arange(len(order))
            docs = np.zeros((len(order), len(column)))
            docs[rank[of[own]], place] = value[own]
            levels = [docs]
            while len(levels[0]) > 1:
                levels.insert(0, np.maximum.reduceat(levels[0], np.arange(0, len(levels[0]), FAN), axis=0))
            self._pairs(tree, [x[column] for x in tree.levels], levels, ids[order], none[order])

    def _pairs(self, tree: Tree, sides: list[np.ndarray], docs: list[np.ndarray], ids: np.ndarray, none: np.ndarray) -> None:
        """Depth first over document nodes, the likeliest first; each takes on the item nodes that its parent's bounds left, and splits them down to items."""
        last = max(0, len(docs) - 2)  # nodes whose children are documents
        stack = [(0, 0, np.zeros(1, np.int64), 0)]
        while stack:
            level, node, alive, depth = stack.pop()
            some = np.flatnonzero(docs[level][node])
            most = docs[level][node][some]
            while True:
                bound = most @ sides[depth][np.ix_(some, alive)]
                weakest = np.minimum.reduceat(self.floors[tree.numbers], tree.starts[depth])[alive]
                alive = alive[(bound * (1 + 1e-9) >= weakest) & (bound > 0)]
                if not len(alive) or depth == len(sides) - 1:
                    break
                depth += 1
                alive = (alive[:, None] * FAN + np.arange(FAN)).ravel()
                alive = alive[alive < sides[depth].shape[1]]
            if not len(alive):
                continue
            below = docs[min(level + 1, len(docs) - 1)]
            a, b = (node * FAN, min((node + 1) * FAN, len(below))) if len(docs) > 1 else (0, 1)
            if level < last:
                likely = np.argsort((below[a:b][:, some] @ sides[depth][np.ix_(some, alive)]).max(1), kind="stable")
                stack += [(level + 1, a + int(c), alive, depth) for c in likely]
                continue
            left, right = below[a:b][:, some], sides[depth][np.ix_(some, alive)]
            score = left.astype(np.int64) @ right.astype(np.int64) if tree.wide else (left @ right).astype(np.int64)
            self.scored += score.size
            enough = score >= np.maximum(1, self.floors[tree.numbers[alive]])
            for k in np.flatnonzero(enough.any(0)):
                good = enough[:, k]
                self.keep(int(tree.numbers[alive[k]]), score[good, k], ids[a:b][good], none[a:b][good])


def saturated(tf: np.ndarray, n: np.ndarray, of: np.ndarray, documents: int, length: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m), with m = 50 + (50 n N) div L of each document."""
    n = n.astype(object) if 50 * int(n.max(initial=0)) * documents >= 2**63 else n
    m = (50 + (50 * n * documents) // max(1, length)).astype(np.int64)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m[of])


def _searched(rows: DataFrame, forest: Broadcast, floors: Broadcast, documents: int, length: int, top: int) -> DataFrame:
    """vectors -> item (number), doc_id, score: each partition's best documents of each item that reach the item's floor."""

    def work(batches):
        found = Search(forest.value, floors.value, top)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                id_, n, at, tf = (part.column(c) for c in ("doc_id", "n", "at", "tf"))
                of = np.repeat(np.arange(part.num_rows), at.value_lengths().to_numpy(zero_copy_only=False))
                value = saturated(tf.flatten().to_numpy(), n.to_numpy(), of, documents, length)
                found.search(id_.fill_null(0).to_numpy(), id_.is_null().to_numpy(zero_copy_only=False), of, at.flatten().to_numpy(), value)
        for item, (score, ids, none) in found.best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item), pa.int32()), pa.array(ids, pa.int64(), mask=none), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return small_batches(rows).mapInArrow(work, "item int, doc_id long, score long")


def _block(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """The result for some items, given as rows (item_id, terms)."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    held = np.concatenate([np.array(r["terms"], np.int64) for r in rows])
    vocabulary = Vocabulary(held)
    made = saved(vectors(docs, send(vocabulary)), "vectors")
    documents, length = made.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary.hashes))
    counted = made.select(F.explode("at").alias("at")).groupBy("at").count().toArrow()
    df[counted["at"].to_numpy()] = counted["count"].to_numpy()
    weights = np.floor(1000 * np.log((2.0 * documents + 2) / (2 * df + 1))).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum([len(r["terms"]) for r in rows])])
    forest = send(Forest(starts, np.searchsorted(vocabulary.hashes, held), weights))

    by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = lambda part, floors: saved(_searched(part, forest, send(floors), documents, length, top).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top), "ranked")
    floors = np.zeros(len(rows), np.int64)
    seed = best(made.filter(F.pmod(F.xxhash64("doc_id", "n", "at", "tf"), F.lit(SEED)) == 0), floors).filter(F.col("rank") == top).toArrow()
    floors[seed["item"].to_numpy()] = seed["score"].to_numpy()
    # one number and id an item of the block
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
    return best(made, floors).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> item_id, rank, doc_id, score: the `top` best documents of each item, fewer if fewer score.

    Null and blank texts have no terms: such documents aren't counted, such items have no rows. Equal scores stand by
    ascending id, documents without one last. Rows that repeat are documents of their own; items that repeat an id are
    ranked apart, and a null id stays null. A very long text is cut piece by piece. Without documents or items there are no
    rows. Other columns play no part. An item of more terms than a block is a block of its own.
    """
    held = saved(item_terms(items), "items")
    total = held.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    many = -(-total // block_terms)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(many):
        rows = held.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(many)) == k).orderBy("item_id", "terms").collect()
        if rows:
            out = out.union(_block(docs, rows, top))
    return out


def op11_lexical(spark, sf_dir) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents where text is not null),
c as (select doc_id, len(ws) n, unnest(ws) t from d where len(ws) > 0),
g as (select count(*) bn, sum(len(ws)) bl from d where len(ws) > 0),
tf as (select doc_id, n, t, count(*) tf from c group by 1, 2, 3),
i as (select distinct item_id, t from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) t from benchmark)),
w as (select t, cast(floor(1000 * ln((2 * bn + 2) / (2 * df + 1))) as bigint) w from (select t, cast(count(*) as double) df from tf group by 1), (select cast(bn as double) bn from g)),
s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * bn) // bl)))) as bigint) score from i join tf using (t) join w using (t), (select bn, cast(bl as bigint) bl from g) group by 1, 2),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 50"""
