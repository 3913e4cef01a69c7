"""Exact ranked search of all documents for each item of a query table, by two hierarchies searched against each other.

A document is a sparse vector of term impacts, an item one of term weights, and a score is their product. Both sides
form trees: documents of a grove (a bounded run of rows, ordered so that similar ones are neighbours) and items alike
are grouped into leaves and the leaves into nodes, and every node holds the maximum of each coordinate below it. The
product of two nodes' maxima bounds all scores between them. A pair of nodes is left out, with all its items and all
its documents, if its bound is below the weakest k-th score of its items so far; other pairs are split, the more
promising half first, down to single scores. Equal bounds are not left out, since ties go to the smaller id.

Spark spreads documents over tasks by their leading terms, so a grove's maxima are tight; ties of the order spread by a
hash. A first round over every 32nd document by hash gives each item a score to beat, which the round over all documents
starts with: its k-th score there cannot exceed the final one, so nothing is lost. Each task returns at most k rows an
item, and these are ranked.

Items are taken in blocks of at most ``BLOCK_TERMS`` terms (one longer item is its own block), so what is broadcast, or
comes to the driver (a block's terms, their document counts, the scores to beat), has that bound whatever the tables;
every block searches all documents. Terms are compared by 64-bit hashes.

Defined results: a null text has no terms; a document without terms counts nowhere, an item without terms has no rows.
Rows that repeat an item_id are ranked each for itself; rows that repeat a doc_id are documents of their own. Among
equal scores a null doc_id comes last. Extra columns are ignored, an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, column, discard, materialize, partitions, releasing, table, utf8
from .de_bruijn import BLOCK, spread, word_hashes
from .jaccard_join import LOWER
from .oracles import LETTERS

TOP = 20
#: Terms of a block of items.
BLOCK_TERMS = 1 << 19
#: Documents and items of a leaf, nodes of a node, and documents of a grove.
DOC_LEAF, ITEM_LEAF, FAN, GROVE = 32, 8, 4, 1024
#: One document in so many takes part in the first round.
PILOT = 32

# The bytes that part terms; all others, those of non-ASCII letters included, belong to one.
GAP = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    GAP[_low : _high + 1] = True


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term."""
    data, offsets = utf8(texts)
    word, owner, _ = word_hashes(LOWER[data], offsets, GAP)
    return word, owner


def counted(owner: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, term) pairs in order, and how often each occurs."""
    turn = np.lexsort((term, owner))
    owner, term = owner[turn], term[turn]
    new = np.ones(len(turn), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return owner[at], term[at], np.diff(np.append(at, len(turn)))


def lists(owner: np.ndarray, rows: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


@releasing
def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text", BLOCK):
            word, owner = terms_of(column(block, "text"))
            owner, word, n = counted(owner, word)
            yield pa.RecordBatch.from_arrays([column(block, "item_id"), lists(owner, block.num_rows, word.view(np.int64), pa.int64()), lists(owner, block.num_rows, n, pa.int64())], names=["item_id", "terms", "repeats"])


@releasing
def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Terms of each document, how many of them, and the asked ones with their numbers."""
    for batch in batches:
        for block in blocks(batch, "text", BLOCK):
            word, owner = terms_of(column(block, "text"))
            n = np.bincount(owner, minlength=block.num_rows)
            place = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
            hit = vocabulary[place] == word
            owner, term, tf = counted(owner[hit], place[hit])
            yield pa.RecordBatch.from_arrays([column(block, "doc_id"), pa.array(n, pa.int64()), lists(owner, block.num_rows, term, pa.int32()), lists(owner, block.num_rows, tf, pa.int64())], names=["doc_id", "n", "terms", "tf"])


class Node:
    """Maxima of coordinates (sorted terms and values) over what lies in [low, high)."""

    __slots__ = ("high", "low", "nodes", "terms", "top")

    def __init__(self, low: int, high: int, terms: np.ndarray, values: np.ndarray, nodes: tuple = ()):
        self.low, self.high, self.nodes = low, high, nodes
        turn = np.argsort(terms, kind="stable")
        terms = terms[turn]
        at = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
        self.terms, self.top = terms[at], np.maximum.reduceat(values[turn], at) if len(at) else values[:0]


def product(terms: np.ndarray, weights: np.ndarray, node: Node) -> int:
    """Bound of weighted terms against a node."""
    if not len(node.terms):
        return 0
    place = np.minimum(np.searchsorted(node.terms, terms), len(node.terms) - 1)
    return int((weights * node.top[place] * (node.terms[place] == terms)).sum())


def hierarchy(ends: np.ndarray, terms: np.ndarray, values: np.ndarray, leaf: int) -> Node:
    """Tree over rows whose coordinates are terms[ends[k]:ends[k + 1]]."""
    rows = len(ends) - 1
    level = [Node(k, min(k + leaf, rows), terms[ends[k] : ends[min(k + leaf, rows)]], values[ends[k] : ends[min(k + leaf, rows)]]) for k in range(0, rows, leaf)]
    while len(level) > 1:
        groups = [tuple(level[k : k + FAN]) for k in range(0, len(level), FAN)]
        level = [Node(g[0].low, g[-1].high, np.concatenate([n.terms for n in g]), np.concatenate([n.top for n in g]), g) for g in groups]
    return level[0]


def reordered(ends: np.ndarray, order: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    size = np.diff(ends)[order]
    pick = spread(ends[:-1][order], size)
    return np.concatenate([[0], np.cumsum(size)]), *(c[pick] for c in columns)


class Items:
    """Weighted items of a block, ordered by their weightiest term, with their tree."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        lead = [terms[a:b][weights[a:b].argmax()] if b > a else -1 for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.order = np.argsort(lead, kind="stable")
        self.ends, self.terms, self.weights = reordered(ends, self.order, terms, weights)
        self.root = hierarchy(self.ends, self.terms, self.weights, ITEM_LEAF)

    def __len__(self) -> int:
        return len(self.order)

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.terms[self.ends[k] : self.ends[k + 1]], self.weights[self.ends[k] : self.ends[k + 1]]


class Best:
    """The best documents of each item so far, and the score that the next one must reach."""

    def __init__(self, floor: np.ndarray, top: int):
        self.top, self.beat, self.found = top, np.maximum(floor, 1), [[] for _ in floor]

    def add(self, item: int, scored: list[tuple]) -> None:
        """Rows (-score, id is null, id)."""
        kept = sorted(self.found[item] + scored)[: self.top]
        self.found[item] = kept
        if len(kept) == self.top:
            self.beat[item] = max(self.beat[item], -kept[-1][0])


def search(items: Items, ids: list, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray, best: Best) -> int:
    """Search one grove; gives back how many single scores were worked out."""
    docs, scored = hierarchy(ends, terms, impacts, DOC_LEAF), 0
    todo = [(product(items.root.terms, items.root.top, docs), items.root, docs)]
    while todo:
        bound, asked, held = todo.pop()
        if bound < best.beat[asked.low : asked.high].min():
            continue
        if asked.nodes or held.nodes:
            split_items = asked.nodes and (not held.nodes or (asked.high - asked.low) * DOC_LEAF > (held.high - held.low) * ITEM_LEAF)
            pairs = [(n, held) for n in asked.nodes] if split_items else [(asked, n) for n in held.nodes]
            todo += sorted(((product(a.terms, a.top, d), a, d) for a, d in pairs), key=lambda p: p[0])
            continue
        span = slice(ends[held.low], ends[held.high])
        row = np.repeat(np.arange(held.high - held.low), np.diff(ends[held.low : held.high + 1]))
        turn = np.argsort(terms[span], kind="stable")
        term, row, impact = terms[span][turn], row[turn], impacts[span][turn]
        for k in range(asked.low, asked.high):
            own, weight = items.of(k)
            if product(own, weight, held) < best.beat[k]:
                continue
            low, high = np.searchsorted(term, own, "left"), np.searchsorted(term, own, "right")
            at = spread(low, high - low)
            score = np.zeros(held.high - held.low, np.int64)
            np.add.at(score, row[at], np.repeat(weight, high - low) * impact[at])
            scored += len(score)
            good = np.flatnonzero(score >= best.beat[k])
            if len(good):
                best.add(k, [(-int(score[g]), ids[held.low + g] is None, ids[held.low + g]) for g in good.tolist()])
    return scored


def length_factor(n: int, documents: int, total: int) -> int:
    return 100 - 25 + (25 * n * documents) // total


@releasing
def _searched(batches: Iterator[pa.RecordBatch], items: Items, floor: np.ndarray, documents: int, total: int, top: int, id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    best = Best(floor, top)
    for whole in batches:
        for start in range(0, whole.num_rows, GROVE):
            batch = whole.slice(start, GROVE)
            held = column(batch, "terms")
            ends = np.concatenate([[0], np.cumsum(np.diff(held.offsets.to_numpy()))])
            terms, tf = held.flatten().to_numpy(), column(batch, "tf").flatten().to_numpy()
            m = np.array([length_factor(n, documents, total) for n in column(batch, "n").to_pylist()], np.int64)
            impacts = (1_000_000_000 * tf) // (1_000 * tf + 12 * np.repeat(m, np.diff(ends)))
            search(items, column(batch, "doc_id").to_pylist(), ends, terms, impacts, best)
    rows = [(k, r[2], -r[0]) for k, found in enumerate(best.found) for r in found]
    place, ids, scores = zip(*rows, strict=True) if rows else ([], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(items.order[list(place)] if rows else [], pa.int64()), pa.array(ids, id_kind), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])


def item_blocks(items: DataFrame, limit: int) -> Iterator[list]:
    """Rows of items in turn, in blocks of at most ``limit`` terms."""
    held, size = [], 0
    for row in items.where(F.size("terms") > 0).toLocalIterator():
        if held and size + len(row["terms"]) > limit:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row["terms"])
    if held:
        yield held


def _block_ranks(rows: list, item_kind: str, docs: DataFrame, top: int, pilot: int) -> DataFrame:
    """Ranked documents of the items of one block, written out."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    asked = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
    ends = np.concatenate([[0], np.cumsum([len(a) for a in asked])])
    vocabulary, terms = np.unique(np.concatenate(asked), return_inverse=True)
    shared = spark.sparkContext.broadcast(vocabulary)
    id_name = kind.simpleString()
    vectors = docs.select("doc_id", "text").mapInArrow(lambda it: _vectors(it, shared.value), f"doc_id {id_name}, n long, terms array<int>, tf array<long>")
    vectors = materialize(vectors.where("n > 0"), "vectors")
    documents, total = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, count in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[term] = count
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    items = Items(ends, terms, weight[terms] * np.concatenate([np.array(r["repeats"], np.int64) for r in rows]))
    weights = spark.sparkContext.broadcast(weight)

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The two weightiest asked terms of each document, by which neighbours are found."""
        for batch in batches:
            first, second = [], []
            for held in column(batch, "terms"):
                own = held.values.to_numpy()
                two = own[np.argsort(-weights.value[own], kind="stable")[:2]].tolist() + [-1, -1]
                first.append(two[0])
                second.append(two[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(second, pa.int32())], names=[*batch.schema.names, "lead", "second"])

    held = vectors.where(F.size("terms") > 0).mapInArrow(leading, f"doc_id {id_name}, n long, terms array<int>, tf array<long>, lead int, second int")
    order = ["lead", "second", F.xxhash64("doc_id", "n")]
    near = materialize(held.repartitionByRange(partitions(spark), *order).sortWithinPartitions("lead", "second"), "groves")
    discard(vectors)
    trees = spark.sparkContext.broadcast(items)
    arrow_kind = pa.string() if id_name == "string" else near.select("doc_id").limit(0).toArrow().schema.field(0).type

    def searched(rows_: DataFrame, floor: np.ndarray) -> DataFrame:
        start = spark.sparkContext.broadcast(floor)
        found = rows_.select("doc_id", "n", "terms", "tf").mapInArrow(lambda it: _searched(it, trees.value, start.value, documents, total, top, arrow_kind), f"item long, doc_id {id_name}, score long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        return found.withColumn("rank", rank).where(F.col("rank") <= top)

    floor = np.zeros(len(items), np.int64)
    if documents:
        place = np.argsort(items.order)
        for item, score in searched(near.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(pilot)) == 0), floor).where(F.col("rank") == top).select("item", "score").toLocalIterator():
            floor[place[item]] = score
    ids = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], f"item long, item_id {item_kind}")
    made = searched(near, floor).join(ids, "item").select("item_id", "rank", "doc_id", "score")
    made = materialize(made, "ranks")
    discard(near)
    return made


def rank(items: DataFrame, docs: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, pilot: int = PILOT) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank, doc_id, score."""
    item_kind, doc_kind = dict(items.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    asked = materialize(items.select("item_id", "text").mapInArrow(_item_rows, f"item_id {item_kind}, terms array<long>, repeats array<long>"), "items")
    made = [_block_ranks(rows, item_kind, docs, top, pilot) for rows in item_blocks(asked, block_terms)]
    discard(asked)
    if not made:
        return docs.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")
    return reduce(DataFrame.unionByName, made)


def op13_dual_tree(spark, sf_dir: str) -> DataFrame:
    """Contract query: every benchmark item against every document."""
    return rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The contract rows in DuckDB, all products worked out."""
    cut = f"regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {cut} AS t FROM documents), item AS (SELECT item_id, unnest({cut}) AS term FROM benchmark), asked AS (SELECT item_id, term, count(*) AS r FROM item GROUP BY item_id, term),
total AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM d WHERE len(t) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
m AS (SELECT doc_id, 75 + ((25 * len(t) * docs) // words) AS m FROM d, total WHERE len(t) > 0),
s AS (SELECT item_id, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}"""
