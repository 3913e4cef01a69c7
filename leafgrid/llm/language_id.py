"""Language identification by prediction by partial matching.

Byte n-gram counts of a bounded labelled sample make one variable-order context tree for each language. Escape
probabilities (method C, with exclusion of the symbols already offered by longer contexts) are folded into one cost
row per context once, so that the statistics are frozen. Scoring walks each byte to the longest context that the
language's tree holds and adds the exact code length of the byte; the shortest code wins.

The model is broadcast: ``CONTEXTS`` rows for each language, about 2 MB, so it grows with the number of languages
and not with the corpus.

Defined results: a null text, an empty one or one without any letter (Unicode category L; numerals such as "²" or "Ⅷ"
are none) is ``und`` with score 0. Ties go to the language that sorts first. Every row gets a row, repeated rows and
null ids included (a null id is in training). Extra columns of the input are ignored. Without training rows every text
is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, column, releasing, remainder, table, utf8

#: Documented bounds: documents of a language in the training sample, and contexts of its tree.
SAMPLE_PER_LANGUAGE = 600
CONTEXTS = 3_500
ORDER = 4
LETTER = regex.compile(r"\p{L}")


@dataclass
class ContextTree:
    """Frozen statistics of a language: ``child[node, symbol]`` walks to longer contexts, ``cost[node, symbol]`` is in bits."""

    child: np.ndarray
    cost: np.ndarray


@dataclass
class Trees:
    """The trees of all languages over one alphabet; its last symbol stands for every byte never seen."""

    languages: list[str]
    symbol: np.ndarray
    trees: list[ContextTree]
    order: int

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row in each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(data):
            return out
        symbols = self.symbol[data].astype(np.int32)
        starts, edge = offsets[:-1], int(self.symbol.max()) + 1
        before = []
        for depth in range(1, self.order + 1):
            back = np.full_like(symbols, edge)
            back[depth:] = symbols[:-depth]
            for k in range(depth):  # a context never reaches into the document before
                at = starts + k
                back[at[at < offsets[1:]]] = edge
            before.append(back)
        full = offsets[1:] > starts
        for k, tree in enumerate(self.trees):
            flat, alphabet, half = tree.child.reshape(-1), tree.child.shape[1], len(tree.child) // 2
            node = np.zeros(len(data), np.int32)
            for back in before:
                node = flat[node * np.int32(alphabet) + back]
            node = np.where(node >= half, node - half, node)
            cost = tree.cost.reshape(-1)[node * np.int32(tree.cost.shape[1]) + symbols]
            out[full, k] = np.add.reduceat(cost, starts[full], dtype=np.float64)
        return out


def _gram_counts(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text", 8 << 20):
            langs = np.array(column(block, "lang").to_pylist(), dtype=object)
            data, offsets = utf8(column(block, "text"))
            owner = np.repeat(np.arange(len(langs)), np.diff(offsets))
            for lang in sorted(set(langs)):
                mine = langs[owner] == lang if len(owner) else np.zeros(0, bool)
                own, wide = owner[mine], data[mine].astype(np.int64)
                for n in range(1, order + 2):
                    if len(wide) < n:
                        break
                    code = np.zeros(len(wide) - n + 1, np.int64)
                    for k in range(n):
                        code = code * 256 + wide[k : len(wide) - n + 1 + k]
                    code, count = np.unique(code[own[: len(code)] == own[n - 1 :]], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(code), pa.string()), pa.array(np.full(len(code), n, np.int32)), pa.array(code), pa.array(count.astype(np.int64))],
                        names=["lang", "n", "gram", "count"],
                    )


def train(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, contexts: int = CONTEXTS, order: int = ORDER) -> Trees:
    """Fit the trees on at most about ``sample`` documents of each language, chosen by a hash of the id.

    The driver holds one number for each language, and the bounded counts of the trees.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return build({}, order)
    spread = (F.xxhash64(F.col("doc_id"), F.lit(17)) % 1_000_000 + 1_000_000) % 1_000_000 / 1e6
    rate = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))) for lang, n in sorted(sizes.items())])
    grams = (
        rows.where(spread < rate)
        .select("lang", "text")
        .mapInArrow(lambda it: _gram_counts(it, order), "lang string, n int, gram long, count long")
        .groupBy("lang", "n", "gram")
        .agg(F.sum("count").alias("count"))
        .withColumn("context", F.shiftright("gram", 8))
    )
    seen = grams.groupBy("lang", "n", "context").agg(F.sum("count").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("seen"), "n", "context"))
    kept = seen.withColumn("rank", rank).where(F.col("rank") <= contexts).select("lang", "n", "context")  # each language's most seen
    found = grams.join(F.broadcast(kept), ["lang", "n", "context"]).select("lang", "n", "gram", "count").toArrow()
    counts: dict[str, dict[tuple[int, int], int]] = {lang: {} for lang in sorted(sizes)}
    for lang, n, gram, count in zip(*(found.column(c).to_pylist() for c in ("lang", "n", "gram", "count")), strict=True):
        counts[lang][n, gram] = count
    return build(counts, order)


def build(counts: dict[str, dict[tuple[int, int], int]], order: int) -> Trees:
    """Freeze n-gram counts by language, keyed by length and big-endian code."""
    seen = sorted({g & 255 for c in counts.values() for _, g in c})
    symbol = np.full(256, len(seen), np.uint8)
    symbol[seen] = np.arange(len(seen))
    return Trees(list(counts), symbol, [freeze(c, symbol, len(seen) + 1, order) for c in counts.values()], order)


def freeze(counts: dict[tuple[int, int], int], symbol: np.ndarray, width: int, order: int) -> ContextTree:
    """The tree of one language over an alphabet of ``width`` symbols."""
    above = lambda n, context: (n - 1, context & ((1 << 8 * (n - 1)) - 1))
    contexts = {(0, 0): 0}
    for n, context in sorted({(n - 1, g >> 8) for n, g in counts}):
        if n and above(n, context) in contexts:
            contexts[n, context] = len(contexts)
    size = len(contexts)
    child = np.tile(np.arange(size, 2 * size)[:, None], (2, width + 1)).astype(np.int32 if size > 16_000 else np.int16)  # no longer context: stay, whatever follows
    table_ = np.zeros((size, width))
    parent_of, depth = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for (n, context), node in contexts.items():
        if n:
            parent_of[node], depth[node] = contexts[above(n, context)], n
            child[parent_of[node], symbol[context >> 8 * (n - 1)]] = node
    for (n, gram), count in counts.items():
        node = contexts.get((n - 1, gram >> 8))
        if node is not None:
            table_[node, symbol[gram & 255]] += count
    bits = np.zeros((size, width))
    done = np.zeros((size, width), bool)
    at = np.arange(size)
    for _ in range(order + 1):  # all nodes escape towards the root together
        live = np.where(done, 0.0, table_[at])
        total, kinds = live.sum(1, keepdims=True), (live > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = np.where(live > 0, bits - np.log2(live / (total + kinds)), bits)
            done |= live > 0
            bits = np.where(~done & (kinds > 0), bits - np.log2(kinds / (total + kinds)), bits)
        # a node at the root has offered all it has, so a second visit adds nothing
        at = np.where(depth[at] == 0, at, parent_of[at])
    left = np.maximum(256 - done.sum(1, keepdims=True), 1)
    return ContextTree(child, np.where(done, bits, bits + np.log2(left)).astype(np.float32))


@releasing
def _predict(batches: Iterator[pa.RecordBatch], tree: Trees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text"):
            text = column(block, "text")
            data, offsets = utf8(text)
            rows = block.num_rows
            ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
            cum = np.concatenate([[0], np.cumsum(ascii_letter)])
            lettered = cum[offsets[1:]] > cum[offsets[:-1]]
            for i in np.flatnonzero(~lettered):
                lettered[i] = bool(LETTER.search(bytes(data[offsets[i] : offsets[i + 1]]).decode("utf8", "replace")))
            if tree.languages:
                bits = tree.bits(data, offsets)
                best = bits.argmin(1)
                score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                names = np.array(tree.languages, dtype=object)[best]
            else:
                names, score, lettered = np.array(["und"] * rows, dtype=object), np.zeros(rows), np.zeros(rows, bool)
            names = np.where(lettered, names, "und")
            yield pa.RecordBatch.from_arrays(
                [column(block, "doc_id"), column(block, "held_out"), pa.array(list(names), pa.string()), pa.array(np.where(lettered, score, 0.0))],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )


def predict(docs: DataFrame, tree: Trees, held_out) -> DataFrame:
    """Language and posterior of every whole text; only the text is read for it."""
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(lambda it: _predict(it, shared.value), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query: learn where crc32(doc_id) mod 4 is not 2, predict every document."""
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    tree = train(docs.where(~F.coalesce(held, F.lit(False))))
    return predict(docs, tree, held)
