"""Removal of long repeated word spans by compaction of a de Bruijn graph.

Every window of ``WINDOW`` words is an edge of the graph. Consecutive windows whose smallest ``ANCHOR``-word hash is one
and the same string form a bundle, a nonbranching piece of a path that needs no join. Equal windows hold equal anchors,
so only bundles whose anchor occurs twice can hold a repeated edge; only these are taken up into the graph.

Equal bundles form a class with its number, its first source coordinate (id, then place) and the bundles before and
after it where all its occurrences agree. A join links a class with the next one if each is the only neighbour of the
other: all their occurrences then coincide, and chains of linked classes compact to paths. A path's occurrences but the
first are repeated spans, each found by the path's head alone. The first occurrence of a class may still hold edges that
another class (a bundle cut differently at the rim of a span) has earlier: edges that several classes share are grouped
to their first coordinate, and runs of them with one displacement become spans as well.

Each span names an earlier source. The source's words are digested from its coordinates (128 bits), and a span is only
removed if its own words have that digest; others stay and are counted in ``n_unverified``. That takes two different
windows with one 64-bit hash.

No key gathers rows in one task: anchors, classes and edges are counted with partial sums, and the joins that follow
read those counts as written tables, so adaptive execution splits a hot key. Spans of one document meet in its own row.

Defined results: a null text has no words. Rows of equal id and text are one document, and each gets its result; rows
that repeat an id with another text are ordered by a hash of the text. A null id comes before all others. Ids may have
any type that orders. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, column, discard, materialize, releasing, table, utf8
from .jaccard_join import BASE, BLOCK, INVERSE, SPACE, mix, powers
from .suffix_dedup import sliding_min

#: Words of a window that counts as a repeated span, and of the string that anchors a bundle.
WINDOW, ANCHOR = 20, 6
LOW = np.uint64(2**32 - 1)


def word_hashes(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash and row of every word, and its place within the row; ``gap`` says which bytes part words."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    inside = ~gap[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = row[1:] != row[:-1]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (cut[:-1] | ~before))
    end = np.flatnonzero(inside & (cut[1:] | ~after)) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), dtype=np.uint64, out=sums[1:])
    word = mix((sums[end] - sums[start]) * powers(INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    owner = row[start]
    first = np.searchsorted(owner, np.arange(rows))
    return word, owner, np.arange(len(word)) - first[owner]


def strings(word: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(word) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(BASE) + word[k : k + n]
    return mix(h)


class Bundles:
    """Bundles of a block of texts: row, anchor hash, first window's place and number of windows, with the edges' hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
        none = np.zeros(0, np.int64)
        self.edges, self.row, self.anchor, self.place, self.count, self.at = none.view(np.uint64), none, none, none, none, none
        word, owner, place = word_hashes(data, offsets)
        n = len(word) - window + 1
        if n <= 0:
            return
        inside = np.flatnonzero(owner[:n] == owner[window - 1 :])
        if not len(inside):
            return
        gram = strings(word, anchor)
        # the least of the upper 32 bits, ties to the rightmost
        packed = (gram & ~LOW) | (LOW - np.arange(len(gram), dtype=np.uint64))
        least = sliding_min(packed, window - anchor + 1)[inside]
        row = owner[inside]
        new = np.ones(len(inside), bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        self.at = np.flatnonzero(new)
        self.edges = strings(word, window)[inside]
        self.row, self.place = row[self.at], place[inside][self.at]
        self.anchor = gram[(LOW - (least[self.at] & LOW)).astype(np.int64)].view(np.int64)
        self.count = np.diff(np.append(self.at, len(inside)))

    def digests(self) -> np.ndarray:
        """Hash of each bundle's words: its first and last window cover them all."""
        first, last = self.edges[self.at], self.edges[self.at + self.count - 1]
        return mix(first * np.uint64(BASE) + mix(last + self.count.astype(np.uint64)))

    def neighbours(self, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digest of the bundle before and after, 0 at the ends of a text."""
        same = self.row[1:] == self.row[:-1]
        before, after = np.zeros(len(digest), np.uint64), np.zeros(len(digest), np.uint64)
        before[1:], after[:-1] = np.where(same, digest[:-1], np.uint64(0)), np.where(same, digest[1:], np.uint64(0))
        return before, after


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... for each count, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - start, count)


@releasing
def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text", BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(Bundles(*utf8(column(block, "text"))).anchor)], names=["anchor"])


@releasing
def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text", BLOCK):
            found = Bundles(*utf8(column(block, "text")))
            owner = pa.array(found.row)
            yield pa.RecordBatch.from_arrays([pa.array(found.anchor), column(block, "doc_id").take(owner), column(block, "th").take(owner), pa.array(found.place)], names=["anchor", "doc_id", "th", "place"])


@releasing
def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles at the wanted places; the first of a digest in a block brings the hashes of its edges along."""
    for batch in batches:
        for block in blocks(batch, "text", BLOCK):
            found = Bundles(*utf8(column(block, "text")))
            wanted = column(block, "places")
            starts = np.diff(wanted.offsets.to_numpy())
            pick = (np.repeat(np.arange(len(wanted)), starts) << 32) | wanted.flatten().to_numpy()
            take = np.flatnonzero(np.isin((found.row << 32) | found.place, pick))
            digest = found.digests()
            before, after = found.neighbours(digest)
            first = np.zeros(len(take), bool)
            first[np.unique(digest[take], return_index=True)[1]] = True
            size = np.where(first, found.count[take], 0)
            raw = found.edges[spread(found.at[take], size)].tobytes()
            ends = np.concatenate([[0], np.cumsum(8 * size)]).astype(np.int32)
            bits = pa.py_buffer(np.packbits(first, bitorder="little").tobytes())
            edges = pa.Array.from_buffers(pa.binary(), len(take), [bits, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
            owner = pa.array(found.row[take])
            numbers = [pa.array(x[take].view(np.int64)) for x in (digest, before, after)]
            th = column(block, "th").take(owner)
            pos = (found.place[take] << 32) | th.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([numbers[0], column(block, "doc_id").take(owner), pa.array(pos), *numbers[1:], pa.array(found.count[take].astype(np.int32)), edges], names=["digest", "doc_id", "pos", "before", "after", "windows", "edges"])


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every edge of a class with its coordinate in the first occurrence."""
    for batch in batches:
        held = column(batch, "edges").to_pylist()
        count = np.array([len(e) // 8 for e in held], np.int64)
        edges = np.frombuffer(b"".join(held), np.int64)
        step = spread(np.zeros(len(count), np.int64), count)
        pos = np.repeat(column(batch, "pos").to_numpy(), count) + (step << 32)
        yield pa.RecordBatch.from_arrays([pa.array(edges), column(batch, "doc_id").take(pa.array(np.repeat(np.arange(len(count)), count))), pa.array(pos)], names=["edge", "doc_id", "pos"])


def span_digest(words: list[bytes], start: int, windows: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + windows + WINDOW - 1]), digest_size=16).digest()


@releasing
def _source_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text", BLOCK):
            owner, place, windows, digest = [], [], [], []
            for k, (text, wanted) in enumerate(zip(column(block, "text").to_pylist(), column(block, "wanted").to_pylist(), strict=True)):
                words = text.encode().split()
                for span in wanted:
                    owner.append(k)
                    place.append(span["place"])
                    windows.append(span["windows"])
                    digest.append(span_digest(words, span["place"], span["windows"]))
            pick = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([column(block, "doc_id").take(pick), column(block, "th").take(pick), pa.array(place, pa.int64()), pa.array(windows, pa.int64()), pa.array(digest, pa.binary())], names=["source_id", "source_th", "source_place", "windows", "source_digest"])


@releasing
def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text", BLOCK):
            out = []
            for text, spans in zip(column(block, "text").to_pylist(), column(block, "spans").to_pylist(), strict=True):
                words = text.encode().split()
                kept, reached, removed, failed = [], 0, 0, 0
                for span in sorted(spans or (), key=lambda s: s["place"]):
                    start, end = span["place"], span["place"] + span["windows"] + WINDOW - 1
                    if span_digest(words, start, span["windows"]) != span["source_digest"]:
                        failed += 1
                    elif end > reached:
                        kept += words[reached:start]
                        removed += end - max(start, reached)
                        reached = end
                kept = b" ".join(kept + words[reached:])
                out.append((len(words), removed, hashlib.sha256(kept).hexdigest(), failed, kept.decode()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([column(block, "doc_id"), *(pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "n_unverified", "kept"])


def coordinate(doc_id: str = "doc_id", pos: str = "pos") -> Column:
    """Where an occurrence stands, in the order that decides which is first."""
    return F.struct(F.col(doc_id).alias("doc_id"), F.col(pos).alias("pos"))


def place_of(pos: Column) -> Column:
    return F.shiftrightunsigned(pos, 32)


def text_hash_of(pos: Column) -> Column:
    return pos.bitwiseAND(F.lit(int(LOW)))


def same_text(ids: str, th: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(ids)) & (F.col("th") == F.col(th))


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences of bundles whose anchor is repeated, and their classes."""
    kind = dict(rows.dtypes)["doc_id"]
    found = rows.select("text").mapInArrow(_anchors, "anchor long")
    twice = materialize(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    places = rows.mapInArrow(_places, f"anchor long, doc_id {kind}, th long, place long").join(twice, "anchor", "left_semi")
    wanted = materialize(places.groupBy(F.col("doc_id").alias("in_id"), F.col("th").alias("in_th")).agg(F.collect_set("place").alias("places")), "places")
    held = rows.join(wanted, same_text("in_id", "in_th")).select("doc_id", "th", "text", "places")
    occurrences = materialize(held.mapInArrow(_occurrences, f"digest long, doc_id {kind}, pos long, before long, after long, windows int, edges binary"), "occurrences")
    only = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    grouped = occurrences.groupBy("digest").agg(F.count("*").alias("n"), F.min(coordinate()).alias("first"), only("before"), only("after"), F.first("windows").alias("windows"), F.max("edges").alias("edges"))
    classes = materialize(grouped.select("digest", "n", "first.doc_id", "first.pos", "before", "after", "windows", "edges"), "classes")
    discard(twice, wanted)
    return occurrences, classes


def paths_of(classes: DataFrame) -> DataFrame:
    """Chains of classes that occur only together: the head's digest, the first coordinate as source and the number of windows."""
    often = classes.where("n > 1").select("digest", "doc_id", "pos", "before", "after", "windows")
    ahead = often.select(F.col("digest").alias("before"), F.col("after").alias("digest"), F.lit(True).alias("linked"))
    linked = often.join(ahead, ["before", "digest"], "left").withColumns({"th": text_hash_of(F.col("pos")), "place": place_of(F.col("pos"))})
    order = Window.partitionBy("doc_id", "th").orderBy("place")
    numbered = linked.withColumn("path", F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(order))
    heads = numbered.groupBy("doc_id", "th", "path").agg(F.min_by("digest", "place").alias("digest"), F.min("place").alias("source_place"), F.sum("windows").alias("windows"))
    return heads.select("digest", F.col("doc_id").alias("source_id"), F.col("th").alias("source_th"), "source_place", "windows")


def rim_spans(classes: DataFrame) -> DataFrame:
    """Runs of edges in first occurrences of classes that another class has earlier, with their source."""
    kind = dict(classes.dtypes)["doc_id"]
    edges = classes.select("doc_id", "pos", "edges").mapInArrow(_edge_rows, f"edge long, doc_id {kind}, pos long")
    shared = materialize(edges.groupBy("edge").agg(F.count("*").alias("n"), F.min(coordinate()).alias("source")).where("n > 1").drop("n"), "edges")
    later = edges.join(shared, "edge").where(coordinate() > F.col("source"))
    at = later.select(
        "doc_id", text_hash_of(F.col("pos")).alias("th"), place_of(F.col("pos")).alias("place"),
        F.col("source.doc_id").alias("source_id"), text_hash_of(F.col("source.pos")).alias("source_th"), place_of(F.col("source.pos")).alias("source_place"),
    )
    keys = ["doc_id", "th", "source_id", "source_th", "moved"]
    run = F.col("place") - F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
    runs = at.withColumn("moved", F.col("source_place") - F.col("place")).withColumn("run", run)
    made = runs.groupBy(*keys, "run").agg(F.min("place").alias("place"), F.min("source_place").alias("source_place"), F.count("*").alias("windows")).drop("moved", "run")
    made = materialize(made, "rims")
    discard(shared)
    return made


def spans_of(rows: DataFrame) -> DataFrame:
    """Repeated spans by document: in_id, in_th and spans of (place, windows, source_digest)."""
    kind = dict(rows.dtypes)["doc_id"]
    occurrences, classes = classes_of(rows)
    heads, rims = materialize(paths_of(classes), "paths"), rim_spans(classes)
    discard(classes)
    source = ["source_id", "source_th", "source_place", "windows"]
    asked = heads.select(*source).unionByName(rims.select(*source)).distinct().groupBy("source_id", "source_th").agg(F.collect_list(F.struct(F.col("source_place").alias("place"), "windows")).alias("wanted"))
    texts = rows.join(asked, same_text("source_id", "source_th")).select("doc_id", "th", "text", "wanted")
    answers = texts.mapInArrow(_source_digests, f"asked_id {kind}, source_th long, source_place long, windows long, source_digest binary")
    answers = materialize(answers.dropDuplicates(["asked_id", *source[1:]]), "sources")

    def answered(spans: DataFrame) -> DataFrame:
        return spans.join(answers, [spans["source_id"].eqNullSafe(answers["asked_id"]), *(spans[c] == answers[c] for c in source[1:])]).select(*(spans[c] for c in spans.columns), "source_digest")

    named = materialize(answered(heads), "heads")
    first = (F.shiftleft("source_place", 32)).bitwiseOR(F.col("source_th"))
    repeats = occurrences.select("digest", "doc_id", "pos").join(named, "digest").where(coordinate() > F.struct(F.col("source_id").alias("doc_id"), first.alias("pos")))
    repeats = repeats.select("doc_id", text_hash_of(F.col("pos")).alias("th"), place_of(F.col("pos")).alias("place"), "windows", "source_digest")
    spans = materialize(repeats.unionByName(answered(rims).select("doc_id", "th", "place", "windows", "source_digest")), "spans")
    discard(occurrences, heads, rims, answers, named)
    return spans.groupBy(F.col("doc_id").alias("in_id"), F.col("th").alias("in_th")).agg(F.collect_set(F.struct("place", "windows", "source_digest")).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Of each document: doc_id, n_words, n_removed, kept_sha256, n_unverified and kept, the words left joined by spaces."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.hash("text").cast("long").bitwiseAND(F.lit(int(LOW))))
    kind = dict(rows.dtypes)["doc_id"]
    found = rows.join(spans_of(rows), same_text("in_id", "in_th"), "left").select("doc_id", "text", "spans")
    return found.mapInArrow(_removed, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, n_unverified long, kept string")


def op12_de_bruijn(spark, sf_dir: str) -> DataFrame:
    """Contract query over every document."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "n_unverified")


def oracle() -> str:
    """The contract rows in DuckDB, window by window."""
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, w, unnest(range(0, len(w) - {WINDOW - 1})) AS place FROM w WHERE len(w) >= {WINDOW}),
turn AS (SELECT doc_id, place, row_number() OVER (PARTITION BY md5(array_to_string(w[place + 1:place + {WINDOW}], ' ')) ORDER BY doc_id, place) AS n FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(place, place + {WINDOW})) AS k FROM turn WHERE n > 1),
out AS (SELECT doc_id, list(k) AS g FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS k FROM w),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.k) AS kept FROM word LEFT JOIN gone USING (doc_id, k) WHERE gone.k IS NULL GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN out USING (doc_id) LEFT JOIN kept USING (doc_id)"""
