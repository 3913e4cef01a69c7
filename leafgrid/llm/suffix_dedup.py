"""Exact removal of repeated byte strings with a partitioned suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Every window of that length
owns one anchor: the smallest hash among its ``GRAM``-byte strings, so equal windows own equal anchors at the same
place. Only anchors whose string occurs twice can own a repeated window. For these, the record around the anchor
(all windows it owns) is cut out, equal records of a task are counted once, and the suffixes that start at the
anchors are range-partitioned by their leading bytes, Spark sampling the splitters. Within a bucket a multikey
quicksort over eight-byte characters orders the suffixes, and likewise the reversed prefixes; the common prefix
lengths of neighbours give classes of equal suffixes at every depth, and a window is repeated if its two classes
are shared. Splitters never fall between suffixes with the same leading bytes, so no class straddles a boundary;
an anchor with more than ``HOT_RECORDS`` different records is compared through digests of its windows instead,
which spread over all tasks.

Defined results: a null or empty text has 0 bytes and the digest of nothing. Rows that repeat a doc_id and its
text are two documents, each the other's copy; null ids are as any other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, column, discard, materialize, partitions, releasing, table, utf8

LENGTH = 200
GRAM = 32
WINDOW = LENGTH - GRAM + 1
HOT_RECORDS = 100_000
BLOCK_RECORDS = 30_000
#: Places within a text take 40 bits, more than any string of Spark has; the anchor is chosen by the other 24 bits of the hash.
POSITION_BITS = np.uint64(40)
BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """64-bit hash of each ``size``-byte string (a power of two), doubled up from bytes."""
    h, base, n = data.astype(np.uint64) + np.uint64(1), int(BASE), 1
    while n < size:
        h = h[:-n] * np.uint64(base) + h[n:]
        base, n = base * base % 2**64, 2 * n
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    rest = width - n
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor: row, hash of its string, place in the row, first and last window start that it owns."""
    empty = (np.zeros(0, np.int64),) * 5
    if len(data) < LENGTH:
        return empty
    hashes = gram_hashes(data)
    place = (np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets)))[: len(hashes)].astype(np.uint64)
    last = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
    packed = ((hashes >> POSITION_BITS) << POSITION_BITS) | (last - place)  # ties go to the rightmost
    least = sliding_min(packed, WINDOW)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = np.flatnonzero(row[: len(least)] == row[LENGTH - 1 : LENGTH - 1 + len(least)])
    if not len(valid):
        return empty
    owner, chosen = row[valid], least[valid]
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])]))
    end = np.concatenate([new[1:], [len(valid)]]) - 1
    row_of = owner[new]
    at = (last - (chosen[new] & last)).astype(np.int64)
    start = offsets[:-1][row_of]
    return row_of, hashes[start + at].view(np.int64), at, valid[new] - start, valid[end] - start


@releasing
def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text"):
            row, gram, at, low, high = anchors(*utf8(column(block, "text")))
            pick = pa.array(row)
            pos = (at << 16) | ((at - low) << 8) | (high - low)
            yield pa.RecordBatch.from_arrays([pa.array(gram), column(block, "key").take(pick), column(block, "th").take(pick), pa.array(pos)], names=["gram", "key", "th", "pos"])


@releasing
def _record_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (gram, digest, key, th, low) for each record, and one (gram, digest, first, content, n) for each that differs."""
    names = ["gram", "digest", "key", "th", "low", "lead", "first", "content", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
    seen: dict[tuple[int, int], list] = {}
    for batch in batches:
        data, offsets = utf8(column(batch, "text"))
        out = []
        for k, (key, th, found) in enumerate(zip(column(batch, "key").to_pylist(), column(batch, "th").to_pylist(), column(batch, "found").to_pylist(), strict=True)):
            for item in found or ():
                gram, pos = item["gram"], item["pos"]
                at, first, span = pos >> 16, (pos >> 8) & 255, pos & 255
                begin = int(offsets[k]) + at - first
                content = data[begin : begin + span + LENGTH].tobytes()
                digest = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "big", signed=True)
                known = seen.setdefault((gram, digest), [first, content, 0])
                known[2] += 1
                out.append((gram, digest, key, th, at - first, None, None, None, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    items = list(seen.items())
    for k in range(0, len(items), 20_000):
        rows = [(g, d, None, None, None, int.from_bytes(c[f : f + 7], "big"), f, c, n) for (g, d), (f, c, n) in items[k : k + 20_000]]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def multikey_sort(group: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the byte rows within groups, and the common prefix with the row before (-1 across groups).

    Multikey quicksort by breadth: at each depth all runs of equal rows are split at once by their next eight bytes.
    """
    n = len(group)
    wide = np.ascontiguousarray(chars).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    run = np.concatenate([[0], np.cumsum(group[order][1:] != group[order][:-1])]) if n else np.zeros(0, np.int64)
    live = np.arange(n)
    for depth in range(wide.shape[1]):
        same = np.zeros(len(live) + 1, bool)
        same[1:-1] = run[live][1:] == run[live][:-1]
        live = live[same[1:] | same[:-1]]  # rows whose run has others
        if not len(live):
            break
        key = wide[order[live], depth]
        turn = np.lexsort((key, run[live]))
        order[live] = order[live[turn]]
        key = key[turn]
        new = np.concatenate([[False], (key[1:] != key[:-1]) & (run[live][1:] == run[live][:-1])])
        step = np.zeros(n + 1, np.int64)
        step[live[new]] = 1
        run = run + np.cumsum(step[:n])
    common = np.full(n, -1, np.int64)
    if n > 1:
        a, b = chars[order[1:]], chars[order[:-1]]
        differ = a != b
        length = np.where(differ.any(1), differ.argmax(1), chars.shape[1])
        common[1:] = np.where(group[order[1:]] == group[order[:-1]], length, -1)
    return order, common


def repeated(gram: np.ndarray, first: np.ndarray, contents: list[bytes], n: np.ndarray) -> list[np.ndarray]:
    """For each record, which of its windows also occur in another record of its anchor."""
    size = len(contents)
    count = np.array([len(c) - LENGTH + 1 for c in contents])
    right, left = np.zeros((size, LENGTH), np.uint8), np.zeros((size, 8 * -(-WINDOW // 8)), np.uint8)
    for k, (c, f) in enumerate(zip(contents, first.tolist(), strict=True)):
        raw = np.frombuffer(c, np.uint8)
        tail = raw[f : f + LENGTH]
        right[k, : len(tail)] = tail
        left[k, :f] = raw[:f][::-1]
    masks = [np.full(c, m > 1) for c, m in zip(count.tolist(), n.tolist(), strict=True)]
    sides = []
    for chars in (right, left):
        order, common = multikey_sort(gram, chars)
        sides.append((np.argsort(order, kind="stable"), common))
    (rank_r, common_r), (rank_l, common_l) = sides
    for before in range(WINDOW):  # windows that start so many bytes before the anchor
        at = np.flatnonzero((before <= first) & (before > first - count))
        if len(at) < 2:
            continue
        suffix = np.cumsum(common_r < LENGTH - before)[rank_r[at]]
        prefix = np.cumsum(common_l < before)[rank_l[at]]
        key = suffix * (size + 1) + prefix
        turn = np.argsort(key, kind="stable")
        same = key[turn][1:] == key[turn][:-1]
        shared = np.zeros(len(at), bool)
        shared[turn[1:]] |= same
        shared[turn[:-1]] |= same
        for k in at[shared]:
            masks[k][first[k] - before] = True
    return masks


@releasing
def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor; blocks end between anchors."""
    held: dict[tuple[int, int], list] = {}
    last = None

    def flush() -> pa.RecordBatch:
        keys, rows = list(held), list(held.values())
        gram = np.array([g for g, _ in keys], np.int64)
        found = repeated(gram, np.array([r[0] for r in rows]), [r[1] for r in rows], np.array([r[2] for r in rows]))
        hit = [k for k, m in enumerate(found) if m.any()]
        return pa.RecordBatch.from_arrays([pa.array([keys[k][0] for k in hit], pa.int64()), pa.array([keys[k][1] for k in hit], pa.int64()), pa.array([found[k].tobytes() for k in hit], pa.binary())], names=["gram", "digest", "mask"])

    for batch in batches:
        for gram, digest, first, content, n in zip(*(column(batch, c).to_pylist() for c in ("gram", "digest", "first", "content", "n")), strict=True):
            if gram != last and len(held) >= BLOCK_RECORDS:
                yield flush()
                held.clear()
            last = gram
            held.setdefault((gram, digest), [first, content, 0])[2] += n
    if held:
        yield flush()


@releasing
def _window_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for gram, digest, content, n in zip(*(column(batch, c).to_pylist() for c in ("gram", "digest", "content", "n")), strict=True):
            views = [hashlib.blake2b(content[k : k + LENGTH], digest_size=16).digest() for k in range(len(content) - LENGTH + 1)]
            m = len(views)
            yield pa.RecordBatch.from_arrays([pa.array([gram] * m), pa.array([digest] * m), pa.array(range(m), pa.int32()), pa.array(views, pa.binary()), pa.array([n] * m)], names=["gram", "digest", "at", "view", "n"])


def _digest_masks(records: DataFrame) -> DataFrame:
    """The same masks by digests of single windows, for anchors with too many records for one bucket."""
    whole = records.groupBy("gram", "digest").agg(F.sum("n").alias("n"), F.first("content").alias("content"))
    views = materialize(whole.mapInArrow(_window_digests, "gram long, digest long, at int, view binary, n long"), "views")
    twice = views.groupBy("view").agg(F.sum("n").alias("total")).where("total > 1").select("view")
    hit = views.join(twice, "view", "left_semi").groupBy("gram", "digest").agg(F.array_sort(F.collect_list("at")).alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for at in column(batch, "at").to_pylist():
                mask = np.zeros(WINDOW + 1, bool)
                mask[at] = True
                masks.append(mask.tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "gram"), column(batch, "digest"), pa.array(masks, pa.binary())], names=["gram", "digest", "mask"])

    return hit.mapInArrow(pack, "gram long, digest long, mask binary")


@releasing
def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(column(batch, "text"))
        rows = []
        for k, found in enumerate(column(batch, "found").to_pylist()):
            raw = data[offsets[k] : offsets[k + 1]]
            edge = np.zeros(len(raw) + 1, np.int32)
            for item in found or ():
                starts = np.flatnonzero(np.frombuffer(item["mask"], bool)) + item["low"]
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + LENGTH, -1)
            gone = np.cumsum(edge)[:-1] > 0
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = raw[~gone].tobytes()
            rows.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        arrays = [column(batch, "doc_id"), *(pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays[: 5 + with_text], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])


def remove_repeats(docs: DataFrame, with_text: bool = False, hot_records: int = HOT_RECORDS) -> DataFrame:
    """Bytes, removed bytes, removed runs and digest of the rest of each document (and the rest itself)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.xxhash64("doc_id"), F.lit(0))).withColumn("th", F.hash("text", "doc_id"))
    found = rows.select("key", "th", "text").mapInArrow(_anchor_rows, "gram long, key long, th int, pos long")
    twice = materialize(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "twice")
    chosen = found.join(twice, "gram", "left_semi").groupBy("key", "th").agg(F.collect_set(F.struct("gram", "pos")).alias("found"))
    records = materialize(
        rows.select("key", "th", "text").join(chosen.hint("shuffle_hash"), ["key", "th"]).mapInArrow(_record_rows, "gram long, digest long, key long, th int, low long, lead long, first int, content binary, n long"),
        "records",
    )
    discard(twice)
    contents = records.where("content is not null").select("gram", "digest", "lead", "first", "content", "n")
    hot = contents.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > hot_records).select("gram")
    hot = materialize(hot, "hot")
    cool, masks = contents, None
    if hot.take(1):
        cool = contents.join(hot, "gram", "left_anti")
        masks = _digest_masks(contents.join(hot, "gram", "left_semi"))
    sorted_ = cool.repartitionByRange(partitions(spark), "lead").sortWithinPartitions("gram").mapInArrow(_masks, "gram long, digest long, mask binary")
    masks = sorted_ if masks is None else sorted_.unionByName(masks)
    spans = (
        records.where("content is null").select("gram", "digest", "key", "th", "low").distinct()
        .join(masks, ["gram", "digest"]).groupBy("key", "th").agg(F.collect_list(F.struct("low", "mask")).alias("found"))
    )
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.join(spans.hint("shuffle_hash"), ["key", "th"], "left").select("doc_id", "text", "found").mapInArrow(lambda it: _cut(it, with_text), schema)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query over every document."""
    return remove_repeats(table(spark, sf_dir, "documents"))
