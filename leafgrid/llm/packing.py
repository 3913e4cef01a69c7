"""Best-two-fit packing of tokenised documents into sequences of at most ``CAPACITY`` tokens.

How pieces fit depends on their lengths alone, so the packing is solved once on the histogram of lengths (at
most ``CAPACITY`` numbers, whatever the size of the input): fill a bin greedily with the longest pieces that
fit, then replace its smallest piece with two unpacked ones that fill the expanded gap more tightly, and repeat
the bin as often as the histogram allows. The solution is a list of patterns; each piece finds its place from
its length and its rank among pieces of that length, which Spark counts in buckets.

Tokens come from the given tokenizer file. A text in plain Latin letters is cut into words by the tokenizer's own
split rule, its model encodes each word, and the ids are kept in a bounded cache; any other text goes to the
tokenizer whole.

Defined results: a null or empty text is one piece of the closing id alone. Every row gets its pieces, repeated
rows and null ids included. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, column, discard, materialize, partitions, releasing, table

CAPACITY = 2048
CLOSING_ID = 0
#: Words whose ids a worker keeps.
CACHED_WORDS = 200_000

# The split rule of the tokenizer within plain Latin text, and what is outside of such text.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ſ0-9²³¹¼-¾]+")
NOT_PLAIN = re.compile(r"[^\t-\r\x20-\x7e¡-įı-ſ]|<\|")


class WordIds(dict):
    """Ids of words and of chunks between white space, filled on demand through the tokenizer's own model."""

    def __init__(self, model, letters: dict[int, str]):
        self.model, self.letters = model, letters

    def __missing__(self, chunk: str) -> bytes:
        words = WORDS.findall(chunk)
        if len(words) == 1:
            raw = chunk if chunk.isascii() else chunk.encode().decode("latin1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(raw)], "<u4").tobytes()
        else:
            ids = b"".join([self[w] for w in words])
        self[chunk] = ids
        return ids


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = WordIds(self.tokenizer.model, byte_letters())

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        ids = self.cache.__getitem__
        return [self.whole(t) if NOT_PLAIN.search(t) else b"".join(map(ids, t.lower().split())) for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@releasing
def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    coder, closing, wide = encoder(path), np.array([CLOSING_ID], "<u4").tobytes(), 4 * capacity
    for batch in batches:
        for block in blocks(batch, "text"):
            owner, piece, length, crc = [], [], [], []
            for k, ids in enumerate(coder.encode([t or "" for t in column(block, "text").to_pylist()])):
                ids += closing
                for n, at in enumerate(range(0, len(ids), wide)):
                    part = ids[at : at + wide]
                    owner.append(k)
                    piece.append(n)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            number = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays(
                [column(block, "doc_id").take(pa.array(owner)), pa.array(number), pa.array(number.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
    _ENCODERS.clear()  # the worker lives on and serves other stages


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise whole texts and cut only those longer than ``capacity``."""
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(lambda it: _pieces(it, path, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_pair(free: list[int], left: dict[int, int], room: int, above: int) -> tuple[int, int] | None:
    """Two free lengths with the largest sum over ``above`` and at most ``room``."""
    best, pair = above, None
    low, high = 0, bisect_right(free, room) - 1
    while low <= high:
        x, y = free[low], free[high]
        if x + y > room or (low == high and left[x] < 2):
            high -= 1
        else:
            if x + y > best:
                best, pair = x + y, (y, x)
                if best == room:
                    break
            low += 1
    return pair


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, longest first, with how often each is used."""
    left = {n: c for n, c in histogram.items() if c > 0}
    free = sorted(left)
    patterns = []
    while free:
        pattern, room = [free[-1]], capacity - free[-1]
        used = {free[-1]: 1}
        at = bisect_right(free, room) - 1
        while at >= 0:  # greedily, the longest that fits
            n = free[at]
            take = min(left[n] - used.get(n, 0), room // n)
            if take > 0:
                pattern += [n] * take
                used[n] = used.get(n, 0) + take
                room -= n * take
            at = min(at - 1, bisect_right(free, room) - 1)
        if room:
            small = pattern[-1]
            spare = {n: left[n] - used.get(n, 0) for n in free}
            pair = best_pair([n for n in free if spare[n] > 0], spare, room + small, small)
            if pair:
                pattern[-1:] = pair
                used[small] -= 1
                for n in pair:
                    used[n] = used.get(n, 0) + 1
                pattern.sort(reverse=True)
        times = min(left[n] // u for n, u in used.items() if u)
        patterns.append((tuple(pattern), times))
        for n, u in used.items():
            left[n] -= u * times
            if u and not left[n]:
                del left[n]
        free = [n for n in free if n in left]
    return patterns


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """For each length of each pattern: length, first rank, number in a bin, first sequence, offset; sorted."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        offset, k = 0, 0
        while k < len(pattern):
            n = pattern[k]
            u = pattern.count(n)
            rows.append((n, taken.get(n, 0), u, sequence, offset))
            taken[n] = taken.get(n, 0) + u * times
            offset += n * u
            k += u
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _places(batches: Iterator[pa.RecordBatch], plan: np.ndarray) -> Iterator[pa.RecordBatch]:
    key = (plan[:, 0] << 44) + plan[:, 1]
    for batch in batches:
        length, rank = (column(batch, c).to_numpy().astype(np.int64) for c in ("length", "rank"))
        slot = plan[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
        q = rank - slot[:, 1]
        keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(slot[:, 3] + q // slot[:, 2]), pa.array(slot[:, 4] + q % slot[:, 2] * length)], names=[*keep, "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = spark.sparkContext.broadcast(slots(solve(histogram, capacity)))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(4 * partitions(spark))))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("bucket", "length").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    local = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("row")) - 1
    ranked = dealt.withColumn("local", local).join(bases, ["bucket", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    kind = dict(cut.dtypes)["doc_id"]
    return ranked.mapInArrow(lambda it: _places(it, plan.value), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query over every document."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
