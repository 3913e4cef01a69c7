"""Fill-in-middle: texts cut at two of their line boundaries and rearranged, so that a model learns to fill gaps.

The boundaries of a text stand in an indexable skip list. Its lowest lane holds every boundary, each lane above a
quarter of the one below, chosen by a hash of the rank, and every link carries how many lines (unit width) and how
many code points it skips. A cut at rank r descends from the head: it follows a link while the accumulated lines stay
at or below r, then goes down a lane; it arrives at r exactly, and the accumulated code points say where to cut. The
lists of a block of texts share their arrays and all cuts of the block descend together, in expected steps that grow
with the logarithm of the longest list.

Ranks and form are drawn from a hash of the id, so a retried task or another partitioning repeats them.

Defined results: a null text is empty, and an empty text or one that holds a marker stays plain. A null id draws as
an empty string does. Rows that repeat an id draw alike and are each cut by their own text. Ids may have any type that
has a text form. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, column, releasing, table, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Per cent of texts to rearrange, and of those the per cent with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
NO_LINK = np.int64(1) << 62
LINE_FEED = 10


def promoted(rank: np.ndarray, lane: int) -> np.ndarray:
    """Whether a boundary reaches a lane: a quarter of those on the lane below, and the head always."""
    h = rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (rank == 0) | (h >> np.uint64(64 - 2 * lane) == 0) if lane else np.ones(len(rank), bool)


class SkipLists:
    """Indexable skip lists over the line boundaries of several texts, given as UTF-8 bytes with row offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        rows = len(offsets) - 1
        size = np.diff(offsets)
        feeds = np.flatnonzero(data == LINE_FEED) + 1
        ends = np.union1d(feeds, offsets[1:][size > 0])  # a text that ends in a line feed has no line after it
        row = np.searchsorted(offsets, ends, side="left") - 1
        self.lines = np.bincount(row, minlength=rows)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        head = np.cumsum(self.lines + 1) - (self.lines + 1)
        at = np.zeros(rows + len(ends), np.int64)  # code points before each boundary; heads stand at 0
        at[np.arange(len(ends)) + row + 1] = points[ends] - points[offsets[row]]
        rank = np.arange(len(at)) - np.repeat(head, self.lines + 1)
        self.lanes = []
        nodes = np.arange(len(at))
        down = nodes
        for lane in range(32):
            last = np.ones(len(nodes), bool)
            last[:-1] = rank[nodes[1:]] == 0
            units = np.append(np.diff(rank[nodes]), 0)
            chars = np.append(np.diff(at[nodes]), 0)
            units[last] = NO_LINK
            self.lanes.append((units, chars, down))
            up = np.flatnonzero(promoted(rank[nodes], lane + 1))
            if last.all():
                break
            nodes, down = nodes[up], up
        self.heads = np.flatnonzero(rank[nodes] == 0)

    def code_points(self, ranks: np.ndarray) -> np.ndarray:
        """Code points before the boundary of that rank, one rank for each text."""
        place, units, chars = self.heads.copy(), np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for unit_width, char_width, down in reversed(self.lanes):
            going = np.arange(len(ranks))
            while len(going):
                going = going[units[going] + unit_width[place[going]] <= ranks[going]]
                units[going] += unit_width[place[going]]
                chars[going] += char_width[place[going]]
                place[going] += 1
            place = down[place]
        assert (units == ranks).all()
        return chars


@releasing
def _rearranged(batches: Iterator[pa.RecordBatch], rate: int, suffix_first: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text"):
            lists = SkipLists(*utf8(column(block, "text")))
            texts = [t or "" for t in column(block, "text").to_pylist()]
            draws = [column(block, f"h{k}").to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1, 5)]
            cuts = [h % (lists.lines + 1) for h in draws[:2]]
            first, second = (lists.code_points(pick(*cuts)) for pick in (np.minimum, np.maximum))
            form, output = [], []
            for text, a, b, h3, h4 in zip(texts, first.tolist(), second.tolist(), draws[2].tolist(), draws[3].tolist(), strict=True):
                if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
                    form.append("plain")
                    output.append(text)
                elif h4 % 100 < suffix_first:
                    form.append("spm")
                    output.append(f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}")
                else:
                    form.append("psm")
                    output.append(f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}")
            plain = np.array([f == "plain" for f in form], bool)
            yield pa.RecordBatch.from_arrays(
                [column(block, "doc_id"), pa.array(lists.lines.astype(np.int64)), pa.array(form, pa.string()), pa.array(first, pa.int64(), mask=plain), pa.array(second - first, pa.int64(), mask=plain), pa.array(output, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """Lines, form, cuts and rearranged text of each document: doc_id, n, form, prefix_chars, middle_chars, output.

    No shuffle: a document needs nothing but itself.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", *drawn).mapInArrow(lambda it: _rearranged(it, rate, suffix_first), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No text that was rearranged holds a marker, so the markers part it exactly."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Contract query over every document."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}
    return made.withColumns(digests).drop("output")


def oracle() -> str:
    """The contract rows in DuckDB."""
    draw = ", ".join(f"CAST('0x' || substr(hex, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    plain = f"text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE}"
    join = "array_to_string({}, '')".format
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || doc_id) AS hex FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS u, {draw} FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b, CASE WHEN {plain} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, {join('u[1:a]')} AS pre, {join('u[a + 1:b]')} AS mid, {join('u[b + 1:]')} AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END AS output FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o"""
