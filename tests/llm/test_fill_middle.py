"""Operator 11 against cuts made line by line, and its round trip."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.llm import fill_middle
from leafgrid.llm.common import utf8

import pyarrow as pa


def brute(doc_id, text, rate=100, suffix_first=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h4 % 100 < suffix_first:
        return len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows():
    rng = random.Random(5)
    texts = [None, "", "\n", "\n\n\n", "x", "x\n", "\nx", "a\r\nb c\x85d\n", "é🙂\nß\n\n🙂", "has <P> in it\nand more", "<S><M>", "<\nP>\n<S\n", "\u0000\n\u0000", "w " * 20_000, "line é\n" * 5_000]
    texts += ["".join(rng.choice("ab é🙂\n\n<") for _ in range(rng.randrange(400))) for _ in range(150)]
    return [(k if k % 11 else None, t) for k, t in enumerate(texts)] + [(3, "\n\n\n"), (3, "another text\nof the same id")]


@pytest.mark.parametrize("rate,suffix_first", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_cuts_match_line_by_line(spark, rate, suffix_first):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3).withColumns({"form": F.lit("extra"), "output": F.lit(1), "h1": F.lit(2), "n": F.lit(3)})
    made = fill_middle.fill_in_middle(docs, rate, suffix_first).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = sorted(map(tuple, made.collect()), key=str)
    want = sorted(((i, *brute(i, t, rate, suffix_first), t or "") for i, t in rows()), key=str)
    assert got == want


def test_nothing_and_other_ids(spark):
    docs = spark.createDataFrame([("seven", "a\nb")], "doc_id string, text string")
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    assert [tuple(r) for r in fill_middle.fill_in_middle(docs).collect()] == [("seven", *brute("seven", "a\nb"))]


def test_skip_lists_reach_every_rank():
    rng = random.Random(1)
    texts = ["".join(rng.choice("é\nx") for _ in range(n)) for n in (0, 1, 2, 3, 50, 3000)]
    lists = fill_middle.SkipLists(*utf8(pa.array(texts)))
    assert len(lists.lanes) > 4 and len(lists.lanes[1][0]) < 0.5 * len(lists.lanes[0][0])
    for share in np.linspace(0, 1, 13):
        ranks = (lists.lines * share).astype(np.int64)
        want = [sum(map(len, re.findall(r"[^\n]*\n|[^\n]+", t)[:r])) for t, r in zip(texts, ranks, strict=True)]
        assert lists.code_points(ranks).tolist() == want
