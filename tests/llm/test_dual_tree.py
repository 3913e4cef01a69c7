"""Operator 13 against all products worked out, and what the trees leave out."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.llm import dual_tree
from leafgrid.llm.common import table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(items, docs, top):
    """Rows (item_id, rank, score), with ids where a score decides alone which document it is."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, bag in bags:
            m = 100 - 25 + (25 * bag.total() * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def rows():
    rng = random.Random(2)
    vocabulary = ["t%d" % int(rng.paretovariate(0.5)) for _ in range(500)] + ["É", "ß7", "日本", "x_y", "a-b", "Öl"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary).swapcase() if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(n))
    docs = [(k, text(rng.randrange(60))) for k in range(400)]
    docs += [(1000 - k, docs[7][1]) for k in range(60)]  # ties
    docs += [(7, docs[7][1]), (2000, None), (2001, ""), (2002, " .,;\t{}"), (2003, "t1 " * 20_000), (None, docs[7][1]), (None, "É"), (2004, "z" * 5000)]
    items = [(k, text(rng.randrange(1, 25))) for k in range(40)] + [(3, "t1 T1 t1"), (50, docs[7][1]), (51, None), (52, "..."), (53, "never seen anywhere"), (None, "É ß7"), (54, " ".join(vocabulary))]
    return items, docs


@pytest.mark.parametrize("block_terms,pilot,top", [(1 << 19, 32, 20), (60, 3, 5)])
def test_ranks_match_all_products(spark, monkeypatch, block_terms, pilot, top):
    monkeypatch.setattr(dual_tree, "GROVE", 100)
    items, docs = rows()
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"terms": F.lit(1), "rank": F.lit(2)})
    held = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({"score": F.lit("extra"), "n": F.lit(3), "lead": F.lit(4)})
    got = sorted(map(tuple, dual_tree.rank(asked, held, top, block_terms, pilot).collect()), key=str)
    assert got == brute(items, docs, top)


def test_nothing_and_other_ids(spark):
    asked = spark.createDataFrame([("q", "one two")], "item_id string, text string")
    held = spark.createDataFrame([("b", "one two"), ("a", "One, two!"), ("c", "three")], "doc_id string, text string")
    assert [tuple(r) for r in dual_tree.rank(asked, held).orderBy("rank").collect()] == brute([("q", "one two")], [("b", "one two"), ("a", "One, two!"), ("c", "three")], 20)
    assert dual_tree.rank(asked.limit(0), held).count() == dual_tree.rank(asked, held.limit(0)).count() == 0
    assert dual_tree.rank(asked, held).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_prune_whole_batches():
    """Two kinds of documents and items: far fewer scores are worked out than there are pairs, and none that counts is missed."""
    rng = np.random.default_rng(3)

    def vectors(n, size, high):
        own = [np.sort(rng.choice(np.arange(kind * 300, kind * 300 + 300), size, replace=False)) for kind in np.repeat([0, 1, 2, 3], n // 4)]
        return np.arange(0, n * size + 1, size), np.concatenate(own), rng.integers(1, high, n * size)

    ends, term, impact = vectors(800, 30, 1000)
    items = dual_tree.Items(*vectors(64, 12, 50))
    best = dual_tree.Best(np.zeros(len(items), np.int64), 5)
    scored = dual_tree.search(items, list(range(800)), ends, term, impact, best)
    assert 0 < scored < 0.3 * 800 * 64
    dense = np.zeros((800, 1200), np.int64)
    dense[np.repeat(np.arange(800), 30), term] = impact
    for k in range(len(items)):
        own, weight = items.of(k)
        score = dense[:, own] @ weight
        want = sorted((-int(s), False, d) for d, s in enumerate(score) if s > 0)[:5]
        assert best.found[k] == want


def test_every_node_bounds_what_is_below(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    asked = table(spark, "/root/testdata/sf0.001", "benchmark")
    got = sorted(map(tuple, dual_tree.rank(asked, docs, 7).collect()), key=str)
    assert got == brute([tuple(r) for r in asked.select("item_id", "text").collect()], [tuple(r) for r in docs.select("doc_id", "text").collect()], 7)
