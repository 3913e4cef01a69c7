"""Operator 12 against every window compared with every other."""

import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from leafgrid.llm import de_bruijn
from leafgrid.llm.common import utf8

SIZE = de_bruijn.WINDOW
DOCS = "doc_id long, text string"


def brute(rows):
    """Coordinates are (id, place); the rows' ids are distinct but for equal texts."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: (i is not None, i or 0)
    for i, words in sorted(split, key=lambda r: order(r[0])):
        for k in range(len(words) - SIZE + 1):
            first.setdefault(tuple(words[k : k + SIZE]), (i, k))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - SIZE + 1):
            if first[tuple(words[k : k + SIZE])] != (i, k):
                gone.update(range(k, k + SIZE))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest(), 0, kept.decode()))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, DOCS).repartition(parts).withColumns({"th": F.lit("extra"), "spans": F.lit(1), "place": F.lit(2), "n": F.lit(3)})
    return sorted((tuple(r) for r in de_bruijn.remove_repeats(docs).collect()), key=str)


def sentence(rng, n, size=400):
    return ["w%d" % rng.randrange(size) for _ in range(n)]


def test_spans_match_window_by_window(spark):
    rng = random.Random(3)
    passages = [sentence(rng, n) for n in (19, 20, 21, 33, 60, 200)]
    rows = []
    for i in range(140):
        words = sentence(rng, rng.randrange(60))
        for _ in range(rng.randrange(3)):
            passage = list(rng.choice(passages))
            if rng.random() < 0.4:
                passage[rng.randrange(len(passage))] = "changed%d" % rng.randrange(3)
            words += passage[rng.randrange(5) :] + sentence(rng, rng.randrange(8))
        rows.append((1000 - i, " ".join(words)))
    rows += [(k, rng.choice(["\t", "\n ", "  "]).join(passages[5])) for k in range(2000, 2040)]  # many copies
    rows += [(3000 + k, " ".join(["a"] * n)) for k, n in enumerate((19, 20, 21, 70))]  # every window alike
    rows += [(3100 + k, " ".join(["x", "y", "z"] * 25)[k:]) for k in range(4)]
    rows += [(4000, None), (4001, ""), (4002, " \t\n"), (4003, "É 🙂 " * 25), (4004, "b" * 5000), (None, " ".join(passages[3])), (-5, " ".join(passages[3]))]
    assert run(spark, rows) == brute(rows)


def test_long_texts_and_equal_rows(spark):
    rng = random.Random(4)
    long = sentence(rng, 20_000, 5_000)
    rows = [(1, " ".join(long)), (2, " ".join(long[5_000:15_000])), (3, " ".join(["new", *long[:10_000], "gap", *long[10_000:]])), (7, "once more " * 20), (7, "once more " * 20)]
    assert run(spark, rows) == brute(rows)
    both = [(5, " ".join(long[:30])), (5, " ".join(long[:30]) + " more")]  # one id, two texts: one of them keeps its words
    assert sorted(r[2] for r in run(spark, both)) in ([0, 30], [0, 31])


def test_nothing_and_other_ids(spark):
    text = " ".join(sentence(random.Random(1), 25))
    docs = spark.createDataFrame([("b", text), ("a", text), (None, "x")], "doc_id string, text string")
    assert de_bruijn.remove_repeats(docs.limit(0)).count() == 0
    assert sorted((r["doc_id"] or "", r["n_removed"]) for r in de_bruijn.remove_repeats(docs).collect()) == [("", 0), ("a", 0), ("b", 25)]


def test_clashing_hashes_remove_nothing_else():
    """With spans whose words differ from their source nothing goes, and they are counted."""
    rng = random.Random(6)
    texts = pa.array([" ".join(sentence(rng, 25)), " ".join(sentence(rng, 25))])
    ids, spans = pa.array([1, 2]), pa.array([[], [{"place": 2, "windows": 3, "source_digest": b"another"}]], pa.list_(pa.struct([("place", pa.int64()), ("windows", pa.int64()), ("source_digest", pa.binary())])))
    batch = pa.RecordBatch.from_arrays([ids, texts, spans], names=["doc_id", "text", "spans"])
    (out,) = de_bruijn._removed(iter([batch]))
    assert out.column("n_removed").to_pylist() == [0, 0] and out.column("n_unverified").to_pylist() == [0, 1]


def test_paths_are_compact(spark):
    """A passage of 500 words in many texts becomes one path, and copies of whole texts one each."""
    rng = random.Random(8)
    passage = sentence(rng, 500, 10**9)
    rows = [(i, " ".join(sentence(rng, 30, 10**9) + passage + sentence(rng, 30, 10**9))) for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("th", F.hash("text").cast("long").bitwiseAND(F.lit(2**32 - 1)))
    _, classes = de_bruijn.classes_of(docs)
    heads = de_bruijn.paths_of(classes).collect()
    assert len(heads) == 1 and 450 < heads[0]["windows"] <= 481 and classes.where("n = 30").count() > 30


def test_equal_windows_share_an_anchor():
    rng = random.Random(9)
    common = sentence(rng, 24)
    found = de_bruijn.Bundles(*utf8(pa.array([" ".join(sentence(rng, 40) + common), None, " ".join(common + sentence(rng, 40))])))
    ends = [(found.row == k) for k in (0, 2)]
    assert found.count.sum() == 2 * 45 and len(set(found.anchor[ends[0]]) & set(found.anchor[ends[1]])) >= 1
    assert (found.count <= SIZE - de_bruijn.ANCHOR + 1).all()
