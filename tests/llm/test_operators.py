"""Each text operator against brute force, an exact round trip or held-out accuracy, with awkward rows."""

import bisect
import gzip
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafgrid.llm import decontamination, jaccard_join, language_id, markov_lm, packing, queries, secret_scan, suffix_dedup, toxicity, warc, weighted_fingerprint
from leafgrid.llm.common import remainder, setting, table

DATA = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"  # the smallest tables hold no secrets
MOST = "/root/testdata/sf0.1"  # enough labelled rows for each language
DOCS = "doc_id long, text string"
ODD = [(900, None), (901, ""), (902, " \t\n "), (903, "x"), (None, "no id at all here"), (904, "É 🙂 İ ﬁ"), (905, "a" * 5000), (3, "the id again")]


def docs_of(spark, rows, parts=3):
    """Documents with extra columns whose names clash with those of results."""
    df = spark.createDataFrame(rows, DOCS).repartition(parts)
    return df.withColumns({"score": F.lit("extra"), "key": F.lit(1), "gid": F.lit(2), "length": F.lit(3)})


def words(rng, n, size=300):
    return " ".join("w%d" % rng.randrange(size) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    return table(spark, DATA, "documents")


# ---- op1 ----


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/é", "<html><head><title>T &amp; é</title></head><p>One<b>two</b></p><script>no</script><a href=\"/x\">z</a>"), (2, None, None), (2, None, None), (3, "http://b", "WARC text\nline")], "page_id long, url string, html string")
    made = warc.responses(pages)
    warc.write_warc(warc.serialised_responses(made), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert back.where("not whole").count() == 0
    names = ["record_id", "target_uri", "date", "http_header", "payload", "payload_digest"]
    assert sorted((*r[:4], bytes(r["payload"]).decode(), r[5]) for r in back.select(names).collect()) == sorted(map(tuple, made.select(names).collect()))
    strip = lambda df: sorted(map(tuple, df.drop("page_id").collect()))
    assert strip(warc.derivatives(back)) == strip(warc.derivatives(made))
    derived = {(r["page_id"], r["record_type"]): r for r in warc.derivatives(made).collect()}
    assert derived[1, "conversion"]["block"] == "Onetwo\nz"
    assert derived[1, "metadata"]["block"] == "title: T & é\r\noutlinks: 1\r\noutlink: /x"
    assert derived[1, "metadata"]["refers_to"] == derived[1, "conversion"]["refers_to"]
    assert derived[1, "metadata"]["concurrent_to"] == derived[1, "conversion"]["record_id"]
    assert derived[2, "conversion"]["block"] == "" and len(derived) == 6
    assert warc.serialised(warc.derivatives(made)).count() == 8
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_marks_short_records(spark, tmp_path):
    (tmp_path / "bad.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nHTTP/1.1 200 OK\r\n\r\nshort\r\n\r\n")
    back = warc.read_warc(spark, str(tmp_path))
    assert [r["whole"] for r in back.collect()] == [False] and warc.derivatives(back).count() == 0


def test_warc_payloads_hold_anything(spark, tmp_path):
    """Version lines within payloads, bytes that are not UTF-8, version 1.1, records after a broken one."""
    payloads = [b"see\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n inside", b"caf\xe9 <b>x</b>", b"", b"w " * 200_000]

    def record(version, payload, size=None):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        return b"WARC/%s\r\nWARC-Type: response\r\nWARC-Record-ID: <r%d>\r\nContent-Length: %d\r\n\r\n" % (version, len(payload), size or len(block)) + block + b"\r\n\r\n"

    (tmp_path / "a.warc").write_bytes(record(b"1.0", payloads[0]) + record(b"1.0", b"lost", 9_999_999) + b"".join(record(b"1.1", p) for p in payloads[1:]))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert [bytes(r["payload"]) for r in rows if r["whole"]] == payloads and sum(not r["whole"] for r in rows) == 1
    made = warc.derivatives(warc.read_warc(spark, str(tmp_path))).where("record_type = 'conversion'").collect()
    assert {r["refers_to"]: r["block"] for r in made}["<r13>"] == "caf\ufffd x" and len(made) == 4


def warc_record(number, payload, kind=b"response", version=b"1.0"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    return b"WARC/%s\r\nWARC-Type: %s\r\nWARC-Record-ID: <r%d>\r\nContent-Length: %d\r\n\r\n" % (version, kind, number, len(block)) + block + b"\r\n\r\n"


def test_warc_files_as_crawls_ship_them(spark, tmp_path):
    """Compressed member by member, requests among responses; files that give nothing are named."""
    records = [warc_record(k, b"page %d " % k * 50, b"request" if k % 3 == 1 else b"response") for k in range(9)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "d.warc").write_bytes(b"nothing of the kind")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    by = {n: sorted((r["record_id"], bytes(r["payload"])) for r in rows if r["file"].endswith(n)) for n in ("a.warc", "b.warc.gz", "c.warc.gz")}
    assert by["a.warc"] == by["b.warc.gz"] == by["c.warc.gz"] and len(by["a.warc"]) == 6 and all(r["whole"] for r in rows)
    silent = warc.silent_files(spark, str(tmp_path), warc.read_warc(spark, str(tmp_path))).collect()
    assert [r["file"].rsplit("/", 1)[-1] for r in silent] == ["d.warc"]


@pytest.mark.parametrize("split", [200, 1000, 1 << 20])
def test_warc_files_in_pieces(spark, tmp_path, split):
    """Splits anywhere, and payloads that hold whole records, which look like a start wherever a split begins."""
    rng = random.Random(split)
    inner = b"".join(warc_record(100 + k, b"inner" * 20) for k in range(5))
    payloads = [rng.choice([b"x" * rng.randrange(900), inner, b"", b"\r\n\r\n" * 5]) for _ in range(25)]
    (tmp_path / "a.warc").write_bytes(b"".join(warc_record(k, p) for k, p in enumerate(payloads)))
    with setting(spark, "spark.sql.files.maxPartitionBytes", str(split)), setting(spark, "spark.sql.files.openCostInBytes", "1"):
        rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert {r["record_id"]: bytes(r["payload"]) for r in rows} == {f"<r{k}>": p for k, p in enumerate(payloads)} and len(rows) == 25


def test_warc_written_records_end_strictly(spark, tmp_path):
    made = warc.responses(spark.createDataFrame([(k, f"http://a/{k}", "<p>é</p>") for k in range(20)], "page_id long, url string, html string"))
    warc.write_warc(warc.serialised_responses(made).coalesce(1), str(tmp_path / "w"), "gzip")
    data = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("*.gz"))
    at = 0
    for _ in range(20):
        head = data.index(b"\r\n\r\n", at) + 4
        size = int(re.search(rb"Content-Length: (\d+)", data[at:head])[1])
        assert data[at:].startswith(b"WARC/1.0\r\n") and data[head + size : head + size + 4] == b"\r\n\r\n"
        at = head + size + 4
    assert at == len(data) and warc.read_warc(spark, str(tmp_path / "w")).where("whole").count() == 20


def test_outlinks_and_character_references(spark):
    html = """<a class="k" href="/one">1</a><A HREF="/two">2</A><a href='/three?a=1&amp;b=2'>3</a><a\nhref = /four id=x>4</a><a data-href="/no">5</a><abbr href="/no">6</abbr><a name=q>7</a>
    <p>caf&eacute; &#233;&#xE9;&#128512; &nope; &#0; &#xD800; &#x110000; &amp;lt; a&nbsp;b &copy; &Alpha;</p>"""
    page = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    made = {r["record_type"]: r["block"] for r in warc.derivatives(warc.responses(page)).collect()}
    assert made["metadata"].split("\r\n")[1:] == ["outlinks: 4", "outlink: /one", "outlink: /two", "outlink: /three?a=1&b=2", "outlink: /four"]
    assert made["conversion"].split("\n")[-1] == "café éé😀 &nope; \ufffd \ufffd \ufffd &lt; a b © Α"


def test_warc_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>x</p>")], "page_id long, url string, html string")
    made = warc.responses(pages).withColumns({"block": F.lit("mine"), "record_type": F.lit("mine"), "refers_to": F.lit(1), "content_type": F.lit(2)})
    assert sorted(map(tuple, warc.derivatives(made).collect())) == sorted(map(tuple, warc.derivatives(warc.responses(pages)).collect()))


# ---- op2 ----


def brute_repeats(rows):
    counts = Counter()
    for _, t in rows:
        b = (t or "").encode()
        counts.update(b[i : i + 200] for i in range(len(b) - 199))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if counts[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [100_000, 3])
def test_suffix_dedup_matches_brute_force(spark, hot):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh éß") for _ in range(n))
    parts, rows = [text(rng.randint(150, 500)) for _ in range(5)], []
    for i in range(60):
        pieces = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(parts)
            if rng.random() < 0.5:
                p = p[rng.randint(0, len(p) // 2) :]
            if rng.random() < 0.3:
                k = rng.randint(0, len(p) - 1)
                p = p[:k] + "Z" + p[k + 1 :]
            pieces += [text(rng.randint(0, 80)), p]
        rows.append((i, "".join(pieces)))
    rows += [*ODD, (None, parts[0] + "x" * 50), (200, "ab" * 300), (5, rows[5][1]), (5, "other " + parts[1]), (204, "a" * 199), (205, "q" * 200), (206, "q" * 201)]
    got = suffix_dedup.remove_repeats(docs_of(spark, rows), with_text=True, hot_records=hot).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute_repeats(rows)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.remove_repeats(docs_of(spark, ODD).limit(0)).count() == 0


def test_multikey_sort_orders_and_measures():
    rng = np.random.default_rng(2)
    group, chars = rng.integers(0, 4, 200), rng.integers(0, 2, (200, 24)).astype(np.uint8)
    order, common = suffix_dedup.multikey_sort(group, chars)
    rows = [(int(group[k]), bytes(chars[k])) for k in order]
    assert rows == sorted(rows)
    for k in range(1, 200):
        a, b = rows[k - 1], rows[k]
        want = -1 if a[0] != b[0] else next((i for i in range(24) if a[1][i] != b[1][i]), 24)
        assert common[k] == want


# ---- op3 ----


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rng = random.Random(1)
    rows = [(i, words(rng, rng.choice([0, 3, 40, 300]))) for i in range(60)] + [(700, words(rng, 3000)), (701, words(rng, 3000)), (1, "again"), *ODD]
    got = packing.pack(docs_of(spark, rows), path).collect()
    for r in got:
        assert 1 <= r["length"] <= 2048 and r["start"] == 2048 * r["piece"]
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    want = Counter()
    for d, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for n, k in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[k : k + 2048], "<u4")
            want[d, n, len(part), zlib.crc32(part.tobytes())] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got)
    free, bins = [], 0
    for n in sorted((r["length"] for r in got), reverse=True):  # best fit, the longest first
        k = bisect.bisect_left(free, n)
        room = free.pop(k) if k < len(free) else 2048
        bins += room == 2048
        bisect.insort(free, room - n) if room > n else None
    assert len(by_sequence) <= bins
    assert packing.pack(docs_of(spark, rows).limit(0), path).count() == 0
    coder = packing.Encoder(path)  # real texts of all languages, and every row of the smallest table
    texts = [r["text"] for r in table(spark, DATA, "documents").where("text is not null").collect()]
    assert coder.encode(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("seed", range(5))
def test_solver_places_each_length_once(seed):
    rng = random.Random(seed)
    histogram = Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 30)]) for _ in range(400))
    patterns = packing.solve(dict(histogram), 100)
    used = Counter()
    for pattern, times in patterns:
        assert sum(pattern) <= 100 and times > 0
        for n in pattern:
            used[n] += times
    assert used == histogram


def test_pair_search_is_best():
    rng = random.Random(4)
    for _ in range(200):
        free = sorted(rng.sample(range(1, 60), rng.randint(1, 12)))
        left = {n: rng.randint(1, 2) for n in free}
        room, above = rng.randint(2, 80), rng.randint(0, 40)
        sums = [x + y for i, x in enumerate(free) for j, y in enumerate(free) if (i < j or (i == j and left[x] > 1)) and above < x + y <= room]
        pair = packing.best_pair(free, left, room, above)
        assert (sum(pair) if pair else None) == max(sums, default=None)


# ---- op4 ----


def test_decontamination(spark):
    item = "In a garden Tom counted 14 apples and 3 baskets near the old river before walking 14 km home again"
    again = "In a garden Ann counted 27 apples and 5 baskets near the old river before walking 27 km home again"
    broken = "In a garden Ann counted 27 apples and 5 baskets near the old river before walking 28 km home again"
    rng = random.Random(2)
    rows = [(1, "noise first. " + item + " more noise."), (2, again), (3, broken), (4, words(rng, 200)), (5, "In a garden Tom counted"), (6, item.upper()), *ODD]
    bench = spark.createDataFrame([(10, item), (11, None), (12, "too short"), (13, "")], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontamination.matches(docs_of(spark, rows), bench).collect()}
    assert found[1]["n_replaced"] == 0 and found[2]["n_replaced"] > 0 and found[2]["item_id"] == 10
    assert 3 not in found and 4 not in found and 5 not in found
    kept = decontamination.decontaminate(docs_of(spark, rows), bench)
    assert kept.columns == docs_of(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - set(found)
    unnamed = decontamination.decontaminate(docs_of(spark, [(None, item), (None, "clean without id"), (None, None), (7, item), (7, "clean with it")]), bench)
    assert sorted(r["text"] or "" for r in unnamed.collect()) == ["", "clean with it", "clean without id"]
    assert decontamination.matches(docs_of(spark, rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [50_000, 0])
def test_decontamination_finds_short_and_numeric_items(spark, monkeypatch, limit):
    """A verbatim copy matches however few words or literals its item has; other numbers do not."""
    monkeypatch.setattr(decontamination, "LITERAL_LIMIT", limit)
    items = [(1, "what is 17 times 23"), (2, "add 3 and 4 and 5 6 7 8 9"), (3, "1 2 3 4 5 6 7 8 9 10 11 12"), (4, "sum of the numbers 4 5 6 7 8"), (5, "why")]
    rows = [(10 + k, f"some words before it, {t} and some words after it") for k, t in items] + [(20, "what is 18 times 23 here"), (21, "9 9 9 9 9 9 9 9 9 9 9 9"), (22, "What is\n17 TIMES 23"), (23, "sum of the numbers 1 2 3 9 9"), (24, " Why?\n")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(docs_of(spark, rows + ODD), bench).collect()}
    assert found == {(11, 1), (12, 2), (13, 3), (14, 4), (22, 1), (23, 4), (24, 5)}  # "why" is too short to tell anything inside a text


@pytest.mark.parametrize("limit", [50_000, 0])
def test_short_answers_leave_clean_documents_alone(spark, monkeypatch, limit):
    """Items of one to three words match texts that are nothing else; a benchmark listed twice changes nothing."""
    monkeypatch.setattr(decontamination, "LITERAL_LIMIT", limit)
    bench = spark.createDataFrame([(1, "the"), (2, "Yes."), (3, "17"), (4, "a b c"), (5, "the capital of France")] * 2, "item_id long, text string")
    docs = table(spark, MORE, "documents").where("lang = 'en'").select("doc_id", "text")
    assert decontamination.decontaminate(docs, bench).count() == docs.count()
    rows = [(1, "Oh yes, we went home."), (2, "yes"), (3, "There were 17 of them."), (4, "THE"), (5, "Say a b c again"), (6, "It is the capital of France, they say")]
    assert {r["doc_id"] for r in decontamination.decontaminate(docs_of(spark, rows), bench).collect()} == {1, 3, 5}
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_decontamination_catches_each_kind_of_new_parameters(spark):
    """Thirty questions of each kind, asked again with other values: nine in ten are found, and other questions are not."""
    rng = random.Random(12)
    spelt = decontamination.NUMBERS[1:20]
    plot = lambda: words(rng, 9, 10**6).split()

    def question(stem, name, a, b):
        return " ".join([*stem[:3], name, *stem[3:5], "has", str(a), "apples", *stem[5:], "and", str(b), "pears", "left"])

    items, rows = [], []
    for kind in range(4):
        for k in range(30):
            stem, a, b = plot(), rng.randrange(2, 19), rng.randrange(19, 99)
            items.append((100 * kind + k, question(stem, "Tom", a, b)))
            again = [question(stem, "Tom", a + 100, b + 100), question(stem, "Ann", a, b), question(stem, "Tom", f"{a + 1},000", f"{b},500"), question(stem, "Tom", spelt[(a + 3) % 19], spelt[(b + 7) % 19])][kind]
            rows.append((100 * kind + k, words(rng, 30) + " " + again + " " + words(rng, 30)))
            rows.append((10_000 + 100 * kind + k, question(plot(), "Tom", a, b)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(docs_of(spark, rows), bench).collect()}
    assert all(d == i for d, i in found)
    for kind in range(4):
        assert sum((100 * kind + k,) * 2 in found for k in range(30)) >= 27, kind


def test_decontamination_with_clashing_values_and_other_case(spark):
    """Two item values may become one; verbatim windows count beside a clash; case and spacing do not hide names."""
    slots = "In a garden Tom counted 14 apples and 3 baskets near the old river before walking home again"
    merged = "In a garden Ann counted 6 apples and 6 baskets near the old river before walking home again"
    long = "the quick brown fox jumps over the lazy dog and runs through the deep forest until it finds 14 or 14 small houses"
    clash = long.replace("14 or 14", "15 or 16")
    names = "they say that Tom and Ann and Bob and Eve met Max and Kim near York with Joe and Sam and Dan"
    rows = [(1, merged), (3, clash), (4, names.lower()), (5, names.replace(" ", "\n")), (6, names.upper()), (7, "so " + names)]
    bench = spark.createDataFrame([(10, slots), (11, long), (12, names)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_replaced"]) for r in decontamination.matches(docs_of(spark, rows + ODD), bench).collect()}
    assert set(found) == {(1, 10), (3, 11), (4, 12), (5, 12), (6, 12), (7, 12)}
    assert found[1, 10][1] == 3 and found[3, 11] == (11, 0) and found[4, 12][1] == 0


def test_decontamination_beyond_the_literal_limit(spark, corpus, monkeypatch):
    bench = table(spark, DATA, "benchmark")
    want = sorted(map(tuple, decontamination.matches(corpus, bench).collect()))
    monkeypatch.setattr(decontamination, "LITERAL_LIMIT", 10)
    assert sorted(map(tuple, decontamination.matches(corpus, bench).collect())) == want and want


def test_decontamination_finds_whole_passages(spark, corpus):
    """Every document that holds a whole item is found; those that share no eight words with any are not."""
    split = lambda t: [w for w in re.split(r"[^\w%$€£°]+|_", t.lower()) if w]
    items = [(r["item_id"], split(r["text"])) for r in table(spark, DATA, "benchmark").collect()]
    grams = {tuple(w[k : k + 8]) for _, w in items for k in range(len(w) - 7)}
    found = {r["doc_id"] for r in decontamination.matches(corpus, table(spark, DATA, "benchmark")).collect()}
    for r in corpus.collect():
        w = split(r["text"])
        mine = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        if any(len(i) >= 8 and {tuple(i[k : k + 8]) for k in range(len(i) - 7)} <= mine for _, i in items):
            assert r["doc_id"] in found
        if not mine & grams:
            assert r["doc_id"] not in found


# ---- op5 ----


def brute_ppm(counts, order, text):
    """Code length of a text by PPM, method C with exclusion, from n-gram counts."""
    total = 0.0
    contexts = {(n - 1, g >> 8) for n, g in counts}
    for k, byte in enumerate(text):
        out, depth = set(), 0
        while depth < min(order, k) and (depth + 1, int.from_bytes(text[k - depth - 1 : k], "big")) in contexts:
            depth += 1
        while True:
            context = int.from_bytes(text[k - depth : k], "big")
            here = {g & 255: c for (n, g), c in counts.items() if n == depth + 1 and g >> 8 == context and (g & 255) not in out}
            n, q = sum(here.values()), len(here)
            if byte in here:
                total -= math.log2(here[byte] / (n + q))
                break
            if q:
                total -= math.log2(q / (n + q))
                out |= set(here)
            if depth == 0:
                total += math.log2(256 - len(out))
                break
            depth -= 1
    return total


def test_ppm_code_lengths_are_exact():
    texts = {"a": b"abracadabra abra", "b": b"banana bandana"}
    counts = {lang: dict(Counter((n, int.from_bytes(t[k : k + n], "big")) for n in (1, 2, 3) for k in range(len(t) - n + 1))) for lang, t in texts.items()}
    tree = language_id.build(counts, 2)
    for text in (b"abra", b"banzai", b"xyz", b"", b"dabanana"):
        bits = tree.bits(np.frombuffer(b"ra" + text, np.uint8), np.array([0, 2, 2 + len(text)]))[1]
        for k, lang in enumerate(("a", "b")):
            assert bits[k] == pytest.approx(brute_ppm(counts[lang], 2, text), abs=1e-3)


def test_language_id_held_out(spark, corpus):
    held = remainder(F.col("doc_id"), 4) == 2
    tree = language_id.train(corpus.where(~held), sample=200)
    got = language_id.predict(corpus, tree, held).join(corpus.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    odd = {r["doc_id"]: r for r in language_id.predict(docs_of(spark, ODD), tree, F.lit(None)).collect()}
    assert all(odd[d]["lang_pred"] == "und" and odd[d]["score"] == 0 for d in (900, 901, 902))
    signs = language_id.predict(docs_of(spark, [(1, "²½"), (2, "Ⅷ ①"), (3, "12_3"), (4, "é")]), tree, F.lit(None)).collect()
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in signs} == {1: True, 2: True, 3: True, 4: False}
    assert odd[905]["lang_pred"] in tree.languages and len(odd) == len(ODD)
    nothing = language_id.train(corpus.where("false"))
    assert {r["lang_pred"] for r in language_id.predict(corpus, nothing, F.lit(False)).collect()} == {"und"}


# ---- op6 ----


def area_under_curve(rows):
    """Share of (toxic, clean) pairs in the right order."""
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == t] for t in (1, 0))
    return np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])


def test_toxicity_held_out(spark):
    docs, labels = table(spark, MOST, "documents"), table(spark, MOST, "labels")
    grammar = toxicity.train_on(docs, labels)
    rows = toxicity.predict(docs, grammar, remainder(F.col("doc_id"), 5) == 0).where("held_out").join(labels, "doc_id").collect()
    assert {r["toxic"] for r in rows} == {0, 1} and area_under_curve(rows) > 0.9
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == t] for t in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) and len(toxic) > 50 and sum(clean) <= 0.02 * len(clean)
    odd = {r["doc_id"]: r["score"] for r in toxicity.predict(docs_of(spark, ODD), grammar, F.lit(False)).collect()}
    assert odd[900] == odd[901] and all(0 <= s < 0.5 for s in odd.values()) and len(odd) == len(ODD)
    kept = toxicity.reject(docs, grammar)
    assert kept.schema == docs.schema and kept.count() == toxicity.predict(docs, grammar, F.lit(False)).where("predicted = 0").count()
    assert toxicity.train(spark.createDataFrame([], "doc_id long, text string, toxic int")).stems == {}
    assert toxicity.predict(docs.limit(0), grammar, F.lit(False)).count() == 0 == toxicity.reject(docs.limit(0), grammar).count()
    long = [(1, "you idiot. " + "calm word " * 100_000), (2, "idiot " * 100_000), (3, "x" * 1_000_000)]
    assert len(toxicity.predict(docs_of(spark, long), grammar, F.lit(False)).collect()) == 3


def test_calibration_of_separable_rows_is_bounded():
    x = np.column_stack([np.ones(200), np.repeat([0.0, 1.0], 100)])
    beta = toxicity.fit_line(x, np.repeat([0.0, 1.0], 100))
    assert np.abs(beta).max() < 20 and (x[0] @ beta) < -2 < 2 < (x[-1] @ beta)


def clause_weight(grammar, text):
    return sum(map(grammar.weigh, grammar.clauses(text)[1]))


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({"fool": 3.0, "piece\u02b9of\u02b9garbage": 4.0}, {"fool": 2.0})
    single = clause_weight(g, "what a fool")
    assert clause_weight(g, "you are a fool") > single == 3 > clause_weight(g, "she said what a fool") > clause_weight(g, "not a fool") == 0  # below the weight of a match
    assert clause_weight(g, "not, a. fool") == 3  # a negation does not leave its clause
    assert clause_weight(g, "kill") == clause_weight(g, "kill the lights") == 0 < clause_weight(g, "i kill you") < clause_weight(g, "i will kill you")
    assert clause_weight(g, "kill them. you") > 0 == clause_weight(g, "kill. you") == clause_weight(g, "nothing here")
    assert clause_weight(g, "a Piece of Garbage") == 4 and clause_weight(g, "piece of cake, garbage") == 0
    assert clause_weight(g, "foolish") == 2 and clause_weight(g, "fool fool") > 6
    assert g.features("FOOL. fool")[0] == pytest.approx(math.log1p(6))


def test_composition_unites_marks():
    parts = toxicity.insults(), toxicity.negation(), toxicity.after(toxicity.TARGET, "targeted")
    both = toxicity.compose(*parts)
    rng = random.Random(3)
    for _ in range(50):
        s, each = 0, [0] * 3
        for tag in (rng.choice(toxicity.TAGS) for _ in range(12)):
            steps = [m.step(e, tag) for m, e in zip(parts, each, strict=True)]
            each = [e for e, _ in steps]
            assert both.marks[s, tag] == frozenset().union(*(m for _, m in steps))
            s = both.moves[s, tag]


def test_composed_grammar_decides():
    """Insults and verbs of harm stand in toxic and clean rows alike; only the clause around them tells. Without the
    composition (every hit accepted, no gains) the held-out rows cannot be told apart."""
    rng = random.Random(21)
    toxic = ["you are a {i}", "they are such {i} and {i}", "i will {h} you", "we will {h} them", "you {i}"]
    clean = ["you are not a {i}", "never a {i} was here", "i will {h} the lights", "{h} it", "he is no {i}", "he said never {h} you", "nobody wrote {i} or said {i}"]
    rows = []
    for k in range(1500):
        bad = rng.random() < 0.5
        said = rng.choice(toxic if bad else clean).format(i=rng.choice(["fool", "dunce", "oaf"]), h=rng.choice(["hurt", "kill"]))
        rows.append((k, f"{words(rng, 8)}. {said}. {words(rng, 8)}", int(bad)))
    lexicon = {"fool": 3.0, "dunce": 3.0, "oaf": 3.0}
    grammar = toxicity.Grammar(lexicon, {})
    arcs = np.array([grammar.arc_weights(t) for k, t, _ in rows if k % 2 == 0])
    gains = toxicity.learn_gains(arcs[:, :-1], grammar.marked, arcs[:, -1], np.array([float(y) for k, _, y in rows if k % 2 == 0]))
    learned = toxicity.Grammar(lexicon, {}, gains=gains)
    marks = dict(zip(toxicity.MARKS, gains - toxicity.PRIOR, strict=True))
    assert marks["negated"] < -0.3 and marks["targeted"] > 0.1  # learned from the labels, away from the prior
    flat = toxicity.Grammar(lexicon, {}, machine=toxicity.compose(toxicity.Transducer({}, {(0, t): frozenset({"accepted"}) for t in (toxicity.INSULT, toxicity.HARM)})), gains=np.zeros(6), accepted=0.0)
    by = lambda g: area_under_curve([{"score": clause_weight(g, t), "toxic": y} for k, t, y in rows if k % 2])
    assert by(learned) > 0.9 > 0.7 > by(flat)


# ---- op7 ----


@pytest.fixture(scope="module")
def model(spark):
    return secret_scan.train(table(spark, MORE, "documents"))


def test_secret_spans(spark, model):
    key = "AKIA" + "ABCDEFGH12345678"
    text = f"É password = 'hunter2hunter2' and {key} or {'0a' * 20} TOKEN:short api_key=abcdefgh"
    rows = [(1, text), (2, "toKen = x"), *ODD]
    got = {r["doc_id"]: r for r in secret_scan.scan(docs_of(spark, rows), model).collect()}
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (2, 1, 1)
    at = text.index("password")
    spans = f"assign:{at}:{text.index('2hunter2') + 8},access:{text.index(key)}:{text.index(key) + 20},hex:{text.index('0a0a')}:{text.index('0a0a') + 40},assign:{text.index('api_key')}:{len(text)}"
    assert got[1]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    assert set(spans.split(",")) <= set(got[1]["spans"].split(","))
    empty = hashlib.sha256(b"").hexdigest()
    assert all(got[d]["base_sha256"] == empty and got[d]["spans"] == "" for d in (2, 900, 901, 902)) and len(got) == len(rows)
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs_of(spark, rows), model).collect()}
    assert "hunter2" not in clean[1] and key not in clean[1] and clean[900] is None and clean[904] == ODD[5][1]


def planted_secret(rng, kind):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda pool, n: "".join(rng.choices(pool, k=n))
    return {"hex": lambda: draw("0123456789abcdef", 31), "plain": lambda: draw(letters, 40), "prefixed": lambda: "ghp_" + draw(letters, 36), "access": lambda: "ASIA" + draw(letters[:26] + "0123456789", 16), "base64": lambda: draw(letters + "+/", 43) + "="}[kind]()


def test_crf_finds_secrets_without_keywords(spark):
    """Recall and precision on rows that were not trained on, over the whole table: values in running text, after other words, and decoys."""
    docs = table(spark, MORE, "documents").where("text is not null")
    model = secret_scan.train(docs.where("doc_id % 2 = 0"))
    rng, rows, want, kinds = random.Random(12), [], {}, {}
    decoys = ("someCamelCaseName", "snake_case_name", "https://www.site.com/a/b-12345", "2021-03-04T05:06:07Z", "/usr/lib/thing.py", "978-3-1614-8410-0", "v1.20.3-beta", "x12@mail.example.com", "6f1b2c3d-1a2b-4c3d-8e9f-0a1b2c3d4e5f")
    for r in docs.where("doc_id % 2 = 1").collect():
        words_, kind = r["text"].split(" "), rng.choice(["hex", "plain", "prefixed", "access", "base64"])
        k, lead = rng.randrange(len(words_) + 1), rng.choice(["", "", "bearer ", "credential = "])
        value = planted_secret(rng, kind)
        text = " ".join([*words_[:k], lead + value, "so", rng.choice(decoys), *words_[k:]])
        rows.append((r["doc_id"], text))
        want[r["doc_id"]], kinds[r["doc_id"]] = (text.index(value), text.index(value) + len(value)), kind
    got = {r["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("crf")] for r in secret_scan.scan(docs_of(spark, rows), model).collect()}
    hit = Counter(kinds[d] for d, spans in got.items() if want[d] in spans)
    assert sum(hit.values()) >= 0.95 * len(rows) and all(hit[k] >= 0.85 * n for k, n in Counter(kinds.values()).items())
    assert sum(s != want[d] for d, spans in got.items() for s in spans) <= 0.02 * len(rows)
    assert not any("crf" in r["spans"] for r in secret_scan.scan(docs, model).collect())  # nothing is added to the table as it is


def test_crf_adds_what_the_patterns_miss(spark, model):
    text = 'plain words then key = "9f8e7d6c5b4a39281706f5e4d3c2b1a" and more words'  # 31 digits, no keyword
    assert secret_scan.base_spans(text) == []
    assert [text[b:e] for b, e in secret_scan.crf_spans(text, *model)] == ["9f8e7d6c5b4a39281706f5e4d3c2b1a"]
    assert secret_scan.crf_spans("call +1 (545) 555-9193 or 7844238401328224 at 10.0.0.1 x@mail7.example.com", *model) == []
    nothing = secret_scan.train(table(spark, MORE, "documents").limit(0))
    assert secret_scan.crf_spans(text, *nothing) == []
    none = secret_scan.train(docs_of(spark, [(k, "no secret is here %d" % k) for k in range(20)] + [o for o in ODD if o[0] != 905]))
    assert secret_scan.crf_spans(text, *none) == []
    rows = [(1, "aB3_" * 60_000), (2, ("x1-" * 9 + " ") * 20_000), (3, "word " * 100_000)]
    assert [r["n_hex"] for r in secret_scan.scan(docs_of(spark, rows), model).collect()] == [0, 0, 0]


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        emit, move = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
        value = lambda tags: sum(emit[k, t] for k, t in enumerate(tags)) + sum(move[a, b] for a, b in zip((2, *tags), tags, strict=False))  # noqa: B023, E731
        assert tuple(secret_scan.viterbi(emit, move)) == max(product(range(3), repeat=n), key=value)


# ---- op8 ----


def test_markov_scores(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(0, 40), 30).upper() if i % 5 == 0 else words(rng, rng.randint(0, 40), 30)) for i in range(120)] + ODD
    docs = docs_of(spark, rows)
    got = markov_lm.score_texts(docs, remainder(F.col("doc_id"), 7) == 2).collect()
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), "\0end"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not held(d) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), held(d), len(split(t)), sum(counts[w] > 0 for w in split(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    nothing = markov_lm.score_texts(docs, F.lit(True)).collect()
    assert {r["train_tokens"] for r in nothing} == {0} and all(r["n_known"] == 0 for r in nothing)
    assert markov_lm.score_texts(docs.limit(0), F.lit(False)).count() == 0


def test_markov_scores_by_brute_force(spark, monkeypatch):
    """The whole query's scores from its chain by a plain forward recursion; several chunks; repeats score alike."""
    monkeypatch.setattr(markov_lm, "CHUNK_BYTES", 1500)
    kept = []
    fit = markov_lm.baum_welch
    monkeypatch.setattr(markov_lm, "baum_welch", lambda *a: kept.append(fit(*a)) or kept[-1])
    rng = random.Random(16)
    rows = [(i, words(rng, rng.randint(0, 60), 3000)) for i in range(90)] + [(500, "w1 w2 w3"), (500, "w1 w2 w3"), (501, "long " * 20_000)]
    docs = docs_of(spark, rows)
    got = markov_lm.score_texts(docs, remainder(F.col("doc_id"), 7) == 2).collect()
    (chain, history), split = kept[0], lambda t: [*t.encode().split(), b""]
    assert all(b >= a - 1e-4 * abs(a) for a, b in zip(history, history[1:], strict=False))
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not held(d) for w in split(t))
    total = sum(counts.values())
    keys = {w: markov_lm.key_of(w) for w in {w for _, t in rows for w in split(t)}}
    top = sorted(keys[w] for w, n in counts.items() if n * markov_lm.TOP_WORDS > total)
    kind = lambda w: markov_lm.ENDINGS + top.index(keys[w]) if keys[w] in top else markov_lm.ending(w)
    tokens_of, words_of = Counter(), Counter()
    for w, n in counts.items():
        tokens_of[kind(w)] += n
        words_of[kind(w)] += 1
    want = {}
    for d, t in rows:
        a, score = chain.start, 0.0
        for k, w in enumerate(split(t)):
            c = kind(w)
            a = (a if k == 0 else a @ chain.move) * chain.emit[c]
            score += math.log10(a.sum()) + math.log10((counts[w] + 1) / (tokens_of[c] + words_of[c] + 1))
            a = a / a.sum()
        want[d] = score
    assert len(got) == len(rows) and all(r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-9) for r in got)


def test_forward_recursion_is_exact_and_training_climbs():
    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    chain = markov_lm.Chain(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    texts = [rng.integers(0, 5, n) for n in (1, 4, 4, 7, 2)]

    def slow(text):
        a = chain.start * chain.emit[text[0]]
        for s in text[1:]:
            a = (a @ chain.move) * chain.emit[s]
        return math.log10(a.sum())

    assert np.allclose(chain.log_likelihood(texts), [slow(t) for t in texts])
    last = -np.inf
    for _ in range(6):
        start, moves, emitted, likelihood = chain.expected(texts, 1)
        assert likelihood >= last - 1e-9 and emitted.sum() == pytest.approx(18) and moves.sum() == pytest.approx(13)
        last = likelihood
        for scaled in (2, 3, 8):
            assert all(np.allclose(a, b) for a, b in zip(chain.expected(texts, scaled), (start, moves, emitted, likelihood), strict=True))
        chain = markov_lm.Chain(norm(start, 0), norm(moves, 1), norm(emitted, 0))


def test_every_iteration_runs_over_all_texts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, bytearray(rng.integers(0, 5, 3).astype("<u2").tobytes())) for k in range(6000)]
    encoded, seen, step = spark.createDataFrame(rows, "doc_id long, classes binary").cache(), [], markov_lm.step

    def counted(texts, *more):
        seen.append(texts.count())
        return step(texts, *more)

    monkeypatch.setattr(markov_lm, "step", counted)
    _, history = markov_lm.baum_welch(encoded, np.full(5, 3600.0))
    assert set(seen) == {6000} and len(history) == len(seen) >= 4 and history[-1] > history[0]


# ---- op9 ----


def test_fingerprints(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, 60, 120)) for i in range(40)] + [(60 + k, words(rng, 30, 120) + " " + "y" * rng.choice([62, 63, 64, 200, 400]) + " " + "z" * 300) for k in range(8)] + [(50, "same text here"), (51, "same text here"), *ODD]
    got = weighted_fingerprint.fingerprints(docs_of(spark, rows), samples=64).collect()
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    bag = lambda t: Counter({w: n * len(w) for w, n in Counter(re.findall(r"[^\x20\x09-\x0D]+", t)).items()})

    def likeness(a, b):
        a, b = bag(a), bag(b)
        top = sum((a | b).values())
        return sum((a & b).values()) / top if top else 1.0

    want, error = {}, []
    for k, (d, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        want.setdefault((d, len(t), hashlib.sha256(edited.encode()).hexdigest()), []).append((likeness(t, edited), likeness(t, n)))
    assert sorted(want, key=str) == sorted({(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got}, key=str) and len(got) == len(rows)
    for r in got:
        near, beyond = want[r["doc_id"], r["n_chars"], r["edited_sha256"]][0]
        error += [r["near_edited"] - near, r["near_next"] - beyond]
    assert abs(np.mean(error)) < 0.03 and np.sqrt(np.mean(np.square(error))) < 0.09
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[50] == prints[51] != prints[1] and prints[900] == prints[901] == prints[902] == ""
    assert weighted_fingerprint.fingerprints(docs_of(spark, rows[:1])).first()["near_next"] == 1
    assert weighted_fingerprint.fingerprints(docs_of(spark, rows).limit(0)).count() == 0


def brute_fingerprint(text, samples):
    """The same draws one by one in plain Python, weights from the words themselves."""
    signed = lambda x: x - 2**64 if x >> 63 else x
    out = []
    bag = Counter(re.findall(r"[^\x20\x09-\x0D]+", text))
    for k in range(samples if bag else 0):
        drawn = []
        for w, n in bag.items():
            term = xxhash.xxh64_intdigest(w.encode(), 42) & ~63 | min(63, len(w))
            first = xxhash.xxh64_intdigest(struct.pack("<Q", term), 42)
            a, b = (xxhash.xxh64_intdigest(struct.pack("<i", j), first) for j in (2 * k, 2 * k + 1))
            unit = lambda x, bits: (x + 0.5) / 2**bits
            beta = (a >> 1 & (1 << 21) - 1) / 2**21
            r = -math.log(unit(a >> 43, 21) * unit(a >> 22 & (1 << 21) - 1, 21))
            log_c = math.log(-math.log(unit(b >> 32, 32) * unit(b & 2**32 - 1, 32)))
            t = math.floor(math.log(n * len(w)) / r + beta)
            drawn.append((int((log_c - r * (t - beta + 1) + 100) * 2**24), (signed(a) ^ t << 9) & 2**32 - 1))
        out.append(f"{min(drawn)[1]:08x}")
    return "".join(out)


def test_fingerprints_by_brute_force(spark):
    rng = random.Random(18)
    rows = [(i, words(rng, rng.randint(1, 80), 50)) for i in range(30)] + [(40, "same words same"), (41, "same words same"), (42, "q" * 5000 + " " + "é" * 63 + " x"), *ODD]
    got = weighted_fingerprint.fingerprints(docs_of(spark, rows)).collect()
    want = Counter((d, brute_fingerprint(t or "", 32)) for d, t in rows)
    assert want == Counter((r["doc_id"], r["fingerprint"]) for r in got)
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    edited = {hashlib.sha256(e.encode()).hexdigest(): e for (_, t), (_, n) in zip(order, order[1:] + order[:1], strict=True) for e in [(t or "")[: len(t or "") - len(t or "") // 2] + (n or "")[: len(t or "") // 2]]}
    assert all(r["edited_fingerprint"] == brute_fingerprint(edited[r["edited_sha256"]], 32) for r in got)


def test_fingerprints_use_no_python(spark, corpus):
    plan = weighted_fingerprint.fingerprints(corpus)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    plan = decontamination.matches(corpus, table(spark, DATA, "benchmark"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- op10 ----


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least, last = {}, 2**63 - 1
    for k, (d, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), last), last if d is None else d)
    return sorted(((d, len(sets[k]), d if not sets[k] else None if least[root(k)] == last else least[root(k)]) for k, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("common,share", [(200_000, 5_000), (0, 5_000), (200_000, 3)])
def test_jaccard_join_matches_brute_force(spark, common, share):
    rng = random.Random(7)
    base, rows = [[rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.randint(4, 80))] for _ in range(8)], []
    for i in range(200):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = "z%d" % rng.randrange(50)
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [*ODD, (5003, "One two"), (5004, "one TWO"), (None, rows[0][1]), (5006, "É a b c d"), (5007, "é a b c d")]
    got = jaccard_join.near_duplicates(docs_of(spark, rows), common, share).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_jaccard_join_meets_the_source_of_a_dealt_shingle(spark):
    """Copies with text of their own hold the shared shingles in long prefixes only, their source in its short one."""
    source = " ".join("s%d" % k for k in range(104))
    rows = [(0, source)] + [(k, source + "".join(f" own{k}x{n}" for n in range(20))) for k in range(1, 61)] + [(100, "no relation at all to any of them")]
    got = jaccard_join.near_duplicates(docs_of(spark, rows), share=3).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_one_of_each_group_stays(spark):
    rng = random.Random(9)
    text = words(rng, 50)
    rows = [(4, text), (2, text + " end"), (7, text), (9, words(rng, 40)), (9, words(rng, 40)), (11, words(rng, 30)), (11, ""), (12, None)]
    kept = jaccard_join.one_of_each(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {2, 9, 11, 12}
    marked = docs_of(spark, rows).withColumns({"_id": F.lit("keep"), "kept_id": F.lit("keep")})
    assert {(r["_id"], r["kept_id"]) for r in jaccard_join.one_of_each(marked).collect()} == {("keep", "keep")}
    assert jaccard_join.one_of_each(docs_of(spark, rows).limit(0)).count() == 0


def test_parity_bitmaps_never_hide_a_similar_pair():
    rng = np.random.default_rng(3)
    for n in (1, 5, 700, 1500):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(0.9 * len(a))], rng.integers(0, 2**63, n // 20 + 400 * (n == 700)).astype(np.uint64)]))
        x, y = (np.frombuffer(jaccard_join.parity_bits(s), np.uint8) for s in (a, b))
        assert jaccard_join.differing(x, y) <= len(np.setxor1d(a, b))


def test_queries_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
