"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words become a template: numbers, names (capitalised words inside a sentence) and units turn into typed
placeholders. Windows of ``WINDOW`` template words are hashed and looked up among the windows of the benchmark.
A match aligns a run of the document with an item; the values that stand in the slots of both must map one to one
(the same number always replaced by the same number), which also catches re-parameterised questions and sets
aside chance agreement of placeholders.

A pair that this strict rule does not match is judged once more by a wider one. Windows are also looked up with names
as lower-case literals; items with fewer than ``WINDOW`` words, and windows with fewer than ``LITERALS`` literal words,
by their exact words; two values of the item may become one in the document; and where an alignment is not consistent,
its verbatim windows still count. So a verbatim copy always matches, whatever its case and spacing. An item with fewer
than ``SHORT`` words ("yes", "the river") says nothing inside a text: it matches only texts that have no other words.

The windows of the benchmark are looked up inside each document's row while they number at most ``LITERAL_LIMIT``
(their size is checked); beyond that, exploded windows meet them in a join. Their table is written, so Spark knows its
size and chooses how to join, and splits a hot window.

Defined results: null or empty texts and items match nothing. A pair of the strict rule reports that rule's figures.
Rows that share a doc_id count as one document, a null doc_id as one more. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW = 8
LITERALS = 4
#: Matched windows that make a match, or all windows of a shorter item (in the wider rule all that are templates, if any).
MATCHED = 4
#: Words that an item needs to be looked for inside a longer text.
SHORT = 4
LITERAL_LIMIT = 50_000

# Units of measure that have no other common meaning.
UNITS = ("kg", "mg", "km", "cm", "mm", "ml", "mph", "kmh", "kwh", "lb", "lbs", "oz", "ft", "percent", "dollars", "euros", "pounds", "meters", "metres", "miles", "kilometers", "kilograms", "grams", "liters", "litres", "hours", "minutes", "seconds", "%", "$", "€", "£", "°")
# Numbers written as one word.
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion")
NAME_MARK = "\u0001"


def words(text: Column) -> Column:
    """Lower-case words; a name keeps a mark in front, and thousands are not parted from their number."""
    joined = text
    for _ in range(2):  # neighbouring commas take turns
        joined = F.regexp_replace(joined, "([0-9]),([0-9]{3})", "$1$2")
    text = F.when(F.regexp_like(text, F.lit("[0-9],[0-9]{3}")), joined).otherwise(text)
    marked = F.regexp_replace(text, r"([\p{Ll},;] )(?=\p{Lu})", "$1" + NAME_MARK)
    return F.filter(F.split(F.lower(marked), "[^\\p{L}\\p{N}" + NAME_MARK + "%$€£°]+"), lambda w: w != "")


def slot(word: Column) -> Column:
    """1 for a number, 2 for a name, 3 for a unit, 0 for a literal word."""
    listed = F.when(word.isin(*NUMBERS), 1).otherwise(3)
    return F.when(word.between("0", "9~"), 1).when(word.startswith(NAME_MARK), 2).when(word.isin(*NUMBERS, *UNITS), listed).otherwise(0)


def template(word: Column) -> Column:
    """Hash of a literal word, or the number of its slot type."""
    kind = slot(word)
    return F.when(kind > 0, kind.cast("long")).otherwise(F.xxhash64(word))


def plain(word: Column) -> Column:
    """The word without a name's mark."""
    return F.ltrim(word, F.lit(NAME_MARK))


def window_hash(hashes: Column, at: Column, size: int = WINDOW) -> Column:
    return F.xxhash64(*[F.get(hashes, at + k) for k in range(size)])


def settled(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Compute columns once for each row. A generator of one row stands between, so that the optimizer copies none of
    them into the functions of array elements that read them, nor into a filter."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _prepared(rows: DataFrame, key: str, least: int, exact: bool = True) -> DataFrame:
    """Words of texts that have ``least`` or more, and their hashes: templates, templates with names as literals, words.

    Texts without names have one template for both; ``exact`` tells whether the words' own hashes are asked for.
    """
    raw = settled(rows, [key], words=words(F.col("text"))).where(F.size("words") >= least)
    made = settled(raw, [key, "words"], hashes=F.transform("words", template), named=F.exists("words", lambda w: w.startswith(NAME_MARK)))
    lower = F.when(F.col("named"), F.transform("words", lambda w: template(plain(w)))).otherwise(F.col("hashes"))
    own = F.transform("words", lambda w: F.xxhash64(plain(w))) if exact else F.array().cast("array<bigint>")
    return settled(made, [key, "words", "hashes", "named"], lower=lower, exact=own)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, hash, place in the item, raw words, whether the hash is a strict template, and numbers of windows.

    A window has a row for its template, one for that with names as literals if it differs, and one for its exact
    words if neither has enough literals. A short item is one window.
    """
    rows = _prepared(benchmark, "item_id", 1).withColumn("b_windows", F.greatest(F.size("words") - (WINDOW - 1), F.lit(1)))
    at = rows.select("item_id", "words", "hashes", "lower", "exact", "b_windows", F.explode(F.sequence(F.lit(0), F.col("b_windows") - 1)).alias("b_at"))
    raw = at.withColumn("b_raw", F.slice("words", F.col("b_at") + 1, WINDOW))
    literal = lambda name: F.size(F.filter(name, lambda w: slot(w) == 0)) >= LITERALS
    whole = F.size("b_raw") == WINDOW
    made = raw.select("item_id", "b_windows", "b_at", "b_raw", (whole & literal("b_raw")).alias("strict"), (whole & literal(F.transform("b_raw", plain))).alias("wide"), *[window_hash(F.col(name), F.col("b_at")).alias(name) for name in ("hashes", "lower", "exact")])
    kinds = F.array(
        F.when(F.col("strict"), F.struct(F.col("hashes").alias("hash"), F.lit(True).alias("b_strict"))),
        F.when(F.col("wide") & ~(F.col("strict") & (F.col("lower") == F.col("hashes"))), F.struct(F.col("lower").alias("hash"), F.lit(False).alias("b_strict"))),
        F.when(~F.col("strict") & ~F.col("wide"), F.struct(F.col("exact").alias("hash"), F.lit(False).alias("b_strict"))),
    )
    of = Window.partitionBy("item_id", "b_windows")
    templates = F.sum((F.col("strict") | F.col("wide")).cast("int")).over(of)
    counted = made.withColumn("b_needed", F.least(F.lit(MATCHED), F.when(templates > 0, templates).otherwise(F.col("b_windows"))))
    return counted.select("item_id", "b_windows", "b_needed", "b_at", "b_raw", (~F.col("strict") & ~F.col("wide")).alias("b_exact"), F.inline(F.filter(kinds, lambda k: k.isNotNull())))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that match: windows matched and slots replaced."""
    spark = docs.sparkSession
    items = materialize(benchmark_windows(benchmark), "windows")
    known = [r["hash"] for r in items.select("hash").distinct().limit(LITERAL_LIMIT + 1).collect()]
    exact = sorted(r["size"] for r in items.where("b_exact").select(F.size("b_raw").alias("size")).distinct().collect())  # at most WINDOW sizes
    if not known:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, n_windows long, n_replaced long")
    rows = _prepared(docs, "doc_id", min([WINDOW, *exact]), bool(exact))
    # each size of window and the hashes by which it is looked up
    looked = {size: ["exact"] for size in exact} | {WINDOW: ["hashes", "lower"] + ["exact"] * (WINDOW in exact)}

    def places(size: int) -> Column:
        return F.when(F.size("words") >= size, F.sequence(F.lit(0), F.size("words") - size)).otherwise(F.array().cast("array<int>"))

    def hits(size: int, at: Column) -> Column:
        def kinds(i: Column) -> Column:
            raw = F.slice("words", i + 1, size)
            strict = window_hash(F.col("hashes"), i, size)
            made = [window_hash(F.col(name), i, size) for name in looked[size]]
            return F.array_distinct(F.array(*[F.struct(i.alias("at"), raw.alias("raw"), h.alias("hash"), (h == strict).alias("strict")) for h in made]))

        return F.flatten(F.transform(at, kinds))

    if len(known) <= LITERAL_LIMIT:

        def wanted(size: int) -> Column:
            def asked(name: str, i: Column) -> Column:
                found = window_hash(F.col(name), i, size).isin(known)
                return F.col("named") & found if name == "lower" else found  # without names both templates are one

            return F.filter(places(size), lambda i: reduce(or_, [asked(name, i) for name in looked[size]]))

        kept = settled(rows, ["doc_id", "words", "hashes", "lower", "exact"], **{f"at{size}": wanted(size) for size in looked})
        kept = kept.where(reduce(or_, [F.size(f"at{size}") > 0 for size in looked]))
        found = kept.select("doc_id", F.size("words").alias("n_words"), F.inline(F.concat(*[hits(size, F.col(f"at{size}")) for size in looked]))).join(items, "hash")
    else:
        found = rows.select("doc_id", F.size("words").alias("n_words"), F.inline(F.concat(*[hits(size, places(size)) for size in looked]))).join(items, "hash")
    found = found.where((F.size("b_raw") >= SHORT) | (F.size("b_raw") == F.col("n_words")))
    pairs = F.filter(F.zip_with("raw", "b_raw", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: slot(p["b"]) > 0)
    replaced = lambda name: F.size(F.filter(name, lambda p: p["a"] != p["b"]))
    by_template = F.col("strict") & F.col("b_strict")
    verbatim = F.transform("raw", plain) == F.transform("b_raw", plain)
    aligned = (
        found.groupBy("doc_id", "item_id", "b_windows", "b_needed", (F.col("at") - F.col("b_at")).alias("shift"))
        .agg(
            F.count(F.when(by_template, 1)).alias("n"),
            F.array_distinct(F.flatten(F.collect_set(F.when(by_template, pairs)))).alias("pairs"),
            F.size(F.collect_set("at")).alias("wide_n"),
            F.size(F.collect_set(F.when(verbatim, F.col("at")))).alias("verbatim_n"),
            F.array_distinct(F.flatten(F.collect_set(pairs))).alias("raw_pairs"),
        )
        .withColumn("wide", F.array_distinct(F.transform("raw_pairs", lambda p: F.struct(plain(p["a"]).alias("a"), p["b"].alias("b")))))
        .withColumn("one_to_one", (F.col("n") > 0) & (F.size("pairs") == F.size(F.array_distinct("pairs.a"))) & (F.size("pairs") == F.size(F.array_distinct("pairs.b"))))
        .withColumn("steady", F.size("wide") == F.size(F.array_distinct("wide.b")))
    )
    wide_replaced = F.size(F.filter("wide", lambda p: p["a"] != plain(p["b"])))
    return (
        aligned.groupBy("doc_id", "item_id", "b_windows", "b_needed")
        .agg(
            F.sum(F.when(F.col("one_to_one"), F.col("n")).otherwise(0)).alias("n"),
            F.min(F.when(F.col("one_to_one"), replaced("pairs"))).alias("replaced"),
            F.sum(F.when(F.col("steady"), F.col("wide_n")).otherwise(F.col("verbatim_n"))).alias("wide_n"),
            F.min(F.when(F.col("steady"), wide_replaced).when(F.col("verbatim_n") > 0, 0)).alias("wide_replaced"),
        )
        .withColumn("strict", F.col("n") >= F.least(F.lit(MATCHED), F.col("b_windows")))
        .where(F.col("strict") | (F.col("wide_n") >= F.col("b_needed")))
        .select("doc_id", "item_id", *[F.when(F.col("strict"), F.col(a)).otherwise(F.col(b)).cast("long").alias(name) for a, b, name in (("n", "wide_n", "n_windows"), ("replaced", "wide_replaced", "n_replaced"))])
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, columns as they are, that match no item. Each row is judged by its own text, whatever its id."""
    judged = docs.select(F.struct("doc_id", F.xxhash64("text").alias("digest")).alias("doc_id"), "text")
    leaked = matches(judged, benchmark).select(F.col("doc_id.doc_id").alias("leaked_id"), F.col("doc_id.digest").alias("leaked_text")).distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["leaked_id"]) & (F.xxhash64(docs["text"]) == leaked["leaked_text"]), "left_anti")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Matches of every document with every item of the benchmark."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
