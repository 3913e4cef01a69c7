"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a bag of words; a word weighs the characters that it takes up in the text (its count times its
length). For each of ``SAMPLES`` samples every word draws from Gamma(2, 1), Gamma(2, 1) and the uniform
distribution, by hashes of the word, and the word with the smallest draw for its weight is the sample together
with its quantised weight. Two documents share a sample with the probability of their generalised Jaccard
similarity, so the share of equal samples estimates it.

Draws are packed into one long each (order in front, identity behind), so that a fingerprint is ``SAMPLES``
minima of longs: one hash aggregate inside generated code. Words are sorted and counted inside the row; only their
hashes are exploded.

Defined results: a null or empty text, or one of white space only, has the fingerprint "" and is alike (1) only to
another such one. Rows that share a doc_id are ordered by their text; null ids come last. The only row of a table is its own
next. Ids are integers. Extra columns are ignored; equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table

SAMPLES = 32


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def term_of(word: Column) -> Column:
    """Hash of a word; its low six bits hold the length if that is below 63, and 63 otherwise."""
    return F.xxhash64(word).bitwiseAND(F.lit(-64)).bitwiseOR(F.least(F.length(word), F.lit(63)))


def term_array(text: Column) -> Column:
    return F.sort_array(F.transform(word_array(text), term_of))


def long_words(text: Column, terms: Column) -> Column:
    """(term, length) of every word of 63 characters or more, in order; null for most texts, which have none and are not cut again."""
    found = F.filter(word_array(text), lambda w: F.length(w) >= 63)
    made = F.sort_array(F.transform(found, lambda w: F.struct(term_of(w).alias("term"), F.length(w).alias("length"))))
    return F.when(F.exists(terms, lambda t: t.bitwiseAND(F.lit(63)) == 63), made)


def counted(terms: Column, ends: Column, length) -> Column:
    """Array of (term, count, length) from a sorted array and the places where its runs end."""
    row = lambda t, n: F.struct(*length(t), n.alias("n"))
    return F.transform(ends, lambda p, j: row(F.get(terms, p - 1), p - F.coalesce(F.get(ends, j - 1), F.lit(0))))


def run_ends(terms: Column) -> Column:
    size = F.size(terms)
    ends = F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | (F.get(terms, i) != F.get(terms, i - 1)))
    return F.when(size > 0, ends).otherwise(F.array().cast("array<int>"))


def draws(samples: int) -> list[Column]:
    """One column for each sample over columns ``term`` and ``ln_weight``: the packed draw of the term."""
    out = []
    for k in range(samples):
        a, b = f"xxhash64(term, {2 * k})", f"xxhash64(term, {2 * k + 1})"
        beta = f"((shiftrightunsigned({a}, 1) & 2097151) * 4.76837158203125E-7D)"
        r = f"(-ln(((shiftrightunsigned({a}, 43) + 0.5D) * 4.76837158203125E-7D) * (((shiftrightunsigned({a}, 22) & 2097151) + 0.5D) * 4.76837158203125E-7D)))"
        log_c = f"ln(-ln(((shiftrightunsigned({b}, 32) + 0.5D) * 2.3283064365386963E-10D) * (((({b}) & 4294967295) + 0.5D) * 2.3283064365386963E-10D)))"
        t = f"floor(ln_weight / {r} + {beta})"
        order = f"shiftleft(cast(({log_c} - {r} * ({t} - {beta} + 1D) + 100D) * 16777216D as bigint), 32)"
        identity = f"(({a} ^ shiftleft({t}, 9)) & 4294967295)"
        out.append(F.expr(f"min(case when term is not null then {order} | {identity} end)").alias(f"s{k}"))
    return out


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; the samples of an empty bag are null and equal only to those of another."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: same)) / F.size(a).cast("double")


def bounds(docs: DataFrame, buckets: int) -> list[int]:
    """At most ``buckets`` - 1 ids that cut the ids evenly: the number grows with the partitions, not the rows."""
    cuts = docs.select(F.percentile_approx("key", [k / buckets for k in range(1, buckets)], 10_000).alias("q")).first()["q"] if buckets > 1 else []
    return sorted(set(cuts or []))


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the key, by binary search."""
    levels = max(1, len(cuts).bit_length())
    padded = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(levels))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(padded, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in buckets of descending doc_id; ``rn`` numbers them within and ``following`` is the next text.

    The first row of the following bucket stands, as ``halo``, at the end of each bucket; after the last comes the first.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"))
    cuts = bounds(rows, 4 * partitions(docs.sparkSession))
    rows = rows.withColumn("bucket", bucket_of(F.col("key"), cuts))
    heads = sorted(((r["bucket"], r["key"]) for r in rows.groupBy("bucket").agg(F.max("key").alias("key")).collect()), reverse=True)
    if not heads:
        heads = [(0, 0)]
    moved = [(bucket, heads[(k + 1) % len(heads)][1]) for k, (bucket, _) in enumerate(heads)]
    target = F.inline(F.array(*[F.struct(F.lit(b).alias("to_bucket"), F.lit(k).cast("long").alias("key")) for b, k in moved]))
    heads_df = docs.sparkSession.range(1).select(target)  # one row for each bucket
    first = Window.partitionBy("to_bucket").orderBy("text")
    halo = rows.join(F.broadcast(heads_df), "key").withColumn("first", F.row_number().over(first)).where("first = 1")
    every = rows.withColumn("halo", F.lit(False)).unionByName(halo.select("doc_id", "text", "key", F.col("to_bucket").alias("bucket"), F.lit(True).alias("halo")))
    order = Window.partitionBy("bucket").orderBy("halo", F.desc("key"), "text")
    return every.withColumn("following", F.lead("text").over(order)).withColumn("rn", F.row_number().over(order))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprint of every whole text, of its edited text, and their likeness to each other and to the next text's."""
    rows = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.coalesce("following", F.lit("")), F.lit(1), half))
    variants = F.when(F.col("halo"), F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")))).otherwise(
        F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), edited.alias("body")))
    )
    bodies = rows.select("bucket", "rn", "halo", "doc_id", F.length("text").cast("long").alias("n_chars"), F.inline(variants))
    keys = ["bucket", "rn", "halo", "doc_id", "n_chars", "which"]
    bags = bodies.select(*keys, "body", F.when(F.col("which") == 1, F.sha2("body", 256)).alias("sha"), F.inline(F.array(F.struct(term_array(F.col("body")).alias("terms")))))
    bags = bags.select(*keys, "sha", "terms", F.inline(F.array(F.struct(long_words(F.col("body"), F.col("terms")).alias("long")))))
    short = F.when(F.col("long").isNull(), F.col("terms")).otherwise(F.filter("terms", lambda t: t.bitwiseAND(F.lit(63)) < 63))
    bags = bags.select(*keys, "sha", "long", F.inline(F.array(F.struct(short.alias("terms")))))
    bags = bags.select(*keys, "sha", "long", "terms", F.inline(F.array(F.struct(run_ends(F.col("terms")).alias("ends"), run_ends(F.col("long")).alias("long_ends")))))
    few = counted(F.col("terms"), F.col("ends"), lambda t: (t.alias("term"), t.bitwiseAND(F.lit(63)).alias("length")))
    many = counted(F.col("long"), F.col("long_ends"), lambda t: (t["term"].alias("term"), t["length"].cast("long").alias("length")))
    terms = bags.select(*keys, "sha", F.inline_outer(F.when(F.col("long").isNull(), few).otherwise(F.concat(few, many))))
    weighed = terms.select(*keys, "sha", "term", F.log((F.col("n") * F.col("length")).cast("double")).alias("ln_weight"))
    signed = weighed.groupBy(*keys, "sha").agg(*draws(samples)).select(*keys, "sha", F.array(*[F.col(f"s{k}") for k in range(samples)]).alias("signature"))
    order = Window.partitionBy("bucket").orderBy("rn", "which")
    written = lambda c: F.when(F.get(c, F.lit(0)).isNull(), "").otherwise(F.concat_ws("", F.transform(c, lambda s: F.lpad(F.hex(s.bitwiseAND(F.lit(4294967295))), 8, "0"))))
    return (
        signed.withColumn("other", F.lead("signature", 1).over(order))
        .withColumn("beyond", F.lead("signature", 2).over(order))
        .withColumn("edited_sha256", F.lead("sha", 1).over(order))
        .where(~F.col("halo") & (F.col("which") == 0))
        .select(
            "doc_id", "n_chars", "edited_sha256",
            F.lower(written(F.col("signature"))).alias("fingerprint"),
            F.lower(written(F.col("other"))).alias("edited_fingerprint"),
            likeness(F.col("signature"), F.col("other")).alias("near_edited"),
            likeness(F.col("signature"), F.col("beyond")).alias("near_next"),
        )
    )


def op9_weighted_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Contract query over every document."""
    return fingerprints(table(spark, sf_dir, "documents"))
