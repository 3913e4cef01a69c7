"""Near-duplicate documents by a grouped prefix join on word shingles.

A document is the set of its five-word shingles. Shingles have one order: those known to be common last, by
frequency, the rest by hash; any order is exact, this one keeps common shingles out of prefixes. Two sets of
similarity t or more share a shingle within the short prefix of the smaller and the long prefix of the larger.
Documents with the same prefix and size form one group, and groups meet under each prefix shingle.

Under a shingle not all pairs are made: first every group meets the most central group only (the one with the
fewest rare shingles, the likely source of its copies), members are expanded and verified on whole sets, and links
become components. Then only pairs that still lie in different components are made and verified. What is skipped
joins documents already connected, so the components are exact. A shingle common to many groups is dealt over
several keys in the first step, and their centres meet in turn; a key without a short prefix meets the first centre.
The second step deals one side of a large key over salts and repeats the other under all of them.

Before whole sets move, a pair is held against parity bitmaps: they differ in at most as many bits as the sets in
shingles, so a pair whose bitmaps differ in more than similar sets may is left out without loss. Texts of the sets
still wanted pass a Bloom filter of fixed size on their way to the join, which keeps most others at home.

Defined results: a text without words has no shingles and links with nothing; fewer than five words are one
shingle. Rows that repeat a doc_id are judged by their own texts. A null doc_id is its own id and the last choice
for a component's name. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, column, discard, materialize, releasing, small_batches, table, utf8

SHINGLE = 5
PERCENT = 80
#: Bound of the table of common shingles, and of the groups that meet under one key.
COMMON = 400_000
SHARE = 5_000
#: Bytes of text that are cut into shingles at once, and rows of an Arrow batch: both keep Python workers small.
BLOCK = 1 << 18
BATCH_ROWS = 1_000
#: Bits of the Bloom filter; when it fills up it lets all through and nothing else changes.
BLOOM_BITS = 1 << 24
NO_ID = 2**63 - 1

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    return (h * np.uint64(0x94D049BB133111EB)) ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and where each row's begin."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    data = LOWER[data]
    row = np.repeat(np.arange(rows), np.diff(offsets))
    inside = ~SPACE[data]
    cut = np.concatenate([[True], row[1:] != row[:-1]])
    start = np.flatnonzero(inside & (cut | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (np.concatenate([cut[1:], [True]]) | ~np.concatenate([inside[1:], [False]]))) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), dtype=np.uint64)])
    word = mix((sums[end] - sums[start]) * powers(INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    owner = row[start]
    count = np.bincount(owner, minlength=rows)
    many = max(0, len(word) - size + 1)
    hashes, of = np.zeros(many, np.uint64), owner[:many]
    for k in range(size):
        hashes = hashes * np.uint64(BASE) + word[k : k + many]
    whole = of == owner[size - 1 :] if many else np.zeros(0, bool)
    hashes, of = mix(hashes[whole]), of[whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])
        extra = np.array([int(mix(np.array([sum(int(w) * pow(BASE, k + 7, 2**64) for k, w in enumerate(word[first[r] : first[r] + count[r]])) % 2**64], np.uint64))[0]) for r in short], np.uint64)
        hashes, of = np.concatenate([hashes, extra]), np.concatenate([of, short])
    turn = np.lexsort((hashes, of))
    hashes, of = hashes[turn], of[turn]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))])


def node_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


@releasing
def _local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several different sets of a task share, counted."""
    seen, held, size = set(), [], 0

    def flush() -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= 3
        return pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(n[often])], names=["token", "n"])

    for batch in batches:
        for block in blocks(batch, "text", BLOCK):
            hashes, at = shingle_sets(*utf8(column(block, "text")))
            for k in range(block.num_rows):
                own = hashes[at[k] : at[k + 1]]
                node = node_of(own)[:8]
                if len(own) and node not in seen:
                    seen.add(node)
                    held.append(own)
                    size += len(own)
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def common_shingles(docs: DataFrame, limit: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted hashes) and about how many sets hold each."""
    counts = docs.select("text").mapInArrow(_local_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "token").limit(limit).toArrow()
    token, n = found.column("token").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy()
    turn = np.argsort(token)
    return token[turn], n[turn]


def prefix(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Long prefix, its frequencies, the length of the short one and the rare share (0 to 255) of a set."""
    n = len(own)
    tokens, often = common
    freq = np.zeros(n, np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        freq = np.where(tokens[at] == own, often[at], 0)
    turn = np.lexsort((own, freq))
    long = n - -(-PERCENT * n // 100) + 1
    short = n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1
    return own[turn[:long]], freq[turn[:long]], short, int(255 * (freq == 0).sum() // n)


def group_of(lead: np.ndarray, n: int, rare: int) -> int:
    return rare << 55 | int.from_bytes(hashlib.blake2b(lead.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little") >> 9


def parity_bits(own: np.ndarray) -> bytes:
    """Parity of the set in each of a power of two of classes, about as many as it has shingles."""
    size = max(512, 1 << int(len(own) - 1).bit_length())
    return np.packbits((np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two parity bitmaps differ, the longer folded to the length of the shorter."""
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


@releasing
def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = column(batch, "n").to_numpy() + column(batch, "m").to_numpy()
        most = total - 2 * -(-PERCENT * total // (100 + PERCENT))
        keep = [k for k, (x, y) in enumerate(zip(column(batch, "xa"), column(batch, "xb"), strict=True)) if differing(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= most[k]]
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


@releasing
def _nodes(batches: Iterator[pa.RecordBatch], common: tuple) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text", BLOCK):
            hashes, at = shingle_sets(*utf8(column(block, "text")))
            nodes, groups, bits = [], [], []
            for k in range(block.num_rows):
                own = hashes[at[k] : at[k + 1]]
                nodes.append(node_of(own) if len(own) else None)
                lead, _, _, rare = prefix(own, common) if len(own) else (own, None, 0, 0)
                groups.append(group_of(lead, len(own), rare) if len(own) else None)
                bits.append(parity_bits(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([column(block, "doc_id"), pa.array(np.diff(at)), pa.array(nodes, pa.binary()), pa.array(groups, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "n", "node", "gid", "bits"])


@releasing
def _postings(batches: Iterator[pa.RecordBatch], common: tuple, share: int) -> Iterator[pa.RecordBatch]:
    seen = set()
    for batch in batches:
        for block in blocks(batch, "text", BLOCK):
            hashes, at = shingle_sets(*utf8(column(block, "text")))
            parts = []
            for k in range(block.num_rows):
                own = hashes[at[k] : at[k + 1]]
                if not len(own):
                    continue
                lead, freq, short, rare = prefix(own, common)
                gid = group_of(lead, len(own), rare)
                if gid in seen:
                    continue
                seen.add(gid)
                deals = freq // share + 1
                parts.append((lead, np.full(len(lead), gid), np.arange(len(lead)), np.arange(len(lead)) < short, np.where(deals > 1, 1 + gid % deals, 0)))
            if parts:
                token, gid, pos, short, salt = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(gid), pa.array((salt << 33) | (pos << 1) | short)], names=["token", "gid", "place"])


@releasing
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text", BLOCK):
            hashes, at = shingle_sets(*utf8(column(block, "text")))
            own = [hashes[at[k] : at[k + 1]] for k in range(block.num_rows)]
            want = column(block, "node").to_pylist()
            keep = [k for k in range(block.num_rows) if node_of(own[k]) == want[k]]
            yield pa.RecordBatch.from_arrays([pa.array([want[k] for k in keep], pa.binary()), pa.array([own[k].tobytes() for k in keep], pa.binary())], names=["node", "shingles"])


@releasing
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, out = column(batch, "a").to_pylist(), column(batch, "b").to_pylist(), []
        for k, (x, y) in enumerate(zip(column(batch, "sa"), column(batch, "sb"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                out.append(k)
        yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in out], pa.binary()), pa.array([b[k] for k in out], pa.binary())], names=["a", "b"])


def bloom(ids: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """Bitmap of two hashes of each id; at most ``bits`` / 64 words come to the driver."""
    at = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(bits)) for k in (1, 2)])).alias("at"))
    words = at.groupBy((F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out.view(np.uint64)


@releasing
def _maybe(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = np.ones(batch.num_rows, bool)
        for name in ("h1", "h2"):
            at = column(batch, name).to_numpy().astype(np.uint64)
            hit &= (known[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        yield batch.select(["id", "text"]).filter(pa.array(hit))


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough."""
    sides = pairs.join(nodes.selectExpr("node AS a", "n", "bits AS xa"), "a").join(nodes.selectExpr("node AS b", "n AS m", "bits AS xb"), "b")
    close = materialize(sides.select("a", "b", "n", "m", "xa", "xb").mapInArrow(_alike, "a binary, b binary"), "close")
    wanted = materialize(close.selectExpr("a AS node").unionByName(close.selectExpr("b AS node")).distinct().join(nodes.select("node", "id"), "node"), "wanted")
    known = rows.sparkSession.sparkContext.broadcast(bloom(wanted))
    hashed = rows.select("id", "text", *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(BLOOM_BITS)).alias(f"h{k}") for k in (1, 2)])
    # joined by a shuffle also where one side is small: else both Python steps run in one task, in two workers
    texts = hashed.mapInArrow(lambda it: _maybe(it, known.value), "id long, text string").join(wanted.hint("merge"), "id").select("node", "text")
    sets = materialize(texts.mapInArrow(_sets, "node binary, shingles binary").dropDuplicates(["node"]), "sets")
    left = close.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    found = materialize(both.select("a", "b", "sa", "sb").mapInArrow(_linked, "a binary, b binary"), "verified")
    discard(close, wanted, sets)
    return found


def components(links: DataFrame, names: DataFrame) -> DataFrame:
    """(node, label): the smallest (id, node) that links reach; nodes without links are left out.

    Labels spread over links and jump to the label of their own node, so that rounds grow with the log of the diameter.
    """
    ways = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(ways.select(F.col("a").alias("node")).distinct().join(names, "node").select("node", F.struct("id", "node").alias("label")), "labels")
    while True:
        heard = ways.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"))
        far = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        new = near.withColumn("at", F.col("label.node")).join(far, "at", "left").select("node", F.least("label", "far").alias("label"))
        old, labels = labels, materialize(new, "labels")
        settled = not labels.join(old.withColumnRenamed("label", "was"), "node").where(F.col("label") != F.col("was")).take(1)
        discard(old)
        if settled:
            discard(ways)
            return labels


def fits(n: str, m: str):
    return F.expr(f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})")


def dealt_side(rows: DataFrame, by: str, share: int) -> DataFrame:
    """Rows of a key with ``held`` rows dealt over as many salts as it holds shares."""
    return rows.withColumn("salt", F.expr(f"pmod(hash({by}), cast(held / {share} as int) + 1)"))


def repeated_side(rows: DataFrame, share: int) -> DataFrame:
    """The other side of such a join: each row under all salts of its key."""
    return rows.withColumn("salt", F.explode(F.expr(f"sequence(0, cast(held / {share} as int))")))


def near_duplicates(docs: DataFrame, common_limit: int = COMMON, share: int = SHARE) -> DataFrame:
    """Set size and component of every document."""
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return _near_duplicates(docs, common_limit, share)


def _near_duplicates(docs: DataFrame, common_limit: int, share: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    as_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    known = spark.sparkContext.broadcast(common_shingles(rows, common_limit))
    sized = materialize(rows.mapInArrow(lambda it: _nodes(it, known.value), f"doc_id {kind}, n long, node binary, gid long, bits binary"), "nodes")
    full = sized.where("node is not null").withColumn("id", as_id)
    nodes = materialize(full.groupBy("node", "gid", "n").agg(F.min("id").alias("id"), F.min("bits").alias("bits")), "distinct")
    rows = rows.withColumn("id", as_id)
    names = nodes.select("node", "id")

    posted = rows.select("text").mapInArrow(lambda it: _postings(it, known.value, share), "token long, gid long, place long")
    posted = posted.select("token", "gid", F.expr("place % 2 = 1").alias("short"), F.expr("shiftright(place, 1) & 4294967295").alias("pos"), F.expr("shiftright(place, 33)").alias("salt"))
    key = Window.partitionBy("token", "salt")
    met = posted.withColumn("centre", F.min(F.when(F.col("short"), F.col("gid"))).over(key)).withColumn("most", F.max("gid").over(key)).withColumn("least", F.min("gid").over(key))
    met = materialize(met.where("salt > 0 or (centre is not null and most <> least)").select("token", "gid", "pos", "salt", "centre").distinct(), "met")
    # a key of a dealt shingle that no group has in its short prefix takes the first centre of the shingle, if any
    spare = met.where("salt > 0").groupBy("token").agg(F.min("centre").alias("spare"))
    met = met.join(spare, "token", "left").withColumn("centre", F.coalesce("centre", "spare")).where("centre is not null").drop("spare")

    # first pairs: each group with the centre of its key, centres of one shingle with the first of them, members with their group
    dealt = met.where("salt > 0").select("token", "centre").distinct()
    top = dealt.groupBy("token").agg(F.min("centre").alias("top"))
    stars = met.select("gid", "centre").unionByName(dealt.join(top, "token").select(F.col("centre").alias("gid"), F.col("top").alias("centre"))).where("gid <> centre").distinct()
    groups = nodes.groupBy("gid").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("members"))
    chief = groups.select("gid", F.col("first.node").alias("node"), F.col("first.n").alias("n"))
    across = stars.join(chief.toDF("gid", "a", "n"), "gid").join(chief.toDF("centre", "b", "m"), "centre").where(fits("n", "m")).select("a", "b")
    within = nodes.join(groups.where("members > 1").select("gid", F.col("first.node").alias("b")), "gid").where("node <> b").select(F.col("node").alias("a"), "b")
    first = materialize(across.unionByName(within).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    links = verified(first, nodes, rows)
    labels = components(links, names)

    # the rest: pairs under a shingle, or within a group, that still lie in different components
    placed = nodes.join(labels, "node", "left").select("gid", "node", "n", F.coalesce("label", F.struct("id", "node")).alias("label"))
    members = met.select("token", "gid", "pos").distinct().join(placed, "gid")
    mixed = members.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("held")).where("x <> y").select("token", "held")
    open_ = members.join(mixed, "token")
    left = dealt_side(open_, "node", share).selectExpr("token", "salt", "node AS a", "n", "label", "pos")
    right = repeated_side(open_, share).selectExpr("token", "salt", "node AS b", "n AS m", "label AS other", "pos AS at")
    # similar sets share this much at least, so they meet within what is left of each before it
    shared = f"ceil({PERCENT} * (n + m) / {100 + PERCENT})"
    rest = left.join(right, ["token", "salt"]).where(f"label < other and n - pos >= {shared} and m - at >= {shared}").where(fits("n", "m")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    split = placed.groupBy("gid").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("held")).where("x <> y").select("gid", "held")
    loose = placed.join(split, "gid")
    left, right = dealt_side(loose, "node", share).selectExpr("gid", "salt", "node AS a", "label"), repeated_side(loose, share).selectExpr("gid", "salt", "node AS b", "label AS other")
    inner = left.join(right, ["gid", "salt"]).where("label < other").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = rest.unionByName(inner).distinct().join(first, ["a", "b"], "left_anti")
    more = verified(second, nodes, rows)
    if more.take(1):
        labels = components(links.unionByName(more), names)

    own = full.groupBy("node").agg(F.min("id").alias("own"))
    named = own.join(labels.select("node", F.col("label.id").alias("far")), "node", "left").select("node", F.least("own", "far").alias("component"))
    named = named.withColumn("component", F.when(F.col("component") != NO_ID, F.col("component")))
    return sized.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component").cast(kind)).alias("component_id"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Contract query over every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, columns as they are, whose id names their component: one of each group.

    Rows that share a doc_id stay or go together, but for repeats of a text; rows without an id stay if their group
    has none.
    """
    as_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    name = "kept_id"
    while name in docs.columns:
        name += "_"
    marks = materialize(near_duplicates(docs).withColumn(name, as_id), "marks")
    keep = marks.where("doc_id <=> component_id").select(name).distinct()
    kept = docs.withColumn(name, as_id).join(keep, name, "left_semi")
    if marks.groupBy(name).count().where("count > 1").take(1):
        kept = kept.dropDuplicates([name, "text"])
    return kept.select([F.col(f"`{c}`") for c in docs.columns])
