"""Hidden Markov language model.

A hidden chain of ``STATES`` states emits word classes, and a class emits its words by their smoothed corpus
counts: frequent words are classes of their own (at most ``TOP_WORDS``, all above 1 / TOP_WORDS of the tokens), the
rest are classed by a hash of their last three bytes. Baum-Welch runs over all training texts: every task runs the
scaled forward and backward recursions over its texts, many in step, and sends summed counts of transitions and
emissions, which add up across partitions. Training ends after ``ITERATIONS``, or once an iteration gains less than
``LEAST_GAIN`` of the likelihood. The scaled forward recursion then gives the exact likelihood of each text, its closing
token included.

Texts are read once and cut, where they lie, into chunks of about ``CHUNK_BYTES``: each with a dictionary of its words
and its texts as places in it. One window over the words of all dictionaries gives each its count in the whole corpus,
and texts and counts of a chunk meet again. Words travel as 64-bit hashes. Nothing that grows with the vocabulary reaches
the driver.

Defined results: a null or empty text is its closing token alone. Every row gets a row, repeated rows and null ids
included (a null id is in training). Extra columns are ignored. Without training rows N is 0 and all tokens are unknown.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import blocks, column, discard, materialize, releasing, remainder, table

STATES = 6
#: Iterations at most, each over all training texts, and the share of the likelihood below which a gain ends them.
ITERATIONS = 12
LEAST_GAIN = 1e-5
TOP_WORDS = 1024
ENDINGS = 512
#: Tokens that run in step through the recursions; a longer text runs alone.
STEP_TOKENS = 600_000
#: Bytes of text in a chunk.
CHUNK_BYTES = 12 << 20
#: Steps between two scalings of the forward variables in training: no product of so many probabilities underflows.
SCALED = 8

END = b""  # no word is empty, so the empty string is the closing token


def tokens(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 bytes: both ``lower`` and ``split`` of bytes know ASCII only, as asked."""
    found = (text or b"").lower().split()
    found.append(END)
    return found


def keys_of(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, signed."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def key_of(word: bytes) -> int:
    return int(keys_of([word])[0])


def endings(words: list[bytes]) -> np.ndarray:
    return (np.fromiter(map(zlib.crc32, [w[-3:] for w in words]), np.uint32, len(words)) % ENDINGS).astype(np.int16)


def ending(word: bytes) -> int:
    return int(endings([word])[0])


@releasing
def _cut(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of texts (doc_id, held_out, ids) and of words (place, word, ending, n in training) of each chunk."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__  # a word not seen before takes the next number
    held: list[tuple] = []
    size, chunk = 0, TaskContext.get().partitionId() << 32
    schema = pa.schema([("chunk", pa.int64()), ("doc_id", kind), ("held_out", pa.bool_()), ("ids", pa.binary()), ("place", pa.int32()), ("word", pa.int64()), ("ending", pa.int16()), ("n", pa.int64())])

    def rows(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        columns["chunk"] = np.full(n, chunk)
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def flush() -> Iterator[pa.RecordBatch]:
        counts = np.bincount(np.frombuffer(b"".join(ids for _, held_out, ids in held if not held_out), np.uint32), minlength=len(number))
        for k in range(0, len(held), 1000):
            docs, out, ids = zip(*held[k : k + 1000], strict=True)
            yield rows({"doc_id": docs, "held_out": out, "ids": ids})
        words = list(number)
        for k in range(0, len(words), 50_000):
            part = words[k : k + 50_000]
            yield rows({"place": np.arange(k, k + len(part)), "word": keys_of(part), "ending": endings(part), "n": counts[k : k + len(part)]})

    for batch in batches:
        for block in blocks(batch, "text"):
            for doc, out, text in zip(*(column(block, c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                words = tokens(text)
                held.append((doc, out, np.fromiter(map(number.__getitem__, words), np.uint32, len(words)).tobytes()))
                size += len(text) + 16
                if size >= CHUNK_BYTES:
                    yield from flush()
                    number.clear(), held.clear()
                    size, chunk = 0, chunk + 1
    if held:
        yield from flush()


class Vocabulary:
    """Bounded part of the vocabulary: the numbers N and V, the frequent words and the totals of the classes."""

    def __init__(self, total: int, distinct: int, top: list[int], class_total: np.ndarray, class_words: np.ndarray):
        self.total, self.distinct, self.top = total, distinct, np.array(sorted(top), np.int64)
        self.class_total, self.class_words = class_total, class_words


def count_words(texts: DataFrame) -> tuple[DataFrame, DataFrame, Vocabulary]:
    """Texts as places in the dictionary of their chunk, the corpus counts of each dictionary, and what is bounded."""
    kind = dict(texts.dtypes)["doc_id"]
    arrow = to_arrow_type(texts.schema["doc_id"].dataType)
    cut = materialize(texts.mapInArrow(lambda it: _cut(it, arrow), f"chunk long, doc_id {kind}, held_out boolean, ids binary, place int, word long, ending short, n long"), "chunks")
    total = cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    of = Window.partitionBy("word")
    every = cut.where("word is not null").select("chunk", "place", "word", "ending", F.sum("n").over(of).alias("n"), (F.row_number().over(of.orderBy("chunk")) == 1).alias("first"))
    answers = materialize(every.select("chunk", "place", "ending", "n", F.when(F.col("n") * TOP_WORDS > total, F.col("word")).alias("top"), "first"), "answers")
    sums = answers.where("first and n > 0").groupBy("ending", "top").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()  # fewer than ENDINGS + TOP_WORDS rows, by counting
    top = sorted(r["top"] for r in sums if r["top"] is not None)
    classes, words = np.zeros(ENDINGS + len(top)), np.zeros(ENDINGS + len(top))
    for r in sums:
        at = r["ending"] if r["top"] is None else ENDINGS + top.index(r["top"])
        classes[at] += r["n"]
        words[at] += r["words"]
    return cut, answers, Vocabulary(total, sum(r["words"] for r in sums), top, classes, words)


def _encode(left: pa.Table, right: pa.Table, vocabulary: Vocabulary) -> pa.Table:
    """Texts of a chunk with the counts of its words: class sequences, base score and word part of the model's score."""
    place, top = right.column("place").to_numpy(), right.column("top")
    count, of = np.zeros(len(place)), np.zeros(len(place), np.int64)
    count[place] = right.column("n").to_numpy()
    frequent = top.is_valid().to_numpy()
    of[place] = np.where(frequent, ENDINGS + np.searchsorted(vocabulary.top, top.fill_null(0).to_numpy()), right.column("ending").to_numpy())
    base = np.log10((count + 1) / (vocabulary.total + 1 * (vocabulary.distinct + 1)))
    word_part = np.log10((count + 1) / (vocabulary.class_total[of] + vocabulary.class_words[of] + 1))
    short = of.astype("<u2")
    rows = []
    for raw in left.column("ids"):
        ids = np.frombuffer(raw.as_buffer(), np.uint32)
        rows.append((len(ids), int((count[ids] > 0).sum()), float(base[ids].sum()), float(word_part[ids].sum()), short[ids].tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
    return pa.table([left.column("doc_id"), left.column("held_out"), *(pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "word_score", "classes"])


def encode(cut: DataFrame, answers: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row for each document: lengths, scores of the words, and its class sequence as 16-bit numbers."""
    shared = cut.sparkSession.sparkContext.broadcast(vocabulary)
    texts = cut.where("ids is not null").select("chunk", "doc_id", "held_out", "ids")
    kind = dict(cut.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, word_score double, classes binary"
    words = answers.select("chunk", "place", "ending", "n", "top")
    return texts.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(lambda left, right: _encode(left, right, shared.value), schema)


class Chain:
    """Start, transition and class probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit
        self.room: dict[str, np.ndarray] = {}

    def space(self, name: str, rows: int, n: int) -> np.ndarray:
        """Memory that a task uses again for its next texts: new pages cost more than the arithmetic."""
        if name not in self.room or self.room[name].size < rows * n:
            self.room[name] = np.empty(max(rows * n, rows * STEP_TOKENS))
        return self.room[name][: rows * n].reshape(rows, n)

    def seen(self, name: str, symbols: np.ndarray) -> np.ndarray:
        """Probability of each token's class by state."""
        return np.take(np.ascontiguousarray(self.emit.T), symbols, axis=1, out=self.space(name, len(self.start), len(symbols)), mode="clip")

    def forward(self, sequences: list[np.ndarray], scaled: int = 1) -> tuple[np.ndarray, ...]:
        """Scaled forward variables of texts in step, longest first: alpha by state and token, scale by token (1 but at
        every ``scaled``-th step and at the end), order, offsets by step, classes."""
        size = np.array([len(s) for s in sequences])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        alive = np.searchsorted(-size, -np.arange(size[0]), side="left").tolist()  # texts longer than t
        at = np.concatenate([[0], np.cumsum(alive)])
        symbols = np.empty(at[-1], np.intp)
        for k, text in enumerate(order):
            symbols[at[: size[k]] + k] = sequences[text]
        alpha, scale, back = self.seen("alpha", symbols), self.space("scale", 1, at[-1])[0], np.ascontiguousarray(self.move.T)
        scale[:] = 1
        places, ones = at.tolist(), np.ones(len(self.start))
        last = alpha[:, : places[1]]
        last *= self.start[:, None]
        for t, n in enumerate(alive):
            now = alpha[:, places[t] : places[t + 1]]
            if t:
                now *= back @ last[:, :n]
            if (t + 1) % scaled == 0:
                total = ones @ now
                scale[places[t] : places[t + 1]] = total
                now /= total
            last = now
        if scaled > 1:  # the last token of each text takes what is left
            ends = at[size - 1] + np.arange(len(size))
            total = alpha[:, ends].sum(0)
            scale[ends] *= total
            alpha[:, ends] /= total
        return alpha, scale, order, at, symbols

    def log_likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of each text."""
        _, scale, order, at, _ = self.forward(sequences)
        out, logs = np.zeros(len(sequences)), np.log10(scale)
        for t in range(len(at) - 1):
            out[: at[t + 1] - at[t]] += logs[at[t] : at[t + 1]]
        back = np.empty_like(out)
        back[order] = out
        return back

    def expected(self, sequences: list[np.ndarray], scaled: int = SCALED) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts, transitions and emissions, and the log likelihood."""
        alpha, scale, _, at, symbols = self.forward(sequences, scaled)
        states, places, move = len(self.start), at.tolist(), self.move
        weighted, beta = self.seen("weighted", symbols), self.space("beta", states, len(symbols))
        weighted /= scale
        beta[:] = 1
        for t in range(len(places) - 2, 0, -1):
            ahead = weighted[:, places[t] : places[t + 1]]
            ahead *= beta[:, places[t] : places[t + 1]]
            np.matmul(move, ahead, out=beta[:, places[t - 1] : places[t - 1] + ahead.shape[1]])
        # the token before the k-th text's at step t is the k-th at step t - 1
        width = np.diff(at)
        before = np.arange(at[1], at[-1]) - np.repeat(width[:-1], width[1:])
        moves = np.zeros((states, states))
        for k in range(0, len(before), 16_384):
            part = before[k : k + 16_384]
            moves += np.take(alpha, part, axis=1) @ weighted[:, at[1] + k : at[1] + k + len(part)].T
        alpha *= beta
        emitted = np.stack([np.bincount(symbols, alpha[s], len(self.emit)) for s in range(states)], 1)
        return alpha[:, : at[1]].sum(1), moves * self.move, emitted, float(np.log10(scale[scale != 1]).sum())


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows of similar length together, so that few steps wait for one long text."""
    texts = [np.frombuffer(v.as_buffer(), "<u2").astype(np.int64) for v in column(batch, "classes")]
    order = np.argsort([len(t) for t in texts], kind="stable")
    start, held = 0, 0
    for k, row in enumerate(order):
        if held and held + len(texts[row]) > STEP_TOKENS:
            yield order[start:k], [texts[r] for r in order[start:k]]
            start, held = k, 0
        held += len(texts[row])
    if held:
        yield order[start:], [texts[r] for r in order[start:]]


@releasing
def _expected(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for _, texts in _steps(batch):
            start, moves, emitted, likelihood = chain.expected(texts)
            flat = np.concatenate([start, moves.ravel(), emitted.ravel(), [likelihood]])
            total = flat if total is None else total + flat
    chain.room.clear()
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])


def step(encoded: DataFrame, chain: Chain, share: np.ndarray) -> tuple[Chain, float | None]:
    """One iteration: every partition's expected counts, added up by Spark; the new chain and the old one's likelihood."""
    shared, states = encoded.sparkSession.sparkContext.broadcast(chain), len(chain.start)
    sums = encoded.select("classes").mapInArrow(lambda it: _expected(it, shared.value), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    if not len(sums):
        return chain, None
    flat = sums.sort_values("at")["value"].to_numpy()
    start, moves, emitted = flat[:states] + 0.1, flat[states : states + states**2].reshape(states, states) + 0.1, flat[states + states**2 : -1].reshape(-1, states)
    smoothed = emitted + 0.1 * share[:, None]  # no class is impossible in any state
    return Chain(start / start.sum(), moves / moves.sum(1, keepdims=True), smoothed / smoothed.sum(0)), float(flat[-1])


def baum_welch(encoded: DataFrame, classes: np.ndarray, states: int = STATES, iterations: int = ITERATIONS, seed: int = 7) -> tuple[Chain, list[float]]:
    """Fit the chain on all rows; returns it and the log10 likelihood of all rows before each iteration."""
    rng = np.random.default_rng(seed)
    share = (classes + 1) / (classes + 1).sum()
    noisy = share[:, None] * rng.dirichlet(np.full(states, 0.7), len(classes))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    chain, history = Chain(np.full(states, 1 / states), move, (noisy + 1e-12) / (noisy + 1e-12).sum(0)), []
    for _ in range(iterations):
        chain, likelihood = step(encoded, chain, share)
        history += [] if likelihood is None else [likelihood]
        if len(history) > 1 and history[-1] - history[-2] < LEAST_GAIN * -history[-1]:
            break
    return chain, history


@releasing
def _scored(batches: Iterator[pa.RecordBatch], chain: Chain, total: int) -> Iterator[pa.RecordBatch]:
    keep = ["doc_id", "held_out", "n_tokens", "n_known"]
    for batch in batches:
        if not batch.num_rows:
            continue
        score = column(batch, "word_score").to_numpy().copy()
        for part, texts in _steps(batch):
            score[part] += chain.log_likelihood(texts)
        chain.room.clear()
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(np.full(batch.num_rows, total)), column(batch, "base_score"), pa.array(score)], names=[*keep, "train_tokens", "base_score", "score"])


def score_texts(docs: DataFrame, held_out) -> DataFrame:
    """Train on the rows that are not held out and score every text."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    cut, answers, vocabulary = count_words(rows)
    encoded = materialize(encode(cut, answers, vocabulary), "classes")
    discard(cut, answers)
    chain, _ = baum_welch(encoded.where(~F.col("held_out")), vocabulary.class_total)
    shared = spark.sparkContext.broadcast(chain)
    kind = dict(rows.dtypes)["doc_id"]
    return encoded.mapInArrow(lambda it: _scored(it, shared.value, vocabulary.total), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_markov_lm(spark, sf_dir: str) -> DataFrame:
    """Contract query: learn where crc32(doc_id) mod 7 is not 2, score every document."""
    return score_texts(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)
