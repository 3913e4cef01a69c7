"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns the words of a clause into tags with weights: insults (words, stems and phrases), verbs of
harm, targets, negations, verbs of report, signs of intent. Five small transducers read the tags: one accepts insults and
marks those that pile up, one accepts a verb of harm only together with its target, and one each marks what follows a
target, a negation (within a few words), a verb of report or a sign of intent. Their composition, a product machine built
once, has arcs that accept nothing or an insult or threat with its marks; such an arc weighs what the lexical transducer
gave, times a gain for each mark. A clause is matched if its path weighs ``ACCEPTED`` or more; other clauses count for
nothing.

The insult lexicon (words and stems with their log odds), the gains of the marks (with the values of ``PRIOR`` as prior)
and the calibration of matched clauses to a probability are learned from a bounded sample of labelled rows.

Defined results: a null or empty text has the score of a text in which nothing matched. Every row gets a row,
repeated rows and null ids included (a null id is in training). Extra columns are ignored. Of entries that weigh the
same the whole word counts. Without labels of both kinds the fixed seed lexicon and the prior gains score alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, column, discard, materialize, releasing, remainder, table

#: Documented bounds: labelled rows used for learning, entries of the learned lexicon, words whose tag a worker keeps.
SAMPLE_ROWS = 12_000
MAX_ENTRIES = 3_000
KEPT_WORDS = 200_000
#: Rows of each label that must stand apart from the lexicon's rows, else all rows serve both.
LEAST_OF_A_KIND = 20
#: Weight from which a clause is matched, and that of a verb of harm.
ACCEPTED = 1.0
HARM_WEIGHT = 3.0

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]")
ENDS = ".!?;:\n"
STEM_LENGTHS = range(4, 9)
JOIN = "\u02b9"  # a letter that no word of these languages has joins the words of a phrase

INSULT, HARM, TARGET, NEGATION, REPORT, INTENT, OTHER, END = range(8)
TAGS = range(END)

# Closed word classes of the four languages, seed insults and phrases.
SEED_INSULTS = ("idiot", "moron", "imbecile", "scumbag", "idiota", "imbécile", "dummkopf")
PHRASES = ("piece of garbage", "piece of trash", "waste of space", "shut up", "go to hell", "good for nothing", "va te faire", "ferme la", "halt die klappe", "fahr zur hölle", "hijo de puta", "vete al infierno")
HARMS = ("kill", "hurt", "destroy", "strangle", "murder", "tuer", "frapper", "töten", "umbringen", "matar", "golpear")
TARGETS = ("you", "your", "yours", "u", "ya", "they", "them", "toi", "tu", "vous", "du", "dich", "ihr", "euch", "tú", "te", "usted", "ustedes", "vosotros")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "don't", "won't", "pas", "jamais", "nicht", "kein", "keine", "nie", "nunca", "jamás")
REPORTS = ("said", "says", "wrote", "claimed", "quoted", "reported", "dit", "écrit", "sagte", "schrieb", "dijo", "escribió")
INTENTS = ("will", "gonna", "should", "must", "deserve", "vais", "dois", "werde", "sollte", "voy", "debes")
CLASSES = {w: tag for tag, members in ((HARM, HARMS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INTENT, INTENTS)) for w in members}

MARKS = ("threat", "piled", "targeted", "negated", "reported", "intended")
#: Logarithms of the gains of the marks before anything is learned, and how many rows that knowledge is worth.
PRIOR = np.log([1.0, 1.1, 1.3, 0.3, 0.5, 1.5])
PRIOR_ROWS = 8.0


@dataclass(frozen=True)
class Transducer:
    """Deterministic machine over tags: next states, and what an arc marks or accepts. Missing arcs stay and mark nothing;
    the tag ``None`` stands for all others of a state."""

    moves: dict[tuple[int, int | None], int]
    marks: dict[tuple[int, int | None], frozenset[str]]

    def step(self, state: int, tag: int) -> tuple[int, frozenset[str]]:
        none = frozenset()
        return self.moves.get((state, tag), self.moves.get((state, None), state)), self.marks.get((state, tag), self.marks.get((state, None), none))


def compose(*machines: Transducer) -> Transducer:
    """Product machine: all read the same tags, their marks unite. Only reachable states are numbered."""
    numbers = {(0,) * len(machines): 0}
    queue, moves, marks = list(numbers), {}, {}
    while queue:
        state = queue.pop()
        for tag in TAGS:
            steps = [m.step(s, tag) for m, s in zip(machines, state, strict=True)]
            after = tuple(s for s, _ in steps)
            if after not in numbers:
                numbers[after] = len(numbers)
                queue.append(after)
            moves[numbers[state], tag] = numbers[after]
            marks[numbers[state], tag] = frozenset().union(*(m for _, m in steps))
    return Transducer(moves, marks)


def insults() -> Transducer:
    """Accepts insults; from the second in a clause on they pile up."""
    return Transducer({(0, INSULT): 1}, {(0, INSULT): frozenset({"accepted"}), (1, INSULT): frozenset({"accepted", "piled"})})


def threats() -> Transducer:
    """Accepts a verb of harm where its target came before it, or when the target comes."""
    threat = frozenset({"accepted", "threat"})
    return Transducer({(0, TARGET): 1, (0, HARM): 2, (2, TARGET): 1}, {(1, HARM): threat, (2, TARGET): threat})


def after(tag: int, mark: str) -> Transducer:
    """Marks everything behind the first such tag of the clause."""
    return Transducer({(0, tag): 1}, {(1, None): frozenset({mark})})


def negation(reach: int = 3) -> Transducer:
    """Marks the next ``reach`` words behind a negation."""
    moves = {(s, NEGATION): reach for s in range(reach + 1)} | {(s, None): s - 1 for s in range(1, reach + 1)}
    return Transducer(moves, {(s, None): frozenset({"negated"}) for s in range(1, reach + 1)})


def whole_grammar() -> Transducer:
    return compose(insults(), threats(), after(TARGET, "targeted"), negation(), after(REPORT, "reported"), after(INTENT, "intended"))


class WordTags(dict):
    """The lexical transducer: tag and weight of each token, found on demand."""

    def __init__(self, grammar: Grammar):
        self.words, self.stems = grammar.words, grammar.stems

    def __missing__(self, word: str) -> tuple[int, float]:
        if word in ENDS:
            out = END, 0.0
        elif (weight := max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEM_LENGTHS if n < len(word))])) > 0:
            out = INSULT, weight
        else:
            tag = CLASSES.get(word, OTHER)
            out = tag, HARM_WEIGHT if tag == HARM else 0.0
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = out
        return out


@dataclass
class Grammar:
    """Lexicon of insults (``words`` whole, ``stems`` with at least one more letter), product machine, gains, calibration."""

    words: dict[str, float]
    stems: dict[str, float]
    machine: Transducer = field(default_factory=whole_grammar)
    gains: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    accepted: float = ACCEPTED
    mean: np.ndarray = field(default_factory=lambda: np.zeros(4))
    scale: np.ndarray = field(default_factory=lambda: np.ones(4))
    beta: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.5, 0.5, 0.5, 0.0]))

    def __post_init__(self):
        self.arcs = sorted({m - {"accepted"} for m in self.machine.marks.values() if "accepted" in m}, key=sorted)
        number = {a: k for k, a in enumerate(self.arcs)}
        self.marked = np.array([[m in a for m in MARKS] for a in self.arcs], float).reshape(-1, len(MARKS))
        states = 1 + max(s for s, _ in self.machine.moves)
        self.moves = [[self.machine.moves[s, t] for t in TAGS] for s in range(states)]
        self.found = [[number[m - {"accepted"}] if "accepted" in (m := self.machine.marks[s, t]) else None for t in TAGS] for s in range(states)]
        self.tags = WordTags(self)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def clauses(self, text: str) -> tuple[int, list[list[tuple[int, float]]]]:
        """Number of tokens, and for each clause with any the accepted arcs and their lexical weights."""
        low = text.lower()
        for phrase in PHRASES:
            if phrase in low:
                low = low.replace(phrase, phrase.replace(" ", JOIN))
        words = TOKEN.findall(low)
        tags = [self.tags[w] for w in words]
        out: list[list[tuple[int, float]]] = []
        if any(t <= HARM for t, _ in tags):
            state, held, here = 0, 0.0, []
            for tag, weight in tags:
                if tag == END:
                    if here:
                        out.append(here)
                    state, held, here = 0, 0.0, []
                    continue
                arc = self.found[state][tag]
                if tag == HARM:
                    held = weight
                if arc is not None:
                    here.append((arc, weight or held))
                state = self.moves[state][tag]
            if here:
                out.append(here)
        return len(words) + 1, out

    def weigh(self, clause: list[tuple[int, float]]) -> float:
        """Weight of a clause's path; 0 if it is not matched."""
        gains = np.exp(self.marked @ self.gains)
        total = sum(gains[arc] * weight for arc, weight in clause)
        return float(total) if total >= self.accepted else 0.0

    def arc_weights(self, text: str) -> np.ndarray:
        """Lexical weight that each kind of arc accepted, and the logarithm of the length."""
        length, found = self.clauses(text)
        out = np.zeros(len(self.arcs) + 1)
        for clause in found:
            for arc, weight in clause:
                out[arc] += weight
        out[-1] = np.log(length)
        return out

    def features(self, text: str) -> tuple[float, float, float, float]:
        """Sum, largest and density of the matched clauses' weights, and the log of the length."""
        length, found = self.clauses(text)
        scores = [w for c in found if (w := self.weigh(c)) > 0]
        total = sum(scores)
        return np.log1p(total), max(scores, default=0.0), total / np.sqrt(length), np.log(length)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.beta[0] + ((features - self.mean) / self.scale) @ self.beta[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn_gains(arcs: np.ndarray, marked: np.ndarray, length: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log gains of the marks under which the arcs' weights explain the labels best, drawn to the prior.

    The log odds of a row are linear in log(1 + gains . weights) and the log of its length; found by Adam.
    """
    gains, line = PRIOR.copy(), np.array([-2.0, 1.0, 0.0])
    long = (length - length.mean()) / max(length.std(), 1e-6)
    first, second = np.zeros(9), np.zeros(9)
    for turn in range(1, 401):
        each = np.exp(marked @ gains)
        sums = arcs @ each
        x = np.log1p(sums)
        p = 1 / (1 + np.exp(-np.clip(line[0] + line[1] * x + line[2] * long, -30, 30)))
        off = p - toxic
        by_mark = (arcs * each) @ marked / (1 + sums)[:, None]
        slope = np.concatenate([line[1] * off @ by_mark + PRIOR_ROWS * (gains - PRIOR), [off.sum() + 0.05 * line[0], off @ x + 0.05 * line[1], off @ long + 0.05 * line[2]]])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = 0.03 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
        gains, line = gains - move[:6], line - move[6:]
    return gains


def fit_line(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Penalised logistic regression by Newton's method; a step that does not help is halved, so separable rows are no danger."""

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * b @ b)

    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return beta


@releasing
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the least hash of three words in a row, which copies of a text share."""
    for batch in batches:
        for block in blocks(batch, "text"):
            least = []
            for text in column(block, "text").to_pylist():
                words = [w.encode() for w in WORD.findall((text or "").lower())]
                least.append(min((zlib.crc32(c, zlib.crc32(b, zlib.crc32(a))) for a, b, c in zip(words, words[1:], words[2:], strict=False)), default=zlib.crc32(b" ".join(words))))
            yield pa.RecordBatch.from_arrays([*(column(block, c) for c in ("doc_id", "text", "toxic")), pa.array(least, pa.int64())], names=["doc_id", "text", "toxic", "copy"])


@releasing
def _entry_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(column(batch, "text").to_pylist(), column(batch, "toxic").to_pylist(), strict=True):
            words = set(WORD.findall((text or "").lower()))
            counts[toxic].update({w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n} | words)
    for toxic, found in counts.items():
        names = list(found)
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic] * len(part), pa.int32()), pa.array([found[w] for w in part], pa.int64())], names=["entry", "toxic", "docs"])


@releasing
def _features(batches: Iterator[pa.RecordBatch], grammar: Grammar, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text"):
            rows = np.array([grammar.features(t or "") for t in column(block, "text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(column(block, k) for k in keep), *(pa.array(rows[:, i]) for i in range(4))], names=[*keep, "f0", "f1", "f2", "f3"])


@releasing
def _arc_weights(batches: Iterator[pa.RecordBatch], grammar: Grammar) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text"):
            rows = [grammar.arc_weights(t or "") for t in column(block, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(block, "toxic"), pa.array(list(rows), pa.list_(pa.float64()))], names=["toxic", "weights"])


def train(labelled: DataFrame, sample: int = SAMPLE_ROWS, max_entries: int = MAX_ENTRIES) -> Grammar:
    """Fit lexicon, gains and calibration on about ``sample`` rows (doc_id, text, toxic), chosen by a hash of the id.

    Copies of a text count once. Three rows in four make the lexicon, the others gains and calibration: there the lexicon
    finds by chance no more than in texts to come. If they are not of both kinds, all rows serve both.
    """
    rows = labelled.where("toxic in (0, 1)")
    size = rows.count()
    seeds = Grammar({w: 3.0 for w in (*SEED_INSULTS, *(p.replace(" ", JOIN) for p in PHRASES))}, {})
    if not size:
        return seeds
    spread = (F.xxhash64(F.col("doc_id"), F.lit(29)) % 1_000_000 + 1_000_000) % 1_000_000 / 1e6
    drawn = rows.where(spread < min(1.0, sample / size)).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    kind = dict(drawn.dtypes)["doc_id"]
    signed = drawn.mapInArrow(_signed, f"doc_id {kind}, text string, toxic int, copy long").dropDuplicates(["copy", "toxic"])
    chosen = materialize(signed.select("text", "toxic", (F.pmod(F.xxhash64("copy", F.lit(37)), F.lit(4)) == 0).alias("apart")), "labelled")
    n = {(r["apart"], r["toxic"]): r["count"] for r in chosen.groupBy("apart", "toxic").count().collect()}
    if not all(n.get((False, t), 0) + n.get((True, t), 0) for t in (0, 1)):
        return seeds
    learned, judged = chosen.where("not apart"), chosen.where("apart")
    if min(n.get((a, t), 0) for a in (False, True) for t in (0, 1)) < LEAST_OF_A_KIND:
        learned = judged = chosen
    count = {r["toxic"]: r["count"] for r in learned.groupBy("toxic").count().collect()}
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / (count[1] + 1)) - F.log(c / (count[0] + 1))
    entries = (
        learned.mapInArrow(_entry_counts, "entry string, toxic int, docs long")
        .groupBy("entry")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("docs")).otherwise(0)).alias("c"))
        .where("t >= 4")
        .withColumn("odds", odds)
        .where(F.col("odds") - F.sqrt(1 / t + 1 / c) > 1.2)
        .orderBy(F.desc(F.col("odds") * F.sqrt("t")), "entry")
        .limit(max_entries)
        .collect()
    )
    grammar = Grammar(seeds.words | {r["entry"]: r["odds"] for r in entries if not r["entry"].endswith("*")}, {r["entry"][:-1]: r["odds"] for r in entries if r["entry"].endswith("*")})
    arcs = judged.mapInArrow(lambda it: _arc_weights(it, grammar), "toxic int, weights array<double>").toPandas()
    weights = np.stack(arcs["weights"].to_numpy())
    grammar.gains = learn_gains(weights[:, :-1], grammar.marked, weights[:, -1], arcs["toxic"].to_numpy(float))
    found = judged.mapInArrow(lambda it: _features(it, grammar, ["toxic"]), "toxic int, f0 double, f1 double, f2 double, f3 double").toPandas()
    x, y = found[["f0", "f1", "f2", "f3"]].to_numpy(), found["toxic"].to_numpy(float)
    grammar.mean, grammar.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    grammar.beta = fit_line(np.column_stack([np.ones(len(x)), (x - grammar.mean) / grammar.scale]), y)
    discard(chosen)
    return grammar


def _scores(batches: Iterator[pa.RecordBatch], grammar: Grammar) -> Iterator[pa.RecordBatch]:
    for part in _features(batches, grammar, ["doc_id", "held_out"]):
        x = np.column_stack([column(part, f"f{i}").to_numpy() for i in range(4)])
        score = grammar.score(x)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def predict(docs: DataFrame, grammar: Grammar, held_out) -> DataFrame:
    """Score of every whole text; only the text is read for it."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(lambda it: _scores(it, shared.value), f"doc_id {kind}, held_out boolean, score double, predicted int")


def train_on(docs: DataFrame, labels: DataFrame) -> Grammar:
    """The contract's fold: rows whose crc32(doc_id) mod 5 is not 0."""
    judged = labels.select("doc_id", "toxic").where(~F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)))
    # the bounded sample is drawn from the labels before they meet the texts
    size = judged.where("toxic in (0, 1)").count()
    spread = (F.xxhash64(F.col("doc_id"), F.lit(31)) % 1_000_000 + 1_000_000) % 1_000_000 / 1e6
    judged = judged.where("toxic in (0, 1)").where(spread < (min(1.0, SAMPLE_ROWS / size) if size else 1.0))
    return train(docs.select("doc_id", "text").join(F.broadcast(judged), "doc_id"), SAMPLE_ROWS)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: learn where crc32(doc_id) mod 5 is not 0, score every document."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train_on(docs, table(spark, sf_dir, "labels")), remainder(F.col("doc_id"), 5) == 0)


def reject(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """The documents, columns as they are, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                found = np.array([shared.value.features(t or "") for t in column(block, "text").to_pylist()])
                yield block.filter(pa.array(shared.value.score(found) < threshold))

    return docs.mapInArrow(run, docs.schema)
