"""Secret scan by a linear-chain conditional random field over base patterns.

Three fixed patterns give base spans. The CRF tags tokens as begin, inside or outside of a secret from their shape, the
neighbouring words and features of the file; Viterbi decodes. Spans of the CRF that overlap no base span are added as
kind ``crf``.

It is trained without labels of people, by distant supervision on a bounded sample of documents: base spans are tags;
and since they all look alike, texts that hold one are also copied with a value of another alphabet and length put at
another place, behind an ordinary word or a word such as ``bearer`` in place of the keyword, and with decoys
(identifiers, paths, addresses, dates, numbers made of the text's own words) that are outside. The copies are drawn from
a generator seeded by the text, so that a retried task makes the same ones.

A blob is a run of eight or more characters without white space, quotes, brackets, commas. Blobs that are one plain
word are outside by constraint, unless a word such as ``credential`` and a colon or equals sign stand before them; so are
shorter ones. Tokens outside by constraint part a text into short independent chains around its odd blobs, each decoded
exactly, and still count as the neighbours of others.

Defined results: a null or empty text has no spans. Every row gets a row, repeated rows and null ids included.
Extra columns are ignored. With no base span in the sample the CRF adds nothing.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, column, discard, materialize, releasing, table

#: Documented bounds: documents in the training sample, chains that reach the driver, and tokens of a training chain
#: (a longer one trains as pieces of that length).
SAMPLE_DOCS = 4_000
SAMPLE_CHAINS = 20_000
CHAIN_TOKENS = 32
#: Copies with a planted value, and as many with a decoy, of a text that holds base spans (more if the sample has few such
#: texts, so that there are about ``PLANTED`` in all, but at most ``MOST_COPIES`` of a text); other texts get one decoy.
COPIES = 6
MOST_COPIES = 100
PLANTED = 2_000
#: Steps of the fit, fewer once ``STEADY`` of them have not gained ``GAIN`` of the likelihood.
EPOCHS, STEADY, GAIN = 120, 5, 1e-3

# The base patterns, in the order in which equal starts sort.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

BLOB = re.compile(r"[^\s\"'`<>()\[\]{},;]{8,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
EDGE = ".!?:-_=*#|&"
KEYISH = re.compile(r"(?i)\b(?:pass(?:word|wd|phrase|code)?|secrets?|token|auth\w*|cred\w*|bearer|key|\w*[_-]key|\w*[_-]token)\b")
KEYISH_PARTS = ("pass", "secret", "token", "auth", "cred", "bearer", "key")
LED = re.compile(r"(?i)(?:pass(?:word|wd|phrase|code)?|secret|token|auth\w*|cred\w*|bearer|key)[\"']?\x20?[:=]\x20?[\"']?$")
WORD_BEFORE = re.compile(r"(\w+)(\W{0,6})$")
WORD_AFTER = re.compile(r"^\W{0,6}(\w+)")
LETTER_RUN = re.compile(r"[A-Za-z]+")
NUMERIC = re.compile(r"[0-9.:/+TZ-]+")
WORDY = re.compile(r"[A-Za-z]?[a-z]*(?:[._/=-]+[A-Za-z]?[a-z]+|[A-Z][a-z]+)+[0-9]{0,4}")
HEX_ONLY = re.compile(r"[0-9a-f]+")
GROUPED = re.compile(r"[0-9a-fA-F]{4,8}(?:-[0-9a-fA-F]{4,12})+")
CLASSES = str.maketrans({c: "a" for c in "abcdefghijklmnopqrstuvwxyz"} | {c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: "9" for c in "0123456789"})

B, I, O = 0, 1, 2
HASHED = 24  # buckets of the words before and after
LENGTHS, SHARES, TURNS, RUNS = (4, 8, 12, 16, 20, 24, 32, 48), (0.001, 0.1, 0.25, 0.4, 0.6, 0.999), (0.1, 0.2, 0.3, 0.45, 0.6), (3, 5, 7, 10, 14)
N_FEATURES = 29 + len(LENGTHS) + 3 * len(SHARES) + len(TURNS) + len(RUNS) + 6 + 2 * HASHED


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns by start, then kind 0 assign, 1 access, 2 hex."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def plain(blob: str) -> bool:
    """Whether a blob is one word in a usual case."""
    core = blob.strip(EDGE)
    return core.isalpha() and (core.islower() or core[1:].islower() or core.isupper())


def chains(text: str) -> list[list[tuple[int, int, int, int]]]:
    """Runs of odd blobs with no more than two characters between neighbours: (begin, end, blob begin, blob end) of tokens."""
    runs: list[list[tuple[int, int, int, int]]] = []
    for m in BLOB.finditer(text):
        if plain(m[0]) and not LED.search(text, max(0, m.start() - 24), m.start()):
            continue
        tokens = []
        for t in TOKEN.finditer(m[0]):
            end = len(t[0].rstrip(".-")) + t.start()
            if end > t.start():
                tokens.append((m.start() + t.start(), m.start() + end, m.start(), m.end()))
        if tokens:
            if runs and m.start() - runs[-1][-1][3] <= 2:
                runs[-1] += tokens
            else:
                runs.append(tokens)
    return runs


def file_features(text: str, runs: list, base: list) -> list[bool]:
    """The same for all tokens of a text: how many of its words are odd, and whether it holds base spans or key-like words."""
    share = sum(map(len, runs)) / (text.count(" ") + 1)
    low = text.lower()
    keyish = any(k in low for k in KEYISH_PARTS) and KEYISH.search(text)
    return [share > 0.003, share > 0.01, share > 0.05, share > 0.25, bool(base), bool(keyish)]


def one_of(value: float, cuts: tuple) -> list[bool]:
    k = bisect_right(cuts, value) - 1
    return [j == k for j in range(len(cuts))]


def features(text: str, chain: list[tuple[int, int, int, int]], of_file: list[bool]) -> np.ndarray:
    """One binary row for each token: bias, shape, place in its blob, neighbouring words, file."""
    rows = np.zeros((len(chain), N_FEATURES), np.uint8)
    for row, (begin, end, first, last) in zip(rows, chain, strict=True):
        token, blob, n = text[begin:end], text[first:last], end - begin
        kinds = token.translate(CLASSES)
        low, up, digits = kinds.count("a"), kinds.count("A"), kinds.count("9")
        runs = LETTER_RUN.findall(token)
        before = WORD_BEFORE.search(text, max(0, begin - 40), begin)
        after = WORD_AFTER.search(text[end : end + 40])
        previous, gap = (before[1].lower(), before[2]) if before else ("", "")
        following = after[1].lower() if after else ""
        turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n
        distinct = len(set(token)) / min(n, 32)
        flags = [
            True, n == digits, not digits and not up, not digits and bool(up and low), bool(low and up and digits), bool(low and digits and not up), bool(up and digits and not low),
            bool(NUMERIC.fullmatch(token)), bool(WORDY.fullmatch(token)), distinct > 0.3, distinct > 0.5, distinct > 0.7,
            any(c in token for c in "+="), "_" in token, "-" in token, "/" in token, token.count(".") == 1, token.count(".") > 1,
            "@" in blob, "://" in blob, begin == first, any(c in gap for c in ":="), any(c in gap for c in "\"'`"), bool(KEYISH.fullmatch(previous)),
            n >= 16 and 0.1 < digits / n < 0.9, n >= 16 and turns > 0.3, n >= 16 and bool(HEX_ONLY.fullmatch(token)), n >= 14 and digits > 1 and up + digits == n, bool(GROUPED.fullmatch(token)),
        ]
        hashed = [zlib.crc32(previous.encode()) % HASHED == k for k in range(HASHED)] + [zlib.crc32(following.encode()) % HASHED == k for k in range(HASHED)]
        row[:] = flags + one_of(n, LENGTHS) + one_of(digits / n, SHARES) + one_of(up / n, SHARES) + one_of(low / n, SHARES) + one_of(turns, TURNS) + one_of(max(map(len, runs), default=0), RUNS) + of_file + hashed
    return rows


LOWER_CASE, UPPER_CASE, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (DIGITS + "abcdef", DIGITS + LOWER_CASE + UPPER_CASE, UPPER_CASE + "234567", DIGITS + LOWER_CASE, DIGITS + UPPER_CASE, DIGITS + LOWER_CASE + UPPER_CASE + "+/", DIGITS + LOWER_CASE + UPPER_CASE + "-_")


def planted_value(rng: random.Random) -> str:
    """A value of a random alphabet, length and layout."""
    draw = lambda letters, n: "".join(rng.choices(letters, k=n))
    kind = rng.randrange(8)
    if kind == 0:
        return draw(LOWER_CASE, rng.randint(2, 5)) + rng.choice("_-") + draw(ALPHABETS[1], rng.randint(16, 44))
    if kind == 1:
        return draw(UPPER_CASE, 4) + draw(ALPHABETS[4], rng.randint(12, 24))
    if kind == 2:
        return ".".join(draw(ALPHABETS[6], rng.randint(10, 40)) for _ in range(3))
    if kind == 3:  # parted by other signs
        return "".join(draw(ALPHABETS[1], rng.randint(4, 8)) + rng.choice("!#$%^&*~") for _ in range(rng.randint(2, 4))) + draw(ALPHABETS[1], 5)
    if kind == 4:
        return draw(ALPHABETS[0], rng.randint(18, 31))
    return draw(rng.choice(ALPHABETS), rng.randint(18, 64)) + rng.choice(["", "", "=", "=="]) * (kind == 5)


def decoy(rng: random.Random, word) -> str:
    """What looks odd and is no secret, made of the text's own words."""
    digits = lambda n: "".join(rng.choices(DIGITS, k=n))
    w = [word() for _ in range(4)]
    return rng.choice([
        w[0] + w[1].capitalize() + w[2].capitalize(), w[0].capitalize() + w[1].capitalize(), "_".join(w[:3]), "-".join(w[:3]), "_".join(w[:2]).upper(), "/" + "/".join(w) + ".txt",
        f"https://{w[0]}.{w[1]}.com/{w[2]}?id={digits(6)}", f"{w[0]}.{w[1]}{digits(2)}@{w[2]}.org", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}T1{digits(1)}:2{digits(1)}:00Z",
        f"v{digits(1)}.{digits(2)}.{digits(3)}", digits(rng.randint(8, 19)), f"+{digits(2)}-{digits(3)}-{digits(7)}", f"{digits(3)}.{digits(2)}.{digits(3)}.{digits(2)}", w[0] + w[1] + digits(rng.randint(1, 4)),
        f"{w[0]}/{w[1]}", f"{w[0]}.{w[1]}.{w[2]}", f"{w[0]}={digits(3)}", f"({w[0]}){w[1]}{w[2]}", "-".join([digits(3), digits(1), digits(5), digits(3)]), "-".join("".join(rng.choices(ALPHABETS[0], k=n)) for n in (8, 4, 4, 4, 12)), f"http://www.{w[0]}{w[1]}.net/{w[2]}/{digits(5)}", f"https://{w[0]}.{w[1]}.com/{w[2]}/{w[3]}-{digits(3)}", w[0] + "..." + w[1], f"{digits(1)},{digits(3)}.{digits(2)}", w[0].upper() + "-" + digits(4),
        "".join(w[:3]).capitalize() + w[3].upper(), w[0] + "_" + digits(3) + "_" + w[1],
    ])


def copies(text: str, base: list, of_file: list[bool], times: int = COPIES) -> Iterator[tuple[str, list[tuple[int, int]], list[bool]]]:
    """Pieces of the text with a planted value (and its span) or a decoy (none), most as if of a file without base spans."""
    rng = random.Random(zlib.crc32(text.encode("utf8", "replace")))
    cuts = [m.end() for m in re.finditer(r"\s", text)] or [0]
    words = [w for w in re.findall(r"[A-Za-z]{2,}", text) if not KEYISH.fullmatch(w)] or ["word"]
    word = lambda: rng.choice(words).lower()
    for turn in range(2 * times if base else 1):
        at = rng.choice(cuts)
        left, right = text[max(0, at - 60) : at], text[at : at + 60]
        if base_spans(left + " " + right):
            left, right = word() + " ", " " + word()
        secret = base and turn % 2
        value = planted_value(rng) if secret else decoy(rng, word)
        lead, close = rng.choice([("", "")] * 8 + [(word() + " ", ""), (f'{word()} = "', '"'), (word() + ": ", ""), (word() + "=", ""), ("(", ")"), ('"', '"')] + [("bearer ", ""), ("Bearer ", ""), ('credential = "', '"'), ("key: ", "")] * bool(secret))
        begin = len(left) + len(lead)
        yield f"{left}{lead}{value}{close} {right}", [(begin, begin + len(value))] if secret else [], of_file if rng.random() < 0.2 else [*of_file[:-2], False, False]


def viterbi(emit: np.ndarray, move: np.ndarray) -> list[int]:
    """Best tags; a chain starts as if after an outside token."""
    score, back = emit[0] + move[O], []
    for e in emit[1:]:
        step = score[:, None] + move
        back.append(step.argmax(0))
        score = step.max(0) + e
    tags = [int(score.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(samples: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Conditional maximum likelihood by Adam; chains of equal length are run together."""
    weight, move = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    move[O, I] = -20.0  # inside never follows outside
    by_length: dict[int, list[int]] = {}
    for k, (x, _) in enumerate(samples):
        by_length.setdefault(len(x), []).append(k)
    packed = [(np.stack([samples[k][0] for k in ks]), np.stack([samples[k][1] for k in ks])) for ks in by_length.values()]
    first = [np.zeros_like(weight), np.zeros_like(move)]
    second = [np.zeros_like(weight), np.zeros_like(move)]
    reached, waited = -np.inf, 0
    for epoch in range(1, EPOCHS + 1):
        slopes, likelihood = [-0.002 * weight * len(samples) / 100, -0.01 * move], 0.0
        for x, y in packed:
            emit = x @ weight
            n, length = y.shape
            ahead = [emit[:, 0] + move[O]]
            for t in range(1, length):
                ahead.append(log_sum(ahead[-1][:, :, None] + move, 1) + emit[:, t])
            behind = [np.zeros((n, 3))]
            for t in range(length - 1, 0, -1):
                behind.append(log_sum(move + (emit[:, t] + behind[-1])[:, None, :], 2))
            behind = behind[::-1]
            total = log_sum(ahead[-1], 1)
            gold = np.eye(3)[y]
            likelihood += (emit * gold).sum() + move[O, y[:, 0]].sum() + move[y[:, :-1], y[:, 1:]].sum() - total.sum()
            for t in range(length):
                p = np.exp(ahead[t] + behind[t] - total[:, None])
                slopes[0] = slopes[0] + x[:, t].T @ (gold[:, t] - p)
                if t:
                    pair = np.exp(ahead[t - 1][:, :, None] + move + (emit[:, t] + behind[t])[:, None, :] - total[:, None, None])
                    slopes[1] = slopes[1] + np.einsum("ni,nj->ij", gold[:, t - 1], gold[:, t]) - pair.sum(0)
        for k, value in enumerate((weight, move)):
            slope = slopes[k] / max(1, len(samples))
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope**2
            value += 0.15 * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.99**epoch)) + 1e-8)
        move[O, I] = -20.0
        waited = 0 if likelihood > reached + GAIN * abs(reached) or epoch == 1 else waited + 1
        reached = max(reached, likelihood)
        if waited == STEADY:
            break
    return weight, move


def tags_of(run: list[tuple[int, int, int, int]], found: list[tuple[int, int]]) -> list[int]:
    tags, last = [], None
    for begin, end, _, _ in run:
        inside = next((s for s in found if s[0] < end and begin < s[1]), None)
        tags.append(O if inside is None else I if inside is last else B)
        last = inside
    return tags


@releasing
def _training_chains(batches: Iterator[pa.RecordBatch], times: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text", 1 << 20):
            rows, tags = [], []
            for text in column(block, "text").to_pylist():
                text = text or ""
                base, runs = base_spans(text), chains(text)
                of_file = file_features(text, runs, base)
                cases = [(text, runs, [(s, e) for s, _, e in base], of_file)]
                cases += [(piece, chains(piece), found, of_copy) for piece, found, of_copy in copies(text, base, of_file, times)]
                for piece, its_runs, found, of_case in cases:
                    for run in its_runs:
                        for k in range(0, len(run), CHAIN_TOKENS):
                            part = run[k : k + CHAIN_TOKENS]
                            rows.append(features(piece, part, of_case).tobytes())
                            tags.append(bytes(tags_of(part, found)))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(tags, pa.binary())], names=["x", "y"])


def train(docs: DataFrame, sample: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from about ``sample`` documents chosen by a hash of the id.

    Half of them are drawn among documents that hold a keyword or many hexadecimal digits, since secrets are rare.
    """
    hint = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}")
    rows = docs.select("doc_id", "text").where("text is not null")
    n = rows.select(F.count("*").alias("all")).first()["all"]
    nothing = np.zeros((N_FEATURES, 3)), np.array([[0, 0, 0], [0, 0, 0], [-20.0, -20.0, 0]])
    if not n:
        return nothing
    spread = (F.xxhash64(F.col("doc_id"), F.lit(41)) % 1_000_000 + 1_000_000) % 1_000_000 / 1e6
    wide = rows.where(spread < min(1.0, 8 * sample / n))
    chosen = materialize(wide.where((spread < min(1.0, sample / 2 / n)) | hint).select("text", hint.alias("hint")), "sample")
    times = min(MOST_COPIES, max(COPIES, PLANTED // max(1, chosen.where("hint").count())))
    found = materialize(chosen.select("text").mapInArrow(lambda it: _training_chains(it, times), "x binary, y binary"), "chains")
    size = found.count()
    kept = found.where((F.xxhash64("x", "y") % 1_000_000 + 1_000_000) % 1_000_000 < 1e6 * min(1.0, SAMPLE_CHAINS / max(1, size))).toPandas()
    discard(found, chosen)
    samples = sorted((y, x) for x, y in zip(kept["x"], kept["y"], strict=True))
    data = [(np.frombuffer(x, np.uint8).reshape(-1, N_FEATURES).astype(np.float32), np.frombuffer(y, np.uint8).astype(np.int64)) for y, x in samples]
    if not any((y != O).any() for _, y in data):
        return nothing
    return fit(data)


def crf_spans(text: str, weight: np.ndarray, move: np.ndarray, base: list | None = None) -> list[tuple[int, int]]:
    """Spans of begin and inside tags."""
    runs = chains(text)
    of_file = file_features(text, runs, base_spans(text) if base is None else base) if runs else []
    found: list[tuple[int, int]] = []
    for run in runs:
        tags = viterbi(features(text, run, of_file) @ weight, move)
        for (begin, end, _, _), tag in zip(run, tags, strict=True):
            if tag == B:
                found.append((begin, end))
            elif tag == I and found:
                found[-1] = (found[-1][0], end)
    return found


def spans(text: str, weight: np.ndarray, move: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with those of the CRF (kind 3) that overlap no base span."""
    base = base_spans(text)
    added = [(b, 3, e) for b, e in crf_spans(text, weight, move, base) if not any(s < e and b < t for s, _, t in base)]
    return base, sorted(base + added)


NAMES = ("assign", "access", "hex", "crf")


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in found)


@releasing
def _scan(batches: Iterator[pa.RecordBatch], weight: np.ndarray, move: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text"):
            rows = []
            for text in column(block, "text").to_pylist():
                base, every = spans(text or "", weight, move)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [column(block, "doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )


def scan(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Spans of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(lambda it: _scan(it, *shared.value), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(texts: DataFrame, model: tuple[np.ndarray, np.ndarray], mask: str = "[SECRET]") -> DataFrame:
    """The same rows with every span of their text replaced by ``mask``; a null text stays null."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for block in blocks(batch, "text"):
                out = []
                for text in block.column(at).to_pylist():
                    if text:
                        parts, last = [], 0
                        for s, _, e in spans(text, *shared.value)[1]:
                            if s >= last:
                                parts += [text[last:s], mask]
                            last = max(last, e)
                        text = "".join([*parts, text[last:]])
                    out.append(text)
                yield block.set_column(at, block.schema.field(at), pa.array(out, block.schema.field(at).type))

    return texts.mapInArrow(run, texts.schema)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Contract query over every document."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
