"""Toxicity of deobfuscated texts.

A noisy channel writes letters as look-alikes (leetspeak), spells them out with separators, splits
words and repeats letters. Every token that leaves the channel a choice (a character that isn't a
letter, or a letter twice) and every run of single characters becomes a lattice, in which a look-alike
is its letters or nothing, a repeated letter is itself or nothing, and a separator is a word's end or
nothing. A Viterbi search under a character trigram model, counted over all documents, picks the
likeliest spelling; a token without a choice has one path and is its own spelling. The restored text
is scored by a logistic model of its words and word beginnings, fitted on labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import rounds, shared_dir, tidy, written
from lodestar.llm.linear import held_out, labelled_sample, sigmoid

#: Labelled rows that the lexicon is learned from at most.
SAMPLE_ROWS = 8_000
#: Toxic documents of the sample that a feature must be in, and by how much more often it must be in
#: toxic ones than in others.
SUPPORT, LIFT = 3, 1.5
#: Cost of a weight, and steps of the fit.
SPARSITY, STEPS = 2e-4, 400
LEAST_SCORE = 0.5
#: Weight of a feature from which two tokens in a row may be read as one word for it.
STRONG = 0.7
BEGINNINGS = range(4, 8)
#: Characters of distinct tokens that a worker keeps; beyond, it starts anew.
KEPT_CHARS = 4_000_000

#: The letters that a character can stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¢": "c",
}
#: Log-costs of the channel: a look-alike, a repeated letter, a character that stands for nothing, a look-alike
#: that does, a word that is split in two.
LOOKALIKE_COST, REPEAT_COST, NOTHING_COST, BLANK_COST, SPLIT_COST = -1.0, -1.0, -2.5, -12.0, -2.5

#: Symbols of the model: 0 between words, 1-26 letters, 27 any other letter.
SYMBOLS = 28
_BYTE_SYMBOL = np.zeros(256, dtype=np.int64)
_BYTE_SYMBOL[0xC3:0xF5] = 27
for _i in range(26):
    _BYTE_SYMBOL[[0x41 + _i, 0x61 + _i]] = _i + 1

EDGES = "\"'.,;:?#%&*()[]{}<>~^`=/\\-_"
WORDS = re.compile(r"[^\W\d_]+")
#: What gives the channel a choice: a character that is no letter, or a letter twice; tokens without any letter are numbers or signs.
CHOICE, LETTER = re.compile(r"[\W\d_]|(.)\1"), re.compile(r"[^\W\d_]")
#: Characters that stand alone, three at least, with any run of blanks or separators between.
SEPARATORS = r"[\s.,;:\-_*/\\|~=+#'\"·•]+"
SPELLED = re.compile(rf"(?<!\w)(?:[^\W_@$!]|[@$!](?=[\W_])){SEPARATORS}(?:[^\W_]{SEPARATORS}|[@$!]{SEPARATORS})+[^\W_](?!\w)")


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Character trigrams of all documents; at most SYMBOLS ** 3 sums reach the driver, however many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for _, texts in rounds(batch, 0):
                data = np.frombuffer("\0\0".join(["", *texts, ""]).encode("utf-8", "surrogatepass"), dtype=np.uint8)
                codes = _BYTE_SYMBOL[data[(data & 0xC0) != 0x80]]
                total += np.bincount(codes[:-2] * SYMBOLS**2 + codes[1:-1] * SYMBOLS + codes[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    grams = docs.select(docs[text_col].alias("text")).mapInArrow(tidy(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**3)
    for r in grams.collect():
        counts[r["gram"]] = r["n"]
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class Restorer:
    """Viterbi decoding of noisy tokens under the trigram model."""

    def __init__(self, counts: np.ndarray):
        # a trigram without any count still has a little of its last letter's share
        share = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + SYMBOLS)
        smooth = counts + 5 * share
        self.log = np.log(smooth / smooth.sum(axis=2, keepdims=True)).tolist()

    @staticmethod
    def fold(c: str) -> int:
        base = unicodedata.normalize("NFKD", c)[0]
        return ord(base) - 96 if "a" <= base <= "z" else 27

    def restore(self, token: str, joins: float = 0.0) -> str:
        """The likeliest words behind a lower-case token; letters outside a-z stay as they are. A blank ends
        a word, or at the cost ``joins`` it is nothing."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        prior = ""
        for c in token:
            options: list[tuple[int, str, float]] = []
            if c.isalpha():
                options.append((self.fold(c), c, 0.0))
            elif c == " ":
                options.append((0, c, 0.0))
            for x in LOOKALIKES.get(c, ""):
                options.append((ord(x) - 96, x, LOOKALIKE_COST))
            drop = joins if c == " " else REPEAT_COST if c == prior else None if c.isalpha() else BLANK_COST if c in LOOKALIKES else NOTHING_COST
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in best.items():
                row = self.log[a][b]
                for symbol, letter, cost in options:
                    new = score + cost + row[symbol]
                    if (b, symbol) not in following or new > following[b, symbol][0]:
                        following[b, symbol] = new, (path, letter)
                if drop is not None and ((a, b) not in following or score + drop > following[a, b][0]):
                    following[a, b] = score + drop, path
            best = following or best
            prior = prior if c == " " else c
        path = max(((score + self.log[a][b][0], a, b, path) for (a, b), (score, path) in best.items()), key=lambda x: x[:3])[3]
        letters = []
        while path is not None:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))

    def words(self, chunk: str) -> set[str]:
        """The words of a token without white space, as written and as restored."""
        found = set(WORDS.findall(chunk))
        core = chunk.strip(EDGES)
        if CHOICE.search(core) and LETTER.search(core):
            found.update(WORDS.findall(self.restore(core)))
            if (bare := core.rstrip("!$@|+")) != core and CHOICE.search(bare):
                found.update(WORDS.findall(self.restore(bare)))
        return found

    def spelled(self, text: str) -> set[str]:
        """The words of runs of characters that stand alone: each run as one word and as several, also
        without its first or last character, which can be a word of its own beside a spelled one."""
        found: set[str] = set()
        for m in SPELLED.finditer(text):
            if len(m[0].split()) == 1:  # a token by itself
                continue
            units = re.split(SEPARATORS, m[0])
            for own in (units, units[1:], units[:-1], units[1:-1]):
                if len(own) > 2:
                    found.add(self.restore("".join(own)))
                    found.update(self.restore(" ".join(own)).split())
        return found

    def split(self, chunks: list[str], weights: dict[str, float], heads: frozenset[str]) -> set[str]:
        """The words that two tokens in a row make, where the first begins a strong feature, the word has such a
        feature beyond it, and one word is likelier than two."""
        found: set[str] = set()
        for first, second in zip(chunks, chunks[1:]):  # noqa: B905
            if first in heads:
                word = first + second.strip(EDGES + "!")
                if WORDS.fullmatch(word) and any(weights.get(f, 0) >= STRONG and len(f) - f.endswith("*") > len(first) for f in features(word)):
                    if self.restore(f"{first} {word[len(first):]}", SPLIT_COST) == word:
                        found.add(word)
        return found


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


class Reader:
    """The features of texts, each with the number of its places."""

    def __init__(self, counts: np.ndarray):
        self.restorer = Restorer(counts)
        self.forget()

    def forget(self) -> None:
        self.known, self.kept = {}, 0

    def token(self, chunk: str) -> tuple[str, ...]:
        if chunk not in self.known:
            if self.kept > KEPT_CHARS:
                self.forget()
            self.known[chunk] = tuple({f for w in self.restorer.words(chunk) for f in features(w)})
            self.kept += len(chunk)
        return self.known[chunk]

    def text(self, text: str) -> Counter:
        """Of tokens and of runs of single characters; a feature counts once for each token or run."""
        text, found = text.lower(), Counter()
        for chunk, n in Counter(text.split()).items():
            for f in self.token(chunk):
                found[f] += n
        for w in self.restorer.spelled(text):
            found.update(features(w))
        return found


def _per_text(sample: DataFrame, counts: np.ndarray, wanted: dict[str, int] | None) -> DataFrame:
    """(doc_id, feature, at, n) of each text of the sample, of the wanted features with their places alone if there are any given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(counts)
        for batch in batches:
            for at, texts in rounds(batch, 1):
                found = [reader.text(t) for t in texts]
                own = [[(f, n) for f, n in x.items() if wanted is None or f in wanted] for x in found]
                size = np.array(list(map(len, own)), dtype=np.int64)
                row = pa.array(np.repeat(np.arange(at, at + len(own)), size))
                names, ns = pa.array([f for x in own for f, _ in x], pa.string()), pa.array([n for x in own for _, n in x], pa.int32())
                places = pa.array([-1 if wanted is None else wanted[f] for x in own for f, _ in x], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), names, places, ns], names=["doc_id", "feature", "at", "n"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    return sample.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, feature string, at int, n int")


def _strength(n: np.ndarray) -> np.ndarray:
    """What a feature with so many places counts: 1 + log(n), or nothing without any."""
    return np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0.0)


def fit_sparse(row: np.ndarray, column: np.ndarray, values: np.ndarray, labels: np.ndarray, n_columns: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model by accelerated proximal gradient steps; the weights' absolute
    sum costs SPARSITY, both classes count the same."""
    n, share = len(labels), labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / n
    # the curvature is at most a quarter of the greatest row sum times column sum of weighted squares
    spread = np.bincount(row, np.abs(values), minlength=n) + 1
    reach = np.bincount(column, np.abs(values) * (weight * spread)[row], minlength=n_columns)
    rate = 4 / max(reach.max(initial=0.0), float(weight @ spread), 1e-9)
    w, b, look_w, look_b, momentum = np.zeros(n_columns), 0.0, np.zeros(n_columns), 0.0, 1.0
    for _ in range(STEPS):
        pull = weight * (sigmoid(np.bincount(row, values * look_w[column], minlength=n) + look_b) - labels)
        step = look_w - rate * np.bincount(column, values * pull[row], minlength=n_columns)
        new_w = np.sign(step) * np.maximum(np.abs(step) - rate * SPARSITY, 0)
        new_b = look_b - rate * pull.sum()
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        look_w = new_w + (momentum - 1) / following * (new_w - w)
        look_b = new_b + (momentum - 1) / following * (new_b - b)
        w, b, momentum = new_w, new_b, following
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, counts: np.ndarray, rows: int = SAMPLE_ROWS) -> dict:
    """Weights by feature and the intercept, learned from at most ``rows`` labelled rows that aren't held out.

    Without labels of both kinds, every score is the share of label 1, or a half without any label.
    All tables here are bounded by ``rows``.
    """
    sample = labelled_sample(docs, labels, "toxic", rows, folds=True)
    sample = written(sample, shared_dir(docs.sparkSession), "toxic_sample")
    sizes = {int(r["label"] == 1): r["n"] for r in sample.groupBy((F.col("label") == 1).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        share = min(max(n_toxic / (n_toxic + n_clean) if sizes else 0.5, 1e-6), 1 - 1e-6)
        return {"weights": {}, "intercept": math.log(share / (1 - share))}
    toxic, clean = sample.where("label = 1"), sample.where("label != 1")
    support = lambda x: x.groupBy("feature").agg(F.count("*").alias("n"))
    common = {r["feature"]: r["n"] for r in support(_per_text(toxic, counts, None)).where(F.col("n") >= SUPPORT).collect()}
    elsewhere = {r["feature"]: r["n"] for r in support(_per_text(clean, counts, common)).collect()}
    chosen = sorted(f for f, n in common.items() if n / n_toxic >= LIFT * elsewhere.get(f, 0) / n_clean)
    place = {f: i for i, f in enumerate(chosen)}
    numbered = sample.select("doc_id", "label").orderBy("doc_id").toPandas()
    found = _per_text(sample, counts, place).select("doc_id", "at", "n").toPandas()
    row, column = np.searchsorted(numbered["doc_id"].to_numpy(), found["doc_id"].to_numpy()), found["at"].to_numpy(np.int64)
    order = np.lexsort((column, row))  # sums don't depend on the order of tasks
    values = _strength(found["n"].to_numpy(np.float64))[order]
    w, b = fit_sparse(row[order], column[order], values, (numbered["label"] == 1).to_numpy(np.float64), len(chosen))
    return {"weights": {f: float(x) for f, x in zip(chosen, w, strict=True) if x}, "intercept": b}


def score_texts(docs: DataFrame, counts: np.ndarray, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits), one row for each row of ``docs``, from its whole text alone.

    The score is the fitted probability of the restored text: each feature's weight times 1 + log(its
    places), and ``n_hits`` counts the features with a positive one. Null and empty texts have the
    intercept's score, a score at the threshold is label 1, texts of any length are read whole, repeated
    rows are scored each, an empty table gives no rows; other columns aren't read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, weights = Restorer(counts), model["weights"]
        places = {f: i for i, f in enumerate(weights)}
        weight = np.array(list(weights.values()))
        heads = frozenset(f[:k] for f, x in weights.items() if x >= STRONG for k in range(1, len(f) - f.endswith("*")))
        #: Features of tokens that have any, and all tokens that were looked at.
        hot: dict[str, tuple[int, ...]] = {}
        seen: set[str] = set()
        kept = 0
        own = lambda words: tuple({places[f] for w in words for f in features(w) if f in places})
        for batch in batches:
            for at, texts in rounds(batch, 1):
                scores, hits = [], []
                for t in texts:
                    t = t.lower()
                    if kept > KEPT_CHARS:
                        hot.clear()
                        seen.clear()
                        kept = 0
                    row = t.split()
                    chunks = set(row)
                    for chunk in chunks - seen:
                        kept += len(chunk)
                        if some := own(restorer.words(chunk)):
                            hot[chunk] = some
                    seen |= chunks
                    n = np.zeros(len(weight))
                    if some := hot.keys() & chunks:
                        for chunk, k in Counter(filter(some.__contains__, row)).items():
                            n[list(hot[chunk])] += k
                    for word in restorer.spelled(t) | restorer.split(row, weights, heads):
                        if some := own([word]):
                            n[list(some)] += 1
                    scores.append(float(sigmoid(weight @ _strength(n) + model["intercept"])))
                    hits.append(int(np.count_nonzero((n > 0) & (weight > 0))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], names=["doc_id", "score", "n_hits"])

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = picked.schema[0].dataType.simpleString()
    scored = picked.mapInArrow(tidy(run), f"doc_id {kind}, score double, n_hits long")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"), "n_hits")
