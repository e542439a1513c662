"""Toxicity: gradient-boosted trees over dense features of the whole text, with isotonic calibration.

The lexicon (words, word beginnings and word ends that mark the class) is learnt from a bounded sample of labelled rows in
folds, so that trees and calibration are fitted on features whose lexicon has not seen the row.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled sample that is brought to the driver: by smallest hash of the id, whole texts.
MAX_LABELLED = 10_000
FOLDS = 3
LEAST = 4  #: marked documents that must hold a word or affix of the lexicon
WORD = re.compile(r"[^\W_]+(?:['’*@$#0-9][^\W_]+)*")
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "*": "", "'": "", "’": "", "#": ""})
AFFIXES = (4, 5, 6, 7)
NEAR = 4  #: words between a second person and a lexicon word that still count as near
FEATURES = (
    "words", "hits", "density", "strongest", "weight_density", "spread", "affix_density", "affix_strongest", "near_second_person", "second_person",
    "capitals", "shouted", "exclamations", "questions", "other_marks", "digits", "disguised", "disguised_hits", "repeats", "mean_length",
)


@dataclass
class Lexicon:
    """Log odds of the class for words and for affixes ('^abcd' begins, 'abcd$' ends a word)."""

    words: dict[str, float] = field(default_factory=dict)
    affixes: dict[str, float] = field(default_factory=dict)
    _of: dict[str, float] = field(default_factory=dict, repr=False)

    def affix(self, word: str) -> float:
        """The strongest affix of a word; kept for the words met so far (bounded)."""
        w = self._of.get(word)
        if w is None:
            w = max((self.affixes.get(a, 0.0) for a in affixes(word)), default=0.0)
            if len(self._of) > 300_000:
                self._of.clear()
            self._of[word] = w
        return w


def affixes(word: str) -> list[str]:
    return [a for n in AFFIXES if len(word) > n for a in ("^" + word[:n], word[-n:] + "$")]


def keys_of(text: str) -> set[str]:
    """Words and affixes of a text."""
    words = {w.lower() for w in WORD.findall(text)}
    return words | {a for w in words for a in affixes(w)}


def document_counts(texts: list[str], labels: list[int], folds: np.ndarray) -> list[tuple[Counter, Counter, list[int]]]:
    """For each fold and class, how many documents hold each word and affix, and how many there are.

    Only keys that LEAST marked documents hold can enter a lexicon, so clean documents are counted for these alone.
    """
    own = [(Counter(), Counter(), [0, 0]) for _ in range(FOLDS)]
    every: Counter = Counter()
    for text, y, k in zip(texts, labels, folds, strict=True):
        own[k][2][y] += 1
        if y:
            found = keys_of(text)
            own[k][1].update(found)
            every.update(found)
    kept = {w for w, c in every.items() if c >= LEAST}
    for text, y, k in zip(texts, labels, folds, strict=True):
        if not y:
            own[k][0].update(keys_of(text) & kept)
    return own


def make_lexicon(clean: Counter, marked: Counter, n: list[int], floor: float = 2.0) -> Lexicon:
    """Words and affixes whose smoothed log odds by document are at least ``floor``."""

    def odds(k: str) -> float:
        return math.log((marked[k] + 0.5) / (n[1] + 1)) - math.log((clean[k] + 0.5) / (n[0] + 1))

    scored = {k: odds(k) for k, c in marked.items() if c >= LEAST}
    top = sorted((k for k, v in scored.items() if v >= floor), key=lambda k: (-scored[k], k))
    is_affix = lambda k: k[0] == "^" or k[-1] == "$"
    return Lexicon({k: scored[k] for k in top if not is_affix(k)}, {k: scored[k] for k in top if is_affix(k)})


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Dense features of a whole text; null and empty texts give zeros."""
    text = text or ""
    raw = WORD.findall(text)
    low = [w.lower() for w in raw]
    n = len(low)
    counts = Counter(low)
    hits = strongest = weight = spread = affix = affix_max = disguised = disguised_hits = 0.0
    hot = set()
    for w, c in counts.items():
        v = lexicon.words.get(w, 0.0)
        if not w.isalpha():
            plain = w.translate(DISGUISE)
            if plain != w and any(ch.isalpha() for ch in w):
                disguised += c
                if (u := lexicon.words.get(plain, 0.0)) > v:
                    disguised_hits += c
                    v = u
        if v:
            hot.add(w)
            hits += c
            spread += 1
            weight += v * c
            strongest = max(strongest, v)
        a = lexicon.affix(w)
        if a:
            affix += a * c
            affix_max = max(affix_max, a)
    you = sum(counts[w] for w in SECOND_PERSON & counts.keys())
    near = 0
    if hot and you:
        places = [i for i, w in enumerate(low) if w in SECOND_PERSON]
        hot_places = np.array([i for i, w in enumerate(low) if w in hot])
        at = np.searchsorted(hot_places, places)
        gap = np.minimum(np.abs(hot_places[np.minimum(at, len(hot_places) - 1)] - places), np.abs(hot_places[np.maximum(at - 1, 0)] - places))
        near = int((gap <= NEAR).sum())
    per, chars = 1.0 / max(n, 1), 1.0 / max(len(text), 1)
    bang, ask = text.count("!"), text.count("?")
    plain_marks = sum(text.count(c) for c in ".,;:")
    shouted = sum(1 for w in raw if len(w) > 2 and w.isupper())
    letters = sum(map(len, low))
    digits = sum(text.count(c) for c in "0123456789")
    other = max(0, len(text) - letters - text.count(" ") - text.count("\n") - plain_marks - bang - ask)
    capitals = sum(1 for w in raw if w[0].isupper())
    return [
        math.log1p(n), hits, hits * per, strongest, weight * per, spread, affix * per, affix_max, near, you * per, capitals * per, shouted * per, bang * chars, ask * chars,
        other * chars, digits * chars, disguised * per, disguised_hits, 1.0 - len(counts) * per if n else 0.0, letters * per,
    ]


class Trees:
    """Gradient-boosted trees for two classes: binned features, second-order gains, fixed depth."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.trees = math.log(rate / (1 - rate)), []
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            tree = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            self._grow(b, g, h, np.arange(len(y)), 0, 0, tree, score)
            self.trees.append(tree)
        return self

    def _grow(self, b, g, h, rows, at, level, tree, score) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        value = -self.rate * gs / (hs + self.ridge)
        best = (1e-6, -1, 0)
        if level < self.depth and len(rows) > 1:
            for f, edges in enumerate(self.edges):
                if not len(edges):
                    continue
                n = len(edges) + 1
                gl = np.bincount(b[rows, f], g[rows], n).cumsum()[:-1]
                hl = np.bincount(b[rows, f], h[rows], n).cumsum()[:-1]
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(hl < self.least) | (hs - hl < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] < 0:
            tree[at] = (-1, 0.0, value)
            score[rows] += value
            return
        _, f, k = best
        tree[at] = (f, float(self.edges[f][k]), value)
        left = b[rows, f] <= k
        self._grow(b, g, h, rows[left], 2 * at + 1, level + 1, tree, score)
        self._grow(b, g, h, rows[~left], 2 * at + 2, level + 1, tree, score)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            f, cut, value = (np.array(c) for c in zip(*tree, strict=True))
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                inner = f[at] >= 0
                right = x[np.arange(len(x)), np.maximum(f[at], 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += value[at]
        return out


class Isotonic:
    """Pool adjacent violators; between the steps it interpolates. Each end is pulled in by one row of the other class."""

    def fit(self, s: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(s, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, first and last score
        for v, t in zip(s[order], y[order], strict=True):
            blocks.append([float(t), 1.0, v, v])
            while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
                t2, n2, _, hi = blocks.pop()
                blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2], hi]
        xs, ps = [], []
        for t, n, lo, hi in blocks:
            p = (t + 0.02) / (n + 0.04)
            xs += [lo, hi] if hi > lo else [lo]
            ps += [p] * (1 + (hi > lo))
        self.x, self.p = np.array(xs), np.maximum.accumulate(np.array(ps))
        return self

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.interp(s, self.x, self.p)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    calibration: Isotonic | None
    prior: float = 0.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        x = np.array([features(t, self.lexicon) for t in texts], float).reshape(-1, len(FEATURES))
        return np.clip(self.calibration(self.trees.score(x)), 0.0, 1.0)


def fit_model(rows: list[tuple[str, str, int]]) -> Model:
    """Fit on (id, text, label). With one class only, the score is that class's rate.

    Each fold's features come from the lexicon of the other folds, so no row has marked its own words; its calibration score
    comes from trees that haven't seen it. Scoring uses the lexicon of all rows.
    """
    y = np.array([r[2] for r in rows], int)
    if not len(rows) or y.min() == y.max():
        return Model(Lexicon(), None, None, float(y.mean()) if len(rows) else 0.0)
    fold = np.array([zlib.crc32(f"fold{r[0]}".encode()) % FOLDS for r in rows])
    own = document_counts([r[1] for r in rows], y.tolist(), fold)
    clean, marked = sum((o[0] for o in own), Counter()), sum((o[1] for o in own), Counter())
    n = [sum(o[2][c] for o in own) for c in (0, 1)]
    x = np.empty((len(rows), len(FEATURES)))
    for k in range(FOLDS):
        lexicon = make_lexicon(clean - own[k][0], marked - own[k][1], [n[c] - own[k][2][c] for c in (0, 1)])
        for i in np.flatnonzero(fold == k):
            x[i] = features(rows[i][1], lexicon)
    held = np.zeros(len(rows))
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            held[fold == k] = Trees().fit(x[fold != k], y[fold != k]).score(x[fold == k])
    return Model(make_lexicon(clean, marked, n), Trees().fit(x, y), Isotonic().fit(held, y.astype(float)))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_LABELLED) -> Model:
    """Fit from labelled rows that aren't held out: the ``most`` of smallest id hash, classes as they come.

    Rows that repeat an id with other texts are rows of their own, rows that repeat both are one; ties of the id hash are broken by id, text hash and label, so reruns agree.
    """
    given = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    chosen = given.orderBy(F.xxhash64("__id"), "__id", "__y").limit(most)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    texts = texts.withColumn("__hash", F.xxhash64("__text"))
    keys = texts.join(F.broadcast(chosen), "__id").select("__id", "__hash", "__y").distinct().orderBy(F.xxhash64("__id"), "__id", "__hash", "__y").limit(most)
    rows = texts.join(F.broadcast(keys), ["__id", "__hash"]).dropDuplicates(["__id", "__hash", "__y"])
    rows = rows.select(F.col("__id").cast("string"), "__text", "__y").collect()  # bounded by ``most``
    return fit_model(sorted((r[0], r[1], r[2]) for r in rows))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 (a column of that name is replaced). Null texts score as empty ones."""
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of the labelled sample and the number of trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                got = shared.value.score(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], [*part.schema.names, score_col])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(score_col, DoubleType()))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, most: int = MAX_LABELLED) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted. ``most`` bounds the labelled rows that the model is fitted on.

    Rows without an id count as not held out. Repeated rows score alike, null texts as empty ones, and texts of any length are
    scored whole. Without labels every row scores 0; with one class only, that class's rate. An empty table gives an empty
    result. Columns other than the named ones are ignored.
    """
    model = learn(docs, labels, id_col, text_col, most=most)
    scored = score(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), model, "__text", "__score").drop("__text")
    return scored.select(
        F.col("__id").alias(id_col), held_out("__id").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted")
    )
