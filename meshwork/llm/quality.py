"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation over the counts of
vote patterns of the whole corpus (at most 3 ** labellers rows) estimates how each labeller votes on good and bad
documents; the posteriors train a hashed linear scorer. No true label is used.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.plans.durable import written

DIMS = 1 << 16
MAX_TRAINING = 6_000  #: default of quality's ``most``
#: Frequent short words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that for on with as are this by an be was from at or de la le les des et un une dans qui que pour pas sur au "
    "der die das und ist von mit den auf für ein eine nicht zu el los las en y se por con una del al es su para como"
).split()


def votes() -> dict[str, Column]:
    """1 good, 0 bad, -1 abstain; expects a frame with the columns of :func:`measures`."""
    n, chars = F.col("__n"), F.greatest(F.col("__chars"), F.lit(1))
    vote = lambda bad, good: F.when(bad, 0).when(good, 1).otherwise(-1)
    return {
        "marks": vote(F.col("__marks") / chars > 0.03, F.col("__marks") == 0),
        "bars": vote(F.col("__bars") / F.greatest(n, F.lit(1)) > 0.08, F.col("__bars") == 0),
        "variety": vote((n >= 20) & (F.col("__distinct") < 0.25 * n), (n >= 20) & (F.col("__distinct") > 0.4 * n)),
        "lines": vote((F.col("__lines") >= 4) & (F.col("__own_lines") < 0.7 * F.col("__lines")), F.col("__own_lines") == F.col("__lines")),
        "function_words": vote((n >= 20) & (F.col("__function") < 3), F.col("__function") >= 8),
        "word_length": vote((F.col("__letters") / F.greatest(n, F.lit(1)) > 12) | (F.col("__letters") / F.greatest(n, F.lit(1)) < 2), (F.col("__letters") / F.greatest(n, F.lit(1))).between(3, 9)),
        "length": vote(n < 2, n >= 60),
    }


def measures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What the labellers look at, by built-in functions over the whole text; null counts as empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), t.alias("__text")).withColumns({"__words": F.array_remove(F.split(F.translate("__text", "\n\t\r", "   "), " "), ""), "__split": F.split("__text", "\n")})
    gone = lambda c: F.length("__text") - F.length(F.translate("__text", c, ""))
    rows = rows.withColumn("__set", F.array_distinct("__words"))
    return rows.select(
        "__id", F.length("__text").alias("__chars"), F.size("__words").alias("__n"), F.size("__set").alias("__distinct"),
        F.size("__split").alias("__lines"), F.size(F.array_distinct("__split")).alias("__own_lines"), gone("*#$%&~^<>{}").alias("__marks"), gone("|").alias("__bars"),
        F.size(F.array_intersect("__set", F.array(*[F.lit(w) for w in FUNCTION_WORDS]))).alias("__function"),
        (F.length("__text") - F.size("__words")).alias("__letters"),
    )


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-7) -> tuple[np.ndarray, float, np.ndarray]:
    """Two-class EM over vote patterns (rows of -1, 0, 1). Returns vote probabilities [class, labeller, vote], the
    share of good documents and each pattern's posterior of good. An abstention says
    nothing of the class. It starts from majority votes, so class 1 is good."""
    m, w = patterns.shape[1], counts.astype(float)
    ones, zeros = (patterns == 1).sum(1), (patterns == 0).sum(1)
    post = (ones + 2.0) / (ones + 3.0 * zeros + 4.0)  # a complaint weighs more than a compliment
    hot = np.stack([patterns == v for v in (0, 1)], 2).astype(float)
    prob, prior = np.zeros((2, m, 2)), 0.5
    for _ in range(rounds):
        prior = float(np.clip((w * post).sum() / max(w.sum(), 1e-9), 0.02, 0.98))
        for c, q in ((1, post), (0, 1 - post)):
            seen = np.einsum("p,pmv->mv", w * q, hot) + 1.0
            prob[c] = seen / seen.sum(1, keepdims=True)
        like = [math.log(p) + np.einsum("pmv,mv->p", hot, np.log(prob[c])) for c, p in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        moved, post = float(np.abs(new - post).max(initial=0)), new
        if moved < tolerance:
            break
    return prob, prior, post


TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")


def hashed(text: str, kept: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features: hashed words and marks with damped counts of unit length, and the log length."""
    kept = {} if kept is None else kept
    counts = Counter(TOKEN.findall(text))
    if len(kept) > 400_000:
        kept.clear()
    at = np.empty(len(counts) + 1, np.int64)
    for i, t in enumerate(counts):
        j = kept.get(t)
        if j is None:
            j = kept[t] = zlib.crc32(t.encode("utf-8", "surrogatepass")) % (DIMS - 1)
        at[i] = j
    at[-1] = DIMS - 1
    value = np.empty(len(at))
    value[:-1] = np.log1p(np.fromiter(counts.values(), float, len(counts)))
    value[:-1] /= max(math.sqrt(float((value[:-1] ** 2).sum())), 1e-9)
    value[-1] = math.log1p(sum(counts.values())) / 8
    return at, value


class Linear:
    """Logistic regression on hashed features with soft labels: passes of AdaGrad in a fixed order."""

    def __init__(self, passes: int = 4, rate: float = 0.5, decay: float = 1e-6):
        self.passes, self.rate, self.decay = passes, rate, decay
        self.w, self.b = np.zeros(DIMS, np.float32), 0.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Linear:
        seen, seen_b = np.full(DIMS, 1e-2), 1e-2
        order = np.random.default_rng(7)
        for _ in range(self.passes):
            for i in order.permutation(len(rows)):
                at, v = rows[i]
                g = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.w[at] @ v) + self.b)))) - y[i]
                step = g * v + self.decay * self.w[at]
                seen[at] += step**2
                self.w[at] -= (self.rate * step / np.sqrt(seen[at])).astype(np.float32)
                seen_b += g * g
                self.b -= self.rate * g / math.sqrt(seen_b)
        return self

    def score(self, at: np.ndarray, v: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.w[at] @ v) + self.b))))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, most: int = MAX_TRAINING) -> DataFrame:
    """One row per row: id, weak (posterior of good from the votes), score (hashed linear scorer), keep (score >= threshold).

    The scorer is trained on at most ``most`` documents, those of smallest id hash, whatever the corpus size, as they are
    collected on the driver; votes are counted over all rows, and all rows are scored.
    Null texts count as empty; texts of any length are read whole. Rows with a null id are scored but never trained on. Repeated rows score alike; an empty
    table gives an empty result. Other columns are ignored.
    """
    named = votes()
    voted = measures(docs, id_col, text_col).select("__id", F.concat_ws("", *[(v + 1).cast("string") for v in named.values()]).alias("__votes"))
    voted = written(voted, "votes")  # read for the counts of patterns and for the choice of training rows
    found = voted.groupBy("__votes").agg(F.count(F.lit(1)).alias("n")).orderBy("__votes").collect()  # at most 3 ** labellers
    patterns = np.array([[int(c) - 1 for c in r[0]] for r in found], int).reshape(-1, len(named))
    _, prior, post = em(patterns, np.array([r[1] for r in found]))
    weak = {r[0]: float(p) for r, p in zip(found, post, strict=True)}
    chosen = voted.where("__id is not null").orderBy(F.xxhash64("__id"), "__id").limit(most)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    texts = texts.withColumn("__hash", F.xxhash64("__text"))
    keys = texts.join(F.broadcast(chosen.distinct()), "__id").select("__id", "__hash", "__votes").distinct().orderBy(F.xxhash64("__id"), "__id", "__hash", "__votes").limit(most)
    both = texts.join(F.broadcast(keys), ["__id", "__hash"]).dropDuplicates(["__id", "__hash", "__votes"])
    sample = sorted(tuple(r) for r in both.select("__id", "__text", "__votes").collect())  # bounded by ``most``
    model = Linear().fit([hashed(t) for _, t, _ in sample], np.array([weak[v] for _, _, v in sample]))
    shared = docs.sparkSession.sparkContext.broadcast((model.w, model.b))  # DIMS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, kept = Linear(), {}
        scorer.w, scorer.b = shared.value
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                got = [scorer.score(*hashed(t or "", kept)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(got, pa.float64())], ["__id", "__votes", "score"])

    rows = measures_with_text(docs, id_col, text_col, named)
    kind = rows.schema["__id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"__id {kind}, __votes string, score double")
    table = F.create_map(*[F.lit(x) for kv in weak.items() for x in kv]) if weak else F.create_map(F.lit(""), F.lit(prior))
    return scored.select(F.col("__id").alias(id_col), F.coalesce(F.try_element_at(table, F.col("__votes")), F.lit(prior)).alias("weak"), "score", (F.col("score") >= threshold).alias("keep"))


def measures_with_text(docs: DataFrame, id_col: str, text_col: str, named: dict[str, Column]) -> DataFrame:
    """Id, text and votes side by side, from one scan."""
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("__row"), F.col(text_col).alias("__t"))
    m = measures(rows, "__row", "__t")
    return m.select(F.col("__id.id").alias("__id"), F.col("__id.text").alias("__text"), F.concat_ws("", *[(v + 1).cast("string") for v in named.values()]).alias("__votes"))
