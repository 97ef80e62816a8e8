"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all grades and
ordered thresholds, so the expected severity grows with w.x. Features are words
and prefixes of words (inflected forms share them), chosen by how much more often
texts of a higher grade hold them; a feature's value is its rate per hundred
words, damped.

Labels say toxic or not. Severity grades are made from them: 0 not toxic, and
toxic texts are parted at their median evidence (the sum of the chosen features'
log-odds in the text) into 1 and 2. The model is fitted on a bounded number of
labelled texts; every text is scored, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._util import fresh, sample_by_hash, settle, small_batches, worker_cache

#: About so many labelled rows, those whose doc_id hashes low, on which the model is fitted.
FIT_ROWS = 20_000
FEATURES = 2_000
PREFIXES = (4, 5, 6, 7, 8)
#: A text is toxic if its expected severity (0 to the highest grade) is at least this.
TOXIC_FROM = 0.4
CACHE_WORDS = 150_000

_STRIP = re.compile(r"\W+")


def features_of(word: str) -> list[str]:
    """A word (lower-cased, without what is no letter, digit or underscore) and its prefixes."""
    w = _STRIP.sub("", word.lower())
    return ([w + "$"] if w else []) + [w[:n] for n in PREFIXES if len(w) >= n]


class Features(dict):
    """Numbers of the chosen features of a word, kept for words seen lately."""

    def __init__(self, chosen: dict[str, int]):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = tuple(self.chosen[f] for f in features_of(word) if f in self.chosen)
        return out

    def rates(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values of a text."""
        ws = text.split() if text else []
        hits = [i for w in ws for i in self[w]]
        if not hits:
            return np.empty(0, np.int64), np.empty(0)
        which, n = np.unique(np.array(hits), return_counts=True)
        return which, np.log1p(100.0 * n / max(len(ws), 20))


def _document_counts(batches):
    """How many texts of each class hold each feature; a row for a feature each time the table of them is full."""
    worker_cache().clear()
    seen: dict[str, list[int]] = {}
    for b in batches:
        for text, y in zip(b["text"], b["toxic"], strict=True):
            for f in {f for w in set((text or "").split()) for f in features_of(w)}:
                seen.setdefault(f, [0, 0])[int(y)] += 1
            if len(seen) > 200_000:
                yield pd.DataFrame([(f, *n) for f, n in seen.items()], columns=["feature", "clean", "toxic"])
                seen = {}
    yield pd.DataFrame([(f, *n) for f, n in seen.items()], columns=["feature", "clean", "toxic"])


def _vectors(chosen: dict[str, int]):
    def f(batches):
        feats = Features(chosen)
        for b in batches:
            pairs = [feats.rates(t) for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"], "which": [p[0] for p in pairs], "value": [p[1] for p in pairs]})

    return f


class CumulativeLink:
    """Ordinal regression with shared weights; fitted by gradient steps on the penalised likelihood."""

    def __init__(self, features: int, grades: int):
        self.w, self.grades = np.zeros(features), grades
        self.theta0, self.gaps = 0.0, np.zeros(grades - 2)

    def theta(self) -> np.ndarray:
        """Ordered thresholds: the first, and positive gaps."""
        return self.theta0 + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def cumulative(self, s: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k = 0 .. grades - 1, a row for each score."""
        c = 1.0 / (1.0 + np.exp(-np.clip(self.theta()[None, :] - s[:, None], -40, 40)))
        return np.concatenate([c, np.ones((len(s), 1))], 1)

    def probabilities(self, s: np.ndarray) -> np.ndarray:
        return np.diff(self.cumulative(s), axis=1, prepend=0.0)

    def fit(self, row: np.ndarray, which: np.ndarray, value: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 400, rate: float = 0.1) -> None:
        n, g = len(y), self.grades - 1
        m = [np.zeros(len(self.w) + g), np.zeros(len(self.w) + g)]
        for t in range(1, steps + 1):
            s = np.bincount(row, weights=value * self.w[which], minlength=n)
            c = self.cumulative(s)
            hi, lo = c[np.arange(n), y], np.where(y > 0, c[np.arange(n), np.maximum(y - 1, 0)], 0.0)
            p = np.maximum(hi - lo, 1e-12)
            d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
            grad_w = np.bincount(which, weights=value * (d_hi - d_lo)[row], minlength=len(self.w)) / n + penalty * self.w
            d_theta = np.array([((y == k + 1) * d_lo - (y == k) * d_hi).sum() for k in range(g)]) / n
            steps_of = np.exp(self.gaps)
            grad = np.concatenate([grad_w, [d_theta.sum()], [steps_of[j] * d_theta[j + 1 :].sum() for j in range(g - 1)]])
            m[0], m[1] = 0.9 * m[0] + 0.1 * grad, 0.99 * m[1] + 0.01 * grad * grad
            move = rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8)
            self.w -= move[: len(self.w)]
            self.theta0 -= move[len(self.w)]
            self.gaps -= move[len(self.w) + 1 :]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES) -> tuple[dict[str, int], CumulativeLink] | None:
    """The chosen features and the model, or None if the labels don't hold both kinds."""
    some = labels.filter("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    some = F.broadcast(sample_by_hash(some, F.col("doc_id"), fit_rows))  # bounded by fit_rows
    train = settle(docs.select("doc_id", "text").join(some, "doc_id").select("toxic", "text"), "labelled")  # read three times
    kinds = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    clean, toxic = kinds.get(0, 0), kinds.get(1, 0)
    if not clean or not toxic:
        return None
    counts = train.mapInPandas(_document_counts, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    best = counts.filter("clean + toxic >= 4").withColumn("odds", odds).orderBy(F.desc(F.abs("odds") * F.sqrt(F.least(F.col("toxic") + F.lit(0.5), F.col("clean") + F.col("toxic")))), "feature").limit(features).collect()
    chosen, odds_of = {r["feature"]: i for i, r in enumerate(best)}, np.array([r["odds"] for r in best])
    got = train.mapInPandas(_vectors(chosen), "toxic int, which array<long>, value array<double>").toPandas()
    n = np.array([len(x) for x in got["which"]])
    row, which, value = np.repeat(np.arange(len(got)), n), np.concatenate(list(got["which"])).astype(np.int64), np.concatenate(list(got["value"]))
    y = got["toxic"].to_numpy(np.int64)
    evidence = np.bincount(row, weights=np.maximum(odds_of, 0)[which] * value, minlength=len(y))
    y[(y == 1) & (evidence > np.median(evidence[y == 1]))] = 2
    model = CumulativeLink(len(chosen), 3)
    model.fit(row, which, value, y)
    return chosen, model


def grade(docs: DataFrame, labels: DataFrame, toxic_from: float = TOXIC_FROM, fit_rows: int = FIT_ROWS, names: tuple[str, str, str] = ("severity", "grade", "toxic")) -> DataFrame:
    """``docs`` (doc_id, text, ...) with severity (expected grade, 0 to 2), grade (likeliest) and whether toxic, under ``names``.

    Labels tell toxic from clean alone. Of toxic texts, those with more evidence than the median (the log odds of their
    features) are grade 2, the others 1; so the upper threshold tells how strong the evidence is, as no label does.

    ``labels`` has doc_id and toxic (over 0: toxic). Null and empty texts have no features: they get the severity of
    a text without evidence. Labels with a null, of repeated ids (one of them counts) or of unknown documents do no
    harm. Without labels of both kinds nothing is learned: severity 0, grade 0, not toxic. Rows are graded each,
    repeated ones and null ids too. Other columns stay as they are; one named like a new column is replaced. An empty
    table gives an empty table.
    """
    learned = fit(small_batches(docs).select("doc_id", "text"), labels.select("doc_id", "toxic"), fit_rows)
    if not learned:
        return docs.withColumns({names[0]: F.lit(0.0), names[1]: F.lit(0), names[2]: F.lit(False)})
    chosen, model = learned

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        feats = Features(chosen)
        for texts in parts:
            yield pd.Series([float(model.w[w] @ v) for w, v in map(feats.rates, texts)], dtype=float)

    own = fresh(docs, "score")
    scored = docs.withColumn(own, score(F.col("text")))
    c = [F.lit(0.0), *(1 / (1 + F.exp(F.col(own) - float(t))) for t in model.theta()), F.lit(1.0)]
    p = [c[k + 1] - c[k] for k in range(model.grades)]
    best = F.greatest(*p)
    likeliest = F.coalesce(*(F.when(x == best, k) for k, x in enumerate(p)))
    expected = sum((k * x for k, x in enumerate(p)), F.lit(0.0))
    return scored.withColumns({names[0]: expected, names[1]: likeliest.cast("int"), names[2]: expected >= toxic_from}).drop(own)
