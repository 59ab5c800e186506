"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers are trained with numpy from confirmed toxic texts (P) and unlabelled texts (U, drawn from all that
may be learned from, their labels unread) on the class-prior-corrected risk of Kiryo et al., "Positive-unlabeled
learning with non-negative risk estimator" (2017): ``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))``. Where the
bracket falls below 0 a step goes the other way, against overfitting. The prior is a parameter; by default it is the
share of toxic texts among the labelled ones that may be learned from, the only use of labels that aren't toxic.

A text's features are the hashes of its distinct words, whole, and of their first 4, 5 and 6 letters; words of more than
LONG letters also have all their 4-letter strings, and words with letters of a script without spaces (Chinese, Japanese,
Thai, Lao, Burmese, Khmer), where a run of letters is a clause, all strings of 1 to 4 letters. The samples are bounded:
MOST_POSITIVE confirmed texts and, for each of CLASSIFIERS classifiers, MOST_UNLABELLED others, chosen by hash; the
classifiers train in a task each and their logits are averaged. Scoring covers all whole texts.

Null and empty texts have no features and get the score of the bias. Without toxic examples or unlabelled texts all
scores are 0. Rows with a null doc_id are held out; a doc_id labelled twice is toxic if any of its labels says so.
Rows that repeat a doc_id are scored each; long texts count with all their words. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .sampling import bounded_sample, held_out

DIMENSIONS = 1 << 17
MOST_POSITIVE = 3000
MOST_UNLABELLED = 5000
CLASSIFIERS = 3
STEPS = 120
#: Features count that stand in so many texts of the sample, and whose shares of P and of U differ by so many deviations.
LEAST_TEXTS = 3
LEAST_DEVIATIONS = 5
_WORDS = re.compile(r"\w+")
#: Features of words up to LONG letters are the word and its beginnings alone; those of words over LONGEST are not cached.
LONG = 6
LONGEST = 64
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_CACHE = 200_000


def word_parts(word: str) -> set[str]:
    """The strings whose hashes are a word's features."""
    parts = {f"{word}$", *(word[:k] for k in (4, 5, 6) if len(word) >= k)}
    lengths = (1, 2, 3, 4) if _UNSPACED.search(word) else (4,) if len(word) > LONG else ()
    for n in lengths:
        parts.update(word[i : i + n] for i in range(len(word) - n + 1))
    return parts


class Features:
    """Feature numbers of a text; words met before are looked up."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.held = dimensions, {}

    def __call__(self, text: str) -> np.ndarray:
        found: set[int] = set()
        for word in set(_WORDS.findall(text.lower())):
            numbers = self.held.get(word)
            if numbers is None:
                numbers = tuple({zlib.crc32(p.encode()) % self.dimensions for p in word_parts(word)})
                if len(word) <= LONGEST:
                    if len(self.held) >= _CACHE:
                        self.held.clear()
                    self.held[word] = numbers
            found.update(numbers)
        return np.fromiter(found, np.int32, len(found))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, dimensions: int = DIMENSIONS, steps: int = STEPS) -> np.ndarray:
    """Weights, the bias last, by full-batch Adam steps on the non-negative risk with logistic loss."""
    texts = positive + unlabelled
    n_p, n_u = len(positive), len(unlabelled)
    features = np.concatenate(texts) if texts else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    frequent = np.bincount(features, minlength=dimensions) >= LEAST_TEXTS
    in_p = np.bincount(features[owner < n_p], minlength=dimensions) / n_p
    in_u = np.bincount(features[owner >= n_p], minlength=dimensions) / n_u
    pooled = (in_p * n_p + in_u * n_u) / (n_p + n_u)
    spread = np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + 1e-12)
    keep = (frequent & (np.abs(in_p - in_u) >= LEAST_DEVIATIONS * spread))[features]
    features, owner = features[keep], owner[keep]
    w, bias = np.zeros(dimensions), float(np.log(prior / (1 - prior)))
    first, second, t = np.zeros(dimensions + 1), np.zeros(dimensions + 1), 0
    is_p = np.arange(len(texts)) < n_p
    for _ in range(steps):
        logit = np.bincount(owner, weights=w[features], minlength=len(texts)) + bias
        p = _sigmoid(logit)
        negative_loss = np.logaddexp(0, logit)
        bracket = negative_loss[~is_p].mean() - prior * negative_loss[is_p].mean()
        # Slopes by the logit: of the loss as toxic p - 1, of the loss as harmless p.
        slope = np.where(is_p, -prior * p / n_p, p / n_u)
        slope = np.where(is_p, prior * (p - 1) / n_p, 0) + slope if bracket >= 0 else -slope
        gradient = np.append(np.bincount(features, weights=slope[owner], minlength=dimensions) + 1e-4 * w, slope.sum())
        t += 1
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return np.append(w, bias)


def training_texts(docs: DataFrame, labels: DataFrame, most_positive: int, most_unlabelled: int, classifiers: int, prior: float | None) -> tuple[DataFrame, float]:
    """(part, text): part -1 for confirmed toxic texts, 0 and on for each classifier's unlabelled ones; and the prior."""
    usable = docs.select("doc_id").filter(~held_out()).distinct()
    known = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(usable, "doc_id")
    toxic, labelled = known.agg(F.sum((F.col("toxic") == 1).cast("long")), F.count("*")).first()
    share = (toxic or 0) / labelled if labelled else 0.0
    prior = min(0.9, max(0.001, share if prior is None else prior)) if labelled else 0.0
    confirmed = known.filter("toxic = 1").select("doc_id", F.lit(-1).alias("part"))
    parts = usable.select("doc_id", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(classifiers)).cast("int").alias("part"))
    ids = bounded_sample(confirmed, "part", "doc_id", most_positive).unionByName(bounded_sample(parts, "part", "doc_id", most_unlabelled))
    # Ids of the sample: most_positive + classifiers * most_unlabelled at most.
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
    return texts.select("part", "doc_id", "text"), prior


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, classifiers: int = CLASSIFIERS, prior: float | None = None) -> np.ndarray | None:
    """Mean weights of the classifiers (DIMENSIONS, then the bias); None without examples."""
    texts, prior = training_texts(docs, labels, most_positive, most_unlabelled, classifiers, prior)
    if not prior:
        return None

    def featured(batches):
        numbers = Features()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["part"], batch["doc_id"], pa.array([numbers(t).tobytes() for t in batch["text"].to_pylist()], pa.binary())],
                ["part", "doc_id", "features"],
            )

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "doc_id"])
        toxic = [np.frombuffer(x, np.int32) for x in pdf.loc[pdf["part"] == -1, "features"]]
        others = [np.frombuffer(x, np.int32) for x in pdf.loc[pdf["part"] != -1, "features"]]
        if not toxic or not others:
            return pd.DataFrame({"weights": []}).astype(object)
        return pd.DataFrame({"weights": [train(toxic, others, prior).astype(np.float32).tobytes()]})

    rows = texts.select("part", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(featured, "part int, doc_id long, features binary")
    every = F.sequence(F.lit(0), F.lit(classifiers - 1))
    rows = rows.withColumn("classifier", F.explode(F.when(F.col("part") == -1, every).otherwise(F.array("part"))))
    found = rows.groupBy("classifier").applyInPandas(learn, "weights binary").collect()  # a vector for each classifier
    return np.mean([np.frombuffer(r["weights"], np.float32) for r in found], axis=0) if found else None


def toxicity(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text); ``labels`` has doc_id, toxic.

    ``bounds``: the sizes of the samples, the number of classifiers and the prior, as fit() takes them.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(fit(docs, labels, **bounds))

    def score(batches):
        weights, numbers = held.value, Features()
        for batch in batches:
            texts = batch["text"].to_pylist()
            logits = np.array([weights[numbers(t)].sum() + weights[-1] for t in texts]) if weights is not None else np.full(len(texts), -np.inf)
            scores = _sigmoid(logits.astype(np.float64)) if weights is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return chosen.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
