"""Toxicity by a classifier chain: linear models in sequence, each fed the probabilities of the earlier categories.

Fitting uses a bounded sample of labelled rows, `sample` distinct texts at most, taken in hash order of the text; near
copies among them (texts that share the least hashes of their words) are learned from once, by the text of the least
hash and its labels. For each category the `terms` words or word beginnings (of 4 to 6 letters, for inflected and
compounded languages) whose document counts tell it best (the likelihood ratio G2, in at least `least` texts) are
counted on Spark; the models (ridge-penalised logistic regression, Newton's method) are fitted on the sample's word sets.
A later model sees the logits of the earlier ones: while fitting, out-of-fold predictions over `folds` folds, whose
terms are chosen without the fold too, so it learns from what they say about texts that they haven't seen. Scoring is
one pass over whole texts.

Defined cases: a null or empty text has no words and gets the intercepts' probability; rows with a null label in any
category are not learned from; without labelled rows, or with one class only, a category's model is its smoothed
base rate; repeated rows and null ids are kept in the scores; repeated texts are learned from once, with the
labels of the smallest doc_id; near copies once, too; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, TERMS, FOLDS, LEAST, RIDGE = 20_000, 96, 5, 3, 0.3
CATEGORIES = ("low_quality", "toxic")
LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)


def features(text: str) -> set[str]:
    """The distinct lower-case words, and the beginnings of longer ones with an asterisk."""
    words = set(LETTERS.findall(text.lower()))
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in STEMS))


@dataclass
class Chain:
    categories: tuple[str, ...]
    terms: dict[str, int]
    weights: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """A column for each category, from rows of word indicators."""
        for w in self.weights:
            x = np.hstack([x, (x @ w[:-1] + w[-1])[:, None]])
        return x[:, len(self.terms) :]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights and intercept (last, unpenalised but for a trace that keeps one-class data finite)."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, sample: int = SAMPLE, terms: int = TERMS, folds: int = FOLDS, least: int = LEAST) -> Chain:
    """The chain fitted on docs (doc_id, text) and labels (doc_id, one 0/1 column for each category)."""
    said = F.arrow_udf(lambda array: pa.array([list(features(x or "")) for x in array.to_pylist()], pa.list_(pa.string())), "array<string>")
    labels = labels.select(F.col("doc_id").alias("_id"), *categories).dropna()
    # Texts are hashed before the join, so that only hashes are shuffled.
    rows = docs.select("doc_id", F.xxhash64("text").alias("h")).where("text IS NOT NULL").join(labels, F.col("doc_id") == F.col("_id"))
    first = rows.groupBy("h").agg(F.min(F.struct("doc_id", *categories)).alias("r")).select("h", "r.*")
    first = first.orderBy("h").limit(sample)
    texts = docs.select(F.col("doc_id").alias("_d"), "text").join(F.broadcast(first), F.col("_d") == F.col("doc_id")).where(F.xxhash64("text") == F.col("h"))
    texts = texts.select("h", *categories, said(F.col("text")).alias("words"))
    # Near copies share the least hashes of their words: one of them speaks for all.
    alike = F.slice(F.array_sort(F.transform("words", lambda w: F.xxhash64(w))), 1, 4)
    texts = texts.withColumn("alike", alike).groupBy("alike").agg(F.min_by(F.struct("h", *categories, "words"), "h").alias("r")).select("r.*")
    texts = texts.persist()
    fold = F.pmod("h", F.lit(folds)).cast("int")
    sums = [F.count(F.lit(1)), *(F.sum(c) for c in categories)]
    totals = np.zeros((folds, 1 + len(categories)))
    for r in texts.groupBy(fold.alias("f")).agg(*sums).collect():  # a row a fold
        totals[r[0]] = [x or 0 for x in r[1:]]
    # Of each word, how many texts have it: in all, then without each fold. The same of each category.
    without = [F.lit(True), *(fold != f for f in range(folds))]
    words = texts.select("h", F.explode("words").alias("word"), *categories).where("word <> ''")
    seen = [F.count_if(w).alias(f"n{v}") for v, w in enumerate(without)] + [F.sum(F.when(w, F.col(c)).otherwise(0)).alias(f"c{j}_{v}") for j, c in enumerate(categories) for v, w in enumerate(without)]
    counts = words.groupBy("word").agg(*seen).where(F.col("n0") >= least)
    whole = [totals.sum(axis=0), *(totals.sum(axis=0) - totals[f] for f in range(folds))]

    def g2(j: int, v: int) -> Column:
        n, pos = (float(x) for x in (whole[v][0], whole[v][1 + j]))
        has, hit = F.col(f"n{v}"), F.col(f"c{j}_{v}")
        table = [(hit, pos, has), (pos - hit, pos, n - has), (has - hit, n - pos, has), (n - pos - has + hit, n - pos, n - has)]
        return sum((F.when((x > 0) & (side > 0), x * F.log(x * F.lit(n) / (F.lit(of) * side))).otherwise(0.0) for x, of, side in table), F.lit(0.0))

    each = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(v).alias("v"), F.round(g2(j, v), 9).alias("g2")) for j in range(len(categories)) for v in range(folds + 1)))).alias("r")
    best = F.row_number().over(Window.partitionBy("r.j", "r.v").orderBy(F.desc("r.g2"), "word"))
    chosen = counts.select("word", each).where("r.g2 > 0").withColumn("k", best).where(F.col("k") <= terms).select("word", "r.j", "r.v", "k").orderBy("j", "v", "k").collect()
    index = {w: k for k, w in enumerate(dict.fromkeys(r[0] for r in chosen))}
    inside = np.zeros((folds + 1, len(index)), bool)  # the terms of each variant: all, then without each fold
    for word, _, v, _ in chosen:
        inside[v, index[word]] = True
    known = F.array(*map(F.lit, index)) if index else F.array().cast("array<string>")
    held = texts.select("h", F.array_intersect("words", known).alias("words"), *categories).orderBy("h").collect()  # bounded by the sample
    texts.unpersist()
    x, y = np.zeros((len(held), len(index))), np.zeros((len(held), len(categories)))
    part = np.array([r["h"] % folds for r in held], dtype=np.int64)
    for k, r in enumerate(held):
        x[k, [index[w] for w in r["words"]]] = 1
        y[k] = [r[c] for c in categories]
    return Chain(tuple(categories), *chain(x, y, part, inside, index))


def chain(x: np.ndarray, y: np.ndarray, part: np.ndarray, inside: np.ndarray, index: dict[str, int]) -> tuple[dict[str, int], list[np.ndarray]]:
    """The terms of all texts and the models of each category, later ones with the out-of-fold logits of the earlier."""
    terms, weights, logits = np.flatnonzero(inside[0]), [], np.zeros((len(x), 0))
    for j in range(y.shape[1]):
        weights.append(logistic(np.hstack([x[:, terms], logits]), y[:, j]))
        unseen = np.zeros(len(x))
        for f in range(len(inside) - 1):
            out, mine = part == f, np.hstack([x[:, inside[f + 1]], logits])
            w = logistic(mine[~out], y[~out, j])
            unseen[out] = mine[out] @ w[:-1] + w[-1]
        logits = np.hstack([logits, unseen[:, None]])
    names = list(index)
    return {names[t]: k for k, t in enumerate(terms)}, weights


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, and a probability for each category) of each row of docs."""
    index, n = chain.terms, len(chain.terms)

    @F.arrow_udf("array<double>")
    def judge(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = index.keys()
        for array in arrays:
            x = np.zeros((len(array), n))
            for k, text in enumerate(array.to_pylist()):
                if text:
                    x[k, [index[w] for w in known & features(text)]] = 1
            p = 1 / (1 + np.exp(-np.clip(chain.logits(x), -30, 30)))
            yield pa.array(list(p), pa.list_(pa.float64()))

    rows = docs.select("doc_id", judge(F.col("text").cast("string")).alias("p"))
    return rows.select("doc_id", *(F.col("p")[k].alias(f"p_{c}") for k, c in enumerate(chain.categories)))
