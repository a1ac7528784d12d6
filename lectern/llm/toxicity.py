"""Toxicity by class-conditional Kneser-Ney word models.

Two bigram models, of toxic and of ordinary training texts, score a text; the difference of its
length-normalised log-likelihoods goes through a logistic curve fitted on training rows that the
counts leave out. Counts are Kneser-Ney's continuation counts at both orders: a word or bigram counts once per distinct
word before it, so copies and near copies of a text add nothing (plain counts of bigrams did worse on held-out rows). Rare expressions fall back from a class's bigrams to its word counts,
and from those to the counts that both classes share.

Counts come from Spark aggregates over the training rows: at most max_train labelled rows (by hash of
the id, in proportion over all), the documented bound of the fitting sample. The model that is sent to
tasks holds the words and bigrams counted LEAST times or more in that sample, however many; rarer ones are scored by
backoff. Discounts are estimated from how many counts are one and two. Every whole text is scored, without a shuffle.

The mean difference alone finds two toxic documents of three, as a few words make a long text toxic; so the curve
also takes the mean over the most toxic run of 8 words and the mean of what exceeds EXCESS.

Defined cases: null and empty texts, and texts without a known word, get the score of a difference of
zero; a repeated document is scored once per row; labels may repeat (a document is toxic if any of its
labels says so), null labels are left out; with no training rows of both classes every score is the training
rows' class rate, or 0.5 without any (predicted is then 1 for all: who filters by it has to ask fitted() first
whether there is a model); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import arrow_text as A
from lectern.llm.shared import discard, written

DISCOUNT, FLOOR, EXCESS = 0.75, 0.0005, 3.0
#: Words and bigrams counted less often than LEAST are scored by backoff, as are bigrams after words that either class
#: has followed by fewer than CONTEXT (an average over parts): what is left out hangs on its own counts, never on a number kept.
LEAST, CONTEXT = 3, 20
#: Ordinary rows are counted in parts of the toxic rows' number, this many at most.
MOST_PARTS = 32
WORD = re.compile(r"[^\W_]+")
UNKNOWN = "\x00"


@dataclass
class Model:
    ids: dict[str, int]
    uni: np.ndarray
    context: np.ndarray
    keys: np.ndarray
    bi: np.ndarray
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def differences(self, texts: list[str | None]) -> np.ndarray:
        """Per text, from the difference of log-likelihoods of each word: its mean, the mean over the most
        toxic run of 8 words, and the log of the mean of what exceeds EXCESS."""
        out = np.tile([0.0, 0.0, np.log(FLOOR)], (len(texts), 1))
        get, size = self.ids.get, len(self.uni)
        for k, text in enumerate(texts):
            if not text:
                continue
            i = np.array([get(w, 0) for w in WORD.findall(text.lower())], np.int64)
            if not len(i):
                continue
            x = self.uni[i]
            if len(i) > 1 and len(self.keys):
                key = i[:-1] * size + i[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                x[1:] += np.where(self.keys[at] == key, self.bi[at], self.context[i[:-1]])
            total = np.concatenate([[0.0], np.cumsum(x)])
            run = min(8, len(x))
            out[k] = x.mean(), (total[run:] - total[:-run]).max() / 8, np.log(FLOOR + np.maximum(x - EXCESS, 0).mean())
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = self.differences(texts) @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (constant first) of a logistic regression, by Newton's method on scaled columns."""
    scale = np.maximum(np.abs(x).max(axis=0, initial=0.0), 1e-12)
    z = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([w[:1], w[1:] / scale])


def discounts(pairs: DataFrame) -> dict[int, float]:
    """Per class, the discount of counts n by the usual estimate, n1 / (n1 + 2 n2), from how many are 1 and 2."""
    found = pairs.groupBy("toxic").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()
    return {r["toxic"]: min(0.95, max(0.05, r["n1"] / max(1, r["n1"] + 2 * r["n2"]))) for r in found}


def fit(rows: DataFrame, least: int = LEAST, context: int = CONTEXT) -> Model | None:
    """The model of training rows (text, toxic, part): rows of a null part fit the logistic curve. Counts
    and discounts are taken in each part and averaged over a class's parts, which hold as many rows
    each: a larger text repeats its words more, so counts of unlike sizes would not compare.
    None without rows of both classes."""
    parts = dict(rows.where("part is not null").groupBy("toxic").agg(F.countDistinct("part")).collect())
    if len(parts) < 2:
        return None
    tokens = rows.where("part is not null and text is not null").select("toxic", "part", _words(F.col("text")).alias("w"))
    # Pairs of two common words (one in a thousand each, so a thousand words at most) are made distinct before they
    # are shuffled, and over all keys, as the rows of one such pair may be very many.
    seen = written(tokens.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")), "seen")
    common = seen.join(F.broadcast(seen.agg(F.sum("n").alias("all"))), F.col("n") * 1000 >= F.col("all")).select("w")
    grams = tokens.select("toxic", "part", F.explode(F.transform("w", lambda w, i: F.struct(
        F.coalesce(F.get("w", i - 2), F.lit("")).alias("u"), F.coalesce(F.get("w", i - 1), F.lit("")).alias("v"), w.alias("w")))).alias("g"))
    grams = grams.select("toxic", "part", "g.v", "g.w", F.xxhash64("g.u").alias("u"))
    grams = grams.join(F.broadcast(common.select("w", F.lit(True).alias("often"))), "w", "left").join(F.broadcast(common.select(F.col("w").alias("v"), F.lit(True).alias("before"))), "v", "left")
    both = F.coalesce(F.col("often") & F.col("before"), F.lit(False))
    keys = ["toxic", "part", "v", "w"]
    # Of other pairs one shuffle serves both aggregates: a bigram's rows meet, and its contexts are counted once each.
    rare = grams.where(~both).select(*keys, "u").repartition("v", "w").groupBy(*keys, "u").agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count("*").alias("n"))
    pairs = written(rare.unionByName(grams.where(both).select(*keys, "u").distinct().groupBy(*keys).agg(F.count("*").alias("n"))), "bigrams")
    followers = written(pairs.groupBy("toxic", "part", "w").agg(F.count("*").alias("n")), "followers")

    def averaged(df: DataFrame, off: dict[int, float], *keys: str) -> DataFrame:
        """Of both classes: n, the counts, and d, the discounted counts, as averages over parts."""
        per = {c: F.col("toxic") == c for c in (0, 1)}
        return df.groupBy(*keys).agg(
            F.sum("n").alias("n"),
            *((F.sum(F.when(per[c], F.col("n"))) / parts[c]).alias(f"n{c}") for c in (0, 1)),
            *((F.sum(F.when(per[c], F.greatest(F.col("n") - off.get(c, DISCOUNT), F.lit(0.0)))) / parts[c]).alias(f"d{c}") for c in (0, 1)),
        ).na.fill(0)

    one, two = discounts(followers), discounts(pairs)
    words = written(averaged(followers, one, "w"), "words")
    known = written(words.where(F.col("n") >= least), "known")
    total = words.agg(*(F.sum(f"{x}{c}").alias(f"{x}{c}") for x in "nd" for c in (0, 1))).first()
    if total is None or not total["n0"] or not total["n1"]:
        return None
    vocabulary = known.toArrow()
    names = vocabulary.column("w").to_pylist()
    ids = {w: i + 1 for i, w in enumerate(names)}
    size = len(names) + 1
    n, d = np.zeros((2, size)), np.zeros((2, size))
    for x, at in ((n, "n"), (d, "d")):
        for c in (0, 1):
            x[c, 1:] = vocabulary.column(f"{at}{c}").to_numpy()
            x[c, 0] = max(0.0, total[f"{at}{c}"] - x[c].sum())
    of = n.sum(axis=1, keepdims=True)
    share = n[0] * parts[0] + n[1] * parts[1] + 1e-9  # the counts of both classes' texts together
    share /= share.sum()
    p = d / of
    p += (1 - p.sum(axis=1, keepdims=True)) * share

    # The vocabulary is part of the model that all tasks get; its bound is the sample's.
    inside = pairs.join(F.broadcast(known.select(F.col("w").alias("v"))), "v")
    contexts = written(averaged(inside, two, "v").where(F.least("n0", "n1") >= context), "contexts")
    often = averaged(inside.join(F.broadcast(known.select("w")), "w").join(F.broadcast(contexts.select("v")), "v"), two, "v", "w").where(F.col("n") >= least).toArrow()
    contexts_ = contexts.toArrow()
    whole, used = np.zeros((2, size)), np.zeros((2, size))
    at = np.array([ids[v] for v in contexts_.column("v").to_pylist()], np.int64)
    v = np.array([ids[x] for x in often.column("v").to_pylist()], np.int64)
    w = np.array([ids[x] for x in often.column("w").to_pylist()], np.int64)
    for c in (0, 1):
        whole[c, at] = contexts_.column(f"n{c}").to_numpy()
        used[c, at] = contexts_.column(f"d{c}").to_numpy()
    left = np.where(whole > 0, np.maximum(1 - used / np.maximum(whole, 1e-9), 0.01), 1.0)
    count = np.stack([often.column(f"d{c}").to_numpy() for c in (0, 1)])
    bi = np.log(count / whole[:, v] + left[:, v] * p[:, w]) - np.log(p[:, w])
    key = v * size + w
    order = np.argsort(key)
    model = Model(ids, np.log(p[1]) - np.log(p[0]), np.log(left[1]) - np.log(left[0]), key[order], (bi[1] - bi[0])[order])
    discard(seen, pairs, followers, words, known, contexts)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            x = model.differences(A.column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([A.column(batch, "toxic"), *(pa.array(x[:, k].copy()) for k in range(3))], ["toxic", "x0", "x1", "x2"])

    fitting = rows.where("part is null").select("text", "toxic").mapInArrow(measure, "toxic int, x0 double, x1 double, x2 double").toArrow()
    y = fitting.column("toxic").to_numpy().astype(float)
    if len(y):
        model.weights = tuple(logistic(np.column_stack([fitting.column(f"x{k}").to_numpy() for k in range(3)]), y))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """Rows (text, toxic, part) to learn from: labelled, not held out, about max_train at most. A quarter
    has a null part; the rest of the larger class is dealt into parts of the smaller one's size."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    sizes = dict(known.groupBy("toxic").count().collect())
    most = sum(sizes.values())
    if most > max_train:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_train / most))
    least = max(1, min(sizes.get(0, 0), sizes.get(1, 0)))
    deal = [min(MOST_PARTS, max(1, round(sizes.get(c, 0) / least))) for c in (0, 1)]
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.when(F.col("toxic") == 1, deal[1]).otherwise(deal[0]))
    fits = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 4
    known = known.withColumn("part", F.when(~fits, part.cast("int")))
    return written(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic", "part"), "training")


def fitted(docs: DataFrame, labels: DataFrame, max_train: int = 40_000) -> Model | float:
    """The model of docs (doc_id, text) and labels (doc_id, toxic); where labels of both classes are not at hand, the
    share of toxic ones instead (0.5 without any)."""
    rows = training_rows(docs, labels, max_train)
    model = fit(rows)
    if model is None:
        rate = rows.agg(F.avg("toxic")).first()[0]
        model = 0.5 if rate is None else float(rate)
    discard(rows)
    return model


def scored(docs: DataFrame, model: Model | float) -> DataFrame:
    """docs (doc_id, text) with held_out, score and predicted."""
    docs = docs.select("doc_id", "text")
    if not isinstance(model, Model):
        out = docs.select("doc_id", F.lit(model).alias("score"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in A.slices(batches, "text"):
                yield pa.RecordBatch.from_arrays(
                    [A.column(batch, "doc_id"), pa.array(model.scores(A.column(batch, "text").to_pylist()))], ["doc_id", "score"])

        out = docs.mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = 40_000) -> DataFrame:
    """docs (doc_id, text) with held_out, score and predicted."""
    return scored(docs, fitted(docs, labels, max_train))
