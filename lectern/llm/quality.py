"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of a text are Spark expressions. A random forest on labelled rows gives paths, each a
conjunction of thresholds on statistics; a logistic regression with a lasso penalty weighs them, most
at zero; what is left is compiled into one Spark column expression, so scoring runs in the JVM over
whole texts, without a shuffle or Python.

The fit uses at most max_train labelled rows (by hash of the id), the documented bound of its sample.

Defined cases: null and empty texts have statistics of zero and get those statistics' score; a
repeated document is scored once per row; of repeated labels the largest counts, null labels none; with
rows of one class only, or none, the score is that class's rate or 0.5 (1 then predicted); where equal statistics have
both labels and no tree splits, it is the rate of label 1; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import written


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _counts(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [t.alias("t"), F.split(F.trim(t), r"\s+").alias("w")]


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """docs with `keep` and a struct `s` of statistics of `text`."""
    rows = docs.select(*keep, *_counts(F.col("text")))
    n = F.greatest(F.char_length("t"), F.lit(1)).cast("double")
    words = F.greatest(F.size("w"), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return (F.char_length("t") - F.char_length(F.regexp_replace("t", pattern, ""))) / n

    def ascii_share(*characters: str) -> Column:
        """The same for single ASCII characters, without patterns."""
        return sum((F.octet_length("t") - F.octet_length(F.replace("t", F.lit(c), F.lit(""))) for c in characters), F.lit(0)) / n

    stats = {
        "chars": F.log1p(F.char_length("t").cast("double")),
        "words": F.log1p(F.when(F.col("t") == "", 0.0).otherwise(words)),
        "word_chars": n / words,
        "upper": share(r"\p{Lu}+"),
        "digits": share(r"\p{N}+"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:'\"-]+"),
        "stops": ascii_share(".", "?"),
        "commas": ascii_share(","),
        "breaks": ascii_share("\n"),
        "bars": ascii_share("|"),
        "shouts": ascii_share("!"),
        "distinct": F.size(F.array_distinct("w")) / words,
        "repeats": F.size(F.filter("w", lambda x, i: (i > 0) & (x == F.get("w", i - 1)))) / words,
        "short": F.size(F.filter("w", lambda x: F.char_length(x) <= 3)) / words,
        "long": F.size(F.filter("w", lambda x: F.char_length(x) >= 14)) / words,
    }
    return rows.select(*keep, F.struct(*[v.cast("double").alias(k) for k, v in stats.items()]).alias("s"))


def rules_of(model, names: list[str]) -> list[tuple[tuple[str, str, float], ...]]:
    """All paths from a root to any node of a forest, as conjunctions of (statistic, <= or >, threshold)."""
    found: dict[tuple, None] = {}
    path: list[tuple[str, str, float]] = []
    for line in model.toDebugString.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-0-9.eE]+)\)", line)
        if not m:
            if line.lstrip().startswith("Tree"):
                path, root = [], len(line) - len(line.lstrip())
            continue
        depth = len(m[1]) - root - 1
        path = [*path[:depth], (names[int(m[2])], m[3], float(m[4]))]
        bounds: dict[tuple[str, str], float] = {}
        for name, side, at in path:
            old = bounds.get((name, side))
            bounds[name, side] = at if old is None else (min if side == "<=" else max)(old, at)
        found[tuple(sorted((name, side, at) for (name, side), at in bounds.items()))] = None
    return list(found)


def _holds(rule: tuple[tuple[str, str, float], ...], stats: str = "s") -> Column:
    out = F.lit(True)
    for name, side, at in rule:
        c = F.col(f"{stats}.{name}")
        out = out & ((c <= at) if side == "<=" else (c > at))
    return out


def rate_only(rate: float) -> float:
    """The constant of a model without rules that scores every text with this rate, of 1e-12 to 1 less it."""
    rate = min(max(rate, 1e-12), 1 - 1e-12)
    return math.log(rate / (1 - rate))


def fit(rows: DataFrame, trees: int = 20, depth: int = 3, lasso: float = 0.001) -> tuple[float, list[tuple[tuple, float]]]:
    """(constant, [(rule, weight)]) of rows (s, label), a bounded sample; weights of zero are left out. Without
    rows of both classes, or where no tree finds a split, there are no rules and the constant gives the rate."""
    names = rows.schema["s"].dataType.names
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return rate_only(next(iter(seen), 0.5)), []
    # The sample is small: two partitions keep the optimiser's many passes from being mostly task starts.
    vectors = rows.coalesce(2).select("label", array_to_vector(F.array(*[F.col(f"s.{x}") for x in names])).alias("features"), "s").persist()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="onethird", subsamplingRate=0.5).fit(vectors)
    rules = rules_of(forest, names)
    if not rules:
        vectors.unpersist()
        return rate_only(seen[1] / (seen[0] + seen[1])), []
    held = vectors.select("label", array_to_vector(F.array(*[_holds(r).cast("double") for r in rules])).alias("features")).persist()
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=100).fit(held)
    vectors.unpersist()
    held.unpersist()
    weights = model.coefficients.toArray().tolist()
    return float(model.intercept), [(r, w) for r, w in zip(rules, weights, strict=True) if w]


def compiled(constant: float, rules: list[tuple[tuple, float]]) -> Column:
    """The score, between 0 and 1, as an expression over the statistics in s."""
    total = F.lit(constant)
    for rule, weight in rules:
        total = total + F.when(_holds(rule), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def quality(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> DataFrame:
    """docs (doc_id, text) with held_out, score and predicted."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    n = known.count()
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_train / n))
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rules = fit(written(statistics(train, "label"), "statistics"))
    out = statistics(docs.select("doc_id", "text"), "doc_id").withColumn("score", compiled(*rules))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
