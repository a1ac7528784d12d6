"""Language identification by words first, then shorter and shorter character n-grams.

A known word scores each language by its log frequency there. A word that training did not keep falls
back to its character n-grams of 4 letters (word ends count), or where none of those is known to 3, 2
and 1; the n-grams found score in its place. A text's language has the largest sum; its score is the
share of that language after a softmax over the sums (of 30 words at most, so that longer texts don't
all score 1).

The tables hold all words of a bounded sample, MAX_DOCS texts a language (by hash of the id), and all their n-grams.
They are the only data sent to tasks; every whole text is scored without a shuffle.

Defined cases: a null text, or one without a letter, gives `und` and 0.0, as does every text where
nothing could be learned; ties go to the language that sorts first; repeated rows are scored once
each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import arrow_text as A
from lectern.llm.shared import discard, written

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The bound of the sample that the tables are learned from: so many texts of each language, about.
MAX_DOCS = 3000
ORDERS = (4, 3, 2, 1)
SMOOTH = 0.5


def learnable(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def _table(counts: DataFrame, key: str, languages: list[str]) -> tuple[list[str], np.ndarray]:
    rows = counts.groupBy(key).pivot("lang", languages).agg(F.sum("n")).na.fill(0).toArrow()
    n = np.column_stack([rows.column(x).to_numpy() for x in languages]).astype(float) if rows.num_rows else np.zeros((0, len(languages)))
    return rows.column(key).to_pylist(), n


class Model:
    def __init__(self, languages: list[str], words: tuple[list[str], np.ndarray], grams: tuple[list[str], np.ndarray]):
        self.languages = languages
        self.words = {w: i for i, w in enumerate(words[0])}
        self.grams = {g: i + len(words[0]) for i, g in enumerate(grams[0])}
        parts = []
        sizes = np.array([len(g) for g in grams[0]], np.int64)
        n = words[1]
        parts.append(np.log((n + SMOOTH) / (n.sum(axis=0) + SMOOTH * max(1, len(n)))))
        rest = np.zeros_like(grams[1])
        for k in ORDERS:
            own = grams[1][sizes == k]
            # n-grams of a word overlap, so each counts for a part of one.
            rest[sizes == k] = np.log((own + SMOOTH) / (own.sum(axis=0) + SMOOTH * max(1, len(own)))) / k
        parts.append(rest)
        rows = np.concatenate(parts).astype(np.float32)
        self.rows = rows - rows.max(axis=1, keepdims=True) if len(rows) else rows

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.languages:
            return "und", 0.0
        known, gram = self.words.get, self.grams.get
        found = []
        for w in words:
            i = known(w)
            if i is not None:
                found.append(i)
                continue
            padded = f"\x02{w}\x03"
            for k in ORDERS:
                ids = [i for i in map(gram, [padded[j : j + k] for j in range(max(1, len(padded) - k + 1))]) if i is not None]
                if ids:
                    found += ids
                    break
        if not found:
            total = np.zeros(len(self.languages))
        else:
            total = self.rows[found].sum(axis=0, dtype=np.float64) * (min(30, len(words)) / len(words))
        e = np.exp(total - total.max())
        best = int(total.argmax())
        return self.languages[best], float(e[best] / e.sum())


def fit(rows: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """The model of rows (doc_id, text, lang), each of them learnable: all words of a sample of max_docs texts a language."""
    rows = rows.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], ([], np.zeros((0, 0))), ([], np.zeros((0, 0))))
    unit = 1 << 20
    part = F.coalesce(*[F.when(F.col("lang") == x, int(unit * min(1.0, max_docs / sizes[x]))) for x in languages], F.lit(0))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(unit)) < part)
    tokens = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}[\p{L}\p{M}]*)"))).alias("w"))
    counts = written(tokens.groupBy("w", "lang").agg(F.count("*").alias("n")), "words")
    words = _table(counts, "w", languages)
    padded = F.concat(F.lit("\x02"), "w", F.lit("\x03"))

    def runs(k: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(padded) - (k - 1)))
        return F.transform(places, lambda i: F.substring(padded, i, F.lit(k)))

    pieces = F.flatten(F.array(*map(runs, ORDERS)))
    grams = counts.select("lang", "n", F.explode(pieces).alias("g")).groupBy("g", "lang").agg(F.sum("n").alias("n"))
    model = Model(languages, words, _table(grams, "g", languages))
    discard(counts)
    return model


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) with held_out, lang_pred and score; lang is only learned from, where
    learnable(doc_id)."""
    model = fit(docs.select("doc_id", "text", "lang").where(learnable(F.col("doc_id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            found = [model.predict(t) for t in A.column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [A.column(batch, "doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
