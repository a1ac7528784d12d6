"""Corpus pipeline: from `documents` to encoded training texts.

Stages, in order: toxic documents go; of near copies (five-word shingles, a similarity of 0.8 or more) the
one with the smallest id stays; passages of 200 bytes or more that also stand elsewhere are cut out of
texts; documents that hold benchmark items go; texts are encoded. Each stage's result is written as
Parquet in the shared folder and read again as the next one's documents, so a stage that fails is run
again from there. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontamination, minhash, suffix_dedup, toxicity
from lectern.llm.queries import byte_bpe
from lectern.llm.shared import table, written

#: SQL can't express the trained model, the minima of hashes or the encoding; tests hold stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the toxicity operator predicts to be ordinary; rows with a null id stay, and so do all rows where
    no model can be fitted (no learnable labels, or of one class only), as then nothing tells documents apart."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    if not isinstance(model, toxicity.Model):
        return docs
    scored = toxicity.scored(docs, model)
    return docs.join(scored.where("predicted = 1").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that reach a smaller id over near-duplicate links; rows with a null id stay."""
    found = minhash.near_duplicates(docs, words=5)
    return docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with repeated passages cut out of their texts (whole characters); null texts stay null."""
    cut = suffix_dedup.remove_repeats(docs, whole_characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    columns = {"text": text} | ({"n_chars": F.coalesce(F.char_length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return cut.withColumns(columns).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that hold no benchmark item; rows with a null id stay."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the token ids of their texts and their number."""
    return bpe.encode(docs, byte_bpe()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result, each stage written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
