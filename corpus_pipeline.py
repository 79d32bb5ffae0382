"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corelev.llm.common import table, written
from corelev.llm.decontam import contamination
from corelev.llm.line_dedup import BLANKS, line_dedup
from corelev.llm.ngram_join import set_components
from corelev.llm.packing import best_fit, token_lengths
from corelev.llm.toxicity import fit, score


def _row_key(doc_id: Column, text_key: Column) -> Column:
    """One key for id and text; rows that are alike in both share it and every decision."""
    return F.xxhash64(doc_id.cast("long"), text_key)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on this stage's documents and ``labels``, doesn't reject."""
    marked = score(docs, fit(docs, table(spark, sf_dir, "labels")), prefix="__")
    return marked.where("not __rejected").select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, documents stay; ``n_chars`` follows the text that is left (null text: as it was)."""
    out = line_dedup(docs, stats=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id, once. Texts without words all stay."""
    chosen = (set_components(docs).where("representative and component is not null")
              .select(_row_key(F.col("doc_id"), F.col("text_key")).alias("__key")).distinct())
    wordless = F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS)) == ""
    first = (docs.where(~wordless).withColumn("__key", _row_key(F.col("doc_id"), F.xxhash64("text")))
             .withColumn("__rn", F.row_number().over(Window.partitionBy("__key").orderBy("__key"))).where("__rn = 1"))
    kept = first.join(chosen, "__key", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(docs.where(wordless))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of 10 words with a benchmark item."""
    hit = contamination(docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") > 0)
    bad = hit.select(_row_key(F.col("doc_id"), F.col("text_key")).alias("__key")).distinct()
    keyed = docs.withColumn("__key", _row_key(F.col("doc_id"), F.xxhash64("text")))
    return keyed.join(bad, "__key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, packed into sequences: one row a piece."""
    return best_fit(token_lengths(docs))


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("ngram_join", near_duplicates), ("decontamination", decontaminate), ("packing", packing)]

#: The toxicity model isn't expressible in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: each is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
