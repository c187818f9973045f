"""Corpus preparation: quality rules, language ID, near duplicates, repeated passages, packing.

Every stage reads what its predecessor wrote; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import jaccard, langid, packing, quality, substrings
from strataq.llm.common import stored

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the quality rules keeps.

    A null or empty text has too few words and goes; repeated rows are judged one by one; an
    empty table stays empty; all columns are kept, whatever their names.
    """
    return quality.filtered(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: a null text, one without letters, and one without a clear language go.

    Repeated rows are judged one by one; an empty table stays empty; all columns are kept,
    whatever their names.
    """
    found = langid.identify(carried(docs, "doc_id", "text", "lang"))
    known = found.agg(F.count_distinct("lang").alias("n")).first()["n"]
    # A third of the way from chance to certainty.
    least = F.lit(1 / 3 + 2 / 3 / max(known, 1)) if known > 1 else F.lit(0.5)
    return returned(found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least)), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id; a null id is never linked."""
    copies = jaccard.classes(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(copies, "doc_id", "left_anti")
    again = docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start in an earlier document; a text that is nothing else goes.

    ``n_chars`` follows the text. A null text stays null; rows with the same id, or none, take
    nothing from each other; an empty table stays empty; all columns are kept, whatever their
    names.
    """
    found = substrings.dedup(carried(docs, "doc_id", "text")).filter("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    out = returned(found.withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text"))), docs.columns, "n_removed")
    size = F.when(F.col("_n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", size).select(*(F.col(f"`{c}`") for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens, as the pieces and their places; a null text is an empty one, and an empty table gives no sequence."""
    return packing.digest(docs)


def carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator needs; all others as one, so that their names can't clash with those that it adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*(others or [F.lit(None).alias("none")])).alias("row"))


def returned(rows: DataFrame, columns: list[str], *also: str) -> DataFrame:
    """The columns as they were before ``carried``; those of ``also`` with an underscore before their name."""
    top = {c for c in rows.columns if c != "row"}
    inner = set(rows.schema["row"].dataType.names)
    return rows.select(*((F.col("row").getField(c) if c in inner else F.col(f"`{c}`")).alias(c) for c in columns if c in inner | top), *(F.col(c).alias(f"_{c}") for c in also))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Language ID and packing need trained weights and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
