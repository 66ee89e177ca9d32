"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. A stage works on every row that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalis.llm.chosen_path import jaccard_join
from curalis.llm.common import stage, working
from curalis.llm.mixing import poisson_mix
from curalis.llm.packing import pack
from curalis.llm.quality import quality_rules
from curalis.llm.suffix_dedup import suffix_dedup

#: Strings of so many bytes count as passages: 50 words are longer where a word and its blank have 4.8 bytes or more.
PASSAGE_BYTES = 240
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _key(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("_key", F.sha2(F.coalesce("text", F.lit("")), 256))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rows are told apart by a hash of id and text, so ids may be null or repeated.

    Null and empty texts have fewer words than the rules ask for and go; repeated rows are judged alike; an empty table gives an empty result.
    """
    rows = docs.select(*COLUMNS).withColumn("_row", F.xxhash64("doc_id", "text"))
    kept = quality_rules(rows, key="_row").where("kept").select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates; a repeated row once.

    Rows are told apart by a hash of id and text, so ids may be repeated; rows without id come after those with one. A null or empty text
    is in no group and stays. Of equal ids in a group the least hash stays. An empty table gives an empty result.
    """
    rows = docs.select(*COLUMNS).withColumn("_row", F.xxhash64("doc_id", "text"))
    with working(spark) as keep:
        classes = stage(jaccard_join(rows, key="_row").groupBy(F.col("doc_id").alias("_row")).agg(F.min("class_id").alias("_class"), F.count("*").alias("rows")), "classes")
        named = rows.select("_row", "doc_id").join(classes, "_row")
        best = named.groupBy("_class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row", "rows")).alias("b"))
        kept = keep(stage(best.select("b._row", "b.rows"), "kept"))
    rows = rows.join(kept.select("_row"), "_row", "left_semi")
    if kept.where("rows > 1").limit(1).count():
        rows = rows.dropDuplicates(["_row"])
    return rows.select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of ``PASSAGE_BYTES`` that occur elsewhere too; documents of which nothing is left go.

    Null and shorter texts stay as they are. A repeated row, or a row with another's text, loses all of
    it. Rows without id are judged like others; an empty table gives an empty result.
    """
    cut = suffix_dedup(docs, length=PASSAGE_BYTES, with_text=True).where("n_removed > 0").select(F.col("digest").alias("_key"), "kept_text").distinct()
    rows = _key(docs).join(cut, "_key", "left")
    text = F.when(F.col("kept_text").isNotNull(), F.col("kept_text")).otherwise(F.col("text"))
    changed = F.col("kept_text").isNotNull()
    return rows.where(~changed | (F.length(F.trim("kept_text")) > 0)).select(
        "doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target shares and shuffled.

    Null ids, texts and sources are rows like others; equal rows are drawn alike; an empty table gives an empty result.
    """
    return poisson_mix(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids.

    A null text is packed as an empty one (its end mark alone); repeated rows are packed each; an empty table gives an empty result.
    """
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mixing", mixing),
    ("packing", packing),
]

#: Fertility bands, sampled paths and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
