"""Corpus pipeline: language ID, near duplicates, decontamination, personal data, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet into the shared folder of ``spark.checkpoint.dir`` and reads it again
as the next stage's ``docs``.  All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from coheral.llm import chosen_path, decontaminate, language_id, mixing, pii
from coheral.llm.common import SPACE_WORD, id_remainder, table
from coheral.session import checkpoint_dir, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_LANGUAGE_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letters, or under a fifth of their n-grams known to any language.

    The filters learn from the rows whose crc32(doc_id) mod 5 is not 0 and whose lang is known.
    """
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs.filter(id_remainder("doc_id", 5) != 0))
    found = language_id.predict(docs, model)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def _row_key() -> Column:
    """Key of a row as a string that sorts by id, rows without one last: id and hash of all columns.

    Rows with one key are the same row.
    """
    sortable = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    whole = F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"})
    return F.concat_ws(":", F.coalesce(sortable, F.lit("~")), F.md5(whole.cast("binary")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near copies, the one with the least id (one with an id before one without).

    Rows are told apart by id and content, so texts under one id, or none, are compared like
    any others; rows without an id and without a word all stay.
    """
    docs = docs.select(*COLUMNS)
    bare = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(SPACE_WORD), F.lit(False))
    keyed = docs.filter(~bare).withColumn("row_key", _row_key())
    first = chosen_path.jaccard_join(keyed, "row_key", kind="string").filter("doc_id = class_id").select(F.col("doc_id").alias("row_key")).distinct()
    kept = keyed.join(first, "row_key", "left_semi").dropDuplicates(["row_key"])
    return kept.select(*COLUMNS).unionByName(docs.filter(bare))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, its parameters changed or not; each row is judged by its own text."""
    docs = docs.select(*COLUMNS)
    leaks = decontaminate.find_leak_rows(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_key").distinct()
    leaks = leaks.select(F.col("doc_id").alias("leak"), F.col("text_key").alias("leak_text"))
    same = F.col("doc_id").eqNullSafe(F.col("leak")) & (decontaminate.text_key(F.col("text")) == F.col("leak_text"))
    return docs.join(leaks, same, "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; n_chars follows the text."""
    docs = docs.select(*COLUMNS)
    clean = pii.redact(pii.find(docs, pii.fit(docs)))
    n_chars = F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))
    return clean.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, with size, source_size, target and taken (words to take, repeats counted)."""
    docs = docs.select(*COLUMNS).withColumn("size", F.coalesce(
        F.regexp_count("text", F.lit(mixing.SPACE_WORD)), F.lit(0)).cast("long"))
    # rows with one id, or none, are told apart by a number
    same = ["doc_id", "source", "size"]
    numbered = docs.withColumn("nth", F.row_number().over(W.Window.partitionBy(*same).orderBy("text", "lang")))
    taken = mixing.taken_words(docs)
    taken = taken.withColumn("nth", F.row_number().over(W.Window.partitionBy(*same).orderBy("copy"))).filter("taken > 0")
    taken = taken.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), F.col("nth").alias("k"),
                         "source_size", "target", "taken")
    on = (F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s"))
          & (F.col("size") == F.col("z")) & (F.col("nth") == F.col("k")))
    return numbered.join(taken, on).select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", mix),
]

# The language filters and the chosen-path join have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; stage results stay in the shared folder."""
    ship_package(spark)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
