"""Registered ``opN_<name>`` queries: each applies its operator to its whole table."""

from __future__ import annotations

from coheral.llm import (chat_windows, chosen_path, decontaminate, hyper_minhash, importance, language_id, licence_scan, maxent,
                         mixing, pii, repeats, rp_forest, vector_codes)
from coheral.llm.common import id_remainder, table
from coheral.plans.registry import Query
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Query] = {}


def _register(fn, oracle: str | None = None):
    QUERIES[fn.__name__] = Query(fn.__name__, fn, oracle, fn.__name__.split("_")[0])
    return fn


@_register
def op10_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held)
    model = language_id.fit(docs.filter("NOT held_out AND doc_id IS NOT NULL"))
    return language_id.predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")


@_register
def op7_licence_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licence_scan.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    more = F.transform("spans", lambda s: s["label"])
    best = F.array_max(F.transform("spans", lambda s: s["cover"]))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.transform("spans", lambda s: F.struct(s["label"], s["start"], s["end"])).alias("template_spans"))


def op3_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_register(op3_hypergeometric_mix, mixing.oracle())


@_register
def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(  # the planted conversation of control strings
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_windows.digests(chat_windows.read_back(chat_windows.windows(rows.unionByName(extra))))


@_register
def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_register
def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    per_kind = [F.size(F.filter("base_spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS[:pii.N_BASE]]
    base = pii.span_text(F.col("base_spans"))
    return found.select("doc_id", *per_kind, F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                        pii.span_text(F.col("spans")).alias("spans"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


@_register
def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.jaccard_join(table(spark, sf_dir, "documents"))


@_register
def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_register
def op1_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(id_remainder("doc_id", 10) == 0, F.lit(False))
    return maxent.score(table(spark, sf_dir, "documents"), held)


@_register
def op9_lyndon_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


_register(op11_vector_codes, vector_codes.oracle())


@_register
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_register
def op13_hyper_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyper_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@_register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
