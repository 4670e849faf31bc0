"""Physical-plan properties of every registered query (sf0.001 plans; the shape does not depend on size)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from coheral.operators import joins as JN
from coheral.operators import ordering as O
from tests.conftest import SMALL

QUERIES = E.queries()
# queries whose builders run Spark jobs while planning (fits, folds, checkpoints) are planned the same way
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_products(spark, name):
    plan = _plan(QUERIES[name](spark, SMALL))
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans {op}"


def test_first_per_key_aggregates_map_side(spark):
    # one key holds a third of the rows
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                                   F.col("id").alias("ord"), (F.col("id") * 2).alias("v"))
    out = JN.first_per_key(df, ["k"], ["ord"], unique_order=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2 and "SortAggregate" not in plan and "Window" not in plan
    assert out.filter(F.col("k") == 0).first()["ord"] == 0


def test_prompt_dedup_does_not_sort_texts(spark):
    for name in ("dedup_prompts", "shape_prompt_texts"):
        assert "SortAggregate" not in _plan(QUERIES[name](spark, SMALL)), name


def test_global_rank_sorts_once(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"), F.lit("wide").alias("text"))
    ranked = O.global_rank(df, ["k"], "pos", num_partitions=4, key=["k"])
    plan = _plan(ranked)
    assert "hashpartitioning(_pid" not in plan and "rangepartitioning" not in plan  # cut by the checkpoint
    assert all(r["k"] == r["pos"] for r in ranked.collect())
    sliced = O.slice_rows(df, "k", 10, 20)
    assert "Exchange" not in _plan(sliced)
    assert sorted(r["k"] for r in sliced.collect()) == list(range(10, 20))


def test_topk_is_two_stage(spark):
    df = spark.range(30000).select((F.col("id") % 2).alias("g"), F.col("id"), F.rand(1).alias("v"))
    plan = _plan(O.topk_per_group(df, ["g"], [F.desc("v"), "id"], 10, salts=16))
    assert plan.count("Window") >= 2


STORY_QUERIES = ["incremental_pairs", "story_to_pairs", "story_to_pairs_multilabel", "story_to_t5_text", "story_to_t5_multilabel",
                 "story_to_prompt_completion", "pairs_to_story_format", "story_to_pairs_explode", "two_sentence_pairs", "sft_examples"]


@pytest.mark.parametrize("name", STORY_QUERIES)
def test_no_exchange_above_the_sentence_expansion(spark, name):
    plan = _plan(QUERIES[name](spark, SMALL))
    above = plan.split("Generate posexplode")[0]
    assert "Generate posexplode" in plan and "Exchange" not in above and "Join" not in above


def test_essays_are_whole(spark):
    plan = _plan(QUERIES["incremental_pairs"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan  # no language, length or id filter
    assert "LessThan" not in plan and "EqualTo" not in plan


@pytest.mark.parametrize("name", ["story_to_pairs", "story_to_t5_text", "story_to_t5_multilabel", "story_to_prompt_completion"])
def test_stories_are_dealt_by_the_id_their_labels_join(spark, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(QUERIES[name](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning(essay_id" not in plan and "hashpartitioning(ord" in plan  # one exchange of the texts
    assert "LeftSemi" in plan  # labels of other stories are not gathered
