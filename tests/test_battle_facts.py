"""Battles cleaned from facts found once per conversation equal those cleaned from the joined texts."""

from pyspark.sql import functions as F

from coheral.operators import arena as A

TEXTS = {"0": [["user", "Hello there"], ["assistant", "I am Cla"]], "1": [["user", "uDe is a word"], ["assistant", "yes"]],
         "2": [["user", "ask OpenAI"], ["assistant", None]], "3": [["user", "bonjour le monde"], ["assistant", "oui"], ["user", "x" * 500]],
         "4": [], "5": [["user", None]]}


def test_facts_equal_joined_texts(spark):
    ids = [*TEXTS, "gone", None]
    rows = [(i * 100 + j * 10 + o, ["leftvote", "rightvote", "tievote", "chat"][(i + j) % 4], float(i), str(j), ["", ""] if i % 2 else ["m1", "m2"],
             [(a, "m1", o), (b, "m2", 0)]) for i, a in enumerate(ids) for j, b in enumerate(ids) for o in (0, 1)]
    log = spark.createDataFrame(rows, "ord long, type string, tstamp double, ip string, models array<string>, "
                                      "states array<struct<conv_id:string,model_name:string,offset:int>>")
    messages = spark.createDataFrame(list(TEXTS.items()), "conv_id string, messages array<array<string>>")
    full = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.from_json(F.to_json(F.lit(None).cast("array<array<string>>")), "array<array<string>>") if v is None else
                                                 F.array(*[F.array(*[F.lit(x).cast("string") for x in m]) for m in v]).cast("array<array<string>>")) for k, v in TEXTS.items()]))
    joined = log.withColumn("states", F.transform("states", lambda s: F.struct(
        s["conv_id"].alias("conv_id"), s["model_name"].alias("model_name"), s["offset"].alias("offset"),
        F.when(s["conv_id"].isNotNull(), F.try_element_at(full, F.coalesce(s["conv_id"], F.lit("")))).alias("messages"))))
    kept = lambda d: sorted(map(str, d.withColumn("language", F.when(F.col("reason").isNull(), F.col("language"))).collect()))
    want = A.clean_battles(joined, exclude_models=["m9"], ban_ips=["3"])
    got = A.clean_battles(log, exclude_models=["m9"], ban_ips=["3"], messages=messages)
    assert kept(A.with_conversations(got, messages).select(want.columns)) == kept(want)
    reasons = {r["ord"]: r["reason"] for r in got.collect()}
    assert reasons[10] == "leaked_identity"  # the word begins in one conversation and ends in the other


def test_texts_do_not_meet_the_votes(spark):
    import __spark_entry__ as E
    from tests.conftest import SMALL

    for name in ("clean_battles", "drop_counters", "battle_language"):
        plan = E.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "msg0" not in plan and "head1" in plan, name
