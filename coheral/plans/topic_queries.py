"""Registered queries: embedding clusters, prompt dedup and shaping, cluster summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coheral.operators import topics as T
from coheral.operators.external import llm_map
from coheral.operators.semantic import fit_semantic, semantic_embedding
from coheral.operators.ward import hierarchical_topics
from coheral.plans.metric_queries import _r
from coheral.plans.oracle_fixtures import with_fixtures
from coheral.plans.registry import query
from coheral.sources.tables import Tables


def _emb(spark, sf_dir) -> DataFrame:
    return Tables(spark, sf_dir).embeddings


_CENTRES = ("c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) "
            "AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) x "
            "GROUP BY label, i) y GROUP BY label), "
            "s AS (SELECT e.label, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.centre) AS cos "
            "FROM embeddings e JOIN c ON e.label = c.label)")


@query("cluster_share", "A29", "SELECT label, COUNT(*) AS size, round(COUNT(*) / (SELECT COUNT(*) FROM embeddings), 6) "
                                "AS share FROM embeddings GROUP BY label")
def q_cluster_share(spark, sf_dir):
    return T.cluster_share(_emb(spark, sf_dir))


@query("relabel_by_size", "D12", "WITH s AS (SELECT label, COUNT(*) AS size FROM embeddings GROUP BY label), "
                                  "m AS (SELECT label, CAST(row_number() OVER (ORDER BY size DESC, label) - 1 AS INTEGER) AS new_label "
                                  "FROM s) SELECT e.vec_id, m.new_label FROM embeddings e JOIN m ON e.label = m.label")
def q_relabel_by_size(spark, sf_dir):
    return T.relabel_by_size(_emb(spark, sf_dir)).select("vec_id", "new_label")


@query("cluster_topk", "D11 F23", f"WITH {_CENTRES}, "
                                  "k AS (SELECT least(20, min(n)) AS k FROM (SELECT COUNT(*) AS n FROM embeddings GROUP BY label) z) "
                                  "SELECT label, vec_id, CAST(rank AS INTEGER) AS rank, round(cos, 6) AS cos FROM (SELECT *, row_number() OVER "
                                  "(PARTITION BY label ORDER BY cos DESC, vec_id) AS rank FROM s) r "
                                  "WHERE rank <= (SELECT k FROM k)")
def q_cluster_topk(spark, sf_dir):
    t = T.cluster_topk(_emb(spark, sf_dir), 20)
    return _r(t.select("label", "vec_id", "rank", "cos"))


@query("ranked_cluster_dump", "D13", f"WITH {_CENTRES} SELECT label, vec_id, row_number() OVER (PARTITION BY label "
                                     "ORDER BY cos DESC, vec_id) AS rank FROM s")
def q_ranked_cluster_dump(spark, sf_dir):
    return T.ranked_cluster_dump(_emb(spark, sf_dir)).select("label", "vec_id", "rank")


@query("kmeans_topics", "M5 D12")
def q_kmeans_topics(spark, sf_dir):
    assign, _ = T.kmeans_topics(_emb(spark, sf_dir), k=10, seed=42)
    return assign.select("vec_id", "label", "cluster")


@query("bisecting_topics", "M6")
def q_bisecting_topics(spark, sf_dir):
    assign, _ = T.kmeans_topics(_emb(spark, sf_dir), k=10, seed=42, bisecting=True)
    return assign.select("vec_id", "label", "cluster")


_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KEY_SQL = ("array_to_string(list_sort(list_transform(string_split(translate(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), "
            "'" + _PUNCT.replace("'", "''") + "', ''), ' '), lambda w: lower(w))), '')")


@query("dedup_prompts", "D2 F3", f"SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY "
                                 f"{_KEY_SQL} ORDER BY doc_id) AS rn FROM documents) z WHERE rn = 1")
def q_dedup_prompts(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("ord"), "text")
    return T.dedup_prompts(d, "text", "ord").select(F.col("ord").alias("doc_id"), "text")


@query("shape_prompt_texts", "P28 D2", f"""
WITH u AS (SELECT conv_id, turn, regexp_replace(text || CASE WHEN turn = 0 AND conv_id % 9 = 4 THEN chr(10) || '1. one' || chr(10) ||
           '1. two' WHEN turn = 0 AND conv_id % 9 = 7 THEN ' call 777777777' ELSE '' END, '^\\s+|\\s+$', '', 'g') AS text FROM conversations
           WHERE role = 'user'),
c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, text FROM u),
f AS (SELECT * FROM c WHERE length(text) >= 32 AND length(text) <= 1500)
SELECT conv_id AS ord, CAST(i AS INTEGER) AS i, text FROM (
  SELECT *, row_number() OVER (PARTITION BY {_KEY_SQL} ORDER BY conv_id, i) AS rn FROM f) z WHERE rn = 1""")
def q_shape_prompt_texts(spark, sf_dir):
    from coheral.sources import fixtures as fx
    chats = fx.chats(Tables(spark, sf_dir))
    conv = F.transform("conversations", lambda m: F.struct(
        F.when(m["from"] == "human", "user").otherwise("assistant").alias("role"), m["value"].alias("content")))
    rows = chats.select("ord", conv.alias("conversation"))
    return T.shape_prompt_texts(rows, min_length=32, max_length=1500).select("ord", "i", "text")


@query("choose_random_prompts", "D24", "SELECT vec_id FROM embeddings ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)) "
                                       "LIMIT 10")
def q_choose_random_prompts(spark, sf_dir):
    return T.choose_random_prompts(_emb(spark, sf_dir).select("vec_id"), 10, 42)


@query("semantic_topics", "X6 M5")
def q_semantic_topics(spark, sf_dir):
    """Latent semantic vectors of all documents, clustered by k-means."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "text")
    vectors = semantic_embedding(d, fit_semantic(d, rank=32, iterations=2)).drop("text")
    assigned, _ = T.kmeans_topics(vectors, 8)
    return assigned.select("doc_id", "cluster")


@query("hierarchical_topics", "M6")
def q_hierarchical_topics(spark, sf_dir):
    return hierarchical_topics(_emb(spark, sf_dir), 20)[0].select("vec_id", "cluster")


@query("summarise_clusters", "M7 F4 X1")
def q_summarise_clusters(spark, sf_dir):
    t = Tables(spark, sf_dir)
    e = t.embeddings.select("vec_id", "label", "embedding")
    # prompts of the embedded corpus: documents aligned by id modulo the corpus size
    n_docs = t.documents.agg(F.count(F.lit(1))).scalar()
    texts = t.documents.select(F.col("doc_id").alias("_d"), "text")
    # the texts meet the eight chosen rows of each cluster and the ten random ones only
    with_text = lambda x: x.withColumn("_d", F.col("vec_id") % n_docs).join(texts, "_d").drop("_d")
    top = with_text(T.cluster_topk(e, 8))
    rnd = with_text(T.choose_random_prompts(e.select("vec_id"), 10, 42)).withColumn(
        "r", F.row_number().over(Window.orderBy("vec_id")))  # ten prompts
    prompts = T.cluster_summary_prompts(top, rnd, num_prompts=10)
    out = llm_map(prompts, "prompt", out_col="topic")
    share = T.cluster_share(e)
    return out.join(share, "label").select("label", "size", "share", F.length("prompt").alias("prompt_chars"),
                                           F.split("topic", "\n")[0].alias("topic"))
