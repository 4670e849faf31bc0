"""Prompt topic clustering.

Embeddings are ``array<float>`` columns.  Cluster centres are a grouped mean
(map-side partial aggregation: |clusters| x dim values per task), cosine
similarities are row-local array expressions against the broadcast centres
(|clusters| rows), and per-cluster top-k uses the salted two-stage top-k, so a
cluster holding a third of the prompts is never sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coheral.functions.hashing import hash_key
from coheral.functions.text import py_strip, remove_punctuation, truncate_middle
from coheral.operators.ordering import global_rank, topk_per_group


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """cosine similarity of two arrays."""
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def cluster_centres(df: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per cluster: (label, centre array<double>), one partial aggregate per task and cluster."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = df.select(label, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    return v.groupBy(label).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("centre"))


def with_centre_cosine(df: DataFrame, centres: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Attach cos(embedding, centre of its cluster); centres are |clusters| rows -> broadcast."""
    j = df.join(centres, label)
    return j.withColumn("cos", cosine(F.col(vec).cast("array<double>"), F.col("centre"))).drop("centre")


def cluster_topk(df: DataFrame, k: int, label: str = "label", vec: str = "embedding", key: str = "vec_id",
                 centres: DataFrame | None = None) -> DataFrame:
    """Per cluster the k rows closest (cosine) to the centre; k = min(k, smallest cluster)."""
    centres = centres if centres is not None else cluster_centres(df, label, vec)
    scored = with_centre_cosine(df, centres, label, vec)
    smallest = df.groupBy(label).count().agg(F.min("count")).first()[0]  # one number
    kk = int(min(k, smallest or 0))
    return topk_per_group(scored, [label], [F.desc("cos"), F.col(key)], kk, salt_key=F.xxhash64(key))


def cluster_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size"))


def relabel_by_size(df: DataFrame, label: str = "label") -> DataFrame:
    """Cluster ids renumbered 0.. by size (largest first, ties by old id)."""
    sizes = cluster_sizes(df, label)
    # one row per cluster: bounded window
    from pyspark.sql import Window
    m = sizes.withColumn("new_label", F.row_number().over(Window.orderBy(F.desc("size"), label)) - 1)
    return df.join(m.select(label, "new_label"), label)


def cluster_share(df: DataFrame, label: str = "label") -> DataFrame:
    """Size and share (rounded to 6 places) per cluster."""
    s = cluster_sizes(df, label)
    total = df.agg(F.count(F.lit(1))).scalar()
    return s.select(label, "size", F.round(F.col("size") / total, 6).alias("share"))


def ranked_cluster_dump(df: DataFrame, label: str = "label", vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Every row with its 1-based rank inside its cluster by similarity to the centre.

    Ranks come from the distributed ``global_rank`` over (cluster, -cos, key)
    minus the first position of the cluster, so no cluster is sorted by one task.
    """
    scored = with_centre_cosine(df, cluster_centres(df, label, vec), label, vec)
    g = global_rank(scored.select(label, key, (-F.col("cos")).alias("_neg")), [label, "_neg", key], "_g")
    first = g.groupBy(label).agg(F.min("_g").alias("_g0"))
    ranks = g.join(first, label).select(key, (F.col("_g") - F.col("_g0") + 1).alias("rank"))
    return scored.join(ranks, key)


def kmeans_topics(df: DataFrame, k: int = 20, seed: int = 42, vec: str = "embedding", bisecting: bool = False) -> tuple:
    """M5 (k-means) / M6 re-aimed (bisecting k-means): fit, then relabel clusters by size.

    Returns (assignments: key..., cluster; centres: cluster, centre).  Agglomerative
    Ward clustering needs all pairwise distances, so M6 uses MLlib's divisive
    bisecting k-means instead (documented approximation).
    """
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.withColumn("_features", array_to_vector(F.col(vec).cast("array<double>")))
    algo = (BisectingKMeans(k=k, seed=seed, featuresCol="_features", predictionCol="_cluster") if bisecting
            else KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="_cluster"))
    model = algo.fit(data)
    pred = model.transform(data).drop("_features")
    relab = relabel_by_size(pred, "_cluster").withColumnRenamed("new_label", "cluster")
    spark = df.sparkSession
    cents = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
                                  "_cluster int, centre array<double>")
    mapping = relab.select("_cluster", "cluster").distinct()
    cents = cents.join(mapping, "_cluster").select("cluster", "centre")
    return relab.drop("_cluster"), cents


def dedup_key(text: Column) -> Column:
    """D2 key: strip, remove punctuation, split on ' ', lower-case, sort, concatenate (no separator)."""
    words = F.split(remove_punctuation(py_strip(text)), " ", -1)
    return F.array_join(F.array_sort(F.transform(words, lambda w: F.lower(w))), "")


def dedup_prompts(df: DataFrame, text: str = "text", order: str = "ord") -> DataFrame:
    """Keep the first occurrence of every dedup key (``order`` is unique; hash aggregate, skew-safe)."""
    from coheral.operators.joins import first_per_key
    keyed = df.withColumn("_key", dedup_key(F.col(text)))
    return first_per_key(keyed, ["_key"], [order], unique_order=True).drop("_key")


def shape_prompt_texts(rows: DataFrame, min_length: int | None = None, max_length: int | None = None,
                       english_only: bool = False, order: str = "ord") -> DataFrame:
    """Pick the text source per row, strip, filter language and length, dedup.

    ``rows`` has any of: text (string), conversation_a / conversation
    (array<struct<role, content>>), turns (array<string>).  Output: ord, i, text.
    """
    from coheral.operators.conversations import detect_language
    srcs = []
    cols = set(rows.columns)
    user = lambda c: F.transform(F.filter(F.col(c), lambda m: m["role"] == "user"), lambda m: m["content"])
    if "text" in cols:
        srcs.append(F.when(F.col("text").isNotNull(), F.array(F.col("text"))))
    if "conversation_a" in cols:
        srcs.append(user("conversation_a"))
    if "conversation" in cols:
        srcs.append(user("conversation"))
    if "turns" in cols:
        srcs.append(F.col("turns"))
    texts = F.coalesce(*srcs) if len(srcs) > 1 else srcs[0]
    ex = rows.select(order, F.posexplode(texts).alias("i", "text")).withColumn("text", py_strip("text"))
    if english_only:
        ex = ex.filter(detect_language(F.col("text")) == "English")
    if min_length:
        ex = ex.filter(F.length("text") >= min_length)
    if max_length:
        ex = ex.filter(F.length("text") <= max_length)
    # one number for (order, i): a hash aggregate can keep its minimum
    ex = ex.withColumn("_o", F.col(order).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("i"))
    return dedup_prompts(ex, "text", "_o").drop("_o")


def choose_random_prompts(texts: DataFrame, n: int, seed: int = 42, key: str = "vec_id") -> DataFrame:
    """``n`` prompts drawn from the whole corpus (seeded hash order), as the reference does."""
    return texts.withColumn("_h", hash_key(F.col(key), seed)).orderBy("_h").limit(n).drop("_h")


# ---- fixed values: cluster summary prompt --------------------------------------
SUMMARY_INSTRUCTION = ("Given a list of user messages, use less than 8 words to summarize a central topic for all "
                       "messages in English. Your output should only include a single line. Try to be specific.")
# -------------------------------------------------------------------------------


def cluster_summary_prompts(topk: DataFrame, random_prompts: DataFrame, num_prompts: int = 10,
                            label: str = "label", text: str = "text") -> DataFrame:
    """M7 (prompt side): 80% top prompts + 20% random, each truncated to 200 chars, one prompt per cluster.

    ``topk`` holds (label, rank, text) with rank 1..k; ``random_prompts`` holds
    (text, r) with r = 1..; the random tail is shared by all clusters as in the
    reference.  collect_list runs over at most ``num_prompts`` rows per cluster.
    """
    split = int(num_prompts * 0.8)
    tr = lambda c: truncate_middle(c, 200)
    top = (topk.filter(F.col("rank") <= split)
           .groupBy(label).agg(F.sort_array(F.collect_list(F.struct("rank", tr(F.col(text)).alias("t")))).alias("items"))
           .select(label, F.array_join(F.transform("items", lambda s: s["t"]), "\n").alias("top")))
    # the random tail (num_prompts - split rows) is one string shared by every cluster: a scalar subquery
    tail = (random_prompts.filter(F.col("r") <= num_prompts - split)
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", tr(F.col(text)).alias("t")))),
                                          lambda s: s["t"]), "\n")).scalar())
    body = F.when(F.length(tail) > 0, F.concat_ws("\n", F.col("top"), tail)).otherwise(F.col("top"))
    return top.select(label, F.concat(F.lit(SUMMARY_INSTRUCTION + "\n\nBEGIN OF THE MESSAGE LIST\n"), body,
                                      F.lit("\nEND OF THE MESSAGE LIST.")).alias("prompt"))
