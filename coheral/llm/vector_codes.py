"""Operator 11, vector code compression: product codes by member-resident Lloyd rounds.

A vector becomes integers and is cut into equal parts; each part position has a codebook.
The part rows live in the partition of (position, entry, salt): whoever owns an entry
holds its members.  A round adds the members up in the tasks where they live (only one row of
sums per entry and task is shuffled), floors the means into the new codebooks and looks
up every member's nearest entry.  Members whose entry stays are not moved; those that
change entry, and only they, go through the shuffle to their new owners.  The salt deals
an entry that holds most of the rows over as many owners as there are partitions.  Each
round's look-ups are written to the shared folder, so a lost executor repeats one round.

Codebooks are ``parts * entries`` rows of integers, whatever the table, and travel with the tasks.

Edge cases: rows whose vector is null, empty, or holds a null or non-finite component are
dropped, and so are vectors of another length than that of the first row (the one of least
id); a length that isn't a multiple of ``parts`` is filled up with zeros; integers
saturate where a part's squared distance could leave 62 bits (from 2**28 for parts of 16);
repeated ids are rows of their own (equal ids are ordered by vector, null ids come last); with fewer rows than
entries the codebooks are as short as the table; null labels form one group; an empty
table gives no rows.  Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coheral.llm.common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
OWNER = ["position", "entry", "salt"]


def _limit(width: int) -> int:
    """Largest size of an integer, so that ``width`` squared differences stay under 2**62."""
    return min(1 << 28, math.isqrt((1 << 62) // width) // 2)


def nearest(part: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, ties to the lower one; squared distance), exact in integers."""
    size = max(np.abs(part).max(initial=0), np.abs(codebook).max(initial=0))
    best, error = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    for lo in range(0, len(part), 1024):
        x = part[lo:lo + 1024]
        if part.shape[1] * 4 * int(size) ** 2 < 1 << 53:  # doubles hold all terms exactly
            a, c = x.astype(float), codebook.astype(float)
            d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]
        else:
            d = np.zeros((len(x), len(codebook)), np.int64)
            for k in range(part.shape[1]):
                d += (x[:, k][:, None] - codebook[:, k][None, :]) ** 2
        at = d.argmin(1)
        best[lo:lo + 1024], error[lo:lo + 1024] = at, d[np.arange(len(x)), at]
    return best, error


def _lookup(codebooks: np.ndarray) -> Column:
    """Column struct<entry, error> of the part in position, c0, c1, ..."""

    @F.pandas_udf("entry int, error bigint")
    def run(position: pd.Series, *columns: pd.Series) -> pd.DataFrame:
        part = np.column_stack([c.to_numpy(np.int64) for c in columns])
        at, entry, error = position.to_numpy(), np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for p in range(len(codebooks)):
            mine = at == p
            if mine.any():
                entry[mine], error[mine] = nearest(part[mine], codebooks[p])
        return pd.DataFrame({"entry": entry, "error": error})

    return run("position", *_components(codebooks.shape[2]))


def _components(width: int) -> list[str]:
    return [f"c{k}" for k in range(width)]


def _owners(df: DataFrame) -> DataFrame:
    """Deal rows out to the owners of their entries."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *OWNER)


def integers(df: DataFrame, key: str, vector: str, label: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """((row, id, label, v) of the rows that take part, written; the width of a part)."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(finite)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).select(F.size("v").alias("n")).collect()
    length = first[0]["n"] if first else parts
    width = -(-length // parts)
    limit = _limit(width)
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(limit)), F.lit(-limit)).cast("int"))
    filled = F.concat(whole, F.array_repeat(F.lit(0), width * parts - length))
    rows = rows.filter(F.size("v") == length).select(F.monotonically_increasing_id().alias("row"), "id", "label", filled.alias("v"))
    return cut(rows), width


def first_codebooks(rows: DataFrame, parts: int, width: int, entries: int) -> np.ndarray:
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # ``entries`` rows
    v = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width)
    return v.transpose(1, 0, 2).copy()


def update(residents: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """New codebooks: floored means of the members, summed where they live first; entries without members stay."""
    columns = _components(codebooks.shape[2])
    by_entry = residents.groupBy("position", "entry").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns])
    out = codebooks.copy()
    for r in by_entry.collect():  # one row per entry at most
        out[r["position"], r["entry"]] = [r[c] // r["n"] for c in columns]
    return out


def migrate(residents: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """The residents under new codebooks: only those whose nearest entry changes are shuffled."""
    looked_up = cut(residents.withColumn("to", _lookup(codebooks)["entry"]))
    stay = looked_up.filter("to = entry").drop("to")
    leave = looked_up.filter("to <> entry").withColumn("entry", F.col("to")).drop("to")
    return stay.unionByName(_owners(leave))


def fit(rows: DataFrame, codebooks: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """(resident part rows, final codebooks as parts x entries x width) after ``rounds`` rounds from the given codebooks."""
    parts, _, width = codebooks.shape
    spark = rows.sparkSession
    salts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = F.array(*[F.struct(F.lit(p).alias("position"), *[F.col("v")[p * width + k].alias(f"c{k}") for k in range(width)])
                       for p in range(parts)])
    residents = rows.select("row", "id", "label", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"),
                            F.explode(pieces).alias("p")).select("row", "id", "label", "salt", "p.*")
    residents = cut(_owners(residents.withColumn("entry", _lookup(codebooks)["entry"])))
    for left in reversed(range(rounds)):
        codebooks = update(residents, codebooks)
        if left:
            residents = migrate(residents, codebooks)
    return residents, codebooks


def codebook_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of every row that takes part."""
    rows, width = integers(df, key, vector, label, parts, scale)
    codebooks = first_codebooks(rows, parts, width, entries)
    columns = [F.col("id").alias("vec_id"), "label"]
    if codebooks.size:
        residents, codebooks = fit(rows, codebooks, rounds)
        found = residents.withColumn("found", _lookup(codebooks)).select("row", "id", "label", "position", "found.*")
        digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("position") == p, F.col("entry"))))), 2, "0") for p in range(parts)]
        coded = cut(found.groupBy("row", "id", "label").agg(F.concat(*digits).alias("code"), F.sum("error").alias("error"))
                    .select(*columns, "code", "error"))
    else:
        coded = rows.select(*columns, F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    digest = codebook_digest(codebooks)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("l")), "left")
            .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB restatement: the rounds unrolled, every part compared with every entry."""
    width = f"(len(v) // {parts})"
    steps = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v"
        " FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"pieces AS (SELECT vec_id, p, v[p * {width} + 1:(p + 1) * {width}] AS part FROM kept, range({parts}) AS r(p))",
        f"seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries})",
        "book0 AS (SELECT p, e, part FROM pieces JOIN seeds USING (vec_id))"]
    distance = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        steps.append(f"near{r} AS (SELECT vec_id, x.p AS p, any_value(x.part) AS part, min(CAST("
                     + distance.format(a="x.part", b="b.part") + f" AS BIGINT) * {entries} + b.e) AS best"
                     f" FROM pieces x JOIN book{r} b ON x.p = b.p GROUP BY vec_id, x.p)")
        if r < rounds:
            steps.append(f"sums{r} AS (SELECT p, best % {entries} AS e, i, CAST(floor(CAST(sum(part[i + 1]) AS DOUBLE) / count(*)) AS BIGINT) AS m"
                         f" FROM near{r}, generate_series(0, len(part) - 1) AS g(i) GROUP BY ALL)")
            steps.append(f"mean{r} AS (SELECT p, e, list(m ORDER BY i) AS part FROM sums{r} GROUP BY p, e)")
            steps.append(f"book{r + 1} AS (SELECT b.p, b.e, coalesce(m.part, b.part) AS part FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.e = m.e)")
    return f"""WITH {", ".join(steps)},
digest AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS d FROM book{rounds}),
codes AS (SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256
FROM codes JOIN kept USING (vec_id), digest"""
