"""Writers.  Every writer is a distributed ``DataFrameWriter`` call."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> None:
    """K1: CSV with header, no index column."""
    df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2/K5: JSON lines; ``mode='append'`` is the append-only result log."""
    df.write.mode(mode).json(path)


def append_result(df: DataFrame, path: str) -> None:
    """K5: append judgments/answers (append-only JSONL)."""
    write_jsonl(df, path, "append")


def metrics_long(wide: DataFrame, group: list[str] | None = None) -> DataFrame:
    """K3 helper: precision_macro ... -> (group..., metric, average, value)."""
    group = group or []
    names = [c for c in wide.columns if c not in group]
    st = F.explode(F.array(*[F.struct(F.lit(c.split("_")[0]).alias("metric"),
                                      F.lit(c.split("_")[1] if "_" in c else "").alias("average"),
                                      F.col(c).cast("double").alias("value")) for c in names]))
    return wide.select(*group, st.alias("s")).select(*group, "s.*")


def write_metric_report(wide: DataFrame, path: str, group: list[str] | None = None) -> None:
    """K3: TSV metric report (accuracy / f1 / recall / precision blocks in long form)."""
    write_csv(metrics_long(wide, group), path, sep="\t")


def write_metric_blocks(wide: DataFrame, path: str, kind: str, group: list[str] | None = None,
                        averages: tuple[str, ...] = ("macro", "weighted", "micro")) -> None:
    """K3: one report a row of ``wide`` in the block layout (title, accuracy, then f1, recall and precision by average).

    Columns are ``accuracy`` and ``<metric>_<average>``; with ``group`` each report is in a folder of its own.
    """
    from coheral.sources.files import REPORT_BLOCKS

    number = lambda c: F.coalesce(F.col(c).cast("double").cast("string"), F.lit("nan"))
    lines = [F.lit(f"coherence results analysis for data {kind}:"), F.lit("accuracy:"), number("accuracy")]
    for block in REPORT_BLOCKS[1:]:
        lines += [F.lit(f"{block}:"), *[F.concat(F.lit(f"{a}\t"), number(f"{block}_{a}")) for a in averages]]
    group = group or []
    out = wide.select(*group, F.concat_ws("\n", *lines).alias("value"))
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*group) if group else writer).text(path)


def write_predictions(df: DataFrame, path: str, pred: str = "pred", gold: str = "gold", logits: str | None = None,
                      n_classes: int = 0) -> None:
    """K4: TSV with prediction, gold and per-class logits."""
    cols = [F.col(pred).alias("prediction-idx"), F.col(gold).alias("real-label")]
    if logits:
        cols += [F.col(logits)[i].alias(f"log{i}") for i in range(n_classes)]
    write_csv(df.select(*[c for c in df.columns if c in ("guid", "title")], *cols), path, sep="\t")


FILTER_BITS = 16


def _key_bits(df: DataFrame, key: str, *group: str) -> DataFrame:
    """(group..., word, bits): the keys of each group as a bitmap of ``2 ** FILTER_BITS`` bits, set words only."""
    slot = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS)).cast("int").alias("_s")
    return df.select(*group, slot).groupBy(*group, F.shiftright("_s", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, _s & 31)")).alias("bits"))


def _may_hold(spark, path: str, rows: list) -> list[str] | None:
    """Batches that may hold one of the keys of the bitmap ``rows``; None if that isn't known."""
    from coheral.session import fs_list_names, fs_read_text
    names = [n for n in fs_list_names(spark, f"{path}/_filters") if n.endswith(".json")]
    if not names:
        return None
    mine, found = {r["word"]: r["bits"] for r in rows}, set()
    for n in names:
        for batch, words in json.loads(fs_read_text(spark, f"{path}/_filters/{n}")).items():
            if any(int(w) in mine and mine[int(w)] & bits for w, bits in words.items()):
                found.add(batch)
    return sorted(found)


def checkpointed_sink(df: DataFrame, path: str, key: str, batch_col: str = "batch") -> DataFrame:
    """K6: resumable output.  Rows whose key is already written are skipped (left
    anti join) and the others are appended under their ``batch`` folder; nothing
    written is ever replaced.  A call that fails commits no file, so calling it
    again adds exactly the missing keys.  Returns the rows written in this call.

    Before its rows a call publishes one small file with a bitmap of their keys by
    batch (``2 ** FILTER_BITS`` bits each), so a later call reads and joins only the batches that may
    hold one of its keys.  A bitmap whose rows never came costs a needless read, no row.
    An output without bitmaps is read whole."""
    from coheral.session import cut_lineage, fs_exists, fs_publish
    spark = df.sparkSession
    path = path.rstrip("/")
    there = fs_exists(spark, path)
    todo = df
    if there:
        batches = _may_hold(spark, path, _key_bits(df, key).collect())  # 2 ** (FILTER_BITS - 5) words at most
        if batches is None or batches:
            written = spark.read.parquet(path)
            if batches is not None:
                written = written.filter(F.coalesce(F.col(batch_col).cast("string"), F.lit("null")).isin(*batches))
            todo = df.join(written.select(key), key, "left_anti")
    todo = cut_lineage(todo)  # before anything is written under ``path``
    if not there or fs_exists(spark, f"{path}/_filters"):
        bits: dict[str, dict[str, int]] = {}
        for r in _key_bits(todo.withColumn("_b", F.coalesce(F.col(batch_col).cast("string"), F.lit("null"))), key, "_b").collect():
            bits.setdefault(r["_b"], {})[str(r["word"])] = r["bits"]
        if bits or not there:
            fs_publish(spark, f"{path}/_filters/{uuid.uuid4().hex}.json", json.dumps(bits))
    todo.write.mode("append").partitionBy(batch_col).parquet(path)
    return todo


def cache_dataset(build, path: str, spark) -> DataFrame:
    """K7: reuse the saved dataset when present, else build and save it (Parquet)."""
    from coheral.session import fs_exists
    if not fs_exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_text_report(df: DataFrame, path: str, fmt: str, *cols: str) -> None:
    """K8: one formatted text line per row (``format_string``)."""
    df.select(F.format_string(fmt, *[F.col(c) for c in cols]).alias("value")).write.mode("overwrite").text(path)


def _cells(df: DataFrame):
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]


def render_table(df: DataFrame, html: bool = False) -> DataFrame:
    """K9: one markdown (or HTML) table line per row in column ``value``, the head lines first.

    Formatting is a column expression; write it with ``write_table``.
    """
    spark, cells = df.sparkSession, _cells(df)
    if html:
        head = ["<tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>"]
        esc = [F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")) for c in cells]
        line = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in esc], F.lit("</tr>"))
    else:
        head = ["| " + " | ".join(df.columns) + " |", "|" + "|".join("---" for _ in df.columns) + "|"]
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).unionByName(df.select(line.alias("value")))


def write_table(df: DataFrame, path: str, html: bool = False) -> None:
    """K9: the rendered table as text files; part files in order hold the lines in order."""
    render_table(df, html).write.mode("overwrite").text(path)
