"""File readers for the reference's formats.

Order-dependent consumers need the position of each line; ``with_line_order``
numbers the rows of a scan in place from line counts per split.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coheral.session import cut_lineage
from coheral.sources import schemas as SC


# ---- fixed values: blocks of a metric report, in order ----
REPORT_BLOCKS = ["accuracy", "f1", "recall", "precision"]
# ------------------------------------------------------------


def read_essay_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw essay CSV (Filename, Prompt, corrected_essay) -> essay_id, prompt_id, text."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))
    return df.select(F.col("Filename").alias("essay_id"), F.col("Prompt").alias("prompt_id"),
                     F.col("corrected_essay").alias("text"))


def read_conversations_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Whole-file JSON array (multiLine) or JSONL of ShareGPT conversations."""
    return spark.read.schema(SC.CHAT).option("multiLine", multiline).json(path)


def _placed(df: DataFrame) -> DataFrame:
    """``df`` with the split (file, start) each row is from and its place in the task's output."""
    return df.select("*", F.col("_metadata.file_path").alias("_fp"), F.col("_metadata.file_block_start").alias("_bs"),
                     F.monotonically_increasing_id().alias("_mid"))


def _splits(df: DataFrame) -> DataFrame:
    """One row per split: (file, start, place of its first row, rows, number of its first row in file order)."""
    some = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns[:1]]))  # lines are parsed, so both scans see the same rows
    sizes = _placed(df).select("_fp", "_bs", "_mid", some.isNull().alias("_x")).groupBy("_fp", "_bs").agg(
        F.min("_mid").alias("_first"), F.count("*").alias("_n"), F.max("_x").alias("_x")).drop("_x")
    return cut_lineage(sizes.withColumn("_off", F.sum("_n").over(Window.orderBy("_fp", "_bs")) - F.col("_n")))


def with_line_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """Exact line order of a file scan (file path, then position), rows numbered where they are.

    Rows are counted per split; prefix sums over (file, split start) say where each split begins,
    and a row's number is that plus its place in the split.  Only the table with one row per split
    (128 MB of input by default) is shuffled, written and broadcast; no text is.
    ``df`` is a scan: both passes cut the same files into the same splits.
    """
    key = [F.xxhash64("_fp"), F.xxhash64(F.reverse("_fp"))]
    starts = _splits(df).select(*[k.alias(f"_k{i}") for i, k in enumerate(key)], F.col("_bs").alias("_kb"), (F.col("_off") - F.col("_first")).alias("_shift"))
    on = (key[0] == F.col("_k0")) & (key[1] == F.col("_k1")) & (F.col("_bs") == F.col("_kb"))
    return _placed(df).join(F.broadcast(starts), on).withColumn(name, F.col("_mid") + F.col("_shift")).drop("_fp", "_bs", "_mid", "_k0", "_k1", "_kb", "_shift")


def read_jsonl(spark: SparkSession, path: str, schema=None, begin: int | None = None, end: int | None = None) -> DataFrame:
    """S3: JSONL rows ``[begin:end]`` in file order (adds ``ord``).

    A slice counts all lines, then reads the files that hold its rows only.
    """
    r = spark.read.schema(schema).json(path) if schema is not None else spark.read.json(path)
    if begin is None and end is None:
        return with_line_order(r)
    wanted = F.lit(True) if end is None else F.col("first") < end
    files = _splits(r).groupBy("_fp").agg(F.min("_off").alias("first"), F.sum("_n").alias("n"))
    files = files.filter(wanted & (F.col("first") + F.col("n") > (begin or 0))).orderBy("_fp").collect()  # the files of the slice
    if not files:
        return with_line_order(r).limit(0)
    part = spark.read.schema(r.schema).json([unquote(f["_fp"]) for f in files])
    d = with_line_order(part).withColumn("ord", F.col("ord") + files[0]["first"])
    return d.filter((F.col("ord") >= (begin or 0)) & (F.lit(True) if end is None else F.col("ord") < end))


def read_answers_dir(spark: SparkSession, answer_dir: str) -> DataFrame:
    """All ``*.jsonl`` answers; model = file stem; the last line per (model, question) wins."""
    r = spark.read.schema(SC.ANSWER).json(f"{answer_dir.rstrip('/')}/*.jsonl")
    r = r.withColumn("model", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1))
    d = with_line_order(r)
    from coheral.operators.joins import first_per_key
    return first_per_key(d, ["model", "question_id"], ["ord"], last=True)


def read_judge_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Judge prompt dimension keyed by name (last line wins)."""
    d = with_line_order(spark.read.schema(SC.JUDGE_PROMPT).json(path))
    from coheral.operators.joins import first_per_key
    return first_per_key(d, ["name"], ["ord"], last=True).drop("ord")


def _log_paths(spark: SparkSession, root: str, pattern: str, *more: str) -> DataFrame:
    """Metadata of the log files under ``root`` (any depth); the content column is pruned."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
            .load(root).select("path", *more))


def _log_day(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})[^/]*$", 1)


def _between(df: DataFrame, day: Column, first: str | None, last: str | None) -> DataFrame:
    if first is not None:
        df = df.filter(day >= first)
    if last is not None:
        df = df.filter(day <= last)
    return df


def read_logs(spark: SparkSession, root: str, pattern: str = "*-conv.json", first: str | None = None,
              last: str | None = None, schema=SC.ARENA_LOG) -> DataFrame:
    """All rows of all log files under ``root`` (any depth), no list of files made.

    ``first`` and ``last`` bound the dates in the file names (files without a date then drop out).
    """
    r = spark.read.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).json(root)
    day = _log_day(F.col("_metadata.file_path"))
    return r if first is None and last is None else _between(r.filter(day != ""), day, first, last)


def list_log_files(spark: SparkSession, root: str, pattern: str = "*-conv.json", max_files: int | None = None) -> list[str]:
    """Log files under ``root`` (any depth) ordered by modification time; the newest ``max_files``, or all.

    Only file metadata is read; without ``max_files`` the list has every path, as the
    reference's has (``read_logs`` reads the files without a list).
    """
    meta = _log_paths(spark, root, pattern, "modificationTime")
    if max_files:
        meta = meta.orderBy(F.desc("modificationTime"), F.desc("path")).limit(max_files)
    return [r["path"] for r in meta.orderBy("modificationTime", "path").collect()]


def list_log_files_by_date(spark: SparkSession, root: str, pattern: str = "*-conv.json", first: str | None = None,
                           last: str | None = None, max_files: int | None = None) -> list[str]:
    """Log files named by date (``YYYY-MM-DD-...``) under server folders, by (date, server); the last ``max_files``, or all.

    ``first`` and ``last`` bound the dates; only file names are read.
    """
    meta = _log_paths(spark, root, pattern)
    meta = meta.select("path", _log_day(F.col("path")).alias("day"),
                       F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("server")).filter("day <> ''")
    meta = _between(meta, F.col("day"), first, last)
    if max_files:
        meta = meta.orderBy(F.desc("day"), F.desc("server"), F.desc("path")).limit(max_files)
    return [r["path"] for r in meta.orderBy("day", "server", "path").collect()]


def scan_log_projected(spark: SparkSession, paths) -> DataFrame:
    """Type, tstamp, model ('' default), models (['', ''] default)."""
    r = spark.read.schema(SC.ARENA_LOG).json(paths)
    return r.select("type", "tstamp", F.coalesce("model", F.lit("")).alias("model"),
                    F.coalesce("models", F.array(F.lit(""), F.lit(""))).alias("models"))


def scan_votes(spark: SparkSession, paths) -> DataFrame:
    """Arena log rows of the four vote types (filter pushed into the JSON scan)."""
    from coheral.operators.arena import VOTE_TYPES
    return spark.read.schema(SC.ARENA_LOG).json(paths).filter(F.col("type").isin(*VOTE_TYPES))


def read_prediction_tsv(spark: SparkSession, path: str, label2idx: dict | None = None,
                        pred_col: str = "prediction-idx", gold_col: str = "real-label") -> DataFrame:
    """Prediction TSV; columns located by header; label words mapped to indexes."""
    from coheral.operators.replies import label_to_index
    r = spark.read.option("header", True).option("sep", "\t").csv(path)
    m = label2idx or {}
    return r.select(label_to_index(F.col(f"`{pred_col}`"), m).alias("pred"),
                    label_to_index(F.col(f"`{gold_col}`"), m).alias("gold"))


def read_leaderboard_csv(spark: SparkSession, path: str, add_hyperlink: bool = True) -> DataFrame:
    """Leaderboard CSV typed per header; '-' -> null.

    'Arena Elo rating' -> int, 'MMLU' -> x100 rounded to 1 place, win-rate columns
    (ending in '%') -> number rounded to 1, 'MT-bench (score)' -> rounded to 2;
    Model gets a markdown hyperlink when a Link column is present.
    """
    r = spark.read.option("header", True).csv(path)
    num = lambda c: F.when(F.col(f"`{c}`") == "-", None).otherwise(F.regexp_replace(F.col(f"`{c}`"), "%", "")) \
        .try_cast("double")
    cols = []
    for c in r.columns:
        if c == "Arena Elo rating":
            cols.append(num(c).cast("int").alias(c))
        elif c == "MMLU":
            cols.append(F.bround(num(c) * 100, 1).alias(c))
        elif c == "MT-bench (score)":
            cols.append(F.bround(num(c), 2).alias(c))
        elif "win rate" in c.lower():
            cols.append(F.bround(num(c), 1).alias(c))
        elif c == "Model" and add_hyperlink and "Link" in r.columns:
            cols.append(F.format_string('<a target="_blank" href="%s" style="color: var(--link-text-color); '
                                        'text-decoration: underline dotted;">%s</a>', F.col("Link"), F.col("Model"))
                        .alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return r.select(*cols)


def read_metric_report(spark: SparkSession, path: str) -> DataFrame:
    """Parse metric reports written by ``write_metric_report`` back to (metric, average, value x100)."""
    t = spark.read.option("header", True).option("sep", "\t").csv(path)
    return t.select("metric", "average", F.bround(F.col("value").cast("double") * 100).cast("int").alias("value_x100"))


def read_metric_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Reports in the block layout of ``write_metric_blocks``, any number of files.

    (file, title, metric, average, value, value_x100, problem): one row per value.  A line that fits
    no block, a value that is no number, and a block that is missing give a row with ``problem`` instead.
    """
    t = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: x != "")
    row = "array<struct<metric:string,average:string,value:double,problem:string>>"
    start = F.struct(F.lit("").alias("block"), F.array().cast(row).alias("rows"))

    def read(state, line):
        name, cells = F.regexp_extract(line, "^([a-z0-9]+):$", 1), F.split(line, "\t")
        plain = state["block"] == "accuracy"
        value = F.when(plain, F.get(cells, 0)).otherwise(F.get(cells, 1)).try_cast("double")
        fits = (F.size(cells) == F.when(plain, 1).otherwise(2)) & value.isNotNull() & (state["block"] != "")
        found = F.struct(F.when(fits, state["block"]).alias("metric"), F.when(fits & ~plain, cells[0]).alias("average"),
                         F.when(fits, value).alias("value"), F.when(~fits, F.concat(F.lit("unread line: "), line)).alias("problem"))
        return F.when(name.isin(*REPORT_BLOCKS), F.struct(name.alias("block"), state["rows"].alias("rows"))).otherwise(
            F.struct(state["block"].alias("block"), F.concat(state["rows"], F.array(found).cast(row)).alias("rows")))

    folded = t.select("file", F.get(lines, 0).alias("title"), F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), start, read)["rows"].alias("r"))
    absent = F.transform(F.filter(F.array(*[F.lit(b) for b in REPORT_BLOCKS]), lambda b: ~F.exists("r", lambda x: F.coalesce(x["metric"] == b, F.lit(False)))),
                         lambda b: F.struct(b.alias("metric"), F.lit(None).cast("string").alias("average"), F.lit(None).cast("double").alias("value"),
                                            F.concat(F.lit("no values under "), b).alias("problem"))).cast(row)
    out = folded.select("file", "title", F.inline(F.concat("r", absent)))
    return out.select("file", "title", "metric", "average", "value", F.bround(F.col("value") * 100).cast("int").alias("value_x100"), "problem")


def read_split_cache(spark: SparkSession, path: str, split: str, one_per_class: str | None = None, order: str = "ord") -> DataFrame:
    """One split of a dataset cached as Parquet partitioned by ``split`` (partition pruning).

    ``one_per_class`` names the label column of which only the first row each is kept (D19).
    """
    d = spark.read.parquet(path).filter(F.col("split") == split)
    if one_per_class is None:
        return d
    from coheral.operators.joins import first_per_key
    return first_per_key(d, [one_per_class], [order])


def read_pair_csv(spark: SparkSession, path: str, task: str = "detection") -> DataFrame:
    """Pair CSV -> task columns; empty strings are nulls, labels/reasons ints."""
    r = spark.read.schema(SC.PAIR_CSV).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    ints = {c: F.col(c).try_cast("int") for c in ["label", "R1", "R2", "R3", "R4", "R5", "R6", "R7"]}
    base = [F.col("essay_id"), F.col("topic"), F.col("context"), F.col("sentence")]
    if task.startswith("rewriting-r"):
        return r.select(*base, *[ints[f"R{i}"].alias(f"R{i}") for i in range(1, 8)], F.col("Rewrite").alias("rewrite"))
    if task.startswith("rewriting"):
        return r.select(*base, F.col("Rewrite").alias("rewrite"))
    return r.select(*base, ints["label"].alias("label"))
