"""Line numbers of file scans (S3-S5) and metric reports in blocks."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from coheral.sources import files as FI
from coheral.sources import sinks as SK


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _write(folder, sizes, blank_every=0):
    """Files of JSON lines, numbered in (path, position) order; the expected numbers."""
    os.makedirs(folder)
    n, names = 0, []
    for f, size in enumerate(sizes):
        name = f"part {f:02d}.jsonl" + (".gz" if f % 4 == 3 else "")
        lines = []
        for i in range(size):
            lines.append(json.dumps({"n": n, "text": f"line {n} " + "x" * (n % 90)}))
            if blank_every and n % blank_every == 0:
                lines.append("")
            n += 1
        with (gzip.open if name.endswith(".gz") else open)(os.path.join(folder, name), "wt") as out:
            out.write("".join(line + "\n" for line in lines))
        names.append(name)
    return n


def test_numbers_follow_files_and_splits(spark, scratch, small_splits):
    folder = os.path.join(scratch, "in")
    n = _write(folder, [300, 1, 0, 120, 700, 33, 5, 60], blank_every=17)
    d = FI.read_jsonl(spark, folder, "n long, text string")
    assert d.rdd.getNumPartitions() > 8  # files were split
    assert sorted((r.ord, r.n) for r in d.collect()) == [(i, i) for i in range(n)]


def test_no_text_is_shuffled_or_written(spark, scratch, small_splits):
    folder = os.path.join(scratch, "in")
    _write(folder, [50, 50])
    plan = FI.read_jsonl(spark, folder, "n long, text string")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert moved and all("Broadcast" in line for line in moved)
    assert "Sort" not in plan.replace("SortMerge", "")


@pytest.mark.parametrize("begin, end", [(0, 5), (310, 320), (299, 303), (None, 7), (415, None), (1000, 2000), (5, 5)])
def test_slices_read_their_files_only(spark, scratch, begin, end, small_splits):
    folder = os.path.join(scratch, "in")
    n = _write(folder, [300, 10, 5, 100, 2])
    d = FI.read_jsonl(spark, folder, "n long, text string", begin, end)
    assert sorted((r.ord, r.n) for r in d.collect()) == [(i, i) for i in range(n)[begin:end]]
    if (begin, end) == (310, 320):
        assert len(d.inputFiles()) == 2


def test_judge_prompts_and_answers_last_line_wins(spark, scratch):
    os.makedirs(os.path.join(scratch, "p"))
    with open(os.path.join(scratch, "p", "a.jsonl"), "w") as f:
        for k in range(3):
            f.write(json.dumps({"name": "pair-v2", "system_prompt": f"s{k}", "prompt_template": "t"}) + "\n")
        f.write(json.dumps({"name": "single-v1", "system_prompt": "one", "prompt_template": "t"}) + "\n")
    got = {r["name"]: r["system_prompt"] for r in FI.read_judge_prompts(spark, os.path.join(scratch, "p")).collect()}
    assert got == {"pair-v2": "s2", "single-v1": "one"}


def test_projected_logs_and_appended_results(spark, scratch):
    path = os.path.join(scratch, "log.json")
    with open(path, "w") as f:
        f.write('{"type": "chat", "tstamp": 1.5}\n{"type": "upvote", "tstamp": 2.5, "model": "m", "models": ["a", "b"]}\n')
    got = sorted(tuple(r) for r in FI.scan_log_projected(spark, path).collect())
    assert got == [("chat", 1.5, "", ["", ""]), ("upvote", 2.5, "m", ["a", "b"])]
    for k in range(2):
        SK.append_result(spark.range(k, k + 1), os.path.join(scratch, "results"))
    assert sorted(r.id for r in spark.read.json(os.path.join(scratch, "results")).collect()) == [0, 1]


METRICS = ["accuracy"] + [f"{m}_{a}" for m in ("f1", "recall", "precision") for a in ("macro", "weighted", "micro")]


def test_reports_in_blocks_round_trip(spark, scratch):
    path = os.path.join(scratch, "reports")
    rows = [(f"run{i}", *[round((i * 10 + k) / 100, 2) for k in range(10)]) for i in range(6)]
    df = spark.createDataFrame(rows, "run string, " + ", ".join(f"{m} double" for m in METRICS))
    SK.write_metric_blocks(df, path, "sent_binary", ["run"])
    text = spark.read.text(os.path.join(path, "run=run2"), wholetext=True).first()[0].splitlines()
    assert text[:5] == ["coherence results analysis for data sent_binary:", "accuracy:", "0.2", "f1:", "macro\t0.21"] and len(text) == 15
    assert [text[k] for k in (3, 7, 11)] == ["f1:", "recall:", "precision:"]  # the places a reader by line counts on
    back = FI.read_metric_blocks(spark, path).collect()
    assert len(back) == 60 and all(r.problem is None and r.title == "coherence results analysis for data sent_binary:" for r in back)
    got = {(r.file.split("run=")[1].split("/")[0], r.metric, r.average): r.value_x100 for r in back}
    assert got == {(row[0], m.split("_")[0], m.split("_")[1] if "_" in m else None): round(v * 100)
                   for row in rows for m, v in zip(METRICS, row[1:])}


def test_malformed_reports_are_told_by_file(spark, scratch):
    folder = os.path.join(scratch, "bad")
    os.makedirs(folder)
    for name, text in (("a.tsv", "title\naccuracy:\nhigh\nf1:\nmacro\t0.5\nrecall:\nmacro\t0.25\textra\nprecision:\r\nmacro\t1e-1\r\n"), ("b.tsv", ""), ("c.tsv", "t\n0.5\n")):
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    got = {}
    for r in FI.read_metric_blocks(spark, folder).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.metric, r.average, r.value, r.problem))
    assert sorted(got["a.tsv"], key=repr) == sorted([
        (None, None, None, "unread line: high"), ("f1", "macro", 0.5, None), (None, None, None, "unread line: macro\t0.25\textra"),
        ("precision", "macro", 0.1, None), ("accuracy", None, None, "no values under accuracy"), ("recall", None, None, "no values under recall")], key=repr)
    assert [p for *_, p in got["c.tsv"]][0] == "unread line: 0.5" and len(got["c.tsv"]) == 5
    assert len(got.get("b.tsv", [])) in (0, 4)
