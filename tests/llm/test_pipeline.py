"""The pipeline, stage by stage and as a whole, against brute force; and the registered queries."""

import collections
import hashlib
import re

import pytest

import corpus_pipeline as cp
from coheral.llm.queries import QUERIES
from coheral.llm.words import shingle_sets
from pyspark.sql import functions as F
from tests.llm.test_operators import _base_spans, _words

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(cp.STAGES):
        frame = stage(spark, docs, SMALL)
        assert k == len(cp.STAGES) - 1 or frame.columns == cp.COLUMNS
        frame.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return out


def test_language_stage_keeps_documents_with_a_language(stages):
    kept = {r.doc_id for r in stages[1]}
    assert all((r.doc_id in kept) for r in stages[0] if re.search("[a-z]{3}", r.text.lower()))


def test_near_duplicate_stage_keeps_one_of_each_class(stages):
    rows = sorted(stages[1], key=lambda r: r.doc_id)
    sets = [set(s.tolist()) for s in shingle_sets([r.text or "" for r in rows])]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert sorted(r.doc_id for r in stages[2]) == sorted({rows[k].doc_id for k in root})


def test_decontamination_stage_drops_whole_items_only(spark, stages):
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [plain(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in stages[3]}
    for r in stages[2]:
        assert (r.doc_id in kept) != any(i in plain(r.text) for i in items)


def test_personal_data_stage_leaves_no_base_span(stages):
    before = {r.doc_id: r for r in stages[3]}
    assert set(before) == {r.doc_id for r in stages[4]}
    for r in stages[4]:
        assert not _base_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id].text or "[" in r.text


def test_mixing_stage_meets_its_targets(stages):
    sizes = collections.Counter()
    for r in stages[4]:
        sizes[r.source] += len(_words(r.text))
    taken, target = collections.Counter(), {}
    for r in stages[5]:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 < r.taken <= 3 * r["size"] and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())


def test_run_equals_the_stages(spark, stages):
    got = sorted(map(str, cp.run(spark, SMALL).collect()))
    assert got == sorted(map(str, stages[-1]))


def test_stages_take_odd_documents(spark, tmp_path):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int, size string, hash int, label int"
    odd = [(1, "plain text that is long enough to have some words in it", "en", "a", 55), (1, "plain text that is long enough to have some words in it", "en", "a", 55),
           (None, "no id here but some words", "en", None, None), (None, None, None, None, None), (2, "", "en", "a", 0), (3, "w " * 40000, "en", "b", 80000),
           (4, "mail a@b.co", None, "b", 11)]
    for rows in ([(*r, 1, "s", 2, 3) for r in odd], []):
        docs = spark.createDataFrame(rows, kind)
        for k, (_, stage) in enumerate(cp.STAGES):
            path = f"{tmp_path}/{len(rows)}-{k}"
            stage(spark, docs, SMALL).write.parquet(path)
            docs = spark.read.parquet(path)
        if rows:
            assert sorted((r.doc_id is None, r.doc_id) for r in docs.collect() if r.doc_id is not None) == [(False, i) for i in sorted(
                {r.doc_id for r in docs.collect() if r.doc_id is not None})]
        else:
            assert docs.count() == 0


KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_decontamination_judges_rows_without_an_id_one_by_one(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    rows = [(None, f"so. {item}", "en", "a", 1), (None, "clean words that no benchmark holds at all", "en", "a", 2),
            (5, f"so. {item}", "en", "a", 1), (5, "other clean words under the same id", "en", "a", 2), (None, None, "en", "a", 3)]
    got = cp.decontamination(spark, spark.createDataFrame(rows, KIND), SMALL).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, (rows[1], rows[3], rows[4])))


def test_near_duplicates_under_one_id_and_without_one(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in ("red", "green", "blue"))
    rows = [(7, one, "en", "a", 1), (7, two, "en", "a", 2), (None, one, "en", "a", 3), (None, three, "en", "a", 4), (None, three + " end", "en", "a", 5),
            (9, two + " end", "en", "b", 6), (None, "", "en", "a", 0), (None, None, "en", "a", None), (None, None, "en", "a", None), (-3, "lone words", "en", "a", 7)]
    got = [tuple(r) for r in cp.near_duplicates(spark, spark.createDataFrame(rows, KIND).repartition(3), SMALL).collect()]
    left = [r for r in got if r[1] is None or not r[1].startswith("blue")]
    assert sorted(map(str, left)) == sorted(map(str, rows[:2] + rows[6:]))
    assert len(got) == len(left) + 1


def test_mix_keeps_texts_under_one_id(spark):
    rows = [(1, "a b c", "en", "s", 5), (1, "d e f", "en", "s", 5), (1, "g h i j", "en", "s", 7), (2, "k l", "en", "s", 3)]
    got = cp.mix(spark, spark.createDataFrame(rows, KIND), SMALL).collect()
    assert sorted(r.text for r in got) == sorted(r[1] for r in rows) and sum(r.taken for r in got) == 12


def test_all_queries_are_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"} and len(QUERIES) == 14


def test_queries_return_the_contract_columns(spark):
    want = {
        "op1_": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op2_": ["query_id", "rank", "vec_id", "score"],
        "op3_": ["doc_id", "size", "source_size", "target", "taken"],
        "op4_": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op6_": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        "op7_": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        "op9_": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op10_": ["doc_id", "held_out", "lang_pred", "score"]}
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name, q in QUERIES.items():
        columns = next((c for k, c in want.items() if name.startswith(k)), None)
        if columns:
            got = q.fn(spark, SMALL)
            assert got.columns[: len(columns)] == columns, name
            if name[:4] in ("op1_", "op3_", "op4_", "op7_", "op9_", "op10"):
                assert got.count() == n, name


def test_planted_conversation(spark):
    q = next(q for k, q in QUERIES.items() if k.startswith("op6_"))
    r = q.fn(spark, SMALL).filter(F.col("conv_id") == -7).first()
    text = "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
