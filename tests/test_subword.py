"""Subword counts (X7): round trips, a plain merge loop, and the operators that count with them."""

import base64
import os

import pytest
import regex
from pyspark.sql import functions as F

from coheral.functions.subword import RANK_PATTERN, Subwords
from coheral.operators import arena as A
from coheral.operators import conversations as C
from coheral.operators import sft as S
from tests.conftest import SMALL

FOLDER = os.environ.get("COHERAL_VOCABULARIES", "/opt/tokenizers")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no vocabulary files here")
BYTES = ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken"]
TEXTS = ["Hello world, hello", "", None, "naïve café 漢字 \U0001f600", "a" * 300, "  two  blanks\n\n\ttab ", "<|endoftext|> is text", "don't 12345 !!??"]


def _of(spark, name):
    return Subwords(spark, os.path.join(FOLDER, name))


@pytest.mark.parametrize("name", BYTES)
def test_round_trip_and_counts(spark, name):
    sub = _of(spark, name)
    docs = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(TEXTS + docs)), "i int, t string").repartition(3)
    rows = df.select("t", sub.encode("t").alias("ids"), sub("t").alias("n")).select("*", sub.decode("ids").alias("back")).collect()
    assert len(rows) == len(TEXTS) + len(docs)
    for r in rows:
        assert r.back == r.t and (r.n is None if r.t is None else r.n == len(r.ids))


def _merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best: best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_ids_equal_the_plain_merge_loop(spark):
    with open(os.path.join(FOLDER, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sub = _of(spark, "byte_bpe_50k.tiktoken")
    texts = [t for t in TEXTS if t] + ["The quick brown fox's jumps; over thelazydogs unbelievably 3.14159"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sub.encode("t").alias("ids")).collect()
    for r in got:
        assert r.ids == [i for w in regex.findall(RANK_PATTERN, r.t) for i in _merge(w.encode(), ranks)]


def test_other_kinds_count(spark):
    for name in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"):
        sub = _of(spark, name)
        got = spark.createDataFrame([("one two three",), (None,), ("",)], "t string").select(sub("t").alias("n")).collect()
        assert got[0].n >= 3 and got[1].n is None and got[2].n == 0
    with pytest.raises(Exception, match="not a .json"):
        spark.createDataFrame([("x",)], "t string").select(Subwords(spark, __file__)("t")).collect()


def test_operators_count_with_them(spark):
    sub = _of(spark, "byte_bpe_50k.json")
    conv = [("human", "unbelievably long question"), ("gpt", "short"), ("human", "two"), ("gpt", "an antidisestablishmentarian answer")]
    schema = "id string, ord long, model string, plugins string, conversations array<struct<from:string,value:string>>"
    chats = spark.createDataFrame([("c", 0, None, None, conv), ("empty", 1, None, None, [])], schema)
    n = [r.n for r in spark.createDataFrame([(v,) for _, v in conv], "t string").select(sub("t").alias("n")).collect()]
    first = n[0] + n[1] + 12
    got = C.split_long_conversation(chats, first + 1, token_len=sub, keep_tail=True).collect()
    assert [(r.id, len(r.conversations)) for r in got] == [("c_0", 2), ("c_2", 2)]
    assert len(C.split_long_conversation(chats, first + n[2] + n[3] + 12, token_len=sub).collect()) == 1
    summary = C.corpus_stats(chats, sub)[0].first()
    assert summary.n_tokens == sum(n) and summary.avg_prompt_len == (n[0] + n[2]) / 2
    masks = {r.id: r for r in S.chat_sft_masks(chats, token_len=sub).collect()}
    text = masks["c"].text
    assert masks["c"].n_tokens == spark.createDataFrame([(text,)], "t string").select(sub("t")).first()[0]
    pairs = spark.createDataFrame([("a context", "a sentence", 1)], "context string, sentence string, label int")
    e = S.sft_examples(pairs, token_len=sub).select("mask_len", sub("prompt").alias("n")).first()
    assert e.mask_len == e.n + 2
    talk = spark.createDataFrame([(1, "m", "en", 1, [("user", "unbelievably"), ("assistant", None)])],
                                 "user_id int, model string, language string, turn int, conversation array<struct<role:string,content:string>>")
    assert A.release_stats(talk, sub).first().avg_prompt_tokens == spark.range(1).select(sub(F.lit("unbelievably"))).first()[0]


def test_a_tokenizer_gets_bounded_slices():
    import pandas as pd

    from coheral.functions import subword as W

    seen = []
    texts = pd.Series(["ab" * 40_000, None, "", "c" * 300_000, *["d" * 1000] * 600], dtype=object)
    got = W._over(texts, lambda some: seen.append(some) or [len(t) for t in some])
    assert got.tolist() == [80_000, None, 0, 300_000, *[1000] * 600]
    assert len(seen) > 3 and all(len(s) == 1 or sum(map(len, s)) <= W.SLICE for s in seen)


def test_corpus_stats_tokenize_once(spark):
    rows = [("a", [("human", "one two"), ("gpt", "x")]), ("b", [("human", "one"), ("gpt", None), ("human", "left")]), ("c", []), ("d", None)]
    chats = spark.createDataFrame(rows, "id string, conversations array<struct<from:string,value:string>>")
    out = C.corpus_stats(chats, Subwords(spark, os.path.join(FOLDER, "byte_bpe_50k.json")))[0]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    r = C.corpus_stats(chats)[0].first()
    assert (r.n_conversations, r.avg_prompt_len, r.avg_response_len, r.n_tokens) == (4, 1.5, 1.0, 3)
    none = C.corpus_stats(chats.limit(0))[0].first()
    assert (none.n_conversations, none.avg_prompt_len, none.n_tokens) == (0, None, None)
