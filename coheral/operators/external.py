"""Calls to external models as Arrow-batched partition operators.

``llm_map`` sends each row's prompt to a user-supplied callable inside an
iterator UDF: prompts stream out and replies back in Arrow batches, each partition runs a
bounded thread pool (global concurrency = running tasks x ``concurrency``), and
failures become an error value instead of failing the task.  A deterministic
offline stub keeps everything testable without network access.  Re-running
with ``resume_from`` skips keys already answered (left anti join).
"""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

# ---- fixed values of the reference's retry policies ---------------------------
API_MAX_RETRY = 16
API_RETRY_SLEEP = 10
API_ERROR_OUTPUT = "$ERROR$"
# ---------------------------------------------------------------------------


@dataclass
class RetryFixed:
    """Up to ``tries`` attempts, fixed sleep, then the error output."""
    tries: int = API_MAX_RETRY
    sleep: float = API_RETRY_SLEEP
    error_output: str = API_ERROR_OUTPUT

    def call(self, fn: Callable[[str], str], prompt: str) -> str:
        for _ in range(self.tries):
            try:
                return fn(prompt)
            except Exception:  # noqa: BLE001 -- any client error is retried
                time.sleep(self.sleep)
        return self.error_output


@dataclass
class RetryBackoff:
    """Exponential backoff, base 2, jitter, ``max_retries`` retries; then re-raise."""
    max_retries: int = 5
    initial_delay: float = 1.0
    base: float = 2.0
    jitter: bool = True
    error_output: str | None = None

    def call(self, fn: Callable[[str], str], prompt: str) -> str:
        delay = self.initial_delay
        for attempt in range(self.max_retries + 1):
            try:
                return fn(prompt)
            except Exception:  # noqa: BLE001
                if attempt == self.max_retries:
                    if self.error_output is not None:
                        return self.error_output
                    raise
                delay *= self.base * (1 + (random.random() if self.jitter else 0))
                time.sleep(delay)
        return self.error_output or ""


def stub_model(prompt: str) -> str:
    """Deterministic offline model: a verdict derived from the prompt's MD5."""
    h = hashlib.md5(prompt.encode("utf-8")).hexdigest()
    return ("1" if h[0] < "8" else "0") + "\nstub reply " + h[:8]


def stub_judge(prompt: str) -> str:
    """Deterministic offline judge: a pair verdict and a score derived from the prompt's MD5."""
    h = hashlib.md5(prompt.encode("utf-8")).hexdigest()
    verdict = "[[A]]" if h[0] < "6" else "[[B]]" if h[0] < "c" else "[[C]]" if h[0] < "f" else "undecided"
    return f"{h[:8]}: {verdict} Rating: [[{int(h[1], 16) % 10 + 1}]]"


def llm_map(df: DataFrame, prompt_col: str, fn: Callable[[str], str] = stub_model, out_col: str = "reply",
            policy=None, concurrency: int = 4, key: str | None = None, resume_from: DataFrame | None = None,
            empty_on_error: bool = True) -> DataFrame:
    """One model call per row; returns ``df`` plus ``out_col``.

    ``fn`` must be picklable.  With ``policy`` None a failing call yields ''
    (the reference's behaviour when a request raises).
    """
    if resume_from is not None and key is not None:
        df = df.join(resume_from.select(key), key, "left_anti")
    pol = policy

    def one(p):
        if p is None:
            return None
        if pol is not None:
            return pol.call(fn, p)
        try:
            return fn(p)
        except Exception:  # noqa: BLE001
            if empty_on_error:
                return ""
            raise

    @F.pandas_udf("string")
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(max_workers=concurrency) as ex:
            for batch in batches:
                prompts = batch.tolist()
                replies: list = [None] * len(prompts)
                places = iter(range(len(prompts)))  # each thread takes the next prompt; a range's iterator is safe to share

                def work():
                    try:
                        for i in places:
                            replies[i] = one(prompts[i])
                    except BaseException:
                        for _ in places:  # no further calls after a failure
                            pass
                        raise

                for w in [ex.submit(work) for _ in range(concurrency)]:
                    w.result()
                yield pd.Series(replies, dtype=object)

    # calls have a price: never repeated for a filter or a second use of the reply
    return df.withColumn(out_col, reply.asNondeterministic()(F.col(prompt_col)))


# ---- fixed values: marks that the offline moderation default looks for ----------
MODERATION_MARKS = ["<redacted>", "<anonymized>"]
# ---------------------------------------------------------------------------


def moderation_tag(df: DataFrame, text_col: str, fn: Callable[[str], dict] | None = None,
                   conservative: bool = True) -> DataFrame:
    """``df`` with flagged, categories (array of names) and error.

    The offline default is a column expression over MODERATION_MARKS.  With ``fn`` (text ->
    {"flagged": bool, "categories": [...]}) a failing call gives its message in ``error`` and
    counts as flagged (serving, ``conservative``) or null (batch).
    """
    if fn is None:
        text = F.coalesce(F.col(text_col), F.lit(""))
        found = F.array_compact(F.array(*[F.when(text.contains(m), m.strip("<>")) for m in MODERATION_MARKS]))
        return df.withColumns({"flagged": F.size(found) > 0, "categories": found, "error": F.lit(None).cast("string")})
    schema = StructType([*df.schema.fields, StructField("flagged", BooleanType()),
                         StructField("categories", ArrayType(StringType())), StructField("error", StringType())])

    def one(text):
        try:
            got = fn(text or "")
            return bool(got["flagged"]), list(got.get("categories", [])), None
        except Exception as e:  # noqa: BLE001 -- any client error becomes a value
            return (True if conservative else None), [], str(e)

    def run(batches):
        for pdf in batches:
            rows = [one(t) for t in pdf[text_col].tolist()]
            for k, c in enumerate(("flagged", "categories", "error")):
                pdf[c] = [r[k] for r in rows]
            yield pdf

    return df.mapInPandas(run, schema)


def tags_per_message(tagged: DataFrame, conv: str = "conv_id", turn: str = "turn", tag: str = "flagged") -> DataFrame:
    """One array of message tags per conversation, in turn order."""
    return tagged.groupBy(conv).agg(F.transform(F.sort_array(F.collect_list(F.struct(turn, tag))), lambda x: x[tag]).alias("tags"))


def hashed_embedding(df: DataFrame, text_col: str, dim: int = 64, out_col: str = "embedding") -> DataFrame:
    """X6 offline default: L2-normalised hashed bag of lower-cased words (MLlib HashingTF + Normalizer, JVM side)."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    tok = RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True)
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim)
    nz = Normalizer(inputCol="_tf", outputCol="_n", p=2.0)
    out = nz.transform(tf.transform(tok.transform(df)))
    return out.withColumn(out_col, vector_to_array("_n")).drop("_words", "_tf", "_n")
