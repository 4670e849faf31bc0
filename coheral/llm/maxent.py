"""Operator 1, LM scoring: hashed maximum-entropy model with a class-factored softmax.

P(token | context) = P(class | context) * P(token | class).  The class softmax is a
maximum-entropy model over hashed features of the context: the previous token, the pair
of previous tokens, and the tokens two and three back with the nearer ones skipped.  It
is trained by distributed gradient updates: in every round each task runs AdaGrad over
its share of the learning texts from the common weights, and the weighted mean of the
updates makes the next weights; each learning text is used in one round.  Inside a class the
features are the token identities alone, whose maximum-entropy solution is known in
closed form: the smoothed relative frequencies (c + 0.1) / (N_class + 0.1 (V_class + 1)),
where the class's one unseen token stands for all tokens not learned.  So the model is a
distribution, and equals the base model when the context tells nothing.

A token's class is read off its spelling (hash of its last two bytes), except for the most
frequent tokens, which are classes of their own.  All counts are exact over all learning
texts: tasks sum them up, shards of the token hash merge them.  Tokens of a share of
``table_share`` or more (at most its inverse, whatever the corpus) are known to every
task; the others are looked up by sending (text, token hash) in packed arrays to
the token's shard, and the texts' sums come back.

Edge cases: null or empty text has only the end token; rows with a null id are scored, not
learned and not held out; with nothing to learn all counts are 0; repeated rows count
as often as they occur; a text of any length is scored whole.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coheral.llm.common import cut, mix64, modest_batches, text_slices
from coheral.llm.words import words

SPELLING = 64          # classes by spelling
SINGLES = 32           # classes of one frequent token
CLASSES = SPELLING + SINGLES
BUCKETS = 1 << 13      # hashed features
CHUNK = 1 << 20
END = np.uint64((0x5DEECE66D << 6) | 1)
_GROUP = np.uint64(SPELLING - 1)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts (words, then one end each) and tokens per text.

    The low six bits of a hash are the class by spelling.
    """
    data, starts, ends, h, counts = words(texts)
    if len(h):
        last = data[ends - 1].astype(np.uint64)
        before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        group = mix64(last * np.uint64(256) + before, 17) & _GROUP
        h = (h & ~_GROUP) | group
    out = np.full(len(h) + len(texts), END, np.uint64)
    at = np.ones(len(out), bool)
    at[np.cumsum(counts + 1) - 1] = False
    out[at] = h
    return out, counts + 1


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _sum_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([n for _, n in parts])[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _texts(b: pd.DataFrame) -> list[str]:
    return [t if isinstance(t, str) else "" for t in b["text"]]


def count_tokens(learn: DataFrame, shards: int, hold: int = 1 << 21) -> DataFrame:
    """(shard, hashes, counts): one row per shard with all its tokens' exact counts."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0

        def flush() -> Iterator[pd.DataFrame]:
            keys, n = _sum_up(parts)
            at = _shard(keys, shards)
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(shards + 1))
            for s in range(shards):
                own = order[edges[s]:edges[s + 1]]
                if len(own):
                    yield pd.DataFrame({"shard": [s], "hashes": [keys[own].tobytes()], "counts": [_pack(n[own])]})

        for b in batches:
            texts = _texts(b)
            for lo, hi in text_slices(texts, CHUNK):
                h, _ = tokens(texts[lo:hi])
                keys, n = np.unique(h, return_counts=True)
                parts.append((keys, n.astype(np.int64)))
                size += len(keys)
                if size > hold:
                    parts[:] = [_sum_up(parts)]
                    size = len(parts[0][0])
                    if size > hold // 2:
                        yield from flush()
                        parts, size = [], 0
        if size:
            yield from flush()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((r.shard, r.hashes, r.counts) for b in batches for r in b.itertuples())
        for s, own in itertools.groupby(rows, key=lambda r: r[0]):
            parts, size, settled = [], 0, 0
            for _, h, n in own:
                parts.append((np.frombuffer(h, np.uint64), _unpack(n, np.int64)))
                size += len(parts[-1][0])
                if size > hold + 2 * settled:
                    parts = [_sum_up(parts)]
                    size = settled = len(parts[0][0])
            keys, n = _sum_up(parts)
            yield pd.DataFrame({"shard": [s], "hashes": [keys.tobytes()], "counts": [_pack(n)], "n": [int(n.sum())], "v": [len(keys)]})

    return (learn.mapInPandas(partial, "shard int, hashes binary, counts binary")
            .repartition(shards, "shard").sortWithinPartitions("shard")
            .mapInPandas(merge, "shard int, hashes binary, counts binary, n bigint, v bigint"))


@dataclass
class Model:
    n: int
    v: int
    table: np.ndarray        # hashes of the tokens every task knows, sorted
    table_counts: np.ndarray
    table_class: np.ndarray  # their classes
    class_n: np.ndarray
    class_v: np.ndarray
    weights: np.ndarray      # (BUCKETS + 1) x CLASSES; the last row is the bias

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table or -1, class) of every token."""
        cls = (h & _GROUP).astype(np.int64)
        if not len(self.table):
            return np.full(len(h), -1), cls
        at = np.minimum(np.searchsorted(self.table, h), len(self.table) - 1)
        known = self.table[at] == h
        return np.where(known, at, -1), np.where(known, self.table_class[at], cls)

    def features(self, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(table places, classes, feature rows n x 4) of the tokens of whole texts."""
        at, cls = self.look_up(h)
        # a frequent token is a symbol of its own, others are their class
        symbol = np.where(at >= 0, at + CLASSES + 1, cls).astype(np.uint64)
        pos = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        back = []
        for k in (1, 2, 3):
            s = np.full(len(h), CLASSES, np.uint64)
            s[k:] = symbol[:-k] if k < len(h) else symbol[:0]
            s[pos < k] = CLASSES
            back.append(s)
        mask, big = np.uint64(BUCKETS - 1), np.uint64(1 << 24)
        rows = np.empty((len(h), 4), np.int32)
        for f, key in enumerate((back[0], back[0] * big + back[1], back[1], back[2])):
            rows[:, f] = mix64(key, 100 + f) & mask
        return at, cls, rows

    def logits(self, rows: np.ndarray) -> np.ndarray:
        w = self.weights
        out = np.take(w, rows[:, 0], axis=0)
        for f in range(1, rows.shape[1]):
            out += np.take(w, rows[:, f], axis=0)
        out += w[BUCKETS]
        return out

    def class_log10(self, rows: np.ndarray, cls: np.ndarray, batch: int = 4096) -> np.ndarray:
        out = np.empty(len(cls))
        for lo in range(0, len(cls), batch):
            z = self.logits(rows[lo:lo + batch])
            z -= z.max(1, keepdims=True)
            own = z[np.arange(len(z)), cls[lo:lo + batch]]
            out[lo:lo + batch] = (own - np.log(np.exp(z).sum(1))) / np.log(10)
        return out


def _sum_rows(p: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature rows in use, sum of p's rows over the tokens that have them).

    Features are ordered by how often they occur; the k-th occurrences of all that have one are added
    at once, until few features are left, which are summed one by one.
    """
    flat = rows.T.astype(np.uint16).ravel()  # BUCKETS fits; short keys are sorted by radix
    order = np.argsort(flat, kind="stable")
    key = flat[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    often = np.argsort(-size, kind="stable")
    first, size = first[often], size[often]
    token = order % len(p)
    out, k = p[token[first]], 1
    while (more := int(np.searchsorted(-size, -k))) > 48:
        out[:more] += p[token[first[:more] + k]]
        k += 1
    for i in range(more):
        out[i] += p[token[first[i] + k: first[i] + size[i]]].sum(0)
    return key[first], out


def gradient_steps(m: Model, rows: np.ndarray, cls: np.ndarray, memory: np.ndarray, rate: float, batch: int = 4096) -> None:
    """AdaGrad over the tokens in batches; changes the model's weights and the squared-gradient memory."""
    w = m.weights
    for lo in range(0, len(cls), batch):
        r, c = rows[lo:lo + batch], cls[lo:lo + batch]
        p = m.logits(r)
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(c)), c] -= 1
        use, grad = _sum_rows(p, r)
        use, grad = np.append(use, BUCKETS), np.vstack([grad, p.sum(0, keepdims=True)])
        past = memory[use]
        past += grad * grad
        memory[use] = past
        past += np.float32(1e-6)
        np.sqrt(past, out=past)
        grad /= past
        grad *= np.float32(rate)
        w[use] -= grad


def _sum_blocks(df: DataFrame, spread: int) -> DataFrame:
    """Sum the float arrays of (block, learner, weight, delta) by block: first in ``spread`` groups, then together."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((r.block, r.learner, r.weight, r.delta) for b in batches for r in b.itertuples())
        for (block, learner), own in itertools.groupby(rows, key=lambda r: r[:2]):
            total, weight = None, 0.0
            for _, _, w, d in own:
                part = np.frombuffer(d, np.float32).astype(np.float64)
                total, weight = part if total is None else total + part, weight + w
            yield pd.DataFrame({"block": [block], "learner": [learner], "weight": [weight], "delta": [total.astype(np.float32).tobytes()]})

    kind = "block int, learner int, weight double, delta binary"
    for groups in (spread, 1):
        df = (df.withColumn("learner", F.col("learner") % groups)
              .repartition("block", "learner").sortWithinPartitions("block", "learner").mapInPandas(add, kind))
    return df


def _round(learn: DataFrame, model: Model, rate: float, blocks: int = 16) -> np.ndarray:
    """Weighted mean of all tasks' changes of the weights after one pass over ``learn``."""
    shared = learn.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = shared.value
        own = Model(**{**base.__dict__, "weights": base.weights.copy()})
        memory, seen = np.zeros_like(own.weights), 0
        for b in batches:
            texts = _texts(b)
            for lo, hi in text_slices(texts, CHUNK):
                h, sizes = tokens(texts[lo:hi])
                _, cls, rows = own.features(h, sizes)
                gradient_steps(own, rows, cls, memory, rate)
                seen += len(h)
        if seen:
            # per row of weights, a task counts by what it has seen of that feature
            trust = np.sqrt(memory.sum(1)).astype(np.float32) + 1e-9
            delta = np.hstack([(own.weights - base.weights) * trust[:, None], trust[:, None]]).astype(np.float32)
            me = TaskContext.get().partitionId()
            for k, part in enumerate(np.array_split(delta, blocks)):
                yield pd.DataFrame({"block": [k], "learner": [me], "weight": [float(seen)], "delta": [part.tobytes()]})

    sums = _sum_blocks(learn.mapInPandas(run, "block int, learner int, weight double, delta binary"), 32)
    out = sorted(sums.collect(), key=lambda r: r["block"])  # one row per block: the size of the weights
    if not out:
        return np.zeros_like(model.weights)
    full = np.concatenate([np.frombuffer(r["delta"], np.float32).reshape(-1, CLASSES + 1) for r in out])
    return full[:, :CLASSES] / np.maximum(full[:, CLASSES:], 1e-9)


def fit(learn: DataFrame, counts: DataFrame, rounds: int, rate: float, table_share: float) -> Model:
    """``learn`` has (key, text); ``counts`` comes from count_tokens (written already)."""
    total = counts.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"] or 0)
    least = max(1, int(np.ceil(n * table_share)))

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                h, c = np.frombuffer(r.hashes, np.uint64), _unpack(r.counts, np.int64)
                group, top = (h & _GROUP).astype(np.int64), c >= least
                yield pd.DataFrame({"top": [h[top].tobytes()], "top_n": [c[top].tobytes()],
                                    "class_n": [np.bincount(group, c, SPELLING).astype(np.int64)],
                                    "class_v": [np.bincount(group, minlength=SPELLING)]})

    parts = counts.mapInPandas(summary, "top binary, top_n binary, class_n array<bigint>, class_v array<bigint>").select(
        "top", "top_n", F.posexplode(F.arrays_zip("class_n", "class_v")).alias("g", "x"))
    # at most 1 / table_share tokens in all, and one row per class
    tops = [r for r in parts.filter("g = 0").select("top", "top_n").collect()]
    by_class = {r["g"]: r for r in parts.groupBy("g").agg(F.sum("x.class_n").alias("n"), F.sum("x.class_v").alias("v")).collect()}
    table = np.concatenate([np.frombuffer(r["top"], np.uint64) for r in tops]) if tops else np.zeros(0, np.uint64)
    table_n = np.concatenate([np.frombuffer(r["top_n"], np.int64) for r in tops]) if tops else np.zeros(0, np.int64)
    order = np.argsort(table)
    table, table_n = table[order], table_n[order]
    cls = (table & _GROUP).astype(np.int64)
    class_n, class_v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for g, r in by_class.items():
        class_n[g], class_v[g] = r["n"], r["v"]
    for k, t in enumerate(sorted(range(len(table)), key=lambda t: (-table_n[t], table[t]))[:SINGLES]):
        class_n[cls[t]] -= table_n[t]
        class_v[cls[t]] -= 1
        cls[t] = SPELLING + k
        class_n[cls[t]], class_v[cls[t]] = table_n[t], 1
    weights = np.zeros((BUCKETS + 1, CLASSES), np.float32)
    weights[BUCKETS] = np.log(class_n + 0.1 * (class_v + 1)) - np.log(n + 0.1 * (v + CLASSES))
    model = Model(n, v, table, table_n, cls, class_n, class_v, weights)
    for k in range(rounds if n else 0):
        share = learn.filter(F.pmod(F.xxhash64("key", F.lit(31)), F.lit(rounds)) == k)
        model.weights = model.weights + _round(share, model, rate)
    return model


def score(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", shards: int | None = None,
          rounds: int = 3, rate: float = 0.15, table_share: float = 4e-6) -> DataFrame:
    """Score every row, learning from those where ``held_out`` is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).
    """
    spark = df.sparkSession
    modest_batches(spark)
    shards = shards or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), held_out.alias("held_out"))
    learn = rows.filter("key IS NOT NULL AND NOT held_out").select("key", "text")
    counts = cut(count_tokens(learn, shards))
    model = fit(learn, counts, rounds, rate, table_share)
    shared = spark.sparkContext.broadcast(model)
    unseen = np.log10(model.class_n + 0.1 * (model.class_v + 1))
    base_unit, train_tokens = float(np.log10(model.n + 0.1 * (model.v + 1))), model.n

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per chunk of texts: one row with what is known here, and one per shard with the tokens to look up."""
        m, me, number = shared.value, TaskContext.get().partitionId(), 0
        known_log = np.log10(m.table_counts + 0.1)
        for b in batches:
            texts = _texts(b)
            for lo, hi in text_slices(texts, CHUNK):
                h, sizes = tokens(texts[lo:hi])
                at, cls, feats = m.features(h, sizes)
                owner = np.repeat(np.arange(hi - lo, dtype=np.int32), sizes)
                here = at >= 0
                sums = np.bincount(owner[here], known_log[at[here]], hi - lo)
                known = np.bincount(owner[here], minlength=hi - lo)
                by_class = np.bincount(owner, m.class_log10(feats, cls) - unseen[cls], hi - lo)
                chunk = me * (1 << 32) + number
                number += 1
                part = b.iloc[lo:hi]
                ids = part["key"].to_numpy(dtype=float, na_value=np.nan)
                out = [{"shard": chunk % shards, "kind": 2, "chunk": chunk, "ids": part["key"].fillna(0).astype(np.int64).to_numpy().tobytes(),
                        "flags": np.column_stack([np.isnan(ids), part["held_out"].to_numpy(bool)]).astype(np.uint8).tobytes(),
                        "owner": _pack(np.concatenate([sizes, known]).astype(np.int64)), "values": np.concatenate([sums, by_class]).tobytes()}]
                far, who = h[~here], owner[~here]
                to = _shard(far, shards)
                order = np.argsort(to, kind="stable")
                far, who = far[order], who[order]
                edges = np.searchsorted(to[order], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(edges)):
                    a, z = edges[s], edges[s + 1]
                    out.append({"shard": int(s), "kind": 1, "chunk": chunk, "ids": None, "flags": None,
                                "owner": _pack(who[a:z]), "values": far[a:z].tobytes()})
                yield pd.DataFrame(out)

    kind = "shard int, kind int, chunk bigint, ids binary, flags binary, owner binary, values binary"

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted by shard and kind: its counts (0), tokens to look up (1), rows to hand on (2)."""
        at, keys, logs = -1, np.zeros(0, np.uint64), np.zeros(0)
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.kind == 0:
                    at, keys, logs = r.shard, np.frombuffer(r.values, np.uint64), np.log10(_unpack(r.owner, np.int64) + 0.1)
                elif r.kind == 2:
                    out.append((r.chunk, 0, r.ids, r.flags, r.owner, r.values))
                else:
                    h, who = np.frombuffer(r.values, np.uint64), _unpack(r.owner, np.int32)
                    value, found = np.full(len(h), -1.0), np.zeros(len(h), bool)  # log10(0 + 0.1)
                    if at == r.shard and len(keys):
                        p = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                        found = keys[p] == h
                        value[found] = logs[p[found]]
                    texts, inverse = np.unique(who, return_inverse=True)
                    out.append((r.chunk, 1, None, None, _pack(np.concatenate([texts, np.bincount(inverse, found)]).astype(np.int32)),
                                np.bincount(inverse, value).tobytes()))
            yield pd.DataFrame(out, columns=["chunk", "kind", "ids", "flags", "owner", "values"])

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted by chunk and kind: a chunk's texts first, then the shards' sums for them."""
        rows = ((r.chunk, r.kind, r.ids, r.flags, r.owner, r.values) for b in batches for r in b.itertuples())
        for _, own in itertools.groupby(rows, key=lambda r: r[0]):
            ids = None
            for _, k, i, f, owner, values in own:
                if k == 0:
                    ids, flags = np.frombuffer(i, np.int64), np.frombuffer(f, np.uint8).reshape(-1, 2)
                    sizes, known = _unpack(owner, np.int64).reshape(2, -1).copy()
                    sums, by_class = np.frombuffer(values, float).reshape(2, -1).copy()
                else:
                    texts, found = _unpack(owner, np.int32).reshape(2, -1)
                    sums[texts] += np.frombuffer(values, float)
                    known[texts] += found
            yield pd.DataFrame({"doc_id": pd.arrays.IntegerArray(ids.copy(), flags[:, 0].astype(bool)),
                                "held_out": flags[:, 1].astype(bool), "n_tokens": sizes, "n_known": known,
                                "train_tokens": np.full(len(ids), train_tokens), "base_score": sums - sizes * base_unit, "score": sums + by_class})

    dictionary = counts.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("ids"),
                               F.lit(None).cast("binary").alias("flags"), F.col("counts").alias("owner"), F.col("hashes").alias("values"))
    asked = rows.mapInPandas(local, kind).unionByName(dictionary)
    answered = (asked.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "chunk")
                .mapInPandas(look_up, "chunk bigint, kind int, ids binary, flags binary, owner binary, values binary"))
    return (answered.repartition(shards, "chunk").sortWithinPartitions("chunk", "kind").mapInPandas(
        together, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"))
