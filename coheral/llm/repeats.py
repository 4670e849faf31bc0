"""Operator 9, suffix-array dedup of repeated byte strings (linear grouping construction).

Every byte that a ``WIDTH``-byte string covers is removed where the string also starts
earlier (smaller document, or earlier in the same one).  Sorting all suffixes of a
corpus at once is out of the question, so the windows are first dealt out by content:

1. Each window's anchor is its ``GRAM``-byte string of least hash.  Consecutive windows
   with one anchor form a segment; equal segments are found by hash, and only the
   earliest goes on.  Where an anchor belongs to one segment only, its windows are unique.
2. The windows of the other segments are cut into blocks of at most ``BLOCK`` starts.
   The bytes all of a block's windows share (its core) are one symbol; blocks with equal
   cores are written as short texts (bytes before, core, bytes after) and their suffixes
   are sorted by Lyndon groups (``lyndon.suffix_ranks``).  Equal windows are neighbours
   in that order, and all but the earliest are removed.

Anchors that hold ``hot_share`` of a bounded sample of texts go by single windows (a
core of ``WIDTH`` bytes), dealt by their own hash; cores with very many variants are
grouped by their windows in one sort.  So no group grows with the data, and both ways
give the same rows.  Strings are compared by two independent 64-bit hashes (anchor and
segment) or by a 64-bit hash of the core plus the bytes around it.

Every chunk of texts is read twice, in the same order; the chunks' checksums are
compared and a difference (an input that changes between reads) raises an error.

Edge cases: null text is empty; texts under ``WIDTH`` bytes keep everything; null ids come
after all others; rows with equal ids are ordered by where they are read; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coheral.llm.common import cut, mix64, modest_batches, text_slices
from coheral.llm.lyndon import suffix_ranks
from coheral.llm.words import _powers

WIDTH = 100
GRAM = 32
BLOCK = 8
CHUNK = 1 << 20
_PLACE = np.uint64((1 << 28) - 1)
_LAST = np.iinfo(np.int64).max
END, SEPARATOR, CORE = 0, 1, 258


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


class Hashes:
    """Hash of any substring of ``data`` in constant time."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, size, seed: int) -> np.ndarray:
        return mix64((self.total[start + size] - self.total[start]) * self.inverse[start], seed)


def anchors(data: np.ndarray, bounds: np.ndarray, hashes: Hashes) -> dict[str, np.ndarray]:
    """Segments of the texts in ``data``: first window start, number of windows, anchor place, hashes of both."""
    n = len(data)
    if n < WIDTH:
        return {k: np.zeros(0, t) for k, t in (("start", int), ("n", int), ("anchor", int), ("gram", np.uint64), ("segment", np.uint64))}
    last = n - GRAM + 1
    gram = mix64((hashes.total[GRAM:] - hashes.total[:last]) * hashes.inverse[:last], 21)
    least = (gram & ~_PLACE) | np.arange(last, dtype=np.uint64)
    span, windows = 1, WIDTH - GRAM + 1
    while span * 2 <= windows:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if windows > span:
        least = np.minimum(least[: len(least) - (windows - span)], least[windows - span:])
    anchor = (least & _PLACE).astype(np.int64)
    inside = np.ones(n - WIDTH + 1, bool)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        inside[max(lo, hi - WIDTH + 1):hi] = False
    change = np.ones(len(anchor) + 1, bool)
    change[1:-1] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    edge = np.flatnonzero(change)
    start, size = edge[:-1], np.diff(edge)
    use = inside[start]
    start, size = start[use], size[use]
    place = anchor[start]
    segment = hashes.of(start, size + WIDTH - 1, 22)
    segment = mix64(segment ^ (size * 256 + place - start).astype(np.uint64), 23)
    return {"start": start, "n": size, "anchor": place, "gram": gram[place], "segment": segment}


def _chunks(batches: Iterator[pd.DataFrame]):
    """(chunk id, ids with nulls last, null flags, data, bounds, checksum) of the texts in reading order."""
    me, number = TaskContext.get().partitionId(), 0
    for b in batches:
        texts = [t if isinstance(t, str) else "" for t in b["text"]]
        nulls = b["key"].isna().to_numpy()
        ids = b["key"].fillna(_LAST).to_numpy().astype(np.int64) if not nulls.any() else np.array(
            [_LAST if z else int(x) for z, x in zip(nulls, b["key"])], np.int64)
        for lo, hi in text_slices(texts, CHUNK):
            enc = [t.encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
            blob = b"".join(enc)
            bounds = np.cumsum([0] + [len(e) for e in enc])
            yield (me << 32) + number, ids[lo:hi], nulls[lo:hi], blob, bounds, zlib.crc32(ids[lo:hi].tobytes(), zlib.crc32(blob))
            number += 1


def _sorted_rows(batches: Iterator[pd.DataFrame], key: str):
    rows = (r for b in batches for r in b.itertuples())
    return itertools.groupby(rows, key=lambda r: getattr(r, key))


def _split(shard: np.ndarray, shards: int):
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)):
        yield int(s), order[edges[s]:edges[s + 1]]


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Marks rows (sorted by the keys) that differ from the row before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


# -- 1. segments ---------------------------------------------------------------------------------------------------

SEGMENTS = "shard int, chunk bigint, grams binary, segments binary, ids binary, doc binary, place binary"
CODES = "chunk bigint, kind int, doc binary, place binary, check binary"


def _emit_segments(shards: int, hot: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, ids, _, blob, bounds, check in _chunks(batches):
            data = np.frombuffer(blob, np.uint8)
            a = anchors(data, bounds, Hashes(data))
            doc = np.searchsorted(bounds, a["start"], side="right") - 1
            place = np.empty(len(doc), [("off", "<u4"), ("n", "u1"), ("anchor", "u1")])
            place["off"], place["n"], place["anchor"] = a["start"] - bounds[doc], a["n"], a["anchor"] - a["start"]
            key = np.where(np.isin(a["gram"], hot), a["segment"], a["gram"])
            out = []
            for s, own in _split(((key >> np.uint64(9)) % np.uint64(shards)).astype(np.int64), shards):
                docs, at = np.unique(doc[own], return_inverse=True)
                out.append({"shard": s, "chunk": chunk, "grams": a["gram"][own].tobytes(), "segments": a["segment"][own].tobytes(),
                            "ids": _pack(ids[docs]), "doc": _pack(np.concatenate([[check, len(docs)], docs, at]).astype(np.uint32)),
                            "place": place[own].tobytes()})
            if out:
                yield pd.DataFrame(out)
    return run


_PLACE_TYPE = np.dtype([("off", "<u4"), ("n", "u1"), ("anchor", "u1")])


def _judge_segments(hot: np.ndarray):
    """Per shard: segments seen earlier (code 1), first segments whose anchor has others (2, or 3 if it is hot)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _sorted_rows(batches, "shard"):
            parts = []
            for r in rows:
                head = _unpack(r.doc, np.uint32)
                docs, at = head[2:2 + head[1]], head[2 + head[1]:]
                parts.append((r.chunk, int(head[0]), docs[at], _unpack(r.ids, np.int64)[at],
                              np.frombuffer(r.grams, np.uint64), np.frombuffer(r.segments, np.uint64), np.frombuffer(r.place, _PLACE_TYPE)))
            sizes = [len(p[2]) for p in parts]
            chunk = np.repeat([p[0] for p in parts], sizes)
            ids, gram, seg, place = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5, 6))
            order = np.lexsort((chunk, place["off"], ids, seg, gram))
            fresh = _first_of(gram[order], seg[order])
            code = np.where(fresh, 0, 1).astype(np.uint8)
            lead = order[fresh]
            other = _first_of(gram[lead])
            alone = other & np.append(other[1:], True)
            code[np.flatnonzero(fresh)[~alone]] = 2
            is_hot = np.isin(gram[order], hot)
            code[fresh & is_hot] = 3
            back = np.empty(len(order), np.uint8)
            back[order] = code
            at, out = 0, []
            for (c, check, doc, *_), n in zip(parts, sizes):
                own = np.flatnonzero(back[at:at + n])
                if len(own):
                    out.append({"chunk": c, "kind": 1, "doc": _pack(doc[own].astype(np.uint32)),
                                "place": _pack(np.concatenate([place[at:at + n][own].view(np.uint8), back[at:at + n][own]])),
                                "check": check.to_bytes(4, "little")})
                at += n
            if out:
                yield pd.DataFrame(out)
    return run


def _read_codes(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, raw = _unpack(r.doc, np.uint32), _unpack(r.place, np.uint8)
    n = len(doc)
    return doc.astype(np.int64), raw[: n * 6].view(_PLACE_TYPE), raw[n * 6:]


# -- 2. blocks -----------------------------------------------------------------------------------------------------

TEXTS = "chunk bigint, kind int, doc binary, place binary, check binary, blob binary"
BLOCKS = "shard int, chunk bigint, ids binary, doc binary, rows binary"
_BLOCK_TYPE = np.dtype([("core", "<u8"), ("left", "<u8"), ("right", "<u8"), ("off", "<u4")])


def _emit_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for chunk, ids, nulls, blob, bounds, check in _chunks(batches):
        yield pd.DataFrame([{"chunk": chunk, "kind": 0, "doc": _pack(np.concatenate([ids, nulls]).astype(np.int64)),
                             "place": _pack(bounds), "check": check.to_bytes(4, "little"), "blob": zlib.compress(blob, 1)}])


def _check(rows_check: bytes, text_check: bytes) -> None:
    if rows_check != text_check:
        raise RuntimeError("the input's rows or their order changed between two reads; write it to a table first")


def blocks_of(data: np.ndarray, h: Hashes, start: np.ndarray, n: np.ndarray, anchor: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the segment, block rows): windows of each segment in blocks of ``width`` starts.

    Offsets are anchor - window start; block b has those in [b * width, (b + 1) * width).  ``left`` and ``right``
    hold the bytes next to the core and, in the top byte, the greatest and least t = offset - b * width.
    """
    most, least = anchor - start, anchor - start - n + 1
    first, count = least // width, most // width - least // width + 1
    own = np.repeat(np.arange(len(start)), count)
    b = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + first[own]
    t_max, t_min = np.minimum(width - 1, most[own] - b * width), np.maximum(0, least[own] - b * width)
    core = anchor[own] - b * width
    size = WIDTH - width + 1
    rows = np.zeros(len(own), _BLOCK_TYPE)
    rows["core"] = mix64(h.of(core, size, 31) ^ (b * 16 + width).astype(np.uint64), 32)
    left, right = np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint64)
    for j in range(width - 1):
        byte = data[np.maximum(core - 1 - j, 0)].astype(np.uint64)
        left |= np.where(j < t_max, byte, 0).astype(np.uint64) << np.uint64(8 * j)
        byte = data[np.minimum(core + size + j, len(data) - 1)].astype(np.uint64)
        right |= np.where(j < width - 1 - t_min, byte, 0).astype(np.uint64) << np.uint64(8 * j)
    rows["left"] = left | (t_max.astype(np.uint64) << np.uint64(56))
    rows["right"] = right | (t_min.astype(np.uint64) << np.uint64(56))
    rows["off"] = core
    return own, rows


def _emit_blocks(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, rows in _sorted_rows(batches, "chunk"):
            text, found = None, []
            for r in rows:
                if r.kind == 0:
                    text = r
                else:
                    _check(r.check, text.check)
                    found.append(_read_codes(r))
            if not found or not any((f[2] >= 2).any() for f in found):
                continue
            ids = _unpack(text.doc, np.int64)
            ids = ids[: len(ids) // 2]
            bounds, data = _unpack(text.place, np.int64), _unpack(text.blob, np.uint8)
            doc, place, code = (np.concatenate([f[k] for f in found]) for k in range(3))
            h, docs, blocks = Hashes(data), [], []
            for want, width in ((2, BLOCK), (3, 1)):
                use = code == want
                start = bounds[doc[use]] + place["off"][use]
                own, rows_ = blocks_of(data, h, start, place["n"][use].astype(np.int64), start + place["anchor"][use], width)
                docs.append(doc[use][own])
                rows_["off"] -= bounds[docs[-1]].astype(np.uint32)
                blocks.append(rows_)
            doc, rows_ = np.concatenate(docs), np.concatenate(blocks)
            out = []
            for s, own in _split(((rows_["core"] >> np.uint64(9)) % np.uint64(shards)).astype(np.int64), shards):
                some, at = np.unique(doc[own], return_inverse=True)
                out.append({"shard": s, "chunk": chunk, "ids": _pack(ids[some]),
                            "doc": _pack(np.concatenate([[len(some)], some, at]).astype(np.uint32)), "rows": rows_[own].tobytes()})
            yield pd.DataFrame(out)
    return run


def _window_keys(left: np.ndarray, right: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes around the core that belong to window t."""
    low = (np.uint64(1) << (t.astype(np.uint64) * np.uint64(8))) - np.uint64(1)
    high = (np.uint64(1) << ((BLOCK - 1 - t).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
    return left & low, right & high


def window_classes(core: np.ndarray, left: np.ndarray, right: np.ndarray, most: int = 4096, batch: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(variant, t, class) of every window of the variants (sorted by core); equal windows have equal classes."""
    t_max, t_min = (left >> np.uint64(56)).astype(np.int64), (right >> np.uint64(56)).astype(np.int64)
    heads = np.flatnonzero(_first_of(core))
    sizes = np.diff(np.append(heads, len(core)))
    bucket = np.repeat(np.arange(len(heads)), sizes)
    v = np.repeat(np.arange(len(core)), t_max - t_min + 1)
    t = np.arange(len(v)) - np.repeat(np.cumsum(t_max - t_min + 1) - (t_max - t_min + 1), t_max - t_min + 1) + t_min[v]
    k1, k2 = _window_keys(left[v], right[v], t)
    rank = np.zeros(len(v), np.int64)
    sort_here = (sizes > 1) & (sizes <= most)
    # suffix order of the short texts, a batch of whole buckets at a time
    done = 0
    while done < len(heads):
        upto = done + 1
        while upto < len(heads) and heads[upto] - heads[done] < batch:
            upto += 1
        pick = np.flatnonzero(sort_here[bucket] & (bucket >= done) & (bucket < upto))
        if len(pick):
            sym = np.zeros((len(pick), 2 * BLOCK), np.int64)
            live = np.zeros(sym.shape, bool)
            for j in range(BLOCK - 1):
                sym[:, BLOCK - 2 - j] = ((left[pick] >> np.uint64(8 * j)) & np.uint64(255)).astype(np.int64) + 2
                live[:, BLOCK - 2 - j] = j < t_max[pick]
                sym[:, BLOCK + j] = ((right[pick] >> np.uint64(8 * j)) & np.uint64(255)).astype(np.int64) + 2
                live[:, BLOCK + j] = j < BLOCK - 1 - t_min[pick]
            sym[:, BLOCK - 1], sym[:, -1] = CORE, SEPARATOR
            live[:, BLOCK - 1] = live[:, -1] = True
            sym[np.append(bucket[pick][1:] != bucket[pick][:-1], True), -1] = END
            place = np.cumsum(live.ravel()).reshape(live.shape) - 1
            text = sym[live]
            starts = np.flatnonzero(_first_of(bucket[pick]))
            bounds = np.append(np.concatenate(([0], np.cumsum(live.sum(1))))[starts], len(text))
            ranks = suffix_ranks(text, bounds)
            where = np.full(len(core), -1)
            where[pick] = np.arange(len(pick))
            own = np.flatnonzero(where[v] >= 0)
            rank[own] = ranks[place[where[v[own]], BLOCK - 1 - t[own]]]
        done = upto
    large = sizes[bucket[v]] > most
    order = np.lexsort((np.where(large, k2, 0), np.where(large, k1, 0), np.where(large, t, rank), bucket[v]))
    fresh = _first_of(bucket[v][order], t[order], k1[order], k2[order])
    cls = np.empty(len(v), np.int64)
    cls[order] = np.cumsum(fresh) - 1
    return v, t, cls


def _judge_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, rows in _sorted_rows(batches, "shard"):
        parts = []
        for r in rows:
            head = _unpack(r.doc, np.uint32)
            docs, at = head[1:1 + head[0]], head[1 + head[0]:]
            parts.append((r.chunk, docs[at], _unpack(r.ids, np.int64)[at], np.frombuffer(r.rows, _BLOCK_TYPE)))
        sizes = [len(p[1]) for p in parts]
        chunk, source = np.repeat([p[0] for p in parts], sizes), np.repeat(np.arange(len(parts)), sizes)
        doc, ids, b = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        order = np.argsort(b["core"], kind="stable")
        heads = np.flatnonzero(_first_of(b["core"][order]))
        n = np.diff(np.append(heads, len(order)))
        order = order[np.repeat(n > 1, n)]  # cores seen once have no equal windows
        chunk, source, doc, ids, b = chunk[order], source[order], doc[order], ids[order], b[order]
        # entries in corpus order within each variant
        order = np.lexsort((chunk, b["off"], ids, b["right"], b["left"], b["core"]))
        chunk, source, doc, ids, b = chunk[order], source[order], doc[order], ids[order], b[order]
        if not len(b):
            continue
        fresh = _first_of(b["core"], b["left"], b["right"])
        variant, lead = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        rank = np.empty(len(b), np.int64)
        rank[np.lexsort((chunk, b["off"], ids))] = np.arange(len(b))
        v, t, cls = window_classes(b["core"][lead], b["left"][lead], b["right"][lead])
        least = np.full(cls.max() + 1, _LAST)
        np.minimum.at(least, cls, rank[lead][v])
        # bit t of a variant's mask: its window t is first in the variant's first entry
        keeps = np.zeros(len(lead), np.uint8)
        np.bitwise_or.at(keeps, v, np.where(least[cls] == rank[lead][v], 1 << t, 0).astype(np.uint8))
        every = np.zeros(len(lead), np.uint8)
        np.bitwise_or.at(every, v, (1 << t).astype(np.uint8))
        mask = every[variant] & ~np.where(fresh, keeps[variant], 0).astype(np.uint8)
        out = []
        hit = np.flatnonzero(mask)
        hit = hit[np.argsort(source[hit], kind="stable")]
        edges = np.searchsorted(source[hit], np.arange(len(parts) + 1))
        for k in np.flatnonzero(np.diff(edges)):
            own = hit[edges[k]:edges[k + 1]]
            out.append({"chunk": parts[k][0], "kind": 2, "doc": _pack(doc[own].astype(np.uint32)),
                        "place": _pack(np.concatenate([np.ascontiguousarray(b["off"][own]).view(np.uint8), mask[own]])), "check": b""})
        if out:
            yield pd.DataFrame(out)


# -- 3. texts ------------------------------------------------------------------------------------------------------

RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _finish(keep_bytes: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _sorted_rows(batches, "chunk"):
            for r in rows:
                if r.kind == 0:
                    text, bounds, data = r, _unpack(r.place, np.int64), _unpack(r.blob, np.uint8)
                    change = np.zeros(len(data) + WIDTH + 1, np.int32)  # +1 where a removed window starts, -1 after it
                elif r.kind == 1:
                    _check(r.check, text.check)
                    doc, place, code = _read_codes(r)
                    use = code == 1
                    start = bounds[doc[use]] + place["off"][use]
                    np.add.at(change, start, 1)
                    np.add.at(change, start + place["n"][use] + WIDTH - 1, -1)
                else:
                    doc, raw = _unpack(r.doc, np.uint32).astype(np.int64), _unpack(r.place, np.uint8)
                    start, mask = bounds[doc] + raw[: len(doc) * 4].view(np.uint32), raw[len(doc) * 4:]
                    for t in range(BLOCK):
                        own = start[(mask >> t) & 1 == 1] - t
                        np.add.at(change, own, 1)
                        np.add.at(change, own + WIDTH, -1)
            gone = np.cumsum(change[: len(data)]) > 0
            ids, blob, out = _unpack(text.doc, np.int64).reshape(2, -1), data.tobytes(), []
            for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
                g = gone[lo:hi]
                removed = int(np.count_nonzero(g))
                kept = data[lo:hi][~g].tobytes() if removed else blob[lo:hi]
                spans = int(np.count_nonzero(np.diff(g.astype(np.int8), prepend=0) == 1)) if removed else 0
                out.append((hi - lo, removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            frame.insert(0, "doc_id", pd.arrays.IntegerArray(ids[0].copy(), ids[1].astype(bool)))
            yield frame
    return run


def hot_anchors(rows: DataFrame, sample_rows: int, hot_share: float) -> np.ndarray:
    """Anchors that make up ``hot_share`` of those of a bounded sample of texts (at most its inverse)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, _, blob, bounds, _ in _chunks(batches):
            data = np.frombuffer(blob, np.uint8)
            gram, n = np.unique(anchors(data, bounds, Hashes(data))["gram"], return_counts=True)
            yield pd.DataFrame({"gram": gram.view(np.int64), "n": n})

    picked = rows.orderBy(F.xxhash64("key", F.lit(3)), "key").limit(sample_rows)
    counts = cut(picked.mapInPandas(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") >= max(32, total * hot_share)).select("gram").collect()
    return np.array([r[0] for r in hot], np.int64).view(np.uint64)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = 1024, hot_share: float = 0.0005,
                   keep_bytes: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for."""
    spark = df.sparkSession
    modest_batches(spark)
    shards = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    hot = hot_anchors(rows, sample_rows, hot_share)

    def dealt(frame: DataFrame, by: str, *then: str) -> DataFrame:
        return frame.repartition(shards, by).sortWithinPartitions(by, *then)

    codes = cut(dealt(rows.mapInPandas(_emit_segments(shards, hot), SEGMENTS), "shard", "chunk")
                .mapInPandas(_judge_segments(hot), CODES))
    texts = rows.mapInPandas(_emit_texts, TEXTS)
    marks = codes.withColumn("blob", F.lit(None).cast("binary"))
    blocks = dealt(texts.unionByName(marks), "chunk", "kind").mapInPandas(_emit_blocks(shards), BLOCKS)
    masks = dealt(blocks, "shard", "chunk").mapInPandas(_judge_blocks, CODES).withColumn("blob", F.lit(None).cast("binary"))
    out = dealt(texts.unionByName(marks).unionByName(masks), "chunk", "kind").mapInPandas(_finish(keep_bytes), RESULT)
    return out if keep_bytes else out.drop("kept")
