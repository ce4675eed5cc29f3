"""N-gram Jaccard join in the Jaccard metric space: pivots, Voronoi regions and triangle-inequality windows, exactly.

Documents of equal shingle sets collapse to one set. Pivots by themselves would leave nearly all sets at distance 1 from
every pivot, so regions are opened from an index that no linked pair can evade: sets of similarity t share a shingle among
their first n - ceil(t n) + 1 shingles in any common order. In each bucket of that index the smallest set is a pivot.

1. Every set is measured against its pivots: at distance 1 - t or less it is linked and lies in the pivot's region.
2. Links give components; two sets of one component need not meet again.
3. Sets of a bucket in different components meet if the triangle inequality allows it, given their distances from the
   bucket's pivot, and sizes do: boundary sets are compared with each region they may reach into. Measured pairs link.

Measuring goes in two steps. The counts of a set's shingles by hash class bound what two sets can share (so that
distance has a lower bound); pairs that this does not settle are counted exactly.

The common order puts frequent shingles (as far as partitions see them) last, so that passages which many documents
share open no large buckets. Any order is exact; the list of frequent shingles has a fixed size.

Nulls: a null text has no words; documents without words have an empty set and are linked with nothing. A null doc_id is
passed over for component ids where its component has another. Repeated rows are one set. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import materialize, mix64, ship, small_batches
from .components import components

WORDS = 5
#: Similarity in percent, from which on two sets are linked.
PERCENT = 75
#: Pivots of a bucket.
PIVOTS = 2
#: Likely partners of a set, in a bucket, that are measured before all others.
NEAREST = 3
#: Frequent shingles that the order knows, at most: 8 bytes each, broadcast.
FREQUENT = 1 << 18
#: Bits of the map of sets whose shingles are fetched: what is broadcast has this size always.
MAP_BITS = 1 << 26
#: Rows that one group of `_meetings` has, about: larger ones are split.
GROUP_ROWS = 512
#: Smallest tokens that a set of a split pivot carries, by which a pair knows the one part that passes it on.
CARRIED = 32
_NONE = np.iinfo(np.int64).max
_CHUNK = 1 << 19
_C, _D = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: By the number of bytes that count of eight.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its bytes go through a bijective mixer by eights, after its length."""
    n = stop - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    h = mix64(n.astype(np.uint64) * _C)
    live, k = np.arange(len(n)), 0
    while len(live):
        left = n[live] - k
        h[live] = mix64((h[live] * _D) ^ (eights[start[live] + k] & _MASKS[np.minimum(left, 8)]))
        live, k = live[left > 8], k + 8
    return h


def _sets_of_chunk(texts: list[bytes], words: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    low = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start = np.flatnonzero(edge == -1)
    stop = np.flatnonzero(edge == 1)
    if not len(start):
        return [np.zeros(0, np.uint64) for _ in texts]
    w = word_hashes(low, start, stop)
    of = np.searchsorted(ends, start, side="right")
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    n = max(0, len(w) - words + 1)
    h = w[:n].copy()
    for j in range(1, words):
        h = mix64(h * _D + w[j : n + j])
    out = []
    for k in range(len(texts)):
        a, b = int(first[k]), int(first[k + 1])
        if b - a >= words:
            out.append(np.unique(h[a : b - words + 1]))
        elif b > a:
            one = w[a : a + 1].copy()
            for j in range(a + 1, b):
                one = mix64(one * _D + w[j : j + 1])
            out.append(mix64(one ^ _C))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The ascending hashes of each text's distinct shingles; texts are hashed together in chunks."""
    chunk, size = [], 0
    for t in texts:
        chunk.append((t or "").encode())
        size += len(chunk[-1])
        if size >= _CHUNK:
            yield from _sets_of_chunk(chunk, words)
            chunk, size = [], 0
    if chunk:
        yield from _sets_of_chunk(chunk, words)


def set_id(s: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """Two sums over the set, as signed longs."""
    with np.errstate(over="ignore"):
        a, b = mix64(s + _C + mix64(np.array([seed], np.uint64))).sum(dtype=np.uint64), mix64(s ^ _D).sum(dtype=np.uint64)
    both = np.array([a, b], np.uint64).astype(np.int64)
    return int(both[0]), int(both[1])


def sketch(s: np.ndarray) -> bytes:
    """Counts by hash class, the number of classes being a power of two near half of the set's size."""
    bits = min(max(6, (max(len(s), 2) // 2 - 1).bit_length()), 13)
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() if counts.max() <= 255 else counts.astype("<u4").tobytes() + b"4"


def _counts(b: bytes) -> np.ndarray:
    return np.frombuffer(b[:-1], "<u4").astype(np.int64) if len(b) % 2 else np.frombuffer(b, np.uint8).astype(np.int64)


def most_shared(a: bytes, b: bytes) -> int:
    """An upper bound of what the sets of two sketches share."""
    x, y = _counts(a), _counts(b)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = x.reshape(len(y), -1).sum(1)
    return int(np.minimum(x, y).sum())


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - math.ceil(n * percent / 100) + 1 if n else 0


# ---- passes over the documents --------------------------------------------------------------------------------------


def _narrow(docs: DataFrame, seed: int = 0) -> DataFrame:
    """kind 0: doc_id, n, sid, sid2 and (once a partition) the sketch of a document. kind 1: a shingle frequent in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tokens, size = set(), [], 0
        counted = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, counts = np.unique(np.concatenate(tokens), return_counts=True) if tokens else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            k, inverse = np.unique(np.concatenate([counted[0], every]), return_inverse=True)
            n = np.zeros(len(k), np.int64)
            np.add.at(n, inverse, np.concatenate([counted[1], counts]))
            return k, n

        for batch in batches:
            n, sid, sid2, sk = [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist()):
                a, b = set_id(s, seed)
                new = (a, b) not in seen and len(s) > 0
                if new:
                    seen.add((a, b))
                    tokens.append(s)
                    size += len(s)
                n.append(len(s))
                sid.append(a)
                sid2.append(b)
                sk.append(sketch(s) if new else None)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(sid2, pa.int64()), pa.array(sk, pa.binary())], ["kind", "doc_id", "n", "sid", "sid2", "sketch"])
            if size > 1 << 21:  # what occurs once in so much goes, which keeps the table small
                counted = merged()
                counted = counted[0][counted[1] > 1], counted[1][counted[1] > 1]
                tokens, size = [], 0
        k, c = merged()
        often = c >= max(2, len(seen) // 2048)
        k, c = k[often].astype(np.int64), c[often]
        none = pa.nulls(len(k), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(k), np.int32)), none, pa.array(c), pa.array(k), none, pa.nulls(len(k), pa.binary())], ["kind", "doc_id", "n", "sid", "sid2", "sketch"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, "kind int, doc_id long, n long, sid long, sid2 long, sketch binary")


def _frequent(narrow: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, classes of frequency) of the most frequent shingles, ascending: whole classes, `most` shingles at most."""
    counted = materialize(narrow.where("kind = 1").groupBy("sid").agg(F.sum("n").alias("c")).select("sid", F.floor(F.log2("c")).cast("int").alias("r")))
    least, room = 64, most
    for r in counted.groupBy("r").count().orderBy(F.desc("r")).collect():  # a row for each power of two
        if r["count"] > room:
            break
        least, room = r.r, room - r["count"]
    top = counted.where(F.col("r") >= least).toArrow()
    t = top.column("sid").to_numpy().astype(np.uint64)
    order = np.argsort(t)
    return t[order], top.column("r").to_numpy().astype(np.int64)[order] + 1


def _index(docs: DataFrame, held: Broadcast, seed: int = 0) -> DataFrame:
    """token, sid: the first shingles of every set in the common order. held: the result of `_frequent`, of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = held.value
        seen = set()
        for batch in batches:
            tokens, sids, lengths, sizes = [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist()):
                a, _ = set_id(s, seed)
                if a in seen or not len(s):
                    continue
                seen.add(a)
                p = prefix_length(len(s))
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    r = np.where(often[at] == s, rank[at], 0)
                    s = s[np.argsort(r, kind="stable")[:p]] if r.any() else s[:p]
                else:
                    s = s[:p]
                tokens.append(s)
                sids.append(a)
                lengths.append(p)
                sizes.append((a, p))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(np.repeat(np.array(sids, np.int64), lengths))], ["token", "sid"])

    return docs.select("text").mapInArrow(run, "token long, sid long")


def _buckets(index: DataFrame) -> DataFrame:
    """token, sid, pivot of every set in a bucket of at least two sets; the pivot is the smallest set id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token0, pivot0, last = None, None, None  # the bucket that goes on in the next batch
        lone = False  # whether only its pivot has come so far
        for batch in batches:
            t, s = batch.column("token").to_numpy(), batch.column("sid").to_numpy()
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
            if token0 is not None and len(t):
                new[0] = (t[0] != token0) or (s[0] != last)
            t, s = t[new], s[new]
            if not len(t):
                continue
            head = np.ones(len(t), bool)
            head[1:] = t[1:] != t[:-1]
            head[0] = t[0] != token0
            begin = np.flatnonzero(head)
            which = np.cumsum(head) - 1
            pivots = s[begin]
            pivot = np.where(which >= 0, pivots[np.maximum(which, 0)] if len(begin) else 0, pivot0 or 0)
            several = np.zeros(len(t), bool)
            several[~head] = True
            several[begin] = np.append(~head[1:], False)[begin]
            out_t, out_s, out_p = t[several], s[several], pivot[several]
            if lone and not head[0]:  # the pivot that the batch before ended with
                out_t, out_s, out_p = np.append(out_t, token0), np.append(out_s, pivot0), np.append(out_p, pivot0)
            token0, pivot0, last = t[-1], pivot[-1], s[-1]
            lone = bool(head[-1])
            if len(out_t):
                yield pa.RecordBatch.from_arrays([pa.array(out_t), pa.array(out_s), pa.array(out_p.astype(np.int64))], ["token", "sid", "pivot"])

    return index.repartition("token").sortWithinPartitions("token", "sid").mapInArrow(run, "token long, sid long, pivot long")


# ---- measuring ------------------------------------------------------------------------------------------------------


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb, low: pairs with a lower bound of their distance, from sizes and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            share = np.minimum(na, nb)
            possible = share * 100 >= percent * np.maximum(na, nb)
            ka, kb = batch.column("ka"), batch.column("kb")
            share = np.array([most_shared(ka[i].as_py(), kb[i].as_py()) if possible[i] else share[i] for i in range(len(na))], np.int64)
            low = 1 - share / np.maximum(na + nb - share, 1)
            maybe = share * (100 + percent) >= percent * (na + nb)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(low), pa.array(maybe)], ["a", "b", "low", "maybe"])

    j = pairs.join(nodes.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka")), "a")
    j = j.join(nodes.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb")), "b")
    return j.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a long, b long, low double, maybe boolean")


def _sets(docs: DataFrame, wanted: DataFrame, seed: int = 0) -> DataFrame:
    """sid, set (hashes) of the wanted sids, written; a map of fixed size keeps most others from being shuffled."""
    bit = F.pmod("sid", F.lit(MAP_BITS))  # ids are hashes
    rows = wanted.select((bit / 32768).cast("int").alias("row"), (bit % 32768).cast("long").alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()  # 2048 rows of 4 KB at most
    bitmap = np.zeros(MAP_BITS // 8, np.uint8)
    for row, bits in zip(rows.column("row").to_pylist(), rows.column("bits"), strict=True):
        bitmap[row * 4096 : (row + 1) * 4096] = np.frombuffer(bits.as_buffer(), np.uint8)
    del rows
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = held.value, set()
        for batch in batches:
            sids, sets = [], []
            for s in shingle_sets(batch.column("text").to_pylist()):
                a, _ = set_id(s, seed)
                at = a % MAP_BITS
                if (bits[at >> 3] >> (at & 7)) & 1 and a not in seen and len(s):
                    seen.add(a)
                    sids.append(a)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, pa.binary())], ["sid", "set"])

    out = materialize(docs.select("text").mapInArrow(run, "sid long, set binary").join(wanted, "sid", "left_semi").dropDuplicates(["sid"]))
    held.destroy()  # what follows reads the written table
    return out


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()


def _measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, distance, linked of those pairs (a, b) of which `sets` has both, counted exactly."""
    pairs = pairs.select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, linked = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                union = len(p) + len(q) - both
                d.append(1 - both / union)
                linked.append(100 * both >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(d, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "distance", "linked"])

    j = pairs.join(sets.select(F.col("sid").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("set").alias("y")), "b")
    return j.mapInArrow(run, "a long, b long, distance double, linked boolean")


def _folded(sketches: list[bytes], bits: int) -> np.ndarray:
    """Sketches as rows of 2^bits counts."""
    return np.stack([_counts(x).reshape(1 << bits, -1).sum(1) for x in sketches]).astype(np.int32)


def bucket_pairs(sid: np.ndarray, n: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, sketches: list[bytes], reach: float, percent: int, best: int = 0, side: np.ndarray | None = None) -> tuple[list, list]:
    """Pairs (a, b) within a bucket, ascending in n, that components, sizes, triangle inequality and sketches leave.

    With `best`, for each set only those that seem nearest by their sketches. With `side`, only pairs of different sides.
    """
    bits = np.array([len(_counts(x)).bit_length() - 1 for x in sketches])
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    a, b = [], []
    for i in range(len(sid) - 1):
        end = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
        j = np.arange(i + 1, end)
        j = j[(label[j] != label[i]) & (low[j] - high[i] <= reach) & (low[i] - high[j] <= reach)]
        if side is not None:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        k = int(bits[i])  # the larger sets have as many classes at least
        if k not in tables:
            rows = np.flatnonzero(bits >= k)
            place = np.full(len(sid), -1)
            place[rows] = np.arange(len(rows))
            tables = {k: (_folded([sketches[r] for r in rows], k), place)}
        m, place = tables[k]
        share = np.minimum(m[place[i]], m[place[j]]).sum(1)
        ok = share * (100 + percent) >= percent * (n[i] + n[j])
        j, share = j[ok], share[ok]
        if best and len(j) > best:
            j = j[np.argsort(-share / (n[i] + n[j]), kind="stable")[:best]]
        if len(j):
            a.append(np.minimum(sid[i], sid[j]))
            b.append(np.maximum(sid[i], sid[j]))
    return a, b


def _grouped(rows: DataFrame, most: int | None = None) -> DataFrame:
    """rows (token, sid, pivot, ...) with group, part and side: what is compared together, in groups of about `most` rows.

    Buckets of one pivot share a part, so that a pair, which meets in many of its buckets, is passed on once. A pivot with
    more rows has several parts (parts, slot); its sets carry their smallest tokens there. A bucket with more rows is cut
    into blocks by its sets' hashes, and each pair of blocks is a group, in which side tells the blocks apart; side is -1
    within a block. No pair of a bucket is lost.
    """
    most = most or GROUP_ROWS
    many = lambda c, n: materialize(rows.groupBy(c).agg(F.ceil(F.count("*") / most).cast("int").alias(n)).where(F.col(n) > 1))
    hot = many("pivot", "parts")
    lists = rows.join(hot, "pivot", "left_semi").groupBy("sid", "pivot").agg(F.slice(F.sort_array(F.collect_list("token")), 1, CARRIED).alias("carried"))
    r = rows.join(hot, "pivot", "left").join(many("token", "blocks"), "token", "left").join(materialize(lists), ["sid", "pivot"], "left")
    r = r.withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long")).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    r = r.withColumn("slot", F.pmod("token", "parts")).withColumn("block", F.pmod(F.xxhash64(F.lit(5), "sid"), "blocks").cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = F.least("block", "other"), F.greatest("block", "other")
    r = r.withColumns({"group": F.xxhash64("token", x, y), "part": F.xxhash64("pivot", "slot", x, y), "side": F.when(x == y, F.lit(-1)).otherwise(F.col("block")), "carried": F.coalesce("carried", F.array().cast("array<long>"))})
    return r.drop("blocks", "block", "other")


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of at most CARRIED longs as rows, filled up with _NONE."""
    c = column.combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    at, values = c.offsets.to_numpy(), c.values.to_numpy()
    n = np.diff(at)
    out = np.full((len(n), CARRIED), _NONE)
    out[np.repeat(np.arange(len(n)), n), np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], n)] = values[at[0] : at[-1]]
    return out


def here(x: np.ndarray, y: np.ndarray, parts: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether this part passes a pair on: it has the least token that both sets carry, or they carry none in common."""
    both = np.sort(np.concatenate([x, y], 1), 1)
    same = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)
    token = both[np.arange(len(both)), same.argmax(1)]
    return ~same.any(1) | (token % parts == slot)


def _meetings(rows: DataFrame, reach: float, percent: int, best: int = 0) -> DataFrame:
    """a < b of sets in one bucket, in different components, that sizes, sketches and the triangle inequality leave.

    rows: group, part, side, parts, slot and carried of `_grouped`, sid, n, sketch, label, low, high (the distance from the bucket's pivot, or
    bounds of it). The groups of a part come to one task, and of a pivot's parts one passes a pair on.
    """
    most = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        seen.clear()
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            token = t.column("group").to_numpy()
            cut = len(token) - int(np.argmax(token[::-1] != token[-1])) if len(token) and (token != token[-1]).any() else 0
            rest = t.slice(cut)
            yield from found(t.slice(0, cut))
        if rest is not None:
            yield from found(rest)

    seen: set[int] = set()

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        token = t.column("group").to_numpy()
        if not len(token):
            return
        edges = np.concatenate([[0], np.flatnonzero(np.diff(token)) + 1, [len(token)]])
        sid, n, label, low, high, side = (t.column(c).to_numpy() for c in ("sid", "n", "label", "low", "high", "side"))
        parts, slot = t.column("parts").to_numpy(), t.column("slot").to_numpy()
        sketches = t.column("sketch")
        a, b, rows_a, rows_b = [], [], [], []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi - lo > 1 and not (label[lo:hi] == label[lo]).all():
                x, y = bucket_pairs(sid[lo:hi], n[lo:hi], label[lo:hi], low[lo:hi], high[lo:hi], sketches.slice(lo, hi - lo).to_pylist(), reach, percent, best, side[lo:hi] if side[lo] >= 0 else None)
                if x:
                    x, y = np.concatenate(x), np.concatenate(y)
                    order = lo + np.argsort(sid[lo:hi])
                    rows_a.append(order[np.searchsorted(sid[order], x)])
                    rows_b.append(order[np.searchsorted(sid[order], y)])
                    a.append(x)
                    b.append(y)
        if a:
            pairs = np.stack([np.concatenate(a), np.concatenate(b)])
            keys = mix64(mix64(mix64(pairs[0].astype(np.uint64)) + pairs[1].astype(np.uint64)) + t.column("part").to_numpy()[np.concatenate(rows_a)].astype(np.uint64)).tolist()
            new = [k not in seen and not seen.add(k) for k in keys]
            new = np.flatnonzero(new)
            pairs, x, y = pairs[:, new], np.concatenate(rows_a)[new], np.concatenate(rows_b)[new]
            split = np.flatnonzero(parts[x] > 1)
            if len(split):
                lists, stays = _lists(t.column("carried")), np.ones(len(new), bool)
                for k in range(0, len(split), 1 << 14):
                    i = split[k : k + (1 << 14)]
                    stays[i] = here(lists[x[i]], lists[y[i]], parts[x[i]], slot[x[i]])
                pairs = pairs[:, stays]
            if len(seen) > most:  # later repetitions pass then, and go in the distinct below
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    r = rows.repartition("part").sortWithinPartitions("part", "group", "n")
    return r.mapInArrow(run, "a long, b long").distinct()


def join(docs: DataFrame, percent: int = PERCENT, frequent: int = FREQUENT, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid of every row of `docs` (doc_id, text); node, label of the sets that have links)."""
    small_batches(docs.sparkSession)
    narrow = materialize(_narrow(docs, seed))
    rows = narrow.where("kind = 0").select("doc_id", "n", "sid")
    several = rows.sparkSession.createDataFrame([], "sid long") if seed > 8 else narrow.where("kind = 0").groupBy("sid").agg(F.min("sid2").alias("x"), F.max("sid2").alias("y")).where("x <> y").select("sid")
    if not several.isEmpty():  # two sets have the same id: other ids
        return join(docs, percent, frequent, seed + 1)
    nodes = materialize(narrow.where("kind = 0 AND sketch IS NOT NULL").select("sid", "n", "sketch").dropDuplicates(["sid"]))
    held = docs.sparkSession.sparkContext.broadcast(_frequent(narrow, frequent))
    buckets = materialize(_buckets(_index(docs, held, seed)))
    held.destroy()
    # more pivots for each bucket: a near copy that one misses is likely to lie near another, and to need no meetings then
    pivots = [F.min_by("sid", F.xxhash64(F.lit(k), "sid")).alias(f"p{k}") for k in range(PIVOTS - 1)]
    others = buckets.join(buckets.groupBy("token").agg(*pivots), "token").select("sid", F.explode(F.array("pivot", *[f"p{k}" for k in range(PIVOTS - 1)])).alias("p"))
    near = others.where("sid <> p").select(F.least("sid", "p").alias("a"), F.greatest("sid", "p").alias("b")).distinct()
    bounds = materialize(_bounded(near, nodes, percent))
    sets = _sets(docs, materialize(_ids(bounds.where("maybe"))), seed)
    measured = materialize(_measured(bounds.where("maybe"), sets, percent))
    labels = materialize(components(measured.where("linked")))
    # what is known of the distance of a set from its bucket's pivot
    # (the pivot, the smallest id of its bucket, is `a` in every pair with another set of the bucket)
    known = bounds.join(measured.select("a", "b", "distance"), ["a", "b"], "left")
    known = materialize(known.select(F.col("a").alias("pivot"), F.col("b").alias("sid"), F.coalesce("distance", "low").alias("low"), F.coalesce("distance", F.lit(1.0)).alias("high")))
    reach = 1 - percent / 100 + 1e-9

    def open_rows() -> DataFrame:
        """Rows of buckets whose sets are not all of one component, and not just a pivot and another set: those have met."""
        labelled = materialize(buckets.join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid")))
        other = F.col("sid") != F.col("pivot")
        hashed = lambda h: F.sum(F.when(other, h.cast("decimal(38,0)")))
        by_bucket = labelled.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m"), hashed(F.xxhash64("sid")).alias("u"), hashed(F.xxhash64(F.lit(1), "sid")).alias("v"))
        # of buckets with the very same sets one is enough
        chosen = materialize(by_bucket.where("x <> y AND m > 2").groupBy("m", "u", "v").agg(F.min("token").alias("token")).select("token"))
        out = labelled.where(other).join(chosen, "token", "left_semi")
        out = materialize(out.select("token", "sid", "pivot", "label").join(known, ["sid", "pivot"]))
        return _grouped(out).join(nodes.select("sid", "n", "sketch"), "sid").select("group", "part", "side", "parts", "slot", "carried", "sid", "n", "sketch", "label", "low", "high")

    def joined(links: DataFrame) -> DataFrame:
        return materialize(components(links.select("a", "b").unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))))

    # first the likeliest partners of each set, as far as their shingles are at hand: most components grow together
    likely = materialize(_measured(_meetings(open_rows(), reach, percent, NEAREST), sets, percent)).where("linked")
    if not likely.isEmpty():
        labels = joined(likely)
    # then all that is left; meetings have gone by sizes and sketches, so what remains is counted
    rest = materialize(_meetings(open_rows(), reach, percent))
    if not rest.isEmpty():
        new = materialize(_measured(rest, _sets(docs, materialize(_ids(rest)), seed), percent)).where("linked")
        if not new.isEmpty():
            labels = joined(new)
    return rows, labels


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of every row of `docs` (doc_id, text)."""
    rows, labels = join(docs, percent)
    r = rows.join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left").select("doc_id", "n", F.coalesce("label", "sid").alias("label"))
    r = materialize(r)
    low = r.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("low"))
    j = r.join(low, "label", "left")
    return j.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))


ship(__name__)
