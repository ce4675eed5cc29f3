"""Exact dedup: binary-fuse filters per immutable snapshot screen the digests of each new batch.

`dedup` takes the rows in batches. Copies inside one batch are grouped by digest on their own. Each batch becomes an immutable
snapshot with static 3-wise binary-fuse filters, built once and stored (one per digest bucket, so that a filter has a bounded number
of keys). The digests of a later batch are screened by the filters of every earlier snapshot: what no filter lets pass is new, and
goes no further; positives join the exact digests of the snapshots that let them pass, and only groups found so, or inside a batch,
have more than one row. The bytes of the normalised texts of such groups are compared; rows whose bytes differ from those of their
digest's representative form groups of their own, keyed by the text itself.

Groups of any size are dealt over several tasks: partial aggregates come first, and joins of rows with their group are salted.
Nulls: a null text counts as empty, so null and empty or blank texts are equal. A null doc_id comes last among ties.
Repeated rows: one of them stays. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, hash_map, marked, materialize, mix64, salted_join, ship

#: Keys of one filter at most, on average: bounds a filter to about 1.2 bytes times as much.
KEYS_PER_FILTER = 250_000
#: Rows of a group from which on its joins are dealt over several tasks.
HOT = 256


# ---- the filter, in numpy -------------------------------------------------------------------------------------------


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots, in consecutive segments, and the one-byte fingerprint of each key."""
    h = mix64(keys ^ np.uint64(seed))
    g = mix64(h + np.uint64(0x9E3779B97F4A7C15))
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    at = [(first + np.uint64(i)) * np.uint64(segment) + ((g >> np.uint64(20 * i)) & mask) for i in range(3)]
    return np.stack(at).astype(np.int64), ((h ^ g) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, slots a segment, segments, fingerprints) of distinct uint64 keys: no key is ever missed."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(len(keys), 2)
    segment = min(1 << max(2, int(math.floor(math.log(n) / math.log(3.33) + 2.25))), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    for attempt in range(200):
        segments = max(1, math.ceil(n * factor / segment) - 2)
        seed = int(mix64(np.array([attempt + 1], np.uint64))[0])
        at, prints = _slots(keys, seed, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # the xor of the numbers of the keys that are still in a slot
        numbers = np.arange(len(keys), dtype=np.int64)
        for row in at:
            np.bitwise_xor.at(held, row, numbers)
        layers, left = [], len(keys)
        single = np.flatnonzero(count == 1)
        while len(single):
            own = held[single]
            own, first = np.unique(own, return_index=True)
            layers.append((own, single[first]))
            left -= len(own)
            touched = at[:, own]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(held, row, own)
            single = np.unique(touched)
            single = single[count[single] == 1]
        if left == 0:
            table = np.zeros(size, np.uint8)
            for own, slot in reversed(layers):  # the slots of a layer belong to one key each
                table[slot] = 0
                table[slot] = prints[own] ^ table[at[0, own]] ^ table[at[1, own]] ^ table[at[2, own]]
            return seed, segment, segments, table.tobytes()
        factor *= 1.02
    raise ValueError("no binary-fuse filter found; are the keys distinct?")


def probe_filter(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    """True for every key of the filter, and for about one in 256 others."""
    at, prints = _slots(keys.astype(np.uint64), seed, segment, segments)
    t = np.frombuffer(table, np.uint8)
    return (t[at[0]] ^ t[at[1]] ^ t[at[2]]) == prints


# ---- Spark ----------------------------------------------------------------------------------------------------------


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def _key(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d[:8]) for d in digests), np.uint64)


def filters(entries: DataFrame) -> DataFrame:
    """batch, bucket and a filter for each batch and bucket of `entries` (batch, bucket, digest)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, table = build_filter(_key(pdf.digest))
        return pd.DataFrame({"batch": [pdf.batch.iloc[0]], "bucket": [pdf.bucket.iloc[0]], "seed": [np.uint64(seed).astype(np.int64)], "segment": [segment], "segments": [segments], "table": [table]})

    return entries.select("batch", "bucket", "digest").groupBy("batch", "bucket").applyInPandas(build, "batch int, bucket long, seed long, segment long, segments long, table binary")


def screen(incoming: DataFrame, built: DataFrame) -> DataFrame:
    """digest, snapshot of the rows of `incoming` (batch, bucket, digest) that the filter of an earlier batch lets pass."""

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        keys, batch = _key(left.digest), left.batch.to_numpy()
        for f in right.itertuples():
            later = batch > f.batch
            if later.any():
                hit = probe_filter(keys[later], int(np.int64(f.seed).astype(np.uint64)), int(f.segment), int(f.segments), f.table)
                out.append(pd.DataFrame({"digest": left.digest[later][hit], "snapshot": np.full(int(hit.sum()), f.batch, np.int32)}))
        return pd.concat(out) if out else pd.DataFrame({"digest": [], "snapshot": np.zeros(0, np.int32)})

    return incoming.select("batch", "bucket", "digest").groupBy("bucket").cogroup(built.groupBy("bucket")).applyInPandas(probe, "digest binary, snapshot int")


def _best() -> Column:
    """Which of equal texts stays: most code points, then the smallest doc_id (null last), then any."""
    return F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("rid").alias("r"))


def dedup(docs: DataFrame, batch: Column, batches: int, keys_per_filter: int = KEYS_PER_FILTER) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, batch.

    `batch`: the number of the batch in which a row arrives, from 0 to `batches` - 1.
    """
    rows = docs.select("doc_id", batch.cast("int").alias("batch"), F.length(F.coalesce("text", F.lit(""))).alias("n_points"), normalised(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", "batch", "n_points", _digest(F.col("norm")).alias("digest"), "norm")
    base = materialize(rows.drop("norm").withColumn("rid", F.monotonically_increasing_id()))
    # inside a batch
    entries = base.groupBy("batch", "digest").agg(F.count("*").alias("n"), F.min(_best()).alias("best"))
    n_buckets = max(8, math.ceil(base.count() / keys_per_filter))
    entries = materialize(entries.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(n_buckets))))
    # against the snapshots: filters first, then the exact digests of the snapshot whose filter let one pass
    built = materialize(filters(entries.where(F.col("batch") < batches - 1)))
    passed = screen(entries.where("batch > 0"), built).withColumnRenamed("snapshot", "batch")
    matched = materialize(passed.distinct().join(entries.select("digest", "batch"), ["digest", "batch"], "left_semi").select("digest").distinct())
    # one row for each group of several rows, under every batch that it has rows in
    many = entries.join(matched, "digest", "left_semi").groupBy("digest").agg(F.sum("n").alias("n"), F.min("best").alias("best"), F.collect_list("batch").alias("batches"))
    alone = entries.join(matched, "digest", "left_anti").where("n > 1").select("digest", "n", "best", F.array("batch").alias("batches"))
    groups = materialize(many.unionByName(alone).select(F.explode("batches").alias("batch"), "digest", "n", "best").withColumn("gid", F.xxhash64("digest", "batch")))
    bits = hash_map(groups.select(F.col("gid").alias("h")).distinct())
    split = marked(base.withColumn("gid", F.xxhash64("digest", "batch")).withColumn("h", F.col("gid")), bits).drop("h")
    hot = groups.where(f"n > {HOT}").select(F.xxhash64("gid").alias("h"))
    found = salted_join(split.where("in_map").drop("in_map"), groups.select("gid", F.col("digest").alias("g_digest"), "n", "best"), "gid", hot, "left")
    found = materialize(found.withColumn("n", F.when(F.col("g_digest") == F.col("digest"), F.col("n"))))  # gid names a digest but for chance
    other = _different(rows, found, hot)
    if not other.isEmpty():
        found = _regrouped(found, other)
    several = found.where("n IS NOT NULL").select("doc_id", "batch", "digest", F.col("best.i").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("best.r")).alias("kept"))
    one = split.where("NOT in_map").select("doc_id", "batch", "digest").unionByName(found.where("n IS NULL").select("doc_id", "batch", "digest"))
    every = several.unionByName(one.select("*", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")))
    return every.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "batch")


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _different(rows: DataFrame, found: DataFrame, hot: DataFrame) -> DataFrame:
    """digest, doc_id, n_points, sub (the text): rows whose bytes differ from those of their group's representative.

    Only the texts of groups of several rows come here; the representative's text goes to each task that has some of its rows.
    """
    held = found.where("n IS NOT NULL")
    # a group's digest and the row that represents it, once for all batches
    keys = materialize(held.groupBy("digest").agg(F.first("best").alias("best"), F.max("n").alias("n")).withColumn("h", F.xxhash64("digest")))
    some = marked(rows.withColumn("h", F.xxhash64("digest")), hash_map(keys.select("h"))).where("in_map").drop("in_map", "h")
    texts = some.join(keys.select("digest", "best").hint("shuffle_hash"), "digest").where(F.col("doc_id").eqNullSafe(F.col("best.i")) & (F.col("n_points") == -F.col("best.p")))
    texts = materialize(texts.select("digest", F.col("norm").alias("f_norm")).dropDuplicates(["digest"]), "lz4")
    j = salted_join(some, texts, "digest", keys.where(f"n > {HOT}").select("h"))
    return materialize(j.where(F.col("norm") != F.col("f_norm")).select("digest", "doc_id", "n_points", F.col("norm").alias("sub")).distinct())


def _regrouped(found: DataFrame, other: DataFrame) -> DataFrame:
    """Equal digests of different bytes: the text itself tells the groups of these digests apart."""
    bad = other.select("digest").distinct()
    rest = found.join(bad, "digest", "left_anti")
    b = found.join(bad, "digest", "left_semi").drop("n", "best", "g_digest")
    o = other.select(F.col("digest").alias("o_digest"), F.col("doc_id").alias("o_id"), F.col("n_points").alias("o_points"), "sub")
    b = b.join(o, (b.digest == o.o_digest) & b.doc_id.eqNullSafe(o.o_id) & (b.n_points == o.o_points), "left").drop("o_digest", "o_id", "o_points")
    b = b.withColumn("sub", F.coalesce("sub", F.lit("")))
    g = b.groupBy("digest", "sub").agg(F.count("*").alias("n"), F.min(_best()).alias("best"))
    return rest.select("doc_id", "batch", "digest", "rid", "n", "best").unionByName(b.join(g, ["digest", "sub"]).select("doc_id", "batch", "digest", "rid", "n", "best"))


ship(__name__)
