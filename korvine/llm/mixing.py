"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash. Tokens are summed by source and by the leading bits of the hash; the running sum of
that histogram shows in which bucket a source's budget runs out. Only the documents of this boundary bucket are summed
again, by the next bits, and so on (thresholds are nested); at the last level documents of one hash share what is left.
A filter on the hash then selects documents: nothing is sorted by document and no group meets in one task.

A source above its size is taken whole as often as it fits, and the hash decides on the rest.
Nulls: a null text has size 0; null sources form one source, ordered last; a null doc_id is hashed as empty.
Repeated rows have equal hashes and share what is left. An empty table, or one without words, takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import NOT_SPACE, materialize, ship

LEVELS, BITS = 5, 12
MOST = 3


def ranked(sources: DataFrame, order: list[Column]) -> DataFrame:
    """Numbers from 0 in the given order, without one task for all rows: a count per range, then a local rank."""
    parts = materialize(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("c"))  # a row for each range
    before = sizes.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
    local = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("local", local).join(before, "part").select(*sources.columns, (F.col("before") + F.col("local")).alias("rank"))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds weight (1, 2, 3 by rank) and target: shares of the sum, at most `most` x size.

    Who is above the level of the free sources stays above as the level rises, so each round needs the last level only: one job
    for a round, and a round for each time that the level rises.
    """
    by_code_point = [F.col("source").isNull().asc(), F.col("source").cast("binary").asc()]
    s = materialize(ranked(sizes, by_code_point).select("source", "source_size", (F.col("rank") % 3 + 1).alias("weight")))
    above, held = F.lit(False), None
    while True:
        one = s.agg(
            F.sum("source_size"), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(~above, 1)), F.sum(F.when(above, most * F.col("source_size")))
        ).first()  # four numbers
        total, weights, free, taken = one[0] or 0, one[1] or 0, one[2], one[3] or 0
        if free == held or not free:
            break
        held = free
        above = F.lit(total - taken) * F.col("weight") > most * F.col("source_size") * F.lit(weights)
    share = (F.lit(total - taken) * F.col("weight")).cast("double") / F.lit(weights or 1).cast("double")
    return s.withColumn("target", F.when(above, (most * F.col("source_size")).cast("double")).otherwise(share))


def _hash() -> Column:
    """A 60-bit hash of doc_id and text."""
    h = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    return F.conv(F.substring(h, 1, LEVELS * BITS // 4), 16, 10).cast("long")


def _size() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"{NOT_SPACE}+")).cast("long")


def _key(df: DataFrame) -> Column:
    # joins need a null source to be a value, and no other source's
    return F.when(df["source"].isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), df["source"].cast("string")))


def thresholds(base: DataFrame, most: int = MOST) -> DataFrame:
    """k (source), source_size, target, copies, threshold, rest, edge: how to mix `base` (source, size, hash)."""
    t = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    t = t.withColumn("budget", F.round("target").cast("long"))
    t = t.withColumn("copies", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
    t = materialize(t.withColumn("left", F.col("budget") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")))
    state = t.select(_key(t).alias("k"), "left", "prefix")
    rows = base.select(_key(base).alias("k"), "size", "hash")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.join(state, "k").where(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        hist = inside.select("k", "left", F.shiftright("hash", shift).alias("bucket"), "size").groupBy("k", "left", "bucket").agg(F.sum("size").alias("n"))
        hist = hist.withColumn("upto", F.sum("n").over(Window.partitionBy("k").orderBy("bucket")))
        edge = hist.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left")))
        state = materialize(edge.select("k", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.col("bucket").alias("prefix"), F.col("n").alias("edge")))
        if level < LEVELS - 1:
            state = state.drop("edge")
    state = state.select("k", F.col("left").alias("rest"), F.col("prefix").alias("threshold"), "edge")
    return materialize(t.select(_key(t).alias("k"), "source_size", "target", "copies").join(state, "k", "left"))


def _part() -> Column:
    """Words of the last, incomplete pass: the whole document, none, or at the threshold its share of what is left."""
    return F.when(F.col("hash") < F.col("threshold"), F.col("size")).when(F.col("hash") == F.col("threshold"), F.expr("size * rest div edge")).otherwise(F.lit(0))


def mix(docs: DataFrame, most: int = MOST) -> DataFrame:
    """Per row of `docs` (doc_id, text, source): doc_id, source, size, source_size, target, taken, hash, copies, part.

    `taken` words: `copies` whole passes, and `part` words of the next one.
    """
    base = materialize(docs.select("doc_id", "source", _size().alias("size"), _hash().alias("hash")))
    out = base.withColumn("k", _key(base)).join(thresholds(base, most), "k").withColumn("part", _part())
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"), "hash", "copies", "part")


def mixed(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, all columns; a document taken in part counts from half on."""
    names = docs.columns
    plan = thresholds(materialize(docs.select("source", _size().alias("size"), _hash().alias("hash"))), most)
    own = {c: f"_{c}_of_plan" for c in plan.columns}  # the rows keep their columns in a struct, so that no name clashes
    d = docs.select(F.struct(*names).alias("_row"), _hash().alias("_h_of_row"), _size().alias("_n_of_row"), _key(docs).alias("_k_of_row"))
    j = d.join(plan.withColumnsRenamed(own), F.col("_k_of_row") == F.col(own["k"]))
    part = F.expr("CASE WHEN _h_of_row < _threshold_of_plan THEN _n_of_row WHEN _h_of_row = _threshold_of_plan THEN _n_of_row * _rest_of_plan div _edge_of_plan ELSE 0 END")
    times = (F.col(own["copies"]) + F.when((part > 0) & (2 * part >= F.col("_n_of_row")), 1).otherwise(0)).cast("int")
    taken = j.select("_row", times.alias("_times")).where("_times > 0")
    return taken.select("_row", F.explode(F.expr("sequence(1, _times)")).alias("_pass")).select(*[F.col("_row")[c].alias(c) for c in names])


ship(__name__)
