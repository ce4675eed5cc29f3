"""What the operators of this subpackage share: written intermediate tables and worker-side code."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space of the contracts; words are maximal runs of anything else.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def ship(name: str) -> None:
    """Pickle functions of this module by value, so that executors need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where everything runs on one machine, as in tests, a
    temporary folder takes its place where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='korvine-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of whole texts be small, where the session has Spark's default: it bounds a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write `df` as Parquet to the shared folder and read it back.

    A lost executor then costs a reread and no recomputation, and Spark knows the size of what it reads,
    so that it broadcasts a side of a join only if that side is small.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/korvine-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column | str) -> Column:
    """The words of a text, as an array; null counts as no text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({NOT_SPACE}+)"), F.lit(1))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Rows of a map of hashes, 2^15 bits (4 KB) each: what is broadcast has this size at most.
MAP_ROWS = 2048


def _bit(c: str) -> tuple[Column, Column]:
    """(row, bit) of a hash in the map."""
    spread = F.pmod(F.xxhash64(c), F.lit(MAP_ROWS * 32768))
    return (F.shiftright(spread, 15)).cast("int"), (spread % 32768).cast("int")


def hash_map(hashes: DataFrame) -> DataFrame:
    """A bit map of the hashes in column h, of MAP_ROWS rows of 4 KB at most, whatever the number of hashes."""
    row, bit = _bit("h")
    return hashes.select(row.alias("row"), bit.cast("long").alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))


def marked(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Adds `in_map`: whether the bit of a row's h is set, as it is for the hashes of the map and some others."""
    row, bit = _bit("h")
    byte = F.conv(F.hex(F.expr("substring(bits, bit div 8 + 1, 1)")), 16, 10).cast("int")
    named = rows.withColumn("row", row).withColumn("bit", bit).join(F.broadcast(bits), "row", "left")  # MAP_ROWS rows at most
    return named.withColumn("in_map", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, bit % 8)")) != 0, F.lit(False))).drop("row", "bit", "bits")


#: Copies of a group's one row that a hot key's rows are dealt over.
SALTS = 64


def salted_join(rows: DataFrame, groups: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` joined with `groups` (one narrow row for each value of `key`), where some values have very many rows.

    hot: the xxhash64 (column h) of the values that may be hot; they go into a map of fixed size, and rows and groups that the map
    names are dealt over SALTS tasks, the groups in as many copies. Values that the map names by chance are dealt alike.
    """
    bits = hash_map(hot)
    r = marked(rows.withColumn("h", F.xxhash64(key)), bits)
    spread = F.when(F.col("in_map"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    r = r.withColumn("salt", spread).drop("h", "in_map")
    g = marked(groups.withColumn("h", F.xxhash64(key)), bits)
    g = g.withColumn("salt", F.explode(F.when(F.col("in_map"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop("h", "in_map")
    return r.join(g, [key, "salt"], how).drop("salt")


ship(__name__)
