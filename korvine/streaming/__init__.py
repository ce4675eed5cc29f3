"""The column expressions of the scanner under Structured Streaming: functions arrive as files, scores leave as files.

Nothing here keeps state: a function's features and risk are its own. The checkpoint of the query takes the place of resumable steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dialect import SPARK
from ..operators import rules

SCHEMA = "id long, func string, target boolean, project string, split string"


def read_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """JSON lines of functions as they arrive, `files` of them a batch at most."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(folder)


def scored(functions: DataFrame) -> DataFrame:
    """id, the counting features and the risk of each row, of a stream or a table."""
    d = functions.withColumn("code", F.coalesce("func", F.lit("")))
    d = d.select("id", *[F.expr(e).alias(c) for c, e in rules.counts(SPARK).items()]).withColumn("raw_tenths", F.expr(rules.raw_risk()))
    return d.withColumn("risk", F.expr(rules.risk_thousandths("raw_tenths", SPARK))).withColumn("risk_level", F.expr(rules.level("risk")))


def write_scores(functions: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Scores appended as Parquet; with `once` what has arrived is worked off and the query ends."""
    w = scored(functions).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


def write_vectors(functions: DataFrame, table: dict[str, int], path: str, checkpoint: str) -> StreamingQuery:
    """Ids of each arriving function by a fixed vocabulary, a Parquet file a batch: what a buffer with a final flush does."""
    from ..operators import heuristics, places, vectors

    look = vectors.lookup(table)

    def batch(rows: DataFrame, number: int) -> None:
        d = rows.withColumn("clean", F.expr(heuristics.stripped(SPARK, "coalesce(func, '')")))
        d.select("id", look(places.serving_symbols("clean")).alias("ids")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return functions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
