"""Keep a snapshot table current from a stream of Delta rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.operators import versioning
from termloom.sources.rf2 import BOM, typed
from termloom.sources.schemas import Record


def read_delta_stream(spark: SparkSession, root: str, record: Record, pattern: str = "*Delta*.txt") -> DataFrame:
    """Typed rows of the files of one record type as they arrive; `arrival` orders them by file, then line hash."""
    raw = spark.readStream.schema("value string").option("lineSep", "\n").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").format("text").load(root)
    line = F.regexp_replace("value", "\r$", "")
    rows = raw.select(F.col("_metadata.file_path").alias("path"), line.alias("raw")).filter((F.col("raw") != "") & (F.regexp_replace("raw", f"^{BOM}", "") != "\t".join(record.header)))
    parts = F.split("raw", "\t", -1)
    return rows.select(*[typed(F.get(parts, F.lit(i)), kind).alias(name) for i, (name, kind) in enumerate(record.fields)], F.xxhash64("path", "raw").alias("arrival"))


def upsert(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The latest row of each id among the state and a batch; on equal times the state's row stays."""
    new = batch.withColumn("g_age", F.lit(1))
    both = new if state is None else state.withColumn("g_age", F.lit(0)).unionByName(new)
    order = F.struct(F.col("g_age").alias("age"), "arrival")
    return versioning.latest(both.withColumn("g_order", F.row_number().over(_by_id(order))), arrival="g_order").drop("g_age", "g_order")


def _by_id(order):
    from pyspark.sql import Window

    return Window.partitionBy("id", "effectiveTime").orderBy(order)


def maintain(stream: DataFrame, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that merges each micro-batch into `table` (a folder). A batch writes version <table>/<batch id>
    and the next reads the one before, so a batch that runs again writes the same."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        state = spark.read.parquet(f"{table}/{number - 1}") if number else None
        upsert(state, batch).write.mode("overwrite").parquet(f"{table}/{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
