"""A folder that parsed documents arrive in, as a table of their sections that follows it.

Each micro-batch is assembled as a batch is and written under its own number, so that a batch that runs again after
a failure replaces itself. A document that arrives anew takes the place of its earlier sections when the table is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from quire.operators import store
from quire.schemas import DOCUMENT
from quire.sources.documents import run_statistics


def arriving_documents(spark: SparkSession, folder: str, files_a_batch: int = 1_000) -> DataFrame:
    """The JSON files that come to a folder, as read_documents has them; each is read once."""
    rows = spark.readStream.schema(DOCUMENT).option("multiLine", True).option("maxFilesPerTrigger", files_a_batch).json(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:_structured)?\.json$", 1)
    return rows.select(name.alias("doc_id"), F.col("_metadata.file_modification_time").alias("arrived"), *DOCUMENT.fieldNames())


def _latest(rows: DataFrame) -> DataFrame:
    """Of documents that come more than once the last one; of equal times any one."""
    order = W.partitionBy("doc_id").orderBy(F.col("arrived").desc())
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def follow_sections(documents: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes the section texts of arriving documents under folder. once: what is there now, then the query ends."""
    def write(batch: DataFrame, number: int) -> None:
        docs = _latest(batch).persist()
        texts = store.section_texts(docs).join(docs.select("doc_id", "arrived"), "doc_id")
        texts.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        docs.unpersist()

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def followed_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of each document's last arrival."""
    rows = spark.read.parquet(folder)
    last = rows.groupBy("doc_id").agg(F.max(F.struct("arrived", "batch")).alias("last"))
    met = rows.join(last, "doc_id").where((F.col("arrived") == F.col("last.arrived")) & (F.col("batch") == F.col("last.batch")))
    return met.drop("last", "batch", "arrived")


def windowed_runs(runs: DataFrame, at: str = "at", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Statistics of arriving runs (at, query_type, has_data, total_ms) by time window and query type; runs that are
    later than `late` are left out, so that the state of past windows can go."""
    timed = runs.withWatermark(at, late).withColumn("window", F.window(at, window))
    return run_statistics(timed, ["window", "query_type"])
