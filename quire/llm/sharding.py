"""Contiguous shards of near-equal bytes, by DataFrame functions alone.

Documents are laid out in one global order. Range partitions of that order are
summed first; the exclusive prefix sums of the few partition totals, added to
the running sums inside each partition, give every document its byte offset in
the corpus. Cutting the offsets at equal targets gives the shards. No partition
sees more than its own range, and only one row per partition goes through a
single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quire.llm.common import durable, table

N_SHARDS = 40
OVERHEAD_BYTES = 16


def _before(sums: DataFrame, key: str, **named) -> DataFrame:
    """Exclusive prefix sums over a table of one row per range partition or shard."""
    order = W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return sums.select(key, *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(n) for n, c in named.items()])


def byte_shards(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD_BYTES) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row of docs.

    size is the UTF-8 bytes of the text plus overhead. The order is that of (hash of the text, id): it mixes the
    corpus, and equal texts lie side by side. A document goes where the middle of its bytes falls between the
    n_shards equal targets, so a shard is off its target by half of its first and last document at most; slot
    counts a shard's documents from 0 in the order.
    - A null text counts as empty. Rows that repeat are laid out each, side by side. Null ids come first.
    - With fewer documents than shards, or one longer than a target, some shards are empty. No rows, no shards.
    Columns of docs other than the id and the text are not looked at. An id column of any name is returned under it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        F.xxhash64(text).alias("_hash"),
    )
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_shards)
    # Written once: the sampled ranges of a second run, after an executor is lost, could be others.
    ranged = durable(rows.repartitionByRange(parts, "_hash", "_id").withColumn("_part", F.spark_partition_id()))
    in_part = W.partitionBy("_part").orderBy("_hash", "_id", "_size").rowsBetween(W.unboundedPreceding, 0)
    totals = ranged.groupBy("_part").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n"))
    starts = _before(totals, "_part", bytes_before="bytes", rows_before="n")
    total = totals.agg(F.sum("bytes").alias("_total"))
    placed = (
        ranged.select("*", F.sum("_size").over(in_part).alias("_run"), F.row_number().over(in_part).alias("_nth"))
        .join(F.broadcast(starts), "_part")  # a row for each of `parts` partitions
        .crossJoin(F.broadcast(total))  # one row
        .select(
            "_id", "_size", "_crc",
            (F.col("rows_before") + F.col("_nth") - 1).alias("_rank"),
            # decimal: twice the corpus' bytes times the shards may pass 64 bits
            F.least(
                F.lit(n_shards - 1),
                F.floor(
                    ((F.col("bytes_before") + F.col("_run")) * 2 - F.col("_size")).cast(T.DecimalType(28, 0))
                    * n_shards / (F.col("_total") * 2)
                ).cast("int"),
            ).alias("shard"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # n_shards rows
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        "shard",
        (F.col("_rank") - F.col("_first")).cast("long").alias("slot"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
