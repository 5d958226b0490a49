"""Reading parsed documents, knowledge trees, run logs and readable documents; writing steps."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.operators.control import flatten_tree
from quire.schemas import DOCUMENT


def _with_id(rows: DataFrame) -> DataFrame:
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:_structured)?\.json$", 1)
    return rows.select(name.alias("doc_id"), *DOCUMENT.fieldNames())


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each JSON file, its name without ending as doc_id; many files are one table. Broken files have null columns."""
    return _with_id(spark.read.schema(DOCUMENT).option("multiLine", True).json(path))


def documents_of(spark: SparkSession, documents: dict[str, dict | str]) -> DataFrame:
    """The same of documents at hand, as dictionaries or JSON text."""
    rows = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in documents.items()]
    raw = spark.createDataFrame(rows, "doc_id string, raw string")
    return raw.select("doc_id", F.from_json("raw", DOCUMENT).alias("d")).select("doc_id", "d.*")


def empty_documents(spark: SparkSession) -> DataFrame:
    return documents_of(spark, {})


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def cached_documents(spark: SparkSession, folder: str, stem: str) -> tuple[DataFrame, str | None]:
    """<folder>/<stem>_structured.json, else <folder>/<stem>.json, else no document; and the path that was read."""
    for name in (f"{stem}_structured.json", f"{stem}.json"):
        if _exists(spark, path := f"{folder}/{name}"):
            return read_documents(spark, path), path
    return empty_documents(spark), None


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as they are (path, content), for a parser to be mapped over them; none comes with the library."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def knowledge(spark: SparkSession, trees: dict[str, dict]) -> DataFrame:
    """Knowledge trees by domain, flattened in their order: (domain, ord, path, key, value); value is null unless text."""
    rows = [(d, o, p, k, v if isinstance(v, str) else None) for d, tree in trees.items() for o, p, k, v in flatten_tree(tree)]
    return spark.createDataFrame(rows, "domain string, ord int, path string, key string, value string")


def read_trees(spark: SparkSession, folder: str) -> dict[str, dict]:
    """The knowledge files of a folder, each a small tree, by name."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("name"), "value")
    return {r["name"]: json.loads(r["value"]) for r in files.collect()}


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """(run, at, query, query_type, has_data, total_ms, total_s) of a run log: a header with a time starts a run."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"(?=QUERY DEBUG LOG)")).alias("run", "text"))
    get = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return whole.where(F.col("text").startswith("QUERY DEBUG LOG")).select(
        "run", F.try_to_timestamp(get(r"QUERY DEBUG LOG . ([0-9: -]+[0-9])")).alias("at"), get(r"Query: ([^\n]*)").alias("query"),
        get(r"query_type: (\S+)").alias("query_type"), (F.regexp_extract("text", r"data keys: (\S+)", 1) != "None").alias("has_data"),
        get(r"total_ms: ([0-9]+)").cast("long").alias("total_ms"), get(r"TOTAL TIME: ([0-9.]+)s").cast("double").alias("total_s"),
    )


def run_statistics(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs, those with data, and the times of those: least, median, mean, most."""
    good = F.when(F.col("has_data"), F.col("total_ms"))
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"), F.count_if("has_data").alias("with_data"), F.min(good).alias("min_ms"), F.median(good).alias("median_ms"),
        F.avg(good).alias("mean_ms"), F.max(good).alias("max_ms"),
    )


def readable_sections(spark: SparkSession, path: str) -> DataFrame:
    """(path, nr, level, heading, body) of markdown files: a heading starts a section and lines belong to the one above."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"(?m)^(?=#{1,6} )")).alias("nr", "text"))
    head = F.regexp_extract("text", r"^(#{1,6}) ([^\n]*)", 2)
    return whole.select("path", "nr", F.length(F.regexp_extract("text", r"^(#{1,6}) ", 1)).alias("level"), head.alias("heading"), F.regexp_replace("text", r"^#{1,6} [^\n]*\n?", "").alias("body"))


def profile(sections: DataFrame) -> DataFrame:
    """(path, key, value) of a readable document's bold-keyed lines."""
    return sections.select("path", "nr", F.explode(F.split("body", "\n")).alias("line")).select(
        "path", F.regexp_extract("line", r"^\*\*([^*]+):\*\* *(.*)$", 1).alias("key"), F.regexp_extract("line", r"^\*\*([^*]+):\*\* *(.*)$", 2).alias("value")
    ).where("key <> ''")


def readable_pages(sections: DataFrame) -> DataFrame:
    """(path, page, orientation, verdict, spans, lines) of the page headings of a readable document."""
    mark = lambda p: F.regexp_extract("body", p, 1)
    return sections.where(F.col("heading").rlike("^Page [0-9]+$")).select(
        "path", F.regexp_extract("heading", "([0-9]+)", 1).cast("int").alias("page"), mark(r"\*([a-z]+) \|").alias("orientation"), mark(r"verdict: (\w+)").alias("verdict"),
        F.nullif(mark(r"spans: ([0-9]+)"), F.lit("")).cast("int").alias("spans"), F.nullif(mark(r"lines: ([0-9]+)"), F.lit("")).cast("int").alias("lines"),
    )


def numbered_steps(steps: DataFrame, by: list[str], order: str) -> DataFrame:
    """A run's steps with their number."""
    return steps.withColumn("step", F.row_number().over(W.partitionBy(*by).orderBy(order)))
