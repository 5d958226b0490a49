import json
import os
import time

from pyspark.sql import functions as F

from quire.streaming.documents import arriving_documents, follow_sections, followed_sections, windowed_runs


def put(folder, name, title):
    document = {"filename": f"{name}.pdf", "sections": [{"number": "1", "title": title, "content_blocks": [{"text": f"text of {title}", "source": {"page": 1}}]}], "tables": []}
    path = folder / f"{name}.json"
    path.write_text(json.dumps(document))
    return path


def test_sections_follow_a_folder(spark, tmp_path):
    arriving, kept, marks = tmp_path / "in", str(tmp_path / "kept"), str(tmp_path / "marks")
    arriving.mkdir()
    follow = lambda: follow_sections(arriving_documents(spark, str(arriving)), kept, marks, once=True).awaitTermination()
    put(arriving, "a", "one"), put(arriving, "b_structured", "two")
    follow()
    texts = lambda: {r["doc_id"]: r["content"] for r in followed_sections(spark, kept).collect()}
    assert texts() == {"a": "text of one", "b": "text of two"}
    later = put(arriving, "b", "three")  # the same document by its plain name, arriving later
    os.utime(later, (time.time() + 60, time.time() + 60))
    put(arriving, "c", "four")
    follow()
    assert texts() == {"a": "text of one", "b": "text of three", "c": "text of four"}
    follow()  # nothing new
    assert len(texts()) == 3


def test_runs_by_window(spark, tmp_path):
    rows = [(f"2026-03-11 10:{m:02d}:00", kind, m % 2 == 0, 1000 * m) for m in range(0, 50, 10) for kind in ("soa", "kri")] + [("2026-03-11 12:00:00", "soa", True, 7)]
    frame = spark.createDataFrame(rows, "at string, query_type string, has_data boolean, total_ms long").withColumn("at", F.to_timestamp("at"))
    frame.coalesce(1).write.parquet(str(tmp_path / "runs"))
    stream = windowed_runs(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "runs")))
    query = stream.writeStream.format("memory").queryName("windowed_runs").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "marks")).start()
    query.awaitTermination()
    got = {(str(r["window"]["start"]), r["query_type"]): (r["runs"], r["with_data"], r["max_ms"]) for r in spark.table("windowed_runs").collect()}
    assert got == {("2026-03-11 10:00:00", "soa"): (5, 5, 40000), ("2026-03-11 10:00:00", "kri"): (5, 5, 40000), ("2026-03-11 12:00:00", "soa"): (1, 1, 7)}
