"""Hand-worked cases over one small document."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.operators import chunking, control, gather, retrieval, store
from quire.plans import engine
from quire.session import Settings
from quire.sources import documents as sources

DEMO = json.loads((Path(__file__).parent / "data" / "demo.json").read_text())
TABLE = "Procedure | Day 1\n" + "-" * 40 + "\nSwab | X\n  a. Only once."


@pytest.fixture(scope="module")
def docs(spark):
    return sources.documents_of(spark, {"demo": DEMO}).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["section_id"]: r for r in store.section_texts(docs).collect()}


def test_sections_come_in_natural_order(docs):
    rows = store.natural_order(store.sections(docs), "section_id", ["doc_id"], "first_order").orderBy("position").collect()
    assert [r["section_id"] for r in rows] == ["1", "1.1", "5", "5.1", "5.10", "Appendix A"]


def test_section_texts(texts):
    assert texts["5.1"]["pages"] == [3, 4]
    assert texts["5.1"]["content"] == f"Participants must be 18 years or older.\n\nRefer to Appendix A.\n\n[Table: Table 1 Visits]\n{TABLE}"
    assert texts["5.10"]["content"] == f"[Page 5]\nScreen failure text.\n\n[Table: Table 1 Visits]\n{TABLE}"


def test_last_section_of_a_number_wins_in_the_first_place(spark):
    twice = {"sections": [{"number": "1", "title": "old"}, {"number": "2", "title": "two"}, {"number": "1", "title": "new"}, {"number": "", "title": "none"}, {"id": "x", "title": "by id"}]}
    got = store.sections(sources.documents_of(spark, {"d": twice})).orderBy("first_order").collect()
    assert [(r["section_id"], r["title"]) for r in got] == [("1", "new"), ("2", "two"), ("x", "by id")]


def test_metadata(docs):
    assert store.metadata(docs).first().asDict() == {"doc_id": "demo", "filename": "demo.pdf", "total_pages": 6, "sections": 6, "tables": 1}


def test_leaves(docs):
    got = {r["section_id"] for r in retrieval.leaves(store.sections(docs), ["doc_id"], "section_id").collect()}
    assert got == {"1.1", "5.1", "5.10", "Appendix A"}


def test_flat_content(docs):
    flat = {r["section_id"]: r["content"] for r in chunking.flat_sections(docs).collect()}
    assert flat["1.1"] == "See Section 5.1 for criteria.\n\na) first\n\n  - sub\n\nb) second"
    assert "5.10" not in flat


def test_packing(spark):
    text = "\n\n".join(c * 10 for c in "abcd")
    frame = spark.createDataFrame([(text,)], "t string")
    got = frame.select(chunking.packed(chunking.paragraphs(F.col("t")), 20, 5)).first()[0]
    assert got == ["a" * 10 + "\n\n" + "b" * 10, "b" * 5 + "\n\n" + "c" * 10, "c" * 5 + "\n\n" + "d" * 10]


def spec_pack(paras, size, overlap):
    done, now = [], ""
    for p in paras:
        if now and len(now) + len(p) > size:
            done.append(now)
            now = now[-overlap:] if overlap and len(now) > overlap else ""
        now = f"{now}\n\n{p}" if now else p
    return [*done, now] if now.strip() else done


def test_packing_against_a_spec(spark):
    import random

    rng = random.Random(1)
    rows = [["x" * rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))] for _ in range(60)]
    frame = spark.createDataFrame([(r,) for r in rows], "p array<string>")
    for size, overlap in ((20, 0), (25, 7), (1, 3)):
        got = frame.select("p", chunking.packed(F.col("p"), size, overlap).alias("c")).collect()
        assert all(r["c"] == spec_pack(r["p"], size, overlap) for r in got)


def test_list_items_join(spark):
    text = "Intro\n\n- one\n\n• two\n\n1. three\n\n10. no\n\na) four\n\nb. five\n\n \n\nend"
    got = spark.createDataFrame([(text,)], "t string").select(chunking.paragraphs(F.col("t"))).first()[0]
    assert got == ["Intro", "- one\n• two\n1. three", "10. no", "a) four\nb. five", "end"]


def test_references_are_followed_once(docs, texts, spark):
    known = store.section_texts(docs)
    have = known.where("section_id = '1.1'").select("doc_id", F.lit("section").alias("type"), F.col("section_id").alias("item_id"), "pages", F.col("content").alias("text"))
    assert [r["item_id"] for r in gather.follow_references(have, known, ["doc_id"]).collect()] == ["5.1"]
    have = known.where("section_id = '5.1'").select("doc_id", F.lit("section").alias("type"), F.col("section_id").alias("item_id"), "pages", F.col("content").alias("text"))
    assert [r["item_id"] for r in gather.follow_references(have, known, ["doc_id"]).collect()] == ["Appendix A"]
    assert [r["item_id"] for r in gather.tables_on_pages(have, store.tables(docs), ["doc_id"]).collect()] == ["table_p4_1"]


def test_appendix_needs_a_letter_of_its_own(spark):
    rows = [("see appendix to this",), ("See Appendix b, refer to § 4.2.1 and see section 3",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(gather.references(F.col("t"))).collect()]
    assert got == [[], ["4.2.1", "3", "Appendix B"]]


def test_ingest(docs):
    chunks, counts = engine.ingest(docs)
    assert counts.first().asDict() == {"doc_id": "demo", "pages": 6, "sections": 5, "tables": 1, "n_chunks": 6, "n_tokens": counts.first()["n_tokens"]}
    rows = chunks.orderBy("nr").collect()
    assert rows[0]["text"].startswith("Document: Clinical protocol: demo.pdf, 6 pages, 6 sections, 1 tables. Section §1: SUMMARY\n\nOverview.")
    assert rows[-1]["chunk_type"] == "table" and rows[-1]["chunk_id"] == "chunk_6" and rows[-1]["raw_text"] == "Table: Table 1 Visits\nProcedure | Day 1\nSwab | X"


def test_null_captions_and_no_sections(spark):
    bare = sources.documents_of(spark, {"d": {"tables": [{"id": "t", "rows": [["a", None]]}]}, "e": {}})
    chunks, counts = engine.ingest(bare)
    assert chunks.first()["raw_text"] == "Table: \na | None" and counts.count() == 2
    assert engine.index(bare).nodes.count() == 1


def test_cached_documents(spark, tmp_path):
    (tmp_path / "demo.json").write_text(json.dumps(DEMO))
    found, path = sources.cached_documents(spark, str(tmp_path), "demo")
    assert path.endswith("demo.json") and found.first()["doc_id"] == "demo"
    missing, path = sources.cached_documents(spark, str(tmp_path), "other")
    assert path is None and missing.count() == 0


def reply(context):
    return "Here: " + json.dumps(
        {"inclusion": [{"id": "I1", "text": "Age 18 or older", "grounding": {"section_id": "5.1", "page": 3, "exact_source_text": "Participants must be 18 years", "confidence": "0.9"}}]}
    )


def test_a_query_end_to_end(docs, spark):
    found = engine.index(docs)
    seen = []
    answer = engine.run_query(spark, found, "inclusion criteria participants years", "eligibility", reply, Settings(), on_step=seen.append)
    assert answer.error is None, answer.error
    assert answer.data["inclusion"][0]["automation_level"] == "MANUAL" and answer.data["summary"]["total"] == 0
    assert answer.validation["total"] == 1 and answer.validation["details"][0] == {"item": ".inclusion[0] I1", "verdict": "VERIFIED"}
    assert [s["agent"] for s in seen] == ["explorer", "extractor", "reviewer", "engine"]


def test_critical_signals_bring_two_more_passes(docs, spark):
    flag = lambda *_: [{"signal_type": "consistency", "severity": "critical", "title": "t", "description": "d"}, {"signal_type": "odd", "severity": "minor"}]
    answer = engine.run_query(spark, engine.index(docs), "inclusion criteria participants years", "eligibility", reply, Settings(), flag)
    assert sum(s["agent"] == "explorer" for s in answer.steps) == 3 and len(answer.signals) == 3


def test_failures_are_answers(docs, spark):
    answer = engine.run_query(spark, engine.index(docs), "inclusion criteria", "eligibility", lambda p: "no JSON", Settings())
    assert answer.data == {} and any(s.get("error") == "parse_failed" for s in answer.steps)
    answer = engine.run_query(spark, None, "x", "eligibility", reply, Settings())
    assert answer.error


def test_knowledge_search(spark):
    tree = {"A": {"title": "Safety first", "sections": {"6.6": "Safety rules", "x": ["safety list", "none"]}}, "B": {"deep": {"er": {"still": {"safety": 1}}}}}
    flat = sources.knowledge(spark, {"k": tree})
    got = control.search(flat, F.lit("SAFETY"), ["domain"]).orderBy("nth").collect()
    assert [r["path"] for r in got] == ["A.title", "A.sections.6.6", "A.sections.x[0]"]


def test_routes():
    assert control.route_after_extraction(False) == "end" and control.route_after_extraction(True) == "review"
    assert [control.route_after_review("need_more", c) for c in range(3)] == ["explore", "explore", "end"]
    assert gather.agentic("done", "soa") and not gather.agentic("done", "risk")
