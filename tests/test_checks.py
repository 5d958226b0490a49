"""Tables, reconciliation, extraction records and verdicts: hand-worked cases and truth tables."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from quire import schemas
from quire.operators import extract, gather, outline, reconcile, retrieval, tables, validate


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", list: "array<string>"}
    ddl = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(column).first()[0]


GRID = [["Procedure", "Treatment", "Treatment", ""], ["Window", "± 3", "NA", ""], ["Efficacy", "", "", ""], ["Swab", "X", "", ""], ["", "", "", ""], ["Vitals", "", "", "X"]]


def test_row_types_and_labels(spark):
    rows = spark.createDataFrame([("t", i, r) for i, r in enumerate(GRID)], "id string, row_index int, cells array<string>")
    got = tables.typed_rows(rows, ["id"]).orderBy("row_index").collect()
    assert [r["row_type"] for r in got] == ["header", "window", "group_header", "data", "separator", "data"]
    assert [r["group_label"] for r in got] == [None, None, None, "Efficacy", None, "Efficacy"]


def test_column_groups(spark):
    cells = spark.createDataFrame([("t", i, c) for i, c in enumerate(GRID[0])], "id string, col int, text string")
    assert [(r["label"], r["column_indices"]) for r in tables.column_groups(cells, ["id"]).collect()] == [("Treatment", [1, 2])]


def test_grids(spark):
    frame = spark.createDataFrame([([[" a \n b", None], ["c"]],)], "g array<array<string>>")
    r = frame.select(tables.normal_grid(F.col("g")), tables.cell_count(F.col("g")), tables.table_hash(tables.normal_grid(F.col("g")))).first()
    assert r[0] == [["a b", ""], ["c", ""]] and r[1] == 3 and len(r[2]) == 16


def test_strategies(spark):
    counts = spark.createDataFrame([(1, "text", 5), (1, "lines", 5), (2, "text", 6), (2, "lines", 5), (3, "lines", 0)], "page int, strategy string, cells int")
    assert {r["page"]: r["strategy"] for r in tables.best_strategy(counts, ["page"]).collect()} == {1: "lines", 2: "text"}


@pytest.mark.parametrize("text,want", [("12.5 a", ["a"]), ("X a, b", ["a", "b"]), ("X †", ["†"]), ("word", []), ("X a,b,c,d", []), ("", []), (None, [])])
def test_footnote_refs(spark, text, want):
    assert one(spark, tables.footnote_refs(F.col("t")), t=text) == want


def cells(spark, rows):
    return spark.createDataFrame([("t", i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)], "id string, row int, col int, value string")


def test_reconciliation(spark):
    text = cells(spark, [["Swab", "X"], ["Vitals", ""], ["Dose", "5 mL"], ["Bloods", ""]])
    vision = cells(spark, [["Swab", "✓", ""], ["Vitals", "X", ""], ["Dose", "50 mL", ""], ["Bloods", "Day 3", ""], ["ECG", "X", "n"]])
    heads = lambda names, col: spark.createDataFrame([("t", i, n) for i, n in enumerate(names)], f"id string, {col} int, header string")
    mapping = reconcile.align_columns(heads(["Procedure", "Day 1"], "t_col"), heads(["Procedures", "Day 1", "Notes"], "v_col"), ["id"])
    compared = reconcile.compare_cells(text, vision, mapping, ["id"]).cache()
    summed = reconcile.confidence(compared, ["id"]).first()
    assert (summed["total_cells"], summed["conflicts"], summed["confidence"]) == (8, 2, 0.75)
    merged = reconcile.in_order(reconcile.merged_cells(text, vision, mapping, ["id"]), ["id"]).orderBy("row").collect()
    assert [r["cells"] for r in merged] == [["Swab", "X"], ["Vitals", "X"], ["Dose", "5 mL"], ["Bloods", ""], ["ECG", "X"]]


@pytest.mark.parametrize("a,b,want", [("5", "9", "text"), ("", "x y", "vision"), ("abc", "", "text"), ("ab", "abcdef", "vision"), ("abcd", "abcdef", "text"), ("", "day 3", "text"), ("nan", "x", "text")])
def test_resolution(spark, a, b, want):
    assert one(spark, reconcile.resolution(F.col("a"), F.col("b"))["resolution"], a=a, b=b) == want


def test_numbers(spark):
    text = "Amendment 6 of 2021: IC-4 requires 38.5C, 1200.5 mg, 2000 mL, 3000 units"
    assert sorted(one(spark, validate.numbers(F.col("t")), t=text)) == [38.5, 3000.0]


CONTEXT = "[Page 3] Participants must be 18 years or older. Fever (>= 38C) excludes. §5.1"


def test_verdicts(spark):
    rows = [("Age 18 or older", "Participants must be 18 years", 3), ("Fever >= 39C", "Fever (>= 38C) excludes.", 3), ("Consent given", "Written consent obtained", 3), ("Older participants", "18 years or older", -1)]
    claims = spark.createDataFrame([(i, *r, "5.1", None, CONTEXT) for i, r in enumerate(rows)], "nr int, claim string, exact_source_text string, page int, section_id string, completeness string, context string")
    checked = validate.validate(claims).cache()
    assert [r["verdict"] for r in checked.orderBy("nr").collect()] == ["VERIFIED", "FAILED_NUMBERS", "FAILED_SOURCE", "FLAGGED"]
    assert validate.summarize(checked, []).first().asDict() == {"verified": 1, "flagged": 1, "failed": 2, "total": 4}


def test_verdict_truth_table(spark):
    options = [("V", "V partial", "W empty", "X not found"), ("V numbers match", "V no numbers", "- skip", "X claim"), ("V", "W p.2", "X no page provided"), ("V", "W 1 not found", None), (None, "W missing timing")]
    rows = [*itertools.product(*options)]
    frame = spark.createDataFrame(rows, "s string, n string, p string, c string, w string")
    got = frame.select("*", validate.verdict(*map(F.col, ("s", "n", "p", "c", "w"))).alias("v")).collect()
    for r in got:
        if r["n"].startswith("X"):
            want = "FAILED_NUMBERS"
        elif not r["s"].startswith("V"):
            want = "FAILED_SOURCE"
        else:
            want = "FLAGGED" if r["p"].startswith("X") else "VERIFIED"
        assert r["v"] == want


@pytest.mark.parametrize("section,context,want", [("5", "in 15.3", "W 5 not found"), ("5", "in 5, yes", "V"), ("5.1", "§5.1", "V"), ("A(1)", "x A(1) y", "W A(1) not found"), ("", "x", None)])
def test_section_check(spark, section, context, want):
    assert one(spark, validate.section_check(F.col("s"), F.col("c")), s=section, c=context) == want


def test_groundings_are_found_in_order(spark):
    record = {"a": [{"id": "E1", "endpoint": "x criteria", "grounding": {"page": 2, "exact_source_text": "quote here"}}, {"kri_id": 7, "deep": {"exact_source_text": "q", "page": 1}}], "grounding": {"section_id": "9"}}
    rows = spark.createDataFrame([("r", json.dumps(record)), ("bad", "{"), ("null", None)], "id string, data string")
    got = validate.claims(rows, ["id"]).orderBy("nr").collect()
    assert [r["item"] for r in got] == [".a[0] E1", ".a[1] 7.deep", ""]
    assert [r["completeness"] for r in got] == ["W missing timing; criteria mentioned but no thresholds", None, None]


def test_every_root_has_a_type_and_a_valid_record():
    for query_type in schemas.QUERY_TYPES:
        assert schemas.struct_of(schemas.root_of(query_type)).fieldNames()
    assert schemas.root_of("unheard of") == "GeneralExtraction" and len(schemas.RECORDS) == 34


def filled(record):
    out = {}
    for f in schemas.RECORDS[record]:
        if f.required:
            out[f.name] = f.allowed[0] if f.allowed else "x"
        elif f.kind in schemas.RECORDS:
            out[f.name] = [filled(f.kind)] if f.many else filled(f.kind)
    return out


@pytest.mark.parametrize("query_type", schemas.QUERY_TYPES)
def test_records(spark, query_type):
    record = filled(schemas.root_of(query_type))
    raw = json.dumps(record)
    rows = [("fence", f"```json\n{raw}\n```"), ("prose", f"Well: {raw} done"), ("plain", raw), ("none", "sorry"), ("null", None)]
    got = {r["id"]: r for r in extract.parse_replies(spark.createDataFrame(rows, "id string, raw string"), query_type).collect()}
    assert [got[k]["method"] for k in ("fence", "prose", "plain")] == ["json_mode", "json_mode_brace", "json_mode"]
    assert got["none"]["error"] == got["null"]["error"] == "parse_failed" and got["plain"]["record"] is not None


def test_what_records_refuse():
    check = lambda **more: extract.check_record({"id": "1", "category": "Primary", "objective": "o", **more}, "Endpoint")[1]
    assert not check() and not check(grounding={"page": "5", "confidence": "0.9"})
    assert check(category="Other") and check(grounding={"page": 5.7}) and check(grounding=None) and check(id=5)
    assert extract.check_record({}, "Endpoint")[1][0] == "id: missing"
    assert extract.check_record({"check_id": "1", "check_type": "other", "status": "match", "description": "d"}, "ConsistencyResult")[0]["source_a"] is None


@pytest.mark.parametrize("hits,want", [(0, 0.35), (1, 0.45), (2, 0.55), (3, 0.1 + 0.1 + 0.1 + 0.35)])
def test_relevance(spark, hits, want):
    text = " ".join(["endpoint", "objective", "efficacy"][:hits])
    assert one(spark, gather.relevance(F.col("t"), F.lit(""), F.lit("endpoints")), t=text) == pytest.approx(want, abs=1e-12)


def test_budget(spark):
    items = [("A", 0.9, 20), ("B", 0.85, 28), ("C", 0.6, 16), ("D", 0.55, 8), ("E", 0.5, 4), ("F", 0.49, 4)]
    frame = spark.createDataFrame([("q", "section", n, i, "x" * size, s) for i, (n, s, size) in enumerate(items)], "q string, type string, item_id string, ord int, text string, score double")
    got = gather.pack(frame, ["q"], budget=10).orderBy("pos").collect()
    assert [(r["item_id"], r["shortened"]) for r in got] == [("A", False), ("C", True), ("E", True)] and got[-1]["used"] == 10
    assert gather.context(gather.pack(frame, ["q"], budget=10), ["q"]).first()["context"].startswith("[§A]\nxxxx")


def test_fusion(spark):
    rank = lambda rows: spark.createDataFrame([("q", d, r) for d, r in rows], "query_id string, doc_id string, rank int")
    a, b = rank([("x", 1), ("y", 2)]), rank([("y", 1), ("x", 2), ("z", 3)])
    got = retrieval.fuse([a, b]).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["score"], 7)) for r in got] == [("x", 0.0330601), ("y", 0.0330601), ("z", 0.016129)]
    assert got == retrieval.fuse([b, a]).orderBy("rank").collect()


def test_merged_parts(spark):
    parts = spark.createDataFrame([("t", 0, "h\n-\nr1"), ("t", 1, " \n"), ("t", 2, "h\n-\nr2\n\nr3"), ("t", 3, "h\nonly")], "id string, part int, text string")
    assert gather.merge_parts(parts, ["id"]).first()["merged"] == "h\n-\nr1\nr2\nr3\nh\nonly"


def test_outline_operators(spark):
    starts = spark.createDataFrame([("d", "1", 3, 0), ("d", "2", 54, 1), ("d", "3", 59, 2), ("d", "4", 59, 3)], "doc_id string, section_id string, start_page int, ord int")
    got = {r["section_id"]: r["end_page"] for r in outline.section_ranges(starts, ["doc_id"], F.lit(70)).collect()}
    assert got == {"1": 53, "2": 58, "3": 59, "4": 70}
    assert one(spark, outline.domain(F.col("t")), t="Safety monitoring and endpoints") == "safety"
    assert one(spark, outline.domain(F.col("t")), t="nothing") is None
    grid = [("d", p, 0, ["h"], [[str(p)]]) for p in (2, 3, 4, 6)] + [("d", 7, 0, ["other"], [["7"]])]
    tables_ = spark.createDataFrame(grid, "doc_id string, page int, ord int, headers array<string>, rows array<array<string>>")
    merged = outline.merge_continuations(tables_, ["doc_id"]).orderBy("first_page").collect()
    assert [(r["n_pages"], round(r["confidence"], 2), r["rows"]) for r in merged] == [(3, 0.66, [["2"], ["3"], ["4"]]), (1, 0.92, [["6"]]), (1, 0.92, [["7"]])]
    text = spark.createDataFrame([("d", "An Adverse Event of Special Interest and (see) serious adverse event (SAE), a serious adverse event (SAE)")], "doc_id string, text string")
    assert [(r["abbreviation"], r["expansion"]) for r in outline.abbreviations(text, ["doc_id"]).collect()] == [("SAE", "serious adverse event")]
    assert [one(spark, outline.page_verdict(F.col("n")), n=n) for n in (7, 8)] == ["SUFFICIENT", "USE_PDFPLUMBER"]


def test_run_log_and_readable_documents(spark, tmp_path):
    from quire.sources import documents as sources

    rule = "=" * 20
    (tmp_path / "log.txt").write_text("".join(f"{rule}\nQUERY DEBUG LOG — 2026-03-1{i} 09:11:33\nQuery: q{i}\n{rule}\n  query_type: risk\n  data keys: {k}\n  total_ms: {ms}\n{rule}\nTOTAL TIME: {ms / 1000}s\n" for i, (k, ms) in enumerate([("['a']", 2000), ("None", 8), ("['a']", 4000)])))
    runs = sources.read_run_log(spark, str(tmp_path / "log.txt"))
    assert [(r["query"], r["has_data"], r["total_ms"]) for r in runs.orderBy("at").collect()] == [("q0", True, 2000), ("q1", False, 8), ("q2", True, 4000)]
    assert sources.run_statistics(runs, ["query_type"]).first()["median_ms"] == 3000
    (tmp_path / "doc.md").write_text("# Doc\n**Pages:** 2\n### Page 1\n*1 of 2*\n*portrait | verdict: SUFFICIENT | spans: 3 | lines: 0*\ntext\n### Page 2\n*landscape | verdict: USE_PDFPLUMBER | spans: 9 | lines: 44*\n")
    parts = sources.readable_sections(spark, str(tmp_path / "doc.md"))
    assert [(r["key"], r["value"]) for r in sources.profile(parts).collect()] == [("Pages", "2")]
    assert [(r["page"], r["verdict"], r["lines"]) for r in sources.readable_pages(parts).orderBy("page").collect()] == [(1, "SUFFICIENT", 0), (2, "USE_PDFPLUMBER", 44)]
