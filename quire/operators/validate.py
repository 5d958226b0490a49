"""Checks of extracted claims against their source, and the verdict."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.text import escaped, strip

VERIFIED, FLAGGED, FAILED_NUMBERS, FAILED_SOURCE = "VERIFIED", "FLAGGED", "FAILED_NUMBERS", "FAILED_SOURCE"

# Ids and codes whose digits are no quantities, in the two steps in which they are taken out.
CODES = (
    r"COVID-19|SARS-CoV-2|mRNA-[0-9]+|P-?[0-9]+|Amendment\s+[0-9]+|Version\s+[0-9]+",
    r"IC-[0-9]+|EC-[0-9]+|DR-[0-9]+|[A-Z]{2}-[0-9]+",
)
# Fields that hold a claim's text, the first filled one counts; ids shown in a path; and what counts as missing.
CLAIM_FIELDS = ("endpoint", "text", "description", "condition", "statement", "source_criterion", "definition")
ID_FIELDS = ("id", "criterion_id", "rule_id", "finding_id", "risk_id", "check_id", "kri_id")
MISSING = ("", "null", "None")
MISSING_TIMING = ("", "N/A", "null", "None")
DOMAINS = ("DM", "VS", "LB", "CM", "MH", "AE", "EX", "DS", "IE", "SC", "SV", "TV", "DV", "FA", "", "null", "None")


def numbers(text: Column) -> Column:
    """V3: the distinct quantities in a text: no parts of codes, no years, no fractions above a thousand."""
    bare = F.coalesce(text, F.lit(""))
    for codes in CODES:
        bare = F.regexp_replace(bare, codes, "")
    found = F.transform(F.regexp_extract_all(bare, F.lit(r"([0-9]+\.?[0-9]*)"), F.lit(1)), lambda x: x.cast("double"))
    return F.array_distinct(F.filter(found, lambda n: ~((n >= 1900) & (n <= 2100)) & ~((n > 1000) & (n != F.round(n)))))


def numbers_check(claim: Column, source: Column) -> Column:
    """V4: each number of the claim has to be in the source, to within a half. Up to three that are not are named, smallest first."""
    said, there = numbers(claim), numbers(source)
    wrong = F.array_sort(F.filter(said, lambda n: ~F.exists(there, lambda s: F.abs(n - s) < 0.5)))
    told = F.array_join(F.transform(F.slice(wrong, 1, 3), lambda n: n.cast("string")), ",")
    return (
        F.when((F.coalesce(claim, F.lit("")) == "") | (F.coalesce(source, F.lit("")) == ""), "- skip")
        .when(F.size(said) == 0, "V no numbers")
        .when(F.size(wrong) > 0, F.concat(F.lit("X claim has "), told, F.lit(" not in source")))
        .otherwise("V numbers match")
    )


def source_check(source: Column, context: Column) -> Column:
    """V2: the first 40 characters of the quote in the context, else the first 20; quotes of five characters tell nothing."""
    low = F.lower(context)
    start = lambda n: strip(F.lower(F.substring(source, 1, n)))
    return (
        F.when(F.coalesce(F.length(source), F.lit(0)) <= 5, "W empty")
        .when(low.contains(start(40)), "V").when(low.contains(start(20)), "V partial").otherwise("X not found")
    )


def page_marks(context: Column) -> Column:
    """V5: pages that a context names."""
    marks = lambda p: F.regexp_extract_all(context, F.lit(p), F.lit(1))
    return F.transform(F.array_distinct(F.concat(marks(r"\[Page\s+([0-9]+)\]"), marks(r'page="([0-9]+)"'))), lambda x: x.cast("int"))


def page_check(page: Column, context: Column) -> Column:
    """V5: of a claim's page."""
    marks = page_marks(context)
    return (
        F.when(~(F.coalesce(page, F.lit(0)) > 0), "X no page provided").when(F.size(marks) == 0, "V no markers")
        .when(F.array_contains(marks, page), "V").otherwise(F.concat(F.lit("W p."), page.cast("string"), F.lit(" not in context")))
    )


def section_check(section_id: Column, context: Column) -> Column:
    """V6: the id between word ends, or after a section sign; null without an id."""
    found = F.expr("true") & (F.regexp_like(context, F.concat(F.lit(r"\b"), escaped(section_id), F.lit(r"\b"))) | context.contains(F.concat(F.lit("§"), section_id)))
    return F.when(F.coalesce(section_id, F.lit("")) == "", F.lit(None).cast("string")).when(found, "V").otherwise(F.concat(F.lit("W "), section_id, F.lit(" not found")))


def completeness_check(endpoint: Column, timing: Column, has_endpoint: Column, domain: Column | None = None, condition: Column | None = None, automation: Column | None = None) -> Column:
    """V7: what an item lacks; null if nothing. A domain given as null is no domain field."""
    low = F.lower(F.coalesce(endpoint, F.lit("")))
    vague = (low.contains("defined as") | low.contains("criteria") | low.contains("following")) & ~low.rlike("[0-9]")
    parts = [
        F.when(has_endpoint & F.coalesce(timing, F.lit("")).isin(*MISSING_TIMING), "missing timing"),
        F.when(has_endpoint & vague, "criteria mentioned but no thresholds"),
    ]
    if domain is not None:
        parts.append(F.when(domain.isNotNull() & (automation == "FULL") & F.coalesce(condition, F.lit("")).isin(*MISSING), "FULL automation but no condition"))
        parts.append(F.when(domain.isNotNull() & ~domain.isin(*DOMAINS), F.concat(F.lit("unknown SDTM domain: "), domain)))
    issues = F.concat_ws("; ", *parts)
    return F.when(issues != "", F.concat(F.lit("W "), issues))


def claim_text(*candidates: Column) -> Column:
    """V8: the first candidate that is not missing, else empty."""
    return F.coalesce(*[F.when(~c.isin(*MISSING), c) for c in candidates], F.lit(""))


def verdict(source: Column, numbers_: Column, page: Column, section: Column, complete: Column) -> Column:
    """V9: of the checks. Wrong numbers outrank a missing source; warnings never fail a claim."""
    starts = lambda c, *marks: F.substring(F.coalesce(c, F.lit("")), 1, 1).isin(*marks)
    wrong = starts(source, "X") | starts(numbers_, "X") | starts(page, "X") | starts(section, "X") | starts(complete, "X")
    return F.when(starts(source, "V") & ~wrong & starts(numbers_, "V", "-"), VERIFIED).when(starts(numbers_, "X"), FAILED_NUMBERS).when(~starts(source, "V"), FAILED_SOURCE).otherwise(FLAGGED)


def validate(claims: DataFrame) -> DataFrame:
    """V2-V9: claims (..., claim, exact_source_text, page, section_id, completeness, context) with a column for each check and the verdict."""
    checked = claims.select(
        "*", source_check(F.col("exact_source_text"), F.col("context")).alias("source_grounding"), numbers_check(F.col("claim"), F.col("exact_source_text")).alias("numbers"),
        page_check(F.col("page"), F.col("context")).alias("page_ref"), section_check(F.col("section_id"), F.col("context")).alias("section_ref"),
    )
    return checked.withColumn("verdict", verdict(F.col("source_grounding"), F.col("numbers"), F.col("page_ref"), F.col("section_ref"), F.col("completeness")))


def summarize(checked: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each outcome."""
    n = lambda *v: F.count_if(F.col("verdict").isin(*v))
    return checked.groupBy(*by).agg(n(VERIFIED).alias("verified"), n(FLAGGED).alias("flagged"), n(FAILED_NUMBERS, FAILED_SOURCE).alias("failed"), F.count("*").alias("total"))


def groundings(record: dict | list, path: str = "", parent: dict | None = None) -> Iterator[tuple[str, dict, dict]]:
    """V1: (path, grounding, item) of every grounding in a record, depth first: an object under the key "grounding", or one
    with a quote and a page. List items show their place and their id."""
    if isinstance(record, list):
        for i, item in enumerate(record):
            named = next((str(item[k]) for k in ID_FIELDS if k in item), "") if isinstance(item, dict) else ""
            yield from groundings(item, f"{path}[{i}]" + (f" {named}" if named else ""), item if isinstance(item, dict) else parent)
    elif isinstance(record, dict):
        if {"exact_source_text", "page"} <= record.keys():
            yield path, record, parent or record
            return
        for key, value in record.items():
            if key == "grounding" and isinstance(value, dict):
                yield path, value, record
            elif isinstance(value, (dict, list)):
                yield from groundings(value, f"{path}.{key}", record)


_CLAIM = "item string, claim string, exact_source_text string, page int, section_id string, has_endpoint boolean, endpoint string, timing string, domain string, condition string, automation string"


def claims(records: DataFrame, by: list[str], json_col: str = "data") -> DataFrame:
    """V1, V7, V8: a row for each grounding in the JSON records: (by..., nr, item, claim, ..., completeness). No valid JSON, no rows."""
    kinds = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in by)
    names = [x.split()[0] for x in _CLAIM.split(", ")]

    def text(value) -> str | None:
        return None if value is None else value if isinstance(value, str) else json.dumps(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*_schema, ("nr", pa.int32()), *[(n, pa.int32() if n == "page" else pa.bool_() if n == "has_endpoint" else pa.string()) for n in names]])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    data = json.loads(row[json_col] or "null")
                except ValueError:
                    continue
                for nr, (path, g, item) in enumerate(groundings(data)):
                    claim = next((str(item[f]) for f in CLAIM_FIELDS if item.get(f) and str(item[f]) not in MISSING), "")
                    page = g.get("page", 0)
                    out.append(
                        {b: row[b] for b in by}
                        | {
                            "nr": nr, "item": path[:80], "claim": claim, "exact_source_text": text(g.get("exact_source_text", "")), "page": page if isinstance(page, int) else 0,
                            "section_id": text(g.get("section_id", "")), "has_endpoint": "endpoint" in item, "endpoint": text(item.get("endpoint")), "timing": text(item.get("timing")),
                            "domain": text(item["sdtm_domain"]) if "sdtm_domain" in item else None, "condition": text(item.get("condition")),
                            "automation": text(item.get("automation_level", item.get("automation"))),
                        }
                    )
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    _schema = list(to_arrow_schema(records.select(*by).schema))
    found = records.select(*by, json_col).mapInArrow(run, f"{kinds}, nr int, {_CLAIM}")
    complete = completeness_check(F.col("endpoint"), F.col("timing"), F.col("has_endpoint"), F.col("domain"), F.col("condition"), F.col("automation"))
    return found.withColumn("completeness", complete).drop("has_endpoint", "endpoint", "timing", "domain", "condition", "automation")
