"""Extraction records: prompts, the parse ladder, checks against schemas and between fields."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.schemas import RECORDS, Field, root_of, struct_of
from quire.text import strip

APPENDIX_CHARS = 3_000
# The knowledge that goes with a record's prompt.
APPENDIX = {"DeviationRuleSet": "cdisc", "KRIExtraction": "sdtm_mappings"}
FENCE = "```"


def without_fences(raw: Column) -> Column:
    """E5: a reply without the code fence around it."""
    text = strip(raw)
    opened = F.when(text.startswith(FENCE), F.when(text.contains("\n"), F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(F.substring(text, 4, 1 << 30))).otherwise(text)
    # everything from the last fence on goes when the reply ends with one
    closed = F.when(opened.endswith(FENCE), F.regexp_replace(opened, r"(?s)```(?!.*```).*$", "")).otherwise(opened)
    return strip(closed)


def within_braces(raw: Column) -> Column:
    """E5: from the first opening to the last closing brace; null without them."""
    first, last = F.instr(raw, "{"), F.length(raw) - F.instr(F.reverse(raw), "}") + 1
    return F.when((first > 0) & F.contains(raw, F.lit("}")) & (last >= first), F.substring(raw, first, last - first + 1))


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def salvage(raw: Column, method: str = "json_mode", valid: Callable[[Column], Column] = is_json) -> Column:
    """E5: struct(json, method, error): the first rung that `valid` accepts, of the reply without fences, the reply, and what
    is between its braces; else no JSON and the error parse_failed."""
    out = lambda j, m, e: F.struct(j.alias("json"), F.lit(m).alias("method"), F.lit(e).cast("string").alias("error"))
    bare, inner = without_fences(raw), within_braces(raw)
    return F.when(valid(bare), out(bare, method, None)).when(valid(raw), out(raw, method, None)).when(valid(inner), out(inner, f"{method}_brace", None)).otherwise(out(F.lit(None).cast("string"), method, "parse_failed"))


def coerce(value, field: Field, path: str = "") -> tuple[object, list[str]]:
    """A JSON value as its field has it, and what is wrong. Numbers may come as text, whole floats as integers."""
    where = f"{path}.{field.name}".lstrip(".")
    if field.many:
        if not isinstance(value, list):
            return None, [f"{where}: a list is due"]
        parts = [_one(v, field, f"{where}[{i}]") for i, v in enumerate(value)]
        return [v for v, _ in parts], [e for _, errors in parts for e in errors]
    return _one(value, field, where)


def _one(value, field: Field, where: str) -> tuple[object, list[str]]:
    if field.kind in RECORDS:
        return check_record(value, field.kind, where) if isinstance(value, dict) else (None, [f"{where}: an object is due"])
    wrong = (None, [f"{where}: {field.kind} is due"])
    if field.kind == "string":
        if not isinstance(value, str):
            return wrong
        return (value, []) if field.allowed is None or value in field.allowed else (None, [f"{where}: {value!r} is not allowed"])
    if field.kind == "boolean":
        known = {True: True, False: False, "true": True, "false": False, "yes": True, "no": False, "on": True, "off": False, "1": True, "0": False}
        key = value.lower() if isinstance(value, str) else value
        return (known[key], []) if isinstance(key, (str, bool, int)) and key in known else wrong
    try:
        number = float(value) if isinstance(value, (int, float, str)) else None
    except ValueError:
        number = None
    if number is None or (field.kind == "integer" and not number.is_integer()):
        return wrong
    return (int(number) if field.kind == "integer" else number), []


def check_record(data: dict, record: str, path: str = "") -> tuple[dict, list[str]]:
    """The record with defaults filled in, and all that is wrong with it. Fields it does not know are left out.

    A field with a default may be missing, not null. A record left out is filled with its own defaults, unless it has
    required fields: then it is null.
    """
    out, errors = {}, []
    for f in RECORDS[record]:
        if f.name in data:
            out[f.name], wrong = coerce(data[f.name], f, path)
            errors += wrong
        elif f.required:
            errors.append(f"{path}.{f.name}".lstrip(".") + ": missing")
        elif f.kind in RECORDS and not f.many:
            filled, lacks = check_record({}, f.kind)
            out[f.name] = None if lacks else filled
        else:
            out[f.name] = f.default
    return out, errors


def parse_replies(replies: DataFrame, query_type: str, raw_col: str = "raw", method: str = "json_mode") -> DataFrame:
    """Replies with columns record (the query type's struct, null if invalid), data (the same as JSON), method and error.

    Built-in functions find the JSON; a rung counts when it is JSON and a valid record, as a later rung may be.
    """
    record = root_of(query_type)
    columns = replies.columns

    def checked(text: str | None) -> tuple[str | None, list[str]]:
        if text is None:
            return None, ["no JSON"]
        try:
            data = json.loads(text)
        except ValueError as e:
            return None, [f"no JSON: {e}"]
        if not isinstance(data, dict):
            return None, ["an object is due"]
        out, errors = check_record(data, record)
        return (None, errors) if errors else (json.dumps(out, ensure_ascii=False), [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, how, error = [], [], []
            for bare, raw, inner in zip(*[c.to_pylist() for c in batch.columns[-3:]], strict=True):
                tried = [checked(t) for t in (bare, raw, inner)]
                hit = next((i for i, (found, _) in enumerate(tried) if found is not None), None)
                data.append(None if hit is None else tried[hit][0])
                how.append(f"{method}_brace" if hit == 2 else method)
                error.append("parse_failed" if hit is None else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *[pa.array(x, pa.string()) for x in (data, how, error)]], [*columns, "data", "method", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in replies.schema)
    raw = F.col(raw_col)
    tried = replies.select(*columns, without_fences(raw).alias("_bare"), raw.alias("_raw"), within_braces(raw).alias("_inner"))
    found = tried.mapInArrow(run, f"{kinds}, data string, method string, error string")
    return found.withColumn("record", F.from_json("data", struct_of(record)))


def primary_endpoint_issue(endpoints: Column, declared: Column) -> Column:
    """Declared against extracted primary endpoints; null if they agree or none is declared."""
    actual = F.size(F.filter(endpoints, lambda e: e["category"] == "Primary"))
    return F.when((declared > 0) & (actual != declared), F.concat(F.lit("Declared "), declared.cast("string"), F.lit(" primary endpoints but extracted "), actual.cast("string")))


def count_issue(actual: Column, declared: Column, what: str) -> Column:
    """E8 for any list and its declared length, as arms; a list that the record does not have is no issue."""
    return F.when((declared > 0) & actual.isNotNull() & (actual != declared), F.concat(F.lit("Declared "), declared.cast("string"), F.lit(f" {what} but extracted "), actual.cast("string")))


def appendix(record: str, trees: dict[str, dict]) -> str:
    """The knowledge that goes with a record's prompt, cut to its length; trees are the loaded domains."""
    domain = APPENDIX.get(record)
    return json.dumps(trees[domain], indent=2)[:APPENDIX_CHARS] if domain in trees else ""


def prompt(system: str, appendix_text: str, context: Column) -> Column:
    """What a model is asked: instructions, the appendix if any, the context."""
    lead = system + (f"\n\n{appendix_text}" if appendix_text else "")
    return F.concat(F.lit(lead + "\n\n"), context)


def extract(contexts: DataFrame, query_type: str, adapter: Callable[[str], str], system: str = "", appendix_text: str = "", by: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """adapter(prompt) -> reply, called on the executors for each context that is not blank; then parse_replies.

    Offline, the adapter replays recorded replies; what comes out is a replay and says nothing of a model. An adapter that
    fails leaves no reply for that row.
    """
    asked = contexts.where(F.coalesce("context", F.lit("")) != "").select(*by, prompt(system, appendix_text, F.col("context")).alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = []
            for text in batch.column(len(by)).to_pylist():
                try:
                    replies.append(adapter(text))
                except Exception:  # noqa: BLE001  a model's failure is a row without a reply
                    replies.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(replies, pa.string())], [*by, "raw"])

    kinds = ", ".join(f"`{b}` {asked.schema[b].dataType.simpleString()}" for b in by)
    return parse_replies(asked.mapInArrow(run, f"{kinds}, raw string"), query_type)
