"""From hits to a context: expansion, cross references, page overlap, relevance, packing into a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.operators.chunking import table_text
from quire.text import CHARS_PER_TOKEN, blank, words

CONTEXT_TOKENS = 32_000
HIGH, MEDIUM = 0.8, 0.5
SHORTENED = 2_000
#: Parts in which the items of one size are picked before they meet.
SALTS = 64
GATHER_CHARS = 150_000
TABLE_ROWS = 100

# What is searched for each query type besides the user's own words.
EXPANSIONS = {
    "endpoints": ["objectives and endpoints primary secondary exploratory", "estimand endpoint definition population intercurrent events", "efficacy endpoint analysis assessment timepoint"],
    "eligibility": ["inclusion criteria participants eligible enrollment", "exclusion criteria medical conditions disqualification", "lifestyle considerations contraception restrictions"],
    "safety": ["adverse events serious adverse events reporting monitoring", "adverse events special interest AESI definition criteria", "stopping rules discontinuation safety monitoring committee"],
    "study_design": ["overall design randomization blinding stratification", "sample size determination enrollment participants", "study intervention dose route administration treatment arms"],
    "intervention": ["investigational product dose formulation route", "concomitant therapy prohibited permitted medications", "dose modification discontinuation treatment compliance"],
    "statistical": ["sample size determination power calculation", "analysis populations intent-to-treat per-protocol", "interim analysis data monitoring committee multiplicity"],
    "soa": ["schedule of activities visit procedures assessments"],
    "deviation": ["eligibility criteria schedule of activities"],
    "kri": ["screening failure enrollment inclusion exclusion", "adverse event reporting rate collection monitoring", "visit schedule compliance assessment window"],
    "risk": ["safety monitoring adverse events stopping rules"],
    "ambiguity": ["eligibility criteria safety definitions"],
    "consistency": ["synopsis protocol summary objectives endpoints", "statistical analysis primary secondary endpoint"],
}

# Words that raise a text's relevance for a query type.
KEYWORDS = {
    "endpoints": ["endpoint", "objective", "efficacy"],
    "eligibility": ["inclusion", "exclusion", "criteria"],
    "safety": ["safety", "adverse", "monitoring"],
    "soa": ["schedule", "activities", "visit"],
    "study_design": ["design", "randomiz", "blind"],
    "intervention": ["dose", "drug", "vaccine"],
    "statistical": ["statistic", "sample", "power"],
}


def expansions(spark: SparkSession) -> DataFrame:
    """G1 as a table (query_type, ord, text), ord from 1."""
    rows = [(t, i, q) for t, qs in EXPANSIONS.items() for i, q in enumerate(qs, 1)]
    return spark.createDataFrame(rows, "query_type string, ord int, text string")


def expand(requests: DataFrame) -> DataFrame:
    """Requests (request_id, query_type, text) as the queries to run: (request_id, ord, text), the user's own at 0 unless blank.

    A general request without words has no query; its result is empty.
    """
    own = requests.where(~blank(F.col("text"))).select("request_id", F.lit(0).alias("ord"), "text")
    canned = requests.select("request_id", "query_type").join(F.broadcast(expansions(requests.sparkSession)), "query_type")  # a fixed table
    return own.unionByName(canned.select("request_id", "ord", "text"))


def first_hits(hits: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of hits (by..., type, item_id, text, ...) the first of each item; blank texts and missing ids are dropped.

    The order is the query's and the rank's, never arrival. One aggregation, no window.
    """
    keys = [*by, "type", "item_id"]
    rest = [c for c in hits.columns if c not in keys]
    real = hits.where(~blank(F.col("text")) & (F.coalesce("item_id", F.lit("")) != ""))
    first = real.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return first.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest])


def references(text: Column) -> Column:
    """Ids that a text points to: numbers after "see" or "refer to" and a section sign, letters after Appendix.

    A letter is given with its word, as sections are numbered, and has to stand alone, so that "see appendix to" is none.
    """
    numbered = F.regexp_extract_all(text, F.lit(r"(?i)(?:see|refer to)\s+(?:Section|§)\s*([0-9]+(?:\.[0-9]+)*)"), F.lit(1))
    lettered = F.regexp_extract_all(text, F.lit(r"(?i)(?:see|refer to)\s+Appendix\s+([A-Z])\b"), F.lit(1))
    return F.array_distinct(F.concat(numbered, F.transform(lettered, lambda x: F.concat(F.lit("Appendix "), F.upper(x)))))


def follow_references(gathered: DataFrame, section_texts: DataFrame, by: list[str]) -> DataFrame:
    """Sections that gathered texts point to, without those already there; one hop. Both sides have doc_id."""
    keys = list(dict.fromkeys([*by, "doc_id"]))
    asked = gathered.select(*keys, F.explode(references(F.col("text"))).alias("item_id")).distinct()
    new = asked.join(gathered.where("type = 'section'").select(*keys, "item_id"), [*keys, "item_id"], "left_anti")
    known = section_texts.where(~blank(F.col("content"))).select("doc_id", F.col("section_id").alias("item_id"), "pages", F.col("content").alias("text"))
    return new.join(known, ["doc_id", "item_id"]).select(*keys, F.lit("section").alias("type"), "item_id", "pages", "text")


def tables_on_pages(gathered: DataFrame, table_rows: DataFrame, by: list[str]) -> DataFrame:
    """Tables on a page of what is gathered that are not gathered yet: an equi join of pages, each table once."""
    keys = list(dict.fromkeys([*by, "doc_id"]))
    seen = gathered.select(*keys, F.explode("pages").alias("page")).distinct()
    on = table_rows.select("doc_id", F.col("table_id").alias("item_id"), F.explode(F.array_distinct("page_range")).alias("page"))
    near = seen.join(on, ["doc_id", "page"]).select(*keys, "item_id").distinct()
    new = near.join(gathered.where("type = 'table'").select(*keys, "item_id"), [*keys, "item_id"], "left_anti")
    texts = table_rows.select("doc_id", F.col("table_id").alias("item_id"), F.col("page_range").alias("pages"), table_text(F.col("caption"), F.col("column_headers"), F.col("rows"), TABLE_ROWS).alias("text"))
    return new.join(texts, ["doc_id", "item_id"]).select(*keys, F.lit("table").alias("type"), "item_id", "pages", "text")


def relevance(text: Column, query: Column, query_type: Column) -> Column:
    """Half the share of the query's words in the text (0.3 without a query), a tenth for each keyword of the type, and 0.2."""
    low = F.lower(text)
    asked = F.array_distinct(words(F.lower(query)))
    overlap = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(low))) / F.greatest(F.size(asked), F.lit(1))).otherwise(F.lit(0.3))
    boost = F.lit(0.0)
    for kind, keywords in KEYWORDS.items():
        hits = F.lit(0.0)
        for word in keywords:  # one after the other: three tenths are not 0.3 in doubles
            hits = hits + F.when(low.contains(word), 0.1).otherwise(0.0)
        boost = F.when(query_type == kind, hits).otherwise(boost)
    return F.least(F.lit(1.0), overlap * 0.5 + boost + 0.2)


def item_score(relevance_: Column, kind: Column) -> Column:
    """A table's is a tenth more, at most 1."""
    return F.when(kind == "table", F.least(F.lit(1.0), relevance_ + 0.1)).otherwise(relevance_)


def pack(items: DataFrame, by: list[str], budget: int = CONTEXT_TOKENS, high: float = HIGH, medium: float = MEDIUM) -> DataFrame:
    """Items (by..., type, item_id, ord, text, score) that fit the budget: (by..., pos, type, item_id, shortened, taken text, est, used).

    In order of score, sections before tables and then ord on ties: whole from `high` on, their beginning from `medium` on,
    else not at all. What does not fit is passed over and later ones may still fit, so this is a fold, not a running sum.
    Only lengths go through the fold, and only of items that could be taken: of those of one size no more than the budget
    holds, the first ones, since a size that does not fit once never fits again. They are picked in SALTS parts of each
    size first, so that a size with most of the items is no task of its own. Items that cost nothing always fit: they do
    not go through the fold and get their places behind it.
    """
    able = items.where(F.col("score") >= medium).withColumn("shortened", F.col("score") < high)
    able = able.withColumn("est", F.floor(F.when(F.col("shortened"), F.least(F.length("text"), F.lit(SHORTENED))).otherwise(F.length("text")) / CHARS_PER_TOKEN))
    order = [F.col("score").desc(), F.when(F.col("type") == "table", 1).otherwise(0), F.col("ord"), F.col("item_id")]
    free, able = able.where("est = 0"), able.where(F.col("est").between(1, budget)).withColumn("_salt", F.pmod(F.xxhash64("type", "ord", "item_id"), F.lit(SALTS)))
    for part in (["est", "_salt"], ["est"]):
        nth = F.row_number().over(W.partitionBy(*by, *part).orderBy(*order))
        able = able.withColumn("_nth", nth).where(F.col("_nth") * F.col("est") <= budget).drop("_nth")
    able = able.drop("_salt")
    entry = F.struct((-F.col("score")).alias("neg"), F.when(F.col("type") == "table", 1).otherwise(0).alias("kind"), "ord", "item_id", "est")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<type:int,item_id:string,ord:bigint,used:bigint>>").alias("taken"))

    def step(a: Column, x: Column) -> Column:
        total = a["used"] + x["est"]
        fits = total <= budget
        one = F.struct(x["kind"].alias("type"), x["item_id"].alias("item_id"), x["ord"].cast("long").alias("ord"), total.alias("used"))
        return F.struct(F.when(fits, total).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["taken"], F.array(one))).otherwise(a["taken"]).alias("taken"))

    folded = able.groupBy(*by).agg(F.aggregate(F.array_sort(F.collect_list(entry)), start, step, lambda a: a["taken"]).alias("_taken"))
    taken = folded.select(*by, F.explode("_taken").alias("_t")).select(*by, F.when(F.col("_t.type") == 1, "table").otherwise("section").alias("_kind"), F.col("_t.item_id").alias("item_id"), F.col("_t.ord").alias("ord"), F.col("_t.used").alias("used"))
    text = F.when(F.col("shortened"), F.substring("text", 1, SHORTENED)).otherwise(F.col("text"))
    met = able.withColumn("_kind", F.when(F.col("type") == "table", "table").otherwise("section")).withColumn("ord", F.col("ord").cast("long"))
    fit = taken.join(met, [*by, "_kind", "item_id", "ord"]).select(*by, "type", "item_id", "ord", "score", "shortened", "est", "used", text.alias("text"))
    free = free.select(*by, "type", "item_id", F.col("ord").cast("long").alias("ord"), "score", "shortened", "est", F.lit(0).cast("long").alias("used"), text.alias("text"))
    placed = W.partitionBy(*by).orderBy(*order)
    return fit.unionByName(free).select(
        *by, (F.row_number().over(placed) - 1).alias("pos"), "type", "item_id", "score", "shortened", "est", F.max("used").over(placed.rowsBetween(W.unboundedPreceding, 0)).alias("used"), "text"
    )


def context(packed: DataFrame, by: list[str]) -> DataFrame:
    """(by..., context): the packed pieces under their labels, in order, between rules."""
    label = F.concat(
        F.lit("["), F.when(F.col("type") == "table", F.concat(F.lit("TABLE: "), "item_id")).otherwise(F.concat(F.lit("§"), "item_id")),
        F.when(F.col("shortened"), " (truncated)").otherwise(""), F.lit("]\n"), F.col("text"),
    )
    return packed.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", label.alias("t")))), lambda x: x["t"]), "\n\n---\n\n").alias("context"))


def take_search(gathered: DataFrame, hits: DataFrame, used_chars: int, limit: int = GATHER_CHARS) -> DataFrame:
    """Hits not gathered yet, none once the budget is spent; it is looked at before, so the last search may pass it."""
    if used_chars >= limit:
        return hits.limit(0)
    return hits.where(F.coalesce("item_id", F.lit("")) != "").join(gathered.select("item_id"), "item_id", "left_anti")


def merge_parts(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., merged): markdown parts (by..., part, text) of one table, in order. Later parts lose their first two
    lines, a header and its rule, and blank lines; parts of two lines or less stay whole. Blank parts are left out."""
    real = parts.where(~blank(F.col("text"))).withColumn("lines", F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), "\n"))
    first = F.row_number().over(W.partitionBy(*by).orderBy("part")) == 1
    rest = F.when(F.size("lines") > 2, F.filter(F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(1))), lambda x: ~blank(x))).otherwise(F.col("lines"))
    cut = real.withColumn("piece", F.when(first, F.col("text")).otherwise(F.array_join(rest, "\n")))
    return cut.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), "\n").alias("merged"))


def agentic(signal: str, query_type: str) -> bool:
    """Whether a pass goes by tool calls: when more was asked for, and for schedules."""
    return signal == "need_more" or query_type == "soa"
