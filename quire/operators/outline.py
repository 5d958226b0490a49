"""Structure of whole documents: section ranges, routing, continued tables, abbreviations, references, outline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.operators.store import natural_key

MERGED_CONFIDENCE, CONTINUED = 0.92, 0.85
RULED_LINES = 8

# Words in a title that tell a section's domain, tried in this order.
DOMAIN_KEYWORDS = {
    "endpoints": ["endpoint", "objective", "efficacy"],
    "eligibility": ["eligib", "inclusion", "exclusion", "population"],
    "soa": ["schedule", "activities", "event", "visit", "appendix 1"],
    "safety": ["safety", "adverse", "aesi", "monitoring", "stopping"],
    "statistical": ["statistic", "analysis", "sample size", "power"],
    "study_design": ["design", "rationale", "phase", "randomiz", "blind"],
    "intervention": ["intervention", "treatment", "dosage", "dose", "drug", "vaccine"],
    "overview": ["synopsis", "summary", "overview", "introduction"],
    "regulatory": ["regulatory", "ethical", "irb", "consent", "compliance"],
    "administrative": ["abbrevi", "definition", "reference", "appendix"],
}


def section_ranges(starts: DataFrame, by: list[str], last_page: Column) -> DataFrame:
    """Starts (by..., section_id, start_page, ord) with end_page: where the next section begins, less one, but not before
    the start; the last section ends with the document."""
    order = W.partitionBy(*by).orderBy("start_page", "ord")
    following = F.lead("start_page").over(order)
    return starts.withColumn("end_page", F.greatest(F.col("start_page"), F.coalesce(following - 1, last_page)))


def tables_in_ranges(ranges: DataFrame, table_pages: DataFrame, by: list[str]) -> DataFrame:
    """(by..., section_id, table_id) of tables (by..., table_id, page) on a page of a section, each pair once: pages are
    spelt out, so that the range join is an equi join."""
    spread = ranges.select(*by, "section_id", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    return spread.join(table_pages, [*by, "page"]).select(*by, "section_id", "table_id").distinct()


def domain(title: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """The domain with the most of its keywords in a title, the earlier on ties; null with none."""
    low = F.lower(title)
    counts = [F.struct(sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate((keywords or DOMAIN_KEYWORDS).items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["name"])


def continuations(tables: DataFrame, by: list[str]) -> DataFrame:
    """D3: tables (by..., page, ord, headers, rows) with the island they belong to: a table goes on one of the page before
    that is followed by it and has the same headers."""
    order = W.partitionBy(*by).orderBy("page", "ord")
    follows = (F.col("page") == F.lag("page").over(order) + 1) & F.col("headers").eqNullSafe(F.lag("headers").over(order))
    return tables.withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("_new").over(order)).drop("_new")


def merge_continuations(tables: DataFrame, by: list[str]) -> DataFrame:
    """D3: (by..., island, first_page, last_page, n_pages, rows, merged, confidence); each page gone on to costs confidence."""
    islands = continuations(tables, by)
    listed = F.array_sort(F.collect_list(F.struct("page", "ord", "rows")))
    grouped = islands.groupBy(*by, "island").agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_pages"),
        F.flatten(F.transform(listed, lambda x: x["rows"])).alias("rows"),
    )
    return grouped.withColumn("merged", F.col("n_pages") > 1).withColumn("confidence", F.lit(MERGED_CONFIDENCE) * F.pow(F.lit(CONTINUED), F.col("n_pages") - 1))


def missing_categories(expected: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Expected (by..., category) that were not found."""
    return expected.join(found.select(*by, "category").distinct(), [*by, "category"], "left_anti")


def abbreviations(texts: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """(by..., abbreviation, expansion): capitals in brackets after as many words, the first expansion that fits.

    The expansion is the words before the bracket, one for each letter, that begin with the letters.
    """
    found = texts.select(*by, F.explode(F.expr(rf"regexp_extract_all({text_col}, '((?:[A-Za-z-]+ ){{2,8}}\\([A-Z]{{2,8}}\\))', 1)")).alias("hit"))
    short = F.regexp_extract("hit", r"\(([A-Z]+)\)", 1)
    before = F.split(F.trim(F.regexp_replace("hit", r"\([A-Z]+\)", "")), "[ -]+")
    cut = F.slice(before, F.greatest(F.size(before) - F.length(short) + 1, F.lit(1)), F.length(short))
    initials = F.upper(F.array_join(F.transform(cut, lambda w: F.substring(w, 1, 1)), ""))
    named = found.select(*by, short.alias("abbreviation"), F.array_join(cut, " ").alias("expansion"), initials.alias("initials"))
    return named.where("initials = abbreviation").groupBy(*by, "abbreviation").agg(F.min("expansion").alias("expansion"))


def cross_references(texts: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """(by..., kind, target, mentions) of sections, appendices and tables that texts name."""
    patterns = {"section": r"Section\s+([0-9]+(?:\.[0-9]+)*)", "appendix": r"Appendix\s+([A-Z]|[0-9]+)\b", "table": r"Table\s+([0-9]+)"}

    def targets(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("target")))

    each = [targets(k, p) for k, p in patterns.items()]
    spread = texts.select(*by, F.explode(F.concat(*each)).alias("r"))
    return spread.groupBy(*by, F.col("r.kind").alias("kind"), F.col("r.target").alias("target")).agg(F.count("*").alias("mentions"))


def page_verdict(lines: Column) -> Column:
    """Whether a page's ruled lines ask for table extraction. The cut fits one sample document and no more."""
    return F.when(lines >= RULED_LINES, "USE_PDFPLUMBER").otherwise("SUFFICIENT")


def outline(section_rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., position, depth, line): sections in natural order, set in by two for each level of their number."""
    depth = F.size(F.split("section_id", "\\.")) - 1
    line = F.concat(F.repeat(F.lit("  "), depth), F.lit("- **"), "section_id", F.lit("** "), "title")
    order = W.partitionBy(*by).orderBy(natural_key(F.col("section_id")), "section_id")
    return section_rows.select(*by, F.row_number().over(order).alias("position"), depth.alias("depth"), line.alias("line"))
