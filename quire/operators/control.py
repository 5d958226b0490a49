"""State, signals, routing and knowledge search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_CYCLES = 2
# What a review may flag, and how gravely.
SIGNAL_TYPES = ("hallucination", "completeness", "consistency", "plausibility")
SEVERITIES = ("critical", "major", "minor")
DONE, NEED_MORE = "done", "need_more"
FAILURES_SHOWN = 10
DEPTH, MATCHES = 4, 5


def upsert(current: DataFrame, update: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of update in place of those of current with equal keys; the others of both. Null keys are keys."""
    version = F.when(F.col("_new"), 1).otherwise(0)
    both = current.withColumn("_new", F.lit(False)).unionByName(update.withColumn("_new", F.lit(True)))
    rest = [c for c in current.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def append(current: DataFrame, more: DataFrame) -> DataFrame:
    """Both, in no order."""
    return current.unionByName(more)


def known_signals(signals: DataFrame) -> DataFrame:
    """Signals (signal_type, severity, ...) of a known type and severity; the others are refused."""
    return signals.where(F.col("signal_type").isin(*SIGNAL_TYPES) & F.col("severity").isin(*SEVERITIES))


def next_signal(signals: DataFrame, by: list[str], cycle: Column, max_cycles: int = MAX_CYCLES) -> DataFrame:
    """(by..., signals, edge): need_more if a signal of this pass is critical and cycles are left. cycle is a column of signals."""
    seen = known_signals(signals).withColumn("_cycle", cycle).groupBy(*by).agg(
        F.count("*").alias("signals"), F.max(F.col("severity") == "critical").alias("_critical"), F.max("_cycle").alias("_cycle")
    )
    return seen.select(*by, "signals", F.when(F.col("_critical") & (F.col("_cycle") < max_cycles), NEED_MORE).otherwise(DONE).alias("edge"))


def route_after_extraction(has_data: bool) -> str:
    """W7."""
    return "review" if has_data else "end"


def route_after_review(edge: str, cycle: int, max_cycles: int = MAX_CYCLES) -> str:
    """Another pass only while cycles are left, so at most max_cycles + 1 passes."""
    return "explore" if edge == NEED_MORE and cycle < max_cycles else "end"


def digest(checked: DataFrame, by: list[str], cross_field: DataFrame | None = None) -> DataFrame:
    """(by..., text): the counts, up to ten failures in their order, and what fields contradict each other.

    checked has nr, item and verdict; cross_field, if any, (by..., issue).
    """
    failed = F.col("verdict").startswith("FAILED")
    line = F.concat(F.lit("  "), "item", F.lit(": "), "verdict")
    # Ranked before they are collected: tasks send on no more than the first few of each group.
    nth = F.row_number().over(W.partitionBy(*by).orderBy("nr", "t"))
    first = checked.where(failed).select(*by, "nr", line.alias("t")).withColumn("nth", nth).where(F.col("nth") <= FAILURES_SHOWN)
    lines = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("nth", "t"))).alias("lines"))
    sums = checked.groupBy(*by).agg(F.count_if(F.col("verdict") == "VERIFIED").alias("v"), F.count("*").alias("n"), F.count_if(failed).alias("f")).join(lines, by, "left")
    head = F.concat(F.lit("Verified: "), "v", F.lit("/"), "n", F.lit(", Failed: "), "f")
    shown = F.coalesce(F.transform("lines", lambda x: x["t"]), F.array().cast("array<string>"))
    parts = F.concat(F.array(head), shown)
    if cross_field is not None:
        sums = sums.join(cross_field.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("issue")), "; ").alias("x")), by, "left")
        parts = F.concat(parts, F.when(F.coalesce("x", F.lit("")) != "", F.array(F.concat(F.lit("Cross-field issues: "), "x"))).otherwise(F.array().cast("array<string>")))
    return sums.select(*by, F.array_join(parts, "\n").alias("text"))


def flatten_tree(tree, depth: int = DEPTH) -> list[tuple[int, str, str, object]]:
    """(ord, path, key, value) of a knowledge tree, depth first; strings in lists have no key. depth levels deep."""
    rows: list[tuple[int, str, str, object]] = []

    def walk(node, path: str, left: int) -> None:
        if left <= 0:
            return
        pairs = node.items() if isinstance(node, dict) else enumerate(node)
        for key, value in pairs:
            here = f"{path}[{key}]" if isinstance(node, list) else f"{path}.{key}" if path else key
            if isinstance(node, dict) or isinstance(value, str):
                rows.append((len(rows), here, key if isinstance(node, dict) else "", value))
            if isinstance(value, (dict, list)):
                walk(value, here, left - 1)

    walk(tree, "", depth)
    return rows


def search(flat: DataFrame, term: Column, by: list[str], most: int = MATCHES) -> DataFrame:
    """Rows of flattened trees (by..., ord, path, key, value; value null if no text) whose key or text holds the term,
    in any case: (by..., path, value, nth) of the first `most`."""
    low = F.lower(term)
    hit = F.lower("key").contains(low) | F.coalesce(F.lower("value").contains(low), F.lit(False))
    listed = F.array_sort(F.collect_list(F.struct("ord", "path", "value")))
    found = flat.where(hit).groupBy(*by).agg(F.slice(listed, 1, most).alias("m"))
    return found.select(*by, F.posexplode("m").alias("nth", "_m")).select(*by, "_m.path", "_m.value", (F.col("nth") + 1).alias("nth"))
