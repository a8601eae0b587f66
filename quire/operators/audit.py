"""The audit: counters of what a conversion removed, found, merged and kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULT, Config
from quire.functions.colour import colour_class
from quire.functions.text import norm_key, ws
from quire.operators import lines as L
from quire.operators import regions as G
from quire.operators import sections as S

#: Counters that every document has, with 0 where nothing was counted.
ALWAYS = ("duplicate_spans_removed", "repeated_furniture_removed", "regex_furniture_removed", "images_rendered", "tables_detected", "table_cells_repaired", "question_box_line_exclusions_applied")


def _count(df: DataFrame, name) -> DataFrame:
    metric = F.lit(name) if isinstance(name, str) else name
    return df.groupBy("doc_id", metric.alias("metric")).agg(F.count(F.lit(1)).alias("value"))


def of_lines(lines: DataFrame, keys: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Lines that go as furniture: repeated ones, and those that only a pattern names."""
    keyed = lines.withColumn("key", norm_key(F.col("text"))).join(keys.select("doc_id", "key", F.lit(True).alias("again")), ["doc_id", "key"], "left")
    out = _count(keyed.filter("again"), "repeated_furniture_removed")
    if config.drop_patterns:
        named = reduce(lambda a, b: a | b, [F.col("key").rlike(f"^(?:{p})") for p in config.drop_patterns])
        out = out.unionByName(_count(keyed.filter(F.col("again").isNull() & named), "regex_furniture_removed"))
    return out


def of_regions(regions: DataFrame) -> DataFrame:
    return _count(regions, F.when(F.col("kind") == "table", "tables_detected").otherwise("images_rendered"))


def of_tables(tables: DataFrame) -> DataFrame:
    """Empty cells that a donor filled."""
    flat = F.flatten(F.transform("rows", lambda r: F.transform(r, lambda c: ws(F.coalesce(c, F.lit(""))) == "")))
    fixed = G.repaired_tables(tables).filter("donor_page is not null").select("doc_id", "page", "ord", "cells")
    both = tables.select("doc_id", "page", "ord", flat.alias("empty")).join(fixed, ["doc_id", "page", "ord"])
    n = F.size(F.filter(F.arrays_zip("empty", "cells"), lambda z: z["empty"] & (z["cells"] != "")))
    return both.groupBy("doc_id").agg(F.sum(n).cast("long").alias("value")).select("doc_id", F.lit("table_cells_repaired").alias("metric"), "value")


def of_spans(spans: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Repeated spans, and coloured ones by class."""
    first = L.distinct_spans(spans, config).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))
    every = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(first, "doc_id")
    removed = every.select("doc_id", F.lit("duplicate_spans_removed").alias("metric"), (F.col("n") - F.col("kept")).alias("value"))
    tinted = L.distinct_spans(spans, config).withColumn("css_class", colour_class(F.col("color"), config)).filter("css_class is not null")
    return removed.unionByName(_count(tinted, "chromatic_spans_seen")).unionByName(_count(tinted, F.concat(F.lit("color_class:"), "css_class")))


def of_styles(units: DataFrame, name: str, seen: DataFrame) -> DataFrame:
    """Ranges of a style column that were seen on lines (doc_id, one row each), kept in units, and lost."""
    kept = units.groupBy("doc_id").agg(F.sum(F.size(name)).cast("long").alias("kept"))
    both = seen.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(kept, "doc_id", "left").withColumn("kept", F.least(F.coalesce("kept", F.lit(0)), F.col("n")))
    stem = {"color_ranges": "chromatic_spans", "bold_ranges": "bold_runs", "italic_ranges": "italic_runs"}[name]
    pairs = F.array(*[F.struct(F.lit(f"{stem}_{k}").alias("metric"), v.alias("value")) for k, v in (("preserved", F.col("kept")), ("discarded", F.col("n") - F.col("kept")))])
    return both.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.*")


def of_exclusions(lines: DataFrame, boxes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Lines in a box that a rule keeps out of it."""
    free = G.boxed(lines, boxes, config).filter("box is null").select("doc_id", "page", "ord")
    held = G.boxed(lines, boxes, Config()).filter("box is not null").select("doc_id", "page", "ord")
    return _count(held.join(free, ["doc_id", "page", "ord"]), "question_box_line_exclusions_applied")


def of_elements(in_page: DataFrame, elements: DataFrame) -> DataFrame:
    """Merges within and across pages, and the markers of lists."""
    joined = in_page.groupBy("doc_id").agg(F.sum(F.col("n_units") - 1).cast("long").alias("value")).select("doc_id", F.lit("semantic_continuations_merged").alias("metric"), "value")
    across = elements.groupBy("doc_id").agg(F.sum(F.size("page_breaks")).cast("long").alias("value")).select("doc_id", F.lit("cross_page_continuations_merged").alias("metric"), "value")
    lists = elements.filter(F.col("kind").isin("bullet", "dash"))
    return joined.unionByName(across).unionByName(_count(lists, F.concat(F.lit("list_marker:"), S.list_marker())))


def whole(documents: DataFrame, *parts: DataFrame) -> DataFrame:
    """doc_id, metric, value of all parts; the fixed counters are 0 where nothing was counted."""
    zero = documents.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(m) for m in ALWAYS])).alias("metric"), F.lit(0).cast("long").alias("value"))
    return reduce(DataFrame.unionByName, [zero, *[p.select("doc_id", "metric", F.col("value").cast("long").alias("value")) for p in parts]]).groupBy("doc_id", "metric").agg(F.sum("value").alias("value"))


def report(counters: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """doc_id, json: one audit report per document, counters in order of name, then the warnings."""
    each = counters.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("counters"))
    if warnings is None:
        return each.select("doc_id", F.to_json(F.struct("counters")).alias("json"))
    found = warnings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "type", "details"))).alias("warnings"))
    return each.join(found, "doc_id", "left").select("doc_id", F.to_json(F.struct("counters", "warnings")).alias("json"))


def validation_report(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """doc_id, json: one validation report per package."""
    rules = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", "rule"))).alias("errors"))
    return verdicts.join(rules, "doc_id", "left").select("doc_id", F.to_json(F.struct("status", "n_errors", "errors")).alias("json"))
