"""The engine's three entry points over tables of many documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULT, Config
from quire.operators import audit as A
from quire.operators import epub, render
from quire.operators import lines as L
from quire.operators import regions as G
from quire.operators import sections as S
from quire.operators import segment
from quire.plans.lineage import cut
from quire.sources import files


def inspect(lines: DataFrame, regions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, json: sizes, furniture, lines and regions of every document."""
    return files.inventory_json(lines, regions, G.furniture_keys(lines, config), L.body_size(lines, config))


def elements(lines: DataFrame, regions: DataFrame, drawings: DataFrame | None = None, config: Config = DEFAULT, cover: bool = True) -> DataFrame:
    """Elements in reading order; with ``cover``, page 1 and the skipped pages hold none.

    Lines may carry ranges of styles (see lines.from_spans and lines.with_styles).
    """
    lines = L.without_line_overlays(lines, config)
    kept = G.without_number_overlays(G.without_furniture(lines, G.furniture_keys(lines, config), config), config)
    if drawings is not None:
        kept = G.boxed(kept, G.question_boxes(drawings, lines, config), config)
    kept = segment.caps_pairs(G.outside_regions(kept, regions, config), config)
    skipped = [*config.skip_pages, *([1] if cover else [])]
    if skipped:
        kept, regions = kept.filter(~F.col("page").isin(*skipped)), regions.filter(~F.col("page").isin(*skipped))
    return segment.merged_across_pages(segment.merged_in_page(segment.units(kept, G.distinct_regions(regions, config), config), config), config)


def convert(lines: DataFrame, regions: DataFrame, drawings: DataFrame | None = None, tables: DataFrame | None = None, config: Config = DEFAULT, css: str = "body{}", cover: bool = True, images: DataFrame | None = None) -> dict[str, DataFrame]:
    """All results of a conversion, each as a lazy table over elements that are computed once.

    ``tables`` (doc_id, page, ord, rows) and ``images`` (doc_id, page, ord, filename,
    caption, data) are numbered as their regions are.
    """
    read = cut(elements(lines, regions, drawings, config, cover))
    sectioned = S.sections(read)
    meta = S.metadata(lines, G.furniture_keys(lines, config), config=config)
    books = cut(epub.packages(render.documents(sectioned, tables=tables, images=images), S.contents(sectioned), S.page_list(sectioned), meta, css, images))
    warnings = S.warnings(read, tables)
    parts = [A.of_lines(lines, G.furniture_keys(lines, config), config), A.of_regions(regions), *([A.of_tables(tables)] if tables is not None else [])]
    counters = A.whole(lines, *parts, S.metrics(read))
    return {
        "elements": read, "sections": sectioned, "metadata": meta, "packages": books, "warnings": warnings, "counters": counters, "report": A.report(counters, warnings), "suspicious": S.suspicious(read),
        "metrics": S.metrics(read), "verdicts": epub.verdicts(books),
    }


def validate(packages: DataFrame, external: DataFrame | None = None, config: Config = DEFAULT) -> dict[str, DataFrame]:
    """Findings, verdicts and reports of packages (doc_id, epub)."""
    found, verdicts = epub.findings(epub.entries(packages), config.plain_phrases), epub.verdicts(packages, external)
    return {"findings": found, "verdicts": verdicts, "report": A.validation_report(found, verdicts)}
