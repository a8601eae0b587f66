"""Page furniture, tables, images and question boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import DEFAULT, Config
from quire.functions import geometry
from quire.functions import patterns as P
from quire.functions.text import norm_key, ws

PAGE = ["doc_id", "page"]


def furniture_keys(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, key, pages, ratio: texts that repeat in the header or footer band."""
    band = (F.col("y0") <= config.page_height * config.header_band) | (F.col("y1") >= config.page_height * (1 - config.footer_band))
    keyed = lines.withColumn("key", norm_key(F.col("text")))
    total = lines.groupBy("doc_id").agg(F.max("page").alias("total"))
    seen = keyed.filter(band & F.char_length("key").between(1, config.furniture_key_length)).groupBy("doc_id", "key").agg(F.count_distinct("page").alias("pages"))
    ratio = F.col("pages") / F.greatest(F.col("total") - 2, F.lit(1))
    return seen.join(total, "doc_id").withColumn("ratio", ratio).filter(F.col("ratio") >= config.furniture_ratio).select("doc_id", "key", "pages", "ratio")


def without_furniture(lines: DataFrame, keys: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Lines whose text is no furniture and matches no drop pattern; rights notices are tagged only."""
    keyed = lines.withColumn("key", norm_key(F.col("text")))
    kept = keyed.join(keys.select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    for p in config.drop_patterns:
        kept = kept.filter(~F.col("key").rlike(f"^(?:{p})"))
    if config.rights_patterns:
        kept = kept.withColumn("rights_notice", F.col("key").rlike("^(?:" + "|".join(config.rights_patterns) + ")"))
    return kept.drop("key")


def table_pages(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pages worth the cost of a table finder: forced ones and those with a keyword."""
    forced = F.col("page").isin(*config.table_pages) if config.table_pages else F.lit(False)
    return lines.filter(F.col("text").rlike(P.TABLE_KEYWORDS) | forced).select(*PAGE).distinct()


def accepted_tables(tables: DataFrame) -> DataFrame:
    return tables.filter((F.size("rows") >= 2) & (F.array_max(F.transform("rows", lambda r: F.size(r))) >= 2))


def large_images(images: DataFrame, config: Config = DEFAULT) -> DataFrame:
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return images.filter(area >= config.image_min_area * config.page_width * config.page_height)


def outside(lines: DataFrame, regions: DataFrame, share: float) -> DataFrame:
    """Rows that no region of their page covers beyond a share of their own area."""
    l, r = lines.alias("l"), regions.alias("r")
    hit = (F.col("l.doc_id") == F.col("r.doc_id")) & (F.col("l.page") == F.col("r.page")) & (geometry.overlap(geometry.of("l."), geometry.of("r.")) > share)
    return l.join(r, hit, "left_anti")


def outside_regions(lines: DataFrame, regions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return outside(lines, regions, config.region_overlap)


def images_outside_tables(images: DataFrame, tables: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return outside(images, tables, config.image_in_table)


def page_regions(tables: DataFrame, images: DataFrame, pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Regions of every page: doc_id, page, ord, kind, x0, y0, x1, y1, caption.

    Tables of two rows and two columns at least; images that are large enough and
    outside of them, numbered from 1000; the image regions of the settings, numbered
    from 5000, on the ``pages`` (doc_id, page) they name.  Nearly equal ones once.
    """
    side = [F.col(c).cast("double").alias(c) for c in geometry.SIDES]
    kept = accepted_tables(tables)
    seen = images_outside_tables(large_images(images, config), kept, config)
    caption = F.col("caption") if "caption" in images.columns else F.lit(None).cast("string")
    out = kept.select(*PAGE, F.col("ord").cast("int").alias("ord"), F.lit("table").alias("kind"), *side, F.lit(None).cast("string").alias("caption"))
    shown = seen.select(*PAGE, (F.col("ord") + 1000).cast("int").alias("ord"), F.lit("image").alias("kind"), *side, caption.alias("caption"))
    if config.image_regions:
        one = lambda k, box, text: F.struct(F.lit(5000 + k).alias("ord"), *[F.lit(float(v)).alias(c) for c, v in zip(geometry.SIDES, box)], F.lit(text).alias("caption"))
        for page in {p for p, *_ in config.image_regions}:
            extra = F.array(*[one(k, box, text) for k, (p, box, text) in enumerate(config.image_regions) if p == page])
            added = pages.filter(F.col("page") == page).select(*PAGE).distinct().select(*PAGE, F.explode(extra).alias("r"))
            shown = shown.unionByName(added.select(*PAGE, "r.ord", F.lit("image").alias("kind"), *[f"r.{c}" for c in geometry.SIDES], "r.caption"))
    return out.unionByName(distinct_regions(shown, config).select(out.columns))


def distinct_regions(regions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Regions by (y, x); one that nearly equals a kept region goes."""
    fields = [c for c in regions.columns if c not in PAGE]
    row = F.struct(F.col("y0").alias("by_"), F.col("x0").alias("at_"), *fields)
    pages = regions.groupBy(*PAGE).agg(F.array_sort(F.collect_list(row)).alias("all"))
    side = lambda v: tuple(v[k] for k in geometry.SIDES)

    def fold(kept: Column, s: Column) -> Column:
        near = F.exists(kept, lambda p: (geometry.overlap(side(p), side(s)) > config.region_mutual) & (geometry.overlap(side(s), side(p)) > config.region_mutual))
        return F.when(near, kept).otherwise(F.concat(kept, F.array(s)))

    return pages.select(*PAGE, F.inline(F.aggregate("all", F.slice("all", 1, 0), fold))).drop("by_", "at_")


def question_boxes(drawings: DataFrame, lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Blue outlines of box shape that hold the centre of a line; nearly equal ones once."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    blue = (F.col("b") > F.col("r") + 0.08) & (F.col("b") > F.col("g") + 0.08) & (F.col("b") > 0.12)
    fits = F.col("has_curve") & w.between(120.0, 0.95 * config.page_width) & h.between(18.0, 110.0) & F.col("width").between(0.4, 2.0) & blue
    d, l = drawings.filter(fits).alias("d"), lines.alias("l")
    held = d.join(l, (F.col("d.doc_id") == F.col("l.doc_id")) & (F.col("d.page") == F.col("l.page")) & _centre("l.", "d.", config.box_tolerance), "left_semi")
    first = Window.partitionBy(*PAGE, *geometry.box_key(geometry.of(), 1.0)).orderBy("ord")
    return held.withColumn("n_", F.row_number().over(first)).filter("n_ = 1").select(*PAGE, "ord", *geometry.SIDES)


def _centre(line: str, box: str, tolerance: float) -> Column:
    x, y = (F.col(line + "x0") + F.col(line + "x1")) / 2, (F.col(line + "y0") + F.col(line + "y1")) / 2
    return x.between(F.col(box + "x0") - tolerance, F.col(box + "x1") + tolerance) & y.between(F.col(box + "y0") - tolerance, F.col(box + "y1") + tolerance)


def boxed(lines: DataFrame, boxes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Lines with ``box``: the first box of their page that holds their centre, if no rule excludes them."""
    l, b = lines.alias("l"), boxes.alias("b")
    free = F.lit(True)
    for page, pattern in config.box_exclusions:
        rule = F.col("l.text").rlike(f"^(?:{pattern})$")
        free = free & ~(rule if page is None else rule & (F.col("l.page") == page))
    hit = (F.col("l.doc_id") == F.col("b.doc_id")) & (F.col("l.page") == F.col("b.page")) & _centre("l.", "b.", config.box_tolerance) & free
    inside = l.join(b, hit).groupBy("l.doc_id", "l.page", "l.ord").agg(F.min("b.ord").alias("box"))
    return lines.join(inside, ["doc_id", "page", "ord"], "left")


def edge_audit(tables: DataFrame, lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Tables with several short tokens just left of them: a column may be missing."""
    t, l = tables.alias("t"), lines.alias("l")
    middle = (F.col("l.y0") + F.col("l.y1")) / 2
    hit = (F.col("t.doc_id") == F.col("l.doc_id")) & (F.col("t.page") == F.col("l.page")) & middle.between(F.col("t.y0"), F.col("t.y1")) & (F.col("l.x1") < F.col("t.x0") - config.edge_gap)
    text = ws(F.col("l.text"))
    near = t.join(l, hit).select("t.doc_id", "t.page", F.col("t.ord").alias("ord"), F.col("l.ord").alias("line"), text.alias("token"))
    near = near.filter((F.char_length("token") <= config.edge_token_length) & F.col("token").rlike(P.EDGE_TOKEN))
    tokens = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("line", "token"))), lambda r: r["token"]), 1, 8)
    return near.groupBy("doc_id", "page", "ord").agg(F.count(F.lit(1)).alias("n_tokens"), F.array_join(tokens, "|").alias("tokens")).filter(F.col("n_tokens") >= config.edge_tokens)


def repaired_tables(tables: DataFrame) -> DataFrame:
    """Empty cells filled from the first table of the document with the same shape.

    A donor must agree in every cell that both have, in at least one such cell,
    and fill at least one gap; donors are taken as they came, in page order.
    """
    shape = F.array_join(F.transform("rows", lambda r: F.size(r).cast("string")), ",")
    t = tables.withColumn("shape", shape)
    flat = F.flatten(F.transform("rows", lambda r: F.transform(r, lambda c: F.nullif(ws(F.coalesce(c, F.lit(""))), F.lit("")))))
    t = t.withColumn("cells", flat)
    a, b = t.alias("a"), t.alias("b")
    pairs = F.arrays_zip(F.col("a.cells").alias("p"), F.col("b.cells").alias("q"))
    agree = F.forall(pairs, lambda z: z["p"].isNull() | z["q"].isNull() | (z["p"] == z["q"])) & F.exists(pairs, lambda z: z["p"] == z["q"])
    fills = F.exists(pairs, lambda z: z["p"].isNull() & z["q"].isNotNull())
    other = (F.col("a.page") != F.col("b.page")) | (F.col("a.ord") != F.col("b.ord"))
    gaps = a.filter(F.exists("a.cells", lambda c: c.isNull()))
    found = gaps.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.shape") == F.col("b.shape")) & other & agree & fills)
    donor = found.groupBy("a.doc_id", "a.page", "a.ord").agg(F.min_by(F.col("b.cells"), F.struct("b.page", "b.ord")).alias("donor"), F.min(F.struct("b.page", "b.ord"))["page"].alias("donor_page"))
    out = t.join(donor, ["doc_id", "page", "ord"], "left")
    filled = F.when(F.col("donor").isNull(), F.col("cells")).otherwise(F.zip_with("cells", "donor", lambda p, q: F.coalesce(p, q)))
    return out.select("doc_id", "page", "ord", "shape", F.transform(filled, lambda c: F.coalesce(c, F.lit(""))).alias("cells"), "donor_page")


def without_number_overlays(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Drop a lone number beside a much wider line that starts with the same number."""
    a, b = lines.alias("a"), lines.select(*PAGE, "ord", "text", *geometry.SIDES).alias("b")
    number = F.regexp_extract(F.col("a.text"), r"^([0-9]{3}[.]?)$", 1)
    hit = (
        (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.ord") != F.col("b.ord")) & (number != "")
        & (F.abs(F.col("a.y0") - F.col("b.y0")) < config.number_dy) & F.startswith(F.col("b.text"), number)
        & (F.col("b.x1") - F.col("b.x0") > config.number_wider * (F.col("a.x1") - F.col("a.x0")))
    )
    return a.join(b, hit, "left_anti")
