"""Classification of lines and segmentation into units.

The units of a page follow a state machine.  Here it is two passes of window
functions over (document, page): hard starts, which no state can change, cut the
page into segments; within a segment the rule of its kind gives the first soft
break, after which plain paragraph rules hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import DEFAULT, Config
from quire.functions import patterns as P
from quire.functions import ranges as R
from quire.functions.text import join_lines, join_two, ws
from quire.operators import lines as L

PAGE = ["doc_id", "page"]
LISTS = ("bullet", "dash")
MERGING = ("p", "alternative", "roman", "question", "legal", "bullet", "dash")
CROSSING = ("p", "bullet", "dash", "question", "alternative", "roman", "legal", "legal-item", "callout", "question-callout")
REGIONS = ("image", "table")


def kinds(lines: DataFrame) -> DataFrame:
    """Adds kind, marker and rest of the ordered marker rules; null kind: no marker."""
    t, kind, first = F.col("text"), F.col("kind"), F.left("text", F.lit(1))
    rules = {
        "question": ("0123456789", P.QUESTION), "alternative": ("abcdeABCDE", P.ALTERNATIVE), "roman": ("IVXLCDM", P.ROMAN), "bullet": (P.BULLETS, P.BULLET), "dash": (P.DASHES, P.DASH),
        "legal": ("aA", P.ARTICLE), "legal-item": ("§pP", P.LEGAL_ITEM), "answer": ("lLcCeE", P.ANSWER), "call-inline": ("dDeEoOaAiI", P.CALL_INLINE), "call-label": ("dDeEoOaAiI", P.CALL_LABEL),
    }
    # Most lines fail on their first character, before any pattern is tried.
    named = F
    for name, (starts, pattern) in rules.items():
        named = named.when(first.isin(*starts) & t.rlike(pattern), name)
    group = lambda name, k: F.regexp_extract(t, rules[name][1], k)
    marker = (
        F.when(kind == "question", F.concat(group("question", 1), F.lit(".")))
        .when(kind == "alternative", F.concat(F.lower(group("alternative", 1)), F.lit(")")))
        .when(kind == "roman", F.concat(group("roman", 1), F.lit(" –")))
        .when(kind == "bullet", group("bullet", 1))
        .when(kind == "dash", group("dash", 1))
        .when(kind == "call-inline", F.concat(group("call-inline", 1), F.lit(":")))
        .when(kind.isNotNull(), "")
    )
    rest = F
    for name in ("question", "alternative", "roman", "bullet", "dash", "call-inline"):
        rest = rest.when(kind == name, group(name, 2))
    rest = rest.when(kind == "call-label", F.regexp_replace(t, ":+$", "")).when(kind.isNotNull(), t)
    return lines.withColumn("kind", named).withColumns({"marker": marker, "rest": rest})


def capitals(text: Column) -> Column:
    return (F.upper(text) == text) & text.rlike(P.CAPITAL)


def heading_level(config: Config = DEFAULT) -> Column:
    """0 or the level, from text, size, bold_ratio and body_size."""
    t, ratio = F.col("text"), F.col("size") / F.col("body_size")
    level = F.when((t == "") | (F.char_length(t) > config.heading_length), 0)
    for page, pattern, n in config.headings:
        level = level.when((F.col("page") == page) & t.rlike(pattern), n)
    caps = capitals(t)
    return level.when(ratio >= 1.55, 1).when((ratio >= 1.35) | (caps & (ratio >= 1.18)), 2).when((ratio >= 1.18) & ((F.col("bold_ratio") > 0.45) | caps), 3).otherwise(0)


def headings(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Lines with ``level`` above 0."""
    return lines.join(L.body_size(lines, config), "doc_id").withColumn("level", heading_level(config)).filter("level > 0")


def caps_pairs(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Join a heading in capitals that is set on two lines; pairs only, from the top.

    Other columns are those of the first line.
    """
    own = ("doc_id", "page", "ord", "text", "x0", "y0", "x1", "y1", "size", "bold_ratio")
    rest = [F.min_by(c, F.struct("y0", "x0", "ord")).alias(c) for c in lines.columns if c not in own]
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "ord")
    before = lambda c: F.lag(c).over(order)
    caps = capitals(F.col("text"))
    gap = F.col("y0") - before("y1")
    near = (F.abs(F.col("size") - before("size")) <= 0.35) & (F.abs(F.col("x0") - before("x0")) <= 24.0) & gap.between(-1.0, 4.0)
    both = caps & F.lag(caps).over(order) & near & (F.char_length("text") + F.char_length(before("text")) < 150)
    linked = lines.withColumn("link_", F.coalesce(both, F.lit(False)))
    island = linked.withColumn("island_", F.sum((~F.col("link_")).cast("int")).over(order))
    nth = F.row_number().over(Window.partitionBy(*PAGE, "island_").orderBy("y0", "x0", "ord")) - 1
    dealt = island.withColumn("pair_", F.floor(nth / 2))
    parts = F.array_sort(F.collect_list(F.struct("y0", "x0", "ord", "text")))
    return dealt.groupBy(*PAGE, "island_", "pair_").agg(
        F.min("ord").alias("ord"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max("size").alias("size"), F.max("bold_ratio").alias("bold_ratio"), *rest,
    ).drop("island_", "pair_")


def indented(config: Config = DEFAULT) -> Column:
    """A new paragraph by its indent or by the gap above it (columns x0, gap, page_left, line_height)."""
    return (F.col("x0") >= F.col("page_left") + config.indent) | (F.col("gap") > config.gap_plain * F.col("line_height"))


def _sized(lines: DataFrame, config: Config) -> DataFrame:
    """Lines with body_size, page_left and line_height, by windows: one exchange on the document."""
    whole, page = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "page")
    running = F.col("size").between(config.body_size_low, config.body_size_high) & (F.char_length("text") > config.body_text_length)
    sized = lines.withColumn("body_size", F.coalesce(F.median(F.when(running, F.col("size"))).over(whole), F.lit(config.body_size_default)))
    fits = (F.char_length("text") > config.left_length) & (F.col("size") <= config.left_size * F.col("body_size"))
    sized = sized.withColumn("page_left", F.coalesce(F.min(F.when(fits, F.bround("x0"))).over(page), F.lit(config.left_default)))
    return sized.withColumn("line_height", F.greatest(F.lit(config.line_min), config.line_factor * F.col("body_size")))


def paragraph_islands(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, page, para, n_lines, text: plain paragraphs by indent and gap alone."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "ord")
    s = _sized(lines, config).withColumn("gap", F.col("y0") - F.lag("y1").over(order))
    s = s.withColumn("start", F.lag("ord").over(order).isNull() | indented(config)).withColumn("para", F.sum(F.col("start").cast("int")).over(order))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("y0", "ord", "text"))), lambda p: p["text"])
    return s.groupBy(*PAGE, "para").agg(F.count(F.lit(1)).alias("n_lines"), join_lines(parts).alias("text"))


def units(lines: DataFrame, regions: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """Units of every page: doc_id, page, unit, kind, level, marker, text, x0, y0, n_lines, region.

    ``lines`` may carry ``box`` (see regions.boxed) and ranges of styles, which are
    found again in the joined text.  Regions become units of their kind with an
    empty text and the region's number.  Labels without content vanish.
    """
    styles = [c for c in R.STYLES if c in lines.columns]
    base = lines if "box" in lines.columns else lines.withColumn("box", F.lit(None).cast("int"))
    known = kinds(_sized(base, config)).withColumn("level", heading_level(config)).withColumn("is_line", F.lit(1))
    if regions is not None:
        gaps = regions.select(*PAGE, "ord", "kind", "x0", "y0", "x1", "y1", F.lit(0).alias("is_line"))
        known = known.unionByName(gaps, allowMissingColumns=True)
    order = Window.partitionBy(*PAGE).orderBy("y0", "is_line", "ord")
    line, boxed = F.col("is_line") == 1, F.col("box").isNotNull()
    starter = line & ~boxed & F.col("kind").isNotNull()
    head = line & ~boxed & (F.col("level") > 0) & ~F.coalesce(F.col("kind") == "question", F.lit(False))
    asks = line & ~boxed & ~head & ~starter & F.endswith("text", F.lit("?")) & (F.char_length("text") <= config.question_length) & ((F.col("bold_ratio") > config.question_bold) | F.contains(F.lower("font"), F.lit("sans")))
    shape = F.when(~line, "region").when(boxed, "boxed").when(head, "heading").when(starter, "starter").when(asks, "asks").otherwise("plain")
    s = known.withColumn("shape", shape)
    before = F.lag("shape").over(order)
    same_box = (before == "boxed") & (F.lag("box").over(order) == F.col("box"))
    hard = F.when(F.col("shape") == "boxed", ~F.coalesce(same_box, F.lit(False))).when(F.col("shape") == "plain", before.isNull() | before.isin("region", "boxed", "heading", "asks")).otherwise(True)
    s = s.withColumns({"hard": hard, "gap": F.col("y0") - F.lag("y1").over(order), "shift": F.lag("x0").over(order) - F.col("x0")})
    s = s.withColumn("seg", F.sum(F.col("hard").cast("int")).over(order))
    own = F.when(F.col("shape").isin("boxed", "asks"), "question-callout").when(F.col("shape") == "heading", "heading").when(F.col("shape") == "plain", "p").when(F.col("kind").startswith("call-"), "callout").otherwise(F.col("kind"))
    inside = Window.partitionBy(*PAGE, "seg").orderBy("y0", "is_line", "ord")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumns({"of": F.first(own).over(whole), "first_x": F.first("x0").over(whole), "label": F.first(F.coalesce(F.col("kind") == "call-label", F.lit(False)) & (F.col("shape") == "starter")).over(whole), "nth": F.row_number().over(inside) - 1})
    h, gap, have = F.col("line_height"), F.col("gap"), F.col("nth") - F.col("label").cast("int")
    rule = (
        F.when(F.col("of").isin(*LISTS), (F.col("x0") < F.col("first_x") - config.list_outdent) | (gap > config.gap_plain * h))
        .when(F.col("of").isin("legal", "legal-item"), gap > config.gap_legal * h)
        .when(F.col("of").isin("question", "alternative", "roman"), gap > config.gap_plain * h)
        .when(F.col("of") == "callout", (have >= 1) & ((gap > config.gap_callout * h) | ((have >= 2) & (F.col("shift") > config.callout_outdent))))
        .otherwise(False)
    )
    soft = ~F.col("hard") & rule
    s = s.withColumn("after", F.max(F.coalesce(soft, F.lit(False)).cast("int")).over(whole))
    s = s.withColumn("was", F.coalesce(F.lag("after").over(inside), F.lit(0)))
    plain = F.col("of").isin("p", "answer") | (F.col("was") == 1)
    broken = F.col("hard") | (~F.col("hard") & F.when(F.col("of") == "question-callout", False).when(plain, indented(config)).otherwise((F.col("after") == 1) & (F.col("was") == 0)))
    s = s.withColumn("broken", F.coalesce(broken, F.lit(False)))
    s = s.withColumn("unit", F.sum(F.col("broken").cast("int")).over(order))
    s = s.withColumn("unit_kind", F.when(F.col("hard"), F.col("of")).when((F.col("after") == 1) | (F.col("of").isin("p", "answer") & F.col("broken")), "p"))
    body = F.when(~F.col("hard") | (F.col("shape") != "starter"), F.col("text")).when(F.col("kind") == "call-label", "").when(F.col("kind").isin("legal", "legal-item", "answer"), F.col("text")).otherwise(F.col("rest"))
    mark = F.when(F.col("hard") & (F.col("shape") == "starter"), F.when(F.col("kind") == "call-label", F.col("rest")).otherwise(F.col("marker")))
    s = s.withColumns({"body": F.coalesce(body, F.lit("")), "mark": mark})
    at = F.struct("y0", "is_line", "ord")
    # What a marker leaves is the end of its line: ranges count from there.
    lead = F.when(F.endswith("text", F.col("body")), F.char_length("text") - F.char_length("body")).otherwise(F.char_length("text"))
    s = s.withColumns({c: F.coalesce(R.clip(F.col(c), lead, F.char_length("text"), R.STYLES[c]), R.none(R.STYLES[c])) for c in styles})
    ordered = F.array_sort(F.collect_list(F.struct("y0", "is_line", "ord", "body", *styles)))
    parts = F.transform(ordered, lambda p: p["body"])
    region = F.min_by("ord", at).alias("region") if regions is not None else F.lit(None).cast("int").alias("region")
    out = s.groupBy(*PAGE, "unit").agg(
        F.min_by("unit_kind", at).alias("kind"), F.coalesce(F.max(F.when(F.col("shape") == "heading", F.col("level"))), F.lit(0)).alias("level"), F.coalesce(F.min_by("mark", at), F.lit("")).alias("marker"),
        join_lines(parts).alias("text"), F.min_by("x0", at).alias("x0"), F.min("y0").alias("y0"), F.min_by("page_left", at).alias("page_left"), F.count(F.lit(1)).alias("n_lines"),
        region, *([ordered.alias("parts_")] if styles else []),
    )
    out = out.withColumn("region", F.when(F.col("kind").isin(*REGIONS), F.col("region")))
    for c in styles:
        rows = F.transform("parts_", lambda p: F.struct(ws(p["body"]).alias("text"), p[c].alias("ranges")))  # noqa: B023
        out = out.withColumn(c, R.project(F.col("text"), rows, R.STYLES[c])["ranges"]).withColumn(c, R.normal(c, F.col("text"), F.col(c)))
    return out.drop("parts_").filter((F.col("text") != "") | F.col("kind").isin(*REGIONS))


def merged_in_page(units_: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Join units of one page that a false break has parted; adds ``n_units``.

    A paragraph continues an unfinished unit if it starts in lower case, or hangs
    right of the list item at the head of an unbroken chain.  Joined units lose
    their ranges of styles.
    """
    styles = [c for c in R.STYLES if c in units_.columns]
    extra = [c for c in ("region",) if c in units_.columns]
    order = Window.partitionBy(*PAGE).orderBy("unit")
    is_p = F.col("kind") == "p"
    s = units_.withColumns({"open": ~F.lag("text").over(order).rlike(P.TERMINAL) & (F.lag("text").over(order) != ""), "low": F.col("text").rlike(f"^[{P.LOWER}]"), "run": F.sum((~is_p).cast("int")).over(order)})
    inside = Window.partitionBy(*PAGE, "run").orderBy("unit")
    s = s.withColumns({"head": F.first("kind").over(inside), "head_x": F.first("x0").over(inside), "nth": F.row_number().over(inside) - 1})
    listed = F.col("head").isin(*LISTS)
    prior = F.coalesce(F.lag("kind").over(order).isin(*MERGING), F.lit(False))
    hang = is_p & prior & F.coalesce(F.col("open"), F.lit(False)) & (F.col("low") | (listed & (F.col("x0") >= F.col("head_x") + config.list_hanging)))
    plain = is_p & prior & F.coalesce(F.col("open"), F.lit(False)) & F.col("low")
    s = s.withColumn("hang", hang).withColumn("fail", (is_p & ~hang & F.col("head").isin(*MERGING) & (F.col("nth") > 0)).cast("int"))
    s = s.withColumn("cut", F.coalesce(F.max("fail").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("link", F.when(F.col("cut") == 0, F.col("hang")).otherwise(plain))
    s = s.withColumn("element", F.sum((~F.col("link")).cast("int")).over(order))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("unit", "text"))), lambda p: p["text"])
    first = lambda c: F.min_by(c, "unit").alias(c)
    own = [F.when(F.count(F.lit(1)) == 1, F.min_by(c, "unit")).otherwise(R.none(R.STYLES[c])).alias(c) for c in styles]
    return s.groupBy(*PAGE, "element").agg(
        first("kind"), first("level"), first("marker"), join_lines(parts).alias("text"), first("x0"), first("y0"), first("page_left"), F.count(F.lit(1)).alias("n_units"), *[first(c) for c in extra], *own
    )


def merged_across_pages(elements: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Join the first paragraph of a page to the unit that the page before left open.

    Adds seq (reading order) and page_breaks (offset, page), keeping offsets and
    ranges of styles in the joined text.
    """
    styles = [c for c in R.STYLES if c in elements.columns]
    extra = [c for c in ("region",) if c in elements.columns]
    order = Window.partitionBy("doc_id").orderBy("page", "element")
    before = lambda c: F.lag(c).over(order)
    p_here = Window.partitionBy(*PAGE)
    wide = (F.col("kind") == "p") & (F.col("x0") >= F.col("page_left") + config.indent)
    s = elements.withColumns({"tail": F.regexp_replace(F.col("text"), P.CLOSERS, ""), "indents": F.sum(wide.cast("int")).over(p_here), "wide": wide.cast("int")})
    first = F.row_number().over(Window.partitionBy(*PAGE).orderBy("element")) == 1
    may = first & (F.col("kind") == "p") & (before("page") == F.col("page") - 1) & before("kind").isin(*CROSSING) & (before("tail") != "") & (F.col("text") != "")
    s = s.withColumn("may", F.coalesce(may, F.lit(False)))
    s = s.withColumn("run", F.sum((~F.col("may")).cast("int")).over(order))
    inside = Window.partitionBy("doc_id", "run").orderBy("page", "element")
    s = s.withColumns({"head": F.first("kind").over(inside), "head_x": F.first("x0").over(inside), "open": ~before("tail").rlike(P.TERMINAL), "colon": before("tail").rlike(":$"), "item": before("tail").rlike(r"(?i)(^|\W)item\s+subsequente[.]?$")})
    low = F.col("text").rlike(P.LOWER_START)
    margin = F.col("x0") <= F.col("page_left") + config.base_margin
    title = F.col("text").rlike("^[-–—−•◦]+$") | F.col("text").rlike(P.NUMBERING) | ((F.char_length("text") <= 80) & F.endswith("text", F.lit(":"))) | ((F.char_length("text") <= 100) & capitals(F.col("text")))
    paragraph = margin & ~title & (F.col("open") | (F.col("indents") - F.col("wide") > 0))
    by_head = (
        F.when(F.col("head").isin(*LISTS), F.col("x0") >= F.col("head_x") + config.list_hanging)
        .when(~margin, False)
        .when(F.col("head") == "p", paragraph)
        .when(F.col("head") == "question", F.col("open") | F.col("colon") | F.col("item"))
        .when(F.col("head").isin("alternative", "roman"), F.col("open") & low)
        .otherwise(F.col("open"))
    )
    s = s.withColumns({"link_head": F.col("may") & F.coalesce(by_head, F.lit(False)), "link_p": F.col("may") & F.coalesce(paragraph, F.lit(False))})
    fail = (F.col("may") & ~F.col("link_head")).cast("int")
    s = s.withColumn("cut", F.coalesce(F.max(fail).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("link", F.when(F.col("cut") == 0, F.col("link_head")).otherwise(F.col("link_p")))
    s = s.withColumn("seq", F.sum((~F.col("link")).cast("int")).over(order))
    rows = F.array_sort(F.collect_list(F.struct("page", "element", "text", *styles)))
    empty = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<offset:int,page:int>>").alias("page_breaks"), *[R.none(R.STYLES[c]).alias(c) for c in styles])

    def add(state: Column, r: Column) -> Column:
        text = join_two(state["text"], r["text"])
        at = (F.char_length(text) - F.char_length(r["text"])).cast("int")
        more = F.concat(state["page_breaks"], F.array(F.struct(at.alias("offset"), r["page"].cast("int").alias("page"))))
        # A space parts two words; where a hyphen closed up, the left part is cut at the boundary.
        limit = F.when(F.substring(text, at, 1) == " ", F.least(at - 1, F.char_length(state["text"]))).otherwise(at)
        kept = [F.when(state["text"] == "", r[c]).otherwise(R.merged(state[c], r[c], limit, at, R.STYLES[c])).alias(c) for c in styles]
        alone = state["text"] == ""
        return F.struct(F.when(alone, r["text"]).otherwise(text).alias("text"), F.when(alone, state["page_breaks"]).otherwise(more).alias("page_breaks"), *kept)

    at = F.struct("page", "element")
    head = lambda c: F.min_by(c, at).alias(c)
    out = s.groupBy("doc_id", "seq").agg(head("kind"), head("level"), head("marker"), F.min("page").alias("page"), head("x0"), rows.alias("rows"), *[head(c) for c in extra])
    return out.withColumn("j", F.aggregate("rows", empty, add)).select("doc_id", "seq", "page", "kind", "level", "marker", "x0", "j.text", "j.page_breaks", *extra, *[f"j.{c}" for c in styles])
