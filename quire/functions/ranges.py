"""Offset ranges over a text: arrays of struct<start, end[, css_class]>.

Starts count from 0 and ends are exclusive, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.arrays import let
from quire.functions.text import escape

PLAIN = "array<struct<start:int,end:int>>"
COLOURED = "array<struct<start:int,end:int,css_class:string>>"


def none(coloured: bool = False) -> Column:
    return F.array().cast(COLOURED if coloured else PLAIN)


def _with(r: Column, start: Column, end: Column, coloured: bool) -> Column:
    parts = [start.cast("int").alias("start"), end.cast("int").alias("end")]
    return F.struct(*parts, r["css_class"].alias("css_class")) if coloured else F.struct(*parts)


def clip(ranges: Column, start: Column, end: Column, coloured: bool = False) -> Column:
    """Ranges of the slice [start, end), counted from its start."""
    cut = F.transform(ranges, lambda r: _with(r, F.greatest(start, r["start"]) - start, F.least(end, r["end"]) - start, coloured))
    return F.filter(cut, lambda r: r["end"] > r["start"])


def _blank(text: Column, start: Column, end: Column) -> Column:
    return F.trim(F.substring(text, start + 1, end - start)) == ""


def _valid(text: Column, ranges: Column) -> Column:
    return F.array_sort(F.filter(ranges, lambda r: (r["start"] >= 0) & (r["end"] > r["start"]) & (r["end"] <= F.char_length(text))))


def normal_styles(text: Column, ranges: Column) -> Column:
    """Sorted ranges; those that overlap, touch, or have only blanks between them are one."""

    def add(kept: Column, r: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        joins = (F.size(kept) > 0) & ((r["start"] <= last["end"]) | _blank(text, last["end"], F.greatest(r["start"], last["end"])))
        longer = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(_with(r, last["start"], F.greatest(last["end"], r["end"]), False)))
        return F.when(F.coalesce(joins, F.lit(False)), longer).otherwise(F.concat(kept, F.array(r)))

    return F.aggregate(_valid(text, ranges), none(), add)


def normal_colours(text: Column, ranges: Column) -> Column:
    """Sorted ranges; equal classes merge over overlaps and blanks, a conflicting later range goes whole."""

    def add(kept: Column, r: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        same, some = r["css_class"] == last["css_class"], F.size(kept) > 0
        overlaps = r["start"] < last["end"]
        gap = (r["start"] > last["end"]) & _blank(text, last["end"], F.greatest(r["start"], last["end"]))
        longer = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(_with(r, last["start"], F.greatest(last["end"], r["end"]), True)))
        return F.when(F.coalesce(some & same & (overlaps | gap), F.lit(False)), longer).when(F.coalesce(some & overlaps, F.lit(False)), kept).otherwise(F.concat(kept, F.array(r)))

    return F.aggregate(_valid(text, ranges), none(True), add)


def project(joined: Column, parts: Column, coloured: bool = False) -> Column:
    """struct<ranges, kept, dropped>: ranges of joined lines, found again in the joined text.

    ``parts`` is an array of struct<text, ranges>.  A forward cursor looks for each
    whole line; where it is not found, a snippet counts only if it occurs once
    from the cursor on.  Coloured snippets need two characters.
    """
    kind = COLOURED if coloured else PLAIN
    start = F.struct(F.lit(1).alias("cursor"), none(coloured).alias("ranges"), F.lit(0).alias("kept"), F.lit(0).alias("dropped"))
    find = lambda s, at: F.call_function("locate", s, joined, at)

    def add(state: Column, line: Column) -> Column:
        def lone(r: Column) -> Column:
            def fits(snippet: Column, at: Column) -> Column:
                once = (at > 0) & (find(snippet, at + 1) == 0) & (F.char_length(F.trim(snippet)) >= (2 if coloured else 1))
                return F.when(once, _with(r, at - 1, at - 1 + F.char_length(snippet), coloured))

            return let(F.substring(line["text"], r["start"] + 1, r["end"] - r["start"]), lambda snippet: let(find(snippet, state["cursor"]), lambda at: fits(snippet, at)))

        def found(whole: Column) -> Column:
            moved = F.transform(line["ranges"], lambda r: _with(r, r["start"] + whole - 1, r["end"] + whole - 1, coloured))
            return F.when(whole > 0, moved).otherwise(F.filter(F.transform(line["ranges"], lone), lambda r: r.isNotNull())).cast(kind)

        def moved_on(whole: Column, got: Column) -> Column:
            return F.struct(
                F.when(whole > 0, (whole + F.char_length(line["text"])).cast("int")).otherwise(state["cursor"]).alias("cursor"),
                F.concat(state["ranges"], got).alias("ranges"),
                (state["kept"] + F.size(got)).alias("kept"),
                (state["dropped"] + F.size(line["ranges"]) - F.size(got)).alias("dropped"),
            )

        return let(find(line["text"], state["cursor"]), lambda whole: let(found(whole), lambda got: moved_on(whole, got)))

    return F.aggregate(parts, start, add, lambda s: F.struct(s["ranges"].alias("ranges"), s["kept"].alias("kept"), s["dropped"].alias("dropped")))


def merged(left: Column, right: Column, limit: Column, shift: Column, coloured: bool = False) -> Column:
    """Ranges of a join: those of the left part up to ``limit``, those of the right part shifted."""
    return F.concat(clip(left, F.lit(0), limit, coloured), F.transform(right, lambda r: _with(r, r["start"] + shift, r["end"] + shift, coloured)))


def rich_text(text: Column, colours: Column, bolds: Column, italics: Column) -> Column:
    """Escaped text with span, em and strong around the pieces between range ends.

    The ranges must be normal (normal_colours, normal_styles) and should be
    columns of their own, since each is read several times.
    """
    c, b, i = colours, bolds, italics
    ends = lambda rs: F.flatten(F.transform(rs, lambda r: F.array(r["start"], r["end"])))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.char_length(text)), ends(c), ends(b), ends(i))))
    pieces = F.transform(F.slice(cuts, 1, F.greatest(F.size(cuts) - 1, F.lit(0))), lambda a, k: F.struct(a.alias("a"), F.get(cuts, k + 1).alias("z")))

    def piece(p: Column) -> Column:
        within = lambda r: (r["start"] <= p["a"]) & (p["z"] <= r["end"])
        out = escape(F.substring(text, p["a"] + 1, p["z"] - p["a"]))
        name = F.get(F.filter(c, within), F.lit(0))["css_class"]
        out = F.when(name.isNotNull(), F.concat(F.lit('<span class="'), name, F.lit('">'), out, F.lit("</span>"))).otherwise(out)
        out = F.when(F.exists(i, within), F.concat(F.lit('<em class="pdf-italic">'), out, F.lit("</em>"))).otherwise(out)
        return F.when(F.exists(b, within), F.concat(F.lit('<strong class="pdf-bold">'), out, F.lit("</strong>"))).otherwise(out)

    return F.array_join(F.transform(pieces, piece), "")


def page_mark(page: Column, inline: bool = False) -> Column:
    name = "pagebreak pagebreak-inline" if inline else "pagebreak"
    return F.format_string(f'<span epub:type="pagebreak" class="{name}" id="page-%d" title="%d"></span>', page, page)


def with_breaks(text: Column, breaks: Column, colours: Column | None = None, bolds: Column | None = None, italics: Column | None = None) -> Column:
    """Text with a marker at each page break: escaped, and styled where ranges are given."""
    ordered = F.array_sort(breaks)
    edges = F.concat(F.array(F.lit(0)), F.transform(ordered, lambda b: b["offset"]), F.array(F.char_length(text)))

    def part(k: Column) -> Column:
        start, end = F.get(edges, k), F.get(edges, k + 1)
        cut = F.substring(text, start + 1, end - start)
        if colours is None:
            return escape(cut)
        pieces = F.struct(cut.alias("t"), clip(colours, start, end, True).alias("c"), clip(bolds, start, end).alias("b"), clip(italics, start, end).alias("i"))
        return F.element_at(F.transform(F.array(pieces), lambda p: rich_text(p["t"], p["c"], p["b"], p["i"])), 1)

    return F.concat(part(F.lit(0)), F.array_join(F.transform(ordered, lambda b, k: F.concat(page_mark(b["page"], True), part(k + 1))), ""))


#: Style columns of lines and elements, and whether their ranges carry a class.
STYLES = {"color_ranges": True, "bold_ranges": False, "italic_ranges": False}


def from_spans(spans: Column, text: Column, css_class: Column) -> Column:
    """Colour ranges of a line whose text is its spans joined by a space.

    ``css_class`` and ``text`` are functions of a span.
    """
    start = F.struct(F.lit(0).alias("at"), none(True).alias("out"))

    def add(state: Column, s: Column) -> Column:
        end = (state["at"] + F.char_length(text(s))).cast("int")
        one = F.array(F.struct(state["at"].alias("start"), end.alias("end"), css_class(s).alias("css_class")))
        return F.struct((end + 1).alias("at"), F.when(css_class(s).isNull(), state["out"]).otherwise(F.concat(state["out"], one)).alias("out"))

    return F.aggregate(spans, start, add, lambda s: s["out"])


def normal(name: str, text: Column, ranges: Column) -> Column:
    """Normal ranges of a style column."""
    return normal_colours(text, ranges) if STYLES[name] else normal_styles(text, ranges)
