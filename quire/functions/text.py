"""Text functions as Catalyst expressions; Arrow only where Spark has no equal."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import patterns as P

#: A no-break blank, and marks without width.
MARKS = "\u00a0\u200b\ufffe\uffff\u00ad"
#: What ``ws`` changes, or an end that it may trim.
UNTIDY = rf"[\t\r\f\x0B{MARKS}]| (?: |$)|^ "


def _unicode(form: str):
    """Unicode normalisation; ASCII batches pass through untouched."""

    @F.arrow_udf("string")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in text.to_pylist()], pa.string())

    return run


def ws(text: Column, nfc: bool = False) -> Column:
    """White space of a line: drop zero-width marks, collapse blanks, trim; NFC on demand.

    Most texts are in order already; one search tells, and only the others are rewritten.
    """
    plain = F.translate(text, MARKS, " ")
    plain = _unicode("NFC")(plain) if nfc else plain
    plain = F.trim(F.regexp_replace(plain, "[ \\t\\r\\f\\x0B]+", " "))
    return plain if nfc else F.when(text.rlike(UNTIDY), plain).otherwise(text)


def fold(text: Column) -> Column:
    """Case folding of the Latin and Greek letters whose fold is not their lower case."""
    text = F.lower(text)
    for a, b in (("ß", "ss"), ("ς", "σ"), ("ſ", "s"), ("ŉ", "ʼn"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def norm_key(text: Column) -> Column:
    """Furniture key: folded text with page counters replaced."""
    return F.regexp_replace(fold(ws(text)), P.COUNTER, "<page>")


def _closes_up(left: Column, right: Column) -> Column:
    """Whether a word is cut by a hyphen between two fragments; the long left one is searched last."""
    return F.contains(left, F.lit("-")) & F.left(right, F.lit(1)).rlike(f"[{P.LOWER}]") & left.rlike(P.TRAILING_HYPHEN)


def join_two(left: Column, right: Column) -> Column:
    """Join two fragments: a word cut by a hyphen closes up, all else gets a space."""
    cut = _closes_up(left, right)
    return F.when(left == "", right).when(cut, F.concat(F.regexp_replace(left, r"\s*-\s*$", ""), right)).otherwise(F.concat(left, F.lit(" "), right))


def join_lines(parts: Column) -> Column:
    """Join physical lines to one text."""
    joined = F.aggregate(F.filter(F.transform(parts, lambda p: ws(p)), lambda p: p != ""), F.lit(""), join_two)
    return F.regexp_replace(joined, r"\s+([,.;:!?])", "$1")


def join_page(left: Column, right: Column) -> Column:
    """struct<text, boundary, left_limit> of a join across pages."""
    cut = _closes_up(left, right)
    head = F.when(cut, F.regexp_replace(left, r"\s*-\s*$", "")).otherwise(left)
    text = join_two(left, right)
    return F.struct(text.alias("text"), (F.char_length(text) - F.char_length(right)).alias("boundary"), F.char_length(head).alias("left_limit"))


def suspicious_duplicate(text: Column) -> Column:
    """Equal halves, a repeated run of words at the start, or a long word in capitals twice; as written."""
    plain = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    w = F.split(plain, " ")
    n = F.size(w)
    half = (n % 2 == 0) & (n >= 2) & (n <= 80) & (F.slice(w, 1, F.greatest(F.floor(n / 2).cast("int"), F.lit(1))) == F.slice(w, F.floor(n / 2).cast("int") + 1, F.greatest(n, F.lit(1))))
    most = F.least(F.lit(16), F.floor(n / 2).cast("int"))
    starts = F.when(most >= 4, F.sequence(F.lit(4), F.greatest(most, F.lit(4)))).otherwise(F.array().cast("array<int>"))
    prefix = (n <= 80) & F.exists(starts, lambda k: F.slice(w, 1, k) == F.slice(w, k + 1, k))
    return half | prefix | plain.rlike(P.TWICE)


def slug(text: Column) -> Column:
    """ASCII name for files and ids."""
    plain = F.regexp_replace(_unicode("NFKD")(text), "[^\\x00-\\x7F]", "")
    out = F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "secao").otherwise(out)


def escape(text: Column) -> Column:
    """HTML escape without quotes."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _each(s: str, change: str) -> str:
    """Every letter changed by its one-letter mapping, whatever stands beside it; one without such a mapping stays."""
    out = []
    for c in s:
        if change == "lower":
            out.append(c.lower()[0])
        else:
            out.append(next((x for x in (c.upper(), c.title(), {"ß": "ẞ"}.get(c, c)) if len(x) == 1), c))
    return "".join(out)


def title_blanks(s: str) -> str:
    """A text in capitals with a capital first in each word; only blanks part words, and an ordinal sign is no capital."""
    low = _each(s, "lower")
    if _each(s, "upper") != s or low == s or "ª" in s or "º" in s:
        return s
    return " ".join(_each(w[:1], "upper") + w[1:] for w in low.split(" "))


def title_case(text: Column, blanks: bool = False) -> Column:
    """Title case where all letters are capitals.

    A word starts after anything that is no letter, or with ``blanks`` only after a blank.
    """

    @F.arrow_udf("string")
    def run(t: pa.Array) -> pa.Array:
        return pa.array([s if not s else title_blanks(s) if blanks else s.title() if s.isupper() else s for s in t.to_pylist()], pa.string())

    return run(text)


def cell_text(text: Column) -> Column:
    """Table cells: white space; where mathematical, compatibility forms and single glyphs."""

    @F.arrow_udf("string")
    def maths(t: pa.Array) -> pa.Array:
        out = []
        for s in t.to_pylist():
            if s is not None and any("MATHEMATICAL" in unicodedata.name(c, "") or c in "⋁∧∨→↔¬" for c in s):
                kept: list[str] = []
                for c in s:
                    if kept and kept[-1] == c and unicodedata.name(c, "").startswith("MATHEMATICAL "):
                        continue
                    kept.append(c)
                s = unicodedata.normalize("NFKC", "".join(kept).replace("⋁", "∨"))
            out.append(s)
        return pa.array(out, pa.string())

    once = F.regexp_replace(maths(ws(text)), r"\b([pqr]) \1\b", "$1")
    return F.regexp_replace(once, r"= ([0-9]+) \1\b", "= $1")


def stem(path: Column) -> Column:
    """File name without folders and suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "[/\\\\]"), -1), r"\.[^.]*$", "")
