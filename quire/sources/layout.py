"""Positioned text derived from ``documents``, for documents that carry no geometry.

Each line of a text becomes a line of a page of twelve; a small number computed
from the document and the line decides its marker, size, place and style, so any
engine derives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.arrays import let
from quire.functions.text import ws

PAGE_LINES = 12


def _slots(docs: DataFrame) -> DataFrame:
    raw = docs.select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    h = ((F.col("doc_id") * 31 + F.col("line_no") * 17) % 16).cast("int")
    return raw.select("doc_id", "raw", "line_no", h.alias("h"), F.floor(F.col("line_no") / PAGE_LINES).cast("int").alias("p0")).select(
        "doc_id", "raw", "line_no", "h", (F.col("p0") + 1).alias("page"), (F.col("line_no") - F.col("p0") * PAGE_LINES + 1).alias("slot")
    )


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, page, ord, text, x0, y0, x1, y1, size, bold_ratio, font, color: one row per line that has text."""
    h, raw = F.col("h"), F.col("raw")
    number = F.lpad((F.col("line_no") % 999 + 1).cast("string"), 3, "0")
    marked = (
        F.when(h == 0, F.concat(number, F.lit(". "), raw))
        .when(h == 1, F.concat(F.lit("a) "), raw))
        .when(h == 2, F.concat(F.lit("II – "), raw))
        .when(h == 3, F.concat(F.lit("• "), raw))
        .when(h == 4, F.concat(F.lit("− "), raw))
        .when(h == 5, F.concat(F.lit("Art. 5º "), raw))
        .when(h == 6, F.concat(F.lit("Obs.: "), raw))
        .when(h == 7, F.lit("Letra b."))
        .when(h == 15, F.concat(F.lit("§ 1º "), raw))
        .otherwise(raw)
    )
    body = _slots(docs).withColumn("text", marked).select(
        "doc_id",
        "page",
        F.col("slot").alias("ord"),
        ws(F.col("text")).alias("text"),
        F.when(h.isin(10, 13), 68.0).otherwise(48.0).alias("x0"),
        (60.0 + (F.col("slot") - 1) * 18.0 + F.when(h == 12, 4.0).otherwise(0.0)).alias("y0"),
        F.when(h == 9, 20.0).otherwise(12.0).alias("size"),
        F.when(h == 9, 1.0).when(h == 14, 0.5).otherwise(0.0).alias("bold_ratio"),
        F.when(h == 9, "Base-Bold").otherwise("Base").alias("font"),
        F.when(h == 11, 0xC02020).when(h == 14, 0x2040C0).when(h == 12, 0x20A020).otherwise(0).alias("color"),
    )
    pages = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    header = docs.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.floor((pages - 1) / PAGE_LINES).cast("int") + 1)).alias("page")).select(
        "doc_id", "page", F.lit(0).alias("ord"), F.concat(F.lit("Disciplina "), F.coalesce("source", F.lit(""))).alias("text"),
        F.lit(48.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(10.0).alias("size"), F.lit(0.0).alias("bold_ratio"), F.lit("Base").alias("font"), F.lit(0).alias("color"),
    )
    both = body.unionByName(header).filter("text <> ''")
    return both.select(
        "doc_id", "page", "ord", "text", "x0", "y0", (F.col("x0") + 5.0 * F.char_length("text")).alias("x1"), (F.col("y0") + F.col("size")).alias("y1"), "size", "bold_ratio", "font", "color"
    )


def _word_x0(n: Column, x0: Column) -> Column:
    return x0 + 40.0 * n


def _word_font(n: Column, font: Column, of: Callable[[Column], Column] = lambda font: font) -> Column:
    """The font of a word, or what ``of`` tells of it where ``font`` is what it tells of the line's font."""
    return F.when(n % 3 == 1, of(F.lit("Base-Bold"))).otherwise(font)


def spans(docs: DataFrame) -> DataFrame:
    """Words of every line as spans; every seventh line has each span twice (an overlay)."""
    base = lines(docs).filter("ord > 0")
    word = F.posexplode(F.split("text", " ")).alias("n", "word")
    cut = base.select("doc_id", "page", F.col("ord").alias("line"), word, "x0", "y0", "size", "font", "color", "bold_ratio")
    styled = cut.select(
        "doc_id", "page", "line", "n", F.col("word").alias("text"), _word_x0(F.col("n"), F.col("x0")).alias("x0"), "y0",
        F.col("size"), _word_font(F.col("n"), F.col("font")).alias("font"),
        F.when(F.col("n") % 5 == 2, 0xC02020).otherwise(F.col("color")).alias("color"),
    ).filter("text <> ''")
    again = styled.filter("(doc_id + line) % 7 = 0").withColumn("x0", F.col("x0") + 0.1)
    both = styled.withColumn("copy", F.lit(0)).unionByName(again.withColumn("copy", F.lit(1)))
    return both.select(
        "doc_id", "page", "line", (F.col("n") * 2 + F.col("copy")).alias("ord"), "text", "x0", "y0", (F.col("x0") + 5.0 * F.char_length("text")).alias("x1"), (F.col("y0") + F.col("size")).alias("y1"),
        "size", "font", F.when(F.col("n") % 3 == 1, 16).otherwise(0).alias("flags"), "color",
    )


def chars(docs: DataFrame) -> DataFrame:
    """Characters of every line; words alternate between three fonts."""
    w = spans(docs).filter("ord % 2 = 0")
    letter = F.posexplode(F.split("text", "")).alias("n", "c")
    cut = w.select("doc_id", "page", "line", "ord", letter, "x0", "y0", "size", "font").filter("c <> ''")
    return cut.select(
        "doc_id", "page", (F.col("line").cast("long") * 10_000_000_000 + F.col("ord").cast("long") * 10_000 + F.col("n")).alias("ord"), F.col("c").alias("text"), F.col("font").alias("fontname"), "size",
        (F.col("x0") + 5.0 * F.col("n")).alias("x0"), (F.col("x0") + 5.0 * F.col("n") + 5.0).alias("x1"), F.col("y0").alias("top"), (F.col("y0") + F.col("size")).alias("bottom"),
    )


def pieces(line: Column, on: Callable[[Column], Column] | None = None) -> Column:
    """The characters of a line (a struct) as an array of its words, whose characters stand side by side in one font.

    With ``on``, null stands for each word in a font that is not ``on``.
    """

    def words(on_line: Column | None) -> Column:
        def piece(w: Column, n: Column) -> Column:
            x0 = _word_x0(n, line["x0"])
            whole = F.struct(
                w.alias("text"), _word_font(n, line["font"]).alias("fontname"), line["size"].alias("size"), x0.alias("x0"), (x0 + 5.0 * F.char_length(w)).alias("x1"), line["y0"].alias("top"), line["y1"].alias("bottom")
            )
            return whole if on_line is None else F.when((w == "") | _word_font(n, on_line, on), whole)

        return F.filter(F.transform(F.split(line["text"], " "), piece), lambda p: p.isNull() | (p["text"] != ""))

    return words(None) if on is None else let(on(line["font"]), words)


def _pages(docs: DataFrame) -> DataFrame:
    """Every page, counted without touching its lines: each has a header line at least."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    return docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.floor((n - 1) / PAGE_LINES).cast("int") + 1)).alias("page")).distinct()


def regions(docs: DataFrame) -> DataFrame:
    """Tables and images: doc_id, page, ord, kind, x0, y0, x1, y1."""
    p = _pages(docs)
    k = F.col("doc_id") + F.col("page")
    rows = F.filter(
        F.array(
            F.when(k % 3 == 0, F.struct(F.lit(1).alias("ord"), F.lit("table").alias("kind"), F.lit(40.0).alias("x0"), F.lit(112.0).alias("y0"), F.lit(9000.0).alias("x1"), F.lit(168.0).alias("y1"))),
            F.when(k % 5 == 0, F.struct(F.lit(2).alias("ord"), F.lit("image").alias("kind"), F.lit(40.0).alias("x0"), F.lit(202.0).alias("y0"), F.lit(9000.0).alias("x1"), F.lit(240.0).alias("y1"))),
            F.when(k % 15 == 0, F.struct(F.lit(3).alias("ord"), F.lit("image").alias("kind"), F.lit(41.0).alias("x0"), F.lit(203.0).alias("y0"), F.lit(9000.0).alias("x1"), F.lit(240.0).alias("y1"))),
        ),
        lambda r: r.isNotNull(),
    )
    return p.select("doc_id", "page", F.explode(rows).alias("r")).select("doc_id", "page", "r.*")


def drawings(docs: DataFrame) -> DataFrame:
    """Vector drawings: one real question box on some pages, and others that fail a rule."""
    p = _pages(docs)
    one = lambda y0, y1, width, r, curve: F.struct(F.lit(40.0).alias("x0"), F.lit(y0).alias("y0"), F.lit(340.0).alias("x1"), F.lit(y1).alias("y1"), F.lit(width).alias("width"), F.lit(r).alias("r"), F.lit(0.3).alias("g"), F.lit(0.5).alias("b"), F.lit(curve).alias("has_curve"))
    some = F.array(one(75.0, 110.0, 1.0, 0.1, True), one(75.2, 110.2, 1.0, 0.1, True), one(260.0, 268.0, 1.0, 0.1, True), one(130.0, 160.0, 5.0, 0.1, True), one(130.0, 160.0, 1.0, 0.9, True), one(130.0, 160.0, 1.0, 0.1, False))
    return p.filter((F.col("doc_id") + F.col("page")) % 4 == 0).select("doc_id", "page", F.posexplode(some).alias("ord", "d")).select("doc_id", "page", "ord", "d.*")


def tables(docs: DataFrame) -> DataFrame:
    """Tables with cells: three rows of three; some cells are empty or null."""
    t = regions(docs).filter("kind = 'table'").select("doc_id", "page", "ord", F.lit(120.0).alias("x0"), "y0", F.lit(400.0).alias("x1"), "y1")
    key = F.col("doc_id") + F.col("page")
    rows = F.array(
        F.array(F.lit(""), F.lit("Total"), F.lit("Nota")),
        F.array(F.lit("A"), F.when(key % 2 == 0, F.concat(F.lit("v"), F.col("page").cast("string"))), F.lit("10")),
        F.array(F.lit("B"), F.lit("x < y"), F.when(key % 4 == 1, "").otherwise("20")),
    )
    return t.withColumn("rows", rows)


def from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``documents`` that the layout needs.

    Files with few row groups for the cluster's cores are spread first; a larger
    table is read as it lies.  Round robin, since a union of parts that are hashed
    by document would count as hashed by document itself.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= 4 * cores else docs.repartition(cores)
