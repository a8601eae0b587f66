"""The document engine: hand-made rows, and its queries against DuckDB."""

import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions import colour, geometry, ranges, text
from quire.operators import epub, lines, regions, render, sections, segment
from quire.plans.oracle import ORACLE_SQL
from quire.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
CHECKED = ["furniture_keys", "body_size", "page_left", "line_kinds", "heading_levels", "color_classes", "boxed_lines", "table_cell_repair", "number_overlay_antijoin", "join_lines_text", "suspicious_duplicates", "document_profile", "toc", "line_overlay_dedup", "caps_pairs", "metadata", "rich_text", "ranges_normalized", "page_regions", "audit_counters", "xhtml_rules", "line_from_spans"]


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("parts, want", [(["insti-", "tuição"], "instituição"), (["insti -", "tuição"], "instituição"), (["Lei -", "Maior"], "Lei - Maior"), (["foi", ", ok"], "foi, ok"), (["", "a"], "a")])
def test_join_lines(spark, parts, want):
    df = spark.createDataFrame([(parts,)], "p array<string>")
    assert df.select(text.join_lines(F.col("p")).alias("x")).first()["x"] == want


def test_text_functions(spark):
    assert one(spark, " a \t b", text.ws) == "a b"
    assert one(spark, "Página 3 de 10", text.norm_key) == "página <page>"
    assert one(spark, "GOVERNO FEDERAL GOVERNO FEDERAL", text.suspicious_duplicate) is True
    assert one(spark, "um texto comum", text.suspicious_duplicate) is False
    assert one(spark, "Ação & Reação!", text.slug) == "acao-reacao"
    assert one(spark, "a<b & c", text.escape) == "a&lt;b &amp; c"
    assert one(spark, "x/y/Nome do Livro.pdf", text.stem) == "Nome do Livro"


@pytest.mark.parametrize("rgb, want", [((200, 20, 20), "red"), ((200, 120, 20), "orange"), ((20, 160, 20), "green"), ((20, 60, 200), "blue"), ((120, 20, 200), "purple"), ((100, 100, 110), None), ((40, 0, 0), None)])
def test_colours(spark, rgb, want):
    packed = rgb[0] << 16 | rgb[1] << 8 | rgb[2]
    assert spark.range(1).select(colour.colour_class(F.lit(packed)).alias("x")).first()["x"] == want


def test_geometry_rounds_half_to_even(spark):
    row = spark.createDataFrame([(1.25, 0.75, 2.0, 2.0)], "x0 double, y0 double, x1 double, y1 double").select(*geometry.box_key(geometry.of(), 0.5), geometry.overlap(geometry.of(), geometry.of()).alias("o")).first()
    assert list(row)[:2] == [2, 2] and row["o"] == 1.0


def test_ranges(spark):
    df = spark.createDataFrame([("abcdefghij", [(0, 3), (3, 5), (7, 9)])], "t string, r array<struct<start:int,end:int>>")
    got = df.select(ranges.normal_styles(F.col("t"), F.col("r")).alias("n"), ranges.clip(F.col("r"), F.lit(2), F.lit(8)).alias("c")).first()
    assert [tuple(x) for x in got["n"]] == [(0, 5), (7, 9)]
    assert [tuple(x) for x in got["c"]] == [(0, 1), (1, 3), (5, 6)]
    tint = spark.createDataFrame([("abcdefghij", [(0, 3, "red"), (3, 5, "red"), (4, 6, "blue")])], "t string, r array<struct<start:int,end:int,css_class:string>>")
    kept = tint.select(ranges.normal_colours(F.col("t"), F.col("r")).alias("n")).first()["n"]
    assert [tuple(x) for x in kept] == [(0, 3, "red"), (3, 5, "red")]


def test_style_marks_leave_the_text(spark):
    df = spark.createDataFrame([("um <b> dois", [(0, 2)])], "t string, r array<struct<start:int,end:int>>")
    html = df.select(ranges.rich_text(F.col("t"), ranges.none(True), F.col("r"), ranges.none()).alias("h")).first()["h"]
    assert html.replace('<strong class="pdf-bold">', "").replace("</strong>", "") == "um &lt;b&gt; dois"


def _lines(spark, rows):
    return spark.createDataFrame([(1, 1, k, *r) for k, r in enumerate(rows)], "doc_id long, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold_ratio double, font string, color int")


def test_visible_layer_wins(spark):
    rows = [("ABC", 48.0, 60.0, 70.0, 72.0, 12.0, 0.0, "F", 0xFFFFFF), ("ABC DEF", 48.0, 60.0, 90.0, 72.0, 12.0, 0.0, "F", 0x0000C0)]
    assert [r["text"] for r in lines.without_line_overlays(_lines(spark, rows)).collect()] == ["ABC DEF"]


def test_question_is_no_heading(spark):
    rows = [("001. Texto da questão", 48.0, 60.0, 200.0, 80.0, 20.0, 1.0, "B", 0), ("continua aqui mesmo em corpo normal", 48.0, 82.0, 200.0, 94.0, 12.0, 0.0, "B", 0)]
    got = segment.units(_lines(spark, rows)).collect()
    assert [(r["kind"], r["marker"]) for r in got] == [("question", "001.")]


def test_two_greetings_are_two_paragraphs(spark):
    rows = [("uma linha na margem esquerda", 48.0, 42.0, 200.0, 54.0, 12.0, 0.0, "B", 0), ("Olá, aluno!", 68.0, 60.0, 200.0, 72.0, 12.0, 0.0, "B", 0), ("Seja bem-vindo.", 68.0, 74.0, 200.0, 86.0, 12.0, 0.0, "B", 0)]
    assert segment.paragraph_islands(_lines(spark, rows)).count() == 3


def test_label_without_content_vanishes(spark):
    rows = [("Dica:", 48.0, 60.0, 200.0, 72.0, 12.0, 0.0, "B", 0), ("a) alternativa", 48.0, 78.0, 200.0, 90.0, 12.0, 0.0, "B", 0)]
    assert [r["kind"] for r in segment.units(_lines(spark, rows)).collect()] == ["alternative"]


def test_short_document_header_is_furniture(spark):
    rows = [("Cabeçalho", 48.0, 20.0, 100.0, 30.0, 10.0, 0.0, "B", 0), ("texto", 48.0, 400.0, 100.0, 412.0, 12.0, 0.0, "B", 0)]
    assert [r["key"] for r in regions.furniture_keys(_lines(spark, rows)).collect()] == ["cabeçalho"]


def test_rules_as_written(spark):
    assert one(spark, "Texto APRESENTAÇÃO APRESENTAÇÃO fim de linha", text.suspicious_duplicate) is True
    assert one(spark, "governo Governo", text.suspicious_duplicate) is False
    texts = ["§ 1abc", "§ 1º Texto", "Parágrafo ÚNICO. Texto", "paragrafo unico", "ART. 5º Texto", "ATENÇÃO: veja", "atenção"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "ord int, text string")
    got = {r["ord"]: r["kind"] for r in segment.kinds(df).collect()}
    assert [got[k] for k in range(7)] == [None, "legal-item", "legal-item", None, "legal", "call-inline", "call-label"]


def test_styles_follow_the_text_into_the_book(spark):
    rows = [("001. Texto forte e", 48.0, 60.0, 200.0, 72.0, 12.0, 0.0, "B", 0), ("mais cor aqui", 48.0, 74.0, 200.0, 86.0, 12.0, 0.0, "B", 0)]
    styled = _lines(spark, rows).withColumns(
        {
            "color_ranges": F.when(F.col("ord") == 1, F.array(F.struct(F.lit(5).alias("start"), F.lit(8).alias("end"), F.lit("red").alias("css_class")))).otherwise(ranges.none(True)),
            "bold_ranges": F.when(F.col("ord") == 0, F.array(F.struct(F.lit(11).alias("start"), F.lit(16).alias("end")))).otherwise(ranges.none()),
            "italic_ranges": ranges.none(),
        }
    )
    read = segment.merged_across_pages(segment.merged_in_page(segment.units(styled)))
    r = read.first()
    assert r["text"] == "Texto forte e mais cor aqui" and [tuple(x) for x in r["bold_ranges"]] == [(6, 11)] and [tuple(x) for x in r["color_ranges"]] == [(19, 22, "red")]
    html = render.fragments(sections.sections(read)).first()["html"]
    assert 'Texto <strong class="pdf-bold">forte</strong> e mais <span class="red">cor</span> aqui</p>' in html


def test_tables_and_images_reach_the_book(spark):
    lines_ = _lines(spark, [("uma linha de texto corrido aqui.", 48.0, 20.0, 200.0, 32.0, 12.0, 0.0, "B", 0)])
    regions_ = spark.createDataFrame([(1, 1, 1, "table", 40.0, 100.0, 300.0, 160.0), (1, 1, 1002, "image", 40.0, 200.0, 300.0, 260.0)], "doc_id long, page int, ord int, kind string, x0 double, y0 double, x1 double, y1 double")
    tables = spark.createDataFrame([(1, 1, 1, [["A", "B"], ["x < y", None]])], "doc_id long, page int, ord int, rows array<array<string>>")
    images = spark.createDataFrame([(1, 1, 1002, "fig.png", "Uma & outra")], "doc_id long, page int, ord int, filename string, caption string")
    read = segment.merged_across_pages(segment.merged_in_page(segment.units(lines_, regions_)))
    body = render.documents(sections.sections(read), tables=tables, images=images).first()["xhtml"]
    assert '<div class="table-wrap"><table><tr><th>A</th><th>B</th></tr><tr><td>x &lt; y</td><td></td></tr></table></div>' in body
    assert '<figure><img src="../images/fig.png" alt=""/><figcaption>Uma &amp; outra</figcaption></figure>' in body


def test_one_bad_document_does_not_stop_the_others(spark):
    good = '<html xmlns="http://www.w3.org/1999/xhtml"><body><p>ok</p></body></html>'
    files = spark.createDataFrame([(1, 0, "s", good), (2, 0, "s", "<html><p></html>")], "doc_id long, section_no long, section string, xhtml string")
    toc = spark.createDataFrame([(1, 1, 1, "A", "s.xhtml#a"), (1, 2, 3, "B", "s.xhtml#b"), (1, 3, 2, "C", "s.xhtml#c"), (1, 4, 1, "D", "s.xhtml#d")], "doc_id long, seq long, level int, text string, href string")
    pages = spark.createDataFrame([(1, 1, "s")], "doc_id long, page int, section string")
    meta = spark.createDataFrame([(1, "Área", "T", "N"), (2, "", "", "")], "doc_id long, area string, title string, author string")
    images = spark.createDataFrame([(1, "cover.png", bytearray(b"png")), (1, "f.svg", bytearray(b"<svg/>"))], "doc_id long, filename string, data binary")
    books = epub.packages(files, toc, pages, meta, images=images)
    got = {r["doc_id"]: r for r in books.collect()}
    assert got[2]["epub"] is None and "not well-formed" in got[2]["error"] and got[1]["error"] is None
    z = zipfile.ZipFile(io.BytesIO(got[1]["epub"]))
    assert {"OEBPS/text/cover.xhtml", "OEBPS/images/cover.png", "OEBPS/images/f.svg"} < set(z.namelist())
    nav = z.read("OEBPS/nav.xhtml").decode()
    inner = '<li class="toc-l3"><a href="text/s.xhtml#b">B</a></li><li class="toc-l2"><a href="text/s.xhtml#c">C</a></li>'
    assert f'<li class="toc-l1"><a href="text/s.xhtml#a">A</a><ol>{inner}</ol></li><li class="toc-l1">' in nav
    assert {r["doc_id"]: r["status"] for r in epub.verdicts(books).collect()} == {1: "partial", 2: "failed"}


def test_identifiers_and_plain_phrases(spark):
    opf = b'<package xmlns="http://www.idpf.org/2007/opf" unique-identifier="i"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="i">a</dc:identifier></metadata></package>'
    ncx = b'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><head><meta name="dtb:uid" content="b"/></head></ncx>'
    link = b'<html><body><p><a href="x">so  texto</a></p></body></html>'
    df = spark.createDataFrame([(1, bytearray(epub.package({"a.opf": opf, "a.ncx": ncx, "b.xhtml": link})))], "doc_id long, epub binary")
    assert {r["rule"] for r in epub.findings(epub.entries(df), ("so texto",)).collect()} == {"identifiers differ", "plain phrase in a link"}


def test_colour_ranges_of_spans(spark):
    rows = [(1, 1, 1, k, t, 48.0 + 30 * k, 60.0, 70.0 + 30 * k, 72.0, 12.0, "B", 0, c) for k, (t, c) in enumerate([("um", 0), ("dois", 0xC02020), ("três", 0x2040C0)])]
    df = spark.createDataFrame(rows, "doc_id long, page int, line int, ord int, text string, x0 double, y0 double, x1 double, y1 double, size double, font string, flags int, color int")
    r = lines.from_spans(df, styles=True).first()
    assert r["text"] == "um dois três" and [tuple(x) for x in r["color_ranges"]] == [(3, 7, "red"), (8, 12, "blue")]


def test_settings_win_over_what_is_found(spark):
    from quire.config import Config

    lines_ = _lines(spark, [("Área do livro", 48.0, 300.0, 200.0, 312.0, 12.0, 0.0, "B", 0), ("LIVRO ELETRÔNICO", 48.0, 320.0, 200.0, 332.0, 12.0, 0.0, "B", 0), ("O TÍTULO DELE", 48.0, 340.0, 200.0, 352.0, 12.0, 0.0, "B", 0)])
    keys = regions.furniture_keys(lines_)
    assert sections.metadata(lines_, keys).first().asDict() == {"doc_id": 1, "area": "Área do livro", "title": "O Título Dele", "author": ""}
    assert sections.metadata(lines_, keys, config=Config(title="X", author="Y")).first().asDict() == {"doc_id": 1, "area": "Área do livro", "title": "X", "author": "Y"}


def test_package_rules(spark):
    good = epub.book(1, "T", "A", [("s", '<html xmlns="http://www.w3.org/1999/xhtml"><body><p>ok</p></body></html>')], [], [], "")
    names = zipfile.ZipFile(io.BytesIO(good)).namelist()
    assert names[0] == "mimetype" and names[1:] == sorted(names[1:])
    bad = epub.package({"OEBPS/a.xhtml": b'<html><body><blockquote class="legal-quote"/><span class="pagebreak"/><blockquote class="legal-quote"/><u>x</u><p>001. Quest</p></body></html>'})
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(bad)), (3, bytearray(b"no zip"))], "doc_id long, epub binary")
    rules = {(r["doc_id"], r["rule"]) for r in epub.findings(epub.entries(df)).collect()}
    assert rules == {(2, "legal quotations apart"), (2, "underline element"), (2, "question without its class"), (3, "unreadable archive")}
    assert {r["doc_id"]: r["status"] for r in epub.verdicts(df).collect()} == {1: "partial", 2: "failed", 3: "failed"}


def _plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    cur = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert got and got == want


def test_join_lines_text_keeps_the_tail_of_a_long_line(spark, monkeypatch):
    from quire.plans import queries

    long = "palavra" * 160_000
    monkeypatch.setattr(queries, "_lines", lambda spark, sf_dir: spark.createDataFrame([(1, 1, 1, long)], "doc_id long, page int, ord int, text string"))
    assert queries.join_lines_text(spark, SF).first()["text"] == long


def test_metadata_parts_words_at_blanks_as_its_sql(spark, tmp_path):
    names = ["EA!! OF,SIFB!! PÓS-GRADUAÇÃO", "STRAßE NOVA", "1º ANO", "ΤΕΛΟΣ ΕΝΑΣ", "ŉOVA-LEI"]
    docs = spark.createDataFrame([(16 * k + 8, f"{name}\n\n\n{name} II", "web") for k, name in enumerate(names)], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["metadata"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.select("doc_id", "area", "title", "author").collect())
    assert got == sorted(con.execute(f"SELECT doc_id, area, title, author FROM ({ORACLE_SQL['metadata']})").fetchall())
    assert got[0][1] == "Ea!! Of,sifb!! Pós-graduação Ii"


PIECES = [("um", "Bold", 12.0, 48.0, 60.0), ("dois", "Base", 12.0, 60.0, 60.0), ("três", "Bold", 12.0, 90.0, 60.0), ("e", "Bold", 12.0, 111.0, 60.5), ("longe", "Bold", 12.0, 140.0, 60.5), ("abaixo", "Bold", 12.0, 165.0, 90.0), ("x", None, 12.0, 196.0, 90.0), ("fim", "Bold", 12.0, 202.0, 90.0)]
RUNS = [("abaixo", 165.0, 90.0, 195.0, 102.0), ("fim", 202.0, 90.0, 217.0, 102.0), ("longe", 140.0, 60.5, 165.0, 72.5), ("trêse", 90.0, 60.0, 116.0, 72.5), ("um", 48.0, 60.0, 58.0, 72.0)]


def test_runs_of_characters_and_of_their_strings(spark):
    kind = "doc_id long, page int, ord long, text string, fontname string, size double, x0 double, x1 double, top double, bottom double"
    whole = [(1, 1, 100 * k, t, f, s, x, x + 5.0 * len(t), y, y + s) for k, (t, f, s, x, y) in enumerate(PIECES)]
    each = [(d, p, o + n, c, f, s, x + 5.0 * n, x + 5.0 * n + 5.0, y, z) for d, p, o, t, f, s, x, _, y, z in whole for n, c in enumerate(t)]
    fonts = spark.createDataFrame([(1, "Bold"), (2, "Base")], "doc_id long, font string")
    for rows in (each[::-1], whole):
        runs = lines.char_runs(spark.createDataFrame(rows, kind), fonts, "bold")
        assert sorted(tuple(r) for r in runs.select("text", "x0", "y0", "x1", "y1").collect()) == RUNS
        assert {tuple(r) for r in runs.select("doc_id", "page", "style").collect()} == {(1, 1, "bold")}
    assert lines.char_runs(spark.createDataFrame(each, kind), fonts.filter("doc_id = 2"), "bold").count() == 0


@pytest.mark.parametrize("name", ["char_runs", "style_run_join", "ranges_projected"])
def test_bold_runs_move_lines_once_and_no_characters(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Aggregate") == 1


def test_ranges_of_runs_that_a_line_holds_once(spark):
    """Places count characters, also behind letters of several bytes; what occurs again, even overlapping itself, has none."""
    box = "0.0D AS x0, 10.0D AS y0, 90.0D AS x1, 22.0D AS y1"
    snippets = ["ção", "aa", "é", " fim ", "", "nada"]
    runs = ", ".join(f"struct('bold' AS style, '{t}' AS text, {box})" for t in snippets)
    df = spark.sql(f"SELECT struct('é ação aaa é fim' AS text, {box}) AS l, array({runs}) AS runs")
    assert [tuple(r) for r in df.select(lines.ranges_on_line(F.col("l"), lines.bands(F.col("runs"))).alias("r")).first()["r"]] == [(3, 6), (13, 16)]


def test_words_in_other_fonts_stay_null_and_part_runs(spark):
    from quire.sources import layout

    df = spark.sql("SELECT struct('um longuíssimo dois três  comprido' AS text, 'Base' AS font, 12.0D AS size, 48.0D AS x0, 60.0D AS y0, 72.0D AS y1) AS l")
    on = lambda font: lines.named(font, "bold")
    some, every = layout.pieces(F.col("l"), on), layout.pieces(F.col("l"))
    got = df.select(some.alias("p"), lines.page_runs(some, None, "bold").alias("a"), lines.page_runs(every, on, "bold").alias("b")).first()
    assert [p and p["text"] for p in got["p"]] == [None, "longuíssimo", None, None, None]
    assert [r["text"] for r in got["a"]] == ["longuíssimo"] and got["a"] == got["b"]
