"""Sources, sinks, entry points and the stream."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from quire.plans import api
from quire.sources import files, layout
from quire.streaming import ingest


def test_overrides(tmp_path):
    p = tmp_path / "o.json"
    p.write_text(json.dumps({"config": {"heading_length": 99, "unknown": 1}, "drop_patterns": ["^x"], "headings": [{"page": 2, "pattern": "^A", "level": 2}], "question_box_line_exclusions": [{"pattern": "Prof.*", "ignore_case": True}]}))
    got = files.overrides(str(p))
    assert (got.heading_length, got.drop_patterns, got.headings, got.box_exclusions) == (99, ("^x",), ((2, "^A", 2),), ((None, "(?i)Prof.*"),))
    assert files.overrides(str(tmp_path / "none.json")) == files.overrides(None)


def test_inventory(spark, tmp_path):
    page = {"lines": [{"text": "Um texto", "bbox": [48, 60, 90, 72], "size": 12.0, "bold_ratio": 0.0, "font": "F", "color": 0}], "images": [], "tables": [{"bbox": [1, 2, 3, 4], "rows": [["a", None], ["b", "c"]]}]}
    (tmp_path / "a.json").write_text(json.dumps({"body_size": 12.0, "repeated_furniture": [], "pages": {"1": page, "2": page}}))
    pages = files.inventories(spark, str(tmp_path))
    assert {(r["page"], r["text"], r["x1"]) for r in files.inventory_lines(pages).collect()} == {(1, "Um texto", 90.0), (2, "Um texto", 90.0)}
    assert [r["rows"] for r in files.inventory_regions(pages).filter("page = 1").collect()] == [[["a", None], ["b", "c"]]]


def test_convert_and_validate(spark, tmp_path):
    docs = spark.createDataFrame([(1, "\n".join(f"Linha {k} de um texto qualquer que continua" for k in range(30)), "src")], "doc_id long, text string, source string")
    lines, regions = layout.lines(docs), layout.regions(docs)
    out = api.convert(lines, regions, layout.drawings(docs), layout.tables(docs), cover=False)
    written = files.write_packages(out["packages"], str(tmp_path / "books")).collect()
    assert len(written) == 1 and written[0]["n_bytes"] > 500
    back = files.packages(spark, str(tmp_path / "books"))
    assert [r["status"] for r in api.validate(back)["verdicts"].collect()] == ["partial"]
    body = json.loads(api.inspect(lines, regions).first()["json"])
    assert body["body_size"] == 12.0 and len(body["pages"]) == 3


def test_stream(spark, tmp_path):
    rows = [(1, "a b c", "s", datetime(2024, 1, 1)), (2, "a b c", "s", datetime(2024, 1, 1)), (3, "other", "s", datetime(2024, 1, 1))]
    spark.createDataFrame(rows, ingest.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ingest.run(ingest.documents(spark, str(tmp_path / "in")), lambda d: layout.lines(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
