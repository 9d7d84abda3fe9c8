"""Cells of records and projections on odd values."""

import pytest
from pyspark.sql import functions as F

from claimforge.functions import cells
from claimforge.operators import assembly

RECORD = """{"t": "x", "parts": ["a", {"text": "b"}, {"other": 1}, 3], "o": {"text": "c", "link": "http://l"}, "n": 5, "z": 0, "none": null, "links": [{"text": "t"}, "http://h", {"link": "http://k"}], "num": "12.5 元", "word": "abc", "lines": " p \\n\\n q", "yes": true}"""


@pytest.mark.parametrize(
    "read, name, want",
    [
        (cells.text_cell, "t", "x"), (cells.text_cell, "parts", "ab"), (cells.text_cell, "o", "c"), (cells.text_cell, "n", "5"), (cells.text_cell, "z", ""), (cells.text_cell, "none", ""), (cells.text_cell, "missing", ""),
        (cells.link_cell, "t", "x"), (cells.link_cell, "links", "http://h"), (cells.link_cell, "o", "http://l"), (cells.link_cell, "parts", ""), (cells.link_cell, "n", ""),
        (cells.number_cell, "n", 5.0), (cells.number_cell, "num", 12.5), (cells.number_cell, "word", None), (cells.number_cell, "parts", None), (cells.number_cell, "z", 0.0),
        (cells.list_cell, "lines", ["p", "q"]), (cells.list_cell, "missing", None), (cells.list_cell, "t", ["x"]),
    ],
)
def test_cells(spark, read, name, want):
    df = spark.createDataFrame([(RECORD,)], "r string").select(F.parse_json("r").alias("r"))
    assert df.select(read(F.col("r"), name).alias("v")).first().v == want


def test_errors_in_order(spark):
    kind = "read struct<kind:string,is_recoverable:boolean>, a array<struct<kind:string,is_recoverable:boolean>>, b array<struct<kind:string,is_recoverable:boolean>>"
    df = spark.createDataFrame([(("r", True), [("a", False)], None), (None, None, None)], kind)
    got = df.select(assembly.split_errors(assembly.all_errors(F.col("read"), F.col("a"), F.col("b"))).alias("s")).collect()
    assert [(r.s.stop, [e.kind for e in r.s.critical], [e.kind for e in r.s.recoverable]) for r in got] == [(True, ["a"], ["r"]), (False, [], [])]


def test_runs_without_keywords(spark):
    runs = spark.createDataFrame([(1,), (2,)], "run_id long")
    words = spark.createDataFrame([(1, "k", "x")], "run_id long, keyword_id string, keyword_text string")
    assert sorted(tuple(r) for r in assembly.keyword_rows(runs, words, "fitness").collect()) == [(1, "k", "x"), (2, "EMPTY", "")]
    assert [tuple(r) for r in assembly.keyword_rows(runs, words, "home_appliances").collect()] == [(1, "k", "x")]


def test_loader_falls_back_to_all_sections(spark):
    kind = "patent_holder string, patent_number string, application_date string, priority_date string, sections array<struct<section_name:string,section_text:string>>"
    df = spark.createDataFrame([(None, "n", "", "p", [("技术领域", "f"), ("其他", "o")]), ("h", None, "a", "p", [("发明内容", "i")]), (None, None, None, None, [])], kind)
    got = [(r.application_date, r.technical_field, r.invention_content) for r in assembly.loaded(df).collect()]
    assert got == [("p", "f", "f\no"), ("a", "", "i"), ("", "", "")]
