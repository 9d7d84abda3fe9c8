"""The keyword plan on small records of each variant: odd rows, attempts, and what is said if nothing is written."""

import pytest
from pyspark.sql import functions as F

from claimforge.functions import replies
from claimforge.operators import keywording

RECORD = "record_id long, variant string, patent_number string, patent_holder string, technical_field string, background_tech string, invention_content string"
CLAIM = "record_id long, seq int, claim_id string, claim_type string, claim_text string"
REPLY = "record_id long, seq int, stage string, attempt int, reply string"
TERMS = [("extraction", "1. 保温"), ("filtering", '{"filtered_core_terms": [{"text": "保温"}]}')]


def said(record, seq, combination, more=TERMS):
    return [(record, seq, s, 0, r) for s, r in (*more, ("combination", combination))]


@pytest.fixture(scope="module")
def result(spark):
    one = '[{"keyword_text": " 保温杯 ", "confidence": 0.9}]'
    records = [
        (1, "general", "P1", "张三", None, None, None),  # every keyword breaks a guardrail
        (2, "general", "P2", "甲公司", "水壶", None, None),  # no claims; attempts
        (3, "general", "P3", None, None, " ", ""),  # no claims and no context
        (4, "home_appliances", "P4", None, None, None, "x"),  # no claims
        (5, "home_appliances", "P5", None, None, None, None),  # blank claim ids; two claims say the same
        (6, "fitness", "P6", None, None, None, None),  # a blank id, a claim without a reply, one without a list
        (7, None, "P7", None, None, None, None),  # no variant
        (8, "fitness", "P8", None, None, None, None),  # no valid claim
        (1, "general", "P1", "张三", None, None, None),
    ]
    claims = [
        (1, 4, "3", "INDEPENDENT", "a"), (1, 2, " 1 ", "DEPENDENT", "b"), (5, 1, None, "INDEPENDENT", "a"), (5, 2, "2", "DEPENDENT", "b"), (5, 3, "", "INDEPENDENT", "c"),
        (6, 1, " ", "INDEPENDENT", "a"), (6, 2, "2", "INDEPENDENT", "b"), (6, 3, "3", "INDEPENDENT", "c"), (7, 1, "9", None, "a"), (8, 1, "1", None, None), (None, 1, "1", None, "x"),
    ]
    rows = [*said(1, 2, '[{"keyword_text": "a"}, {"keyword_text": "a、bcd"}]'), *said(1, 4, one), *said(2, None, "[broken"), (2, None, "combination", 1, one), (2, None, "product_objects", 0, '{"primary_product_object": "杯", "search_product_objects": ["锅", "水 壶"]}'), *said(3, None, one), *said(4, None, one)]
    rows += [*said(5, 1, one), *said(5, 3, one), *said(6, 1, one), *said(6, 3, "保温杯子"), *said(7, 1, one, [("extraction", "1. 保温"), ("filtering", "nothing")]), *said(8, 1, one), (None, None, "combination", 0, one)]
    frames = (spark.createDataFrame(v, s) for v, s in ((records, RECORD), (claims, CLAIM), (rows, REPLY)))
    return keywording.keyworded(*frames)


def test_written_keywords(result):
    got = sorted((r.record_id, r.claim_id, r.keyword_text, r.keyword_type, r.confidence_score) for r in result.stored.collect())
    assert got == [
        (2, "P2", "保温杯", "COMBINED", 0.9), (2, "P2", "甲同款水 壶", "HOLDER_BASED", 0.88),
        (5, "RECORD-1", "保温杯", "COMBINED", 0.9), (5, "RECORD-2", "保温杯", "COMBINED", 0.9), (7, "9", "保温杯", "COMBINED", 0.9),
    ]


def test_empty_rows(result):
    rows = result.assembled.filter("keyword_type = 'EMPTY'").collect()
    assert sorted((r.record_id, r.seq, r.claim_id, r.generation_method, r.confidence_score) for r in rows) == [(1, 2, " 1 ", "NONE", None), (6, 2, "2", "NONE", None), (6, 3, "3", "NONE", None)]
    assert result.assembled.count() == result.assembled.select("keyword_id").distinct().count()


def test_runs(result):
    got = {r.record_id: (r.workflow_variant, r.keywords_count, r.exception_type) for r in result.runs.collect()}
    assert got == {
        1: ("general", 0, "NO_VALID_KEYWORDS"), 2: ("general", 2, ""), 3: ("general", 0, "NO_KEYWORDS_TO_WRITE"), 5: ("home_appliances", 2, ""),
        6: ("fitness_equipment", 0, ""), 7: ("general", 1, ""), 8: ("fitness_equipment", 0, "NO_KEYWORDS_TO_WRITE"),
    }


def test_empty_tables(spark):
    out = keywording.keyworded(*(spark.createDataFrame([], s) for s in (RECORD, CLAIM, REPLY)))
    assert out.stored.isEmpty() and out.runs.isEmpty()


@pytest.mark.parametrize(
    "reply, want",
    [
        (None, []), ("", []), ("{broken}", []), ('{"terms": [{"text": "a"}]}', []), ('{"filtered_core_terms": {"text": "a"}}', []), ('[{"filtered_core_terms": [{"text": "b"}]}]', [("b", "unknown", "", 0.8)]),
        ('x {"filtered_core_terms": ["a", {"text": ""}, {"text": "b", "category": "c", "source_location": "s", "confidence": 0.1}]} y', [("b", "c", "s", 0.1)]),
    ],
)
def test_strict_terms(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "reply string")
    assert [tuple(x) for x in df.select(replies.strict_terms(F.col("reply"))).first()[0]] == want
