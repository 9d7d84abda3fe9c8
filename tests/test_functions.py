"""Golden cases of the functions, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from claimforge.functions import keywords, patent, replies, rules, text

PATENT = """专利号：CN123
技术领域
本发明涉及扫地机。

背景技术
现有技术不足。

发明内容
目的是改进。

权利要求书
1. 一种装置，其特征在于，包括：主体；电池；
轮子。
2. 根据权利要求1所述的装置，其特征在于所述主体为圆形。
3. 如权利要求 1 所述的装置，带有灯。
4、根据权利要求2所述的装置。
5：一种方法，包括步骤一；步骤二；步骤三。完成。

说明书附图
图1是整体图；
"""


def value(spark, column, **inputs):
    df = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<string>'}" for k, v in inputs.items()) or "x string") if inputs else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("said, want", [("匹配", "matching"), ("MATCH", "matching"), ("相同", "matching"), ("等同", "matching"), ("不匹配", "not_matching"), ("NOT_MATCH", "not_matching"), ("NO_MATCH", "not_matching"), ("no-match", "not_matching"), ("no match", "not_matching"), ("不同", "not_matching"), ("区别", "not_matching"), ("", "uncertain"), (None, "uncertain"), ("unknown", "uncertain"), ("是match吗", "matching"), ("matched", "uncertain")])
def test_status(spark, said, want):
    assert value(spark, rules.status(F.col("s")), s=said) == want


@pytest.mark.parametrize("kind, reason, want", [("文字直接公开", "", "MATCH"), ("可判断不具有", "", "NO_MATCH"), ("相关信息缺失", "产品明确没有它", "NO_MATCH"), ("相关信息缺失", "未提及", "UNCERTAIN"), ("相关信息缺失", None, "UNCERTAIN"), ("别的", "", "UNCERTAIN"), (None, None, "UNCERTAIN")])
def test_rule_result(spark, kind, reason, want):
    assert value(spark, rules.rule_result(F.col("k"), F.col("r")), k=kind, r=reason) == want


@pytest.mark.parametrize("said, want", [("无", ("general", 0.4)), ("健身 空调", ("fitness_equipment", 0.5)), ("家电 冰箱 Treadmill", ("home_appliances", 0.67)), (None, ("general", 0.4))])
def test_industry(spark, said, want):
    assert tuple(value(spark, rules.industry(F.col("s")), s=said)) == want


def test_claims_of_a_patent(spark):
    df = spark.createDataFrame([("t", PATENT)], "task_id string, raw_text string").withColumn("claims_text", patent.claims_block(F.col("raw_text")))
    rows = patent.claims(df).orderBy("seq").collect()
    assert [(r.claim_id, r.claim_type, r.parent_claim_id) for r in rows] == [("1", "INDEPENDENT", None), ("2", "DEPENDENT", "1"), ("3", "DEPENDENT", "1"), ("4", "DEPENDENT", "2"), ("5", "INDEPENDENT", None)]
    assert [len(r.sentence_units) for r in rows] == [3, 1, 1, 1, 4]
    depth = {r.claim_id: r.depth for r in patent.claim_depth(patent.claims(df)).collect()}
    assert depth == {"1": 0, "2": 1, "3": 1, "4": 2, "5": 0}


def test_sections_of_a_patent(spark):
    df = spark.createDataFrame([("t", PATENT)], "task_id string, raw_text string")
    rows = patent.sections(df).orderBy("seq").collect()
    assert [r.section_name for r in rows] == ["技术领域", "背景技术", "发明内容", "附图说明"]
    for r in rows:
        assert PATENT[r.start_position : r.end_position].strip() == r.section_text
    told = patent.figure_descriptions(patent.sections(df)).collect()
    assert [(r.figure_id, r.description) for r in told] == [("图1", "整体图")]


def test_claim_errors(spark):
    assert [e.error_type for e in value(spark, patent.claim_errors(F.col("s")), s="短")] == ["CLAIMS_PARSE_ERROR", "CLAIMS_NUMBERING_ERROR"]
    assert value(spark, patent.claim_errors(F.col("s")), s="1. 一种足够长的装置说明") == []


def test_features(spark):
    got = value(spark, patent.features(F.lit("1"), F.col("s")), s="一种装置，其特征在于，包括：主体；以及电池；主体；其中，轮子。")
    assert [(f.feature_id, f.feature_text) for f in got] == [("1A", "一种装置"), ("1B", "主体"), ("1C", "电池"), ("1D", "轮子")]
    comma = value(spark, patent.features(F.lit("2"), F.col("s")), s="装置包含主体，所述主体为圆形，红色")
    assert [f.feature_text for f in comma] == ["装置", "主体", "所述主体为圆形，红色"]
    assert value(spark, patent.features(F.lit("3"), F.col("s")), s=None) == []
    many = value(spark, patent.features(F.lit("4"), F.col("s")), s="物包括" + "；".join(f"件{i}" for i in range(40)))
    assert len(many) == 26 and many[-1].feature_id == "4Z"


def test_metadata_is_null_without_codes(spark):
    assert all(v is None for v in value(spark, patent.metadata(F.col("s")), s=PATENT))


def test_white_space_is_unicode(spark):
    assert value(spark, text.strip(F.col("s")), s="\u3000 a\u3000b \n") == "a\u3000b"
    assert value(spark, text.no_ws(F.col("s")), s="\u3000a\u3000b ") == "ab"
    assert value(spark, text.first_non_blank("a", "b"), a="\u3000", b=" x ") == "x"


@pytest.mark.parametrize("said, bad", [("ab", True), ("a" * 19, True), ("智能/水杯", True), ("扫地扫地机", True), ("智能水杯", False), ("用于清洁地面的扫地机器人", True), ("用于扫地", False), (None, True)])
def test_guardrail(spark, said, bad):
    assert value(spark, keywords.breaks_guardrail(F.col("s")), s=said) is bad


@pytest.mark.parametrize("holder, name", [("深圳市大光科技有限公司", "深圳市大光"), ("Acme Robotics, Inc.", "Acme"), ("石头（北京）集团", "石头"), ("", ""), (None, "")])
def test_holder_name(spark, holder, name):
    got = value(spark, keywords.holder_name(F.col("h")), h=holder)
    assert name == got or (name and got.startswith(name))


def test_holder_keyword(spark):
    c = keywords.holder_keyword(F.col("h"), F.col("p"), F.col("s"), F.col("o"))
    assert value(spark, c, h="小米科技有限责任公司", p="装置", s=["用于清洁", "扫地机"], o=["x"]).keyword_text.endswith("同款扫地机")
    assert value(spark, c, h="张三", p="装置", s=["扫地机"], o=[]) is None


@pytest.mark.parametrize("said, want", [('```json\n{"a": [1, 2,],}\n```', '{"a":[1,2]}'), ('x {"a": 1} y', '{"a":1}'), ("[1,2", None), (None, None)])
def test_tolerant_json(spark, said, want):
    assert value(spark, F.to_json(replies.tolerant_json(F.col("s"))), s=said) == want


def test_python_literals(spark):
    df = spark.createDataFrame([("{'a': [1, None]}",), ("no",), (None,)], "s string")
    assert [r.v for r in df.select(replies.python_literal_json("s").alias("v")).collect()] == ['{"a": [1, null]}', None, None]


def test_filtered_terms(spark):
    c = replies.filtered_terms(F.col("s"), F.col("o"))
    terms = lambda x: [(y.text, y.confidence) for y in x.terms]
    got = value(spark, c, s='{"core_terms": ["水杯", {"term": "灯", "confidence": 0}, {"text": "轮", "score": 0.5}]}', o=["z"])
    assert terms(got) == [("水杯", 0.7), ("灯", 0.8), ("轮", 0.5)]
    got = value(spark, c, s="nothing", o=[str(i) for i in range(20)])
    assert terms(got) == [(str(i), 0.6) for i in range(12)] and got.log == replies.FILTER_NOTICE
    assert terms(value(spark, c, s="{'Core Terms': [{'Term': '灯', 'on': True},]}", o=[])) == [("灯", 0.8)]
    assert value(spark, c, s="nothing", o=[]).log == "" and terms(value(spark, c, s=None, o=["a"])) == [("a", 0.6)]


def test_other_replies(spark):
    assert tuple(value(spark, replies.product_objects(F.col("s")), s='{"primary_product_object": "杯", "search_product_objects": ["碗"]}')) == ("杯", ["碗"])
    assert tuple(value(spark, replies.product_objects(F.col("s")), s="结果：杯，碗、盘")) == ("杯", ["碗", "盘"])
    assert value(spark, replies.grounded(F.col("o"), F.col("p"), F.col("c")), o=["扫 地", "杯", "灯"], p="灯", c="一种扫地的灯") == ["扫 地"]
    assert tuple(value(spark, replies.invention_point(F.col("s"), F.lit("general")), s="a|b|c")) == ("a", "b", "")
    assert tuple(value(spark, replies.invention_point(F.col("s"), F.lit("home_appliances")), s="a|x|b|c")) == ("a|x", "b", "c")
    assert [x.text for x in value(spark, replies.listed_terms(F.col("s")), s="1. 甲\n2、乙\n\n")] == ["甲", "乙"]
    assert [tuple(k) for k in value(spark, replies.combined_keywords(F.col("s")), s="甲乙丙\n1. 丁")] == [("甲乙丙", "unknown", "text_extraction", 0.6), ("1. 丁", "unknown", "text_extraction", 0.6)]
    assert [f.feature_id for f in value(spark, replies.reply_features(F.col("s"), F.lit("1")), s='{"features": [{"feature_id": "1A", "feature_text": "x"}, {"feature_id": "", "feature_text": "y"}]}')] == ["1A"]
    assert tuple(value(spark, replies.tagged_lists(F.col("s")), s="{x}\n使用场景：\n1. 家里\n人群：\n- 老人\n- 孩子")) == (["家里"], ["老人", "孩子"])
    assert [s.text for s in value(spark, replies.scene_words(F.col("s")), s='[{"text": "室内", "category": "usage_environment"}, "户外"]')] == ["室内", "户外"]
    own = F.transform("o", lambda x: F.struct(x.alias("text"), F.lit("").alias("source"), F.lit("").alias("type")))
    got = value(spark, replies.refined_terms(F.col("s"), own), s="精炼说明：", o=["原"])
    assert [x.text for x in got.terms] == ["原"] and got.log == replies.REFINE_NOTICE
    assert value(spark, replies.flat_content(F.col("s")), s='[{"type": "text", "text": "a"}, "b"]') == "ab"


@pytest.mark.parametrize("path, want", [("http://x/a.JPG?id=1", ("image", ".JPG")), ("/a/b.tar", ("default", ".tar")), ("/a/b", ("default", "")), ("x.PDF", ("document", ".PDF"))])
def test_file_kind(spark, path, want):
    assert tuple(value(spark, rules.file_kind(F.col("p")), p=path)) == want


def test_figure_ids(spark):
    df = spark.createDataFrame([([["图1"], [], ["图1", "图3"], []],)], "l array<array<string>>")
    assert df.select(patent.figure_ids(F.col("l")).alias("v")).first().v == ["图1", "图2", "图3", "图4"]
    left = patent.figure_ids(F.col("l"), F.array(F.lit("图9"), F.lit("图3")), F.array(F.lit("图7")))
    assert df.select(left.alias("v")).first().v == ["图1", "图9", "图3", "图5"]


def test_figure_pages(spark):
    rows = [("d", 1, "正文" * 300, 0, 0), ("d", 2, "附图说明 " + "字" * 300, 0, 0), ("d", 3, "图1", 1, 0), ("d", 4, "", 1, 3), ("e", 1, "x" * 900, 0, 0)]
    pages = spark.createDataFrame(rows, "doc string, page int, text string, images int, drawings int")
    assert {(r.doc, r.page) for r in patent.figure_page(pages).filter("is_figure").collect()} == {("d", 3), ("d", 4)}
    assert {r.page for r in patent.trailing_pages(pages).collect()} == {3, 4}
    assert {r.doc: r.pages for r in patent.candidate_pages(pages).collect()} == {"d": [3, 4], "e": []}
    described = spark.createDataFrame([("d", 1), ("e", 1)], "doc string, n int")
    assert {r.doc: r.pages for r in patent.candidate_pages(pages, described).collect()} == {"d": [4], "e": [1]}
    spaced = [("a", 1, "附 图\n说 明" + "字" * 900, 0, 0), ("a", 2, "字" * 900, 0, 0), ("b", 1, "附图说明" + "字" * 900, 0, 0), ("b", 2, "字" * 900 + "说明书 附图", 0, 0), ("b", 3, "图1", 1, 1)]
    found = patent.candidate_pages(spark.createDataFrame(spaced, "doc string, page int, text string, images int, drawings int"), described)
    assert {r.doc: r.pages for r in found.collect()} == {"a": [2], "b": [2]}


def test_small_texts(spark):
    assert value(spark, text.keyword_list(F.col("s")), s="a，b\nA, a ,") == ["a", "b", "A"]
    assert value(spark, text.string_array(F.col("s")), s='["u", " ", null]') == ["u"] and value(spark, text.string_array(F.col("s")), s="u") == ["u"]
    assert value(spark, text.report_file_name(F.col("s")), s='a<b>:c  d') == "a-b-c-d"
    assert value(spark, patent.app_token(F.col("s")), s="https://x/base/AbC123?t=1") == "AbC123"
    assert value(spark, rules.recoverable(F.col("s")), s="Fetch failed") is True
    assert value(spark, rules.image_mime(F.col("s")), s="a.JPEG") == "image/jpeg"
    assert value(spark, patent.subject(F.col("s")), s="demo_测试") is None


def test_claim_depth_of_long_chains_and_cycles(spark):
    rows = [(1, str(i), str(i - 1) if i > 1 else None) for i in range(1, 101)] + [(2, "1", "2"), (2, "2", "1"), (2, "3", "1"), (2, "4", "9"), (2, "5", "5")]
    got = {(r.task_id, r.claim_id): r.depth for r in patent.claim_depth(spark.createDataFrame(rows, "task_id int, claim_id string, parent_claim_id string")).collect()}
    assert got == {(1, str(i)): i - 1 for i in range(1, 101)} | {(2, "1"): None, (2, "2"): None, (2, "3"): None, (2, "4"): 1, (2, "5"): None}
