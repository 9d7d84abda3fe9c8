"""Reply contracts on odd replies: counts, rejects and fallbacks."""

import pytest
from pyspark.sql import functions as F

from claimforge.functions import cells, replies
from claimforge.operators import contracts

TEXT = "1. 一种水杯。\n2. 根据权利要求1所述的水杯。"


@pytest.mark.parametrize(
    "reply, want, reasons",
    [
        (None, [], []),
        ("", [], []),
        ("{]}", [("1", "rules"), ("2", "rules")], ["NOT_JSON"]),
        ('{"claims": null}', [], []),
        ('{"claims": {"claim_id": "1"}}', [], []),
        ('{"claims": [{}]}', [("", "reply")], []),
        ('{"claims": [{"claim_id": null, "claim_type": null}]}', [("1", "rules"), ("2", "rules")], ["claim_type"]),
        ('{"claims": [{"sentence_units": "x"}, {"claim_id": "5"}]}', [("1", "rules"), ("2", "rules")], ["sentence_units"]),
        ('pre {"claims": [{"claim_id": "5", "sentence_units": []}, [1]]} post', [("5", "reply")], []),
    ],
)
def test_claims_contract(spark, reply, want, reasons):
    df = spark.createDataFrame([("t", reply, TEXT)], "task_id string, reply string, claims_text string")
    got = contracts.claims_reply(df)
    assert [(r.claim_id, r.origin) for r in got.accepted.orderBy("seq").collect()] == want and [r.reason for r in got.rejects.collect()] == reasons
    assert got.counts == {"accepted": sum(o == "reply" for _, o in want), "rejected": len(reasons)}


def test_contracts_of_no_replies(spark):
    df = spark.createDataFrame([], "task_id string, reply string, claims_text string")
    assert contracts.claims_reply(df).accepted.collect() == [] and contracts.claims_reply(df).counts == {"accepted": 0, "rejected": 0}


def test_analysis_contract(spark):
    kind = "task_id string, reply string, features array<struct<feature_id:string,claim_id:string>>"
    features = [("A", "1"), ("B", "1")]
    df = spark.createDataFrame([("n", None, features), ("x", '{"analysis": 5}', features), ("d", '[{"feature_id": "B", "claim_id": null, "reason": null}, {"feature_id": null}, {"feature_id": "Z", "reasoning_type": "根据功能推导得出"}]', features), ("e", "[]", [])], kind)
    got = contracts.analysis_reply(df)
    rows = {(r.task_id, r.feature_id): (r.origin, r.comparison_result, r.claim_id) for r in got.accepted.collect()}
    assert rows == {("n", "A"): ("missing", "UNCERTAIN", "1"), ("n", "B"): ("missing", "UNCERTAIN", "1"), ("x", "A"): ("format", "UNCERTAIN", "1"), ("x", "B"): ("format", "UNCERTAIN", "1"), ("d", "B"): ("reply", "UNCERTAIN", ""), ("d", "Z"): ("reply", "MATCH", ""), ("d", "A"): ("missing", "UNCERTAIN", "1")}
    assert sorted((r.task_id, r.reason) for r in got.rejects.collect()) == [("d", "feature_id"), ("x", "NOT_A_LIST")]


@pytest.mark.parametrize("value, want", [("0", False), ("-0.0", False), ("0.5", True), ('""', False), ('" "', True), ('"0"', True), ("[]", False), ("[0]", True), ("{}", False), ("null", False), ("false", False), ("true", True)])
def test_truth_of_values(spark, value, want):
    df = spark.createDataFrame([('{"k": ' + value + "}",)], "s string").select(F.parse_json("s").alias("v"))
    assert df.select(replies.said(replies.field(F.col("v"), "k")).isNotNull().alias("x")).first().x is want


@pytest.mark.parametrize("price, want", [("0", "0"), ("12", "12"), ("1.5", "1.5"), ('"¥ 3"', "¥ 3"), ('""', ""), ("null", "")])
def test_prices_of_records(spark, price, want):
    df = spark.createDataFrame([('{"价格": ' + price + "}",)], "s string").select(F.parse_json("s").alias("v"))
    assert df.select(cells.product_record(F.col("v"), F.lit(1))["price"].alias("p")).first().p == want
