"""Texts, prompts and number formats."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowloom.functions import text as X
from flowloom.functions.formatting import fixed, fmt4, py_repr
from flowloom.functions.labels import binary_label, canon_label
from flowloom.schemas import q


def one(spark, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{q(c)} double" for c in names))


def described(spark, **values):
    df = one(spark, **values)
    return df.select(X.verbalise(df)).first()[0]


def test_numbers(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1e-5, 5e-5, -5e-5, 1e-4, 59.46375, 0.03125, 0.00015, 1e7, 12345678.9, 1e15, 123456789012.34565,
              82847891734956.33, 8.566889401254952e17]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 14) for _ in range(3000)]
    values += [rng.randint(0, 10**9) / 20000 for _ in range(3000)]
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", py_repr(F.col("x")).alias("r"), fmt4(F.col("x")).alias("f")).collect()
    for r in rows:
        if r.x < 1e16:
            assert r.r == repr(r.x)
        assert r.f == f"{r.x:.4f}"


def test_all_sections(spark):
    text = described(spark, **{
        "flow_duration": 0.5, "Duration": 64.0, "Header_Length": 54.9, "Protocol Type": 6.0, "Rate": 1.25, "Srate": 0.0,
        "Drate": 3.0, "syn_flag_number": 1.0, "ack_flag_number": 2.0, "rst_count": 3.0, "HTTP": 1.0, "LLC": 1.0,
        "Tot sum": 10.0, "Min": -1.0, "AVG": 2.0, "IAT": 0.1, "Covariance": -0.5, "Weight": 7.0})
    assert text == (
        "Network flow with duration 0.5000 seconds. total duration 64.0000. header length 54 bytes. using TCP protocol. "
        "overall rate 1.2500. destination rate 3.0000. TCP flags: 1 SYN, 2 ACK. Flag counts: 3 RST count. "
        "Services: HTTP, LLC. Statistics: total sum 10.0000, minimum -1.0000, average 2.0000. "
        "Advanced metrics: inter-arrival time 0.1000, covariance -0.5000, weight 7.0000")


@pytest.mark.parametrize("value,words", [(6.5, "using protocol 6"), (17.0, "using UDP protocol"), (1.0, "using ICMP protocol"), (0.0, None)])
def test_protocols(spark, value, words):
    text = described(spark, **{"flow_duration": 1.0, "Protocol Type": value})
    assert text == "Network flow with duration 1.0000 seconds" + (f". {words}" if words else "")


def test_missing_values(spark):
    text = described(spark, **{"flow_duration": math.nan, "Duration": 2.0, "Min": math.nan, "Covariance": None, "Max": math.nan, "Rate": math.nan})
    assert text == (
        "Network flow with duration nan seconds. total duration 2.0000. Statistics: minimum nan. "
        "Advanced metrics: covariance nan")


def test_truncation(spark):
    df = spark.createDataFrame([("a" * 400,), ("a" * 401,)], "t string").select(X.truncate(F.col("t")))
    assert [r[0] for r in df.collect()] == ["a" * 400, "a" * 400 + "..."]


def test_records_round_trip(spark):
    df = spark.createDataFrame([(1.0, 2, 1e-5, "XSS")], "a double, b int, `c d` double, label string")
    record = X.instruction_records(df).first()
    assert record.input == "Network flow features: a: 1.0, b: 2, c d: 1e-05" and record.output == "XSS"
    parsed = X.instruction_records(df).select(X.parse_features(F.col("input")).alias("m"))
    assert parsed.first().m == {"a": "1.0", "b": "2", "c d": "1e-05"}
    assert parsed.select(X.render_features(F.col("m"))).first()[0] == "a: 1.0, b: 2.0, c d: 1e-05"


def test_parse_quirks(spark):
    df = spark.createDataFrame([("Network flow features: a: 1, junk, b: x: y, a: 2",)], "t string")
    assert df.select(X.parse_features(F.col("t"))).first()[0] == {"a": "2", "b": "x: y"}


def test_first_token_and_budget(spark):
    df = spark.createDataFrame([("  Benign because\nof",), ("   ",), (None,)], "t string")
    assert [r[0] for r in df.select(X.first_token(F.col("t"))).collect()] == ["Benign", "Unknown", "Unknown"]
    assert df.select(X.length_budget(F.col("t"), 2)).first()[0] == "Benign because"


def test_prompts(spark):
    df = spark.createDataFrame([("T", "L")], "t string, l string")
    t, label = F.col("t"), F.col("l")
    assert df.select(X.prompt(t, t)).first()[0] == "### Instruction:\nT\n\n### Input:\nT\n\n### Response:\n"
    assert df.select(X.prompt(t, t, label, "</s>")).first()[0].endswith("### Response:\nL</s>")
    assert df.select(X.expert_prompt(t, label)).first()[0].endswith("Network Flow: T\n\nAnswer: L ")
    assert df.select(X.chat_prompt(t, label)).first()[0].endswith("<|start_header_id|>assistant<|end_header_id|>\n\nL<|eot_id|>")


def test_labels(spark):
    df = spark.createDataFrame([(" ddos-X ",), ("BenignTraffic",), ("Benign2",), (" XSS ",)], "l string")
    assert [tuple(r) for r in df.select(canon_label(F.col("l")), binary_label(F.col("l"))).collect()] == [
        ("DDoS", "Attack"), ("Benign", "Benign"), ("Benign2", "Benign"), ("XSS", "Attack")]


def test_text_needs_no_python(spark):
    df = one(spark, flow_duration=1.0, Rate=2.0).withColumn("label", F.lit("x"))
    plan = X.text_table(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_fixed_decimals_round_the_binary_value(spark):
    values = [0.0, 0.005, 0.015, 0.025, 2.675, 0.125, 0.375, 12.25, 12.35, 0.05, 0.15, 0.25, -0.125, -2.5, 99.95, 1e-9, 4.5e11, 123456.785]
    for places in (1, 2, 4):
        df = spark.createDataFrame([(v,) for v in values], "x double").select("x", fixed(F.col("x"), places).alias("t"))
        assert {r.x: r.t for r in df.collect()} == {v: f"{v:.{places}f}" for v in values}


def test_feature_numbers(spark):
    df = spark.createDataFrame([("Network flow features: b: 2, a: 1e-05, c: x, junk, d: nan",), ("a: 1, b: 2",), ("a: 3, a: 4",), (None,)], "t string")
    rows = df.select(X.parse_features(F.col("t")).alias("m")).select(X.feature_numbers(F.col("m"), ["a", "b", "c", "e"]).alias("x")).collect()
    assert [r.x for r in rows] == [[1e-05, 2.0, None, None], [1.0, 2.0, None, None], [4.0, None, None, None], [None] * 4]


def test_parsed_features_are_looked_up_once(spark, small):
    """No lookup per column in the method of the stage, and one cut of the text."""
    from flowloom.plans.catalog import QUERIES

    plan = QUERIES["t10_parse_features"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    # the interpreted lambda's lookup, not 46 of them
    assert plan.count("element_at(m#") == 1 and plan.count("split(") == 1
