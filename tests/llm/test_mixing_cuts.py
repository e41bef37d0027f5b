"""A source whose documents all have certain copies is not cut and so not sorted."""

from flowloom.llm import mixing


def test_capped_source_has_no_cut(spark):
    known = spark.createDataFrame(
        [("capped", 65535, 5, 0.0, 0.0), ("capped", 65535, 6, 0.0, 0.0), ("open", 3, 5, 0.5, 4.0), ("open", 9, 5, 0.5, 4.0)],
        "source string, bucket int, size bigint, odds_left double, rest double")
    assert [(r.source, r.bucket, r.before) for r in mixing.cuts(known).collect()] == [("open", 3, 0)]
