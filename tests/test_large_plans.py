"""Plans whose largest task must not grow with the table."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.operators import statistics as ST
from flowloom.plans import text_queries as TQ
from flowloom.plans.catalog import QUERIES
from flowloom.sources import tables as IO


def _plan(df, physical=False):
    run = df._jdf.queryExecution()
    return (run.executedPlan() if physical else run.optimizedPlan()).toString()


def test_first_rows_are_not_sorted(spark):
    df = spark.range(1_000).select(
        (F.col("id") % 3).cast("string").alias("c"), F.concat(F.lit("k"), (999 - F.col("id")).cast("string")).alias("k"), F.col("id").alias("a b"))
    out = ST.first_rows_of(df, "c", "k", ["a b"])
    assert "Sort" not in _plan(out, physical=True)
    assert {r.c: r.first["a b"] for r in out.collect()} == {
        str(c): min(range(c, 1_000, 3), key=lambda i: f"k{999 - i}") for c in range(3)}


def test_names_are_distinct_before_they_meet(spark, small):
    lines = _plan(QUERIES["u02_name_difference"](spark, small)).split("\n")
    others = []  # the second child of each join, the side that is matched against
    for i, line in enumerate(lines):
        if "Join LeftAnti" in line:
            place = line.index("Join")
            others.append(next(x for x in lines[i + 1:] if x[place:].startswith("+- ")))
    assert len(others) == 2 and all("Aggregate" in x for x in others)


def test_headers_are_not_sorted_with_all_lines(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.createDataFrame([(1.0, "x"), (2.0, "y")], "a double, label string").write.option("header", True).csv(path)
    merged = IO.merge_parts(spark, path, T.StructType([T.StructField("a", T.DoubleType())]), "strict")
    plan = _plan(merged, physical=True)
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan
    assert sorted(r.a for r in merged.collect()) == [1.0, 2.0]


def test_csv_files_hold_a_bounded_number_of_records(spark, tmp_path):
    path = str(tmp_path / "texts")
    IO.write_csv(spark.range(95).selectExpr("concat('a\\n', id) as text", "'x' as label").coalesce(1), path, records_per_file=20)
    assert len(list(tmp_path.glob("texts/part-*.csv"))) == 5 and IO.read_text_label(spark, path).count() == 95


def test_a_large_class_is_in_many_files(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(TQ, "new_folder", lambda spark, purpose: str(tmp_path / purpose))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "10k")
    try:
        QUERIES["b01_validate_columns"](spark, small)
    finally:
        spark.conf.set(size, before)
    files = [f.read_text() for f in tmp_path.glob("unchecked/part-*.csv")]
    assert sum(",Benign,1" in f for f in files) > 1


def test_unlike_files_are_compressed(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(TQ, "new_folder", lambda spark, purpose: str(tmp_path / purpose))
    out = QUERIES["a01_unlike_files"](spark, small)
    files = list(tmp_path.glob("unlike/part-*"))
    assert files and all(f.name.endswith(".csv.gz") for f in files)
    assert len(out.select("flow_id").collect()) == spark.read.parquet(f"{small}/lineitem.parquet").count()
