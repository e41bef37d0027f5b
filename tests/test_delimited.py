"""Folders of delimited files that do not look alike, and their rows in file order."""

import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.operators import sampling as SP
from flowloom.sources import delimited as DL
from flowloom.sources import tables as IO

SCHEMA = T.StructType([T.StructField("Rate", T.DoubleType()), T.StructField("Weight", T.DoubleType()), T.StructField("label", T.StringType())])


def test_three_files_of_other_order_separator_and_one_more_column(spark, tmp_path):
    (tmp_path / "part-1.csv").write_text('Rate,Weight,label\n1,10,"a, b"\n2,20,b\n3\n4,5,c,too many\n')
    (tmp_path / "part-2.csv").write_text('label;Weight;Rate\n"x;y";30;3\nb,c;40;4\n')
    (tmp_path / "part-3.csv").write_text('Weight\tnote\tRate\tlabel\n50\t"tab\there"\t5\tc\n')
    want = {(1.0, 10.0, "a, b"), (2.0, 20.0, "b"), (3.0, None, None), (3.0, 30.0, "x;y"), (4.0, 40.0, "b,c"), (5.0, 50.0, "c")}
    assert {tuple(r) for r in IO.read_flow_csv(spark, str(tmp_path), SCHEMA).collect()} == want
    rows = IO.read_flow_csv(spark, str(tmp_path), None)
    assert rows.columns == ["Rate", "Weight", "label", "note"]
    assert {tuple(r)[:3] for r in rows.collect()} == want


def test_files_without_rows_and_columns_nobody_has(spark, tmp_path):
    (tmp_path / "part-1.csv").write_text("")
    (tmp_path / "part-2.csv").write_text("label,Rate\n")
    (tmp_path / "part-3.csv").write_text("Rate\n7\n")
    assert [tuple(r) for r in IO.read_flow_csv(spark, str(tmp_path), SCHEMA).collect()] == [(7.0, None, None)]
    (tmp_path / "part-2.csv").write_text("")
    (tmp_path / "part-3.csv").write_text("\n\n")
    assert IO.read_flow_csv(spark, str(tmp_path), SCHEMA).collect() == []
    assert IO.read_flow_csv(spark, str(tmp_path), SCHEMA, position=True).columns == [*SCHEMA.fieldNames(), "position"]


@pytest.mark.parametrize("head,sep,columns", [
    ("a,b\n1,2\n", ",", ("a", "b")), ("a;b\n1;2\n", ";", ("a", "b")), ("a\n1\n", ",", ("a",)), ("a|b|a\n", "|", ("a", "b", "a.1")),
    # The comma is in the header's text only: the lines have as many fields as the header by ';'.
    ("a, in m;b;c\n1;2;3\n4;5;6\n", ";", ("a, in m", "b", "c")),
    # Commas and spaces in quotes do not count.
    ('"a,b" "c d"\n1 2\n', " ", ("a,b", "c d")), ('x;"y\nz;z"\n1;2\n', ";", ("x", "y\nz;z")), (" a , b \n1,2\n", ",", ("a", "b")),
    ("a,b;c\n1,2;3\n", ",", ("a", "b;c")),
])
def test_layouts(head, sep, columns):
    assert DL.layout_of(head) == DL.Layout(sep, columns)


def test_odd_file_names_long_heads_and_compressed_files(spark, tmp_path):
    folder = tmp_path / "in [1] {x} 100%"
    folder.mkdir()
    (folder / "part-a b.csv").write_text("Rate,label\n1,a\n")
    (folder / "part-[2]*.csv").write_text("label;Rate\nb;2\n")
    (folder / "part-100%25.csv").write_text("Rate,label\n" + "3,c\n" * 30_000)
    rows = IO.read_flow_csv(spark, str(folder), SCHEMA)
    assert {(r.label, r.n) for r in rows.groupBy("label").agg(F.count("Rate").alias("n")).collect()} == {("a", 1), ("b", 1), ("c", 30_000)}
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write("label|Rate\nz|9\n")
    assert [tuple(r) for r in IO.read_delimited(spark, DL.literal(str(tmp_path / "x.csv.gz")), SCHEMA).collect()] == [(9.0, None, "z")]


def test_rows_are_numbered_as_one_reader_would(spark, tmp_path, monkeypatch):
    """Thirty files, some of another layout, one of many splits, rows that are dropped, files and splits dealt to tasks in any order."""
    want, n = [], 0
    for i in range(30):
        lines, sep = [], ";" if i % 4 == 1 else ","
        for j in range(4_000 if i == 7 else i % 5):
            lines.append(f"{n}{sep}x{j}")
            want.append(n)
            n += 1
            if j % 3 == 1:
                lines.append(f"9{sep}too{sep}many")
        (tmp_path / f"part-{i:02d}{' b' if i % 2 else ''}.csv").write_text(f"Rate{sep}label\n" + "".join(f"{x}\n" for x in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = IO.read_flow_csv(spark, str(tmp_path), SCHEMA, position=True)
        got = rows.collect()
        assert rows.select("position").distinct().count() == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [int(r.Rate) for r in sorted(got, key=lambda r: r.position)] == want
    assert sorted(r.position for r in got) == list(range(len(want)))
    assert sorted(int(r.Rate) for r in DL.first_rows(rows, 17).collect()) == want[:17]
    assert sorted(int(r.Rate) for r in SP.head(rows, "position", 5).collect()) == want[:5]
    kept = SP.cap_first_come(rows, "position", 3, by="label").collect()
    assert sorted(int(r.Rate) for r in kept if r.label == "x0") == [int(r.Rate) for r in sorted(got, key=lambda r: r.position) if r.label == "x0"][:3]


def test_reading_in_file_order_moves_no_rows(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-{i}.csv").write_text("Rate,label\n1,a\n")
    plan = IO.read_flow_csv(spark, str(tmp_path), SCHEMA, position=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan
