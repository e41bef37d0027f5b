"""Registered queries over flow texts, instruction records and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom import schemas as S
from flowloom.functions import text as X
from flowloom.functions.formatting import fmt4, py_repr
from flowloom.operators import columns as C
from flowloom.operators import sampling as SP
from flowloom.operators import statistics as ST

from flowloom.plans.fixtures import FLOWS, ctes, read
from flowloom.plans.registry import query
from flowloom.plans.sampling_queries import SPLIT_CTE, WITH, clean_flows

from flowloom.session import new_folder
from flowloom.sources import tables as IO
from flowloom.sources.delimited import first_rows


def _num(c: str) -> str:
    return f'"{c}"'


def _f4(c: str) -> str:
    return f"coalesce(printf('%.4f', {_num(c)}), 'nan')"


def _measure_sql(rules) -> str:
    cells = []
    for c, word, nonzero in rules:
        test = f"coalesce({_num(c)} <> 0, true)" if nonzero else f"{_num(c)} > 0"
        cells.append(f"case when {test} then '{word} ' || {_f4(c)} end")
    return ", ".join(cells)


def _list_sql(title: str, cells: str) -> str:
    return f"'{title}: ' || nullif(concat_ws(', ', {cells}), '')"


def _int(c: str) -> str:
    return f"cast(trunc({_num(c)}) as bigint)"


TEXT_SQL = "concat_ws('. ', " + ", ".join([
    f"'Network flow with duration ' || {_f4('flow_duration')} || ' seconds'",
    f"case when \"Duration\" > 0 and \"Duration\" is distinct from flow_duration then 'total duration ' || {_f4('Duration')} end",
    f"case when \"Header_Length\" > 0 then 'header length ' || {_int('Header_Length')} || ' bytes' end",
    "case when \"Protocol Type\" = 6 then 'using TCP protocol' when \"Protocol Type\" = 17 then 'using UDP protocol' "
    "when \"Protocol Type\" = 1 then 'using ICMP protocol' when \"Protocol Type\" > 0 then 'using protocol ' || "
    f"{_int('Protocol Type')} end",
    *[f"case when {_num(c)} > 0 then '{w} rate ' || {_f4(c)} end"
      for c, w in (("Rate", "overall"), ("Srate", "source"), ("Drate", "destination"))],
    _list_sql("TCP flags", ", ".join(f"case when {_num(c)} > 0 then {_int(c)} || ' {w}' end" for c, w in X.FLAG_NAMES.items())),
    _list_sql("Flag counts", ", ".join(
        f"case when {_num(c)} > 0 then {_int(c)} || ' {w} count' end" for c, w in X.COUNT_NAMES.items())),
    _list_sql("Services", ", ".join(f"case when {_num(s)} > 0 then '{s}' end" for s in X.SERVICES)),
    _list_sql("Statistics", _measure_sql(X.STATISTICS)),
    _list_sql("Advanced metrics", _measure_sql(X.ADVANCED)),
]) + ")"
TEXTS = ctes(raw=FLOWS, v=f"select flow_id, trim(label) as label, {TEXT_SQL} as text from raw")


@query("t01_verbalise", TEXTS + "select flow_id, text from v")
def t01(spark, sf_dir):
    df = clean_flows(spark, sf_dir)
    return df.select("flow_id", X.verbalise(df).alias("text"))


@query("t02_truncate400", "select doc_id, case when length(text) > 400 then left(text, 400) || '...' else text end as text from documents")
def t02(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.truncate(F.col("text")).alias("text"))


@query("t03_text_table", TEXTS + """select flow_id, label,
  case when length(text) > 400 then left(text, 400) || '...' else text end as text,
  case when lower(label) like 'benign%' then 'Benign' else 'Attack' end as binary_label from v""")
def t03(spark, sf_dir):
    from flowloom.plans.fixtures import flows

    return X.text_table(flows(spark, sf_dir), keep=["flow_id"])


_INPUT = "'Network flow features: ' || concat_ws(', ', " + ", ".join(
    f"'{c}: ' || coalesce(cast({_num(c)} as varchar), 'nan')" for c in S.FEATURES) + ")"
RECORDS = f"(select flow_id, '{X.INSTRUCTION}' as instruction, {_INPUT} as input, label as output from f)"


@query("t04_instruction_record", WITH + f"select * from {RECORDS}")
def t04(spark, sf_dir):
    return X.instruction_records(clean_flows(spark, sf_dir), keep=["flow_id"])


@query("t05_prompt", WITH + f"""select flow_id, '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) ||
  '### Input:' || chr(10) || input || chr(10) || chr(10) || '### Response:' || chr(10) || output || '</s>' as prompt
  from {RECORDS}""")
def t05(spark, sf_dir):
    records = X.instruction_records(clean_flows(spark, sf_dir), keep=["flow_id"])
    return records.select("flow_id", X.prompt(
        F.col("instruction"), F.col("input"), F.col("output"), "</s>").alias("prompt"))


_EXPERT_SQL = "'" + X.EXPERT.replace("\n\n", "' || chr(10) || chr(10) || '") + "Network Flow: '"


@query("t06_expert_prompt", f"""select doc_id, {_EXPERT_SQL} || text || chr(10) || chr(10) || 'Answer: ' || lang || ' '
  as text from documents""")
def t06(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.expert_prompt(F.col("text"), F.col("lang")).alias("text"))


_NN = "' || chr(10) || chr(10) || '"


@query("t07_chat_prompt", f"""select doc_id, '<|begin_of_text|><|start_header_id|>system<|end_header_id|>{_NN}{X.CHAT_SYSTEM}'
  || '<|eot_id|><|start_header_id|>user<|end_header_id|>{_NN}' || {_EXPERT_SQL} || text || '{_NN}{X.CHAT_QUESTION}'
  || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>{_NN}' || lang || '<|eot_id|>' as text from documents""")
def t07(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.chat_prompt(F.col("text"), F.col("lang")).alias("text"))


_NUMBERS = """select flow_id, 'small' as kind, l / 1000000.0::double as x from (select flow_id, "Weight" as l from f)
  union all select flow_id, 'rate', "Srate" from f union all select flow_id, 'large', "Srate" * 1e9::double from f
  union all select flow_id, 'signed', "Covariance" from f"""


def _numbers(spark, sf_dir):
    df = clean_flows(spark, sf_dir)
    cells = {
        "small": F.col("Weight") / F.lit(1_000_000.0), "rate": F.col("Srate"), "large": F.col("Srate") * F.lit(1e9),
        "signed": F.col("Covariance"),
    }
    return df.select("flow_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), x.alias("x")) for k, x in cells.items()])).alias("c")).select("flow_id", "c.*")


@query("t08_py_repr", WITH + f"select flow_id, kind, cast(x as varchar) as text from ({_NUMBERS})")
def t08(spark, sf_dir):
    return _numbers(spark, sf_dir).select("flow_id", "kind", py_repr(F.col("x")).alias("text"))


@query("t09_fmt4", WITH + f"select flow_id, kind, printf('%.4f', x) as text from ({_NUMBERS})")
def t09(spark, sf_dir):
    return _numbers(spark, sf_dir).select("flow_id", "kind", fmt4(F.col("x")).alias("text"))


@query("t10_parse_features", WITH + "select flow_id, 46 as n_features, " + ", ".join(
    f"{_num(c)} as {S.snake(c)}" for c in S.FEATURES) + " from f")
def t10(spark, sf_dir):
    records = X.instruction_records(clean_flows(spark, sf_dir), keep=["flow_id"])
    parsed = records.select("flow_id", X.parse_features(F.col("input")).alias("m"))
    numbers = parsed.select("flow_id", F.size("m").alias("n_features"), X.feature_numbers(F.col("m"), S.FEATURES).alias("x"))
    nan = F.lit(float("nan"))
    return numbers.select("flow_id", "n_features", *[
        F.nullif(F.element_at("x", i + 1), nan).alias(S.snake(c)) for i, c in enumerate(S.FEATURES)])


@query("t11_render_features", WITH + """select flow_id, 'label_id: ' || cast(l_id as varchar) || '.0, weight: '
  || cast("Weight" as varchar) || ', class: ' || label as text from (select *, length(label) as l_id from f)""")
def t11(spark, sf_dir):
    df = clean_flows(spark, sf_dir)
    text = F.concat(
        F.lit(f"{X.INPUT_PREFIX}label_id: "), F.length("label").cast("string"), F.lit(", weight: "),
        py_repr(F.col("Weight")), F.lit(", broken, class: "), F.col("label"),
    )
    return df.select("flow_id", X.render_features(X.parse_features(text)).alias("text"))


@query("t12_first_token", r"""select conv_id, turn, case when regexp_extract(text, '\S+') = '' then 'Unknown'
  else regexp_extract(text, '\S+') end as token from conversations""")
def t12(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.first_token(F.col("text")).alias("token"))


@query("t13_length_budget", r"""select doc_id, len(t) as n_tokens, array_to_string(t[1:512], ' ') as text from (
  select doc_id, [x for x in regexp_split_to_array(text, '\s+') if x <> ''] as t from documents)""")
def t13(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id", X.token_count(text).cast("bigint").alias("n_tokens"), X.length_budget(text, 512).alias("text"))


@query("t14_run_label", "select distinct 'DDOS-' || event_type || '-TCP' as label from events")
def t14(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return events.select(F.concat_ws("-", F.lit("DDOS"), "event_type", F.lit("TCP")).alias("label")).distinct()


# ---- files ---------------------------------------------------------------------------------------


@query("a01_read_flow_csv", ctes(raw=FLOWS) + """select count(*) as n, round(sum("Weight"), 3) as weight,
  round(sum("Rate"), 3) as rate, count("Rate") as n_rate, count(distinct label) as n_labels
  from raw""")
def a01(spark, sf_dir):
    from flowloom.plans.fixtures import flows

    folder = new_folder(spark, "csv")
    out = flows(spark, sf_dir).drop("flow_id")
    IO.write_csv(out, folder)
    df = IO.read_flow_csv(spark, folder)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("Weight"), 3).alias("weight"),
        F.round(F.sum("Rate"), 3).alias("rate"), F.count("Rate").alias("n_rate"),
        F.count_distinct("label").alias("n_labels"))


@query("a01_unlike_files", FLOWS)
def a01_unlike(spark, sf_dir):
    """Three kinds of files in one folder: another order of columns, another separator, one column more."""
    from pyspark.sql import types as T

    from flowloom.plans.fixtures import flows

    folder = new_folder(spark, "unlike")
    rows = flows(spark, sf_dir).withColumn("kind", F.pmod(F.xxhash64("flow_id"), F.lit(3)))
    names = ["flow_id", *S.FLOW_COLUMNS]
    kinds = [(names, ","), (names[::-1], ";"), ([*names[20:], "kind", *names[:20]], "\t")]
    for kind, (columns, sep) in enumerate(kinds):
        rows.filter(F.col("kind") == kind).select(*(F.col(S.q(c)) for c in columns)).write.mode("append").options(
            header=True, sep=sep, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
            compression=IO.COMPRESSION, maxRecordsPerFile=IO.RECORDS_PER_FILE).csv(folder)
    schema = T.StructType([T.StructField("flow_id", T.StringType()), *S.FLOW_SCHEMA.fields])
    return IO.read_flow_csv(spark, folder, schema)


def event_files(spark, sf_dir):
    """The events in 30 files, in order, read back with their position."""
    folder = new_folder(spark, "ordered")
    events = read(spark, sf_dir, "events").select("event_id", "event_type")
    events.repartitionByRange(30, "event_id").sortWithinPartitions("event_id").write.option("header", True).csv(folder)
    return IO.read_flow_csv(spark, folder, events.schema, position=True)


@query("k06_file_order", """select event_id, event_type, row_number() over (order by event_id) - 1 as position from events""")
def k06(spark, sf_dir):
    return event_files(spark, sf_dir)


@query("s13_head_of_files", "select event_id, event_type from events order by event_id limit (select count(*) // 12 from events)")
def s13_files(spark, sf_dir):
    rows = event_files(spark, sf_dir)
    return first_rows(rows, rows.count() // 12).select("event_id", "event_type")


@query("s15_first_come_of_files", """with e as (select event_id, event_type, row_number() over (partition by event_type
  order by event_id) as rn from events) select event_id, event_type from e
  where rn <= (select count(*) // 12 from events)""")
def s15_files(spark, sf_dir):
    rows = event_files(spark, sf_dir)
    return SP.cap_first_come(rows, "position", rows.count() // 12, by="event_type").select("event_id", "event_type")


@query("a02_sniff_sep", WITH + "select ';' as sep, count(*) as n, count(distinct label) as n_labels from f")
def a02(spark, sf_dir):
    folder = new_folder(spark, "semicolon")
    clean_flows(spark, sf_dir).select("Rate", "Weight", "label").write.options(header=True, sep=";").csv(folder)
    sep = IO.sniff_separator(spark, folder)
    df = IO.read_delimited(spark, folder)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("n_labels")).withColumn("sep", F.lit(sep))


@query("a03_read_text_label", "select lang as label, count(*) as n, cast(sum(length(text)) as bigint) as characters from documents group by 1")
def a03(spark, sf_dir):
    folder = new_folder(spark, "texts")
    IO.write_csv(read(spark, sf_dir, "documents").select("text", F.col("lang").alias("label")), folder)
    df = IO.read_text_label(spark, folder)
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("characters"))


@query("a04_read_instructions", WITH + f"select instruction, input, output from {RECORDS}")
def a04(spark, sf_dir):
    folder = new_folder(spark, "records")
    records = X.instruction_records(clean_flows(spark, sf_dir).drop("flow_id"))
    IO.write_instructions(records, folder)
    return IO.read_instructions(spark, folder)


@query("a04_arrays_and_lines", WITH + f"select instruction, input, output from {RECORDS}")
def a04_mixed(spark, sf_dir):
    """One folder with files of lines, compact arrays and indented arrays; arrays are cut into records."""
    folder = new_folder(spark, "mixed-records")
    records = X.instruction_records(clean_flows(spark, sf_dir), keep=["flow_id"])
    kinds = records.withColumn("kind", F.pmod(F.xxhash64("flow_id"), F.lit(3))).drop("flow_id")
    IO.write_instructions(kinds.filter("kind = 0").drop("kind"), folder)
    for kind, marks in ((1, ("[", ",", "]", " ")), (2, ("[\n  ", ",\n  ", "\n]", "\n"))):
        IO.write_instruction_arrays(kinds.filter(F.col("kind") == kind).drop("kind"), folder, *marks)
    return IO.read_instructions(spark, folder)


@query("a05_write_csv", TEXTS + """select label, count(*) as n, cast(sum(length(text)) as bigint) as characters from (
  select label, case when length(text) > 400 then left(text, 400) || '...' else text end as text from v) group by 1""")
def a05(spark, sf_dir):
    from flowloom.plans.fixtures import flows

    folder = new_folder(spark, "text-csv")
    IO.write_csv(X.text_table(flows(spark, sf_dir)), folder, compression=IO.COMPRESSION)
    df = IO.read_text_label(spark, folder)
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("characters"))


def split_records(spark, sf_dir):
    df = clean_flows(spark, sf_dir)
    records = X.instruction_records(df, keep=["flow_id"])
    return SP.stratified_split(records, "flow_id", by="output")


@query("a06_write_splits", WITH + SPLIT_CTE + "select split, label as output, count(*) as n from split group by 1, 2")
def a06(spark, sf_dir):
    folder = new_folder(spark, "splits")
    IO.write_splits(split_records(spark, sf_dir).drop("flow_id"), folder)
    return IO.read_split(spark, folder).groupBy("split", "output").agg(F.count(F.lit(1)).alias("n"))


@query("a07_write_metadata", WITH + SPLIT_CTE + """select count(*) as total_samples,
  count(*) filter (split = 'train') as train_samples, count(*) filter (split = 'validation') as validation_samples,
  count(*) filter (split = 'test') as test_samples, cast(46 as bigint) as n_features,
  '""" + ",".join(S.FEATURES) + """' as feature_names, (select string_agg(label || '=' || n, ',' order by label) from c)
  as class_distribution, 'lineitem' as csv_source, false as feature_engineering_applied from split""")
def a07(spark, sf_dir):
    folder = new_folder(spark, "metadata")
    rows = split_records(spark, sf_dir).select("split", "output")
    IO.write_metadata(IO.dataset_metadata(rows, S.FEATURES, "lineitem", False), folder)
    df = IO.read_metadata(spark, folder)
    classes = F.array_join(F.transform(F.array_sort(F.map_entries("class_distribution")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return df.withColumns({"feature_names": F.array_join("feature_names", ","), "class_distribution": classes})


@query("a08_merge_parts", WITH + """select label, count(*) as n, round(sum("Weight"), 3) as weight from f group by 1""")
def a08(spark, sf_dir):
    folder = new_folder(spark, "parts")
    df = clean_flows(spark, sf_dir).select("Rate", "Weight", "label")
    IO.write_csv(df, folder)
    merged = IO.merge_parts(spark, folder, df.schema)
    return merged.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("Weight"), 3).alias("weight"))


@query("a08_merge_parts_strict", WITH + """select label, count(*) as n, """ + ", ".join(
    f'round(sum(cast("{c}" as decimal(28,9))), 3) as {c.lower()}' for c in ("Weight", "Rate")) + " from f group by 1")
def a08_strict(spark, sf_dir):
    """Part files whose columns stand in another order, and one more."""
    folder = new_folder(spark, "strict-parts")
    df = clean_flows(spark, sf_dir).select("Rate", "Weight", "label").withColumn("kind", F.pmod(F.xxhash64("Rate", "Weight"), F.lit(2)))
    for kind, columns in enumerate((["Rate", "Weight", "label"], ["kind", "label", "Weight", "Rate"])):
        df.filter(F.col("kind") == kind).select(*columns).write.mode("append").option("header", True).csv(folder)
    merged = IO.merge_parts(spark, folder, df.drop("kind").schema, "strict")
    return merged.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.sum(F.col(c).cast("decimal(28,9)")), 3).alias(c.lower()) for c in ("Weight", "Rate")])


@query("b01_validate_columns", WITH + """select label, "column", status, count(*) as n from f, (values ('Rate', 'missing'), ('kind', 'extra')) v("column", status)
  group by 1, 2, 3""")
def b01(spark, sf_dir):
    """The columns of every file of a folder, by its header, and the rows of each class that a file holds."""
    folder = new_folder(spark, "unchecked")
    df = clean_flows(spark, sf_dir).drop("flow_id").withColumn("kind", F.lit(1)).drop("Rate")
    # Every task writes its own rows: to bring classes together, all columns would be shuffled and sorted.
    df.write.options(header=True, maxRecordsPerFile=IO.RECORDS_PER_FILE).csv(folder)
    found = C.validate_files(spark, folder)
    rows = IO.read_delimited(spark, folder, T.StructType([T.StructField("label", T.StringType())]), position=False, where=True)
    per_file = rows.groupBy(F.regexp_extract("_file", "[^/]+$", 0).alias("file"), "label").agg(F.count(F.lit(1)).alias("n"))
    return per_file.join(found, "file").groupBy("label", "column", "status").agg(F.sum("n").alias("n"))


@query("b02_require_columns", WITH + "select label, count(*) as n from f group by 1")
def b02(spark, sf_dir):
    df = C.require_columns(clean_flows(spark, sf_dir), S.FLOW_COLUMNS)
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("b03_label_column", WITH + "select 'kind' as label_column, label, count(*) as n from f group by 2")
def b03(spark, sf_dir):
    """A table without ``label`` is labelled by its last column."""
    df = clean_flows(spark, sf_dir).withColumnRenamed("label", "kind")
    name = C.label_column(df)
    return df.groupBy(F.col(S.q(name)).alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("label_column", F.lit(name))


@query("g05_step_counts", WITH + """select * from (values (1, 'flows', 48), (2, 'features and label', 47), (3, 'texts', 3)) s(place, step, n_columns),
  (select count(*) as n_rows from f)""")
def g05_steps(spark, sf_dir):
    """Rows and columns behind each step of the text table, counted by the write itself."""
    counts = ST.StepCounts()
    flows = counts.step("flows", clean_flows(spark, sf_dir))
    texts = counts.step("texts", X.text_table(counts.step("features and label", flows.drop("flow_id"))))
    texts.write.parquet(new_folder(spark, "steps"))
    return counts.table(spark)


@query("a10_publish", WITH + SPLIT_CTE + """select 'SKIPPED' as second_run, split, count(*) as n from split group by 2""")
def a10(spark, sf_dir):
    from flowloom.plans import sweep

    folder = new_folder(spark, "published")
    rows = split_records(spark, sf_dir).drop("flow_id")
    sweep.publish(rows, folder, S.FEATURES, "lineitem", False)
    again = sweep.publish(rows, folder, S.FEATURES, "lineitem", False)
    out = IO.read_split(spark, folder).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("second_run", F.lit(again))


@query("a13_read_prepared", WITH + "select count(*) as n, 46 as n_features from f")
def a13(spark, sf_dir):
    from flowloom.plans import sweep

    folder = new_folder(spark, "prepared")
    sweep.publish(split_records(spark, sf_dir).drop("flow_id"), folder, S.FEATURES, "lineitem", False)
    df = sweep.read_prepared(spark, folder, len(S.FEATURES))
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("n_features", F.lit(len(S.FEATURES)))


@query("a14_completeness", """select capture_id, bool_or(event_type <> 'error' and event_id % 1000 < 500) as converted
  from (select *, cast(floor(event_id / 500) as bigint) as capture_id from events) group by 1""")
def a14(spark, sf_dir):
    from flowloom.plans.fixtures import packets

    rows = packets(spark, sf_dir)
    converted = rows.filter((F.col("eth_type") == 2048) & (F.col("packet_no") % 1000 < 500))
    return IO.completeness(rows, converted)


