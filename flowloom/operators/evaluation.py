"""Metrics of predictions against true labels, as tables.

Everything comes from one aggregate: the counts of (true, predicted) pairs,
which has at most classes x classes rows whatever the number of predictions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.formatting import fixed, fmt4
from flowloom.operators.bounded import bounded_rows
from flowloom.operators.statistics import time_statistics
from flowloom.session import materialise

TRUE, PREDICTED = "true", "predicted"


def pair_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(TRUE, PREDICTED).agg(F.count(F.lit(1)).alias("n"))


def join_truth(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Predictions next to the true label of the same row."""
    return predictions.join(truth, key)


def labels_of(pairs: DataFrame) -> DataFrame:
    """Labels that occur as truth or prediction."""
    return pairs.select(F.explode(F.array(TRUE, PREDICTED)).alias("label")).filter("label is not null").distinct()


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(F.when(F.col(TRUE) == F.col(PREDICTED), 1.0).otherwise(0.0)).alias("accuracy"))


def per_class(pairs: DataFrame) -> DataFrame:
    """``label, precision, recall, f1, support``; 0 where a ratio has no denominator.

    Every pair row is counted once under its true and once under its predicted
    label, so one aggregate gives all three counts.
    """
    hit = F.col(TRUE) == F.col(PREDICTED)
    sides = F.explode(F.array(
        F.struct(F.col(TRUE).alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("chosen"),
                 F.when(hit, F.col("n")).otherwise(F.lit(0)).alias("tp")),
        F.struct(F.col(PREDICTED).alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("chosen"),
                 F.lit(0).cast("bigint").alias("tp")),
    )).alias("s")
    sums = pairs.select(sides).select("s.*").groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("tp").alias("tp"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    out = sums.select("label", "support", ratio(F.col("tp"), F.col("chosen")).alias("precision"),
                      ratio(F.col("tp"), F.col("support")).alias("recall"))
    both = F.col("precision") + F.col("recall")
    f1 = ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), both)
    return out.select("label", "precision", "recall", f1.alias("f1"), "support")


def weighted(classes: DataFrame) -> DataFrame:
    """Support-weighted precision, recall and F1, and the total support."""
    def mean(c: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))

    return classes.agg(
        mean("precision").alias("precision_weighted"), mean("recall").alias("recall_weighted"),
        mean("f1").alias("f1_weighted"), F.sum("support").alias("support_total"),
    )


def confusion_matrix(pairs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """One row per true label, one column per predicted label, zeros filled, labels sorted."""
    names = labels_of(pairs)
    if labels is None:
        labels = sorted(r[0] for r in bounded_rows(names))
    wide = pairs.groupBy(TRUE).pivot(PREDICTED, labels).agg(F.sum("n"))
    rows = names.select(F.col("label").alias(TRUE)).join(wide, TRUE, "left")
    return rows.select(TRUE, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in labels])


def confusion(pairs: DataFrame) -> DataFrame:
    """``true, predicted, n`` for every pair of labels, zeros included: the matrix, unpivoted.

    The counts are written first, as they are read three times and may stand behind a model that scores the whole table.
    """
    pairs = materialise(pairs, "pairs")
    labels = sorted(r[0] for r in bounded_rows(labels_of(pairs)))
    matrix = confusion_matrix(pairs, labels)
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias(PREDICTED), F.col(f"`{c}`").alias("n")) for c in labels
    ])).alias("cell")
    return matrix.select(TRUE, cells).select(TRUE, "cell.*")


def metrics_table(df: DataFrame) -> DataFrame:
    """``name, value`` of all scalar metrics."""
    pairs = pair_counts(df)
    hits = F.sum(F.when(F.col(TRUE) == F.col(PREDICTED), F.col("n")).otherwise(F.lit(0)))
    acc = pairs.agg(F.try_divide(hits.cast("double"), F.sum("n")).alias("value"))
    scalars = weighted(per_class(pairs))
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in scalars.columns
    ])).alias("m")
    return acc.select(F.lit("accuracy").alias("name"), "value").unionByName(scalars.select(stacked).select("m.*"))


def outcome_sample(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows with ``[SUCCESS]`` or ``[FAILED]``."""
    status = F.when(F.col(TRUE) == F.col(PREDICTED), "[SUCCESS]").otherwise("[FAILED]")
    return df.orderBy(key).limit(n).select(key, TRUE, PREDICTED, status.alias("outcome"))


def loss_curves(log: DataFrame) -> DataFrame:
    """``step, curve, value`` for the logged training and evaluation losses."""
    cells = F.explode(F.array(
        F.struct(F.lit("loss").alias("curve"), F.col("loss").alias("value")),
        F.struct(F.lit("eval_loss").alias("curve"), F.col("eval_loss").alias("value")),
    )).alias("c")
    return log.select("step", cells).select("step", "c.*").filter("value is not null")


def compare_configs(df: DataFrame, config: str) -> DataFrame:
    """``config, accuracy, f1_weighted`` per configuration, from one aggregate of pairs."""
    pairs = df.groupBy(config, TRUE, PREDICTED).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(TRUE) == F.col(PREDICTED), F.col("n")).otherwise(F.lit(0))
    by_true = Window.partitionBy(config, TRUE)
    by_predicted = Window.partitionBy(config, PREDICTED)
    sized = pairs.withColumns({
        "hit": hit, "support": F.sum("n").over(by_true), "chosen": F.sum("n").over(by_predicted),
    })
    # F1 of a class is 2 tp / (support + chosen); classes without a hit add 0.
    f1 = F.try_divide(F.lit(2.0) * F.col("hit"), F.col("support") + F.col("chosen"))
    return sized.groupBy(config).agg(
        F.try_divide(F.sum("hit").cast("double"), F.sum("n")).alias("accuracy"),
        F.try_divide(F.sum(F.when(F.col("hit") > 0, f1 * F.col("support"))), F.sum("n")).alias("f1"),
    ).select(config, "accuracy", F.coalesce("f1", F.lit(0.0)).alias("f1_weighted"))


def report(df: DataFrame, time_column: str) -> DataFrame:
    """``section, line_no, text``: overall, per class, inference and distribution sections; line 0 is the head of a table."""
    pairs = pair_counts(df)
    classes = per_class(pairs)
    total = F.sum("support").over(Window.partitionBy(F.lit(1)))  # one row per class
    times = time_statistics(df, time_column)

    def line(section: str, number: Column | int, text: Column) -> tuple[Column, ...]:
        number = F.lit(number) if isinstance(number, int) else number
        return F.lit(section).alias("section"), number.cast("int").alias("line_no"), text.alias("text")

    def rows(source: DataFrame, section: str, items: list[tuple[str, Column]]) -> DataFrame:
        cells = F.explode(F.array(*[
            F.struct(F.lit(i + 1).alias("line_no"), F.concat(F.lit(f"{name}: "), value).alias("text"))
            for i, (name, value) in enumerate(items)
        ])).alias("c")
        return source.select(cells).select(*line(section, F.col("c.line_no"), F.col("c.text")))

    names = {"accuracy": "Accuracy", "precision_weighted": "Weighted Precision",
             "recall_weighted": "Weighted Recall", "f1_weighted": "Weighted F1-Score", "support_total": "Total Samples"}
    metrics = metrics_table(df).groupBy().pivot("name", list(names)).agg(F.first("value"))
    overall = rows(metrics, "OVERALL PERFORMANCE", [
        (title, F.col(c).cast("bigint").cast("string") if c == "support_total" else fmt4(F.col(c)))
        for c, title in names.items()
    ])
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("label"))
    width = F.greatest(F.length("label"), F.lit(20))
    detail = F.concat(
        F.rpad(F.col("label"), width, F.lit(" ")), F.lit(" "),
        *[F.concat(F.rpad(fmt4(F.col(c)), 10, " "), F.lit(" ")) for c in ("precision", "recall", "f1")],
        F.rpad(F.col("support").cast("string"), 10, " "),
    )
    titles = [("Class", 20), ("Precision", 10), ("Recall", 10), ("F1-Score", 10), ("Support", 10)]  # fixed values: the table's head
    head = df.sparkSession.createDataFrame(
        [("PER-CLASS PERFORMANCE", 0, " ".join(f"{t:<{n}}" for t, n in titles))], "section string, line_no int, text string")
    each = head.unionByName(classes.select(*line("PER-CLASS PERFORMANCE", place, detail)))
    inference = rows(times, "INFERENCE PERFORMANCE", [
        *[(f"{title}", F.concat(fmt4(F.col(c)), F.lit(" seconds"))) for title, c in (
            ("Average Inference Time", "mean"), ("Median Inference Time", "median"), ("Min Inference Time", "min"),
            ("Max Inference Time", "max"), ("Standard Deviation", "std"))],
        ("Throughput", F.concat(fixed(F.col("throughput"), 2), F.lit(" samples/second"))),
    ])
    percent = fixed(F.col("support") * 100.0 / total, 1)
    share = F.concat("label", F.lit(": "), F.col("support").cast("string"), F.lit(" samples ("), percent, F.lit("%)"))
    spread = classes.select(*line("CLASS DISTRIBUTION", place, share))
    return overall.unionByName(each).unionByName(inference).unionByName(spread)


def write_evaluation(df: DataFrame, folder: str, time_column: str) -> None:
    """Predictions, metrics, per-class values and the matrix as JSON tables, the report as text."""
    pairs = pair_counts(df)
    df.select(TRUE, PREDICTED, time_column).write.mode("overwrite").json(f"{folder}/predictions")
    metrics_table(df).write.mode("overwrite").json(f"{folder}/metrics")
    per_class(pairs).write.mode("overwrite").json(f"{folder}/per_class")
    confusion(pairs).write.mode("overwrite").json(f"{folder}/confusion")
    lines = report(df, time_column).orderBy("section", "line_no").select(
        F.concat_ws("\t", "section", "text").alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(f"{folder}/report")  # a page of text
