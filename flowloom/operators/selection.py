"""Feature scores, selection and scaling.

Scores come from aggregates over the whole table: no rows are sampled and no
matrix is collected. What reaches the driver is one number per feature, or one
row per class.
"""

from __future__ import annotations

import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import ceil, fsum, inf, nextafter, sqrt

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from flowloom import schemas as S
from flowloom.operators import features as FE
from flowloom.operators import sampling as SP
from flowloom.operators.bounded import MAX_CLASSES, bounded_rows, small_side
from flowloom.operators.columns import missing_features
from flowloom.operators.forest import WholeForest
from flowloom.operators.ranking import class_counts
from flowloom.operators.statistics import long_form, moments, order_statistics, value_counts
from flowloom.schemas import q
from flowloom.session import cleaned_shuffles, materialise, materialise_wide

VARIANCE_THRESHOLD = 0.01
MI_BUCKETS = 32


# ---- variance --------------------------------------------------------------------------------


def variances(df: DataFrame, columns: list[str]) -> dict[str, float]:
    return {c: m["var"] for c, m in moments(df, columns).items()}


def variance_filter(
    df: DataFrame, columns: list[str], threshold: float = VARIANCE_THRESHOLD, known: dict[str, dict] | None = None
) -> list[str]:
    """Columns whose population variance is above half the threshold; ``known`` are their moments."""
    found = variances(df, columns) if known is None else {c: known[c]["var"] for c in columns}
    kept = [c for c in columns if (found[c] or 0.0) > threshold * 0.5]
    if not kept:
        raise ValueError("no feature has enough variance")
    return kept


# ---- scores ----------------------------------------------------------------------------------


def class_cells(df: DataFrame, columns: list[str], by: str = S.LABEL) -> DataFrame:
    """``by, pos, n, mean, var`` per class and column: one hash aggregate from which both moments and F scores follow."""
    return long_form(df, columns, by).filter("x is not null").groupBy(by, "pos").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


@dataclass(frozen=True)
class ColumnCells:
    """One column's classes: ``n, mean, var`` each."""

    classes: list[tuple[int, float, float]]

    def _squares(self) -> tuple[int, float, float, float]:
        n = sum(c[0] for c in self.classes)
        centre = fsum(k * m for k, m, _ in self.classes) / n
        return n, centre, fsum(k * (m - centre) ** 2 for k, m, _ in self.classes), fsum(k * v for k, _, v in self.classes)

    def moments(self) -> dict[str, float | None]:
        if not self.classes:
            return {"n": 0, "mean": None, "std": None, "var": None}
        n, mean, between, within = self._squares()
        return {"n": n, "mean": mean, "var": (between + within) / n, "std": sqrt((between + within) / n)}

    def f_score(self) -> float | None:
        k = len(self.classes)
        if not k:
            return None
        n, _, between, within = self._squares()
        return None if k < 2 or n <= k or not within else (between / (k - 1)) / (within / (n - k))


def anova_f(df: DataFrame, columns: list[str], by: str = S.LABEL) -> DataFrame:
    """``feature, f_score``: between-class over within-class variance of every column.

    One hash aggregate of (class, feature) cells. Each cell holds a mean and central moments, so the sums of squares keep
    their digits without a pass for the global mean.
    """
    names = F.array(*[F.lit(c) for c in columns])
    cells = class_cells(df, columns, by)
    whole = Window.partitionBy("pos")  # one row per class
    centre = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    off = F.col("mean") - F.col("centre")
    sums = cells.withColumn("centre", centre).groupBy(F.element_at(names, F.col("pos") + 1).alias("feature")).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * off * off).alias("ssb"),
        F.sum(F.col("n") * F.col("var")).alias("ssw"))
    score = F.try_divide(F.try_divide("ssb", F.col("k") - 1), F.try_divide("ssw", F.col("n") - F.col("k")))
    return sums.select("feature", score.alias("f_score"))


def bucket_limits(
    df: DataFrame, columns: list[str], buckets: int = MI_BUCKETS, counts: dict[str, int] | None = None, **kw
) -> dict[str, list[float]]:
    """Upper limits of equal-frequency buckets; equal values always share a bucket.

    A value is in bucket ``i`` or above when at least ``i/buckets`` of the other
    values are smaller, so the limits are order statistics and no row is ranked.
    """
    counts = value_counts(df, columns) if counts is None else counts
    at = {
        c: [ceil(i * (counts[c] - 1) / buckets) - 1 for i in range(1, buckets)] for c in columns if counts[c]
    }
    ranks = {c: [r for r in rs if r >= 0] for c, rs in at.items()}
    values = order_statistics(df, ranks, counts, **kw)
    return {c: [values[(c, r)] for r in rs] for c, rs in ranks.items()}


def bucketed(df: DataFrame, limits: dict[str, list[float]], *keep: str) -> DataFrame:
    """``keep`` and one bucket column per feature: the number of different limits under the value.

    The binary search is the one of ``Bucketizer``, whose splits include their
    lower end; the next double above a limit makes the limit itself fall below.
    """
    columns = list(limits)
    out = [f"b{i}" for i in range(len(columns))]
    splits = [[-inf, *(nextafter(v, inf) for v in sorted(set(limits[c]))), inf] for c in columns]
    plain = df.select(*keep, *[F.col(q(c)).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    many = [i for i, s in enumerate(splits) if len(s) > 2]
    if many:
        plain = Bucketizer(
            inputCols=[f"x{i}" for i in many], outputCols=[out[i] for i in many], splitsArray=[splits[i] for i in many],
            handleInvalid="keep",
        ).transform(plain)
    return plain.select(*keep, *[
        F.when(F.col(f"x{i}").isNotNull(), F.col(out[i]) if i in many else F.lit(0.0)).alias(c)
        for i, c in enumerate(columns)
    ])


def mutual_information(
    df: DataFrame, columns: list[str], by: str = S.LABEL, buckets: int = MI_BUCKETS, **kw
) -> DataFrame:
    """``feature, mi_score``: information (in nats) between the bucketed feature and the class.

    The long form exists only inside the map stage: partial aggregation reduces
    it to at most features x buckets x classes rows before anything is shuffled.
    """
    return bucket_information(df, bucket_limits(df, columns, buckets, **kw), by)  # kw: known counts, and the sizes of exact aggregates


def bucket_information(df: DataFrame, limits: dict[str, list[float]], by: str = S.LABEL) -> DataFrame:
    """:func:`mutual_information` of columns whose buckets are known."""
    found = list(limits)
    names = F.array(*[F.lit(c) for c in found])
    joint = long_form(bucketed(df, limits, by), found, by).filter("x is not null").groupBy(by, "pos", "x").agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.element_at(names, F.col("pos") + 1).alias("feature"), F.col("x").alias("bucket"), F.col(by).alias("class"), "n")
    whole = Window.partitionBy("feature")
    sized = joint.withColumns({
        "total": F.sum("n").over(whole),
        "in_bucket": F.sum("n").over(Window.partitionBy("feature", "bucket")),
        "in_class": F.sum("n").over(Window.partitionBy("feature", "class")),
    })
    p = F.col("n").cast("double") / F.col("total")
    ratio = F.col("n").cast("double") * F.col("total") / (F.col("in_bucket").cast("double") * F.col("in_class"))
    return sized.groupBy("feature").agg(F.greatest(F.sum(p * F.ln(ratio)), F.lit(0.0)).alias("mi_score"))


# ---- score table -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Score:
    feature: str
    f_score: float
    mi_score: float
    selected: bool = False


def _top(scores: list[float], n: int) -> list[int]:
    """Places of the ``n`` best scores; of equal ones the later column first."""
    return sorted(range(len(scores)), key=lambda i: (-scores[i], -i))[:n]


def union_cap(columns: list[str], f: dict[str, float], mi: dict[str, float], n: int) -> list[Score]:
    """Best ``n`` by F, united with the best ``n`` by information, cut to ``n``; schema order kept.

    When the union is too large, a feature scores its F if it was chosen by F,
    plus its information if it was chosen by that.
    """
    f_all = [f.get(c) or 0.0 for c in columns]
    mi_all = [mi.get(c) or 0.0 for c in columns]
    by_f, by_mi = set(_top(f_all, n)), set(_top(mi_all, n))
    chosen = by_f | by_mi
    if len(chosen) > n:
        combined = [
            (f_all[i] if i in by_f else 0.0) + (mi_all[i] if i in by_mi else 0.0) for i in range(len(columns))
        ]
        chosen = set(_top(combined, n))
    return [Score(c, f_all[i], mi_all[i], i in chosen) for i, c in enumerate(columns)]


def score_table(spark: SparkSession, scores: list[Score]) -> DataFrame:
    return spark.createDataFrame(
        [(s.feature, s.f_score, s.mi_score, s.selected) for s in scores],
        "feature string, f_score double, mi_score double, selected boolean",
    )


# ---- forests ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    trees: int
    depth: int


# The two forests and the folds whose importances are averaged. Depth 30 is Spark's limit.
FORESTS = (Forest(100, 30), Forest(50, 10))
FOLDS = 3
SEED = 42
# Small tables are few tasks a fit, several fits at a time.
_ROWS_PER_TASK = 10_000
FITS_AT_A_TIME = 6


def fit_sample(df: DataFrame, key: str, by: str = S.LABEL, max_fit_rows: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows a forest learns from: all that have a class, or, where a caller asks for it, a stratified sample of about ``max_fit_rows``."""
    known = df.filter(F.col(by).isNotNull())
    return known if max_fit_rows is None else SP.stratified_sample(known, key, max_fit_rows, by, seed)


def rf_importance(
    df: DataFrame, columns: list[str], key: str, by: str = S.LABEL, forests: tuple[Forest, ...] = FORESTS,
    folds: int = FOLDS, seed: int = SEED, max_fit_rows: int | None = None, limits: dict[str, list[float]] | None = None,
) -> dict[str, float]:
    """Mean feature importance of the forests over stratified folds, classes weighted evenly.

    Learnt from all rows, see :mod:`flowloom.operators.forest`; ``max_fit_rows`` is for callers that want a sample, see :func:`fit_sample`.
    ``limits`` are the buckets of the columns, where they are known.
    """
    rows = fit_sample(df.select(key, by, *[q(c) for c in columns]), key, by, max_fit_rows, seed)
    if max_fit_rows is not None:
        rows = materialise(rows, "fit-sample")
    counts = class_counts(rows, by)
    if not counts:
        return dict.fromkeys(columns, 0.0)
    classes = sorted(counts, key=str)
    plain = rows.select(
        F.col(key), F.col(by), *[F.coalesce(F.col(q(c)).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    if limits is None:
        limits = bucket_limits(plain, columns, counts=dict.fromkeys(columns, sum(counts.values())))
    # A byte a value: written down once, in tasks that are worth their start.
    binned = bucketed(plain, {c: limits[c] for c in columns}, key, by).select(
        F.col(key).alias("_key"), F.col(by).alias("_class"), F.xxhash64(F.col(key)).alias("place"),
        (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(by)) - 1).cast("int").alias("label"),
        F.array(*[F.col(q(c)).cast("tinyint") for c in columns]).alias("features"))
    folded = SP.stratified_parts(binned, "_key", folds, "_class", seed, counts)
    parts = -(-sum(counts.values()) // _ROWS_PER_TASK)
    table = materialise(folded.select("place", "label", "features", "fold").coalesce(parts), "forest-rows").coalesce(parts)
    sizes = {(r["fold"], r["label"]): r["n"] for r in table.groupBy("fold", "label").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # folds x classes
    fits = []
    for fold in range(folds):
        have = [sum(sizes.get((f, c), 0) for f in range(folds) if f != fold) for c in range(len(classes))]
        n, known = sum(have), sum(1 for h in have if h)
        if not n:
            continue
        for i, spec in enumerate(forests):
            forest = WholeForest(numTrees=spec.trees, maxDepth=spec.depth, seed=seed + i, featureSubsetStrategy="sqrt")
            forest.class_weights, forest.rows = [n / (known * h) if h else 0.0 for h in have], n
            fits.append((forest, table.filter(F.col("fold") != fold)))
    # One fit is a chain of small jobs that leaves most cores idle.
    with cleaned_shuffles(df.sparkSession), ThreadPoolExecutor(FITS_AT_A_TIME) as pool:
        importances = list(pool.map(lambda fit: fit[0].fit(fit[1]).featureImportances.toArray(), fits))
    total = [fsum(float(v[j]) for v in importances) for j in range(len(columns))]
    return {c: v / (folds * len(forests)) for c, v in zip(columns, total)}


def top_n(columns: list[str], importance: dict[str, float], n: int) -> list[str]:
    """Best first; of equal ones the later column first."""
    return [columns[i] for i in _top([importance[c] for c in columns], n)]


def complete_critical(selected: list[str], available: list[str], n: int) -> list[str]:
    """Exactly ``n`` names where possible: the selection, then missing critical features in their order."""
    out = list(selected[:n])
    for c in S.CRITICAL_FEATURES:
        if len(out) < n and c in available and c not in out:
            out.append(c)
    return out


# ---- scaling ---------------------------------------------------------------------------------


def learn_scale(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std; a constant column divides by 1."""
    return {c: (m["mean"] or 0.0, m["std"] or 1.0) for c, m in moments(df, columns).items()}


def standardise(df: DataFrame, columns: list[str], scale: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(x - mean) / std. Strict use passes a scale learnt on the training rows only."""
    scale = learn_scale(df, columns) if scale is None else scale
    return df.select(*[
        ((F.col(q(c)).cast("double") - F.lit(scale[c][0])) / F.lit(scale[c][1])).alias(c) if c in scale else F.col(q(c))
        for c in df.columns
    ])


# ---- fit and transform -------------------------------------------------------------------------


@dataclass(frozen=True)
class SelectionSettings:
    """Settings of one feature count. ``n_statistical`` is part of the format but nothing reads it."""

    n_features: int
    n_statistical: int
    variance_threshold: float = VARIANCE_THRESHOLD
    seed: int = SEED
    forests: tuple[Forest, ...] = FORESTS
    max_fit_rows: int | None = None

    @classmethod
    def for_count(cls, n: int, **kw) -> SelectionSettings:
        return cls(n_features=n, n_statistical=min(n + 10, 50), **kw)


@dataclass
class FittedSelection:
    """Everything needed to apply a selection to new rows."""

    features: list[str]
    scores: list[Score]
    importance: dict[str, float]
    scale: dict[str, tuple[float, float]]
    statistics: FE.TableStatistics
    temporal: list[str] = field(default_factory=list)
    behavioural: list[str] = field(default_factory=list)
    network: list[str] = field(default_factory=list)
    key: str | None = None

    def transform(self, df: DataFrame, mode: str = "compat", keep: list[str] | None = None) -> DataFrame:
        """Engineer, pick the stored features in order, apply the stored scale.

        Compat: table statistics are recomputed on ``df``. Strict: those of the
        fit are used, which also makes this work on a stream. Features that ``df`` can't give are left out with a warning.
        """
        made = FE.engineer(df, self.statistics if mode == "strict" else None, self.key)
        here, gone = missing_features(made.df, self.features)
        if gone:
            warnings.warn(f"features that the table does not have: {gone}", stacklevel=2)
        rest = [c for c in (keep or [S.LABEL]) if c in made.df.columns]
        picked = made.df.select(*[q(c) for c in rest], *[q(c) for c in here])
        scaled = standardise(picked, here, {c: self.scale[c] for c in here})
        return scaled.select(*[q(c) for c in [*here, *rest]])


@dataclass
class Prepared:
    """An engineered table, written down, and the class cells of all its features, from which moments and F scores follow."""

    made: FE.Engineered
    names: list[str]
    cells: dict[str, ColumnCells]
    f: dict[str, float] = field(default_factory=dict)
    mi: dict[str, float] = field(default_factory=dict)
    limits: dict[str, list[float]] = field(default_factory=dict)

    @property
    def df(self) -> DataFrame:
        return self.made.df

    @property
    def moments(self) -> dict[str, dict[str, float]]:
        return {c: self.cells[c].moments() for c in self.names}

    def varied(self, threshold: float = VARIANCE_THRESHOLD) -> list[str]:
        return variance_filter(self.made.df, self.names, threshold, self.moments)

    def f_scores(self, columns: list[str]) -> dict[str, float | None]:
        return {c: self.cells[c].f_score() for c in columns}

    def score(self, columns: list[str]) -> None:
        """Fill in both scores, one row per feature, and the buckets behind them, unless they are there."""
        if not set(columns) <= self.f.keys():
            self.f = self.f_scores(columns)
            counts = {c: m["n"] for c, m in self.moments.items()}
            self.limits = bucket_limits(self.df, columns, counts=counts)
            self.mi = {r["feature"]: r["mi_score"] for r in bucket_information(self.df, self.limits).collect()}

    def scale(self, columns: list[str]) -> dict[str, tuple[float, float]]:
        found = self.moments
        return {c: (found[c]["mean"] or 0.0, found[c]["std"] or 1.0) for c in columns}


def prepare(df: DataFrame, key: str, by: str = S.LABEL) -> Prepared:
    """Engineer the table, write it down and sum it up per class and feature.

    Formulas and sums of 77 columns in one stage make a method that is too long for the JIT compiler: that pass took 689 task
    seconds on 3.6 million rows, where writing and reading take 195.
    """
    made = FE.engineer(df, key=key)
    made.df = materialise_wide(made.df, "engineered")
    names = [c for c in made.df.columns if c not in (by, key)]
    cells: dict[str, list] = {c: [] for c in names}
    for r in bounded_rows(class_cells(made.df, names, by), MAX_CLASSES * len(names), "cells"):
        cells[names[r["pos"]]].append((r["n"], r["mean"], r["var"]))
    return Prepared(made, names, {c: ColumnCells(v) for c, v in cells.items()})


def fit_select(
    df: DataFrame, key: str, settings: SelectionSettings,
    prepared: Prepared | None = None,
) -> FittedSelection:
    """Variance filter, two scores, forests, critical features, scale; exactly ``n_features`` names.

    ``prepared`` lets a sweep over feature counts engineer and score the table once.
    """
    n = settings.n_features
    ready = prepare(df, key) if prepared is None else prepared
    made = ready.made
    varied = ready.varied(settings.variance_threshold)
    ready.score(varied)
    scores = union_cap(varied, ready.f, ready.mi, n)
    chosen = [s.feature for s in scores if s.selected]
    importance = rf_importance(ready.df, chosen, key, forests=settings.forests, seed=settings.seed,
                               max_fit_rows=settings.max_fit_rows, limits=ready.limits)
    final = complete_critical(top_n(chosen, importance, n), ready.names, n)
    if len(final) != n:
        raise ValueError(f"{n} features wanted, {len(final)} found")
    return FittedSelection(
        final, scores, importance, ready.scale(final), made.statistics, made.temporal, made.behavioural, made.network,
        key)


def original_features(df: DataFrame, n: int | None = None) -> DataFrame:
    """The way without engineering: known features in order, the numeric ones standardised."""
    picked = FE.selected_columns(df, n)
    return standardise(picked, [c for c in S.SCALED_FEATURES if c in picked.columns])


def select_or_original(df: DataFrame, key: str, settings: SelectionSettings) -> tuple[DataFrame, FittedSelection | None]:
    """Fitted features, or the original ones when the data can't be fitted; lost executors and the like are raised.

    Fitting runs its statistics jobs right here, so a failure shows inside the
    ``try`` and not when the result is used.
    """
    try:
        fitted = fit_select(df, key, settings)
        return fitted.transform(df), fitted
    except (ValueError, AnalysisException):
        return original_features(df, settings.n_features), None


def feature_report(spark: SparkSession, fitted: FittedSelection) -> DataFrame:
    """``section, place, feature, importance, family`` of the selected features, overall and per family."""

    def family(f: str) -> str:
        return FE.feature_family(f, fitted.temporal, fitted.behavioural, fitted.network)

    sections = {
        "Final": fitted.features,
        "Temporal": [f for f in fitted.temporal if f in fitted.features],
        "Behavioral": [f for f in fitted.behavioural if f in fitted.features],
        "Network Context": [f for f in fitted.network if f in fitted.features],
        "Original Critical": [f for f in fitted.features if f in S.CRITICAL_FEATURES],
    }
    rows = [
        (section, i + 1, f, fitted.importance.get(f, 0.0), family(f))
        for section, names in sections.items() for i, f in enumerate(names)
    ]
    return spark.createDataFrame(rows, "section string, place int, feature string, importance double, family string")


def label_index(df: DataFrame, by: str = S.LABEL) -> DataFrame:
    """``label, label_id``: sorted class names numbered from 0. The window runs over one row per class."""
    names = df.select(by).filter(F.col(by).isNotNull()).distinct()
    number = F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(by)) - 1
    return names.select(by, number.cast("int").alias("label_id"))


def with_label_index(df: DataFrame, by: str = S.LABEL) -> DataFrame:
    return df.join(small_side(label_index(df, by)), by)


