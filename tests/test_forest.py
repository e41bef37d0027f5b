"""Forests that learn from all rows: the grower against a plain one, upper nodes split by summed counts against nodes grown by one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import forest as FO
from flowloom.operators import sampling as SP
from flowloom.operators import selection as SEL


def plain_gains(x, y, w, weight, depth):
    """Summed gain per feature of one tree that tries every feature, node by node."""
    out = np.zeros(x.shape[1])
    total = np.bincount(y, w, len(weight))

    def purity(counts):
        return ((counts * weight) ** 2).sum() / (counts @ weight)

    if depth == 0 or np.count_nonzero(total) < 2:
        return out
    best = (1e-9, None)
    for f in range(x.shape[1]):
        for b in np.unique(x[:, f])[:-1]:
            left = np.bincount(y[x[:, f] <= b], w[x[:, f] <= b], len(weight))
            gain = purity(left) + purity(total - left) - purity(total)
            if gain > best[0] * (1 + 1e-12):
                best = (gain, (f, b))
    if best[1] is None:
        return out
    out[best[1][0]] += best[0]
    side = x[:, best[1][0]] <= best[1][1]
    return out + plain_gains(x[side], y[side], w[side], weight, depth - 1) + plain_gains(x[~side], y[~side], w[~side], weight, depth - 1)


@pytest.mark.parametrize("at_once", [16_000, 40])
@pytest.mark.parametrize("depth", [3, 30])
def test_grown_as_node_by_node(monkeypatch, depth, at_once):
    monkeypatch.setattr(FO, "AT_ONCE", at_once)
    rng = np.random.default_rng(depth)
    n, weight = 400, np.array([1.0, 0.7, 2.3])
    x = rng.integers(0, 12, (n, 4)).astype(np.uint8)
    y, w = rng.integers(0, 3, n).astype(np.int16), rng.integers(1, 4, n).astype(np.uint8)
    root = rng.integers(0, 2, n).astype(np.int32)  # two nodes at once
    found = FO.grow(x, y, w, root, np.array([0, 0]), depth, 4, weight, np.random.default_rng(1))
    want = sum(plain_gains(x[root == r], y[root == r], w[root == r].astype(float), weight, depth) for r in (0, 1))
    assert found == pytest.approx(want)


def test_bags_are_poisson_and_the_same_again():
    place = np.random.default_rng(1).integers(-2**62, 2**62, 200_000)
    w = FO.bag(place, 42, 3)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and (w == FO.bag(place, 42, 3)).all()
    assert abs(np.corrcoef(w, FO.bag(place, 42, 4))[0, 1]) < 0.02


def planted(spark, n):
    return spark.range(n, numPartitions=3).selectExpr(
        "cast(id as string) as key", "case when id % 7 = 0 then 'rare' when hash(id) % 3 = 0 then 'a' else 'b' end as label").selectExpr(
        "key", "label", "case when label = 'a' or hash(key, 1) % 5 = 0 then 1D else 0D end as strong", "double(hash(key, 2) % 50) as noise")


def test_upper_nodes_by_counts_are_the_same_trees(spark, monkeypatch):
    """Two columns are both tried by every node, so nothing but the rows decides: many small tasks grow what one does."""
    df = planted(spark, 3_000)
    forests = (SEL.Forest(3, 12), SEL.Forest(2, 4))
    whole = SEL.rf_importance(df, ["noise", "strong"], "key", forests=forests)
    monkeypatch.setattr(FO, "LOCAL_BYTES", 9 * 250)    # nodes of at most 250 rows are grown by a task
    monkeypatch.setattr(FO, "MOVED_BYTES", 9 * 4_500)  # two trees at a time
    parts = SEL.rf_importance(df, ["noise", "strong"], "key", forests=forests)
    assert parts == pytest.approx(whole) and sum(whole.values()) == pytest.approx(1.0)


def test_every_row_is_learnt_from(spark, monkeypatch):
    """Forests used to learn from a sample of 20,000 rows; two thirds of all rows are each fold's training rows."""
    seen = []

    def fit(self, table):
        seen.append((self.rows, table.count()))
        return FO.Importances(np.ones(2))

    monkeypatch.setattr(FO.WholeForest, "_fit", fit)
    SEL.rf_importance(planted(spark, 30_000), ["noise", "strong"], "key", forests=(SEL.Forest(2, 3),))
    assert [a for a, _ in seen] == [b for _, b in seen] and sum(a for a, _ in seen) == 60_000


def test_parts_are_stratified_folds(spark):
    df = planted(spark, 1_000)
    cells = SP.stratified_parts(df, "key", 3).groupBy("label").pivot("fold").agg(F.count("key")).collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in cells) and sum(sum(r[1:]) for r in cells) == 1_000
    one = SP.stratified_parts(df.filter("label = 'a'").limit(1), "key", 3).collect()
    assert len(one) == 1 and one[0]["fold"] == 0


def fitted_rows(monkeypatch, run):
    """Training rows of the forests that ``run`` fits."""
    seen = []

    def fit(self, table):
        seen.append(self.rows)
        return FO.Importances(np.arange(1.0, 1.0 + len(table.select("features").first()[0])))

    monkeypatch.setattr(FO.WholeForest, "_fit", fit)
    run()
    return seen


def test_fit_select_learns_from_the_whole_table(spark, small, monkeypatch):
    """The query's forests used to learn from 1,000 rows; two forests on three folds of two thirds of the rows. The buckets are found once."""
    from flowloom.plans.catalog import QUERIES
    from flowloom.plans.sampling_queries import clean_flows

    searched = []
    search = SEL.bucket_limits
    monkeypatch.setattr(SEL, "bucket_limits", lambda *a, **kw: searched.append(1) or search(*a, **kw))
    seen = fitted_rows(monkeypatch, lambda: QUERIES["m09_fit_select"](spark, small).collect())
    assert len(seen) == 6 and sum(seen) == 4 * clean_flows(spark, small).count() and len(searched) == 1


@pytest.fixture(scope="module")
def swept(spark, small):
    """The sweep query with forests that only tell their rows, its result and the files it wrote."""
    import glob

    from flowloom.plans.catalog import QUERIES
    from flowloom.session import shared_folder

    def files():
        return {f for f in glob.glob(f"{shared_folder(spark)}/sweep-*/records/**/*", recursive=True) if "/part-" in f}

    before = files()  # of other runs
    with pytest.MonkeyPatch.context() as m:
        seen = fitted_rows(m, lambda: QUERIES["q01_sweep"](spark, small).collect())
    return seen, files() - before


def test_sweep_learns_from_the_whole_table(spark, small, swept):
    from flowloom.plans.sampling_queries import clean_flows

    seen, _ = swept
    assert len(seen) == 12 and sum(seen) == 8 * clean_flows(spark, small).count()


def test_sweep_writes_compressed_records(swept):
    """Plain records, which repeat one instruction and the feature names, were most of the disk."""
    _, files = swept
    assert files and all(f.endswith(".json.gz") for f in files)


@pytest.mark.parametrize("local_rows", [10**6, 100])
def test_baseline_is_learnt_from_all_rows(spark, monkeypatch, local_rows):
    """Classes that follow from two columns, one of them in a single row of a thousand: the model names nearly all, also where tasks grow parts of trees."""
    from flowloom.operators import scoring as SC

    monkeypatch.setattr(FO, "LOCAL_BYTES", 10 * local_rows)
    df = spark.range(4_000, numPartitions=3).selectExpr("id", "double(id % 4) as a", "double(id % 1000 = 7) as b", "if(id % 3 = 0, null, double(id % 11)) as c")
    df = df.selectExpr("*", "case when b = 1 then 'rare' when a < 2 then 'low' else 'high' end as label")
    seen = []
    model_of = FO.WholeForest.model
    monkeypatch.setattr(FO.WholeForest, "model", lambda self, table, *a: seen.append((self.rows, table.count())) or model_of(self, table, *a))
    model = SC.fit_baseline(df, ["a", "b", "c"], "id", forest=SEL.Forest(15, 8))
    got = SC.apply_baseline(model, df)
    assert seen == [(4_000, 4_000)] and model.stages[2].getNumTrees == 15 and model.stages[2].numClasses == 3
    assert got.filter("label != predicted_class").count() == 0 and got.columns == [*df.columns, "predicted_class"]
    assert set(model.stages[2].featureImportances.indices) <= {0, 1, 2}


def test_workers_need_no_package(tmp_path):
    """Functions that run in Python workers are sent whole: a worker that cannot import the package runs them."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps((FO.bag, FO.grow, FO.split_histograms)))
    code = ("import sys, pickle, numpy as np; f = pickle.load(open(sys.argv[1], 'rb')); assert 'flowloom' not in sys.modules; "
            "print(f[0](np.arange(3), 1, 1).tolist())")
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path / "f")], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.strip() == str(FO.bag(np.arange(3), 1, 1).tolist())
