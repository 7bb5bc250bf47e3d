import math
import random

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
import pytest

from steadyseed.functions.skew import hot_keys
from steadyseed.operators import forest, trees
from steadyseed.plans import fixtures as fx


def plain_tree(x, y, w, depth, classes):
    """A tree by trying every split between neighbouring values, as nested tuples (feature, threshold, left, right) or a value."""
    n = w.sum()
    shares = np.array([w[y == c].sum() for c in range(classes)]) / n if classes else np.array([(w * y).sum() / n])

    def purity(rows):
        own = w[rows].sum()
        return sum(w[rows & (y == c)].sum() ** 2 for c in range(classes)) / own if classes else (w * y)[rows].sum() ** 2 / own

    best = (0.0, None)
    everything = np.ones(len(y), bool)
    for f in range(x.shape[1]):
        known = np.unique(x[:, f])
        for t in (known[1:] + known[:-1]) / 2:
            low = x[:, f] <= t
            gain = purity(low) + purity(~low) - purity(everything)
            if gain > best[0] + 1e-9 * max(n, 1):
                best = (gain, (f, t))
    if not depth or best[1] is None:
        return shares
    low = x[:, best[1][0]] <= best[1][1]
    return (*best[1], plain_tree(x[low], y[low], w[low], depth - 1, classes), plain_tree(x[~low], y[~low], w[~low], depth - 1, classes))


def plain_value(tree, row):
    while isinstance(tree, tuple):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


def table(spark, x, y, member):
    rows = [(i, *map(float, r), float(v), [bool(b) for b in m]) for i, (r, v, m) in enumerate(zip(x, y, member, strict=True))]
    names = ", ".join(f"f{j} double" for j in range(x.shape[1]))
    df = spark.createDataFrame(rows, f"id int, {names}, label double, member array<boolean>")
    made = forest.assemble(df, "id", [f"f{j}" for j in range(x.shape[1])], "label").join(df.select(F.col("id").alias("row_id"), "member"), "row_id")
    return made.withColumn("__y", F.col("label")).repartition(3, "row_id").sortWithinPartitions("row_id")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 9, (300, 3)).astype(float)
    target = x[:, 0] * 2 - (x[:, 1] > 4) * 5 + rng.normal(0, 1, 300)
    label = (target > 4).astype(float) + (target > 11)
    return x, target, label, rng.random((300, 2)) < 0.7


@pytest.mark.parametrize("classes", [0, 3])
def test_a_tree_is_the_best_of_all_splits(spark, data, classes):
    x, target, label, member = data
    y = label if classes else target
    rows = table(spark, x, y, member)
    cuts = trees.cuts_of(rows)
    own = trees.prepared(rows, F.col("member"), cuts).persist()
    model = trees.Model(g := trees.Growth(depth=3, classes=classes), trees.grow(own, 2, 3, g, 3))
    got = trees.predictions(own, {"tree": model}, with_ids=True).collect()
    assert len(got) == (~member).sum()
    for run in (0, 1):
        m = member[:, run]
        want = plain_tree(x[m], y[m], np.ones(m.sum()), 3, classes)
        for r in got:
            if r["run"] == run:
                value = plain_value(want, x[r["row_id"]])
                assert r["prediction"] == (value.argmax() if classes else pytest.approx(value[0]))
    own.unpersist()


def test_a_bagged_forest_is_the_mean_of_trees_of_drawn_rows(spark, data):
    x, target, _, member = data
    rows = table(spark, x, target, member)
    own = trees.prepared(rows, F.col("member"), trees.cuts_of(rows)).persist()
    g = trees.Growth(trees=6, depth=2, bagging=True, seed=3)
    model = trees.Model(g, trees.grow(own, 2, 3, g, 100))  # many partitions: sums are added in two steps
    keys = {r["row_id"]: r["key"] for r in own.select("row_id", "key").collect()}
    key = np.array([keys[i] for i in range(300)], np.int64).view(np.uint64)
    got = {(r["run"], r["row_id"]): r["prediction"] for r in trees.predictions(own, {"f": model}, with_ids=True).collect()}
    want = np.zeros(300)
    for t in range(6):
        w = trees.times_drawn(key, t, 3) * member[:, 0]
        tree = plain_tree(x[w > 0], target[w > 0], w[w > 0].astype(float), 2, 0)
        want += [plain_value(tree, r)[0] / 6 for r in x]
    assert all(got[0, i] == pytest.approx(want[i]) for i in range(300) if not member[i, 0])
    own.unpersist()


def test_draws_are_poisson():
    rng = np.random.default_rng(1)
    key = rng.integers(0, 2**63, 40_000).astype(np.uint64)
    draws = [trees.times_drawn(key, t, 1) for t in range(8)]
    for d in draws:
        assert d.mean() == pytest.approx(1, abs=0.03) and (d == 0).mean() == pytest.approx(math.exp(-1), abs=0.01)
    assert abs(np.corrcoef(draws)[np.triu_indices(8, 1)]).max() < 0.03


def test_cut_points():
    assert list(trees.cut_points(np.array([1.0, 2, 2, 5]))) == [1.5, 3.5]
    assert list(trees.cut_points(np.array([4.0, 4]))) == []
    many = trees.cut_points(np.arange(1000.0))
    assert len(many) == 31 and np.allclose(np.diff(many), 31.25, atol=1)


def test_other_layouts_give_the_same_forest(spark, tables):
    from steadyseed.operators.layout import fixed_layout

    df = fx.net(spark, tables)
    found = []
    for parts in (1, 6):
        rows = fixed_layout(forest.assemble(df.repartition(parts), "row_id", ["l_extendedprice", "l_discount"], "label"), "row_id", df.count())
        rows = rows.withColumn("__y", F.col("label"))
        own = trees.prepared(rows, F.array(F.xxhash64("row_id") % 3 != 0), trees.cuts_of(rows))
        g = trees.Growth(trees=3, depth=4, bagging=True)
        grown = trees.grow(own, 1, 2, g)
        found.append((grown.feature, grown.threshold, grown.value))
    for a, b in zip(*found, strict=True):
        assert np.array_equal(a, b)


def test_drawn_thresholds_lie_between_the_extremes_of_their_node(spark, data):
    """Extremely randomised: every threshold is the drawn share of the way between the least and the largest value."""
    x, target, _, member = data
    rows = table(spark, x, target, member)
    own = trees.prepared(rows, F.col("member"), None).persist()
    g = trees.Growth(trees=4, depth=4, drawn=True, seed=5)
    grown = trees.grow(own, 2, 3, g)
    for run in (0, 1):
        for t in range(4):
            for node in range(15):
                f = grown.feature[run, t, node]
                level = int(math.log2(node + 1))
                # rows that reach the node
                here = trees.leaves(x, grown.feature[run, t], grown.threshold[run, t], level) == node
                here &= member[:, run]
                if not here.any():
                    continue
                assert grown.value[run, t, node, 0] == pytest.approx(target[here].mean())
                assert grown.weight[run, t, node] == here.sum()
                if f >= 0:
                    share = trees.drawn_shares(g, t, node, 1, 3)[0, f]
                    low, high = x[here, f].min(), x[here, f].max()
                    assert grown.threshold[run, t, node] == pytest.approx(low + share * (high - low))
    flat = trees.Growth(trees=2, depth=3, drawn=True)
    same = trees.grow(trees.prepared(table(spark, x * 0, target, member), F.col("member"), None), 2, 3, flat)
    assert (same.feature == -1).all()
    own.unpersist()


def plain_samme(x, y, classes, rounds):
    """AdaBoost with weights stored per row."""
    w, votes = np.ones(len(y)), []
    for _ in range(rounds):
        stump = plain_tree(x, y, w, 1, classes)
        said = np.array([plain_value(stump, r).argmax() for r in x])
        error = w[said != y].sum() / w.sum()
        if error >= 1 - 1 / classes:
            break
        alpha = math.log((1 - error) / error) + math.log(classes - 1)
        votes.append((alpha, stump))
        w = w * np.exp(alpha * (said != y))
        w /= w.sum()
    return lambda row: int(np.argmax([sum(a for a, s in votes if plain_value(s, row).argmax() == c) for c in range(classes)]))


@pytest.mark.parametrize("classes", [2, 3])
def test_reweighted_stumps_without_stored_weights(spark, data, classes):
    x, _, label, member = data
    label = np.minimum(label, classes - 1)
    rows = table(spark, x, label, member)
    own = trees.prepared(rows, F.col("member"), trees.cuts_of(rows)).persist()
    model = trees.reweighted_stumps(own, 2, 3, classes, rounds=6)
    got = trees.predictions(own, {"a": model}, with_ids=True).collect()
    for run in (0, 1):
        m = member[:, run]
        said = plain_samme(x[m], label[m], classes, 6)
        assert all(r["prediction"] == said(x[r["row_id"]]) for r in got if r["run"] == run)
    own.unpersist()


def test_gradient_boosting_follows_its_residuals(spark, data):
    x, target, label, member = data
    for classes, y in ((0, target), (2, (label > 0).astype(float))):
        rows = table(spark, x, y, member)
        own = trees.prepared(rows, F.col("member"), trees.cuts_of(rows)).persist()
        model = trees.gradient_boosting(own, 2, 3, trees.Growth(depth=2, classes=classes), rounds=4)
        got = trees.predictions(own, {"g": model}, with_ids=True).collect()
        m = member[:, 1]
        sign = np.where(y > 0, 1.0, -1.0) if classes else y
        score, everywhere = np.zeros(m.sum()), np.zeros(300)
        for k in range(4):
            left = sign[m] - score if not classes else 4 * sign[m] / (1 + np.exp(2 * sign[m] * score)) if k else sign[m]
            tree = plain_tree(x[m], left, np.ones(m.sum()), 2, 0)
            step = 0.1 if k else 1.0
            score = score + step * np.array([plain_value(tree, r)[0] for r in x[m]])
            everywhere += step * np.array([plain_value(tree, r)[0] for r in x])
        want = (everywhere > 0).astype(float) if classes else everywhere
        assert all(r["prediction"] == pytest.approx(want[r["row_id"]]) for r in got if r["run"] == 1)
        own.unpersist()


def test_odd_tables(spark):
    rng = random.Random(1)
    x, y = np.zeros((20, 1)), np.array([rng.random() for _ in range(20)])
    member = np.column_stack([np.ones(20, bool), np.zeros(20, bool)])
    rows = table(spark, x, y, member)
    own = trees.prepared(rows, F.col("member"), trees.cuts_of(rows))
    g = trees.Growth(trees=2, depth=2)
    grown = trees.grow(own, 2, 1, g)
    assert (grown.feature == -1).all() and grown.value[0, :, 0, 0] == pytest.approx([y.mean()] * 2) and not grown.value[1].any()
    got = trees.predictions(own, {"f": trees.Model(g, grown)}).collect()
    assert len(got) == 20 and {r["run"] for r in got} == {1}
    none = rows.limit(0)
    assert trees.cuts_of(none) == []
    assert (trees.grow(trees.prepared(none, F.col("member"), []), 2, 1, g).feature == -1).all()
    no_features = forest.assemble(rows.select(F.col("row_id").alias("id"), "label", "member"), "id", [], "label").join(rows.select("row_id", "member"), "row_id").withColumn("__y", F.col("label"))
    cuts = trees.cuts_of(no_features)
    assert cuts == [] and trees.grow(trees.prepared(no_features, F.col("member"), cuts), 2, 1, g).value[0, 0, 0, 0] == pytest.approx(y.mean())


def test_rows_of_equal_bins_are_added_up_once(spark, monkeypatch):
    from types import SimpleNamespace

    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.integers(0, 4, 3)], float(rng.integers(0, 2)), bool(rng.integers(0, 3))) for i in range(1500)]
    df = spark.createDataFrame(rows, "row_id bigint, x array<double>, __y double, known boolean").withColumn("features", array_to_vector("x"))
    own = trees.prepared(df, F.array("known", F.lit(True)), trees.cuts_of(df)).select("key", "y", "member", "x").persist()
    batches = own.toArrow().to_batches()
    monkeypatch.setattr(trees, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    distinct, plain = trees._distinct, lambda x: None
    met = []
    for classes in (0, 2):
        growth = trees.Growth(6, 3, classes, True, "sqrt")
        boosted = trees.gradient_boosting(own, 2, 3, trees.Growth(1, 3, classes), rounds=2).boost
        scans = [trees.Scan(growth, trees.grow(own, 2, 3, growth), 0, 2, 3)]
        scans.append(trees.Scan(trees.Growth(1, 3), trees.Trees.empty(2, trees.Growth(1, 3)), 0, 0, 3, boost=boosted))
        for scan in scans:
            sums = []
            for how in (distinct, plain):
                monkeypatch.setattr(trees, "_distinct", lambda x, how=how: met.append(how(x)) or met[-1])
                out = [b for b in trees._sums(SimpleNamespace(value=scan))(iter(batches))]
                sums.append({(r["run"], r["tree"]): np.frombuffer(r["sums"]) for b in out for r in b.to_pylist()})
            assert sums[0].keys() == sums[1].keys() and len(sums[0]) == 2 * scan.growth.trees
            assert all(np.allclose(sums[0][k], sums[1][k]) for k in sums[0])
    assert len(met[0][0]) == 64 and (met[0][0][met[0][1]] == np.array([r[1] for r in rows])).all()


def test_bins_are_set_from_few_rows_of_each_task(spark):
    df = spark.range(60_000).select(F.col("id").alias("row_id"), array_to_vector(F.array((F.col("id") * 7919 % 10007).cast("double"))).alias("features")).repartition(12)
    cuts = trees.cuts_of(df, most=500)
    near = df.select("features", F.xxhash64(F.col("row_id").cast("string")).alias("h")).orderBy("h").limit(500).collect()
    assert (cuts[0] == trees.cut_points(np.array([r["features"][0] for r in near]))).all()
    assert (trees.cuts_of(df, most=500, n=60_000)[0] == cuts[0]).all()
    # ids that repeat: too few hashes are small
    same = df.withColumn("row_id", F.lit(1))
    assert len(trees.cuts_of(same, most=500)) == 1


def test_equal_rows_are_weighed_once_and_levels_read_their_masses(spark, monkeypatch):
    """The same trees as from scans of the rows, with a hot group of rows and several groups of trees."""
    rng = np.random.default_rng(5)
    rows = [(i, [0.0, 1.0, 2.0] if i % 3 == 0 else [float(v) for v in rng.integers(0, 4, 3)], float(rng.integers(0, 3))) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id bigint, x array<double>, label double").withColumn("features", array_to_vector("x")).repartition(5, "row_id")
    member = F.array(F.col("row_id") % 4 != 0, F.col("row_id") % 5 != 0)
    monkeypatch.setattr(trees, "hot_keys", lambda read, keys: hot_keys(read, keys, at_least=500))
    monkeypatch.setattr(trees, "MASS_BYTES", 40_000)
    monkeypatch.setattr(trees, "MASS_WORK", 0)
    read, scan = [], trees._scan
    monkeypatch.setattr(trees, "_scan", lambda own, s, partitions, masses=None: read.append(masses is not None) or scan(own, s, partitions, masses))
    worth = trees._trees_with_masses

    def both(work):
        found = []
        for how in (worth, lambda *a: 0):
            monkeypatch.setattr(trees, "_trees_with_masses", how)
            read.clear()
            found.append(work())
            assert read and all(read) == any(read) == (how is worth)
        return found

    for classes in (0, 3):
        y = F.col("label") if classes else F.col("label") * 1.5
        for cuts in (trees.cuts_of(df), None):
            own = trees.prepared(df.withColumn("__y", y), member, cuts).persist()
            kinds = [trees.Growth(4, 3, classes, drawn=True)] if cuts is None else [
                trees.Growth(1, 3, classes), trees.Growth(30, 3, classes, True, "sqrt", seed=2)]
            for g in kinds:
                monkeypatch.setattr(trees, "MASS_BYTES_PER_ROW", 8)
                a, b = both(lambda g=g, own=own: trees.grow(own, 2, 3, g, 5))
                assert np.array_equal(a.feature, b.feature) and np.allclose(a.threshold, b.threshold)
                assert np.allclose(a.value, b.value) and np.allclose(a.weight, b.weight)
            own.unpersist()
    own = trees.prepared(df.withColumn("__y", (F.col("label") > 0).cast("double")), member, trees.cuts_of(df)).persist()
    for work in (
        lambda: trees.gradient_boosting(own, 2, 3, trees.Growth(depth=2), rounds=3), lambda: trees.gradient_boosting(own, 2, 3, trees.Growth(depth=2, classes=2), rounds=3),
        lambda: trees.reweighted_stumps(own, 2, 3, 2, rounds=3),
    ):
        a, b = (m.boost for m in both(work))
        assert np.allclose(a.weights, b.weights)
        for one, other in zip(a.rounds, b.rounds, strict=True):
            assert np.array_equal(one.feature, other.feature) and np.allclose(one.value, other.value)
    own.unpersist()


def test_models_are_asked_once_about_rows_of_equal_bins(spark, data, monkeypatch):
    x, _, label, member = data
    rows = table(spark, np.minimum(x, 2), label, member)
    own = trees.prepared(rows, F.col("member"), trees.cuts_of(rows)).persist()
    models = {}
    for name, trees_of in (("one", 1), ("two", 3)):
        g = trees.Growth(trees_of, 2, 3, trees_of > 1)
        models[name] = trees.Model(g, trees.grow(own, 2, 3, g))
    models["three"] = trees.reweighted_stumps(own, 2, 3, 3, rounds=3)
    columns = ["row_id", "run", "model", "y", "prediction"]
    for kind in (trees.ASKED, trees.LEARNED):
        looked_up = trees.predictions(own, models, kind, with_ids=True)
        assert "BroadcastHashJoin" in looked_up._jdf.queryExecution().toString()
        with monkeypatch.context() as m:
            m.setattr(trees, "_few_cells", lambda *a: False)
            plain = trees.predictions(own, models, kind, with_ids=True).select(columns).collect()
        assert len(plain) == 3 * (member == bool(kind)).sum()
        assert sorted(map(tuple, looked_up.select(columns).collect())) == sorted(map(tuple, plain))
        assert looked_up.drop("row_id").columns == trees.predictions(own, models, kind).columns
    own.unpersist()


@pytest.mark.parametrize("drawn", [False, True])
def test_few_trees_read_what_each_task_weighed(spark, monkeypatch, drawn):
    rng = np.random.default_rng(3)
    table = [(str(i), [float(a), float(b)], float(a - 2 * b + i % 3)) for i, (a, b) in enumerate(rng.integers(0, 3, (600, 2)).tolist())]
    df = spark.createDataFrame(table, "row_id string, features array<double>, __y double").repartition(3, "row_id").sortWithinPartitions("row_id")
    g = trees.Growth(6, 4, 0, not drawn, "all", drawn, 5)
    cuts = None if drawn else trees.cuts_of(df, n=len(table))
    rows = trees.prepared(df, F.array(F.lit(trees.LEARNED)), cuts)
    read, scan = [], trees._scan

    def seen(*args):
        read.append(args[3])
        return scan(*args)

    monkeypatch.setattr(trees, "_scan", seen)
    own = trees.grow(rows, 1, 2, g, 3)
    assert read and all(m is not None and not m.met for m in read)
    monkeypatch.setattr(trees, "_trees_with_own_masses", lambda *a: 0)
    scanned = trees.grow(rows, 1, 2, g, 3)
    assert read[-1] is None and (own.feature == scanned.feature).all() and (own.feature >= 0).sum() > 20
    assert np.allclose(own.threshold, scanned.threshold) and np.allclose(own.value, scanned.value) and np.allclose(own.weight, scanned.weight)
