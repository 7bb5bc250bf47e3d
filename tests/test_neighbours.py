import numpy as np
from pyspark.sql import functions as F
import pytest

from steadyseed.operators import neighbours, resample
from steadyseed.operators.neighbours import neighbour_lists


def brute(ids, vecs, k, parts=None):
    found = {}
    for i, v in zip(ids, vecs, strict=True):
        pool = [(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in zip(ids, vecs, strict=True)
                if j != i and (parts is None or parts[j] == parts[i])]
        found[i] = [j for _, j in sorted(pool)[:k]]
    return found


def points(spark, vecs, parts=None, labels=None):
    rows = [(i, parts[i] if parts else "", labels[i] if labels else 0, [float(x) for x in v]) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "id bigint, part string, label bigint, vec array<double>")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    # Integer grid points (many ties), a far cluster, and a third of all rows in one spot.
    near = rng.integers(0, 12, size=(200, 2))
    far = rng.integers(1000, 1010, size=(100, 2))
    return np.vstack([near, far, np.full((150, 2), 3)]).tolist()


@pytest.mark.parametrize("block_rows", [20, 100, 4096])
def test_matches_brute_force(spark, cloud, block_rows):
    df = points(spark, cloud)
    expected = brute(range(len(cloud)), cloud, 5)
    for parts in (1, 6):
        got = neighbour_lists(df.select("id", "part", "vec").repartition(parts), df, 5, block_rows)
        assert {r["id"]: [n["id"] for n in r["neighbours"]] for r in got.collect()} == expected


@pytest.mark.parametrize("block_rows", [25, 4096])
def test_within_parts(spark, cloud, block_rows):
    parts = {i: "ab"[i % 2] if i < 440 else "c" for i in range(len(cloud))}
    df = points(spark, cloud, parts)
    expected = brute(range(len(cloud)), cloud, 12, parts)
    got = neighbour_lists(df, df, 12, block_rows)
    assert {r["id"]: [n["id"] for n in r["neighbours"]] for r in got.collect()} == expected
    assert "label" in got.columns


def test_wide_vectors(spark, tables):
    rows = spark.read.parquet(f"{tables}/embeddings.parquet").limit(120).collect()
    vecs = [[float(x) for x in r["embedding"]] for r in rows]
    df = points(spark, vecs)
    expected = brute(range(len(vecs)), vecs, 3)
    got = neighbour_lists(df, df, 3, 30)
    assert {r["id"]: [n["id"] for n in r["neighbours"]] for r in got.collect()} == expected


def test_queries_elsewhere_and_empty(spark):
    df = points(spark, [[0, 0], [1, 0], [5, 5]])
    asked = spark.createDataFrame([(100, "", [0.9, 0.0]), (101, "other", [0.0, 0.0])], "id bigint, part string, vec array<double>")
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in neighbour_lists(asked, df, 2).collect()}
    assert got[100] == [1, 0]
    assert neighbour_lists(asked, df.limit(0), 2).where(F.size("neighbours") > 0).isEmpty()


def imbalanced(spark, n=300):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        minority = i % 6 == 0
        x, z = rng.normal(1.0 if minority else 0.0, 1.0, 2)
        rows.append((i, float(x), float(z), int(minority)))
    return spark.createDataFrame(rows, "id bigint, x double, z double, label bigint")


def test_adasyn_properties(spark):
    df = imbalanced(spark)
    allocation = resample.adasyn_allocation(df, "id", ["x", "z"], "label").rows
    wanted = allocation.agg(F.sum("copies")).first()[0]
    balanced, reason = resample.adasyn(df, "id", ["x", "z"], "label")
    assert reason is None and balanced.count() == 300 + wanted
    synthetic = balanced.where("is_synthetic").collect()
    assert len({r["id"] for r in synthetic}) == wanted and all(r["label"] == 1 for r in synthetic)
    original = {r["id"]: (r["x"], r["z"]) for r in df.where("label = 1").collect()}
    for r in synthetic:
        ax, az = original[int(r["id"].split("~")[0])]
        # On the segment from the parent to some minority row.
        assert any(
            abs((bx - ax) * (r["z"] - az) - (bz - az) * (r["x"] - ax)) < 1e-9
            and min(ax, bx) - 1e-9 <= r["x"] <= max(ax, bx) + 1e-9 for bx, bz in original.values()
        )
    counts = {(r["stage"], r["label"]): r["n"] for r in resample.class_counts_before_after(df, balanced, "label").collect()}
    assert counts[("before", 1)] == 50 and counts[("after", 1)] == 50 + wanted and counts[("after", 0)] == 250


def test_adasyn_does_not_depend_on_layout(spark):
    df = imbalanced(spark)
    runs = []
    for parts, block_rows in ((1, 4096), (5, 40)):
        out, _ = resample.adasyn(df.repartition(parts), "id", ["x", "z"], "label", block_rows=block_rows)
        runs.append(sorted(map(tuple, out.collect())))
    assert runs[0] == runs[1]


def test_adasyn_leaves_alone(spark):
    df = imbalanced(spark)
    same = df.withColumn("label", (F.col("id") % 2).cast("bigint"))
    assert resample.adasyn(same, "id", ["x", "z"], "label")[1] == "classes are already balanced"
    few = df.withColumn("label", (F.col("id") < 5).cast("bigint"))
    table, reason = resample.adasyn(few, "id", ["x", "z"], "label")
    assert "fewer than 6 rows" in reason and table.count() == 300
    apart = df.withColumn("x", F.col("x") + F.col("label") * 1000)
    assert "no minority row" in resample.adasyn(apart, "id", ["x", "z"], "label")[1]


def test_a_query_is_copied_per_group_of_cells_not_per_cell(spark):
    from steadyseed.operators import neighbours

    rng = np.random.default_rng(2)
    # wide and alike in all directions, so that no cell can be ruled out
    df = points(spark, rng.normal(size=(400, 24)).tolist())
    pivots = np.array([r["vec"] for r in df.limit(40).collect()])
    cells = neighbours._cells(neighbours._assign_points(df, pivots), pivots)
    groups = neighbours._grouped(cells, 200)
    at_home = neighbours._visits(df.select("part", F.col("id").cast("string").alias("qkey"), "vec"), cells, 6, home=True)
    rows = neighbours._visits(at_home, cells, 6, home=False, groups=groups).select(F.size("cells").alias("n")).collect()
    assert sum(r["n"] for r in rows) > 400 * 30 and len(rows) <= 400 * (max(groups[""]) + 1)


def test_shares_of_some_rows_against_all(spark):
    df = imbalanced(spark)
    whole = resample.neighbour_shares(df, "id", ["x", "z"], "label", [1], block_rows=40).select("id", "others")
    some = resample.neighbour_shares(df, "id", ["x", "z"], "label", [1], block_rows=40, asked=F.col("id") % 12 == 0).select("id", "others")
    assert sorted(some.collect()) == sorted(r for r in whole.collect() if r["id"] % 12 == 0) and some.count() == 25


def test_products_find_the_same_nearest_as_summed_dimensions(monkeypatch):
    from steadyseed.operators import neighbours

    rng = np.random.default_rng(3)
    b = np.round(rng.normal(0, 1, (900, 20)), 1)
    b[500:560] = b[7]  # ties, settled by the place
    a = np.vstack([b[::30], rng.normal(0, 1, (20, 20)), b[7:8] + 1e-9, np.full((1, 20), 1e8)])
    exact = neighbours.squared_distances(a, b)
    for k in (1, 6):
        at, which = neighbours._best(exact, k)
        with monkeypatch.context() as m:
            m.setattr(neighbours, "squared_distances", None)  # only the pairs that can be near are summed
            found = neighbours.nearest_pairs(a, b, k)
        assert (found[0] == at).all() and (found[1] == which).all() and (found[2] == exact[at, which]).all()
    # what is not a number, and narrow vectors, are summed as they are
    b[3, 0] = np.inf
    assert (neighbours.nearest_pairs(a, b, 6)[1] == neighbours._best(neighbours.squared_distances(a, b), 6)[1]).all()
    assert (neighbours.nearest_pairs(a[:, :4], b[:, :4], 6)[1] == neighbours._best(neighbours.squared_distances(a[:, :4], b[:, :4]), 6)[1]).all()


@pytest.mark.parametrize(("dims", "scale"), [(1, [1.0]), (2, [3.0, 1.0]), (4, [50.0, 1e5, 0.1, 0.08]), (20, [1.0] * 20)])
def test_nearest_pivots_are_those_of_all_pairs(dims, scale, monkeypatch):
    rng = np.random.default_rng(dims)
    points = np.round(rng.normal(0, 1, (3000, dims)) * scale, 2)  # with ties
    pivots = np.unique(points[:400], axis=0)
    rng.shuffle(pivots)
    _, cell, near = neighbours.nearest_pairs(points, pivots, 1)
    compared = []
    whole = neighbours.squared_distances
    monkeypatch.setattr(neighbours, "squared_distances", lambda a, b: compared.append(len(a) * len(b)) or whole(a, b))
    found = neighbours.nearest_pivots(points, pivots)
    assert (found[0] == cell).all() and (found[1] == near).all()
    if dims == 4:
        assert sum(compared) < len(points) * len(pivots) / 5
