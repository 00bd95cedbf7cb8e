"""Contributions of inputs against Shapley's formula, and preprocessing across splits, saving and loading."""

import itertools
import math

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from quern.operators import explain as E
from quern.operators.preprocess import TabularPreprocessor, TabularPreprocessorModel

INPUTS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, float(i % 7), float(i * i % 11), float(i % 3), float(3 * (i % 7) - (i * i % 11) * (i % 3) + i % 2)) for i in range(150)]
    df = spark.createDataFrame(made, "id long, a double, b double, c double, y double")
    return VectorAssembler(inputCols=INPUTS, outputCol="features").transform(df)


def expected(nodes, at, x, known):
    """The tree's value where only some features are known: unknown splits are averaged by the training weights."""
    node = nodes[at]
    if node["leftChild"] < 0:
        return node["prediction"]
    f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
    if f in known:
        return expected(nodes, node["leftChild"] if x[f] <= cut else node["rightChild"], x, known)
    left, right = (nodes[node[k]]["impurityStats"][0] for k in ("leftChild", "rightChild"))
    return (left * expected(nodes, node["leftChild"], x, known) + right * expected(nodes, node["rightChild"], x, known)) / (left + right)


def shapley(value, n):
    out = []
    for i in range(n):
        others = [j for j in range(n) if j != i]
        out.append(sum(math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (value({*s, i}) - value(set(s))) for k in range(n) for s in itertools.combinations(others, k)))
    return out


OWN = {"labelCol": "y", "predictionCol": "p", "seed": 1}
MODELS = [(DecisionTreeRegressor, {"maxDepth": 5}), (RandomForestRegressor, {"numTrees": 4, "maxDepth": 4}), (GBTRegressor, {"maxIter": 4, "maxDepth": 3})]


@pytest.mark.parametrize("kind, sizes", MODELS)
def test_tree_contributions(spark, rows, kind, sizes):
    model = kind(**sizes, **OWN).fit(rows)
    found = E.contributions(model, rows, INPUTS, ["id", "a", "b", "c"]).collect()
    assert len(found) == 150
    trees = list(zip(E._saved_nodes(model, spark).items(), E._weights(model)))
    for r in found:
        assert r.base + sum(c["shap"] for c in r.contributions) == pytest.approx(r.prediction, abs=1e-9)
        assert [c["importance"] for c in r.contributions] == sorted((abs(c["shap"]) for c in r.contributions), reverse=True)
    for r in found[::10]:
        x = [r.a, r.b, r.c]
        want = shapley(lambda known: sum(w * expected(nodes, 0, x, known) for (_, nodes), w in trees), 3)
        got = {c["name"]: c for c in r.contributions}
        assert [got[n]["shap"] for n in INPUTS] == pytest.approx(want, abs=1e-9)
        assert [got[n]["value"] for n in INPUTS] == x
        assert all(c["direction"] == ("increase" if c["shap"] > 0 else "decrease" if c["shap"] < 0 else "neutral") for c in r.contributions)


def test_deep_paths_and_a_lone_leaf(spark):
    names = [f"x{i}" for i in range(9)]
    made = [tuple([i] + [float(i >> k & 1) for k in range(9)] + [float(i)]) for i in range(512)]
    df = spark.createDataFrame(made, f"id long, {', '.join(n + ' double' for n in names)}, y double")
    df = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    model = DecisionTreeRegressor(maxDepth=9, labelCol="y").fit(df)
    found = E.contributions(model, df, names, ["id"]).collect()
    assert all(r.base + sum(c["shap"] for c in r.contributions) == pytest.approx(r.id) for r in found)
    flat = DecisionTreeRegressor(maxDepth=3, labelCol="y").fit(df.withColumn("y", F.lit(2.0)))
    one = E.contributions(flat, df, names, ["id"]).first()
    assert one.base == one.prediction == 2.0 and {c["shap"] for c in one.contributions} == {0.0}
    assert E.contributions(model, df.limit(0), names, ["id"]).count() == 0


def test_linear_contributions(rows):
    model = LinearRegression(labelCol="y").fit(rows)
    found = E.contributions(model, rows, INPUTS, ["id"]).collect()
    assert all(r.base + sum(c["shap"] for c in r.contributions) == pytest.approx(r.prediction) for r in found)
    assert sum(c["shap"] for r in found for c in r.contributions) == pytest.approx(0, abs=1e-6)


def test_preprocessor(spark, tmp_path):
    schema = "id long, n double, m double, whole int, k string, code string"
    train = spark.createDataFrame([(1, 1.0, 5.0, 1, "b", "code"), (2, None, 6.0, 2, "a", None), (3, 3.0, 7.0, 3, None, "x"), (4, float("nan"), 8.0, 4, "b", "x")], schema)
    fitted = TabularPreprocessor(["n", "m", "whole", "absent"], ["k", "code", "absent"]).fit(train)
    path = f"file://{tmp_path}/fitted"
    fitted.save(path)
    loaded = TabularPreprocessorModel.load(path)
    assert loaded.medians == {"n": 2.0} and loaded.getOrDefault(loaded.categorical) == ["k", "code", "absent"]
    test = spark.createDataFrame([(1, None, None, None, "c", "x"), (2, 9.0, 1.0, 7, "b", None), (3, float("nan"), 2.0, 8, None, "code")], schema)
    for model in (fitted, loaded):
        out = model.transform(test)
        assert out.columns == test.columns
        assert sorted(tuple(r) for r in out.collect()) == [(1, 2.0, 0.0, 0.0, 0, 2), (2, 9.0, 1.0, 7.0, 2, 0), (3, 2.0, 2.0, 8.0, 0, 1)]
    estimator = TabularPreprocessor(["n"], ["k"])
    estimator.save(f"file://{tmp_path}/estimator")
    assert TabularPreprocessor.load(f"file://{tmp_path}/estimator").getOrDefault("numerical") == ["n"]
    empty = TabularPreprocessor(["n"], ["k"]).fit(train.limit(0))
    assert tuple(empty.transform(test.limit(1)).select("n", "k").first()) == (0.0, "c")


def test_training_rows_are_stored_once(spark, sf):
    """A model passes over its rows many times: the joins and medians behind them are not run again for each pass."""
    from quern.plans.graph_queries import _training

    plan = _training(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
