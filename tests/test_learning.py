import pytest
from pyspark.ml.functions import vector_to_array

from pitchframe.columns import MATCH_KEY
from pitchframe.operators import splits
from pitchframe.operators.metrics import accuracy, classification_report, majority_predictions
from pitchframe.operators.models import boosted_trees, logistic_regression, neural_net, random_forest
from pitchframe.operators.prep import MatchPreprocessor, TargetEncoder, class_weights, with_class_weights
from pitchframe.plans.dataset import match_dataset
from pitchframe.plans.evaluation import (
    feature_importance,
    fit_predict,
    holdout_parts,
    holdout_report,
    parts_for,
    ranked_ends,
    settled_dataset,
    walk_forward_report,
)
from test_standings import in_order, league


@pytest.fixture(scope="module")
def seasons(make_matches):
    parts = []
    for i, season in enumerate(["99-00", "00-01", "01-02"]):
        rows = [(r[0], r[1].replace("2021", str(1999 + i)), *r[2:]) for r in league(20 + i, 90, 5, 90)]
        parts.append(make_matches(rows, season=season))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@pytest.fixture(scope="module")
def dataset(seasons):
    return settled_dataset(match_dataset(seasons))


def test_scaling_uses_population_deviation(spark):
    train = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (6.0, 5.0)], "x double, same double")
    prep = MatchPreprocessor(categories=[]).fit(train)
    assert prep.scaling["x"] == (3.0, pytest.approx(1.8708286933869707))
    assert prep.scaling["same"] == (5.0, 1.0)
    later = prep.scaled(spark.createDataFrame([(3.0, 7.0)], train.schema)).first()
    assert tuple(later) == (0.0, 2.0)


def test_one_hot_gives_zeros_for_unseen_values(spark):
    train = spark.createDataFrame([("c",), ("a",), ("b",)], "team string")
    prep = MatchPreprocessor(["team"]).fit(train)
    assert prep.feature_names() == ["cat__team_a", "cat__team_b", "cat__team_c"]
    got = prep.transform(spark.createDataFrame([("a",), ("zzz",)], train.schema))
    assert [r[0] for r in got.select(vector_to_array("features")).collect()] == [[1, 0, 0], [0, 0, 0]]


def test_label_codes(spark):
    target = TargetEncoder().fit(spark.createDataFrame([("H",), ("A",), ("D",)], "FTR string"))
    assert target.classes == ["A", "D", "H"]
    with pytest.raises(Exception):
        target.transform(spark.createDataFrame([("X",)], "FTR string")).collect()


def test_class_weights_balance(spark):
    rows = spark.createDataFrame([("H",)] * 4 + [("A",)] * 2, "label string")
    weights = {r["label"]: r["weight"] for r in class_weights(rows).collect()}
    assert weights == {"H": 6 / 8, "A": 6 / 4}
    total = with_class_weights(rows).groupBy("label").sum("weight").collect()
    assert {r[1] for r in total} == {3.0}


def test_folds_follow_time_not_labels(seasons):
    folds = {(r["fold"], r["role"], r["season"]) for r in splits.walk_forward_folds(seasons).collect()}
    assert folds == {
        (1, "train", "99-00"),
        (1, "test", "00-01"),
        (2, "train", "99-00"),
        (2, "train", "00-01"),
        (2, "test", "01-02"),
    }
    assert list(splits.fold_seasons(seasons)) == [(1, ["99-00"], "00-01"), (2, ["99-00", "00-01"], "01-02")]
    counts = splits.fold_rows(seasons).groupBy("fold", "role").count().collect()
    assert {tuple(r) for r in counts} == {(1, "train", 90), (1, "test", 90), (2, "train", 180), (2, "test", 90)}


def test_first_rows_train(make_matches):
    rows = league(30, 55, 4, 12)
    got = splits.chronological_split(make_matches(rows)).collect()
    train = {r["match_seq"] for r in got if r["split"] == "train"}
    assert train == {r[0] for r in in_order(rows)[: int(55 * 0.8)]}
    five = make_matches([(i, f"2021-08-{i + 1:02d}", "15:00", "A", "B", 0, 0) for i in range(5)])
    assert splits.chronological_split(five).where("split = 'test'").count() == 1


def test_report_matches_counts_by_hand(spark):
    pairs = [("H", "H")] * 3 + [("H", "A")] + [("A", "H")] + [("A", "A")] * 2 + [("D", "H")]
    predictions = spark.createDataFrame(pairs, "label string, prediction string")
    report = {r["class"]: r for r in classification_report(predictions).collect()}
    assert report["H"]["precision"] == pytest.approx(3 / 5)
    assert report["H"]["recall"] == pytest.approx(3 / 4)
    assert (report["D"]["precision"], report["D"]["f1"], report["D"]["support"]) == (0.0, 0.0, 1)
    assert report["accuracy"]["f1"] == pytest.approx(5 / 8)
    assert report["macro avg"]["recall"] == pytest.approx((3 / 4 + 2 / 3) / 3)
    assert report["weighted avg"]["recall"] == pytest.approx(5 / 8)
    counted = predictions.groupBy("label", "prediction").count().withColumnRenamed("count", "n")
    assert accuracy(counted, weight="n").first()[0] == accuracy(predictions).first()[0] == pytest.approx(5 / 8)


def test_majority_takes_the_first_class_on_a_tie(spark):
    rows = [(1, "train", "H")] * 2 + [(1, "train", "A")] * 2 + [(1, "test", "H"), (1, "test", "A")]
    got = majority_predictions(spark.createDataFrame(rows, "fold int, role string, FTR string"))
    assert {(r["label"], r["prediction"], r["n"]) for r in got.collect()} == {("H", "A", 1), ("A", "A", 1)}


def test_walk_forward_reports_every_fold(dataset):
    report = walk_forward_report(dataset, lambda n, k: logistic_regression(n, max_iter=20))
    rows = report.where("class = 'accuracy'").collect()
    assert {r["fold"] for r in rows} == {1, 2} and all(0 <= r["f1"] <= 1 for r in rows)


def test_strong_penalty_shrinks_to_the_majority(dataset):
    predicted = fit_predict(dataset, dataset, lambda n, k: logistic_regression(n, c=1e-9))
    assert predicted.select("prediction").distinct().count() == 1


@pytest.mark.parametrize(
    "make",
    [lambda n, k: random_forest(5), lambda n, k: boosted_trees(2), lambda n, k: neural_net(epochs=3)],
    ids=["forest", "boosted", "net"],
)
def test_other_models_run(dataset, make):
    report = {r["class"]: r for r in holdout_report(dataset, make).collect()}
    assert 0 <= report["accuracy"]["f1"] <= 1
    assert report["accuracy"]["support"] == dataset.count() - int(dataset.count() * 0.8)


def test_importance_covers_every_feature(dataset):
    importance = feature_importance(dataset, trees=5, depth=4)
    rows = importance.collect()
    assert sum(r["Importance"] for r in rows) == pytest.approx(1.0)
    assert {"num__Home_TablePosDiff", "cat__HomeTeam_t00", "cat__season_label_99-00"} <= {r["Feature"] for r in rows}
    ends = ranked_ends(importance, 3).collect()
    assert [r["list"] for r in ends].count("top") == 3 and len(ends) == 6
    assert max(rows, key=lambda r: r["Importance"])["Importance"] == max(r["Importance"] for r in ends)


def test_parts_are_those_of_the_split_and_deal_nothing(spark, make_matches):
    """The wide rows are only compared with the first test row."""
    rows = [(n, f"2021-08-{1 + n * 7 % 20:02d}", ["15:00", None, "12:30"][n % 3], "A", "B", n % 4, 1) for n in range(60)]
    both = make_matches(rows).unionByName(make_matches(rows, div="K")).unionByName(make_matches(rows, season="22-23"))
    for share in (0.0, 0.3, 0.8, 1.0):
        marked = {tuple(r[k] for k in MATCH_KEY): r["split"] for r in splits.chronological_split(both, share).collect()}
        for part, df in zip(("train", "test"), splits.chronological_parts(both, share)):
            assert {tuple(r[k] for k in MATCH_KEY) for r in df.collect()} == {k for k, v in marked.items() if v == part}
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_logistic_regression_keeps_no_second_copy(spark, dataset, monkeypatch):
    """It keeps its rows in blocks; the frame it is given is not kept as well."""
    from pyspark import StorageLevel
    from pyspark.ml.classification import LogisticRegression

    given, own = [], LogisticRegression._fit
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, df: given.append(df) or own(self, df))
    fit_predict(*holdout_parts(dataset), lambda n, k: logistic_regression(n)).collect()
    assert [df.storageLevel for df in given] == [StorageLevel.NONE]
    assert "Exchange" not in given[0]._jdf.queryExecution().executedPlan().toString()


def test_parts_suit_the_model():
    """What fits one task is trained there in a few jobs; more is dealt into parts as before."""
    net, boosting, forest = neural_net(), boosted_trees(), random_forest()
    assert [parts_for(net, size << 20) for size in (1, 180, 256, 257, 800)] == [1, 1, 1, 33, 100]
    assert [parts_for(boosting, size << 20) for size in (0, 18, 180)] == [1, 1, 6]
    assert [parts_for(forest, size << 20) for size in (0, 18, 180)] == [1, 3, 23]
