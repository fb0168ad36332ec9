"""The registered queries, each over the whole tables, and the SQL they are checked against.

Doubles are rounded to six digits and days written as text on both sides, since engines
sum in different orders and hand out dates in different types.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import oracle
from pitchframe.columns import FORM_MEASURES, LEAGUE, MATCH_COLUMNS, MATCH_KEY, OUTCOME_MEASURES, RAW_COLUMNS
from pitchframe.operators.elo import join_elo
from pitchframe.operators.match_rows import complete_rows, to_match_rows
from pitchframe.operators.metrics import accuracy, classification_report, majority_predictions
from pitchframe.operators.models import boosted_trees, logistic_regression, neural_net, random_forest
from pitchframe.operators.prep import (
    MatchPreprocessor,
    TargetEncoder,
    class_weights,
    walk_forward_one_hot,
    walk_forward_scaled,
)
from pitchframe.operators.rolling import add_rolling_features
from pitchframe.operators.splits import chronological_split, fold_rows, walk_forward_folds
from pitchframe.operators.standings import add_table_positions
from pitchframe.operators.team_rows import to_team_rows
from pitchframe.plans import summaries
from pitchframe.plans.dataset import exploratory_dataset, match_dataset
from pitchframe.plans.evaluation import (
    feature_importance,
    holdout_parts,
    holdout_report,
    mean_probabilities,
    ranked_ends,
    settled_dataset,
    walk_forward_report,
)
from pitchframe.session import new_folder, settle, settle_if_shared
from pitchframe.sources.derived import derived_elo, derived_matches
from pitchframe.sources.matches import read_matches, split_unscored, typed_matches
from pitchframe.sources.versions import read_version, replace_dataset, write_version

Query = Callable[[SparkSession, str], DataFrame]


def rounded(name: str) -> Column:
    """Six digits.  Spark rounds by way of decimal text; numbers that are not near the middle of two can do without.

    Below a million the product errs by less than 1e-4, and the quotient is the double next to the decimal number.
    """
    number = F.col(name)
    millionths = number * 1e6
    nearest = F.rint(millionths)
    plain = (F.abs(number) < 1e6) & (F.abs(millionths - nearest) < 0.499)
    return F.when(plain, nearest / 1e6).otherwise(F.round(number, 6))


def portable(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits (and no negative zero), days as text."""
    changed = {}
    for name, type_ in df.dtypes:
        if type_ == "double":
            changed[name] = rounded(name) + F.lit(0.0)
        elif type_ == "date":
            changed[name] = F.col(name).cast("string")
    return df.withColumns(changed)


def over_matches(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(derived_matches(spark, sf_dir))


def over_dataset(run: Callable[[DataFrame], DataFrame]) -> Query:
    """Queries that read the complete dataset several times get it settled."""
    return over_matches(lambda matches: run(settled_dataset(match_dataset(matches))))


def rolling(measures: list[str], scopes: list[str], windows: list[int]) -> Query:
    def run(matches: DataFrame) -> DataFrame:
        rows = to_team_rows(settle_if_shared(add_table_positions(matches, settled=True, later=True)))
        return add_rolling_features(rows, measures, windows, scopes, keep=[*MATCH_KEY, "Team", "Venue"])

    return over_matches(run)


def standings(matches: DataFrame) -> DataFrame:
    columns = ["HomeTeam", "AwayTeam", "match_no", "HomeTablePos", "AwayTablePos", "TablePosDiff"]
    needed = [*MATCH_KEY, "Date", "Time", "HomeTeam", "AwayTeam", "FTHG", "FTAG"]
    return add_table_positions(matches.select(*needed)).select(*MATCH_KEY, *columns)


def team_rows(with_positions: bool) -> Query:
    def run(matches: DataFrame) -> DataFrame:
        rows = to_team_rows(add_table_positions(matches), with_positions)
        return rows.drop("match_no", "league_matches")

    return over_matches(run)


def scaled(dataset: DataFrame) -> DataFrame:
    """Every fold's test rows, scaled by its training seasons."""
    numbers = MatchPreprocessor(categories=[], exclude=["HomeTeam", "AwayTeam"]).number_columns(dataset)
    return walk_forward_scaled(dataset, numbers).select("fold", *MATCH_KEY, *numbers)


def one_hot(matches: DataFrame) -> DataFrame:
    """The ones among every fold's encoded test rows; the matches themselves are read once."""
    return walk_forward_one_hot(settle(matches.select(*MATCH_KEY, "Date", "HomeTeam", "AwayTeam")))


def label_codes(matches: DataFrame) -> DataFrame:
    coded = TargetEncoder().fit_transform(matches.select(*MATCH_KEY, "FTR"))
    return coded.select(*MATCH_KEY, "FTR", F.col("label").cast("int").alias("label"))


def fold_membership(matches: DataFrame) -> DataFrame:
    return fold_rows(matches.select(*MATCH_KEY, "Date")).drop("Date")


def majority(matches: DataFrame) -> DataFrame:
    """Counted by season and result before the seasons multiply into folds."""
    counts = matches.groupBy("season", "FTR").agg(F.count("*").alias("n"), F.min("Date").alias("Date"))
    return majority_predictions(fold_rows(counts), weight="n")


ELO_COLUMNS = [*MATCH_KEY, "Date", "HomeTeam", "AwayTeam", "Home_Elo", "Away_Elo"]


def elo_enriched(matches: DataFrame) -> DataFrame:
    return join_elo(matches, derived_elo(matches)).select(*ELO_COLUMNS)


def elo_in_place(matches: DataFrame) -> DataFrame:
    """A dataset that is enriched from itself and replaced, twice."""
    spark, path = matches.sparkSession, new_folder(matches.sparkSession, "versions")
    write_version(matches.select(*MATCH_KEY, "Date", "HomeTeam", "AwayTeam"), path, ["season"])
    for _ in range(2):
        replace_dataset(spark, path, lambda dataset: join_elo(dataset, derived_elo(dataset)), ["season"])
    return read_version(spark, path).select(*ELO_COLUMNS)


def season_files(matches: DataFrame) -> DataFrame:
    """The matches written as season files of two headers, and read back by name in one scan."""
    path = new_folder(matches.sparkSession, "seasons")
    texts = matches.withColumn("Date", F.date_format("Date", "dd/MM/yyyy"))
    early, late = texts.where("season % 2 = 0"), texts.where("season % 2 = 1").withColumn("Referee", F.lit("N, N"))
    parts = {"early": early.select(*MATCH_KEY, *RAW_COLUMNS), "late": late.select("Referee", *reversed(RAW_COLUMNS), *MATCH_KEY)}
    for name, part in parts.items():
        part.write.partitionBy("div_name", "season").option("header", "true").csv(f"{path}/{name}")
    return read_matches(matches.sparkSession, [f"{path}/{name}" for name in parts])


def split_rows(matches: DataFrame) -> DataFrame:
    return chronological_split(matches.select(*MATCH_KEY, "Date", "Time"))


def text_matches(matches: DataFrame) -> DataFrame:
    """The matches as a season file's text, with the ways of writing a day, blanks and junk."""
    seq = F.col("match_seq")
    forms = {0: "dd/MM/yyyy", 1: "dd/MM/yy", 2: "yyyy-MM-dd", 5: "d/M/yyyy"}
    day = F.coalesce(*[F.when(seq % 7 == n, F.date_format("Date", form)) for n, form in forms.items()])
    day = F.when(seq % 7 == 3, "").when(seq % 7 == 4, "to be fixed").otherwise(day)
    texts = {c: F.col(c).cast("string") for c in RAW_COLUMNS}
    texts["Date"] = F.when(seq % 7 == 6, F.col("Date").cast("string")).otherwise(day)
    texts["FTHG"] = F.when(seq % 11 == 3, "n/a").otherwise(F.concat(F.col("FTHG").cast("string"), F.lit(".0")))
    texts["HS"] = F.when(seq % 5 == 2, " ").otherwise(texts["HS"])
    return matches.withColumns(texts)


def typed(matches: DataFrame) -> DataFrame:
    rows = typed_matches(text_matches(matches))
    usable, rejected = split_unscored(rows)
    both = usable.withColumn("usable", F.lit(True)).unionByName(rejected.withColumn("usable", F.lit(False)))
    return both.select(*MATCH_KEY, "Date", "FTHG", "FTAG", "HS", "usable")


def by_kick_off(matches: DataFrame) -> DataFrame:
    # Read for the matches and for either side's rows.
    placed = settle_if_shared(add_table_positions(matches, settled=True))
    return to_match_rows(to_team_rows(placed), placed, keep="all", kick_off_key=["Date", "Time"])


def feature_pairs(matches: DataFrame) -> DataFrame:
    """Two columns of the dataset, from the measures and the window that make them."""
    needed = matches.select(*MATCH_KEY, *MATCH_COLUMNS, "HC", "AC")
    return summaries.feature_pairs(match_dataset(needed, ["TablePosDiff", "Corners"], [5], [""]))


def support(report: DataFrame) -> DataFrame:
    """(fold, class, support, in_range): a report's rows by class, and whether its measures lie in 0 to 1."""
    inside = [F.col(c).between(0, 1) for c in ("precision", "recall", "f1")]
    rows = report.where(~F.col("class").isin("accuracy", "macro avg", "weighted avg"))
    by = [c for c in ("fold",) if c in report.columns]
    return rows.select(*by, "class", "support", reduce(lambda x, y: x & y, inside).alias("in_range"))


def calibration(dataset: DataFrame) -> DataFrame:
    """Intercepts carry no penalty: on its training rows a logistic model's mean probabilities are the shares."""
    train, _ = holdout_parts(dataset)
    found = mean_probabilities(train, lambda n, k: logistic_regression(n))
    return found.select("class", "rows", *[F.round(c, 2).alias(c) for c in ("share", "probability")])


def importance_names(dataset: DataFrame) -> DataFrame:
    """Every feature of the importance study, and what all importances sum to."""
    ranked = feature_importance(dataset)
    # As many rows as features.
    return ranked.select("Feature", F.round(F.sum("Importance").over(Window.partitionBy(F.lit(0))), 6).alias("total"))


ALL_MEASURES = [*FORM_MEASURES, *OUTCOME_MEASURES]

PLAIN: dict[str, Query] = {
    "derived_matches": over_matches(lambda m: m),
    "derived_elo": over_matches(derived_elo),
    "typed_matches": over_matches(typed),
    "dataset_by_kick_off": over_matches(by_kick_off),
    "goal_histogram": over_matches(summaries.goal_histogram),
    "points_gap_season": over_matches(lambda m: summaries.points_gap(m, LEAGUE)),
    "points_gap": over_matches(summaries.points_gap),
    "home_away_ppg": over_matches(summaries.home_away_ppg),
    "outcome_shares": over_matches(summaries.outcome_shares),
    "ppg_ranking": over_matches(summaries.ppg_ranking),
    "feature_pairs": over_matches(feature_pairs),
    "standings_before_match": over_matches(standings),
    "team_rows": team_rows(False),
    "team_rows_positions": team_rows(True),
    "rolling_venue_5": rolling(FORM_MEASURES, [""], [5]),
    "rolling_venue_10": rolling(FORM_MEASURES, [""], [10]),
    "rolling_all_5": rolling(FORM_MEASURES, ["_all"], [5]),
    "rolling_all_10": rolling(FORM_MEASURES, ["_all"], [10]),
    "rolling_points_win": rolling(OUTCOME_MEASURES, ["", "_all"], [5, 10]),
    "match_dataset": over_matches(match_dataset),
    "match_dataset_complete": over_matches(lambda m: complete_rows(match_dataset(m))),
    "exploratory_dataset": over_matches(lambda m: complete_rows(exploratory_dataset(m))),
    "elo_enriched": over_matches(elo_enriched),
    "elo_in_place": over_matches(elo_in_place),
    "season_files": over_matches(season_files),
    "chrono_split": over_matches(split_rows),
    "walk_forward_folds": over_matches(walk_forward_folds),
    "walk_forward_rows": over_matches(fold_membership),
    "scaled_features": over_dataset(scaled),
    "one_hot_teams": over_matches(one_hot),
    "label_codes": over_matches(label_codes),
    "class_weights": over_matches(lambda m: class_weights(m, "FTR")),
    "majority_baseline_report": over_matches(lambda m: classification_report(majority(m), ["fold"], "n")),
    "majority_baseline_accuracy": over_matches(lambda m: accuracy(majority(m), ["fold"], "n")),
    "feature_importance_top10": over_dataset(lambda d: ranked_ends(feature_importance(d))),
    "feature_importance_names": over_dataset(importance_names),
    "walk_forward_lr_support": over_dataset(
        lambda d: support(walk_forward_report(d, lambda n, k: logistic_regression(n)))
    ),
    "walk_forward_rf_support": over_dataset(lambda d: support(walk_forward_report(d, lambda n, k: random_forest()))),
    "holdout_lr_calibration": over_dataset(calibration),
    "holdout_gbt_support": over_dataset(lambda d: support(holdout_report(d, lambda n, k: boosted_trees()))),
    "holdout_mlp_support": over_dataset(lambda d: support(holdout_report(d, lambda n, k: neural_net()))),
    "walk_forward_lr": over_dataset(lambda d: walk_forward_report(d, lambda n, k: logistic_regression(n))),
    "walk_forward_rf": over_dataset(lambda d: walk_forward_report(d, lambda n, k: random_forest())),
    "holdout_lr": over_dataset(lambda d: holdout_report(d, lambda n, k: logistic_regression(n))),
    "holdout_gbt": over_dataset(lambda d: holdout_report(d, lambda n, k: boosted_trees())),
    "holdout_mlp": over_dataset(lambda d: holdout_report(d, lambda n, k: neural_net())),
}


def comparable(run: Query) -> Query:
    return lambda spark, sf_dir: portable(run(spark, sf_dir))


QUERIES: dict[str, Query] = {name: comparable(run) for name, run in PLAIN.items()}


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
