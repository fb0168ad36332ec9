"""Feature preparation: scaling, one-hot teams, label codes, class weights."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchframe.columns import LEAK_COLUMNS, MATCH_KEY
from pitchframe.operators.splits import season_order
from pitchframe.operators.stored import StoredModel

TEAMS = ("HomeTeam", "AwayTeam")


class TargetEncoder:
    """Class labels as codes in alphabetical order; an unseen label raises."""

    def __init__(self, label: str = "FTR") -> None:
        self.label = label
        self.model: StringIndexerModel | None = None

    def fit(self, df: DataFrame) -> TargetEncoder:
        indexer = StringIndexer(
            inputCol=self.label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error"
        )
        self.model = indexer.fit(df)
        return self

    @property
    def classes(self) -> list[str]:
        return list(self.model.labels)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def names(self, code: str):
        """The class name behind a code column."""
        labels = F.array(*[F.lit(c) for c in self.classes])
        return F.element_at(labels, F.col(code).cast("int") + 1)


class _PrepParams(Params):
    categories = Param(Params._dummy(), "categories", "columns that are one-hot encoded", TypeConverters.toListString)
    exclude = Param(Params._dummy(), "exclude", "further columns that are no features", TypeConverters.toListString)


class MatchPreprocessor(Estimator, _PrepParams, DefaultParamsWritable, DefaultParamsReadable):
    """Standard scaling of numbers and one-hot encoding of categories into ``features``.

    Numbers are all columns but the categories, the keys and what is known only after
    the match.  They are scaled with the population standard deviation (1 where a column is
    constant), from one aggregation over the training rows.  A category not seen in training
    becomes all zeros.  Everything fitted is a handful of numbers per column or team.
    """

    def __init__(self, categories: Sequence[str] = TEAMS, exclude: Sequence[str] = ()) -> None:
        super().__init__()
        self._set(categories=list(categories), exclude=list(exclude))

    def number_columns(self, df: DataFrame) -> list[str]:
        categories = self.getOrDefault("categories")
        left_out = {*MATCH_KEY, *LEAK_COLUMNS, "label", "weight", "split", "fold", "role", *self.getOrDefault("exclude")}
        return [c for c in df.columns if c not in left_out and c not in categories]

    def _fit(self, dataset: DataFrame) -> MatchPreprocessorModel:
        model = MatchPreprocessorModel()
        model.scaling = _moments(dataset, self.number_columns(dataset))
        categories = self.getOrDefault("categories")
        model.labels = {}
        if categories:
            codes = [f"code_{c}" for c in categories]
            indexer = StringIndexer(inputCols=categories, outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep")
            model.labels = {c: list(labels) for c, labels in zip(categories, indexer.fit(dataset).labelsArray)}
        return self._copyValues(model)


def _moments(train: DataFrame, numbers: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per number column, as one vector aggregate."""
    if not numbers:
        return {}
    metrics = Summarizer.metrics("mean", "variance", "count").summary(F.col("numbers"))
    vectors = VectorAssembler(inputCols=list(numbers), outputCol="numbers").transform(train)
    found = vectors.select(metrics.alias("m")).select("m.*").first()
    rows = found["count"]
    # The summarizer's variance divides by rows - 1.
    squares = found["variance"].toArray() * max(rows - 1, 0)
    spread = deviations(np.full(len(squares), rows), found["mean"].toArray(), squares)
    return {c: (float(m), float(s)) for c, m, s in zip(numbers, found["mean"], spread)}


class MatchPreprocessorModel(StoredModel, _PrepParams):
    """Adds ``features``; keys, label columns and the raw categories stay."""

    scaling: dict[str, tuple[float, float]]
    labels: dict[str, list[str]]

    @property
    def numbers(self) -> list[str]:
        return list(self.scaling)

    def scaled(self, df: DataFrame) -> DataFrame:
        """The number columns scaled in place."""
        return df.withColumns(
            {c: (F.col(c) - F.lit(mean)) / F.lit(std) for c, (mean, std) in self.scaling.items()}
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ready = self.scaled(dataset)
        parts = self.numbers
        if self.labels:
            names = list(self.labels)
            codes = [f"code_{c}" for c in names]
            coded = ready
            # One by one: label lists of different lengths would be filled up with nulls.
            for name, code in zip(names, codes):
                coded = StringIndexerModel.from_labels(self.labels[name], name, code, handleInvalid="keep").transform(coded)
            encoder = OneHotEncoder(inputCols=codes, outputCols=[f"cat_{c}" for c in names], dropLast=True)
            # The number of codes is known from the indexer: no row is read here.
            ready = encoder.fit(coded.limit(0)).transform(coded)
            parts = parts + [f"cat_{c}" for c in names]
        kept = [c for c in dataset.columns if c not in self.scaling]
        assembled = VectorAssembler(inputCols=parts, outputCol="features").transform(ready)
        return assembled.select(*kept, "features")

    def feature_names(self) -> list[str]:
        """Names of the entries of ``features``, in order."""
        return [f"num__{c}" for c in self.scaling] + [f"cat__{c}_{label}" for c, own in self.labels.items() for label in own]

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        scaling = [(n, c, *moments) for n, (c, moments) in enumerate(self.scaling.items())]
        labels = [(n, c, own) for n, (c, own) in enumerate(self.labels.items())]
        return {
            "scaling": spark.createDataFrame(scaling, "n int, name string, mean double, deviation double"),
            "labels": spark.createDataFrame(labels, "n int, name string, labels array<string>"),
        }

    def restore(self, tables: dict[str, DataFrame]) -> None:
        self.scaling = {r["name"]: (r["mean"], r["deviation"]) for r in tables["scaling"].orderBy("n").collect()}
        self.labels = {r["name"]: list(r["labels"]) for r in tables["labels"].orderBy("n").collect()}


# Moments by season: counts, means and squared deviations merge exactly enough in any order.

Moments = tuple[np.ndarray, np.ndarray, np.ndarray]


def moments_of(values: np.ndarray) -> Moments:
    """Of every column of a matrix, without its NaN."""
    known = ~np.isnan(values)
    n = known.sum(axis=0)
    # The first known value is taken off before adding up, so that large means cost no digits.
    first = values[known.argmax(axis=0), np.arange(values.shape[1])]
    first = np.where(n > 0, first, 0.0)
    apart = np.where(known, values - first, 0.0)
    mean = apart.sum(axis=0) / np.maximum(n, 1)
    squares = np.where(known, (values - first) - mean, 0.0) ** 2
    return n, first + mean, squares.sum(axis=0)


def merged_moments(a: Moments, b: Moments) -> Moments:
    n = a[0] + b[0]
    apart = b[1] - a[1]
    share = b[0] / np.maximum(n, 1)
    return n, np.where(a[0] > 0, a[1] + apart * share, b[1]), a[2] + b[2] + np.where(a[0] > 0, apart**2 * a[0] * share, 0.0)


def deviations(n: np.ndarray, mean: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Population deviations; 1 where all that is left of a column is rounding."""
    variance = squares / np.maximum(n, 1)
    eps = np.finfo(np.float64).eps
    constant = variance <= n * eps * variance + (n * mean * eps) ** 2
    return np.where(constant, 1.0, np.sqrt(variance))


SEASON_MOMENTS = "n array<long>, mean array<double>, squares array<double>"


def season_moments(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """(season, n, mean, squares): moments of every number column, nulls left out, a row a season."""
    season = df.schema["season"]
    schema = f"season {season.dataType.simpleString()}, {SEASON_MOMENTS}"
    names = ["season", "n", "mean", "squares"]

    def row(key: pa.Scalar, moments: Moments) -> pa.RecordBatch:
        types = [pa.int64(), pa.float64(), pa.float64()]
        lists = [pa.array([m.tolist()], pa.list_(t)) for m, t in zip(moments, types)]
        return pa.RecordBatch.from_arrays([pa.array([key.as_py()], key.type), *lists], names)

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, tuple[pa.Scalar, Moments]] = {}
        for batch in batches:
            arrays = [batch.column(c).cast(pa.float64()) for c in numbers]
            values = np.stack([a.fill_null(np.nan).to_numpy(zero_copy_only=False) for a in arrays], axis=1)
            keys = batch.column("season")
            for key in keys.unique():
                same = pc.is_null(keys) if not key.is_valid else pc.fill_null(pc.equal(keys, key), False)
                own = moments_of(values[same.to_numpy(zero_copy_only=False)])
                held[key.as_py()] = (key, merged_moments(held[key.as_py()][1], own) if key.as_py() in held else own)
        for key, own in held.values():
            yield row(key, own)

    def of_seasons(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, moments = None, None
        for batch in batches:
            for at, key in enumerate(batch.column("season")):
                own = tuple(batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in names[1:])
                if now is not None and key == now:
                    moments = merged_moments(moments, own)
                    continue
                if now is not None:
                    yield row(now, moments)
                now, moments = key, own
        if now is not None:
            yield row(now, moments)

    parts = df.select("season", *numbers).mapInArrow(of_batches, schema)
    return parts.repartition("season").sortWithinPartitions("season").mapInArrow(of_seasons, schema)


def walk_forward_scales(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """(_season, fold, means, deviations) of every season but the first, from the seasons before it."""
    placed = season_order(df).withColumnRenamed("season", "_season")
    moments = season_moments(df, numbers)
    ordered = moments.join(placed, F.col("season").eqNullSafe(F.col("_season"))).drop("season")
    kind = df.schema["season"].dataType.simpleString()

    def forward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier: Moments | None = None
        for batch in batches:
            for at in range(len(batch)):
                own = tuple(batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in ("n", "mean", "squares"))
                if earlier is not None:
                    lists = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (earlier[1], deviations(*earlier))]
                    fold = pa.array([batch.column("place")[at].as_py()], pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column("_season").slice(at, 1), fold, *lists], ["_season", "fold", "means", "deviations"])
                earlier = own if earlier is None else merged_moments(earlier, own)

    # One row per season by now, merged forward in order.
    return ordered.repartition(1).sortWithinPartitions("place").mapInArrow(
        forward, f"_season {kind}, fold int, means array<double>, deviations array<double>"
    )


def walk_forward_scaled(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """Every row but the first season's with ``fold``, its ``numbers`` scaled by the seasons before.

    Moments per season come from one pass and are merged forward over the short table of
    seasons, so the work does not grow with their square.  Nulls stay null.
    """
    rows = df.join(walk_forward_scales(df, numbers), F.col("season").eqNullSafe(F.col("_season")))
    ready = {c: (F.col(c) - F.get("means", F.lit(i))) / F.get("deviations", F.lit(i)) for i, c in enumerate(numbers)}
    return rows.withColumns(ready).select("fold", *df.columns)


def walk_forward_one_hot(df: DataFrame, categories: Sequence[str] = TEAMS) -> DataFrame:
    """(fold, match key, position, feature): the ones among the encoded test rows of all folds.

    A value's code in a fold is its rank among the column's values that the seasons before
    hold; a value not among them has no entry.  First seasons come from one pass, and codes
    from running ranks over values and folds, so the rows are read once for all folds.
    """
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("no"), F.col(c).alias("value")) for n, c in enumerate(categories)]))
    order = season_order(df).withColumnRenamed("season", "_season")
    last = order.agg(F.max("place").alias("last"))
    placed = df.join(order, F.col("season").eqNullSafe(F.col("_season")))
    entries = placed.select(F.col("place").alias("fold"), *MATCH_KEY, values.alias("entry")).select("fold", *MATCH_KEY, "entry.*")
    firsts = entries.where("value IS NOT NULL").groupBy("no", "value").agg(F.min("fold").alias("first"))
    # A row per value and fold that knows it; ``last`` is one row.
    later = F.explode(F.when(F.col("first") < F.col("last"), F.sequence(F.col("first") + 1, F.col("last"))))
    known = firsts.withColumn("one", F.lit(1)).join(last.withColumn("one", F.lit(1)), "one").select("no", "value", later.alias("fold"))
    ranks = Window.partitionBy("no", "fold").orderBy("value")
    coded = known.withColumn("rank", F.row_number().over(ranks) - 1)
    sizes = known.groupBy("no", "fold").agg(F.count("*").alias("size"))
    # At most a row per category and fold.
    earlier = Window.partitionBy("fold").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("no", "fold", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    codes = coded.join(offsets, ["no", "fold"]).select("no", "fold", "value", (F.col("rank") + F.col("offset")).cast("int").alias("position"))
    names = F.element_at(F.array(*[F.lit(f"cat__{c}_") for c in categories]), F.col("no") + 1)
    return entries.join(codes, ["no", "fold", "value"]).select(
        "fold", *MATCH_KEY, "position", F.concat(names, F.col("value")).alias("feature")
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, weight): rows / (classes x rows of the class), so that classes weigh the same."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    # One row per class by now.
    every = Window.partitionBy(F.lit(0))
    rows, classes = F.sum("n").over(every), F.count("*").over(every)
    return counts.select(label, (rows / (classes * F.col("n"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight``: a join with the small table of classes, which Spark broadcasts by its size."""
    weights = class_weights(df, label).withColumnRenamed(label, "_class")
    return df.join(weights, F.col(label).eqNullSafe(F.col("_class"))).drop("_class")
