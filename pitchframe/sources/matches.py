"""Readers and writers for season files, datasets and ratings."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pitchframe.columns import COUNT_COLUMNS, LEAGUE, MATCH_KEY, RAW_COLUMNS, require_columns
from pitchframe.operators.match_rows import complete_rows
from pitchframe.operators.ordering import match_order
from pitchframe.session import settle

HEADER_BYTES = 1 << 20  # within which a file's first line ends
LINE_BITS = 32  # of a row's number that count its line, above those of its file
SEASON_PATTERN = r"(?:^|\D)(\d\d-\d\d)\.csv$"


def parse_day(text: Column) -> Column:
    """Day-first dates with two- or four-digit years, or ISO dates; anything else is NULL."""
    patterns = ["d/M/yyyy", "d/M/yy", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)).cast("date") for p in patterns])


def file_season(path: Column) -> Column:
    """The season of the file at ``path``: a ``season=`` folder, else ``21-22`` before ``.csv``.

    A file without either raises: rows of unknown seasons would merge into one.
    """
    found = F.coalesce(_folder_value(path, "season"), F.nullif(F.regexp_extract(path, SEASON_PATTERN, 1), F.lit("")))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no season in the name of "), path)))


def _folder_value(path: Column, key: str) -> Column:
    """The value of a ``key=value`` folder on the way to a file, else NULL."""
    value = F.regexp_extract(path, rf"/{key}=([^/]+)/", 1)
    return F.url_decode(F.nullif(value, F.lit("")))


def _parsed_file(raw: bytes, wanted: list[str], needed: list[str], path: str) -> pa.Table:
    """Text columns of one CSV file by name; an empty field is NULL, and so is a column that is not ``needed`` and not there."""
    texts = {c: pa.string() for c in wanted}
    convert = arrow_csv.ConvertOptions(
        include_columns=wanted, include_missing_columns=True, column_types=texts, strings_can_be_null=True, null_values=[""]
    )
    head = next(csv.reader(io.StringIO(raw[:HEADER_BYTES].decode("utf-8-sig", "replace"))), [])
    missing = [c for c in needed if c not in head]
    if missing:
        raise ValueError(f"missing columns {missing} in {path}")
    if not head:
        return pa.table({c: pa.array([], pa.string()) for c in wanted})
    try:
        return arrow_csv.read_csv(pa.BufferReader(raw), parse_options=arrow_csv.ParseOptions(newlines_in_values=True), convert_options=convert)
    except (pa.ArrowInvalid, pa.ArrowKeyError):
        # Rows of other lengths, letters in another encoding or repeated names: slower, but it takes them.
        lines = csv.reader(io.StringIO(raw.decode("utf-8-sig", "replace")))
        names = next(lines)
        at = [names.index(c) if c in names else None for c in wanted]
        rows = [[r[i] or None if i is not None and i < len(r) else None for i in at] for r in lines if r]
        return pa.table({c: pa.array([r[n] for r in rows], pa.string()) for n, c in enumerate(wanted)})


def _scan_csv(spark: SparkSession, paths: str | Iterable[str], needed: list[str] | None = None) -> DataFrame:
    """Text columns ``needed`` of CSV files, with league, season and match_seq, in one scan.

    match_seq numbers files by path and lines within them, where the files hold none.

    A row of the scan is a whole file, whose own header says where its columns are; only the
    columns asked for are kept.  So files may differ in columns and order, and nothing is read
    twice.  Without ``needed`` the columns are those of the first file.  A file of more than
    2 GB fails the run.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    header = spark.read.option("recursiveFileLookup", "true").csv(paths, header=True)
    if needed is not None:
        require_columns(header, needed, f"Files: {paths[:3]}")
    wanted = needed or [c for c in header.columns if c not in (*MATCH_KEY, "Div")]
    keys = ["div_name", "Div", "match_seq"]
    names = ["_path", "_line", *wanted, *[f"_{k}" for k in keys]]

    def parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = content.as_py()
                own = _parsed_file(raw, [*wanted, *keys], needed or [], path)
                place = [pa.array([path] * len(own), pa.string()), pa.array(range(len(own)), pa.int64())]
                columns = [*place, *[own[c] for c in (*wanted, *keys)]]
                yield from pa.table(columns, names=names).combine_chunks().to_batches()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    whole = files.select(F.col("_metadata.file_path").alias("path"), "content")
    schema = ", ".join(f"`{name}` {'long' if name == '_line' else 'string'}" for name in names)
    # A row per file, for which no file is opened: the files in order of their paths.
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_path"))
    placed = files.select(F.col("_metadata.file_path").alias("_path")).withColumn("_file", order.cast("long"))
    path, in_order = F.col("_path"), F.shiftleft("_file", LINE_BITS) + F.col("_line")
    return whole.mapInArrow(parsed, schema).join(placed, "_path").select(
        *wanted,
        F.coalesce(_folder_value(path, "div_name"), "_div_name", "_Div").alias("div_name"),
        file_season(path).alias("season"),
        F.coalesce(F.col("_match_seq").try_cast("long"), in_order).alias("match_seq"),
    )


def typed_matches(scan: DataFrame, div_name: str = "all") -> DataFrame:
    """Text columns of season files to a typed match frame; what cannot be read is NULL."""
    counts = {c: F.col(c).try_cast("double").cast("int") for c in COUNT_COLUMNS}
    return scan.withColumns(
        {"Date": parse_day(F.col("Date")), "div_name": F.coalesce("div_name", F.lit(div_name)), **counts}
    ).select(*MATCH_KEY, *RAW_COLUMNS)


def read_matches(spark: SparkSession, paths: str | Iterable[str], div_name: str = "all") -> DataFrame:
    """Season CSV files (one path, a list, or folders) as one typed match frame.

    The league comes from a folder or the ``Div`` column (``div_name`` without one), the season
    from a folder or the file name, and ``match_seq`` numbers the rows in file order.  A missing
    column or season raises.  Write the result once with ``write_matches`` and read it from
    there: the staged table prunes columns and seasons, and fixes ``match_seq``.
    """
    return typed_matches(_scan_csv(spark, paths, RAW_COLUMNS), div_name)


def split_unscored(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches with keys, a date and a score, the others); only the former can enter a table."""
    needed = [*MATCH_KEY, "Date", "FTHG", "FTAG"]
    usable = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in needed])
    return matches.where(usable), matches.where(~usable)


def write_matches(matches: DataFrame, path: str) -> None:
    """Stage matches as Parquet by league and season, in order within each file."""
    in_order(matches).write.partitionBy(*LEAGUE).parquet(path)


def read_staged(spark: SparkSession, path: str, seasons: Iterable[str] | None = None) -> DataFrame:
    """A staged or exported Parquet table; ``seasons`` prunes partitions."""
    table = spark.read.parquet(path)
    return table if seasons is None else table.where(F.col("season").isin(list(seasons)))


def read_dataset_csv(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Processed season CSVs, typed: files such as ``21-22.csv``, or the folders that
    ``export_dataset(format="csv")`` writes by league and season."""
    scan = _scan_csv(spark, paths)
    names = [c for c in scan.columns if c not in MATCH_KEY]
    text = {"Time", "HomeTeam", "AwayTeam", "FTR", "Date"}
    numbers = {c: F.col(c).try_cast("double") for c in names if c not in text}
    goals = {c: F.col(c).try_cast("double").cast("int") for c in ("FTHG", "FTAG") if c in names}
    typed = scan.withColumns({**numbers, **goals, "Date": parse_day(F.col("Date"))})
    return typed.withColumn("div_name", F.coalesce("div_name", F.lit("all"))).select(*MATCH_KEY, *names)


def read_elo(spark: SparkSession, path: str) -> DataFrame:
    """Rating snapshots: team, QueryDate, elo."""
    table = spark.read.csv(path, header=True)
    return table.select("team", parse_day(F.col("QueryDate")).alias("QueryDate"), F.col("elo").try_cast("double"))


def in_order(df: DataFrame) -> DataFrame:
    """Sort by league, season and kick-off, source order within a kick-off."""
    return df.orderBy(*LEAGUE, *match_order())


def _qualified(spark: SparkSession, path: str) -> str:
    """The absolute form of a path, with its file system."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return str(system.makeQualified(there).toString()).rstrip("/")


def _input_roots(df: DataFrame) -> set[str]:
    """The paths that a frame's file scans were given, without listing their files."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    roots = set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            relation = leaf.relation()
            if relation.getClass().getSimpleName() == "HadoopFsRelation":
                paths = relation.location().rootPaths()
                roots |= {_qualified(df.sparkSession, paths.apply(k).toString()) for k in range(paths.size())}
    return roots


def export_dataset(
    matches: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists"
) -> tuple[DataFrame, tuple[int, int]]:
    """Write the complete rows in order, by league and season; return them re-read, and their shape.

    The rows are counted as they are written.
    The target must not be a path the rows are read from: Spark would delete its own input.
    """
    target = _qualified(matches.sparkSession, path)
    for root in _input_roots(matches):
        if f"{root}/".startswith(f"{target}/") or f"{target}/".startswith(f"{root}/"):
            raise ValueError(f"{path} is, holds or lies in an input of this dataset ({root}); write to a new path")
    types = matches.schema
    # Sorting samples its input: from the settled rows that costs a read, not the pipeline again.
    written_rows = Observation()
    observed = in_order(settle(complete_rows(matches))).observe(written_rows, F.count(F.lit(1)).alias("rows"))
    writer = observed.write.mode(mode).partitionBy(*LEAGUE)
    if format == "csv":
        writer.option("header", "true").csv(path)
        body = [f for f in types.fields if f.name not in LEAGUE]
        parts = [types[name] for name in LEAGUE]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (*body, *parts))
        written = matches.sparkSession.read.csv(path, header=True, schema=schema)
    else:
        writer.parquet(path)
        written = matches.sparkSession.read.parquet(path)
    return written, (written_rows.get["rows"], len(written.columns))
