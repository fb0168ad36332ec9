import os

import pytest
from pyspark.sql import functions as F

from pitchframe.columns import RAW_COLUMNS
from pitchframe.operators.elo import join_elo, repeated_ratings
from pitchframe.operators.standings import add_table_positions
from pitchframe.plans.dataset import match_dataset
from pitchframe.sources import matches as M
from pitchframe.sources import versions as V
from test_standings import league


def write_season(path, rows, columns):
    lines = [",".join(columns)]
    for r in rows:
        lines.append(",".join(str(r.get(c, 1)) for c in columns))
    path.write_text("\n".join(lines) + "\n")


@pytest.fixture()
def season_files(tmp_path):
    """Two seasons whose columns differ in order and number."""
    base = {"Time": "20:00", "FTR": "H", "HTR": "D", "FTHG": 2, "FTAG": 0, "Div": "E0"}
    first = [{**base, "Date": "14/08/2021", "HomeTeam": "A", "AwayTeam": "B", "HS": 7}]
    second = [
        {**base, "Date": "05/08/22", "HomeTeam": "C", "AwayTeam": "A", "HS": 8, "B365H": 1.5},
        {**base, "Date": "06/08/22", "HomeTeam": "B", "AwayTeam": "C", "HS": "", "FTHG": ""},
    ]
    write_season(tmp_path / "pl21-22.csv", first, ["Div", *RAW_COLUMNS, "B365H"])
    write_season(tmp_path / "pl22-23.csv", second, ["Div", "B365H", *reversed(RAW_COLUMNS)])
    return tmp_path


def test_reads_seasons_with_other_headers(spark, season_files):
    paths = [str(season_files / f"pl{s}.csv") for s in ("21-22", "22-23")]
    got = M.read_matches(spark, paths).orderBy("match_seq").collect()
    assert [(r["season"], str(r["Date"]), r["HomeTeam"], r["HS"]) for r in got] == [
        ("21-22", "2021-08-14", "A", 7),
        ("22-23", "2022-08-05", "C", 8),
        ("22-23", "2022-08-06", "B", None),
    ]
    assert {r["div_name"] for r in got} == {"E0"} and got[0]["Time"] == "20:00"
    assert M.read_matches(spark, paths[0]).count() == 1
    assert M.read_matches(spark, str(season_files)).count() == 3
    usable, rejected = M.split_unscored(M.read_matches(spark, paths))
    assert (usable.count(), rejected.count()) == (2, 1)


def test_missing_column_raises(spark, tmp_path):
    write_season(tmp_path / "21-22.csv", [{}], [c for c in RAW_COLUMNS if c != "HST"])
    with pytest.raises(ValueError, match="HST"):
        M.read_matches(spark, str(tmp_path))


def test_staged_table_prunes_seasons(spark, season_files, tmp_path):
    path = str(tmp_path / "staged")
    M.write_matches(M.read_matches(spark, str(season_files)), path)
    one = M.read_staged(spark, path, ["22-23"])
    assert one.count() == 2
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "season" in filters.split("PartitionFilters")[1].split("PushedFilters")[0]


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_export_drops_incomplete_rows_and_reports_shape(spark, make_matches, tmp_path, format):
    wide = match_dataset(make_matches(league(11, 60, 4, 60)))
    path = str(tmp_path / "out")
    written, shape = M.export_dataset(wide, path, format)
    complete = wide.dropna().count()
    assert shape == (complete, 148) and written.count() == complete > 0
    assert written.schema["Home_Points_Rolling5"].dataType.simpleString() == "double"
    with pytest.raises(ValueError, match="input"):
        M.export_dataset(written, path, format, mode="overwrite")
    assert written.count() == complete


def test_exported_csv_reads_back_whole(spark, make_matches, tmp_path):
    wide = match_dataset(make_matches(league(11, 60, 4, 60)).unionByName(make_matches(league(12, 60, 4, 60), season="22-23")))
    path = str(tmp_path / "csv")
    written, _ = M.export_dataset(wide, path, "csv")
    back = M.read_dataset_csv(spark, path)
    keys = ["div_name", "season", "match_seq", "HomeTeam", "Home_Points_Rolling5"]
    assert sorted(map(tuple, back.select(*keys).collect())) == sorted(map(tuple, written.select(*keys).collect()))
    assert {r["season"] for r in back.select("season").distinct().collect()} == {"21-22", "22-23"}


def test_export_refuses_its_input_however_it_is_spelt(spark, make_matches, tmp_path, monkeypatch):
    path = str(tmp_path / "pq")
    M.export_dataset(match_dataset(make_matches(league(11, 60, 4, 60))), path)
    source = spark.read.parquet(path)
    relative = os.path.relpath(path, os.getcwd())
    for spelling in (relative, f"./{relative}", f"{tmp_path}/other/../pq", f"file:{path}/div_name=L", str(tmp_path)):
        with pytest.raises(ValueError, match="input"):
            M.export_dataset(source, spelling, mode="overwrite")
    M.export_dataset(source, f"{path}-2")


@pytest.mark.parametrize("name", ["matches.csv", "part-00000-12.csv", "pl121-22.csv"])
def test_unknown_season_raises(spark, tmp_path, name):
    write_season(tmp_path / name, [{"HomeTeam": "A"}], RAW_COLUMNS)
    with pytest.raises(Exception, match="no season"):
        M.read_matches(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("key", ["div_name", "season", "match_seq"])
def test_rows_without_keys_do_not_vanish(spark, make_matches, key):
    whole = make_matches(league(11, 60, 4, 60))
    holed = whole.withColumn(key, F.when(F.col("HomeTeam") != F.lit("t00"), F.col(key)))
    usable, rejected = M.split_unscored(holed)
    assert usable.count() + rejected.count() == whole.count() and rejected.count() > 0
    assert add_table_positions(usable).count() == usable.count()
    with pytest.raises(Exception, match=f"{key} is NULL"):
        add_table_positions(holed).collect()


def test_processed_csv_is_typed(spark, tmp_path):
    columns = ["Date", "Time", "HomeTeam", "AwayTeam", "FTR", "FTHG", "FTAG", "Home_Points_Rolling5"]
    row = {"Date": "2021-09-01", "Time": "15:00", "HomeTeam": "A", "AwayTeam": "B", "FTR": "D", "Home_Points_Rolling5": 1.5}
    write_season(tmp_path / "21-22.csv", [row], columns)
    got = M.read_dataset_csv(spark, str(tmp_path)).first()
    assert (got["season"], str(got["Date"]), got["FTHG"], got["Home_Points_Rolling5"]) == ("21-22", "2021-09-01", 1, 1.5)


def test_elo_keeps_matches_and_can_run_again(spark, make_matches, tmp_path):
    matches = make_matches([(1, "2021-08-01", "15:00", "A", "B", 1, 0), (2, "2021-08-02", "15:00", "B", "A", 1, 0)])
    (tmp_path / "elo.csv").write_text("team,QueryDate,elo,rank\nA,2021-08-01,1500.5,1\nB,2021-08-02,1400,2\n")
    elo = M.read_elo(spark, str(tmp_path / "elo.csv"))
    once = join_elo(matches, elo)
    for rated in (once, join_elo(once, elo)):
        got = rated.orderBy("match_seq").select("Home_Elo", "Away_Elo").collect()
        assert [tuple(r) for r in got] == [(1500.5, None), (1400.0, None)]
    assert repeated_ratings(elo).count() == 0
    twice = elo.unionByName(elo.withColumn("elo", F.lit(1.0)))
    assert repeated_ratings(twice).count() == 2
    with pytest.raises(Exception, match="several ratings of"):
        join_elo(matches, twice).collect()
    # A count needs no ratings, and repeated ones do not multiply it.
    assert join_elo(matches, twice).count() == 2


def test_awkward_files_are_read(spark, tmp_path):
    """A mark at the start, rows of other lengths, quotes, another encoding, a blank line and an empty file."""
    columns = ",".join(RAW_COLUMNS)
    row = ["14/08/2021", "20:00", "A", "B", "2", "0", "H", "1", "0", "H", *["1"] * 12]
    (tmp_path / "20-21.csv").write_bytes(b"\xef\xbb\xbf" + f"{columns}\n{','.join(row)}\n\n".encode())
    short, long_row = row[:10], [*row, "x", "y"]
    (tmp_path / "21-22.csv").write_text("\n".join([columns, ",".join(short), ",".join(long_row)]) + "\n")
    quoted = ['"A, the ""first"""' if v == "A" else v for v in row]
    (tmp_path / "22-23.csv").write_text("\r\n".join([columns, ",".join(quoted)]))
    (tmp_path / "23-24.csv").write_bytes(f"{columns}\n".encode() + ",".join(["Köln" if v == "A" else v for v in row]).encode("latin-1"))
    got = M.read_matches(spark, str(tmp_path)).orderBy("season", "match_seq").collect()
    assert [(r["season"], r["HomeTeam"], r["HS"]) for r in got] == [
        ("20-21", "A", 1), ("21-22", "A", None), ("21-22", "A", 1), ("22-23", 'A, the "first"', 1), ("23-24", "K\ufffdln", 1),
    ]
    (tmp_path / "24-25.csv").write_text(columns.replace("HST,", "") + "\n")
    with pytest.raises(Exception, match="missing columns.*HST"):
        M.read_matches(spark, str(tmp_path)).collect()


def test_season_files_are_scanned_once(spark, season_files):
    plan = M.read_matches(spark, str(season_files))._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.splitlines() if "binaryFile" in line]
    assert sum("content" in line for line in reads) == 1 and "Scan csv" not in plan and "Scan text" not in plan


def test_replaced_from_itself(spark, tmp_path):
    path = str(tmp_path / "set")
    with pytest.raises(ValueError, match="no committed version"):
        V.read_version(spark, path)
    assert V.write_version(spark.range(5), path) == 1
    old = V.read_version(spark, path)
    new = V.replace_dataset(spark, path, lambda d: d.withColumn("id", F.col("id") * 10))
    assert sorted(r[0] for r in new.collect()) == [0, 10, 20, 30, 40]
    # Whoever began to read the old version can end.
    assert sorted(r[0] for r in old.collect()) == [0, 1, 2, 3, 4]


def test_a_failed_run_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "set")
    V.write_version(spark.range(3), path)
    with pytest.raises(Exception, match="broken off"):
        V.replace_dataset(spark, path, lambda d: d.withColumn("x", F.when(F.col("id") == 2, F.raise_error(F.lit("broken off")))))
    assert V.current_version(spark, path) == 1 and V.read_version(spark, path).count() == 3
    assert V.write_version(spark.range(4), path) == 3
    assert V.expire_versions(spark, path, keep=1) == [1, 2]
    assert V.read_version(spark, path).count() == 4
    with pytest.raises(ValueError, match="no committed version 1"):
        V.read_version(spark, path, 1)


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "set")
    V.write_version(spark.range(3), path)
    monkeypatch.setattr(V, "_versions", lambda spark, path: ([], []))
    with pytest.raises(Exception, match="(?i)exist"):
        V.write_version(spark.range(9), path)
