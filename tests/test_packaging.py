"""The functions that run in Python workers must be importable there, whatever the working directory."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.addPyFile({archive!r})
from pitchframe.operators.standings import add_table_positions
rows = [("L", "21-22", i, "2021-08-0%d" % (i + 1), "15:00", "A", "B", 1, 0) for i in range(5)]
names = "div_name string, season string, match_seq long, d string, Time string, HomeTeam string, AwayTeam string, FTHG int, FTAG int"
matches = spark.createDataFrame(rows, names).selectExpr("* except (d)", "to_date(d) as Date")
print("rows", add_table_positions(matches).count())
"""


@pytest.mark.skipif(not (ROOT / "pitchframe").exists(), reason="runs from the repository")
def test_works_from_another_folder_with_an_archive(tmp_path):
    archive = shutil.make_archive(str(tmp_path / "pitchframe"), "zip", ROOT, "pitchframe")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(archive=archive)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "rows 5" in done.stdout, done.stderr[-2000:]
