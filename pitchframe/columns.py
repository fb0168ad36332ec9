"""Column names and types shared by every module.

Match frames keep the column names of the season files (``HomeTeam``, ``FTHG``,
...), so a query written against those files keeps working.  Three key columns
are added: ``div_name`` and ``season`` name the league table a match counts for,
``match_seq`` is its row number in the source and breaks ties in the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

LEAGUE = ["div_name", "season"]
MATCH_KEY = [*LEAGUE, "match_seq"]

# The columns a season file must have, in file order.
RAW_COLUMNS = [
    "Date", "Time", "HomeTeam", "AwayTeam",
    "FTHG", "FTAG", "FTR", "HTHG", "HTAG", "HTR",
    "HS", "AS", "HST", "AST", "HF", "AF",
    "HC", "AC", "HY", "AY", "HR", "AR",
]
# Those of them that hold text.
TEXT_COLUMNS = ["Time", "HomeTeam", "AwayTeam", "FTR", "HTR"]
COUNT_COLUMNS = [c for c in RAW_COLUMNS if c not in TEXT_COLUMNS and c != "Date"]

# Fixed values: (own measure, opponent's measure, home column, away column).
MIRRORED = [
    ("GoalsFor", "GoalsAgainst", "FTHG", "FTAG"),
    ("HTGoalsFor", "HTGoalsAgainst", "HTHG", "HTAG"),
    ("Shots", "ShotsAgainst", "HS", "AS"),
    ("ShotsOnTarget", "ShotsOnTargetAgainst", "HST", "AST"),
    ("Corners", "CornersAgainst", "HC", "AC"),
    ("Fouls", "FoulsAgainst", "HF", "AF"),
    ("YellowCards", "YellowCardsAgainst", "HY", "AY"),
    ("RedCards", "RedCardsAgainst", "HR", "AR"),
]

# Fixed values: (difference, minuend, subtrahend).  Fouls count the other way round.
DIFFERENCES = [
    ("GoalDifference", "GoalsFor", "GoalsAgainst"),
    ("ShotDifference", "Shots", "ShotsAgainst"),
    ("ShotOnTargetDifference", "ShotsOnTarget", "ShotsOnTargetAgainst"),
    ("CornerDifference", "Corners", "CornersAgainst"),
    ("FoulDifference", "FoulsAgainst", "Fouls"),
]

# The measures that get rolling means, in output order.
FORM_MEASURES = [
    "TablePosDiff",
    "GoalsFor", "GoalsAgainst", "GoalDifference",
    "Shots", "ShotsAgainst", "ShotDifference",
    "ShotsOnTarget", "ShotsOnTargetAgainst", "ShotOnTargetDifference",
    "ShotAccuracy",
    "Corners", "CornerDifference",
    "Fouls", "FoulDifference",
]
# Further measures with rolling means.
OUTCOME_MEASURES = ["Points", "Win"]
# The shorter list of the exploratory variant.
SHORT_FORM_MEASURES = ["TablePosDiff", "GoalsFor", "Shots", "ShotsOnTarget", "Corners", "Fouls"]
# Matches looked back on.
WINDOWS = [5, 10]

# The match columns of the dataset, in output order.
MATCH_COLUMNS = ["Date", "Time", "HomeTeam", "AwayTeam", "FTR", "FTHG", "FTAG"]
# What is known only after the match, or is no feature.
LEAK_COLUMNS = ["Date", "Time", "FTR", "FTHG", "FTAG"]


def require_columns(df: DataFrame, needed: list[str], hint: str = "") -> None:
    """Raise ``ValueError`` when ``df`` lacks one of ``needed``."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}. {hint}".strip())


def columns_like(df: DataFrame, part: str) -> list[str]:
    """Columns whose name contains ``part``, each once, in frame order."""
    return list(dict.fromkeys(c for c in df.columns if part in c))
