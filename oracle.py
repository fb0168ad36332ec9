"""SQL for DuckDB that states each registered query on its own.

Common parts are written once and put together as CTEs.  The league table is stated
the plain way, every team at every match, to check the chunked one against it.
"""

from __future__ import annotations

from pitchframe.columns import (
    DIFFERENCES,
    FORM_MEASURES,
    MIRRORED,
    OUTCOME_MEASURES,
    RAW_COLUMNS,
    SHORT_FORM_MEASURES,
)

MATCHES = """
o AS (
  SELECT o_orderkey AS k, c_mktsegment AS dv, c_nationkey AS h, o_orderdate AS dt,
         CAST(ROUND(o_totalprice * 100) AS BIGINT) AS c
  FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (
  SELECT k, dv, h, dt, c,
         CAST(c % 5 AS INT) AS hg, CAST((c // 5) % 4 AS INT) AS ag,
         CAST((c // 20) % 4 AS INT) AS hx, CAST((c // 80) % 4 AS INT) AS ax,
         CAST((c // 320) % 9 AS INT) AS hm, CAST((c // 2880) % 9 AS INT) AS am
  FROM o),
matches AS (
  SELECT k AS match_seq, dv AS div_name, CAST(YEAR(dt) AS INT) AS season,
         CAST(dt AS DATE) AS "Date", CONCAT(CAST(12 + k % 8 AS VARCHAR), ':00') AS "Time",
         CONCAT('NATION_', CAST(h AS VARCHAR)) AS "HomeTeam",
         CONCAT('NATION_', CAST((h + 1 + k % 24) % 25 AS VARCHAR)) AS "AwayTeam",
         hg AS "FTHG", ag AS "FTAG",
         CASE WHEN hg > ag THEN 'H' WHEN hg < ag THEN 'A' ELSE 'D' END AS "FTR",
         CAST(hg // 2 AS INT) AS "HTHG", CAST(ag // 2 AS INT) AS "HTAG",
         CASE WHEN hg // 2 > ag // 2 THEN 'H' WHEN hg // 2 < ag // 2 THEN 'A' ELSE 'D' END AS "HTR",
         CASE WHEN c % 97 = 0 THEN NULL ELSE hg + hx + hm END AS "HS", ag + ax + am AS "AS",
         CASE WHEN c % 97 = 0 THEN NULL ELSE hg + hx END AS "HST", ag + ax AS "AST",
         CAST(c % 17 AS INT) AS "HF", CAST(c % 19 AS INT) AS "AF",
         CAST(c % 11 AS INT) AS "HC", CAST(c % 13 AS INT) AS "AC",
         CAST(c % 4 AS INT) AS "HY", CAST(c % 6 AS INT) AS "AY",
         CAST(c % 2 AS INT) AS "HR", CAST(c % 3 AS INT) AS "AR"
  FROM g)"""

ELO = """
elo AS (
  SELECT DISTINCT team, "Date" AS "QueryDate",
         CAST(1000 + (CAST(SUBSTR(team, 8) AS INT) * 37 + DAY("Date") * 11) % 900 AS DOUBLE) AS elo
  FROM (SELECT "HomeTeam" AS team, "Date" FROM matches
        UNION ALL SELECT "AwayTeam", "Date" FROM matches)
  WHERE DAY("Date") % 2 = 0)"""

POINTS = """
points AS (
  SELECT div_name, season, "HomeTeam" AS "Team", 'H' AS venue,
         CASE "FTR" WHEN 'H' THEN 3 WHEN 'D' THEN 1 WHEN 'A' THEN 0 END AS pts FROM matches
  UNION ALL
  SELECT div_name, season, "AwayTeam", 'A',
         CASE "FTR" WHEN 'A' THEN 3 WHEN 'D' THEN 1 WHEN 'H' THEN 0 END FROM matches)"""

STANDINGS = """
numbered AS MATERIALIZED (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY div_name, season ORDER BY "Date", "Time", match_seq) - 1 AS match_no
  FROM matches),
booked AS (
  SELECT div_name, season, match_no, "HomeTeam" AS team, "FTHG" AS gf, "FTAG" AS ga FROM numbered
  UNION ALL SELECT div_name, season, match_no, "AwayTeam", "FTAG", "FTHG" FROM numbered),
teams AS (SELECT DISTINCT div_name, season, team FROM booked),
tables AS (
  SELECT n.div_name, n.season, n.match_no, n."HomeTeam", n."AwayTeam", t.team,
         COALESCE(SUM(CASE WHEN b.gf > b.ga THEN 3 WHEN b.gf = b.ga THEN 1 ELSE 0 END) OVER w, 0) AS pts,
         COALESCE(SUM(b.gf - b.ga) OVER w, 0) AS gd,
         COALESCE(SUM(b.gf) OVER w, 0) AS gf,
         COALESCE(COUNT(b.team) OVER w, 0) AS played
  FROM numbered n
  JOIN teams t ON n.div_name = t.div_name AND n.season = t.season
  LEFT JOIN booked b ON b.div_name = n.div_name AND b.season = n.season
                    AND b.match_no = n.match_no AND b.team = t.team
  WINDOW w AS (PARTITION BY n.div_name, n.season, t.team ORDER BY n.match_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ranked AS MATERIALIZED (
  SELECT div_name, season, match_no, "HomeTeam", "AwayTeam", team,
         CASE WHEN played < 3 THEN 10
              ELSE ROW_NUMBER() OVER (PARTITION BY div_name, season, match_no
                                      ORDER BY pts DESC, gd DESC, gf DESC, team) END AS pos
  FROM tables),
positions AS (
  SELECT div_name, season, match_no,
         CAST(MAX(CASE WHEN team = "HomeTeam" THEN pos END) AS INT) AS "HomeTablePos",
         CAST(MAX(CASE WHEN team = "AwayTeam" THEN pos END) AS INT) AS "AwayTablePos"
  FROM ranked WHERE team = "HomeTeam" OR team = "AwayTeam" GROUP BY div_name, season, match_no),
placed AS (
  SELECT n.*, p."HomeTablePos", p."AwayTablePos", p."AwayTablePos" - p."HomeTablePos" AS "TablePosDiff"
  FROM numbered n
  JOIN positions p ON p.div_name = n.div_name AND p.season = n.season AND p.match_no = n.match_no)"""


def _quoted(names: list[str], prefix: str = "") -> str:
    return ", ".join(f'{prefix}"{n}"' for n in names)


def _team_rows() -> str:
    def side(home: bool) -> str:
        own, other = ("Home", "Away") if home else ("Away", "Home")
        sign = "" if home else "-"
        stats = ", ".join(
            f'"{h if home else a}" AS "{mine}", "{a if home else h}" AS "{theirs}"' for mine, theirs, h, a in MIRRORED
        )
        win, loss = ("H", "A") if home else ("A", "H")
        return f"""
  SELECT div_name, season, match_seq, match_no, "Date", "Time", "{own}Team" AS "Team", "{other}Team" AS "Opponent",
         '{own[0]}' AS "Venue", {sign}"TablePosDiff" AS "TablePosDiff",
         "{own}TablePos" AS "TeamTablePos", "{other}TablePos" AS "OpponentTablePos", {stats},
         CASE "FTR" WHEN '{win}' THEN 'W' WHEN 'D' THEN 'D' WHEN '{loss}' THEN 'L' END AS "Result"
  FROM placed"""

    differences = ", ".join(f'"{a}" - "{b}" AS "{name}"' for name, a, b in DIFFERENCES)
    return f"""
sides AS ({side(True)} UNION ALL {side(False)}),
team_rows AS (
  SELECT *, CASE "Result" WHEN 'W' THEN 3 WHEN 'D' THEN 1 WHEN 'L' THEN 0 END AS "Points", {differences},
         "ShotsOnTarget" / CAST(CASE WHEN "Shots" = 0 THEN 1 ELSE "Shots" END AS DOUBLE) AS "ShotAccuracy",
         CAST(CASE "Result" WHEN 'W' THEN 1 WHEN 'D' THEN 0.5 WHEN 'L' THEN 0 END AS DOUBLE) AS "Win"
  FROM sides)"""


def _rolled_names(measures: list[str], windows: list[int], scopes: list[str]) -> list[tuple[str, str, str]]:
    return [(m, f"w{scope}{n}", f"{m}_Rolling{n}{scope}") for scope in scopes for n in windows for m in measures]


def _rolled(measures: list[str], windows: list[int], scopes: list[str]) -> str:
    means = ", ".join(f'AVG("{m}") OVER {w} AS "{name}"' for m, w, name in _rolled_names(measures, windows, scopes))
    frames = ", ".join(
        f"""w{scope}{n} AS (PARTITION BY div_name, season, "Team"{', "Venue"' if scope == "" else ""}
             ORDER BY "Date", "Time", match_seq ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"""
        for scope in scopes
        for n in windows
    )
    return f"""
rolled AS (SELECT *, {means} FROM team_rows WINDOW {frames})"""


ALL_MEASURES = [*FORM_MEASURES, *OUTCOME_MEASURES]
KEY = "div_name, season, match_seq"
DAY = 'CAST("Date" AS VARCHAR) AS "Date"'


def _round(name: str, source: str | None = None) -> str:
    return f'ROUND({source or chr(34) + name + chr(34)}, 6) + 0.0 AS "{name}"'


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _features(windows: list[int] = [5, 10]) -> list[str]:
    return ["TablePosDiff", *[n for _, _, n in _rolled_names(ALL_MEASURES, windows, ["", "_all"])]]


def _dataset() -> tuple[str, list[str]]:
    """The wide dataset as CTE ``dataset`` and its feature columns."""
    names = [f"{p}{f}" for p in ("Home_", "Away_") for f in _features()]
    picked = ", ".join(f'{t}."{f}" AS "{p}{f}"' for t, p in (("h", "Home_"), ("a", "Away_")) for f in _features())
    sql = f"""
dataset AS (
  SELECT m.div_name, m.season, m.match_seq, m."Date", m."Time", m."HomeTeam", m."AwayTeam", m."FTR", m."FTHG", m."FTAG",
         {picked}
  FROM matches m
  JOIN rolled h ON h.div_name = m.div_name AND h.season = m.season AND h.match_seq = m.match_seq AND h."Venue" = 'H'
  JOIN rolled a ON a.div_name = m.div_name AND a.season = m.season AND a.match_seq = m.match_seq AND a."Venue" = 'A')"""
    return sql, names


def _complete(names: list[str]) -> str:
    return " AND ".join(f'"{n}" IS NOT NULL' for n in names)


def _dataset_output(names: list[str]) -> str:
    values = ", ".join(f'"{n}"' if n.endswith("_TablePosDiff") else _round(n) for n in names)
    return f'SELECT {KEY}, {DAY}, "Time", "HomeTeam", "AwayTeam", "FTR", "FTHG", "FTAG", {values} FROM dataset'


FOLDS = """
places AS (SELECT season, ROW_NUMBER() OVER (ORDER BY MIN("Date"), season) - 1 AS place FROM matches GROUP BY season),
folds AS (
  SELECT CAST(t.place AS INT) AS fold, CASE WHEN s.place = t.place THEN 'test' ELSE 'train' END AS role, s.season
  FROM places t JOIN places s ON s.place <= t.place WHERE t.place > 0)"""

MAJORITY = """
tallies AS (
  SELECT f.fold, f.role, m."FTR" AS label, COUNT(*) AS n
  FROM matches m JOIN folds f ON f.season = m.season GROUP BY ALL),
guess AS (
  SELECT fold, label AS prediction FROM tallies WHERE role = 'train'
  QUALIFY ROW_NUMBER() OVER (PARTITION BY fold ORDER BY n DESC, label) = 1),
pairs AS (
  SELECT t.fold, t.label, g.prediction, t.n FROM tallies t JOIN guess g ON g.fold = t.fold WHERE t.role = 'test')"""

REPORT = """
classes AS (SELECT fold, label AS class FROM pairs UNION SELECT fold, prediction FROM pairs),
counted AS (
  SELECT c.fold, c.class,
         COALESCE(SUM(CASE WHEN p.label = c.class THEN p.n END), 0) AS support,
         COALESCE(SUM(CASE WHEN p.prediction = c.class THEN p.n END), 0) AS said,
         COALESCE(SUM(CASE WHEN p.label = c.class AND p.prediction = c.class THEN p.n END), 0) AS hits
  FROM classes c JOIN pairs p ON p.fold = c.fold GROUP BY c.fold, c.class),
shares AS (
  SELECT *, CASE WHEN said = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / said END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / support END AS recall FROM counted),
scored AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM shares),
report AS (
  SELECT fold, class, precision, recall, f1, support FROM scored
  UNION ALL SELECT fold, 'accuracy', NULL, NULL, CAST(SUM(hits) AS DOUBLE) / SUM(support), SUM(support)
  FROM scored GROUP BY fold
  UNION ALL SELECT fold, 'macro avg', AVG(precision), AVG(recall), AVG(f1), SUM(support) FROM scored GROUP BY fold
  UNION ALL SELECT fold, 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
         SUM(f1 * support) / SUM(support), SUM(support) FROM scored GROUP BY fold)"""


def _rolling_query(measures: list[str], scopes: list[str], windows: list[int]) -> str:
    values = ", ".join(_round(n) for _, _, n in _rolled_names(measures, windows, scopes))
    return (
        _with(MATCHES, STANDINGS, _team_rows(), _rolled(measures, windows, scopes))
        + f'SELECT {KEY}, "Team", "Venue", {values} FROM rolled'
    )


def _gap(by: str) -> str:
    comma = ", " if by else ""
    return (
        _with(MATCHES, POINTS)
        + f"""SELECT {by}{comma}"Team", "Home", "Away", ABS("Home" - "Away") AS "Difference" FROM (
  SELECT {by}{comma}"Team", CAST(COALESCE(SUM(CASE WHEN venue = 'H' THEN pts END), 0) AS BIGINT) AS "Home",
         CAST(COALESCE(SUM(CASE WHEN venue = 'A' THEN pts END), 0) AS BIGINT) AS "Away"
  FROM points GROUP BY {by}{comma}"Team")"""
    )


def _exploratory() -> str:
    """Every match column and every team column of both sides, complete rows only."""
    base = [*RAW_COLUMNS, "HomeTablePos", "AwayTablePos", "TablePosDiff"]
    known = {"Date", "Time", "Team", "Venue"}
    team = ["Opponent", "TablePosDiff", "TeamTablePos", "OpponentTablePos"]
    team += [c for own, other, _, _ in MIRRORED for c in (own, other)] + ["Result", "Points"]
    team += [name for name, _, _ in DIFFERENCES]
    rolled = [n for _, _, n in _rolled_names(SHORT_FORM_MEASURES, [5, 10], ["", "_all"])]
    picked = ", ".join(
        f'{t}."{c}" AS "{p}{c}"' for t, p in (("h", "Home_"), ("a", "Away_")) for c in [*team, *rolled] if c not in known
    )
    plain = [f"{p}{c}" for p in ("Home_", "Away_") for c in team]
    means = [f"{p}{c}" for p in ("Home_", "Away_") for c in rolled]
    shown = _quoted([c for c in base if c != "Date"] + plain)
    return (
        _with(MATCHES, STANDINGS, _team_rows(), _rolled(SHORT_FORM_MEASURES, [5, 10], ["", "_all"]))
        + f"""SELECT {KEY}, {DAY}, {shown}, {", ".join(_round(c) for c in means)} FROM (
  SELECT m.div_name, m.season, m.match_seq, {_quoted(base, "m.")}, {picked}
  FROM placed m
  JOIN rolled h ON h.div_name = m.div_name AND h.season = m.season AND h.match_seq = m.match_seq AND h."Venue" = 'H'
  JOIN rolled a ON a.div_name = m.div_name AND a.season = m.season AND a.match_seq = m.match_seq AND a."Venue" = 'A')
WHERE {_complete([*base, *plain, *means])}"""
    )


def _enriched() -> str:
    return (
        _with(MATCHES, ELO)
        + f"""SELECT {KEY}, CAST(m."Date" AS VARCHAR) AS "Date", "HomeTeam", "AwayTeam", h.elo AS "Home_Elo", a.elo AS "Away_Elo"
FROM matches m
LEFT JOIN elo h ON h.team = m."HomeTeam" AND h."QueryDate" = m."Date"
LEFT JOIN elo a ON a.team = m."AwayTeam" AND a."QueryDate" = m."Date\""""
    )


def _scaled() -> str:
    dataset, names = _dataset()
    stats = ", ".join(
        f'AVG("{n}") AS "mean_{n}", CASE WHEN STDDEV_POP("{n}") = 0 THEN 1 ELSE STDDEV_POP("{n}") END AS "std_{n}"'
        for n in names
    )
    values = ", ".join(_round(n, f'(d."{n}" - s."mean_{n}") / s."std_{n}"') for n in names)
    return (
        _with(
            MATCHES,
            STANDINGS,
            _team_rows(),
            _rolled(ALL_MEASURES, [5, 10], ["", "_all"]),
            dataset,
            f"\ncomplete AS (SELECT * FROM dataset WHERE {_complete(names)})",
            FOLDS.replace("FROM matches", "FROM complete"),
            f"\nstats AS (SELECT f.fold, {stats} FROM complete d JOIN folds f ON f.season = d.season"
            " WHERE f.role = 'train' GROUP BY f.fold)",
        )
        + f"""SELECT f.fold, d.div_name, d.season, d.match_seq, {values}
FROM complete d JOIN folds f ON f.season = d.season AND f.role = 'test' JOIN stats s ON s.fold = f.fold"""
    )


def _one_hot() -> str:
    def known(team: str) -> str:
        return f"""
{team.lower()}s AS (
  SELECT fold, team, ROW_NUMBER() OVER (PARTITION BY fold ORDER BY team) - 1 AS position,
         COUNT(*) OVER (PARTITION BY fold) AS n
  FROM (SELECT DISTINCT f.fold, m."{team}" AS team FROM matches m
        JOIN folds f ON f.season = m.season AND f.role = 'train'))"""

    def ones(team: str, offset: str) -> str:
        return f"""SELECT f.fold, m.div_name, m.season, m.match_seq, CAST(k.position + {offset} AS INT) AS position,
       CONCAT('cat__{team}_', k.team) AS feature
FROM matches m JOIN folds f ON f.season = m.season AND f.role = 'test'
JOIN {team.lower()}s k ON k.fold = f.fold AND k.team = m."{team}\""""

    width = "(SELECT MAX(n) FROM hometeams w WHERE w.fold = f.fold)"
    return (
        _with(MATCHES, FOLDS, known("HomeTeam"), known("AwayTeam"))
        + ones("HomeTeam", "0")
        + "\nUNION ALL\n"
        + ones("AwayTeam", width)
    )


def _by_kick_off() -> str:
    """Every team column of both sides, found by kick-off and name: several matches of a team multiply."""
    team = ["Opponent", "TablePosDiff", *[c for own, other, _, _ in MIRRORED for c in (own, other)], "Result", "Points"]
    team += [name for name, _, _ in DIFFERENCES]
    sides = (("h", "Home"), ("a", "Away"))
    picked = ", ".join(f'{t}."{c}" AS "{side}_{c}"' for t, side in sides for c in team)
    joins = "\n".join(
        f"""LEFT JOIN team_rows {t} ON {t}.div_name = m.div_name AND {t}.season = m.season AND {t}."Date" = m."Date"
  AND {t}."Time" = m."Time" AND {t}."Team" = m."{side}Team" AND {t}."Venue" = '{side[0]}'"""
        for t, side in sides
    )
    base = _quoted([c for c in [*RAW_COLUMNS, "HomeTablePos", "AwayTablePos", "TablePosDiff"] if c != "Date"], "m.")
    return (
        _with(MATCHES, STANDINGS, _team_rows())
        + f"""SELECT m.div_name, m.season, m.match_seq, CAST(m."Date" AS VARCHAR) AS "Date", {base}, {picked}
FROM placed m
{joins}"""
    )


def _typed() -> str:
    """The days, counts and gaps that the texts of ``text_matches`` stand for."""
    return (
        _with(MATCHES)
        + """SELECT div_name, season, match_seq, day AS "Date", home AS "FTHG", away AS "FTAG", shots AS "HS",
       day IS NOT NULL AND home IS NOT NULL AND away IS NOT NULL AS usable
FROM (
  SELECT div_name, season, match_seq,
         CASE WHEN match_seq % 7 = 1 AND YEAR("Date") < 2000 THEN CAST(CAST("Date" + INTERVAL 100 YEAR AS DATE) AS VARCHAR)
              WHEN match_seq % 7 IN (3, 4) THEN NULL ELSE CAST("Date" AS VARCHAR) END AS day,
         CASE WHEN match_seq % 11 = 3 THEN NULL ELSE "FTHG" END AS home, "FTAG" AS away,
         CASE WHEN match_seq % 5 = 2 THEN NULL ELSE "HS" END AS shots
  FROM matches)"""
    )


HOLDOUT = """
parted AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY season, "Date", "Time", match_seq, div_name) <= FLOOR(COUNT(*) OVER () * 0.8) AS train
  FROM complete)"""


def _studies() -> dict[str, str]:
    """What holds for the model studies whatever the fitted trees or weights are."""
    dataset, names = _dataset()
    complete = f"\ncomplete AS (SELECT * FROM dataset WHERE {_complete(names)})"
    base = [MATCHES, STANDINGS, _team_rows(), _rolled(ALL_MEASURES, [5, 10], ["", "_all"]), dataset, complete]
    walk = (
        _with(*base, FOLDS.replace("FROM matches", "FROM complete"))
        + """SELECT f.fold, d."FTR" AS class, COUNT(*) AS support, true AS in_range
FROM complete d JOIN folds f ON f.season = d.season AND f.role = 'test' GROUP BY f.fold, d."FTR\""""
    )
    held = (
        _with(*base, HOLDOUT)
        + 'SELECT "FTR" AS class, COUNT(*) AS support, true AS in_range FROM parted WHERE NOT train GROUP BY "FTR"'
    )
    share = 'ROUND(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (), 2)'
    teams = " UNION ALL ".join(
        f"SELECT DISTINCT CONCAT('cat__{label}_', CAST({source} AS VARCHAR)) FROM parted WHERE train"
        for label, source in (("HomeTeam", '"HomeTeam"'), ("AwayTeam", '"AwayTeam"'), ("season_label", "season"))
    )
    numbers = ", ".join(f"'num__{n}'" for n in names)
    return {
        "walk_forward_lr_support": walk,
        "walk_forward_rf_support": walk,
        "holdout_gbt_support": held,
        "holdout_mlp_support": held,
        "holdout_lr_calibration": _with(*base, HOLDOUT)
        + f"""SELECT "FTR" AS class, COUNT(*) AS rows, {share} AS share, {share} AS probability
FROM parted WHERE train GROUP BY "FTR\"""",
        "feature_importance_names": _with(*base, HOLDOUT)
        + f'SELECT "Feature", 1.0::DOUBLE AS total FROM (SELECT UNNEST([{numbers}]) AS "Feature" UNION ALL {teams})',
    }


def statements() -> dict[str, str]:
    form = [STANDINGS, _team_rows()]
    everything = _rolled(ALL_MEASURES, [5, 10], ["", "_all"])
    dataset, names = _dataset()
    wide = _with(MATCHES, *form, everything, dataset)
    team_columns = ["Team", "Opponent", "Venue", "TablePosDiff"]
    stats = [c for own, other, _, _ in MIRRORED for c in (own, other)]
    tail = [*stats, "Result", "Points", *[name for name, _, _ in DIFFERENCES]]
    raw = _quoted([c for c in RAW_COLUMNS if c != "Date"])
    return _studies() | {
        "typed_matches": _typed(),
        "dataset_by_kick_off": _by_kick_off(),
        "derived_matches": _with(MATCHES) + f"SELECT {KEY}, {DAY}, {raw} FROM matches",
        "season_files": _with(MATCHES)
        + f"SELECT div_name, CAST(season AS VARCHAR) AS season, match_seq, {DAY}, {raw} FROM matches",
        "derived_elo": _with(MATCHES, ELO)
        + 'SELECT team, CAST("QueryDate" AS VARCHAR) AS "QueryDate", elo FROM elo',
        "goal_histogram": _with(MATCHES)
        + """SELECT CAST(g.goals AS INT) AS goals, COUNT(*) FILTER (WHERE side = 'H') AS home_matches,
       COUNT(*) FILTER (WHERE side = 'A') AS away_matches
FROM (SELECT UNNEST(RANGE(0, (SELECT GREATEST(MAX("FTHG"), MAX("FTAG")) + 1 FROM matches))) AS goals) g
LEFT JOIN (SELECT 'H' AS side, "FTHG" AS n FROM matches UNION ALL SELECT 'A', "FTAG" FROM matches) s
  ON s.n = g.goals GROUP BY g.goals""",
        "points_gap_season": _gap("div_name, season"),
        "points_gap": _gap(""),
        "home_away_ppg": _with(MATCHES, POINTS)
        + f"""SELECT h."Team", "HomePoints", "HomeGames", "AwayPoints", "AwayGames",
       {_round("HomePPG", '"HomePoints" / CAST("HomeGames" AS DOUBLE)')},
       {_round("AwayPPG", '"AwayPoints" / CAST("AwayGames" AS DOUBLE)')},
       {_round("HomeAwayDifference", '"HomePoints" / CAST("HomeGames" AS DOUBLE) - "AwayPoints" / CAST("AwayGames" AS DOUBLE)')}
FROM (SELECT "Team", CAST(SUM(pts) AS BIGINT) AS "HomePoints", COUNT(*) AS "HomeGames"
      FROM points WHERE venue = 'H' GROUP BY 1) h
LEFT JOIN (SELECT "Team", CAST(SUM(pts) AS BIGINT) AS "AwayPoints", COUNT(*) AS "AwayGames"
           FROM points WHERE venue = 'A' GROUP BY 1) a ON a."Team" = h."Team\"""",
        "outcome_shares": _with(MATCHES)
        + f"""SELECT "FTR", COUNT(*) AS matches, {_round("share", "COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE)")}
FROM matches WHERE "FTR" IS NOT NULL GROUP BY "FTR\"""",
        "ppg_ranking": _with(MATCHES, POINTS)
        + f"""SELECT "Team", CAST(SUM(pts) AS BIGINT) AS "TotalPoints", COUNT(pts) AS "Games",
       {_round("PPG", "SUM(pts) / CAST(COUNT(pts) AS DOUBLE)")} FROM points GROUP BY "Team\"""",
        "feature_pairs": wide
        + f"SELECT {_round('Home_TablePosDiff_Rolling5')}, {_round('Home_Corners_Rolling5')} FROM dataset",
        "standings_before_match": _with(MATCHES, STANDINGS)
        + f'SELECT {KEY}, "HomeTeam", "AwayTeam", match_no, "HomeTablePos", "AwayTablePos", "TablePosDiff" FROM placed',
        "team_rows": _with(MATCHES, *form)
        + f'SELECT {KEY}, {DAY}, "Time", {_quoted([*team_columns, *tail])} FROM team_rows',
        "team_rows_positions": _with(MATCHES, *form)
        + f'SELECT {KEY}, {DAY}, "Time", {_quoted([*team_columns, "TeamTablePos", "OpponentTablePos", *tail])} FROM team_rows',
        "rolling_venue_5": _rolling_query(FORM_MEASURES, [""], [5]),
        "rolling_venue_10": _rolling_query(FORM_MEASURES, [""], [10]),
        "rolling_all_5": _rolling_query(FORM_MEASURES, ["_all"], [5]),
        "rolling_all_10": _rolling_query(FORM_MEASURES, ["_all"], [10]),
        "rolling_points_win": _rolling_query(OUTCOME_MEASURES, ["", "_all"], [5, 10]),
        "match_dataset": wide + _dataset_output(names),
        "match_dataset_complete": wide + _dataset_output(names) + f" WHERE {_complete(names)}",
        "exploratory_dataset": _exploratory(),
        "elo_enriched": _enriched(),
        "elo_in_place": _enriched(),
        "chrono_split": _with(MATCHES)
        + f"""SELECT {KEY}, {DAY}, "Time",
       CASE WHEN ROW_NUMBER() OVER (ORDER BY season, "Date", "Time", match_seq) <= FLOOR(COUNT(*) OVER () * 0.8)
            THEN 'train' ELSE 'test' END AS split FROM matches""",
        "walk_forward_folds": _with(MATCHES, FOLDS) + "SELECT fold, role, season FROM folds",
        "walk_forward_rows": _with(MATCHES, FOLDS)
        + "SELECT m.div_name, m.season, m.match_seq, f.fold, f.role FROM matches m JOIN folds f ON f.season = m.season",
        "scaled_features": _scaled(),
        "one_hot_teams": _one_hot(),
        "label_codes": _with(MATCHES)
        + f"SELECT {KEY}, \"FTR\", CASE \"FTR\" WHEN 'A' THEN 0 WHEN 'D' THEN 1 WHEN 'H' THEN 2 END AS label FROM matches",
        "class_weights": _with(MATCHES)
        + f"""SELECT "FTR", {_round("weight", "SUM(COUNT(*)) OVER () / CAST(COUNT(*) OVER () * COUNT(*) AS DOUBLE)")}
FROM matches GROUP BY "FTR\"""",
        "majority_baseline_report": _with(MATCHES, FOLDS, MAJORITY, REPORT)
        + f"SELECT fold, class, {_round('precision')}, {_round('recall')}, {_round('f1')}, CAST(support AS BIGINT) AS support FROM report",
        "majority_baseline_accuracy": _with(MATCHES, FOLDS, MAJORITY)
        + f"""SELECT fold, {_round("accuracy", "SUM(CASE WHEN label = prediction THEN n ELSE 0 END) / CAST(SUM(n) AS DOUBLE)")}
FROM pairs GROUP BY fold""",
    }
