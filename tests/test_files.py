"""File sources on a CSV tree written to a fresh temporary folder."""

import csv
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortrank.plans.verify import expected_counts
from cohortrank.sources import files as S

SPEC = ["Player", "Team", "Age", "Market value", "Passes, %", "Aerial duels per 90", "Aerial duels per 90.1"]
HEADER = ["Player", "Team", "Age", "Market value", "Passes, %", "Aerial duels per 90", "Aerial duels per 90"]


def _write(path, header, rows, bom=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as fh:
        w = csv.writer(fh)
        w.writerow(header)
        w.writerows(rows)


@pytest.fixture(scope="module")
def tree():
    root = tempfile.mkdtemp(prefix="cohortrank-exports-")
    season = os.path.join(root, "2025-2026")
    good = [["A. One", "Club A", "21", "1000000", "81.5", "2.1", "2.1"],
            ["B. Two", "Club A", "25", "0", "NA", "1.0", "1.0"],
            ["C. Three", "", "19", "10d", "70", "0.5", "0.5"]]
    _write(os.path.join(season, "1 - [GER] - (2. Bundesliga)", "1 - [GER] - (2. Bundesliga).csv"), HEADER, good, bom=True)
    open(os.path.join(season, "1 - [GER] - (2. Bundesliga)", "3.txt"), "w").close()
    # reordered header: must be read by name, not by position
    order = [3, 0, 1, 2, 4, 5, 6]
    _write(os.path.join(season, "2 - [FRA] - (Ligue 2)", "x.csv"), [HEADER[i] for i in order],
           [[r[i] for i in order] for r in good[:2]])
    open(os.path.join(season, "2 - [FRA] - (Ligue 2)", "5.txt"), "w").close()
    # missing column
    _write(os.path.join(season, "3 - [ESP] - (Primera)", "y.csv"), HEADER[:2] + HEADER[3:], [good[0][:2] + good[0][3:]])
    open(os.path.join(season, "3 - [ESP] - (Primera)", "SIZE.txt"), "w").close()
    # extra column whose name holds a comma
    _write(os.path.join(season, "4 - [POR] - (Liga 3)", "z.csv"), HEADER + ["Extra, %"], [good[0] + ["1"]])
    for n in ("4.txt", "old_7.txt"):
        open(os.path.join(season, "4 - [POR] - (Liga 3)", n), "w").close()
    # a folder with a note only
    os.makedirs(os.path.join(season, "5 - [RSA] - (Premier)"))
    open(os.path.join(season, "5 - [RSA] - (Premier)", "Note.txt"), "w").close()
    return root


def test_line_breaks_in_quoted_cells(spark, tmp_path):
    rows = [["A. One", "Club\nA", "21", "5", "81.5", "2.1", "2.1"], ["B. Two", "Club B", "25", "0", "70", "1", "1"]]
    _write(str(tmp_path / "2025-2026" / "1 - [GER] - (2. Bundesliga)" / "x.csv"), HEADER, rows)
    for strict in (True, False):
        df, _ = S.read_exports(spark, str(tmp_path), SPEC, season="2025-2026", strict=strict)
        assert sorted((r["Player"], r["Team"], r["Age"]) for r in df.collect()) == [("A. One", "Club\nA", "21"), ("B. Two", "Club B", "25")]


def test_header_report(spark, tree):
    rep = {r["folder"]: r for r in S.header_report(spark, tree, SPEC).collect()}
    assert set(rep) == {"1 - [GER] - (2. Bundesliga)", "2 - [FRA] - (Ligue 2)", "3 - [ESP] - (Primera)",
                        "4 - [POR] - (Liga 3)"}
    assert rep["1 - [GER] - (2. Bundesliga)"]["ok"] and rep["2 - [FRA] - (Ligue 2)"]["ok"]
    assert rep["3 - [ESP] - (Primera)"]["missing"] == ["Age"]
    assert rep["4 - [POR] - (Liga 3)"]["extra"] == ["Extra, %"]


def test_read_exports_strict_and_lenient(spark, tree):
    types = {"Age": "double", "Market value": "double", "Passes, %": "double",
             "Aerial duels per 90": "double", "Aerial duels per 90.1": "double"}
    df, _ = S.read_exports(spark, tree, SPEC, types, season="2025-2026", strict=True)
    rows = df.collect()
    assert len(rows) == 5
    fra = [r for r in rows if r["country"] == "FRA"]
    assert {r["Player"] for r in fra} == {"A. One", "B. Two"} and {r["Market value"] for r in fra} == {1e6, 0.0}
    ger = {r["Player"]: r for r in rows if r["country"] == "GER"}
    assert ger["B. Two"]["Passes, %"] is None and ger["C. Three"]["Market value"] is None
    assert ger["A. One"]["league"] == "2. Bundesliga" and ger["A. One"]["season"] == "2025-2026"
    lenient, _ = S.read_exports(spark, tree, SPEC, types, season="2025-2026", strict=False)
    esp = [r for r in lenient.collect() if r["country"] == "ESP"]
    assert len(esp) == 1 and esp[0]["Age"] is None and esp[0]["Team"] == "Club A"


def test_missing_exports_and_expected_counts(spark, tree):
    rep = S.header_report(spark, tree, SPEC)
    reg = spark.createDataFrame([(f,) for f in ["1 - [GER] - (2. Bundesliga)", "5 - [RSA] - (Premier)"]], "folder string")
    assert [r["folder"] for r in S.missing_exports(reg, rep).collect()] == ["5 - [RSA] - (Premier)"]
    exp = {r["folder"]: r for r in expected_counts(S.file_listing(spark, tree)).collect()}
    assert exp["1 - [GER] - (2. Bundesliga)"]["expected"] == 3
    assert exp["3 - [ESP] - (Primera)"]["reason"] == "no numbered .txt (found SIZE.txt)"
    assert exp["4 - [POR] - (Liga 3)"]["reason"].startswith("several numbered .txt: 4.txt, old_7.txt")


def test_read_table_and_write_merged(spark, tree):
    d = tempfile.mkdtemp(prefix="cohortrank-tsv-")
    p = os.path.join(d, "t.tsv")
    with open(p, "w") as fh:
        fh.write("a\tb\n1\tx\n2\ty\n")
    t = S.read_table(spark, p)
    assert t.columns == ["a", "b"] and t.count() == 2
    out = os.path.join(tempfile.mkdtemp(prefix="cohortrank-merged-"), "m")
    df = spark.createDataFrame([("2025-2026", "GER_2B", 1), ("2025-2026", "FRA_L2", 2)], "season string, league_code string, v int")
    S.write_merged(df, out)
    back = spark.read.parquet(out)
    assert sorted(r["league_code"] for r in back.collect()) == ["FRA_L2", "GER_2B"]


def test_part_schema_check(spark, tree):
    rep = S.header_report(spark, tree, SPEC)
    assert S.part_schema_check(rep).count() == 0


def test_load_league_map(spark):
    d = tempfile.mkdtemp(prefix="cohortrank-lm-[x]-")
    p = os.path.join(d, "league_map.csv")
    with open(p, "w", encoding="utf-8-sig") as fh:
        fh.write("league_code,folder,country,league,priority,priority_rank,division,strength,strength_source,"
                 "latest_season,n_teams,n_players,groups,calendar,notes\n")
        fh.write("GER_22B,1 - [GER] - (2. Bundesliga),GER,2. Bundesliga,green,1,2,51.3,x,2025-2026,18,538,,autumn-spring,\n")
        fh.write("RSA_PD,60 - [RSA] - (Premier Division),RSA,Premier Division,red,3,1,,MISSING,2025-2026,0,0,,autumn-spring,no CSV\n")
    lm, missing = S.load_league_map(spark, p)
    assert lm.count() == 2 and missing.first()["n_without_strength"] == 1
    assert lm.where(F.col("league_code") == "GER_22B").first()["strength"] == 51.3


def test_season_predicate(spark):
    df = spark.createDataFrame([("2025-2026",), ("old",), ("2025-26",)], "s string")
    assert [r["s"] for r in df.where(S.valid_season(F.col("s"))).collect()] == ["2025-2026"]
