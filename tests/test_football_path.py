"""End to end with football names: CSV exports -> contract scan -> roles -> score."""

import csv
import os
import random
import tempfile

from pyspark.sql import functions as F

from cohortrank.functions.roles import assign_role
from cohortrank.plans.score import score, shortlist
from cohortrank.sources.files import read_exports
from cohortrank.spec import FOOTBALL_SPEC, ROLE_OF_POSITION


def test_football_exports_score(spark):
    metrics = FOOTBALL_SPEC.metrics()
    header = ["Player", "Team", "Position", "Age", "Minutes played", "Market value"] + metrics
    root = tempfile.mkdtemp(prefix="cohortrank-football-")
    rnd = random.Random(1)
    positions = list(ROLE_OF_POSITION) + ["XX", ""]
    for folder in ["1 - [GER] - (2. Bundesliga)", "2 - [FRA] - (Ligue 2)"]:
        d = os.path.join(root, "2025-2026", folder)
        os.makedirs(d)
        with open(os.path.join(d, folder + ".csv"), "w", newline="", encoding="utf-8-sig") as fh:
            w = csv.writer(fh)
            w.writerow(header)
            for i in range(120):
                pos = rnd.choice(positions)
                w.writerow([f"P{i}", f"Club {i % 9}", (pos + ", CF") if pos else "", 17 + i % 18,
                            rnd.choice([300, 650, 900, 1500, 2500]), rnd.choice([0, 100000, 2500000])]
                           + [round(rnd.random() * 10, 2) if rnd.random() > 0.05 else "" for _ in metrics])
    types = {c: "double" for c in header if c not in ("Player", "Team", "Position")}
    df, report = read_exports(spark, root, header, types, season="2025-2026")
    assert report.where(~F.col("ok")).count() == 0
    players = (df.withColumn("player_id", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
                 .withColumn("role", assign_role(F.col("Position"), ROLE_OF_POSITION))
                 .withColumnRenamed("Minutes played", "minutes").withColumnRenamed("Market value", "market_value")
                 .withColumnRenamed("Age", "age").withColumnRenamed("Player", "player")
                 .withColumnRenamed("Team", "club_season"))
    assert players.select("player_id").distinct().count() == 240
    lm = spark.createDataFrame([("1 - [GER] - (2. Bundesliga)", "GER_22B", 60.0, "green", 1),
                                ("2 - [FRA] - (Ligue 2)", "FRA_LIGUE", None, "green", 1)],
                               "folder string, league_code string, strength double, priority string, priority_rank int")
    s = score(players, lm, FOOTBALL_SPEC, key="folder")
    rows = s.collect()
    assert rows and all(0 <= r["perf_league"] <= 100 for r in rows)
    assert all((r["perf_adjusted"] is None) == (r["league_code"] == "FRA_LIGUE") for r in rows)
    assert {r["role"] for r in rows} <= set(FOOTBALL_SPEC.role_metrics)
    # each player's percentile map holds exactly its role's metrics
    for r in rows[:20]:
        assert set(r["pct_map"]) == set(FOOTBALL_SPEC.role_metrics[r["role"]])
    top = shortlist(s, role="CF", top=5).collect()
    assert len(top) <= 5
