"""PCA with missing values, season outcomes of the resolver, exports in several files, the checkpoint folder."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortrank.operators.aggregates import pca_variance
from cohortrank.operators.joins import resolve_scope
from cohortrank.session import ensure_checkpoint_dir
from cohortrank.sources.files import header_report, read_exports


def test_pca_scales_by_the_filled_column(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    x[:, 2] += x[:, 0]
    x[rng.random(200) < 0.6, 1] = np.nan
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in x]
    got = [r.explained for r in pca_variance(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()]
    full = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    values = np.linalg.eigvalsh(np.corrcoef(full.T))[::-1]
    assert got == pytest.approx((values / values.sum()).tolist(), abs=1e-9)


def test_resolver_season_outcomes(spark):
    cat = spark.createDataFrame([("Germany", "Liga", 7, 1, {"2024": 70})], "area string, name string, id long, cat_ord long, seasons map<string,long>")
    scopes = spark.createDataFrame([("Germany. Liga",), ("Nowhere. None",)], "scope string")
    out = lambda t: {r.scope: (r.competition_id, r.season_id, r.season_status) for r in resolve_scope(scopes, cat, t).collect()}
    assert out("2024")["Germany. Liga"] == (7, 70, "season")
    assert out("1999")["Germany. Liga"] == (None, None, "no season")
    assert out("last_season")["Germany. Liga"] == (7, None, "keyword")
    assert out("2024")["Nowhere. None"] == (None, None, None)


@pytest.mark.parametrize("files", [1, 4, 16])
def test_exports_in_several_files(spark, tmp_path, files):
    spec, base = ["Key", "Player", "Market value"], f"{tmp_path}/2025-2026"
    rows = spark.range(100).select(F.col("id").cast("string").alias("Key"), F.concat(F.lit("P, "), "id").alias("Player"), (F.col("id") * 10).cast("string").alias("Market value"))
    for i, columns in enumerate((spec, spec[::-1], [*spec, "Extra, %"], spec[:2])):
        part = rows.where(F.col("Key").cast("int") % 4 == i).withColumn("Extra, %", F.lit("1"))
        part.select(*[F.col(f"`{c}`") for c in columns]).repartition(files).write.option("header", "true").csv(f"{base}/{i + 1} - [GER] - (L{i})")
    lenient, report = read_exports(spark, str(tmp_path), spec, {"Market value": "double"}, "2025-2026", strict=False)
    got = {r["Key"]: (r["Player"], r["Market value"], r["league"]) for r in lenient.collect()}
    assert got == {str(i): (f"P, {i}", None if i % 4 == 3 else i * 10.0, f"L{i % 4}") for i in range(100)}
    strict, _ = read_exports(spark, str(tmp_path), spec, {"Market value": "double"}, "2025-2026")
    assert strict.count() == 50
    assert {r.folder: r.ok for r in report.collect()}["3 - [GER] - (L2)"] is False


def test_cluster_session_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
