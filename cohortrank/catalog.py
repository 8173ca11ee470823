"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver tables (through the fixture binding) and runs
an operator or pipeline over the whole tables. Column names equal those of
the matching SQL in ``cohortrank.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import league as L
from .plans import score as S
from .sources import fixtures as fx

SCORE_COLS = ["player_id", "player", "role", "league_code", "cell", "thin", "minutes", "market_value",
              "priced", "raw", "evidence", "perf_league", "perf_adjusted", "rank_in_league", "rank_overall"]
LEAGUE_MAP_COLS = ["league_key", "league_code", "folder", "country", "league", "priority", "priority_rank",
                   "division", "strength", "strength_source", "latest_season", "n_teams", "n_players",
                   "groups", "calendar", "notes"]


def league_map(spark: SparkSession, sf: str, players: DataFrame | None = None) -> DataFrame:
    p = players if players is not None else fx.players(spark, sf)
    return L.build_league_map(p, fx.leagues(spark, sf), season=fx.FIXTURE_SEASON,
                              calendar_year=fx.FIXTURE_CALENDAR_YEAR, apertura=fx.FIXTURE_APERTURA)


def scored(spark: SparkSession, sf: str, params=None, roles=None) -> DataFrame:
    p = fx.players(spark, sf)
    lm = league_map(spark, sf, p)
    kw = {} if params is None else {"params": params}
    return S.score(p, lm, fx.FIXTURE_SPEC, roles=roles, **kw)


# ---- Q1 / Q2 family -------------------------------------------------------
def q_score(spark, sf):
    return scored(spark, sf).select(*SCORE_COLS)


def q_role_percentiles(spark, sf):
    from .spec import ScoreParams
    params = ScoreParams()
    p = fx.players(spark, sf)
    lm = league_map(spark, sf, p)
    metric_cols = [m for m in fx.FIXTURE_SPEC.metrics() if m in p.columns]
    elig = S.with_cells(S.eligible(S.with_league(p, lm), params.min_minutes), params)
    pct = S.role_percentiles(elig, fx.FIXTURE_SPEC, metric_cols, params)
    return pct.select("player_id", "role", "cell", "ordinal", "metric", "value", "volume", "pct")


def q_thin_cells(spark, sf):
    from .spec import ScoreParams
    params = ScoreParams()
    p = fx.players(spark, sf)
    lm = league_map(spark, sf, p)
    elig = S.with_cells(S.eligible(S.with_league(p, lm), params.min_minutes), params)
    return (elig.groupBy("league_cell", "cell", "role", "cell_n", "thin")
                .agg(F.count(F.lit(1)).alias("n_rows")))


def q_ranks(spark, sf):
    return scored(spark, sf).select("player_id", "role", "league_code", "perf_league", "perf_adjusted",
                                    "rank_in_league", "rank_overall")


def q_shortlist(spark, sf):
    return S.shortlist(scored(spark, sf, roles=["AUTOMOBILE"]), role="AUTOMOBILE", league="nation_1", max_age=30,
                       priority=2, top=15)


# ---- Q3 family ------------------------------------------------------------
def q_league_map(spark, sf):
    return league_map(spark, sf).select(*LEAGUE_MAP_COLS)


def q_supported_median(spark, sf):
    return L.supported_median(fx.players(spark, sf), ["league_key"], "market_value")


def q_interpolated_strength(spark, sf):
    raw = L.raw_strength(L.strength_inputs(fx.players(spark, sf), fx.leagues(spark, sf)))
    return raw.select("league_key", "mv_median", "uefa_raw", "interp", "raw")


def q_monotone_anchors(spark, sf):
    inputs = L.strength_inputs(fx.players(spark, sf), fx.leagues(spark, sf))
    return L.anchors_of(inputs)


# ---- Q4 / Q6 quality family -------------------------------------------------
from .operators import sets as U  # noqa: E402
from .plans import quality as Qy  # noqa: E402

SUPPLIER_KEY = ["s_name", "s_nationkey"]


def _pair(spark, sf):
    from .session import table
    return table(spark, sf, "supplier"), fx.supplier_changed(spark, sf)


def q_duplicate_keys(spark, sf):
    from .session import table
    return U.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def q_dedup_rows(spark, sf):
    from .session import table
    return U.dedup_rows(table(spark, sf, "documents").select("text"))


def q_union_exports(spark, sf):
    a, b = fx.supplier_halves(spark, sf)
    return U.union_exports([a, b])


def q_combine(spark, sf):
    a, b = fx.supplier_halves(spark, sf)
    return Qy.combine([a, b], "s_acctbal", ["s_suppkey"])


def q_diff_keyed(spark, sf):
    a, b = _pair(spark, sf)
    return Qy.diff_keyed(a, b, SUPPLIER_KEY)


def q_diff_positional(spark, sf):
    a, b = _pair(spark, sf)
    return Qy.diff_positional(a, b, ["s_suppkey"])


def q_key_membership(spark, sf):
    a, b = _pair(spark, sf)
    return Qy.key_membership(a, b, SUPPLIER_KEY)


def q_shape_checks(spark, sf):
    a, b = _pair(spark, sf)
    return Qy.shape_checks(a, b)


def q_diff_summary(spark, sf):
    a, b = _pair(spark, sf)
    return Qy.diff_summary(a, b, SUPPLIER_KEY)


def q_diff_listing(spark, sf):
    a, b = _pair(spark, sf)
    return Qy.diff_listing(Qy.diff_keyed(a, b, SUPPLIER_KEY))


def q_preview(spark, sf):
    a, b = _pair(spark, sf)
    return Qy.preview(a, SUPPLIER_KEY, "s_acctbal", side="a").unionByName(
        Qy.preview(b, SUPPLIER_KEY, "s_acctbal", side="b"))


def q_compare_keyed(spark, sf):
    """Q6 + X4: verdict by the first default key that both tables have; duplicated and one-sided keys."""
    from .session import table
    return Qy.compare(table(spark, sf, "supplier"), fx.supplier_edited(spark, sf), defaults=[["s_code", "s_name"], SUPPLIER_KEY])


def q_compare_positional(spark, sf):
    a, b = _pair(spark, sf)
    return Qy.compare(a, b, order_by=["s_suppkey"])


def q_cell_tolerance(spark, sf):
    a, b = _pair(spark, sf)
    return Qy.cell_tolerance(a, b, SUPPLIER_KEY, "s_acctbal")


# ---- Q7 / Q10: concept index and diagnostics ---------------------------------
from .functions.numeric import round_half_even  # noqa: E402
from .operators import aggregates as A  # noqa: E402
from .operators.rank import pct_rank_global, ranks_min_desc, top_per_group  # noqa: E402
from .plans import report as R  # noqa: E402
from .session import materialize, table  # noqa: E402
from .spec import CANDIDATE_MAX_AGE, RETENTION_FRACTION, TOP_FRACTION  # noqa: E402

CONCEPT_NAMES = list(fx.FIXTURE_CONCEPTS)
BLOCK_NAMES = list(fx.FIXTURE_BLOCKS)


def _pool(spark, sf):
    return fx.players(spark, sf).where(F.col("role").isin(fx.FIXTURE_POOL_ROLES))


def _concepts(spark, sf, group=None):
    """Concept scores (within ``group``) + flat index of the pool, with its market value (checkpointed)."""
    players = fx.players(spark, sf)
    pool = players.where(F.col("role").isin(fx.FIXTURE_POOL_ROLES))
    sc = R.concept_scores(pool, "player_id", fx.FIXTURE_CONCEPTS, "age", group)
    sc = sc.withColumn("flat_index", R.flat_index(CONCEPT_NAMES))
    return materialize(sc.join(pool.select("player_id", "market_value"), "player_id", "inner"))


def q_global_percentile(spark, sf):
    p = fx.players(spark, sf).select("player_id", "price_per_unit")
    return pct_rank_global(p, "price_per_unit", out="pct")


def q_concept_index(spark, sf):
    return _concepts(spark, sf).select("player_id", *CONCEPT_NAMES, "flat_index")


def q_block_index(spark, sf):
    b = R.block_scores(_concepts(spark, sf), "player_id", fx.FIXTURE_BLOCKS)
    return b.withColumn("block_index", R.flat_index(BLOCK_NAMES))


def q_spearman(spark, sf):
    return A.spearman(_concepts(spark, sf), "flat_index", "market_value", "player_id")


def q_spearman_no_age(spark, sf):
    """Q7: index without the age concept against the price."""
    c = _concepts(spark, sf)
    rest = [n for n, ms in fx.FIXTURE_CONCEPTS.items() if ms]
    return A.spearman(c.withColumn("index_no_age", R.flat_index(rest)), "index_no_age", "market_value", "player_id")


def q_spearman_within_league(spark, sf):
    """Q7: index of percentiles within each league against the price."""
    return A.spearman(_concepts(spark, sf, "league_key"), "flat_index", "market_value", "player_id")


def q_retention_blocks(spark, sf):
    """Q7: top share kept when the index is the mean of the blocks."""
    c = _concepts(spark, sf)
    b = R.block_scores(c, "player_id", fx.FIXTURE_BLOCKS).withColumn("block_index", R.flat_index(BLOCK_NAMES))
    return A.retention(b.join(c.select("player_id", "market_value"), "player_id"), "player_id", "block_index", "market_value",
                       RETENTION_FRACTION)


def q_price_vs_league_median(spark, sf):
    """Q7: own price against the median price of the league."""
    return A.pearson(q_group_median(spark, sf), "league_median", "market_value")


def q_pearson(spark, sf):
    return A.pearson(fx.players(spark, sf), "price_per_unit", "market_value")


def q_corr_matrix(spark, sf):
    return A.corr_matrix(_concepts(spark, sf), CONCEPT_NAMES)


def q_corr_with(spark, sf):
    return A.corr_with(_concepts(spark, sf), CONCEPT_NAMES, "flat_index")


def q_pca_variance(spark, sf):
    return A.pca_variance(_concepts(spark, sf), CONCEPT_NAMES)


def q_retention(spark, sf):
    return A.retention(_concepts(spark, sf), "player_id", "flat_index", "market_value", RETENTION_FRACTION)


def _att(spark, sf):
    c = _concepts(spark, sf).withColumn("value_index", round_half_even(F.col("flat_index"), 1))
    return ranks_min_desc(c, {"assumed_rank": ([], "value_index"), "actual_rank": ([], "market_value")})


def q_top_by_value(spark, sf):
    att = _att(spark, sf)
    return (att.orderBy(F.col("market_value").desc_nulls_last(), "player_id").limit(15)
               .select("player_id", "market_value", "value_index", "assumed_rank", "actual_rank"))


def q_rank_zip(spark, sf):
    att = materialize(_att(spark, sf))
    mvm = lambda c: round_half_even(F.col(c) / F.lit(1e6), 1)
    a = (top_per_group(att, [], [F.col("value_index").desc_nulls_last(), F.col("player_id")], 15, out="rank")
         .select("rank", F.col("player_id").alias("a_player_id"), F.col("value_index").alias("a_value_index"),
                 mvm("market_value").alias("a_mv_m"), F.col("actual_rank").alias("a_actual_rank")))
    b = (top_per_group(att, [], [F.col("market_value").desc_nulls_last(), F.col("player_id")], 15, out="rank")
         .select("rank", F.col("player_id").alias("b_player_id"), mvm("market_value").alias("b_mv_m")))
    return A.rank_zip(a, b, "rank")


# ---- Q8 candidate report ------------------------------------------------------
def _cand(spark, sf):
    return materialize(R.candidates(scored(spark, sf), CANDIDATE_MAX_AGE))


def q_club_status(spark, sf):
    p = fx.players(spark, sf)
    return p.select("player_id", "club_season", "club_now",
                    R.club_moved(F.col("club_season"), F.col("club_now")).alias("moved"),
                    R.club_free(F.col("club_now")).alias("free"))


def q_quantile_cut(spark, sf):
    return R.top_decile_test(_cand(spark, sf), TOP_FRACTION).select(
        r9_col("cut").alias("cut"), "n_top", "n_rest")


def r9_col(c):
    from .functions.numeric import r9
    return r9(F.col(c))


def q_two_proportion(spark, sf):
    return R.top_decile_test(_cand(spark, sf), TOP_FRACTION).select(
        "moved_top", "n_top", "moved_rest", "n_rest", "z", "p_value")


def q_validation(spark, sf):
    return R.validation(_cand(spark, sf), TOP_FRACTION)


def q_quintile_rate(spark, sf):
    return R.quintile_rate(_cand(spark, sf))


def q_concentration_alert(spark, sf):
    return R.concentration_alert(_cand(spark, sf))


def q_top_per_group(spark, sf):
    return R.top_by_group(_cand(spark, sf)).select("role", "rank", "player_id", "idx")


def q_payload(spark, sf):
    """One flat row per candidate, its radar array (X23) included."""
    return R.payload_players(_cand(spark, sf))


def q_payload_json(spark, sf):
    from .spec import MIN_MINUTES, FULL_SEASON
    sc = scored(spark, sf)
    cand = materialize(R.candidates(sc, CANDIDATE_MAX_AGE))
    counts = cand.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    groups = fx.FIXTURE_SPEC.groups_df(spark).join(counts, "role", "left") \
        .withColumn("n", F.coalesce(F.col("n"), F.lit(0)))
    meta = {"maxAge": CANDIDATE_MAX_AGE, "minMinutes": MIN_MINUTES, "fullSeason": FULL_SEASON}
    header, players = R.payload_json(cand, meta, groups, R.validation(cand, TOP_FRACTION), scanned=sc)
    return header.withColumn("kind", F.lit("header")).unionByName(players.withColumn("kind", F.lit("player")))


def q_radar(spark, sf):
    """The radar array as rows."""
    return scored(spark, sf).select("player_id", F.posexplode("radar").alias("ordinal", "value"))


def q_money_label(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") * 1000).alias("value"))
    return R.money_labels(c, "c_custkey", "value")


def q_run_summary(spark, sf):
    return A.run_summary(scored(spark, sf))


def q_distinct_leagues(spark, sf):
    return _cand(spark, sf).select(F.col("league").alias("name"), F.col("country").alias("code")).distinct()


def q_role_profile(spark, sf):
    return A.role_profile(scored(spark, sf), "role", ("age", "minutes"))


def q_group_size(spark, sf):
    return A.group_size(fx.players(spark, sf), "role")


def q_value_shares(spark, sf):
    return A.value_shares(table(spark, sf, "orders"), "o_orderpriority")


def q_value_concentration(spark, sf):
    return A.value_concentration(table(spark, sf, "part"), "p_size", 6)


def _docs_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(
        table(spark, sf, "labels"), "doc_id", "left")


def q_rate_by_band(spark, sf):
    from .functions.numeric import bucketize
    d = _docs_labels(spark, sf)
    band = bucketize(F.col("n_chars"), fx.FIXTURE_LENGTH_EDGES, fx.FIXTURE_LENGTH_LABELS, "nan")
    return A.rate_by(d, band.alias("b"), F.col("quality") == 1).withColumnRenamed("group", "group_value")


def q_rate_range(spark, sf):
    return A.rate_range(_docs_labels(spark, sf), "lang", F.col("toxic") == 1)


# ---- roles, latest per key, verification, registry, catalogue -------------------
from .functions import roles as RO  # noqa: E402
from .functions import text as TX  # noqa: E402
from .operators import joins as J  # noqa: E402
from .operators.rank import latest_per_key, row_index  # noqa: E402
from .plans import registry as RG  # noqa: E402
from .plans import verify as V  # noqa: E402

TIMEFRAME = "1998/1999"


def _positions(spark, sf):
    return fx.events_positions(spark, sf)


def q_assign_role(spark, sf):
    p = _positions(spark, sf)
    return p.select("user_id", "position", RO.first_token(F.col("position")).alias("first_pos"),
                    RO.assign_role(F.col("position"), fx.FIXTURE_ROLE_OF_EVENT).alias("role"))


def q_unmapped_codes(spark, sf):
    p = _positions(spark, sf).withColumn("role", RO.assign_role(F.col("position"), fx.FIXTURE_ROLE_OF_EVENT))
    return RO.unmapped_codes(p, "position")


def q_role_default(spark, sf):
    p = _positions(spark, sf)
    return p.select("user_id", RO.assign_role_default(F.col("position"), fx.FIXTURE_ROLE_OF_EVENT).alias("role"))


def q_latest_per_key(spark, sf):
    """Per customer the newest season; in it the first order with data, else the last."""
    o = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.year("o_orderdate").alias("season"),
        (F.col("o_orderstatus") != "P").alias("has_data"))
    order = F.struct(-F.col("season"), (~F.col("has_data")).cast("int"),
                     F.when(F.col("has_data"), F.col("o_orderkey")).otherwise(-F.col("o_orderkey")))
    return latest_per_key(o, ["o_custkey"], order)


def _verified(spark, sf):
    return V.verify(fx.season_registry(spark, sf).select("folder"), fx.season_found(spark, sf),
                    fx.season_listing(spark, sf))


def q_verify_season(spark, sf):
    return _verified(spark, sf).select("folder", "n_rows", "n_parts", "expected", "reason", "status", "message")


def q_expected_counts(spark, sf):
    return V.expected_counts(fx.season_listing(spark, sf))


def q_status_rollup(spark, sf):
    return V.status_rollup(_verified(spark, sf))


def q_reconcile_counts(spark, sf):
    return V.reconcile_counts(fx.season_found(spark, sf), V.expected_counts(fx.season_listing(spark, sf)))


def q_registry(spark, sf):
    return RG.build_registry(fx.registry_rows(spark, sf), tiers=("green", "yellow"))


def q_code_order(spark, sf):
    return RG.code_order(RG.build_registry(fx.registry_rows(spark, sf)))


def q_league_code(spark, sf):
    p = table(spark, sf, "part")
    country = F.concat(F.lit("B"), F.regexp_extract("p_brand", r"(\d+)", 1))
    return p.select("p_partkey",
                    TX.league_code(country, F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("code_name"),
                    TX.league_code(country, F.col("p_type")).alias("code_type"))


def q_safe_name(spark, sf):
    p = table(spark, sf, "part")
    raw = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit("."))
    return p.select("p_partkey", TX.safe_name(raw).alias("safe"))


def q_natural_order(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    x = n.select("n_nationkey", "n_name", TX.natural_key("n_name").alias("_key"))
    return row_index(x, ["_key", "n_nationkey"], out="ord").select("n_name", "ord")


def q_slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", TX.slug(F.col("text")).alias("slug"))


def q_source_split(spark, sf):
    lm = league_map(spark, sf)
    return A.group_size(lm.withColumn("source", TX.first_word(F.col("strength_source"))), "source")


def _catalogue(spark, sf):
    return RG.catalogue_table(RG.flatten_catalogue(fx.catalogue_docs(spark, sf)))


def q_catalogue_flatten(spark, sf):
    flat = RG.flatten_catalogue(fx.catalogue_docs(spark, sf))
    return flat.select("area", "competition_id", "competition", "season_id", "season",
                       F.col("cat_ord.doc").alias("doc_ord"), F.col("cat_ord.pos").alias("comp_pos"))


def q_catalogue_resolve(spark, sf):
    return J.resolve_scope(fx.scopes(spark, sf), _catalogue(spark, sf), TIMEFRAME)


def q_suggest(spark, sf):
    cat = _catalogue(spark, sf)
    unresolved = J.resolve_scope(fx.scopes(spark, sf), cat, TIMEFRAME).where(F.col("match") == "none")
    return J.suggest(unresolved.select("scope"), cat)


# ---- S1-S5, S13, U5 on an export tree derived from supplier -----------------------
from .sources import files as FS  # noqa: E402


def _tree(spark, sf, plain_season=None):
    import uuid
    from .session import ensure_checkpoint_dir
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/exports-{uuid.uuid4().hex}"
    return fx.write_export_tree(spark, sf, root, plain_season)


def q_header_report(spark, sf):
    rep = FS.header_report(spark, _tree(spark, sf), fx.EXPORT_SPEC)
    return rep.select("folder", F.array_join("missing", "|").alias("missing"),
                      F.array_join("extra", "|").alias("extra"), "ok").groupBy("folder", "missing", "extra", "ok") \
              .agg(F.count(F.lit(1)).alias("n_files"))


def _exports(spark, sf, strict):
    df, _ = FS.read_exports(spark, _tree(spark, sf), fx.EXPORT_SPEC, fx.EXPORT_TYPES,
                            season="2025-2026", strict=strict)
    return df.groupBy("folder", "country", "league", "season").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("Team").alias("n_team"),
        F.sum("Key").alias("key_sum"), F.max("Market value").alias("max_value"))


def q_strict_gate(spark, sf):
    return _exports(spark, sf, True)


def q_conform(spark, sf):
    return _exports(spark, sf, False)


def q_missing_exports(spark, sf):
    rep = FS.header_report(spark, _tree(spark, sf), fx.EXPORT_SPEC)
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    reg = n.select(F.format_string("%d - [%s] - (%s)", F.col("n_nationkey") + 1,
                                   F.upper(F.substring("r_name", 1, 3)), F.col("n_name")).alias("folder"))
    planned = table(spark, sf, "region").select(F.format_string("%d - [%s] - (planned)", F.col("r_regionkey") + 100, F.upper(F.substring("r_name", 1, 3))).alias("folder"))
    return FS.missing_exports(reg.unionByName(planned), rep)


def q_part_schema_check(spark, sf):
    """Folders whose exports of two seasons do not share one header."""
    rep = FS.header_report(spark, _tree(spark, sf, "2024-2025"), fx.EXPORT_SPEC)
    return FS.part_schema_check(rep).select("folder", "n_headers")


# ---- digests, staged publishing, newest season, scans, file sinks ---------------------
from .operators import scan as SC  # noqa: E402
from .plans import digest as DG  # noqa: E402
from .sources import publish as PB  # noqa: E402


def _folder(spark, name):
    import uuid
    from .session import ensure_checkpoint_dir
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


def q_diff_by_digest(spark, sf):
    """J3 by digest tree: the result of ``diff_keyed``; rows of equal buckets are not shuffled."""
    a, b = _pair(spark, sf)
    return DG.diff_by_digest(a, b, SUPPLIER_KEY)


def q_diff_stored(spark, sf):
    """Q6 on stored tables: digests first, then only the groups that differ."""
    changed = fx.orders_changed(spark, sf)
    pa, pb = _folder(spark, "digested"), _folder(spark, "digested")
    DG.write_digested(table(spark, sf, "orders").select(*changed.columns), pa, ["o_orderkey"])
    DG.write_digested(changed, pb, ["o_orderkey"])
    return DG.diff_stored(spark, pa, pb, ["o_orderkey"])


def q_merge_counts(spark, sf):
    """Q4: rows before, after and removed of a merge."""
    merged = U.union_exports(list(fx.supplier_halves(spark, sf)))
    return U.removed_count(merged, U.dedup_rows(merged))


def _published(spark, sf):
    """Merge both halves, stage, publish; every seventh nation expects a row too many, so it is held back."""
    root = _folder(spark, "published")
    merged = U.dedup_rows(U.union_exports(list(fx.supplier_halves(spark, sf)))).withColumn("league", F.col("s_nationkey"))
    own = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("league")).agg(F.count(F.lit(1)).alias("n"))
    expected = own.select("league", (F.col("n") + (F.col("league") % 7 == 3).cast("long")).alias("expected"))
    return root, PB.publish(merged, root, expected, ["league"])


def q_publish_merge(spark, sf):
    """Q4 + S9: what readers see through the manifest."""
    root, _ = _published(spark, sf)
    return PB.read_published(spark, root, ["league"]).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("s_suppkey").alias("key_sum"))


def q_publish_manifest(spark, sf):
    """Q4: the checked counts of the written files."""
    return _published(spark, sf)[1].select("league", "n_rows", "expected", "status")


def q_newest_season(spark, sf):
    """Q3: the newest season of each league, chosen before the scan; only its folders are read."""
    root = _folder(spark, "seasons")
    FS.write_merged(fx.season_orders(spark, sf), root, ["season", "league"])
    rows, _ = PB.scan_newest(spark, root, "league", "season")
    return rows.where(FS.valid_season(F.col("season"))).groupBy(F.col("league").cast("long").alias("league"), F.col("season").alias("latest_season")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"), F.sum("cents").alias("cents"))


def q_running_total(spark, sf):
    """Prefix scan: running total and running maximum of the order prices by date, over the whole table."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return SC.prefix_scan(o, ["o_orderdate", "o_orderkey"], {"total": ("sum", "cents"), "highest": ("max", "cents")}).select("o_orderkey", "total", "highest")


def q_asof_balance(spark, sf):
    """As-of join: per customer the nearest supplier balances of its nation, at or below and above its own."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), "s_acctbal")
    return SC.asof_join(c, "c_acctbal", s, "s_acctbal", ["s_acctbal"], group_cols=["nation"]).select(
        "c_custkey", F.col("prev.s_acctbal").alias("below"), F.col("next.s_acctbal").alias("above"))


def q_corr_wide(spark, sf):
    """A11 over many columns: the dimensions of the embeddings."""
    v = table(spark, sf, "embeddings")
    dims = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    cols = [f"d{i}" for i in range(dims)]
    return A.corr_matrix_wide(v.select(*[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)]), cols)


def q_pca_moments(spark, sf):
    """Sums of the explained shares and of their squares."""
    return A.pca_variance(_concepts(spark, sf), CONCEPT_NAMES).agg(
        F.count(F.lit(1)).alias("n"), r9_col_of(F.sum("explained")).alias("total"), r9_col_of(F.sum(F.col("explained") * F.col("explained"))).alias("squares"))


def r9_col_of(c):
    from .functions.numeric import r9
    return r9(c)


def q_write_merged(spark, sf):
    """A folder per nation, read back."""
    root = _folder(spark, "merged")
    s = table(spark, sf, "supplier").withColumn("league_code", F.format_string("N%02d", F.col("s_nationkey"))).withColumn("season", F.lit("2025-2026"))
    FS.write_merged(s, root)
    return spark.read.parquet(root).groupBy("season", "league_code").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("s_suppkey").alias("key_sum"))


def q_read_table(spark, sf):
    """A tab-separated table, written and read as text."""
    path = _folder(spark, "table") + ".tsv"
    table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size").write.option("header", "true").option("sep", "\t").csv(path)
    return FS.read_table(spark, path)


def q_load_league_map(spark, sf):
    """The league dimension from its CSV, and how many leagues have no strength."""
    path = _folder(spark, "league_map") + ".csv"
    names = [f.name for f in FS.LEAGUE_MAP_SCHEMA.fields]
    league_map(spark, sf).select(*names).write.option("header", "true").csv(path)
    lm, missing = FS.load_league_map(spark, path)
    return lm.select("league_code", "league", "priority_rank", "division", "strength", "n_teams", "n_players").crossJoin(F.broadcast(missing))


# ---- W6, K2, U4 ------------------------------------------------------------------
from .operators.rank import with_group_median  # noqa: E402


def q_group_median(spark, sf):
    """Each priced player with the median market value of its league."""
    p = fx.players(spark, sf).where(F.col("market_value") > 0).select("player_id", "league_key", "market_value")
    return with_group_median(p, ["league_key"], "market_value", out="league_median")


def q_canonical_order(spark, sf):
    """K2: nation ascending, balance descending (NULLs last), key ascending -> row number."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    x = (s.withColumn("_nb", F.col("s_acctbal").isNull().cast("int"))
          .withColumn("_bd", F.coalesce(-F.col("s_acctbal"), F.lit(0.0))))
    return row_index(x, ["s_nationkey", "_nb", "_bd", "s_suppkey"], out="ord").select(
        "s_suppkey", "s_nationkey", "s_acctbal", "ord")


def q_column_diff(spark, sf):
    """U4: supplier vs its changed copy with a renamed and a moved column."""
    a = table(spark, sf, "supplier")
    b = fx.supplier_changed(spark, sf).select("s_name", "s_suppkey", F.col("s_acctbal").alias("balance"),
                                              "s_nationkey")
    return U.column_diff(spark, a, b)


QUERIES = {
    "score": q_score,
    "role_percentiles": q_role_percentiles,
    "thin_cells": q_thin_cells,
    "ranks": q_ranks,
    "shortlist": q_shortlist,
    "league_map": q_league_map,
    "supported_median": q_supported_median,
    "interpolated_strength": q_interpolated_strength,
    "monotone_anchors": q_monotone_anchors,
    "duplicate_keys": q_duplicate_keys,
    "dedup_rows": q_dedup_rows,
    "union_exports": q_union_exports,
    "combine": q_combine,
    "diff_keyed": q_diff_keyed,
    "diff_positional": q_diff_positional,
    "key_membership": q_key_membership,
    "shape_checks": q_shape_checks,
    "diff_summary": q_diff_summary,
    "diff_listing": q_diff_listing,
    "preview": q_preview,
    "cell_tolerance": q_cell_tolerance,
    "compare_keyed": q_compare_keyed,
    "compare_positional": q_compare_positional,
    "global_percentile": q_global_percentile,
    "concept_index": q_concept_index,
    "block_index": q_block_index,
    "spearman": q_spearman,
    "spearman_no_age": q_spearman_no_age,
    "spearman_within_league": q_spearman_within_league,
    "retention_blocks": q_retention_blocks,
    "price_vs_league_median": q_price_vs_league_median,
    "pearson": q_pearson,
    "corr_matrix": q_corr_matrix,
    "corr_with": q_corr_with,
    "pca_variance": q_pca_variance,
    "retention": q_retention,
    "top_by_value": q_top_by_value,
    "rank_zip": q_rank_zip,
    "club_status": q_club_status,
    "quantile_cut": q_quantile_cut,
    "two_proportion": q_two_proportion,
    "validation": q_validation,
    "quintile_rate": q_quintile_rate,
    "concentration_alert": q_concentration_alert,
    "top_per_group": q_top_per_group,
    "payload": q_payload,
    "payload_json": q_payload_json,
    "radar": q_radar,
    "money_label": q_money_label,
    "run_summary": q_run_summary,
    "distinct_leagues": q_distinct_leagues,
    "role_profile": q_role_profile,
    "group_size": q_group_size,
    "value_shares": q_value_shares,
    "value_concentration": q_value_concentration,
    "rate_by_band": q_rate_by_band,
    "rate_range": q_rate_range,
    "assign_role": q_assign_role,
    "unmapped_codes": q_unmapped_codes,
    "role_default": q_role_default,
    "latest_per_key": q_latest_per_key,
    "verify_season": q_verify_season,
    "expected_counts": q_expected_counts,
    "status_rollup": q_status_rollup,
    "reconcile_counts": q_reconcile_counts,
    "registry": q_registry,
    "code_order": q_code_order,
    "league_code": q_league_code,
    "safe_name": q_safe_name,
    "natural_order": q_natural_order,
    "slug": q_slug,
    "source_split": q_source_split,
    "catalogue_flatten": q_catalogue_flatten,
    "catalogue_resolve": q_catalogue_resolve,
    "suggest": q_suggest,
    "header_report": q_header_report,
    "strict_gate": q_strict_gate,
    "conform": q_conform,
    "missing_exports": q_missing_exports,
    "part_schema_check": q_part_schema_check,
    "group_median": q_group_median,
    "canonical_order": q_canonical_order,
    "column_diff": q_column_diff,
    "diff_by_digest": q_diff_by_digest,
    "diff_stored": q_diff_stored,
    "merge_counts": q_merge_counts,
    "publish_merge": q_publish_merge,
    "publish_manifest": q_publish_manifest,
    "newest_season": q_newest_season,
    "running_total": q_running_total,
    "asof_balance": q_asof_balance,
    "corr_wide": q_corr_wide,
    "pca_moments": q_pca_moments,
    "write_merged": q_write_merged,
    "read_table": q_read_table,
    "load_league_map": q_load_league_map,
}
