"""DuckDB SQL that states the same queries as the Spark plans (the test oracle).

The driver tables are pre-registered as views. Shared steps are common table
expressions; DuckDB drops the ones a query does not reference. Literals are
cast to DOUBLE where Spark computes in doubles (DuckDB reads ``0.35`` as a
DECIMAL). Rounding is ``round_even(x * 10^n, 0) / 10^n``, the same
half-to-even rule as ``rint`` on the Spark side.
"""

from __future__ import annotations

from .sources.fixtures import (FIXTURE_LOWER_IS_BETTER, FIXTURE_ROLE_METRICS, FIXTURE_SEASON,
                               FIXTURE_VOLUME_OF, FIXTURE_CALENDAR_YEAR, FIXTURE_APERTURA,
                               FIXTURE_METRICS)
from .spec import DIVISION_FACTOR, LEAGUE_WEIGHT, MIN_ATTEMPTS, MIN_CELL, MIN_MINUTES, FULL_SEASON


def d(x: float) -> str:
    """A DOUBLE literal."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def rnd(expr: str, n: int) -> str:
    s = d(10.0 ** n)
    return f"(round_even(({expr}) * {s}, 0) / {s})"


def r9(expr: str) -> str:
    return rnd(expr, 9)


def _spec_values() -> str:
    rows = []
    for role, ms in FIXTURE_ROLE_METRICS.items():
        for i, m in enumerate(ms):
            vol = FIXTURE_VOLUME_OF.get(m)
            rows.append(f"('{role}', {i}, '{m}', {'true' if m in FIXTURE_LOWER_IS_BETTER else 'false'}, "
                        f"{repr(vol) if vol else 'NULL'})")
    return ",\n    ".join(rows)


def _case_metric(col: str) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{m}' THEN {m}" for m in FIXTURE_METRICS) + " END"


def _strlist(xs) -> str:
    return ", ".join(f"'{x}'" for x in sorted(xs)) or "''"


FACTOR_CASE = "CASE division " + " ".join(f"WHEN {k} THEN {d(v)}" for k, v in DIVISION_FACTOR.items()) + " END"

LEAGUE_CODE = ("country || '_' || left(array_to_string(list_transform(_w, lambda x: CASE WHEN len(_w) = 1 "
               "THEN left(x, 5) ELSE left(x, 1) || regexp_replace(x, '[^0-9]', '', 'g') END), ''), 7)")

CTES = [
    # ---- FIXTURES 3.1: players
    """li AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price_cents,
         count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
         sum(CAST(round(l_discount * 100) AS BIGINT)) AS discount_cents
  FROM lineitem GROUP BY l_orderkey)""",
    """pc AS (
  SELECT o_custkey, count(*) AS n_orders, sum(n_lines) AS n_lines, sum(qty) AS minutes,
         sum(price_cents) AS price_cents, sum(n_returned) AS n_returned, sum(discount_cents) AS discount_cents,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent
  FROM li JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)""",
    f"""players AS (
  SELECT c_custkey AS player_id, c_name AS player, c_nationkey AS league_key, c_mktsegment AS role,
         c_acctbal AS market_value, CAST(17 + c_custkey % 19 AS DOUBLE) AS age,
         CASE WHEN c_custkey % 17 <> 0 THEN 'CLUB_' || CAST(c_nationkey AS VARCHAR) END AS club_season,
         CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN ''
              WHEN c_custkey % 5 = 0 THEN 'CLUB_' || CAST(c_nationkey + 1 AS VARCHAR)
              WHEN c_custkey % 17 <> 0 THEN 'CLUB_' || CAST(c_nationkey AS VARCHAR) END AS club_now,
         minutes,
         n_orders * {d(90)} / nullif(minutes, 0) AS orders_per90,
         n_lines * {d(90)} / nullif(minutes, 0) AS lines_per90,
         price_cents / {d(100)} / nullif(minutes, 0) AS price_per_unit,
         CASE WHEN n_returned > 0 THEN {d(100)} * n_returned / nullif(n_lines, 0) END AS returned_pct,
         discount_cents / {d(100)} / nullif(n_lines, 0) AS discount_avg,
         {d(100)} * n_urgent / nullif(n_orders, 0) AS urgent_pct
  FROM customer JOIN pc ON c_custkey = o_custkey)""",
    # ---- FIXTURES 3.2: league dimension and Q3 build
    """leagues AS (
  SELECT n_nationkey AS league_key, n_name AS folder, n_name AS league,
         upper(substr(r_name, 1, 3)) AS country, CAST(1 + n_nationkey % 3 AS INTEGER) AS division,
         CASE WHEN n_regionkey <= 2 THEN CAST(20 + (n_nationkey * 37) % 60 AS DOUBLE) END AS coefficient,
         CASE WHEN n_regionkey <= 1 THEN 'green' WHEN n_regionkey <= 3 THEN 'yellow' ELSE 'red' END AS priority
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey)""",
    """prof AS (
  SELECT league_key, count(*) AS n_players, count(DISTINCT club_season) AS n_teams
  FROM players GROUP BY league_key)""",
    f"""med AS (
  SELECT league_key, count(*) AS n_rows, count(*) FILTER (WHERE market_value > 0) AS n_positive,
         CASE WHEN count(*) FILTER (WHERE market_value > 0) >= 20 THEN
           {r9('quantile_cont(market_value, 0.5) FILTER (WHERE market_value > 0)')} END AS mv_median,
         {d(100)} * count(*) FILTER (WHERE market_value > 0) / count(*) AS coverage
  FROM players GROUP BY league_key)""",
    f"""inputs AS (
  SELECT l.*, p.n_players, p.n_teams, m.n_positive, m.mv_median, m.coverage,
         coefficient * {FACTOR_CASE} AS uefa_raw
  FROM leagues l LEFT JOIN prof p USING (league_key) LEFT JOIN med m USING (league_key))""",
    """anchors AS (
  SELECT mv_median AS ax,
         max(uefa_raw) OVER (ORDER BY mv_median, uefa_raw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ay,
         row_number() OVER (ORDER BY mv_median, uefa_raw) AS anchor_ord
  FROM inputs WHERE uefa_raw IS NOT NULL AND mv_median IS NOT NULL AND mv_median <> 0)""",
    """iv AS (
  SELECT * FROM (SELECT ax, ay, lead(ax) OVER (ORDER BY anchor_ord) AS bx, lead(ay) OVER (ORDER BY anchor_ord) AS by_
                 FROM anchors) WHERE bx IS NOT NULL AND bx > ax)""",
    """ends AS (
  SELECT min(ax) AS xmin, max(ax) AS xmax, arg_min(ay, anchor_ord) AS yfirst, arg_max(ay, anchor_ord) AS ylast
  FROM anchors)""",
    """interp AS (
  SELECT i.league_key,
         CASE WHEN x IS NULL THEN NULL WHEN x < xmin THEN yfirst WHEN x >= xmax THEN ylast
              ELSE (iv.by_ - iv.ay) / (iv.bx - iv.ax) * (x - iv.ax) + iv.ay END AS interp
  FROM (SELECT *, CASE WHEN mv_median <> 0 THEN mv_median END AS x FROM inputs WHERE uefa_raw IS NULL) i
  LEFT JOIN iv ON i.x >= iv.ax AND i.x < iv.bx CROSS JOIN ends)""",
    """raw AS (
  SELECT i.*, t.interp, coalesce(i.uefa_raw, t.interp) AS raw
  FROM inputs i LEFT JOIN interp t USING (league_key))""",
    """top AS (
  SELECT CASE WHEN coalesce(max(CASE WHEN raw <> 0 THEN raw END), 0) <> 0
              THEN max(CASE WHEN raw <> 0 THEN raw END) ELSE CAST(1.0 AS DOUBLE) END AS top FROM raw)""",
    f"""league_map AS (
  SELECT league_key, {LEAGUE_CODE} AS league_code, folder, country, league, priority,
         CASE priority WHEN 'green' THEN 1 WHEN 'yellow' THEN 2 WHEN 'red' THEN 3 END AS priority_rank,
         division,
         CASE WHEN raw IS NOT NULL AND raw <> 0 THEN {rnd(d(100) + ' * raw / top', 1)} END AS strength,
         CASE WHEN uefa_raw IS NOT NULL THEN 'provisional_uefa_x_division'
              WHEN interp IS NOT NULL THEN 'provisional_marketvalue_interp (coverage '
                   || CAST(CAST(round_even(coalesce(coverage, 0), 0) AS BIGINT) AS VARCHAR) || '%)'
              ELSE 'MISSING - fill by hand' END AS strength_source,
         '{FIXTURE_SEASON}' AS latest_season,
         CAST(coalesce(n_teams, 0) AS BIGINT) AS n_teams, CAST(coalesce(n_players, 0) AS BIGINT) AS n_players,
         CAST(NULL AS INTEGER) AS groups,
         CASE WHEN country IN ({_strlist(FIXTURE_APERTURA)}) THEN 'apertura-clausura'
              WHEN country IN ({_strlist(FIXTURE_CALENDAR_YEAR)}) THEN 'calendar' ELSE 'autumn-spring' END AS calendar,
         CASE WHEN coalesce(n_players, 0) > 0 THEN '' ELSE 'no CSV exported yet' END AS notes
  FROM (SELECT *, regexp_extract_all(upper(league), '[A-Za-z0-9]+') AS _w FROM raw) CROSS JOIN top)""",
    # ---- Q1 score
    f"""spec AS (
  SELECT * FROM (VALUES
    {_spec_values()}) t(role, ordinal, metric, lower_is_better, volume_metric))""",
    f"""x AS (
  SELECT p.*, lm.league_code, lm.league, lm.country, lm.priority, lm.priority_rank, lm.division, lm.strength
  FROM players p LEFT JOIN league_map lm USING (league_key))""",
    f"""elig AS (
  SELECT *, CASE WHEN strength > {d(-0.1)} AND strength <= {d(15)} THEN 'd'
                 WHEN strength > {d(15)} AND strength <= {d(30)} THEN 'c'
                 WHEN strength > {d(30)} AND strength <= {d(50)} THEN 'b'
                 WHEN strength > {d(50)} AND strength <= {d(101)} THEN 'a' ELSE 'nan' END AS band,
         coalesce(league_code, 'nan') || '|' || role AS league_cell
  FROM x WHERE minutes >= {d(MIN_MINUTES)} AND role IS NOT NULL AND role <> 'NA')""",
    f"""celled AS (
  SELECT *, cell_n < {MIN_CELL} AS thin,
         CASE WHEN cell_n < {MIN_CELL} THEN 'band:' || band || '|' || role ELSE league_cell END AS cell
  FROM (SELECT *, count(*) OVER (PARTITION BY league_cell) AS cell_n FROM elig))""",
    f"""long AS (
  SELECT c.player_id, c.role, c.cell, c.minutes, s.ordinal, s.metric, s.lower_is_better, s.volume_metric,
         {_case_metric('s.metric')} AS value,
         CASE WHEN s.volume_metric IS NOT NULL THEN {_case_metric('s.volume_metric')} END AS volume
  FROM celled c JOIN spec s USING (role))""",
    f"""ranked AS (
  SELECT *, CASE WHEN value IS NOT NULL THEN
           ((rank() OVER (PARTITION BY cell, metric ORDER BY value) - 1)
            + (count(*) OVER (PARTITION BY cell, metric, value) + 1) / {d(2)})
           / count(value) OVER (PARTITION BY cell, metric) END AS _p
  FROM long)""",
    f"""pcts AS (
  SELECT *, CASE WHEN volume_metric IS NOT NULL THEN
           {d(0.5)} + (coalesce(_pf, {d(0.5)}) - {d(0.5)})
             * coalesce(least(greatest(volume * minutes / {d(90)} / {d(MIN_ATTEMPTS)}, {d(0)}), {d(1)}), {d(0)})
         ELSE _pf END AS pct
  FROM (SELECT *, CASE WHEN lower_is_better THEN {d(1)} - _p ELSE _p END AS _pf FROM ranked))""",
    """per AS (
  SELECT player_id, list_reduce(list(pct ORDER BY ordinal) FILTER (WHERE pct IS NOT NULL), lambda a, b: a + b) AS _s,
         count(pct) AS _k, list(""" + rnd("pct * " + d(100), 1) + """ ORDER BY ordinal) AS radar
  FROM pcts GROUP BY player_id)""",
    f"""scored0 AS (
  SELECT c.*, per.radar, CASE WHEN _k > 0 THEN _s / _k END AS raw,
         {rnd('sqrt(least(' + d(1) + ', c.minutes / ' + d(FULL_SEASON) + '))', 3)} AS evidence
  FROM celled c JOIN per USING (player_id))""",
    f"""scored1 AS (
  SELECT *, {rnd('(' + d(0.5) + ' + (coalesce(raw, ' + d(0.5) + ') - ' + d(0.5) + ') * coalesce(least(greatest(evidence, ' + d(0) + '), ' + d(1) + '), ' + d(0) + ')) * ' + d(100), 1)} AS perf_league
  FROM scored0)""",
    f"""scored2 AS (
  SELECT *, CASE WHEN strength IS NOT NULL THEN
           {rnd('((perf_league / ' + d(100) + ') * ' + d(1.0 - LEAGUE_WEIGHT) + ' + (strength / ' + d(100) + ') * ' + d(LEAGUE_WEIGHT) + ') * ' + d(100), 1)}
         END AS perf_adjusted,
         CASE WHEN market_value > 0 THEN market_value END AS market_value_known
  FROM scored1)""",
    """scored AS (
  SELECT * EXCLUDE (market_value, market_value_known), market_value_known AS market_value,
         market_value_known IS NOT NULL AS priced,
         CASE WHEN league_code IS NOT NULL AND perf_league IS NOT NULL THEN
           rank() OVER (PARTITION BY league_code, role ORDER BY perf_league DESC NULLS LAST) END AS rank_in_league,
         CASE WHEN perf_adjusted IS NOT NULL THEN
           rank() OVER (PARTITION BY role ORDER BY perf_adjusted DESC NULLS LAST) END AS rank_overall
  FROM scored2)""",
]


def with_ctes(final: str) -> str:
    """All shared CTEs, then ``final``; a ``final`` starting with ',' adds more CTEs."""
    sep = "" if final.lstrip().startswith(",") else "\n"
    return "WITH " + ",\n".join(CTES) + sep + final


SCORE_COLS = ("player_id, player, role, league_code, cell, thin, minutes, market_value, priced, "
              "raw, evidence, perf_league, perf_adjusted, rank_in_league, rank_overall")

LEAGUE_MAP_COLS = ("league_key, league_code, folder, country, league, priority, priority_rank, division, "
                   "strength, strength_source, latest_season, n_teams, n_players, groups, calendar, notes")

ORACLE = {
    "score": with_ctes(f"SELECT {SCORE_COLS} FROM scored"),
    "role_percentiles": with_ctes(
        "SELECT player_id, role, cell, ordinal, metric, value, volume, pct FROM pcts"),
    "thin_cells": with_ctes(
        "SELECT league_cell, cell, role, cell_n, thin, count(*) AS n_rows FROM celled "
        "GROUP BY league_cell, cell, role, cell_n, thin"),
    "ranks": with_ctes(
        "SELECT player_id, role, league_code, perf_league, perf_adjusted, rank_in_league, rank_overall FROM scored"),
    "shortlist": with_ctes("""
, f AS (SELECT * FROM scored WHERE role = 'AUTOMOBILE'
          AND coalesce(regexp_matches(league, '(?i)nation_1'), false) AND age <= 30 AND priority_rank <= 2),
  flag AS (SELECT max(CASE WHEN perf_adjusted IS NOT NULL THEN 1 ELSE 0 END) AS has_adj FROM f)
SELECT player_id, player, club_season, league, age, minutes, market_value, perf_league, perf_adjusted, evidence
FROM f CROSS JOIN flag
ORDER BY CASE WHEN has_adj = 1 THEN perf_adjusted ELSE perf_league END DESC NULLS LAST, player_id
LIMIT 15"""),
    "league_map": with_ctes(f"SELECT {LEAGUE_MAP_COLS} FROM league_map"),
    "supported_median": with_ctes(
        "SELECT league_key, n_rows, n_positive, mv_median, coverage FROM med"),
    "interpolated_strength": with_ctes(
        "SELECT league_key, mv_median, uefa_raw, interp, raw FROM raw"),
    "monotone_anchors": with_ctes("SELECT ax, ay, anchor_ord FROM anchors"),
}


# ---- quality family (Q4, Q6) ----------------------------------------------
NUMERIC_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(expr: str) -> str:
    s = f"trim(CAST({expr} AS VARCHAR))"
    return f"(CASE WHEN regexp_full_match({s}, '{NUMERIC_RE}') THEN TRY_CAST({s} AS DOUBLE) END)"


def key_part(expr: str) -> str:
    s = f"trim(CAST({expr} AS VARCHAR))"
    n = to_number(expr)
    return (f"coalesce(CASE WHEN {n} IS NOT NULL AND {n} = floor({n}) AND abs({n}) < {d(1e15)} "
            f"THEN CAST(CAST(floor({n}) AS BIGINT) AS VARCHAR) ELSE {s} END, '<NA>')")


def composite_key(cols) -> str:
    return "concat_ws(' | ', " + ", ".join(key_part(c) for c in cols) + ")"


def cells_equal(a: str, b: str) -> str:
    sa, sb = f"CAST({a} AS VARCHAR)", f"CAST({b} AS VARCHAR)"
    na, nb = to_number(a), to_number(b)
    return (f"(CASE WHEN {a} IS NULL AND {b} IS NULL THEN true WHEN {a} IS NULL OR {b} IS NULL THEN false "
            f"ELSE coalesce({sa} = {sb} OR ({na} IS NOT NULL AND {nb} IS NOT NULL AND {na} = {nb}) "
            f"OR trim({sa}) = trim({sb}), false) END)")


SUP_KEY = composite_key(["s_name", "s_nationkey"])
SUP_COLS = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
Q_CTES = [
    """sup_a AS (SELECT * FROM supplier)""",
    """sup_b AS (
  SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_name || ' ' ELSE s_name END AS s_name, s_nationkey,
         CASE WHEN s_suppkey % 7 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal
  FROM supplier WHERE s_suppkey % 13 <> 0)""",
    f"""ka AS (SELECT {SUP_KEY} AS key, * FROM sup_a)""",
    f"""kb AS (SELECT {SUP_KEY} AS key, * FROM sup_b)""",
    """dups AS (SELECT key FROM ka GROUP BY key HAVING count(*) > 1
           UNION SELECT key FROM kb GROUP BY key HAVING count(*) > 1)""",
    """kj AS (
  SELECT ka.key, ka.s_suppkey AS a0, ka.s_acctbal AS a1, kb.s_suppkey AS b0, kb.s_acctbal AS b1
  FROM ka JOIN kb USING (key) WHERE key NOT IN (SELECT key FROM dups))""",
    "kdiff AS (\n" + "\n  UNION ALL\n".join(
        f"  SELECT key, '{c}' AS column_name, CAST(a{i} AS VARCHAR) AS value_a, CAST(b{i} AS VARCHAR) AS value_b "
        f"FROM kj WHERE NOT {cells_equal(f'a{i}', f'b{i}')}"
        for i, c in enumerate(["s_suppkey", "s_acctbal"])) + ")",
    """pa AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, * FROM sup_a)""",
    """pb AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, * FROM sup_b)""",
    "pdiff AS (\n" + "\n  UNION ALL\n".join(
        f"  SELECT 'row ' || CAST(pa.idx AS VARCHAR) AS key, '{c}' AS column_name, CAST(pa.{c} AS VARCHAR) AS value_a, "
        f"CAST(pb.{c} AS VARCHAR) AS value_b FROM pa JOIN pb USING (idx) WHERE NOT {cells_equal('pa.' + c, 'pb.' + c)}"
        for c in SUP_COLS) + ")",
    """halves AS (
  SELECT * FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT * FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey % 10 = 0)""",
]


def with_q(final: str) -> str:
    sep = "" if final.lstrip().startswith(",") else "\n"
    return "WITH " + ",\n".join(Q_CTES) + sep + final


ORACLE.update({
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem "
                      "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "dedup_rows": "SELECT DISTINCT text FROM documents",
    "union_exports": with_q("SELECT * FROM halves"),
    "combine": with_q("SELECT *, row_number() OVER (ORDER BY s_acctbal IS NULL, s_acctbal DESC, s_suppkey) - 1 "
                      "AS row_idx FROM (SELECT DISTINCT * FROM halves)"),
    "diff_keyed": with_q("SELECT * FROM kdiff"),
    "diff_positional": with_q("SELECT * FROM pdiff"),
    "key_membership": with_q(
        "SELECT coalesce(x.key, y.key) AS key, CASE WHEN x.key IS NOT NULL AND y.key IS NOT NULL THEN 'both' "
        "WHEN x.key IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS membership "
        "FROM (SELECT DISTINCT key FROM ka) x FULL OUTER JOIN (SELECT DISTINCT key FROM kb) y ON x.key = y.key"),
    "shape_checks": with_q(
        "SELECT 'rows' AS check_name, CAST((SELECT count(*) FROM sup_a) AS VARCHAR) AS value_a, "
        "CAST((SELECT count(*) FROM sup_b) AS VARCHAR) AS value_b, "
        "(SELECT count(*) FROM sup_a) = (SELECT count(*) FROM sup_b) AS passed "
        "UNION ALL SELECT 'columns', '4', '4', true "
        "UNION ALL SELECT 'column names', 's_suppkey,s_name,s_nationkey,s_acctbal', "
        "'s_suppkey,s_name,s_nationkey,s_acctbal', true"),
    "diff_summary": with_q(
        ", rc AS (SELECT count(*) AS rows_compared FROM kj)\n"
        "SELECT c.column_name, CAST(coalesce(n, 0) AS BIGINT) AS n_different, rows_compared, "
        "coalesce(n, 0) / rows_compared AS share_different "
        "FROM (VALUES ('s_suppkey'), ('s_acctbal')) c(column_name) "
        "LEFT JOIN (SELECT column_name, count(*) AS n FROM kdiff GROUP BY column_name) d USING (column_name) CROSS JOIN rc"),
    "diff_listing": with_q(
        "SELECT *, (SELECT count(*) FROM kdiff) AS n_total FROM kdiff ORDER BY key, column_name LIMIT 500"),
    "preview": with_q(
        "(SELECT 'a' AS side, key, s_acctbal AS value FROM ka ORDER BY s_acctbal DESC NULLS LAST, key LIMIT 5) "
        "UNION ALL (SELECT 'b' AS side, key, s_acctbal AS value FROM kb "
        "ORDER BY s_acctbal DESC NULLS LAST, key LIMIT 5)"),
    "compare_keyed": with_q(f"""
, sup_c AS (SELECT * FROM sup_b UNION ALL SELECT * FROM sup_a WHERE s_suppkey % 11 = 0
            UNION ALL SELECT s_suppkey, s_name || ' new', s_nationkey, s_acctbal FROM sup_a WHERE s_suppkey % 17 = 0),
  kc AS (SELECT {SUP_KEY} AS key, * FROM sup_c),
  twice AS (SELECT key FROM ka GROUP BY key HAVING count(*) > 1 UNION SELECT key FROM kc GROUP BY key HAVING count(*) > 1),
  pairs AS (SELECT ka.s_suppkey AS a0, kc.s_suppkey AS b0, ka.s_acctbal AS a1, kc.s_acctbal AS b1
            FROM ka JOIN kc USING (key) WHERE key NOT IN (SELECT key FROM twice)),
  bad AS (SELECT (SELECT count(*) FROM pairs WHERE NOT {cells_equal('a0', 'b0')})
               + (SELECT count(*) FROM pairs WHERE NOT {cells_equal('a1', 'b1')}) AS n),
  c0(check_name, x, y) AS (
  SELECT 'key unique', (SELECT count(*) FROM (SELECT key FROM ka GROUP BY key HAVING count(*) > 1)),
         (SELECT count(*) FROM (SELECT key FROM kc GROUP BY key HAVING count(*) > 1))
  UNION ALL SELECT 'rows', (SELECT count(*) FROM ka), (SELECT count(*) FROM kc)
  UNION ALL SELECT 'columns', 4, 4
  UNION ALL SELECT 'same keys', (SELECT count(DISTINCT key) FROM ka WHERE key NOT IN (SELECT key FROM kc)),
         (SELECT count(DISTINCT key) FROM kc WHERE key NOT IN (SELECT key FROM ka))
  UNION ALL SELECT 'cells', 2 * (SELECT count(*) FROM pairs), n FROM bad),
  c AS (SELECT *, CASE WHEN check_name IN ('rows', 'columns') THEN x = y WHEN check_name = 'cells' THEN x > 0 AND y = 0
               ELSE x = 0 AND y = 0 END AS passed FROM c0)
SELECT check_name, CAST(x AS VARCHAR) AS value_a, CAST(y AS VARCHAR) AS value_b, passed FROM c
UNION ALL SELECT 'column names', '{",".join(SUP_COLS)}', '{",".join(SUP_COLS)}', true
UNION ALL SELECT 'result', NULL, NULL, (SELECT bool_and(passed) FROM c)"""),
    "compare_positional": with_q(f"""
, c0(check_name, x, y) AS (
  SELECT 'rows', (SELECT count(*) FROM sup_a), (SELECT count(*) FROM sup_b)
  UNION ALL SELECT 'columns', 4, 4
  UNION ALL SELECT 'cells', 4 * (SELECT count(*) FROM pa JOIN pb USING (idx)), (SELECT count(*) FROM pdiff)),
  c AS (SELECT *, CASE WHEN check_name = 'cells' THEN y = 0 AND (SELECT count(*) FROM sup_a) = (SELECT count(*) FROM sup_b)
               ELSE x = y END AS passed FROM c0)
SELECT check_name, CAST(x AS VARCHAR) AS value_a, CAST(y AS VARCHAR) AS value_b, passed FROM c
UNION ALL SELECT 'column names', '{",".join(SUP_COLS)}', '{",".join(SUP_COLS)}', true
UNION ALL SELECT 'result', NULL, NULL, (SELECT bool_and(passed) FROM c)"""),
    "cell_tolerance": with_q(
        "SELECT ka.key, ka.s_acctbal AS value_a, kb.s_acctbal AS value_b, "
        "CASE WHEN ka.s_acctbal IS NULL AND kb.s_acctbal IS NULL THEN true "
        "WHEN ka.s_acctbal IS NULL OR kb.s_acctbal IS NULL THEN false "
        f"ELSE abs(ka.s_acctbal - kb.s_acctbal) < {d(1e-9)} END AS close FROM ka JOIN kb USING (key)"),
})


# ---- Q7 / Q10 / Q8 / aggregates --------------------------------------------
from .sources.fixtures import (FIXTURE_BLOCKS, FIXTURE_CONCEPTS, FIXTURE_LENGTH_EDGES,  # noqa: E402
                               FIXTURE_LENGTH_LABELS, FIXTURE_POOL_ROLES)
from .spec import CANDIDATE_MAX_AGE, RETENTION_FRACTION, TOP_FRACTION  # noqa: E402

_PCT_METRICS = list(dict.fromkeys(m for ms in FIXTURE_CONCEPTS.values() if ms for m in ms)) + ["age"]


def mean_skip_null(exprs) -> str:
    tot = " + ".join(f"coalesce({e}, {d(0)})" for e in exprs)
    cnt = " + ".join(f"CAST({e} IS NOT NULL AS INTEGER)" for e in exprs)
    return f"(CASE WHEN ({cnt}) > 0 THEN ({tot}) / ({cnt}) END)"


def mean_null_zero_x100(exprs) -> str:
    tot = " + ".join(f"coalesce({e}, {d(0)})" for e in exprs)
    return f"(({tot}) / {d(len(exprs))} * {d(100)})"


def guarded_corr(x: str, y: str) -> str:
    f = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    den = f"(stddev_pop({x}) {f} * stddev_pop({y}) {f})"
    return f"(CASE WHEN {den} > 0 THEN covar_pop({x}, {y}) {f} / {den} END)"


def avg_rank(col: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    pv = f"PARTITION BY {part + ', ' if part else ''}{col}"
    return (f"(CASE WHEN {col} IS NOT NULL THEN (rank() OVER ({p}ORDER BY {col}) - 1) "
            f"+ (count(*) OVER ({pv}) + 1) / {d(2)} END)")


def erfc_two_sided(z: str) -> str:
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    import math
    x = f"(abs({z}) / {d(math.sqrt(2.0))})"
    t = f"({d(1)} / ({d(1)} + {d(0.5)} * {x}))"
    poly = d(coef[-1])
    for c in reversed(coef[:-1]):
        poly = f"({d(c)} + {t} * {poly})"
    return f"({t} * exp(-{x} * {x} + {poly}))"


def _band_case(col, edges, labels, other="nan"):
    parts = [f"WHEN {col} > {d(lo)} AND {col} <= {d(hi)} THEN '{lab}'"
             for lo, hi, lab in zip(edges[:-1], edges[1:], labels)]
    return "CASE " + " ".join(parts) + f" ELSE '{other}' END"


R_CTES = [
    f"""pool AS (SELECT * FROM players WHERE role IN ({', '.join(repr(r) for r in FIXTURE_POOL_ROLES)}))""",
    "plong AS (SELECT player_id, m.metric, CASE m.metric " + " ".join(
        f"WHEN '{m}' THEN CAST({m} AS DOUBLE)" for m in _PCT_METRICS) + " END AS value FROM pool CROSS JOIN (VALUES "
    + ", ".join(f"('{m}')" for m in _PCT_METRICS) + ") m(metric))",
    f"""ppct AS (SELECT player_id, metric, {avg_rank('value', 'metric')} / count(value) OVER (PARTITION BY metric) AS pct
  FROM plong)""",
    "pw AS (SELECT player_id, " + ", ".join(
        f"max(pct) FILTER (WHERE metric = '{m}') AS p_{m}" for m in _PCT_METRICS) + " FROM ppct GROUP BY player_id)",
    "concepts AS (SELECT player_id, " + ", ".join(
        (f"{mean_skip_null(['p_' + m for m in ms])} AS {name}" if ms else f"{d(1)} - p_age AS {name}")
        for name, ms in FIXTURE_CONCEPTS.items()) + " FROM pw)",
    f"""cidx AS (SELECT c.*, {mean_null_zero_x100(list(FIXTURE_CONCEPTS))} AS flat_index, p.market_value
  FROM concepts c JOIN pool p USING (player_id))""",
    f"""att AS (SELECT *, CASE WHEN value_index IS NOT NULL THEN rank() OVER (ORDER BY value_index DESC NULLS LAST) END AS assumed_rank,
         CASE WHEN market_value IS NOT NULL THEN rank() OVER (ORDER BY market_value DESC NULLS LAST) END AS actual_rank
  FROM (SELECT *, {rnd('flat_index', 1)} AS value_index FROM cidx))""",
    f"""cand AS (
  SELECT *, coalesce(perf_adjusted, perf_league) AS idx,
         club_now IS NOT NULL AND NOT (club_season IS NOT DISTINCT FROM club_now) AS moved,
         club_now IS NULL OR trim(club_now) = '' AS free
  FROM scored WHERE age <= {d(CANDIDATE_MAX_AGE)} AND minutes IS NOT NULL)""",
    f"""cutv AS (SELECT quantile_cont(idx, {TOP_FRACTION}) AS cut FROM cand)""",
    f"""tt AS (
  SELECT max(cut) AS cut, count(*) FILTER (WHERE idx >= cut) AS n_top,
         count(*) FILTER (WHERE idx >= cut AND moved) AS moved_top,
         count(*) FILTER (WHERE NOT (idx >= cut)) AS n_rest,
         count(*) FILTER (WHERE NOT (idx >= cut) AND moved) AS moved_rest
  FROM cand CROSS JOIN cutv)""",
    f"""tz AS (
  SELECT *, CASE WHEN n_top > 0 AND n_rest > 0 AND se > 0 THEN (p1 - p2) / se END AS z FROM (
    SELECT *, sqrt(pool * ({d(1)} - pool) * ({d(1)} / n_top + {d(1)} / n_rest)) AS se FROM (
      SELECT *, CAST(moved_top AS DOUBLE) / n_top AS p1, CAST(moved_rest AS DOUBLE) / n_rest AS p2,
             (CAST(moved_top AS DOUBLE) + moved_rest) / (CAST(n_top AS DOUBLE) + n_rest) AS pool FROM tt)))""",
    f"""tp AS (SELECT *, {r9('z')} AS z9, {r9(erfc_two_sided('z'))} AS p_value FROM tz)""",
    f"""mvr AS (
  SELECT {guarded_corr('rx', 'ry')} AS rho FROM (
    SELECT {avg_rank('idx')} AS rx, {avg_rank('market_value')} AS ry FROM cand
    WHERE priced AND idx IS NOT NULL AND market_value IS NOT NULL))""",
]


def with_r(final: str) -> str:
    sep = "" if final.lstrip().startswith(",") else "\n"
    return "WITH " + ",\n".join(CTES + R_CTES) + sep + final


_TOP15 = "SELECT *, row_number() OVER (PARTITION BY role ORDER BY idx DESC NULLS LAST, player_id) AS rank FROM cand"

ORACLE.update({
    "global_percentile": with_r(
        "SELECT player_id, price_per_unit, " + avg_rank("price_per_unit")
        + " / count(price_per_unit) OVER () AS pct FROM players"),
    "concept_index": with_r("SELECT player_id, " + ", ".join(FIXTURE_CONCEPTS) + ", flat_index FROM cidx"),
    "block_index": with_r(
        "SELECT player_id, " + ", ".join(f"{mean_skip_null(cs)} AS {b}" for b, cs in FIXTURE_BLOCKS.items())
        + ", " + mean_null_zero_x100([mean_skip_null(cs) for cs in FIXTURE_BLOCKS.values()])
        + " AS block_index FROM cidx"),
    "spearman": with_r(
        f"SELECT count(*) AS n, {r9(guarded_corr('rx', 'ry'))} AS rho FROM ("
        f"SELECT {avg_rank('flat_index')} AS rx, {avg_rank('market_value')} AS ry FROM cidx "
        "WHERE flat_index IS NOT NULL AND market_value IS NOT NULL)"),
    "spearman_no_age": with_r(
        f"SELECT count(*) AS n, {r9(guarded_corr('rx', 'ry'))} AS rho FROM ("
        f"SELECT {avg_rank('v')} AS rx, {avg_rank('market_value')} AS ry FROM ("
        f"SELECT market_value, {mean_null_zero_x100([n for n, ms in FIXTURE_CONCEPTS.items() if ms])} AS v FROM cidx) "
        "WHERE v IS NOT NULL AND market_value IS NOT NULL)"),
    "spearman_within_league": with_r(
        ", lp AS (SELECT player_id, metric, " + avg_rank("value", "league_key, metric")
        + " / count(value) OVER (PARTITION BY league_key, metric) AS pct FROM plong JOIN "
        "(SELECT player_id, league_key FROM pool) USING (player_id)),\n"
        "lw AS (SELECT player_id, " + ", ".join(f"max(pct) FILTER (WHERE metric = '{m}') AS p_{m}" for m in _PCT_METRICS)
        + " FROM lp GROUP BY player_id),\nlc AS (SELECT player_id, " + ", ".join(
            (f"{mean_skip_null(['p_' + m for m in ms])} AS {name}" if ms else f"{d(1)} - p_age AS {name}")
            for name, ms in FIXTURE_CONCEPTS.items()) + " FROM lw),\n"
        f"lx AS (SELECT {mean_null_zero_x100(list(FIXTURE_CONCEPTS))} AS v, market_value FROM lc JOIN pool USING (player_id))\n"
        f"SELECT count(*) AS n, {r9(guarded_corr('rx', 'ry'))} AS rho FROM ("
        f"SELECT {avg_rank('v')} AS rx, {avg_rank('market_value')} AS ry FROM lx "
        "WHERE v IS NOT NULL AND market_value IS NOT NULL)"),
    "retention_blocks": with_r(
        ", bx AS (SELECT player_id, market_value, "
        + mean_null_zero_x100([mean_skip_null(cs) for cs in FIXTURE_BLOCKS.values()]) + f""" AS v FROM cidx),
  rr AS (SELECT *, CAST(floor(count(*) OVER () * {d(RETENTION_FRACTION)}) AS BIGINT) AS k, count(*) OVER () AS n_rows,
         row_number() OVER (ORDER BY v IS NULL, v DESC, player_id) - 1 AS pos_a,
         row_number() OVER (ORDER BY market_value IS NULL, market_value DESC, player_id) - 1 AS pos_b FROM bx),
  rt AS (SELECT *, pos_a < k AND v IS NOT NULL AS top_a, pos_b < k AND market_value IS NOT NULL AS top_b FROM rr)
SELECT max(n_rows) AS n, max(k) AS k, count(*) FILTER (WHERE top_a AND top_b) AS overlap,
       count(*) FILTER (WHERE top_b) AS n_top_b,
       CASE WHEN count(*) FILTER (WHERE top_b) <> 0 THEN count(*) FILTER (WHERE top_a AND top_b) / count(*) FILTER (WHERE top_b) END AS retention
FROM rt"""),
    "price_vs_league_median": with_r(f"""
, pp AS (SELECT league_key, market_value FROM players WHERE market_value > 0),
  pm AS (SELECT pp.market_value, m.v FROM pp LEFT JOIN
    (SELECT league_key, quantile_cont(market_value, 0.5) AS v FROM pp GROUP BY league_key) m USING (league_key))
SELECT count(*) FILTER (WHERE v IS NOT NULL AND market_value IS NOT NULL) AS n, {r9(guarded_corr('v', 'market_value'))} AS r FROM pm"""),
    "pearson": with_r(
        "SELECT count(*) FILTER (WHERE price_per_unit IS NOT NULL AND market_value IS NOT NULL) AS n, "
        f"{r9(guarded_corr('price_per_unit', 'market_value'))} AS r FROM players"),
    "corr_matrix": with_r("\nUNION ALL\n".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r9(guarded_corr(a, b))} AS r FROM cidx"
        for a in FIXTURE_CONCEPTS for b in FIXTURE_CONCEPTS)),
    "corr_with": with_r("\nUNION ALL\n".join(
        f"SELECT '{a}' AS column_name, {r9(guarded_corr(a, 'flat_index'))} AS r FROM cidx" for a in FIXTURE_CONCEPTS)),
    "retention": with_r(f"""
, rr AS (SELECT *, CAST(floor(count(*) OVER () * {d(RETENTION_FRACTION)}) AS BIGINT) AS k, count(*) OVER () AS n_rows,
         row_number() OVER (ORDER BY flat_index IS NULL, flat_index DESC, player_id) - 1 AS pos_a,
         row_number() OVER (ORDER BY market_value IS NULL, market_value DESC, player_id) - 1 AS pos_b FROM cidx),
  rt AS (SELECT *, pos_a < k AND flat_index IS NOT NULL AS top_a, pos_b < k AND market_value IS NOT NULL AS top_b FROM rr)
SELECT max(n_rows) AS n, max(k) AS k, count(*) FILTER (WHERE top_a AND top_b) AS overlap,
       count(*) FILTER (WHERE top_b) AS n_top_b,
       CASE WHEN count(*) FILTER (WHERE top_b) <> 0 THEN count(*) FILTER (WHERE top_a AND top_b) / count(*) FILTER (WHERE top_b) END AS retention
FROM rt"""),
    "top_by_value": with_r(
        "SELECT player_id, market_value, value_index, assumed_rank, actual_rank FROM att "
        "ORDER BY market_value DESC NULLS LAST, player_id LIMIT 15"),
    "rank_zip": with_r(f"""
, za AS (SELECT row_number() OVER (ORDER BY value_index DESC NULLS LAST, player_id) AS rank, player_id AS a_player_id,
         value_index AS a_value_index, {rnd('market_value / ' + d(1e6), 1)} AS a_mv_m, actual_rank AS a_actual_rank FROM att
         QUALIFY rank <= 15),
  zb AS (SELECT row_number() OVER (ORDER BY market_value DESC NULLS LAST, player_id) AS rank, player_id AS b_player_id,
         {rnd('market_value / ' + d(1e6), 1)} AS b_mv_m FROM att QUALIFY rank <= 15)
SELECT coalesce(za.rank, zb.rank) AS rank, a_player_id, a_value_index, a_mv_m, a_actual_rank, b_player_id, b_mv_m
FROM za FULL OUTER JOIN zb ON za.rank = zb.rank"""),
    "club_status": with_r(
        "SELECT player_id, club_season, club_now, "
        "club_now IS NOT NULL AND NOT (club_season IS NOT DISTINCT FROM club_now) AS moved, "
        "club_now IS NULL OR trim(club_now) = '' AS free FROM players"),
    "quantile_cut": with_r(f"SELECT {r9('cut')} AS cut, n_top, n_rest FROM tt"),
    "two_proportion": with_r("SELECT moved_top, n_top, moved_rest, n_rest, z9 AS z, p_value FROM tp"),
    "validation": with_r(f"""SELECT n_top AS "nTop",
  CASE WHEN n_top > 0 THEN {rnd(d(100) + ' * moved_top / n_top', 1)} END AS "movedTop",
  CASE WHEN n_rest > 0 THEN {rnd(d(100) + ' * moved_rest / n_rest', 1)} END AS "movedRest",
  {rnd('p_value', 3)} AS "pValue", {rnd('rho', 2)} AS "mvCorr",
  (SELECT count(*) FILTER (WHERE priced) FROM cand) AS "nWithMv",
  (SELECT {rnd(d(100) + ' * (count(*) - count(*) FILTER (WHERE priced)) / count(*)', 1)} FROM cand) AS "pctNoMv"
FROM tp CROSS JOIN mvr"""),
    "quintile_rate": with_r("""
, qs AS (SELECT *, CAST(ceil(5 * (row_number() OVER (ORDER BY idx, player_id)) / count(*) OVER ()) - 1 AS INTEGER) AS slice
         FROM cand WHERE idx IS NOT NULL)
SELECT slice, count(*) AS n, """ + d(100) + """ * count(*) FILTER (WHERE moved) / count(*) AS pct_moved FROM qs GROUP BY slice"""),
    "concentration_alert": with_r(f"""
, t15 AS (SELECT * FROM ({_TOP15}) WHERE rank <= 15),
  cc AS (SELECT role, country, count(*) AS n_country FROM t15 GROUP BY role, country),
  best AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY role ORDER BY n_country DESC, country) = 1),
  sizes AS (SELECT role, count(*) AS n_top FROM t15 GROUP BY role),
  cpool AS (SELECT country, count(*) AS n_pool FROM cand GROUP BY country),
  total AS (SELECT count(*) AS n_all FROM cand),
  res AS (SELECT b.role, b.country, b.n_country, s.n_top,
                 CAST(floor({d(100)} * b.n_country / s.n_top + {d(0.5)}) AS BIGINT) AS got,
                 CAST(floor({d(100)} * p.n_pool / t.n_all + {d(0.5)}) AS BIGINT) AS expect
          FROM best b JOIN sizes s USING (role) LEFT JOIN cpool p USING (country) CROSS JOIN total t)
SELECT *, (got - expect) >= 20 AS alert FROM res"""),
    "top_per_group": with_r(f"SELECT role, rank, player_id, idx FROM ({_TOP15}) WHERE rank <= 15"),
    "payload": with_r(f"""SELECT player_id, player AS name, club_season AS team, club_now AS "clubNow", moved, free,
  league, country, role AS "group", role AS pos, CAST(trunc(age) AS INTEGER) AS age,
  CAST(trunc(minutes) AS INTEGER) AS "min", market_value AS mv, {rnd('idx', 1)} AS idx, radar FROM cand"""),
    "radar": with_ctes("\nSELECT player_id, CAST(ordinal AS INTEGER) AS ordinal, " + rnd("pct * " + d(100), 1) + " AS value FROM pcts"),
    "money_label": f"""SELECT c_custkey, c_acctbal * 1000 AS value,
  CASE WHEN c_acctbal * 1000 IS NULL THEN '—'
       WHEN c_acctbal * 1000 >= {d(1e6)} THEN
         regexp_replace(printf('%.1f', floor(c_acctbal * 1000 / {d(1e5)} + {d(0.5)}) / {d(10)}), '\\.0$', '') || ' M€'
       ELSE CAST(CAST(floor(c_acctbal * 1000 / {d(1000)} + {d(0.5)}) AS BIGINT) AS VARCHAR) || ' k€' END AS label
FROM customer""",
    "run_summary": with_r(
        "SELECT count(*) AS n_rows, count(DISTINCT league_code) AS n_leagues, count(DISTINCT role) AS n_roles, "
        "count(*) FILTER (WHERE priced) AS n_priced, count(*) FILTER (WHERE NOT priced) AS n_unpriced FROM scored"),
    "distinct_leagues": with_r("SELECT DISTINCT league AS name, country AS code FROM cand"),
    "role_profile": with_r(
        f"SELECT role, count(*) AS players, {rnd('avg(age)', 0)} AS mean_age, "
        f"{rnd('avg(minutes)', 0)} AS mean_minutes FROM scored GROUP BY role"),
    "group_size": with_r("SELECT role, count(*) AS n FROM players GROUP BY role"),
    "value_shares": "SELECT o_orderpriority, count(*) AS n, count(*) / (SELECT count(*) FROM orders) AS share "
                    "FROM orders GROUP BY o_orderpriority",
    "value_concentration": """SELECT count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_rows,
  CAST(sum(n) FILTER (WHERE pos < 6) AS BIGINT) AS n_top, sum(n) FILTER (WHERE pos < 6) / sum(n) AS share_top
FROM (SELECT p_size, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_size) - 1 AS pos
      FROM part WHERE p_size IS NOT NULL GROUP BY p_size)""",
    "rate_by_band": f"""SELECT {_band_case('n_chars', FIXTURE_LENGTH_EDGES, FIXTURE_LENGTH_LABELS)} AS group_value,
  count(*) AS n, avg(CASE WHEN coalesce(quality = 1, false) THEN {d(1)} ELSE {d(0)} END) AS rate
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY group_value""",
    "rate_range": f"""SELECT count(*) AS n_groups, min(rate) AS min_rate, max(rate) AS max_rate FROM (
  SELECT lang, avg(CASE WHEN coalesce(toxic = 1, false) THEN {d(1)} ELSE {d(0)} END) AS rate
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang)""",
})


# ---- roles, latest per key, verification, registry, catalogue ------------------
from .functions.text import FOLDER_RE  # noqa: E402
from .sources.fixtures import FIXTURE_ROLE_OF_EVENT  # noqa: E402

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_ROLE_CASE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FIXTURE_ROLE_OF_EVENT.items()) + " END"
TIMEFRAME = "1998/1999"


def safe_name_sql(e: str) -> str:
    ill = '<>:"/\\|?*'
    return f"regexp_replace(trim(translate({e}, '{ill}', '{'-' * len(ill)}')), '\\.+$', '')"


def league_code_sql(country: str, league: str) -> str:
    return (f"({country} || '_' || left(array_to_string(list_transform(regexp_extract_all(upper({league}), "
            f"'[A-Za-z0-9]+'), lambda x: CASE WHEN len(regexp_extract_all(upper({league}), '[A-Za-z0-9]+')) = 1 "
            f"THEN left(x, 5) ELSE left(x, 1) || regexp_replace(x, '[^0-9]', '', 'g') END), ''), 7))")


M_CTES = [
    """evf AS (SELECT user_id, event_type, ts, event_id,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)""",
    """upos AS (SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id, event_type) AS position
         FROM evf WHERE rn = 1 GROUP BY user_id)""",
    f"""uroles AS (SELECT user_id, position, {_STRIP.format("split_part(position, ',', 1)")} AS first_pos FROM upos)""",
    f"""uassigned AS (SELECT *, CASE WHEN position IS NULL THEN 'NA' WHEN first_pos = '' THEN NULL
                                   ELSE {_ROLE_CASE.format('first_pos')} END AS role FROM uroles)""",
    """sfound AS (
  SELECT n_name AS folder, n_nationkey, CASE WHEN n_nationkey % 9 <> 4 AND n_nationkey % 12 <> 5 THEN s._s END AS n_rows,
         CASE WHEN n_nationkey % 12 = 5 THEN 0 ELSE coalesce(c._c, 0) END AS n_parts
  FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS _s FROM supplier GROUP BY s_nationkey) s ON n_nationkey = s_nationkey
  LEFT JOIN (SELECT c_nationkey, count(*) AS _c FROM customer GROUP BY c_nationkey) c ON n_nationkey = c_nationkey)""",
    """slisting AS (
  SELECT folder, CASE WHEN n_nationkey % 8 = 7 THEN 'SIZE.txt'
                      ELSE CAST(coalesce(n_rows, 0) + CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) || '.txt' END AS file_name
  FROM sfound
  UNION ALL SELECT folder, 'old_' || CAST(coalesce(n_rows, 0) AS VARCHAR) || '.txt' FROM sfound WHERE n_nationkey % 11 = 10
  UNION ALL SELECT folder, 'notes.md' FROM sfound WHERE n_nationkey % 2 = 0)""",
    """sexp AS (
  SELECT folder, CASE WHEN n_numbered = 1 THEN _value END AS expected,
         CASE WHEN n_numbered = 0 THEN 'no numbered .txt (found ' || _all || ')'
              WHEN n_numbered > 1 THEN 'several numbered .txt: ' || _numbered END AS reason
  FROM (SELECT folder, count(*) AS n_txt, count(*) FILTER (WHERE _num <> '') AS n_numbered,
               max(CASE WHEN _num <> '' THEN CAST(_num AS BIGINT) END) AS _value,
               array_to_string(list_sort(list(file_name)), ', ') AS _all,
               coalesce(array_to_string(list_sort(list(file_name) FILTER (WHERE _num <> '')), ', '), '') AS _numbered
        FROM (SELECT *, regexp_extract(regexp_replace(file_name, '\\.txt$', ''), '(\\d+)', 1) AS _num
              FROM slisting WHERE suffix(file_name, '.txt'))
        GROUP BY folder))""",
    """sver AS (
  SELECT f.folder, f.n_rows, f.n_parts, e.expected,
         CASE WHEN e.expected IS NULL THEN coalesce(e.reason, 'no .txt with the expected count') END AS reason,
         CASE WHEN f.n_rows IS NULL AND f.n_parts = 0 THEN 'EMPTY' WHEN f.n_rows IS NULL THEN 'NO_CSV'
              WHEN e.expected IS NULL THEN 'FAIL' WHEN e.expected <> f.n_rows THEN 'FAIL' ELSE 'OK' END AS status,
         CASE WHEN f.n_rows IS NULL AND f.n_parts = 0 THEN 'no parts and no merged export - nothing exported yet'
              WHEN f.n_rows IS NULL THEN printf('%d parts present but no merged export', f.n_parts)
              WHEN e.expected IS NULL THEN printf('%d rows but %s', f.n_rows, coalesce(e.reason, 'no .txt with the expected count'))
              WHEN e.expected <> f.n_rows THEN printf('merged export has %d rows, expected %d (%+d)', f.n_rows, e.expected, f.n_rows - e.expected)
              ELSE printf('%d rows', f.n_rows) END AS message
  FROM sfound f LEFT JOIN sexp e USING (folder))""",
    """regrows AS (
  SELECT CASE WHEN r_regionkey <= 1 THEN 'green' WHEN r_regionkey <= 3 THEN 'yellow' ELSE 'red' END AS tier,
         upper(substr(r_name, 1, 3)) AS code, r_regionkey AS row_ord, n_name AS league,
         row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS pos
  FROM region JOIN nation ON n_regionkey = r_regionkey)""",
    f"""reg_all AS (
  SELECT *, {safe_name_sql("printf('%d - [%s] - (%s)', num, code, league)")} AS folder FROM (
    SELECT *, row_number() OVER (ORDER BY CASE tier WHEN 'green' THEN 1 WHEN 'yellow' THEN 2 ELSE 3 END, row_ord, pos) AS num
    FROM regrows))""",
    f"""reg_gy AS (
  SELECT *, {safe_name_sql("printf('%d - [%s] - (%s)', num, code, league)")} AS folder FROM (
    SELECT *, row_number() OVER (ORDER BY CASE tier WHEN 'green' THEN 1 WHEN 'yellow' THEN 2 ELSE 3 END, row_ord, pos) AS num
    FROM regrows WHERE tier IN ('green', 'yellow')))""",
    """nyears AS (SELECT DISTINCT c_nationkey, CAST(year(o_orderdate) AS BIGINT) AS y
                FROM orders JOIN customer ON o_custkey = c_custkey)""",
    """catflat AS (
  SELECT r_name AS area, CAST(n_nationkey AS BIGINT) AS competition_id, n_name AS competition,
         y AS season_id, CASE WHEN y IS NOT NULL THEN printf('%d/%d', y, y + 1) END AS season,
         r_regionkey * 100000 + (dense_rank() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1) AS cat_ord
  FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN nyears ON c_nationkey = n_nationkey)""",
    """cats AS (SELECT DISTINCT area, competition_id AS id, competition AS name, cat_ord FROM catflat)""",
    """scopes AS (
  SELECT DISTINCT scope FROM (
    SELECT r_name || '. ' || n_name AS scope FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'EUROPE. ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 0
    UNION ALL SELECT r_name || '. NATIONAL_' || CAST(n_nationkey AS VARCHAR) FROM nation JOIN region ON n_regionkey = r_regionkey
              WHERE n_nationkey % 5 = 0))""",
    """sparts AS (
  SELECT scope,
         trim(CASE WHEN regexp_matches(scope, '^(.*?)\\. (.*)$') THEN regexp_extract(scope, '^(.*?)\\. (.*)$', 1) ELSE scope END) AS _area,
         trim(CASE WHEN regexp_matches(scope, '^(.*?)\\. (.*)$') THEN regexp_extract(scope, '^(.*?)\\. (.*)$', 2) ELSE '' END) AS _league
  FROM scopes)""",
    """resolved AS (
  SELECT s.scope, c.id AS competition_id,
         CASE WHEN c.id IS NULL THEN 0 WHEN position(lower(s._area) IN lower(coalesce(c.area, ''))) > 0 THEN 2 ELSE 1 END AS _q,
         c.cat_ord
  FROM sparts s LEFT JOIN cats c ON lower(c.name) = lower(s._league)
  QUALIFY row_number() OVER (PARTITION BY s.scope ORDER BY _q DESC, c.cat_ord NULLS LAST) = 1)""",
    f"""resolved2 AS (
  SELECT r.scope, CASE WHEN f.season_id IS NOT NULL THEN r.competition_id END AS competition_id, f.season_id,
         CASE WHEN f.season_id IS NOT NULL THEN 'season' WHEN r.competition_id IS NOT NULL THEN 'no season' END AS season_status,
         CASE r._q WHEN 2 THEN 'area' WHEN 1 THEN 'name' ELSE 'none' END AS match
  FROM resolved r LEFT JOIN catflat f ON f.competition_id = r.competition_id AND f.season = '{TIMEFRAME}')""",
]


def with_m(final: str) -> str:
    sep = "" if final.lstrip().startswith(",") else "\n"
    return "WITH " + ",\n".join(CTES + M_CTES) + sep + final


ORACLE.update({
    "assign_role": with_m("SELECT user_id, position, first_pos, role FROM uassigned"),
    "unmapped_codes": with_m("SELECT first_pos AS code, count(*) AS n FROM uassigned WHERE role IS NULL GROUP BY first_pos"),
    "role_default": with_m(
        f"SELECT user_id, coalesce({_ROLE_CASE.format('CASE WHEN position IS NULL THEN ' + chr(39) + 'NA' + chr(39) + ' ELSE first_pos END')}, 'MID') AS role FROM uroles"),
    "latest_per_key": """SELECT o_custkey, o_orderkey, season, has_data FROM (
  SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderstatus <> 'P' AS has_data FROM orders)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY season DESC, has_data DESC,
                           CASE WHEN has_data THEN o_orderkey ELSE -o_orderkey END) = 1""",
    "verify_season": with_m("SELECT folder, n_rows, n_parts, expected, reason, status, message FROM sver"),
    "expected_counts": with_m("SELECT folder, expected, reason FROM sexp"),
    "status_rollup": with_m(
        "SELECT status, count(*) AS n_folders, CAST(sum(CASE WHEN status = 'OK' THEN n_rows ELSE 0 END) AS BIGINT) AS n_rows_ok "
        "FROM sver GROUP BY status"),
    "reconcile_counts": with_m(
        "SELECT coalesce(f.folder, e.folder) AS folder, f.n_rows, e.expected, f.n_rows - e.expected AS difference "
        "FROM sfound f FULL OUTER JOIN sexp e ON f.folder = e.folder"),
    "registry": with_m(
        f"""SELECT CAST(num AS INTEGER) AS num, folder, tier, code, league,
  CASE WHEN regexp_matches(folder, '{FOLDER_RE}') THEN CAST(regexp_extract(folder, '{FOLDER_RE}', 1) AS INTEGER) END AS parsed_num,
  CASE WHEN regexp_matches(folder, '{FOLDER_RE}') THEN upper(regexp_extract(folder, '{FOLDER_RE}', 2)) ELSE '' END AS parsed_code,
  CASE WHEN regexp_matches(folder, '{FOLDER_RE}') THEN regexp_extract(folder, '{FOLDER_RE}', 3) ELSE folder END AS parsed_league
FROM reg_gy"""),
    "code_order": with_m("SELECT code, CAST(min(num) AS INTEGER) AS first_num FROM reg_all GROUP BY code"),
    "league_code": "SELECT p_partkey, "
                   + league_code_sql("('B' || regexp_extract(p_brand, '(\\d+)', 1))", "concat_ws(' ', p_name, CAST(p_size AS VARCHAR))")
                   + " AS code_name, "
                   + league_code_sql("('B' || regexp_extract(p_brand, '(\\d+)', 1))", "p_type")
                   + " AS code_type FROM part",
    "safe_name": "SELECT p_partkey, " + safe_name_sql("p_brand || '/' || p_name || ' ' || p_type || '.'") + " AS safe FROM part",
    "natural_order": """SELECT n_name, row_number() OVER (ORDER BY lower(regexp_extract(n_name, '^(\\D*)', 1)),
  coalesce(TRY_CAST(regexp_extract(n_name, '(\\d+)', 1) AS BIGINT), -1),
  lower(regexp_replace(n_name, '^\\D*\\d*', '')), n_nationkey) - 1 AS ord FROM nation""",
    "slug": f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
  strip_accents(text), '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug
FROM documents""",
    "source_split": with_m("SELECT split_part(strength_source, ' ', 1) AS source, count(*) AS n FROM league_map GROUP BY source"),
    "catalogue_flatten": with_m("SELECT area, competition_id, competition, season_id, season, CAST(cat_ord // 100000 AS BIGINT) AS doc_ord, CAST(cat_ord % 100000 AS BIGINT) AS comp_pos FROM catflat"),
    "catalogue_resolve": with_m("SELECT scope, competition_id, season_id, season_status, match FROM resolved2"),
    "suggest": with_m("""
, unres AS (SELECT scope, _league FROM resolved2 JOIN sparts USING (scope) WHERE match = 'none')
SELECT scope, rank, suggestion FROM (
  SELECT u.scope, c.area || '. ' || c.name AS suggestion,
         row_number() OVER (PARTITION BY u.scope ORDER BY c.cat_ord) AS rank
  FROM unres u JOIN cats c ON position(substr(lower(u._league), 1, 6) IN lower(c.name)) > 0)
WHERE rank <= 8"""),
})


# ---- file sources over the export tree written from supplier ----------------------
_NATION_FOLDER = "printf('%d - [%s] - (%s)', n_nationkey + 1, upper(substr(r_name, 1, 3)), n_name)"
_EXP = f"""sx AS (
  SELECT {_NATION_FOLDER} AS folder, upper(substr(r_name, 1, 3)) AS country, n_name AS league, n_nationkey AS k,
         s_suppkey, s_acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_HDR = """CASE WHEN k % 6 = 5 THEN '' WHEN k % 4 = 1 THEN 'Team' ELSE '' END AS missing,
         CASE WHEN k % 6 = 5 THEN 'Extra, %' ELSE '' END AS extra,
         NOT (k % 6 = 5 OR (k % 4 = 1 AND k % 6 <> 5)) AS ok"""


def _export_rows(strict: bool) -> str:
    cond = "WHERE NOT (k % 6 = 5 OR (k % 4 = 1 AND k % 6 <> 5))" if strict else ""
    return (f"WITH {_EXP} SELECT folder, country, league, '2025-2026' AS season, count(*) AS n_rows, "
            f"count(*) FILTER (WHERE k % 6 = 5 OR NOT (k % 4 = 1)) AS n_team, "
            f"CAST(sum(s_suppkey) AS DOUBLE) AS key_sum, max(s_acctbal) AS max_value FROM sx {cond} "
            f"GROUP BY folder, country, league")


ORACLE.update({
    "header_report": f"WITH {_EXP} SELECT folder, {_HDR}, count(DISTINCT 1) AS n_files FROM (SELECT DISTINCT folder, k FROM sx) "
                     "GROUP BY ALL",
    "strict_gate": _export_rows(True),
    "conform": _export_rows(False),
    "missing_exports": f"SELECT {_NATION_FOLDER} AS folder FROM nation JOIN region ON n_regionkey = r_regionkey "
                       "WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) "
                       "UNION ALL SELECT printf('%d - [%s] - (planned)', r_regionkey + 100, upper(substr(r_name, 1, 3))) FROM region",
    "part_schema_check": f"WITH {_EXP} SELECT DISTINCT folder, CAST(2 AS BIGINT) AS n_headers FROM sx "
                         "WHERE k % 4 = 1 OR k % 6 = 5 OR k % 5 = 3",
})


ORACLE.update({
    "group_median": with_ctes("""
, pp AS (SELECT player_id, league_key, market_value FROM players WHERE market_value > 0)
SELECT pp.*, m.league_median FROM pp LEFT JOIN
  (SELECT league_key, quantile_cont(market_value, 0.5) AS league_median FROM pp GROUP BY league_key) m USING (league_key)"""),
    "canonical_order": "SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (ORDER BY s_nationkey, "
                       "s_acctbal IS NULL, s_acctbal DESC, s_suppkey) - 1 AS ord FROM supplier",
    "column_diff": """SELECT * FROM (VALUES
  ('s_suppkey', 0, 1, 'both', false), ('s_name', 1, 0, 'both', false), ('s_nationkey', 2, 3, 'both', false),
  ('s_acctbal', 3, NULL, 'only_a', false), ('balance', NULL, 2, 'only_b', false))
  t(column_name, pos_a, pos_b, side, same_position)""",
})


ORACLE.update({
    "diff_by_digest": with_q("SELECT * FROM kdiff"),
    "diff_stored": "SELECT CAST(o_orderkey AS VARCHAR) AS key, 'o_orderstatus' AS column_name, o_orderstatus AS value_a, 'X' AS value_b "
                   "FROM orders WHERE o_orderkey % 997 = 3 AND o_orderkey % 1009 <> 7 AND o_orderstatus <> 'X'",
    "merge_counts": with_q("SELECT (SELECT count(*) FROM halves) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM halves)) AS rows_after, "
                           "(SELECT count(*) FROM halves) - (SELECT count(*) FROM (SELECT DISTINCT * FROM halves)) AS removed"),
    "publish_merge": "SELECT s_nationkey, count(*) AS n_rows, CAST(sum(s_suppkey) AS BIGINT) AS key_sum FROM supplier WHERE s_nationkey % 7 <> 3 GROUP BY s_nationkey",
    "publish_manifest": "SELECT s_nationkey AS league, count(*) AS n_rows, count(*) + CASE WHEN s_nationkey % 7 = 3 THEN 1 ELSE 0 END AS expected, "
                        "CASE WHEN s_nationkey % 7 = 3 THEN 'mismatch' ELSE 'published' END AS status FROM supplier GROUP BY s_nationkey",
    "newest_season": """WITH x AS (
  SELECT c_nationkey AS league, year(o_orderdate) AS y, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) <= 1998 - c_nationkey % 4),
newest AS (SELECT league, max(y) AS y FROM x GROUP BY league)
SELECT CAST(league AS BIGINT) AS league, printf('%d-%d', y, y + 1) AS latest_season, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers,
       CAST(sum(cents) AS BIGINT) AS cents
FROM x JOIN newest USING (league, y) GROUP BY league, y""",
    "running_total": """SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS total,
       max(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS highest
FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""",
    "asof_balance": """SELECT c_custkey, max(s_acctbal) FILTER (WHERE s_acctbal <= c_acctbal) AS below, min(s_acctbal) FILTER (WHERE s_acctbal > c_acctbal) AS above
FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey GROUP BY c_custkey""",
    "corr_wide": f"""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT 'd' || p.i AS a, 'd' || q.i AS b, {r9('corr(p.v, q.v)')} AS r FROM x p JOIN x q ON p.vec_id = q.vec_id GROUP BY p.i, q.i""",
    # the eigenvalues' squares add up to the squares of all correlations of the filled columns
    "pca_moments": with_r(", f AS (SELECT " + ", ".join(f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in FIXTURE_CONCEPTS) + " FROM cidx)\n"
                          f"SELECT CAST({len(FIXTURE_CONCEPTS)} AS BIGINT) AS n, {d(1)} AS total, "
                          + r9("(" + d(len(FIXTURE_CONCEPTS)) + " + 2 * (" + " + ".join(
                              f"pow({guarded_corr(a, b)}, 2)" for i, a in enumerate(FIXTURE_CONCEPTS) for b in list(FIXTURE_CONCEPTS)[i + 1:])
                              + f")) / {d(len(FIXTURE_CONCEPTS) ** 2)}") + " AS squares FROM f"),
    "write_merged": "SELECT '2025-2026' AS season, printf('N%02d', s_nationkey) AS league_code, count(*) AS n_rows, CAST(sum(s_suppkey) AS BIGINT) AS key_sum "
                    "FROM supplier GROUP BY s_nationkey",
    "read_table": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part",
    "load_league_map": with_ctes("\nSELECT league_code, league, CAST(priority_rank AS INTEGER) AS priority_rank, division, strength, CAST(n_teams AS INTEGER) AS n_teams, "
                                 "CAST(n_players AS INTEGER) AS n_players, (SELECT count(*) FROM league_map WHERE strength IS NULL) AS n_without_strength FROM league_map"),
})
