"""Binding of the driver's TPC-H-style tables to the engine's schemas.

* ``players``: one row per customer that has line items. A customer is a
  player, its nation the league, its market segment the role, its account
  balance the market value and its ordered quantity the minutes played.
* ``leagues``: one row per nation with the inputs of the league-map build.

Lineitem is pre-aggregated to one row per order before it meets ``orders``,
so the big join carries a quarter of the rows, and every per-customer figure
is a plain sum or count (no distinct aggregate). Prices and discounts carry
two decimals and are summed as whole cents (exact integer sums), so the
figures do not depend on the order in which partial sums meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import safe_div
from ..session import materialize, table
from ..spec import MetricSpec

# ---------------------------------------------------------------------------
# FIXED VALUES of the binding (documented in FIXTURES.md section 3).
# ---------------------------------------------------------------------------
# Metric spec per market segment: each segment scores its own subset, in this order.
FIXTURE_ROLE_METRICS = {
    "AUTOMOBILE": ["orders_per90", "price_per_unit", "discount_avg", "returned_pct", "urgent_pct"],
    "BUILDING": ["price_per_unit", "discount_avg", "urgent_pct"],
    "FURNITURE": ["orders_per90", "returned_pct", "urgent_pct"],
    "HOUSEHOLD": ["orders_per90", "price_per_unit", "discount_avg", "urgent_pct"],
    "MACHINERY": ["price_per_unit", "returned_pct", "discount_avg", "orders_per90"],
}
FIXTURE_LOWER_IS_BETTER = {"discount_avg"}
FIXTURE_VOLUME_OF = {"returned_pct": "lines_per90", "urgent_pct": "orders_per90"}
FIXTURE_ROLE_LABEL = {"AUTOMOBILE": "Automobile", "BUILDING": "Building", "FURNITURE": "Furniture",
                      "HOUSEHOLD": "Household", "MACHINERY": "Machinery"}
FIXTURE_METRICS = ["orders_per90", "lines_per90", "price_per_unit", "returned_pct",
                   "discount_avg", "urgent_pct"]
# League dimension rule: coefficient only for regions 0..2; priority by region.
FIXTURE_PRIORITY_OF_REGION = {0: "green", 1: "green", 2: "yellow", 3: "yellow", 4: "red"}
FIXTURE_CALENDAR_YEAR = {"AME", "ASI"}
FIXTURE_APERTURA = {"MID"}
FIXTURE_SEASON = "2025-2026"
# Concepts of the flat index (Q7): metrics averaged in a concept, concepts
# averaged into the index; the age concept is the inverted age percentile.
FIXTURE_CONCEPTS = {
    "c_ordering": ["orders_per90", "lines_per90"],
    "c_value": ["price_per_unit"],
    "c_care": ["returned_pct", "discount_avg"],
    "c_urgency": ["urgent_pct"],
    "c_minutes": ["minutes"],
    "c_age": None,
}
FIXTURE_BLOCKS = {"b_activity": ["c_ordering", "c_minutes"],
                  "b_quality": ["c_value", "c_care", "c_urgency"],
                  "b_age": ["c_age"]}
FIXTURE_POOL_ROLES = ["AUTOMOBILE", "BUILDING", "MACHINERY"]
# Position-code dictionary of the events binding (P1): event type -> role.
FIXTURE_ROLE_OF_EVENT = {"click": "BROWSE", "view": "BROWSE", "purchase": "BUY", "signup": "JOIN"}
# Document length bands (P6 on n_chars) for the rate-by-band query.
FIXTURE_LENGTH_EDGES = [0, 1000, 5000, 20000, 1000000000]
FIXTURE_LENGTH_LABELS = ["short", "medium", "long", "very long"]
# ---------------------------------------------------------------------------

FIXTURE_METRIC_LABEL = {"orders_per90": "Orders /90", "lines_per90": "Lines /90", "price_per_unit": "Price per unit",
                        "returned_pct": "Returned", "discount_avg": "Discount", "urgent_pct": "Urgent"}
FIXTURE_SPEC = MetricSpec(FIXTURE_ROLE_METRICS, set(FIXTURE_LOWER_IS_BETTER), dict(FIXTURE_VOLUME_OF),
                          labels=FIXTURE_METRIC_LABEL, role_labels=FIXTURE_ROLE_LABEL)


def _club_past(custkey, nationkey):
    return F.when(custkey % 17 != 0, F.concat(F.lit("CLUB_"), nationkey.cast("string")))


def _club_now(custkey, nationkey, past):
    return (F.when(custkey % 11 == 0, F.lit(None).cast("string"))
             .when(custkey % 13 == 0, F.lit(""))
             .when(custkey % 5 == 0, F.concat(F.lit("CLUB_"), (nationkey + 1).cast("string")))
             .otherwise(past))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items pre-aggregated per order, joined to the order header."""
    li = (table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("n_lines"),
               F.sum("l_quantity").alias("qty"),
               F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("price_cents"),
               F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
               F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("discount_cents")))
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return li.join(o, li.l_orderkey == o.o_orderkey, "inner")


def players(spark: SparkSession, sf_dir: str, cut: bool = True) -> DataFrame:
    """One row per customer with line items (FIXTURES.md 3.1).

    The lineitem aggregation is the expensive part and every plan reads the
    players more than once, so by default the result is checkpointed.
    """
    per_cust = (order_facts(spark, sf_dir)
                .groupBy("o_custkey")
                .agg(F.count(F.lit(1)).alias("n_orders"),
                     F.sum("n_lines").alias("n_lines"),
                     F.sum("qty").alias("minutes"),
                     F.sum("price_cents").alias("price_cents"),
                     F.sum("n_returned").alias("n_returned"),
                     F.sum("discount_cents").alias("discount_cents"),
                     F.count_if("urgent").alias("n_urgent")))
    c = table(spark, sf_dir, "customer")
    j = c.join(per_cust, c.c_custkey == per_cust.o_custkey, "inner")
    past = _club_past(F.col("c_custkey"), F.col("c_nationkey"))
    out = j.select(
        F.col("c_custkey").alias("player_id"),
        F.col("c_name").alias("player"),
        F.col("c_nationkey").alias("league_key"),
        F.col("c_mktsegment").alias("role"),
        F.col("c_acctbal").alias("market_value"),
        (F.lit(17) + F.col("c_custkey") % 19).cast("double").alias("age"),
        past.alias("club_season"),
        _club_now(F.col("c_custkey"), F.col("c_nationkey"), past).alias("club_now"),
        F.col("minutes"),
        safe_div(F.col("n_orders") * F.lit(90.0), F.col("minutes")).alias("orders_per90"),
        safe_div(F.col("n_lines") * F.lit(90.0), F.col("minutes")).alias("lines_per90"),
        safe_div(F.col("price_cents") / F.lit(100.0), F.col("minutes")).alias("price_per_unit"),
        F.when(F.col("n_returned") > 0,
               safe_div(F.lit(100.0) * F.col("n_returned"), F.col("n_lines"))).alias("returned_pct"),
        safe_div(F.col("discount_cents") / F.lit(100.0), F.col("n_lines")).alias("discount_avg"),
        safe_div(F.lit(100.0) * F.col("n_urgent"), F.col("n_orders")).alias("urgent_pct"),
    )
    return materialize(out) if cut else out


def leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation: the static inputs of the league-map build (FIXTURES.md 3.2)."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    pr = F.col("n_regionkey")
    prio = F.when(pr <= 1, "green").when(pr <= 3, "yellow").otherwise("red")
    return (n.join(r, n.n_regionkey == r.r_regionkey, "left")
             .select(F.col("n_nationkey").alias("league_key"),
                     F.col("n_name").alias("folder"),
                     F.col("n_name").alias("league"),
                     F.upper(F.substring("r_name", 1, 3)).alias("country"),
                     (F.lit(1) + F.col("n_nationkey") % 3).cast("int").alias("division"),
                     F.when(pr <= 2, (F.lit(20) + (F.col("n_nationkey") * 37) % 60).cast("double"))
                      .alias("coefficient"),
                     prio.alias("priority")))


def events_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: a position list = its distinct event types in order of first use.

    The first token is the type of the user's first event in (ts, event_id)
    order. Equal types are collapsed by a partial aggregate first, so the
    list per user is bounded by the number of event types, however many
    events the user has.
    """
    ev = table(spark, sf_dir, "events")
    firsts = ev.groupBy("user_id", "event_type").agg(
        F.min(F.struct("ts", "event_id")).alias("_first"))
    agg = firsts.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("_first", "event_type"))).alias("_types"))
    return agg.select("user_id",
                      F.array_join(F.transform("_types", lambda s: s["event_type"]), ",")
                      .alias("position"))


def supplier_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping exports of the supplier table (every row is in at least one).

    Part A holds even keys, part B odd keys plus every key divisible by 10,
    so the keys divisible by 10 arrive twice as identical rows.
    """
    s = table(spark, sf_dir, "supplier")
    return (s.where(F.col("s_suppkey") % 2 == 0),
            s.where((F.col("s_suppkey") % 2 == 1) | (F.col("s_suppkey") % 10 == 0)))


def supplier_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed copy of supplier: some rows gone, some balances moved, some names padded."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.where(k % 13 != 0).select(
        "s_suppkey",
        F.when(k % 5 == 0, F.concat(F.col("s_name"), F.lit(" "))).otherwise(F.col("s_name")).alias("s_name"),
        "s_nationkey",
        F.when(k % 7 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")).alias("s_acctbal"))


def supplier_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed copy with some suppliers twice under one key and some under names of their own."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return (supplier_changed(spark, sf_dir).unionByName(s.where(k % 11 == 0))
            .unionByName(s.where(k % 17 == 0).withColumn("s_name", F.concat(F.col("s_name"), F.lit(" new")))))


# ---- Q5: a season check over nations --------------------------------------
def season_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry folders: one per nation."""
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("folder"), "n_nationkey")


def season_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation: rows of the merged export (its suppliers; NULL if none) and raw parts (customers).

    Some nations have parts but no merged export yet, and some have neither.
    """
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("_s"))
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("_c"))
    j = n.join(s, n.n_nationkey == s.s_nationkey, "left").join(c, n.n_nationkey == c.c_nationkey, "left")
    k = F.col("n_nationkey")
    return j.select(F.col("n_name").alias("folder"), F.when((k % 9 != 4) & (k % 12 != 5), F.col("_s")).alias("n_rows"),
                    F.when(k % 12 == 5, F.lit(0)).otherwise(F.coalesce(F.col("_c"), F.lit(0))).cast("long").alias("n_parts"))


def season_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing per nation folder whose ``.txt`` names carry the expected count.

    Every third nation's number is one too high, every eighth has only an
    unnumbered ``SIZE.txt``, every eleventh has a second numbered file, and
    even nations hold an unrelated note.
    """
    f = season_found(spark, sf_dir).join(season_registry(spark, sf_dir), "folder")
    k = F.col("n_nationkey")
    cnt = F.coalesce(F.col("n_rows"), F.lit(0))
    main = f.select("folder", F.when(k % 8 == 7, F.lit("SIZE.txt"))
                    .otherwise(F.concat((cnt + F.when(k % 3 == 0, 1).otherwise(0)).cast("string"), F.lit(".txt")))
                    .alias("file_name"))
    extra = f.where(k % 11 == 10).select("folder", F.concat(F.lit("old_"), cnt.cast("string"), F.lit(".txt"))
                                         .alias("file_name"))
    note = f.where(k % 2 == 0).select("folder", F.lit("notes.md").alias("file_name"))
    return main.unionByName(extra).unionByName(note)


def orders_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of orders in which a handful of rows differ, one in 997, and one in 1009 is gone."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    k = F.col("o_orderkey")
    return o.where(k % 1009 != 7).withColumn("o_orderstatus", F.when(k % 997 == 3, F.lit("X")).otherwise(F.col("o_orderstatus")))


def season_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as season exports: season (year), league (nation of the customer); nations stop at different years."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
                                              F.year("o_orderdate").alias("y"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("league"))
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.where(F.col("y") <= 1998 - F.col("league") % 4).select("o_orderkey", "o_custkey", "cents", "league", F.format_string("%d-%d", F.col("y"), F.col("y") + 1).alias("season"))


# ---- Q9 / S11: registry and catalogue over region -> nation -------------------
def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry row per region: tier, names, code and its nations as an array."""
    r = table(spark, sf_dir, "region")
    n = table(spark, sf_dir, "nation")
    leagues = n.groupBy("n_regionkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"])
        .alias("leagues"))
    rk = F.col("r_regionkey")
    tier = F.when(rk <= 1, "green").when(rk <= 3, "yellow").otherwise("red")
    return r.join(leagues, r.r_regionkey == leagues.n_regionkey, "left").select(
        tier.alias("tier"), F.lower("r_name").alias("local_name"), F.col("r_name").alias("english_name"),
        F.upper(F.substring("r_name", 1, 3)).alias("code"),
        F.coalesce(F.col("leagues"), F.array().cast("array<string>")).alias("leagues"),
        rk.alias("row_ord"))


def catalogue_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per region: competitions (nations) with seasons (order years)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    years = o.join(c, o.o_custkey == c.c_custkey).select("c_nationkey", "y").distinct()
    seasons = years.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("y").cast("long").alias("id"),
        F.format_string("%d/%d", F.col("y"), F.col("y") + 1).alias("name")))).alias("seasons"))
    n = table(spark, sf_dir, "nation")
    comps = (n.join(seasons, n.n_nationkey == seasons.c_nationkey, "left")
              .groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(
                  F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"),
                  F.coalesce(F.col("seasons"), F.array().cast("array<struct<id:bigint,name:string>>"))
                  .alias("seasons")))).alias("competitions")))
    r = table(spark, sf_dir, "region")
    return r.join(comps, r.r_regionkey == comps.n_regionkey, "left").select(
        F.col("r_regionkey").alias("doc_ord"),
        F.to_json(F.struct(F.col("r_name").alias("name"), "competitions")).alias("json"))


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'Area. League' strings: every nation under its region, some under a wrong area,
    and some names that exist nowhere."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    k = F.col("n_nationkey")
    a = j.select(F.concat_ws(". ", "r_name", "n_name").alias("scope"))
    b = j.where(k % 4 == 0).select(F.concat(F.lit("EUROPE. "), F.col("n_name")).alias("scope"))
    c = j.where(k % 5 == 0).select(F.concat(F.col("r_name"), F.lit(". NATIONAL_"), k.cast("string")).alias("scope"))
    return a.unionByName(b).unionByName(c).distinct()


# ---- S1-S5: an export tree written from the supplier table ------------------------
EXPORT_SPEC = ["Key", "Player", "Team", "Market value"]
EXPORT_TYPES = {"Key": "double", "Market value": "double"}


def write_export_tree(spark: SparkSession, sf_dir: str, root: str, plain_season: str | None = None) -> str:
    """Write one CSV export per nation under ``<root>/2025-2026/<nation>=...``.

    ``plain_season``: a second season in which all nations follow the contract.

    Columns follow ``EXPORT_SPEC`` from the supplier table, with contract
    breaks on purpose: nations with key % 4 == 1 lose ``Team``; key % 6 == 5
    gains ``Extra, %``; key % 5 == 3 has the columns in another order. Nations
    without suppliers get no file. One Spark write per header variant (four
    writes), partitioned by folder, so the tree grows with the table.
    """
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
          .select(F.format_string("%d - [%s] - (%s)", F.col("n_nationkey") + 1,
                                  F.upper(F.substring("r_name", 1, 3)), F.col("n_name")).alias("nation"),
                  F.col("n_nationkey").alias("_k"),
                  F.col("s_suppkey").cast("string").alias("Key"), F.col("s_name").alias("Player"),
                  F.concat(F.lit("TEAM_"), F.col("s_nationkey").cast("string")).alias("Team"),
                  F.col("s_acctbal").cast("string").alias("Market value")))
    k = F.col("_k")
    variants = [
        (~((k % 4 == 1) | (k % 6 == 5) | (k % 5 == 3)), ["Key", "Player", "Team", "Market value"]),
        ((k % 4 == 1) & ~(k % 6 == 5), ["Key", "Player", "Market value"]),
        ((k % 6 == 5), ["Key", "Player", "Team", "Market value", "Extra, %"]),
        ((k % 5 == 3) & ~(k % 4 == 1) & ~(k % 6 == 5), ["Market value", "Key", "Player", "Team"]),
    ]
    base = root.rstrip("/") + "/2025-2026"
    for cond, cols in variants:
        part = j.where(cond).withColumn("Extra, %", F.lit("1"))
        (part.select("nation", *[F.col(f"`{c}`") for c in cols])
             .write.mode("append").option("header", "true").partitionBy("nation").csv(base))
    if plain_season:
        j.select("nation", *EXPORT_SPEC).write.mode("append").option("header", "true").partitionBy("nation").csv(f"{root.rstrip('/')}/{plain_season}")
    return root
