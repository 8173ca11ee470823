"""The candidate payload as registered: the radar of every candidate by brute force, every column by its SQL."""

from datetime import datetime

import duckdb

import __spark_entry__ as E
from tools.check_oracle import rows_of

N = 12
#: customer -> (unit price, discount, orders, urgent ones) of its order lines; three customers have no discount at all
FACTS = {k: (10.0 + (k * 7) % 5, None if k in (2, 3, 7) else (k % 4) / 100, 2 + k % 3, k % 3) for k in range(N)}


def write_tables(spark, root):
    """Twelve customers of one league, too young to be left out, in one peer group."""
    day = datetime(2026, 1, 1)
    orders, lines = [], []
    for k, (price, discount, n_orders, urgent) in FACTS.items():
        for i in range(n_orders):
            key = 10 * k + i
            orders.append((key, ids(k), "O", 1.0, day, "1-URGENT" if i < urgent else "5-LOW"))
            lines.append((key, 1, 1, 1, 400.0, 400.0 * price, discount, 0.0, "N", "O", day))
    for name, rows, schema in [
            ("region", [(0, "EUROPE")], "r_regionkey int, r_name string"),
            ("nation", [(0, "NATION_0", 0)], "n_nationkey int, n_name string, n_regionkey int"),
            ("customer", [(ids(k), f"Customer {k}", 0, 100.0 * k, "BUILDING") for k in FACTS],
             "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                               "o_orderdate timestamp, o_orderpriority string"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                                "l_linestatus string, l_shipdate timestamp")]:
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")


def ids(k):
    return 19 * (k // 8) + k % 8 + 1  # ages 18 to 25


def percentile(values, v):
    known = [x for x in values if x is not None]
    return None if v is None else (sum(x < v for x in known) + (sum(x == v for x in known) + 1) / 2) / len(known)


def test_payload_carries_the_radar(spark, tmp_path):
    write_tables(spark, tmp_path)
    df = E.queries()["payload"](spark, str(tmp_path))
    records = df.collect()
    discounts = [d for _, d, _, _ in FACTS.values()]
    shares = [u / n for _, _, n, u in FACTS.values()]
    expect = {}
    for k, (price, discount, n_orders, urgent) in FACTS.items():
        care = percentile(discounts, discount)
        urgency = percentile(shares, urgent / n_orders)
        parts = [percentile([p for p, *_ in FACTS.values()], price), None if care is None else 1 - care,
                 0.5 + (urgency - 0.5) * n_orders / 20]
        expect[ids(k)] = [None if p is None else round(p * 100 * 10) / 10 for p in parts]
    assert {r.player_id: r.radar for r in records} == expect and len(records) == N
    assert sum(None in r.radar for r in records) == 3  # a missing metric keeps its place

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    cur = con.execute(E.oracle_sql()["payload"])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in records]) == rows_of(columns, cur.fetchall())
