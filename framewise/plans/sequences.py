"""Queries and oracles of the rules along a sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as sq
from .fixtures import rounded, sr, table


def orders(s, sf):
    return table(s, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def customers(s, sf):
    return table(s, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")


def by_price():
    return [F.col("o_totalprice"), F.col("o_orderkey")], F.col("o_totalprice")


def by_balance():
    return [F.col("c_acctbal"), F.col("c_custkey")], F.col("c_acctbal")


def traded(s, sf):
    return table(s, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"))


QUERIES = {
    "E2_hold_out": lambda s, sf: sq.hold_out(customers(s, sf), ["c_nationkey"], *by_balance()),
    "E3_folds": lambda s, sf: sq.folds(orders(s, sf), ["o_custkey"], *by_price(), 3),
    "E4_running_weight": lambda s, sf: rounded(sq.running_weight(orders(s, sf), ["o_custkey"], *by_price(), "o_totalprice")),
    "E5_neighbour_values": lambda s, sf: rounded(sq.neighbour_values(orders(s, sf), ["o_custkey"], [F.col("o_orderkey")], F.col("o_orderkey"), "o_totalprice")),
    "E6_leave_one_out_median": lambda s, sf: rounded(sq.leave_one_out_median(customers(s, sf), ["c_nationkey"], "c_acctbal")),
    "E7_first_row": lambda s, sf: rounded(sq.first_row(orders(s, sf), ["o_custkey"], [F.col("o_orderkey")], ["o_totalprice"])),
    "E8_mutual_best": lambda s, sf: rounded(sq.mutual_best(traded(s, sf), "l_partkey", "l_suppkey", "quantity")),
}

PRICE, BALANCE = "o_orderkey, o_custkey, " + sr("o_totalprice"), "c_custkey, c_nationkey, c_acctbal"
ORACLES = {
    "E2_hold_out": f"SELECT {BALANCE}, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) % 5 = 0 AS held FROM customer",
    "E3_folds": "SELECT o_orderkey, o_custkey, o_totalprice, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1) % 3 AS INT) AS fold FROM orders",
    "E4_running_weight": f"""SELECT {PRICE}, {sr('run', 'running')} FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM orders)""",
    "E5_neighbour_values": f"""SELECT {PRICE}, {sr('p', 'previous')}, {sr('n', 'next')} FROM (SELECT *, lag(o_totalprice) OVER w AS p, lead(o_totalprice) OVER w AS n
      FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))""",
    "E6_leave_one_out_median": f"""SELECT a.c_custkey, a.c_nationkey, {sr('any_value(a.c_acctbal)', 'c_acctbal')}, {sr('median(b.c_acctbal)', 'peer_median')}
      FROM customer a LEFT JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey GROUP BY 1, 2""",
    "E7_first_row": f"""SELECT {PRICE}, {sr('f', 'first_o_totalprice')} FROM (SELECT *, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders)""",
    "E8_mutual_best": f"""WITH p AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey) AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS b FROM p)
      SELECT l_partkey, l_suppkey, {sr('q', 'quantity')} FROM r WHERE a = 1 AND b = 1""",
}
