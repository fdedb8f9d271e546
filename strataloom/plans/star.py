"""Queries over the star tables: contracts, archiving, ranking with ties, bounded reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import history, linking, report


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contract_violations(spark, sf_dir):
    lines, orders = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    same = lines["l_orderkey"] == orders["o_orderkey"]
    found = [
        history.duplicate_keys(lines, ["l_orderkey", "l_linenumber"], "duplicate_line"),
        history.orphans(lines, orders, same, "line_without_order"),
        history.orphans(orders, lines, same, "order_without_line"),
        history.breaches(lines, (F.col("l_quantity") <= 0) | F.col("l_quantity").isNull(), "quantity_not_positive"),
        history.breaches(orders, ~F.col("o_orderstatus").isin("F", "O", "P"), "unknown_status"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def brand_rank(spark, sf_dir):
    return report.dense_ranking(_t(spark, sf_dir, "part").select("p_brand"), "p_brand", F.col("p_brand"))


def character_rank(spark, sf_dir):
    values = report.symbols(_t(spark, sf_dir, "part"), "p_brand", "p_type")
    return report.dense_ranking(values, "symbol", F.instr(F.lit("Brand#0123456789"), F.col("symbol")))


def archive_move(spark, sf_dir):
    """Orders of customers in one segment move to the archive; the rest stays active. Nothing is lost or doubled."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    retired = _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    active = orders.join(retired, "o_custkey", "left_anti").withColumn("place", F.lit("active"))
    archived = orders.join(retired, "o_custkey", "left_semi").withColumn("place", F.lit("archive"))
    return active.unionByName(archived).select("o_orderkey", "place")


def recursive_reach(spark, sf_dir):
    nations, regions = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    customers = _t(spark, sf_dir, "customer")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    links = nations.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).unionByName(
        customers.select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child")))
    return linking.reachable(links, regions.where("r_regionkey < 2").select(name("r", "r_regionkey").alias("node")), "node", 2)


ORACLE = {
    "contract_violations": """
        SELECT 'duplicate_line' AS rule, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
        UNION ALL SELECT 'line_without_order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
        UNION ALL SELECT 'order_without_line', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)
        UNION ALL SELECT 'quantity_not_positive', count(*) FROM lineitem WHERE l_quantity <= 0 OR l_quantity IS NULL
        UNION ALL SELECT 'unknown_status', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P')""",
    "brand_rank": """SELECT p_brand, n, dense_rank() OVER (ORDER BY n DESC) AS rank, row_number() OVER (ORDER BY n DESC, p_brand) AS ordinal
        FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)""",
    "character_rank": """
        WITH v AS (SELECT DISTINCT p_brand, p_type FROM part), s AS (SELECT unnest(string_split(p_brand, '')) AS symbol FROM v),
        c AS (SELECT symbol, count(*) AS n FROM s GROUP BY symbol)
        SELECT symbol, n, dense_rank() OVER (ORDER BY n DESC) AS rank, row_number() OVER (ORDER BY n DESC, instr('Brand#0123456789', symbol)) AS ordinal FROM c""",
    "archive_move": """SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'archive' ELSE 'active' END AS place
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "recursive_reach": """
        WITH RECURSIVE l AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
        w AS (SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region WHERE r_regionkey < 2 UNION ALL SELECT child, depth + 1 FROM w JOIN l ON w.node = l.parent WHERE depth < 2)
        SELECT node, min(depth) AS depth FROM w GROUP BY node""",
}

QUERIES = {name: globals()[name] for name in ORACLE}
