"""Reports, constraints, collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collections as C
from ..operators import quality as Q
from ..plans import analytics as A
from .base import query

REV = "l_extendedprice*(1-l_discount)"
CUST = "customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey"

query("j01_order_summary", f"""
  SELECT o_orderkey, c_custkey, c_name, o_orderdate, o_orderstatus, o_totalprice, r_name,
         count(*) AS total_items, sum(l_quantity) AS total_quantity
  FROM orders JOIN lineitem ON l_orderkey=o_orderkey JOIN {CUST.replace('customer JOIN', 'customer ON c_custkey=o_custkey JOIN', 1)}
  GROUP BY ALL""")(A.order_summary)

query("j02_product_sales", f"""
  SELECT p_partkey, p_name, p_brand, sum(l_quantity) AS total_sold, round(sum({REV}),4) AS total_revenue,
         round(avg(l_extendedprice/l_quantity),6) AS average_price, count(DISTINCT o_custkey) AS unique_customers
  FROM part LEFT JOIN lineitem ON l_partkey=p_partkey AND l_discount=0.1 AND l_returnflag='R'
  LEFT JOIN orders ON o_orderkey=l_orderkey GROUP BY p_partkey, p_name, p_brand""")(
    lambda t: A.product_sales(t, (F.col("l_discount") == 0.1) & (F.col("l_returnflag") == "R"))
)

query("j03_purchase_history", f"""
  SELECT c_custkey, c_name, r_name, count(DISTINCT o_orderkey) AS total_orders, round(sum(o_totalprice),2) AS total_spent,
         max(o_orderdate) AS last_order_date, round(avg(o_totalprice),6) AS average_order_value
  FROM {CUST} LEFT JOIN orders ON o_custkey=c_custkey AND o_orderstatus='F' GROUP BY c_custkey, c_name, r_name""")(
    lambda t: A.purchase_history(t, F.col("o_orderstatus") == "F")
)

query("j02_product_sales_all", f"""
  SELECT p_partkey, p_name, p_brand, sum(l_quantity) AS total_sold, round(sum({REV}),4) AS total_revenue,
         round(avg(l_extendedprice/l_quantity),6) AS average_price, count(DISTINCT o_custkey) AS unique_customers
  FROM part LEFT JOIN lineitem ON l_partkey=p_partkey LEFT JOIN orders ON o_orderkey=l_orderkey GROUP BY p_partkey, p_name, p_brand""")(
    lambda t: A.product_sales(t, F.lit(True))
)
query("j03_purchase_history_all", f"""
  SELECT c_custkey, c_name, r_name, count(DISTINCT o_orderkey) AS total_orders, round(sum(o_totalprice),2) AS total_spent,
         max(o_orderdate) AS last_order_date, round(avg(o_totalprice),6) AS average_order_value
  FROM {CUST} LEFT JOIN orders ON o_custkey=c_custkey GROUP BY c_custkey, c_name, r_name""")(
    lambda t: A.purchase_history(t, F.lit(True))
)

query("j04_line_subtotals", """
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         round(l_quantity*(l_extendedprice/l_quantity)*(1-l_discount),4) AS subtotal FROM lineitem""")(A.line_subtotals)

query("j05_products_of_brand", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_brand='Brand#1'")(
    lambda t: A.products_of_brand(t, "Brand#1")
)
query("j05_customers_of_nation", f"SELECT c_custkey, c_name, n_name FROM {CUST} WHERE n_name='NATION_1'")(
    lambda t: A.customers_of_nation(t, "NATION_1")
)
query("j05_low_stock", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size < 10")(lambda t: A.low_stock(t, 10))
query("j06_most_expensive", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3")(
    lambda t: A.most_expensive(t, 3)
)
query("j06_top_customers", """
  SELECT o_custkey, round(sum(o_totalprice),2) AS total_spent FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")(
    lambda t: A.top_customers(t, 3)
)
query("j07_sales_by_brand", f"SELECT p_brand, round(sum({REV}),4) AS revenue FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1")(
    A.sales_by_brand
)
query("j07_orders_by_region", f"SELECT r_name, count(*) AS n_orders FROM orders, {CUST} WHERE c_custkey=o_custkey GROUP BY 1")(
    A.orders_by_region
)
query("j08_repeat_customers", "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1 HAVING count(*) > 1")(A.repeat_customers)
query("j08_popular_products", """
  SELECT l_partkey, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 3""")(
    A.popular_products
)
query("j09_average_order_by_region", f"""
  SELECT r_name, round(avg(o_totalprice),6) AS average_order_value FROM orders, {CUST} WHERE c_custkey=o_custkey GROUP BY 1""")(
    A.average_order_by_region
)
query("j10_revenue_by_customer", f"""
  SELECT o_custkey, round(sum({REV}),4) AS revenue FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1""")(A.revenue_by_customer)
query("j11_not_recently_ordered", """
  SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (
    SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey=o_orderkey
    WHERE o_orderdate::DATE >= (SELECT (max(o_orderdate)::DATE - INTERVAL 3 MONTH)::DATE FROM orders))""")(A.not_recently_ordered)
query("j12_priciest_brand", """
  SELECT p_brand, round(avg(p_retailprice),6) AS average_price FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")(A.priciest_brand)
query("j13_broad_customers", """
  SELECT o_custkey, count(DISTINCT p_brand) AS n_brands FROM lineitem JOIN part ON l_partkey=p_partkey
  JOIN orders ON l_orderkey=o_orderkey GROUP BY 1 HAVING count(DISTINCT p_brand) >= 3""")(A.broad_customers)
query("j14_revenue_share_by_region", f"""
  WITH r AS (SELECT r_name, sum({REV}) AS r FROM lineitem JOIN orders ON l_orderkey=o_orderkey, {CUST} WHERE c_custkey=o_custkey GROUP BY 1)
  SELECT r_name, round(r,4) AS revenue, round(100*r/sum(r) OVER (),4) AS percent FROM r""")(A.revenue_share_by_region)
query("j14_status_share", """
  SELECT round(100.0::DOUBLE*count(*) FILTER (o_orderstatus='F')/count(*),4) AS percent_delivered,
         round(100.0::DOUBLE*count(*) FILTER (o_orderstatus='P')/count(*),4) AS percent_pending FROM orders""")(A.status_share)
query("j15_monthly_growth", """
  WITH m AS (SELECT strftime(o_orderdate,'%Y-%m') AS month, round(sum(o_totalprice),2) AS total FROM orders GROUP BY 1)
  SELECT month, total, round(100*(total-lag(total) OVER (ORDER BY month))/lag(total) OVER (ORDER BY month),6) AS growth_percent FROM m""")(
    A.monthly_growth
)
query("j16_favourite_method", f"""
  WITH m AS (SELECT r_name, o_orderpriority, count(*) AS n_orders FROM orders, {CUST} WHERE c_custkey=o_custkey GROUP BY 1,2)
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY r_name ORDER BY n_orders DESC, o_orderpriority)=1""")(A.favourite_method)
query("j17_discount_by_brand", """
  SELECT p_brand, round(avg(l_discount),6) AS average_discount FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1""")(
    A.discount_by_brand
)
query("j18_orders_of_customer", """
  SELECT o_orderkey, c_name, o_orderdate, o_totalprice FROM orders JOIN customer ON o_custkey=c_custkey
  WHERE c_name='Customer#000000001'""")(lambda t: A.orders_of_customer(t, "Customer#000000001"))
query("j18_orders_to_region", f"""
  SELECT o_orderkey, c_custkey, r_name, o_orderstatus FROM orders, {CUST} WHERE c_custkey=o_custkey AND r_name='AMERICA'""")(
    lambda t: A.orders_to_region(t, "AMERICA")
)

# Constraints. The tables hold few violations, so rules and parents are chosen to have some.

query("k01_unique_line_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1,2 HAVING count(*)>1")(
    lambda t: Q.check_unique(t("lineitem"), ["l_orderkey", "l_linenumber"])
)
query("k01_unique_order_keys", "SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*)>1")(
    lambda t: Q.check_unique(t("orders"), ["o_orderkey"])
)
query("k02_null_counts", """
  SELECT count(*) FILTER (o_orderkey IS NULL) AS o_orderkey, count(*) FILTER (o_custkey IS NULL) AS o_custkey,
         count(*) FILTER (o_totalprice IS NULL) AS o_totalprice FROM orders""")(
    lambda t: Q.null_counts(t("orders"), ["o_orderkey", "o_custkey", "o_totalprice"])
)
query("k02_documents_without_label", """
  SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL""")(
    lambda t: Q.check_not_null(t("documents").select("doc_id").join(t("labels"), "doc_id", "left").select("doc_id", "quality"), ["quality"])
)
query("k03_orphan_lines", """
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem l
  WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)""")(
    lambda t: Q.check_fk(t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), t("orders"), [("l_orderkey", "o_orderkey")])
)
query("k03_unlabelled_documents", "SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")(
    lambda t: Q.check_fk(t("documents").select("doc_id", "lang", "source"), t("labels"), [("doc_id", "doc_id")])
)
query("k04_status_outside_set", """
  SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_orderstatus IN ('F','P') AND o_totalprice > 0)""")(
    lambda t: Q.check_predicate(
        t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"),
        F.col("o_orderstatus").isin("F", "P") & (F.col("o_totalprice") > 0),
    )
)
query("k05_default_labels", """
  SELECT d.doc_id, coalesce(l.quality,0) AS quality, coalesce(l.toxic,0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")(
    lambda t: Q.fill_defaults(
        t("documents").select("doc_id").join(t("labels"), "doc_id", "left"), {"quality": F.lit(0), "toxic": F.lit(0)}
    )
)


def _delta(t):
    """A second delivery: finished orders come again, closed and dearer, twice."""
    finished = t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return finished.select("o_orderkey", F.round(F.col("o_totalprice") + 1, 2).alias("o_totalprice"), F.lit(1).alias("version")).unionByName(
        finished.select("o_orderkey", F.round(F.col("o_totalprice") + 2, 2).alias("o_totalprice"), F.lit(2).alias("version"))
    )


@query("a09_upsert_orders", """
  SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN round(o_totalprice+2,2) ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderstatus='F' THEN 2 ELSE 0 END AS version FROM orders""")
def upsert_orders(t):
    base = t("orders").select("o_orderkey", "o_totalprice", F.lit(0).alias("version"))
    return C.upsert(base, _delta(t), ["o_orderkey"], "version")


@query("a10_point_lookup", """
  SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R')""")
def point_lookup(t):
    ids = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.get_by_ids(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ids, "o_orderkey")
