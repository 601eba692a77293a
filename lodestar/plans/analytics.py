"""Business reports over the star schema, as DataFrame plans.

Every report takes ``t``, a function from table name to DataFrame. Line items
are aggregated to the join key before they meet another large table; dimension
tables are joined without hints, so the planner broadcasts them only while their
measured size allows it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Tables = Callable[[str], DataFrame]


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def places(t: Tables) -> DataFrame:
    """nation with its region's name."""
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def customer_places(t: Tables) -> DataFrame:
    return t("customer").join(places(t), F.col("c_nationkey") == F.col("n_nationkey"))


def order_summary(t: Tables) -> DataFrame:
    items = t("lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("total_items"), F.sum("l_quantity").alias("total_quantity")
    )
    return (
        t("orders")
        .join(items, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(customer_places(t), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey", "c_custkey", "c_name", "o_orderdate", "o_orderstatus", "o_totalprice", "r_name", "total_items", "total_quantity"
        )
    )


def product_sales(t: Tables, sold: Column) -> DataFrame:
    """Never-sold products stay, with NULL sums and 0 customers. ``sold`` limits the line items inside the left join."""
    buyers = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = t("lineitem").where(sold).join(buyers, "l_orderkey", "left")
    sales = lines.groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("total_sold"),
        F.round(F.sum(revenue()), 4).alias("total_revenue"),
        F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("average_price"),
        F.count_distinct("o_custkey").alias("unique_customers"),
    )
    joined = t("part").join(sales, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.select(
        "p_partkey", "p_name", "p_brand", "total_sold", "total_revenue", "average_price",
        F.coalesce("unique_customers", F.lit(0)).cast("bigint").alias("unique_customers"),
    )


def purchase_history(t: Tables, counted: Column) -> DataFrame:
    bought = t("orders").where(counted).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.round(F.sum("o_totalprice"), 2).alias("total_spent"),
        F.max("o_orderdate").alias("last_order_date"),
        F.round(F.avg("o_totalprice"), 6).alias("average_order_value"),
    )
    joined = customer_places(t).join(bought, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(
        "c_custkey", "c_name", "r_name",
        F.coalesce("total_orders", F.lit(0)).cast("bigint").alias("total_orders"),
        "total_spent", "last_order_date", "average_order_value",
    )


def line_subtotals(t: Tables) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return t("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.round(F.col("l_quantity") * unit * (1 - F.col("l_discount")), 4).alias("subtotal"),
    )


def products_of_brand(t: Tables, brand: str) -> DataFrame:
    return t("part").where(F.col("p_brand") == brand).select("p_partkey", "p_name", "p_retailprice")


def customers_of_nation(t: Tables, nation: str) -> DataFrame:
    return customer_places(t).where(F.col("n_name") == nation).select("c_custkey", "c_name", "n_name")


def low_stock(t: Tables, below: int) -> DataFrame:
    return t("part").where(F.col("p_size") < below).select("p_partkey", "p_name", "p_size")


def most_expensive(t: Tables, n: int) -> DataFrame:
    return t("part").select("p_partkey", "p_name", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(n)


def top_customers(t: Tables, n: int) -> DataFrame:
    spent = t("orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total_spent"))
    return spent.orderBy(F.col("total_spent").desc(), "o_custkey").limit(n)


def _by_part(t: Tables, *sums: Column) -> DataFrame:
    return t("lineitem").groupBy("l_partkey").agg(*sums)


def sales_by_brand(t: Tables) -> DataFrame:
    lines = _by_part(t, F.sum(revenue()).alias("r"))
    return lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.round(F.sum("r"), 4).alias("revenue"))


def _orders_by_region(t: Tables, *aggregates: Column) -> DataFrame:
    joined = t("orders").join(customer_places(t), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("r_name").agg(*aggregates)


def orders_by_region(t: Tables) -> DataFrame:
    return _orders_by_region(t, F.count(F.lit(1)).alias("n_orders"))


def repeat_customers(t: Tables, more_than: int = 1) -> DataFrame:
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders")).where(F.col("n_orders") > more_than)


def popular_products(t: Tables, more_than: int = 3) -> DataFrame:
    return t("lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n_orders")).where(F.col("n_orders") > more_than)


def average_order_by_region(t: Tables) -> DataFrame:
    return _orders_by_region(t, F.round(F.avg("o_totalprice"), 6).alias("average_order_value"))


def revenue_by_customer(t: Tables) -> DataFrame:
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sum(revenue()).alias("r"))
    joined = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    total = joined.groupBy("o_custkey").agg(F.round(F.sum("r"), 4).alias("revenue"))
    return total.orderBy(F.col("revenue").desc(), "o_custkey")


def not_recently_ordered(t: Tables, months: int = 3) -> DataFrame:
    since = t("orders").agg(F.add_months(F.max("o_orderdate").cast("date"), -months)).scalar()
    recent = t("orders").where(F.col("o_orderdate").cast("date") >= since).select("o_orderkey")
    lines = t("lineitem").join(recent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_partkey")
    return t("part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


def priciest_brand(t: Tables) -> DataFrame:
    mean = t("part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("average_price"))
    best = mean.agg(F.min_by(F.struct("p_brand", "average_price"), F.struct(-F.col("average_price"), F.col("p_brand"))).alias("b"))
    return best.select("b.p_brand", "b.average_price")


def broad_customers(t: Tables, brands: int = 3) -> DataFrame:
    lines = t("lineitem").select("l_orderkey", "l_partkey").join(
        t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
    )
    bought = lines.select("l_orderkey", "p_brand").join(
        t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return bought.groupBy("o_custkey").agg(F.count_distinct("p_brand").alias("n_brands")).where(F.col("n_brands") >= brands)


def revenue_share_by_region(t: Tables) -> DataFrame:
    orders = t("lineitem").groupBy("l_orderkey").agg(F.sum(revenue()).alias("r"))
    joined = orders.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    region = joined.join(customer_places(t), F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name").agg(F.sum("r").alias("r"))
    # One row per region is left for the window.
    share = 100 * F.col("r") / F.sum("r").over(Window.partitionBy(F.lit(0)))
    return region.select("r_name", F.round("r", 4).alias("revenue"), F.round(share, 4).alias("percent"))


def status_share(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return t("orders").agg(
        F.round(100 * F.count_if(F.col("o_orderstatus") == "F") / n, 4).alias("percent_delivered"),
        F.round(100 * F.count_if(F.col("o_orderstatus") == "P") / n, 4).alias("percent_pending"),
    )


def monthly_growth(t: Tables) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM")
    total = t("orders").groupBy(month.alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    # One row per month is left for the window.
    before = F.lag("total").over(Window.partitionBy(F.lit(0)).orderBy("month"))
    return total.withColumn("growth_percent", F.round(100 * (F.col("total") - before) / before, 6))


def favourite_method(t: Tables) -> DataFrame:
    joined = t("orders").join(customer_places(t), F.col("o_custkey") == F.col("c_custkey"))
    counted = joined.groupBy("r_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"))
    w = Window.partitionBy("r_name").orderBy(F.col("n_orders").desc(), "o_orderpriority")
    return counted.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def discount_by_brand(t: Tables) -> DataFrame:
    lines = _by_part(t, F.sum("l_discount").alias("s"), F.count("l_discount").alias("n"))
    joined = lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("average_discount"))


def orders_of_customer(t: Tables, name: str) -> DataFrame:
    chosen = t("customer").where(F.col("c_name") == name)
    return t("orders").join(chosen, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_orderdate", "o_totalprice")


def orders_to_region(t: Tables, region: str) -> DataFrame:
    chosen = customer_places(t).where(F.col("r_name") == region)
    return t("orders").join(chosen, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "r_name", "o_orderstatus")
