"""Sources: the driver's tables as bar series, context series, trades and articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ["symbol", "date", "open", "high", "low", "close", "volume", "vwap", "transactions"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ohlc(rows: DataFrame, *keys: str) -> DataFrame:
    """OHLC by keys from rows (price, quantity, amount, k): k orders the rows of a bar and has no ties."""
    return rows.groupBy(*keys).agg(
        F.min_by("price", "k").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "k").alias("close"),
        F.sum("quantity").alias("volume"),
        (F.sum("amount") / F.sum("quantity")).alias("vwap"),
        F.count("*").alias("transactions"),
    )


def _priced(lines: DataFrame, *also: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    k = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lines.filter("l_quantity > 0").select(*also, F.col("l_shipdate").cast("date").alias("date"), price.alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"), k.alias("k"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by symbol (the return flag)."""
    rows = _priced(table(spark, sf_dir, "lineitem"), "l_returnflag").withColumnRenamed("l_returnflag", "symbol")
    return _ohlc(rows, "symbol", "date").select(*BAR_COLUMNS)


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark: one bar a date over all symbols; close is the date's volume-weighted price."""
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    return rows.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars by brand."""
    lines = _priced(table(spark, sf_dir, "lineitem"), "l_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    return _ohlc(lines.join(parts, "l_partkey").withColumn("date", F.trunc("date", "month")), "symbol", "date").select(*BAR_COLUMNS)


def vix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volatility index: mean order value by date, on the orders' own calendar."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg((F.avg("o_totalprice") / 10000).alias("vix"))


def series_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named context series in long form: mean order value by priority and date."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("name"), F.col("o_orderdate").cast("date").alias("date")).agg((F.avg("o_totalprice") / 10000).alias("close"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades: an order is a trade of its customer's segment; profit is its value over the mean of all orders'."""
    orders = table(spark, sf_dir, "orders")
    mean = orders.agg(F.avg("o_totalprice").alias("mean"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("symbol"))
    rows = orders.join(customers, "o_custkey").join(F.broadcast(mean))
    pnl = F.col("o_totalprice") - F.col("mean")
    tier = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
    return rows.select("symbol", tier.alias("tier"), F.col("o_orderstatus").alias("vol_regime"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("trade_id"), pnl.alias("pnl"), (pnl / F.col("mean")).alias("pnl_pct"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 30).alias("holding_days"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News: documents as articles of the ticker that is their source."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.col("source").alias("ticker"), F.col("text").alias("body"), "lang")
