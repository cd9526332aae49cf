"""Registry, table access, derived dirty tables and the rounding both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one scale factor by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def orders_dirty(self) -> DataFrame:
        key = F.col("o_orderkey")
        price = F.when(key % 7 == 0, None).when(key % 97 == 0, F.col("o_totalprice") * 10).otherwise(F.col("o_totalprice"))
        marred = self.orders.withColumns({
            "o_totalprice": price, "o_orderpriority": F.when(key % 11 == 0, "").otherwise(F.col("o_orderpriority"))})
        return marred.unionByName(marred.where(key % 50 == 0))

    @property
    def customer_dirty(self) -> DataFrame:
        segment, turn = F.col("c_mktsegment"), F.col("c_custkey") % 3
        return self.customer.withColumn("c_mktsegment", F.when(turn == 0, F.upper(segment)).when(turn == 1, F.lower(segment)).otherwise(
            F.concat(F.lit("  "), segment, F.lit(" "))))

    @property
    def labelled(self) -> DataFrame:
        return self.documents.join(self.labels, "doc_id").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


DIRTY_ORDERS = """marred AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 10 ELSE o_totalprice END AS o_totalprice,
    o_orderdate, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS o_orderpriority FROM orders),
orders_dirty AS (SELECT * FROM marred UNION ALL SELECT * FROM marred WHERE o_orderkey % 50 = 0)"""

DIRTY_CUSTOMER = """customer_dirty AS (
  SELECT * REPLACE (CASE c_custkey % 3 WHEN 0 THEN upper(c_mktsegment) WHEN 1 THEN lower(c_mktsegment)
    ELSE '  ' || c_mktsegment || ' ' END AS c_mktsegment) FROM customer)"""

LABELLED = "labelled AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"


def nine_digits(df: DataFrame) -> DataFrame:
    """Doubles to nine significant digits (below 1e-12 to zero) and whole numbers to bigint, so
    that the summation order of the two engines does not show."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            text = F.format_string("%.8e", c.cast("double"))
            plain = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
            c = F.when(plain, c.cast("double")).when(F.abs(c) < 1e-12, F.lit(0.0)).otherwise(text.try_cast("double"))
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def nine_digits_sql(sql: str, doubles: str, ints: str) -> str:
    swaps = [f"CASE WHEN abs(\"{c}\") < 1e-12 THEN 0.0::DOUBLE ELSE CAST(printf('%.8e', CAST(\"{c}\" AS DOUBLE)) AS DOUBLE) END AS \"{c}\"" for c in doubles.split()]
    swaps += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints.split()]
    return f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({sql})" if swaps else sql


def check(name: str, sql: str | None = None, doubles: str = "", ints: str = ""):
    """Register a query, with its SQL where SQL can express it."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: nine_digits(fn(Tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = nine_digits_sql(sql, doubles, ints)
        return fn

    return register


def long_sql(table: str, cols: list[str], cast: str = "DOUBLE") -> str:
    """(column, x) rows of several columns."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS {cast}) AS x FROM {table}" for c in cols)


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ALL = [*LINE, "l_returnflag", "l_linestatus", "l_shipdate"]
ORDER = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDER_ALL = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
EVENT = ["event_id", "user_id", "value"]
FENCES = """f AS (SELECT "column", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM long GROUP BY 1),
fences AS (SELECT "column", q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM f)"""
