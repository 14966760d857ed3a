"""Projected views with personal data over the driver's tables; the same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SALT = "fixed-salt-for-tests"

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()

VIEWS = {
    "people": """SELECT c_custkey AS id, c_name AS full_name, lower(replace(c_name, '#', '.')) || '@corp.test' AS email,
        '06' || lpad(CAST(c_custkey AS STRING), 8, '0') AS phone, 'town-' || CAST(c_nationkey AS STRING) AS city, 'land-' || CAST(c_nationkey % 7 AS STRING) AS country,
        c_nationkey AS nation, c_acctbal AS salary, c_mktsegment AS segment, c_custkey % 10 = 0 AS is_vip FROM customer""",
    "payroll": "SELECT o_orderkey AS slip, o_custkey AS employee_id, o_totalprice AS amount, o_orderpriority AS grade FROM orders",
    "products": "SELECT p_partkey AS id, p_brand AS brand, p_retailprice AS unit_price, p_size AS risk_score, p_retailprice * 0.25 AS internal_margin FROM part",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = {"people": "customer", "payroll": "orders", "products": "part"}[name]
    table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(VIEWS[name])


def duck(name: str) -> str:
    return VIEWS[name].replace("AS STRING", "AS VARCHAR")


def lines(values: list[str], column: str) -> str:
    """An inline table; the same in both engines."""
    quoted = ", ".join("(" + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") + ")" for v in values)
    return f"SELECT * FROM (VALUES {quoted}) AS t({column})"
