"""External inputs: JDBC databases, JSON collections, Parquet folders, pipe-and-ampersand text, demo customers."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mask

DRIVERS = {"postgresql": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", 5432), "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 3306), "mssql": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://{host}:{port};databaseName={database}", 1433)}
#: What makes a session read-only, where the server has it.
READ_ONLY = {"postgresql": "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY", "mysql": "SET SESSION TRANSACTION READ ONLY"}


def jdbc_options(config: dict[str, Any]) -> dict[str, str]:
    """Reader options for a configured database; the driver's jar must be on the class path."""
    kind = config["type"]
    if kind not in DRIVERS:
        raise ValueError(f"unknown database type '{kind}'; known: {', '.join(DRIVERS)}")
    driver, url, port = DRIVERS[kind]
    options = {"driver": driver, "url": url.format(host=config.get("host", "localhost"), port=config.get("port") or port, database=config["database"]), "fetchsize": str(config.get("fetchsize", 10_000)), "queryTimeout": str(config.get("timeout", 30))}
    options |= {k: str(config[k]) for k in ("user", "password") if config.get(k)}
    if kind in READ_ONLY:
        options["sessionInitStatement"] = READ_ONLY[kind]
    return options


def jdbc_table(spark: SparkSession, config: dict[str, Any], table: str, split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table; filters and column lists are pushed to the server. split: (column, low, high, partitions)."""
    reader = spark.read.format("jdbc").options(**jdbc_options(config)).option("dbtable", table)
    if split:
        column, low, high, parts = split
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def parquet_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def json_collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def sampled(df: DataFrame, n: int, key: str) -> DataFrame:
    """n rows that look random but are always the same."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(n)


# Prefixes of binary columns in hexadecimal, which gain a mark.
HEX_PREFIXES = ["|474946383961", "\tE6100000010C"]


def piped_records(spark: SparkSession, path: str) -> DataFrame:
    """Records that end in &| with fields that end in +|, as arrays of fields."""
    text = spark.read.option("lineSep", "&|").text(path)
    record = F.regexp_replace(F.regexp_replace(F.col("value"), r"\A(﻿|\s)+", ""), r"\s+\z", "")
    return text.select(record.alias("record")).where(F.col("record") != "").select(F.split("record", r"\+\|").alias("fields"))


def piped_to_tabbed(records: DataFrame) -> DataFrame:
    """One line of tab-separated text per record: quotes doubled, markup and fields with tabs quoted, NULs removed."""

    def one(part: Column, i: Column) -> Column:
        part = F.replace(part, F.lit('"'), F.lit('""'))
        part = F.when((i == 0) & (part == "\0"), F.lit("00")).otherwise(F.replace(part, F.lit("\0"), F.lit("")))
        quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        return F.when(part.rlike(r"(?s)\A<.*>\z"), quoted(part)).when(part.rlike(r"(?s)\A.<.*>\z"), quoted(F.substring(part, F.lit(2), F.char_length(part)))).when(part.contains("\t"), quoted(part)).otherwise(part)

    line = F.array_join(F.transform("fields", one), "\t")
    return records.select(reduce(lambda c, p: F.replace(c, F.lit(p), F.lit(p[0] + "\\\\x" + p[1:])), HEX_PREFIXES, line).alias("line"))


def demo_customers(spark: SparkSession, n: int = 10_000, salt: str = "demo") -> DataFrame:
    """Invented customers, the same for the same salt."""
    ids = spark.range(n)
    key = F.col("id").cast("string")
    made = lambda kind, label: mask.generated(kind, F.concat(key, F.lit(label)), salt)
    seconds = mask.seed(key, salt, "|t") % (366 * 86_400)
    return ids.select(
        key.alias("_id"), made("FIRST_NAME", "f").alias("firstname"), made("LAST_NAME", "l").alias("lastname"), made("EMAIL", "e").alias("email"), made("PHONE", "p").alias("phone"),
        made("CITY", "c").alias("city"), made("COUNTRY", "n").alias("country"), F.timestamp_seconds(F.lit(1_704_067_200) + seconds).alias("created_at"),
    )
