"""Masked rows as test fixtures, in JSON or CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def _quoted(value: Column) -> Column:
    """As a CSV field: quoted if it holds a comma, a quote or a line end."""
    return F.when(value.rlike("[,\"\r\n]"), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def csv_rows(df: DataFrame) -> DataFrame:
    """Each row as a CSV line without its end; null is empty."""
    text = lambda f: F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`").cast("string")
    return df.select(F.array_join(F.array(*(F.coalesce(_quoted(text(f)), F.lit("")) for f in df.schema.fields)), ",").alias("line"))


def csv_header(df: DataFrame) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c for c in df.columns)


def content(df: DataFrame, form: str) -> str:
    """A few rows as one text: a JSON array, or CSV with a header and CRLF line ends."""
    if form == "csv":
        return "".join(line + "\r\n" for line in [csv_header(df), *(r["line"] for r in csv_rows(df).collect())])
    if form != "json":
        raise ValueError(f"unknown format '{form}'; known: json, csv")
    return "[" + ", ".join(r["json"] for r in json_rows(df).collect()) + "]"
