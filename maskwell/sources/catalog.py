"""Tables behind an engine: registration, listing, description, and the types found for their columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import names, values
from ..operators import documents


@dataclass
class Table:
    df: DataFrame
    keys: tuple[str, ...] = ()
    is_collection: bool = False
    types: dict[str, str] | None = None
    layers: dict[str, str] = field(default_factory=dict)


class Catalog:
    """Databases of tables and collections. Types are found once per table and settings."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings
        self.databases: dict[str, dict[str, Table]] = {}

    def register(self, database: str, name: str, df: DataFrame, keys: tuple[str, ...] = (), is_collection: bool = False) -> None:
        if is_collection:  # behind a view of its own, at which lineage ends
            view = collection_view(database, name)
            df.createOrReplaceTempView(view)
            df = self.spark.table(view)
        self.databases.setdefault(database, {})[name.lower()] = Table(df, tuple(keys), is_collection)

    def tables(self, database: str) -> dict[str, Table]:
        if database not in self.databases:
            raise ValueError(f"unknown database '{database}'; known: {', '.join(sorted(self.databases)) or 'none'}")
        return self.databases[database]

    def table(self, database: str, name: str) -> Table:
        found = self.tables(database).get(name.lower())
        if found is None:
            raise ValueError(f"unknown table '{name}' in '{database}'")
        return found

    def list_tables(self, database: str) -> list[str]:
        return sorted(self.tables(database))

    def types(self, database: str, name: str) -> dict[str, str]:
        """Types by column, from names and, for text columns left over, a sample of their values."""
        table = self.table(database, name)
        if table.types is None:
            if table.is_collection:
                table.types = documents.field_types(table.df.schema, self.settings)
                table.layers = dict.fromkeys(table.types, "name")
                return table.types
            found = {}
            for f in table.df.schema.fields:
                kind = names.name_type(f.name, self.settings, name, f.dataType.simpleString())
                if kind:
                    found[f.name] = kind
            found |= {p: k for p, k in documents.field_types(table.df.schema, self.settings).items() if "." in p}
            table.layers = dict.fromkeys(found, "name")
            open_ = [c for c in values.text_columns(table.df) if c not in found]
            if self.settings.scan_values and open_:
                scanned = scan_table(table.df, open_, self.settings.scan_sample, self.settings.scan_threshold)
                found |= scanned
                table.layers |= dict.fromkeys(scanned, "value")
            table.types = found
        return table.types

    def describe(self, database: str, name: str) -> DataFrame:
        """(name, type, nullable, primary_key, pii_type), or (name, types, frequency, pii_type) of a collection's fields."""
        table, types = self.table(database, name), self.types(database, name)
        if table.is_collection:
            rows = documents.infer_schema(table.df.select(F.to_json(F.struct("*")).alias("doc")), "doc")
            pairs = [(k, v) for k, v in types.items()]
            known = self.spark.createDataFrame(pairs, "name string, pii_type string")
            return rows.join(known, "name", "left").orderBy("name")
        rows = [(f.name, f.dataType.simpleString(), f.nullable, f.name in table.keys, types.get(f.name)) for f in table.df.schema.fields]
        return self.spark.createDataFrame(rows, "name string, type string, nullable boolean, primary_key boolean, pii_type string")

    def registry(self) -> DataFrame:
        """All types found so far: (db, table, column, pii_type, layer)."""
        rows = [(d, n, c, k, t.layers.get(c)) for d, tables in self.databases.items() for n, t in tables.items() for c, k in (t.types or {}).items()]
        return self.spark.createDataFrame(rows, "db string, table string, column string, pii_type string, layer string")


def collection_view(database: str, name: str) -> str:
    return f"collection_{database}_{name}".lower()


def scan_table(df: DataFrame, columns: list[str], sample: int, threshold: float) -> dict[str, str]:
    """Types of text columns by the `sample` smallest distinct values of each, all columns in one job.

    Each column is scanned alone (the reader prunes the others), made distinct on the executors and cut by a top-k
    that holds `sample` values a task.
    """
    firsts = [values.sample_values(df, c, sample).select(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    rows = reduce(DataFrame.unionAll, firsts).groupBy("column").agg(values.scanned(F.col("value"), threshold).alias("kind"))
    return {r["column"]: r["kind"] for r in rows.collect() if r["kind"]}


def qualified(name: str, default: str = "public") -> tuple[str, str]:
    """(schema, table) of a name of one or two parts."""
    schema, _, table = name.rpartition(".")
    return schema or default, table


def listed(schema: str, table: str, default: str = "public") -> str:
    """A table as it is listed: qualified unless it is in the default schema."""
    return table if schema == default else f"{schema}.{table}"
