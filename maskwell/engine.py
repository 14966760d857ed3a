"""The engine: read-only requests over registered tables and collections, answered with masked results."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import Settings
from .functions import values
from .functions.mask import new_salt
from .operators import bands, documents, fixtures, gate, lineage
from .operators.gate import Denied
from .sources import catalog, readers
from .sources.catalog import Catalog, collection_view

QUOTES = "spark.sql.ansi.doubleQuotedIdentifiers"
LOCK = threading.RLock()


def nested(kind: T.DataType) -> bool:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return isinstance(kind, T.StructType)


def by_leaf(types: dict[str, str]) -> dict[str, str]:
    """Types by path and, so that moved fields keep theirs, by last part."""
    return {p.rsplit(".", 1)[-1]: k for p, k in types.items() if "." in p} | types


@dataclass
class QueryResult:
    """A masked result. `df` is lazy; rows() brings it to the driver, at most the engine's max_rows."""

    df: DataFrame
    columns: list[str]
    tables_detected: list[str]
    pii_columns_anonymized: list[str]

    def envelope(self) -> dict[str, Any]:
        rows = [list(r) for r in self.df.collect()]
        return {"columns": self.columns, "rows": rows, "row_count": len(rows), "tables_detected": self.tables_detected, "pii_columns_anonymized": self.pii_columns_anonymized}


class Engine:
    """One salt per query in ephemeral mode; in session mode one salt until purge()."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, salt: str | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.catalog = Catalog(spark, self.settings)
        self.fixed, self.session_salt = salt, salt or new_salt()
        self.clock, self.last = time.monotonic, time.monotonic()
        #: Databases of the settings that could not be reached, with the reason.
        self.unreachable: dict[str, str] = {}

    def salt(self) -> str:
        now, last = self.clock(), self.last
        self.last = now
        if not self.fixed and now - last > 60 * self.settings.ttl_minutes:
            self.session_salt = new_salt()
        return self.session_salt if self.fixed or self.settings.mode == "session" else new_salt()

    def purge(self) -> None:
        """Forget the session's mapping: values get other masks from now on."""
        self.fixed, self.session_salt = None, new_salt()

    def register(self, database: str, name: str, df: DataFrame, keys: tuple[str, ...] = (), is_collection: bool = False) -> None:
        self.catalog.register(database, name, df, keys, is_collection)

    def connect(self, read: Callable[[SparkSession, dict[str, Any], str], DataFrame] = readers.jdbc_table) -> list[str]:
        """Register the tables of the settings' databases; a database that is down is left out, with its reason in
        `unreachable`. Each has type, host, database and `tables`, a list of names or a map of names to their
        keys. A table outside the default schema is known as schema_table."""
        for name, config in self.settings.databases.items():
            tables = config.get("tables") or {}
            try:
                found = {t: read(self.spark, config, t) for t in tables}
            except Exception as error:
                self.unreachable[name] = values.redact_message_text(str(error).splitlines()[0] if str(error) else type(error).__name__)
                continue
            self.catalog.databases.setdefault(name, {})
            for table, df in found.items():
                keys = tables[table] if isinstance(tables, dict) else ()
                self.register(name, catalog.listed(*catalog.qualified(table)).replace(".", "_"), df, tuple(keys or ()))
        return sorted(set(self.settings.databases) - set(self.unreachable))

    def list_tables(self, database: str) -> list[str]:
        return self.catalog.list_tables(database)

    def describe(self, database: str, table: str) -> DataFrame:
        return self.catalog.describe(database, gate.valid_identifier(table))

    # SQL

    @contextmanager
    def views(self, database: str) -> Iterator[None]:
        """The database's tables as views, and nothing else: other requests of the session wait, and the views go."""
        tables, conf = self.catalog.tables(database), self.spark.conf
        with LOCK:
            before = conf.get(QUOTES)
            conf.set(QUOTES, "true")  # else "name" would be a text
            try:
                for name, table in tables.items():
                    table.df.createOrReplaceTempView(name)
                yield
            finally:
                conf.set(QUOTES, before)
                for name in tables:
                    self.spark.catalog.dropTempView(name)

    def analysed(self, query: str) -> DataFrame:
        try:
            return self.spark.sql(query)
        except Exception as error:
            message = str(getattr(error, "desc", None) or error).splitlines()[0]
            raise Denied("ANALYSIS", values.redact_message_text(message)) from None

    def sql(self, database: str, query: str, max_rows: int | None = None, limited: bool = True) -> QueryResult:
        """Check, analyse, find each column's type by lineage (and values, where lineage has none), mask.

        Sums and averages of sensitive floating-point numbers are made of decimals, so that the order of rows does not
        change a mask."""
        with self.views(database):
            return self._sql(database, gate.without_top(query), max_rows, limited)

    def _sql(self, database: str, query: str, max_rows: int | None, limited: bool) -> QueryResult:
        tables = self.catalog.tables(database)
        gate.check(self.spark, query, set(tables), self.settings.blocked_tables, self.settings.blocked_functions)
        raw = self.analysed(query)
        types: dict[lineage.Source, str] = {}
        read = lineage.tables(raw)
        if read - set(tables):
            raise Denied("UNKNOWN_TABLE", ", ".join(sorted(read - set(tables))))
        used = sorted(read)
        for name in used:
            types |= {(name, c.lower()): k for c, k in self.catalog.types(database, name).items()}
        order = self.settings.precedence()
        found, sums = lineage.walked(raw, lambda sources: lineage.resolve(sources, types, order) not in (None, "SAFE"))
        kinds: list[str | None] = [lineage.resolve(sources, types, order, not nested(f.dataType)) for (_, sources), f in zip(found, raw.schema.fields)]
        spans = [(first, last) for text, first, last in sums if text == query]
        exact = self.analysed(lineage.exact_sums(query, spans)) if spans else raw
        named = bands.banded(exact).toDF(*(f"c{i}" for i in range(len(raw.columns))))
        if spans:
            named = named.select(*(F.col(f"c{i}").cast(f.dataType).alias(f"c{i}") for i, f in enumerate(raw.schema.fields)))
        open_ = [f"c{i}" for i, f in enumerate(raw.schema.fields) if kinds[i] is None and isinstance(f.dataType, T.StringType)]
        if open_ and self.settings.scan_values:
            scanned = values.scan(named.limit(self.settings.scan_sample), open_, self.settings.scan_threshold)
            kinds = [k or scanned.get(f"c{i}") for i, k in enumerate(kinds)]
        salt, most = self.salt(), gate.clamp_limit(max_rows or self.settings.max_rows, self.settings.max_rows)
        inner = by_leaf({c: k for name in used for c, k in self.catalog.types(database, name).items() if "." in c})
        columns = [documents.masked_nested(F.col(f"c{i}"), f.dataType, inner, salt, f.name, kinds[i]).alias(f.name) for i, f in enumerate(raw.schema.fields)]
        out = named.select(*columns)
        inside = [lineage.resolve(sources, types, order) for _, sources in found]
        masked = [c for c, *k in zip(raw.columns, kinds, inside) if set(k) - {None, "SAFE"}]
        return QueryResult(out.limit(most) if limited else out, raw.columns, used, masked)

    # Documents

    def _documents(self, database: str, name: str, out: DataFrame) -> QueryResult:
        types, order = self.catalog.types(database, name), self.settings.precedence()
        # Computed fields inherit from the fields that they are computed from.
        known = {(collection_view(database, name), path.lower()): kind for path, kind in types.items()}
        found = {n: lineage.resolve(s, known, order, not nested(out.schema[n].dataType)) for n, s in lineage.trace(out)}
        kinds = {n: k for n, k in found.items() if k}
        # A path that a stage has put something else under keeps its type only by lineage.
        own = {p: k for p, k in by_leaf(types).items() if p not in out.columns or p in kinds}
        masked = documents.masked_documents(out, own, self.salt(), kinds)
        return QueryResult(masked, out.columns, [name], sorted({p for p in types if p.split(".")[0] in out.columns} | {n for n, k in kinds.items() if k != "SAFE"}))

    def find(self, database: str, collection: str, filter: Any = "{}", projection: Any = None, limit: int = 100, limited: bool = True) -> QueryResult:
        table = self.catalog.table(database, collection)
        return self._documents(database, collection, documents.find(table.df, filter, projection, gate.clamp_limit(limit, self.settings.max_rows) if limited else None))

    def aggregate(self, database: str, collection: str, pipeline: Any = "[]", limit: int = 100, limited: bool = True) -> QueryResult:
        table = self.catalog.table(database, collection)
        return self._documents(database, collection, documents.aggregate(table.df, pipeline, gate.clamp_limit(limit, self.settings.max_rows) if limited else None))

    # Fixtures

    def fixtures(self, database: str, table: str, limit: int = 10, format: str = "json") -> dict[str, Any]:
        """A few masked rows of a table or collection as JSON or CSV (tables only); the first by key, if there is one."""
        gate.valid_identifier(table)
        found, types = self.catalog.table(database, table), self.catalog.types(database, table)
        if found.is_collection and format != "json":
            raise ValueError("collections are exported as json")
        out = documents.masked_documents((found.df.orderBy(*found.keys) if found.keys else found.df).limit(gate.clamp_limit(limit, self.settings.max_rows)), types, self.salt()).cache()
        try:
            return {"format": format, "table": table, "row_count": out.count(), "pii_columns_anonymized": [c for c, k in types.items() if k != "SAFE"], "content": fixtures.content(out, format)}
        finally:
            out.unpersist()
