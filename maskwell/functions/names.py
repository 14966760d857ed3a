"""Classification of columns by their names: globs, manual levels, overrides and table context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LEVELS, Settings

BOOLEAN = ("boolean", "bool", "bit")


def glob_regex(glob: str) -> str:
    """A regular expression for a glob with * ? and [..] that both Java and RE2 read."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]")
            i = end
        else:
            out.append("\\" + c if c in ".^$+{}()|[]\\" else c)
        i += 1
    return "^" + "".join(out) + r"\z"


def matches(name: Column, globs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(name).rlike(glob_regex(g.lower())) for g in globs), F.lit(False))


def leaf(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def manual(name: Column, settings: Settings) -> Column:
    rules = [F.when(matches(name, settings.sensitivity[level]), F.lit(kind)) for level, kind in LEVELS if isinstance(settings.sensitivity.get(level), list)]
    return F.coalesce(*rules, F.lit(None).cast("string"))


def overridden(name: Column, settings: Settings) -> Column:
    rules = [F.when(F.lower(name) == key.lower(), F.lit(kind.upper())) for key, kind in settings.overrides.items()]
    return F.coalesce(*rules, F.lit(None).cast("string"))


def by_pattern(name: Column, settings: Settings) -> Column:
    """The first type, in the settings' order, one of whose globs matches."""
    return F.coalesce(*(F.when(matches(name, globs), F.lit(kind)) for kind, globs in settings.patterns.items()), F.lit(None).cast("string"))


def by_context(name: Column, table: Column, settings: Settings) -> Column:
    """A type for plain column names (amount, rate) in tables whose name gives them away."""
    rules = [F.when((matches(table, rule.get("tables", [])) | matches(leaf(table), rule.get("tables", []))) & F.lower(name).isin([c.lower() for c in rule.get("columns", [])]), F.lit(kind.upper())) for kind, rule in settings.table_context.items()]
    return F.coalesce(*rules, F.lit(None).cast("string"))


def table_type(table: Column, name: Column, data_type: Column, settings: Settings) -> Column:
    """Type of a table's column: none for booleans, else manual level, override, name, table context."""
    found = F.coalesce(manual(name, settings), overridden(name, settings), by_pattern(name, settings), by_context(name, table, settings))
    return F.when(~F.lower(data_type).isin(*BOOLEAN), found)


def document_type(path: Column, settings: Settings) -> Column:
    """Type of a document's dotted path: manual level and name by the last part, override by the whole path."""
    return F.coalesce(manual(leaf(path), settings), overridden(path, settings), by_pattern(leaf(path), settings))


# The same on the driver, for one name at a time.


def _any(name: str, globs: list[str]) -> bool:
    import re

    return any(re.match(glob_regex(g.lower()).replace(r"\z", r"\Z"), name.lower()) for g in globs)


def name_type(name: str, settings: Settings, table: str | None = None, data_type: str = "", path: str | None = None) -> str | None:
    """Type of one column; with `path`, of a document's field."""
    if path is None and data_type.lower() in BOOLEAN:
        return None
    for level, kind in LEVELS:
        if isinstance(settings.sensitivity.get(level), list) and _any(name, settings.sensitivity[level]):
            return kind
    for key, kind in settings.overrides.items():
        if key.lower() == (path or name).lower():
            return kind.upper()
    for kind, globs in settings.patterns.items():
        if _any(name, globs):
            return kind
    if table and path is None:
        for kind, rule in settings.table_context.items():
            tables = rule.get("tables", [])
            if (_any(table, tables) or _any(table.rsplit(".", 1)[-1], tables)) and name.lower() in [c.lower() for c in rule.get("columns", [])]:
                return kind.upper()
    return None
