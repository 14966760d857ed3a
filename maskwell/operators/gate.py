"""Which requests may run: SQL by its parsed plan, documents by an allow-list, and the rules as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class Denied(ValueError):
    """A refused request, with a stable code."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


# Names that a query must not use, by dialect.
WRITE_WORDS = ["INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "COPY", "CREATE", "GRANT", "REVOKE"]
DANGEROUS = {
    "postgresql": ["pg_read_file", "pg_read_binary_file", "lo_import", "lo_export", "pg_execute_server_program", "dblink", "encode", "convert_from", "convert_to"],
    "mysql": ["LOAD_FILE", r"INTO\s+OUTFILE", r"INTO\s+DUMPFILE", "BENCHMARK", "SLEEP"],
    "mssql": ["xp_cmdshell", "xp_regread", "xp_regwrite", "xp_dirtree", "xp_fileexist", "OPENROWSET", "OPENDATASOURCE", "sp_configure", "sp_addextendedproc"],
}
SYSTEM_TABLES = {
    "postgresql": ["pg_shadow", "pg_authid", "pg_roles", "pg_stat_activity", "pg_user", "pg_settings", "pg_class", "pg_proc", "pg_namespace", "information_schema"],
    "mysql": ["mysql.user", "mysql.db", "mysql.tables_priv", "mysql.columns_priv", "mysql.global_grants", "mysql.password_history", "performance_schema", "mysql.slow_log", "mysql.general_log"],
    "mssql": ["sys.sql_logins", "sys.syslogins", "sys.server_principals", "sys.credentials", "sys.configurations", "sys.dm_exec_connections", "sys.linked_logins", "sys.asymmetric_keys", "sys.symmetric_keys"],
}
#: Spark functions that run code or read files outside the tables.
SPARK_DANGEROUS = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "version", "current_user", "session_user", "user"}
#: Table functions that a query may call.
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer", "sql_keywords"}
QUERY_ROOTS = {"Project", "Aggregate", "Distinct", "Deduplicate", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Union", "Intersect", "Except", "UnresolvedWith", "WithCTE", "UnresolvedHaving", "UnresolvedInlineTable", "SubqueryAlias", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "WithWindowDefinition", "UnresolvedTableValuedFunction", "LimitAll", "LocalRelation", "Pivot", "UnresolvedPivot"}


# Column expressions


def without_literals(query: Column) -> Column:
    """The query with line comments, block comments, then quoted strings and names blanked, in that order."""
    out = F.regexp_replace(query, r"--[^\n]*", " ")
    out = F.regexp_replace(out, r"(?s)/\*.*?\*/", " ")
    out = F.regexp_replace(out, r"'(?:[^']|'')*'", "''")
    return F.regexp_replace(out, r'"(?:[^"\\]|\\.)*"', '""')


def is_identifier(name: Column) -> Column:
    """One or two parts of ASCII letters, digits and underscores, not starting with a digit."""
    return name.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*(\.[a-zA-Z_][a-zA-Z0-9_]*)?\z")


def verdict(query: Column, dialect: str = "postgresql", blocked_tables: tuple[str, ...] = ()) -> Column:
    """ALLOWED, or the code of the first rule that the query's text breaks."""
    clean = without_literals(F.trim(query, F.lit(" \t\r\n\x0b\x0c")))
    statements = F.size(F.filter(F.split(clean, ";"), lambda p: p.rlike(r"\S")))
    tables = reduce(lambda a, b: a | b, (clean.rlike(rf"(?i)\b{t.replace('.', r'\.')}\b") for t in [*SYSTEM_TABLES.get(dialect, []), *blocked_tables]), F.lit(False))
    call = r"\s*\(?" if dialect == "mssql" else r"\s*\("
    functions = clean.rlike(rf"(?i)\b({'|'.join(DANGEROUS.get(dialect, ['(?!)']))}){call}")
    return (
        F.when(query.isNull() | ~query.rlike(r"\S"), "EMPTY")
        .when(statements > 1, "MULTI_STATEMENT")
        .when(clean.rlike(rf"(?i)\b({'|'.join(WRITE_WORDS)})\b"), "WRITE")
        .when(functions, "FUNCTION")
        .when(tables, "TABLE")
        .otherwise("ALLOWED")
    )


# Shell commands that would go around the masking.
SHELL_RULES = {
    "DATABASE_CLIENT": r"(^|[\s;&|/(])(psql|pg_dump|mysql|mysqldump|mongosh?|mongodump|sqlcmd|bcp|sqlite3)(\s|$)",
    "CONTAINER": r"(^|[\s;&|/(])(docker|podman|kubectl)\s+(exec|cp|run|inspect|logs)\b",
    "SECRET_FILE": r"(^|[\s/'\x22=])\.env(\b|$)|config\.ya?ml|\.pgpass|\.my\.cnf",
    "PROCESS": r"/proc/|(^|[\s;&|/(])(strace|ltrace|gdb|ptrace|tcpdump)(\s|$)",
}


def classify_command(command: Column) -> Column:
    """The rule that a shell command breaks, or ALLOWED."""
    return F.coalesce(*(F.when(command.rlike("(?i)" + rule), F.lit(code)) for code, rule in SHELL_RULES.items()), F.lit("ALLOWED"))


def clamp(n: Column, most: int) -> Column:
    return F.greatest(F.lit(1), F.least(n, F.lit(most)))


def clamp_limit(n: int, most: int) -> int:
    return max(1, min(int(n), most))


def valid_identifier(name: str) -> str:
    if not re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_]*(\.[a-zA-Z_][a-zA-Z0-9_]*)?", name):
        raise Denied("IDENTIFIER", name)
    return name


# Plans


def sequence(items) -> list:
    """A Scala sequence's items."""
    return [items.apply(i) for i in range(items.size())]


def class_name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _sub_plans(expression) -> list:
    try:
        return [expression.plan()]
    except Exception:  # no subquery
        return []


def walk(plan) -> Iterator[tuple[str, Any]]:
    """All plan nodes and expressions, with those of subqueries and common table expressions."""
    stack = [("plan", plan)]
    while stack:
        kind, node = stack.pop()
        yield kind, node
        name = class_name(node)
        if kind == "plan":
            stack += [("plan", c) for c in sequence(node.children())] + [("expression", e) for e in sequence(node.expressions())]
            if name == "UnresolvedWith":
                stack += [("plan", pair._2()) for pair in sequence(node.cteRelations())]
        else:
            stack += [("expression", c) for c in sequence(node.children())]
            if "Subquery" in name or name in ("Exists", "ListQuery", "LateralSubquery"):
                stack += [("plan", p) for p in _sub_plans(node)]


TOP = re.compile(r"\A(\s*SELECT\s+(?:DISTINCT\s+)?)TOP\s*(?:\(\s*(\d+)\s*\)|(\d+))\s", re.IGNORECASE)


def without_top(query: str) -> str:
    """SELECT TOP n at the start of a query, which one dialect has, as a LIMIT at its end."""
    found = TOP.match(query or "")
    if not found:
        return query
    body = query[found.end() :].rstrip().removesuffix(";")
    return f"{found[1]}{body}\nLIMIT {found[2] or found[3]}"


def relations(plan, local: frozenset[str] = frozenset()) -> Iterator[Any]:
    """The relations of a parsed plan that name no common table expression in scope there.

    An expression of a WITH sees those before it and, if recursive, itself; names inside a subquery end with it.
    """
    stack = [("plan", plan, local)]
    while stack:
        kind, node, local = stack.pop()
        name = class_name(node)
        if kind == "expression":
            stack += [("expression", c, local) for c in sequence(node.children())]
            if "Subquery" in name or name in ("Exists", "ListQuery"):
                stack += [("plan", p, local) for p in _sub_plans(node)]
            continue
        if name == "UnresolvedWith":
            for pair in sequence(node.cteRelations()):
                own = pair._1().lower()
                stack.append(("plan", pair._2(), local | {own} if node.allowRecursion() else local))
                local = local | {own}
        elif name == "UnresolvedRelation":
            if ".".join(str(p) for p in sequence(node.multipartIdentifier())).lower() not in local:
                yield node
        stack += [("plan", c, local) for c in sequence(node.children())] + [("expression", e, local) for e in sequence(node.expressions())]


def parse(spark: SparkSession, query: str):
    """The parsed plan of a read-only query; anything else is Denied before it is analysed or run."""
    if not query or not query.strip():
        raise Denied("EMPTY")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as error:
        text = str(getattr(error, "desc", None) or error)
        parts = [p for p in re.sub(r"'(?:[^']|'')*'", "''", query).split(";") if p.strip()]
        raise Denied("MULTI_STATEMENT" if len(parts) > 1 else "SYNTAX", text.splitlines()[0] if text and len(parts) < 2 else "") from None
    if class_name(plan) == "CompoundBody":
        raise Denied("MULTI_STATEMENT")
    if class_name(plan) not in QUERY_ROOTS:
        raise Denied("WRITE", class_name(plan))
    return plan


def check(spark: SparkSession, query: str, tables: set[str], blocked_tables: tuple[str, ...] = (), blocked_functions: tuple[str, ...] = ()) -> None:
    """Parse a query and refuse unknown or blocked tables, path relations and dangerous functions.

    `tables` are the known names; the name of a common table expression is known where it is in scope.
    """
    plan = parse(spark, query)
    denied = {f.lower() for f in blocked_functions} | SPARK_DANGEROUS
    blocked = {t.lower() for t in blocked_tables} | {t for names in SYSTEM_TABLES.values() for t in names}
    for node in relations(plan):
        full = ".".join(str(p) for p in sequence(node.multipartIdentifier())).lower()
        if full in blocked or full.split(".")[0] in blocked:
            raise Denied("TABLE", full)
        if full not in tables:
            raise Denied("UNKNOWN_TABLE", full)
    for kind, node in walk(plan):
        name = class_name(node)
        if kind == "plan" and name not in QUERY_ROOTS and (name.endswith("Command") or name.endswith("Statement") or name.startswith(("Insert", "Create", "Drop", "Merge", "Update", "Delete", "Write", "Append", "Overwrite"))):
            raise Denied("WRITE", name)
        if name == "UnresolvedRelation":
            parts = [str(p) for p in sequence(node.multipartIdentifier())]
            full = ".".join(parts).lower()
            if full in blocked or parts[0].lower() in blocked:
                raise Denied("TABLE", full)
        elif name == "UnresolvedFunction":
            called = str(sequence(node.nameParts())[-1]).lower()
            if called in denied:
                raise Denied("FUNCTION", called)
        elif name == "UnresolvedTableValuedFunction":
            called = str(sequence(node.name())[-1]).lower()
            if called not in TABLE_FUNCTIONS:
                raise Denied("FUNCTION", called)


# Document requests

# Operators and stages that document requests must not use.
DENIED_OPERATORS = {"$where", "$function", "$accumulator", "$expr"}
DENIED_STAGES = {"$out", "$merge", "$lookup", "$graphlookup", "$unionwith"}


def check_document(part: Any) -> None:
    """Refuse denied operators and stages at any depth, whatever their case."""
    if isinstance(part, dict):
        for key, value in part.items():
            if str(key).lower() in DENIED_OPERATORS:
                raise Denied("OPERATOR", key)
            if str(key).lower() in DENIED_STAGES:
                raise Denied("STAGE", key)
            check_document(value)
    elif isinstance(part, list):
        for item in part:
            check_document(item)
