"""Named queries over the driver's tables, and the DuckDB SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import NAME_PATTERNS, Settings
from ..engine import Engine
from ..functions import mask, names, values
from ..operators import documents, fixtures, gate
from ..sources import catalog, readers
from ..streaming import limits
from . import duck_masks
from .views import SALT, duck, lines, table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SETTINGS = Settings(
    sensitivity={"public": ["id", "slip"], "secret": ["api_*"], "confidential": ["internal_*"]},
    overrides={"grade": "SAFE", "segment": "SAFE"},
    table_context={"SALARY": {"tables": ["*payroll*"], "columns": ["amount", "rate"]}},
    scan_values=False,
)


def add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


# Masks of single columns


def mask_query(source: str, masks: dict[str, tuple[str, str]], keep: list[str]) -> tuple[Query, str]:
    """Mask columns of a view; the oracle masks the same view in DuckDB."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = view(spark, sf_dir, source)
        return df.select(*keep, *(mask.masked(F.col(c), df.schema[c].dataType, kind, SALT, c).alias(c) for c, (kind, _) in masks.items()))

    return run, duck_masks.masked(duck(source), masks, keep)


for _kind in ("FIRST_NAME", "LAST_NAME", "PERSON", "ADDRESS", "IP", "IBAN", "FINANCIAL", "SSN", "GEO", "CREDENTIAL", "DATE_OF_BIRTH", "URL", "SECRET"):
    add(f"mask_{_kind.lower()}", *mask_query("people", {"full_name": (_kind, "text")}, ["id"]))
add("mask_person_customer", *mask_query("people", {"full_name": ("PERSON", "text"), "email": ("EMAIL", "text"), "phone": ("PHONE", "text"), "city": ("CITY", "text"), "salary": ("SALARY", "double")}, ["id", "is_vip"]))
add("mask_email_view", *mask_query("people", {"email": ("EMAIL", "text")}, ["id"]))
add("mask_phone_view", *mask_query("people", {"phone": ("PHONE", "text")}, ["id"]))
add("mask_city_country", *mask_query("people", {"city": ("CITY", "text"), "country": ("COUNTRY", "text")}, ["id"]))
add("mask_siren_siret", *mask_query("people", {"phone": ("SIREN", "text"), "email": ("SIRET", "text")}, ["id"]))
add("mask_confidential_mixed", *mask_query("products", {"internal_margin": ("CONFIDENTIAL", "double"), "risk_score": ("CONFIDENTIAL", "int"), "brand": ("SECRET", "text")}, ["id"]))
add("mask_number_as_person", *mask_query("people", {"nation": ("PERSON", "int"), "salary": ("CREDENTIAL", "double")}, ["id"]))
add("perturb_salary_acctbal", *mask_query("people", {"salary": ("SALARY", "double")}, ["id"]))
add("perturb_score", *mask_query("products", {"risk_score": ("SCORE", "int")}, ["id"]))
add("perturb_price_part", *mask_query("products", {"unit_price": ("PRICE", "double")}, ["id"]))
add("perturb_revenue_orders", *mask_query("payroll", {"amount": ("REVENUE", "double")}, ["slip"]))


def mask_url_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", mask.masked(F.col("url"), T.StringType(), "URL", SALT).alias("url"))


add("mask_url_pages", mask_url_pages, duck_masks.masked("SELECT page_id, url FROM pages", {"url": ("URL", "text")}, ["page_id"]))

GUARDS = "SELECT 1 AS k, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS VARCHAR(20)) AS t UNION ALL SELECT 2, 0.0, '' UNION ALL SELECT 3, 1000.0, '   ' UNION ALL SELECT 4, -1.0, '1000' UNION ALL SELECT 5, 10000000.0, 'abc'"


def mask_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(GUARDS.replace("VARCHAR(20)", "STRING")).withColumn("x", F.col("x").cast("double"))
    numeric_text = mask.masked(F.col("t"), T.StringType(), "SALARY", SALT)
    shown = F.when(F.col("t").isNull() | (F.trim("t") == ""), F.lit("blank")).when(numeric_text == mask.REDACTED, numeric_text).otherwise("number")
    return df.select("k", mask.masked(F.col("x"), T.DoubleType(), "SALARY", SALT).alias("x"), mask.masked(F.col("t"), T.StringType(), "PERSON", SALT).alias("t"), shown.alias("numeric_text"))


add("mask_null_blank_zero_guards", mask_guards, duck_masks.masked(f"SELECT k, CAST(x AS DOUBLE) AS x, t, CASE WHEN t IS NULL OR trim(t) = '' THEN 'blank' WHEN try_cast(t AS DOUBLE) IS NULL THEN '[REDACTED]' ELSE 'number' END AS numeric_text FROM ({GUARDS})", {"x": ("SALARY", "double"), "t": ("PERSON", "text")}, ["k", "numeric_text"]))


def mask_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").cast("binary").alias("raw"))
    return df.select("n_nationkey", mask.masked(F.col("raw"), T.BinaryType(), None, SALT).alias("raw"))


add("mask_binary", mask_binary, "SELECT n_nationkey, '[BINARY DATA]' AS raw FROM nation")

# Seeds and mappings


def seed_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", mask.seed(F.col("c_name"), SALT).alias("seed"))


add("seed_mod_1e9", seed_mod, f"SELECT c_custkey, {duck_masks.seed('c_name')} AS seed FROM customer")


def mapping_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session's mapping store would hold: one row per value, the first type in order."""
    df = table(spark, sf_dir, "orders").select(F.lit("s1").alias("session_id"), F.lit("CREDENTIAL").alias("entity_type"), F.col("o_orderpriority").alias("value"))
    df = df.select("session_id", "entity_type", mask.mapping_key(F.col("session_id"), F.col("value")).alias("value_hash"), mask.generated("CREDENTIAL", F.col("value"), SALT).alias("fake_value"))
    return df.dropDuplicates(["session_id", "value_hash"])


add("mapping_hash_store", mapping_store, f"SELECT DISTINCT 's1' AS session_id, 'CREDENTIAL' AS entity_type, sha256('s1:' || o_orderpriority) AS value_hash, substr(sha256(o_orderpriority || '{SALT}|c'), 1, 12) AS fake_value FROM orders")


def mapping_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a session that its mapping holds."""
    key = mask.mapping_key(F.lit("s1"), F.col("c_mktsegment")).alias("value_hash")
    held = table(spark, sf_dir, "customer").where("c_nationkey < 3").select(key).distinct()
    return table(spark, sf_dir, "customer").select("c_custkey", key).join(held.withColumn("hit", F.lit(True)), "value_hash", "left").groupBy(F.coalesce("hit", F.lit(False)).alias("hit")).agg(F.count("*").alias("n"))


add("mapping_lookup", mapping_lookup, "SELECT c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_nationkey < 3) AS hit, count(*) AS n FROM customer GROUP BY 1")


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    masked = mask.masked(F.col("o_custkey"), T.LongType(), "CREDENTIAL", SALT)
    return df.agg(F.countDistinct("o_custkey").alias("raw"), F.countDistinct(masked).alias("masked"))


add("mapping_distinct_counts", distinct_counts, "SELECT count(DISTINCT o_custkey) AS raw, count(DISTINCT o_custkey) AS masked FROM orders")

# Names

NAMES = ["first_name", "lastname2", "prenom", "c_name", "username", "EMAIL_ADDRESS", "ip_address", "country_name", "velocity", "hotel_id", "filename", "unzipped", "amount", "unit_price", "credit_score", "gross_margin", "api_token", "card_number", "birth_date", "siret_no", "siren", "geo_x", "home_url", "note_1", "taux_tva", "is_active", "address.street", "contact.email", "x", "", "internal_rate", "id", "grade", "mobile", "ssn4"]


def like(pattern: str) -> str:
    return pattern.replace("_", "!_").replace("*", "%")


def pattern_case(column: str) -> str:
    """First matching type, by LIKE."""
    return "CASE " + " ".join(f"WHEN lower({column}) LIKE '{like(g)}' ESCAPE '!' THEN '{kind}'" for kind, globs in NAME_PATTERNS.items() for g in globs) + " END"


MANUAL = "CASE WHEN lower({c}) LIKE 'api!_%' ESCAPE '!' THEN 'SECRET' WHEN lower({c}) LIKE 'internal!_%' ESCAPE '!' THEN 'CONFIDENTIAL' WHEN lower({c}) IN ('id', 'slip') THEN 'SAFE' END"
OVERRIDE = "CASE WHEN lower({c}) IN ('grade', 'segment') THEN 'SAFE' END"


def name_query(rule: Callable[..., object], tables: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.sql(lines(NAMES, "name"))
        if tables:
            df = df.crossJoin(spark.sql(lines(["hr.Payroll_2024", "payroll", "other"], "tab")))  # three inline rows
        return df.select(*df.columns, rule().alias("pii_type"))

    return run


add("classify_columns_by_name", name_query(lambda: names.by_pattern(F.col("name"), SETTINGS)), f"SELECT name, {pattern_case('name')} AS pii_type FROM ({lines(NAMES, 'name')})")
add("classify_with_sensitivity", name_query(lambda: names.manual(F.col("name"), SETTINGS)), f"SELECT name, {MANUAL.format(c='name')} AS pii_type FROM ({lines(NAMES, 'name')})")
add("classify_with_overrides", name_query(lambda: names.overridden(F.col("name"), SETTINGS)), f"SELECT name, {OVERRIDE.format(c='name')} AS pii_type FROM ({lines(NAMES, 'name')})")
CONTEXT = "CASE WHEN lower(tab) LIKE '%payroll%' AND lower(name) IN ('amount', 'rate') THEN 'SALARY' END"
BOTH = f"({lines(NAMES, 'name')}) CROSS JOIN ({lines(['hr.Payroll_2024', 'payroll', 'other'], 'tab')})"
add("classify_table_context", name_query(lambda: names.by_context(F.col("name"), F.col("tab"), SETTINGS), True), f"SELECT name, tab, {CONTEXT} AS pii_type FROM {BOTH}")
add("classify_tables", name_query(lambda: names.table_type(F.col("tab"), F.col("name"), F.when(F.col("name") == "is_active", "boolean").otherwise("string"), SETTINGS), True), f"SELECT name, tab, CASE WHEN name <> 'is_active' THEN coalesce({MANUAL.format(c='name')}, {OVERRIDE.format(c='name')}, {pattern_case('name')}, {CONTEXT}) END AS pii_type FROM {BOTH}")
LEAF = "split_part(name, '.', -1)"
add("classify_documents", name_query(lambda: names.document_type(F.col("name"), SETTINGS)), f"SELECT name, coalesce({MANUAL.format(c=LEAF)}, {OVERRIDE.format(c='name')}, {pattern_case(LEAF)}) AS pii_type FROM ({lines(NAMES, 'name')})")


def describe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of three tables with their types by name and context."""
    engine = registered(spark, sf_dir)
    parts = [engine.describe("d", t).withColumn("tab", F.lit(t)) for t in ("people", "payroll", "products")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("tab", "name", "primary_key", "pii_type")


DESCRIBED = {
    "people": {"id": "SAFE", "full_name": "PERSON", "email": "EMAIL", "phone": "PHONE", "city": "CITY", "country": "COUNTRY", "nation": None, "salary": "SALARY", "segment": "SAFE", "is_vip": None},
    "payroll": {"slip": "SAFE", "employee_id": None, "amount": "SALARY", "grade": "SAFE"},
    "products": {"id": "SAFE", "brand": None, "unit_price": "PRICE", "risk_score": "SCORE", "internal_margin": "CONFIDENTIAL"},
}
sql_text = lambda v: "NULL" if v is None else f"'{v}'"
add("describe_all_tables", describe_tables, " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS name, {'true' if c == 'id' else 'false'} AS primary_key, {sql_text(k)} AS pii_type" for t, own in DESCRIBED.items() for c, k in own.items()))


def list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in registered(spark, sf_dir).list_tables("d")], "name string")


add("list_tables", list_tables, "SELECT 'payroll' AS name UNION ALL SELECT 'people' UNION ALL SELECT 'products'")

# Values

EDGES = ["192.168.1.10", "1.2.3.4", "4111 1111 1111 1111", "123 456 789", "123 456 789 00012", "4111111111111111", "2024-01-02 x", "HOUSEHOLD", "Jean-Pierre", "view", "a@b.co", "https://x.org/y", "FR7612345678", "+33 6 12 34 56 78", "Marie Curie", "null", "x", "", "  ", None, "O'Brien", "12/05/2024", "-3.5", "Anna B2", "McGregor Ltd"]


def word_boundary(kind: str) -> str:
    return f"regexp_full_match(v, '{values.PATTERNS[kind]}')"


SCANNED = f"(SELECT trim(value, ' ' || chr(9)) AS v, value FROM ({lines(EDGES, 'value')}))"
NUMBER = f"regexp_matches(v, '{values.NUMBER_OR_DATE.replace(r'\z', '$')}')"


def edge_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(lines(EDGES, "value"))
    return df.select("value", *(F.coalesce(values.matches(F.col("value"), k), F.lit(False)).alias(k.lower()) for k in values.PATTERNS), F.coalesce(values.is_number_or_date(F.col("value")), F.lit(False)).alias("number"))


add("scan_edge_values", edge_types, f"SELECT value, {', '.join(f'coalesce({word_boundary(k)}, false) AS {k.lower()}' for k in values.PATTERNS)}, coalesce({NUMBER}, false) AS number FROM {SCANNED}")

NAME_TEST = (
    "(len(v) BETWEEN 2 AND 60 AND lower(v) NOT IN (" + ", ".join(f"'{w}'" for w in values.NO_NAMES) + ") AND NOT regexp_matches(v, '[0-9]') "
    "AND len(list_filter(regexp_split_to_array(v, '[\\s\\-]+'), lambda p: regexp_matches(p, '" + values.NAME_WORD.replace(r"\z", "$").replace("'", "''") + "'))) >= 1 "
    "AND 2 * len(list_filter(regexp_split_to_array(v, '[\\s\\-]+'), lambda p: regexp_matches(p, '" + values.NAME_WORD.replace(r"\z", "$").replace("'", "''") + "'))) >= len(regexp_split_to_array(v, '[\\s\\-]+')))"
)


def edge_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(lines(EDGES, "value")).select("value", F.coalesce(values.looks_like_name(F.col("value")), F.lit(False)).alias("is_name"))


add("scan_person_heuristic", edge_names, f"SELECT value, coalesce({NAME_TEST}, false) AS is_name FROM {SCANNED}")


def scan_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "people")
    parts = [df.agg(*(r.alias(k.lower()) for k, r in values.ratios(F.col(c)).items())).withColumn("name", F.lit(c)) for c in ("full_name", "email", "phone", "segment")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def ratio_sql(kind: str) -> str:
    test = NAME_TEST if kind == "PERSON" else word_boundary(kind)
    some = f"v <> '' AND NOT {NUMBER}" if kind in values.NOT_NUMBERS else "v <> ''"
    return f"count(*) FILTER ({some} AND {test}) / nullif(count(*) FILTER ({some}), 0)::DOUBLE"


add("scan_ratio_per_type", scan_ratios, " UNION ALL ".join(f"SELECT {', '.join(f'{ratio_sql(k)} AS {k.lower()}' for k in [*values.PATTERNS, 'PERSON'])}, '{c}' AS name FROM (SELECT trim({c}) AS v FROM ({duck('people')}))" for c in ("full_name", "email", "phone", "segment")))


def scan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by the 50 smallest distinct values of each text column."""
    found = {}
    for t in ("customer", "part", "orders", "pages"):
        df = table(spark, sf_dir, t)
        found |= {(t, c): k for c, k in catalog.scan_table(df, [c for c in values.text_columns(df) if c != "html"], 50, 0.3).items()}
    return spark.createDataFrame([(t, c, k) for (t, c), k in sorted(found.items())], "tab string, name string, pii_type string")


SCAN_CASE = "CASE " + " ".join(f"WHEN {ratio_sql(k)} >= 0.3 THEN '{k}'" for k in [*values.PATTERNS, "PERSON"]) + " END"
add("scan_numeric_exclusion", scan_tables, "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS name, {SCAN_CASE} AS pii_type FROM (SELECT DISTINCT {c} AS raw, trim({c}) AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY raw LIMIT 50)" for t, cs in {"customer": ["c_name", "c_mktsegment"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "pages": ["url"]}.items() for c in cs) + ") WHERE pii_type IS NOT NULL")


def sample_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.sample_values(table(spark, sf_dir, "customer"), "c_name", 50)


add("sample_distinct_values", sample_distinct, "SELECT DISTINCT c_name FROM customer WHERE c_name IS NOT NULL ORDER BY 1 LIMIT 50")
TEXT_KINDS = ["EMAIL", "IP", "URL"]


def text_counts(name: str, key: str, column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return df.agg(F.count(key).alias("n"), *(F.count_if(F.col(column).rlike(values.PATTERNS[k])).alias(k.lower()) for k in TEXT_KINDS))

    return run


for _name, _key, _column in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text")):
    add(f"text_pii_counts_{_name}", text_counts(_name, _key, _column), f"SELECT count({_key}) AS n, {', '.join(f'count(*) FILTER (regexp_matches({_column}, {sql_text(values.PATTERNS[k])})) AS {k.lower()}' for k in TEXT_KINDS)} FROM {_name}")


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(values.redact_text(F.col("text"), TEXT_KINDS)).alias("redacted"))


REDACTED = "text"
for _kind in TEXT_KINDS:
    REDACTED = f"regexp_replace({REDACTED}, {sql_text(values.PATTERNS[_kind].replace(r'\S', '[^ \t\n\x0b\x0c\r\x85\xa0  -     　]') if _kind == 'URL' else values.PATTERNS[_kind])}, '[VALUE]', 'g')"
add("redact_text_email_ip_url", redact_documents, f"SELECT doc_id, md5({REDACTED}) AS redacted FROM documents")
MESSAGES = ["duplicate key (email)=(ann@x.org) exists", "user Marie Anne Curie not found at 10.0.0.12", "see https://x.org/a b", "plain message", "card 4111 1111 1111 1111 declined"]


def redact_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(lines(MESSAGES, "message")).select("message", values.redact_message(F.col("message")).alias("shown"))


SHOWN = ["duplicate key ([COLUMN])=([VALUE]) exists", "user [VALUE] not found at [VALUE]", "see [VALUE] b", "plain message", "card [VALUE]declined"]
add("redact_error_message", redact_messages, " UNION ALL ".join(f"SELECT {sql_text(m)} AS message, {sql_text(s)} AS shown" for m, s in zip(MESSAGES, SHOWN)))

# Gate

REQUESTS = ["SELECT 1", "WITH x AS (SELECT 1) SELECT * FROM x", "SELECT ';' FROM t;", "SELECT 'INSERT' FROM t -- DROP", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "/* x */ delete from t", "SELECT pg_read_file('x')", "SELECT encode (a, 'b') FROM t", "SELECT * FROM pg_shadow", "SELECT * FROM information_schema.tables", "", "  ", None, "MERGE INTO t USING s", "SELECT copy FROM t", "SELECT \"DROP\" FROM t", "SELECT 1 -- a ; b", "select updated_at from t"]
CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(query, '--[^\n]*', ' ', 'g'), '/\*.*?\*/', ' ', 'gs'), '''(?:[^'']|'''')*''', '''''', 'g'), '\"(?:[^\"\\]|\\.)*\"', '\"\"', 'g')".replace('\\"', '"')


def strip_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(lines(REQUESTS, "query")).select("query", gate.without_literals(F.col("query")).alias("clean"))


add("strip_literals", strip_literals, f"SELECT query, {CLEAN} AS clean FROM ({lines(REQUESTS, 'query')})")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(lines(REQUESTS, "query")).select("query", gate.verdict(F.col("query")).alias("verdict"))


add("validate_queries_verdict", verdicts, f"""SELECT query, CASE WHEN query IS NULL OR trim(query) = '' THEN 'EMPTY'
    WHEN len(list_filter(string_split(clean, ';'), lambda p: trim(p) <> '')) > 1 THEN 'MULTI_STATEMENT'
    WHEN regexp_matches(clean, '\\b({'|'.join(gate.WRITE_WORDS)})\\b', 'i') THEN 'WRITE'
    WHEN regexp_matches(clean, '\\b({'|'.join(gate.DANGEROUS['postgresql'])})\\s*\\(', 'i') THEN 'FUNCTION'
    WHEN regexp_matches(clean, '\\b({'|'.join(gate.SYSTEM_TABLES['postgresql'])})\\b', 'i') THEN 'TABLE' ELSE 'ALLOWED' END AS verdict
    FROM (SELECT query, {CLEAN.replace('(query,', '(trim(query),')} AS clean FROM ({lines(REQUESTS, 'query')}))""")
DIALECT_REQUESTS = ["SELECT load_file('/etc/passwd')", "SELECT 1 INTO OUTFILE 'x'", "select sleep(5)", "SELECT sleep FROM t", "SELECT * FROM mysql.user", "SELECT * FROM performance_schema.threads", "EXEC xp_cmdshell 'dir'", "SELECT * FROM OPENROWSET ('x')", "SELECT * FROM sys.sql_logins", "SELECT TOP 5 * FROM t", "SELECT benchmark(1, 2)", "SELECT 'xp_cmdshell'", "DROP TABLE t", "SELECT 1; SELECT 2"]


def dialect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = spark.sql(lines(DIALECT_REQUESTS, "query"))
    parts = [requests.select(F.lit(d).alias("dialect"), "query", gate.verdict(F.col("query"), d).alias("verdict")) for d in ("mysql", "mssql")]
    return parts[0].unionAll(parts[1])


def dialect_sql(dialect: str, call: str) -> str:
    tables = "|".join(t.replace(".", "\\.") for t in gate.SYSTEM_TABLES[dialect])
    return f"""SELECT '{dialect}' AS dialect, query, CASE WHEN len(list_filter(string_split(clean, ';'), lambda p: trim(p) <> '')) > 1 THEN 'MULTI_STATEMENT'
    WHEN regexp_matches(clean, '\\b({'|'.join(gate.WRITE_WORDS)})\\b', 'i') THEN 'WRITE' WHEN regexp_matches(clean, '\\b({'|'.join(gate.DANGEROUS[dialect])}){call}', 'i') THEN 'FUNCTION'
    WHEN regexp_matches(clean, '\\b({tables})\\b', 'i') THEN 'TABLE' ELSE 'ALLOWED' END AS verdict FROM (SELECT query, {CLEAN} AS clean FROM ({lines(DIALECT_REQUESTS, 'query')}))"""


add("validate_dialects_verdict", dialect_verdicts, dialect_sql("mysql", r"\s*\(") + " UNION ALL " + dialect_sql("mssql", r"\s*\(?"))
IDENTIFIERS = ["t", "a.b", "a.b.c", "1a", "a b", "_x9", "a.", "", "é", "t;", "a\n"]


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(lines(IDENTIFIERS, "name")).select("name", gate.is_identifier(F.col("name")).alias("valid"))


add("validate_identifiers", identifiers, f"SELECT name, regexp_full_match(name, '[a-zA-Z_][a-zA-Z0-9_]*(\\.[a-zA-Z_][a-zA-Z0-9_]*)?') AS valid FROM ({lines(IDENTIFIERS, 'name')})")


def clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", gate.clamp(F.col("p_size") * 5 - 20, 100).alias("n"))


add("clamp_limit", clamped, "SELECT p_partkey, greatest(1, least(p_size * 5 - 20, 100)) AS n FROM part")
COMMANDS = ["psql -c x", "ls -l", "docker exec db sh", "cat .env", "echo $PATH", "cat /proc/1/environ", "strace -p 1", "vim config.yaml", "python a.py"]
COMMAND_CODES = ["DATABASE_CLIENT", "ALLOWED", "CONTAINER", "SECRET_FILE", "ALLOWED", "PROCESS", "PROCESS", "SECRET_FILE", "ALLOWED"]


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(lines(COMMANDS, "command")).select("command", gate.classify_command(F.col("command")).alias("verdict"))


add("classify_commands", commands, " UNION ALL ".join(f"SELECT {sql_text(c)} AS command, {sql_text(v)} AS verdict" for c, v in zip(COMMANDS, COMMAND_CODES)))

# Relational operators under the mask


def registered(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark, SETTINGS, salt=SALT)
    for name, keys in (("people", ("id",)), ("payroll", ()), ("products", ("id",))):
        engine.register("d", name, view(spark, sf_dir, name), keys)
    return engine


def relational(name: str, sql: str, masks: dict[str, tuple[str, str]], keep: list[str], duck_sql: str | None = None) -> None:
    """A query through the engine; the oracle runs it (or `duck_sql`) in DuckDB on raw values, then masks the columns named."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return registered(spark, sf_dir).sql("d", sql, limited=False).df

    views = ", ".join(f"{v} AS ({duck(v)})" for v in ("people", "payroll", "products"))
    plain = duck_sql or sql
    inner = plain if not plain.startswith("WITH ") else plain[5:]
    body = f"WITH {views} SELECT * FROM ({plain})" if inner is plain else f"WITH {'RECURSIVE ' if 'RECURSIVE' in inner else ''}{views}, {inner.removeprefix('RECURSIVE ')}"
    add(name, run, duck_masks.masked(body, masks, keep))


PERSON, EMAIL, SALARY = ("PERSON", "text"), ("EMAIL", "text"), ("SALARY", "double")
EMAIL_NUMBER = ("EMAIL", "int")
relational("masked_join_inner", "SELECT p.full_name, s.slip, s.amount FROM people p JOIN payroll s ON p.id = s.employee_id", {"full_name": PERSON, "amount": SALARY}, ["slip"])
relational("masked_join_left", "SELECT p.id, p.email, s.amount FROM people p LEFT JOIN payroll s ON p.id = s.employee_id", {"email": EMAIL, "amount": SALARY}, ["id"])
relational("masked_join_right", "SELECT s.slip, p.email FROM people p RIGHT JOIN payroll s ON p.id = s.employee_id AND p.nation < 5", {"email": EMAIL}, ["slip"])
relational("masked_join_full", "SELECT p.id, p.full_name, q.unit_price FROM people p FULL JOIN products q ON p.id = q.id", {"full_name": PERSON, "unit_price": ("PRICE", "double")}, ["id"])
relational("masked_semi_join", "SELECT id, email FROM people p WHERE EXISTS (SELECT 1 FROM payroll s WHERE s.employee_id = p.id AND s.amount > 200000)", {"email": EMAIL}, ["id"])
relational("masked_anti_join", "SELECT id, email FROM people p WHERE NOT EXISTS (SELECT 1 FROM payroll s WHERE s.employee_id = p.id)", {"email": EMAIL}, ["id"])
relational("masked_not_in", "SELECT id, full_name FROM people WHERE id NOT IN (SELECT employee_id FROM payroll WHERE amount > 100000)", {"full_name": PERSON}, ["id"])
relational("masked_theta_range", "SELECT p.id, q.id AS qid, p.full_name FROM people p JOIN products q ON q.risk_score BETWEEN p.nation AND p.nation + 1 WHERE p.id < 40 AND q.id < 40", {"full_name": PERSON}, ["id", "qid"])
relational("masked_cross_join", "SELECT p.id, q.id AS qid, p.email FROM people p CROSS JOIN products q WHERE p.id < 5 AND q.id < 5", {"email": EMAIL}, ["id", "qid"])
relational("masked_lateral", "SELECT p.id, x.top FROM people p, LATERAL (SELECT max(s.amount) AS top FROM payroll s WHERE s.employee_id = p.id) x", {"top": SALARY}, ["id"])
relational("masked_asof", "SELECT id, qid, unit_price FROM (SELECT p.id, q.id AS qid, q.unit_price, row_number() OVER (PARTITION BY p.id ORDER BY q.id DESC) AS r FROM people p JOIN products q ON q.id <= p.id AND q.id > p.id - 3) WHERE r = 1", {"unit_price": ("PRICE", "double")}, ["id", "qid"])
relational("masked_group_count", "SELECT city, count(*) AS n, count(DISTINCT email) AS emails FROM people GROUP BY city", {"city": ("CITY", "text")}, ["n", "emails"])
relational("masked_group_sum_perturbed", "SELECT nation, round(sum(salary), 2) AS total, round(avg(salary), 2) AS mean, min(salary) AS low, max(full_name) AS top FROM people GROUP BY nation", {"total": SALARY, "mean": SALARY, "low": SALARY, "top": PERSON}, ["nation"],
           # In whole cents, halves away from zero: sums of doubles would depend on the order of rows.
           "SELECT nation, CAST(cents AS DOUBLE) / 100 AS total, CAST(sign(cents) * ((2 * abs(cents) + paid) // (2 * paid)) AS DOUBLE) / 100 AS mean, low, top FROM (SELECT nation, CAST(sum(CAST(round(salary * 100) AS BIGINT)) AS HUGEINT) AS cents, count(salary) AS paid, min(salary) AS low, max(full_name) AS top FROM people GROUP BY nation)")
relational("masked_having", "SELECT nation, count(*) AS n FROM people GROUP BY nation HAVING avg(salary) > 4000", {}, ["nation", "n"])
relational("masked_count_distinct", "SELECT count(DISTINCT full_name) AS people, count(DISTINCT city) AS cities, count(salary) AS paid FROM people", {}, ["people", "cities", "paid"])
relational("masked_filter_aggregate", "SELECT nation, count(*) FILTER (WHERE salary > 0) AS n, max(email) FILTER (WHERE id > 10) AS m FROM people GROUP BY nation", {"m": EMAIL}, ["nation", "n"])
relational("masked_cube", "SELECT city, segment, count(*) AS n FROM people GROUP BY CUBE (city, segment)", {"city": ("CITY", "text")}, ["segment", "n"])
relational("masked_rollup", "SELECT country, city, count(*) AS n FROM people GROUP BY ROLLUP (country, city)", {"country": ("COUNTRY", "text"), "city": ("CITY", "text")}, ["n"])
relational("masked_grouping_sets", "SELECT city, nation, grouping(city) AS g, count(*) AS n FROM people GROUP BY GROUPING SETS ((city), (nation), ())", {"city": ("CITY", "text")}, ["nation", "g", "n"])
relational("masked_rank_topk", "SELECT * FROM (SELECT id, full_name, nation, rank() OVER (PARTITION BY nation ORDER BY salary DESC) AS r, ntile(4) OVER (PARTITION BY nation ORDER BY salary DESC, id) AS q FROM people) WHERE r <= 3", {"full_name": PERSON}, ["id", "nation", "r", "q"])
relational("masked_lag_lead", "SELECT id, lag(email) OVER (PARTITION BY nation ORDER BY id) AS before, lead(full_name, 2) OVER (PARTITION BY nation ORDER BY id) AS later FROM people", {"before": EMAIL, "later": PERSON}, ["id"])
relational("masked_first_last", "SELECT id, first_value(city) OVER w AS c1, count(email) OVER w AS n FROM people WINDOW w AS (PARTITION BY nation ORDER BY id)", {"c1": ("CITY", "text")}, ["id", "n"])
relational("masked_running_sum", "SELECT slip, round(sum(amount) OVER (PARTITION BY employee_id ORDER BY slip ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS run FROM payroll", {"run": SALARY}, ["slip"])
relational("masked_union", "SELECT id, email AS v FROM people UNION ALL SELECT id, brand FROM products", {"v": EMAIL}, ["id"])
relational("masked_union_distinct", "SELECT city AS v FROM people UNION SELECT country FROM people", {"v": ("CITY", "text")}, [])
relational("masked_intersect", "SELECT email FROM people WHERE nation < 10 INTERSECT SELECT email FROM people WHERE nation > 5", {"email": EMAIL}, [])
relational("masked_except", "SELECT full_name FROM people EXCEPT SELECT full_name FROM people WHERE nation = 3", {"full_name": PERSON}, [])
relational("masked_cte_rename", "WITH x AS (SELECT id, email AS e FROM people), y AS (SELECT id, e AS label FROM x) SELECT id, label FROM y", {"label": EMAIL}, ["id"])
relational("masked_recursive", "WITH RECURSIVE r(n, v) AS (SELECT 1, max(email) FROM people UNION ALL SELECT n + 1, v FROM r WHERE n < 4) SELECT n, v FROM r", {"v": EMAIL}, ["n"])
relational("masked_alias_to_public", "SELECT email AS id, salary AS slip FROM people", {"id": EMAIL, "slip": SALARY}, [])
relational("masked_scalar_subquery", "SELECT id, (SELECT max(full_name) FROM people) AS top, (SELECT count(*) FROM people) AS n FROM products", {"top": PERSON}, ["id", "n"])
relational("masked_concat", "SELECT id, full_name || ' <' || email || '>' AS label FROM people", {"label": PERSON}, ["id"])
relational("masked_case_coalesce", "SELECT id, CASE WHEN email LIKE '%1%' THEN 'odd' ELSE city END AS c, coalesce(CASE WHEN nation > 5 THEN email END, 'none') AS e, email LIKE '%1%' AS has FROM people", {"c": ("CITY", "text"), "e": EMAIL}, ["id", "has"])
relational("masked_functions", "SELECT id, upper(email) AS u, substr(full_name, 1, 6) AS s, length(email) AS n, salary + 1 AS m, CAST(floor(salary) AS BIGINT) AS b FROM people", {"u": EMAIL, "s": PERSON, "m": SALARY, "b": ("SALARY", "int")}, ["id", "n"])
relational("masked_order_limit", "SELECT id, full_name, salary FROM people ORDER BY salary DESC, id LIMIT 20 OFFSET 5", {"full_name": PERSON, "salary": SALARY}, ["id"])
relational("masked_distinct", "SELECT DISTINCT country, nation % 3 AS k FROM people", {"country": ("COUNTRY", "text")}, ["k"])
relational("masked_explode_words", "SELECT id, w FROM people LATERAL VIEW explode(split(full_name, '#')) t AS w", {"w": PERSON}, ["id"])
ORACLES["masked_explode_words"] = duck_masks.masked(f"SELECT id, unnest(string_split(full_name, '#')) AS w FROM ({duck('people')})", {"w": PERSON}, ["id"])

relational("masked_dates", "SELECT slip, year(d) AS y, month(d) AS m, amount FROM (SELECT slip, amount, date_add(DATE '1990-01-01', CAST(slip % 9000 AS INT)) AS d FROM payroll) WHERE d >= DATE '1995-01-01'", {"amount": SALARY}, ["slip", "y", "m"],
           "SELECT slip, year(d)::INT AS y, month(d)::INT AS m, amount FROM (SELECT slip, amount, DATE '1990-01-01' + CAST(slip % 9000 AS INTEGER) AS d FROM payroll) WHERE d >= DATE '1995-01-01'")
relational("masked_spread_listagg", "SELECT nation, count(*) AS n, max(salary) - min(salary) AS spread, listagg(DISTINCT segment, ',') WITHIN GROUP (ORDER BY segment) AS segments FROM people GROUP BY nation", {"spread": SALARY}, ["nation", "n", "segments"],
           "SELECT nation, count(*) AS n, max(salary) - min(salary) AS spread, string_agg(DISTINCT segment, ',' ORDER BY segment) AS segments FROM people GROUP BY nation")
relational("masked_quoted_names", 'SELECT "id", "email" AS "who" FROM people', {"who": EMAIL}, ["id"])
relational("masked_top", "SELECT TOP 25 id, full_name FROM people ORDER BY id", {"full_name": PERSON}, ["id"], "SELECT id, full_name FROM people ORDER BY id LIMIT 25")
relational("masked_position", "SELECT id, instr(email, '@') AS place, length(email) AS n FROM people", {"place": EMAIL_NUMBER}, ["id", "n"])

# Documents

CUSTOMER_DOCS = """SELECT c_custkey AS _id, named_struct('email', lower(replace(c_name, '#', '.')) || '@corp.test', 'city', 'town-' || CAST(c_nationkey AS STRING)) AS contact,
    c_name AS name, c_nationkey AS nation, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE array(c_mktsegment, 'all') END AS tags, round(c_acctbal, 2) AS balance FROM customer"""


def collections(spark: SparkSession, sf_dir: str) -> Engine:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    engine = Engine(spark, Settings(), salt=SALT)
    engine.register("m", "customers", spark.sql(CUSTOMER_DOCS), is_collection=True)
    return engine


def found(test: str, projection: str | None = None) -> Query:
    return lambda spark, sf_dir: collections(spark, sf_dir).find("m", "customers", test, projection, limited=False).df


def staged(stages: str) -> Query:
    return lambda spark, sf_dir: collections(spark, sf_dir).aggregate("m", "customers", stages, limited=False).df


DOCS = "(SELECT c_custkey AS _id, lower(replace(c_name, '#', '.')) || '@corp.test' AS email, 'town-' || c_nationkey AS city, c_name AS name, c_nationkey AS nation, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE [c_mktsegment, 'all'] END AS tags, round(c_acctbal, 2) AS balance FROM customer)"
add("doc_find_filter", found('{"nation": {"$gte": 3, "$lt": 9}, "tags": "all", "balance": {"$not": {"$lt": 0}}}', '{"name": 1, "nation": 1}'), duck_masks.masked(f"SELECT _id, name, nation FROM {DOCS} WHERE nation >= 3 AND nation < 9 AND tags IS NOT NULL AND NOT balance < 0", {"name": PERSON}, ["_id", "nation"]))
add("doc_find_or_in_regex", found('{"$or": [{"nation": {"$in": [1, 2]}}, {"contact.email": {"$regex": "1@"}}], "tags": {"$exists": false}}', '{"contact.email": 1}'), duck_masks.masked(f"SELECT _id, email FROM {DOCS} WHERE (nation IN (1, 2) OR email LIKE '%1@%') AND tags IS NULL", {"email": EMAIL}, ["_id"]))
add("doc_find_ne_missing", found('{"tags": {"$ne": "BUILDING"}, "nation": {"$mod": [2, 0]}}', '{"nation": 1}'), f"SELECT _id, nation FROM {DOCS} WHERE NOT coalesce(list_contains(tags, 'BUILDING'), false) AND nation % 2 = 0")
add("doc_project", staged('[{"$project": {"who": {"$toUpper": "$name"}, "half": {"$divide": ["$balance", 2]}, "big": {"$cond": [{"$gt": ["$balance", 5000]}, "y", "n"]}}}]'), duck_masks.masked(f"SELECT _id, upper(name) AS who, balance / 2 AS half, CASE WHEN balance > 5000 THEN 'y' ELSE 'n' END AS big FROM {DOCS}", {"who": PERSON}, ["_id", "half", "big"]))
add("doc_group_sum", staged('[{"$match": {"balance": {"$gt": 0}}}, {"$group": {"_id": "$nation", "n": {"$sum": 1}, "total": {"$max": "$balance"}, "top": {"$max": "$contact.email"}, "last": {"$min": "$name"}}}]'), duck_masks.masked(f"SELECT nation AS _id, count(*) AS n, max(balance) AS total, max(email) AS top, min(name) AS last FROM {DOCS} WHERE balance > 0 GROUP BY nation", {"top": EMAIL, "last": PERSON}, ["_id", "n", "total"]))
add("doc_group_accumulators", staged('[{"$group": {"_id": "$nation", "total": {"$sum": "$_id"}, "mean": {"$avg": "$_id"}, "low": {"$min": "$balance"}, "cities": {"$addToSet": "$contact.city"}}}, {"$project": {"total": 1, "mean": 1, "low": 1, "n": {"$size": "$cities"}}}]'), f"SELECT nation AS _id, sum(_id)::BIGINT AS total, avg(_id) AS mean, min(balance) AS low, count(DISTINCT city) AS n FROM {DOCS} GROUP BY nation")
add("doc_find_type_nor", found('{"$nor": [{"nation": {"$lt": 4}}, {"balance": {"$lt": 0}}], "tags": {"$size": 2, "$all": ["all"]}, "name": {"$type": "string"}}', '{"nation": 1, "name": 1}'), duck_masks.masked(f"SELECT _id, nation, name FROM {DOCS} WHERE NOT (nation < 4) AND NOT (balance < 0) AND len(tags) = 2 AND list_contains(tags, 'all')", {"name": PERSON}, ["_id", "nation"]))
add("doc_unwind", staged('[{"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": true, "includeArrayIndex": "at"}}, {"$project": {"tags": 1, "at": 1}}]'), f"SELECT _id, t.tag AS tags, t.at AS at FROM {DOCS} d LEFT JOIN LATERAL (SELECT unnest(d.tags) AS tag, generate_subscripts(d.tags, 1) - 1 AS at) t ON true")
add("doc_sort_skip_limit", staged('[{"$sort": {"balance": -1, "_id": 1}}, {"$skip": 5}, {"$limit": 20}, {"$project": {"name": 1}}]'), duck_masks.masked(f"SELECT _id, name FROM {DOCS} ORDER BY balance DESC, _id LIMIT 20 OFFSET 5", {"name": PERSON}, ["_id"]))
add("doc_count", staged('[{"$match": {"nation": 3}}, {"$count": "n"}]'), f"SELECT count(*) AS n FROM {DOCS} WHERE nation = 3")
add("doc_sort_by_count", staged('[{"$sortByCount": "$nation"}]'), f"SELECT nation AS _id, count(*) AS count FROM {DOCS} GROUP BY nation")
add("doc_bucket", staged('[{"$bucket": {"groupBy": "$nation", "boundaries": [0, 5, 10, 30], "output": {"n": {"$sum": 1}}}}]'), f"SELECT CASE WHEN nation < 5 THEN 0 WHEN nation < 10 THEN 5 ELSE 10 END AS _id, count(*) AS n FROM {DOCS} GROUP BY 1")
add("doc_add_unset_replace", staged('[{"$addFields": {"twice": {"$multiply": ["$nation", 2]}}}, {"$unset": ["tags", "balance"]}, {"$replaceRoot": {"newRoot": {"k": "$_id", "twice": "$twice", "mail": "$contact.email"}}}]'), duck_masks.masked(f"SELECT _id AS k, nation * 2 AS twice, email AS mail FROM {DOCS}", {"mail": EMAIL}, ["k", "twice"]))


def nested_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = collections(spark, sf_dir).find("m", "customers", "{}", limited=False).df
    return df.select("_id", F.col("contact.email").alias("email"), F.col("contact.city").alias("city"), "name", "nation")


add("doc_nested_mask", nested_mask, duck_masks.masked(f"SELECT _id, email, city, name, nation FROM {DOCS}", {"email": EMAIL, "city": ("CITY", "text"), "name": PERSON}, ["_id", "nation"]))


def inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents.infer_schema(table(spark, sf_dir, "events"), "props")
    return out.select("name", F.array_join("types", ",").alias("types"), "frequency")


add("doc_infer_schema", inferred, """SELECT name, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types, round(sum(n) / (SELECT count(*) FROM events WHERE props IS NOT NULL), 2) AS frequency
    FROM (SELECT j.key AS name, CASE json_type(j.value) WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'str' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' ELSE 'NoneType' END AS kind, count(*) AS n
    FROM events, json_each(props) j GROUP BY ALL) GROUP BY name""")


def masked_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = view(spark, sf_dir, "people").select("id", F.to_json(F.struct(F.struct("email").alias("contact"), "nation")).alias("doc"))
    out = people.select("id", documents.masked_json(people, "doc", Settings(), SALT).alias("doc"))
    return out.select("id", F.get_json_object("doc", "$.contact.email").alias("email"), F.get_json_object("doc", "$.nation").cast("int").alias("nation"))


add("doc_json_mask", masked_json, duck_masks.masked(f"SELECT id, email, nation FROM ({duck('people')})", {"email": EMAIL}, ["id", "nation"]))

# Sinks


def fixture_rows(form: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = registered(spark, sf_dir)
        df = engine.sql("d", "SELECT id, full_name, salary FROM people ORDER BY id LIMIT 10").df
        df = df.withColumn("salary", F.col("salary").cast("decimal(20,2)").cast("string"))
        return fixtures.json_rows(df) if form == "json" else fixtures.csv_rows(df)

    return run


TEN = duck_masks.masked(f"SELECT id, full_name, salary FROM ({duck('people')}) ORDER BY id LIMIT 10", {"full_name": PERSON, "salary": SALARY}, ["id"])
add("fixtures_json_rows", fixture_rows("json"), f"""SELECT '{{"id":' || id || ',"full_name":"' || full_name || '","salary":"' || CAST(salary AS DECIMAL(20,2)) || '"}}' AS json FROM ({TEN})""")
add("fixtures_csv_rows", fixture_rows("csv"), f"SELECT id || ',' || full_name || ',' || CAST(salary AS DECIMAL(20,2)) AS line FROM ({TEN})")


def demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.demo_customers(spark, 10_000, SALT).select("_id", "firstname", "city")


add("demo_customers", demo, f"SELECT CAST(i AS VARCHAR) AS _id, {duck_masks.pick(mask.FIRST, 's')} AS firstname, {duck_masks.pick(mask.CITIES, 't')} AS city FROM (SELECT i, {duck_masks.seed('(CAST(i AS VARCHAR) || chr(102))')} AS s, {duck_masks.seed('(CAST(i AS VARCHAR) || chr(99))')} AS t FROM range(10000) r(i))")

# Streams


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 7).cast("string").alias("client"), F.col("event_id").alias("request_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"))


def rate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.rate_limit(requests(spark, sf_dir), limit=5, seconds=3600.0)


add("rate_limit_decisions", rate_decisions, """WITH RECURSIVE o AS (SELECT CAST(user_id % 7 AS VARCHAR) AS client, event_id AS request_id, CAST(floor(epoch(ts)) AS DOUBLE) AS "at" FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY "at", request_id) AS i FROM o),
    r AS (SELECT client, request_id, "at", i, true AS allowed, ["at"] AS log FROM n WHERE i = 1 UNION ALL
          SELECT client, request_id, "at", i, len(log) < 5, CASE WHEN len(log) < 5 THEN list_append(log, "at") ELSE log END
          FROM (SELECT n.*, list_filter(r.log, lambda x: n."at" - x < 3600) AS log FROM r JOIN n ON n.client = r.client AND n.i = r.i + 1))
    SELECT client, request_id, "at", allowed FROM r""")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = limits.idle_sessions(table(spark, sf_dir, "events"), "user_id", "ts", 30)
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("requests").cast("long").alias("requests"))


add("ttl_sessions", sessions, "SELECT user_id, count(*) FILTER (fresh) AS sessions, count(*) AS requests FROM (SELECT user_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS fresh FROM events) GROUP BY user_id")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream, masked, and gathered in files."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    return limits.gathered(limits.masked_stream(stream.select("event_id", "event_type", "value"), {"event_type": "CREDENTIAL", "value": "SCORE"}, SALT))


add("stream_masked_events", streamed, duck_masks.masked("SELECT event_id, event_type, value FROM events", {"event_type": ("CREDENTIAL", "text"), "value": ("SCORE", "double")}, ["event_id"]))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
