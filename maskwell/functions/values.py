"""Classification of columns by their values, and masking of values inside free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Value patterns of each type, in order of precedence. A whole value must match.
PATTERNS: dict[str, str] = {
    "EMAIL": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "SIRET": r"\d{3}\s?\d{3}\s?\d{3}\s?\d{5}",
    "SIREN": r"\d{3}\s?\d{3}\s?\d{3}",
    "PHONE": r"\+?\d[\d\s\-().]{7,}",
    "IP": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "IBAN": r"[A-Z]{2}\d{2}[A-Z0-9]{4,30}",
    "CREDIT_CARD": r"\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{1,4}",
    "URL": r"https?://\S+",
}
#: Types for which numbers and values that start with a date do not count.
NOT_NUMBERS = ("PHONE", "CREDIT_CARD", "SIRET", "SIREN")
NUMBER_OR_DATE = r"^(-?\d+([.,]\d+)?\z|\d{4}-\d{2}-\d{2}|\d{2}[/.-]\d{2}[/.-]\d{4})"
# What a word of a name looks like, and words that are no names.
NAME_WORD = r"^([A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{1,25}\z|[A-ZÀ-ÖØ-Þ]{2,25}\z|[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+[-'][A-ZÀ-ÖØ-Þa-zà-öø-ÿ]+)"
NO_NAMES = (
    "null none true false yes no ok active inactive pending done todo prospect client lead won lost email phone appel "
    "reunion prevu effectue entrant sortant linkedin site recommandation esn cabinet startup grand_groupe eti pme it "
    "finance industrie conseil sante test admin user manager data"
).split()
# A database's (column)=(value) report, and runs of capitalised words.
KEY_VALUE = r"\(([^)]+)\)=\(([^)]+)\)"
NAME_RUN = r"\b[A-Z][a-zà-ÿ]{1,20}(?:\s+[A-Z][a-zà-ÿ]{1,20}){1,3}\b"

UNICODE = "(?U)"


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, UNICODE + r"\A\s+|\s+\z", "")


def counts(value: Column) -> Column:
    """Whether a value takes part in a scan: neither null nor blank."""
    return value.isNotNull() & (trimmed(value) != "")


def is_number_or_date(value: Column) -> Column:
    return trimmed(value).rlike(UNICODE + NUMBER_OR_DATE)


def matches(value: Column, kind: str) -> Column:
    return trimmed(value).rlike(UNICODE + r"\A(?:" + PATTERNS[kind] + r")\z")


def looks_like_name(value: Column) -> Column:
    """2 to 60 characters, no digit, not a stop word, and half of its words or more written like names."""
    v = trimmed(value)
    parts = F.split(v, UNICODE + r"[\s\-]+")
    named = F.size(F.filter(parts, lambda p: p.rlike(NAME_WORD)))
    size = F.char_length(v)
    return (size >= 2) & (size <= 60) & ~F.lower(v).isin(*NO_NAMES) & ~v.rlike(r"\p{Nd}") & (named >= 1) & (2 * named >= F.size(parts))


def ratios(value: Column) -> dict[str, Column]:
    """Per type, an aggregate: the share of matching values among those that count for the type."""
    some = counts(value)
    out = {}
    for kind in PATTERNS:
        candidate = some & ~is_number_or_date(value) if kind in NOT_NUMBERS else some
        out[kind] = F.try_divide(F.count_if(candidate & matches(value, kind)), F.count_if(candidate))
    out["PERSON"] = F.try_divide(F.count_if(some & looks_like_name(value)), F.count_if(some))
    return out


def scanned(value: Column, threshold: float = 0.3) -> Column:
    """An aggregate: the first type, in order, whose ratio reaches the threshold."""
    return F.coalesce(*(F.when(ratio >= threshold, F.lit(kind)) for kind, ratio in ratios(value).items()), F.lit(None).cast("string"))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def scan(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.3) -> dict[str, str]:
    """Types of text columns by their values: one aggregation over all columns, one row to the driver."""
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return {}
    row = df.agg(*(scanned(F.col(f"`{c}`"), threshold).alias(str(i)) for i, c in enumerate(columns))).first()
    return {c: row[i] for i, c in enumerate(columns) if row[i]}


def sample_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n smallest distinct values that are not null."""
    c = F.col(f"`{column}`")
    return df.select(c.alias(column)).where(c.isNotNull()).distinct().orderBy(column).limit(n)


def redact_text(text: Column, kinds: list[str] | None = None, mark: str = "[VALUE]") -> Column:
    """Free text with all values of the given types replaced."""
    return reduce(lambda t, k: F.regexp_replace(t, UNICODE + _inside(k), mark), kinds or list(PATTERNS), text)


def _inside(kind: str) -> str:
    """Numbers of fixed length must not be part of longer ones."""
    return rf"(?<!\d)(?:{PATTERNS[kind]})(?!\d)" if kind in ("SIRET", "SIREN") else PATTERNS[kind]


def redact_message(message: Column) -> Column:
    """An error message without values: patterns, (column)=(value) reports, then names."""
    out = F.regexp_replace(redact_text(message), KEY_VALUE, r"([COLUMN])=([VALUE])")
    return F.regexp_replace(out, UNICODE + NAME_RUN, "[VALUE]")


def redact_message_text(message: str) -> str:
    """The same for one message on the driver."""
    import re

    for kind in PATTERNS:
        message = re.sub(_inside(kind), "[VALUE]", message)
    message = re.sub(KEY_VALUE, "([COLUMN])=([VALUE])", message)
    return re.sub(NAME_RUN, "[VALUE]", message)
