"""Masking of values, as deterministic expressions of the value, its type and a salt.

One value under one salt always gives one mask, so groups and joins on masked keys survive. Everything compiles to
built-in functions: no cache, no state, no Python on the executors.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST = ["Adele", "Basile", "Cecile", "Damien", "Elise", "Fabien", "Gaelle", "Hugo", "Ines", "Jules", "Karine", "Leon", "Maud", "Noe", "Odile", "Paul", "Quentin", "Rose", "Simon", "Tess"]
LAST = ["Abadie", "Berger", "Carlier", "Delmas", "Estrade", "Ferrand", "Guerin", "Hamon", "Imbert", "Jacquet", "Keller", "Lacombe", "Marchal", "Navarro", "Olivier", "Pasquier", "Roussel", "Savary", "Tellier", "Vasseur"]
CITIES = ["Amiens", "Brest", "Cahors", "Dijon", "Evreux", "Foix", "Gap", "Laon", "Metz", "Nevers", "Orange", "Pau", "Reims", "Senlis", "Tarbes", "Vannes"]
COUNTRIES = ["Austria", "Belgium", "Chile", "Denmark", "Estonia", "France", "Ghana", "Hungary", "Iceland", "Japan", "Kenya", "Latvia"]
STREETS = ["rue des Lilas", "rue du Moulin", "avenue de la Gare", "place du Marche", "chemin Vert", "allee des Pins", "quai Neuf", "boulevard du Port"]

#: Half-width of the factor by which numbers of a type are scaled.
NOISE = {"SALARY": 0.15, "REVENUE": 0.15, "SCORE": 0.10, "PRICE": 0.15, "CONFIDENTIAL": 0.15}
REDACTED, BINARY = "[REDACTED]", "[BINARY DATA]"


def new_salt() -> str:
    return uuid.uuid4().hex


def canonical(value: Column, kind: T.DataType) -> Column:
    """The text of a value that is hashed; floating point by six decimals, so that it does not depend on the writer."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.try_cast("decimal(38,6)").cast("string")
    return value.cast("string")


def _rest_of(digest: Column, modulus: int = 10**9) -> Column:
    """The digest, a number of 256 bits, modulo 10**9: eight words of 32 bits, each step within a long."""
    words = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)]
    return reduce(lambda rest, word: (rest * F.lit(1 << 32) + word) % modulus, words, F.lit(0).cast("long"))


def seed(text: Column, salt: str, label: str = "") -> Column:
    """A number below 10**9 from text and salt; other labels give independent numbers."""
    return _rest_of(F.sha2(F.concat(text, F.lit(salt + label)), 256))


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at % len(values) + 1).cast("int"))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b)


def _digits(number: Column, n: int) -> Column:
    return F.lpad(number.cast("string"), n, "0")


def _rounded(number: Column, places: int, size: Column | None = None) -> Column:
    """A double rounded as the masks' SQL does it: scaled, then halves of the scaled double away from zero. Spark's round()
    goes by the shortest decimal, which is a half where the scaled double is not. Where `size`, which bounds the number's,
    is too large to scale, the number is whole."""
    scale = F.lit(float(10**places))
    if size is not None:
        scale = F.when(F.abs(size) > 1.5e306, F.lit(1.0)).otherwise(scale)
    return F.round(number * scale) / scale


def generated(kind: str, text: Column, salt: str, name: str = "") -> Column:
    """A string of the given type for the canonical text. Unknown types are redacted."""
    s, s2 = seed(text, salt), seed(text, salt, "|2")
    first, last = _pick(FIRST, s), _pick(LAST, _div(s, len(FIRST)))
    if kind == "FIRST_NAME":
        return first
    if kind == "LAST_NAME":
        return _pick(LAST, s)
    if kind == "PERSON":
        return F.concat(first, F.lit(" "), last)
    if kind == "EMAIL":
        return F.concat(F.lower(first), F.lit("."), F.lower(last), s.cast("string"), F.lit("@example.org"))
    if kind == "PHONE":
        d = _digits(s % 100_000_000, 8)
        return F.concat(F.lit("+33 6"), *(x for i in range(4) for x in (F.lit(" "), F.substring(d, 2 * i + 1, 2))))
    if kind == "ADDRESS":
        return F.concat((s % 200 + 1).cast("string"), F.lit(" "), _pick(STREETS, s), F.lit(", "), _digits(s2 % 95_000 + 1_000, 5), F.lit(" "), _pick(CITIES, s2))
    if kind == "CITY":
        return _pick(CITIES, s)
    if kind == "COUNTRY":
        return _pick(COUNTRIES, s)
    if kind == "IP":
        return F.concat(F.lit("10."), (_div(s, 65_536) % 256).cast("string"), F.lit("."), (_div(s, 256) % 256).cast("string"), F.lit("."), (s % 256).cast("string"))
    if kind == "IBAN":
        return F.concat(F.lit("FR76"), _digits(s, 9), _digits(s2, 9), _digits(s2 % 100_000, 5))
    if kind == "FINANCIAL":
        return F.concat(F.lit("4"), _digits(s, 9), _digits(s2 % 1_000_000, 6))
    if kind == "SSN":
        return F.concat(_digits(s, 9), _digits(s2 % 1_000_000, 6))
    if kind == "SIREN":
        return _digits(s, 9)
    if kind == "SIRET":
        return F.concat(_digits(s, 9), _digits(s2 % 100_000, 5))
    if kind == "GEO":
        span = 360 if "lon" in name.lower() else 180
        return _rounded(s / F.lit(1e9) * span - span / 2, 4).cast("decimal(10,4)").cast("string")
    if kind == "URL":
        return F.concat(F.lit("https://example.org/"), s.cast("string"))
    if kind == "CREDENTIAL":
        return F.substring(F.sha2(F.concat(text, F.lit(salt + "|c")), 256), 1, 12)
    if kind == "DATE_OF_BIRTH":
        return F.date_add(F.lit("1940-01-01").cast("date"), (s % 25_000).cast("int")).cast("string")
    return F.lit(REDACTED)


def scaled(number: Column, text: Column, salt: str, share: float) -> Column:
    """A double scaled by a factor within `share` of 1."""
    return number * (F.lit(1.0) + F.lit(share) * (F.lit(2.0) * seed(text, salt) / F.lit(1e9) - F.lit(1.0)))


def perturbed(value: Column, kind: T.DataType, salt: str, share: float) -> Column:
    """Numeric noise that keeps the column's type; 0, NaN and infinities stay, text that is no number is redacted."""
    text = canonical(value, kind)
    if isinstance(kind, T.IntegralType):
        out = F.bround(scaled(value.cast("double"), text, salt, share)).cast(kind)
        return F.when(value == 0, value).otherwise(out)
    if isinstance(kind, T.DecimalType):
        wide = T.DecimalType(min(38, max(kind.precision, kind.precision + 2 - kind.scale)), max(kind.scale, 2))
        out = _rounded(scaled(value.cast("double"), text, salt, share), 2, value.cast("double")).cast(wide)
        return F.when(value == 0, value.cast(wide)).otherwise(out)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        odd = F.isnan(value) | (F.abs(value) == float("inf")) | (value == 0)
        return F.when(odd, value).otherwise(_rounded(scaled(value.cast("double"), text, salt, share), 2, value.cast("double")).cast(kind))
    number = value.cast("string").try_cast("double")
    out = _rounded(scaled(number, value.cast("string"), salt, share), 2, number).cast("string")
    return F.when(number == 0, value.cast("string")).otherwise(F.coalesce(out, F.lit(REDACTED)))


def blank(value: Column) -> Column:
    return value.rlike(r"(?U)\A\s*\z")


def masked(value: Column, kind: T.DataType, pii: str | None, salt: str, name: str = "") -> Column:
    """The value under its type. Nested values are walked by operators.documents.

    Unchanged: null, blank text, booleans, and everything of no type or SAFE, but binary, which is never shown.
    """
    if isinstance(kind, T.BinaryType):
        return F.when(value.isNotNull(), F.lit(BINARY))
    if pii in (None, "SAFE") or isinstance(kind, (T.BooleanType, T.NullType)):
        return value
    if pii in NOISE:
        if isinstance(kind, T.NumericType):
            return F.when(value.isNotNull(), perturbed(value, kind, salt, NOISE[pii]))
        if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
            return F.when(value.isNull() | blank(value), value).otherwise(perturbed(value, kind, salt, NOISE[pii]))
        return F.when(value.isNotNull(), F.lit(REDACTED))
    text = canonical(value, kind)
    out = generated(pii, text, salt, name)
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return F.when(value.isNull() | blank(value), value).otherwise(out)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), value.cast("string")).when(value.isNotNull(), out)
    return F.when(value.isNotNull(), out)


def mapping_key(session: Column, value: Column) -> Column:
    """The key under which a session's mapping of a value is filed."""
    return F.sha2(F.concat_ws(":", session, value), 256)
