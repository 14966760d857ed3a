"""The masks in DuckDB's SQL, written apart from the Spark expressions, to say what those must return."""

from __future__ import annotations

from ..functions.mask import CITIES, COUNTRIES, FIRST, LAST, NOISE, STREETS
from .views import SALT


def seed(text: str, label: str = "") -> str:
    digest = f"sha256({text} || '{SALT}{label}')"
    rest = "0::BIGINT"
    for i in range(8):
        rest = f"(({rest} * 4294967296 + ('0x' || substr(d, {8 * i + 1}, 8))::BIGINT) % 1000000000)"
    return f"(SELECT {rest} FROM (SELECT {digest} AS d))"


def pick(values: list[str], at: str) -> str:
    return "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], CAST(({at}) % {len(values)} + 1 AS INTEGER))"


def generated(kind: str, text: str, s: str, s2: str) -> str:
    first, last = pick(FIRST, s), pick(LAST, f"{s} // {len(FIRST)}")
    pad = lambda e, n: f"lpad(CAST({e} AS VARCHAR), {n}, '0')"
    eight = pad(f"{s} % 100000000", 8)
    return {
        "FIRST_NAME": first,
        "LAST_NAME": pick(LAST, s),
        "PERSON": f"{first} || ' ' || {last}",
        "EMAIL": f"lower({first}) || '.' || lower({last}) || {s} || '@example.org'",
        "PHONE": "'+33 6 ' || " + " || ' ' || ".join(f"substr({eight}, {i}, 2)" for i in (1, 3, 5, 7)),
        "ADDRESS": f"({s} % 200 + 1) || ' ' || {pick(STREETS, s)} || ', ' || {pad(f'({s2} % 95000 + 1000)', 5)} || ' ' || {pick(CITIES, s2)}",
        "CITY": pick(CITIES, s),
        "COUNTRY": pick(COUNTRIES, s),
        "IP": f"'10.' || ({s} // 65536 % 256) || '.' || ({s} // 256 % 256) || '.' || ({s} % 256)",
        "IBAN": f"'FR76' || {pad(s, 9)} || {pad(s2, 9)} || {pad(f'{s2} % 100000', 5)}",
        "FINANCIAL": f"'4' || {pad(s, 9)} || {pad(f'{s2} % 1000000', 6)}",
        "SSN": f"{pad(s, 9)} || {pad(f'{s2} % 1000000', 6)}",
        "SIREN": pad(s, 9),
        "SIRET": f"{pad(s, 9)} || {pad(f'{s2} % 100000', 5)}",
        "GEO": f"CAST(CAST(round({s} / 1e9::DOUBLE * 180 - 90, 4) AS DECIMAL(10, 4)) AS VARCHAR)",
        "URL": f"'https://example.org/' || {s}",
        "CREDENTIAL": f"substr(sha256({text} || '{SALT}|c'), 1, 12)",
        "DATE_OF_BIRTH": f"CAST(DATE '1940-01-01' + CAST({s} % 25000 AS INTEGER) AS VARCHAR)",
    }.get(kind, "'[REDACTED]'")


def column(name: str, kind: str, form: str) -> str:
    """The mask of a column of form text, double or int, which stands beside its seeds."""
    s, s2 = f"{name}__s", f"{name}__s2"
    if kind in NOISE:
        noise = f"{name} * (1 + {NOISE[kind]}::DOUBLE * (2 * {s} / 1e9::DOUBLE - 1))"
        rounded = f"CAST(round_even({noise}, 0) AS BIGINT)" if form == "int" else f"round({noise}, 2)"
        return f"CASE WHEN {name} IS NULL OR {name} = 0 THEN {name} ELSE {rounded} END"
    own = generated(kind, canonical(name, form), s, s2)
    if form == "text":
        return f"CASE WHEN {name} IS NULL OR trim({name}, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN {name} ELSE {own} END"
    return f"CASE WHEN {name} IS NOT NULL THEN {own} END"


def canonical(name: str, form: str) -> str:
    return f"CAST(CAST({name} AS DECIMAL(38,6)) AS VARCHAR)" if form == "double" else f"CAST({name} AS VARCHAR)"


def masked(inner: str, masks: dict[str, tuple[str, str]], keep: list[str]) -> str:
    """The rows of `inner` with columns masked: {column: (kind, form)}; `keep` lists columns that stay."""
    seeds = ", ".join(f"{seed(canonical(c, form))} AS {c}__s, {seed(canonical(c, form), '|2')} AS {c}__s2" for c, (_, form) in masks.items())
    out = [*keep, *(f"{column(c, kind, form)} AS {c}" for c, (kind, form) in masks.items())]
    return f"SELECT {', '.join(out)} FROM (SELECT *{', ' + seeds if seeds else ''} FROM ({inner}))"
