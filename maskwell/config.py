"""Settings: what counts as sensitive, limits, salt policy. Loaded from YAML with ${NAME:-default} substitution."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from typing import Any

# Column-name globs of each type, in order of precedence.
NAME_PATTERNS: dict[str, list[str]] = {
    "FIRST_NAME": ["first_name*", "firstname*", "prenom"],
    "LAST_NAME": ["last_name*", "lastname*", "nom_famille"],
    "PERSON": ["*name*", "nom"],
    "EMAIL": ["*email*", "*mail*", "courriel"],
    "PHONE": ["*phone*", "*tel*", "*mobile*", "*fax*", "telephone"],
    "ADDRESS": ["*address*", "*addr*", "*street*", "*zip*", "*postal*"],
    "CITY": ["*city*", "*ville*"],
    "COUNTRY": ["*country*", "*pays*"],
    "CREDENTIAL": ["*password*", "*passwd*", "*username*", "*secret*", "*token*"],
    "SSN": ["*ssn*", "*social_security*", "*num_secu*"],
    "FINANCIAL": ["*iban*", "*credit_card*", "*card_number*", "*cvc*"],
    "IP": ["*ip_address*", "*ip_addr*"],
    "GEO": ["*latitude*", "*longitude*", "*geo_*"],
    "URL": ["*_url", "*profile_url*", "*avatar*", "*website*"],
    "DATE_OF_BIRTH": ["*birth*", "*dob*", "*naissance*"],
    "SALARY": ["*salary*", "*salaire*", "*wage*", "*compensation*", "*remuneration*"],
    "REVENUE": ["*revenue*", "*chiffre_affaires*", "*margin*", "*marge*", "*profit*", "*benefice*", "*turnover*"],
    "SCORE": ["*_score*", "*credit_score*", "*fraud_score*", "*risk_score*", "*credit_rating*", "*risk_rating*", "*note_*"],
    "PRICE": ["*unit_price*", "*prix*", "*discount_rate*", "*taux_*"],
    "SIRET": ["*siret*"],
    "SIREN": ["*siren*"],
}

#: Manual levels, strongest first, and the type each stands for.
LEVELS = [("secret", "SECRET"), ("confidential", "CONFIDENTIAL"), ("public", "SAFE")]


@dataclass(frozen=True)
class Settings:
    patterns: dict[str, list[str]] = field(default_factory=lambda: dict(NAME_PATTERNS))
    sensitivity: dict[str, list[str]] = field(default_factory=dict)
    overrides: dict[str, str] = field(default_factory=dict)
    table_context: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    scan_values: bool = True
    scan_sample: int = 50
    scan_threshold: float = 0.3
    free_text: str = "redact"
    max_rows: int = 100
    blocked_tables: tuple[str, ...] = ()
    blocked_functions: tuple[str, ...] = ()
    document_sample: int = 100
    mode: str = "ephemeral"
    ttl_minutes: int = 30
    databases: dict[str, dict[str, Any]] = field(default_factory=dict)

    def precedence(self) -> list[str]:
        """Types from the one that wins; conflicts between sources of a column are settled by it."""
        return ["SECRET", "CONFIDENTIAL", *self.patterns, "CREDIT_CARD"]


_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


def substitute(value: Any, environment: dict[str, str] | None = None) -> Any:
    """Replace ${NAME} and ${NAME:-default} in every string of a tree; an unset name without default is empty."""
    env = os.environ if environment is None else environment
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: env.get(m[1]) or (m[2] or ""), value)
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    return value


_loaded: dict[str, Settings] = {}


def load(path: str, environment: dict[str, str] | None = None) -> Settings:
    """Settings of a YAML file, remembered by path until reset()."""
    if path not in _loaded:
        import yaml

        with open(path, encoding="utf-8") as f:
            _loaded[path] = from_tree(substitute(yaml.safe_load(f) or {}, environment))
    return _loaded[path]


def reset() -> None:
    _loaded.clear()


def from_tree(tree: dict[str, Any]) -> Settings:
    part = lambda *path: _dig(tree, path)
    detection, security = part("detection"), part("security")
    scan = detection.get("value_scan") or {}
    plain = Settings()
    return Settings(
        patterns=detection.get("column_patterns") or plain.patterns,
        sensitivity={k: v for k, v in (detection.get("sensitivity") or {}).items() if isinstance(v, list)},
        overrides=detection.get("overrides") or {},
        table_context=detection.get("table_context") or {},
        scan_values=bool(scan.get("enabled", True)),
        scan_sample=int(scan.get("sample_size", plain.scan_sample)),
        free_text=(detection.get("free_text") or {}).get("default_strategy", plain.free_text),
        max_rows=int(security.get("max_rows", plain.max_rows)),
        blocked_tables=tuple(security.get("blocked_tables") or ()),
        blocked_functions=tuple(security.get("blocked_functions") or ()),
        document_sample=int(part("mongodb").get("schema_sample_size", plain.document_sample)),
        mode=part("storage").get("mode", plain.mode),
        ttl_minutes=int(part("storage").get("ttl_minutes", plain.ttl_minutes)),
        databases=part("databases"),
    )


def _dig(tree: dict[str, Any], path: tuple[str, ...]) -> dict[str, Any]:
    for name in path:
        tree = tree.get(name) or {}
    return tree
