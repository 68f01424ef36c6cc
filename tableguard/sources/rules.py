"""Category rules and owner overrides, read on the driver as configuration."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from tableguard.functions import fixed as X

_LISTS = ("exact_names", "prefixes", "schemas", "comment_keywords", "column_keywords")


@dataclass(frozen=True)
class Rule:
    name: str
    description: str = ""
    exact_names: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    schemas: tuple[str, ...] = ()
    comment_keywords: tuple[str, ...] = ()
    column_keywords: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rules:
    categories: tuple[Rule, ...]
    overrides: Mapping[str, str] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return sorted(r.name for r in self.categories)


def make_rules(categories: list[Mapping], overrides: Mapping[str, str] | None = None) -> Rules:
    """Checked rules. Unknown fields, unsafe names and overrides to unknown categories fail."""
    rules = []
    for item in categories:
        extra = set(item) - {"name", "description", *_LISTS}
        if extra:
            raise ValueError(f"unknown rule fields: {sorted(extra)}")
        if not re.fullmatch(X.SAFE_TERM_RE, item["name"]):
            raise ValueError("a category name is one safe lowercase term")
        lists = {k: tuple(item.get(k) or ()) for k in _LISTS}
        rules.append(Rule(item["name"], item.get("description") or "", **lists))
    if not rules:
        raise ValueError("at least one category is needed")
    unknown = set((overrides or {}).values()) - {r.name for r in rules}
    if unknown:
        raise ValueError(f"overrides name unknown categories: {sorted(unknown)}")
    return Rules(tuple(rules), dict(overrides or {}))


def _load(path: str | Path):
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:  # PyYAML is optional: JSON files always work
        raise ImportError("PyYAML is needed to read YAML rules; JSON needs nothing") from error
    return yaml.safe_load(text)


def read_rules(rules_path: str | Path, overrides_path: str | Path | None = None) -> Rules:
    categories = _load(rules_path)["categories"]
    overrides = _load(overrides_path).get("overrides") if overrides_path else None
    return make_rules(categories, overrides)
