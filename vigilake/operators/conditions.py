"""Conditions of the pipeline language, compiled to boolean columns.

A condition is {"type": ..., "settings": {...}}. Values are compared as text or
as numbers; a missing path is false for every type. No condition is ever null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.functions.paths import Value, lookup

Config = dict
Lookup = Callable[[str], Value]


class ConfigError(ValueError):
    """A condition or transform is of an unknown type or lacks a setting."""


def _settings(config: Config) -> dict:
    return config.get("settings") or {}


def source_key(config: Config) -> str:
    return (_settings(config).get("object") or {}).get("source_key", "")


def target_key(config: Config) -> str:
    return (_settings(config).get("object") or {}).get("target_key", "")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


_TEXT: dict[str, Callable[[Column, str], Column]] = {
    "string_contains": lambda c, v: c.contains(v),
    "string_equals": lambda c, v: c == F.lit(v),
    "string_starts_with": lambda c, v: c.startswith(v),
    "string_ends_with": lambda c, v: c.endswith(v),
    "string_match": lambda c, v: c.rlike(v),
}
_NUMBER: dict[str, Callable[[Column, float], Column]] = {
    "number_equals": lambda c, v: c == v,
    "number_greater_than": lambda c, v: c > v,
    "number_less_than": lambda c, v: c < v,
}
_META = {"all": "all", "any": "any", "none": "none", "meta_all": "all", "meta_any": "any", "meta_none": "none"}

TYPES = (*_META, *_TEXT, *_NUMBER, "exists", "format_json")


def checked_regex(pattern: str) -> str:
    """The pattern, if it is a regular expression; back-references and look-around, which the language has not, are refused."""
    if re.search(r"\\[1-9]|\(\?(?:[=!]|<[=!])", pattern):
        raise ConfigError(f"unsupported regular expression {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ConfigError(f"bad regular expression {pattern!r}: {e}") from e
    return pattern


def compile_condition(config: Config, find: Lookup, data: Column) -> Column:
    """The condition as a column; ``find`` looks a path up and ``data`` is the message's text."""
    kind, settings = config.get("type", ""), _settings(config)
    if kind in _META:
        parts = [compile_condition(c, find, data) for c in settings.get("conditions") or []]
        if _META[kind] == "all":
            return reduce(and_, parts, F.lit(True))
        some = reduce(or_, parts, F.lit(False))
        return some if _META[kind] == "any" else ~some
    if kind in _TEXT:
        value = settings.get("value", "")
        value = str(value).lower() if isinstance(value, bool) else str(value)
        return _true(_TEXT[kind](find(source_key(config)).text, checked_regex(value) if kind == "string_match" else value))
    if kind in _NUMBER:
        return _true(_NUMBER[kind](find(source_key(config)).number, float(settings.get("value", 0))))
    if kind == "exists":
        return _true(find(source_key(config)).exists)
    if kind == "format_json":
        return F.try_parse_json(data).isNotNull()
    raise ConfigError(f"condition {kind!r}: unknown type")


def condition(config: Config, data: Column | str = "data", meta: Column | str | None = None) -> Column:
    """The condition over a column of JSON text and, for "meta " paths, another one."""
    text = F.col(data) if isinstance(data, str) else data
    other = F.col(meta) if isinstance(meta, str) else meta
    return compile_condition(config, lambda path: lookup(text, path, other), text)
