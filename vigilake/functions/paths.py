"""Dotted JSON paths compiled to columns over VARIANT values.

A path is keys joined by dots; a backslash keeps a dot inside a key, a run of
digits is a list index, and a last ``#`` is a list's length. Other path syntax
(wildcards, queries, modifiers) is refused when the path is compiled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

META = "meta "


class PathError(ValueError):
    """The path uses syntax outside the supported subset."""


def split_path(path: str) -> list[str]:
    parts = [p.replace("\\.", ".") for p in re.split(r"(?<!\\)\.", path.strip())]
    for p in parts:
        if p == "" or re.search(r"[*?|@!]", p) or ("#" in p and p != "#"):
            raise PathError(f"unsupported path {path!r}")
    return parts


def _step(part: str) -> str:
    if part.isdigit():
        return f"[{part}]"
    return "['" + part.replace("\\", "\\\\").replace("'", "\\'") + "']"


def variant_path(path: str) -> str:
    return "$" + "".join(_step(p) for p in split_path(path))


def at(v: Column, path: str, kind: str = "string") -> Column:
    """Value at the path as ``kind``; null where it is missing or cannot be cast."""
    return F.try_variant_get(v, variant_path(path), kind)


def kind_of(v: Column) -> Column:
    """Spark's name for a variant's type: VOID for JSON null, OBJECT<...>, ARRAY<...>, STRING, BIGINT, BOOLEAN, ..."""
    return F.schema_of_variant(v)


@dataclass(frozen=True)
class Value:
    """One looked-up value with the conversions conditions and transforms need."""

    exists: Column
    text: Column
    raw: Column | None

    @property
    def number(self) -> Column:
        """Numbers and numeric text as a double; true is 1; anything else, 0. Null if missing."""
        return F.when(self.exists, F.coalesce(self.text.try_cast("double"), F.when(self.text == "true", 1.0), F.lit(0.0)))


def lookup(data: Column, path: str, meta: Column | None = None) -> Value:
    """The value at a path of JSON text ``data``, or of ``meta`` for paths that begin with "meta "."""
    source, key = data, path.strip()
    if path.startswith(META):
        source, key = (F.lit("{}") if meta is None else meta), path[len(META) :].strip()
    v = F.try_parse_json(source)
    parts = split_path(key)
    if parts[-1] == "#":
        items = F.try_variant_get(v, "$" + "".join(_step(p) for p in parts[:-1]), "array<variant>")
        return Value(items.isNotNull(), F.size(items).cast("string"), None)
    found = F.try_variant_get(v, variant_path(key), "variant")
    return Value(found.isNotNull(), F.when(found.isNotNull(), F.coalesce(F.try_variant_get(v, variant_path(key), "string"), F.lit(""))), found)
