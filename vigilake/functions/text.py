"""Scalar functions on text, lists and times."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null for empty text and for "-"."""
    t = F.trim(c)
    return F.when((t != "") & (t != "-"), t)


def to_int(c: Column) -> Column:
    t = blank_to_null(c)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))


def to_double(c: Column) -> Column:
    return blank_to_null(c).try_cast("double")


def to_list(c: Column) -> Column:
    return F.split(blank_to_null(c), ",")


def looks_like_csv(c: Column) -> Column:
    return c.rlike(r"[ ,\t]")


def any_of(tests) -> Column:
    """OR of the tests; false for none of them."""
    tests = list(tests)
    return reduce(or_, tests) if tests else F.lit(False)


def contains_any_ci(c: Column, patterns) -> Column:
    """True where one pattern is part of the text, without regard to case."""
    low = F.lower(c)
    return F.coalesce(any_of(low.contains(p.lower()) for p in patterns), F.lit(False))


def list_contains_any_ci(items: Column, patterns) -> Column:
    return F.coalesce(F.exists(items, lambda x: contains_any_ci(x, patterns)), F.lit(False))


def starts_with_any(c: Column, prefixes) -> Column:
    return F.coalesce(any_of(c.startswith(p) for p in prefixes), F.lit(False))


def ends_with_any(c: Column, suffixes) -> Column:
    return F.coalesce(any_of(c.endswith(s) for s in suffixes), F.lit(False))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a shell pattern with * and ? ([ is literal unless it is closed)."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (j := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches_glob(c: Column, patterns) -> Column:
    return F.coalesce(any_of(c.rlike(glob_regex(p)) for p in patterns), F.lit(False))


def last_part(c: Column, separator: str) -> Column:
    return F.substring_index(c, separator, -1)


def truncated(c: Column, most: int) -> Column:
    """Text of at most ``most`` characters, an ellipsis in place of what is cut."""
    return F.when(F.char_length(c) > most, F.concat(F.left(c, F.lit(most - 1)), F.lit("…"))).otherwise(c)


def slack_escaped(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


# ---- times ----

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_NAIVE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?$"


def _micros(c: Column) -> Column:
    """At most six digits of a fraction, as many as a timestamp holds."""
    return F.regexp_replace(F.upper(c), r"(\.\d{6})\d+", "$1")


def rfc3339(c: Column) -> Column:
    return F.when(c.rlike(RFC3339), _micros(c).try_cast("timestamp"))


def any_timestamp(c: Column) -> Column:
    """RFC 3339, or the same without a zone, which is then UTC, with T or a space."""
    t = F.trim(c)
    return F.coalesce(rfc3339(t), F.when(t.rlike(_NAIVE), F.concat(_micros(t), F.lit("Z")).try_cast("timestamp")))


def plain_timestamp(c: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss in UTC."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.concat(t, F.lit("Z")).try_cast("timestamp"))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600, "d": 86400}


def parse_duration(text: str) -> float:
    """Seconds of a duration such as 90s, 1h30m or 7d."""
    parts = re.findall(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h|d)", text)
    if not parts or "".join(a + b for a, b in parts) != text.strip().lstrip("+"):
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(a) * _UNITS[b] for a, b in parts)
