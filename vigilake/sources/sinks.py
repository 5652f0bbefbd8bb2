"""Where matches, alerts and query results go."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from vigilake.functions.text import parse_duration

Post = Callable[[str, str, dict, float], int]


def post(url: str, body: str, headers: dict, timeout: float) -> int:
    """HTTP POST; the status."""
    request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", **headers}, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return response.status


def as_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), {"pretty": "true"})


def deliver(outbox: DataFrame, send: Post = post, out: Callable[[str], None] = print) -> None:
    """Sends an outbox (sink, settings, payload). Text for stdout comes to the driver row by row; posts go out from the executors, 2xx (chat: 200) being success."""
    for row in outbox.where("sink = 'stdout'").select("payload").toLocalIterator():
        out(row.payload)

    def each(rows: Iterable[Row]) -> None:
        for r in rows:
            s = json.loads(r.settings)
            try:
                timeout = parse_duration(s["timeout"]) if s.get("timeout") else 10.0
            except ValueError:
                timeout = 10.0
            status = send(s["url"], r.payload, s.get("headers") or {}, timeout)
            if not (status == 200 if r.sink == "slack" else 200 <= status < 300):
                raise OSError(f"{r.sink}: status {status}")

    outbox.where("sink in ('slack', 'http_post')").foreachPartition(each)


def print_matches(matches: DataFrame, out: Callable[[str], None] = print) -> None:
    for row in matches.select(as_json(matches).alias("j")).toLocalIterator():
        out(row.j)


#: More rows than a person reads; larger results belong into a table.
MOST_SHOWN = 10_000


def _shown(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows: write the result to files or aggregate it")
    return rows


def result_table(df: DataFrame, most: int = MOST_SHOWN) -> str:
    """A query result as text columns; an error if it has over ``most`` rows."""
    rows = [[("" if v is None else str(v)) for v in r] for r in _shown(df, most)]
    widths = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(df.columns)]
    line = lambda cells: "  ".join(x.ljust(w) for x, w in zip(cells, widths, strict=True)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in widths]), *map(line, rows)])


def result_json(df: DataFrame, most: int = MOST_SHOWN) -> str:
    """A query result as a JSON list; an error if it has over ``most`` rows."""
    return "[" + ",".join(r[0] for r in _shown(df.select(F.to_json(F.struct("*"))), most)) + "]"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
