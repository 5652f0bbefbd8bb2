"""Transforms of the pipeline language, compiled to one pass over a DataFrame.

A message is a row with the columns data and meta (JSON text) and alert (JSON
text of the last detection, read by paths that begin with "meta alert").
Every transform applies where a guard column is true, so the cases of a switch
and the items of a for-each need neither unions nor second scans:

* ``_live`` is false once a message is dropped; dropped rows only carry what
  they have sent.
* ``_outbox`` gathers what has been sent: (sink, settings, payload).

Writing into JSON at any path is Arrow-batched Python; all else stays in the JVM.
"""

from __future__ import annotations

import ipaddress
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.ids import uuid5
from vigilake.functions.net import IPV4, RFC1918, in_networks, ipv4_number
from vigilake.functions.paths import META, Value, lookup, split_path

from .conditions import Config, ConfigError, compile_condition, source_key, target_key

OUTBOX = "array<struct<sink:string,settings:string,payload:string>>"
Resolver = Callable[[pd.Series], pd.Series]


def _dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def set_in(doc, parts: list[str], value):
    """doc with value at the path; objects are made on the way, list indices extend lists with nulls."""
    if not parts:
        return value
    head, rest = parts[0], parts[1:]
    if isinstance(doc, list) and head.isdigit():
        i = int(head)
        out = list(doc) + [None] * (i + 1 - len(doc))
        out[i] = set_in(out[i], rest, value)
        return out
    out = dict(doc) if isinstance(doc, dict) else {}
    out[head] = set_in(out.get(head), rest, value)
    return out


def delete_in(doc, parts: list[str]):
    head, rest = parts[0], parts[1:]
    if isinstance(doc, list) and head.isdigit() and int(head) < len(doc):
        i = int(head)
        return [*doc[:i], *doc[i + 1 :]] if not rest else [*doc[:i], delete_in(doc[i], rest), *doc[i + 1 :]]
    if isinstance(doc, dict) and head in doc:
        return {k: v for k, v in doc.items() if k != head} if not rest else doc | {head: delete_in(doc[head], rest)}
    return doc


def json_set(doc: Column, path: str, value: Column) -> Column:
    """JSON text with JSON ``value`` at the path; unchanged where value is null, null where doc is null."""
    parts = split_path(path)

    @F.pandas_udf("string")
    def run(docs: pd.Series, values: pd.Series) -> pd.Series:
        def one(d, v):
            if d is None or v is None:
                return d
            try:
                old = json.loads(d) if d else {}
            except ValueError:
                old = {}
            return _dump(set_in(old, parts, json.loads(v)))

        return pd.Series([one(d, v) for d, v in zip(docs, values, strict=True)], dtype=object)

    return run(doc, value)


def json_delete(doc: Column, path: str) -> Column:
    parts = split_path(path)

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        def one(d):
            if not d:
                return d
            try:
                return _dump(delete_in(json.loads(d), parts))
            except ValueError:
                return d

        return pd.Series([one(d) for d in docs], dtype=object)

    return run(doc)


def as_json(text: Column) -> Column:
    """Text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def find(path: str) -> Value:
    """A path of the current message."""
    if path.startswith(META):
        key = path[len(META) :].strip()
        if key == "alert":
            return Value(F.col("alert").isNotNull(), F.col("alert"), F.try_parse_json("alert"))
        if key.startswith("alert."):
            return lookup(F.col("alert"), key[len("alert.") :])
    return lookup(F.col("data"), path, F.col("meta"))


class Compiler:
    """Compiles a list of transforms; holds what is looked up outside the data."""

    def __init__(self, resolve: dict[str, DataFrame] | None = None, fetch: Callable[[str, dict, float], tuple[int, str]] | None = None, fixed_ids: bool = False):
        #: "dns_reverse": (key, value) and "dns_forward": (key, values) tables for the lookups; without one, the lookup finds nothing.
        self.resolve = resolve or {}
        self.fetch = fetch
        self.fixed_ids = fixed_ids
        self.count = 0

    def _name(self, what: str) -> str:
        self.count += 1
        return f"_{what}{self.count}"

    def _set(self, df: DataFrame, guard: Column, path: str, value: Column) -> DataFrame:
        """value: JSON text; null leaves the message as it is."""
        if path.startswith(META):
            key = path[len(META) :].strip()
            if key == "alert":
                return df.withColumn("alert", F.when(guard & value.isNotNull(), value).otherwise(F.col("alert")))
            name, key = ("alert", key[len("alert.") :]) if key.startswith("alert.") else ("meta", key)
        else:
            name, key = "data", path
        new = self._name("new")
        df = df.withColumn(new, F.when(guard, value))
        hit = F.col(new).isNotNull()
        return df.withColumn(name, F.when(hit, json_set(F.when(hit, F.col(name)), key, F.col(new))).otherwise(F.col(name))).drop(new)

    def apply(self, df: DataFrame, configs: list[Config], guard: Column) -> DataFrame:
        for c in configs:
            df = self.one(df, c, guard & F.col("_live"))
        return df

    def one(self, df: DataFrame, config: Config, guard: Column) -> DataFrame:
        kind, s = config.get("type", ""), config.get("settings") or {}
        make = getattr(self, "tf_" + kind, None)
        if make is None:
            raise ConfigError(f"transform {kind!r}: unknown type")
        return make(df, config, s, guard)

    # ---- objects ----

    def tf_object_copy(self, df, config, s, guard):
        v = find(source_key(config))
        value = as_json(v.text) if v.raw is None else F.to_json(v.raw)
        return self._set(df, guard, target_key(config), F.when(v.exists, value))

    def tf_object_delete(self, df, config, s, guard):
        path = source_key(config)
        name, key = ("meta", path[len(META) :].strip()) if path.startswith(META) else ("data", path)
        if name == "meta" and key == "alert":
            return df.withColumn("alert", F.when(~guard, F.col("alert")))
        return df.withColumn(name, F.when(guard, json_delete(F.when(guard, F.col(name)), key)).otherwise(F.col(name)))

    def tf_object_insert(self, df, config, s, guard):
        return self._set(df, guard, target_key(config), F.lit(_dump(s.get("value"))))

    # ---- text ----

    def _text(self, df, config, guard, change: Callable[[Column], Column]) -> DataFrame:
        v = find(source_key(config))
        return self._set(df, guard, target_key(config) or source_key(config), F.when(v.exists, as_json(change(v.text))))

    def tf_string_to_lower(self, df, config, s, guard):
        return self._text(df, config, guard, F.lower)

    def tf_string_to_upper(self, df, config, s, guard):
        return self._text(df, config, guard, F.upper)

    def tf_string_replace(self, df, config, s, guard):
        pattern = s.get("pattern", "")
        if not pattern:
            raise ConfigError("transform string_replace: pattern is required")
        return self._text(df, config, guard, lambda c: F.replace(c, F.lit(pattern), F.lit(s.get("replacement", ""))))

    # ---- routing ----

    def tf_meta_switch(self, df, config, s, guard):
        route, case = self._name("route"), F.lit(None).cast("int")
        cases = s.get("cases") or []
        for i in range(len(cases) - 1, -1, -1):
            c = cases[i].get("condition") or {}
            test = compile_condition(c, find, F.col("data")) if c.get("type") else F.lit(True)
            case = F.when(test, i).otherwise(case)
        df = df.withColumn(route, F.when(guard, case))
        for i, c in enumerate(cases):
            df = self.apply(df, c.get("transforms") or [], F.coalesce(F.col(route) == i, F.lit(False)))
        return df.drop(route)

    def tf_meta_for_each(self, df, config, s, guard):
        item, mark = self._name("item"), self._name("each")
        v = find(source_key(config))
        items = F.try_variant_get(v.raw, "$", "array<variant>") if v.raw is not None else F.lit(None).cast("array<variant>")
        here = F.struct(F.lit(False).alias("each"), F.col("_live").alias("live"), F.lit(None).cast("string").alias("data"))
        gone = F.struct(F.lit(False).alias("each"), F.lit(False).alias("live"), F.lit(None).cast("string").alias("data"))
        made = F.transform(items, lambda x: F.struct(F.lit(True).alias("each"), F.lit(True).alias("live"), F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")).alias("data")))
        df = df.withColumn(item, F.explode(F.when(guard & items.isNotNull(), F.concat(F.array(gone), made)).otherwise(F.array(here))))
        new = F.col(f"{item}.each")
        df = df.withColumns(
            {
                "data": F.when(new, F.col(f"{item}.data")).otherwise(F.col("data")),
                "meta": F.when(new, "{}").otherwise(F.col("meta")),
                "alert": F.when(~new, F.col("alert")),
                "_live": F.col(f"{item}.live"),
                "_outbox": F.when(new, F.array().cast(OUTBOX)).otherwise(F.col("_outbox")),
                mark: new,
            }
        ).drop(item)
        return self.apply(df, s.get("transforms") or [], F.col(mark)).drop(mark)

    def tf_utility_drop(self, df, config, s, guard):
        return df.withColumn("_live", F.col("_live") & ~guard)

    # an end-of-batch marker carries no data
    tf_utility_control = tf_utility_drop

    # ---- detection ----

    def tf_detect(self, df, config, s, guard):
        if not s.get("id"):
            raise ConfigError("transform detect: id is required")
        if not (s.get("condition") or {}).get("type"):
            raise ConfigError("transform detect: condition is required")
        hit = guard & compile_condition(s["condition"], find, F.col("data"))
        dedup = F.coalesce(find(s["dedup_key"]).text, F.lit("")) if s.get("dedup_key") else F.lit("")
        ident = uuid5(F.concat(F.lit(s["id"] + ":"), F.col("data"))) if self.fixed_ids else F.uuid()
        alert = F.struct(
            ident.alias("id"),
            F.lit(s["id"]).alias("rule_id"),
            F.lit(s.get("title", "")).alias("title"),
            F.lit(s.get("description", "")).alias("description"),
            F.lit(s.get("severity") or "INFO").alias("severity"),
            (F.array(*map(F.lit, s["tags"])) if s.get("tags") else F.lit(None).cast("array<string>")).alias("tags"),
            dedup.alias("dedup_key"),
            F.lit(int(s.get("threshold") or 1)).alias("threshold"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
            F.base64(F.encode("data", "UTF-8")).alias("event"),
        )
        return df.withColumn("alert", F.when(hit, F.to_json(alert, {"ignoreNullFields": "false"})).otherwise(F.col("alert")))

    def tf_alert(self, df, config, s, guard):
        mark, data, meta, alert, live = (self._name(x) for x in ("alert", "data", "meta", "kept", "live"))
        df = df.withColumns({mark: guard & F.col("alert").isNotNull(), data: F.col("data"), meta: F.col("meta"), alert: F.col("alert"), live: F.col("_live")})
        df = df.withColumns({"data": F.when(F.col(mark), F.col("alert")).otherwise(F.col("data")), "meta": F.when(F.col(mark), "{}").otherwise(F.col("meta"))})
        df = self.apply(df, s.get("outputs") or [], F.col(mark))
        return df.withColumns({"data": F.col(data), "meta": F.col(meta), "alert": F.col(alert), "_live": F.col(live)}).drop(mark, data, meta, alert, live)

    # ---- enrichment ----

    def _resolved(self, df, config, guard, table: str, suffix: str, value: Callable[[Column], Column]) -> DataFrame:
        found = self.resolve.get(table)
        if found is None:
            return df
        key, got = self._name("key"), self._name("got")
        rows = found.toDF(key, got).dropDuplicates([key])
        df = df.join(rows, (find(source_key(config)).text == F.col(key)) & guard, "left")
        target = target_key(config) or source_key(config) + suffix
        return self._set(df, guard, target, F.when(F.col(got).isNotNull(), value(F.col(got)))).drop(key, got)

    def tf_enrich_dns_reverse(self, df, config, s, guard):
        return self._resolved(df, config, guard, "dns_reverse", "_hostname", lambda c: as_json(F.regexp_replace(c, r"\.$", "")))

    def tf_enrich_dns_forward(self, df, config, s, guard):
        return self._resolved(df, config, guard, "dns_forward", "_ips", F.to_json)

    def tf_enrich_geoip(self, df, config, s, guard):
        # each is a column of its own, as the optimizer would write it out in every test otherwise
        address, number = self._name("address"), self._name("number")
        df = df.withColumn(address, F.when(guard, find(source_key(config)).text))
        text = F.col(address)
        df = df.withColumn(number, ipv4_number(text))
        n = F.col(number)
        private = in_networks(n, RFC1918)
        loopback = in_networks(n, ("127.0.0.0/8",))
        unicast = ~(in_networks(n, ("127.0.0.0/8", "224.0.0.0/4", "169.254.0.0/16", "0.0.0.0/32", "255.255.255.255/32")))
        v4 = F.to_json(F.struct((unicast & ~private).alias("is_global"), loopback.alias("is_loopback"), private.alias("is_private")))
        value = F.when(n.isNotNull(), v4).when(text.contains(":"), _geo_v6(F.when(text.contains(":"), text)))
        return self._set(df, guard, target_key(config) or source_key(config) + "_geo", value).drop(address, number)

    def tf_enrich_http_get(self, df, config, s, guard):
        fetch = self.fetch
        if fetch is None:
            return df
        headers, url = dict(s.get("headers") or {}), s.get("url", "")
        from vigilake.functions.text import parse_duration

        try:
            timeout = parse_duration(s["timeout"]) if s.get("timeout") else 10.0
        except ValueError:
            timeout = 10.0
        full = F.lit(url)
        if source_key(config):
            v = find(source_key(config))
            full = F.when(v.exists, F.replace(F.lit(url), F.lit("{value}"), v.text)).otherwise(url)

        @F.pandas_udf("string")
        def get(urls: pd.Series) -> pd.Series:
            seen: dict[str, str | None] = {}

            def one(u):
                if u is None:
                    return None
                if u not in seen:
                    try:
                        status, body = fetch(u, headers, timeout)
                    except OSError:
                        status, body = 0, ""
                    if status != 200:
                        seen[u] = None
                    else:
                        try:
                            json.loads(body)
                            seen[u] = body
                        except ValueError:
                            seen[u] = _dump(body)
                return seen[u]

            return urls.map(one)

        return self._set(df, guard, target_key(config) or "enrichment", get(F.when(guard, full)))

    # ---- sinks ----

    def _send(self, df, guard, sink: str, settings: dict, payload: Column) -> DataFrame:
        entry = F.struct(F.lit(sink).alias("sink"), F.lit(_dump(settings)).alias("settings"), payload.alias("payload"))
        return df.withColumn("_outbox", F.when(guard, F.concat("_outbox", F.array(entry))).otherwise(F.col("_outbox")))

    def tf_send_stdout(self, df, config, s, guard):
        return self._send(df, guard, "stdout", {}, F.col("data"))

    def tf_send_slack(self, df, config, s, guard):
        if not s.get("webhook_url"):
            raise ConfigError("transform send_slack: webhook_url is required")
        extra = {k: F.lit(s[k]).alias(k) for k in ("channel", "username") if s.get(k)}
        payload = F.to_json(F.struct(*(extra[k] for k in ("channel",) if k in extra), F.col("data").alias("text"), *(extra[k] for k in ("username",) if k in extra)))
        return self._send(df, guard, "slack", {"url": s["webhook_url"]}, payload)

    def tf_send_http_post(self, df, config, s, guard):
        if not s.get("url"):
            raise ConfigError("transform send_http_post: url is required")
        return self._send(df, guard, "http_post", {"url": s["url"], "headers": s.get("headers") or {}, "timeout": s.get("timeout", "")}, F.col("data"))


def _geo_v6(address: Column) -> Column:
    @F.pandas_udf("string")
    def flags(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                ip = ipaddress.ip_address(x)
            except ValueError:
                return None
            unicast = not (ip.is_loopback or ip.is_multicast or ip.is_link_local or ip.is_unspecified)
            return _dump({"is_global": unicast, "is_loopback": ip.is_loopback, "is_private": False})

        return s.map(lambda x: None if x is None else one(x))

    return flags(address)


TYPES = tuple(sorted(n[3:] for n in dir(Compiler) if n.startswith("tf_")))
