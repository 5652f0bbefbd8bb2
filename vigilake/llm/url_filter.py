"""URL filters: host rules first, then a tree of path templates per host.

DataFrame functions only. Numbers, hexadecimal strings and long mixed tokens of
a path become wildcards that keep a file extension; what stands behind the first
``depth`` segments is folded into one last segment ``**``. The rest is a tree
per host, whose nodes are judged all at once, in a fixed number of rounds:

* a node with ``most`` different children, or with ``many`` of them that are
  ``share`` of its rows at least, gets one wildcard child instead. The next
  round sees the children's subtrees as one, so wildcards below wildcards, as
  deep as there are rounds, are found;
* in the last round labelled children of other nodes are put in order of their
  block rate, and neighbours in it are merged where a two-sample test of their
  rates gives no difference of more than ``z`` standard errors. Paths whose
  segments are then alike at every place have one template.

Rows that a rule decides are the labels. A node's purity is its labelled block
rate, smoothed by its parent's with ``weight`` observations. Above the host
stands the rate of all hosts; on these two an unlabelled row counts as
``doubt`` of a row that is not blocked, as rules label little else than what
they block. A template is rejected from ``purity`` on.

The tree is built on aggregated shapes, which are written once a round; only
the last join, by host and shape, meets all rows, and it can be split where a
host is hot. Work does not depend on how deep a path is beyond ``depth``.

Defined cases: a url that is null or has no "://" has an empty host and path,
fits no rule and is judged with all such rows; a host without labels has the
smoothed rate of all; repeated rows are judged alike and count as often as they
stand; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import written

# Fixed values: (verdict, host and path start).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    place = F.instr(url, "://")
    after = F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _general(segment: Column) -> Column:
    ext = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    wild = stem.rlike("^[0-9]+$") | stem.rlike("^(?=.*[0-9])[0-9A-Fa-f-]{8,}$") | (stem.rlike("[0-9]") & stem.rlike("[A-Za-z]") & (F.length(stem) >= 12)) | (F.length(stem) > 60)
    return F.when(wild, F.concat(F.lit("*"), ext)).otherwise(segment)


def _changes(places: DataFrame, last: bool, many: int, most: int, share: float, z: float) -> tuple[DataFrame, DataFrame | None]:
    """Nodes (host, k, start) whose children become one wildcard; and, in the last round, the names of merged children of others."""
    node = ["host", "k", "start"]
    kids = places.groupBy(*node, "segment").agg(*(F.sum(c).alias(c) for c in ("n", "known", "bad")))
    nodes = kids.groupBy(*node).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("rows"), F.count_if(F.col("known") > 0).alias("labelled"))
    nodes = nodes.withColumn("wild", (F.col("kinds") >= most) | ((F.col("kinds") >= many) & (F.col("kinds") >= share * F.col("rows"))))
    wild = nodes.where("wild").select(*node, F.lit("*").alias("every"))
    if not last:
        return wild, None
    # fewer than ``most`` children of a node remain
    some = kids.where("known > 0").withColumn("rate", F.col("bad") / F.col("known")).join(nodes.where("not wild and labelled > 1").select(*node), node)
    order = Window.partitionBy(*node).orderBy("rate", "segment")
    n0, p0 = F.lag("known").over(order), F.lag("rate").over(order)
    pooled = (F.lag("bad").over(order) + F.col("bad")) / (n0 + F.col("known"))
    unlike = F.abs(F.col("rate") - p0) > z * F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / F.col("known")))
    grouped = some.withColumn("unlike", F.coalesce(unlike, F.lit(True)).cast("int")).withColumn("branch", F.sum("unlike").over(order))
    branch = Window.partitionBy(*node, "branch")
    least, most_, kinds = F.min("segment").over(branch), F.max("segment").over(branch), F.count(F.lit(1)).over(branch)
    merged = grouped.select(*node, "segment", F.when(kinds > 1, F.concat(F.lit("{"), least, F.lit("|"), most_, F.lit("}"))).alias("name")).where("name is not null")
    return wild, merged


def path_tree(shapes: DataFrame, *, rounds: int, many: int, most: int, share: float, z: float) -> DataFrame:
    """shapes (host, shape, n, known, bad) with their template, an array of segments."""
    tree = shapes.withColumn("template", F.split("shape", "/"))
    for r in range(rounds):
        placed = tree.select("host", "shape", "n", "known", "bad", "template", F.posexplode("template").alias("k", "segment"))
        placed = placed.withColumn("start", F.array_join(F.slice("template", F.lit(1), F.col("k")), "/")).drop("template")
        wild, merged = _changes(placed, r == rounds - 1, many, most, share, z)
        named = placed.join(wild, ["host", "k", "start"], "left")
        name = F.coalesce("every", "segment")
        if merged is not None:
            named, name = named.join(merged, ["host", "k", "start", "segment"], "left"), F.coalesce("every", "name", "segment")
        again = named.groupBy("host", "shape").agg(*(F.first(c).alias(c) for c in ("n", "known", "bad")), F.sort_array(F.collect_list(F.struct("k", name.alias("name")))).alias("path"))
        tree = written(again.select("host", "shape", "n", "known", "bad", F.col("path.name").alias("template")))
    return tree


def purities(tree: DataFrame, *, weight: float, doubt: float) -> DataFrame:
    """(host, template, purity) of each template of path_tree's."""
    sums = [F.sum(c).alias(c) for c in ("n", "known", "bad")]
    templates = tree.groupBy("host", "template").agg(*sums)
    places = templates.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("template")))).withColumn("start", F.slice("template", F.lit(1), F.col("depth")))
    nodes = places.groupBy("host", "start").agg(*sums)
    whole = tree.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "known", "bad"))).first()
    every = whole.bad / max(1.0, whole.known + doubt * (whole.n - whole.known))
    above = places.select("host", "template", "depth", "start").join(nodes, ["host", "start"])
    chains = above.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("depth", "n", "known", "bad"))).alias("chain"))
    unknown = lambda x: F.when(x.depth == 0, doubt * (x.n - x.known)).otherwise(0.0)
    purity = F.aggregate("chain", F.lit(float(every)), lambda above, x: (x.bad + weight * above) / (x.known + unknown(x) + weight))
    return chains.select("host", "template", purity.alias("purity"))


def filter_urls(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules=RULES, depth: int = 16, rounds: int = 3, many: int = 20, most: int = 1000, share: float = 0.5, z: float = 2.0, weight: float = 10.0, doubt: float = 0.25, purity: float = 0.8) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity)."""
    host, path = host_and_path(pages[url])
    base = pages.select(pages[page_id].alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    folded = F.when(F.size(segments) > depth, F.concat(F.slice(segments, 1, depth), F.array(F.lit("**")))).otherwise(segments)
    shape = F.array_join(F.transform(folded, _general), "/")
    base = base.withColumns({"rule": rule, "decided": verdict, "shape": shape})
    shapes = written(base.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("decided").alias("known"), F.count_if(F.col("decided") == "block").alias("bad")))
    tree = path_tree(shapes, rounds=rounds, many=many, most=most, share=share, z=z)
    judged = tree.select("host", "shape", "template").join(purities(tree, weight=weight, doubt=doubt), ["host", "template"])
    judged = written(judged.select("host", "shape", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity"))
    out = base.join(judged, ["host", "shape"], "left")
    verdict = F.coalesce("decided", F.when(F.col("purity") >= purity, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
