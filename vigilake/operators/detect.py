"""Evaluation of rules over events.

What rules read of a payload are atoms, worked out once per event in front of
all rules. All rules of a log type are one array expression over them, each
entry null unless its predicate holds, so titles and the like are made for
matches only; one pass over the events serves every pack. Rules with state yield candidates in that
pass, which are then put through the stateful operators.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.k8s import once
from vigilake.rules.model import ATOMS, AtomEvent, FirstSeen, Pack, Rule, Threshold
from vigilake.rules.registry import PACKS, log_types, pack_rules, prepared
from vigilake.sources.scratch import Scratch

from .classify import infer_log_type, with_payload
from .stateful import event_time, first_seen, micros, thresholds_crossed

#: Before any event; a comparison with it is no test that Spark could leave out.
LONG_AGO = "0001-01-01"
_HIT = "struct<rule_id:string,title:string,severity:string,dedup:string,state:string>"


@dataclass(frozen=True)
class Analysis:
    #: events' columns kept, with rule_id, title, severity, dedup
    matches: DataFrame
    #: rule_id, match, no_match
    evaluations: DataFrame
    #: hits of rules with state, whatever came of them: rule_id, state, _at, title and eventID; what later runs need as ``past``
    stateful: DataFrame | None = None


def _hit(r: Rule) -> Column:
    state = F.lit(None).cast("string") if r.state is None else r.state.key
    return F.when(r.when, F.struct(F.lit(r.rule_id).alias("rule_id"), r.title.alias("title"), r.severity.alias("severity"), r.dedup.alias("dedup"), state.alias("state")))


class RuleSet:
    """Rules by the log types they apply to; an own rule without types applies to all."""

    def __init__(self, mode: str = "reference", packs: list[str] | None = None, options: dict[str, dict] | None = None):
        self.mode, self.options = mode, options or {}
        self.packs = list(PACKS) if packs is None else packs
        self.own: list[tuple] = []

    def add(self, make, types: tuple[str, ...] | None = None) -> RuleSet:
        """make(event) -> list of rules."""
        self.own.append((make, types))
        return self

    def build(self, packs: list[str] | None = None) -> list[tuple[list[Rule], tuple[str, ...] | None]]:
        """Rules over the columns payload and log_type."""
        found = [(pack_rules(p, self.mode == "intended", self.mode, **self.options.get(p, {})), log_types(p, self.mode)) for p in (self.packs if packs is None else packs)]
        for make, types in self.own:
            e = AtomEvent(F.col("payload"), F.col("log_type"))
            found.append((Pack(make(e), e.atoms), types))
        return found


def _found(events: DataFrame, rules: RuleSet, only: tuple[str, ...] | None, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame, list[str], dict, list]:
    """The events, the hits of all rules (kept columns, _at, rule_id, title, severity, dedup, state), the kept columns, the rules' states, and (rule, log type) pairs."""
    if "payload" not in events.columns:
        events = with_payload(events, rules.mode)
    if "log_type" not in events.columns:
        events = events.withColumn("log_type", infer_log_type(F.col("payload")))
    if only:
        events = events.where(F.col("log_type").isin(*only))
    packs = [p for p in rules.packs if only is None or set(log_types(p, rules.mode)) & set(only)]
    plain, events = events, prepared(events, packs)
    built = [(rs, types) for rs, types in rules.build(packs) if rs and (only is None or types is None or set(types) & set(only))]
    atoms = {name: c for rs, _ in built for name, c in rs.atoms.items()}
    if atoms:
        events = events.withColumn(ATOMS, once(F.struct(*(c.alias(name) for name, c in atoms.items()))))
    none = F.array().cast(f"array<{_HIT}>")
    parts = {}
    for i, (rs, types) in enumerate(built):
        hits = F.array_compact(F.array(*map(_hit, rs))).cast(f"array<{_HIT}>")
        parts[f"_m{i}"] = hits if types is None else F.when(F.col("log_type").isin(*types), hits).otherwise(none)
    held = [c for c in keep if c in events.columns]
    order = F.coalesce(F.col("eventTime"), F.timestamp_seconds(F.lit(0))) if "eventTime" in events.columns else F.timestamp_seconds(F.lit(0))
    every = F.flatten(F.array(*parts.values())) if parts else none
    # the outer form, as Spark would work out all rules a second time to filter in front of the plain one
    hits = events.select("log_type", *held, event_time(F.col("payload"), order).alias("_at"), F.explode_outer(every).alias("_h"))
    found = hits.where("_h is not null").select("log_type", *held, "_at", "_h.*")
    states = {r.rule_id: r.state for rs, _ in built for r in rs if r.state is not None}
    by_rule = [(r.rule_id, t) for rs, types in built for r in rs for t in (types or (None,))]
    return plain, found, held, states, by_rule


def found_hits(events: DataFrame, rules: RuleSet, only: tuple[str, ...] | None, keep: tuple[str, ...]) -> tuple[DataFrame, dict]:
    """Hits of all rules, before state is looked at, and the rules' states. events may be a stream."""
    _, found, _, states, _ = _found(events, rules, only, keep)
    return found, states


def _settled(found: DataFrame, states: dict, held: list[str], seen: DataFrame | None, past: DataFrame | None) -> DataFrame:
    """The hits that are matches once rules with state have had their say."""
    seq = [c for c in ("eventID",) if c in held] + ["title"]
    limits = {k: (s.seconds * 1_000_000, s.count) for k, s in states.items() if isinstance(s, Threshold)}
    firsts = [k for k, s in states.items() if isinstance(s, FirstSeen)]
    parts = [found.where(~F.col("rule_id").isin(*states))]
    if limits:
        candidates = found.where(F.col("rule_id").isin(*limits)).withColumn("_now", F.lit(True))
        if past is not None:
            candidates = candidates.unionByName(past.where(F.col("rule_id").isin(*limits)).select("rule_id", "state", "_at", *seq), allowMissingColumns=True)
        crossed = thresholds_crossed(candidates.withColumn("_us", micros(F.col("_at"))), limits, "rule_id", "state", "_us", seq)
        parts.append(crossed.where("_now").drop("_us", "_now"))
    if firsts:
        parts.append(first_seen(found.where(F.col("rule_id").isin(*firsts)), ["rule_id", "state"], ["_at", *seq], seen))
    return reduce(lambda a, b: a.unionByName(b), parts)


def analyze(events: DataFrame, rules: RuleSet | None = None, only: tuple[str, ...] | None = None, keep: tuple[str, ...] = ("eventID", "eventTime", "eventSource", "eventName"), seen: DataFrame | None = None, stateful: bool = True, past: DataFrame | None = None) -> Analysis:
    """Matches of the rules, and how often each rule has been evaluated.

    events: the classified ones, or any rows with a VARIANT ``payload``; without
    a log_type, it is inferred. ``only`` names the log types that can occur,
    which leaves the other packs out of the plan. ``seen`` (rule_id, state) are
    keys of first-seen rules from before, ``past`` earlier hits of rules with
    windows. Without ``stateful``, rules with state match whenever their
    predicate does. For many packs see analyze_by_pack().
    """
    events, found, held, states, by_rule = _found(events, rules or RuleSet(), only, keep)
    settled = _settled(found, states, held, seen, past) if stateful and states else found
    matches = settled.drop("_at", "state")
    return Analysis(matches, _evaluations(events, by_rule, matches), found.where(F.col("rule_id").isin(*states)) if states else None)


def _evaluations(events: DataFrame, by_rule: list[tuple[str, str | None]], matches: DataFrame) -> DataFrame:
    """rule_id, match, no_match; by_rule: rules and the log types they apply to, null for all."""
    index = events.sparkSession.createDataFrame(by_rule or [("", "")], "rule_id string, t string").where("rule_id <> ''")
    types = events.groupBy("log_type").agg(F.count(F.lit(1)).alias("events"))
    totals = types.join(F.broadcast(index), F.col("t").isNull() | (F.col("t") == F.col("log_type"))).groupBy("rule_id").agg(F.sum("events").alias("events"))
    counts = matches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("match"))
    return totals.join(counts, "rule_id", "left").select("rule_id", F.coalesce("match", F.lit(0)).alias("match"), (F.col("events") - F.coalesce("match", F.lit(0))).alias("no_match")).orderBy("rule_id")


def analyze_by_pack(events: DataFrame, rules: RuleSet | None = None, keep: tuple[str, ...] = ("eventID", "eventTime", "eventSource", "eventName"), seen: DataFrame | None = None, stateful: bool = True, past: DataFrame | None = None, scratch: Scratch | None = None, threads: int = 8) -> Analysis:
    """The same as analyze(), for classified events and any number of packs.

    What rules read is written once, by log type, so classification is not part
    of any rule's plan. Each pack whose log types occur then reads those alone,
    in a plan of its own; several are planned and run at a time. Plans thus grow
    with a pack, not with the number of rules, and a lost executor costs a
    task's work. The tables are in ``scratch``, whose owner deletes them.
    """
    rules = rules or RuleSet()
    if "payload" not in events.columns:
        events = with_payload(events, rules.mode)
    spark, scratch = events.sparkSession, scratch or Scratch(events.sparkSession)
    held = [c for c in keep if c in events.columns]
    stored = scratch.written(events.select(*dict.fromkeys([*held, "payload", "log_type"])), "log_type")
    present = {r.log_type for r in stored.select("log_type").distinct().collect()}  # at most one for each format
    groups = [(RuleSet(rules.mode, [p], rules.options), tuple(sorted(set(log_types(p, rules.mode)) & present))) for p in rules.packs]
    groups = [(part, types) for part, types in groups if types]
    if rules.own:
        own = RuleSet(rules.mode, [], rules.options)
        own.own = rules.own
        groups.append((own, None))

    def run(group: tuple[RuleSet, tuple[str, ...] | None]) -> tuple[DataFrame, dict, list]:
        _, found, _, states, by_rule = _found(stored, *group, keep)
        return scratch.written(found), states, by_rule

    with ThreadPoolExecutor(max(1, threads)) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(run), groups))
    columns = "log_type string, " + "".join(f"`{c}` {stored.schema[c].dataType.simpleString()}, " for c in held) + "_at timestamp, rule_id string, title string, severity string, dedup string, state string"
    found = reduce(lambda a, b: a.unionByName(b), [x for x, _, _ in done]) if done else spark.createDataFrame([], columns)
    states = {k: v for _, own_states, _ in done for k, v in own_states.items()}
    settled = scratch.written(_settled(found, states, held, seen, past)) if stateful and states else found
    matches = settled.drop("_at", "state")
    return Analysis(matches, _evaluations(stored, [x for _, _, by_rule in done for x in by_rule], matches), found.where(F.col("rule_id").isin(*states)) if states else None)


def with_reference(matches: DataFrame) -> DataFrame:
    """matches with detection_ref, rule and event in one text."""
    return matches.withColumn("detection_ref", F.concat(F.col("rule_id"), F.lit(":"), F.coalesce(F.nullif("eventID", F.lit("")), F.lit("unknown"))))
