"""Detection rules as column expressions over a payload."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.functions.paths import variant_path
from vigilake.functions.text import any_of, contains_any_ci


@dataclass(frozen=True)
class Threshold:
    """True for the event with which ``count`` of a key lie in the window that ends with it."""

    key: Column
    seconds: int
    count: int


@dataclass(frozen=True)
class FirstSeen:
    """True for the first event of a key."""

    key: Column


@dataclass(frozen=True)
class Rule:
    rule_id: str
    when: Column
    title: Column
    severity: Column
    dedup: Column
    state: Threshold | FirstSeen | None = None


_HOLE = re.compile(r"\{([^{}|]+)(?:\|([^{}]*))?\}")


class Event:
    """Accessors over a payload. Tests are never null: what is missing is false.

    Truth is Python's where a rule asks for it: empty text, zero, false and
    empty lists and objects are false. ``is_true`` asks for the JSON value true.
    """

    def __init__(self, payload: Column, log_type: Column | None = None):
        self.v = payload
        self.log_type = log_type

    # ---- values ----

    def get(self, path: str, kind: str) -> Column:
        return F.try_variant_get(self.v, variant_path(path), kind)

    def s(self, path: str, default: str | None = None) -> Column:
        """The value as text; objects and lists as JSON."""
        found = self.get(path, "string")
        return found if default is None else F.coalesce(found, F.lit(default))

    def n(self, path: str) -> Column:
        return self.get(path, "double")

    def variant(self, path: str) -> Column:
        return self.get(path, "variant")

    def kind(self, path: str) -> Column:
        return F.coalesce(F.schema_of_variant(self.variant(path)), F.lit("VOID"))

    def items(self, path: str) -> Column:
        """A list's items; none where the value is no list."""
        return F.coalesce(self.get(path, "array<variant>"), F.array().cast("array<variant>"))

    def texts(self, path: str) -> Column:
        """A list's items as text; none where the value is no list."""
        return F.transform(self.items(path), lambda x: F.try_variant_get(x, "$", "string"))

    def first_true(self, *paths: str) -> Column:
        """The first value that is not empty, as text."""
        return F.coalesce(*(F.when(self.truthy(p), self.s(p)) for p in paths))

    # ---- tests ----

    def is_object(self, path: str) -> Column:
        return F.startswith(self.kind(path), F.lit("OBJECT"))

    def has(self, path: str) -> Column:
        """The path exists and is not JSON null."""
        return self.s(path).isNotNull()

    def eq(self, path: str, value: str) -> Column:
        return F.coalesce(self.s(path) == value, F.lit(False))

    def among(self, path: str, *values: str) -> Column:
        return F.coalesce(self.s(path).isin(*values), F.lit(False)) if values else F.lit(False)

    def starts(self, path: str, *prefixes: str) -> Column:
        return F.coalesce(any_of(self.s(path).startswith(p) for p in prefixes), F.lit(False))

    def ends(self, path: str, *suffixes: str) -> Column:
        return F.coalesce(any_of(self.s(path).endswith(p) for p in suffixes), F.lit(False))

    def contains(self, path: str, *parts: str) -> Column:
        return F.coalesce(any_of(self.s(path).contains(p) for p in parts), F.lit(False))

    def contains_ci(self, path: str, parts) -> Column:
        return contains_any_ci(self.s(path), parts)

    def search(self, path: str, *patterns: str) -> Column:
        return F.coalesce(any_of(self.s(path).rlike(p) for p in patterns), F.lit(False))

    def is_true(self, path: str) -> Column:
        return (self.kind(path) == "BOOLEAN") & self.eq(path, "true")

    def is_false(self, path: str) -> Column:
        return (self.kind(path) == "BOOLEAN") & self.eq(path, "false")

    def truthy(self, path: str) -> Column:
        kind, text = self.kind(path), self.s(path, "")
        return (
            F.when(kind == "VOID", False)
            .when(kind == "STRING", text != "")
            .when(kind == "BOOLEAN", text == "true")
            .when(F.startswith(kind, F.lit("ARRAY")), text != "[]")
            .when(F.startswith(kind, F.lit("OBJECT")), text != "{}")
            .otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(True)))
        )

    def any(self, path: str, test: Callable[[Event], Column]) -> Column:
        return F.exists(self.items(path), lambda x: test(Event(x, self.log_type)))

    def walk(self, *keys: str) -> Column:
        """Distinct texts found along keys, lists crossed on the way, in order of their first place."""
        found = F.array(self.v)
        for path in map(variant_path, keys):
            found = F.flatten(F.transform(found, _opened_at(path)))
        return F.array_distinct(F.transform(found, lambda x: F.try_variant_get(x, "$", "string")))

    # ---- text ----

    def fmt(self, template: str, **named: Column) -> Column:
        """Text with {path|default} and {$name} filled in; without a default, None stands for what is missing."""
        parts, at = [], 0
        for m in _HOLE.finditer(template):
            if m.start() > at:
                parts.append(F.lit(template[at : m.start()]))
            value = named[m.group(1)[1:]] if m.group(1).startswith("$") else self.s(m.group(1))
            parts.append(F.coalesce(value, F.lit("None" if m.group(2) is None else m.group(2))))
            at = m.end()
        if at < len(template) or not parts:
            parts.append(F.lit(template[at:]))
        return F.concat(*parts)

    def rule(self, rule_id: str, when: Column, title: str | Column | None = None, severity: str | Column = "INFO", dedup: str | Column | None = None, state=None, **named: Column) -> Rule:
        def text(x, default: str) -> Column:
            return F.lit(default) if x is None else x if isinstance(x, Column) else self.fmt(x, **named)

        level = severity if isinstance(severity, Column) else F.lit(severity)
        return Rule(rule_id, F.coalesce(when, F.lit(False)), F.coalesce(text(title, rule_id), F.lit(rule_id)), F.coalesce(level, F.lit("INFO")), F.coalesce(text(dedup, rule_id), F.lit(rule_id)), state)

    # ---- several logs ----

    @cached_property
    def succeeded(self) -> Column:
        """A CloudTrail call without error code and message."""
        return (self.s("errorCode", "") == "") & (self.s("errorMessage", "") == "")

    def named(self, *names: str) -> Column:
        return self.among("eventName", *names)

    @cached_property
    def actor(self) -> Column:
        """Who acted, by the kind of identity."""
        arn = self.s("userIdentity.arn")
        tail = F.element_at(F.split(arn, "/"), -1)
        kind = self.s("userIdentity.type", "")
        of_identity = (
            F.when(kind == "IAMUser", self.s("userIdentity.userName", "<UNKNOWN>"))
            .when(kind == "AssumedRole", F.coalesce(self.first_true("userIdentity.sessionContext.sessionIssuer.userName"), F.when(arn != "", tail), F.lit("<UNKNOWN>")))
            .when(kind == "Root", "root")
            .when(kind == "AWSService", self.s("userIdentity.invokedBy", "<AWS_SERVICE>"))
            .otherwise(F.coalesce(tail, F.lit("<UNKNOWN>")))
        )
        of_actor = F.coalesce(self.first_true("actor.alternateId", "actor.displayName"), F.lit("<UNKNOWN>"))
        of_user = F.coalesce(self.first_true("user.email", "user.name"), F.lit("<UNKNOWN>"))
        return F.when(self.truthy("userIdentity"), of_identity).when(self.truthy("actor"), of_actor).when(self.has("user"), of_user).otherwise("<UNKNOWN>")

    @cached_property
    def source_ip(self) -> Column:
        return F.coalesce(self.s("sourceIPAddress"), self.s("client.ipAddress"), self.s("ipAddress"), self.s("client.ip_address"), F.lit("<UNKNOWN>"))

    @cached_property
    def account(self) -> Column:
        return F.coalesce(self.first_true("recipientAccountId"), self.s("userIdentity.accountId"))


#: The column of what rules share, and the number of each atom in it, the same in every plan.
ATOMS = "_atoms"
_NUMBERS: dict[str, int] = {}


class AtomEvent(Event):
    """An event whose extractions are atoms: fields of the column ``_atoms``, each worked out once per event whatever the number of rules that ask for it.

    ``atoms`` has the expressions of those that have been asked for. Templates
    of titles and the like are read from the payload, as only matches need them.
    """

    def __init__(self, payload: Column, log_type: Column | None = None):
        super().__init__(payload, log_type)
        self.raw = Event(payload, log_type)
        self.atoms: dict[str, Column] = {}
        self._known: dict[str, Column] = {}

    def _atom(self, key: str, make: Callable[[], Column]) -> Column:
        found = self._known.get(key)
        if found is None:
            name = f"a{_NUMBERS.setdefault(key, len(_NUMBERS))}"
            self.atoms[name] = make()
            found = self._known[key] = F.col(ATOMS)[name]
        return found

    def get(self, path: str, kind: str) -> Column:
        return self._atom(f"{kind} {path}", lambda: self.raw.get(path, kind))

    def kind(self, path: str) -> Column:
        return self._atom(f"kind of {path}", lambda: self.raw.kind(path))

    def truthy(self, path: str) -> Column:
        return self._atom(f"truth of {path}", lambda: self.raw.truthy(path))

    def fmt(self, template: str, **named: Column) -> Column:
        return self.raw.fmt(template, **named)


class Pack(list):
    """Rules with the atoms that they read."""

    def __init__(self, rules: list[Rule], atoms: dict[str, Column]):
        super().__init__(rules)
        self.atoms = atoms


def _opened_at(path: str) -> Callable[[Column], Column]:
    return lambda x: _opened(F.try_variant_get(x, path, "variant"))


def _opened(x: Column) -> Column:
    """A list's items, lists in it opened too; one item for another value; none for null."""
    items = F.try_variant_get(x, "$", "array<variant>")
    return F.when(x.isNull() | (F.schema_of_variant(x) == "VOID"), F.array().cast("array<variant>")).when(items.isNotNull(), items).otherwise(F.array(x))
