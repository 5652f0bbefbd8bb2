"""License scans with ordered signature rules.

Text is reduced to lower-case words joined by single spaces. Each rule has a
label, keywords of which all must stand in the text before the rule's pattern
is run, and a priority. Detections are taken by priority, then length; one that
lies inside an accepted one is suppressed. The base phrases are counted beside
that and their labels always stay.

Defined cases: a null or empty text has no words, no labels and score 0; of
equal detections the one that stands first, then the first label, is taken;
repeated rows are scanned alike; an empty table gives an empty one; other
columns are ignored. The time for a text grows with its length and, sorted,
with its detections.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import ALNUM, LOWER, Spans, signed, slices, texts_of

# Phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_NUM = {"1": r"1(?: 0)?", "2": r"2(?: 0)?", "3": r"3(?: 0)?", "4": r"4(?: 0)?"}
_V = r"(?:version |v ?|ver )?"


def _version(v: str) -> str:
    """'2.0' as it stands among words: 2 0, or 2 alone for a whole number."""
    major, _, minor = v.partition(".")
    return major + (f"(?: {minor})?" if minor == "0" else f" {minor}" if minor else "")


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    priority: int


def _rules() -> list[Rule]:
    out: list[Rule] = []

    def add(label: str, pattern: str, keywords: str, priority: int) -> None:
        out.append(Rule(label, re.compile(rf"(?:^|(?<= ))(?:{pattern})(?= |$)"), tuple(keywords.split()), priority))

    # GNU family
    gnu = {"gpl": ("general public licen[cs]e", "1.0 2.0 3.0"), "lgpl": ("(?:lesser|library) general public licen[cs]e", "2.0 2.1 3.0"), "agpl": ("affero general public licen[cs]e", "1.0 3.0")}
    for short, (name, versions) in gnu.items():
        for v in versions.split():
            n = _version(v)
            add(f"{short}-{v}-or-later", rf"(?:gnu )?{name} (?:as published by the free software foundation )?(?:either )?{_V}{n} (?:of the licen[cs]e )?or (?:at your option )?any later(?: version)?", "public any", 95)
            add(f"{short}-{v}-or-later", rf"{short} {n} (?:or later|plus)", short, 95)
            add(f"{short}-{v}-only", rf"{short} {n} only", f"{short} only", 95)
            add(f"{short}-{v}", rf"(?:gnu )?{name} (?:as published by the free software foundation )?(?:either )?{_V}{n}", "public", 85)
            add(f"{short}-{v}", rf"{short}(?:v| v| version)? ?{n}", short, 80)
        add(short, rf"gnu {name}", "gnu public", 60)
        add(short, rf"(?:gnu {short}|{short} licen[cs]e(?:d)?)", short, 55)
    # Creative Commons: elements x versions x ways to write them
    words = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
    for elements in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        parts = elements.split("-")
        short, long = " ".join(parts), " ".join(words[p] for p in parts)
        for v in ("", "1.0", "2.0", "2.5", "3.0", "4.0"):
            label = f"cc-{elements}" + f"-{v}" * bool(v)
            n, rank = (f" {_V}{_version(v)}" if v else ""), 70 + 3 * len(parts) + (10 if v else 0)
            add(label, rf"cc {short}{n}", "cc by", rank)
            add(label, rf"creative commons {long}(?: international)?(?: licen[cs]e)?{n}", "creative attribution", rank)
            add(label, rf"creativecommons org licenses {short}{n}", "creativecommons", rank + 1)
    for pattern in ("cc0(?: 1 0)?(?: universal)?", "creative commons zero", "creativecommons org publicdomain zero(?: 1 0)?"):
        add("cc0-1.0", pattern, pattern[:3], 80)
    # BSD family
    for n, word in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        add(f"bsd-{n}-clause", rf"bsd (?:{n}|{word}) clause(?: licen[cs]e)?", "bsd clause", 85)
        add(f"bsd-{n}-clause", rf"(?:{n}|{word}) clause bsd(?: licen[cs]e)?", "bsd clause", 85)
    for n, name in (("2", "simplified"), ("2", "freebsd"), ("3", "revised"), ("3", "new"), ("3", "modified"), ("4", "original"), ("4", "old")):
        add(f"bsd-{n}-clause", rf"{name} bsd licen[cs]e", f"bsd {name}", 84)
    add("bsd", r"(?:under the )?bsd (?:style )?licen[cs]e", "bsd", 50)
    add("bsd-source", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary", 90)
    # families with versions
    versioned = {
        "apache": ("apache(?: software)?", "1.0 1.1 2.0"), "mpl": ("mozilla public", "1.0 1.1 2.0"), "epl": ("eclipse public", "1.0 2.0"),
        "cddl": ("common development and distribution", "1.0 1.1"), "eupl": ("european union public", "1.0 1.1 1.2"), "ofl": ("(?:sil )?open font", "1.0 1.1"),
        "artistic": ("artistic", "1.0 2.0"), "afl": ("academic free", "1.1 1.2 2.0 2.1 3.0"), "osl": ("open software", "1.0 1.1 2.0 2.1 3.0"),
        "lppl": ("latex project public", "1.0 1.1 1.2 1.3"), "python": ("python(?: software foundation)?", "2.0"), "cpl": ("common public", "1.0"),
        "ipl": ("ibm public", "1.0"), "npl": ("netscape public", "1.0 1.1"), "php": ("php", "3.0 3.01"), "zpl": ("zope public", "1.1 2.0 2.1"),
        "cecill": ("cecill", "1.0 1.1 2.0 2.1"), "gfdl": ("(?:gnu )?free documentation", "1.1 1.2 1.3"), "bsl": ("boost software", "1.0"), "odbl": ("open (?:data commons )?database", "1.0"),
        "qpl": ("q public", "1.0"), "sspl": ("server side public", "1.0"), "busl": ("business source", "1.0 1.1"), "apsl": ("apple public source", "1.0 1.1 1.2 2.0"),
        "rpl": ("reciprocal public", "1.1 1.5"), "spl": ("sun public", "1.0"), "upl": ("universal permissive", "1.0"), "nposl": ("non profit open software", "3.0"),
    }
    for short, (name, versions) in versioned.items():
        key = max(re.findall("[a-z]+", re.sub(r"\([^)]*\)[?]?", " ", name)), key=len)
        for v in versions.split():
            n = _version(v)
            add(f"{short}-{v}", rf"{name} licen[cs]e {_V}{n}", f"{key} licen", 85)
            add(f"{short}-{v}", rf"{name} {_V}{n} licen[cs]e", f"{key} licen", 85)
            add(f"{short}-{v}", rf"(?:spdx licen[cs]e identifier |licen[cs]ed? under (?:the )?){short} {_V}{n}", f"{short} licen", 82)
        add(short, rf"{name} licen[cs]e", f"{key} licen", 60)
    # single texts
    single = {
        "mit": ("(?:under the |under )?mit licen[cs]e|expat licen[cs]e|licen[cs]ed? under (?:the )?mit|spdx licen[cs]e identifier mit", "licen", 75),
        "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted", 90),
        "mit-0": ("mit no attribution|spdx licen[cs]e identifier mit 0", "mit", 86),
        "x11": ("x11 licen[cs]e|mit x11", "x11", 70),
        "isc": ("(?:the )?isc licen[cs]e|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "is", 80),
        "zlib": ("zlib licen[cs]e|zlib libpng licen[cs]e", "zlib", 75),
        "libpng": ("libpng licen[cs]e", "libpng", 74),
        "unlicense": ("the unlicen[cs]e|this is free and unencumbered software released into the public domain", "un", 80),
        "wtfpl": ("wtfpl|do what the fuck you want to public licen[cs]e", "w", 80),
        "public-domain": ("(?:released into|dedicated to|placed in) the public domain", "public domain", 55),
        "proprietary": ("all rights reserved", "rights reserved", 30),
        "ncsa": ("ncsa open source licen[cs]e|university of illinois ncsa", "ncsa", 75),
        "postgresql": ("postgresql licen[cs]e", "postgresql", 75),
        "openssl": ("openssl licen[cs]e", "openssl", 75),
        "vim": ("vim licen[cs]e", "vim", 75),
        "ruby": ("ruby licen[cs]e", "ruby", 75),
        "perl": ("same terms as perl itself", "perl", 75),
        "beerware": ("beerware licen[cs]e|the beer ware licen[cs]e", "beer", 75),
        "json": ("the software shall be used for good not evil", "evil", 85),
        "commons-clause": ("commons clause", "clause", 70),
        "elastic-2.0": ("elastic licen[cs]e(?: 2 0| v2)?", "elastic", 72),
        "polyform-noncommercial": ("polyform noncommercial(?: licen[cs]e)?(?: 1 0 0)?", "polyform", 80),
        "no-redistribution": ("may not be (?:copied|reproduced|redistributed) without (?:prior )?(?:written )?permission", "without permission", 40),
    }
    for label, (pattern, keywords, priority) in single.items():
        add(label, pattern, keywords, priority)
    return sorted(out, key=lambda r: -r.priority)


RULES = _rules()
#: Stands in every text that a rule or base phrase can match.
_GATE = re.compile(rb"licen|gpl|bsd|creative|hereby|redistribut|wtfpl|rights|clause|perl|evil|unencumbered|ncsa|x11|polyform|permission|public|(?<![0-9a-z\x80-\xff])(?:cc|mit)[^0-9a-z\x80-\xff]|(?<![0-9a-z\x80-\xff])cc0")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Words:
    """Normalised text and where its words start."""

    def __init__(self, text: str):
        self.text = text
        self.spaces = [m.start() for m in re.finditer(" ", text)]

    def index(self, at: int) -> int:
        """Number of the word at this place."""
        return bisect_left(self.spaces, at)


def _places(words: Words, phrase: str) -> list[int]:
    """Word indices at which the phrase's words stand; overlaps count."""
    padded, needle, out, at = f" {words.text} ", f" {phrase} ", [], -1
    while (at := padded.find(needle, at + 1)) >= 0:
        out.append(words.index(at))
    return out


class Covered:
    """Intervals of which none lies in another, in order; tells whether one of them holds a new one."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start) - 1
        return k >= 0 and self.ends[k] >= end

    def add(self, start: int, end: int) -> None:
        a, b = bisect_left(self.starts, start), bisect_right(self.ends, end)
        self.starts[a : max(a, b)], self.ends[a : max(a, b)] = [start], [end]


def scan(text: str, rules: list[Rule] | None = None) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, int]]]:
    """Base detections (label, first word) and accepted rule detections (label, first word, word behind the last, priority) of normalised text."""
    rules = RULES if rules is None else rules
    words = Words(text)
    base = [(label, at) for phrase, label in BASE.items() for at in _places(words, phrase)]
    stands: dict[str, bool] = {}
    for r in rules:
        for k in r.keywords:
            if k not in stands:
                stands[k] = k in text
    found = [(r.priority, m.end() - m.start(), m.start(), r.label) for r in rules if all(map(stands.__getitem__, r.keywords)) for m in r.pattern.finditer(text)]
    accepted, covered = [], Covered()
    for priority, size, start, label in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
        if not covered.holds(start, start + size):
            accepted.append((label, words.index(start), words.index(start + size) + 1, priority))
            covered.add(start, start + size)
    return base, accepted


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document n_words, the base counts, labels, score (confidence of the best detection) and detections (label, word span)."""
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    detection = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buf, off = texts_of(batch.column("text"))
            lower = LOWER[buf]
            n_words = Spans(lower, off, ALNUM).counts
            n = len(n_words)
            n_base, first, last = np.zeros(n, np.int64), [None] * n, [None] * n
            base_labels, labels, score, spans = [""] * n, [""] * n, np.zeros(n), [[] for _ in range(n)]
            whole = lower.tobytes()
            whole = b"\n".join([whole[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])  # no match runs on into the next text
            off = off + np.arange(n + 1)
            for k in np.unique(np.searchsorted(off, [m.start() for m in _GATE.finditer(whole)], "right") - 1).tolist():
                normal = b" ".join(_WORD.findall(whole, off[k], off[k + 1])).decode("utf-8", "replace")
                base, accepted = scan(normal)
                if not base and not accepted:
                    continue
                n_base[k] = len(base)
                if base:
                    first[k], last[k] = min(at for _, at in base), max(at for _, at in base)
                base_labels[k] = ",".join(sorted({x for x, _ in base}))
                labels[k] = ",".join(sorted({x for x, _ in base} | {x for x, *_ in accepted}))
                score[k] = max([0.75] * bool(base) + [p / 100 for *_, p in accepted])
                spans[k] = [{"label": x, "start": s, "stop": e} for x, s, e, _ in sorted(accepted, key=lambda x: x[1])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), signed(n_words), signed(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels), pa.array(labels), pa.array(score), pa.array(spans, detection)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:long,stop:long>>")
