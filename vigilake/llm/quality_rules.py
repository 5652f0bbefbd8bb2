"""Quality rules with a distribution test.

The rules count what repeats, symbols and words; the test compares two
histograms of a document with those of its language: of character classes, and
of the language's common words (all others as one). The distance is
Jensen-Shannon's, in bits, from 0 to 1. The references are counted over all
documents, per language, in a pass that sends only sums to the driver (at most
languages x slots numbers). A histogram of too few observations says nothing,
so under ``min_chars`` and ``min_words`` the test passes.

Defined cases: a null or empty text has only zeros and fails the base rules; a
language without a word list, or null, is compared with the reference of all
such documents by character classes only; repeated rows are judged alike.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import ALNUM, LINES, LOWER, SPACED, Spans, grams, mix, per_text, signed, slices, span_hashes, texts_of

# Very common words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on with as be by at this from or an are not have but which you he we they",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce avec il sont on ou son",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
}
OTHER = "other"
MIN_CHARS, MIN_WORDS = 200, 50
#: The word distance may exceed its limit by WORD_NOISE / sqrt(words), which a sample of so few words does by chance.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, WORD_NOISE = 0.25, 0.08, 2.2
#: Character classes: lower, upper, digit, white space, sentence marks, other ASCII marks, first byte of others, later bytes (not counted).
_CLASSES = 8
_CLASS = np.full(256, 5, np.uint8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[list(b" \t\n\v\f\r")], _CLASS[list(b".,;:'\"-()")] = 3, 4
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 7, 6
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _word_table() -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Sorted hashes of all common words, the slot of each, and each language's number of words."""
    words = sorted({w for ws in COMMON_WORDS.values() for w in ws.split()})
    buf, off = texts_of(pa.array(words))
    h = span_hashes(buf, off[:-1], off[1:])
    order = np.argsort(h)
    return h[order], order, {w: i for i, w in enumerate(words)}


_HASHES, _SLOTS, _NUMBER = _word_table()
_OWN = {lang: np.array([_NUMBER[w] for w in ws.split()]) for lang, ws in COMMON_WORDS.items()}
_MASK = np.uint64(0xFFFF)
_MAYBE = np.zeros(1 << 16, bool)
_MAYBE[(_HASHES & _MASK).astype(np.int64)] = True


def histograms(buf: np.ndarray, off: np.ndarray, langs: list[str]) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Character-class counts of each text, and its counts of its language's common words with the rest last."""
    classes = _CLASS[buf]
    by_class = np.array([np.bincount(classes[a:b], minlength=_CLASSES) for a, b in zip(off[:-1], off[1:], strict=True)]).reshape(len(off) - 1, _CLASSES)[:, : _CLASSES - 1]
    lower = LOWER[buf]
    spans = Spans(lower, off, ALNUM)
    h = span_hashes(lower, spans.starts, spans.ends)
    some = np.flatnonzero(_MAYBE[(h & _MASK).astype(np.int64)])
    place = np.minimum(np.searchsorted(_HASHES, h[some]), len(_HASHES) - 1)
    hit = _HASHES[place] == h[some]
    at, slot = some[hit], _SLOTS[place[hit]]
    bounds = np.searchsorted(at, spans.first)
    by_word: list[np.ndarray | None] = []
    for k, lang in enumerate(langs):
        if lang not in _OWN:
            by_word.append(None)
            continue
        seen = np.bincount(slot[bounds[k] : bounds[k + 1]], minlength=len(_NUMBER))[_OWN[lang]]
        by_word.append(np.append(seen, spans.first[k + 1] - spans.first[k] - seen.sum()))
    return by_class, by_word


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors, base 2."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = [np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(kl) / 2)))


def _known(lang: str | None) -> str:
    return lang if lang in _OWN else OTHER


def references(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray | None]]:
    """For each language, counts of character classes and of common words over all documents."""
    source = docs.select(docs[text].alias("text"), docs[lang].cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in slices(batches):
            buf, off = texts_of(batch.column("text"))
            langs = [_known(x) for x in batch.column("lang").to_pylist()]
            by_class, by_word = histograms(buf, off, langs)
            for k, name in enumerate(langs):
                for kind, counts in ((0, by_class[k]), (1, by_word[k])):
                    if counts is not None:
                        sums[name, kind] = sums.get((name, kind), 0) + counts
        rows = [(name, kind, slot, int(n)) for (name, kind), counts in sums.items() for slot, n in enumerate(counts)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["lang", "kind", "slot", "n"])

    out: dict = defaultdict(dict)
    for r in source.mapInArrow(run, "lang string, kind int, slot int, n long").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).collect():
        out[r.lang, r.kind][r.slot] = r.n
    whole = {key: np.array([slots[i] for i in range(len(slots))], float) for key, slots in out.items()}
    return {name: (whole[name, 0], whole.get((name, 1))) for name, kind in whole if kind == 0}


def repeats_within(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Marks the words that stand in a k-word window found twice or more in their text."""
    marked = np.zeros(len(h), bool)
    g = grams(h, k)
    if not len(g):
        return marked
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(owner[: len(g)] == owner[k - 1 :])
    key = mix(g[at] + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    twice = np.unique(np.concatenate((at[order[same]], at[order[same + 1]])))
    for j in range(k):
        marked[twice + j] = True
    return marked


def repeated_lines(buf: np.ndarray, off: np.ndarray, words: Spans) -> np.ndarray:
    """For each text, the lines with a word that equal an earlier line."""
    lines = Spans(buf, off, LINES)
    has_word = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    owner = lines.owner[has_word]
    h = span_hashes(buf, lines.starts[has_word], lines.ends[has_word])
    _, firsts = np.unique(mix(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(owner, minlength=len(off) - 1) - np.bincount(owner[firsts], minlength=len(off) - 1)


def judge(docs: DataFrame, refs: dict | None = None, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Per document the counts, both distances (null where guarded), base_failed and kept."""
    refs = references(docs, text=text, lang=lang) if refs is None else refs
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), docs[lang].cast("string").alias("lang"))
    known = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buf, off = texts_of(batch.column("text"))
            words = Spans(buf, off, SPACED)
            n_words = words.counts
            later = np.concatenate(([0], np.cumsum((buf & 0xC0) == 0x80)))
            word_chars = per_text(words.ends - words.starts, words.first) - (later[off[1:]] - later[off[:-1]])
            symbols = np.concatenate(([0], np.cumsum(_SYMBOL[buf], dtype=np.int64)))
            h = span_hashes(buf, words.starts, words.ends)
            n_repeat = per_text(repeats_within(h, words.first, 3), words.first)
            base_failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
            langs = [_known(x) for x in batch.column("lang").to_pylist()]
            by_class, by_word = histograms(buf, off, langs)
            far: list[list[float | None]] = [[], []]
            for k, name in enumerate(langs):
                ref = known.value.get(name)
                for out, counts, least, kind in ((far[0], by_class[k], min_chars, 0), (far[1], by_word[k], min_words, 1)):
                    usable = ref is not None and ref[kind] is not None and counts is not None and ref[kind].sum() > 0 and counts.sum() >= max(1, least)
                    out.append(distance(counts.astype(float), ref[kind]) if usable else None)
            verdict = np.array([(a is None or a <= max_class_distance) and (b is None or b <= max_word_distance + WORD_NOISE / np.sqrt(w.sum())) for a, b, w in zip(*far, by_word, strict=True)], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(signed(x) for x in (n_words, word_chars, symbols[off[1:]] - symbols[off[:-1]], repeated_lines(buf, off, words), n_repeat)), pa.array(base_failed), pa.array(~base_failed & verdict), *(pa.array(x, pa.float64()) for x in far)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"],
            )

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double")
