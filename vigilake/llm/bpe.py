"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that ends its encoding.
An automaton of all tokens finds those that are suffixes of the prefix; a
candidate is the one if it may follow the token stored for the prefix before
it. Whether two tokens may stand side by side is tested on the merge tree: the
pair is refused if some merge across their border would have come earlier than
the merges that built them. Following the stored tokens back from the end of
the word gives the ids that repeated merging would give, in linear time.

Which characters are letters, digits and white space, and what they become in
normal form and lower case, depends on the Unicode version of a library. Texts
of FAMILIAR characters, on which all versions agree, are split by expressions
of this module's own; for others the tokenizer's own normalizer and character
classes are asked. Encoding is the same for both.

Defined cases: a null or empty text has no tokens and decodes to ""; repeated
rows are encoded alike; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, pre_tokenizers

from .textops import slices

_END = "\u0000"
#: Texts of other characters are normalized and split with the tokenizer's own tables.
_UNFAMILIAR = re.compile("[^\0-\u024f\u0300-\u0314\u0391-\u03a1\u03a3-\u03c9\u0400-\u045f\u2010-\u2027\u2030-\u203a\u20ac\u3000-\u3003\u3041-\u3094\u30a1-\u30f4\u4e00-\u9fa5\uac00-\ud7a3]")
_WHITE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
CACHE_WORDS = 250_000


def _byte_letters() -> list[str]:
    """The visible letter that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Bpe:
    """A tokenizer of the tokenizers library's JSON form: BPE with word ends over byte letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.text_of = {str(i): t for t, i in [*ids.items(), *special.items()]}
        pattern = next(p for p in made["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.pattern, self.normalizer, self.other_words = pattern, Tokenizer.from_file(path).normalizer, None
        self.letters = dict(enumerate(_byte_letters()))
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            t = ids[a + b]
            self.rank[t], self.parts[t] = n, (ids[a], ids[b])
            self.joined[ids[a], ids[b]] = t
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            if i not in self.parts or self.apart(*self.parts[i], self.rank[i]):
                key = t.removesuffix(self.suffix) + _END if self.suffix and t.endswith(self.suffix) and t != self.suffix else t
                self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()
        self.may_follow: dict[tuple[int, int], bool] = {}
        self.fresh: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def apart(self, a: int, b: int, below: float = float("inf")) -> bool:
        """No merge of rank under ``below`` joins a and b across their border before they are built."""
        rank, parts, joined = self.rank, self.parts, self.joined
        limit = below
        while True:
            t = joined.get((a, b))
            if t is not None and rank[t] < limit:
                return False
            # take back the later of the two merges; of equal ones, the right one was made later
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = min(limit, ra), parts[a][1]
            else:
                limit, b = min(limit, rb + 1), parts[b][0]

    def word(self, text: str) -> str:
        """Ids of one pre-token, in decimal, joined by spaces."""
        s = "".join(map(self.letters.__getitem__, text.encode())) + (_END if self.suffix else "")
        last: list[tuple[int, int] | None] = [None] * (len(s) + 1)
        follow = self.may_follow
        for end, (t, size) in self.automaton.iter(s):
            end += 1
            if last[end] is not None:
                continue
            start = end - size
            if start:
                before = last[start]
                if before is None:
                    continue
                pair = (before[0], t)
                ok = follow.get(pair)
                if ok is None:
                    if len(follow) > 1_000_000:
                        follow.clear()
                    ok = follow[pair] = self.apart(*pair)
                if not ok:
                    continue
            last[end] = (t, start)
        out, at = [], len(s)
        while at:
            t, at = last[at]
            out.append(str(t))
        return " ".join(reversed(out))

    def cached(self, text: str) -> str:
        found = self.fresh.get(text)
        if found is None:
            found = self.old.pop(text, None) or self.word(text)
            if len(self.fresh) >= CACHE_WORDS:
                self.old, self.fresh = self.fresh, {}
            if len(text) <= 64:
                self.fresh[text] = found
        return found

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return _WHITE.sub(" ", text).lower()

    def unfamiliar(self, text: str) -> list[str]:
        """Pre-tokens by the tokenizer's own tables."""
        if self.other_words is None:
            # the pattern with its classes written out as what the library holds them to be
            every = "".join(chr(c) for c in range(0x40000) if not 0xD800 <= c < 0xE000)  # none of these classes has any beyond
            spelled = self.pattern
            for name in (r"\p{L}", r"\p{N}", r"\s"):
                kept = pre_tokenizers.Split(Regex(f"{name}+"), "removed", invert=True).pre_tokenize_str(every)
                spelled = spelled.replace(name, "".join(f"\\U{ord(x[0]):08x}-\\U{ord(x[-1]):08x}" for x, _ in kept))
            spelled = re.sub(r"(?<=[|])(\\U[^|]*)(?=[|])", r"[\1]", spelled)  # a class that stood alone
            self.other_words = regex.compile(spelled, regex.V0)
        return self.other_words.findall(self.normalizer.normalize_str(text))

    def plain(self, text: str) -> list[str]:
        words = self.words.findall(self.normal(text)) if text.isascii() or not _UNFAMILIAR.search(text) else self.unfamiliar(text)
        get = self.fresh.get
        return [get(w) or self.cached(w) for w in words]

    def encode(self, text: str | None) -> str:
        """Ids of the whole text, in decimal, joined by spaces."""
        if not text:
            return ""
        if self.split_special is None or "<|" not in text:
            return " ".join(self.plain(text))
        out = []
        for part in self.split_special.split(text):
            out += [str(self.special[part])] if part in self.special else self.plain(part)
        return " ".join(out)

    def decode(self, ids: str) -> str:
        return " ".join(map(self.text_of.__getitem__, ids.split(" "))) if ids else ""


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One tokenizer per path and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def tokenize(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id with the wanted outputs: n_tokens, ids (array), decoded, ids_sha256, decoded_sha256.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the
    decoded text in UTF-8; the decoded text is made from the ids alone.
    """
    types = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        needs_text = any(x.startswith("decoded") for x in outputs)
        for batch in slices(batches):
            columns: dict[str, list] = {x: [] for x in outputs}
            for value in batch.column("text"):
                ids = bpe.encode(value.as_py())
                decoded = bpe.decode(ids) if needs_text else ""
                for x, column in columns.items():
                    if x == "n_tokens":
                        column.append(ids.count(" ") + 1 if ids else 0)
                    elif x == "ids":
                        column.append([int(i) for i in ids.split(" ")] if ids else [])
                    elif x == "decoded":
                        column.append(decoded)
                    else:
                        column.append(hashlib.sha256((ids if x == "ids_sha256" else decoded).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(columns[x], kinds[x]) for x in outputs)], names=["doc_id", *outputs])

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} {types[x]}" for x in outputs))
