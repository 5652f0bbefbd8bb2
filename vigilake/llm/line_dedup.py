"""Line dedup over overlapping windows of three lines.

A document's lines that hold more than white space are numbered. Each window of
``size`` consecutive ones is hashed; of windows that stand more than once in
the corpus all but the first, by (doc_id, line), are repeats. The lines covered
by a document's repeats, overlapping ones merged, are removed.

Defined cases: a null text stays null, an empty one empty; a document of fewer
lines than a window has none and is kept whole; a repeated row (same doc_id and
text) is one occurrence, a repeated doc_id with another text is a document of
its own; a row without doc_id is kept whole; lines are compared without white
space at their ends; blank lines stay unless the text becomes empty of others,
then it is "". An empty table gives an empty one. Other columns are kept, but
for n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Units, later_occurrences, rewritten
from .textops import LINES, SPACED, Spans, grams, span_hashes, texts_of

WINDOW = 3


def _windows(size: int):
    def units(column: pa.Array) -> Units:
        buf, off = texts_of(column)
        words, lines = Spans(buf, off, SPACED), Spans(buf, off, LINES)
        a, b = np.searchsorted(words.starts, lines.starts), np.searchsorted(words.starts, lines.ends)
        full = b > a
        starts, ends, owner = words.starts[a[full]], words.ends[b[full] - 1], lines.owner[full]
        first = np.searchsorted(owner, np.arange(len(off)))
        at = np.flatnonzero(owner[: max(0, len(owner) - size + 1)] == owner[size - 1 :])
        h1, h2 = (grams(span_hashes(buf, starts, ends, which), size) for which in (0, 1))
        return owner[at], at - first[owner[at]], h1[at], h2[at]

    return units


def _without(size: int):
    def rewrite(text: str | None, repeats: list[int] | None) -> tuple[str | None, int, int]:
        if text is None:
            return None, 0, 0
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        if not repeats:
            return text, len(full), 0
        covered = {full[p + j] for p in repeats for j in range(size)}
        left = "\n".join(x for i, x in enumerate(lines) if i not in covered)
        return (left if len(covered) < len(full) else ""), len(full), len(covered)

    return rewrite


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """docs with text freed of repeats, and the columns n_lines and n_removed."""
    found = later_occurrences(docs, _windows(size), doc_id=doc_id, text=text)
    return rewritten(docs, found, [("n_lines", pa.int64(), "long"), ("n_removed", pa.int64(), "long")], _without(size), doc_id=doc_id, text=text)
