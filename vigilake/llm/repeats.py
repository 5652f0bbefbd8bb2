"""Finding the later occurrences of repeated units (line windows, chunks) over all documents.

A unit is (document, position, 128-bit digest); a document is a doc_id and a
hash of its text, so rows that repeat an id with another text are told apart. Each task first settles what
repeats among its own units, in blocks of bounded size: all but a block's first
occurrence are repeats whatever else exists. Only the firsts meet by digest in
one exchange, so a digest that stands in a third of all rows sends one row per
block. The repeats travel along under a salt of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import signed, slices

BLOCK_UNITS = 400_000

Units = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
"""Index of the text in the batch, position, and two hashes of each unit."""


def later_occurrences(docs: DataFrame, units: Callable[[pa.Array], Units], *, doc_id: str, text: str, block_units: int = BLOCK_UNITS) -> DataFrame:
    """(doc_id, row, repeats): sorted positions of the units of which an earlier one exists, by (doc_id, hash of the text, position); documents without any are left out.

    Rows that repeat a doc_id and text count as one document.
    """
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("row"), docs[text].alias("text")).where("doc_id is not null and text is not null")

    def settle(parts: list[Units]) -> pa.RecordBatch:
        doc, row, pos, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, row, doc, h2, h1))
        doc, row, pos, h1, h2 = doc[order], row[order], pos[order], h1[order], h2[order]
        new = np.ones(len(doc), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
        repeat = (doc != doc[head]) | (row != row[head]) | (pos != pos[head])
        salt = np.where(repeat, 1 + np.arange(len(doc)) % 997, 0)
        return pa.RecordBatch.from_arrays([signed(h1), signed(h2), pa.array(salt.astype(np.int32)), signed(doc), signed(row), pa.array(pos.astype(np.int32))], names=["h1", "h2", "salt", "doc_id", "row", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in slices(batches):
            owner, pos, h1, h2 = units(batch.column("text"))
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
            parts.append((ids[owner], rows[owner], pos, h1, h2))
            held += len(pos)
            if held >= block_units:
                yield settle(parts)
                parts, held = [], 0
        if held:
            yield settle(parts)

    rows = source.mapInArrow(run, "h1 long, h2 long, salt int, doc_id long, row long, pos int")
    ranked = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "row", "pos")))
    return ranked.where("salt > 0 or rank > 1").groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("repeats"))


def unused(docs: DataFrame, name: str) -> str:
    """name, lengthened until no column of docs is called so."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def rewritten(docs: DataFrame, repeats: DataFrame, extra: list[tuple[str, pa.DataType, str]], rewrite: Callable, *, doc_id: str, text: str) -> DataFrame:
    """docs with text rewritten by rewrite(text, sorted positions of its repeats or None) -> (text, *extra values); columns of docs that are called like an extra one are replaced."""
    docs = docs.drop(*(x for x, _, _ in extra))
    schema = docs.schema
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    id_, row, name = (unused(docs, x) for x in ("found_id", "found_row", "found_repeats"))
    found = repeats.toDF(id_, row, name)
    joined = docs.join(found, (docs[doc_id].cast("long") == found[id_]) & (F.xxhash64(docs[text]) == found[row]), "left").drop(id_, row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            made = [rewrite(t, r) for t, r in zip(batch.column(text).to_pylist(), batch.column(name).to_pylist(), strict=True)]
            columns = [pa.array([m[0] for m in made], pa.string()) if f.name == text else batch.column(f.name) for f in schema]
            columns += [pa.array([m[k] for m in made], kind) for k, (_, kind, _) in enumerate(extra, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[*schema.names, *(x for x, _, _ in extra)])

    return joined.mapInArrow(run, spec + "".join(f", {x} {sql}" for x, _, sql in extra))
