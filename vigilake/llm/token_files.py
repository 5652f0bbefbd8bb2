"""Token ids in binary files, written and read as a Spark data source.

Ids are ranked by their frequency over all documents, so the most frequent 256
take one byte. Four ids share a control byte of two bits each, which give the
number of bytes of each id, and data bytes stand apart from control bytes; a
reader looks the four lengths of a control byte up in a table and gathers all
values of a block at once.

A folder holds ``ids`` (the id of each rank, 32-bit little-endian), files of
blocks under ``parts`` and ``manifest.json``, which lists the files in the order
of doc_id with the documents and ids before each. A file without an entry there
was left by a task that failed. A block has whole documents, of about
``BLOCK_IDS`` ids together: a head of six 64-bit numbers (documents, ids, bytes
of control, of data, and two spare ones), then doc_ids, a byte for each that is
1 if there is none, lengths, control bytes and data.

Texts are cut at ASCII white space, across which the tokenizer joins nothing.
Where its pattern takes runs of letters, single digits and runs of marks apart,
they are also cut between ASCII letters, digits and marks, but not at what may
begin a contraction or a special token. The tokenizers library encodes each
distinct piece once per slice, or it is found in a worker's bounded cache.

Defined cases: a null or empty text is the end id alone; repeated rows are each
written; rows of one doc_id come in the order of a hash of their text, rows
without one before all; an empty table gives a folder without files; other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .runtime import discard, new_path, shuffle_partitions, written
from .textops import SPACED, Spans, slices, texts_of, word_array

MAGIC = b"VGTOKEN1"
BLOCK_IDS = 1 << 18
FILE_IDS = 1 << 26
_SLICE = 2 << 20
CACHE_WORDS = 1_000_000

#: The lengths of the four ids of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    control = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values of pack()."""
    size = LENGTHS[control].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    every = np.ndarray(len(data), "<u4", padded, strides=(1,))
    return every[at] & _MASK[size]


#: White space 0, letters 1, digits 2, marks 3; 4 for what is not cut at: apostrophes, the marks of special tokens, and characters beyond ASCII.
_KIND = np.full(256, 4, np.uint8)
_KIND[:128] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in "'<|>"]] = 4
_KIND[[*range(9), *range(14, 32), 127]] = 4
#: A pattern that ends so takes letters, digits and marks apart.
_APART = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def pieces_of(buf: np.ndarray, off: np.ndarray, fine: bool) -> Spans:
    """Spans between white space, or finer ones."""
    spans = Spans(buf, off, SPACED)
    if fine and len(buf):
        kind = _KIND[buf]
        a, b = kind[:-1], kind[1:]
        cut = (((a != b) & (a < 4) & (b < 4)) | ((a == 2) & (b == 2))) & (a > 0) & (b > 0)
        cut[off[(off > 0) & (off < len(buf))] - 1] = False  # texts are apart already
        cuts = np.flatnonzero(cut) + 1
        spans.starts, spans.ends = np.sort(np.concatenate((spans.starts, cuts))), np.sort(np.concatenate((spans.ends, cuts)))
        spans.first = np.searchsorted(spans.starts, off)
    return spans


class Encoder:
    """The tokenizers library over pieces of texts, each distinct one encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = lambda of, inner: (of or {}).get(inner, [of or {}])
        split, normal = steps(made["pre_tokenizer"], "pretokenizers"), steps(made["normalizer"], "normalizers")
        self.fine = any(x.get("pattern", {}).get("Regex", "").endswith(_APART) for x in split)
        # then ASCII letters are one word, changed by nothing but lower case, and the library's model can be asked at once
        self.plain = self.fine and [x.get("type") for x in normal] == ["NFC", "Replace", "Lowercase"] and [x.get("add_prefix_space", False) for x in split] == [False, False]
        self.library.no_padding()
        self.library.no_truncation()
        self.known: dict[str, bytes] = {}

    def ids(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with end_id behind it, and the n + 1 bounds of the texts."""
        buf, off = texts_of(column)
        spans = pieces_of(buf, off, self.fine)
        coded = word_array(buf, spans, SPACED).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, pieces
        if self.plain:
            tokenize = self.library.model.tokenize
            words, others = [p for p in new if p.isascii() and p.isalpha()], [p for p in new if not (p.isascii() and p.isalpha())]
            self.known.update((p, array("I", [t.id for t in tokenize(p.lower())]).tobytes()) for p in words)
        else:
            others = new
        made = self.library.encode_batch_fast(others, add_special_tokens=False)
        self.known.update((p, array("I", e.ids).tobytes()) for p, e in zip(others, made, strict=True))
        found = [self.known[p] for p in pieces]
        for p in new:
            if len(p) > 64:
                del self.known[p]
        size = np.array([len(x) for x in found], np.int64) >> 2
        pool, start = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        codes = coded.indices.to_numpy(zero_copy_only=False)
        each = size[codes]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(each)))
        bounds = ends[spans.first] + np.arange(len(spans.first))
        out = np.full(int(bounds[-1]), end_id, np.uint32)
        place = np.arange(int(ends[-1]))
        out[place + np.repeat(spans.owner, each)] = pool[place + np.repeat(start[codes] - ends[:-1], each)]
        return out, bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder per path and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def sorted_ids(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """Written rows of two kinds: ``document`` (at, doc_id, ids) in the order of doc_id, of which ``at`` tells the place, and each task's ``counts`` of all ids. ids are little-endian numbers of 2 or 4 bytes."""
    parts = shuffle_partitions(docs.sparkSession)
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).withColumns({"row": F.xxhash64("text"), "apart": F.monotonically_increasing_id()})
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "row", "apart")]
    placed = source.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("at"), "doc_id", "text")
    names = ["kind", "at", "doc_id", "width", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        size = max(encoder.library.get_vocab_size(), end_id + 1)
        kind, counts = np.dtype("<u2" if size <= 1 << 16 else "<u4"), np.zeros(size, np.int64)
        for batch in slices(batches, most=_SLICE):
            ids, bounds = encoder.ids(batch.column("text"), end_id)
            counts += np.bincount(ids, minlength=size)
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(bounds * kind.itemsize), pa.py_buffer(ids.astype(kind))])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(["document"] * n), batch.column("at"), batch.column("doc_id"), pa.array(np.full(n, kind.itemsize, np.int32)), blob.cast(pa.binary())], names=names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in (("counts", pa.string()), (None, pa.int64()), (None, pa.int64()), (8, pa.int32()), (counts.tobytes(), pa.binary()))], names=names)

    return written(placed.mapInArrow(run, "kind string, at long, doc_id long, width int, ids binary"), "kind")


def frequency_order(counted: DataFrame) -> np.ndarray:
    """Ids by falling frequency, equal ones by id, from the rows of sorted_ids(); as many numbers as the vocabulary has."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column("ids"):
                x = np.frombuffer(blob.as_buffer(), np.int64)
                total = x.copy() if total is None else total + x
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = counted.where("kind = 'counts'").select("ids").mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([r.id for r in sorted(rows.collect(), key=lambda r: (-r.n, r.id))], np.int64)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":", "://", 1))


def _put(path: str, content: bytes) -> None:
    store, at = _opened(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as out:
        out.write(content)


def _get(path: str) -> bytes:
    store, at = _opened(path)
    with store.open_input_file(at) as f:
        return f.read()


class _Written(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class _Writer(DataSourceArrowWriter):
    """Writes rows (at, doc_id, width, ids); each unbroken run of ``at`` becomes files of its own."""

    def __init__(self, path: str, block_ids: int, file_ids: int):
        self.path, self.block_ids, self.file_ids = path, block_ids, file_ids

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        order = np.frombuffer(_get(f"{self.path}/ids"), "<u4")
        rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        store, at = _opened(f"{self.path}/parts")
        store.create_dir(at, recursive=True)
        files: list[dict] = []
        out, docs, parts, held = None, [], [], 0

        def block() -> None:
            nonlocal docs, parts, held
            if docs:
                control, data = pack(rank[np.concatenate(parts)])
                ids = np.array([0 if d is None else d for d in docs], "<i8")
                head = np.array([len(docs), held, len(control), len(data), 0, 0], "<i8")
                for x in (head, ids, np.array([d is None for d in docs], np.uint8), np.array([len(p) for p in parts], "<i8"), control, data):
                    out.write(x if isinstance(x, bytes) else x.tobytes())
                files[-1]["docs"] += len(docs)
                files[-1]["ids"] += held
                docs, parts, held = [], [], 0

        last = None
        try:
            for batch in iterator:
                for place, doc, width, ids in zip(batch.column("at").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("width").to_pylist(), batch.column("ids"), strict=True):
                    if out is None or place != last + 1 or files[-1]["ids"] + held >= self.file_ids:
                        if out is not None:
                            block()
                            out.close()
                        files.append({"name": f"{uuid.uuid4().hex}.tok", "at": place, "docs": 0, "ids": 0})
                        out = store.open_output_stream(f"{at}/{files[-1]['name']}")
                        out.write(MAGIC)
                    last = place
                    docs.append(doc)
                    parts.append(np.frombuffer(ids.as_buffer(), f"<u{width}"))
                    held += len(parts[-1])
                    if held >= self.block_ids:
                        block()
            block()
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["at"])
        docs = ids = 0
        for f in files:
            f["first_doc"], f["first_id"] = docs, ids
            docs, ids = docs + f["docs"], ids + f["ids"]
        _put(f"{self.path}/manifest.json", json.dumps({"docs": docs, "ids": ids, "files": files}).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        store, at = _opened(f"{self.path}/parts")
        for f in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{at}/{f['name']}")


class _File(InputPartition):
    def __init__(self, name: str, first_id: int):
        self.name, self.first_id = name, first_id


class _Reader(DataSourceReader):
    def __init__(self, path: str, as_array: bool):
        self.path, self.as_array = path, as_array

    def partitions(self) -> list[InputPartition]:
        return [_File(f["name"], f["first_id"]) for f in json.loads(_get(f"{self.path}/manifest.json"))["files"]] or [_File("", 0)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        order = np.frombuffer(_get(f"{self.path}/ids"), "<u4")
        store, at = _opened(f"{self.path}/parts/{partition.name}")
        start = partition.first_id
        with store.open_input_stream(at) as f:
            if f.read(len(MAGIC)) != MAGIC:
                raise ValueError(f"{at} is no file of token ids")
            while head := f.read(48):
                n_docs, n_ids, n_control, n_data, *_ = np.frombuffer(head, "<i8").tolist()
                docs, none = np.frombuffer(f.read(8 * n_docs), "<i8"), np.frombuffer(f.read(n_docs), np.uint8) > 0
                size = np.frombuffer(f.read(8 * n_docs), "<i8")
                control, data = np.frombuffer(f.read(n_control), np.uint8), np.frombuffer(f.read(n_data), np.uint8)
                ids = order[unpack(control, data, n_ids)]
                ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
                if self.as_array:
                    column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                else:
                    column = pa.BinaryArray.from_buffers(pa.binary(), n_docs, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=none), pa.array(start + ends[:-1]), pa.array(size), column], names=["doc_id", "start", "n_tokens", "ids"])
                start += n_ids


class TokenFiles(DataSource):
    """``token_ids``: option ids is array (the default) or binary, 32-bit little-endian numbers."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids " + ("binary" if self.options.get("ids") == "binary" else "array<int>")

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("ids") != "binary")

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("block_ids", BLOCK_IDS)), int(self.options.get("file_ids", FILE_IDS)))


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> None:
    """Encodes docs into a folder that does not exist yet."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    rows = sorted_ids(docs, tokenizer, end_id, doc_id, text)
    _put(f"{path}/ids", frequency_order(rows).astype("<u4").tobytes())
    found = rows.where("kind = 'document'").select("at", "doc_id", "width", "ids")
    found.write.format("token_ids").option("block_ids", block_ids).option("file_ids", file_ids).mode("append").save(path)
    discard(rows)


def read(spark: SparkSession, path: str, *, ids: str = "array") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document; start counts the ids of all documents before it."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_ids").option("ids", ids).load(path)


def round_trip(docs: DataFrame, tokenizer: str, *, end_id: int = 1) -> DataFrame:
    """What read() gives of docs written to a new folder among the intermediate tables, with ids in binary."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id=end_id)
    return read(docs.sparkSession, path, ids="binary")
