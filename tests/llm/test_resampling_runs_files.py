"""Importance resampling, periodic runs and token files against brute force and the tokenizers library."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigilake.llm import importance, periodic_runs, queries, token_files

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \n\t", "one", "One two THREE", "é" * 90 + " x\0y " + "Z" * 70 + " z", "the same words " * 30, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "x" * 200]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(6, "the same words " * 30, "en"), (6, "other words of one id " * 9, "en"), (None, "no id at all " * 9, "en"), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def clashing(df):
    names = ("kind", "row", "rank", "place", "part", "before", "apart", "at", "ids", "width", "score", "weight", "n_words", "buckets", "d", "i", "word", "start", "period", "n")
    return df.withColumns({c: F.lit(c) for c in names})


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def buckets_by_hand(text, longest, buckets):
    w = ALNUM.findall((text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def resampled_by_hand(docs, target, *, longest=2, buckets=10_000, percent=25, min_words=20, seed=7):
    found = [buckets_by_hand(t, longest, buckets) for _, t in docs]
    t, s = Counter(x for y in target for x in buckets_by_hand(y, longest, buckets)[1]), Counter(x for _, y in found for x in y)
    every_t, every_s = sum(t.values()) + buckets, sum(s.values()) + buckets
    out = []
    for (i, _), (n, y) in zip(docs, found, strict=True):
        weight = sum(math.floor(1000 * math.log((t[x] + 1) * every_s / ((s[x] + 1) * every_t))) for x in y) // len(y) if y else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(y), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0]))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[5] = k + 1
    return Counter(map(tuple, out))


COLUMNS = ("doc_id", "n_words", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("options", [{}, {"longest": 1, "percent": 60, "min_words": 1}, {"longest": 4, "buckets": 50, "percent": 100, "seed": 9}])
def test_resampling(spark, small, odd, options):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    target = spark.read.parquet(f"{small}/benchmark.parquet")
    got = importance.resample(docs, target, **options)
    want = resampled_by_hand([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], **options)
    # rows of one id and score may stand in either order
    assert as_rows(got.select(*COLUMNS)) == want


def test_resampling_of_odd_tables(spark, small, odd):
    target = spark.read.parquet(f"{small}/benchmark.parquet")
    assert as_rows(importance.resample(clashing(odd), clashing(target)).select(*COLUMNS)) == as_rows(importance.resample(odd, target).select(*COLUMNS))
    assert importance.resample(odd.limit(0), target).count() == 0
    assert as_rows(importance.resample(odd, target.limit(0)).select(*COLUMNS)) == resampled_by_hand([(r.doc_id, r.text) for r in odd.collect()], [])
    tied = spark.range(40).select(F.lit(3).cast("long").alias("doc_id"), F.lit("word " * 25).alias("text"))  # every score is one
    assert sorted(r["rank"] for r in importance.resample(tied, target, percent=50).collect() if r["rank"]) == list(range(1, 21))
    assert importance.resample(spark.createDataFrame([(1, "Word " * 600_000)], "doc_id long, text string"), target).first().n_features == 1_199_999


def test_crc_of_joined_words():
    rng = random.Random(2)
    pairs = [(rng.randbytes(rng.randrange(40)), rng.randbytes(n)) for n in [*range(200), 1000, 70_000]]
    left, right = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    assert importance.combined(left, right, np.array([len(p[1]) for p in pairs])).tolist() == [zlib.crc32(a + b" " + b) for a, b in pairs]


def test_ranks_by_ranges(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 13).alias("score"))
    got = [(r.score, r.id, r["rank"]) for r in importance.ranked(rows, F.desc("score"), F.asc("id")).collect()]
    assert sorted(got, key=lambda x: (-x[0], x[1])) == sorted(got, key=lambda x: x[2]) and {x[2] for x in got} == set(range(1, 5001))


def runs_by_hand(w):
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        t = 0
        while t < n - q:
            s = t
            while t < n - q and w[t] == w[t + q]:
                t += 1
            if t + q - s >= max(24, 3 * q):
                out[s, t + q] = min(q, out.get((s, t + q), q))
            t += t == s
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_periodic_runs_of_nested_repetitions():
    rng = random.Random(5)

    def piece(depth=0):
        k = rng.randrange(6)
        if k < 2 or depth > 3:
            return [rng.randrange((3, 50)[k % 2]) for _ in range(rng.randrange(1, 60))]
        if k == 2:
            return [rng.randrange(2)] * rng.randrange(1, 120)
        p = piece(depth + 1)
        if k == 3:
            r = p * rng.randrange(2, 8)
            return r[rng.randrange(len(p)) : len(r) - rng.randrange(len(p))]
        return p + piece(depth + 1)

    seen = 0
    for _ in range(600):
        w = [x for _ in range(rng.randrange(1, 6)) for x in piece()][:1200]
        want = runs_by_hand(w)
        assert periodic_runs.runs_of(np.array(w, np.int64)) == want
        seen += len(want)
    assert seen > 1000


@pytest.mark.parametrize(
    ("words", "want"),
    [
        ([1] * 200_000, [(0, 200_000, 1)]),
        (([1] * 30_000 + [2]) * 3, [(0, 30_000, 1), (0, 90_003, 30_001), (30_001, 30_000, 1), (60_002, 30_000, 1)]),
        ([bin(i).count("1") % 2 for i in range(100_000)], []),
        (list(range(50_000)) * 2, []),
        ([7, *range(40_000)] + [*range(40_000)] * 2, [(1, 120_000, 40_000)]),
    ],
    ids=["one word", "runs in runs", "no cube", "two only", "long period"],
)
def test_long_repetitive_texts_take_seconds(words, want):
    began = time.time()
    assert periodic_runs.runs_of(np.array(words, np.int64)) == want
    assert time.time() - began < 30


def test_best_run_breaks_ties():
    assert periodic_runs.best_run([(0, 30, 10), (5, 60, 20), (40, 24, 1), (90, 48, 2), (90, 24, 1)]) == (40, 24, 1)
    assert periodic_runs.best_run([]) is None


def test_periodic_runs_query(spark, small, odd):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, small).collect()}
    planted = seen = 0
    for i, text in texts:
        w = SPACED.findall(text or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, planted = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)], planted + 1
        if n > 2500:
            continue
        runs = runs_by_hand(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        dropped = {j for s, size, q in runs for j in range(s + q, s + size)}
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[i] == (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{size},{q}\n" for s, size, q in runs)), digest(" ".join(x for j, x in enumerate(w) if j not in dropped)))
        seen += len(runs)
    assert planted > 5 and seen > 10 and len(got) == len(texts)


def test_periodic_runs_of_odd_rows(spark, odd):
    got = periodic_runs.periodic_runs(odd)
    assert got.count() == odd.count() and bare(got) == bare(periodic_runs.periodic_runs(clashing(odd)))
    rows = [r for r in got.collect() if r.n_runs]
    assert {(r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in rows} >= {(6, ((0, 90, 3),), "the same words"), (6, ((0, 45, 5),), "other words of one id"), (None, ((0, 36, 4),), "no id at all")}
    assert {r.collapsed for r in got.where("doc_id < 3").collect()} == {""}
    assert periodic_runs.periodic_runs(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(odd, min_words=10)


def bare(df):
    return Counter(map(repr, df.collect()))


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(queries.tokenizer_path())
    out.no_padding()
    out.no_truncation()
    return out


def test_packed_values_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1001):
        x = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_files.pack(x)
        assert len(control) == -(-n // 4) and token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n).tolist() == x.tolist()
    assert len(token_files.pack(np.arange(256))[1]) == 256


def test_pieces_encode_as_whole_texts(library, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 500)
    encoder, rng = token_files.Encoder(queries.tokenizer_path()), random.Random(4)
    letters = [chr(c) for c in [*range(1, 128), 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0x301, 0x308, 0x3A3, 0x130, 0xDF, 0xE9, 0x1100, 0x1161, 0xAC00, 0x4E00, 0x1F600, 0xFEFF, 0x200B, 0x345]] + ["<|endoftext|>", "<|startoftext|>", "'s", " ", " ", "\n"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)] + [None, ""]
    for k in range(0, len(texts), 400):
        part = texts[k : k + 400]
        ids, bounds = encoder.ids(pa.array(part, pa.string()), 1)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in part]


@pytest.mark.parametrize("sizes", [{}, {"block_ids": 500, "file_ids": 3000}])
def test_token_files(spark, small, odd, library, tmp_path, sizes):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    path = str(tmp_path / "tokens")
    token_files.write(docs, path, queries.tokenizer_path(), **sizes)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    ends = np.cumsum([r.n_tokens for r in got]).tolist()
    assert [r.start for r in got] == [0, *ends[:-1]] and all(len(r.ids) == r.n_tokens for r in got)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r.doc_id, (*library.encode(r.text or "", add_special_tokens=False).ids, 1)) for r in docs.collect())
    order = np.fromfile(f"{path}/ids", "<u4").tolist()
    counts = Counter(x for r in got for x in r.ids)
    assert order == sorted(counts, key=lambda i: (-counts[i], i))


def test_token_files_of_odd_tables(spark, odd, tmp_path):
    for name, df in (("plain", odd), ("clashing", clashing(odd)), ("none", odd.limit(0))):
        token_files.write(df, str(tmp_path / name), queries.tokenizer_path())
    read = lambda name: bare(token_files.read(spark, str(tmp_path / name)))
    assert read("plain") == read("clashing") and not read("none")
    long = spark.createDataFrame([(1, "x" * 300_000 + " y" * 300_000)], "doc_id long, text string")
    assert token_files.round_trip(long, queries.tokenizer_path()).first().n_tokens > 300_000


def test_token_files_query(spark, small, library):
    start = 0
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_token_files(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert got.pop(r.doc_id) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got
