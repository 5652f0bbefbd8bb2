"""Every operator against brute force, on the small tables and on hand-made odd rows."""

import hashlib
import itertools
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare
from vigilake.llm import bpe, decontaminate, html_extract, licenses, line_dedup, ngram_join, quality_classifier, quality_rules, queries, substring_dedup, url_filter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gämma", "x", "the", "of", "Σ", "日本"]
    long = " ".join(rng.choice(words) for _ in range(3000))
    texts = [None, "", " \n\t", "one", "one two three", "One  Two\nthree", long, long + " end", "a b c d e f g h i j k l\n" * 3, "same line\nsame line\n\nother", "under the MIT license cc-by-nc 4.0"]
    rows = [(i, t, ("en", None, "xx")[i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(50, long, "en", "s", 1), (50, long, "en", "s", 1), (51, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small, odd):
    return spark.read.parquet(f"{small}/documents.parquet").select(*[f.split()[0] for f in SCHEMA.split(", ")]).withColumn("doc_id", F.col("doc_id") + 1000).unionByName(odd)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_id_of(df, key):
    return {r[key]: r for r in df.collect()}


def by_id(df):
    return by_id_of(df, "doc_id")


def components_by_hand(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = SPACED.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(spark):
    """A group whose members differ in growing parts, many of them, and passages that many documents share."""
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(120)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i // 12):
            w[rng.randrange(len(w))] = f"edit{i}"
        rows.append(" ".join(w))
    for _ in range(40):
        rows.append(" ".join([rng.choice(vocab) for _ in range(100)] + passage))
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


@pytest.mark.parametrize(("k", "percent", "often", "light"), [(4, 85, 8, 24), (5, 80, 2, 3)])
def test_ngram_join(spark, docs, monkeypatch, k, percent, often, light):
    monkeypatch.setattr(ngram_join, "MIN_FREQUENT", often)
    monkeypatch.setattr(ngram_join, "LIGHT", light)
    monkeypatch.setattr(ngram_join, "CLASS_STEP", 3)
    for df in (docs, near_copies(spark)):
        got = {i: (r.n_shingles, r.component_id) for i, r in by_id(ngram_join.ngram_jaccard_join(df, words=k, percent=percent)).items()}
        assert got == components_by_hand(texts(df), k, percent)
    assert ngram_join.ngram_jaccard_join(docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    """Whatever the classes of the tokens."""
    rng = np.random.default_rng(percent)
    linked = 0
    for n in [*range(2, 30), 60, 150] * 12:
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = x[np.sort(rng.permutation(len(x))[: max(1, len(x) - rng.integers(0, 1 + len(x) * (100 - percent) // 100))])]
        y = np.unique(np.concatenate((y, rng.integers(0, 1 << 63, rng.integers(0, 1 + n * (100 - percent) // 200)).astype(np.uint64))))
        common = len(np.intersect1d(x, y))
        if 100 * common < percent * (len(x) + len(y) - common) or min(len(x), len(y)) < 2 or len(x) == len(y) == common:
            continue
        linked += 1
        salt, mixed = rng.integers(1, 1 << 62), rng.integers(0, 4)
        of = lambda s: (1 + (s ^ np.uint64(salt)) % np.uint64(4) if mixed else np.full(len(s), 1 + salt % 4)).astype(np.uint8)
        assert len(np.intersect1d(ngram_join.signatures(x, of(x), percent)[0], ngram_join.signatures(y, of(y), percent)[0]))
    assert linked > 50


def test_ngram_join_of_repeated_ids_with_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (5, b), (7, a + " end"), (9, b + " end"), (3, "c d e f"), (5, None), (None, a)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(5, 57, 5, 1): 3, (7, 58, 5, 1): 1, (9, 58, 5, 1): 1, (3, 1, 3, 0): 1, (5, 0, 5, 0): 1, (None, 57, 5, 1): 1})


def links_by_hand(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = SPACED.findall((t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset({tuple(w)} if w else ())
    kinds = set(sets.values()) - {frozenset()}
    links = {x: sum(100 * len(x & y) >= percent * len(x | y) for y in kinds) - 1 for x in kinds}
    return {i: links.get(s, 0) for i, s in sets.items()}


def test_frequent_tokens_are_told_by_their_counts(spark, monkeypatch):
    """However many rare tokens there are, those of more than 16 documents are frequent as long as they are few; else the limit rises."""
    shared = " ".join(f"s{j}" for j in range(33))
    rows = [(i, " ".join([*([shared] if i < 20 else []), *(f"w{i}x{j}" for j in range(200))])) for i in range(40)] + [(100 + i, " ".join(f"t{j}" for j in range(13))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    of = ngram_join.frequent_tokens
    monkeypatch.setattr(ngram_join, "frequent_tokens", lambda *a: found.append(of(*a)) or found[-1])
    for most, want in ((64, 40), (20, 10), (4, 0)):
        monkeypatch.setattr(ngram_join, "MAX_FREQUENT", most)
        got = by_id(ngram_join.ngram_jaccard_join(df))
        assert len(found.pop()[0]) == want
        assert len({r.component_id for r in got.values()}) == 41


@pytest.mark.parametrize("block", [ngram_join.BLOCK_TOKENS, 1024])
def test_ngram_join_counts_all_links(spark, docs, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "MIN_FREQUENT", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", block)
    for df in (docs, near_copies(spark)):
        got = {i: r.n_links for i, r in by_id(ngram_join.ngram_jaccard_join(df, words=4, percent=85)).items()}
        assert got == links_by_hand(texts(df), 4, 85)


def test_html_extraction(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", html_extract.html.unescape(re.sub(r"<(?!/?(?:p|h1)\b)[^>]*>", lambda m: " " if m.group(0) == "<br>" else "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    page = '<html><body><div class="cookie-notice">C</div><header>H</header><main><article><h1>T &amp; U</h1><nav>N</nav><p>One <b>two</b>\n three<br>four<p>Five<ul><li>a<li>b</ul><form>F</form><aside>S</aside><section class="comments"><article><p>no</p></article></section></article></main><footer>F</footer><script>x="</p>"</script></body>'
    odd = spark.createDataFrame([(1, "http://h/a", page), (2, None, None), (3, "nothing", ""), (4, "http://h/b", "plain &lt;text")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(odd).collect()} == {1: "T & U\n\nOne two three four\n\nFive\n\na\n\nb", 2: "", 3: "", 4: "plain <text"}
    assert html_extract.extract(pages.limit(0)).count() == 0


def neutral_page(rng, k):
    """A page without telling names, and its article."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    title, body = text(5), [text(rng.randrange(20, 60)) for _ in range(rng.randrange(1, 5))]
    links = "".join(f"<li><a href=/{word()}>{text(3)}</a></li>" for _ in range(6))
    page = f"<html><body><div class=k1><ul>{links}</ul></div><div class='k2 z{1000 + k}'><div class=k3>All rights kept by us and nobody else at all</div><div class=k4><h2>{title}</h2><div class=k5>{''.join(f'<p>{x}' for x in body)}<div class=k6>Sign here for more</div></div></div><div class=k7>{text(8)}</div></div></body></html>"
    return page, "\n\n".join([title, *body])


def test_the_template_decides(spark):
    rng = random.Random(21)
    made = [neutral_page(rng, k) for k in range(40)]
    rows = [(k, f"http://one.host/{k}", page) for k, (page, _) in enumerate(made)]
    schema = "page_id long, url string, html string"
    for again in (1, 2):  # rows that stand twice cancel nothing
        got = html_extract.extract(spark.createDataFrame(rows * again, schema)).collect()
        assert len(got) == len(rows) * again and all(r.text == made[r.page_id][1] and r.n_chars == len(r.text) for r in got)
    found = html_extract.templates(spark.createDataFrame(rows, schema).withColumn("host", F.lit("h"))).first()
    assert found.main == "/html/body/div.k2+z#/div.k4" and found.dropped == ["/html/body/div.k2+z#/div.k4/div.k5/div.k6"]
    alone = html_extract.extract(spark.createDataFrame([(k, f"http://h{k}/", page) for k, page, in ((k, p) for k, (p, _) in enumerate(made))], schema)).collect()
    assert all(r.text != made[r.page_id][1] for r in alone)


def test_deduction_of_classes_by_hand(spark):
    """Classes of tokens from whole occurrence vectors."""
    rng = random.Random(22)
    rows = []
    for k in range(30):
        parts = "".join(f"<div class={rng.choice('abcd')}>{k}</div>" for _ in range(rng.randrange(4)))
        rows.append((k, f"<body><main>{parts}{'<section class=s><p>x</p></section>' if k % 3 == 0 else ''}</main></body>"))
    vectors = defaultdict(lambda: [0] * len(rows))
    for k, page in rows:
        for e in html_extract.parse(page)[0]:
            vectors[e.path][k] += 1
    classes = defaultdict(set)
    for p, v in vectors.items():
        if sum(x > 0 for x in v) >= 3:
            classes[tuple(v)].add(p)
    stats = html_extract.token_stats(spark.createDataFrame(rows, "page_id long, html string").withColumn("host", F.lit("h"))).collect()
    got = defaultdict(set)
    for r in stats:
        got[r.pages, r.mark1, r.mark2].add(r.path)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))


@pytest.mark.parametrize("page", ["<p>x</p><div " + "a" * 1_000_000, "<a href=http://example.com/some/long/path/it's-here>x</a><p>y" + "'" * 100_000, "<div a='" * 50_000, '<div a="b' * 100_000, "<" * 1_000_000, "<!--" * 200_000, "<script>" * 100_000, "<p a=" * 100_000 + ">", "<a\n" * 200_000, "</div" * 100_000, "<x y='\"" * 50_000, "<ul><li>" * 20_000])
def test_odd_markup_is_read_in_linear_time(page):
    began = time.process_time()
    html_extract.article(page, None, None)
    assert time.process_time() - began < 20


def test_quality_classifier_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    verdict = quality_classifier.classify(d, train)
    assert verdict.count() == d.count()
    share = {r.good: r.k for r in verdict.join(held, "doc_id").groupBy(F.expr("quality = 1 and toxic = 0").alias("good")).agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[True] > 0.95 and share[False] < 0.2
    assert by_id(quality_classifier.classify(d.where("doc_id < 20"), labels.limit(0)))[3].kept


def test_importance_weights_by_hand(spark):
    """Counts, weights and the draw, from features of single texts."""
    import pyarrow as pa

    rng = random.Random(5)
    words = {"good": "calm river stone light garden".split(), "bad": "buy cheap pills now win".split()}
    rows = [(i, " ".join(rng.choice(words["good" if i % 3 else "bad"]) for _ in range(rng.randrange(5, 60))) + "." * (i % 4)) for i in range(200)]
    rows += [(200, None), (201, ""), (3, rows[3][1]), (202, "river " * 5000)]
    labels = [(i, int(i % 3 > 0), int(i % 50 == 7)) for i in range(0, 200, 2)]
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = {i for i, q, t in labels if q == 1 and t == 0}
    slots = lambda t: Counter(int(s) for found, _ in quality_classifier.features(pa.array([t]))[0] for s in found)
    kinds = quality_classifier._START
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(slots(t))
        target.update(slots(t) if i in good else {})
    sure, prior, totals = 1.5, 0.1, [[sum(n for s, n in c.items() if a <= s < b) for a, b in zip(kinds, kinds[1:])] for c in (raw, target)]

    def ratio(s):
        k = next(k for k in range(3) if s < kinds[k + 1])
        share = totals[1][k] / max(1, totals[0][k])
        e, t = raw[s] * share, target[s]
        error = sure * (e * (1 - share) + 1) ** 0.5
        lo, hi = max(e - error, 0), e + error
        return np.log((t + prior) / (min(max(t, lo), hi) + prior))

    got = quality_classifier.classify(df, marks, sure=sure, prior=prior).collect()
    assert len(got) == len(rows)
    want = {i: sum(n * ratio(s) for s, n in slots(t).items()) for i, t in rows}
    assert all(abs(r.weight - want[r.doc_id]) < 1e-3 * max(1, abs(want[r.doc_id])) for r in got)
    assert any(w > 1 for w in want.values()) and any(w < -1 for w in want.values())
    weights = {r.doc_id: r.weight for r in got}
    known = [(weights[i], i in good) for i, _, _ in labels]
    cut = quality_classifier.best_cut(np.array([w for w, _ in known]), np.array([g for _, g in known]))
    gains = [sum(g for w, g in known if w >= c) / sum(g for _, g in known) + sum(not g for w, g in known if w < c) / sum(not g for _, g in known) for c in [*sorted({w for w, _ in known}), cut]]
    assert gains[-1] == pytest.approx(max(gains))
    k = sum(r.weight >= cut for r in got)
    least = sorted((r.key for r in got), reverse=True)[k - 1]
    assert all(r.kept == (r.key >= least) for r in got)
    noise = np.array([r.key - r.weight for r in got])
    assert 0.2 < noise.mean() < 1 and 0.9 < noise.std() < 1.7 and len(set(np.round(noise, 9))) == len(set(i for i, _ in rows))


def test_the_kth_largest_key(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 5), 1.5, -3.0]) for _ in range(700)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 350, 699, 700):
        assert quality_classifier.kth_largest(df, "key", k) == sorted(values, reverse=True)[k - 1]


def test_decontamination(spark, docs, small):
    bench = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").cast("string").alias("item_id"), "text").unionByName(spark.createDataFrame([("short", "one Two three"), ("none", None), ("odd", " ..."), ("x", "one")], "item_id string, text string"))
    items = [(r.item_id, ALNUM.findall((r.text or "").translate(LOW))) for r in bench.collect()]
    windows = defaultdict(set)
    for i, w in items:
        for j in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[j : j + 10])].add(i)
    sizes = sorted({len(w) for w in windows})
    for bytes_ in (decontaminate.BLOCK_BYTES, 4000):
        rows = decontaminate.report(decontaminate.decontaminate(docs, bench, block_bytes=bytes_)).collect()
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
        assert len(rows) == docs.count()
        for i, t in texts(docs):
            w, hit, found = ALNUM.findall((t or "").translate(LOW)), set(), set()
            for m in sizes:
                for j in range(len(w) - m + 1):
                    if (ids := windows.get(tuple(w[j : j + m]))) is not None:
                        found |= ids
                        hit |= set(range(j, j + m))
            assert got[i] == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    assert any(v[4] for v in got.values())


def test_decontamination_by_items_without_id(spark):
    long, short = " ".join(f"w{i}" for i in range(14)), "lone item"
    bench = spark.createDataFrame([(None, long), (None, short), ("known", "b c d")], "item_id string, text string")
    df = spark.createDataFrame([(1, f"x {long} y"), (2, f"a {short} b c d"), (3, "nothing of it")], "doc_id long, text string")
    for bytes_ in (decontaminate.BLOCK_BYTES, 10):
        got = by_id(decontaminate.report(decontaminate.decontaminate(df, bench, block_bytes=bytes_)))
        assert {i: (r.n_hit, r.n_items, r.contaminated) for i, r in got.items()} == {1: (14, 0, True), 2: (5, 1, True), 3: (0, 0, False)}
        assert got[2].items_sha256 == hashlib.sha256(b"known").hexdigest()


def test_decontamination_of_texts_that_repeat_themselves(spark):
    """Time does not grow with the number of equal windows in a text times that in the benchmark."""
    bench = spark.createDataFrame([("ha", "ha " * 300_000), ("two", "ho ho"), *((f"same{k}", " ".join(f"w{j}" for j in range(30))) for k in range(500))], "item_id string, text string")
    df = spark.createDataFrame([(1, "ha " * 1_000_000), (2, "ho " * 500_000), (3, "ha " * 9), (4, " ".join(f"w{j}" for j in range(30)) + " ha" * 10)], "doc_id long, text string")
    began = time.time()
    got = by_id(decontaminate.report(decontaminate.decontaminate(df, bench)))
    assert time.time() - began < 30
    assert {i: (r.n_words, r.n_hit, r.n_items) for i, r in got.items()} == {1: (1_000_000, 1_000_000, 1), 2: (500_000, 500_000, 1), 3: (9, 0, 0), 4: (40, 40, 501)}


def test_spans_of_decontamination_end_with_their_texts(spark):
    bench = spark.createDataFrame([("a", " ".join(f"w{j}" for j in range(25)))], "item_id string, text string")
    rows = [(1, " ".join(f"w{j}" for j in range(12))), (2, " ".join(f"w{j}" for j in range(12, 25))), (3, " ".join(f"w{j}" for j in range(5))), (4, " ".join(f"w{j}" for j in range(5, 25)) + " x " + " ".join(f"w{j}" for j in range(10)))]
    got = by_id(decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), bench))
    assert {i: [tuple(x) for x in r.hits] for i, r in got.items()} == {1: [(0, 12)], 2: [(0, 13)], 3: [], 4: [(0, 20), (21, 31)]}


def test_classifier_counts_exact_ids(spark):
    """Ids over 2^53 beside a null one keep their own labels."""
    big = 1 << 60
    rows = [(big + k, f"{'good' if k % 2 else 'bad'} text number {k}") for k in range(40)] + [(None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    raw, target = quality_classifier._counts(df, np.array([big + 1, big + 3], np.int64))
    one = spark.createDataFrame([r for r in rows if r[0] in (big + 1, big + 3)], "doc_id long, text string")
    assert (target == quality_classifier._counts(one, np.zeros(0, np.int64))[0]).all() and target.sum() < raw.sum()


def test_classifier_counts_in_bounded_memory(spark, monkeypatch):
    """A task that counts many slots holds the sums, not the slots: of 40 batches no more memory than of 4."""
    import pyarrow as pa

    rng = random.Random(5)
    batch = pa.record_batch({"doc_id": list(range(64)), "text": [" ".join(f"w{rng.randrange(9000)}" for _ in range(800)) for _ in range(64)]})
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    frame, made = type(df), []
    mapped = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **k: made.append(f) or mapped(self, f, *a, **k))
    quality_classifier._counts(df, np.arange(0, 64, 3))

    def counted(n):
        tracemalloc.start()
        try:
            blobs = [x for out in made[0](itertools.repeat(batch, n)) for x in out.column("sums").to_pylist()]
            return tracemalloc.get_traced_memory()[1], np.concatenate([np.frombuffer(x, np.int32).reshape(2, -1) for x in blobs], axis=1)
        finally:
            tracemalloc.stop()

    (few, once), (many, again) = counted(4), counted(40)
    assert (again == 10 * once).all() and once[1].any()
    assert many < 1.2 * few


def test_quality_rules(docs):
    got = by_id(quality_rules.judge(docs))
    for i, t in texts(docs):
        t = t or ""
        w = SPACED.findall(t)
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        repeated = {j + d for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for d in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if SPACED.search(line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated), failed)
        assert not (r.kept and failed)
    assert quality_rules.distance(*map(__import__("numpy").array, ([1.0, 0], [0, 1.0]))) == pytest.approx(1)


def test_distribution_test_by_hand(docs):
    """References over all documents, Jensen-Shannon distances and verdicts."""
    kinds = [set("abcdefghijklmnopqrstuvwxyz"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set("0123456789"), set(" \t\n\v\f\r"), set(".,;:'\"-()")]
    rows = [(r.doc_id, r.text or "", r.lang if r.lang in quality_rules.COMMON_WORDS else "other") for r in docs.select("doc_id", "text", "lang").collect()]

    def counts(text, lang):
        by_class = Counter(next((k for k, chars in enumerate(kinds) if c in chars), 5 if c < "\x80" else 6) for c in text)
        words = ALNUM.findall(text.translate(LOW))
        common = quality_rules.COMMON_WORDS.get(lang, "").split()
        seen = Counter(words)
        return [by_class[k] for k in range(7)], [*(seen[w] for w in common), len(words) - sum(seen[w] for w in common)] if common else None

    made = {k: counts(t, lang) for k, (_, t, lang) in enumerate(rows)}
    refs = {}
    for k, (_, _, lang) in enumerate(rows):
        for kind in (0, 1):
            if made[k][kind] is not None:
                old = refs.get((lang, kind), [0] * len(made[k][kind]))
                refs[lang, kind] = [x + y for x, y in zip(old, made[k][kind], strict=True)]

    def distance(p, q):
        p, q = ([x / sum(v) for x in v] for v in (p, q))
        half = lambda a, b: sum(x * np.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
        return max(0.0, (half(p, q) + half(q, p)) / 2) ** 0.5

    got = Counter((r.doc_id, r.class_distance and round(r.class_distance, 6), r.word_distance and round(r.word_distance, 6), r.kept) for r in quality_rules.judge(docs).collect())
    base = {r.doc_id: r.base_failed for r in quality_rules.judge(docs).collect()}
    want = Counter()
    for k, (i, _, lang) in enumerate(rows):
        far = []
        for kind, least in ((0, quality_rules.MIN_CHARS), (1, quality_rules.MIN_WORDS)):
            v = made[k][kind]
            far.append(distance(v, refs[lang, kind]) if v is not None and sum(v) >= least else None)
        limit = quality_rules.MAX_WORD_DISTANCE + quality_rules.WORD_NOISE / max(1, sum(made[k][1] or [1])) ** 0.5
        fine = (far[0] is None or far[0] <= quality_rules.MAX_CLASS_DISTANCE) and (far[1] is None or far[1] <= limit)
        want[i, far[0] and round(far[0], 6), far[1] and round(far[1], 6), fine and not base[i]] += 1
    assert got == want and any(k[1] for k in got) and any(k[2] for k in got)


def test_bpe_equals_the_library_and_decodes(docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    got = by_id(bpe.tokenize(docs, path, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")))
    for i, t in texts(docs):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want and got[i].n_tokens == len(want) and got[i].decoded == library.decode(want, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()
    own = bpe.load(path)
    for t in ("a<|endoftext|>B's", "ΌΣΟΣ İ ﬁ ʼn 12½", "a" * 400, "\x1c\x85y\u3000z", "é\u0301 \u00a0<|start"):
        assert own.encode(t) == " ".join(map(str, library.encode(t, add_special_tokens=False).ids))


def test_bpe_equals_the_library_on_every_code_point():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library, own, rng = Tokenizer.from_file(path), bpe.load(path), random.Random(4)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    familiar = [c for c in every if not bpe._UNFAMILIAR.search(c)]
    texts = ["".join(f"a{c}B " for c in every[k : k + 64]) for k in range(0, len(every), 64)]
    texts += [f"A{c}b {c} {c}1" for c in familiar]
    for pool in (every, familiar, every[:0x3000], every[0x300:0x600]):
        texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    for k in range(0, len(texts), 5000):
        part = texts[k : k + 5000]
        assert [own.encode(t) for t in part] == [" ".join(map(str, e.ids)) for e in library.encode_batch(part, add_special_tokens=False)]


def lines_by_hand(rows, size=3):
    first, out = {}, {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}):
        full = [x.strip(" \t\n\v\f\r") for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        out[i] = (len(full), {j + d for j in range(len(full) - size + 1) if first.setdefault(tuple(full[j : j + size]), (i, j)) != (i, j) for d in range(size)})
    return out


def test_line_dedup(spark, docs, small):
    shared = "first shared line\n second\n\nthird one\nfourth"
    extra = spark.createDataFrame([(900, f"own\n{shared}\ntail"), (901, shared), (902, f"{shared}\n{shared}")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(extra)
    want = lines_by_hand(texts(df))
    rows = line_dedup.dedup_lines(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        n, covered = want.get(r.doc_id, (0, set()))
        assert (r.n_lines, r.n_removed) == (n, len(covered))
    got = by_id(line_dedup.dedup_lines(df))
    assert got[900].text.startswith("own") and got[901].text == "" and got[51].text is None
    compare(spark, small, queries.op7_line_dedup, queries.oracle_sql()["op7_line_dedup"])


def test_substring_dedup(spark, docs):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, rows = words(70), []
    for i in range(30):
        rows.append((i, f"{words(40)} {passage} {words(30)}" if i % 3 == 0 else words(100)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(substring_dedup.dedup_substrings(df))
    assert all(got[i].n_cut_bytes == 0 for i in range(30) if i % 3 or i == 0)
    assert all(len(passage) * 0.5 < got[i].n_cut_bytes <= len(passage) + 2 for i in range(3, 30, 3))
    seen: dict = {}
    whole = by_id(substring_dedup.dedup_substrings(docs.select("doc_id", "text")))
    for i, t in sorted({(i, t) for i, t in texts(docs) if t is not None}):
        raw = t.encode()
        ends, _ = substring_dedup.chunk_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        chunks = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) else []
        assert b"".join(chunks) == raw
        again = [seen.setdefault(c, (i, j)) != (i, j) for j, c in enumerate(chunks)]
        runs = [[len(c) for c, _ in run] for repeated, run in itertools.groupby(zip(chunks, again, strict=True), lambda x: x[1]) if repeated]
        cut = [run for run in runs if sum(run) >= substring_dedup.MIN_RUN]
        assert (whole[i].n_seen, whole[i].n_repeated, whole[i].n_cut_bytes) == (sum(again), sum(map(len, cut)), sum(map(sum, cut)))
        assert len(whole[i].text.encode()) == len(raw) - whole[i].n_cut_bytes


def chunks_by_hand(raw, least, most, bits):
    """Ends of the chunks of a text with white space in every stretch of ``most`` bytes, byte by byte."""
    out, start, h = [], 0, 0
    for k, b in enumerate(raw):
        h = ((h << 2) + int(substring_dedup._GEAR[b])) & 0xFFFFFFFF
        if b not in b" \t\n\v\f\r":
            continue
        end = k + 1
        natural = h >> (32 - bits) == 0 and end - start >= least and end >= 16
        # behind ``most`` bytes the first white space ends the chunk, unless the next natural end comes first
        if natural or end - start >= most:
            out.append(end)
            start = end
    return out + [len(raw)] * (start < len(raw))


def test_chunks_by_hand():
    rng = random.Random(31)
    for n in (0, 1, 5, 40, 400, 2000):
        text = " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randrange(1, 12))) for _ in range(n)).encode()
        for least, most, bits in ((24, 256, 2), (8, 64, 3)):
            ends, owner = substring_dedup.chunk_ends(np.frombuffer(text, np.uint8), np.array([0, len(text)]), least, most, bits)
            assert ends.tolist() == chunks_by_hand(text, least, most, bits) and set(owner.tolist()) <= {0}


def test_repeated_ids_with_other_texts(spark):
    rng = random.Random(13)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    lines, long = "\n".join(text(4) for _ in range(6)), text(90)
    rows = [(1, lines), (1, "short"), (1, long), (2, f"own\n{lines}"), (2, long + " end"), (None, lines), (2, None), (2, f"own\n{lines}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_removed) for r in line_dedup.dedup_lines(df).collect())
    assert got == Counter({(1, 0): 3, (2, 6): 2, (2, 0): 2, (None, 0): 1})
    cut = Counter((r.doc_id, r.n_cut_bytes > 300) for r in substring_dedup.dedup_substrings(df).collect())
    assert cut[1, True] == 0 and cut[2, True] == 1 and cut[None, False] == 1 and sum(cut.values()) == len(rows)


def test_substring_dedup_without_white_space(spark):
    rng = random.Random(10)
    run = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = run(400)
    rows = [(0, run(100) + passage + run(50)), (1, run(77) + passage + run(90)), (2, run(500)), (3, run(60) + passage[:200] + run(1) + passage[200:]), (4, "a" * 2000)]
    got = by_id(substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")))
    size = len(passage.encode())
    assert got[0].n_cut_bytes == got[2].n_cut_bytes == 0
    assert size * 0.7 < got[1].n_cut_bytes <= size and size * 0.5 < got[3].n_cut_bytes <= size
    assert all(got[i].n_chunks >= len(t.encode()) / (substring_dedup.MOST + 4) for i, t in rows)


def test_url_filter(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame([(-1, None), (-2, "no scheme"), (-3, "http://A.Example.COM/en/7x?q#f"), (-4, "http://com/en/"), (-5, "x://notcom/en/"), (-6, "http://h.net"), (-7, "ftp://u@B.Net:8/de/8/?x"), (-8, "http://example.net/de/8")], "page_id long, url string"))
    rules = [(v, *t.partition("/")[::2]) for v, t in url_filter.RULES]
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        host = path = ""
        if r.url and "://" in r.url:
            after = r.url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", after).group().translate(LOW)
            path = re.match(r"[^?#]*", after[len(host) :]).group()
        fits = [(len(h) + len(p), f"{h}/{p}", v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        want = max(fits, default=(0, None, None))
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, want[1]) and g.verdict in ("allow", "block") and (want[2] is None or g.verdict == want[2])


def general_by_hand(segment):
    m = re.search(r"\.[A-Za-z]{1,5}$", segment)
    ext = m.group() if m else ""
    stem = segment[: len(segment) - len(ext)]
    wild = re.fullmatch("[0-9]+", stem) or re.fullmatch("[0-9A-Fa-f-]{8,}", stem) and re.search("[0-9]", stem) or re.search("[0-9]", stem) and re.search("[A-Za-z]", stem) and len(stem) >= 12 or len(stem) > 60
    return "*" + ext if wild else segment


def tree_by_hand(rows, many, most, share, z, weight, doubt, depth=16, rounds=3):
    """rows: (host, path, label or None). Template and purity of each."""
    paths = [p.removeprefix("/").split("/") for _, p, _ in rows]
    paths = [[general_by_hand(x) for x in (p if len(p) <= depth else [*p[:depth], "**"])] for p in paths]
    for r in range(rounds):
        nodes = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for (host, _, label), t in zip(rows, paths, strict=True):
            for k in range(len(t)):
                x = nodes[host, tuple(t[:k])][t[k]]
                x[0], x[1], x[2] = x[0] + 1, x[1] + (label is not None), x[2] + (label == "block")
        names = {}
        for node, kids in nodes.items():
            if len(kids) >= most or len(kids) >= many and len(kids) >= share * sum(n for n, _, _ in kids.values()):
                names |= {(node, kid): "*" for kid in kids}
                continue
            if r < rounds - 1:
                continue
            group = []
            for rate, kid, known, bad in [*sorted((b / n, kid, n, b) for kid, (_, n, b) in kids.items() if n), (None, None, 0, 0)]:
                if group:
                    r0, _, n0, b0 = group[-1]
                    pooled = (b0 + bad) / (n0 + known)
                    if rate is None or abs(rate - r0) > z * (pooled * (1 - pooled) * (1 / n0 + 1 / known)) ** 0.5:
                        if len(group) > 1:
                            segments = [g[1] for g in group]
                            names |= {(node, g): f"{{{min(segments)}|{max(segments)}}}" for g in segments}
                        group = []
                group.append((rate, kid, known, bad))
        paths = [[names.get(((host, tuple(t[:k])), t[k]), t[k]) for k in range(len(t))] for (host, _, _), t in zip(rows, paths, strict=True)]
    sums = defaultdict(lambda: [0, 0, 0])
    for (host, _, label), t in zip(rows, paths, strict=True):
        for k in (None, *range(len(t) + 1)):
            x = sums[k if k is None else (host, tuple(t[:k]))]
            x[0], x[1], x[2] = x[0] + 1, x[1] + (label is not None), x[2] + (label == "block")
    n, known, bad = sums[None]
    out = []
    for (host, _, _), t in zip(rows, paths, strict=True):
        p = bad / max(1.0, known + doubt * (n - known))
        for k in range(len(t) + 1):
            x = sums[host, tuple(t[:k])]
            p = (x[2] + weight * p) / (x[1] + (doubt * (x[0] - x[1]) if k == 0 else 0) + weight)
        out.append(("/" + "/".join(t), p))
    return out


def test_path_trees(spark, small):
    rng = random.Random(12)
    urls = []
    for host in ("a.com", "b.org", "shop.net", "wiki.org"):
        for _ in range(300):
            top = rng.choice(("en", "de", "fr", "spam", "spam2", "blog"))
            rest = rng.choice((f"{rng.randrange(99)}", f"w{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}/x/{rng.choice(('y', 'z'))}/deep/deeper.html", "", f"user-{rng.randrange(5)}/post/{rng.getrandbits(64):x}"))
            urls.append(f"http://{host}/{top}/{rest}")
    urls += ["http://b.org", "http://b.org/", "x", None, "http://a.com/en/1"]
    rules = (("block", "a.com/spam"), ("allow", "a.com/en/"), ("block", "com/fr/1"), ("block", "shop.net/"), ("allow", "shop.net/blog/u"), ("block", "b.org/spam/user-1"), ("block", "b.org/spam2/"), ("allow", "b.org/en/w"))
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    blocked, seen = 0, ""
    for options in (dict(many=20, most=1000, share=0.1, z=2.0, weight=10.0, doubt=0.25), dict(many=3, most=40, share=0.5, z=1.0, weight=2.0, doubt=0.05)):
        got = by_id_of(url_filter.filter_urls(df, rules=rules, **options), "page_id")
        rows = [(g.host, g.path, g.verdict if g.rule else None) for g in (got[i] for i in range(len(urls)))]
        for i, (template, purity) in enumerate(tree_by_hand(rows, **options)):
            assert got[i].template == template and got[i].purity == pytest.approx(purity, abs=1e-9)
            assert got[i].rule or got[i].verdict == ("block" if purity >= 0.8 else "allow")
            blocked += not got[i].rule and got[i].verdict == "block"
        seen += " ".join(g.template for g in got.values())
    assert blocked and "/*/" in seen and "{" in seen
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_wildcards_below_wildcards_and_deep_paths(spark):
    urls = [f"http://h.com/user/{chr(97 + a)}{chr(97 + b)}/post/{chr(97 + (a + 3 * b) % 26)}{chr(97 + (5 * a + b) % 26)}x" for a in range(20) for b in range(20)]
    urls += ["http://h.com/" + "/".join(f"{chr(97 + k % 26)}b" for k in range(n)) for n in (15, 16, 17, 18, 1000, 1000)] + ["http://h.com/" + "x/" * 50_000, "http://h.com/" + "y" * 200_000]
    began = time.time()
    got = by_id_of(url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")), "page_id")
    assert time.time() - began < 60
    assert {got[k].template for k in range(400)} == {"/user/*/post/*"}
    assert [got[k].template.count("/") for k in range(400, 408)] == [15, 16, 17, 17, 17, 17, 17, 1]
    assert got[402].template.endswith("/**") and got[404].template == got[403].template and got[407].template == "/*"
    assert got[404].path == urls[404].removeprefix("http://h.com")


def test_undecided_urls_of_bad_branches_are_rejected(spark):
    """A rule that blocks by numbers labels a template; its other rows follow, and other branches of the host don't."""
    rules = tuple(("block", f"spam.com/offer/{d}") for d in range(1, 8)) + (("allow", "spam.com/news/"),)
    urls = [f"http://spam.com/offer/{d}" for d in range(100, 1000)] + [f"http://spam.com/news/{d}" for d in range(900)] + [f"http://clean.com/{d}" for d in range(300)]
    got = by_id_of(url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules), "page_id")
    undecided = [got[k] for k in range(900) if got[k].rule is None]
    assert len(undecided) == 200 and {r.verdict for r in undecided} == {"block"}
    assert {got[k].verdict for k in range(900, len(urls))} == {"allow"}


def test_contract_rules_of_urls(spark):
    want = {"http://a.com/en/1": "block", "http://example.com/en/70": "allow", "http://x.example.com/en/7": "allow", "http://a.net/de/8": "allow", "http://example.net/de/81": "block", "http://example.net/de/1": "allow", "http://a.org/es/": "block"}
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(want)), "page_id long, url string")).collect()
    assert {list(want)[r.page_id]: r.verdict for r in got} == want


def test_licenses(docs, spark):
    extra = spark.createDataFrame([(800, "Under the MIT License. UNDER the mit/license! Apache License, Version 2.0; cc by nc sa 4.0 / x"), (801, "GNU General Public License v3 or any later version. license_mit"), (802, "mit license under the"), (803, "cc"), (804, "by nc")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(extra)
    got = by_id(licenses.scan_licenses(df))
    for i, t in texts(df):
        w = ALNUM.findall((t or "").translate(LOW))
        hits = [(j, label) for phrase, label in licenses.BASE.items() for j in range(len(w)) if w[j : j + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min((j for j, _ in hits), default=None), max((j for j, _ in hits), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "cc-by-nc-sa-4.0" in got[800].labels and "gpl-3.0-or-later" in got[801].labels and "gpl-3.0," not in got[801].labels + ","
    assert len(licenses.RULES) > 200


def test_license_rules_by_hand():
    """Every rule run on every text; detections taken by priority and length, those inside a taken one left out."""
    rng = random.Random(41)
    pieces = ["gnu general public license version 2 or at your option any later version", "apache license version 2 0", "cc by nc sa 4 0", "bsd 3 clause license", "mit license", "under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "mozilla public license 2 0", "licensed under the mit", "all rights reserved", "lgpl v2 1", "creative commons attribution share alike 4 0", "gpl 3 0 only", "eclipse public license v 2 0", "isc license", "unrelated words", "version 2 0", "license"]
    texts_ = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(150)] + [""]
    for text in texts_:
        found = []
        for r in licenses.RULES:
            if all(k in text for k in r.keywords):
                found += [(-r.priority, m.start() - m.end(), m.start(), r.label, m.end()) for m in re.finditer(r.pattern, text)]
        taken = []
        for p, _, start, label, end in sorted(found):
            if not any(a <= start and end <= b for _, a, b, _ in taken):
                taken.append((label, start, end, -p))
        words = lambda at: text[:at].count(" ")
        base, accepted = licenses.scan(text)
        assert accepted == [(label, words(a), words(b) + 1, p) for label, a, b, p in taken]
        # no keyword gate hides a rule that would fit
        assert {(r.label, m.span()) for r in licenses.RULES for m in re.finditer(r.pattern, text)} == {(label, (a, e)) for _, _, a, label, e in found}
        assert sorted(base) == sorted((label, j) for phrase, label in licenses.BASE.items() for j in range(len(text.split())) if text.split()[j : j + len(phrase.split())] == phrase.split())


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontaminated", "encoded"]
    near = corpus_pipeline.near_duplicates(spark, d, sf)
    want = {i for i, (_, c) in components_by_hand(texts(d), 5, 80).items() if i == c}
    assert {r.doc_id for r in near.select("doc_id").collect()} == want and near.columns == d.columns
    clean = corpus_pipeline.decontaminated(spark, d, sf)
    hit = {r.doc_id for r in queries.op4_decontaminate(spark, sf).where("contaminated").collect()}
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {i for i, _ in texts(d)} - hit
    lines = {r.doc_id: r for r in corpus_pipeline.lines(spark, d, sf).collect()}
    by_hand = lines_by_hand(texts(d))
    assert all((r.text == t) == (not by_hand[i][1]) for i, t in texts(d) if (r := lines.get(i)))
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() < d.count()


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path)
    spark.createDataFrame([(6, 1, 0), (7, 1, 0), (8, 0, 0), (0, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "one two three"), (None, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    long = next(t for i, t in texts(odd) if i == 50)
    more = spark.createDataFrame([(50, "another text of the same id", "en", "s", 1), (49, long, "en", "s", 1), (None, "no id at all", "en", "s", 1)], SCHEMA)
    df = clashing(odd.unionByName(more)).withColumn("group", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        assert name == "encoded" or tuple(out.columns) == corpus_pipeline.COLUMNS
        assert stage(spark, df.limit(0), sf).count() == 0
    near = Counter((r.doc_id, hash(r.text)) for r in corpus_pipeline.near_duplicates(spark, df, sf).collect())
    groups = components_by_hand([(k, t) for k, (i, t) in enumerate(sorted(texts(df), key=lambda x: (x[0] is None, x[0], str(x[1]))))], 5, 80)
    assert max(near.values()) == 1 and near[50, hash("another text of the same id")] == near[None, hash("no id at all")] == near[51, hash(None)] == 1
    assert sum(near.values()) == len({c for _, c in groups.values()}) and near[50, hash(long)] == 0
    kept = corpus_pipeline.decontaminated(spark, df, sf)
    assert {r.doc_id for r in df.join(kept.select(F.col("doc_id").alias("k")), F.col("doc_id") == F.col("k"), "left_anti").collect()} == {4, 5, None}


def clashing(df):
    names = ("n_words", "hits", "items", "n_lines", "n_removed", "component_id", "signature", "__id", "repeats", "row", "pos", "found_id", "found_row", "found_repeats", "range", "tokens", "weight", "key", "kept", "good", "id", "host", "path", "main", "h", "size", "cluster", "n")
    return df.withColumns({c: F.concat(F.lit(c), F.lit("-"), F.coalesce(F.col(df.columns[0]).cast("string"), F.lit("none"))) for c in names})


def bare(rows):
    return Counter(map(repr, (tuple(r) for r in rows)))


@pytest.mark.parametrize("op", [ngram_join.ngram_jaccard_join, quality_rules.judge, lambda d: bpe.tokenize(d, queries.tokenizer_path()), licenses.scan_licenses], ids=["join", "rules", "bpe", "licenses"])
def test_other_columns_do_not_matter(spark, odd, op):
    assert bare(op(clashing(odd)).collect()) == bare(op(odd).collect())
    assert op(odd.limit(0)).count() == 0


def test_kept_columns_keep_their_values(spark, odd):
    bench = spark.createDataFrame([("1", "one two three")], "item_id string, text string")
    df = clashing(odd)
    for op, made in ((line_dedup.dedup_lines, {"n_lines", "n_removed"}), (substring_dedup.dedup_substrings, {"n_chunks", "n_seen", "n_repeated", "n_cut_bytes"}), (lambda d: decontaminate.decontaminate(d, bench), {"n_words", "hits", "items"})):
        own = [c for c in df.columns if c not in made and c != "text"]
        got = op(df)
        assert bare(got.select(*own).collect()) == bare(df.select(*own).collect())
        assert bare(got.select("doc_id", "text", *sorted(made)).collect()) == bare(op(odd).select("doc_id", "text", *sorted(made)).collect())
        assert op(df.limit(0)).count() == 0
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (7, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    assert bare(quality_classifier.classify(df, clashing(labels)).select("doc_id", "weight", "kept").collect()) == bare(quality_classifier.classify(odd, labels).select("doc_id", "weight", "kept").collect())
    assert quality_classifier.classify(odd.limit(0), labels).count() == 0
    pages = spark.createDataFrame([(k, f"http://h/{k % 3}", f"<body><p>{k}</p></body>") for k in range(8)] + [(None, None, None)], "page_id long, url string, html string")
    assert bare(html_extract.extract(clashing(pages)).collect()) == bare(html_extract.extract(pages).collect())
    assert bare(url_filter.filter_urls(clashing(pages)).collect()) == bare(url_filter.filter_urls(pages).collect())


def test_very_long_texts(spark):
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(5000)]
    text = " ".join(rng.choice(words) for _ in range(900_000))
    rows = [(1, text, "en"), (2, text.replace(" ", "\n"), "en"), (3, "cc by nc\n" * 200_000, "en"), (4, "x" * 3_000_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bench = spark.createDataFrame([("b", " ".join(text.split()[500_000:500_030]))], "item_id string, text string")
    joined = by_id(ngram_join.ngram_jaccard_join(df))
    assert joined[1].component_id == joined[2].component_id == 1 and joined[1].n_shingles > 890_000
    assert {i: (r.n_hit >= 30) for i, r in by_id(decontaminate.report(decontaminate.decontaminate(df, bench))).items()} == {1: True, 2: True, 3: False, 4: False}
    assert by_id(line_dedup.dedup_lines(df))[3].n_removed == 199_999
    assert by_id(substring_dedup.dedup_substrings(df))[3].n_cut_bytes > 1_500_000
    assert by_id(quality_rules.judge(df))[1].n_words == 900_000
    assert by_id(licenses.scan_licenses(df))[3].n_base == 200_000
    assert by_id(bpe.tokenize(df, queries.tokenizer_path(), outputs=("n_tokens",)))[4].n_tokens > 0
    assert quality_classifier.classify(df, spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")).count() == 4
    page = "<body><article>" + "".join(f"<p>{w}" for w in words * 20) + "</article></body>"
    assert html_extract.extract(spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")).first().text == "\n\n".join(words * 20)
