"""HTML extraction by template deduction over the pages of a host.

A page becomes a stream of structural tokens: opened containers, told apart by
their path of names, classes and ids (long numbers in them are all alike). The
occurrence vector of a token, its count on each page of the host, is kept as a
fingerprint (sums of two hashes of page and count), which tasks can build apart
and add, so no host's pages meet in one task. Tokens with one fingerprint form
an equivalence class. A class is valid if it stands on two pages and a tenth of
the host's at least and nests: the parents of its tokens belong to it or to
another valid class. The valid classes nested in one another are the host's
template. Its containers that stand once on a page bracket slots.

The article's slot is the innermost one that holds ``SHARE`` of the running text
that varies between the host's pages; link text, and text that is the same on
every page, is template text and does not count. A slot that differs from the
one around it by headings only gives way to it. Each page's text is what remains
of its slot without slots of template text or of links, and without containers
that are never article text: menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments. Where there is no template to
decide, as for a host's only page, the names of a page's own containers do.

Defined cases: a null or empty page has an empty text; a url without a host
shares a template with all such pages; unclosed elements are closed by their
container's end; a tag or comment that the page's end cuts off is dropped, a
quote that nothing closes is part of its value; containers nested more than
DEPTH deep only part blocks, their text stands in the one around; repeated rows are read alike and
count as often as they stand; an empty table gives an empty one; other columns
are ignored. The whole page is read whatever its length, in time that grows
with it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import written
from .textops import mix, slices
from .url_filter import host_and_path

# Kinds of elements.
NEVER = frozenset("nav header footer aside form script style noscript template iframe svg button select option textarea head title menu dialog object canvas audio video map datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CONTAINERS = BLOCKS | NEVER | {"td", "th"}
RAW = frozenset(("script", "style", "title", "textarea", "noscript", "template", "iframe"))
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
NOISE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|notice|gdpr|popup|modal|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead"
    r"|comments?|disqus|repl(?:y|ies)|shar(?:e|ing)|social|related|recommend\w*|newsletter|subscribe|signup|login|search|widget|toolbar|pagination|pager)(?:$|[\s_-])",
    re.I,
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|story|main|body|text)(?:$|[\s_-])", re.I)

#: An opened or closed tag as it mostly stands; others are read attribute by attribute.
_TAG = re.compile(r'<(/?+)([A-Za-z][A-Za-z0-9:-]*+)((?:\s++[^\s"\'<>/=]++(?:="[^"]*+")?+)*+)\s*+/?+>')
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*+)")
_ATTR = re.compile(r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_GAP = re.compile(r"[\s/=]*+")
_NUMBER = re.compile(r"\d{3,}")
SHARE = 0.6
DEPTH = 100
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("depth", "name", "noise", "parent", "path")

    def __init__(self, name: str, attrs: str, parent: Element | None):
        names = role = ""
        self.noise = bool(parent and parent.noise) or name in NEVER
        if attrs and not attrs.isspace():
            found = {m.group(1).lower(): m.group(2) or m.group(3) or m.group(4) or "" for m in _ATTR.finditer(attrs)}
            names = " ".join(filter(None, (found.get("class"), found.get("id"))))
            role = found.get("role", "").lower()
            shown = "hidden" not in found and found.get("aria-hidden", "").lower() != "true" and "display:none" not in found.get("style", "").replace(" ", "").lower()
            self.noise = self.noise or not shown or role in NOISE_ROLES or (name not in ("html", "body", "article", "main") and bool(NOISE_NAMES.search(names)))
        mark = "." + _NUMBER.sub("#", "+".join(sorted(set(names.split())))).replace("/", "|") if names else ""
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent else 0
        self.path = (parent.path if parent else "") + "/" + name + mark + ("@main" if role == "main" else "")


def _markup(page: str, at: int) -> tuple[int, str, bool, str]:
    """Of the markup at a "<": where it ends, the tag's name ("" for comments and the like, None for a bare "<"), whether it closes, and its attributes."""
    m = _TAG.match(page, at)
    if m:
        return m.end(), m.group(2).lower(), bool(m.group(1)), m.group(3)
    m = _NAME.match(page, at)
    n = len(page)
    if m is None:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return (end + 3 if end >= 0 else n), "", False, ""
        if page[at + 1 : at + 2] in ("!", "?", "/"):
            end = page.find(">", at)
            return (end + 1 if end >= 0 else n), "", False, ""
        return at + 1, None, False, ""
    start = k = m.end()
    while True:
        k = _GAP.match(page, k).end()
        if k >= n:
            return n, "", False, ""
        if page[k] == ">":
            return k + 1, m.group(1).lower(), page[at + 1] == "/", page[start:k]
        k = _ATTR.match(page, k).end()


def parse(page: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """Opened containers in page order, and blocks of text with the container they stand in and the length of their link text."""
    root = Element("html", "", None)
    top, opened, blocks, words = root, [root], [], []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if words:
            text = _SPACE.sub(" ", "".join(words)).strip()
            words.clear()
            if text:
                blocks.append((top, text, min(linked, len(text))))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        words.append(text)
        if in_link:
            linked += len(text)

    at, n = 0, len(page)
    raw_end: dict[str, int] = {}
    too_deep: Counter[str] = Counter()
    while at < n:
        start = page.find("<", at)
        if start < 0:
            add(html.unescape(page[at:]))
            break
        end, name, closes, attrs = _markup(page, start)
        while name is None:  # a bare "<" is text
            start = page.find("<", end)
            if start < 0:
                break
            end, name, closes, attrs = _markup(page, start)
        if start < 0:
            add(html.unescape(page[at:]))
            break
        if start > at:
            add(html.unescape(page[at:start]))
        at = end
        if not name:
            continue
        if name == "a":
            in_link = not closes
        if closes:
            if too_deep[name]:
                too_deep[name] -= 1
                flush()
            elif name in CONTAINERS:
                x = top
                while x is not root and x.name != name:
                    x = x.parent
                if x is not root:
                    if name not in ("td", "th"):
                        flush()
                    top = x.parent
            continue
        if name in VOID:
            words.append(" ")
            if name == "hr":
                flush()
            continue
        if name not in CONTAINERS:
            continue
        if name in ("td", "th"):
            words.append(" ")
        elif name in BLOCKS:
            flush()
        if name == "html":
            continue
        if name in BLOCKS and top.name == "p":
            top = top.parent
        stop = CLOSED_BY_SAME.get(name)
        if stop:
            x = top
            while x is not root and x.name not in stop and x.name != name:
                x = x.parent
            if x.name == name:
                top = x.parent
        made = Element(name, attrs, top)
        if name in RAW:
            # everything up to the end tag is no markup; where none follows, none will for a later one
            if raw_end.get(name) != n:
                found = re.compile(f"</{name}", re.I).search(page, at)
                close = page.find(">", found.end()) if found else -1
                raw_end[name] = close + 1 if close >= 0 else n
            at = raw_end[name]
            continue
        if made.depth > DEPTH:
            too_deep[name] += 1
            continue
        opened.append(made)
        top = made
    flush()
    return opened, blocks


def _rank(path: str) -> int:
    """How much a container looks like the article's, by its own name; 0 for not at all."""
    last = path.rpartition("/")[2]
    name, _, names = last.partition(".")
    if name.startswith("article"):
        return 5
    if name.startswith("main") or last.endswith("@main"):
        return 4
    if name in ("div", "section", "td") and names and MAIN_NAMES.search(names.replace("+", " ")):
        return 3
    return 2 if name == "body" else 1 if path == "/html" else 0


def _best(paths: list[tuple[str, float]]) -> str | None:
    """The article's container among (path, text size): by rank, then size, then the outer one."""
    usable = [(_rank(p), size, -len(p), p) for p, size in paths if _rank(p)]
    return max(usable)[3] if usable else None


def _text_hash(s: str) -> int:
    raw = s.encode("utf-8", "surrogatepass")
    return crc32(raw) << 31 | crc32(raw, 0x5BD1E995) >> 1


_STATS = ("pages", "mark1", "mark2", "most", "size", "plain", "low", "high", "noise")


def token_stats(pages: DataFrame) -> DataFrame:
    """Per host and path: pages, fingerprint of the occurrence vector, most on a page, size of the text that stands directly in it, that of it which is no link, and the least and largest hash of it on a page.

    Only paths that can be in a valid class, on two pages and a tenth of the host's at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}

        def drained() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), *[pa.int64()] * len(_STATS)))], names=["host", "path", *_STATS])

        for batch in slices(batches, "html"):
            salts = mix(batch.column("page_id").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)).tolist()
            for salt, host, page in zip(salts, batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if not page:
                    continue
                opened, blocks = parse(page)
                own: dict[str, list] = {}
                for e in opened:
                    own.setdefault(e.path, [0, 0, 0, 0, e.noise])[0] += 1
                for e, text, linked in blocks:
                    x = own[e.path]
                    x[1] += len(text)
                    x[2] += len(text) - linked
                    x[3] = (x[3] * 31 + _text_hash(text)) & 0x7FFFFFFFFFFFFFFF
                for path, (count, size, plain, h, noise) in own.items():
                    mark = salt * (2 * count + 1) * 0x9E3779B97F4A7C15
                    one, two = mark >> 33 & 0x7FFFFFFF, mark >> 2 & 0x7FFFFFFF
                    x = held.get((host, path))
                    if x is None:
                        held[host, path] = [1, one, two, count, size, plain, h, h, int(noise)]
                    else:
                        x[:] = x[0] + 1, x[1] + one, x[2] + two, max(x[3], count), x[4] + size, x[5] + plain, min(x[6], h), max(x[7], h), max(x[8], int(noise))
            if len(held) > 100_000:
                yield drained()
        yield drained()

    rows = pages.select("page_id", "host", "html").mapInArrow(run, "host string, path string, " + ", ".join(f"{x} long" for x in _STATS))
    how = {"most": F.max, "low": F.min, "high": F.max, "noise": F.max}
    whole = written(rows.groupBy("host", "path").agg(*(how.get(x, F.sum)(x).alias(x) for x in _STATS)).where("pages > 1"))
    hosts = whole.where("path = '/html'").select(F.col("host").alias("of"), F.col("pages").alias("n_pages"))
    return whole.join(hosts, F.col("host") == F.col("of")).where("pages * 10 >= n_pages").drop("of")


def _above(path: str) -> str:
    return path.rpartition("/")[0]


def deduce(tokens: pd.DataFrame) -> pd.DataFrame:
    """One host's template from its token table: the article's slot, the slots in it that are dropped, and the template's paths."""
    host, n_pages = tokens["host"].iloc[0], int(tokens["n_pages"].iloc[0])
    rows = {r.path: r for r in tokens.itertuples(index=False)}
    classes: dict[tuple[int, int, int], list[str]] = {}
    for r in rows.values():
        classes.setdefault((r.pages, r.mark1, r.mark2), []).append(r.path)
    class_of = {p: key for key, paths in classes.items() for p in paths}
    valid: dict[tuple[int, int, int], bool] = {}
    for key in sorted(classes, key=lambda k: min((len(p), p) for p in classes[k])):
        above = {_above(p) for p in classes[key]} - {""}
        valid[key] = all(class_of.get(q) == key or valid.get(class_of.get(q), False) for q in above)
    template = sorted(p for key, ok in valid.items() if ok for p in classes[key])
    # text under each path: all, what varies, and what of that is no link
    total, varied, plain = ({p: 0 for p in rows} for _ in range(3))
    for p, r in rows.items():
        if not r.noise:
            differs, q = r.low != r.high, p
            while q:
                if q in rows:
                    total[q] += r.size
                    varied[q] += r.size * differs
                    plain[q] += r.plain * differs
                q = _above(q)
    slots = [p for p in template if rows[p].most == 1 and not rows[p].noise]
    running = plain.get("/html", 0)
    held = [p for p in slots if rows[p].pages * 2 >= n_pages and running and plain[p] >= SHARE * running]
    main = max(held, key=lambda p: (p.count("/"), plain[p], p), default=None)
    while main and _above(main) in held:
        out = _above(main)
        beside = [p for p in rows if _above(p) == out and p != main and varied[p]]
        if not beside or (rows[out].size and rows[out].low != rows[out].high) or not all(p.rpartition("/")[2].partition(".")[0] in _HEADINGS for p in beside):
            break
        main = out
    dropped = []
    if main and n_pages >= 5:
        kinds = ("div", "section", "ul", "ol", "table", "aside", "form", "figure", "dl")
        dropped = [p for p in slots if p.startswith(main + "/") and rows[p].pages * 5 >= 4 * n_pages and p.rpartition("/")[2].partition(".")[0] in kinds and total[p] and (not varied[p] or plain[p] * 4 < varied[p])]
    return pd.DataFrame({"host": [host], "main": [main], "dropped": [dropped], "template": [template]})


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, dropped, template). A host's table of frequent paths is one group, not its pages."""
    return token_stats(pages).groupBy("host").applyInPandas(deduce, "host string, main string, dropped array<string>, template array<string>")


def article(page: str | None, main: str | None, dropped: list[str] | None) -> str:
    """The text of a page's article slot, blocks joined by an empty line; where the page has no such slot, of the container that its own names tell."""
    if not page:
        return ""
    opened, blocks = parse(page)
    paths = {e.path for e in opened if not e.noise}
    if main not in paths:
        sizes = dict.fromkeys(paths, 0.0)
        for e, text, _ in blocks:
            while e is not None:
                if e.path in sizes:
                    sizes[e.path] += len(text)
                e = e.parent
        main = _best(list(sizes.items()))
    skipped, out = set(dropped or ()), []
    for e, text, _ in blocks:
        inside, x, ok = False, e, not e.noise
        while ok and x is not None:
            inside = inside or x.path == main
            ok = x.path not in skipped
            x = x.parent
        if ok and inside:
            out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    host, _ = host_and_path(pages[url])
    source = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[html_column].alias("html"), host.alias("host"))
    # a small table by its measured size is broadcast; else a hot host's rows can be split
    found = written(templates(source).select(F.col("host").alias("h"), "main", "dropped"))
    joined = source.join(found, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "main", "dropped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [article(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("html", "main", "dropped")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
