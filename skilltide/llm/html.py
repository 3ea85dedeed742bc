"""Main-text extraction with a site style tree.

The pages of a host are merged into one tree: a node is a path of tags (with
their first class), and holds the styles (sequences of child tags) and contents
seen there. A node's presentation importance is the entropy of its styles, its
content importance one minus the mean entropy of its contents over the pages, as
in the site style tree; a branch's importance mixes its own with that of its
children. Branches below a threshold leave every page of that host: they say the
same on page after page.

Elements that declare themselves noise (menus, headers, footers, side bars,
notices, adverts, forms, scripts, comments) have importance 0. Tags and roles say
so by themselves; a class or id does if a whole token of it holds words for noise
and nothing else but words of layout (``cookie-banner``, ``ad-slot``, not
``has-sidebar``). Such a token, or a form, counts nothing on a branch that holds
declared main text or more than half of the page's text, and ambiguous words
(notice, related, share) count nothing inside declared main text: there the tree
decides. Reader comments are noise wherever they are declared. If a page declares
its main text (article, main), only that is taken, and the declaration is a prior:
a block inside it, told by its path and text, has as importance the share of the
host's such pages that lack it, counted as if ``PRIOR`` more lacked it, so passages
which some or few pages share stay. If all of a page would go, all of it stays.

Edge cases: null and empty html give an empty text; unclosed and stray tags are
accepted; texts of any length are read whole; a null url is a host of its own; a
path is judged if it is on ``least_pages`` pages or on all pages, two at least, of a
smaller host; repeated rows are extracted each; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import html
import math
import re
import uuid
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, scratch, written
from .media import filesystem

# Kinds of elements in HTML, and words in class or id names that declare noise.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head script style noscript template iframe object svg math canvas button select option textarea input nav footer aside menu dialog title".split())
MAIN = frozenset("article main".split())
READERS = frozenset("comment comments disqus respond replies".split())
NOISE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr newsletter subscribe subscription signup login popup modal sharing social recommended recommendations pagination pager".split())
AMBIGUOUS = frozenset("notice notices related share overlay toolbar widget header".split())
LAYOUT = frozenset("area bar block bottom box button buttons col column container footer global group inner item items left link links list main outer page panel post posts primary right secondary section site slot top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table tbody thead tfoot tr body html article main section div nav aside footer header".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe|svg(?!(?:[^>"']|"[^"]*"|'[^']*')*(?<=/)>))\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S | re.I)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|itemprop|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Za-z]+")
GAMMA, LOW = 0.9, 0.3
#: Pages without a block that the declaration of main text is worth.
PRIOR = 8


class Node:
    __slots__ = ("tag", "path", "hint", "noise", "main", "children", "digest", "size", "holds")

    def __init__(self, tag: str, path: int, hint: int, main: bool):
        self.tag, self.path, self.hint, self.main = tag, path, hint, main
        self.noise, self.children, self.digest = False, [], 0
        self.size, self.holds = 0, False  # characters of text; whether main text is declared in it


#: What an element says of itself: nothing, an ambiguous word, a word for noise (or a form), noise for certain.
NOTHING, MAYBE, TOKEN, CERTAIN = range(4)


def _token_hint(token: str) -> int:
    """Of one class or id token in lower case."""
    words = set(_PARTS.findall(token))
    if not words or not words <= READERS | NOISE | AMBIGUOUS | LAYOUT:
        return NOTHING
    return CERTAIN if words & READERS else TOKEN if words & NOISE else MAYBE if words & AMBIGUOUS else NOTHING


def _declared(tag: str, attributes: str) -> tuple[int, bool, str]:
    """(hint, main, first class) as an element declares itself."""
    hint, main, first = CERTAIN if tag in DROPPED else TOKEN if tag == "form" else MAYBE if tag == "header" else NOTHING, tag in MAIN, ""
    if attributes:
        for name, a, b, c in _NAMES.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id"):
                if tag not in ("html", "body"):
                    hint = max([hint, *map(_token_hint, value.split())])
                if name == "class" and not first:
                    first = next(iter(_PARTS.findall(value)), "")
            elif name == "role":
                hint, main = max(hint, CERTAIN if value in ROLES - {"form"} else TOKEN if value in ROLES else NOTHING), main or value == "main"
            elif name == "itemprop":
                main = main or value == "articlebody"
            elif name == "hidden" or value == "true":
                hint = CERTAIN
    return hint, main and hint != CERTAIN, first


def _judge(root: Node) -> None:
    """Which nodes are noise and which main text, from what they say of themselves and what they hold."""
    order = list(_walk(root))
    for n in reversed(order):
        below = [c for c in n.children if isinstance(c, Node) and c.hint != CERTAIN]
        n.size = sum(len(c.strip()) for c in n.children if isinstance(c, str)) + sum(c.size for c in below)
        n.holds = n.main or any(c.holds for c in below)
    for n in order:
        inside = n.main
        for c in n.children:
            if isinstance(c, Node):
                if n.noise or c.hint == CERTAIN:
                    c.noise = True
                elif c.hint == TOKEN or c.hint == MAYBE and not inside:
                    c.noise = not c.holds and 2 * c.size <= root.size
                c.main = c.main or inside


def parse(text: str) -> Node:
    """The page's tree; a child is a node or a piece of undecoded text."""
    root = Node("", 0, NOTHING, False)
    stack, at, opened = [root], 0, Counter()

    def close(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    for m in _TOKEN.finditer(text):
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        tag = name.lower()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P and opened["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in SIBLINGS and any(opened[t] > 0 for t in SIBLINGS[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[tag]:
                    close(i)
                    break
                if stack[i].tag in _SCOPES:
                    break
        above = stack[-1]
        hint, main, first = _declared(tag, m[4])
        node = Node(tag, xxhash.xxh3_64_intdigest(f"{above.path}/{tag}.{first}") >> 1, hint, main)
        above.children.append(node)
        if tag not in VOID and not m[4].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    if at < len(text):
        stack[-1].children.append(text[at:])
    _judge(root)
    return root


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(c for c in reversed(n.children) if isinstance(c, Node))


def digest_blocks(root: Node) -> set[int]:
    """Gives the nodes in declared main text the digest of their path and text, below 0 (0 without text); those of blocks."""
    found = set()
    for n in reversed(list(_walk(root))):
        if n.main and not n.noise:
            parts = [" ".join(c.split()) if isinstance(c, str) else str(c.digest or "") for c in n.children]
            if any(parts):
                n.digest = -(xxhash.xxh3_64_intdigest("\n".join([str(n.path), *parts])) >> 1) - 1
                if n.tag not in INLINE:
                    found.add(n.digest)
    return found


def nodes_of(root: Node) -> dict[int, tuple[int, int]]:
    """path: (style, content) of the page, over all nodes of the path together."""
    found: dict[int, list[list[str]]] = {}
    for n in _walk(root):
        style, content = found.setdefault(n.path, [[], []])
        style.append(",".join([c.tag for c in n.children if isinstance(c, Node)]))
        content.extend([c for c in n.children if isinstance(c, str)])
    return {p: tuple(xxhash.xxh3_64_intdigest("\n".join(x).strip()) - (1 << 63) for x in v) for p, v in found.items()}


def _blocks(root: Node, out: list[str], declared: bool, low: dict[int, float]) -> None:
    """Append the kept text of a page with gaps at its blocks; branches of low composite importance go."""

    def entry(node: Node, taken: bool) -> list:
        mark = len(out)
        if node.tag not in INLINE:
            out.append(" ")
        # node, whether its text is kept, place in out, children left, parts, their importance
        return [node, taken or node.main or not declared, mark, iter(node.children), 0, 0.0]

    todo = [entry(root, False)]
    while todo:
        top = todo[-1]
        node, keep, mark, left = top[:4]
        for c in left:
            if isinstance(c, str):
                if keep:
                    out.append(c)
            elif not c.noise and not (c.digest and c.tag not in INLINE and c.digest in low):
                todo.append(entry(c, keep))
                break
        else:
            todo.pop()
            if node.tag not in INLINE:
                out.append(" ")
            own, parts, total = low.get(node.path, 1.0), top[4], top[5]
            value = own if not parts else (1 - GAMMA) * own + GAMMA * total / parts
            if value < LOW and not node.main:
                del out[mark:]
                out.append(" ")
            if todo:
                todo[-1][4] += 1
                todo[-1][5] += 1.0 if node.main else value


def main_text(text: str | None, low: dict[int, float] | None = None) -> str:
    """Main text of one page; ``low``: importance of its host's nodes that have less than 1."""
    if not text:
        return ""
    root = parse(text)
    declared = any(n.main and not n.noise for n in _walk(root))
    if declared and low:
        digest_blocks(root)
    out: list[str] = []
    _blocks(root, out, declared, low or {})
    found = " ".join(html.unescape("".join(out)).split())
    return found if found or not low else main_text(text)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def importance(pages: DataFrame, least_pages: int) -> DataFrame:
    """(host, n pages, paths, owns) from pages (host, html): paths or digests and importances of nodes whose own is below 1, and of shared blocks of main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, int] = {}
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(text or "")
                keys = [(host, path, kind, value) for path, values in nodes_of(root).items() for kind, value in enumerate(values)]
                if any(n.main and not n.noise for n in _walk(root)):
                    keys += [(host, d, 2, 0) for d in (0, *digest_blocks(root))]
                for key in keys:
                    counts[key] = counts.get(key, 0) + 1
            columns = [*zip(*counts, strict=True)] if counts else [[], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts.values(), pa.int64())], ["host", "path", "kind", "value", "n"])

    seen = pages.mapInArrow(run, "host string, path long, kind int, value long, n long")
    seen = written(seen.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n")), "html-counts")  # read three times
    # kind 0, styles: entropy of their shares. kind 1, contents: a content on k of m pages has entropy log k / log m
    node = seen.where("kind < 2").groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    mean = F.when(F.col("m") > 1, F.col("s") / F.col("m") / F.log("m")).otherwise(0.0)
    node = node.where("m > 1").withColumn("value", 1 - mean)
    node = node.groupBy("host", "path").agg(F.max("m").alias("m"), F.max(F.when(F.col("kind") == 1, F.col("value"))).alias("content"), F.max(F.when(F.col("kind") == 0, F.col("value"))).alias("style"))
    own = F.greatest("content", "style")
    both = node.select("host", "path", own.alias("own"), "m").where("own < 0.99")
    # The root, path 0, is on all pages of its host
    roots = written(node.where("path = 0").select("host", F.col("m").alias("n"), F.col("m").alias("pages")), "html-hosts")
    # kind 2: blocks of main text; a low one is on more than (1 - LOW) * (m + PRIOR) of the host's m pages, so few rows meet
    least = (1 - LOW) * PRIOR / LOW
    blocks = seen.where((F.col("kind") == 2) & (F.col("path") < 0) & (F.col("n") > least)).select("host", "path", "n")
    pages_of = seen.where((F.col("kind") == 2) & (F.col("path") == 0) & (F.col("n") > least)).select("host", F.col("n").alias("m"))
    shared = blocks.join(pages_of, "host").select("host", "path", (1 - F.col("n") / (F.col("m") + PRIOR)).alias("own"), F.lit(least_pages).cast("long").alias("m")).where(F.col("own") < LOW)
    judged = looked_up(both.union(shared), roots, "host", ["path"]).where(F.col("m") >= F.least(F.lit(least_pages), "pages"))
    of = judged.groupBy("host").agg(F.max("pages").alias("n"), F.collect_list(F.struct("path", "own")).alias("all"))
    return of.select("host", "n", F.col("all.path").alias("paths"), F.col("all.own").alias("owns"))


def store(low: DataFrame, uri: str) -> DataFrame:
    """Lay the hosts' paths and importances out in files at ``uri``; (host, n, file, start, size) of each host, size in paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(uri)
        out, at, name = None, 0, uuid.uuid4().hex
        for batch in batches:
            rows = []
            for host, n, paths, owns in zip(*batch.columns, strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(paths.values.to_numpy().astype("<i8").tobytes() + owns.values.to_numpy().astype("<f8").tobytes())
                rows.append((host.as_py(), n.as_py(), name, at, len(paths)))
                at += 16 * len(paths)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["host", "n", "file", "start", "size"])
        if out is not None:
            out.close()

    return written(low.mapInArrow(run, "host string, n long, file string, start long, size long"), "html-importance")


class Hosts:
    """Importances by host, read by byte range; the hosts used last are kept, up to ``most`` paths together or one host."""

    def __init__(self, uri: str, most: int = 300_000):
        self.fs, self.root = filesystem(uri)
        self.most, self.held = most, 0
        self.kept: OrderedDict[tuple[str, int], dict[int, float]] = OrderedDict()

    def of(self, file: str | None, start: int | None, size: int | None) -> dict[int, float]:
        if file is None:
            return {}
        low = self.kept.pop((file, start), None)
        if low is None:
            self.held += size
            while self.kept and self.held > self.most:
                self.held -= len(self.kept.popitem(last=False)[1])
            with self.fs.open_input_file(f"{self.root}/{file}") as source:
                data = source.read_at(16 * size, start)
            low = dict(zip(np.frombuffer(data, "<i8", size).tolist(), np.frombuffer(data, "<f8", size, 8 * size).tolist(), strict=True))
            self.held += len(low) - size
        self.kept[file, start] = low
        return low


def extract(pages: DataFrame, least_pages: int = 8, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    uri = scratch(pages.sparkSession, "html-hosts")
    low = store(importance(p.select("host", "html"), least_pages), uri)
    p = looked_up(p, low, "host", ["page_id", "url"]).select("page_id", "url", "html", "file", "start", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts = Hosts(uri)
        for batch in batches:
            where = zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)
            texts = [main_text(h.as_py(), hosts.of(*w)) for h, w in zip(batch.column(2), where, strict=True)]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    kinds = dict(p.dtypes)
    return p.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
