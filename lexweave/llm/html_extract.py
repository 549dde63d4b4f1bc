"""Main text of web pages, with wrappers inferred for each host.

A page is parsed into a tree of block elements and text runs.  Pages of a host are folded one after the other into a wrapper, a
union-free regular expression over that tree: elements that match are merged, elements that only one side has become
optional, neighbours that repeat become a repeated group, and text runs that differ become slots.  Folding is
associative enough to be done in parts: each task folds its own pages of a host, and partial wrappers are folded in two levels,
so a host with a third of all pages is nowhere folded by one task.

Texts are counted exactly at the wrapper's places (element paths): one that most of a host's distinct pages hold, and at least two, is
template.  The content of every page of a host is the innermost element of its wrapper that holds most of the other text; an article, main
or content element only ends the descent, and breaks a tie where no element holds most.  A page without that element is taken by itself.
Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are left out by element, role and class.
"""

from __future__ import annotations

import difflib
import hashlib
import html
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged
from .url_filter import url_host

#: Hosts whose wrappers a task holds before it hands them on.
HOSTS = 20_000
#: Levels of elements that a page's tree has at most.
DEPTH = 100
#: Elements by what they do.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noframes xmp".split())
LEFT_OUT = set("head script style noscript template iframe object svg canvas nav footer aside form button select textarea input dialog menu title noframes".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
WORDS_OUT = set("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer
    gdpr masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promotion promoted recommend
    recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags taboola toolbar widget widgets""".split())  # fmt: skip
WORDS_IN = set("article articlebody content entry main post story".split())
#: Words that say nothing of what an element is for, beside one of WORDS_OUT in a compound class name.
WORDS_NEUTRAL = set("area article articles bar block body bottom box btn button buttons center col column container content entry form group head header inner item items left link links list main outer page panel post posts reader right row section site slot story text title top unit user web wrap wrapper".split())
#: Elements of text, which are never the content by themselves.
BLOCKS = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure".split())
#: An element of these closes an open paragraph.
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An open element of the first kind ends where one of the second begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


class Node:
    __slots__ = ("name", "sig", "out", "inside", "children")

    def __init__(self, name: str, sig: str, out: bool, inside: bool) -> None:
        self.name, self.sig, self.out, self.inside, self.children = name, sig, out, inside, []


def started(name: str, attributes: str) -> Node:
    """An element by its name and attributes.

    A class name (or id) leaves it out only as a whole: all its words must be known, and one of them of WORDS_OUT, so `ad-slot` and
    `reader-comments` are left out, and `related-work` is not.
    """
    words, role, sig, unwanted = set(), "", name, False
    if attributes.strip():
        found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
        for label in f"{found.get('class', '')} {found.get('id', '')} {found.get('itemprop', '')}".split():
            own = {w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", label).lower()) if w}
            unwanted |= bool(own & WORDS_OUT) and own <= WORDS_OUT | WORDS_NEUTRAL
            words |= own
        role = found.get("role", "").lower()
        sig = f"{name}.{'.'.join(sorted(words))}" if words else name
        sig += f"@{role}" if role in ("main", "article") else ""
    inside = name in ("article", "main") or role in ("main", "article") or bool(words & WORDS_IN)
    return Node(name, sig, name in LEFT_OUT or role in ROLES or unwanted, inside)


def parsed(page: str) -> Node:
    """The tree of block elements; inline elements leave their text, a line break a space.

    An element more than DEPTH deep is no node of its own, unless it is left out: its text belongs to the element around it, as a run
    of its own.
    """
    root = Node("html", "html", False, False)
    stack, at, text = [root], 0, []
    deeper: list[tuple[str, int]] = []  # open elements that are no nodes, with the length of the stack around them

    def flush() -> None:
        if text:
            run = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if run:
                stack[-1].children.append(run)

    def cut(i: int) -> None:
        del stack[i:]
        while deeper and deeper[-1][1] > len(stack):
            deeper.pop()

    def opened(name: str, attributes: str) -> None:
        if name in CLOSES_P and any(n.name == "p" for n in stack[1:]):
            cut(max(i for i, n in enumerate(stack) if n.name == "p"))
        for i in range(len(stack) - 1, 0, -1):
            if name in ENDS.get(stack[i].name, ()):
                cut(i)
                break
            if stack[i].name in ("ul", "ol", "table", "dl"):
                break
        node, empty = started(name, attributes), name in VOID or attributes.rstrip().endswith("/")
        if name == "header" and not any(n.inside for n in stack):
            node.out = True
        if len(stack) <= DEPTH or node.out > stack[-1].out:
            stack[-1].children.append(node)
            if not empty:
                stack.append(node)
        elif not empty:
            deeper.append((name, len(stack)))

    def closed(name: str) -> None:
        for j in range(len(deeper) - 1, -1, -1):
            if deeper[j] == (name, len(stack)):
                del deeper[j:]
                return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == name:
                cut(i)
                return

    while m := TOKEN.search(page, at):
        text.append(page[at : m.start()])
        at = m.end()
        end, start = m[1], m[2]
        if end is None and start is None:
            continue
        name = (end or start).lower()
        if name in ("html", "body"):
            if name == "body":
                flush()
                cut(1)
        elif start is not None and name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif name in INLINE:
            if name == "br":
                text.append(" ")
        else:
            flush()
            if start is None:
                closed(name)
            else:
                opened(name, m[3] or "")
    text.append(page[at:])
    flush()
    return root


# Wrapper nodes are lists: text ["#", value or None for a slot]; element [sig, repeated, optional, children].


def skeleton(node: Node) -> list:
    return [node.sig, False, False, squashed([["#", c] if isinstance(c, str) else skeleton(c) for c in node.children])]


def squashed(nodes: list) -> list:
    """`nodes` with neighbouring repeats folded into repeated groups, shorter groups first."""
    tried = 0
    while True:
        last: dict[str, int] = {}
        # A group can only be as long as the way from one of its elements to the next such element.
        ways = set()
        for i, n in enumerate(nodes):
            ways.add(i - last.get(n[0], i))
            last[n[0]] = i
        tried = min((k for k in ways if k > tried), default=0)
        if not tried:
            return nodes
        nodes = folded(nodes, tried)


def folded(nodes: list, k: int) -> list:
    """`nodes` with neighbouring repeats of `k` elements folded."""
    keys, out, i = [n[0] for n in nodes], [], 0
    while i < len(nodes):
        key, j = keys[i : i + k], i + k
        if keys[j : j + 1] == key[:1] and key != ["#"] * k:
            while keys[j : j + k] == key:
                j += k
        if j - i < 2 * k:
            out.append(nodes[i])
            i += 1
            continue
        group = nodes[i : i + k]
        for at in range(i + k, j, k):
            group = [merged(a, b) for a, b in zip(group, nodes[at : at + k])]
        if k == 1:
            group[0][1] = True
            out.append(group[0])
        else:
            out.append(["*", True, False, group])
        i = j
    return out


def merged(a: list, b: list) -> list:
    if a[0] == "#":
        return ["#", a[1] if a[1] == b[1] else None]
    return [a[0], a[1] or b[1], a[2] or b[2], aligned(a[3], b[3])]


def aligned(a: list, b: list) -> list:
    """The union-free wrapper of two lists of nodes."""
    ka, kb = [n[0] for n in a], [n[0] for n in b]
    if ka == kb:
        return [merged(x, y) for x, y in zip(a, b)]

    def optional(nodes: list) -> list:
        return [n if n[0] == "#" else [n[0], n[1], True, n[3]] for n in nodes]

    out = []
    for op, i, j, p, q in difflib.SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if op == "equal":
            out += [merged(x, y) for x, y in zip(a[i:j], b[p:q])]
        else:
            out += optional(a[i:j]) + optional(b[p:q])
    return squashed(out)


def place(path: str) -> int:
    return int.from_bytes(hashlib.blake2b(path.encode(), digest_size=8).digest(), "big", signed=True)


def runs(node: Node, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, text) of the text in `node`, in page order, without elements that are left out."""
    for c in node.children:
        if isinstance(c, str):
            yield path, c
        elif not c.out:
            yield from runs(c, f"{path}/{c.sig}")


def named(path: str) -> int:
    """3 for the path of an article, 2 for main, 1 for a content class, 0 for others."""
    sig, _, role = path.rpartition("/")[2].partition("@")
    name, *words = sig.split(".")
    return 3 if "article" in (name, role) else 2 if "main" in (name, role) else int(not WORDS_IN.isdisjoint(words))


def region(wrapper: list, weights: dict[int, int]) -> set[str]:
    """The paths of the content in a wrapper, by the text that is not template at each place."""
    inner: dict[str, dict[str, None]] = {"": {}}

    def grow(nodes: list, path: str) -> None:
        for c in nodes:
            if c[0] == "*":
                grow(c[3], path)
            elif c[0] != "#":
                own = f"{path}/{c[0]}"
                inner[path][own] = None
                inner.setdefault(own, {})
                grow(c[3], own)

    grow(wrapper[3], "")
    weight = {}
    for path in reversed(inner):  # a path is always entered after the one around it
        weight[path] = weights.get(place(path), 0) + sum(weight[c] for c in inner[path])
    total, at = weight[""], ""
    while total and named(at) < 3:
        most = [c for c in inner[at] if weight[c] >= 0.7 * total and c.rpartition("/")[2].partition(".")[0] not in BLOCKS]
        if not most or (named(at) and not named(most[0])):
            break
        at = most[0]
    if named(at):
        return {at}
    within = [p for p in inner if p.startswith(f"{at}/") and named(p) and weight[p]]
    best = max(map(named, within), default=0)
    return {p for p in within if named(p) == best} or {at}


def elements(node: Node, paths: set[str], path: str = "") -> Iterator[tuple[Node, str]]:
    """The outermost elements at `paths`, in page order."""
    if path in paths:
        yield node, path
        return
    for c in node.children:
        if not isinstance(c, str) and not c.out:
            yield from elements(c, paths, f"{path}/{c.sig}")


def main_text(page: str, paths: set[str] = frozenset(), fixed: set[tuple[int, int]] = frozenset()) -> str:
    """Blocks of the main text, in page order, joined by an empty line.

    `paths`: the host's content; `fixed`: (place, text digest) of its template text.  A page that has no text at `paths` is a host by itself.
    One whose content would be template for the most part is a near copy of other pages and keeps all of it.
    """
    root = parsed(page)
    found = [(path, text) for node, at in elements(root, paths) for path, text in runs(node, at)]
    if not found:
        weights: dict[int, int] = {}
        for path, text in runs(root):
            if (place(path), place(text)) not in fixed:
                weights[place(path)] = weights.get(place(path), 0) + len(text)
        found = [(path, text) for node, at in elements(root, region(skeleton(root), weights)) for path, text in runs(node, at)]
    kept = [text for path, text in found if (place(path), place(text)) not in fixed]
    if 2 * sum(map(len, kept)) < sum(len(text) for _, text in found):
        kept = [text for _, text in found]
    return "\n\n".join(kept)


def page_texts(pages: DataFrame) -> DataFrame:
    """(host, place, digest, pages, chars): on how many distinct pages of its host a text stands at a place.  Place 0 counts the pages."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = page.as_py() or ""
                found = {(place(path), place(text)): len(text) for path, text in runs(parsed(page))} | {(0, 0): 0}
                key = place(page)
                for (at, digest), chars in found.items():
                    for column, value in zip(rows, (host, at, digest, key, chars)):
                        column.append(value)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], ["host", "place", "digest", "page", "chars"])

    made = pages.select("host", "html").mapInArrow(local, "host string, place long, digest long, page long, chars long")
    made = made.groupBy("host", "place", "digest", "page").agg(F.min("chars").alias("chars"))
    return made.groupBy("host", "place", "digest").agg(F.count("*").alias("pages"), F.min("chars").alias("chars"))


def evidence(pages: DataFrame) -> DataFrame:
    """(host, weights, fixed): for each host the characters of other text at each place, and its template text (place, digest)."""
    texts = staged(page_texts(pages), "html-texts")
    held = texts.filter("place = 0").select("host", F.col("pages").alias("of"))
    fixed = texts.filter("place <> 0 and pages >= 2").join(held, "host").filter("2 * pages > of").select("host", "place", "digest", "pages", "chars")
    weights = texts.filter("place <> 0").select("host", "place", (F.col("pages") * F.col("chars")).alias("chars"))
    weights = weights.unionByName(fixed.select("host", "place", (-F.col("pages") * F.col("chars")).alias("chars")))
    weights = weights.groupBy("host", "place").agg(F.sum("chars").alias("chars")).filter("chars > 0").groupBy("host").agg(F.collect_list(F.struct("place", "chars")).alias("weights"))
    fixed = fixed.groupBy("host").agg(F.collect_list(F.struct("place", "digest")).alias("fixed"))
    return held.select("host").join(weights, "host", "left").join(fixed, "host", "left")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one row for each host of `pages` (host, html)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([zlib.compress(json.dumps(w).encode()) for w in held.values()], pa.binary())], ["host", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = skeleton(parsed(page.as_py() or ""))
                held[host] = merged(held[host], own) if host in held else own
                if len(held) >= HOSTS:
                    yield handed()
                    held.clear()
        yield handed()

    def folded(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        done = None
        for w in sorted(parts["wrapper"]):
            own = json.loads(zlib.decompress(w))
            done = own if done is None else merged(done, own)
        return pd.DataFrame({"host": [key[0]], "wrapper": [zlib.compress(json.dumps(done).encode())]})

    made = pages.select("host", "html").mapInArrow(local, "host string, wrapper binary")
    made = made.withColumn("part", F.pmod(F.spark_partition_id(), 32))
    made = made.groupBy("host", "part").applyInPandas(folded, "host string, wrapper binary")
    return made.groupBy("host").applyInPandas(folded, "host string, wrapper binary")


def plans(pages: DataFrame) -> DataFrame:
    """(host, plan): the paths of the content and the template text of each host, compressed."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for wrapper, weights, fixed in zip(*(c.to_pylist() for c in batch.columns[1:])):
                paths = region(json.loads(zlib.decompress(wrapper)), {w["place"]: w["chars"] for w in weights or ()})
                made.append(zlib.compress(json.dumps([sorted(paths), sorted((f["place"], f["digest"]) for f in fixed or ())]).encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["host", "plan"])

    joined = wrappers(pages).join(evidence(pages), "host").select("host", "wrapper", "weights", "fixed")
    return joined.mapInArrow(decide, "host string, plan binary")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): one row for each row of `pages`.

    Null, empty and unclosed html give what text there is, or ''.  Urls without a host, null ones included, share the wrapper of the empty
    host.  Repeated rows are all extracted, and count once for what is template; pages of any length and nesting are read whole.  Where two
    places hold as much text, the one that comes first in the wrapper wins.  An empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    held = staged(plans(rows), "html-plans")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([zlib.compress((x.as_py() or "").encode(), 3) for x in batch.column(3)], pa.binary())], ["id", "url", "host", "page"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[set[str], set[tuple[int, int]]]] = {}
        for batch in batches:
            texts = []
            for page, plan in zip(batch.column(2), batch.column(3).to_pylist()):
                if plan not in known:
                    if len(known) > 256:
                        known.clear()
                    paths, fixed = json.loads(zlib.decompress(plan))
                    known[plan] = set(paths), {tuple(f) for f in fixed}
                texts.append(main_text(zlib.decompress(page.as_py()).decode(), *known[plan]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    id_type = rows.schema["id"].dataType.simpleString()
    # Pages travel compressed to the join with their host's plan, which adaptive execution splits for a hot host.
    packed = rows.mapInArrow(pack, f"id {id_type}, url string, host string, page binary")
    return packed.join(held, "host").select("id", "url", "page", "plan").mapInArrow(run, f"id {id_type}, url string, text string, n_chars long")
