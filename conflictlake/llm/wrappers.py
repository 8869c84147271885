"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of structural tokens (tags; text between them is a slot).  Its
*skeleton* is that stream with immediate repetitions folded into groups
``( ... )+``.  The wrapper of a host starts as one skeleton and is aligned with
the next, over and over: the longest common subsequence of elements, slots and
groups stays (elements are aligned inside in turn, so every group is well formed),
what only one side has becomes an optional group ``( ... )?``, a run that repeats
on the other side joins its repeated group, and slots that hold different texts
are variable.  There are no disjunctions.  Where the nodes of one element are too
irregular for that (more than LONGEST_LIST after alignment) the expression is
generalised to ``( (a)? (b)? ... )*`` with one member a kind of node: it matches any
order of them, and a wrapper grows with the kinds of elements, not with the pages.

The wrapper knows for each slot its enclosing elements, how much text it has on
the whole host and whether it ever varies.  Which of them are content is decided
among the slots that a page's own skeleton fills: those of the article
(``article``, ``main``) if it has text there, else all; slots of menus, page
headers, footers, sidebars, notices, adverts, forms, comments, or - outside an
article - of text that is the same on every page (whole, and not because the pages
are copies) are not content.  Nothing is left out for having little text.

A class or id names chrome only if all its words do (``ad-slot``, ``related-links``).
If some do (``share-price-report``, ``banner-image-caption``) the name is a hint, and
the wrapper decides: such an element is chrome where its text is template text of
the host, also inside an article, else content.

Pages only meet their host's wrapper through the host's distinct skeletons:
Spark counts those with a partial aggregate, infers wrappers in a tree (about
FAN expressions a group, as many rounds as the host with most skeletons needs), and
joins the verdicts back to the pages' text blocks.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflictlake.llm.common import map_arrow, refuse_clash, settled
from conflictlake.llm.url_cascade import host_of

FAN = 32  # expressions that one group of the tree aligns
DEEPEST = 120
LONGEST_UNIT = 24  # tokens of a repeated group
LONGEST_LIST = 64  # nodes of one element of a wrapper; longer lists are generalised
SAME_ON = 3  # pages on which a text must be the same to be template text

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template noframes xmp".split())
NO_END = set("p li dt dd tr td th option optgroup thead tbody tfoot rt rp".split())
ENDED_BY = {t: {t} for t in NO_END} | {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "p": {"p"},
                                       **{t: {"tr", "td", "th", "thead", "tbody", "tfoot"} for t in ("thead", "tbody", "tfoot")}}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())

DROPPED = set("head nav menu aside form dialog button select svg canvas object audio video map footer".split()) | RAW
ARTICLE = {"article", "main"}
MARKS = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination"
            " notice notices cookie cookies consent gdpr popup modal newsletter subscribe comment comments reply replies respond disqus share sharing social related"
            " recommended widget footer masthead skip".split())
WHOLE = set("header site-header page-header site-footer page-footer top-bar topbar".split())  # marks only as a whole name
BESIDE = set("area bar block body bottom box btn button buttons center close col column container content form group head heading icon icons inner item items left link links"
             " list main outer panel right row section signup site slot space text title top unit wrap wrapper".split())  # words that do not change what a mark says
NOT = {"no", "has", "with", "without", "free"}  # beside a mark: a property of the page, not an advert or sidebar
NEVER = {"html", "body", "main"}
ROLES = set("navigation banner contentinfo complementary search menu menubar alert dialog".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)
_NAMES = re.compile(r"[A-Za-z]+")


def _marked(attrs: str) -> str:
    """"!" for an element that its attributes make page chrome, "~" if a class or id hints at it, else ""."""
    hint = ""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return "!"
        if name == "role" and value.lower() in ROLES:
            return "!"
        if name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _NAMES.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", one))]
                if one.lower() in WHOLE:
                    return "!"
                if any(w in MARKS for w in words) and not any(w in NOT for w in words):
                    if all(w in MARKS or w in BESIDE for w in words):
                        return "!"
                    hint = "~"
    return hint


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """("tag", name) with a leading / for ends, the letters of class and id, a trailing ! or ~ for marked elements; ("text", raw text)."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:]
            return
        if m.start() > at:
            yield "text", page[at:m.start()]
        at = m.end()
        end, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if not end and name in RAW and not attrs.endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if end:
            yield "tag", "/" + name
            continue
        label = "".join("." + re.sub(r"[^a-z]+", "-", v.strip("\"'").lower())[:40] for a, v in _ATTR.findall(attrs) if a.lower() in ("class", "id")) if attrs else ""
        yield "tag", name + label + (_marked(attrs) if attrs and name not in NEVER else "")


def blocks_of(page: str) -> list:
    """The page's elements and text blocks: ["e", tag, nodes] and ["#", text].

    Inline markup is part of the text around it, white space one space.  Elements
    without end tags end where HTML ends them, open ones with the page; what is
    nested deeper than DEEPEST belongs to the element at that depth.
    """
    root: list = ["e", "", []]
    stack, text, deeper = [root], [], 0

    def flush():
        said = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if said:
            stack[-1][2].append(["#", said])

    def name_of(node):
        return node[1].split(".")[0].rstrip("!~")

    for kind, value in tokens(page):
        if kind == "text":
            text.append(value)
            continue
        end = value.startswith("/")
        name = value.lstrip("/").split(".")[0].rstrip("!~")
        if name in INLINE and not value.endswith(("!", "~")):
            if name == "br":
                text.append(" ")
            continue
        flush()
        if name in VOID:
            continue
        if deeper and name not in NO_END:
            deeper += -1 if end else 1
            continue
        if end:
            at = next((i for i in range(len(stack) - 1, 0, -1) if name_of(stack[i]) == name), 0)
            if at and not (name in NO_END and any(name_of(x) not in NO_END for x in stack[at:])):
                del stack[at:]
            continue
        while len(stack) > 1 and (name_of(stack[-1]) == "p" or (name in NO_END and name_of(stack[-1]) in ENDED_BY[name])):
            stack.pop()
        if len(stack) > DEEPEST:
            deeper += name not in NO_END
            continue
        node = ["e", value, []]
        stack[-1][2].append(node)
        stack.append(node)
    flush()
    return root[2]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()) >> 1


# A node is ["e", tag, nodes], a slot ["#", characters, least hash, greatest hash, pages, origins, least page, greatest page] (hashes of its text
# and of the text of its pages) or a group ["+" or "?" or "*", nodes].

def key(node: list) -> str:
    if node[0] == "e":
        return f"<{node[1]}>{''.join(map(key, node[2]))}</>"
    if node[0] == "#":
        return "#"
    return f"({''.join(map(key, node[1]))}){node[0]}"


def _kind(node: list) -> str:
    """What must agree for two nodes to be aligned: an element's tag; of a group, its members."""
    return f"<{node[1]}>" if node[0] == "e" else "#" if node[0] == "#" else f"({''.join(map(_kind, node[1]))})"


def merged(a: list, b: list) -> list:
    """Two nodes of equal kind as one; slots add up."""
    if a[0] == "e":
        return ["e", a[1], align(a[2], b[2])]
    if a[0] == "#":
        return ["#", a[1] + b[1], min(a[2], b[2]), max(a[3], b[3]), a[4] + b[4], a[5] + b[5], min(a[6], b[6]), max(a[7], b[7])]
    signs = {a[0], b[0]}
    sign = a[0] if len(signs) == 1 else "*" if "*" in signs or signs == {"+", "?"} else a[0]
    return [sign, [merged(x, y) for x, y in zip(a[1], b[1])]]


def fold(nodes: list) -> list:
    """Immediate repetitions of up to LONGEST_UNIT nodes become repeated groups, short units first."""
    keys = [key(x) for x in nodes]
    width = 1
    while width <= min(LONGEST_UNIT, len(nodes) // 2):
        i, out, out_keys = 0, [], []
        while i < len(nodes):
            unit = keys[i:i + width]
            times = 1
            if len(unit) == width and unit[0][0] == "<":
                while keys[i + times * width:i + (times + 1) * width] == unit:
                    times += 1
            if times > 1:
                group = nodes[i:i + width]
                for t in range(1, times):
                    group = [merged(x, y) for x, y in zip(group, nodes[i + t * width:i + (t + 1) * width])]
                out.append(["+", group])
                out_keys.append(key(out[-1]))
                i += times * width
            else:
                out.append(nodes[i])
                out_keys.append(keys[i])
                i += 1
        nodes, keys = out, out_keys
        width += 1
    return nodes


def _joined(nodes: list, groups: list) -> list:
    """``nodes`` with each run like the members of one of ``groups`` put into a group of that kind."""
    for sign, unit in groups:
        want, n = [_kind(x) for x in unit], len(unit)
        out, i = [], 0
        while i < len(nodes):
            got, times = None, 0
            while [_kind(x) for x in nodes[i + times * n:i + (times + 1) * n]] == want:
                part = nodes[i + times * n:i + (times + 1) * n]
                got = part if got is None else [merged(x, y) for x, y in zip(got, part)]
                times += 1
                if sign == "?":
                    break
            if got:
                out.append([sign, got])
                i += times * n
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _members(nodes: list) -> Iterator[list]:
    """Elements and slots of a list, those in groups too."""
    for n in nodes:
        if n[0] in "+?*":
            yield from _members(n[1])
        else:
            yield n


def _long(nodes: list) -> bool:
    return sum(1 for _ in _members(nodes)) > LONGEST_LIST


def _general(nodes: list) -> bool:
    return len(nodes) == 1 and nodes[0][0] == "*" and len(nodes[0][1]) > 1 and all(n[0] == "?" and len(n[1]) == 1 for n in nodes[0][1])


def generalised(nodes: list) -> list:
    """``( (a)? (b)? ... )*``: any sequence of the kinds of nodes that a list has, one member a kind."""
    by_kind: dict[str, list] = {}
    for n in _members(nodes):
        k = _kind(n)
        by_kind[k] = merged(by_kind[k], n) if k in by_kind else n
    kinds = sorted(by_kind)
    return [["*", [["?", [by_kind[k]]] for k in kinds] if len(kinds) > 1 else [by_kind[kinds[0]]]]]


def align(a: list, b: list) -> list:
    """The union-free expression of both: common nodes stay, the rest becomes optional."""
    if _general(a) or _general(b) or _long(a) or _long(b):
        return generalised(a + b)
    out = _aligned(a, b)
    return generalised(out) if _long(out) else out


def _aligned(a: list, b: list) -> list:
    a = _joined(a, [(n[0], n[1]) for n in b if n[0] in "+?*"])
    b = _joined(b, [(n[0], n[1]) for n in a if n[0] in "+?*"])
    ka, kb = [_kind(x) for x in a], [_kind(x) for x in b]
    lo = 0
    while lo < min(len(ka), len(kb)) and ka[lo] == kb[lo]:
        lo += 1
    hi = 0
    while hi < min(len(ka), len(kb)) - lo and ka[-1 - hi] == kb[-1 - hi]:
        hi += 1
    na, nb = len(ka) - lo - hi, len(kb) - lo - hi
    best = np.zeros((na + 1, nb + 1), np.int32)
    for i in range(na - 1, -1, -1):
        for j in range(nb - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if ka[lo + i] == kb[lo + j] else max(best[i + 1, j], best[i, j + 1])
    out, only_a, only_b = [merged(x, y) for x, y in zip(a[:lo], b[:lo])], [], []

    def flush():
        for part in (only_a, only_b):
            if len(part) == 1 and part[0][0] in "+?*":
                out.append(["*" if part[0][0] == "+" else part[0][0], part[0][1]])
            elif part:
                out.append(["?", part[:]])
            part.clear()

    i = j = 0
    while i < na or j < nb:
        if i < na and j < nb and ka[lo + i] == kb[lo + j]:
            flush()
            out.append(merged(a[lo + i], b[lo + j]))
            i, j = i + 1, j + 1
        elif j >= nb or (i < na and best[i + 1, j] >= best[i, j + 1]):
            only_a.append(a[lo + i])
            i += 1
        else:
            only_b.append(b[lo + j])
            j += 1
    flush()
    return out + ([merged(x, y) for x, y in zip(a[-hi:], b[-hi:])] if hi else [])


def expression(nodes: list) -> str:
    """The wrapper as a regular expression over tags and text slots."""
    return "".join(map(key, nodes))


def skeleton(nodes: list) -> tuple[list, list[tuple[int, str]]]:
    """(folded nodes, text blocks as (slot, text) in page order); slots are numbered in the folded order."""
    texts: list[str] = []

    def number(part):  # innermost lists are folded first
        out = []
        for n in part:
            if n[0] == "#":
                out.append(["#", len(n[1]), *[_hash(n[1])] * 2, 1, [len(texts)], 0, 0])
                texts.append(n[1])
            else:
                out.append(["e", n[1], number(n[2])])
        return fold(out)

    folded = number(nodes)
    place = {i: s for s, node in enumerate(slots(folded)) for i in node[5]}
    return folded, [(place[i], t) for i, t in enumerate(texts)]


def slots(nodes: list) -> Iterator[list]:
    for n in nodes:
        if n[0] == "#":
            yield n
        else:
            yield from slots(n[-1])


def placed(nodes: list, path: tuple = ()) -> Iterator[tuple[list, tuple]]:
    """Each slot with the tags of the elements around it."""
    for n in nodes:
        if n[0] == "#":
            yield n, path
        elif n[0] == "e":
            yield from placed(n[2], (*path, n[1].split(".")[0].rstrip("!~") + (n[1][-1] if n[1].endswith(("!", "~")) else "")))
        else:
            yield from placed(n[1], path)


def _barred(path: tuple) -> bool:
    """Whether a slot is page chrome by the elements around it."""
    return any(x.endswith("!") or x.rstrip("~") in DROPPED for x in path) or (any(x.rstrip("~") == "header" for x in path) and not any(x.rstrip("~") in ARTICLE for x in path))


def page_of(folded: list, said: list[tuple[int, str]]) -> int:
    """Hash of a page's text without its chrome: equal for copies of one page."""
    barred = [_barred(path) for _, path in placed(folded)]
    return _hash("\n".join(t for s, t in said if not barred[s]))


def content(nodes: list) -> list[bool]:
    """For each slot of an expression, whether it is content of the page that fills slots of it (those with origins).

    Template text is the same on SAME_ON pages or more that are not all copies of
    one page; a host whose text never varies has none.
    """
    found = list(placed(nodes))
    article = [any(e.rstrip("~") in ARTICLE for e in path) for _, path in found]
    hinted = [any(e.endswith("~") for e in path) for _, path in found]
    open_ = [not _barred(path) for _, path in found]
    same = [n[2] == n[3] and n[4] >= SAME_ON and n[6] != n[7] for n, _ in found]
    varies = any(o and n[2] != n[3] for o, (n, _) in zip(open_, found))
    ok = [bool(n[5]) and o and ((a and not h) or not (s and varies)) for (n, _), o, a, h, s in zip(found, open_, article, hinted, same)]
    if any(o and a for o, a in zip(ok, article)):
        return [o and a for o, a in zip(ok, article)]
    return ok


def _parts(pages: DataFrame, keep: list[str], url_col: str, html_col: str) -> DataFrame:
    """``keep``, host, skeleton and per slot (characters, least and greatest text hash, hash of the page), and the text blocks."""
    src = pages.select(F.col(html_col).cast("string").alias("__html"), host_of(url_col).alias("host"), *keep)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[2:])
    schema = "host string, skeleton string, stats array<array<long>>, slots array<int>, texts array<string>" + kept

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = []
                for page in part.column(0):
                    folded, said = skeleton(blocks_of(page.as_py() or ""))
                    whole = page_of(folded, said)
                    rows.append((expression(folded), [[n[1], n[2], n[3], whole] for n in slots(folded)], [s for s, _ in said], [t for _, t in said]))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.list_(pa.int64()))), pa.array(cols[2], pa.list_(pa.int32())),
                     pa.array(cols[3], pa.list_(pa.string())), *part.columns[2:]], names=["host", "skeleton", "stats", "slots", "texts", *keep])

    return map_arrow(src, read, schema)


_PART = re.compile(r"<[^>]*>|#|\(|\)[+?*]")


def parsed(expr: str, stats: list) -> list:
    """Nodes of an expression; ``stats`` are the slots' numbers (characters, hashes, pages, hashes of pages), origins are slot numbers."""
    stack, serial = [[]], 0
    for m in _PART.finditer(expr):
        t = m[0]
        if t == "#":
            s = stats[serial]
            stack[-1].append(["#", int(s[0]), int(s[1]), int(s[2]), int(s[3]), [serial], *((int(s[4]), int(s[5])) if len(s) > 4 else (0, 0))])
            serial += 1
        elif t == "(":
            stack.append([])
        elif t[0] == ")":
            nodes = stack.pop()
            stack[-1].append([t[1], nodes])
        elif t == "</>":
            stack.pop()
        else:
            stack[-1].append(["e", t[1:-1], []])
            stack.append(stack[-1][-1][2])
    return stack[0]


def skeletons(parts: DataFrame) -> DataFrame:
    """(host, skeleton, pages, stats): the distinct skeletons of each host with what Spark sums up of their slots."""
    one = parts.select("host", "skeleton", F.posexplode_outer("stats").alias("slot", "s"))
    per = one.groupBy("host", "skeleton", "slot").agg(F.count("*").alias("pages"), F.sum(F.get("s", 0)).alias("chars"), F.min(F.get("s", 1)).alias("lo"), F.max(F.get("s", 2)).alias("hi"),
                                                           F.min(F.get("s", 3)).alias("first"), F.max(F.get("s", 3)).alias("last"))
    cell = F.struct("slot", F.array("chars", "lo", "hi", "pages", "first", "last").alias("v"))
    got = per.groupBy("host", "skeleton").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list(F.when(F.col("slot").isNotNull(), cell))).alias("cells"))
    return got.select("host", "skeleton", "pages", F.col("cells.v").alias("stats"))  # a skeleton's slots: as many as one page has


def wrappers(distinct: DataFrame) -> DataFrame:
    """(host, wrapper, stats): the expression that all skeletons of a host match, inferred in a tree.

    A host of n skeletons starts with n / FAN groups; every round aligns about FAN
    groups into one.  The driver only learns the number of skeletons of the largest host.
    """
    schema = "host string, n long, cell long, wrapper string, stats array<array<long>>"

    def infer(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for expr, stats in sorted(zip(pdf["wrapper"], pdf["stats"]), key=lambda x: (len(x[0]), x[0])):
            nodes = parsed(expr, stats)
            whole = nodes if whole is None else fold(align(whole, nodes))
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "n": pdf["n"].iloc[:1], "cell": pdf["cell"].iloc[:1], "wrapper": [expression(whole)],
                             "stats": [[[*n[1:5], *n[6:]] for n in slots(whole)]]})

    sizes = distinct.groupBy(F.col("host").alias("__of")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    got = distinct.join(sizes, F.col("host").eqNullSafe(F.col("__of"))).select("host", "n", F.xxhash64("skeleton").alias("cell"), F.col("skeleton").alias("wrapper"), "stats")
    width = 1
    while True:
        width *= FAN
        got = got.withColumn("cell", F.expr(f"pmod(cell, n div {width} + 1)")).groupBy("host", "n", "cell").applyInPandas(infer, schema)
        if most < width:
            return got.select("host", "wrapper", "stats")


def verdicts(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """(host, skeleton, wanted): the content slots of each skeleton, read off the wrapper it is aligned with."""
    both = distinct.select("host", "skeleton", "stats").join(found.withColumnRenamed("stats", "of_host"), "host").select("host", "skeleton", "stats", "wrapper", "of_host")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = []
            for expr, stats, whole, of_host in zip(*(c.to_pylist() for c in b.columns[1:])):
                wrapper = parsed(whole, of_host)
                for n in slots(wrapper):
                    n[5] = []
                own = parsed(expr, [[0, s[1], s[2], 0, *s[4:]] for s in stats])
                met = align(wrapper, own)
                wanted.append(sorted(i for n, ok in zip(slots(met), content(met)) if ok for i in n[5]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(wanted, pa.list_(pa.int32()))], names=["host", "skeleton", "wanted"])

    return map_arrow(both, decide, "host string, skeleton string, wanted array<int>")


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, host, text and n_chars per page.

    Text blocks of content slots in page order, joined by a newline.  A null or
    empty page, or one without content, has an empty text.  Pages without a host
    share a wrapper.  Repeated rows are pages of their own; an empty table gives
    an empty table.  Text nested deeper than DEEPEST elements belongs to the element at
    that depth; repetitions of more than LONGEST_UNIT tokens are not folded; lists of
    more than LONGEST_LIST nodes are generalised; text is template text from SAME_ON
    pages of a host on.  None of these leaves out text of an article.  A ``keep`` column of a name that is made here is refused
    (ValueError).
    """
    keep = keep or ["page_id", "url"]
    refuse_clash(keep, "host", "skeleton", "stats", "slots", "texts", "wanted", "text", "n_chars", "__html", "h", "k")
    parts = settled(_parts(pages, keep, url_col, html_col), "parts")
    distinct = settled(skeletons(parts), "skeletons")
    found = settled(wrappers(distinct), "wrappers")
    decided = settled(verdicts(distinct, found).select(F.col("host").alias("h"), F.xxhash64("skeleton").alias("k"), "wanted"), "verdicts")
    at = parts.withColumn("k", F.xxhash64("skeleton")).drop("skeleton", "stats")
    met = at.join(decided, (at.host == decided.h) & (at.k == decided.k), "left")
    block = F.transform(F.filter(F.arrays_zip("slots", "texts"), lambda x: F.array_contains("wanted", x["slots"])), lambda x: x["texts"])
    text = F.coalesce(F.array_join(block, "\n"), F.lit(""))
    return met.select(*keep, "host", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
