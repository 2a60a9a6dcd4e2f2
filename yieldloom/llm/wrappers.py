"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import nsmallest

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import by_batch, measured_join, pin

# Names of the markup language and of usual page furniture.
RAW = "script|style|textarea|title|noscript|template|iframe|svg|annotation|annotation-xml|object|select|button|noframes|xmp"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br "
    "math semantics maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup "
    "mtable mtd mtext mtr munder munderover none".split()
)
FURNITURE = frozenset("nav footer aside form head menu dialog".split())
CLASSES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal newsletter subscribe subscription "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets footer comment comments reply replies respond share sharing social related "
    "login search skip pagination pager".split()
)
OUTSIDE = frozenset("header masthead topbar".split())
MAIN = frozenset("article main".split())
MAIN_CLASSES = frozenset("main main-content maincontent site-main".split())
#: Class names never make these furniture.
NEVER_ASIDE = frozenset("body main article".split())
#: All that a head holds besides raw elements; anything else opens the body.
HEAD_ONLY = frozenset("head meta link base basefont bgsound".split())
CLOSED_BY = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}

ATTRIBUTES = r"""(?:[^"'>]|"[^"]*"|'[^']*')*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?P<marks>{ATTRIBUTES})>"
    rf"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>{ATTRIBUTES})>|<[a-z/!?][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW.split("|")}
#: The slash of a self-closed element; one that ends a value without quotes is none.
CLOSED = re.compile(r"""(?:^|[\s"']|(?:^|\s)[^\s"'=>]+)/\Z""")
NAMED = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACES = re.compile(r"\s+")
#: A child that holds at least this share of its parent's variable text is entered in search of the main part.
SHARE = 0.6
SALTS = 64
#: Hosts whose wrappers a task keeps in memory before it hands them on, or as objects while it cuts pages.
HOSTS_HELD, WRAPPERS_HELD = 2_000, 256
#: Hosts' wrappers are broadcast up to so many characters; they are counted first.
BROADCAST_CHARS = 1 << 26
#: Text on so many pages of a host, and on all that have its element, is boilerplate; within a marked main element on so many.
#: The host must have so many pages of which none is a copy of another.
LEAST_PAGES, LEAST_PAGES_MAIN = 2, 3
#: Smallest hashes of five-word shingles kept of a page, and the share of them that copies have in common.
SKETCH, WIDTH, LIKENESS = 64, 5, 0.6
#: A page of which less than this share is left without constant text is a copy (such sets of shingles are alike at 0.8).
LEFT = 1 / 9
#: Elements deeper than this are children of the element at this depth, in page order; they keep what holds for those around them.
DEEPEST = 200


class Node:
    """An element: its signature, its own text blocks and its children in order, and digests of its text (see ``signed``)."""

    __slots__ = ("sig", "name", "words", "around", "items", "own", "whole")

    def __init__(self, sig: str, name: str, words: frozenset, around: tuple = (False, False, False)):
        #: Whether the elements around it, where they are not above it in the tree, are furniture (outside and inside of main elements) or main.
        self.around = around
        self.sig, self.name, self.words, self.items, self.own, self.whole = sig, name, words, [], "", ""


def opened(name: str, attributes: str, around: tuple = (False, False, False)) -> Node:
    named = {k.lower(): (a or b or c).lower() for k, a, b, c in NAMED.findall(attributes)} if attributes else {}
    marks = f"{named.get('class', '')} {named.get('id', '')}".strip()
    words = frozenset(w.rstrip("0123456789-_") for w in marks.split())  # whole names but for their numbers
    if named.get("role") == "main" or named.get("itemprop") == "articlebody":
        words |= {"main"}
    sig = name + "".join(f".{w}" for w in sorted(re.sub(r"\d+", "9", marks).split()))
    return Node(sig, name, words, around)


def parse(text: str) -> Node:
    """The tree of a page. Inline elements leave no trace, scripts and the like are skipped, open elements end with the page."""
    root = Node("", "", frozenset())
    stack, pieces = [root], []
    open_names: Counter = Counter()

    def flush():
        if pieces:
            block = SPACES.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if block:
                if len(stack) > DEEPEST and stack[DEEPEST - 1].items[-1] is not stack[-1]:  # it goes on behind elements inside it
                    on = stack[-1]
                    stack[-1] = Node(on.sig, on.name, on.words, on.around)
                    stack[DEEPEST - 1].items.append(stack[-1])
                stack[-1].items.append(block)

    def pop() -> str:
        name = stack.pop().name
        open_names[name] -= 1
        return name

    at = 0
    while m := TOKEN.match(text, at):
        at = m.end()
        if m["text"] is not None:
            if stack[-1].name == "head" and not m["text"].isspace():
                pop()
            pieces.append(m["text"])
        elif m["name"] is not None:
            name = m["name"].lower()
            if stack[-1].name == "head" and not m["close"] and name not in HEAD_ONLY:
                flush()
                pop()
            if name in INLINE or name == "html":
                if name == "br":
                    pieces.append(" ")
                continue
            flush()
            if m["close"]:
                if open_names[name]:
                    while pop() != name:
                        pass
                continue
            ends = CLOSED_BY.get(name)
            if ends is None and stack[-1].name == "p":
                ends = CLOSED_BY["p"]
            while ends and stack[-1].name in ends:
                pop()
            if name not in VOID:
                deep = len(stack) > DEEPEST
                node = opened(name, m["attributes"], (is_furniture(stack[-1], False), is_furniture(stack[-1], True), is_main(stack[-1])) if deep else (False, False, False))
                stack[min(len(stack), DEEPEST) - 1].items.append(node)
                if not (m["attributes"].endswith("/") and CLOSED.search(m["attributes"])):
                    stack.append(node)
                    open_names[name] += 1
        elif m["raw"] is not None:
            if not m["raw"].lower().startswith("annotation"):  # within a formula, which is inline
                flush()
            if not (m["marks"].endswith("/") and CLOSED.search(m["marks"])):
                end = RAW_ENDS[m["raw"].lower()].search(text, at)
                at = end.end() if end else len(text)
    flush()
    return root


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def signed(node: Node) -> Node:
    """Sets the digests of an element's own text and of all text below it; empty without text."""
    texts = [i for i in node.items if isinstance(i, str)]
    wholes = [i if isinstance(i, str) else signed(i).whole for i in node.items]
    node.own = "=" + digest("\n".join(texts)) if texts else ""
    node.whole = digest("\n".join(w for w in wholes if w)) if any(wholes) else ""
    return node


def is_main(node: Node) -> bool:
    return node.around[2] or node.name in MAIN or bool(node.words & MAIN_CLASSES)


def is_aside(word: str) -> bool:
    """Whether a class or id name is furniture: the whole name, or all words that make it up (cookie-banner)."""
    return word in CLASSES or (("-" in word or "_" in word) and all(w in CLASSES for w in re.split("[-_]+", word)))


def is_furniture(node: Node, inside: bool) -> bool:
    if node.around[inside]:
        return True
    if node.name in NEVER_ASIDE:
        return False
    return node.name in FURNITURE or any(map(is_aside, node.words)) or (not inside and (node.name in OUTSIDE or bool(node.words & OUTSIDE)))


# A wrapper is nested lists: [signature, optional, repeated, text, characters, furniture, children, pages, same]. ``text``
# is "" for no text, "=" and the text for the same text everywhere, "#" for a slot of any text. ``same`` has the digests
# of text that each of the ``pages`` with this element has there.
SIG, OPTIONAL, REPEATED, TEXT, CHARS, ASIDE, PARTS, PAGES, SAME = range(9)


def same_text(a: str, b: str) -> str:
    return a if a == b or not b else b if not a else "#"


def fused(a: list, b: list, again: bool = False, one_page: bool = False) -> list:
    """One expression for two with the same signature: differing texts become a slot.

    Of two pages only common text is constant; elements repeated within a page have the constant text of each.
    """
    if not one_page:
        pages, same = a[PAGES] + b[PAGES], set(a[SAME]).intersection(b[SAME])
    elif a[PAGES] == b[PAGES]:
        pages, same = a[PAGES], set(a[SAME]).union(b[SAME])
    else:
        pages, same = max((a[PAGES], a[SAME]), (b[PAGES], b[SAME]), key=lambda x: x[0])
    return [
        a[SIG], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED] or again, same_text(a[TEXT], b[TEXT]), a[CHARS] + b[CHARS], a[ASIDE],
        aligned(a[PARTS], b[PARTS], one_page), pages, same,
    ]


def folded(parts: list) -> list:
    """Tandem repeats of up to three parts become repeated groups."""
    for width in (1, 2, 3):
        out: list = []
        for part in parts:
            out.append(part)
            while len(out) >= 2 * width and all(out[-k - width][SIG] == out[-k][SIG] for k in range(1, width + 1)):
                last = out[-width:]
                del out[-width:]
                out[-width:] = [fused(a, b, True, True) for a, b in zip(out[-width:], last)]
        parts = out
    return parts


def aligned(a: list, b: list, one_page: bool = False) -> list:
    """Aligns two sequences by their longest common subsequence of signatures; what one of them lacks is optional."""
    if [p[SIG] for p in a] == [p[SIG] for p in b]:
        return [fused(x, y, False, one_page) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][SIG] == b[j][SIG] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][SIG] == b[j][SIG]:
            out.append(fused(a[i], b[j], False, one_page))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][SIG], True, *a[i][REPEATED:]])
            i += 1
        else:
            out.append([b[j][SIG], True, *b[j][REPEATED:]])
            j += 1
    return folded(out)


def expression(node: Node, inside: bool = False) -> list:
    """A signed page's own expression. Main elements' furniture is marked, so that its text never counts."""
    inside = inside or is_main(node)
    texts = [i for i in node.items if isinstance(i, str)]
    text = "=" + " ".join(texts) if texts else ""
    if len(text) > 200:
        text = "=" + digest(text)
    parts = folded([expression(i, inside) for i in node.items if isinstance(i, Node)])
    return [node.sig, False, False, text, sum(map(len, texts)), is_furniture(node, inside), parts, 1, {d for d in (node.own, node.whole) if d}]


def variable(part: list) -> int:
    """Characters in text slots outside of furniture."""
    return 0 if part[ASIDE] else (part[CHARS] if part[TEXT] == "#" or part[REPEATED] else 0) + sum(map(variable, part[PARTS]))


def region(wrapper: list) -> list[str]:
    """Signatures from the root down to the element that holds most variable text of a host's pages."""
    way, at = [], wrapper
    while True:
        total = variable(at)
        inner = max(at[PARTS], key=variable, default=None)
        if not total or inner is None or variable(inner) < SHARE * total or inner[REPEATED] or not inner[PARTS]:
            return way
        way.append(inner[SIG])
        at = inner


def dumped(wrapper: list) -> str:
    return json.dumps(wrapper, default=sorted)


def with_sets(wrapper: list) -> list:
    return [*wrapper[:PARTS], [with_sets(p) for p in wrapper[PARTS]], wrapper[PAGES], frozenset(wrapper[SAME])]


def host_of(url: Column) -> Column:
    """Host of a URL in lower case without user and port; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(url)), "^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def matched(nodes: list[Node], parts: list) -> list:
    """The part of an expression that each of these elements matches, in order; None where there is none.

    A repeated part may match again, and so may a run of repeated parts. Of all such ways the one with most matches and
    most constant text in its place is taken.
    """
    places: dict[str, list[int]] = {}
    for j, part in enumerate(parts):
        places.setdefault(part[SIG], []).append(j)
    options = [places.get(n.sig, ()) for n in nodes]
    if all(len(o) < 2 for o in options):
        return [parts[o[0]] if o else None for o in options]
    start: list[int] = []  # of the run of repeated parts that ends here
    for j, part in enumerate(parts):
        start.append(j + 1 if not part[REPEATED] else start[-1] if j and parts[j - 1][REPEATED] else j)
    best: dict[int, tuple] = {-1: (0, None)}
    for k, (node, option) in enumerate(zip(nodes, options)):
        new = dict(best)
        for j in option:
            gain = 2 + (node.whole in parts[j][SAME])
            for i, (score, way) in best.items():
                if (i < j or j >= start[i]) and (j not in new or score + gain > new[j][0]):
                    new[j] = (score + gain, (way, k, j))
        best = new
    out: list = [None] * len(nodes)
    way = max(best.values(), key=lambda b: b[0])[1]
    while way:
        way, k, j = way
        out[k] = parts[j]
    return out


def children(node: Node, part: list | None) -> dict[int, list | None]:
    """The part of each child element, by its place among the items."""
    places = [k for k, i in enumerate(node.items) if isinstance(i, Node)]
    return dict(zip(places, matched([node.items[k] for k in places], part[PARTS] if part else [])))


def constant(text: str, part: list | None, least: float) -> bool:
    """Whether all pages with this part of the expression, and at least so many, have this text there."""
    return part is not None and part[PAGES] >= least and text in part[SAME]


def blocks(node: Node, part: list | None, inside: bool, least: tuple = (float("inf"),) * 2) -> Iterator[str]:
    """Text in the slots of the expression; constant text and furniture are left out."""
    inside = inside or is_main(node)
    below, own = children(node, part), constant(node.own, part, least[inside])
    for k, item in enumerate(node.items):
        if isinstance(item, str):
            if not own:
                yield item
        elif not is_furniture(item, inside) and not constant(item.whole, below[k], least[inside]):
            yield from blocks(item, below[k], inside, least)


def mains(node: Node, part: list | None, least: float) -> Iterator[tuple[Node, list | None]]:
    """Outermost main elements outside of furniture, with their parts; an article within <main> is the main element.

    One whose whole text is constant is none.
    """
    for k, of in children(node, part).items():
        item = node.items[k]
        if not is_furniture(item, False) and not constant(item.whole, of, least):
            if is_main(item):
                yield from ([*mains(item, of, least)] if item.name != "article" else []) or [(item, of)]
            else:
                yield from mains(item, of, least)


def at_region(root: Node, wrapper: list | None, way: list[str]) -> list[tuple[Node, list | None]]:
    found = [(root, wrapper)]
    for sig in way:
        below = [(node.items[k], of) for node, part in found for k, of in children(node, part).items() if node.items[k].sig == sig]
        if not below:
            break
        found = below
    return found


def sketch(root: Node) -> list[int]:
    """The smallest hashes of the five-word shingles of a page's text outside of furniture, or of main elements that hold most of it."""
    words = " ".join(blocks(root, None, False)).split()
    main = " ".join(b for node, _ in mains(root, None, float("inf")) for b in blocks(node, None, True)).split()
    words = main if 2 * len(main) >= len(words) else words
    if not words:
        return []
    return nsmallest(SKETCH, {xxhash.xxh3_64_intdigest(" ".join(words[k : k + WIDTH]).encode("utf-8", "replace")) for k in range(max(1, len(words) - WIDTH + 1))})


def are_copies(a: list[int], b: list[int]) -> bool:
    least, both = nsmallest(SKETCH, {*a, *b}), {*a}.intersection(b)
    return sum(h in both for h in least) >= LIKENESS * len(least)


def distinct_pages(kept: list[list[int]], more: list[list[int]]) -> list[list[int]]:
    """Sketches of up to LEAST_PAGES_MAIN pages of which none is a copy of another; further ones change nothing."""
    for one in more:
        if one and len(kept) < LEAST_PAGES_MAIN and not any(are_copies(one, k) for k in kept):
            kept = [*kept, one]
    return kept


def main_text(page: str | None, wrapper: list | None, way: list[str], distinct: int = LEAST_PAGES_MAIN) -> str:
    """Blocks of a page in the text slots of its host's expression, without constant text and furniture.

    The slots are those of the marked main elements that hold variable text, or else of the host's region. Only text of
    as many ``distinct`` pages (none a copy of another, see ``distinct_pages``) can be constant. A page that would lose
    nearly all of its main text, or of all text outside of furniture, is a copy of others and keeps it.
    """
    if not page:
        return ""
    root = signed(parse(page))
    least = tuple(n if distinct >= n else float("inf") for n in (LEAST_PAGES, LEAST_PAGES_MAIN))

    def text(chosen, inside, least) -> str:
        return "\n\n".join(b for node, part in chosen for b in blocks(node, part, inside, least))

    def chosen(least) -> str:
        marked = [*mains(root, wrapper, least[1])]
        return text(marked or at_region(root, wrapper, way if distinct >= LEAST_PAGES else []), bool(marked), least)

    found, never = chosen(least), (float("inf"),) * 2
    if wrapper is None or distinct < LEAST_PAGES:
        return found
    marked = [*mains(root, wrapper, never[1])]
    every = text(marked or [(root, wrapper)], bool(marked), never)
    return found if len(found) >= LEFT * len(every) else every


def infer_wrappers(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """host, wrapper (JSON), region (JSON), distinct (pages that are no copies, up to three) for each host of ``pages``.

    Alignment folds page after page into one expression per host within each task; the tasks' expressions are then
    aligned by host and salt and last by host, so a host with a third of all pages is never one task's input.
    """

    def fold(batches):
        held: dict[str, tuple[list, list]] = {}
        for batch in batches:
            for host, page in zip(*[c.to_pylist() for c in batch.columns]):
                if page:
                    root = signed(parse(page))
                    own, (before, kept) = expression(root), held.get(host, (None, []))
                    if len(kept) < LEAST_PAGES_MAIN:
                        kept = distinct_pages(kept, [sketch(root)])
                    held[host] = (fused(before, own) if before else own, kept)
                    if len(held) > HOSTS_HELD:
                        yield handed(held)
                        held = {}
        if held:
            yield handed(held)

    def handed(held):
        data = {"host": [*held], "wrapper": [dumped(w) for w, _ in held.values()], "sketches": [json.dumps(k) for _, k in held.values()]}
        return pa.RecordBatch.from_pydict(data)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total, kept = None, []
        for w, more in sorted(zip(group["wrapper"], group["sketches"])):
            total = fused(total, json.loads(w)) if total else json.loads(w)
            kept = distinct_pages(kept, json.loads(more))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [dumped(total)], "sketches": [json.dumps(kept)]})

    schema = "host string, wrapper string, sketches string"
    partial = pages.select(host_of(F.col(url)).alias("host"), source).mapInArrow(fold, schema)
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    merged = salted.groupBy("host", "salt").applyInPandas(merge, schema).groupBy("host").applyInPandas(merge, schema)
    found = F.udf(lambda w: json.dumps(region(json.loads(w))), "string")  # once per host
    return merged.select("host", "wrapper", found("wrapper").alias("region"), F.json_array_length("sketches").alias("distinct"))


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by two line feeds, empty if none), n_chars (code points).

    Wrappers are inferred first; each page is then matched against its host's, whose slots and constant texts decide
    which blocks stay. A null or empty page has an empty text; pages without a host share one wrapper. Repeated rows give
    repeated rows, other columns are ignored; copies of one page, however many, tell nothing of constant text. Wrappers are
    inferred once, broadcast when hosts and characters were counted to be few, and joined with salt otherwise.
    """
    facts = pin(infer_wrappers(pages, url, source))
    few = facts.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0] <= BROADCAST_CHARS
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"), host_of(F.col(url)).alias("host"))

    def make():
        @lru_cache(WRAPPERS_HELD)
        def loaded(wrapper, region):
            return (with_sets(json.loads(wrapper)), json.loads(region)) if wrapper else (None, [])

        def work(ids, urls, sources, wrappers, regions, distinct):
            texts = [main_text(s, *loaded(w, r), d or 0) for s, w, r, d in zip(sources, wrappers, regions, distinct)]
            return [ids, urls, texts, [len(t) for t in texts]]

        return work

    joined = measured_join(rows, facts, "host", limit=HOSTS_HELD if few else 0)
    return by_batch(joined.select("page_id", "url", "html", "wrapper", "region", "distinct"), "page_id long, url string, text string, n_chars long", make)
