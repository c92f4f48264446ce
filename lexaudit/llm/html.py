"""HTML extraction by equivalence-class template deduction.

1. Pages become tokens: element entries (an element's path of names with their class words), for
   elements that can hold an article also each entry by its turn (the second ``div`` of a path), and
   text blocks (path and text). Pages of a host that are equal count once.
2. A token's occurrence vector holds its number on each page of the host. It is kept as support and an
   order-free 64-bit fingerprint of (page, number) pairs, which merges like a sum does. Tokens of a host
   with equal vectors form an equivalence class, if they are on ``MIN_SHARE`` of its pages at least and
   on ``MIN_PAGES``. Entries by turn count only where a path has the same number of them on all pages.
3. A class is valid if it is ordered: on most of the pages that have it, its tokens come in the same
   order, and, if they repeat, all of them in each round. A second pass over the tokens finds each
   class's orders and the place in the host's frame (the class on most pages that doesn't repeat) where
   it stands; one that is all in one place is nested there. Classes that are not ordered are dropped.
4. Valid classes make the host's template: its elements, its constant texts, and the slots between
   them. The main slot is the template's element that holds the article: the outermost ``article`` or
   ``main``, else the deepest with ``MAIN_SHARE`` of the text that is not constant and not in an element
   that is named or tagged as something else. An element with most of the text is never such a one.
5. A page's text is what fills the main slot, without the template's other elements inside it. Text that
   all pages of a host share inside the slot stays: it is the articles' own (a dateline, a licence, a paragraph
   told twice). Elements of which the template knows nothing go by their tag, role or names.
   Pages that lack the main slot, and hosts with too few pages, are read by tags and names alone.

Hosts' templates are bounded by the size of a page. They are written to a table; the planner
broadcasts it if its files are small and joins by host with skew splitting if not.

Text rules: character references are decoded per text node, white space inside a block (``br``
and table cells included) becomes one space, blocks are trimmed and joined by one line feed.

Defined cases: null html is empty and gives an empty text; a null or host-less url counts as host
""; repeated rows stay; of orders as frequent as each other the one with the least hash counts; an
empty table gives no rows; a page of any length is read in whole by one task; other columns are
ignored, whatever their names. Truncated tags and unclosed elements are read as browsers do, as far
as blocks go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.llm.common import arrow_map, by_size, stored

MIN_SHARE = 0.5
MIN_PAGES = 3
MAIN_SHARE = 0.8

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: HTML element kinds.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe svg math canvas object select button audio video".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption thead tbody tfoot tr ul head".split()
)
_SPACED = frozenset("br td th".split())
_SLOTS = frozenset("article main section div center form body".split())
_TELLING = frozenset("nav footer aside form menu dialog head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar ad ads advert adverts advertisement advertising sponsor"
    " sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login social"
    " share sharing related recommended comment comments discussion disqus reply replies respond widget toolbar pagination pager masthead copyright".split()
)
#: Words that may stand beside one of the names above without giving an element another meaning.
_BESIDE = frozenset(
    "site page top bottom main left right global primary secondary box bar block wrap wrapper container content inner outer area section list"
    " item items link links button buttons icons group panel slot unit zone row col column text body title head header posts post articles form the of by and js".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _named(value: str) -> bool:
    """Whether a class or id says that an element is not of the article: all its words are known, one of them tells."""
    words = [w.lower() for w in _NAME_WORDS.findall(value)]
    return any(w in _NAMES for w in words) and all(w in _NAMES or w in _BESIDE for w in words)


@lru_cache(1 << 14)
def _element(name: str, raw: str) -> tuple[str, bool, bool, bool]:
    """An element's label in paths (name and class words without digits), and whether its tag, role or
    style tells that it is not of the article, its names do, or it is an article by its role."""
    attrs = {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(raw)} if raw.strip(" /") else {}
    classes = attrs.get("class", "").split()
    label = ".".join([name, *sorted({c for c in classes if not any(x.isdigit() for x in c)})])
    telling = name in _TELLING or "hidden" in attrs or attrs.get("role") in _ROLES or attrs.get("aria-hidden") == "true"
    telling |= bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))
    named = name not in ("html", "body") and any(map(_named, [*classes, attrs.get("id", "")]))
    return label, telling, named, name in ("article", "main") or attrs.get("role") == "main"


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text, seed)


@dataclass
class Page:
    """Elements in order of their start (0 is the document), and text blocks."""

    name: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    path: list[int] = field(default_factory=lambda: [0])
    turn: list[int] = field(default_factory=lambda: [1])
    telling: list[bool] = field(default_factory=lambda: [False])
    named: list[bool] = field(default_factory=lambda: [False])
    article: list[bool] = field(default_factory=lambda: [False])
    at: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str, int, int]] = field(default_factory=list)  #: element, text, characters outside links, place
    turns: dict[int, int] = field(default_factory=dict)  #: elements by path

    def chars(self) -> list[int]:
        """Characters outside links in each element and those inside it."""
        out = [0] * len(self.name)
        for e, _, n, _ in self.blocks:
            out[e] += n
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def under(self, start: list[bool]) -> list[bool]:
        """Which elements are, or are inside, one of ``start``."""
        out = list(start)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out

    def token(self, e: int, by_turn: bool = True) -> int:
        """An element's entry: by its path, or by path and turn where the path has several."""
        path = self.path[e]
        return _hash(str(self.turn[e]), path) if by_turn and self.turns[path] > 1 and self.name[e] in _SLOTS else path


def parse(html: str) -> Page:
    page = Page()
    stack: list[int] = [0]
    inline: list[tuple[str, int, bool]] = []  # open elements that are no blocks: name, depth of the stack, hidden
    held: list[str] = []
    linked = 0
    place = 0

    def flush() -> None:
        nonlocal linked, place
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                place += 1
                page.blocks.append((stack[-1], text, max(0, len(text) - linked), place))
        linked = 0

    def close(depth: int) -> None:
        flush()
        del stack[depth:]
        while inline and inline[-1][1] > depth:
            inline.pop()

    def add(text: str) -> None:
        nonlocal linked
        if inline:
            if any(h for _, _, h in inline):
                return
            if any(n == "a" for n, _, _ in inline):
                linked += len(" ".join(text.split()))
        held.append(text)

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        end = n if m is None else m.start()
        if end > at:
            text = html[at:end]
            add(unescape(text) if "&" in text else text)
        if m is None:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                held.append(" ")
            elif name in _BLOCK:
                for depth in range(len(stack) - 1, 0, -1):
                    if page.name[stack[depth]] == name:
                        close(depth)
                        break
            else:
                for depth in range(len(inline) - 1, -1, -1):
                    if inline[depth][0] == name:
                        del inline[depth:]
                        break
                if name in _SPACED:
                    held.append(" ")
            continue
        if name in _RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = found.end() if found else n
            continue
        if name in _SPACED:
            held.append(" ")
        if name in _BLOCK:
            flush()
            if name not in ("html", "body", "head"):
                for depth in range(len(stack) - 1, 0, -1):  # an open paragraph ends where a block begins
                    inner = page.name[stack[depth]]
                    if inner == "p":
                        close(depth)
                        break
                    if inner in _BLOCK:
                        break
        if name in _CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                inner = page.name[stack[depth]]
                if inner in _CLOSES[name]:
                    close(depth)
                    break
                if inner in ("ul", "ol", "dl", "table"):
                    break
        if name in _VOID and name != "hr":
            continue
        if name not in _BLOCK:
            raw = m[3]
            hidden = ("hidden" in raw or "style" in raw) and _element(name, raw)[1] and "aria-hidden" not in raw
            inline.append((name, len(stack), hidden))
            continue
        if name == "hr":
            continue
        if name == "body" and page.name[stack[-1]] == "head":
            close(len(stack) - 1)
        label, telling, named, article = _element(name, m[3])
        top = stack[-1]
        path = _hash(label, page.path[top])
        page.turns[path] = page.turns.get(path, 0) + 1
        place += 1
        for column, value in zip(
            (page.name, page.parent, page.path, page.turn, page.telling, page.named, page.article, page.at),
            (name, top, path, page.turns[path], telling or (name == "header" and not any(page.article[e] for e in stack)), named, article, place),
            strict=True,
        ):
            column.append(value)
        stack.append(len(page.name) - 1)
    flush()
    return page


def holds_article(page: Page) -> list[bool]:
    """Elements that whatever their tag or names hold the article: with over half of the text, and the
    page's heading or ``main`` (or, of forms, an ``article``)."""
    chars = page.chars()
    heading, article = ([n in names for n in page.name] for names in (("h1", "main"), ("article",)))
    for e in range(len(chars) - 1, 0, -1):
        heading[page.parent[e]] |= heading[e]
        article[page.parent[e]] |= article[e]
    return [2 * c > chars[0] and (h or (a and n == "form")) for c, h, a, n in zip(chars, heading, article, page.name, strict=True)]


def doubtful(page: Page) -> list[bool]:
    """Elements that their tag, role or names say are not of the article."""
    return [
        (t or (n and (not a or m == "article"))) and not held  # an article element may be a reader comment; main is none
        for t, n, a, m, held in zip(page.telling, page.named, page.article, page.name, holds_article(page), strict=True)
    ]


def by_rules(page: Page) -> list[str]:
    """The article's blocks by tags and names alone."""
    out = page.under(doubtful(page))
    inside = page.under([a and not o for a, o in zip(page.article, out, strict=True)])
    kept = [b for b in page.blocks if not out[b[0]]]
    return [b[1] for b in kept if inside[b[0]]] or [b[1] for b in kept]


def host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: A token on a page: its number there, its places, and, of element entries, what the template needs to know.
_TOKEN = {"token": "long", "n": "int", "whole": "int", "places": "array<int>", "tag": "string", "parent": "long", "above": "long", "chars": "long", "telling": "boolean", "named": "boolean", "article": "boolean"}
_TOKEN_DDL = ", ".join(f"{k}: {v}" for k, v in _TOKEN.items())
_TOKEN_ARROW = pa.list_(
    pa.struct([("token", pa.int64()), ("n", pa.int32()), ("whole", pa.int32()), ("places", pa.list_(pa.int32())), ("tag", pa.string()), ("parent", pa.int64()), ("above", pa.int64()), ("chars", pa.int64()),
               *((c, pa.bool_()) for c in ("telling", "named", "article"))])
)


def tokens(page: Page) -> list[dict]:
    """A page's tokens. Texts have no ``tag``; ``parent`` is the entry of the element around, ``above`` that by its
    path; ``whole`` is the number of elements with an element's path."""
    chars = page.chars()
    found: dict[int, dict] = {}
    own = [0] * len(page.name)
    for e in range(1, len(page.name)):
        own[e] = page.token(e)
        for token in dict.fromkeys((page.path[e], own[e])):
            t = found.setdefault(
                token,
                {"token": _signed(token), "n": 0, "whole": page.turns[page.path[e]], "places": [], "tag": page.name[e], "parent": _signed(own[page.parent[e]]), "above": _signed(page.path[page.parent[e]]), "chars": 0,
                 "telling": page.telling[e], "named": page.named[e], "article": page.article[e]},
            )
            t["n"] += 1
            t["places"].append(page.at[e])
            t["chars"] += chars[e]
    for e, text, n, place in page.blocks:
        t = found.setdefault(
            _hash(text, page.path[e]),
            {"token": _signed(_hash(text, page.path[e])), "n": 0, "whole": 0, "places": [], "tag": None, "parent": _signed(own[e]), "above": _signed(page.path[e]), "chars": 0, "telling": False, "named": False, "article": False},
        )
        t["n"] += 1
        t["places"].append(place)
        t["chars"] += n
    return list(found.values())


def _page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in by_size(whole, "html", 1_000_000):
            hosts, pages, found = [], [], []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                hosts.append(host(url))
                pages.append(_signed(_hash(html)))
                found.append(tokens(parse(html)))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(found, _TOKEN_ARROW)], ["host", "page", "tokens"])


def page_tokens(pages: DataFrame) -> DataFrame:
    """Each different page of a host once: host, page (its html's hash) and its tokens."""
    picked = pages.select(F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return arrow_map(picked, _page_tokens, f"host string, page long, tokens array<struct<{_TOKEN_DDL}>>").dropDuplicates(["host", "page"])


def classes(found: DataFrame, min_share: float = MIN_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """Equivalence classes by host: host, n_pages, and an array of (class, support, most, members). Classes of one
    token are not of the template, but tell what is inside what."""
    n_pages = found.groupBy(F.col("host").alias("h")).agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    rows = found.select("host", "page", F.explode("tokens").alias("t")).select("host", "page", *(f"t.{c}" for c in _TOKEN if c != "places"))
    vectors = rows.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("support"),
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
        F.max("n").alias("n"),
        (F.min("whole") == F.max("whole")).alias("steady"),
        F.max("whole").alias("whole"),
        F.min("tag").alias("tag"),
        F.min(F.struct("parent", "above")).alias("around"),
        F.sum("chars").alias("chars"),
        *(F.bool_or(c).alias(c) for c in ("telling", "named", "article")),
    )
    repeated = vectors.filter((F.col("support") >= min_pages) & (F.col("steady") | F.col("tag").isNull() | (F.col("n") > 1) | (F.col("whole") == 1)))
    frequent = repeated.join(n_pages, F.col("host") == F.col("h")).filter(F.col("support") >= min_share * F.col("n_pages"))
    member = F.struct("token", "tag", F.col("around.parent").alias("parent"), F.col("around.above").alias("above"), "chars", "telling", "named", "article")
    grouped = frequent.groupBy("host", "n_pages", "support", "vector").agg(F.max("n").alias("most"), F.sort_array(F.collect_list(member)).alias("members"))
    return grouped.groupBy("host", "n_pages").agg(F.collect_list(F.struct(F.col("vector").alias("class"), "support", "most", "members")).alias("classes"))


_ORDERS = "host string, class long, support long, most int, order long, place int, nested boolean, n long"


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each class's tokens come on each page, counted over a batch."""
    seen: dict[tuple, int] = {}

    def counted() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()]
        rows = [(*key, n) for key, n in seen.items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _ORDERS.split(", ")])

    for batch in batches:
        for r in batch.to_pylist():
            places = {t["token"]: t["places"] for t in r["tokens"]}
            of = {c["class"]: sorted((p, m) for m in c["members"] for p in places.get(m, ())) for c in r["classes"]}
            single = [c for c in r["classes"] if c["most"] == 1]
            frame = max(single, key=lambda c: (c["support"], len(c["members"]), c["class"]), default=None)
            edges = np.array([p for p, _ in of[frame["class"]]] if frame else [], np.int64)
            for c in r["classes"]:
                line = of[c["class"]]
                if not line:
                    continue
                size = len(c["members"])
                got = [t for _, t in line]
                rounds = len(got) % size == 0 and all(t == got[i % size] for i, t in enumerate(got))
                order = _signed(_hash(",".join(map(str, got[:size])))) if rounds else 0
                at = np.searchsorted(edges, [p for p, _ in line], side="right") if c is not frame else np.zeros(1, np.int64)
                key = (r["host"], c["class"], c["support"], c["most"], order, int(at[0]), bool((at == at[0]).all()))
                seen[key] = seen.get(key, 0) + 1
        if len(seen) > 10_000:
            yield counted()
            seen.clear()
    yield counted()


def valid_classes(found: DataFrame, made: DataFrame) -> DataFrame:
    """Of ``classes``, those that are ordered: host, class, n (pages in that order), place and whether it is nested there."""
    several = F.filter("classes", lambda c: F.size(c["members"]) > 1)
    slim = F.transform(several, lambda c: F.struct(c["class"].alias("class"), c["support"].alias("support"), c["most"].alias("most"), c["members"]["token"].alias("members")))
    own = F.transform("tokens", lambda t: F.struct(t["token"].alias("token"), t["places"].alias("places")))
    both = found.join(made.select(F.col("host").alias("h"), slim.alias("classes")), F.col("host") == F.col("h")).select("host", own.alias("tokens"), "classes")
    seen = arrow_map(both, _orders, _ORDERS).groupBy("host", "class", "support", "most", "order", "place", "nested").agg(F.sum("n").alias("n"))
    orders = seen.groupBy("host", "class", "support", "order").agg(F.sum("n").alias("n"), F.max_by(F.struct("place", "nested"), F.struct("n", "place")).alias("at")).filter("order != 0")
    best = orders.groupBy("host", "class", "support").agg(F.max_by(F.struct("n", "at"), F.struct("n", -F.col("order"))).alias("b"))
    return best.filter(2 * F.col("b.n") > F.col("support")).select("host", "class", F.col("b.n").alias("n"), "b.at.place", "b.at.nested")


def _template(row: dict, main_share: float) -> dict:
    """A host's main slot, the other elements of its template, and the constants outside the slot."""
    valid = {v["class"] for v in row["valid"]}
    every = {m["token"]: m for c in row["classes"] for m in c["members"] if m["tag"] is not None}
    members = [m for c in row["classes"] if c["class"] in valid for m in c["members"]]
    known = {m["token"]: m for m in members if m["tag"] is not None}
    texts = [m for m in members if m["tag"] is None]

    def around(m: dict) -> list[int]:
        """The entries around a token, from the inside out."""
        out = []
        while True:
            token = m["parent"] if m["parent"] in every else m["above"]
            if token not in every or token in out:
                return out
            out.append(token)
            m = every[token]

    line = {t: [t, *around(m)] for t, m in known.items()}
    free = {t: m["chars"] for t, m in every.items()}  # text that is not constant
    for m in texts:
        for t in around(m):
            free[t] -= m["chars"]
    whole = max((free[t] for t in known), default=0)
    heading = {x for t, m in known.items() if m["tag"] in ("h1", "main") for x in line[t]}
    article = {x for t, m in known.items() if m["tag"] == "article" for x in line[t]}
    holds = {t for t, m in known.items() if 2 * free[t] > whole and (t in heading or (t in article and m["tag"] == "form"))}
    doubt = {t for t, m in known.items() if (m["telling"] or (m["named"] and (not m["article"] or m["tag"] == "article"))) and t not in holds}
    clean = {t for t in known if not doubt.intersection(line[t])}
    rest = whole - sum(free[t] for t in doubt if not doubt.intersection(line[t][1:]))
    slots = [t for t in clean if known[t]["tag"] in _SLOTS and known[t]["tag"] != "body" and free[t] > 0]
    named = [t for t in slots if known[t]["article"] and 4 * free[t] > rest]
    heavy = [t for t in slots if free[t] >= main_share * rest]
    main = min(named, key=lambda t: (len(line[t]), -free[t], t)) if named else max(heavy, key=lambda t: (len(line[t]), free[t], -t), default=None)
    constants = [m["token"] for m in texts if main is None or main not in around(m)]
    return {"host": row["host"], "main": main, "out": sorted(doubt), "constants": sorted(constants)}


def templates(pages: DataFrame, min_share: float = MIN_SHARE, min_pages: int = MIN_PAGES, main_share: float = MAIN_SHARE) -> DataFrame:
    """Per host: ``main`` (entry of the main slot, null if none), ``out`` (other elements) and ``constants`` (texts of the template outside it)."""
    found, drop_tokens = stored(page_tokens(pages), "tokens")
    made, drop_classes = stored(classes(found, min_share, min_pages), "classes")
    valid = valid_classes(found, made).groupBy(F.col("host").alias("h")).agg(F.collect_list(F.struct("class", "n", "place", "nested")).alias("valid"))
    both = made.join(valid, F.col("host") == F.col("h")).select("host", "classes", "valid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("host", pa.string()), ("main", pa.int64()), ("out", pa.list_(pa.int64())), ("constants", pa.list_(pa.int64()))])
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_template(r, main_share) for r in batch.to_pylist()], kind)

    known, _ = stored(arrow_map(both, run, "host string, main long, out array<long>, constants array<long>"), "templates")
    drop_tokens()
    drop_classes()
    return known


def main_text(html: str, main: int | None, out: set[int]) -> str:
    """A page's article by its host's template."""
    page = parse(html)
    entry = [_signed(page.token(e)) if e else 0 for e in range(len(page.name))]
    if main is None or main not in entry:
        return "\n".join(by_rules(page))
    inside = page.under([t == main for t in entry])
    gone = page.under([i and t != main and (t in out or d) for i, t, d in zip(inside, entry, doubtful(page), strict=True)])
    return "\n".join(text for e, text, _, _ in page.blocks if inside[e] and not gone[e])


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in by_size(whole, "html", 1_000_000):
            texts = []
            for row in batch.select(["html", "main", "out"]).to_pylist():
                texts.append(main_text(row["html"], row["main"], set(row["out"] or ())))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=_OUT)


def extract(pages: DataFrame) -> DataFrame:
    """Per page (``page_id``, ``url``, ``html``): page_id, url, text, n_chars."""
    known = templates(pages).select(F.col("host").alias("t_host"), "main", "out")
    at = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"), at.alias("p_host"))
    joined = keyed.join(known, F.col("p_host") == F.col("t_host"), "left").select("page_id", "url", "html", "main", "out")
    return arrow_map(joined, _extract, "page_id long, url string, text string, n_chars long")
