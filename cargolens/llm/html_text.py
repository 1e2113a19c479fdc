"""HTML extraction: equivalence classes of tokens that same-host pages share make up a nested template.

Pages are read as tokens: elements by their path (tags with classes), and the texts between tags with
the path of their element. A token's occurrence vector says how often it occurs on each page of its host;
of equal pages one counts. Vectors are compared through their sums: pages with the token, occurrences, a
hash sum over (page, count), and a sum of places, all of which add up in any order, so each task sums its own
pages first and a hot host meets nowhere as rows.

Tokens of a host with equal vectors form an equivalence class, in the order of their mean places. A class
is valid if it is on enough of the pages, holds an element, and lies inside valid classes only: each
element around its own that is on as many pages belongs to a valid class itself. Valid classes are the
template: those once a page its frame, those of more occurrences nested in it as repeated units. A text
is the template's if it is in a valid class together with an element around it, on ``TEXT_PAGES`` pages at
least: it stands wherever that element does. A page takes part in a class only if the class' tokens stand
on it in whole cycles of the class' order; else its texts there are kept.

What the template leaves are the slots. The main one is that of ``main``, or else of ``article`` with the
elements around it that hold no side matter, where a class of the frame has such an element; on other hosts
all slots are taken in page order. In all of them side matter (menus, headers, footers, forms, notices, by
tag, role, or words of class and id) is left out, and so are blocks that are nothing but template text.
Character references are decoded, white space is one space inside a block, blocks join with one newline.

Null and empty pages give an empty text; very long pages are read whole, one at a time; unclosed tags
close with their parents; pages whose main slot is missing (or whose host has none) fall back to the
page's own main slot; tokens of equal mean place are in order of name; repeated rows give the same row
again; an empty table gives no rows. Extra columns stay in :func:`extract`, ``text`` is replaced."""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_filter, written

#: Templates up to this count are broadcast; beyond it they are joined by a shuffle.
BROADCAST_HOSTS = 20_000
#: Share of a host's pages that a template token must occur on.
SUPPORT = 0.6
#: Different pages that a text must stand on to be taken for the template's.
TEXT_PAGES = 5
#: HTML's own element classes: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section table tbody td tfoot th thead tr ul br".split())
SIDE_TAGS = frozenset("nav header footer aside form head menu dialog button select label input object embed applet".split()) | RAW
SIDE_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer header menu nav navbar navigation newsletter notice notices pager pagination popup promo promoted related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Of these words only a class or id that is the word, or a compound of it with one of the next, is side matter: a header-image is no header.
PLACE_WORDS = frozenset("header footer banner menu toolbar notice notices copyright widget pagination pager reply replies social".split())
PLACE_LEADS = frozenset("site page main top bottom global nav cookie".split())
SIDE_ROLES = frozenset("banner navigation complementary contentinfo search form alert dialog menu menubar toolbar".split())
#: An element that opens inside an open one of these closes it first.
CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
_SCOPES = frozenset("ul ol dl table article section div main body td th blockquote".split())
_ENDS_P = BLOCK - {"br", "body", "html"} - frozenset("td th tr tbody thead tfoot".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_SPACE = re.compile(r"\s+")


def side(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element holds side matter by its tag, role, or a word of its class or id."""
    if tag in SIDE_TAGS or attrs.get("role", "").lower() in SIDE_ROLES or "hidden" in attrs:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    for name in (n for k in ("class", "id") if k in attrs for n in attrs[k].lower().split()):
        parts = [w for w in re.split(r"[^a-z]+", name) if w]
        for w in parts:
            if w in SIDE_WORDS and (w not in PLACE_WORDS or len(parts) == 1 or PLACE_LEADS.intersection(parts)):
                return True
    return False


def read(page: str) -> Iterator[tuple[str, str, object]]:
    """("open", tag, attrs), ("close", tag, None), ("text", raw, None) and ("void", tag, attrs) in page order; raw elements give no text."""
    at, n = 0, len(page)
    stack: list[str] = []

    def close(names: frozenset[str] | tuple, scopes: frozenset[str] = frozenset()) -> list[str]:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in names:
                gone = stack[i:][::-1]
                del stack[i:]
                return gone
            if stack[i] in scopes:
                break
        return []

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            yield "text", page[at:], None
            break
        if m.start() > at:
            yield "text", page[at : m.start()], None
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            for t in close((tag,)):
                yield "close", t, None
            continue
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(m.group(3))} if m.group(3).strip(" /") else {}
        if tag in VOID:
            yield "void", tag, attrs
            continue
        if tag in _ENDS_P:
            for t in close(("p",), _SCOPES):
                yield "close", t, None
        if tag in CLOSES and tag != "p":
            for t in close(CLOSES[tag], _SCOPES - CLOSES[tag]):
                yield "close", t, None
        yield "open", tag, attrs
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            yield "close", tag, None
            continue
        stack.append(tag)
    for t in stack[::-1]:
        yield "close", t, None


def _name(tag: str, attrs: dict[str, str]) -> str:
    return f"{tag}.{'.'.join(sorted(attrs['class'].split()))}" if attrs.get("class") else tag


def _text_key(path: str, text: str) -> str:
    return xxhash.xxh3_64_hexdigest(f"{path}\n{text}".encode("utf-8", "replace"))


def _plain(raw: str) -> str:
    return _SPACE.sub(" ", html.unescape(raw)).strip()


def slots(page: str, texts: bool = False) -> dict[str, list]:
    """Of a page, by token: [occurrences, text characters outside links and side matter, side, place of the first].

    A token is an element's path or, with ``texts``, a text outside side matter: path, a line end, and a hash."""
    out: dict[str, list] = {}
    path: list[str] = []
    flags: list[tuple[bool, bool]] = []
    place = 0
    for kind, x, attrs in read(page):
        if kind == "open":
            path.append(f"{path[-1]}/{_name(x, attrs)}" if path else _name(x, attrs))
            was = flags[-1] if flags else (False, False)
            flags.append((was[0] or side(x, attrs), was[1] or x == "a"))
            out.setdefault(path[-1], [0, 0, flags[-1][0], place])[0] += 1
            place += 1
        elif kind == "close":
            if path:
                path.pop()
                flags.pop()
        elif kind == "text" and path and not flags[-1][0] and (n := len(x.strip())):
            if not flags[-1][1]:
                for p in path:
                    out[p][1] += n
            if texts:
                out.setdefault(f"{path[-1]}\n{_text_key(path[-1], _plain(x))}", [0, 0, False, place])[0] += 1
                place += 1
    return out


class Token(NamedTuple):
    """A token's sums over a host's pages."""

    name: str
    pages: int
    occurrences: int
    vector: int
    chars: int
    side: bool
    place: float

    @property
    def path(self) -> str:
        return self.name.split("\n")[0]

    @property
    def is_text(self) -> bool:
        return "\n" in self.name


def _around(path: str) -> Iterator[str]:
    """The paths of the elements around an element, the outermost first."""
    at = path.find("/")
    while at >= 0:
        yield path[:at]
        at = path.find("/", at + 1)


def classes(tokens: list[Token], pages: int) -> list[list[Token]]:
    """Valid equivalence classes of a host, the outermost first, each in order of its tokens' mean places."""
    by_vector: dict[tuple, list[Token]] = {}
    for t in tokens:
        if t.pages >= SUPPORT * pages:
            by_vector.setdefault((t.pages, t.occurrences, t.vector), []).append(t)
    framed = [sorted(c, key=lambda t: (t.place / t.pages, t.name)) for c in by_vector.values() if any(not t.is_text for t in c)]
    framed.sort(key=lambda c: min(t.path.count("/") for t in c if not t.is_text))
    valid: set[str] = set()
    out = []
    for c in framed:
        own = {t.path for t in c if not t.is_text}
        # every element around the class is in a valid class already, or in this one
        if all(p in valid or p in own for path in own for p in _around(path)):
            valid |= own
            out.append(c)
    return out


def pick(found: list[list[Token]]) -> tuple[str, int] | None:
    """The main slot, of a host's valid classes, and the number of the frame's tokens; an empty slot is the whole page."""
    valid = [t for c in found for t in c if not t.is_text]
    once = [t for t in valid if not t.side and t.occurrences <= 1.5 * t.pages and t.chars > 0]
    for tag in ("main", "article"):
        if named := [t for t in once if t.name.rsplit("/", 1)[-1].split(".")[0] == tag]:
            slot = max(named, key=lambda t: (t.chars, t.name)).name
            while tag == "article" and "/" in slot:
                above = slot.rsplit("/", 1)[0]
                if any(t.side and t.name.startswith(above + "/") and not t.name.startswith(slot + "/") for t in valid):
                    break
                slot = above
            return slot, len(once)
    return ("", len(once)) if once else None


def template_texts(found: list[list[Token]]) -> list[tuple[list[str], list[str]]]:
    """Of the classes that hold texts of the template: their tokens in order, and those texts' hashes."""
    out = []
    for c in found:
        own = {t.path for t in c if not t.is_text}
        texts = [t.name.split("\n")[1] for t in c if t.is_text and t.pages >= TEXT_PAGES and (t.path in own or any(p in own for p in _around(t.path)))]
        if texts:
            out.append(([t.name for t in c if not t.is_text or t.name.split("\n")[1] in texts], texts))
    return out


def takes_part(page: str, order: list[str]) -> bool:
    """Whether a class' tokens stand on a page in whole cycles of their order; a page without any takes no part."""
    want = {name: i for i, name in enumerate(order)}
    seen = 0
    path: list[str] = []
    side_at: list[bool] = []
    for kind, x, attrs in read(page):
        name = None
        if kind == "open":
            path.append(f"{path[-1]}/{_name(x, attrs)}" if path else _name(x, attrs))
            side_at.append(bool(side_at and side_at[-1]) or side(x, attrs))
            name = path[-1]
        elif kind == "close" and path:
            path.pop()
            side_at.pop()
        elif kind == "text" and path and not side_at[-1] and x.strip():
            name = f"{path[-1]}\n{_text_key(path[-1], _plain(x))}"
        if name in want:
            if want[name] != seen % len(order):
                return False
            seen += 1
    return bool(seen) and seen % len(order) == 0


def blocks(page: str, slot: str | None, template: frozenset[str] = frozenset()) -> list[str]:
    """The blocks of text in the slots of that path (all slots if None), without side matter and blocks of the template's texts alone."""
    out: list[str] = []
    now: list[str] = []
    own = False
    path: list[str] = []
    flags: list[tuple[bool, bool]] = []

    def end() -> None:
        nonlocal own
        # references are decoded here, so that one cut by nothing but a tag stays as it stands
        if own and (text := _SPACE.sub(" ", "".join(now)).strip()):
            out.append(text)
        now.clear()
        own = False

    for kind, x, attrs in read(page):
        if kind == "open":
            path.append(f"{path[-1]}/{_name(x, attrs)}" if path else _name(x, attrs))
            was = flags[-1] if flags else (slot is None, False)
            flags.append((was[0] or path[-1] == slot, was[1] or side(x, attrs)))
            if x in BLOCK:
                end()
        elif kind == "close":
            if x in BLOCK:
                end()
            if path:
                path.pop()
                flags.pop()
        elif kind == "void":
            if x in BLOCK:
                end()
        elif (flags[-1] if flags else (slot is None, False)) == (True, False):
            now.append(html.unescape(x))
            own = own or not template or not path or bool((text := _plain(x)) and _text_key(path[-1], text) not in template)
    end()
    return out


def main_text(page: str | None, slot: str | None, template: list[tuple[list[str], list[str]]] = ()) -> str:
    """template: ``template_texts`` of the page's host."""
    if not page:
        return ""
    if slot != "":
        own = slots(page)
        if slot is None or slot not in own or own[slot][2]:
            found = pick(classes([Token(t, 1, n, 0, chars, is_side, at) for t, (n, chars, is_side, at) in own.items()], 1))
            slot = found[0] if found else None
    texts = frozenset(t for order, some in template if takes_part(page, order) for t in some)
    return "\n".join(blocks(page, slot or None, texts))


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """A row for each host that has a template: host, slot, pages, skeleton (tokens of its frame), and template: the classes that hold texts."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = defaultdict(lambda: [0, 0, 0, 0, False, 0])
        names = ["host", "token", "pages", "occurrences", "vector", "chars", "side", "place"]

        def given() -> pd.DataFrame:
            frame = pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=names)
            sums.clear()
            return frame

        for b in batches:
            for host, page in zip(b.host, b.html, strict=True):
                # the page's part in every vector: by its content, so repeated rows count alike on any task
                mark = int.from_bytes(hashlib.blake2b((page or "").encode("utf-8", "replace"), digest_size=4).digest(), "little")
                for token, (count, chars, is_side, place) in [("", (1, 0, True, 0)), *slots(page or "", True).items()]:
                    s = sums[host, token]
                    s[0] += 1
                    s[1] += count
                    s[2] += mark * min(count, 1 << 20) & 0xFFFFFFFF
                    s[3] += chars
                    s[4] = s[4] or is_side
                    s[5] += place
                if len(sums) > 100_000:
                    yield given()
        yield given()

    hosts = pages.select(host_of(F.col("url")).alias("host"), "html").withColumn("_k", F.xxhash64("host", "html"))
    copied = written(hosts.groupBy("_k").count().where("count > 1").select("_k"), "copied-pages")
    if not copied.isEmpty():
        may = key_filter(copied)("_k")
        hosts = hosts.where(~may).unionByName(hosts.where(may).dropDuplicates(["_k"]))
    parts = hosts.select("host", "html").mapInPandas(vectors, "host string, token string, pages long, occurrences long, vector long, chars long, side boolean, place long")
    sums = [F.sum(c).alias(c) for c in ("pages", "occurrences", "vector", "chars", "place")]
    tokens = parts.groupBy("host", "token").agg(*sums, F.max("side").alias("side"))
    # only tokens on enough pages can be in a valid class, which bounds a host's list by its tags in common
    total = tokens.where("token = ''").select("host", F.col("pages").alias("all"))
    common = tokens.where("token <> ''").join(total, "host").where((F.col("pages") >= SUPPORT * F.col("all")) & ((F.col("pages") >= TEXT_PAGES) | ~F.contains("token", F.lit("\n"))))
    lists = common.groupBy("host", "all").agg(F.collect_list(F.struct("token", "pages", "occurrences", "vector", "chars", "side", "place")).alias("tokens"))

    @F.pandas_udf("struct<slot:string,skeleton:int,template:array<struct<tokens:array<string>,texts:array<string>>>>")
    def choose(lists: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for x, k in zip(lists, n, strict=True):
            found = classes([Token(t["token"], t["pages"], t["occurrences"], t["vector"], t["chars"], t["side"], t["place"]) for t in x], k)
            rows.append((*(pick(found) or (None, 0)), [{"tokens": a, "texts": b} for a, b in template_texts(found)]))
        return pd.DataFrame(rows, columns=["slot", "skeleton", "template"])

    return lists.select("host", F.col("all").alias("pages"), choose("tokens", "all").alias("x")).select("host", "pages", "x.*").where("slot is not null")


def extract(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``pages`` with ``text`` in place of ``html``."""
    known = written(templates(pages), "page-templates").select(F.col("host").alias("_host"), F.col("slot").alias("_slot"), F.col("template").alias("_template"))
    small = known.limit(broadcast_hosts + 1).count() <= broadcast_hosts
    own = [c for c in pages.columns if c not in ("html", "text")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), "html", host_of(F.col("url")).alias("_host"))
    joined = rows.join(F.broadcast(known) if small else known, "_host", "left")

    @F.pandas_udf("string")
    def text_of(html_col: pd.Series, slot: pd.Series, template: pd.Series) -> pd.Series:
        given = [[] if t is None else [(list(c["tokens"]), list(c["texts"])) for c in t] for t in template]
        return pd.Series([main_text(h, s, t) for h, s, t in zip(html_col, slot, given, strict=True)], dtype=object)

    return joined.select("_row.*", text_of("html", "_slot", "_template").alias("text"))


def report(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
