"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from one template. A first pass cuts every page into
tokens, tags with their path and text blocks with the path they stand in, and adds up per host and token what
describes its occurrence vector over the pages: pages, occurrences and two keyed
sums that are equal only for equal vectors. Tokens of a host with the same vector
form a class; classes that are large and frequent are the template, nested by their
paths. What is left between template tokens are the slots. The main slot is the deepest template
element, once on a page, that holds half of the host's text, and the article or main element around it if there is one.

A second pass takes everything in the main slot, and of what stands beside it all that the template does not write: a text
that is on every page at the same path is the template's. Menus, headers, footers, forms, scripts and the like go by their
tags. Class names only vote: an element named like a menu, an advert or comments goes unless it holds the main slot,
and its text counts towards the main slot only where too little other text is left.

Nothing is gathered per host but the template: tokens are summed with map-side
combining, so a host may hold any share of all pages. Pages meet their template by host and a salt. A host with one
distinct page has no template: such pages give the text of their article or main elements, else of the body.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.session import materialise

LEAST_CLASS = 3  # tokens of a class
FREQUENT = 0.5  # share of a host's pages a class must be on
MAIN_SHARE = 0.5  # of the host's text that the main slot must hold
UNNAMED_SHARE = 0.2  # of the host's text outside elements that are voted out, below which votes do not count
SALTS = 16  # parts of a host's pages that meet its template apart

# fixed values: names of HTML elements and usual class words
RAW = {"script", "style", "textarea", "xmp", "iframe", "noembed", "noframes", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
NOT_TEXT = set(
    "head nav header footer aside form button select option datalist script style noscript template textarea svg math "
    "canvas object audio video map menu dialog iframe title xmp noembed noframes".split()
)
NOT_TEXT_WORDS = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs "
    "header footer sidebar aside cookie cookies notice notices consent popup modal newsletter subscribe share sharing social "
    "comment comments disqus reply replies respond related form search login widget".split()
)
NEUTRAL_WORDS = set("area bar block body box col container content group inner item items link links list outer section text top bottom left right wrap wrapper".split())
STATE_WORDS = set("has with no is not js without".split())  # "has-sidebar" says something about an element, it is no sidebar
WHOLE = {"html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6"}  # never voted out by their class
HOMES = {"article", "main"}
HOLDERS = {"article", "body", "center", "div", "main", "section", "table", "tbody", "td", "tr"}  # elements that hold blocks
CLOSED_BY_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
DIGITS = re.compile(r"[0-9]+")
PARTS = re.compile(r"[a-z]+")


def votes_out(names: list[str]) -> bool:
    """Whether one of the class, id or role names of an element names an extra."""
    for name in names:
        parts = PARTS.findall(name)
        extra = [p in NOT_TEXT_WORDS for p in parts]
        if not any(extra) or parts[0] in STATE_WORDS:
            continue
        if extra[-1] or all(e or p in NEUTRAL_WORDS for e, p in zip(extra, parts)):
            return True
    return False


class Element:
    """``token`` stands for the path; ``home`` for the nearest article or main element, itself included, or else for the
    outermost element around that is named like an extra.

    ``skip``: an extra by its tag or inside one. ``voted``: named like one or inside one; inside the main slot (``inside``)
    only what is in that slot counts.
    """

    __slots__ = ("name", "token", "home", "skip", "voted", "inside", "mass", "free")

    def __init__(self, name: str, token: int, home: int | None, skip: bool, voted: bool, inside: bool):
        self.name, self.token, self.home, self.skip, self.voted, self.inside = name, token, home, skip, voted, inside
        self.mass = self.free = 0


def scan(page: str, main: int | None = None) -> Iterator[tuple[str, Element, str]]:
    """Events of a page: ("open", element, ""), ("close", element, ""), ("text", innermost element, text) and ("break", …).

    Scripts, styles and the like have no text events. Missing end tags are made up for.
    """
    root = Element("", ROOT, None, False, False, False)
    stack = [root]
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            piece = m.group()
            if piece[0] != "<" or len(piece) == 1:
                yield "text", stack[-1], piece
            continue
        name = name.lower()
        if m.group(1):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    while len(stack) > depth:
                        yield "close", stack.pop(), ""
                    break
            else:
                if name in BLOCK:
                    yield "break", stack[-1], ""
            continue
        if name in CLOSED_BY_ITSELF or name in BLOCK:
            again = {"p"} | ({name} if name in CLOSED_BY_ITSELF else set()) | ({"dt", "dd"} if name in ("dt", "dd") else set())
            stop = SCOPE.get(name, set())
            for depth in range(len(stack) - 1, 0, -1):
                inner = stack[depth].name
                if inner in again:
                    while len(stack) > depth:
                        yield "close", stack.pop(), ""
                    break
                if inner in stop or (inner in BLOCK and inner not in CLOSED_BY_ITSELF):
                    break
        label, names = name, []
        if m.group(3):
            for key, x, y, z in ATTRIBUTE.findall(m.group(3)):
                key = key.lower()
                if key in ("class", "id", "role"):
                    value = (x or y or z).lower()
                    names += value.split()
                    label += ("#" if key == "id" else ".") + DIGITS.sub("0", value)  # numbers tell pages apart, not places
        parent = stack[-1]
        token = token_of(TAG, f"{parent.token}/{label}")
        inside = parent.inside or token == main
        skip = parent.skip or (name in NOT_TEXT and not (name == "header" and parent.home is not None and not parent.voted))
        voted = name not in WHOLE and votes_out(names)
        if token != main:
            voted = voted or parent.voted
        else:
            voted = False
        home = token if name in HOMES else parent.home if parent.home is not None or not voted else token
        element = Element(name, token, home, skip, voted, inside)
        yield "open", element, ""
        if name in VOID or m.group(3).endswith("/"):
            yield "close", element, ""
        elif name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
            stack.append(element)
        else:
            stack.append(element)
    while len(stack) > 1:
        yield "close", stack.pop(), ""


def blocks(page: str, main: int | None = None, events: Iterator | None = None) -> Iterator[tuple[str, Element]]:
    """(text, innermost element where it begins) of every non-empty block, in page order.

    Character references are decoded, white space runs become one blank.
    """
    parts: list[str] = []
    where: Element | None = None

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                yield text, where

    for kind, element, text in scan(page, main) if events is None else events:
        if kind == "text":
            if not parts:
                where = element
            elif (element.skip, element.voted) != (where.skip, where.voted):  # an inline extra ends the block's text
                yield from flush()
                where = element
            parts.append(text)
            continue
        if element.name == "br" and kind == "open":
            if parts:
                parts.append(" ")
            continue
        if kind == "break" or element.name in BLOCK:
            yield from flush()
    yield from flush()


def token_of(kind: str, text: str) -> int:
    return int.from_bytes(blake2b(f"{kind}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


TAG, TEXT, PAGE = "tag", "text", "page"
ROOT = token_of(PAGE, "")
TOKENS = "host string, token long, kind int, depth int, home long, pages long, occurrences long, one long, two long, mass long, free long, least long, most long"
_TOKENS = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in TOKENS.split(", ")])
IS_PAGE, IS_TAG, IS_TEXT = 0, 1, 2


def text_token(text: str, where: Element) -> int:
    return token_of(TEXT, f"{where.token}/{text}")


def page_tokens(page: str) -> dict[int, list]:
    """Per token of a page: kind, depth, home, occurrences, characters of text in it, and of those outside elements voted out."""
    events = list(scan(page))
    found: dict[int, list] = {ROOT: [IS_PAGE, 0, None, 1, 0, 0]}
    open_at: list[Element] = []
    # text counts where its block begins, and flows to the elements around when they close
    for text, where in blocks(page, events=iter(events)):
        found.setdefault(text_token(text, where), [IS_TEXT, 0, None, 0, 0, 0])[3] += 1
        if not where.skip:
            where.mass += len(text)
            where.free += 0 if where.voted else len(text)
            if where.token == ROOT:
                found[ROOT][4] += len(text)
                found[ROOT][5] += len(text)
    for kind, element, _ in events:
        if kind == "open" and element.name not in VOID:
            open_at.append(element)
            holds = element.home if element.name in HOLDERS else None
            depth = len(open_at) if element.name in HOLDERS else -1
            found.setdefault(element.token, [IS_TAG, depth, holds, 0, 0, 0])[3] += 1
        elif kind == "close" and open_at and open_at[-1] is element:
            open_at.pop()
            seen = found[element.token]
            seen[4] += element.mass
            seen[5] += element.free
            if open_at:
                open_at[-1].mass += element.mass
                open_at[-1].free += element.free
            else:
                found[ROOT][4] += element.mass
                found[ROOT][5] += element.free
    return found


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, host and token: what the occurrence vector adds up to."""
    for batch in batches:
        sums: dict[tuple[str, int], list] = {}
        for host, key, page in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html"))):
            page = page or ""
            key &= (1 << 62) - 1
            digest = token_of(PAGE, page)
            for token, (kind, depth, home, n, mass, free) in page_tokens(page).items():
                s = sums.get((host, token))
                if s is None:
                    s = sums[(host, token)] = [kind, depth, home, 0, 0, 0, 0, 0, 0, digest, digest]
                s[3] += 1
                s[4] += n
                s[5] += n * (key & 0x7FFFFFFF)
                s[6] += n * (key >> 31)
                s[7] += mass
                s[8] += free
                s[9], s[10] = min(s[9], digest), max(s[10], digest)
        columns = [[h for h, _ in sums], [t for _, t in sums], *zip(*sums.values())] if sums else [[]] * len(_TOKENS)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TOKENS)], schema=_TOKENS)


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, written): the main slot and the text tokens of the template; pages: host, key, html.

    Hosts with less than two distinct pages have neither.
    """
    sums = ("pages", "occurrences", "one", "two", "mass", "free")
    tokens = materialise(
        pages.mapInArrow(_token_batches, TOKENS)
        .groupBy("host", "token")
        .agg(
            *[F.max(c).alias(c) for c in ("kind", "depth", "home")],
            *[F.sum(c).alias(c) for c in sums],
            F.min("least").alias("least"),
            F.max("most").alias("most"),
        )
        .where("pages > 1")
    )
    hosts = tokens.where(f"kind = {IS_PAGE} and least < most").select(
        "host", F.col("pages").alias("of"), (F.col("free") >= UNNAMED_SHARE * F.col("mass")).alias("by_free"), F.col("mass").alias("whole"), F.col("free").alias("whole_free")
    )
    frequent = tokens.where(f"kind <> {IS_PAGE}").join(hosts, "host").where(F.col("pages") >= FREQUENT * F.col("of"))
    vector = ["host", "pages", "occurrences", "one", "two"]
    valid = frequent.groupBy(*vector).agg(F.count(F.lit(1)).alias("tokens")).where(f"tokens >= {LEAST_CLASS}")
    template = frequent.join(valid, vector)
    holds = F.when(F.col("by_free"), F.col("free")).otherwise(F.col("mass"))
    needed = F.when(F.col("by_free"), F.col("whole_free")).otherwise(F.col("whole"))
    once = (F.col("occurrences") == F.col("pages")) & (holds > 0) & (holds >= MAIN_SHARE * needed)
    slots = template.where((F.col("kind") == IS_TAG) & (F.col("depth") > 0) & once)
    main = slots.groupBy("host").agg(F.max_by(F.coalesce("home", "token"), F.struct("depth", holds, "token")).alias("main"))
    written = frequent.where((F.col("kind") == IS_TEXT) & (F.col("pages") == F.col("of")))
    written = written.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("written"))  # at most the blocks of one page
    return hosts.select("host").join(main, "host", "left").join(written, "host", "left")


def main_text(page: str | None, main: int | None = None, written: frozenset[int] = frozenset()) -> str:
    """The blocks of the main slot and those beside it that the template does not write, one per line."""
    found = [(text, where) for text, where in blocks(page or "", main) if not where.skip]
    if main is not None:
        taken = [t for t, w in found if not w.voted and (w.inside or text_token(t, w) not in written)]
        if taken:
            return "\n".join(taken)
    named = [(t, w) for t, w in found if not w.voted]
    return "\n".join([t for t, w in named if w.home is not None] or [t for t, _ in named] or [t for t, _ in found])


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            main_text(page, main, frozenset(written or ()))
            for page, main, written in zip(*(batch.column(c).to_pylist() for c in ("html", "main", "written")))
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of ``df``.

    A null or empty page has an empty text. Pages without a url share the empty host. Repeated rows are
    answered each. Further columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumns({"host": host_of("url"), "key": F.xxhash64("page_id", "url")})
    known = materialise(templates(rows.select("host", "key", "html")))
    # a host may hold a third of all pages: they meet its template in parts
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))
    kind = dict(rows.dtypes)["page_id"]
    found = rows.join(known, ["host", "salt"], "left").mapInArrow(_text_batches, f"page_id {kind}, url string, text string, n_chars long")
    return found.toDF(id_col, url_col, "text", "n_chars")
