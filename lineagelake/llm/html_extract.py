"""Main text of web pages by template deduction: tags and texts that share an occurrence
vector across the pages of a host are one equivalence class, classes whose tokens keep their
order nest into the host's template, and the text is what remains in the template's main slot
(after Arasu and Garcia-Molina, 2003)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, stored, texts_of

#: HTML's elements that hold no content, that are no part of a main text, that
#: break a line of text, and that a new paragraph ends.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = set(
    "head nav footer aside form noscript iframe svg math canvas object audio video button select textarea template dialog menu".split()
)
RAW = set("script style textarea title xmp noframes".split())
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
INSIDE = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: What a part of a page differs in from page to page and is still no main text:
#: reader comments, adverts and the like, by the last word of a class, id or role, or by its
#: first.  Such a name counts only for an element that holds no headline, article or main.
LAST = set(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored comment comments commentlist disqus reply replies respond "
    "cookies consent notice notices newsletter subscribe subscription breadcrumb breadcrumbs menu nav navbar navigation sidebar pagination pager "
    "complementary contentinfo popup modal".split()
)
FIRST = set("ad ads advert adverts comment comments cookie cookies disqus respond newsletter breadcrumb breadcrumbs".split())

_WORDS = re.compile(r"[^\s_-]+")
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>?|<[a-zA-Z][^>]*\Z|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: A template token is on this share of a host's pages; hosts of fewer pages share the
#: template of all hosts; a main slot holds this share of the text outside other slots.
SUPPORT, FEW_PAGES, SHARE = 0.5, 3, 0.6
_CORE = ("article", "main", "h1")


class Node:
    """An element: its path of names and first classes, whether it is set aside for certain or
    by its name alone, whether it holds a headline, article or main, and its text's length."""

    __slots__ = ("name", "path", "block", "aside", "named", "core", "chars", "parent")

    def __init__(self, name: str, path: str, block: str, aside: bool, named: bool, parent: Node | None):
        self.name, self.path, self.block, self.aside, self.named, self.parent = name, path, block, aside, named, parent
        self.core, self.chars = False, 0


def _element(name: str, attributes: str, inside_article: bool) -> tuple[str, bool, bool]:
    """An element's template token, whether it is set aside, and whether its name says so."""
    aside = name in ASIDE or name == "header" and not inside_article
    if not attributes.strip():
        return name, aside, False
    values = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
    names = [_WORDS.findall(x.lower()) for k in ("class", "id", "role") for x in values.get(k, "").split()]
    named = any(w and (w[-1] in LAST or w[0] in FIRST) for w in names)
    first = values.get("class", "").split()
    return (f"{name}.{first[0]}" if first else name), aside or hidden, named


def parsed(html: str) -> tuple[list[tuple[str, Node | str | None]], int]:
    """What a page consists of, in order, ("open", node), ("close", node), ("text", raw text)
    and ("break", None) between blocks; and the length of its text."""
    events: list[tuple[str, Node | str | None]] = []
    stack: list[Node] = []
    skip_to = total = 0

    def close(k: int) -> None:
        while len(stack) > k:
            node = stack.pop()
            events.append(("close", node))
            if node.parent is not None:
                node.parent.chars += node.chars
            if node.name in BLOCKS:
                events.append(("break", None))

    for m in _TOKEN.finditer(html):
        if m.start() < skip_to:
            continue
        raw, name = m.group(), m.group(2)
        if name is None:
            if raw[0] != "<" or raw == "<":
                events.append(("text", raw))
                if not (stack and stack[-1].aside):
                    n = len(raw) - raw.count(" ")
                    total += n
                    if stack:
                        stack[-1].chars += n
            continue
        name = name.lower()
        if m.group(1):
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if k is not None:
                close(k)
            elif name == "p":
                events.append(("break", None))
            continue
        if name in BLOCKS:
            ends = INSIDE.get(name, {"p"} if name != "br" else set())
            k = len(stack)
            while k and stack[k - 1].name not in BLOCKS:
                k -= 1
            if k and stack[k - 1].name in ends:
                close(k - 1)
            events.append(("break", None))
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, m.end())
            skip_to = end.start() if end else len(html)
            close_at = html.find(">", skip_to) if end else -1
            skip_to = close_at + 1 if close_at >= 0 else len(html)
            continue
        up = stack[-1] if stack else None
        token, aside, named = _element(name, m.group(3), any(s.name in ("article", "main") for s in stack))
        path = (up.path + "/" if up else "") + token
        node = Node(name, path, path if name in BLOCKS else up.block if up else "", bool(up and up.aside) or aside, named and name not in ("html", "body", *_CORE), up)
        if name in _CORE and not node.aside:
            x = up
            while x is not None and not x.core:
                x.core, x = True, x.parent
            node.core = True
        stack.append(node)
        events.append(("open", node))
    close(0)
    return events, total


def walk(html: str) -> Iterator[tuple[str, Node | str | None]]:
    """The events of a page without what is set aside: ("aside", node) and its ("close", node)
    stand for such an element.  A name sets an element aside that holds no headline, article
    or main; on pages that have none of them, if it holds less than half of the text."""
    events, total = parsed(html)
    cores = any(kind == "open" and node.core for kind, node in events)
    within: Node | None = None
    for kind, node in events:
        if within is not None:
            if kind == "close" and node is within:
                within = None
                yield kind, node
            continue
        if kind == "open" and (node.aside or node.named and not node.core and (cores or 2 * node.chars < total)):
            within = node
            yield "aside", node
        else:
            yield kind, node


def _mark(text: str) -> int:
    return xxhash.xxh3_64_intdigest("".join(text.split()).encode("utf-8", "surrogatepass")) >> 1


def contents(html: str) -> tuple[list[tuple[str, str]], dict[str, list[int]]]:
    """A page's blocks of text, as path and text, and its tokens by path: occurrences, place of
    the first, characters of text below that are not set aside, and a mark of the text of
    its blocks (0 if there is none)."""
    blocks: list[tuple[str, str]] = []
    tokens: dict[str, list[int]] = {}
    stack: list[Node] = []
    parts: list[str] = []
    where = ""

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            blocks.append((where, text))
        parts.clear()

    for kind, x in walk(html):
        if kind in ("open", "aside"):
            tokens.setdefault(x.path, [0, len(tokens), 0, 0])[0] += 1
            if kind == "open":
                tokens[x.path][2] += x.chars
            stack.append(x)
        elif kind == "close":
            stack.pop()
        elif kind == "text":
            at = stack[-1].block if stack else ""
            if not parts:
                where = at
            parts.append(x)
        else:
            flush()
    flush()
    own: dict[str, list[str]] = {}
    for path, text in blocks:
        own.setdefault(path, []).append(text)
    for path, texts in own.items():
        if path in tokens:
            tokens[path][3] = _mark(" ".join(texts))
    return blocks, tokens


def _in(path: str, slot: str) -> bool:
    return path == slot or path.startswith(slot + "/")


def main_text(html: str | None, slot: str | None, fixed: Iterable[str] = ()) -> str:
    """The text of the slot ``slot`` of a page, block by block, without the blocks of the paths
    ``fixed``; of its article, main or whole body if the page lacks that slot."""
    if not html:
        return ""
    blocks, tokens = contents(html)
    own = slot if slot in tokens else own_slot(tokens)
    return "\n".join(t for p, t in blocks if (own is None or _in(p, own)) and p not in set(fixed))


def own_slot(tokens: Iterable[str]) -> str | None:
    """The first article of a page, else its first main."""
    return next((p for tag in ("article", "main") for p in tokens if re.fullmatch(rf"{tag}(\..*)?", p.rsplit("/", 1)[-1])), None)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)", 1))


_BLOCK = pa.struct([("path", pa.string()), ("text", pa.string())])
_SEEN = pa.struct([("token", pa.string()), ("n", pa.int32()), ("first", pa.int32()), ("chars", pa.int64()), ("own", pa.int64())])


def read_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, page, own_slot, blocks, tokens`` of every row: each html is read
    once, and only its text and its tokens go on."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(rows, 200):
            blocks, tokens, slots = [], [], []
            for html in b.column(4):
                own, seen = contents(html.as_py() or "")
                blocks.append([{"path": p, "text": t} for p, t in own])
                tokens.append([{"token": t, "n": n, "first": f, "chars": c, "own": o} for t, (n, f, c, o) in seen.items()])
                slots.append(own_slot(seen))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(slots, pa.string()), pa.array(blocks, pa.list_(_BLOCK)), pa.array(tokens, pa.list_(_SEEN))],
                names=["page_id", "url", "host", "page", "own_slot", "blocks", "tokens"],
            )

    kept = texts_of(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _host(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("page"), "html")
    return kept.mapInArrow(
        run, "page_id long, url string, host string, page long, own_slot string, blocks array<struct<path:string,text:string>>, "
        "tokens array<struct<token:string,n:int,first:int,chars:long,own:long>>",
    )


def _named(token: Column, name: str) -> Column:
    """The part of a path up to its outermost element ``name``; "" if it has none."""
    return F.regexp_extract(token, rf"^(?:.*?/)??{name}(?:\.[^/]*)?(?=/|$)", 0)


def _under(token: Column, top: Column) -> Column:
    return F.startswith(F.concat(token, F.lit("/")), F.concat(top, F.lit("/")))


def templates(read: DataFrame) -> DataFrame:
    """``(host, slot, fixed)``: the main slot of each host's template, and the paths in it whose
    text is the template's; host "*" for all together.

    A token's occurrence vector over the pages of its host is known by a sum of hashes of
    (page, occurrences); tokens of equal vectors are one class: tags by their paths, and the
    texts that stand in them.  A class of two tokens or more on half of the pages is valid if
    its tokens come in one order on all pages; being paths, they nest into the template.  Its
    dense slot is the deepest tag that is once on each page and holds most of the text that is
    not set aside.  The main slot is the template's main or article around the dense slot;
    without one, the lowest tag of the template, once on each page, that holds all text that
    is not the same on all pages.

    A text that is the same wherever its tag stands, on half of the pages or more, is the
    template's.  It is left out beside the article or, if there is none, the main or the dense
    slot; and within them where its tag has a class, which tells it from the article's own
    text.  "*" has no text of its own, so its slot climbs to main or article only.
    """
    seen = read.select("host", "page", F.explode("tokens").alias("t")).select("host", "page", "t.*")
    each = seen.withColumn("host", F.explode(F.array("host", F.lit("*"))))
    vectors = each.groupBy("host", "token").agg(
        F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector"), F.count("*").alias("pages"), F.max("n").alias("most"), F.sum("chars").alias("chars"),
        F.min("own").alias("own"), F.max("own").alias("last"),
    )
    vectors = stored(vectors, "vectors")
    every = F.explode(F.array("host", F.lit("*"))).alias("host")
    hosts = read.select(every).groupBy("host").agg(F.count("*").alias("all"))
    body = vectors.where(~F.contains("token", F.lit("/"))).groupBy("host").agg(F.max("chars").alias("text"))
    likely = vectors.join(hosts, "host").where(F.col("pages") >= F.col("all") * SUPPORT)
    classes = likely.groupBy("host", "vector").agg(F.count("*").alias("tokens")).where("tokens > 1").drop("tokens")
    likely = stored(likely.join(classes, ["host", "vector"]), "classes")
    # In a valid class the tokens come in the same order on every page.
    placed = each.select("host", "page", "token", "first").join(likely.select("host", "token", "vector"), ["host", "token"])
    order = placed.groupBy("host", "vector", "page").agg(F.xxhash64(F.transform(F.sort_array(F.collect_set(F.struct("first", "token"))), lambda x: x["token"])).alias("order"))
    valid = order.groupBy("host", "vector").agg(F.min("order").alias("a"), F.max("order").alias("b")).where("a = b").select("host", "vector")
    template = likely.join(valid, ["host", "vector"]).join(body, "host")
    slots = template.where((F.col("most") == 1) & (F.col("chars") > 0) & (F.col("chars") >= F.col("text") * SHARE) & ((F.col("all") >= FEW_PAGES) | (F.col("host") == "*")))
    depth = F.size(F.split("token", "/"))
    dense = slots.groupBy("host").agg(F.max(F.struct(depth.alias("d"), "chars", "token")).alias("s")).select("host", F.col("s.token").alias("dense"))
    dense = dense.withColumns({"main": _named(F.col("dense"), "main"), "article": _named(F.col("dense"), "article")})

    # The path that two paths share is shared by all in between, so the first and the last one
    # with text that is not the template's give the node that holds all of them.
    texts = vectors.where("last <> 0").join(hosts, "host").join(dense, "host")
    is_fixed = (F.col("own") == F.col("last")) & (F.col("pages") >= F.col("all") * SUPPORT)
    ends = texts.where(~is_fixed).groupBy("host").agg(F.min(F.concat("token", F.lit("/"))).alias("a"), F.max(F.concat("token", F.lit("/"))).alias("b"))
    around = dense.join(ends, "host", "left")
    whole = F.concat("dense", F.lit("/"))
    around = around.select("host", "dense", "main", "article", F.least("a", whole).alias("a"), F.greatest("b", whole).alias("b"))
    nodes = template.where("most = 1").select("host", "token")
    holds = around.join(nodes, "host").where(F.startswith("a", F.concat("token", F.lit("/"))) & F.startswith("b", F.concat("token", F.lit("/"))))
    lowest = holds.groupBy("host").agg(F.max_by("token", depth).alias("lowest"))
    named = lambda c: F.when(F.col(c) != "", F.col(c))
    low = F.when(F.col("host") == "*", F.col("dense")).otherwise(F.coalesce("lowest", F.lit("")))
    chosen = dense.join(lowest, "host", "left").select(
        "host", F.coalesce(named("main"), named("article"), low).alias("slot"), F.coalesce(named("article"), named("main"), F.col("dense")).alias("core")
    )
    rest = texts.where(is_fixed & (F.col("host") != "*")).select("host", "token").join(chosen, "host")
    classed = F.contains(F.element_at(F.split("token", "/"), -1), F.lit(".")) & (F.col("token") != F.col("core"))
    rest = rest.where(((F.col("slot") == "") | _under(F.col("token"), F.col("slot"))) & (~_under(F.col("token"), F.col("core")) | classed))
    fixed = rest.groupBy("host").agg(F.collect_set("token").alias("fixed"))
    return chosen.join(fixed, "host", "left").select("host", "slot", F.coalesce("fixed", F.array().cast("array<string>")).alias("fixed"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    The text is that of the page's main slot without what is set aside in it, character
    references decoded, white space within a block as one space, blocks joined by a line
    feed.  A page without its host's slot gives its article, main or whole body.  Null and
    empty pages have an empty text; rows without URL share the host ""; repeated rows give
    repeated results; other columns are ignored.  The template meets the pages' blocks, never
    their html, in a join that Spark plans by its size.
    """
    read = stored(read_pages(pages), "pages")
    slots = stored(templates(read), "slots")
    rest = slots.where("host = '*'").first()
    placed = read.join(slots.where("host <> '*'"), "host", "left").withColumn("slot", F.coalesce("slot", F.lit(rest.slot if rest else None).cast("string")))
    there = F.exists("tokens", lambda t: t["token"] == F.col("slot"))
    slot = F.when(there, F.col("slot")).otherwise(F.coalesce("own_slot", F.lit("")))
    placed = placed.withColumns({"at": slot, "fixed": F.coalesce("fixed", F.array().cast("array<string>"))})
    inside = lambda b: ((F.col("at") == "") | _under(b["path"], F.col("at"))) & ~F.array_contains("fixed", b["path"])
    text = F.array_join(F.transform(F.filter("blocks", inside), lambda b: b["text"]), "\n")
    return placed.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
