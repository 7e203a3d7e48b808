"""HTML main text by equivalence classes of template tokens.

Pages of one host share a template. Its tokens are the elements at their paths (an opening and a closing tag each, as the
parser closes what it opens) and the words that stand next to a tag, at their paths. Tokens that occur once a page and
have the same occurrence vector over the host's pages form an equivalence class. A class is valid where it is on enough
pages and its tokens come in one order on all of them; the classes nest as the paths of their elements do. The valid
elements make the template, and what lies between them are its slots.

Of the valid containers that hold at least half of the text of their pages the innermost is the main one. The main text is
what fills the slots inside it and, as titles and leads may stand before it, the slots beside it: those that no other
container holds, unless an article does, that are not mostly links, have no template word at their edge (headings and
paragraphs may) and differ from page to page. Lists of tags and names, of which an element that is not article text often has one, come before that.

Occurrence vectors are never gathered: a token's vector is represented by the exclusive-or of a hash of its pages, which
pre-aggregates, so a host with a third of all pages costs no more than another. A path is a number made from its parent's
and its own label, so deep markup costs no more than its length. A host's template is a list of numbers, joined to its
pages; a token is in it only if it is on a tenth of them, so the list is at most ten times an average page's tokens.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import textops as X
from lectern.session import materialise

#: A class counts when it is on this share of the host's pages.
MIN_SUPPORT = 0.1
#: Fewer pages with the same words in a slot do not make the words part of the template.
MIN_FIXED = 3
#: The main element holds at least this share of the text of its pages.
MIN_SHARE = 0.5
#: A block beside the main element with a larger share of its text in links is a menu.
MAX_LINKED = 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Elements that may be the main one: headings, paragraphs, list items and inline elements hold parts of an article.
CONTAINERS = set("html body article main section div center table tbody tr td".split())
#: Elements that are a part of the page of their own: beside the main one they are no titles or leads.
BOXES = CONTAINERS | set("ul ol dl menu thead tfoot th li dt dd".split())
#: Elements whose text is prose even if it starts or ends with the same word on all pages.
PROSE = set("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
#: Elements behind which a paragraph or list item further out is not closed.
WALLS = "div section article main table ul ol body blockquote".split()
#: Elements that are not article text wherever they stand.
NOISE_TAGS = set("head nav footer aside form button select menu dialog input label fieldset object embed audio video".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that name something other than the article.
NOISE_NAMES = set(
    "ad ads adv advert advertisement adverts adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert sidebar menu nav navbar navigation topbar footer copyright breadcrumb breadcrumbs "
    "comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login popup modal overlay widget widgets toolbar pagination pager".split()
)
#: Noise outside an article; inside one, a header holds its title.
HEADERS = set("header masthead".split())
CLOSED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

#: Elements that a tag ends.
CLOSES = {tag: [ended for ended, by in CLOSED_BY.items() if tag in by] for tag in set().union(*CLOSED_BY.values())}


ROOT_PATH, PATH_FACTOR, PATH_MASK = 1, 0x9E3779B97F4A7C15, (1 << 63) - 1


@lru_cache(maxsize=1 << 16)
def number(label: str) -> int:
    return int.from_bytes(blake2b(label.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def mixed(a: int, b: int) -> int:
    x = ((a ^ b) * PATH_FACTOR) & ((1 << 64) - 1)
    return (x ^ (x >> 29)) & PATH_MASK


def below(path: int, label: str) -> int:
    """The number of the path that leads from ``path`` to ``label``."""
    return mixed(path, number(label))


class Element:
    __slots__ = ("tag", "path", "parent", "depth", "noise", "article", "linked", "block", "chars", "links", "inside", "beside")

    def __init__(self, tag: str, path: int, parent: Element | None, noise: bool, article: bool) -> None:
        self.tag, self.path, self.parent, self.noise, self.article, self.chars, self.links = tag, path, parent, noise, article, 0, 0
        self.depth = parent.depth + 1 if parent else 0
        self.linked = tag == "a" or parent is not None and parent.linked
        self.block: int = path if parent is None or tag in BLOCKS else parent.block
        self.inside = self.beside = False


@lru_cache(maxsize=1 << 12)
def marks(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """(label, noise, article, header) of a tag by itself."""
    names, role, hidden = [], "", False
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        kind, value = m[1].lower(), (m[2] or "").strip("\"'")
        if kind in ("class", "id"):
            names.append(value)
        elif kind == "role":
            role = value.lower()
        else:
            hidden |= kind == "hidden" or bool(re.search(r"display\s*:\s*none", value))
    words = {w.lower() for n in names for w in NAME.findall(n)}
    noise = hidden or tag in NOISE_TAGS or role in NOISE_ROLES or bool(words & NOISE_NAMES)
    header = tag in HEADERS or bool(words & HEADERS)
    label = ".".join([tag, *sorted(names[0].split() if names else [])])
    return label, noise, tag in ("article", "main") or role in ("article", "main"), header


def opened(tag: str, attributes: str, parent: Element) -> Element:
    label, noise, article, header = marks(tag, attributes)
    article |= parent.article
    return Element(tag, below(parent.path, label), parent, parent.noise or noise or (header and not article), article)


def events(page: str) -> Iterator[tuple[str, Element, str]]:
    """("open" | "close" | "text" | "break", element, text) in page order. Elements left open close at the end."""
    stack = [Element("", ROOT_PATH, None, False, False)]
    places: dict[str, list[int]] = {}  # where the open elements of a tag are in the stack
    at = 0

    def close(depth: int) -> Iterator[tuple[str, Element, str]]:
        while len(stack) > depth:
            places[stack[-1].tag].pop()
            yield "close", stack.pop(), ""

    def topmost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        slash, name, rest = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        tag = name.lower()
        if slash:
            depth = topmost((tag,))
            if depth:
                yield from close(depth)
            if tag in BLOCKS:
                yield "break", stack[-1], ""
            continue
        if tag in BLOCKS:
            yield "break", stack[-1], ""
        if tag in VOID:
            continue
        ended = topmost(CLOSES.get(tag, ()))
        if ended and ended >= topmost(WALLS):
            yield from close(ended)
        if rest and rest.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        stack.append(opened(tag, rest or "", stack[-1]))
        places.setdefault(tag, []).append(len(stack) - 1)
        yield "open", stack[-1], ""
    if at < len(page):
        yield "text", stack[-1], page[at:]
    yield from close(1)


def text_size(text: str) -> int:
    return sum(map(len, text.split()))


def words_hash(texts: list[str]) -> int:
    return int.from_bytes(blake2b(" ".join(" ".join(texts).split()).encode(), digest_size=8).digest(), "little", signed=True)


#: Kinds of tokens: elements that may be the main one, others, words at the edge of prose and of other texts.
CONTAINER, OTHER, WORD, LABEL = range(4)


def page_tokens(page: str) -> list[tuple[int, int, int, int, int, int, int, int, int | None, int | None]]:
    """(token, kind, path, depth, count, text under it, link text under it, text of the page, hash of its own words, hash of
    the page's words) of each token; noise has no text, and words and elements without own words have no hashes."""
    counts: dict[int, list[int]] = {}
    own: dict[int, list[str]] = {}
    words: dict[int, list[int]] = {}
    total, inside = 0, []
    for kind, element, text in events(page):
        if kind == "open":
            inside.append(element)
            found = counts.setdefault(element.path, [CONTAINER if element.tag in CONTAINERS else OTHER, element.depth, 0, 0, 0])
            found[2] += 1
        elif kind == "close":
            inside.pop()
            found = counts[element.path]
            found[3] += element.chars
            found[4] += element.links
            if inside:
                inside[-1].chars += element.chars
                inside[-1].links += element.links
        elif kind == "text" and not element.noise:
            size = text_size(text)
            total += size
            if size:
                own.setdefault(element.path, []).append(text)
                for token in edge_words(element.path, text):
                    words.setdefault(token, [WORD if element.tag in PROSE else LABEL, element.path, element.depth, 0])[3] += 1
            if inside:
                inside[-1].chars += size
                inside[-1].links += size * element.linked
    hashes = {path: words_hash(t) for path, t in own.items()}
    body = words_hash([x for t in own.values() for x in t])
    rows = [
        (path, kind, path, depth, n, size, links, total, hashes.get(path), body if path in hashes else None)
        for path, (kind, depth, n, size, links) in counts.items()
    ]
    return rows + [(token, kind, path, depth, n, 0, 0, 0, None, None) for token, (kind, path, depth, n) in words.items()]


def edge_words(path: int, text: str) -> list[int]:
    """Tokens of the first and the last word of a text, which stand next to a tag."""
    words = text.split()
    return [below(path, f"{side} {word}") for side, word in (("first", words[0]), ("last", words[-1]))]


def page_orders(page: str, classes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Class -> (hash of the order of its elements, of that of all its tokens) on a page; ``classes`` has the class of a token."""
    orders: dict[int, tuple[int, int]] = {}
    for kind, element, text in events(page):
        if kind == "open":
            tokens = [element.path]
        elif kind == "close":
            tokens = [-element.path]
        elif kind == "text" and not element.noise and text.strip():
            tokens = edge_words(element.path, text)
        else:
            continue
        for token in tokens:
            found = classes.get(abs(token))
            if found is not None:
                elements, every = orders.get(found, (1, 1))
                orders[found] = (mixed(elements, token) if kind != "text" else elements, mixed(every, token))
    return orders


def main_text(page: str, candidates: list[int], dropped: list[int]) -> str:
    """The text in the first of ``candidates`` that the page has once and in the slots beside it that are not
    ``dropped``; without a candidate, the text of the page's article and main elements or, where it has none, of the page."""
    found: dict[int, int] = {}
    elements: list[Element] = []
    every: list[tuple[Element, str]] = []
    for kind, element, text in events(page):
        if kind == "open":
            found[element.path] = found.get(element.path, 0) + 1
            elements.append(element)
        elif kind in ("text", "break"):
            every.append((element, text))
    root = next((c for c in candidates if found.get(c) == 1), None)
    articles = root is None and any(e.article and not e.noise and text.strip() for e, text in every)
    if root is not None:
        above = next(e for e in elements if e.path == root)
        while above.parent is not None:
            above = above.parent
            above.beside = True
        for e in elements:
            e.inside = e.path == root or e.parent.inside
            e.beside |= e.parent.beside and (e.tag not in BOXES or e.article)
    left = set(dropped)

    def kept(e: Element) -> bool:
        if root is None:
            return e.article or not articles
        return e.inside or e.beside and e.path not in left and e.block not in left

    blocks, block = [], []
    for element, text in every:
        if text and (element.noise or not kept(element)):
            continue
        if text:
            block.append(text)
        elif block:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    words = (" ".join(html.unescape(b).split()) for b in blocks)
    return " ".join(b for b in words if b)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


TOKENS = pa.schema(
    [("host", pa.string()), ("page", pa.int64()), ("token", pa.int64()), ("kind", pa.int8()), ("path", pa.int64()), ("depth", pa.int32()),
     *[(c, pa.int64()) for c in ("n", "chars", "links", "total", "own", "body")]]
)


def token_table(pages: DataFrame) -> DataFrame:
    """Per host and token: vector, support (pages that have it), most (times on one page) and sums over its pages."""

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in TOKENS]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TOKENS, strict=True)], schema=TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, key, page in zip(*(c.to_pylist() for c in batch.columns[:2]), X.texts_of(batch.column(2)), strict=True):
                rows += [(host, key, *t) for t in page_tokens(page.decode("utf-8", "replace"))]
                if len(rows) > 20_000:
                    yield as_batch(rows)
                    rows = []
            yield as_batch(rows)

    schema = "host string, page bigint, token bigint, kind tinyint, path bigint, depth int, n bigint, chars bigint, links bigint, total bigint, own bigint, body bigint"
    return pages.mapInArrow(run, schema).groupBy("host", "token", "kind", "path", "depth").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("support"), F.max("n").alias("most"),
        *[F.sum(c).alias(c) for c in ("chars", "links", "total")], F.count("own").alias("filled"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in ("own", "body") for f in (F.min, F.max)],
    )


def class_orders(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """(host, vector, in_order, words_in_order) of the classes: whether their elements, and their tokens at all, come in
    one order on all pages. ``classes`` has host, classes (token, vector); hosts of one page need not be in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, page, tokens in zip(batch.column(0).to_pylist(), X.texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                found = page_orders(page.decode("utf-8", "replace"), {t["token"]: t["vector"] for t in tokens})
                rows += [(host, vector, *orders) for vector, orders in found.items()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 3], strict=True)], ["host", "vector", "elements", "tokens"]
            )

    joined = pages.join(classes.withColumnRenamed("host", "c_host"), F.col("host").eqNullSafe(F.col("c_host")))
    found = joined.select("host", "html", "classes").mapInArrow(run, "host string, vector bigint, elements bigint, tokens bigint")
    same = lambda c: (F.min(c) == F.max(c))
    return found.groupBy("host", "vector").agg(same("elements").alias("in_order"), same("tokens").alias("words_in_order"))


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, candidates, dropped): for each host the paths of its main elements, innermost first, and of the slots that
    are no article text beside one: their words belong to the template, or start or end with words of it, or are links."""
    given = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("page"), "html")
    tokens = materialise(token_table(given), "tokens")
    sizes = tokens.groupBy(F.col("host").alias("s_host")).agg(F.max("support").alias("pages"))
    often = tokens.join(sizes, F.col("host").eqNullSafe(F.col("s_host"))).drop("s_host").filter(F.col("support") >= MIN_SUPPORT * F.col("pages"))
    # The classes: tokens of one vector. A word makes one with others only on pages enough.
    once = often.filter((F.col("most") == 1) & ((F.col("kind") < WORD) | (F.col("support") >= MIN_FIXED)))
    # Written, so its size is known: the pages are shuffled by host only if the lists are too large to be sent to the tasks.
    listed = materialise(once.filter("pages > 1").groupBy("host").agg(F.collect_list(F.struct("token", "vector")).alias("classes")), "classes")
    orders = materialise(class_orders(given.select("host", "html"), listed), "class-orders").select(
        F.col("host").alias("o_host"), F.col("vector").alias("o_vector"), "in_order", "words_in_order"
    )
    on = F.col("host").eqNullSafe(F.col("o_host")) & (F.col("vector") == F.col("o_vector"))
    valid = once.join(orders, on, "left").filter(
        F.when(F.col("kind") >= WORD, F.col("words_in_order")).otherwise(F.coalesce("in_order", F.lit(True)))
    )
    mains = valid.filter((F.col("kind") == CONTAINER) & (F.col("chars") >= MIN_SHARE * F.greatest("total", F.lit(1))))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("depth"), (-F.col("support")).alias("n"), "path")))
    mains = mains.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("candidates"))
    same = often.filter((F.col("filled") >= MIN_FIXED) & (F.col("min_own") == F.col("max_own")) & (F.col("min_body") != F.col("max_body")))
    same = same.filter(F.col("filled") >= MIN_SUPPORT * F.col("pages"))
    linked = often.filter((F.col("kind") < WORD) & (F.col("links") > MAX_LINKED * F.col("chars")))
    labelled = valid.filter(F.col("kind") == LABEL)
    dropped = same.select("host", "path").union(linked.select("host", "path")).union(labelled.select("host", "path")).distinct()
    dropped = dropped.groupBy(F.col("host").alias("f_host")).agg(F.sort_array(F.collect_list("path")).alias("dropped"))
    both = mains.join(dropped, F.col("host").eqNullSafe(F.col("f_host")), "left")
    return both.select("host", "candidates", F.coalesce("dropped", F.array().cast("array<bigint>")).alias("dropped"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: the main text of every row of ``pages`` (page_id, url, html).

    Character references are decoded, white space inside a block becomes one space, blocks follow each other by one
    space. A null or empty page has an empty text. Pages without host share one group; pages that their group's
    template does not fit give the text of their own article and main elements, or all of it. Repeated rows give equal texts.
    """
    templates = materialise(deduce_templates(pages), "templates").withColumnRenamed("host", "t_host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = zip(X.texts_of(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            texts = [main_text(p.decode("utf-8", "replace"), c or [], f or []) for p, c, f in chosen]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    given = pages.select("page_id", "url", "html")
    joined = given.join(templates, host_of(F.col("url")).eqNullSafe(F.col("t_host")), "left")
    return joined.select("page_id", "url", "html", "candidates", "dropped").mapInArrow(run, "page_id bigint, url string, text string")
