"""Main text of web pages: maximum-scoring subsequence of words and tags.

A page is a sequence of words, which score positive, and tags, which score negative; one
linear scan finds the contiguous region with the highest sum. The weights come from
labelled pages: those that mark their content with one ``article`` or ``main`` element. A
tag's weight is the log ratio of its rates inside and outside the content (at most
``-LEAST``), and a word's weight that of words (at least ``LEAST``). They are fitted on a
bounded sample of labelled pages (``sample_pages``), of which all tags are kept; elements that
are left out count as outside, so that they show what menus and footers are made of.

A contiguous region cannot leave out what stands inside it: elements that are never content (scripts, menus, forms, footers, elements with a class, id or
role like sidebar, advert, notice or comments) score nothing, neither words nor tags, and are
left out of the region's text. A region that meets an ``article`` element (without one, a
``main`` element) is extended to all of it, so that lists of short items do not cut it.

Contract: null or empty html gives an empty text; a page without words gives an empty text;
repeated rows are extracted each; of regions with equal scores the first stands; pages of any
length are scanned whole, in linear time, with open tags and quotes that nothing closes, too; other columns are carried along, and one named like the result is
refused; an empty table gives no rows. Character references are decoded within each run of text,
white space within a block becomes one space, and blocks are joined by an empty line.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .sampling import bounded

#: What a page begins with, but for tags: comments, elements whose content is raw, declarations (the page's end closes each).
RAW = r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
#: A tag with values in quotes, which may hold ``>``. Its attributes are read once and never again (``*+``).
TOKEN = re.compile(rf"{RAW}|<(/?)([a-zA-Z][\w:-]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))*+)>|[^<]+|<", re.S | re.I)
#: The same without quotes: a tag ends at the first ``>``, else with the page.
LOOSE = re.compile(rf"{RAW}|<(/?)([a-zA-Z][\w:-]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open element of the value is closed by the start of the key's.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements and words in class, id or role that are never part of an article.
NEVER = frozenset("head script style nav aside form footer menu button select dialog noscript template iframe svg label input textarea option".split())
NEVER_NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side nav navbar navigation menu topbar toolbar breadcrumb breadcrumbs pagination pager footer foot masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended trending widget comment comments reply replies discussion disqus respond contentinfo complementary form".split()
)
#: Words that may stand beside those in a compound name, as in ``top-menu``.
PLACES = frozenset("top bottom left right main site page global header list box bar block container wrapper inner outer content area section panel primary secondary mobile desktop links buttons button icons item items group unit slot post posts article story entry form wrap row col column sticky floating fixed policy email thread".split())
#: Ids that headings' slugs have, too: an id of a ``section``, or of ``class="section"``, says nothing by them.
SLUGS = frozenset("ad ads advertising sponsor sponsored promo promotion banner side navigation menu foot cookie cookies consent gdpr notice notices alert overlay subscription signup login search share sharing social related recommended trending reply replies discussion respond complementary form".split())
#: Class words that name content, and those that say nothing beside one of these.
CONTENT = frozenset("post article story entry content main body text".split())
WEAK = frozenset("related share sharing social recommended trending promo promotion sponsored widget subscribe subscription newsletter notice notices alert banner reply replies discussion search side form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAST = 0.05
#: Added to a token's rates, so that a tag never met inside costs some words, not whole paragraphs.
PRIOR = 0.01
SPACE = re.compile(r"\s+")


@dataclass
class Weights:
    """A word's score, each tag's score, and the score of tags that were not met."""

    word: float = 1.0
    tags: dict[str, float] = field(default_factory=dict)
    other: float = -1.0


@dataclass
class Node:
    name: str
    never: bool
    content: bool


def parts(token: str) -> list[str]:
    """The words of a class or id: ``topMenu`` and ``top-menu`` are two."""
    return [x for x in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if x]


def says(token: str, names: frozenset[str]) -> bool:
    """Whether the whole name is one of the names, alone or in a compound with ``PLACES``."""
    own = [x for x in parts(token) if not x.isdigit()]
    return any(x in names for x in own) and all(x in names or x in PLACES for x in own)


def named(element: str, attributes: str) -> tuple[set[str], bool, bool]:
    """Words of class, id and role, whether the element is never content, and whether a header."""
    words: set[str] = set()
    held: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        held.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    never = "hidden" in held or held.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", held.get("style", ""), re.I))
    header = False
    classes = held.get("class", "").split()
    slug = element == "section" or "section" in classes
    for key in ("class", "id", "role"):
        for token in held.get(key, "").split():
            words.update(x for x in re.findall(r"[a-z]+", " ".join(parts(token))))
            if element in HEADINGS or element in ("body", "html", "article", "main"):
                continue
            names = NEVER_NAMED - WEAK if key == "class" and CONTENT.intersection(c.lower() for c in classes) else NEVER_NAMED
            if key == "id":
                names = names - SLUGS if slug else names - {"discussion"}
            never = never or says(token, names)
            header = header or says(token, frozenset(("header",)))
    return words, never, header


def tokens(page: str) -> Iterator[re.Match]:
    """The page cut into comments, raw elements, declarations, tags and runs of text.

    Where no ``>`` outside quotes ends a tag, a quote was never closed: from there on quotes
    mean nothing. That happens once for a page at most, so its time is linear in its length.
    """
    pattern, at = TOKEN, 0
    while at < len(page):
        m = pattern.match(page, at)
        if pattern is TOKEN and m[0] == "<" and re.match(r"/?[a-zA-Z]", page[at + 1 : at + 3]):
            pattern = LOOSE
            continue
        yield m
        at = m.end()


def events(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """The page as (kind, value, left out, in marked content): kind is ``text``, ``tag`` or ``break``.

    A ``break`` is a block's border; a tag's value is its name with its class words.
    """
    stack: list[Node] = []
    opened: Counter = Counter()  # open elements by name
    never = content = 0

    def pop() -> str:
        nonlocal never, content
        node = stack.pop()
        opened[node.name] -= 1
        never -= node.never
        content -= node.content
        return node.name

    for m in tokens(page):
        token = m[0]
        if m[1]:
            yield "tag", m[1].lower(), True, content > 0
        elif m[3]:
            name = m[3].lower()
            block = name in BLOCKS
            if m[2]:
                yield "tag", "/" + name, never > 0, content > 0
                if opened[name]:
                    while pop() != name:
                        pass
                if block:
                    yield "break", name, never > 0, content > 0
                continue
            words, out, header = named(name, m[4]) if m[4] else (set(), False, False)
            out = out or name in NEVER
            if block:
                if stack and stack[-1].name == "p":
                    pop()
                for old in CLOSES.get(name, ()):
                    if stack and stack[-1].name == old:
                        pop()
                yield "break", name, never > 0, content > 0
            marked = name in ("article", "main")
            out = out or (name == "header" or header) and not content
            yield "tag", ".".join([name, *sorted(words)]), never > 0 or out, content > 0
            if name in VOID:
                if name == "br":
                    yield "text", " ", never > 0, content > 0
                continue
            stack.append(Node(name, out, marked))
            opened[name] += 1
            never += out
            content += marked
        elif token == "<" or token[0] != "<":  # else a comment, a declaration, or a tag that the page's end cuts off
            yield "text", token, never > 0, content > 0


def region(page: str, weights: Weights) -> str:
    """The text of the highest-scoring contiguous region, in blocks, with all of its articles."""
    blocks: list[tuple[int, int, str]] = []  # (positions of a block's first and last words, its text)
    words: list[str] = []
    position, at, last = 0, 0, 0
    total = best = 0.0
    low, span = 0, (0, 0)
    held: dict[str, list[list[int]]] = {"article": [], "main": []}  # outermost elements' first and last positions
    depth = {"article": 0, "main": 0}

    def flush() -> None:
        nonlocal words
        if words:
            text = SPACE.sub(" ", "".join(words)).strip()
            if text:
                blocks.append((at, last, text))
            words = []

    for kind, value, never, _ in events(page):
        position += 1
        if kind == "break":
            flush()
            continue
        if kind == "tag" and (element := value.partition(".")[0].lstrip("/")) in held:
            if value[0] != "/":
                if not depth[element] and not never:
                    held[element].append([position, 1 << 62])
                depth[element] += not never
            elif depth[element] and not never:
                depth[element] -= 1
                if not depth[element]:
                    held[element][-1][1] = position
        if never:
            continue
        if kind == "tag":
            score = weights.tags.get(value, weights.tags.get(value.partition(".")[0], weights.other))
        else:
            if not words:
                at = position
            value = references.unescape(value)  # before pieces meet: markup may stand between them
            words.append(value)
            last = position
            score = weights.word * len(value.split())
        total += score
        if total <= 0:
            total, low = 0.0, position
        elif total > best:
            best, span = total, (low, position)
    flush()
    for element in ("article", "main"):
        met = [x for x in held[element] if any(first <= span[1] and last > span[0] and x[0] < first <= x[1] for first, last, _ in blocks)]
        if met:
            span = min(span[0], met[0][0]), max(span[1], met[-1][1])
            break
    return "\n\n".join(text for first, last, text in blocks if first <= span[1] and last > span[0])  # blocks stay whole


def count_tokens(page: str) -> Counter | None:
    """Counts by (tag, or nothing for words, inside content) of a labelled page; None for an unlabelled one.

    Elements that are left out are outside wherever they stand: they show what menus and forms are made
    of. A tag with class words also counts for its bare name, which scores those with words not met.
    """
    counts: Counter = Counter()
    if len(re.findall(r"<(?:article|main)\b", page, re.I)) != 1:
        return None
    for kind, value, never, inside in events(page):
        inside = inside and not never
        if kind == "tag" and not value.lstrip("/").startswith(("article", "main")):
            counts[value, inside] += 1
            if "." in value:
                counts[value.partition(".")[0], inside] += 1
        elif kind == "text":
            counts["", inside] += len(value.split())
    return counts


def learned(found: dict[str, tuple[int, int]]) -> Weights:
    """Weights of (inside, outside) counts: log ratios of a token's rates, words at least ``LEAST``, tags at most ``-LEAST``."""
    inside, outside = (sum(v[k] for t, v in found.items() if "." not in t) for k in (0, 1))
    if not inside or not outside:
        return Weights()
    ratio = {t: math.log((i / inside + PRIOR) / (o / outside + PRIOR)) for t, (i, o) in found.items()}
    word = max(LEAST, ratio.pop("", LEAST))
    return Weights(word, {t: min(-LEAST, r) for t, r in ratio.items()}, -1.0)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = 2_000) -> Weights:
    """Learn the weights from at most about ``sample_pages`` pages; defaults where none is labelled."""
    rows = bounded(pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where("html is not null"), sample_pages, "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for page in b.column(1).to_pylist():
                total.update(count_tokens(page) or ())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], names=["token", "inside", "n"])

    counted = in_arrow(rows, count, "token string, inside boolean, n long").groupBy("token").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("o"))
    return learned({r["token"]: (r["i"], r["o"]) for r in counted.collect()})


def extract(pages: DataFrame, weights: Weights, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text in the column ``name`` in place of the html."""
    keep = [c for c in pages.columns if c != html_col]
    if name in keep:
        raise ValueError(f"a column {name} exists already; choose another name")
    rows = pages.select(html_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                texts = [region(page, weights) if page else "" for page in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=[*keep, name])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]] + [f"`{name}` string"])
    return in_arrow(rows, run, schema)
