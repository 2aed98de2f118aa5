"""Main text of web pages as a maximum-scoring subsequence.

A page is a row of tags and text runs. Words score by where they stand (block element, link, boilerplate
container), tags score against; one linear scan finds the contiguous stretch with the highest sum, and the
text blocks in it, boilerplate containers left out, are the article. The weights are log-odds learned from
labelled pages: those whose markup has an <article> or <main> element say which words and tags
are inside. Where pages say nothing, priors do.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import no_nulls, slices

#: Labelled pages the weights are learned from, about.
TRAINING_PAGES = 4000
#: Hashes a page may have.
HASHES = 1 << 62

# What opens a comment, a declaration or a tag. Everything after the name is possessive: nothing is read twice.
_OPENER = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
# The rest of a tag. A quote opens a value after "=" only, and one that is never closed opens none.
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_NAMES = re.compile(r"(?:\b(?:class|id|role))\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_BOILERPLATE = re.compile(
    r"(?:^|[-_\s])(?:nav|navbar|navigation|menu|sidebar|side|aside|complementary|footer|contentinfo|header|masthead|"
    r"breadcrumbs?|ad|ads|advert|adverts|advertisement|adbox|promo|promotion|sponsor|sponsored|banner|cookies?|consent|"
    r"gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|social|share|sharing|related|recommended|"
    r"comments?|commentlist|replies|disqus|respond|widget|toolbar|pagination|pager|copyright|legal|login|search|form)"
    r"(?:$|[-_\s])",
    re.I,
)
# Names of blocks that are never the article, whatever they hold: comments, navigation, related pages, asides.
_REAL = re.compile(
    r"(?:^|[-_])(?:nav|navbar|navigation|menu|breadcrumbs?|comments?|commentlist|replies|disqus|respond|related|recommended)"
    r"(?:$|[-_])|^(?:sidebar|aside|complementary)$",
    re.I,
)
# Names that say what is beside or around: "has-sidebar", "comments-open", "content-sidebar-wrap".
_QUALIFIER = re.compile(
    r"^(?:has|with|without|no)[-_]|[-_](?:open|opened|closed|enabled|disabled|fixed|visible|hidden|active|expanded|"
    r"collapsed|allowed|on|off)$|(?:^|[-_])(?:content|article|entry)[-_].*(?:wrap|wrapper|container|inner|layout)$",
    re.I,
)
_AROUND = re.compile(r"[-_](?:wrap|wrapper|container|inner|layout)$", re.I)
_COMMENT = re.compile(r"\bcomment", re.I)
_CONTAINERS = frozenset("nav header footer aside form menu dialog button select fieldset".split())
#: Containers a whole page may stand in.
_WRAPPERS = frozenset(("form", "fieldset"))
#: Longer ones in class, id or role are data, not names.
LONGEST_NAME = 200
#: Share of the page's words with which a container is the page, whatever its name.
MOST = 0.75
_SKIPPED = frozenset(
    "script style noscript template iframe object svg math canvas audio video textarea select title head".split()
)
_RAW = frozenset("script style noscript template iframe textarea title xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote td th dd dt figcaption caption summary".split())
_CLOSED_BY_BLOCK = frozenset(("p",))
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


@lru_cache(maxsize=10_000)
def _named(names: str) -> tuple[bool, bool, bool]:
    """What class, id and role say: boilerplate for sure, perhaps boilerplate, a comment."""
    own = [n for n in names.split() if len(n) <= LONGEST_NAME and not _QUALIFIER.search(n)]
    real = any(_REAL.search(n) and not _AROUND.search(n) for n in own)
    return real, any(_BOILERPLATE.search(n) for n in own), any(_COMMENT.search(n) for n in own)


def _settled(out: list[tuple], parents: list[int]) -> list[tuple[str, bool, bool, str, str]]:
    """Items with their container's number replaced by whether they are boilerplate.

    A container known by its name alone, or a form, is none if it holds most of the words (on pages with a
    mark, of those inside it)."""
    held, total = [0] * len(parents), 0
    mark = any(x[2] for x in out)
    for _, sure, inside, _, data, container in out:
        if data and not sure and (inside or not mark):
            n = len(data.split())
            total += n
            held[container] += n
    for k in range(len(parents) - 1, 0, -1):
        held[parents[k]] += held[k]
    bad = [False] * len(parents)
    for k in range(1, len(parents)):
        bad[k] = bad[parents[k]] or held[k] <= MOST * total
    return [(key, sure or bad[k], inside, block, data) for key, sure, inside, block, data, k in out]


def tags(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """``(text before, closing, name, attributes)`` of each tag, in time linear in the page.

    Comments and declarations have no name; the text after the last tag comes with none either. A tag that the
    page breaks off in is dropped, as browsers do. Where quoted values leave a tag without an end, it and all
    tags after it end at the first ">", so a page is not read to its end more than once for that.
    """
    at, end, quotes = 0, len(page), True
    last = page.rfind(">")
    while at < end:
        found = _OPENER.search(page, at)
        if not found:
            break
        before, start = page[at : found.start()], found.end()
        closing, name, attributes = bool(found[1]), (found[2] or "").lower(), ""
        if page.startswith("<!--", found.start()):
            stop = page.find("-->", start)
            at = end if stop < 0 else stop + 3
        elif last < start:
            at = end
            name = ""
        elif not name:
            at = page.index(">", start) + 1
        else:
            rest = _REST.match(page, start) if quotes else None
            if rest:
                attributes, at = rest[1], rest.end()
            else:
                quotes = False
                at = page.index(">", start) + 1
                attributes = page[start : at - 1]
        if name in _RAW and not closing:
            close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            name = ""
        yield before, closing, name, attributes
    if at < end:
        yield page[at:], False, "", ""


def items(page: str) -> list[tuple[str, bool, bool, str, str]]:
    """The page as ``(key, boilerplate, inside, block or "", text)``: tags have no text and a key "<name".

    ``key`` of a text run names its block element and whether it is a link; ``inside`` tells whether an
    <article> or <main> is open. Scripts, styles and the like are gone, comments too.
    """
    out: list[tuple[str, bool, bool, str, str, int]] = []
    stack: list[tuple[str, bool, bool, str, bool, int]] = [("body", False, False, "body", False, 0)]
    solid = [0]  # for each open element, the nearest one at or above it that is not inline
    opened: Counter = Counter()
    parents = [0]  # of containers that may be boilerplate, by number; 0 is none
    block = 0

    def pop() -> str:
        solid.pop()
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    for data, closing, name, attributes in tags(page):
        if data:
            _, sure, inside, element, link, container = stack[-1]
            out.append((element + ("+a" if link else ""), sure, inside, str(block), data, container))
        if not name:
            continue
        top = stack[-1]
        if name not in _INLINE:
            block += 1
        out.append(("<" + name, top[1], top[2], "", "", top[5]))
        if closing:
            if opened[name] > 0:
                while pop() != name:
                    pass
            continue
        if name in _VOID:
            continue
        closed = _SAME.get(name, ()) if name in _SAME else _CLOSED_BY_BLOCK if name not in _INLINE else ()
        if stack[solid[-1]][0] in closed:
            for _ in range(len(stack) - solid[-1]):
                pop()
        top = stack[-1]
        sure, inside, container = top[1], top[2], top[5]
        named = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if "=" in attributes else ""
        real, perhaps, comment = _named(named) if named else (False, False, False)
        if name in ("article", "main"):
            # A page within a form or an oddly named wrapper is still a page; a comment written as an article is none.
            sure = sure or comment
            inside, container = inside or not sure, 0
        elif name not in ("html", "body"):
            own = name in _CONTAINERS and not (name == "header" and inside)
            sure = sure or real or name in _SKIPPED or (own and name not in _WRAPPERS)
            if not sure and (perhaps or own):
                parents.append(container)
                container = len(parents) - 1
        element = top[3] if name in _INLINE else name
        stack.append((name, sure, inside, element, top[4] or name == "a", container))
        solid.append(solid[-1] if name in _INLINE else len(stack) - 1)
        opened[name] += 1
    return _settled(out, parents)


def prior(key: str, bad: bool) -> float:
    """How likely a word (or tag) of this kind is part of an article, before any page is seen."""
    if key.startswith("<"):
        return 0.45 if key[1:] in _TEXTUAL or key[1:] in _INLINE else 0.3
    if bad:
        return 0.02
    element, _, link = key.partition("+")
    return (0.9 if element in _TEXTUAL else 0.6) * (0.5 if link and element not in _TEXTUAL else 1)


def weight(key: str, bad: bool, counts: tuple[int, int], strength: float = 20.0) -> float:
    """Log-odds of being inside, from ``counts`` (inside, outside) and the prior; negative for every tag."""
    inside, outside = counts
    p = (inside + strength * prior(key, bad)) / (inside + outside + strength)
    score = max(-6.0, min(6.0, math.log(p / (1 - p))))
    return min(-0.02, score / 4) if key.startswith("<") else score


class Weights:
    """Counts (inside, outside) by key, boilerplate and, on pages with a mark, whether inside it."""

    def __init__(self, marked: dict, plain: dict):
        self.marked, self.plain = marked, plain
        self.known: dict = {}

    def of(self, key: str, bad: bool, inside: bool | None) -> float:
        found = self.known.get((key, bad, inside))
        if found is None:
            if inside is None:
                found = weight(key, bad, self.plain.get((key, bad), (0, 0)))
            else:
                counts = self.marked.get((bad, inside), (0, 0)) if not key.startswith("<") else (0, 0)
                found = weight(key, bad, counts) if counts != (0, 0) else weight(key, bad, (400, 0) if inside and not bad else (0, 400))
            self.known[(key, bad, inside)] = found
        return found


def learn(pages: Iterator[list]) -> tuple[dict, dict]:
    """Word and tag counts of labelled pages, by kind, inside and outside their mark."""
    marked: Counter = Counter()
    plain: Counter = Counter()
    for page in pages:
        if not any(x[2] for x in page):
            continue
        for key, bad, inside, _, data in page:
            n = len(data.split()) if data else 1 if key.startswith("<") else 0
            if n:
                content = inside and not bad
                plain[(key, bad, content)] += n
                if data:
                    marked[(bad, inside, content)] += n
    fold = lambda c, *k: (c[(*k, True)], c[(*k, False)])
    return (
        {k[:2]: fold(marked, *k[:2]) for k in marked},
        {k[:2]: fold(plain, *k[:2]) for k in plain},
    )


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and past-last index of the contiguous stretch with the highest positive sum; (0, 0) if none."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def extract(page: str, weights: Weights) -> str:
    """The article's text: blocks joined by a space, white space within them single, references decoded."""
    row = items(page)
    mark = any(x[2] for x in row)
    scores = []
    for key, bad, inside, _, data in row:
        w = weights.of(key, bad, inside if mark else None)
        scores.append(w * len(data.split()) if data else w if key.startswith("<") else 0.0)
    first, last = best_region(scores)
    blocks: dict[str, list[str]] = {}
    for _, bad, _, block, data in row[first:last]:
        if data and not bad:
            blocks.setdefault(block, []).append(data)
    texts = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return " ".join(t for t in texts if t)


def _count_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marked, plain = learn(items(p) for b in slices(batches) for p in no_nulls(b.column(0)).to_pylist())
    rows = [("plain", key, bad, False, *n) for (key, bad), n in plain.items()]
    rows += [("marked", "", bad, inside, *n) for (bad, inside), n in marked.items()]
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
    names = ["kind", "key", "bad", "marked", "inside", "outside"]
    columns = list(zip(*rows)) or [[]] * 6
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def sample_bound(sample: int, n: int) -> int:
    """How many of ``HASHES`` hashes choose a page, for about ``sample`` of ``n``: never none while there are pages."""
    return min(HASHES - 1, HASHES * sample // max(n, 1))


def fit(pages: DataFrame, sample: int = TRAINING_PAGES) -> Weights:
    """Weights from about ``sample`` pages, chosen by a hash of id and url, that have a mark."""
    n = pages.count()
    drawn = F.xxhash64("page_id", "url").bitwiseAND(F.lit(HASHES - 1))
    chosen = pages.filter(F.col("html").isNotNull() & (drawn < F.lit(sample_bound(sample, n)))).select("html")
    counts = (
        chosen.mapInArrow(
            _count_pages, "kind string, key string, bad boolean, marked boolean, inside long, outside long"
        )
        .groupBy("kind", "key", "bad", "marked")
        .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        # A row per kind of word or tag; rare made-up tags are left to the priors.
        .orderBy(F.desc(F.col("inside") + F.col("outside")), "kind", "key", "bad", "marked")
        .limit(2000)
        .collect()
    )
    plain = {(r["key"], r["bad"]): (r["inside"], r["outside"]) for r in counts if r["kind"] == "plain"}
    marked = {(r["bad"], r["marked"]): (r["inside"], r["outside"]) for r in counts if r["kind"] == "marked"}
    return Weights(marked, plain)


def _extract_all(weights: Weights, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [extract(p, weights) for p in no_nulls(batch.column(2)).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    Null or empty html, and pages where nothing scores above zero, have the empty text. Repeated rows are
    extracted each; an empty table gives no rows; other columns are not read. Pages are taken whole, in time
    linear in their length whatever their markup; a task holds one page's items at a time.
    """
    weights = fit(pages)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        partial(_extract_all, weights), f"page_id {kind}, url string, text string, n_chars long"
    )
