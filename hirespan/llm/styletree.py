"""Main text of web pages by a site style tree.

The block structure of all pages of a host is merged into one tree: an element's *style* is the sequence of
its children (tag, class, id), and children of equal styles at equal places are one node of the tree. What a
node shows on its pages, its style or, at a leaf, its text, has an entropy; taken to the base of its number
of pages it is the node's importance, from 0 (alike everywhere) to 1 (never twice, or one page only). A leaf
counts by the share of its text outside links. An inner node's importance joins its own with that of its
children, and a branch goes if neither it nor anything in it reaches ``LEAST``.

Entropy cannot tell an advert from an article if both change from page to page, so what a page declares goes
first: menus, footers, forms, adverts, comments and the like, by tag, role or name, have no importance, and
the inside of a declared article has all of it, as a passage found on many pages is text all the same. A page
that declares an article or main part has its text there. If nothing would be left, the undeclared stays.

Pages are read twice. First every node outside articles gives (page, number, key, value); counts by (key, value)
and then by key are combined before they are shuffled, so neither a host with most pages nor its root meets
in one task. Nodes take their importance by a join on the key, are gathered by page (as many as a page has)
and joined to the page, which is then cut. Equal pages of a host count once.

Defined results: a null html is empty; a null url, or one without ``://``, belongs to the empty host. Text
without markup is one block. An unclosed tag or comment ends the page. Repeated rows each give a row; an empty
table gives an empty one; other columns are not looked at. A host with fewer than ``FEW`` pages has no statistics.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirespan.llm.tables import small_batches, written

LEAST = 0.2  # importance below which a branch is noise
DAMPING = 0.9  # weight of the children, to the power of the number of styles
FEW = 4  # pages a node needs before its entropy says anything

# Elements and names that HTML pages use for parts that are not the article, or that are.
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = set("html head body".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark nobr output q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var".split()
)
NOISE_TAGS = set("nav footer aside form noscript template object applet svg canvas audio video button select datalist dialog menu".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
NOISE_WORDS = set(
    "ad ads adsense nav navbar menu sidebar aside footer masthead topbar toolbar banner promo consent gdpr notice popup modal overlay"
    " newsletter signup login disqus respond replies reply related recommended share sharing social widget pagination pager skip".split()
)
NOISE_STARTS = ("advert", "navigat", "breadcrumb", "sponsor", "promot", "subscri", "cookie", "comment")
ARTICLE_NAMES = set("article article-body articlebody article-content post post-body post-content entry entry-content hentry story story-body".split())
MAIN_NAMES = set("main main-content maincontent".split())
CLOSES = {  # tag: what it ends, and what shields that
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
SHIELDS = set("td th table caption button object applet".split())  # a paragraph outside of these is not ended inside

NONE, NOISE, ARTICLE, MAIN, HEADER = range(5)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""")
COMMENT = re.compile(r"<!--(?:-?>|.*?--!?>)", re.S)
OTHER = re.compile(r"<(?:[!?]|/[^a-zA-Z])[^>]*>|</>")
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")


def declared(tag: str, attributes: str) -> tuple[str, int, bool]:
    """An element's label, what it is declared to be, and whether its name alone says so."""
    found = {name.lower(): a or b or c for name, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    label = DIGITS.sub("0", " ".join([tag, *sorted(names)])) if names else tag
    role = found.get("role", "").lower()
    words = {w.lower() for name in names for w in WORDS.findall(name)}
    noisy = any(w in NOISE_WORDS or w.startswith(NOISE_STARTS) for w in words) and not words & {"with", "has", "no", "without"}
    if tag in NOISE_TAGS or role in NOISE_ROLES:
        return label, NOISE, tag == "form"
    if noisy:
        return label, NOISE, tag != "article"
    if tag == "article" or role == "article" or found.get("itemprop") == "articleBody" or any(n.lower() in ARTICLE_NAMES for n in names):
        return label, ARTICLE, False
    if tag == "main" or role == "main" or any(n.lower() in MAIN_NAMES for n in names):
        return label, MAIN, False
    return label, HEADER if tag == "header" or "header" in words else NONE, False


class Page:
    """Blocks of a page in page order: elements, and runs of text (whose label is ``#``). Block 0 is the body."""

    def __init__(self) -> None:
        self.parents, self.labels, self.kinds, self.by_name = [-1], ["body"], [NONE], [False]
        self.texts: list[str | None] = [None]
        self.linked = [0.0]  # share of a run's text inside links

    def add(self, parent: int, label: str, kind: int, by_name: bool, text: str | None = None, linked: float = 0.0) -> int:
        for column, value in zip(
            (self.parents, self.labels, self.kinds, self.by_name, self.texts, self.linked),
            (parent, label, kind, by_name, text, linked), strict=True,
        ):
            column.append(value)
        if kind in (ARTICLE, MAIN):  # what holds an article is no advert, whatever its name
            while parent > 0:
                if self.by_name[parent]:
                    self.kinds[parent], self.by_name[parent] = NONE, False
                parent = self.parents[parent]
        return len(self.parents) - 1

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.parents]
        for k in range(1, len(self.parents)):
            out[self.parents[k]].append(k)
        return out

    def settled(self) -> list[int]:
        """What each block is by its own and its parents' declarations; HEADER and MAIN are resolved."""
        out, inside = [], []
        for k, kind in enumerate(self.kinds):
            above, within = (out[self.parents[k]], inside[self.parents[k]]) if k else (NONE, False)
            if kind == HEADER:  # a page's header; that of an article or main part belongs to it
                kind = NONE if within else NOISE
            out.append(NOISE if above == NOISE or kind == NOISE else ARTICLE if ARTICLE in (above, kind) else NONE)
            inside.append(within or (out[-1] != NOISE and kind in (ARTICLE, MAIN)))
        if any(inside):  # text lies in the declared parts only
            out = [kind if within or kind == NOISE else NONE if self.texts[k] is None else NOISE
                   for k, (kind, within) in enumerate(zip(out, inside, strict=True))]
        return out


def parsed(source: str) -> Page:
    page, pieces = Page(), []
    stack: list[tuple[str, int, bool, bool]] = [("body", 0, True, False)]  # tag, block, is a block, a paragraph is open
    opened: Counter[str] = Counter()
    linked, at, size = 0, 0, len(source)

    def run_ends() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                page.add(stack[-1][1], "#", NONE, False, text, min(1.0, linked / len(text.replace(" ", ""))))
            linked = 0

    def close(place: int) -> None:
        while len(stack) > place:
            opened[stack.pop()[0]] -= 1

    def ended(tags: set[str], shields: set[str]) -> None:
        for place in range(len(stack) - 1, 0, -1):
            if stack[place][0] in tags:
                return close(place)
            if stack[place][0] in shields:
                return None

    def add_text(text: str) -> None:
        nonlocal linked
        text = entities.unescape(text) if "&" in text else text
        pieces.append(text)
        if opened["a"]:
            linked += len("".join(text.split()))

    while at < size:
        start = source.find("<", at)
        if start < 0:
            add_text(source[at:])
            break
        if start > at:
            add_text(source[at:start])
        follows = source[start + 1 : start + 2]
        m = TAG.match(source, start)
        if not m:
            if source.startswith("<!--", start):
                m = COMMENT.match(source, start)
            elif follows in "!?/" and follows:
                m = OTHER.match(source, start)
            elif not (follows.isascii() and follows.isalpha()):
                add_text("<")
                at = start + 1
                continue
            if not m:
                break
            at = m.end()
            continue
        at = m.end()
        end, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in UNSEEN:
            continue
        if end:
            if not opened[tag]:
                continue
            if tag in INLINE:
                place = len(stack) - 1
                while place and stack[place][0] != tag and not stack[place][2]:
                    place -= 1
                if stack[place][0] == tag:
                    if stack[place][2]:
                        run_ends()
                    close(place)
            else:
                run_ends()
                ended({tag}, SHIELDS - {tag} if tag not in ("tr", "tbody", "thead", "tfoot", "table") else {"table"} - {tag})
            continue
        if tag in RAW:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            at = m.start() if m else size
            continue
        if tag in VOID:
            if tag == "br":
                pieces.append(" ")
            elif tag == "hr":
                run_ends()
            continue
        label, kind, by_name = declared(tag, attributes)
        block = tag not in INLINE or kind in (NOISE, ARTICLE, MAIN)
        if block:
            run_ends()
            if tag not in INLINE and stack[-1][3]:
                ended({"p"}, SHIELDS)
            if tag in CLOSES:
                ended(*CLOSES[tag])
            if tag == "h1" and opened["form"]:  # a form around the whole page
                kind = NONE
                for name, number, *_ in stack:
                    if name == "form" and page.by_name[number]:
                        page.kinds[number] = NONE
        number = page.add(stack[-1][1], label, kind, by_name) if block else stack[-1][1]
        stack.append((tag, number, block, tag == "p" or (stack[-1][3] and tag not in SHIELDS)))
        opened[tag] += 1
    run_ends()
    return page


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)))


def nodes(page: Page, host: str) -> list[tuple[int, int, int]]:
    """(number, key, value) of the blocks outside articles: their node in the host's tree, and what they show there.

    An element around one run of text is one node with it.
    """
    children, kinds = page.children(), page.settled()
    keys, out = {0: _hash(host)}, []
    for k, inner in enumerate(children):
        if k not in keys:
            continue
        if page.texts[k] is not None:
            out.append((k, keys[k], _hash(page.texts[k])))
            continue
        if kinds[k] == ARTICLE:  # kept as a whole
            continue
        style = _hash(*[page.labels[c] for c in inner])
        for place, c in enumerate(inner):
            keys[c] = _hash(keys[k], style, place)
        if not (len(inner) == 1 and page.texts[inner[0]] is not None):
            out.append((k, keys[k], style))
    return out


def composite(page: Page, found: dict[int, tuple[float, int]]) -> list[float]:
    """Importance of every block: that of its node joined with what is inside it, nothing if declared noise."""
    children, kinds = page.children(), page.settled()
    out = [0.0] * len(kinds)
    for k in range(len(kinds) - 1, -1, -1):
        own, styles = found.get(k, (1.0, 1))
        if kinds[k] == NOISE:
            out[k] = 0.0
        elif kinds[k] == ARTICLE:
            out[k] = 1.0
        elif page.texts[k] is not None:
            out[k] = own * (1.0 - page.linked[k])
        elif children[k]:
            share = DAMPING**styles
            out[k] = (1.0 - share) * own + share * sum(out[c] for c in children[k]) / len(children[k])
    return out


def main_text(page: Page, found: dict[int, tuple[float, int]]) -> str:
    """What is left of the page without its noisy branches, one line a block."""
    importance, kinds = composite(page, found), page.settled()
    # A branch goes if all in it is below the least; so what decides on a run is the run itself.
    kept = [k for k, text in enumerate(page.texts) if text is not None and importance[k] >= LEAST]
    kept = kept or [k for k, text in enumerate(page.texts) if text is not None and kinds[k] != NOISE]
    return "\n".join(page.texts[k] for k in kept)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def importance(pages: DataFrame) -> DataFrame:
    """(page, found) from ``pages`` (page, host, html): the importance and number of styles of each node that has statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("host", "html")]
            rows = [nodes(parsed(source or ""), host) for host, source in zip(*columns, strict=True)]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            flat = [x for row in rows for x in row]
            number = pa.array([x[0] for x in flat], pa.int32())
            hashes = [pa.array(np.array([x[k] for x in flat], np.uint64).view(np.int64)) for k in (1, 2)]
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (number, *hashes)]
            yield pa.RecordBatch.from_pydict({"page": batch.column("page"), **dict(zip(("numbers", "keys", "values"), lists, strict=True))})

    each = pages.mapInArrow(run, "page binary, numbers array<int>, keys array<long>, values array<long>")
    each = written(each.dropDuplicates(["page"]), "nodes")
    each = each.select("page", F.explode(F.arrays_zip("numbers", "keys", "values")).alias("x"))
    each = each.select("page", F.col("x.numbers").alias("number"), F.col("x.keys").alias("key"), F.col("x.values").alias("value"))
    counts = each.groupBy("key", "value").agg(F.count("*").alias("c"))
    stats = counts.groupBy("key").agg(
        F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"), F.count("*").cast("int").alias("styles")
    )
    # Of m pages, c show one value: the entropy to the base m is 1 - sum(c log c) / (m log m).
    stats = stats.where(f"m >= {FEW}").select("key", (1 - F.col("s") / (F.col("m") * F.log("m"))).alias("own"), "styles")
    found = each.join(stats, "key").groupBy("page").agg(F.collect_list(F.struct("number", "own", "styles")).alias("found"))
    return written(found, "importance")


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page its id, its url, ``text`` and ``n_chars``."""
    small_batches(pages.sparkSession)
    pages = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    host = host_of(F.col("url"))
    digest = F.unhex(F.md5(F.concat_ws("\n", host, F.coalesce("html", F.lit(""))).cast("binary")))
    keyed = pages.withColumn("page", digest)
    found = importance(keyed.select("page", host.alias("host"), "html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, rows in zip(batch.column("html").to_pylist(), batch.column("found").to_pylist(), strict=True):
                texts.append(main_text(parsed(source or ""), {r["number"]: (r["own"], r["styles"]) for r in rows or ()}))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string())})

    joined = keyed.join(found, "page", "left").select("page_id", "url", "html", "found")
    out = joined.mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
