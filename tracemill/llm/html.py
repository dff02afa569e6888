"""Main text of pages by equivalence-class template deduction.

Pages become tokens: a structural tag under its path (tag names with their class and id), and the text of
a block under its path. Over the pages of a host each token has an occurrence vector (how often it occurs
on which page). The vector is kept as a fingerprint that any split of the pages can build in parts: the
exclusive or of a hash of (page, count), the number of pages and the sum of counts. Tokens with one
fingerprint form an equivalence class. A class is valid if it occurs on MIN_SHARE of the host's pages, on
MIN_PAGES at least, and has MIN_SIZE tokens; valid classes nest by their paths and make the host's template.
A text in the class of a tag on its path is the template's; what lies between is in slots. The article's
container is the tag of a valid class that holds most of the slots' prose: text of the template does not
count. The tags' names tell what a slot is for (menus, notices, adverts and so on). The slots of the article
are extracted from every page, whole and in page order, also where some of their text is common to pages;
dropped are only texts of the template: links (a menu; a page's own lists of links stay), and a text that its
own tag always holds (a label), if such texts are less than half of the container's. Hosts whose slots are empty
(all pages alike) have no text of the template. Pages whose host has no template with an article (few pages, odd
pages) are judged by the same rules on themselves alone.

Templates are bounded by 1 / MIN_SHARE times a page's mean number of distinct paths per host. They are
broadcast only if their measured size is at most BROADCAST_BYTES; beyond that they are joined by host.
Vectors are summed per task before the shuffle, so a host with a third of all pages is split.

Defined results: null or empty html gives empty text; a null url or one without :// belongs to host '';
repeated rows (also of a page_id) are extracted alike; unclosed and crossing tags are closed as browsers
do for blocks, markup cut off at the end of a page is dropped; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table

#: Production parameters.
MIN_SHARE, MIN_PAGES, MAX_LINK_SHARE, BROADCAST_BYTES = 0.05, 3, 0.6, 32 << 20
#: Tokens of a valid class.
MIN_SIZE = 2

#: HTML's elements, by how they are read.
DROPPED = "script style noscript template textarea iframe title"
#: Elements whose content is no text either, but only up to their end tag: without one the tag alone is dropped. Some nest.
CLOSED, NESTING = frozenset("select button svg math object canvas audio video".split()), frozenset("svg math object".split())
VOID = "area base br col embed hr img input link meta param source track wbr".split()
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br input picture source rp rt ruby".split()
#: A start tag that closes an open element of the first kind, up to a boundary of the second.
CLOSES = {
    **dict.fromkeys("p div ul ol dl table section article aside header footer nav main form h1 h2 h3 h4 h5 h6 pre blockquote fieldset figure hr address details".split(), (("p",), ())),
    "li": (("li", "p"), ("ul", "ol")), "dt": (("dt", "dd", "p"), ("dl",)), "dd": (("dt", "dd", "p"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th", "p"), ("table",)), "td": (("td", "th", "p"), ("tr", "table")), "th": (("td", "th", "p"), ("tr", "table")),
}
#: What tags and the words of class, id and role say about a part of a page.
BOILER_TAGS = frozenset("head nav footer aside form dialog menu header".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead header footer sidebar side rail ad ads advert adverts advertisement sponsor sponsored promo banner "
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments reply replies "
    "respond disqus login search widget pagination pager toolbar skip".split()
)
#: Words that mark boilerplate inside an article only with one of these (or alone), as they are part of other names too.
WITH = {"header": frozenset("site page main top global nav".split()), "side": frozenset("bar rail column nav menu panel".split())}
#: Tags of prose, whose names mark boilerplate only if all their words do.
PROSE = frozenset("p blockquote pre li dd dt td th figcaption h1 h2 h3 h4 h5 h6".split())
ARTICLE_TAGS, ARTICLE_WORDS = ("article", "main"), frozenset("article articlebody main maincontent content post entry story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(DROPPED.split())})\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>|<[!?/a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
_MARK = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


def _label(tag: str, attributes: str) -> str:
    """A tag with the words of its marks; numbers differ from page to page and are left out."""
    if "=" not in attributes:
        return tag
    words = [w for _, *values in _MARK.findall(attributes) for v in values for w in _WORD.findall(v.lower())]
    return ".".join([tag, *dict.fromkeys(words)])


def _end_of(page: str, tag: str, at: int) -> int:
    """Where an element that has begun ends, or 0 if it is not closed."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}\b[^>]*>", re.I).finditer(page, at):
        if not m[1]:
            if tag not in NESTING:
                return 0
            depth += not m[0].endswith("/>")
        elif (depth := depth - 1) == 0:
            return m.end()
    return 0


def blocks(page: str) -> tuple[dict[str, int], list[tuple[str, str, int]]]:
    """How often each path of structural tags occurs, and the blocks of text: (path, text, length of link text)."""
    paths: dict[str, int] = {}
    found: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str]] = []  # (tag, path)
    path, held, links, in_link, at = "", [], 0, False, 0

    def flush() -> None:
        nonlocal held, links
        if held:
            if text := " ".join(entities.unescape("".join(held)).split()):
                found.append((path, text, links))
            held, links = [], 0

    def text(piece: str) -> None:
        nonlocal links
        held.append(piece)
        if in_link:
            links += len(piece)

    for m in _TOKEN.finditer(page):
        if m.start() < at:  # in an element that is passed over
            continue
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in CLOSED:
            if not m[2] and not (m[4] or "").endswith("/"):
                at = _end_of(page, tag, at) or at
            continue
        if tag == "a":
            in_link = not m[2]
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            continue
        flush()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            kinds, bounds = CLOSES.get(tag, ((), ()))
            if kinds:
                stop = max((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in bounds), default=-1) if bounds else -1
                if not bounds:  # a block closes an open paragraph unless another block lies between
                    if stack and stack[-1][0] in kinds:
                        stack.pop()
                else:
                    first = next((k for k in range(stop + 1, len(stack)) if stack[k][0] in kinds), None)
                    if first is not None:
                        del stack[first:]
            here = f"{stack[-1][1] if stack else ''}/{_label(tag, m[4] or '')}"
            paths[here] = paths.get(here, 0) + 1
            if tag not in VOID and not (m[4] or "").endswith("/"):
                stack.append((tag, here))
        path = stack[-1][1] if stack else ""
    if at < len(page):
        text(page[at:])
    flush()
    return paths, found


def _boiler(path: str, root: str) -> bool:
    """Whether a part below root is no part of the article. A heading in an article's own header stays."""
    for part in path[len(root) :].split("/")[1:]:
        tag, *words = part.split(".")
        if tag in BOILER_TAGS and not (tag == "header" and root and path.rsplit("/", 1)[-1].split(".")[0] in HEADINGS):
            return True
        if tag in ("html", "body", *ARTICLE_TAGS) or BOILER_WORDS.isdisjoint(words):
            continue
        if not root:
            return True
        if tag in PROSE:
            if BOILER_WORDS.issuperset(words):
                return True
        elif any(w in BOILER_WORDS and (len(words) == 1 or w not in WITH or not WITH[w].isdisjoint(words)) for w in words):
            return True
    return False


def article(slots: dict[str, tuple[int, int]], paths: list[str]) -> str | None:
    """The path of the article's container: slots have the lengths of text and link text below each path.

    Containers that name themselves (article, main, then by class) win by their prose; else the deepest
    one that holds most of the prose outside boilerplate."""
    prose = {p: t - 2 * k for p, (t, k) in slots.items() if not _boiler(p, "")}
    total = sum(x for x in prose.values() if x > 0)

    def held(root: str) -> int:
        return sum(x for p, x in prose.items() if x > 0 and (p == root or p.startswith(root + "/")))

    clean = [p for p in paths if not _boiler(p, "")]
    for tag in ARTICLE_TAGS:
        if own := [p for p in clean if p.rsplit("/", 1)[-1].split(".")[0] == tag]:
            return max(own, key=lambda p: (held(p), -len(p)))
    if own := [p for p in clean if not ARTICLE_WORDS.isdisjoint(p.rsplit("/", 1)[-1].split(".")[1:])]:
        if held(best := max(own, key=lambda p: (held(p), -len(p)))) >= 0.3 * total > 0:
            return best
    most = [p for p in clean if p.rsplit("/", 1)[-1].split(".")[0] not in ("p", "li", "ul", "ol", "td", "tr", "pre", *HEADINGS) and held(p) >= 0.7 * total > 0]
    return max(most, key=len, default="" if total > 0 else None)


class Template(NamedTuple):
    """The container's path, and the (path, text) in it that are the template's own."""

    root: str | None = None
    fixed: frozenset[tuple[str, int]] = frozenset()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _text_of(text: str) -> int:
    """A block's name as a token; never 0, which names tags."""
    return _signed(xxhash.xxh64_intdigest(text) | 1)


def _below(path: str, root: str) -> bool:
    return path == root or path.startswith(root + "/")


def _sums(found: list[tuple[str, str, int]]) -> dict[str, tuple[int, int]]:
    out: dict[str, tuple[int, int]] = {}
    for path, text, links in found:
        t, k = out.get(path, (0, 0))
        out[path] = (t + len(text), k + min(links, len(text)))
    return out


def extract(page: str | None, template: Template | None) -> str:
    """The article of a page."""
    paths, found = blocks(page or "")
    root, fixed = template or Template()
    if root is None or root not in paths:
        root = article(_sums(found), list(paths))
        fixed = frozenset()
        if root is None:
            return ""
    kept = (b for b in found if _below(b[0], root) and not _boiler(b[0], root))
    return "\n\n".join(text for path, text, _ in kept if not fixed or (path, _text_of(text)) not in fixed)


def _host(url: str | None) -> str:
    return re.split("[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower() if url and "://" in url else ""


VECTORS = "host string, path string, text bigint, vector bigint, pages bigint, occurrences bigint, chars bigint, links bigint"


def vectors(pages: DataFrame) -> DataFrame:
    """Each host's tokens with the fingerprints of their occurrence vectors; text is 0 for a tag, else a hash of the block."""
    kinds = pa.schema([("host", pa.string()), ("path", pa.string()), *((n, pa.int64()) for n in ("text", "vector", "pages", "occurrences", "chars", "links"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(sums: dict) -> pa.RecordBatch:
            rows = [(*k, _signed(v[0]), *v[1:]) for k, v in sums.items()]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

        sums: dict[tuple[str, str, int], list[int]] = {}
        for batch in batches:
            for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                host = _host(url)
                name = f"{page_id}:{xxhash.xxh64_intdigest(page or '')}"  # page_ids can be null or repeated
                paths, found = blocks(page or "")
                tokens = {(p, 0): [n, 0, 0] for p, n in paths.items()}
                for p, text, links in found:
                    t = tokens.setdefault((p, _text_of(text)), [0, 0, 0])
                    t[0] += 1
                    for x in (t, tokens.setdefault((p, 0), [0, 0, 0])):
                        x[1] += len(text)
                        x[2] += min(links, len(text))
                for (p, text), (n, chars, links) in tokens.items():
                    s = sums.setdefault((host, p, text), [0, 0, 0, 0, 0])
                    s[0] ^= xxhash.xxh64_intdigest(f"{name}:{n}")
                    s[1] += 1
                    s[2] += n
                    s[3] += chars
                    s[4] += links
                if len(sums) > 200_000:
                    yield out(sums)
                    sums = {}
        if sums:
            yield out(sums)

    rows = pages.select("page_id", "url", "html").mapInArrow(work, VECTORS)
    return rows.groupBy("host", "path", "text").agg(F.bit_xor("vector").alias("vector"), *[F.sum(c).alias(c) for c in ("pages", "occurrences", "chars", "links")])


def templates(pages: DataFrame) -> DataFrame:
    """host, nodes: the tags and texts with enough support on the host, with their class and sums of text."""
    found = vectors(pages)
    tokens = save(found, "html-vectors")
    hosts = tokens.where("text = 0").groupBy("host").agg(F.max("pages").alias("all_pages"))
    valid = tokens.join(hosts, "host").where((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= MIN_SHARE * F.col("all_pages")))
    # Equal vectors: one class.
    node = F.struct("path", "text", F.xxhash64("vector", "pages", "occurrences").alias("class"), "chars", "links")
    return valid.groupBy("host").agg(F.sort_array(F.collect_list(node)).alias("nodes"))


def deduce(nodes: list[dict] | None) -> Template | None:
    """The article's container and the template's links and labels in it, by a host's tokens with enough support.

    A tag of a valid class nests in the nearest tag of a valid class above it; one that has none above it is left out."""
    if not nodes:
        return None
    sizes = Counter(n["class"] for n in nodes)
    tags = {n["path"]: n for n in nodes if not n["text"]}
    valid = {p for p, n in tags.items() if sizes[n["class"]] >= MIN_SIZE}

    def above(path: str) -> Iterator[str]:
        while path := path.rpartition("/")[0]:
            yield path

    nested = [p for p in tags if p in valid and (p.count("/") == 1 or any(up in valid for up in above(p)))]
    own = [n for n in nodes if n["text"] and any(tags[p]["class"] == n["class"] for p in (n["path"], *above(n["path"])) if p in tags)]
    whole = {p: (n["chars"], n["links"]) for p, n in tags.items() if (up := p.rpartition("/")[0]) == "" or up in tags}
    slots = dict(whole)
    for n in own:
        if n["path"] in slots:
            t, k = slots[n["path"]]
            slots[n["path"]] = (t - n["chars"], k - n["links"])
    if not any(t > 0 for t, _ in slots.values()):
        slots, own = whole, []
    root = article(slots, nested)
    if root is None:
        return None
    own = [n for n in own if _below(n["path"], root)]
    menus = [n for n in own if n["links"] > MAX_LINK_SHARE * n["chars"]]
    labels = [n for n in own if n["path"] in tags and tags[n["path"]]["class"] == n["class"]]
    if 2 * sum(n["chars"] for n in labels) >= sum(t for p, (t, _) in whole.items() if _below(p, root)):
        labels = []
    return Template(root, frozenset((n["path"], n["text"]) for n in menus + labels))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    rules = save(templates(pages), "html-templates")
    size = rules.select(F.sum(F.aggregate("nodes", F.lit(0), lambda n, x: n + F.octet_length(x["path"]) + 48)).cast("long")).first()[0] or 0
    host = F.coalesce(F.lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))
    rules = F.broadcast(rules) if size <= BROADCAST_BYTES else rules
    rows = pages.select("page_id", "url", "html", host.alias("host")).join(rules, "host", "left").select("page_id", "url", "html", "host", "nodes")
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, Template | None] = {}
        for batch in batches:
            page_id, url, page, hosts, nodes = batch.columns
            texts = []
            for k, (page, host) in enumerate(zip(page.to_pylist(), hosts.to_pylist())):
                if host not in cache:
                    if len(cache) > 10_000:
                        cache.clear()
                    cache[host] = deduce(nodes[k].as_py())
                texts.append(extract(page, cache[host]))
            yield pa.RecordBatch.from_arrays([page_id, url, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=kinds)

    return rows.mapInArrow(work, "page_id bigint, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


SQL = None
