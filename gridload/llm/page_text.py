"""Main text of web pages by site template removal.

Each page is parsed into elements, and every block element outside article prose gets a hash of its subtree
(tag, class words, text with digits levelled, child hashes). Spark counts per host on how many pages each
subtree hash occurs, pages with equal main text as one; subtrees that recur on at least ``min_pages`` pages, or on
``ratio`` of the host's pages and at least ``floor`` of them, are template and deleted, with all they hold. Elements that name themselves
boilerplate (nav, footer, aside, form, script, class tokens such as ``ad`` or ``cookie-notice``) are counted too and
go; a token names what its last word says (``related-work`` is work), and nothing after ``with`` or ``no``. A form or named
box that wraps the only article, main element or h1 of a page and most of its text is no boilerplate, nor one without which the page has no text. If a page has an article or main element, only what lies in it is main text. Boxes in it (div, section,
lists, tables; in a main element without article also paragraphs) are counted like others, apart from those outside;
a box with half of the article's text or more is its body and stays unless most of it is links. Prose tags of an
article are not counted by themselves, so a paragraph that stands in no box stays however often it recurs.

Text: character references decoded once, blanks in a block levelled to one space, blocks joined in page order by
one space. Elements nest to any depth. Null html counts as empty and gives an empty text; unclosed, misnested and cut-off markup is
read as far as it goes. Null urls form one host. Repeated rows are separate pages; extra columns aren't read; an
empty table gives an empty result. Parsing state is one page; counts are partial and final aggregates, and only
pages with undecided blocks take part in the join.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridload.llm.common import stage

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre section summary table
tbody td tfoot th thead tr ul""".split())
#: Words of a class token after which it no longer names the element itself (``with-sidebar``).
STANCE = frozenset("with no has have without not is hide show hidden".split())
#: Last words that say only that the token's first word is held here (``comment-list``, ``ad-slot``).
HOLDERS = frozenset("""area articles bar block body box bottom button buttons card cell col column container content form frame
group holder icons inner item items label left link links list main message news outer overlay panel post posts prompt reading region
right row section slot stories text thread title top trail unit wrap wrapper zone""".split())
#: First words with which ``header`` is the page's header, not that of an article or a box.
PAGE_HEADS = frozenset("header site page global top main web app masthead".split())
#: Tags that may wrap a whole page although they, or their class, look like boilerplate.
WRAPPERS = frozenset("form div section table tbody tr td center span main article".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt td th article main body html".split())
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "option", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}
#: Start tags that end an open element of the named kinds within the given bounds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
        "option": ({"option"}, {"select"})}
BOILERPLATE_TAGS = frozenset("""head script style noscript template nav aside footer form iframe svg canvas button select
textarea input dialog menu object noembed noframes""".split())
BOILERPLATE_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav
navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices popup modal
overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations comment
comments respond replies reply disqus widget toolbar pagination pager skip copyright disclaimer""".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo search complementary dialog alertdialog form menu menubar".split())

#: Parts of a list or table, which are counted with the whole of it where it stands in an article or main element.
PARTS = frozenset("li tr tbody thead tfoot caption legend summary option".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|[^<]+|<""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_WORDS = re.compile(r"[a-z0-9]+")


def named_boilerplate(classes: str, in_main: bool) -> bool:
    """Does a token of the class and id text (lower case) name boilerplate?"""
    for token in classes.split():
        words = [w for w in _WORDS.findall(token.split("--")[0]) if not w[0].isdigit()]
        if not words or STANCE & set(words):
            continue
        first, last = words[0], words[-1]
        if last in ("header", "masthead"):
            if not in_main and first in PAGE_HEADS:
                return True
        elif last in BOILERPLATE_WORDS or first in BOILERPLATE_WORDS and last in HOLDERS:
            return True
    return False


def host_of(url: str | None) -> str:
    """Host of a url without ``www.``, or an empty string."""
    try:
        return re.sub(r"^www\d*\.", "", (urlsplit(url or "").hostname or "").lower())
    except ValueError:
        return ""


class _Element:
    __slots__ = ("tag", "junk", "content", "digest", "counted", "root", "up", "chars", "linked", "key", "number", "holds", "first", "last")

    def __init__(self, tag: str, junk: bool, content: bool, words: str, counted: bool, root: _Element | None, up: _Element | None,
                 number: int | None, holds: bool, first: int):
        self.tag, self.junk, self.content, self.counted, self.root, self.up = tag, junk, content, counted, root, up
        self.digest = hashlib.blake2b(f"{'in ' if root else ''}{tag} {words}".encode(), digest_size=8) if counted else None
        self.chars = self.linked = 0
        self.number, self.holds, self.first = number, holds, first
        self.key = None


def parse_page(html: str, spared: frozenset[int] | None = None) -> tuple[list[str], list[tuple[int, int, int]], list[int]]:
    """Blocks of main text; the counted subtrees that hold some, as (key, first block, end), so that a page needs
    one entry an element however deep it nests; and the distinct keys of all counted subtrees.

    ``spared`` numbers the elements that look like boilerplate but wrap the main text; a first pass finds them.
    """
    stack: list[_Element] = []
    blocks: list[tuple[bool, str]] = []  # in an article or main element, text
    suspects = 0  # elements that look like boilerplate
    wraps: list[_Element] = []  # the outermost of them that may wrap a page, and those that hold an article, main element or h1
    boxes: list[_Element] = []  # counted elements with text
    open_: Counter[str] = Counter()  # elements of each tag in the stack
    held: _Element | None = None  # innermost open counted element
    keys: set[int] = set()
    inner: list[_Element] = []  # counted elements inside an article or main element
    roots: list[_Element] = []  # open article and main elements
    buffer: list[str] = []
    raw = None  # an open element whose content is no markup
    junk = content = link = 0

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                blocks.append((content > 0, text))

    def pop() -> None:
        nonlocal junk, content, link, held
        e = stack[-1]
        if e.tag in BLOCK:
            flush()
        stack.pop()
        open_[e.tag] -= 1
        junk, content, link = junk - e.junk, content - e.content, link - (e.tag == "a")
        if e.content:
            roots.pop()
        if e.counted:
            held = e.up
            e.last = len(blocks)
            if e.last > e.first:
                boxes.append(e)
            e.key = int.from_bytes(e.digest.digest(), "little", signed=True)
            if e.root:
                inner.append(e)
            else:
                keys.add(e.key)
        if e.junk and e.tag in WRAPPERS and (e.holds or not junk):
            wraps.append(e)
        if stack:
            up = stack[-1]
            up.holds = up.holds or e.holds
            if not e.junk:
                up.chars, up.linked = up.chars + e.chars, up.linked + e.linked
        if held and e.key is not None:
            held.digest.update(e.key.to_bytes(8, "little", signed=True))

    at = 0
    while at < len(html):
        if raw:
            end = re.compile(rf"</{raw}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            stop = end.start() if end else len(html)
            if not junk:
                buffer.append(entities.unescape(html[at:stop]))
            at, raw = end.end() if end else stop, None
            pop()
            continue
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            token = m[0]
            if token == "<" and re.match(r"/?[A-Za-z]", html[at:at + 2]):  # a tag with an open quote ends at the next >
                at = html.find(">", at) + 1 or len(html)
                continue
            if token[0] != "<" or token == "<":
                text = token if junk else entities.unescape(token)
                if not junk:
                    buffer.append(text)
                if held:
                    level = re.sub(r"\d+", "0", " ".join(text.split()))
                    if level:
                        held.digest.update(level.encode("utf-8", "surrogatepass"))
                if stack:
                    n = len(text.strip())
                    stack[-1].chars += n
                    stack[-1].linked += n if link else 0
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br" or tag == "p" and not open_["p"]:
                flush() if tag == "p" else buffer.append(" ")
            elif open_[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            if tag in ("br", "hr") and not junk:
                buffer.append(" ") if tag == "br" else flush()
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1) if open_["p"] else ():
                if stack[i].tag == "p":
                    while len(stack) > i:
                        pop()
                    break
                if stack[i].tag in BLOCK:
                    break
        elif tag in ENDS:
            kinds, bounds = ENDS[tag]
            for i in range(len(stack) - 1, -1, -1) if any(open_[k] for k in kinds) else ():
                if stack[i].tag in bounds:
                    break
                if stack[i].tag in kinds:
                    while len(stack) > i:
                        pop()
                    break
        attrs = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(m[3])} if m[3].strip(" /") else {}
        words = " ".join(attrs.get(k, "") for k in ("class", "id")).lower()
        role = attrs.get("role", "").lower()
        comment = tag == "article" and not {"comment", "reply"}.isdisjoint(_WORDS.findall(words))
        bad = (tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
               or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I) is not None
               or tag == "header" and not content
               or comment or tag not in ("html", "body", "main", "article", "h1") and named_boilerplate(words, content > 0))
        holds = tag in ("article", "main", "h1") and not bad
        suspects += bad
        number = suspects if bad else None
        if spared and number in spared:
            bad = False
        inside = not bad and not junk and (tag in ("article", "main") or role in ("main", "article"))
        if tag in BLOCK:
            flush()
        kept = PROSE | PARTS if any(e.tag == "article" for e in roots) else PARTS if roots else ()
        counted = tag in BLOCK and not (tag in kept or tag in ("html", "body") or inside)
        stack.append(_Element(tag, bad, inside, words, counted, roots[0] if roots else None, held,
                              number, holds, len(blocks)))
        open_[tag] += 1
        if counted:
            held = stack[-1]
        if inside:
            roots.append(stack[-1])
        junk, content, link = junk + bad, content + inside, link + (tag == "a")
        if tag in RAW:
            raw = tag
    while stack:
        pop()
    flush()
    for e in inner:
        if not e.junk and 2 * e.chars >= e.root.chars and 2 * e.linked < e.chars:
            e.key = None  # the body of the article, not a box in it
        else:
            keys.add(e.key)
    main = any(b[0] for b in blocks)
    if spared is None and not main:
        holding = [e for e in wraps if e.holds]
        outside = sum(len(text) for _, text in blocks)
        wrapping = frozenset(e.number for e in holding) if sum(e.chars for e in holding) > outside else frozenset()
        if not wrapping and not blocks and wraps:
            most = max(wraps, key=lambda e: e.chars)
            wrapping = frozenset([most.number]) if most.chars > 2 * most.linked else wrapping
        if wrapping:
            return parse_page(html, wrapping)
    before = [0]
    for b in blocks:
        before.append(before[-1] + (b[0] == main))
    spans = [(e.key, before[e.first], before[e.last]) for e in boxes if e.key is not None and before[e.last] > before[e.first]]
    return [text for in_main, text in blocks if in_main == main], spans, sorted(keys)


def without(blocks: list[str], spans: list[tuple[int, int]]) -> str:
    """The blocks outside all spans, joined by a space."""
    kept, at = [], 0
    for lo, hi in sorted(spans):
        if lo > at:
            kept += blocks[at:lo]
        at = max(at, hi)
    return " ".join(kept + blocks[at:])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = 0.2,
            min_pages: int = 10, floor: int = 3) -> DataFrame:
    """Per page row: id, url, text (empty if none)."""
    span = pa.struct([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, texts, open_, spans, counted, digests = [], [], [], [], [], []
            for url, html in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                blocks, boxes, keys = parse_page(html or "")
                text = " ".join(blocks)
                hosts.append(host_of(url))
                texts.append(None if boxes else text)
                open_.append(blocks if boxes else [])
                spans.append([{"key": k, "lo": lo, "hi": hi} for k, lo, hi in boxes])
                counted.append(keys)
                raw = text.encode("utf-8", "surrogatepass")
                digests.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(hosts, pa.string()), pa.array(texts, pa.string()),
                 pa.array(open_, pa.list_(pa.string())), pa.array(spans, pa.list_(span)),
                 pa.array(counted, pa.list_(pa.int64())), pa.array(digests, pa.int64())],
                names=["id", "url", "host", "text", "blocks", "spans", "keys", "digest"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [without(blocks, [(h["lo"], h["hi"]) for h in hits or []])
                     for blocks, hits in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    id_type = rows.schema["id"].dataType.simpleString()
    parsed = stage(rows.mapInArrow(run, f"id {id_type}, url string, host string, text string, blocks array<string>, "
                                   "spans array<struct<key:bigint,lo:int,hi:int>>, keys array<bigint>, digest bigint")
                   .withColumn("rid", F.monotonically_increasing_id()), "pages-parsed")
    template = template_subtrees(parsed, ratio, min_pages, floor)
    undecided = parsed.where(F.col("text").isNull())
    hits = (undecided.select("rid", "host", F.explode("spans").alias("s")).select("rid", "host", "s.*")
            .join(template, ["host", "key"]).groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("hits")))  # of one page
    closed = (undecided.select("rid", "id", "url", "blocks").join(hits, "rid", "left").select("id", "url", "blocks", "hits")
              .mapInArrow(close, f"id {id_type}, url string, text string"))
    return (parsed.where(F.col("text").isNotNull()).select("id", "url", "text").unionByName(closed)
            .withColumnRenamed("id", id_col))


def template_subtrees(parsed: DataFrame, ratio: float, min_pages: int, floor: int) -> DataFrame:
    """host, key of the subtrees that recur on ``min_pages`` of a host's pages, or on ``ratio`` of them and ``floor`` pages.

    Pages of a host with equal main text (copies) count as one.
    """
    totals = parsed.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = (parsed.select("host", "digest", F.explode("keys").alias("key")).distinct()
              .groupBy("host", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min(floor, min_pages)))
    often = (F.col("pages") >= min_pages) | (F.col("pages") >= F.lit(ratio) * F.col("host_pages"))
    return stage(counts.join(totals, "host").where(often).select("host", "key"), "pages-template")
