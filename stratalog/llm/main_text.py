"""Main text of HTML pages: the structure of each page, and a suffix array over each host's pages.

1. A page is scanned into text blocks. Menus, forms, adverts, comments and the like go by their elements and by class, id and
   role names that say nothing else; an article (else a main part, else all) stays. A name that has such a word among others
   (``share-price``) or a block that is one link only makes its blocks suspect.
2. The blocks of a page become a stream of tokens: the words of a block between two bounds, or one token for the whole
   block where it is short or inside an article. A host's streams are concatenated, one after the other with a separator of its own
   each, and sorted into a suffix array, whose intervals of a common prefix of ``window`` tokens (or of one whole block) are
   the long substrings that several places share; the distinct pages of each interval are counted. The union of those windows is
   what all repeats of ``window`` tokens or more cover. A host beyond ``chunk_tokens`` or ``chunk_pages`` is cut into chunks, an array for each, and
   the counts of equal windows are summed over the chunks; a page and its copies lie in one chunk, so the sums are those of one array.
3. What enough pages share goes: a suspect block's parts from two pages on; what no article or main part holds from a number of pages on,
   or half of a small host; inside an article only blocks that nearly all pages and many of them have whole, since
   passages that several articles quote are part of them. A block keeps the runs of words that no repeat covers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, salted_lookup, saved
from .markup import VOID, attributes, scan
from .quality_rules import common_prefixes, suffix_array

# Elements that begin and end a block, that nest, and that never hold main text.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split()
)
_NESTED = _BLOCK - {"hr", "p", "li", "dt", "dd", "option", "tr"}
_CHROME = frozenset("nav aside footer form button select option datalist noscript template svg annotation annotation-xml canvas object audio video dialog menu head search applet map".split())
_CELL = frozenset("td th br".split())

# Words of class, id and role names, and words that may stand beside them and say nothing of what an element holds.
_CHROME_WORDS = frozenset(
    "nav navbar navigation menu menubar submenu footer sidebar sidenav aside complementary contentinfo ad ads advert adverts advertisement advertising "
    "adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe "
    "subscription signup login share sharing social comment comments commentlist reply replies respond disqus breadcrumb breadcrumbs pagination pager "
    "related recommended recommendations widget widgets toolbar search searchbox form skip disclaimer copyright teaser teasers".split()
)
_PLAIN_WORDS = frozenset(
    "site page main top bottom left right upper lower global primary secondary list lists item items box boxes bar bars block blocks section sections area areas inner outer "
    "wrapper wrap container content row col column columns link links button buttons icon icons group panel header head title text body large small inline "
    "float sticky fixed mobile desktop post posts article articles entry entries story stories news blog user users reader readers thread slot unit message".split()
)
#: Of those, the ones that may as well say what a part of an article is about; there they only raise suspicion.
_OWN_WORDS = frozenset("menu banner copyright reply replies respond notice notices alert dialog search form disclaimer teaser teasers aside".split())
_HEADER_WORDS = frozenset("header masthead topbar".split())
_LAYOUT_WORDS = frozenset("with has no without layout enabled disabled template theme single".split())
_MAIN_WORDS = frozenset("content main article story entry post".split())
_ARTICLE_NAMES = frozenset("articlebody article-body article-content post-content entry-content story-body post-body".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD, _SENTENCE = re.compile(r"[^\W\d_]{2}"), re.compile(r"[.!?。！？…]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    """``level`` of the place: 2 article, 1 main part, 0 neither; ``linked``: share of letters in links; ``prose``: a paragraph, or words outside links or a sentence's end."""

    text: str
    level: int
    linked: float
    links: int
    heading: bool
    suspect: bool
    prose: bool = False


#: Kinds of blocks for the host's verdict.
OPEN, INSIDE, SUSPECT = 0, 1, 2


@dataclass(frozen=True)
class Limits:
    """``window``: tokens of the shortest repeat, a power of two. Outside articles it goes if ``many`` distinct pages of the host have it, or the share
    ``share`` of them if those are fewer, and ``pages`` at least; inside if ``article_pages`` and the share ``article_share`` have the whole
    block; in suspect blocks if ``suspect_pages`` do. ``chunk_tokens`` and ``chunk_pages`` bound one suffix array and change no result.
    """

    window: int = 16
    pages: int = 3
    share: float = 0.5
    many: int = 12
    article_pages: int = 12
    article_share: float = 0.8
    suspect_pages: int = 2
    link_share: float = 0.6
    chunk_tokens: int = 1 << 20
    chunk_pages: int = 512


def _named(name: str, inside: bool) -> tuple[bool, bool]:
    """Whether a name says that its element is no main text, and whether it might say so: a telling word among others, or one that may as well be an article's own."""
    parts = {x.lower() for x in _PART.findall(name)}
    telling = parts & _CHROME_WORDS if inside else parts & (_CHROME_WORDS | _HEADER_WORDS)
    if not telling or parts & _LAYOUT_WORDS:
        return False, False
    rest = {x for x in parts - telling - _PLAIN_WORDS if len(x) > 2}
    sure = not rest and not (inside and telling <= _OWN_WORDS)
    return sure, not sure


def _role(tag: str, raw: str, inside: bool) -> tuple[bool, bool, int]:
    """Whether an element is no main text by its names, whether it might be none, and its level as a place of it."""
    level = 2 if tag == "article" else 1 if tag == "main" else 0
    if "=" not in raw and "hidden" not in raw:
        return False, False, level
    a = attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
        return True, False, level
    names = f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}".split()
    if a.get("itemprop", "").lower() == "articlebody" or any(x.lower() in _ARTICLE_NAMES for x in names):
        level = 2
    elif a.get("role") == "main":
        level = max(level, 1)
    if tag in ("html", "body"):
        return False, False, 0
    suspect = False
    for name in names:
        sure, maybe = _named(name, inside)
        if sure:
            return True, False, level
        suspect |= maybe
        parts = {x.lower() for x in _PART.findall(name)}
        if level == 0 and not maybe and tag in ("div", "section", "td") and len(parts) <= 2 and parts & _MAIN_WORDS and not parts & _LAYOUT_WORDS:
            level = 1
    return False, suspect, level


def parse(html: str, names: bool = True) -> list[Block]:
    """The blocks that no structure rules out, in page order; in time linear in the page, however its tags are nested or left open."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool, bool]] = []  # tag, dropped, level, unclosed, suspect
    count: Counter = Counter()  # tags on the stack
    loose: list[int] = []  # places of unclosed ones on it
    last_end: dict[str, int] = {}
    drop, level, suspect, first = False, 0, False, False
    text: list[str] = []
    linked = links = 0
    prose = paragraph = False

    def flush() -> None:
        nonlocal linked, links, first, prose
        joined = " ".join("".join(text).split())
        if joined:
            out.append(Block(joined, level, min(1.0, linked / len(joined)), links, first, suspect, prose or paragraph or bool(_SENTENCE.search(joined))))
        text.clear()
        linked, links, first, prose = 0, int(count["a"] > 0), False, False

    def cut(at: int) -> None:
        nonlocal drop, level, suspect
        count.subtract(x[0] for x in stack[at:])
        del stack[at:]
        while loose and loose[-1] >= at:
            loose.pop()
        _, drop, level, _, suspect = stack[-1] if stack else ("", False, 0, False, False)

    def pop(tag: str) -> None:
        if not count[tag]:
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                return cut(i)
            if stack[i][0] in _NESTED and tag not in _NESTED:
                return

    def closes(tag: str, place: int) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(f"</{tag}", html, re.I)), default=-1)
        return last_end[tag] >= place

    for kind, tag, raw, place in scan(html):
        if kind == "text":
            if not drop:
                text.append(raw)
                linked += len(raw) if count["a"] else 0
                prose |= not count["a"] and bool(_WORD.search(raw))
            continue
        if tag in _BLOCK:
            flush()
            paragraph = tag == "p" and kind != "end"
        elif tag in _CELL:
            text.append(" ")
        if kind == "end":
            pop(tag)
            continue
        if tag in VOID:
            continue
        if tag in ("p", "li", "dt", "dd", "option", "tr") or tag in _NESTED:
            pop("p")
            if tag in ("li", "option", "tr"):
                pop(tag)
        if tag in ("article", "main", "h1", "section", "footer", "body") and loose:
            cut(loose[0])  # a menu that nothing closes ends here
        if tag == "body":
            cut(0)
        if tag == "a":
            pop("a")  # links don't nest
            links += 1
        named, maybe, own = _role(tag, raw, level > 0) if names or tag in ("article", "main") else (False, False, 0)
        chrome = tag in _CHROME or (tag == "header" and level == 0)
        gone = drop or chrome or (named and names)
        if tag == "h1" and not gone:
            first = True
        doubt = suspect or (maybe and names)
        if gone != drop or doubt != suspect or own > level or tag in _NESTED or tag == "a":
            unclosed = chrome and not drop and tag != "head" and not closes(tag, place)
            if unclosed:
                loose.append(len(stack))
            drop, level, suspect = gone, max(level, own), doubt
            stack.append((tag, drop, level, unclosed, suspect))
            count[tag] += 1
    flush()
    return out


def select(blocks: list[Block], link_share: float) -> list[tuple[str, int]]:
    """(text, kind) of the blocks of the innermost place that holds the main text.

    Where neither article nor main part says what that is, blocks of nothing but links go, several or short ones; one that is a
    single link of some words is suspect, and so is a paragraph of links, or a block with words beside them or a sentence's end. A block of a suspect element goes if it is links and no prose.
    """
    size = [0, 0, 0]
    for b in blocks:
        size[b.level] += len(b.text)
    if size[2] and 4 * size[2] >= size[1]:
        title = not any(b.heading and b.level == 2 for b in blocks)
        placed = [(b, INSIDE) for b in blocks if b.level == 2 or (title and b.heading and b.level == 1)]
    elif size[1] or size[2]:
        placed = [(b, INSIDE) for b in blocks if b.level]
    else:
        placed = [(b, SUSPECT if b.linked > link_share else OPEN) for b in blocks if b.linked <= link_share or b.prose or (b.links == 1 and len(b.text.split()) > 4)]
    return [(b.text, SUSPECT if b.suspect else kind) for b, kind in placed if not (b.suspect and b.linked > link_share and not b.prose)]


def page_blocks(html: str, link_share: float = 0.6) -> list[tuple[str, int]]:
    """What the structure of a page leaves; where names rule out every block, elements alone decide."""
    return select(parse(html), link_share) or select(parse(html, names=False), link_share)


# --- token streams -----------------------------------------------------------

_RNG = np.random.default_rng(13)
_BOUND, _WHOLE, _END = (int(x) for x in _RNG.integers(1, 2**63, 3))


def stream(blocks: list[tuple[str, int]], host: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a page's blocks, the kind of the block of each, and how many tokens of its block follow with it; 0: the token is a whole block.

    A block inside an article, or with fewer tokens than a window, is one token. Tokens of different hosts differ.
    """
    tokens: list[int] = []
    kinds, room = [], []
    for text, kind in blocks:
        words = text.split(" ")
        if kind == INSIDE or len(words) + 2 < window:
            tokens.append(xxhash.xxh3_64_intdigest(text) ^ _WHOLE)
            room.append(0)
        else:
            tokens += [_BOUND, *map(xxhash.xxh3_64_intdigest, words), _BOUND]
            room += range(len(words) + 2, 0, -1)
        kinds += [kind] * (len(room) - len(kinds))
    return mix(np.array(tokens, np.uint64) ^ np.uint64(host & (2**64 - 1))), np.array(kinds, np.int8), np.array(room, np.int32)


@cache
def _factors(window: int) -> np.ndarray:
    return np.random.default_rng(17).integers(0, 2**63, window, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(tokens: np.ndarray, room: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window or a whole block begins, and their keys: equal for equal windows of a host."""
    long, whole = np.flatnonzero(room >= window), np.flatnonzero(room == 0)
    keys = np.zeros(len(long), np.uint64)
    for k, factor in enumerate(_factors(window) if len(long) else ()):
        keys += tokens[long + k] * factor
    return np.concatenate([long, whole]), mix(np.concatenate([keys, tokens[whole] ^ np.uint64(_WHOLE)])).view(np.int64)


def shared_windows(pages: list[tuple[np.ndarray, np.ndarray]], window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the windows and whole blocks that ``least`` of the ``pages`` (tokens, room) have, and how many have each, by one suffix array."""
    sizes = np.array([len(t) + 1 for t, _ in pages])
    at = np.cumsum(sizes) - sizes
    tokens = np.concatenate([np.append(t, mix(np.uint64([i]) ^ np.uint64(_END))) for i, (t, _) in enumerate(pages)])
    room = np.concatenate([np.append(r, np.int32(-1)) for _, r in pages])  # a page's end begins no window
    place, key = windows(tokens, room, window)
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    array, levels = suffix_array(tokens)
    lcp = common_prefixes(array, levels)
    rank = np.empty(len(array), np.int64)
    rank[array] = np.arange(len(array))
    # the interval of the suffixes that share the window as a prefix; whole blocks in numbers of their own
    interval = np.where(room[place] == 0, np.cumsum(lcp < 1)[rank[place]], np.cumsum(lcp < window)[rank[place]] + len(array) + 1)
    page = np.searchsorted(at, place, side="right") - 1
    pair = np.unique(interval * len(pages) + page)
    found, n = np.unique(pair // len(pages), return_counts=True)
    _, first = np.unique(interval, return_index=True)
    return key[first][n >= least], n[n >= least]


def uncovered(blocks: list[tuple[str, int]], host: int, gone: list[dict], limits: Limits) -> list[str]:
    """The blocks without what the windows of ``gone`` (kind, key) cover; inside an article nothing goes if that were most of the page."""
    tokens, kinds, room = stream(blocks, host, limits.window)
    place, key = windows(tokens, room, limits.window)
    hit = np.zeros(len(place), bool)
    for kind in (OPEN, INSIDE, SUSPECT):
        hit |= (kinds[place] == kind) & np.isin(key, np.array([g["key"] for g in gone if g["kind"] == kind], np.int64))
    change = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(change, place[hit], 1)
    np.subtract.at(change, place[hit] + np.where(room[place[hit]] == 0, 1, limits.window), 1)
    covered = np.cumsum(change[:-1]) > 0
    kept, at, lost, total = [], 0, 0, 0
    for text, kind in blocks:
        words = text.split(" ")
        total += len(words)
        if room[at] == 0:
            left = [] if covered[at] else words
            lost += len(words) - len(left) if kind == INSIDE else 0
            at += 1
        else:
            left = [w for w, c in zip(words, covered[at + 1 :], strict=False) if not c]
            at += len(words) + 2
        kept.append((text, " ".join(left), kind))
    spare = 2 * lost > total  # no article is all boilerplate
    return [x for x in (text if spare and kind == INSIDE else left for text, left, kind in kept) if x]


# --- hosts -------------------------------------------------------------------


def host_of(url_col: str = "url") -> F.Column:
    host = F.regexp_extract(F.lower(F.col(url_col)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(host, F.lit(""))


def verdicts(streams: DataFrame, limits: Limits) -> DataFrame:
    """key, and in which kinds of blocks the windows of that key go: outside, inside, suspect; streams: host, page, tokens, room, one row a page.

    A key covers its host. The counts of a host's chunks are partial sums; nothing but keys and counts leaves a chunk.
    """
    sizes = streams.groupBy("host").agg(F.count("*").alias("pages"), F.sum(F.size("tokens") + 1).alias("tokens"))
    sizes = sizes.where("pages > 1").select("host", "pages", F.ceil(F.greatest(F.col("tokens") / limits.chunk_tokens, F.col("pages") / limits.chunk_pages)).cast("int").alias("chunks"))
    rows = salted_lookup(streams, sizes, "host", F.col("page")).where("chunks is not null")
    rows = rows.select("host", F.pmod("page", "chunks").alias("chunk"), "chunks", "page", "tokens", "room")
    least = min(limits.pages, limits.article_pages, limits.suspect_pages)

    def count(t: pa.Table) -> pa.Table:
        lists = [x.combine_chunks() for x in (t["tokens"], t["room"])]
        pages = [(a.values.to_numpy().view(np.uint64), b.values.to_numpy()) for a, b in zip(*lists, strict=True)]
        key, n = shared_windows(pages, limits.window, least if t["chunks"][0].as_py() == 1 else 1)
        return pa.table({"host": pa.array(np.full(len(key), t["host"][0].as_py())), "key": key, "n": n})

    counts = rows.groupBy("host", "chunk").applyInArrow(count, "host long, key long, n long")
    counts = counts.groupBy("host", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    n = F.col("n")
    outside = (n >= limits.pages) & ((n >= limits.many) | (n >= limits.share * F.col("pages")))
    inside = (n >= limits.article_pages) & (n >= limits.article_share * F.col("pages"))
    found = counts.join(sizes, "host").select("key", outside.alias("outside"), inside.alias("inside"), (n >= limits.suspect_pages).alias("suspect"))
    return found.where("outside or inside or suspect")


def main_text(pages: DataFrame, limits: Limits = Limits(), repeats: bool = True) -> DataFrame:
    """page_id, url, text (blocks joined by an empty line), n_chars (code points) for every row of ``pages`` (page_id, url, html).

    A null or empty html, and a page of boilerplate alone, gives an empty text. Rows without a url form one host. Repeated rows and equal pages of a host
    are extracted alike and count once as evidence; other columns are ignored; an empty table gives an empty result. ``repeats`` false: by structure alone.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.xxhash64(host_of()).alias("host"))
    rows = rows.withColumn("page", F.xxhash64("host", "html"))
    id_type = rows.schema["page_id"].dataType.simpleString()
    kind_of = pa.list_(pa.struct([("kind", pa.int8()), ("key", pa.int64())]))

    def to_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for html, host in zip(b.column("html").to_pylist(), b.column("host").to_pylist(), strict=True):
                tokens, kinds, room = stream(page_blocks(html, limits.link_share), host, limits.window)
                place, key = windows(tokens, room, limits.window)
                out.append((tokens.view(np.int64), room, sorted(set(zip(kinds[place].tolist(), key.tolist(), strict=True)))))
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            keys = pa.array([[{"kind": k, "key": x} for k, x in row] for row in cols[2]], kind_of)
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("page"), pa.array(cols[0], pa.list_(pa.int64())), pa.array(cols[1], pa.list_(pa.int32())), keys], names=["host", "page", "tokens", "room", "keys"])

    def to_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for html, host, gone in zip(b.column("html").to_pylist(), b.column("host").to_pylist(), b.column("gone").to_pylist(), strict=True):
                blocks = page_blocks(html, limits.link_share)
                texts.append("\n\n".join(uncovered(blocks, host, gone, limits) if gone else (t for t, _ in blocks)))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    gone_type = "array<struct<kind:tinyint,key:bigint>>"
    if repeats:
        streams = rows.select("host", "page", "html").mapInArrow(to_streams, f"host long, page long, tokens array<long>, room array<int>, keys {gone_type}")
        # what the array needs is stored; pages are parsed once more below rather than kept
        streams = saved(streams.where("size(tokens) > 0").groupBy("page").agg(*(F.first(c).alias(c) for c in ("host", "tokens", "room", "keys"))), "streams")
        hits = salted_lookup(streams.select("page", F.explode("keys").alias("k")).select("page", "k.kind", "k.key"), verdicts(streams, limits), "key", F.col("page"))
        hits = hits.where(f"(kind = {OPEN} and outside) or (kind = {INSIDE} and inside) or (kind = {SUSPECT} and suspect)")
        # stored, so that Spark knows its size when it plans: few pages with something to remove are no reason to shuffle all
        gone = saved(hits.groupBy("page").agg(F.collect_set(F.struct("kind", "key")).alias("gone")), "gone")
        rows = rows.join(gone, "page", "left")
    else:
        rows = rows.withColumn("gone", F.lit(None).cast(gone_type))
    out = rows.select("page_id", "url", "html", "host", "gone").mapInArrow(to_text, f"page_id {id_type}, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
