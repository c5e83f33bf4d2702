"""A forgiving scan of HTML into start tags, end tags and text, shared by extraction and interleaving."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

_TAG = re.compile(
    r"""<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*"|'[^']*')*+)>  # a tag; quotes may hold >
          |(/?)([a-zA-Z][^\s/>]*)([^>]*)>                              # with an odd quote
          |!--.*?(?:--!?>|\Z)|[!?/][^>]*(?:>|\Z))""",
    re.S | re.X,
)
_OPEN = re.compile(r"<[!?/]")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Elements whose content is no markup, and elements without content.
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a start tag, names in lower case; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(raw):
        out.setdefault(name.lower(), entities.unescape(next((v for v in values if v), "")))
    return out


def scan(html: str) -> Iterator[tuple[str, str, str, int]]:
    """('start', tag, raw attributes, place), ('end', tag, '', place) and ('text', '', decoded text, place) in page order.

    Comments, declarations and what ``RAW`` elements hold are left out. A ``<`` that begins no tag is text.
    A tag needs a ``>``, so none is looked for beyond the last one: the time is linear in the page.
    """
    at, keep, n, last = 0, 0, len(html), html.rfind(">") + 1
    while True:
        m = _TAG.search(html, at, last)
        if m is None:
            m = _OPEN.search(html, max(at, last))  # of what no > ends, comments, declarations and end tags hold no text
            n = m.start() if m else n
            break
        if m.start() > keep:
            yield "text", "", entities.unescape(html[keep : m.start()]), keep
        close, tag, attrs = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        at = keep = m.end()
        if tag is None:
            if m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
                keep = n
                break
            continue
        tag = tag.lower()
        if close:
            yield "end", tag, "", m.start()
            continue
        yield "start", tag, attrs, m.start()
        if tag in RAW:
            end = _CLOSE[tag].search(html, at)
            at = keep = end.start() if end else n
    if keep < n:
        yield "text", "", entities.unescape(html[keep:n]), keep
