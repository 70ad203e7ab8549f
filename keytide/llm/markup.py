"""A small HTML reader: the events of a page in order, tolerant of broken markup."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content isn't text.
OPAQUE = frozenset(("script", "style", "template", "noscript"))
BLOCKS = frozenset(
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table td th title tr ul".split()
)
MEDIA = frozenset(("img", "audio", "video", "source", "embed"))


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('open', name, attributes) and ('close', name, '')."""
    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            if at < len(page):
                yield "text", html.unescape(page[at:]), ""
            return
        if m.start() > at:
            yield "text", html.unescape(page[at : m.start()]), ""
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in OPAQUE and not m[3].endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.start() if end else len(page)


def plain_text(page: str) -> tuple[str, str, list[str]]:
    """Text with a line per block, the title, and the targets of links."""
    lines: list[list[str]] = [[]]
    links, title, inside = [], [], False
    for kind, x, raw in events(page):
        if kind == "text":
            (title if inside else lines[-1]).append(x)
            continue
        if kind == "open" and x == "a" and (target := attributes(raw).get("href")):
            links.append(target)
        if x == "title":
            inside = kind == "open"
        if x in BLOCKS and lines[-1]:
            lines.append([])
    flat = [" ".join("".join(x).split()) for x in lines]
    return "\n".join(x for x in flat if x), " ".join("".join(title).split()), links
