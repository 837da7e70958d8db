"""Leaf blocks of an HTML page: runs of text between block-level tags, with the path of tags above them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|noscript|iframe|svg|math|head|object|textarea|select)\b(?P<rawattrs>[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+)>"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+)>|<[!?][^>]*>""",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Tags inside a line of text: they neither end a block nor appear in its path.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags that have no end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


#: Open tags that a tag ends although their end tags are left out, and the tags that bound the search for them.
_TABLE = frozenset({"table"})
ENDED_BY = {
    "li": ((frozenset({"li"}), frozenset({"ul", "ol", "menu"})),), "dt": ((frozenset({"dt", "dd"}), frozenset({"dl"})),), "dd": ((frozenset({"dt", "dd"}), frozenset({"dl"})),),
    "td": ((frozenset({"td", "th"}), _TABLE | {"tr"}),), "th": ((frozenset({"td", "th"}), _TABLE | {"tr"}),), "tr": ((frozenset({"tr"}), _TABLE),),
    "tbody": ((frozenset({"thead", "tbody", "tfoot"}), _TABLE),), "thead": ((frozenset({"thead", "tbody", "tfoot"}), _TABLE),), "tfoot": ((frozenset({"thead", "tbody", "tfoot"}), _TABLE),),
    "option": ((frozenset({"option"}), frozenset({"select", "optgroup", "datalist"})),),
}


@dataclass
class Block:
    """``path`` holds the distinct tags above, outermost first, and their class words with a leading dot; the innermost tag comes last."""

    path: tuple[str, ...]
    text: str
    link_chars: int


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    path: tuple[str, ...] = ()
    pieces: list[str] = []
    links, in_link = 0, False

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(path, text, min(links, len(text))))
            pieces.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        piece = html.unescape(raw) if "&" in raw else raw
        pieces.append(piece)
        if in_link:
            links += len(piece.strip())

    held: dict[str, int] = {}  # how many open tags bring each name of the path, in order of the first
    depth: dict[str, int] = {}  # how many open tags have each name

    def opened(name: str, names: tuple[str, ...]) -> None:
        open_.append((name, names))
        depth[name] = depth.get(name, 0) + 1
        for x in names:
            held[x] = held.get(x, 0) + 1

    def closed() -> str:
        name, names = open_.pop()
        depth[name] -= 1
        for x in names:
            held[x] -= 1
            if not held[x]:
                del held[x]
        return name

    def shut(name: str) -> bool:
        if not depth.get(name):
            return False
        while closed() != name:
            pass
        return True

    def new_path() -> tuple[str, ...]:
        if not open_:
            return ()
        inner = open_[-1][0]
        names = list(held)
        last = next((x for x in reversed(names) if x[0] != "."), inner)
        return tuple(names) if last == inner else (*names, inner)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if raw := m["raw"]:
            # its content is no text of the page; "header" and the like do not match because of the word boundary
            if not m["rawattrs"].endswith("/"):
                close = re.compile(rf"</{raw}\s*>", re.I).search(page, at)
                # as browsers do, an open script or style takes the rest of the page
                at = close.end() if close else (len(page) if raw.lower() in ("script", "style", "textarea") else at)
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                in_link = not m["end"]
            elif name == "br":
                pieces.append(" ")
            continue
        flush()
        if name in VOID:
            continue
        if m["end"]:
            if shut(name):
                path = new_path()
            continue
        for before, within in ENDED_BY.get(name, ()):
            # the end tag may be left out: look no further up than the list, table or row that both stand in
            k = len(open_) - 1 if any(depth.get(x) for x in before) else -1
            while k >= 0 and open_[k][0] not in within and open_[k][0] not in before:
                k -= 1
            if k >= 0 and open_[k][0] in before:
                while len(open_) > k:
                    closed()
        if open_ and open_[-1][0] == "p":
            closed()
        words = [x.lower() for a, b, c in _NAMED.findall(m["attrs"]) for x in _PART.findall(a or b or c)]
        opened(name, (name, *("." + w for w in words)))
        path = new_path()
    if at < len(page):
        add(page[at:])
    flush()
    return out


