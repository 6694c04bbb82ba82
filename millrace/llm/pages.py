"""HTML pages as sequences of leaf blocks with tag paths."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements whose content is never text of the page.
RAW = "script|style|noscript|template|svg|iframe|object|canvas|textarea|select|annotation"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mo mn ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mtable mtr mtd mstyle mpadded mspace menclose semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these open elements, up to the nearest of the second set.
CLOSES = {
    "p": frozenset(("p",)),
    "li": frozenset(("li", "p")),
    "dt": frozenset(("dt", "dd", "p")),
    "dd": frozenset(("dt", "dd", "p")),
    "tr": frozenset(("tr", "td", "th", "p")),
    "td": frozenset(("td", "th", "p")),
    "th": frozenset(("td", "th", "p")),
    "option": frozenset(("option",)),
    "body": frozenset(("head", "title")),
}
for _tag in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split():
    CLOSES[_tag] = frozenset(("p",))
SCOPE = frozenset("article aside blockquote body div dl fieldset figure footer form header main nav ol section table ul".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPLIT = re.compile(r"[\s_\-:.]+|(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Block:
    """A leaf: its text with white space runs as one space, the names on its path, and the share of it that is links."""

    text: str
    path: tuple[str, ...]
    links: float


def _element(tag: str, attributes: str) -> tuple[str, ...]:
    names = [tag]
    if attributes:
        for found in NAMES.finditer(attributes):
            names += [x.lower() for x in SPLIT.split(found[1] or found[2] or found[3] or "") if x]
    return tuple(names)


def blocks_of(page: str) -> list[Block]:
    """The non-empty leaf blocks of a page, in page order.

    Block elements bound a block, inline ones don't; <br> is white space.
    Comments and raw elements give nothing; unclosed and stray tags are
    repaired as browsers do in the common cases.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                names = tuple(x for _, element in stack for x in element)
                out.append(Block(text, names, min(1.0, linked / len(text))))
        held.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        held.append(piece)
        if any(tag == "a" for tag, _ in stack[-3:]):
            linked += len(piece)

    for token in TOKEN.finditer(page):
        if token.start() > at:
            text(page[at : token.start()])
        at = token.end()
        tag = token[3]
        if tag is None:
            if token[1] and token[1].lower() != "annotation":  # a formula's source stands beside it
                held.append(" ")
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if token[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if ends := CLOSES.get(tag):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                elif stack[i][0] in SCOPE:
                    break
        if tag not in VOID and not token[4].endswith("/"):
            stack.append((tag, _element(tag, token[4])))
    if at < len(page):
        text(page[at:])
    flush()
    return out
