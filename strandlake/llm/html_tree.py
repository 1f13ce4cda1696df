"""A small tolerant HTML tree: elements with subtree hashes, and text by blocks."""

from __future__ import annotations

import html
import re

import xxhash

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|(?P<loose>[^>]*)>)"""
    r"""|[^<]+|<""",
    re.S,
)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

# Fixed values of HTML: elements without content, with raw text, that end a block, that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
UNSEEN = frozenset("script style textarea title xmp iframe noembed noframes noscript template head svg math object canvas select button option".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
#: The end tag of these leaves blocks opened inside them open.
FORMATTING = frozenset("a b big code em font i nobr s small span strike strong tt u".split())
FENCE = frozenset("ul ol dl table div section article main body html aside nav".split())


class Element:
    """An element: tag, marks (class, id and role words), children (Elements and strings)."""

    __slots__ = ("tag", "marks", "hidden", "children", "digest", "shape", "chars", "linked")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.children, self.marks, self.hidden = tag, [], "", False
        self.digest = self.shape = self.chars = self.linked = 0
        if attrs:
            for name, value in ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'").lower()
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    self.hidden = True
                elif name in ("class", "id", "role"):
                    self.marks += " " + value


class Stack:
    """Open elements from the root down; the nearest open element of a tag or kind is found at once.

    An element closed below open blocks leaves a gap, so that nothing moves.
    """

    def __init__(self, root: Element):
        self.open: list[Element | None] = [root]
        self.of_tag: dict[str, list[int]] = {}
        self.fences: list[int] = []
        self.blocks: list[int] = []

    def push(self, e: Element) -> None:
        for places in self._lists(e):
            places.append(len(self.open))
        self.open.append(e)

    def _lists(self, e: Element) -> list[list[int]]:
        kinds = [self.fences] if e.tag in FENCE else []
        return [self.of_tag.setdefault(e.tag, []), *kinds, *([self.blocks] if e.tag in BLOCK else [])]

    def nearest(self, tag: str) -> int:
        """Place of the innermost open ``tag``, 0 if there is none."""
        places = self.of_tag.get(tag)
        return places[-1] if places else 0

    def behind_fence(self, k: int) -> bool:
        return bool(self.fences) and self.fences[-1] > k

    def close_from(self, k: int) -> None:
        """Closes the element at place ``k`` and all that are open inside it."""
        while len(self.open) > k or self.open[-1] is None:
            e = self.open.pop()
            if e is not None:
                for places in self._lists(e):
                    places.pop()

    def close_only(self, k: int) -> None:
        """Closes the innermost open element of its tag, at place ``k``, but no block inside it."""
        if self.blocks and self.blocks[-1] > k:
            self.of_tag[self.open[k].tag].pop()
            self.open[k] = None
        else:
            self.close_from(k)


def parse(page: str) -> Element:
    """The tree of ``page``, in time linear in its length.

    Open elements are closed at the end; a stray </p> is an empty paragraph, other stray end tags are dropped.
    """
    root = Element("#root")
    stack = Stack(root)
    at, size, last = 0, len(page), page.rfind(">")
    match = TOKEN.match
    while at < size:
        if at > last:
            # No tag ends any more: text up to an open comment.
            stop = page.find("<!--", at)
            stack.open[-1].children.append(html.unescape(page[at : size if stop < 0 else stop]))
            break
        m = match(page, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                if "&" in text:
                    text = html.unescape(text)
                stack.open[-1].children.append(text)
            continue
        tag = tag.lower()
        if m["close"]:
            k = stack.nearest(tag)
            if k and (tag in FORMATTING or tag in ("p", "li")) and stack.behind_fence(k):
                k = 0
            if k and tag in FORMATTING:
                stack.close_only(k)
            elif k:
                stack.close_from(k)
            elif tag == "p":
                stack.open[-1].children.append(Element("p"))
            continue
        attrs = m["attrs"] if m["attrs"] is not None else m["loose"]
        ends = SELF_CLOSING.get(tag, ()) or (("p",) if tag in ENDS_P else ())
        if tag in ENDS_P and tag not in ("p",) and ends != ("p",):
            ends = (*ends, "p")
        k = max(map(stack.nearest, ends), default=0)
        if k and not stack.behind_fence(k):
            stack.close_from(k)
        element = Element(tag, attrs)
        stack.open[-1].children.append(element)
        if tag in RAW:
            stop = re.compile(f"</{tag}", re.I).search(page, at)
            at = size if stop is None else stop.start()
            if stop is not None:
                end = page.find(">", at)
                at = size if end < 0 else end + 1
        elif tag not in VOID:
            stack.push(element)
    return root


def measure(node: Element) -> None:
    """Sets digest, shape, chars and linked chars of ``node`` and all below, children first.

    A digest covers tag, marks, words and the digests of the children; a shape
    tag and marks, and which shapes are below, however often.
    """
    work = [(node, False)]
    while work:
        n, ready = work.pop()
        if not ready:
            work.append((n, True))
            work.extend((c, False) for c in n.children if c.__class__ is Element)
            continue
        h, below = [n.tag, n.marks], set()
        for c in n.children:
            if c.__class__ is Element:
                h.append(str(c.digest))
                below.add(c.shape)
                n.chars += c.chars
                n.linked += c.linked
            else:
                words = " ".join(c.split())
                if words:
                    h.append("=" + words)
                    n.chars += len(words)
        if n.tag == "a":
            n.linked = n.chars
        if n.tag in UNSEEN:
            n.chars = n.linked = 0
        n.digest = xxhash.xxh64_intdigest("\x1f".join(h).encode("utf-8", "replace")) >> 1
        n.shape = xxhash.xxh64_intdigest("\x1f".join([n.tag, n.marks, *map(str, sorted(below))]).encode("utf-8", "replace")) >> 1


def blocks(node: Element, drop) -> list[str]:
    """Texts of the blocks below ``node`` in page order, without elements for which ``drop(element)`` holds."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                out.append(text)

    work: list = [node]
    while work:
        n = work.pop()
        if n is None:
            flush()
        elif n.__class__ is str:
            run.append(n)
        elif n.tag in UNSEEN or n.hidden or n is not node and drop(n):
            if n.tag in BLOCK:
                flush()
        elif n.tag == "br":
            run.append(" ")
        else:
            if n.tag in BLOCK:
                flush()
                work.append(None)
            work.extend(reversed(n.children))
    flush()
    return out
