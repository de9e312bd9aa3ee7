"""A small HTML tree on the standard library's tokenizer: selection, text, sanitizing, serialising."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

#: Elements without content, fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of a page's head, and what stands around it, fixed values.
HEAD = frozenset("html head title meta link base style script".split())
#: A start tag that ends an open element of those kinds, fixed values.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
#: Start tags that end an open paragraph, fixed values.
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Where the search for an element to end stops, fixed values.
FENCES = frozenset("table ul ol div section article body html".split())
#: Tags and attributes that a display artifact may hold, fixed values; a link may have an href besides.
ALLOWED_TAGS = (
    "article", "section", "div", "span",
    "h1", "h2", "h3", "h4", "h5", "h6",
    "p", "ul", "ol", "li", "blockquote",
    "strong", "em", "b", "i", "u", "code", "pre",
    "table", "thead", "tbody", "tr", "th", "td",
    "a", "br",
)
ALLOWED_ATTRIBUTES = ("id", "class", "title", "data-anchor")
DROPPED_WITH_CONTENT = frozenset(("script", "style", "textarea", "option"))
_SPACE = re.compile(r"\s+")


class Node:
    """An element, or with ``tag`` None a run of text."""

    __slots__ = ("tag", "attrs", "children", "parent", "data")

    def __init__(self, tag: str | None, attrs: dict | None = None, data: str = ""):
        self.tag, self.attrs, self.data = tag, attrs or {}, data
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        todo = [iter(self.children)]
        while todo:
            node = next(todo[-1], None)
            if node is None:
                todo.pop()
            elif node.tag:
                yield node
                todo.append(iter(node.children))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.tag is None:
                out.append(node.data)
            else:
                todo += reversed(node.children)
        return "".join(out)

    def remove(self) -> None:
        if self.parent:
            self.parent.children = [c for c in self.parent.children if c is not self]

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def _end(self, tags: set[str] | frozenset[str]) -> None:
        node = self.at
        while node.tag not in tags:
            if node.parent is None or node.tag in FENCES:
                return
            node = node.parent
        self.at = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end({"p"})
        if tag in CLOSES:
            self._end(CLOSES[tag])
        node = self.at.add(Node(tag, {k: v or "" for k, v in reversed(attrs)}))
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.add(Node(None, data=data))


def parse(source: str) -> Node:
    """The tree of a page; as browsers do, a body is added around what has none."""
    builder = _Builder()
    builder.feed(source)
    builder.close()
    root = builder.root
    if not any(n.tag == "body" for n in root.walk()):
        top = next((n for n in root.children if n.tag == "html"), root)
        body = Node("body")
        moved = [n for n in top.children if n.tag not in HEAD]
        top.children = [n for n in top.children if n.tag in HEAD]
        for n in moved:
            body.add(n)
        top.add(body)
    return root




def _fits(node: Node, compound: str) -> bool:
    rest = compound
    m = re.match(r"[a-z][a-z0-9]*", rest)
    if m:
        if node.tag != m[0]:
            return False
        rest = rest[m.end() :]
    for m in re.finditer(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:=['\"]([^'\"]*)['\"])?\]", rest):
        cls, id_, name, value = m.groups()
        if cls and cls not in node.classes() or id_ and node.attrs.get("id") != id_:
            return False
        if name and (name not in node.attrs or value is not None and node.attrs[name] != value):
            return False
    return True


def select(root: Node, selector: str) -> Iterator[Node]:
    """Elements below ``root`` that fit a selector: compounds of tag, class, id and attribute, descendants, commas."""
    options = [s.split() for s in selector.split(",")]

    def ancestors(node: Node, parts: list[str]) -> bool:
        up = node.parent
        for part in reversed(parts):
            while up is not None and not (up.tag and _fits(up, part)):
                up = up.parent
            if up is None:
                return False
            up = up.parent
        return True

    for node in root.walk():
        if any(_fits(node, parts[-1]) and ancestors(node, parts[:-1]) for parts in options):
            yield node


def first(root: Node, selector: str) -> Node | None:
    return next(select(root, selector), None)


def normalize(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def _safe_url(value: str) -> bool:
    scheme = re.match(r"\s*([a-zA-Z][a-zA-Z0-9+.-]*):", value)
    return scheme is None or scheme[1].lower() in ("http", "https")


def sanitize(nodes: list[Node], attributes: tuple[str, ...] = ALLOWED_ATTRIBUTES, tags: tuple[str, ...] = ALLOWED_TAGS) -> str:
    """Serialised with allowed tags and attributes only; other tags vanish but for their content, scripts and styles with it."""
    out: list[str] = []
    todo: list = list(reversed(nodes))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.tag is None:
            out.append(html.escape(node.data, quote=False))
        elif node.tag in DROPPED_WITH_CONTENT:
            continue
        elif node.tag in tags:
            kept = {k: v for k, v in node.attrs.items() if k in attributes or node.tag == "a" and k == "href" and _safe_url(v)}
            out.append(f"<{node.tag}{''.join(f' {k}="{html.escape(v)}"' for k, v in kept.items())}{' /' if node.tag in VOID else ''}>")
            if node.tag not in VOID:
                todo.append(f"</{node.tag}>")
                todo += reversed(node.children)
        else:
            todo += reversed(node.children)
    return "".join(out).strip()
