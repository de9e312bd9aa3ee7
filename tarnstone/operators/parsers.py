"""Parsers: a registry of plugins, detection by confidence, documents as nested rows.

A plugin has a name, a version, the media types it accepts, ``detect(head, media_type)`` giving a confidence and
``parse(content)`` giving a document or raising ParseError. Detection consults plugins in order; the highest
confidence wins and the first registered wins ties; a detector that raises scores zero.
"""

from __future__ import annotations

import dataclasses
import itertools
import re
from collections.abc import Callable, Sequence
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParseError
from ..functions import html as H
from ..schemas import DOCUMENT

CONTRACT_VERSION = "1"
#: Bytes of a file that detection sees.
HEAD_BYTES = 65_536
FALLBACK = 0.1
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


@dataclasses.dataclass(frozen=True)
class Plugin:
    name: str
    version: str
    accepts: tuple[str, ...]
    detect: Callable[[bytes], float]
    parse: Callable[[bytes], dict]


def decode(content: bytes) -> str:
    return content.decode("utf-8-sig", "replace")


def slug(text: str) -> str:
    return re.sub(r"[^0-9a-z]+", "-", H.normalize(text).lower()).strip("-") or "section"


def fresh_id(taken: set[str], text: str, own: str = "") -> str:
    """An id that isn't taken, by its slug: the element's own, else its slug or the text's, numbered from 2."""
    named = slug(own or text)
    for tried in itertools.chain([own] if own else [], [named], (f"{named}-{n}" for n in itertools.count(2))):
        if slug(tried) not in taken:
            taken.add(slug(tried))
            return tried
    raise AssertionError


@dataclasses.dataclass
class Outline:
    """Sections and artifacts of a document as they are met; headings nest by level, whether they have text behind them or not."""

    lead: tuple[str, ...] = ()
    over: dict[int, str] = dataclasses.field(default_factory=dict)
    sections: list[dict] = dataclasses.field(default_factory=list)
    artifacts: list[dict] = dataclasses.field(default_factory=list)

    def enter(self, level: int, text: str) -> list[str]:
        """The path of a heading."""
        self.over = {k: v for k, v in self.over.items() if k < level} | {level: text}
        return [*self.lead, *(self.over[k] for k in sorted(self.over))]

    def add(self, path: list[str], kind: str, heading: str | None, content: str, artifact: dict) -> None:
        shown = len(re.sub("<[^>]*>", "", artifact["content"]))
        anchor = {"artifact_id": artifact["id"], "element_id": artifact["id"], "char_start": 0, "char_end": shown}
        self.artifacts.append(artifact)
        self.sections.append({"index": len(self.sections), "path": path, "kind": kind, "heading": heading, "content": content, "anchor": anchor})

    def document(self, title: str, otherwise: str, *around: dict) -> dict:
        """The whole; a document without sections is malformed, as ``otherwise`` says."""
        if not self.sections:
            raise ParseError("malformed", otherwise)
        return {"contract_version": CONTRACT_VERSION, "title": title, "language": None, "sections": self.sections, "artifacts": [*around, *self.artifacts], "warnings": []}


def _artifact(id_: str, content: str, title: str | None = None) -> dict:
    return {"id": id_, "kind": "html", "content": content, "title": title}


def said(node: H.Node | None) -> str:
    return H.normalize(node.text()) if node is not None else ""


def meant(node: H.Node | None) -> str:
    """What a head element says in an attribute."""
    return H.normalize(node.attrs.get("href") or node.attrs.get("content") or "") if node is not None else ""


def first_said(tree: H.Node, selectors: Sequence[str]) -> H.Node | None:
    return next((n for n in (H.first(tree, s) for s in selectors) if said(n)), None)


def title_of(tree: H.Node, root: H.Node, otherwise: str) -> str:
    return said(H.first(root, "h1")) or meant(H.first(tree, "meta[property='og:title']")) or said(H.first(tree, "title")) or otherwise


def headed(root: H.Node) -> list[tuple[H.Node, list[H.Node]]]:
    """Headings below ``root`` in document order, each with the siblings up to the next one: one pass over the tree."""
    found: list[tuple[H.Node, list[H.Node]]] = []
    todo: list[tuple[list[H.Node], int, list[H.Node] | None]] = [(root.children, 0, None)]
    while todo:
        children, at, body = todo.pop()
        if at == len(children):
            continue
        node = children[at]
        if node.tag in HEADINGS:
            body = []
            found.append((node, body))
        elif body is not None:
            body.append(node)
        todo.append((children, at + 1, body))
        todo.append((node.children, 0, None))
    return found


#: Of a kind: whether a fragment (its source and its text) is of it. The first that holds, else prose.
Rule = tuple[str, Callable[[str, str], bool]]


def by_headings(root: H.Node, rules: Sequence[Rule], lead: Sequence[str] = (), titled: bool = False, attributes: tuple[str, ...] = H.ALLOWED_ATTRIBUTES) -> Outline:
    """A section per heading with text behind it. Headings without text still nest."""
    out, taken = Outline(tuple(lead)), set()
    for node, body in headed(root):
        if not (text := said(node)):
            continue
        path, own = out.enter(int(node.tag[1]), text), (node.attrs.get("id") or "").strip()
        id_ = fresh_id(taken, text, own)
        if content := H.normalize(" ".join(b.text() for b in body)):
            node.attrs["data-anchor"] = id_
            shown = H.sanitize([node, *body], attributes)
            kind = next((k for k, holds in rules if holds(shown, content)), "prose")
            out.add(path, kind, text, content, _artifact(id_, shown, text if titled else None))
    return out


def mostly_tables(source: str, content: str) -> bool:
    tables = H.normalize("".join(n.text() for n in H.select(H.parse(source), "table"))) if "<table" in source else ""
    return bool(tables) and 2 * len(tables) >= len(content)


# Saved pages of one site, recognised by where they were saved from. Fixed values:
SITE = "dndbeyond.com"
SAVED_FROM = re.compile(r"saved\s+from(?:\s+url=\(\d+\))?\s*(https?://(?:www\.)?dndbeyond\.com/\S+)", re.I)
SAVED_FROM_CHARS = 20_000
IDENTITY = ("link[rel='canonical']", "meta[property='og:url']", "meta[name='twitter:url']")
NO_IDENTITY = re.compile(r"/?$|/forums", re.I)
MARKED = "[data-content-chunk-id], [data-content-chunk]"
ARTICLES = (
    "div.p-article-content.u-typography-format",
    "div#p-article-content.u-typography-format",
    "article",
    "main article",
    "main .ddb-statblock",
    "main .mon-stat-block",
    "main .compendium-content",
    "main .more-info-content",
    "main .primary-content",
    "main",
)
SITE_CHROME = (
    "script", "style", "template", "iframe", "object", "embed", "nav", "header", "footer", "aside", "form", "button", "svg",
    "[role='navigation']", "[aria-hidden='true']", ".site-bar", ".site-footer", ".site-header", ".ddb-campaigns-character-card-footer",
)
SITE_ATTRIBUTES = ("id", "class", "title", "data-content-chunk-id", "data-citation-id", "data-anchor")
STAT_BLOCKS = (".mon-stat-block", ".ddb-statblock")
SPELL_LABELS = ("Casting Time", "Range", "Components", "Duration", "Level")
SITE_RULES: tuple[Rule, ...] = (
    ("stat_block", lambda source, content: "stat" in source and H.first(H.parse(source), ", ".join(STAT_BLOCKS)) is not None),
    ("table", mostly_tables),
    ("spell_entry", lambda source, content: sum(label in source for label in SPELL_LABELS) >= 3),
)
BOOK_METAS = ("meta[property='og:site_name']", "meta[name='ddb:book-title']", "meta[name='book-title']")
GENERIC_TITLES = ("ddb", "d&d beyond", "dungeons & dragons beyond", "dungeons and dragons beyond", "dungeons & dragons", "dungeons and dragons", "sources")
# and those of any page
ROOTS = ("article", "main", "body")
CHROME = ("script", "style", "template", "nav", "header", "footer", "aside")


def names_a_page(url: str) -> bool:
    """Whether a URL is of a page of the site's content."""
    if SITE not in url.lower():
        return False
    try:
        at = urlsplit(url)
    except ValueError:
        return False
    return bool(at.scheme) and not NO_IDENTITY.match(at.path)


class SavedPage:
    """What tells a saved page: its tree, its article, and how sure that makes one."""

    def __init__(self, content: bytes):
        source = decode(content)
        self.tree = H.parse(source)
        self.article = first_said(self.tree, ARTICLES)
        saved = SAVED_FROM.search(source[:SAVED_FROM_CHARS])
        signs = (
            (0.95, saved is not None or any(names_a_page(meant(H.first(self.tree, s))) for s in IDENTITY)),
            (0.85, self.article is not None and H.first(self.article, MARKED) is not None),
        )
        self.confidence = max((sure for sure, seen in signs if seen), default=0.0)

    def book(self) -> str | None:
        """The book that the page is of: named in the head, else behind a dash or bar in the title."""
        parts = [H.normalize(x) for x in re.split(r"\s+[-—|]\s+", said(H.first(self.tree, "title")))]
        tails = (x for x in [x for x in parts if x][1:] if x.lower() not in GENERIC_TITLES)
        return next((x for x in (meant(H.first(self.tree, s)) for s in BOOK_METAS) if x), None) or next(tails, None)


def detect_saved(head: bytes) -> float:
    return SavedPage(head).confidence


def parse_saved(content: bytes) -> dict:
    page = SavedPage(content)
    if page.article is None or not page.confidence:
        raise ParseError("unrecognized", "the page has no article" if page.article is None else "the page doesn't look like a saved one")
    for node in list(H.select(page.article, ", ".join(SITE_CHROME))):
        node.remove()
    book, title = page.book(), title_of(page.tree, page.article, "Untitled page")
    out = by_headings(page.article, SITE_RULES, [book] if book else [], True, SITE_ATTRIBUTES)
    return out.document(title, "the article has no text behind a heading", _artifact("full", H.sanitize([page.article], SITE_ATTRIBUTES), title))


def detect_html(head: bytes) -> float:
    source = decode(head)
    return FALLBACK if first_said(H.parse(source), ROOTS) is not None or re.search(r"<!doctype\s+html|<html[\s>]", source, re.I) else 0.0


def parse_html(content: bytes) -> dict:
    tree = H.parse(decode(content))
    root = first_said(tree, ROOTS)
    if root is None:
        raise ParseError("malformed", "the page has no text")
    for node in list(H.select(root, ", ".join(CHROME))):
        node.remove()
    return by_headings(root, (("table", mostly_tables),)).document(title_of(tree, root, "Untitled document"), "the page has no text behind a heading")


ATX = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")


def _paragraph(id_: str, text: str, title: str | None) -> dict:
    node = H.Node("p", {"data-anchor": id_})
    node.add(H.Node(None, data=text))
    return _artifact(id_, H.sanitize([node]), title)


def atx_blocks(text: str) -> list[tuple[int, str | None, str]]:
    """(level, heading, body) in order; what stands before the first heading has level 0 and no heading."""
    lines = re.split(r"\r?\n", text)
    heads = [(n, m) for n, m in enumerate(map(ATX.match, lines)) if m]
    starts = [-1, *(n for n, _ in heads)]
    bodies = [H.normalize("\n".join(lines[a + 1 : b])) for a, b in zip(starts, [*starts[1:], len(lines)], strict=True)]
    return [(0, None, bodies[0]), *((len(m[1]), H.normalize(m[2]), body) for (_, m), body in zip(heads, bodies[1:], strict=True))]


def parse_markdown(content: bytes) -> dict:
    text = decode(content)
    if not H.normalize(text):
        raise ParseError("malformed", "the document is blank")
    blocks, out, taken = atx_blocks(text), Outline(), set()
    for level, heading, body in blocks:
        path = out.enter(level, heading) if heading is not None else []
        if body:
            out.add(path, "prose", heading, body, _paragraph(fresh_id(taken, heading or "intro"), body, heading))
    titles = (h for n, h, _ in blocks if n == 1)
    return out.document(next(titles, None) or blocks[0][2][:80] or "Untitled document", "the document has headings only")


MARKER = re.compile(r"^@@\s+(.+)$", re.M)


def parse_demo(content: bytes) -> dict:
    """The format that shows how to add one: sections begin at lines ``@@ heading``."""
    parts = [H.normalize(x) for x in MARKER.split(decode(content).replace("\r\n", "\n"))[1:]]
    if not parts:
        raise ParseError("malformed", "the document has no markers")
    out = Outline()
    for heading, text in itertools.batched(parts, 2):
        if text:
            id_ = f"s{len(out.sections)}"
            out.add([heading], "unclassified", heading, text, _artifact(id_, f'<p data-anchor="{id_}">{text}</p>'))
    return out.document(parts[0], "the document has markers only")


SAVED_PAGE = Plugin("saved-page", "1.0.0", ("text/html",), detect_saved, parse_saved)
MARKDOWN = Plugin("markdown", "1.0.0", ("text/markdown", "text/plain"), lambda head: FALLBACK, parse_markdown)
HTML = Plugin("generic-html", "1.0.0", ("text/html",), detect_html, parse_html)
DEMO = Plugin("demo-format", "1.0.0", ("application/x-demo-sections",), lambda head: 0.9 if MARKER.search(decode(head)) else 0.0, parse_demo)
#: In the order in which they are consulted; the demo format isn't among them.
SHIPPED = (SAVED_PAGE, MARKDOWN, HTML)


def confidence_of(plugin: Plugin, head: bytes) -> float:
    try:
        return float(plugin.detect(head[:HEAD_BYTES]))
    except Exception:
        return 0.0


def detect(media_type: str, head: bytes, plugins: Sequence[Plugin] = SHIPPED) -> tuple[Plugin | None, float, dict[str, float]]:
    """The plugin that is surest, how sure it is, and all that were asked."""
    asked = [p for p in plugins if media_type in p.accepts]
    scores = {p.name: confidence_of(p, head) for p in asked}
    best = max(asked, key=lambda p: scores[p.name], default=None)  # the first of equals
    return (best, scores[best.name], scores) if best and scores[best.name] > 0 else (None, 0.0, scores)


RESULT = f"struct<plugin_name:string,plugin_version:string,confidence:double,candidates:map<string,double>,document:{DOCUMENT},failure:struct<class:string,stage:string,message:string>>"


def parse_column(media_type: Column, content: Column, plugins: Sequence[Plugin] = SHIPPED) -> Column:
    """Detection and parse of each file: a struct with the plugin, all candidates, and the document or the failure."""

    @F.pandas_udf(RESULT)
    def run(media: pd.Series, data: pd.Series) -> pd.DataFrame:
        rows = []
        for m, c in zip(media, data, strict=True):
            plugin, confidence, scores = detect(m, bytes(c or b""), plugins) if m else (None, 0.0, {})
            row = {"plugin_name": plugin.name if plugin else None, "plugin_version": plugin.version if plugin else None, "confidence": confidence, "candidates": scores, "document": None, "failure": None}
            if plugin is None:
                row["failure"] = {"class": "unrecognized", "stage": "detect", "message": "no plugin recognises the file"}
            else:
                try:
                    row["document"] = plugin.parse(bytes(c or b""))
                except ParseError as e:
                    row["failure"] = {"class": e.category, "stage": "transform", "message": str(e)}
                except Exception as e:
                    row["failure"] = {"class": "malformed", "stage": "transform", "message": type(e).__name__}
            rows.append(row)
        return pd.DataFrame(rows, columns=["plugin_name", "plugin_version", "confidence", "candidates", "document", "failure"])

    return run(media_type, content)


def sections_of(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per section of ``parsed`` (keys and a document), with its display artifact."""
    each = parsed.select(*keys, F.col("document.artifacts").alias("artifacts"), F.explode("document.sections").alias("s"))
    shown = F.filter("artifacts", lambda a: a["id"] == F.col("s.anchor.artifact_id"))
    return each.select(*keys, F.col("s.index").alias("section_index"), "s.path", "s.kind", "s.heading", "s.content", "s.anchor", F.try_element_at(shown, F.lit(1)).alias("display_artifact"))
