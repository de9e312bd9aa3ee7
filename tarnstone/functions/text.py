"""Column functions over text: normalising, stripping, sniffing, analysing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension to media type, fixed values.
MEDIA_TYPES = {"html": "text/html", "htm": "text/html", "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain"}
#: Leading bytes of what is never text, in hex, fixed values.
BINARY_MAGIC = ("25504446", "89504E47", "FFD8FF", "47494638")
ZIP_MAGIC = "504B0304"
#: Patterns that a display artifact must not hold, with what they are; fixed values.
FORBIDDEN_HTML = (
    (r"(?i)<\s*(script|iframe|object|embed|link|meta|form)\b", "forbidden element"),
    (r"(?i)\son\w+\s*=", "inline event handler"),
    (r"(?i)javascript:", "javascript: URL"),
    (r"""(?i)\ssrc\s*=\s*["']?(https?:)?//""", "external resource load (src)"),
)


def normalize_space(c: Column, unicode: bool = True) -> Column:
    """Runs of white space become one space, none at the ends; ``unicode`` counts no-break spaces and the like."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+" if unicode else r"\s+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.([^./\\]+)$", 1))


def sniff_media_type(filename: Column, content: Column) -> Column:
    """Media type by leading bytes and extension, null for what isn't supported; ``content`` is binary."""
    head = F.hex(F.substring(content, 1, 4))
    ext = extension(filename)
    binary = F.lit(False)
    for magic in BINARY_MAGIC:
        binary = binary | head.startswith(magic)
    nul = F.hex(F.substring(content, 1, 512)).rlike("^(..)*?00")
    by_name = F.lit(None).cast("string")
    for e, media in MEDIA_TYPES.items():
        by_name = F.when(ext == e, media).otherwise(by_name)
    zipped = F.when(ext == "zip", "application/zip")
    return F.when(head == ZIP_MAGIC, zipped).when(binary | nul, None).otherwise(by_name)


def simple_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order; the analyzer that has no language."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def forbidden_html(content: Column) -> Column:
    """What a display artifact holds that it must not, as an array."""
    return F.array_compact(F.array(*(F.when(content.rlike(p), why) for p, why in FORBIDDEN_HTML)))


def first_heading(html: Column) -> Column:
    """Text of the first h1, empty where there is none."""
    return normalize_space(strip_tags(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)))


def html_title(html: Column) -> Column:
    """First h1, else the og:title, else the title element; empty where there is none."""
    og = F.regexp_extract(html, r"""(?is)<meta[^>]*property=["']og:title["'][^>]*content=["']([^"']*)["']""", 1)
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    pick = [F.when(normalize_space(x) != "", normalize_space(x)) for x in (first_heading(html), og, strip_tags(title))]
    return F.coalesce(*pick, F.lit(""))
