"""Document validation: all violations of a nested document at once, as an array of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import forbidden_html, strip_tags
from ..schemas import SECTION_KINDS
from .parsers import CONTRACT_VERSION


def blank(text: Column) -> Column:
    """Null, or nothing but white space of any kind."""
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def violations(doc: Column) -> Column:
    """Empty for a valid document; expressions only."""
    sections, artifacts = doc["sections"], doc["artifacts"]
    ids = F.transform(artifacts, lambda a: a["id"])
    version = F.when(doc["contract_version"] != CONTRACT_VERSION, F.lit("contract version differs"))
    title = F.when(blank(doc["title"]), F.lit("title is empty"))
    repeated = F.when(F.size(F.array_distinct(ids)) < F.size(ids), F.lit("artifact ids repeat"))
    forbidden = F.flatten(F.transform(artifacts, lambda a: F.transform(forbidden_html(a["content"]), lambda w: F.concat(F.lit("artifact "), a["id"], F.lit(": "), w))))

    def of_section(s: Column, i: Column) -> Column:
        def say(c: Column, what: str) -> Column:
            return F.when(c, F.concat(F.lit("section "), i.cast("string"), F.lit(f": {what}")))

        shown = F.try_element_at(F.filter(artifacts, lambda a: a["id"] == s["anchor"]["artifact_id"]), F.lit(1))
        start, end = s["anchor"]["char_start"], s["anchor"]["char_end"]
        inside = (start >= 0) & (start < end) & (end <= F.length(strip_tags(shown["content"])))
        return F.array_compact(
            F.array(
                say(s["index"] != i, "index is out of order"),
                say(blank(s["content"]), "content is empty"),
                say(~s["kind"].isin(*SECTION_KINDS), "kind is unknown"),
                say(shown.isNull(), "anchor resolves to no artifact"),
                say(shown.isNotNull() & ~F.coalesce(inside, F.lit(False)), "anchor range is invalid"),
            )
        )

    return F.concat(F.array_compact(F.array(version, title, repeated)), forbidden, F.flatten(F.transform(sections, of_section)))
