"""Secret scans with multipart credential linking.

Base patterns name certain spans. Weak candidates (account identifiers, mixed tokens, endpoints) are common in
clean text, so they count only where complementary parts of a credential co-occur: an identifier with a
secret, a secret with an identifier, an endpoint with both, with gaps of at most ``scope`` code points between
them in one text. That interval join is done by sorting, so no pairs are made: per text, spans lie in the order
of their starts among probes, one behind each span by the scope; of all spans of a role that start before a probe,
the largest end tells whether one reaches to within the scope of the probe's span.

One pass over the texts finds all matches and their lengths; only those numbers are shuffled, by document.
All of it is DataFrame operations.

Defined cases: null text is empty; a text without spans gives an empty list; rows that repeat doc_id and text
give one result row each; null doc_ids are allowed; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kind: (pattern, group whose length counts, least length, role). Base kinds, in the order they are listed in; fixed values.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret"),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, "ident"),
    "hex": (r"[0-9a-f]+", 0, 24, "secret"),
}
#: Patterns that match only where the base pattern has a match that is long enough; they are quicker.
QUICK = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Weak candidates, reported only with complementary parts.
WEAK = {
    "ident": (r"""((?i:user(?:name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""", 2, 3, "ident"),
    "opaque": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20, "secret"),
    "endpoint": (r"""[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D"'<>]+""", 0, 8, "endpoint"),
}
#: Roles that must all stand within the scope of a span of a role.
PARTNERS = {"ident": ("secret",), "secret": ("ident",), "endpoint": ("ident", "secret")}
KINDS = [*BASE, *WEAK]
SCOPE = 300


def _matches(text: Column, kind: str) -> Column:
    """Array of (kind, nth, gap before the match, length of the match, whether it is long enough)."""
    pattern, group, least, _ = (BASE | WEAK)[kind]
    quick = QUICK.get(kind, pattern)
    number = KINDS.index(kind)

    def row(gap: Column, match: Column) -> Column:
        counted = F.length(F.regexp_extract(match, pattern, group) if group else match)
        fits = counted >= least
        if kind == "opaque":  # letters of both cases and a digit
            fits = fits & match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
        return F.struct(F.lit(number).alias("kind"), F.length(gap).cast("long").alias("gap"), F.coalesce(F.length(match), F.lit(0)).cast("long").alias("size"), F.coalesce(fits, F.lit(False)).alias("fits"))

    found = F.zip_with(F.split(text, quick, -1), F.regexp_extract_all(text, F.lit(quick), F.lit(0)), row)
    return F.when(text.rlike(quick), found).otherwise(F.array().cast("array<struct<kind:int,gap:bigint,size:bigint,fits:boolean>>"))


def spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and spans, an array of (start, kind, end, name) by start, then kind.

    ``kind`` is the place of ``name`` in KINDS; starts and ends are code points, the end is exclusive.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text"))
    nothing = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("fits")))
    found = F.concat(nothing, *(_matches(F.col("text"), k) for k in KINDS))
    each = read.select("doc_id", "text_hash", F.posexplode(found).alias("nth", "m")).select("doc_id", "text_hash", "nth", "m.*")
    key = ["doc_id", "text_hash"]
    # rows that repeat are counted, and told apart again at the end
    dealt = each.groupBy(*key, "nth", "kind", "gap", "size", "fits").agg(F.count("*").alias("rows"))
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy(*key, "kind").orderBy("nth"))
    placed = dealt.withColumn("end", upto).withColumn("start", F.col("end") - F.col("size")).where("fits")
    roles = [F.lit(None).cast("string"), *(F.lit(x[3]) for x in (BASE | WEAK).values())]
    placed = placed.withColumn("role", F.element_at(F.array(*roles), F.col("kind") + 2))
    at = F.explode(F.array(F.struct(F.lit(False).alias("probe"), F.col("start").alias("at")), F.struct(F.lit(True).alias("probe"), (F.col("end") + scope).alias("at"))))
    events = placed.withColumn("event", at).select("*", "event.probe", "event.at").drop("event")
    before = Window.partitionBy(*key).orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    linked = F.lit(False)
    for role, partners in PARTNERS.items():
        here = F.col("role") == role
        for p in partners:
            here = here & (F.max(F.when(~F.col("probe") & (F.col("role") == p), F.col("end"))).over(before) >= F.col("start") - scope)
        linked = linked | F.coalesce(here, F.lit(False))
    placed = events.withColumn("linked", linked).where("probe")
    kept = placed.where((F.col("kind") < len(BASE)) | F.col("linked"))
    span = F.struct("start", "kind", "end", F.element_at(F.array(*map(F.lit, KINDS)), F.when(F.col("kind") >= 0, F.col("kind") + 1)).alias("name"))
    back = kept.groupBy(*key).agg(F.max(F.when(F.col("kind") < 0, F.col("rows"))).alias("rows"), F.array_sort(F.collect_list(F.when(F.col("kind") >= 0, span))).alias("spans"))
    return back.select("doc_id", "spans", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select("doc_id", "spans")


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, as a string, of every row."""
    found = spans(docs, scope)
    kinds = F.transform("spans", lambda s: s["kind"])
    count = {f"n_{k}": (F.size("spans") - F.size(F.array_remove(kinds, i))).cast("long") for i, k in enumerate(BASE)}
    base = _joined(F.filter("spans", lambda s: s["kind"] < len(BASE)))
    return found.select("doc_id", *(c.alias(n) for n, c in count.items()), F.sha2(base, 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
