"""Full-text search: analysis to postings, web-style queries, boolean and phrase matching, cover-density rank.

A query is a list of alternatives (``or``), each a list of terms that must all hold; a term is a word or a quoted
phrase and may be negated by a leading ``-``. Words that analyse to nothing are left out; within a phrase they
keep their distance. Matching is relational: a query's lexemes join the postings by lexeme and are counted up to
terms, alternatives and queries, so any number of queries is one plan. Ranks follow published cover density
(Clarke, Cormack and Tudhope 2000); scores are this engine's own, only their order is meant to agree with others.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions.stem import STOP_WORDS, analyze, stem
from ..functions.text import simple_tokens
from ..shared import materialise
from .fusion import ranked

#: Lexemes of all queries up to which their table is broadcast; beyond, it joins the postings by lexeme in a shuffle.
MOST_LEXEMES = 500_000
#: Lexemes up to which a list of them is pushed down to the files.
MOST_PUSHED = 10_000
_TERM = re.compile(r'(-?)"([^"]*)"|(\S+)')


def words(chunks: DataFrame) -> DataFrame:
    """word, chunk_id, pos and all other columns but the content: a row per word of ``chunks`` (chunk_id, content ...), positions from 1."""
    rest = [c for c in chunks.columns if c not in ("chunk_id", "content")]
    each = chunks.select("chunk_id", *rest, F.posexplode(simple_tokens(F.col("content"))).alias("at", "word"))
    return each.select("word", "chunk_id", (F.col("at") + 1).cast("int").alias("pos"), *rest)


def postings(chunks: DataFrame, language: str = "english") -> DataFrame:
    """lexeme, chunk_id, pos and all other columns but the content.

    In English stop words go, and each different word is stemmed once: the stems are a table that the words join. ``chunks``
    is read twice then, so it should be a written table or a scan.
    """
    if language == "simple":
        return words(chunks).withColumnRenamed("word", "lexeme")

    @F.pandas_udf("string")
    def stems(different: pd.Series) -> pd.Series:
        return different.map(stem)

    each = words(chunks).where(~F.col("word").isin(*STOP_WORDS))
    stemmed = words(chunks.select("chunk_id", "content")).where(~F.col("word").isin(*STOP_WORDS)).select("word").distinct().withColumn("lexeme", stems("word"))
    return each.join(stemmed, "word").select("lexeme", "chunk_id", "pos", *(c for c in each.columns if c not in ("word", "chunk_id", "pos")))


#: Parts that stored postings are kept in, by lexeme: a query reads the parts of its own lexemes.
PARTS = 64


def part_of(lexeme: Column) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(PARTS)).cast("int")


def stored(posted: DataFrame) -> DataFrame:
    """``posted`` with its part, in the order in which it is to be written: a common lexeme takes several tasks."""
    keyed = posted.withColumn("part", part_of(F.col("lexeme")))
    return keyed.repartitionByRange("part", "lexeme", "chunk_id").sortWithinPartitions("part", "lexeme", "chunk_id", "pos")


def asked_only(posted: DataFrame, asked: DataFrame) -> DataFrame:
    """Of stored postings those that the queries ask for: parts are pruned, lexemes pushed down to the files."""
    parts = [r["part"] for r in asked.select(part_of(F.col("lexeme")).alias("part")).distinct().collect()]  # PARTS at most
    few = posted.where(F.col("part").isin(parts)).drop("part") if "part" in posted.columns else posted
    lexemes = [r["lexeme"] for r in asked.select("lexeme").distinct().limit(MOST_PUSHED + 1).collect()]
    return few.where(F.col("lexeme").isin(lexemes)) if len(lexemes) <= MOST_PUSHED else few


def parse_query(query: str, language: str = "english") -> list[list[tuple[bool, list[tuple[str, int]]]]]:
    """Alternatives of terms; a term is (negated, [(lexeme, distance from the first)])."""
    found: list[list] = [[]]
    for m in _TERM.finditer(query):
        sign, phrase, word = m.groups()
        if word is not None:
            if word.lower() == "or":
                found.append([])
                continue
            sign, phrase = ("-", word[1:]) if word.startswith("-") else ("", word)
        parts = analyze(phrase, language)
        if parts:
            found[-1].append((sign == "-", [(x, p - parts[0][1]) for x, p in parts]))
    return [a for a in found if a]


ASKED = "alternative int, positives int, term int, negated boolean, size int, place int, lexeme string, distance int"


def _rows(query: str, language: str) -> list[tuple]:
    out = []
    for a, terms in enumerate(parse_query(query, language)):
        for t, (negated, parts) in enumerate(terms):
            out += [(a, sum(not n for n, _ in terms), t, negated, len(parts), i, x, d) for i, (x, d) in enumerate(parts)]
    return out


def query_table(spark: SparkSession, queries: dict, language: str = "english") -> DataFrame:
    """query_id, alternative, positives, term, negated, size, place, lexeme, distance: a row per lexeme of each query."""
    kind = "bigint" if all(isinstance(q, int) for q in queries) else "string"
    return spark.createDataFrame([(q, *row) for q, text in queries.items() for row in _rows(text, language)], f"query_id {kind}, {ASKED}")


def query_frame(queries: DataFrame, language: str = "english") -> DataFrame:
    """The same from a table (query_id, query) of any size."""
    names = [x.split()[0] for x in ASKED.split(", ")]

    @F.pandas_udf(f"array<struct<{ASKED.replace(' ', ':').replace(',:', ',')}>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda q: [dict(zip(names, row, strict=True)) for row in _rows(q or "", language)])

    return queries.select("query_id", F.explode(run("query")).alias("a")).select("query_id", "a.*")


def _bounded(asked: DataFrame) -> DataFrame:
    return F.broadcast(asked) if asked.limit(MOST_LEXEMES + 1).count() <= MOST_LEXEMES else asked


def hits(posted: DataFrame, asked: DataFrame) -> DataFrame:
    """The postings that may serve a query's terms: those of chunks that hold the rarest lexeme which its alternative needs.

    So a common word is looked up only in the chunks that a rare one leaves. Alternatives of negations alone take all
    postings of their lexemes. ``posted`` is read three times, so it should be a written table.
    """
    places = posted.select("lexeme", "chunk_id", "pos")
    needed = asked.where("NOT negated").select("query_id", "alternative", "lexeme").distinct()
    common = places.join(_bounded(needed.select("lexeme").distinct()), "lexeme").groupBy("lexeme").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("query_id", "alternative").orderBy(F.coalesce("n", F.lit(0)), "lexeme"))
    rarest = needed.join(common, "lexeme", "left").withColumn("nth", nth).where("nth = 1").select("query_id", "alternative", "lexeme")
    may = places.select("lexeme", "chunk_id").join(_bounded(rarest), "lexeme").select("query_id", "alternative", "chunk_id").distinct()
    wanted = may.join(_bounded(asked.where("positives > 0")), ["query_id", "alternative"])
    without = places.join(_bounded(asked.where("positives = 0")), "lexeme")
    return places.join(wanted, ["lexeme", "chunk_id"]).unionByName(without)


def _terms(hit: DataFrame) -> DataFrame:
    """query_id, alternative, positives, term, negated and chunk_id: terms that a chunk holds as wholes."""
    key = ["query_id", "alternative", "positives", "term", "negated", "size", "chunk_id"]
    whole = hit.groupBy(*key, (F.col("pos") - F.col("distance")).alias("at")).agg(F.countDistinct("place").alias("n")).where("n = size")
    return whole.select(*key).distinct()


def _fits(hit: DataFrame) -> DataFrame:
    by = _terms(hit).groupBy("query_id", "alternative", "positives", "chunk_id").agg(F.count(F.when(~F.col("negated"), 1)).alias("held"), F.count(F.when(F.col("negated"), 1)).alias("against"))
    return by.where("held = positives AND against = 0 AND positives > 0").select("query_id", "chunk_id").distinct()


#: Alternatives of negations alone that meet the chunks at a time.
ALONE = 500


def _found(hit: DataFrame, asked: DataFrame, chunks: DataFrame | None) -> DataFrame:
    found = _fits(hit)
    alone = asked.where("positives = 0").select("query_id", "alternative").distinct()
    count = alone.count() if chunks is not None else 0
    if not count:
        return found
    against = _terms(hit).where("negated AND positives = 0").select("query_id", "alternative", "chunk_id")
    kind, blocks = dict(asked.dtypes)["query_id"], -(-count // ALONE)
    for b in range(blocks):  # each asks for all other chunks, which are its result
        part = alone.where(F.pmod(F.xxhash64("query_id", "alternative"), F.lit(blocks)) == b).collect()
        if part:
            every = F.explode(F.array(*(F.struct(F.lit(r["query_id"]).cast(kind).alias("query_id"), F.lit(r["alternative"]).alias("alternative")) for r in part)))
            free = chunks.select("chunk_id", every.alias("q")).select("chunk_id", "q.*").join(against, ["query_id", "alternative", "chunk_id"], "left_anti")
            found = found.unionByName(free.select("query_id", "chunk_id"))
    return found.distinct()


def matches(posted: DataFrame, asked: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id) of all that fit. ``chunks`` (chunk_id) is needed only if an alternative is all negations: such a
    query asks for all other chunks, which are its result."""
    return _found(hits(posted, asked), asked, chunks)


def cover_density(hits: list[tuple[int, int]], wanted: int) -> float:
    """Sum over the smallest stretches that hold all ``wanted`` lexemes of lexemes per word; ``hits``: (lexeme number, position) by position."""
    score, counts, missing, lo = 0.0, [0] * wanted, wanted, 0
    for k, p in hits:
        missing -= counts[k] == 0
        counts[k] += 1
        shrunk = None
        while missing == 0:
            shrunk = hits[lo][1]
            counts[hits[lo][0]] -= 1
            missing += counts[hits[lo][0]] == 0
            lo += 1
        if shrunk is not None:
            score += wanted / (p - shrunk + 1)
    return score


def bounds(hit: DataFrame, asked: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, alternative, wanted, chunk_id and most: what a chunk of ``found`` can score at most, from counts and spans alone.

    No smallest stretch holds another, so there are as many as there are places behind the first ``wanted`` - 1 at most, and ``wanted`` for each
    place of the rarest lexeme; each is as long as the gap between the last lexeme to begin and the first to end.
    """
    w = Window.partitionBy("query_id", "alternative").orderBy("lexeme")
    own = asked.where("NOT negated").select("query_id", "alternative", "lexeme").distinct().withColumn("k", F.row_number().over(w) - 1)
    own = own.withColumn("wanted", F.count("*").over(Window.partitionBy("query_id", "alternative")).cast("int"))
    places = hit.where("NOT negated").select("query_id", "alternative", "lexeme", "chunk_id", "pos").distinct()
    mine = places.join(_bounded(own), ["query_id", "alternative", "lexeme"]).join(found, ["query_id", "chunk_id"], "left_semi")
    each = mine.groupBy("query_id", "alternative", "wanted", "chunk_id", "k").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_list("pos").alias("places"))  # one chunk's positions
    by = each.groupBy("query_id", "alternative", "wanted", "chunk_id").agg(F.count("*").alias("held"), F.sum("n").alias("all"), F.min("n").alias("rarest"), (F.max("lo") - F.min("hi") + 1).alias("gap"), F.collect_list(F.struct("k", "places")).alias("hits"))
    stretches = F.least(F.col("wanted") * F.col("rarest"), F.col("all") - F.col("wanted") + 1)
    most = F.when(F.col("held") == F.col("wanted"), stretches * F.col("wanted") / F.greatest("wanted", "gap")).otherwise(0.0)
    return by.select("query_id", "alternative", "wanted", "chunk_id", "hits", (most * (1 + 1e-9)).alias("most"))


@F.pandas_udf(DoubleType())
def density(rows: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([cover_density(sorted(((h["k"], p) for h in row for p in h["places"]), key=lambda x: x[1]), n) for row, n in zip(rows, wanted, strict=True)], dtype=float)


def _scored(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "chunk_id", density("hits", "wanted").alias("score")).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def worth_scoring(bounded: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The chunks of each query that can score most, ``depth`` of them, scored; and the bounds of those others that can still be among the best.

    A chunk whose bound is below the worst of ``depth`` scores that are known isn't scored at all.
    """
    by_chunk = bounded.groupBy("query_id", "chunk_id").agg(F.max("most").alias("most"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("most").desc(), "chunk_id"))
    placed = materialise(by_chunk.withColumn("nth", nth), "bounds")
    first = placed.where(F.col("nth") <= depth).select("query_id", "chunk_id")
    known = materialise(_scored(bounded.join(first, ["query_id", "chunk_id"], "left_semi")), "scored")
    edge = known.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("edge"))
    still = placed.where(F.col("nth") > depth).join(edge, "query_id").where((F.col("n") < depth) | (F.col("most") >= F.col("edge"))).select("query_id", "chunk_id")
    return known, bounded.join(still, ["query_id", "chunk_id"], "left_semi")


def rank_hits(hit: DataFrame, asked: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """query_id, chunk_id, score, rank of each query's ``depth`` best of ``found``; the best alternative counts.

    Positions are only gone through in chunks whose counts and spans allow them to be among the best.
    """
    found = materialise(found, "found")
    known, rest = worth_scoring(materialise(bounds(hit, asked, found), "bounded"), depth)
    scored = known.unionByName(_scored(rest))
    # what fits by negations alone scores 0, and so do chunks that can't be among the best, which ``depth`` others keep out
    unscored = found.join(scored, ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    return ranked(scored.unionByName(unscored), depth)


def rank_matches(posted: DataFrame, asked: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    return rank_hits(hits(posted, asked), asked, found, depth)


def search(posted: DataFrame, asked: DataFrame, depth: int, chunks: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score and rank of each query's ``depth`` best: matching and ranking over one reading of the postings.

    What fits by negations alone has score 0.
    """
    hit = materialise(hits(asked_only(posted, asked), asked), "hits")
    return rank_hits(hit, asked, _found(hit, asked, chunks), depth)
