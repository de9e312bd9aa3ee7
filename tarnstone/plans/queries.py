"""The queries over the driver's tables, each beside the SQL that says the same.

The tables stand in for the engine's: documents for chunks and archives (source as batch, lang as corpus, every
tenth id re-ingested once), embeddings for chunk vectors, events for trails and jobs, benchmark for labels.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import ids
from ..config import ChunkingParams, RetrievalConfig
from ..functions import text as T
from ..functions.embedding import embed_column
from ..operators import admit, chunking, fts, fusion, generations, gold, jobs, metrics, parsers, reads, vector
from ..operators.validate import violations
from ..shared import delete, fresh_path, materialise, spread
from ..sources import buckets, sinks
from ..streaming import pipeline
from . import search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- identity, admission, text ------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def content_fingerprint(s, d):
    return t(s, d, "documents").select("doc_id", ids.fingerprint(F.col("text")).alias("fingerprint"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS fingerprint FROM documents GROUP BY 2")
def content_dedupe_first_wins(s, d):
    """Admission itself: one corpus, files in the order of their ids."""
    files = t(s, d, "documents").select("doc_id", F.lit("c").alias("corpus_id"), F.col("doc_id").cast("string").alias("filename"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("arrival"))
    return admit.admit(files).where("NOT duplicate").select("doc_id", "fingerprint")


@query("SELECT sha256(text) AS fingerprint, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_report(s, d):
    return admit.duplicate_report(t(s, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("fingerprint")))


@query("SELECT doc_id, sha256(lang || ':' || sha256(text) || ':markdown@1.0.0:1:0:' || sha256(text)) AS chunk_id FROM documents")
def derive_chunk_id(s, d):
    digest = F.sha2("text", 256)
    made = ids.chunk_id(F.col("lang"), digest, ids.plugin_stamp(F.lit("markdown"), F.lit("1.0.0")), F.lit(1), F.lit(0), F.col("text"))
    return t(s, d, "documents").select("doc_id", made.alias("chunk_id"))


@query("SELECT doc_id, sha256(sha256(text) || ':markdown@1.0.0:2:' || (doc_id % 5)::VARCHAR) AS section_id, sha256(text || chr(10) || 'fixture/deterministic-v1/32') AS vector_id FROM documents")
def derive_section_and_vector_id(s, d):
    stamp = ids.plugin_stamp(F.lit("markdown"), F.lit("1.0.0"))
    return t(s, d, "documents").select(
        "doc_id",
        ids.section_id(F.sha2("text", 256), stamp, F.lit(2), F.col("doc_id") % 5).alias("section_id"),
        ids.vector_id(F.col("text"), F.lit("fixture"), F.lit("deterministic-v1"), F.lit(32)).alias("vector_id"),
    )


@query("""
    SELECT page_id, CASE WHEN lower(regexp_extract(url, '\\.([^./\\\\]+)$', 1)) IN ('html', 'htm') THEN 'text/html' END AS media_type FROM pages""")
def media_sniff(s, d):
    return t(s, d, "pages").select("page_id", T.sniff_media_type(F.col("url"), F.col("html").cast("binary")).alias("media_type"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS normalized FROM documents")
def normalize_whitespace(s, d):
    return t(s, d, "documents").select("doc_id", T.normalize_space(F.col("text"), unicode=False).alias("normalized"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS stripped, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS anchor_end FROM pages")
def strip_tags(s, d):
    bare = T.strip_tags(F.col("html"))
    return t(s, d, "pages").select("page_id", bare.alias("stripped"), F.length(bare).cast("long").alias("anchor_end"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS h1 FROM pages")
def html_h1(s, d):
    head = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return t(s, d, "pages").select("page_id", T.normalize_space(T.strip_tags(head), unicode=False).alias("h1"))


@query(r"""
    SELECT page_id, regexp_matches(html, '(?i)<\s*(script|iframe|object|embed|link|meta|form)\b') AS element, regexp_matches(html, '(?i)\son\w+\s*=') AS handler,
           regexp_matches(html, '(?i)javascript:') AS script_url, regexp_matches(html, '(?i)\ssrc\s*=\s*["'']?(https?:)?//') AS external FROM pages""")
def forbidden_html(s, d):
    names = ("element", "handler", "script_url", "external")
    return t(s, d, "pages").select("page_id", *(F.col("html").rlike(p).alias(n) for n, (p, _) in zip(names, T.FORBIDDEN_HTML, strict=True)))


@query("""
    SELECT page_id, CASE WHEN contains(html, '<article') THEN 'generic-html' END AS plugin, CASE WHEN contains(html, '<article') THEN 0.1 ELSE 0.0 END::DOUBLE AS confidence,
           2::BIGINT AS candidates FROM pages""")
def plugin_dispatch(s, d):
    p = parsers.parse_column(F.lit("text/html"), F.col("html").cast("binary"))
    return t(s, d, "pages").withColumn("p", p).select("page_id", F.col("p.plugin_name").alias("plugin"), F.col("p.confidence").alias("confidence"), F.size("p.candidates").cast("long").alias("candidates"))


def _parsed_pages(s, d) -> DataFrame:
    """Parsed once and written, as an ingest does."""
    return materialise(t(s, d, "pages").select("page_id", parsers.parse_column(F.lit("text/html"), F.col("html").cast("binary")).alias("p")), "pages")


#: What stands behind the heading of these pages, without tags and with its entities read.
BARE = r"regexp_replace(replace(regexp_extract(html, '(?s)</h1>(.*?)</article>', 1), '<p>', ' '), '<[^>]*>', '', 'g')"
READ = f"replace(replace(replace(replace(replace({BARE}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', chr(39)), '&amp;', '&')"
HEADING = "replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(rf"""
    WITH b AS (SELECT page_id, trim(regexp_replace({HEADING}, '\s+', ' ', 'g')) AS heading, trim(regexp_replace({READ}, '\s+', ' ', 'g')) AS content FROM pages)
    SELECT page_id, 0::INTEGER AS section_index, heading AS path, 'prose' AS kind, heading, content FROM b WHERE heading <> '' AND content <> ''""")
def html_sections(s, d):
    found = parsers.sections_of(_parsed_pages(s, d).select("page_id", "p.document").where("document IS NOT NULL"), "page_id")
    return found.select("page_id", "section_index", F.array_join("path", " > ").alias("path"), "kind", "heading", "content")


@query()
def display_artifacts(s, d):
    found = parsers.sections_of(_parsed_pages(s, d).select("page_id", "p.document").where("document IS NOT NULL"), "page_id")
    return found.select("page_id", "section_index", F.col("anchor.char_end").alias("anchor_end"), F.col("display_artifact.content").alias("html"))


@query("""
    SELECT page_id, CASE WHEN page_id % 6 < 5 THEN 'malformed' END AS failure, (page_id % 6 < 5)::INTEGER + (page_id % 6 = 4)::INTEGER AS violations,
           CASE page_id % 6 WHEN 0 THEN 'title is empty' WHEN 1 THEN 'section 0: index is out of order' WHEN 2 THEN 'section 0: kind is unknown' WHEN 3 THEN 'section 0: anchor range is invalid'
                            WHEN 4 THEN 'section 0: content is empty; section 0: anchor resolves to no artifact' ELSE '' END AS said
    FROM pages WHERE regexp_matches(html, '(?s)<article>.*<h1>.*</h1>.*</article>')""")
def validated_documents(s, d):
    """Every page as its document, five sixths of them with something wrong: all that is wrong is said at once."""
    doc, n = F.col("p.document"), F.col("page_id") % 6
    each = lambda f: doc.withField("sections", F.transform(doc["sections"], f))
    bad = (
        F.when(n == 0, doc.withField("title", F.lit(" \t")))
        .when(n == 1, each(lambda x: x.withField("index", x["index"] + 1)))
        .when(n == 2, each(lambda x: x.withField("kind", F.lit("poem"))))
        .when(n == 3, each(lambda x: x.withField("anchor", x["anchor"].withField("char_end", x["anchor"]["char_end"] + 1))))
        .when(n == 4, each(lambda x: x.withField("content", F.lit(" ")).withField("anchor", x["anchor"].withField("artifact_id", F.lit("none")))))
        .otherwise(doc)
    )
    found = _parsed_pages(s, d).where("p.document IS NOT NULL").select("page_id", violations(bad).alias("v"))
    failure = F.when(F.size("v") > 0, reads.scrub_failure(F.lit("malformed"), F.lit("transform"), F.array_join("v", "; ")))
    return found.select("page_id", failure["class"].alias("failure"), F.size("v").alias("violations"), F.array_join("v", "; ").alias("said"))


#: A conversation as a document: each turn under a heading one level below the last, six levels deep at most, then from the top again.
TURNS = "t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"


def _turns(s, d) -> DataFrame:
    """conv_id and its turns in order, as (i, text)."""
    turns = t(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))  # one conversation's
    return turns.select("conv_id", F.transform("turns", lambda x, i: F.struct(i.alias("i"), F.coalesce(x["text"], F.lit("")).alias("text"))).alias("turns"))


def _found_sections(parsed: DataFrame) -> DataFrame:
    found = parsers.sections_of(materialise(parsed.select("conv_id", "p.document").where("document IS NOT NULL"), "parsed"), "conv_id")
    return found.select("conv_id", "section_index", F.array_join("path", " > ").alias("path"), "kind", "heading", F.sha2("content", 256).alias("content_sha256"))


@query(f"""WITH {TURNS} SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INTEGER AS section_index, array_to_string(list_transform(range(i - i % 6, i + 1), lambda k: 'turn ' || k), ' > ') AS path,
    'prose' AS kind, 'turn ' || i AS heading, sha256(content) AS content_sha256 FROM t WHERE content <> ''""")
def markdown_sections(s, d):
    """Headings of six levels in Markdown, one inside the other."""
    lines = F.transform(F.col("turns"), lambda x: F.concat(F.repeat(F.lit("#"), (x["i"] % 6 + 1).cast("int")), F.lit(" turn "), x["i"].cast("string"), F.lit("\n"), F.regexp_replace(x["text"], r"\s+", " ")))
    return _found_sections(_turns(s, d).select("conv_id", parsers.parse_column(F.lit("text/markdown"), F.array_join(lines, "\n\n").cast("binary")).alias("p")))


@query(f"""WITH {TURNS} SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INTEGER AS section_index, 'talk ' || conv_id || ' > ' || array_to_string(list_transform(range(i - i % 5, i + 1), lambda k: 'turn ' || k), ' > ') AS path,
    CASE WHEN i % 5 = 4 THEN 'table' ELSE 'prose' END AS kind, 'turn ' || i AS heading, sha256(content) AS content_sha256 FROM t WHERE content <> ''""")
def html_heading_sections(s, d):
    """Headings from h1 to h6 in HTML, the deepest over tables; scripts and navigation in between leave no trace."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = lambda x: F.when(x["i"] % 5 == 4, F.concat(F.lit("<table><tr><td>"), safe(x["text"]), F.lit("</td></tr></table>"))).otherwise(F.concat(F.lit("<p>"), safe(x["text"]), F.lit("</p><script>var a = '<p>';</script><nav>menu</nav>")))
    level = lambda x: (x["i"] % 5 + 2).cast("string")
    parts = F.transform(F.col("turns"), lambda x: F.concat(F.lit("<h"), level(x), F.lit(">turn "), x["i"].cast("string"), F.lit("</h"), level(x), F.lit(">"), body(x)))
    html = F.concat(F.lit("<!doctype html><body><h1>talk "), F.col("conv_id").cast("string"), F.lit("</h1>"), F.array_join(parts, ""), F.lit("</body>"))
    return _found_sections(_turns(s, d).select("conv_id", parsers.parse_column(F.lit("text/html"), html.cast("binary")).alias("p")))


@query(r"""
    WITH RECURSIVE d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS n FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
      l AS (SELECT doc_id, string_split(regexp_replace(n, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS x FROM d WHERE length(n) > 6000),
      s AS (SELECT doc_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM l),
      g AS (SELECT doc_id, i, 0 AS k, x AS held FROM s WHERE i = 1
            UNION ALL SELECT s.doc_id, s.i, CASE WHEN length(held) + 1 + length(x) <= 4000 THEN k ELSE k + 1 END, CASE WHEN length(held) + 1 + length(x) <= 4000 THEN held || ' ' || x ELSE x END
            FROM g JOIN s ON s.doc_id = g.doc_id AND s.i = g.i + 1),
      u AS (SELECT doc_id, k, arg_max(held, i) AS x FROM g GROUP BY 1, 2),
      p AS (SELECT doc_id, k, 0 AS c, x AS held FROM u WHERE k = 0
            UNION ALL SELECT u.doc_id, u.k, CASE WHEN length(held) + 2 + length(x) <= 4000 THEN c ELSE c + 1 END,
                   CASE WHEN length(held) + 2 + length(x) <= 4000 THEN held || chr(10) || chr(10) || x ELSE right(held, 400) || chr(10) || chr(10) || x END
            FROM p JOIN u ON u.doc_id = p.doc_id AND u.k = p.k + 1),
      o AS (SELECT doc_id, c, arg_max(held, k) AS content FROM p GROUP BY 1, 2 UNION ALL SELECT doc_id, 0, n FROM d WHERE length(n) <= 6000)
    SELECT doc_id, c::INTEGER AS chunk_index, length(content)::INTEGER AS chars, sha256(content) AS content_sha256, false AS oversized FROM o""")
def chunk_documents(s, d):
    docs = t(s, d, "documents").select("doc_id", parsers.parse_column(F.lit("text/plain"), F.col("text").cast("binary")).alias("p"))
    each = docs.select("doc_id", F.explode(chunking.chunk_column(F.col("p.document.sections"))).alias("c"))
    return each.select("doc_id", "c.chunk_index", F.length("c.content").alias("chars"), F.sha2("c.content", 256).alias("content_sha256"), "c.oversized")


@query("""
    WITH RECURSIVE r AS (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS x FROM conversations),
      s AS (SELECT conv_id, turn, x, length(x) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM r WHERE x <> ''),
      f AS (SELECT conv_id, i, turn, x, n AS size, 0 AS pack FROM s WHERE i = 1
            UNION ALL SELECT s.conv_id, s.i, s.turn, s.x, CASE WHEN f.size + s.n > 1000 THEN s.n ELSE f.size + s.n END, CASE WHEN f.size + s.n > 1000 THEN f.pack + 1 ELSE f.pack END
            FROM f JOIN s ON s.conv_id = f.conv_id AND s.i = f.i + 1)
    SELECT conv_id, pack::INTEGER AS pack, count(*) AS sections, min(turn)::BIGINT AS first_turn, sha256(string_agg(x, chr(10) || chr(10) ORDER BY i)) AS content_sha256 FROM f GROUP BY 1, 2""")
def chunk_packing(s, d):
    """Turns as sections, packed to 1,000 characters by the chunker itself."""
    section = F.struct(F.col("turn").cast("int").alias("index"), F.lit("prose").alias("kind"), F.col("text").alias("content"))
    turns = t(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(section)).alias("turns"))  # one conversation's
    each = turns.select("conv_id", F.explode(chunking.chunk_column(F.col("turns"), ChunkingParams(1000, 100, 10_000_000))).alias("c"))
    return each.select("conv_id", F.col("c.chunk_index").alias("pack"), F.size("c.section_indexes").cast("long").alias("sections"), F.col("c.anchor_section_index").cast("long").alias("first_turn"), F.sha2("c.content", 256).alias("content_sha256"))


@query()
def deterministic_embedding(s, d):
    return t(s, d, "documents").select("doc_id", embed_column(F.col("text")).alias("embedding"))


# --- full text ----------------------------------------------------------------------------------

TOKENS = r"toks AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)"


def _chunks(s, d) -> DataFrame:
    return t(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


#: Where postings are, by application, folder and language, and of which files: an index is written once and searched many times.
_indexes: dict[tuple[str, str, str], tuple[tuple, str]] = {}


def _files(s, df: DataFrame) -> tuple:
    """Names, sizes and times of the files of a table: what tells one state of it from another."""
    path = s._jvm.org.apache.hadoop.fs.Path
    found = []
    for name in sorted(df.inputFiles()):
        at = path(name)
        state = at.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(at)
        found.append((name, state.getLen(), state.getModificationTime()))
    return tuple(found)


def _index(s, d, language: str = "simple") -> DataFrame:
    key, files = (s.sparkContext.applicationId, d, language), _files(s, t(s, d, "documents"))
    if _indexes.get(key, ((), ""))[0] != files:
        path = fresh_path(s, "index")
        fts.stored(fts.postings(_chunks(s, d), language)).write.partitionBy("part").parquet(path)
        if key in _indexes:
            delete(s, _indexes[key][1])
        _indexes[key] = files, path
    return s.read.parquet(_indexes[key][1])


def _match(s, d, text: str) -> DataFrame:
    asked = fts.query_table(s, {1: text}, "simple")
    posted = fts.asked_only(_index(s, d), asked)
    return fts.matches(posted, asked, _chunks(s, d)).select(F.col("chunk_id").alias("doc_id"))


def _questions(s, d) -> DataFrame:
    """The whole texts of the benchmark as questions; without the word that separates alternatives."""
    words = F.array_remove(T.simple_tokens(F.col("text")), "or")
    return t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))


@query(f"WITH {TOKENS}, e AS (SELECT doc_id, unnest(w) AS lexeme FROM toks) SELECT lexeme, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM e GROUP BY 1")
def token_postings(s, d):
    return fts.postings(_chunks(s, d), "simple").groupBy("lexeme").agg(F.countDistinct("chunk_id").alias("docs"), F.count("*").alias("occurrences"))


@query(f"WITH {TOKENS}, e AS (SELECT doc_id, unnest(w) AS lexeme FROM toks) SELECT lexeme, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM e GROUP BY 1")
def fts_index(s, d):
    """The same from the stored index, which is written here unless it is there: searches read it."""
    return _index(s, d).groupBy("lexeme").agg(F.countDistinct("chunk_id").alias("docs"), F.count("*").alias("occurrences"))


@query(f"WITH {TOKENS} SELECT doc_id FROM toks WHERE list_contains(w, 'the') AND list_contains(w, 'with')")
def fts_and_match(s, d):
    return _match(s, d, "the with")


@query(f"WITH {TOKENS} SELECT doc_id FROM toks WHERE list_contains(w, 'para') OR (list_contains(w, 'mit') AND list_contains(w, 'der'))")
def fts_or_match(s, d):
    return _match(s, d, "para or mit der")


@query(f"WITH {TOKENS} SELECT doc_id FROM toks WHERE list_contains(w, 'the') AND NOT list_contains(w, 'with')")
def fts_not_match(s, d):
    return _match(s, d, "the -with")


@query(f"WITH {TOKENS} SELECT doc_id FROM toks WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def fts_phrase_match(s, d):
    return _match(s, d, '"of the"')


#: Cover density: of all stretches that hold all words of a question, the least ones; words per word of each.
RANKED = f"""{TOKENS}, q AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND x <> 'or')) AS ws FROM benchmark),
    m AS (SELECT query_id, doc_id, ws, w FROM q JOIN toks ON list_has_all(w, ws) WHERE len(ws) > 0),
    h AS (SELECT query_id, doc_id, ws, p, x FROM (SELECT query_id, doc_id, ws, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM m) WHERE list_contains(ws, x)),
    g AS (SELECT query_id, doc_id, len(ws) AS n, p, max(CASE WHEN x = k THEN p END) OVER (PARTITION BY query_id, doc_id, k ORDER BY p) AS last FROM (SELECT *, unnest(ws) AS k FROM h)),
    c AS (SELECT query_id, doc_id, n, p, min(last) AS lo, count(last) AS seen FROM g GROUP BY ALL),
    o AS (SELECT query_id, doc_id AS chunk_id, round(sum(n / (hi - lo + 1)), 9) AS score FROM (SELECT query_id, doc_id, n, lo, min(p) AS hi FROM c WHERE seen = n GROUP BY ALL) GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM o)"""


@query(f"WITH {RANKED} SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 10")
def fts_rank_topk(s, d):
    asked = fts.query_frame(_questions(s, d), "simple")
    return fts.search(_index(s, d), materialise(asked, "asked"), 10).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query()
def fts_rank_english(s, d):
    asked = fts.query_frame(_questions(s, d), "english")
    return fts.search(_index(s, d, "english"), materialise(asked, "asked"), 10).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


# --- vectors, fusion, search --------------------------------------------------------------------

SIMS = """
    v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    sims AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.e, c.e), 7) AS score FROM v q JOIN v c ON true WHERE q.vec_id % 100 = 0)"""
VEC = SIMS + ", vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims WHERE score >= {floor} QUALIFY rank <= 50)"
#: A second signal over the same rows: by label and id.
TXT = ", txt AS (SELECT query_id, chunk_id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, ((c.vec_id * 7919 + q.vec_id * 104729) % 1000)::DOUBLE AS s FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 100 = 0) QUALIFY rank <= 50)"


def _rounded(s, d, floor: float) -> DataFrame:
    e = t(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return vector.similarities(spread(e), q, floor, 50, digits=7)


def _text_signal(s, d, depth: int = 50) -> DataFrame:
    """The signal depends on label and id modulo 1,000 only, so ``depth`` rows of each such bucket hold every question's best. Questions of one label
    and offset share their candidates: those of the buckets from the best down, as far as ``depth`` rows need."""
    e = t(s, d, "embeddings").where("label IS NOT NULL AND vec_id IS NOT NULL")
    own = F.col("vec_id") * 7919 % 1000
    nth = F.row_number().over(Window.partitionBy("label", "residue").orderBy("vec_id"))
    held = materialise(e.select("vec_id", "label", own.alias("residue")).withColumn("nth", nth).where(F.col("nth") <= depth), "buckets")
    sizes = held.groupBy("label", "residue").agg(F.count("*").alias("n"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.pmod(F.col("vec_id") * 104729, F.lit(1000)).alias("offset"))
    looks = q.select("label", "offset").distinct().withColumn("score", F.explode(F.sequence(F.lit(0), F.lit(999)))).withColumn("residue", F.pmod(F.col("score") - F.col("offset"), F.lit(1000)))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("label", "offset").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = looks.join(sizes, ["label", "residue"]).withColumn("above", above).where(F.col("above") < depth).select("label", "offset", "score", "residue")
    best = Window.partitionBy("label", "offset").orderBy(F.col("score").desc(), "vec_id")
    shared = held.join(needed, ["label", "residue"]).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= depth)
    found = q.join(shared, ["label", "offset"]).select("query_id", F.col("vec_id").alias("chunk_id"), F.col("score").cast("double").alias("score"))
    return fusion.ranked(found, depth)


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT c.vec_id AS chunk_id, round(list_cosine_similarity(q.e, c.e), 7) AS score FROM v q, v c WHERE q.vec_id = 0 ORDER BY score DESC, chunk_id LIMIT 10")
def vector_topk(s, d):
    e = t(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = e.where("chunk_id = 0").select(F.lit(0).cast("long").alias("query_id"), "embedding")
    return vector.similarities_sql(e, q, -1.0, 10, digits=7).select("chunk_id", "score")


@query(f"WITH {VEC.format(floor=-1)} SELECT query_id, chunk_id, score FROM vec WHERE rank <= 10")
def vector_topk_batch(s, d):
    e = t(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return vector.similarities(e, q, -1.0, 10, digits=7).select("query_id", "chunk_id", "score")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON true WHERE q.vec_id % 100 = 0)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, round(score, 6) AS score FROM n WHERE score >= 0.2 QUALIFY rank <= 10""")
def vector_pivots(s, d):
    """The ten nearest of each hundredth vector, from vectors stored by pivot. Scores by rank: equal ones may come in any order of theirs."""
    e = t(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    best, _ = vector.PivotIndex(e, 64).search(q, 0.2, 10)
    return best.select("query_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {VEC.format(floor=0.2)} SELECT query_id, count(*) AS candidates, min(score) AS least FROM vec GROUP BY 1")
def vector_floor(s, d):
    return _rounded(s, d, 0.2).groupBy("query_id").agg(F.count("*").alias("candidates"), F.min("score").alias("least"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.e, c.e), 12) AS score FROM v q JOIN v c ON true WHERE q.vec_id % 100 = 0)
    SELECT query_id, id, abs(round(1 - score, 9)) AS distance FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1""")
def vector_readback(s, d):
    """Each hundredth vector is looked for among all of its stamp: its nearest is itself, or an equal one."""
    e = t(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.struct(F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit(64).alias("dimensions")).alias("stamp"))
    probes = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    near = vector.read_back(e, probes, {"provider": "p", "model": "m", "dimensions": 64})
    return near.select("query_id", "id", F.abs(F.round("distance", 9)).alias("distance"))


@query("SELECT 'p' AS provider, len(embedding)::INTEGER AS dimensions, count(*) AS chunks FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1, 2")
def stamp_check(s, d):
    """The check itself passes for the corpus's own stamp; then its rows."""
    made = t(s, d, "embeddings").select("embedding", F.struct(F.lit("p").alias("provider"), F.lit("m").alias("model"), F.size("embedding").alias("dimensions")).alias("stamp"))
    own = made.where("embedding IS NOT NULL").select("stamp.*").first()
    there = own is not None and vector.check_stamp(made, own.asDict())
    return made.where(F.col("embedding").isNotNull() & F.lit(there)).groupBy("stamp.provider", "stamp.dimensions").agg(F.count("*").alias("chunks"))


RRF = f"""WITH {VEC.format(floor=0.2)}{TXT}, f AS (
    SELECT coalesce(v.query_id, x.query_id) AS query_id, coalesce(v.chunk_id, x.chunk_id) AS chunk_id, x.score AS fts_score, v.score AS vector_score,
           coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0) AS s FROM vec v FULL JOIN txt x ON v.query_id = x.query_id AND v.chunk_id = x.chunk_id)"""


@query(f"{RRF} SELECT query_id, chunk_id, fts_score, vector_score, round(s, 12) AS fused_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id)::INTEGER AS fused_rank FROM f QUALIFY fused_rank <= 10")
def fuse_rrf(s, d):
    f = fusion.fuse(_text_signal(s, d), _rounded(s, d, 0.2), RetrievalConfig())
    return fusion.top(f, 10, "fused_rank").select("query_id", "chunk_id", "fts_score", "vector_score", F.round("fused_score", 12).alias("fused_score"), "fused_rank")


@query(f"""WITH {VEC.format(floor=0.2)}{TXT},
    nv AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS n FROM vec WINDOW w AS (PARTITION BY query_id)),
    nt AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS n FROM txt WINDOW w AS (PARTITION BY query_id))
    SELECT coalesce(v.query_id, x.query_id) AS query_id, coalesce(v.chunk_id, x.chunk_id) AS chunk_id, round(0.5 * coalesce(v.n, 0) + 0.5 * coalesce(x.n, 0), 9) AS fused_score
    FROM nv v FULL JOIN nt x ON v.query_id = x.query_id AND v.chunk_id = x.chunk_id""")
def fuse_weighted(s, d):
    f = fusion.fuse(_text_signal(s, d), _rounded(s, d, 0.2), RetrievalConfig(fusion="weighted"))
    return f.select("query_id", "chunk_id", F.round("fused_score", 9).alias("fused_score"))


@query(f"{RRF} SELECT query_id, count(*) FILTER (fts_score IS NULL) AS vector_only, count(*) FILTER (vector_score IS NULL) AS fts_only, count(*) AS candidates FROM f GROUP BY 1")
def fuse_missing_signal(s, d):
    f = fusion.fuse(_text_signal(s, d), _rounded(s, d, 0.2), RetrievalConfig())
    return f.groupBy("query_id").agg(F.count(F.when(F.col("fts_score").isNull(), 1)).alias("vector_only"), F.count(F.when(F.col("vector_score").isNull(), 1)).alias("fts_only"), F.count("*").alias("candidates"))


@query(f"""{RRF}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS p FROM f QUALIFY p <= 20)
    SELECT query_id, chunk_id, p::INTEGER AS prerank_position, row_number() OVER (PARTITION BY query_id ORDER BY (chunk_id * 31 % 17) DESC, p)::INTEGER AS rank FROM r QUALIFY rank <= 10""")
def rerank_reorder(s, d):
    f = fusion.fuse(_text_signal(s, d), _rounded(s, d, 0.2), RetrievalConfig())
    r = fusion.rerank(f, (F.col("chunk_id") * 31 % 17).cast("double"), 20)
    return fusion.top(r, 10).select("query_id", "chunk_id", "prerank_position", "rank")


@query(f"""WITH {RANKED},
    fts AS (SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 50),
    v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    sims AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN benchmark b ON b.item_id = q.vec_id JOIN v c ON true JOIN documents x ON x.doc_id = c.vec_id),
    vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims WHERE score >= 0.2 QUALIFY rank <= 50),
    f AS (SELECT coalesce(v.query_id, x.query_id) AS query_id, coalesce(v.chunk_id, x.chunk_id) AS chunk_id, x.score AS fts_score, v.score AS vector_score, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0) AS s
          FROM vec v FULL JOIN fts x ON v.query_id = x.query_id AND v.chunk_id = x.chunk_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id)::INTEGER AS rank FROM f QUALIFY rank <= 10)
    SELECT query_id, rank, chunk_id, sha256(d.text) AS content_sha256, fts_score, round(vector_score, 7) AS vector_score, round(s, 12) AS fused_score FROM r JOIN documents d ON d.doc_id = r.chunk_id""")
def hybrid_search(s, d):
    """The search plan itself: every benchmark text is a question, with the vector of its number; documents are chunks, with theirs."""
    e = t(s, d, "embeddings")
    stamp = {"provider": "p", "model": "m", "dimensions": 64}
    held = e.select(F.col("vec_id").alias("v"), "embedding", F.struct(*(F.lit(v).alias(k) for k, v in stamp.items())).alias("stamp"))
    docs = t(s, d, "documents")
    chunks = docs.join(held, docs["doc_id"] == held["v"], "left").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.col("text").alias("content"), "embedding", "stamp")
    asked = _questions(s, d).join(e.select("vec_id", "embedding"), F.col("query_id") == F.col("vec_id")).where("query <> ''").drop("vec_id")
    found = search.search(chunks, asked, RetrievalConfig(), "simple", stamp=stamp, posted=_index(s, d))
    return found.select("query_id", "rank", "chunk_id", "content_sha256", F.round("fts_score", 9).alias("fts_score"), F.round("vector_score", 7).alias("vector_score"), F.round("fused_score", 12).alias("fused_score"))


@query(r"""WITH q AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS x FROM documents)
    SELECT doc_id AS query_id, CASE WHEN length(x) NOT BETWEEN 1 AND 1024 THEN 'a query must have 1 to 1024 characters' END AS refusal FROM q""")
def question_refusals(s, d):
    """Every document as a question: those that are too long are refused, row by row."""
    asked = t(s, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return search.check_queries(s, asked).select("query_id", "refusal")


@query("""SELECT label, count(*) AS embedded, CASE WHEN label % 3 = 1 THEN 'the corpus is embedded with {"provider":"p","model":"older","dimensions":' || max(len(embedding)) || '}, the query with {"provider":"p","model":"m","dimensions":64}' END AS refusal
    FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1""")
def stamp_refusals(s, d):
    """Labels as corpora, a third of which have been embedded by another model: what each of them says to a question."""
    model = F.when((F.col("label") % 3 == 1) & (F.col("vec_id") % 2 == 0), "older").otherwise("m")
    stamped = t(s, d, "embeddings").where("embedding IS NOT NULL").select("label", F.struct(F.lit("p").alias("provider"), model.alias("model"), F.size("embedding").alias("dimensions")).alias("stamp"))
    return vector.stamp_refusals(stamped, {"provider": "p", "model": "m", "dimensions": 64}, "label").select("label", "embedded", "refusal")


# --- generations, labels, reads -----------------------------------------------------------------

SOURCES = "src AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END AS current_generation FROM documents)"
#: A text counts as rewritten in generation 2 where the id is divisible by 20.
CHUNKS = "ch AS (SELECT doc_id AS source_id, 1 AS generation, text AS content FROM documents UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 20 = 0 THEN text || '!' ELSE text END FROM documents WHERE doc_id % 10 = 0)"
CURRENT = f"{SOURCES}, {CHUNKS}, cur AS (SELECT ch.* FROM ch JOIN src ON ch.source_id = src.id AND ch.generation = src.current_generation)"


def _sources(s, d) -> DataFrame:
    made = F.when(F.col("doc_id") % 10 == 0, 2).otherwise(1)
    return t(s, d, "documents").select(F.col("doc_id").alias("id"), made.alias("current_generation"), F.lit("markdown").alias("plugin_name"), F.when(F.col("doc_id") % 3 == 0, "1.0.0").otherwise("0.9.0").alias("plugin_version"))


def _all_chunks(s, d) -> DataFrame:
    docs = t(s, d, "documents")
    first = docs.select(F.col("doc_id").alias("source_id"), F.lit(1).alias("generation"), F.col("text").alias("content"))
    second = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("source_id"), F.lit(2).alias("generation"), F.when(F.col("doc_id") % 20 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return first.unionByName(second)


def _current(s, d) -> DataFrame:
    return gold.current(_all_chunks(s, d), _sources(s, d))


@query(f"WITH {CURRENT} SELECT source_id, count(*) AS chunks FROM cur GROUP BY 1")
def reader_predicate_counts(s, d):
    return _current(s, d).groupBy("source_id").agg(F.count("*").alias("chunks"))


@query(f"WITH {CURRENT}, live AS (SELECT DISTINCT source_id, sha256(content) AS h FROM cur) SELECT d.doc_id AS source_id, (SELECT count(*) FROM cur WHERE cur.source_id = d.doc_id) AS chunks, NOT EXISTS (SELECT 1 FROM live WHERE live.source_id = d.doc_id AND live.h = sha256(d.text)) AS superseded FROM documents d")
def reader_predicate_in_place(s, d):
    """Chunks, heads and receipts bucketed by source: current chunks and superseded receipts without an exchange."""
    heads = _sources(s, d).select(F.col("id").alias("source_id"), "current_generation")
    receipts = t(s, d, "documents").select(F.col("doc_id").alias("source_id"), F.sha2("text", 256).alias("content_sha256"))
    with buckets.published(s, "source_id", _all_chunks(s, d), heads, receipts) as (chunks, heads, receipts):
        live = gold.current_in_place(chunks, heads).select("source_id", F.sha2("content", 256).alias("content_sha256"))
        counts = live.groupBy("source_id").agg(F.count("*").alias("chunks"))
        flags = gold.superseded_in_place(receipts, live.distinct())
        return materialise(flags.join(counts, "source_id", "left").select("source_id", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), "superseded"), "in-place")


@query(f"WITH {SOURCES}, {CHUNKS} SELECT generation, count(*) AS swept FROM ch JOIN src ON ch.source_id = src.id WHERE ch.generation < src.current_generation GROUP BY 1")
def generation_sweep(s, d):
    return generations.swept(_all_chunks(s, d), _sources(s, d))[1].groupBy("generation").agg(F.count("*").alias("swept"))


@query(f"WITH {CURRENT} SELECT source_id, generation, sha256(content) AS content_sha256 FROM cur")
def generation_commit(s, d):
    """Both generations are inserted, twice, then what the pointer replaces is swept: what is left in the table."""
    rows = _all_chunks(s, d).withColumn("id", F.concat_ws(":", "source_id", "generation"))
    path = fresh_path(s, "commit")
    for part in ("generation = 1", "generation = 2", "generation = 1"):
        sinks.insert_ignore(rows.where(part), path)
    sinks.sweep(path, s, _sources(s, d))
    return sinks.read(s, path).select("source_id", "generation", F.sha2("content", 256).alias("content_sha256"))


@query("SELECT doc_id AS source_id, (CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END + 1)::INTEGER AS target_generation FROM documents WHERE doc_id % 3 <> 0")
def reingest_candidates(s, d):
    return generations.to_reingest(_sources(s, d), "markdown", "0.9.0")


RECEIPTS = "res AS (SELECT doc_id AS source_id, sha256(text) AS content_sha256 FROM documents)"


@query(f"WITH {CURRENT}, {RECEIPTS} SELECT source_id, content_sha256, NOT EXISTS (SELECT 1 FROM cur WHERE cur.source_id = res.source_id AND sha256(cur.content) = res.content_sha256) AS superseded FROM res")
def superseded(s, d):
    res = t(s, d, "documents").select(F.col("doc_id").alias("source_id"), F.sha2("text", 256).alias("content_sha256"))
    return gold.superseded(res, _current(s, d)).select("source_id", "content_sha256", "superseded")


def _labels(s, d) -> DataFrame:
    docs = t(s, d, "documents").select("doc_id", F.struct(F.lit("").alias("chunk_id"), F.col("doc_id").alias("source_id"), F.sha2("text", 256).alias("content_sha256")).alias("e"))
    return docs.groupBy((F.col("doc_id") / 7).cast("long").alias("item_id")).agg(F.collect_list("e").alias("expected"))  # seven at most


ITEMS = "items AS (SELECT doc_id // 7 AS item_id, doc_id AS source_id, sha256(text) AS h FROM documents)"


@query(f"WITH {CURRENT}, {ITEMS}, live AS (SELECT DISTINCT source_id, sha256(content) AS h FROM cur) SELECT item_id, bool_or(live.h IS NULL) AS needs_reconfirmation FROM items LEFT JOIN live ON live.source_id = items.source_id AND live.h = items.h GROUP BY 1")
def needs_reconfirmation(s, d):
    return gold.needs_reconfirmation(_labels(s, d), _current(s, d))


@query(f"WITH {CURRENT}, {ITEMS}, live AS (SELECT DISTINCT sha256(content) AS h FROM cur) SELECT item_id, bool_or(live.h IS NULL) AS unresolvable FROM items LEFT JOIN live ON live.h = items.h GROUP BY 1")
def hash_liveness(s, d):
    return gold.liveness(_labels(s, d), _current(s, d))


@query(f"WITH {CURRENT}, n AS (SELECT doc_id // 5 AS item_id, (row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) - 1)::INTEGER AS nth, sha256(text) AS chunk_id FROM documents) SELECT item_id, nth, chunk_id FROM n WHERE NOT EXISTS (SELECT 1 FROM cur WHERE sha256(cur.content) = n.chunk_id)")
def unresolved_labels(s, d):
    """Questions that name five passages by id each, some of them rewritten since: what refuses the question, and where it stands."""
    named = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", F.sha2("text", 256).alias("h")))), lambda x: x["h"])
    questions = t(s, d, "documents").groupBy(F.floor(F.col("doc_id") / 5).cast("long").alias("item_id")).agg(named.alias("chunk_ids"))  # five at most
    return gold.unresolved(questions, _current(s, d).select(F.sha2("content", 256).alias("id")))


@query("SELECT doc_id AS item_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY doc_id) % 4 = 0 THEN 'heldout' ELSE 'tuning' END AS split FROM documents")
def gold_split_every_4th(s, d):
    items = t(s, d, "documents").select(F.col("doc_id").alias("item_id"), "lang")
    return gold.default_split(items, "item_id", "item_id", "lang").select("item_id", "split")


def _batch():
    """Two hundred documents at most, as many as a batch may have."""
    return F.concat(F.lit("b"), F.floor(F.col("doc_id") / 200).cast("string"))


def _timeline(s, d) -> DataFrame:
    docs = t(s, d, "documents")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 97)
    sources = docs.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") % 2 == 0, _batch()).alias("batch_id"), F.col("lang").alias("filename"), F.lit("ingested").alias("status"), at.alias("created_at"), F.lit(1).alias("current_generation"))
    entry = F.struct(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 3 == 0, "skipped").otherwise("admitted").alias("status"))
    batches = docs.groupBy(_batch().alias("id")).agg(F.collect_list(entry).alias("entry_report"), F.max("doc_id").alias("m")).select("id", F.lit("batch").alias("filename"), F.lit("expanded").alias("status"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("m") % 97).alias("created_at"), "entry_report")
    return reads.timeline(sources, batches)


TIMELINE = """tl AS (SELECT 'source' AS kind, 's' || doc_id AS id, lang AS filename, 1700000000 + doc_id % 97 AS secs, NULL::INTEGER AS entries FROM documents WHERE doc_id % 2 <> 0
    UNION ALL SELECT 'batch', 'b' || doc_id // 200, 'batch', 1700000000 + max(doc_id) % 97, count(*)::INTEGER FROM documents GROUP BY 2)"""


@query(f"WITH {TIMELINE} SELECT kind, id, filename, secs, entries FROM tl ORDER BY secs DESC, id DESC LIMIT 50 OFFSET 10")
def timeline_union_page(s, d):
    return reads.page(_timeline(s, d), 50, 10).select("kind", "id", "filename", F.unix_seconds("created_at").alias("secs"), "entries")


@query(f"WITH {TIMELINE} SELECT count(*) AS total FROM tl")
def timeline_total(s, d):
    return _timeline(s, d).agg(F.count("*").alias("total"))


@query("""SELECT 'b' || doc_id // 200 AS batch_id, count(*) AS total, count(*) FILTER (doc_id % 3 = 0) AS skipped, count(*) FILTER (lang = 'en') AS ingested, count(*) FILTER (lang = 'de') AS failed FROM documents GROUP BY 1""")
def batch_entry_summary(s, d):
    docs = t(s, d, "documents")
    entry = F.struct(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 3 == 0, "skipped").otherwise("admitted").alias("status"))
    batches = docs.groupBy(_batch().alias("id")).agg(F.collect_list(entry).alias("entry_report"))  # a batch's entries
    members = docs.select(_batch().alias("batch_id"), F.when(F.col("lang") == "en", "ingested").when(F.col("lang") == "de", "failed").otherwise("queued").alias("status"))
    out = reads.batch_summary(batches, members, ("ingested", "failed"))
    return out.select("batch_id", F.col("total").cast("long").alias("total"), F.col("skipped").cast("long").alias("skipped"), "ingested", "failed")


@query("SELECT conv_id, array_to_string(list(role ORDER BY turn), ',') AS roles, count(*) AS events FROM conversations GROUP BY 1")
def event_trail(s, d):
    trail = reads.trail(t(s, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")
    return trail.select("conv_id", F.array_join(F.transform("trail", lambda e: e["role"]), ",").alias("roles"), F.size("trail").cast("long").alias("events"))


@query("SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events")
def stage_durations(s, d):
    e = t(s, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ts")
    return e.select("user_id", "event_id", (F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("gap_us"))


# --- evaluation ---------------------------------------------------------------------------------

EVAL = f"""{SIMS},
    res AS (SELECT s.query_id AS item_id, s.chunk_id, e.label, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, s.chunk_id) AS rank FROM sims s JOIN embeddings e ON e.vec_id = s.chunk_id WHERE s.chunk_id <> s.query_id QUALIFY rank <= 20),
    again AS (SELECT item_id, label, row_number() OVER (PARTITION BY item_id ORDER BY (chunk_id * 31 % 17) DESC, rank) AS rank FROM res),
    items AS (SELECT vec_id AS item_id, CASE WHEN vec_id // 100 % 4 = 3 THEN 'heldout' ELSE 'tuning' END AS split, vec_id // 100 % 11 = 1 AS unresolvable, [label, (label + 1) % 10] AS expected FROM embeddings WHERE vec_id % 100 = 0)"""
#: Outcomes of the results of a run, in SQL.
OUT = """{o} AS (SELECT i.item_id, i.split, CASE WHEN unresolvable THEN 'unresolvable' WHEN ranks IS NULL THEN 'miss' ELSE 'hit' END AS status, CASE WHEN NOT unresolvable THEN ranks[1] END AS first_hit_rank,
                 CASE WHEN unresolvable OR ranks IS NULL THEN 0 ELSE list_sum(list_transform(ranks, lambda r: 1 / log2(r + 1))) END AS dcg
          FROM items i LEFT JOIN (SELECT r.item_id, list(rank ORDER BY rank) AS ranks FROM {r} r JOIN items i ON i.item_id = r.item_id WHERE rank <= 10 AND list_contains(expected, label) GROUP BY 1) h USING (item_id))"""
ONE = f"{EVAL}, {OUT.format(o='o', r='res')}"
IDEAL = "(1 / log2(2) + 1 / log2(3))"


def _runs(s, d) -> tuple[DataFrame, DataFrame]:
    """Outcomes of two runs over every hundredth vector as a question: the nearest others, and the same reordered by a scorer. A label is
    what a question expects, with the next one."""
    e = t(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    q = e.where("chunk_id % 100 = 0")
    expected = F.array(F.col("label").cast("string"), ((F.col("label") + 1) % 10).cast("string"))
    nth = F.floor(F.col("chunk_id") / 100)
    items = q.select(F.col("chunk_id").alias("item_id"), F.when(nth % 4 == 3, "heldout").otherwise("tuning").alias("split"), expected.alias("expected"), (nth % 11 == 1).alias("unresolvable"))
    near = vector.similarities(e.select("chunk_id", "embedding"), q.select(F.col("chunk_id").alias("query_id"), "embedding"), -1.0, 21, digits=7)
    best = fusion.ranked(near.where("chunk_id <> query_id").drop("rank"), 20)  # itself is one of them at most
    best = materialise(best.join(e.select("chunk_id", F.col("label").cast("string").alias("hash")), "chunk_id"), "run")
    again = fusion.rerank(best.withColumn("fused_rank", F.col("rank")), (F.col("chunk_id") * 31 % 17).cast("double"), 20)
    first, second = (metrics.outcomes(items, r.where("rank <= 10").select(F.col("query_id").alias("item_id"), "rank", "hash")) for r in (best, again))
    return first, second


@query(f"WITH {ONE} SELECT item_id, split, status, first_hit_rank::INTEGER AS first_hit_rank, round(dcg, 9) AS dcg FROM o")
def eval_outcomes(s, d):
    return _runs(s, d)[0].select("item_id", "split", "status", "first_hit_rank", F.round("dcg", 9).alias("dcg"))


#: Splits without a question that counts have null metrics.
SPLITS = "SELECT x.split, m.* EXCLUDE split FROM (VALUES ('tuning'), ('heldout')) x(split) LEFT JOIN ({}) m ON m.split = x.split"


@query(f"WITH {ONE} " + SPLITS.format("SELECT split, round(avg(CASE WHEN first_hit_rank <= 5 THEN 1.0 ELSE 0 END), 9)::DOUBLE AS recall_at_5, round(avg(CASE WHEN first_hit_rank <= 10 THEN 1.0 ELSE 0 END), 9)::DOUBLE AS recall_at_10 FROM o WHERE status <> 'unresolvable' GROUP BY 1"))
def eval_recall(s, d):
    return metrics.slices(_runs(s, d)[0]).select("split", F.round("recall_at_5", 9).alias("recall_at_5"), F.round("recall_at_10", 9).alias("recall_at_10"))


@query(f"WITH {ONE} " + SPLITS.format("SELECT split, round(avg(coalesce(1.0 / first_hit_rank, 0)), 9)::DOUBLE AS mrr, count(*) AS items FROM o WHERE status <> 'unresolvable' GROUP BY 1"))
def eval_mrr(s, d):
    return metrics.slices(_runs(s, d)[0]).select("split", F.round("mrr", 9).alias("mrr"), "items")


@query(f"WITH {ONE} " + SPLITS.format(f"SELECT split, round(avg(dcg / {IDEAL}), 9)::DOUBLE AS ndcg_at_10 FROM o WHERE status <> 'unresolvable' GROUP BY 1"))
def eval_ndcg(s, d):
    return metrics.slices(_runs(s, d)[0]).select("split", F.round("ndcg_at_10", 9).alias("ndcg_at_10"))


def _long(o: str) -> str:
    every = {"recall_at_5": "avg(CASE WHEN first_hit_rank <= 5 THEN 1.0 ELSE 0 END)", "recall_at_10": "avg(CASE WHEN first_hit_rank <= 10 THEN 1.0 ELSE 0 END)", "mrr": "avg(coalesce(1.0 / first_hit_rank, 0))", "ndcg_at_10": f"avg(dcg / {IDEAL})"}
    return " UNION ALL ".join(f"SELECT x.split, '{k}' AS metric, (SELECT ({v})::DOUBLE FROM {o} WHERE status <> 'unresolvable' AND {o}.split = x.split) AS x FROM (VALUES ('tuning'), ('heldout')) x(split)" for k, v in every.items())


@query(f"WITH {ONE}, {OUT.format(o='p', r='again')}, a AS ({_long('o')}), b AS ({_long('p')}) SELECT a.split, a.metric, round(a.x, 9) AS before, round(b.x, 9) AS after, round(b.x - a.x, 9) AS delta FROM a JOIN b ON a.split = b.split AND a.metric = b.metric")
def eval_compare(s, d):
    c = metrics.compare(*map(metrics.slices, _runs(s, d)))
    return c.select("split", "metric", *(F.round(x, 9).alias(x) for x in ("before", "after", "delta")))


# --- queue --------------------------------------------------------------------------------------

AS_OF = "2024-01-15 12:00:00"
JOBS = "jobs AS (SELECT event_id AS id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN 'claimed' ELSE 'queued' END AS status, (event_id % 4)::INTEGER AS attempts, ts AS run_at, ts AS created_at FROM events)"


def _jobs(s, d) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    claimed = F.col("event_id") % 3 == 0
    return t(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.when(claimed, "claimed").otherwise("queued").alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), at.alias("run_at"), at.alias("created_at"), F.when(claimed, "w").alias("claimed_by"), F.when(claimed, at).alias("claimed_at"))


@query(f"WITH {JOBS} SELECT id, kind, row_number() OVER (ORDER BY created_at, id)::INTEGER AS position FROM jobs WHERE status = 'queued' AND run_at <= TIMESTAMP '{AS_OF}' ORDER BY created_at, id LIMIT 25")
def queue_claim_order(s, d):
    first = jobs.claimable(_jobs(s, d), F.lit(AS_OF).cast("timestamp"), 25)
    return first.select("id", "kind", F.row_number().over(Window.orderBy("created_at", "id")).alias("position"))


@query("SELECT event_id::VARCHAR AS id, 1::BIGINT AS holders FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' ORDER BY ts, event_id::VARCHAR LIMIT 60")
def queue_exclusive_claims(s, d):
    """Three workers at once, two polls of ten jobs each, against one table of all events: the oldest sixty, each with one holder."""
    path, at = fresh_path(s, "jobs"), F.col("ts").cast("timestamp")
    none = {c: F.lit(None).cast(k) for c, k in (("claimed_by", "string"), ("claimed_at", "timestamp"), ("last_error", "string"))}
    rows = t(s, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.lit("{}").alias("payload"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.lit(3).alias("max_attempts"), at.alias("run_at"), at.alias("created_at")).withColumns(none)
    sinks.insert_ignore(rows.select(*pipeline.COLUMNS), path, keyed=True)
    due = datetime.datetime(2024, 1, 15, 12, tzinfo=datetime.UTC)
    with ThreadPoolExecutor(3) as pool:
        held = [x for x in pool.map(lambda n: pipeline.claim(s, path, f"worker {n % 3}", due, 10), range(6)) if x is not None]
    return reduce(DataFrame.unionByName, held).groupBy("id").agg(F.countDistinct("claimed_by").alias("holders"))


@query(f"WITH {JOBS} SELECT id, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END AS status, CASE WHEN attempts >= 3 THEN 0 ELSE (5 * 2 ** greatest(0, attempts - 1))::BIGINT END AS delay_s FROM jobs WHERE status = 'claimed'")
def queue_backoff(s, d):
    now = F.lit(AS_OF).cast("timestamp")
    failed = jobs.fail(_jobs(s, d).where("status = 'claimed'"), F.lit("boom"), now)
    delay = F.when(F.col("status") == "failed", F.lit(0).cast("long")).otherwise(F.unix_seconds("run_at") - F.unix_seconds(now))
    return failed.select("id", "status", delay.alias("delay_s"))


@query(f"WITH {JOBS} SELECT CASE WHEN status = 'claimed' AND run_at < TIMESTAMP '{AS_OF}' - INTERVAL 60 SECOND THEN 'queued' ELSE status END AS status, count(*) AS jobs FROM jobs GROUP BY 1")
def queue_reclaim(s, d):
    return jobs.reclaim_stale(_jobs(s, d), F.lit(AS_OF).cast("timestamp")).groupBy("status").agg(F.count("*").alias("jobs"))


@query("SELECT event_type AS kind, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS handler, count(*) AS jobs FROM events GROUP BY 1, 2")
def queue_dispatch(s, d):
    return jobs.route(_jobs(s, d), ("click", "view")).groupBy("kind", "handler").agg(F.count("*").alias("jobs"))


@query("SELECT event_id AS id, event_type AS event, event_type <> 'error' AND event_type <> 'failed' AS ok FROM events")
def event_ok_default(s, d):
    from ..sources.sinks import event_ok

    e = t(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("event"), F.when(F.col("event_type") == "error", False).alias("given"))
    return e.select("id", "event", event_ok(F.col("given"), F.col("event")).alias("ok"))


# --- beyond the reference: relational and event-time coverage -----------------------------------


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def ext_pricing_summary(s, d):
    l = t(s, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def ext_revenue_by_nation(s, d):
    c, o, l, n = (t(s, d, x) for x in ("customer", "orders", "lineitem", "nation"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS orders FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def ext_rollup_orders(s, d):
    return t(s, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("orders"))


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC)::INTEGER AS place FROM orders")
def ext_window_rank(s, d):
    return t(s, d, "orders").select("o_orderkey", F.rank().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc())).alias("place"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling_events(s, d):
    w = pipeline.tumbling(t(s, d, "events"), "ts", "1 hour", "event_type", events=F.count("*"), total=F.round(F.sum("value"), 4))
    return w.drop("window_end")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS events FROM n GROUP BY user_id, k""")
def ext_session_events(s, d):
    w = pipeline.sessions(t(s, d, "events"), "ts", "30 minutes", "user_id", events=F.count("*"))
    return w.select("user_id", "session_start", "events")
