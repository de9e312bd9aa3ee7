"""Language ID by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one mask of languages per slot; an n-gram's languages are the AND of its slots'
masks, so one lookup answers for all languages. A text's n-grams are looked up, each language's hits are
counted, corrected for the share of false positives its bits are known to give, and the largest count decides.

Learning: n-grams of a bounded sample of labelled texts (``SAMPLE`` per language at most, on average, drawn by a
hash, so languages with fewer are taken whole). An n-gram belongs to a language if it makes up at least
``RATE`` of that language's n-grams and a quarter of the share it has in any other. No more than 1 / RATE n-grams
of a language can. A filter holds ``GROUP`` languages, which bounds it; where there are more, each text meets one
filter after the other and the largest count of all decides. Languages are numbered and kept in a table.

Long texts are read in stretches, so memory is bounded by ``SLICE``, not by a text.

Defined cases: null text, or one without a letter, is ``und`` with score 0; a text with letters but no n-gram
gets the language with most labelled texts; equal counts: the language with more labelled texts, then the
smaller name; without anything learned all are ``und``. A null doc_id is not held out. An empty table gives an empty result; rows
that repeat are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, lookup, materialise, slices

#: Texts of each language to learn from.
SAMPLE = 2000
RATE = 1e-5
#: Languages in a filter.
GROUP = 32
PROBES = 3
#: Bytes handled at a time.
SLICE = 1_000_000
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def grams(parts: list[tuple[int, str, int, int]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``n`` texts' lower-cased parts (text number, part, begin, end): hash and text number of each 4-gram whose middle two are
    letters (what isn't a letter counts as a space) and whose second character is between begin and end; whether each text has letters."""
    numbers, begins, ends, sizes = (np.array(x, np.int64) for x in zip(*((k, a, b, len(p) + 1) for k, p, a, b in parts), strict=True))
    codes = np.frombuffer((" " + " ".join(p for _, p, _, _ in parts) + "   ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letter_table()[codes]
    codes = np.where(letter, codes, 0).astype(np.uint64)
    of = np.repeat(numbers, sizes)
    m = len(of)
    has = np.zeros(n, bool)
    has[of[letter[1 : m + 1]]] = True
    place = np.arange(m) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(letter[1 : m + 1] & letter[2 : m + 2] & (place >= np.repeat(begins, sizes)) & (place < np.repeat(ends, sizes)))
    with np.errstate(over="ignore"):
        h = codes[at] * np.uint64(0x9E3779B97F4A7C15) + codes[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[at + 2] * np.uint64(0x165667B19E3779F9) + codes[at + 3] * np.uint64(0x27D4EB2F165667C5)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h, of[at], has


def read(texts: pa.Array):
    """Row ranges of a bounded size with what :func:`grams` gives of them; a text of over SLICE characters comes in several, each with
    a character before and two behind its own 4-grams' second ones."""
    for lo, hi in slices(pc.binary_length(texts).to_pylist(), SLICE):
        low = [t.lower() for t in texts.slice(lo, hi - lo).to_pylist()]
        if hi - lo == 1 and len(low[0]) > SLICE:
            for a in range(0, len(low[0]), SLICE):
                before = min(a, 1)
                yield lo, hi, *grams([(0, low[0][a - before : a + SLICE + 2], before, before + SLICE)], 1)
        else:
            yield lo, hi, *grams([(k, t, 0, len(t)) for k, t in enumerate(low)], hi - lo)


def slots(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The places of each hash in a table of ``size``, a power of two."""
    with np.errstate(over="ignore"):
        step = (h >> np.uint64(33)) | np.uint64(1)
        return [((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64) for i in range(PROBES)]


class Filter:
    """The bit-sliced Bloom filter: ``masks[word, slot]`` has a bit per language."""

    def __init__(self, languages: list[str], grams_of: dict[str, np.ndarray]):
        self.languages = languages
        total = sum(map(len, grams_of.values()))
        self.size = 1 << max(10, (16 * max(total, 1) - 1).bit_length())
        self.masks = np.zeros((max(1, -(-len(languages) // 8)), self.size), np.uint8)
        for k, lang in enumerate(languages):
            for s in slots(grams_of[lang], self.size):
                self.masks[k // 8, s] |= np.uint8(1 << k % 8)
        full = np.array([np.count_nonzero(self.masks[k // 8] & (1 << k % 8)) / self.size for k in range(len(languages))])
        self.false = full**PROBES

    def hits(self, h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """How many of the 4-grams of each of ``n`` texts each language has (text x language), false positives among them."""
        at = slots(h, self.size)
        out = np.zeros((n, len(self.languages)))
        for w, words in enumerate(self.masks):
            found = words[at[0]]
            for s in at[1:]:
                found &= words[s]
            for k in range(w * 8, min(w * 8 + 8, len(self.languages))):
                out[:, k] = np.bincount(of[(found >> (k % 8) & 1).astype(bool)], minlength=n)
        return out

    def corrected(self, hits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Without the false positives to be expected among ``n`` 4-grams of each text."""
        return np.maximum(0, (hits - n[:, None] * self.false) / (1 - self.false))


@dataclasses.dataclass(frozen=True)
class Model:
    """Tables of what was learned: languages (lang, n, nth, in the order that breaks ties) and own (nth, gram)."""

    groups: int
    languages: DataFrame | None = None
    own: DataFrame | None = None

    def filter(self, group: int) -> Filter:
        mine = F.col("nth").between(group * GROUP, group * GROUP + GROUP - 1)
        names = [r["lang"] for r in self.languages.where(mine).orderBy("nth").collect()]  # GROUP at most
        rows = self.own.where(mine).toPandas()  # GROUP / RATE at most
        return Filter(names, {lang: rows["gram"][rows["nth"] == group * GROUP + k].to_numpy(np.int64).view(np.uint64) for k, lang in enumerate(names)})


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from ``labelled`` (doc_id, text, lang)."""
    spark = labelled.sparkSession
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    order = Window.orderBy(F.col("n").desc(), "lang")  # a row per language
    languages = materialise(known.groupBy("lang").agg(F.count("*").alias("n")).withColumn("nth", F.row_number().over(order) - 1), "languages")
    groups = -(-languages.count() // GROUP)
    if not groups:
        return Model(0)

    def run(batches):
        for batch in batches:
            nths = batch.column(0).to_numpy()
            for lo, hi, h, of, _ in read(batch.column(1)):
                of_gram = nths[lo:hi][of]
                for nth in np.unique(of_gram).tolist():
                    found, n = np.unique(h[of_gram == nth], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), nth, np.int32)), pa.array(found.view(np.int64)), pa.array(n)], names=["nth", "gram", "n"])

    path = fresh_path(spark, "language-grams")
    for g in range(groups):
        these = F.broadcast(languages.where(F.col("nth").between(g * GROUP, g * GROUP + GROUP - 1)))  # GROUP rows
        drawn = known.join(these, "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(float(sample)) / F.col("n") * (1 << 30)).select("nth", "text")
        drawn.mapInArrow(run, "nth int, gram long, n long").groupBy("nth", "gram").agg(F.sum("n").alias("n")).write.mode("append").parquet(path)
    counts = spark.read.schema("nth int, gram long, n long").parquet(path)
    rates = lookup(counts, counts.groupBy("nth").agg(F.sum("n").alias("total")), "nth").withColumn("rate", F.col("n") / F.col("total"))
    most = F.max("rate").over(Window.partitionBy("gram"))  # a row per language at most
    own = rates.withColumn("most", most).where((F.col("rate") >= RATE) & (F.col("rate") * 4 >= F.col("most")))
    return Model(groups, languages, materialise(own.select("nth", "gram"), "own-grams"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the best language's share of all corrected counts) of every row."""
    spark, texts = docs.sparkSession, docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    if not model.groups:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def against(group: int) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast(model.filter(group))

        def run(batches):
            m = shared.value
            for batch in batches:
                rows = batch.num_rows
                hits, n, letters = np.zeros((rows, len(m.languages))), np.zeros(rows), np.zeros(rows, bool)
                for lo, hi, h, of, has in read(pc.fill_null(batch.column(2), "")):  # a long text comes in several parts
                    hits[lo:hi] += m.hits(h, of, hi - lo)
                    n[lo:hi] += np.bincount(of, minlength=hi - lo)
                    letters[lo:hi] |= has
                counts = m.corrected(hits, n)
                best = counts.argmax(axis=1)
                columns = [pa.array([m.languages[b] for b in best], pa.string()), pa.array((best + group * GROUP).astype(np.int32)), pa.array(counts[np.arange(rows), best]), pa.array(counts.sum(axis=1)), pa.array(letters)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_hash", "lang", "nth", "best", "total", "letters"])

        return texts.mapInArrow(run, "doc_id long, text_hash long, lang string, nth int, best double, total double, letters boolean"), shared

    if model.groups == 1:
        found, _ = against(0)
    else:  # the groups' bests of a text meet; rows that repeat meet too, and are told apart again
        path = fresh_path(spark, "languages")
        for g in range(model.groups):
            part, shared = against(g)
            part.write.mode("append").parquet(path)
            shared.destroy()
        every = spark.read.schema(part.schema).parquet(path)
        first = F.max(F.struct("best", (-F.col("nth")).alias("before"), "lang"))
        met = every.groupBy("doc_id", "text_hash").agg(first.alias("first"), F.sum("total").alias("sum"), F.first("letters").alias("letters"), (F.count("*") / model.groups).cast("long").alias("rows"))
        found = met.select("doc_id", F.col("first.lang").alias("lang"), F.col("first.best").alias("best"), (F.col("sum") / F.col("rows")).alias("total"), "letters", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    score = F.when(F.col("letters") & (F.col("total") > 0), F.least(F.col("best") / F.col("total"), F.lit(1.0))).otherwise(0.0)
    return found.select("doc_id", F.when(F.col("letters"), F.col("lang")).otherwise("und").alias("lang_pred"), score.alias("score"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
