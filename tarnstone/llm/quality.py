"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target text (labelled as good) and one of the raw corpus, give
every text a log importance weight: the sum over its n-grams of log p_target - log p_raw. Texts are drawn
without replacement in proportion to their weights by the Gumbel top-k trick: weight plus Gumbel noise, of
which the largest keys stay. The noise is a hash of doc_id and text, so reruns agree. A sum grows with its text, so
texts are drawn within strata of similar length (numbers of n-grams between powers of two): a long one competes with long ones.

An n-gram is a word, a pair of words, or a triple of word shapes; words are runs of letters and digits or of one
punctuation character, and a shape tells case, length and whether a word repeats one of the last few; a run of over ``RUN`` bytes
counts as several, each but the last of that length. Long texts are read in stretches that end between runs and carry the last few
runs along, so memory is bounded by ``SLICE``, not by a text, and every text has the same n-grams in one stretch or many.

The raw model counts every text; the target model is fitted on ``SAMPLE`` labelled texts on average, drawn by
a hash. How many texts of a stratum stay is a share of them; unless given, it is the share of its texts whose weight is above the
cut that best separates such a sample of labelled texts. The k-th largest key of each stratum is found exactly by counting keys
digit by digit.

Defined cases: null text is empty; a text without n-grams has weight 0; rows that repeat doc_id and text have the
same key and fare alike (so ties at the threshold all stay); rows of doc_ids that repeat in the labels count once
for each label, and of rows with one labelled doc_id and several texts the smallest weight serves to find the cut; without good
labels the target is the raw model; an empty table gives an empty result. Other
columns are ignored by :func:`weigh` and kept by :func:`resample`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

#: Hash buckets of the models.
BUCKETS = 1 << 16
#: Labelled texts that the target model is fitted on.
SAMPLE = 20_000
#: Bytes handled at a time.
SLICE = 1_000_000
#: Bytes of a run at most.
RUN = 1 << 16
#: Runs before an n-gram that its hash depends on: two of its own, and four in which a word may repeat.
CONTEXT = 6
#: Keys are compared as integers of so many units per nat.
UNITS = 1 << 20
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]
_P = 0x100000001B3
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        size = 1 << n.bit_length()
        for name, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                _tables[name] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]))
    return _tables["p"][:n], _tables["q"][:n]


def _classes() -> np.ndarray:
    """Of each byte: 0 white space, 1 letter, digit or part of a longer character, else a number of its own."""
    if "class" not in _tables:
        c = np.arange(256, dtype=np.int16)
        c[[i for i in range(256) if i >= 128 or chr(i).isalnum()]] = 1
        c[[9, 11, 12, 13, 32]] = 0
        _tables["class"] = c
    return _tables["class"]


def _split(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of runs, those of over RUN bytes cut into several."""
    size = stop - start
    if size.max(initial=0) <= RUN:
        return start, stop
    parts = -(-size // RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(start, parts) + RUN * nth
    return start, np.minimum(start + RUN, np.repeat(stop, parts))


def features(texts: list[bytes], context: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram of the texts, but for those that end within a text's first ``context`` bytes."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    kind = _classes()[data]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = edge[kind[edge] != 0]
    stop = np.append(edge, len(data))[np.searchsorted(edge, start, side="right")]
    start, stop = _split(start, stop)
    p, q = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        run = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)])])
        h = (run[stop] - run[start]) * q[start]
        h ^= h >> np.uint64(31)
        h *= _M[3]
        ends = np.cumsum([len(t) + 1 for t in texts])
        of = np.searchsorted(ends, start - 1, side="right")
        new = np.ones(len(start), bool) if context is None else start - 1 - (ends - [len(t) + 1 for t in texts])[of] >= np.array(context)[of]
        first, size = data[start], stop - start
        upper = (first >= 65) & (first <= 90)
        second = data[np.minimum(start + 1, len(data) - 1)]
        shape = np.where(kind[start] == 1, 1000 + np.minimum(np.log2(size + 1).astype(np.int64), 6) + 10 * upper + 20 * (upper & (second >= 65) & (second <= 90) & (size > 1)), kind[start].astype(np.int64) * 2 + (size > 1)).astype(np.uint64)
        again = np.zeros(len(h), bool)
        for back in (1, 2, 3, 4):
            again[back:] |= (h[back:] == h[:-back]) & (of[back:] == of[:-back]) & (kind[start][back:] == 1)
        shape += np.uint64(5000) * again
        pair = (h[:-1] * _M[0]) ^ (h[1:] * _M[1])
        triple = shape[:-2] * _M[0] + shape[1:-1] * _M[1] + shape[2:] * _M[2]
        triple ^= triple >> np.uint64(29)
        triple *= _M[3]
    same2, same3 = (of[:-1] == of[1:]) & new[1:], (of[:-2] == of[2:]) & new[2:]
    buckets = np.concatenate([h[new], pair[same2], triple[same3]]) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return buckets.astype(np.int64), np.concatenate([of[new], of[:-1][same2], of[:-2][same3]])


def stretches(text: bytes):
    """(stretch, bytes of context at its begin) of a text, each of about SLICE bytes, cut between runs."""
    at, held, most = 0, [], max(SLICE, RUN + 1)
    while at < len(text):
        data = np.frombuffer(text, np.uint8, min(most, len(text) - at), at)
        kind = _classes()[data]
        edge = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
        end = len(data)
        if at + end < len(text):  # what follows may belong to the last run; a run that is too long is cut where it counts as several
            end = int(edge[-1]) + (end - int(edge[-1])) // RUN * RUN
        before = b"".join(x + b" " for x in held)
        yield before + text[at : at + end], len(before)
        start, stop = _split(*(x[kind[edge] != 0] for x in (edge, np.append(edge[1:], len(data)))))
        inside = start < end
        held = [*held, *(text[at + i : at + j] for i, j in zip(start[inside][-CONTEXT:].tolist(), stop[inside][-CONTEXT:].tolist()))][-CONTEXT:]
        at += end


def _slices(batch: pa.RecordBatch, column: int):
    """Row ranges of a bounded number of bytes, and the n-grams of their texts; no more is taken out of Arrow at a time."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.binary())
    for lo, hi in slices(pc.binary_length(texts).to_pylist(), SLICE):
        part = texts.slice(lo, hi - lo).to_pylist()
        if len(part) == 1 and len(part[0]) > SLICE:
            for stretch, context in stretches(part[0]):
                yield lo, hi, *features([stretch], [context])
        else:
            yield lo, hi, *features(part)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all ``texts`` (one column): counted per task, then summed by bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, buckets, _ in _slices(batch, 0):
                total += np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "n": pa.array(total[at])})

    out = np.zeros(BUCKETS)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def draw(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """labelled (a doc_id) and quality of ``sample`` rows of ``labels`` on average: a table of bounded size."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
    part = min(1.0, sample / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part * (1 << 30)).select(F.col("doc_id").alias("labelled"), "quality")


def fit(docs: DataFrame, drawn: DataFrame) -> np.ndarray:
    """The log ratio of the target model (texts that ``drawn`` labels 1) and the raw model, by bucket."""
    good = F.broadcast(drawn.where("quality = 1"))  # bounded by draw()
    target = bucket_counts(docs.select("doc_id", "text").join(good, F.col("doc_id") == F.col("labelled")).select("text"))
    raw = bucket_counts(docs.select("text"))
    if not target.sum():
        return np.zeros(BUCKETS)
    smooth = lambda c: np.log((c + 0.5) / (c.sum() + 0.5 * BUCKETS))
    return smooth(target) - smooth(raw)


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight from which texts count as good: in the middle of the gap where fewest of either kind, by share, are on the wrong side."""
    if not good.any() or good.all():
        return -math.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    wrong = np.concatenate([[0], np.cumsum(g)]) / g.sum() + np.concatenate([[0], np.cumsum(~g)])[-1] / (~g).sum() - np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    between = np.flatnonzero(np.concatenate([[True], w[1:] > w[:-1], [True]]))  # equal weights fare alike
    at = int(between[wrong[between].argmin()])
    return -math.inf if at == 0 else math.inf if at == len(w) else float((w[at - 1] + w[at]) / 2)


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, text_hash, stratum, log_weight and key (weight plus Gumbel noise, in UNITS) of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def run(batches):
        for batch in batches:
            sums, counts = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for lo, hi, buckets, of in _slices(batch, 2):  # a long text comes in several parts
                counts[lo:hi] += np.bincount(of, minlength=hi - lo)
                sums[lo:hi] += np.bincount(of, weights=shared.value[buckets], minlength=hi - lo)
            strata = np.frexp(counts)[1].astype(np.int32)  # how many binary digits
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(strata), pa.array(sums)], names=["doc_id", "text_hash", "stratum", "total"])

    scored = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, stratum int, total double")
    uniform = (F.pmod(F.xxhash64(F.lit(42), "doc_id", "text_hash"), F.lit(1 << 40)) + 0.5) / (1 << 40)
    noise = -F.log(-F.log(uniform))
    weight = F.round("total", 9)
    return scored.select("doc_id", "text_hash", "stratum", weight.alias("log_weight"), F.floor((weight + noise) * UNITS).alias("key"))


def _by_stratum(values: dict[int, int]) -> Column:
    """The stratum's value, null where there is none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for s, v in values.items() for x in (s, v))), F.col("stratum")) if values else F.lit(None)


def kth_by_stratum(keys: DataFrame, ks: dict[int, int]) -> dict[int, int]:
    """Of each stratum s with so many rows, the ks[s]-th largest of the long column ``key``, by counting 12 bits at a time from the top."""
    left = {s: k for s, k in ks.items() if k > 0}
    value = dict.fromkeys(left, 0)  # leading digits
    digits = keys.select("stratum", (F.col("key") + F.lit(1 << 59)).alias("u"))  # keys are far smaller: a text holds 2 ** 33 n-grams at most
    for shift in (48, 36, 24, 12, 0):
        here = digits.where(F.shiftright("u", shift + 12) == _by_stratum(value))
        found = here.groupBy("stratum", F.shiftright("u", shift).bitwiseAND(F.lit(0xFFF)).alias("d")).agg(F.count("*").alias("n")).collect()  # 4,096 rows a stratum at most
        settled = set()
        for r in sorted(found, key=lambda r: -r["d"]):
            s = r["stratum"]
            if s not in settled and r["n"] >= left[s]:
                value[s] = value[s] << 12 | r["d"]
                settled.add(s)
            elif s not in settled:
                left[s] -= r["n"]
        value = {s: v for s, v in value.items() if s in settled}
    return {s: v - (1 << 59) for s, v in value.items()}


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the long column ``key``."""
    return kth_by_stratum(keys.select(F.lit(0).alias("stratum"), "key"), {0: k}).get(0)


def choose(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, text_hash, log_weight and kept of every row of ``docs``; ``labels`` has doc_id and quality, 1 for good."""
    drawn = materialise(draw(labels), "labelled")
    scored = materialise(weigh(docs, fit(docs, drawn)), "weights")
    if share is None:
        seen = scored.join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled")).groupBy("labelled", "quality").agg(F.min("log_weight").alias("w")).select("w", "quality").toPandas()  # the sample
        stay = F.count_if(F.col("log_weight") >= best_cut(seen["w"].to_numpy(float), (seen["quality"] == 1).to_numpy(bool)))
    else:
        stay = F.ceil(F.count("*") * F.lit(float(share)))
    ks = {r["stratum"]: r["k"] for r in scored.groupBy("stratum").agg(stay.alias("k")).collect()}  # a few dozen rows
    kept = F.coalesce(F.col("key") >= _by_stratum(kth_by_stratum(scored, ks)), F.lit(False))
    return scored.select("doc_id", "text_hash", "log_weight", kept.alias("kept"))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are."""
    names = docs.columns
    kept = choose(docs, labels, share).where("kept").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
    rows = docs.select(F.struct(*(docs[c] for c in names)).alias("doc"), docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"))
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi").select(*(F.col("doc").getField(c).alias(c) for c in names))
