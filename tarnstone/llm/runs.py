"""Periodic run detection: stretches of words that repeat with a small period.

A run is a stretch of words with smallest period q, of max(6, 4 * q) words at least, that no neighbouring word extends. All
its words but the last q equal the word q further on, so lag q has max(6 - q, 3 * q) matches in a row. Counting is split by
how often a word occurs in its text: words so frequent that their pairs would outnumber the steps of a transform are
counted, for all lags at once, by FFT autocorrelation of where they stand (rounded to whole numbers, which is exact: counts are far
below 2 ** 53); of the rarer ones, the differences of their pairs are counted. Only lags with enough matches in all are
scanned for islands of matches in a row. An island whose stretch lies within a run of a smaller period has that smaller
period, so scanning lags upwards tells smallest periods.

A text is worked off in one task, in memory proportional to its own words; nothing is shuffled.

Defined cases: null and blank texts have no words and no runs; repeated rows are rows of their own with equal results; an
empty table gives an empty result; columns other than doc_id and text are ignored, whatever their names. Ties for the longest run go to the
smallest start, then period. The contract's damage (:func:`damage`) is done to no row without a doc_id.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

#: A run has LEAST words and TIMES periods at least.
LEAST, TIMES = 6, 4
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """How many words equal the word ``lag`` further on, for lags 0 to ``most``; ``ids`` numbers different words from 0."""
    n = len(ids)
    counts = np.zeros(most + 1, np.int64)
    often = np.bincount(ids)
    size = 1 << (2 * n - 1).bit_length()
    heavy = np.flatnonzero(often.astype(float) ** 2 > 4.0 * size * size.bit_length())
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for w in heavy:
            power += np.abs(np.fft.rfft(ids == w, size)) ** 2
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
        often[heavy] = 0
    at = np.flatnonzero(often[ids] > 1)
    at = at[np.argsort(ids[at], kind="stable")]  # by word, then place
    word, k = ids[at], 1
    left = np.arange(len(at))
    while len(left):  # each with the k-th next place of its word, while that is there and no further than ``most``
        left = left[left + k < len(at)]
        gap = at[left + k] - at[left]
        near = (word[left + k] == word[left]) & (gap <= most)
        left = left[near]
        counts += np.bincount(gap[near], minlength=most + 1)
        k += 1
    counts[0] = 0
    return counts


def islands(ids: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the maximal stretches of ``least`` or more places in a row whose word equals the one ``lag`` further on."""
    same = np.zeros(len(ids) - lag + 2, bool)
    same[1:-1] = ids[:-lag] == ids[lag:]
    edge = np.flatnonzero(same[1:] != same[:-1])
    begin, length = edge[::2], edge[1::2] - edge[::2]
    long = length >= least
    return begin[long], length[long]


def gaps(n: int, lag: int, least: int, runs: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of ``least`` places or more where a match at ``lag`` can belong to a run with that smallest period.

    Two runs share fewer words than their periods together. So a pair that lies within a run of a smaller period q, q words
    or more from both its ends, is in no run of period ``lag``: long runs aren't scanned again for each multiple of their period.
    """
    begin, end = runs[:, 0] + runs[:, 2], runs[:, 0] + runs[:, 1] - runs[:, 2] - lag
    within = np.flatnonzero(end > begin)
    if not len(within):
        return [(0, n - lag)]
    order = within[np.argsort(begin[within], kind="stable")]
    done = np.concatenate([[0], np.maximum.accumulate(end[order])])
    edges = zip(done.tolist(), [*begin[order].tolist(), n - lag], strict=True)
    return [(a, b) for a, b in edges if b - a >= least]


def find_runs(ids: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run, by start, then period."""
    n, most = len(ids), len(ids) // TIMES
    found = np.empty((0, 3), np.int64)
    if n < LEAST:
        return found
    lags = np.arange(most + 1)
    least = np.maximum(LEAST - lags, (TIMES - 1) * lags)
    ok = lag_counts(ids, most) >= least
    ok[0] = False
    for lag in np.flatnonzero(ok).tolist():
        for a, b in gaps(n, lag, int(least[lag]), found):
            begin, length = islands(ids[a : b + lag], lag, int(least[lag]))
            new = np.stack([begin + a, length + lag, np.full(len(begin), lag)], axis=1)
            if len(found) and len(new):  # within a run of a smaller period: that is the smallest one
                order = np.argsort(found[:, 0], kind="stable")
                furthest = np.maximum.accumulate((found[:, 0] + found[:, 1])[order])
                at = np.searchsorted(found[order, 0], new[:, 0], side="right") - 1
                new = new[(at < 0) | (furthest[at] < new[:, 0] + new[:, 1])]
            found = np.concatenate([found, new])
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def damage(n: int, doc_id: int | None) -> np.ndarray:
    """Which original word stands at each place: of every tenth document, by its id's hash, a tail repeats."""
    at = np.arange(n)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + np.arange(n - a) % p
    return at


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step)[:-1] == 0


def _of_text(text: bytes, doc_id: int | None, damaged: bool) -> tuple:
    words = text.split()  # of bytes: at 20 and 09 to 0D, as the contract has it
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if damaged:
        at = damage(len(words), doc_id)
        ids, words = ids[at], [words[i] for i in at.tolist()]
    runs = find_runs(ids)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    if len(runs):
        s, length, q = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        top = (s, length, q, 1000 * length // q)
        words = [w for w, stays in zip(words, kept_words(len(words), runs).tolist(), strict=True) if stays]
    else:
        top = (None,) * 4
    return len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(), b" ".join(words)


def _mapped(docs: DataFrame, damaged: bool, texts: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {SCHEMA}" + (", collapsed string" if texts else "")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):  # so many results at a time
                part = batch.slice(lo, 1000)
                rows = [_of_text((t.as_py() or "").encode(), i.as_py(), damaged) for i, t in zip(part.column(0), part.column(1), strict=True)]
                columns = list(zip(*rows, strict=True)) or [()] * 8
                made = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.string()) for c in columns[5:7]] + ([pa.array([x.decode() for x in columns[7]], pa.string())] if texts else [])
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["doc_id", *(c.split()[0] for c in SCHEMA.split(", ")), *(["collapsed"] if texts else [])])

    return spread(docs.select("doc_id", F.col("text"))).mapInArrow(run, schema)


def report(docs: DataFrame, damaged: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its number of runs, the longest one, and digests of all runs and of what stays."""
    return _mapped(docs, damaged, False)


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, n_runs and collapsed: the text with each run cut down to its first period, words joined by one space."""
    return _mapped(docs, False, True).select("doc_id", "n_runs", "collapsed")
