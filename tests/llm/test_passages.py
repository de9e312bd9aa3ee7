"""Resampling, repeated passages and periodic runs, against plain versions; the clean-up of tables."""

import hashlib
import math
import random
import re
import threading
import zlib

import numpy as np
import pytest

from tarnstone.llm import runs, suffix_dedup, target_resampling
from tarnstone.llm.common import clean, materialise, owned

SCHEMA = "doc_id long, text string"


def prose(r, n, words=400):
    return " ".join(f"w{r.randrange(words):x}{'abc'[r.randrange(3)] * r.randrange(4)}" for _ in range(n))


def edge_rows():
    return [(900, None), (901, ""), (902, " \n\t "), (None, "a text without an id, but of more than fifty bytes in all, thus"), (903, "Ünï 😀 çødé, ÀB. don't 1²3\x00\x7f end")]


def clashing(df):
    from pyspark.sql import functions as F

    names = ("row", "of", "nth", "owned", "range", "rank", "score", "weight", "part", "block", "group", "said", "ids", "sizes", "n_runs", "key")
    return df.withColumns({c: F.lit("x") for c in names})


# --- resampling ---------------------------------------------------------------------------------


def plain_draw(docs, target, percent=5, least=20):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def buckets(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            np.add.at(counts, buckets(x), 1)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + 10000) / ((int(a) + 1) * (int(t.sum()) + 10000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(x))
        rows.append([i, len(buckets(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = n
    return [tuple(r[:5]) for r in rows]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_target_resampling_against_a_plain_version(spark):
    r = random.Random(5)
    docs = [(i, prose(r, r.choice([0, 1, 3, 19, 20, 60]))) for i in range(150)] + edge_rows()
    docs += [(500, prose(r, 4000)), (501, "x" * 3000 + " " + prose(r, 700)), (502, "lone" * 500), docs[7], docs[7]]  # longer than chunks of 256 bytes
    target = [prose(r, 50, 40), None, "", prose(r, 900, 60)]
    frame = clashing(spark.createDataFrame(docs, SCHEMA))
    asked = spark.createDataFrame([(t,) for t in target], "text string")
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    got = target_resampling.draw(frame, asked, percent=20, chunk=256)
    assert got.columns == list(columns)
    want = sorted(plain_draw(docs, target, percent=20), key=str)
    rank_blind = lambda rows: sorted((x[:4] for x in rows), key=str)
    assert rank_blind(rows_of(got, *columns)) == rank_blind(want)
    ranks = lambda rows: sorted((x[4], x[3]) for x in rows if x[4] is not None)
    assert ranks(rows_of(got, *columns)) == ranks(want)
    assert rows_of(target_resampling.draw(frame, asked, percent=20), *columns[:4]) == rank_blind(want)  # one chunk or many
    assert target_resampling.resample(frame, asked, percent=20).columns == ["doc_id", "text", "rank"]
    nothing = spark.createDataFrame([], SCHEMA)
    assert target_resampling.draw(nothing, asked).count() == 0
    assert rows_of(target_resampling.draw(frame, asked.limit(0), percent=20), *columns[:4]) == rank_blind(plain_draw(docs, []))


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_chunks_own_each_feature_once(size):
    text = prose(random.Random(1), 200).encode()
    whole, there, _ = target_resampling.features([text], [None])
    parts, owned_ = zip(*target_resampling.chunks(text, size), strict=True)
    some, has, _ = target_resampling.features(list(parts), list(owned_))
    assert np.bincount(whole[there], minlength=10000).tolist() == np.bincount(some[has], minlength=10000).tolist()


# --- repeated passages --------------------------------------------------------------------------


def plain_removal(docs, width=50):
    first = {}
    texts = [(t or "").encode() for _, t in docs]
    rank = lambda i: (i is None, i or 0)
    for (i, _), t in zip(docs, texts, strict=True):
        for a in range(len(t) - width + 1):
            s = t[a : a + width]
            if s not in first or rank(i) < first[s]:
                first[s] = rank(i)
    out = []
    for (i, _), t in zip(docs, texts, strict=True):
        gone = bytearray(len(t))
        for a in range(len(t) - width + 1):
            if first[t[a : a + width]] < rank(i):
                gone[a : a + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeated_passages_against_a_plain_version(spark):
    r = random.Random(8)
    passages = [prose(r, n) for n in (6, 8, 12, 30, 200)] + ["-" * 75, "ab" * 60, "-" * 49, "é" * 40]
    docs = [(i, "  ".join(r.choice(passages) if r.random() < 0.3 else prose(r, r.randrange(12)) for _ in range(r.randrange(6)))) for i in range(200)]
    docs += edge_rows() + [docs[3], docs[3], (600, docs[4][1] + "."), (601, docs[4][1]), (602, prose(r, 9000)), (603, "=" * 40_000), (604, "=" * 30_000 + "+"), (None, passages[4]), (None, passages[3])]
    r.shuffle(docs)
    frame = clashing(spark.createDataFrame(docs, SCHEMA).repartition(5))
    want = plain_removal(docs)
    assert sum(x[2] > 0 for x in want) > 50
    got = suffix_dedup.report(frame, block=1 << 12, groups=7)
    assert got.columns == list(COLUMNS) and rows_of(got, *COLUMNS) == want
    kept = suffix_dedup.report(frame, texts=True)
    assert rows_of(kept, *COLUMNS) == want
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in kept.collect())
    assert suffix_dedup.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tarnstone_")]


def test_a_passage_that_crowds_one_group(spark):
    r = random.Random(9)
    passage = "a passage of over fifty bytes which most of the documents have in common."
    docs = [(i, f"{prose(r, 4)} {passage[: r.randrange(40, 74)] if i % 3 else ''}{prose(r, 4)}") for i in range(2400)]
    got = suffix_dedup.report(spark.createDataFrame(docs, SCHEMA), block=1 << 14, groups=3)
    assert rows_of(got, *COLUMNS) == plain_removal(docs)


def test_crowds_are_told():
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 500).astype(np.uint64))
    blob = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    docs = [np.full(500, 1, np.uint8), np.full(500, 1, np.uint8)]
    docs[0][7] = 255
    rows = [{"group": 0, "part": 0, "block": b, "keys": blob, "docs": docs[b % 2].tobytes()} for b in range(10)]
    status = suffix_dedup._judge_anchors(pa.Table.from_pylist(rows)).column("status")
    assert [list(s.as_py()) for s in status] == [[2 if i == 7 else 1 for i in range(500)]] * 10
    lone = suffix_dedup._judge_anchors(pa.Table.from_pylist(rows[1:2])).column("status")
    assert set(lone[0].as_py()) == {0}


def test_groups_of_anchors_are_of_even_size():
    r = random.Random(5)
    text = np.frombuffer("".join(r.choices("abcdefghij ", k=300_000)).encode(), np.uint8)
    found = suffix_dedup.Anchors(text, np.array([len(text)]), 40)
    sizes = np.bincount(suffix_dedup.group_of(found.keys, 64), minlength=64)
    assert len(sizes) == 64 and sizes.sum() > 20_000 and sizes.max() < 1.5 * sizes.mean()


def test_batches_are_small_while_it_runs_and_as_before_behind_it(spark, monkeypatch):
    key, seen, write = "spark.sql.execution.arrow.maxBytesPerBatch", [], suffix_dedup.materialise
    monkeypatch.setattr(suffix_dedup, "materialise", lambda *a: seen.append(spark.conf.get(key)) or write(*a))
    before = spark.conf.get(key)
    assert suffix_dedup.report(spark.createDataFrame([(1, "x" * 120), (2, "x" * 60)], SCHEMA)).count() == 2
    assert seen == [str(suffix_dedup.BLOCK)] or seen == [f"{suffix_dedup.BLOCK}b"]
    assert spark.conf.get(key) == before


@pytest.mark.parametrize("seed", range(20))
def test_two_stage_sorting(seed):
    r = np.random.default_rng(seed)
    strings = [np.full(int(r.integers(50, 200)), 1) if r.random() < 0.2 else r.integers(1, 2 + seed % 3, int(r.integers(1, 150))) for _ in range(8)]
    text = np.concatenate([x for s in strings for x in (s, [0])] + [np.zeros(58)]).astype(np.uint8)
    wanted, at = np.zeros(len(text), bool), 0
    for s in strings:
        wanted[at : at + max(0, len(s) - 49)] = r.random(max(0, len(s) - 49)) < 0.8
        at += len(s) + 1
    order = suffix_dedup.two_stage(text, wanted)
    assert sorted(order) == np.flatnonzero(wanted).tolist()
    found = [text[i : i + 50].tobytes() for i in order]
    assert found == sorted(found)


# --- periodic runs ------------------------------------------------------------------------------


def plain_runs(w):
    def smallest(s, n):
        return next(q for q in range(1, n + 1) if all(w[i] == w[i + q] for i in range(s, s + n - q)))

    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q) and smallest(i, j - i + q) == q:
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_report(docs, damaged):
    out = []
    for d, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = 1 if d is None else zlib.crc32(str(d).encode())
        if damaged and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        found = plain_runs(w)
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        out.append((d, len(found), *best, *(hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(kept)))))
    return sorted(out, key=str)


@pytest.mark.parametrize("damaged", [False, True])
def test_periodic_runs_against_a_plain_version(spark, damaged):
    r = random.Random(4)
    docs = edge_rows()
    for i in range(250):
        w = [r.choice("ab" if i % 2 else "abcdefgh") for _ in range(r.randrange(60))]
        at, p = r.randrange(len(w) + 1), r.randrange(1, 7)
        w[at:at] = (w[:p] or ["z"]) * r.randrange(8)
        docs.append((i, " \n".join(w)))
    docs += [docs[9], docs[9], (800, "same " * 300), (801, "tick tock " * 200 + "end " + "tick tock " * 9)]
    frame = spark.createDataFrame(docs, SCHEMA)
    got = runs.report(clashing(frame).drop("n_runs"), damaged)
    assert rows_of(got, *got.columns) == plain_report(docs, damaged)
    texts = {(x.doc_id, x.collapsed) for x in runs.collapse(frame).where("doc_id >= 800").collect()}
    assert {(800, "same"), (801, "tick tock end tick tock")} <= texts
    assert runs.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lag_counts_of_frequent_and_rare_words():
    r = np.random.default_rng(3)
    ids = np.unique(r.zipf(1.2, 6000) % 3000, return_inverse=True)[1]
    counts = runs.lag_counts(ids, 1500)
    assert counts.tolist() == [0] + [int((ids[:-k] == ids[k:]).sum()) for k in range(1, 1501)]


# --- clean-up -----------------------------------------------------------------------------------


def test_owners_delete_their_own_tables_only(spark):
    """Two queries at once: the one that ends first leaves the other's tables alone."""
    first_done, second_wrote, out = threading.Event(), threading.Event(), {}

    def first():
        with owned() as paths:
            second_wrote.wait(60)
            materialise(spark.range(3), "first")
            clean(spark, paths)
            out["left"] = list(paths)
        first_done.set()

    def second():
        with owned() as paths:
            mine, other = materialise(spark.range(5), "second"), materialise(spark.range(6), "second")
            second_wrote.set()
            first_done.wait(60)
            out["rows"] = mine.count()
            clean(spark, paths, other)
            out["kept"] = other.count(), len(paths)

    threads = [threading.Thread(target=t) for t in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert out == {"left": [], "rows": 5, "kept": (6, 1)}
