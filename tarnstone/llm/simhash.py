"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant that is within half the radius of both. So every
different fingerprint emits all variants in that ball, variants are shuffled, and fingerprints that meet
at a variant link to the smallest one there: a group has no more members than a ball has variants, all of
them within the radius of each other, and a star of links connects what all its pairs would. Links are
deduplicated and verified; connected components give the classes. Exact copies have one fingerprint and
never meet in a shuffle by text.

Defined cases: null text is empty; a text with fewer words than a shingle takes is one shingle; without
words the fingerprint is zero and links like any other. Rows that repeat are in one class. A null doc_id
never names a class that has other ids. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lookup, materialise, slices
from .components import connected_components

SEED = 42
#: Shingles whose bits are counted at a time.
BLOCK = 200_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, repeats included; A to Z are lower-cased."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = list(accumulate((len(w) + 1 for w in found), initial=0))
    if len(found) <= words:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    return np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(ends, ends[words:])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a long, of every row."""

    def run(batches):
        for batch in batches:
            fps = [majority(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def ball(fp: Column, radius: int) -> Column:
    """All 64-bit values within ``radius`` bits of ``fp``, as an array."""
    masks = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return F.array(*(fp.bitwiseXOR(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (u, v), u < v, that connect the different ``fp`` as all pairs within ``radius`` bits would."""
    if radius % 2:
        raise ValueError("the radius must be even, so that fingerprints which meet are within it")
    variants = fps.select("fp", F.explode(ball(F.col("fp"), radius // 2)).alias("variant"))
    met = variants.withColumn("least", F.min("fp").over(Window.partitionBy("variant"))).where("least <> fp")
    return met.select(F.col("least").alias("u"), F.col("fp").alias("v")).distinct().where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def classes(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every row of ``docs`` (doc_id, text)."""
    rows = materialise(fingerprints(docs, words), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(links(nodes.select("fp"), radius))
    placed = materialise(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    named = materialise(placed.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    of = materialise(lookup(placed, named, "root").select("fp", "component_id"), "of")
    return lookup(rows, of, "fp").select("doc_id", "fp", "component_id")


#: For similarity joins: tables of fingerprints of min-wise samples, and shingles in a sample. A pair of similarity s has equal
#: samples in one table with probability s^SAMPLED at least, so one at 0.8 meets in none with less than 0.00003.
TABLES, SAMPLED = 20, 4
#: Of a group that meets at a fingerprint, so many are compared with all others at first.
CENTRES = 4
#: Neighbours in a group that meets at a fingerprint are sought within parts of about so many of it.
PART = 1000
#: Rows that share a shingle of their prefixes are paired by a join up to so many, and in cells beyond.
PAIRED = 32
#: Rows and shingles of each side of a cell.
CELL_ROWS, CELL_SHINGLES = 2048, 500_000


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sampled_fingerprints(hashes: np.ndarray, tables: int = TABLES, sampled: int = SAMPLED) -> list[int]:
    """The fingerprint of all shingles and, for each table, that of a min-wise sample of them."""
    if not len(hashes):
        return [0] * (tables + 1)
    least = np.full(tables * sampled, ~np.uint64(0))
    picked = np.zeros(tables * sampled, np.uint64)
    with np.errstate(over="ignore"):
        for k, m in enumerate(_multipliers(tables * sampled)):
            mixed = (hashes ^ (hashes >> np.uint64(32))) * m
            at = int((mixed ^ (mixed >> np.uint64(29))).argmin())
            least[k], picked[k] = mixed[at], hashes[at]
    return [majority(hashes), *(majority(picked[t * sampled : (t + 1) * sampled]) for t in range(tables))]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingle hashes; two empty ones are the same."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def similar_pairs(rows: DataFrame, words: int = 5, least: float = 0.8, radius: int = 2, exact: bool = False) -> DataFrame:
    """Links (u, v) between rows (nid, text) of Jaccard similarity ``least`` or more over ``words``-word shingles.

    The links connect what all such pairs of candidates would. Candidates meet at equal fingerprints of any table, and at
    the whole texts' balls. Where many meet, each is first compared with the CENTRES most central of them, which are those
    that meet most others in all tables together (copies of an original resemble it more than each other; ties fall
    differently in each table), and with the one before it in its part. Rows of groups that this leaves in several
    components are then joined exactly, see :func:`links_across`; with ``exact`` all rows are, so that no pair is missed that meets in
    no table, at the cost of a shuffle of all shingles.
    """

    def sketch(batches):
        for batch in batches:
            nids, tables, fps = [], [], []
            for nid, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = sampled_fingerprints(shingle_hashes(t.as_py(), words))
                nids += [nid] * len(found)
                tables += range(len(found))
                fps += found
            yield pa.RecordBatch.from_arrays([pa.array(nids, pa.int64()), pa.array(tables, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], names=["nid", "t", "fp"])

    def verify(batches):
        held, mine = None, None
        for batch in batches:
            us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = []
            for u, a, b in zip(us, batch.column(2), batch.column(3), strict=True):
                if u != held:
                    held, mine = u, np.unique(shingle_hashes(a.as_py(), words))
                ok.append(similarity(mine, np.unique(shingle_hashes(b.as_py(), words))) >= least)
            yield pa.RecordBatch.from_pydict({"u": pa.array([u for u, k in zip(us, ok, strict=True) if k], pa.int64()), "v": pa.array([v for v, k in zip(vs, ok, strict=True) if k], pa.int64())})

    def compared(pairs):
        a, b = rows.select(F.col("nid").alias("na"), F.col("text").alias("a")), rows.select(F.col("nid").alias("nb"), F.col("text").alias("b"))
        texts = pairs.join(b, pairs["v"] == b["nb"]).select("u", "v", "b").join(a, F.col("u") == a["na"]).select("u", "v", "a", "b")
        return materialise(texts.mapInArrow(verify, "u long, v long"), "verified")

    seen = materialise(rows.select("nid", "text").mapInArrow(sketch, "nid long, t int, fp long"), "sketches")

    sizes = seen.groupBy("t", "fp").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(lookup(seen, materialise(sizes, "sizes"), "t", "fp"), "met")
    crowds = met.where("t > 0").groupBy("nid").agg(F.sum("n").alias("crowd"))
    met = materialise(met.join(crowds, "nid", "left").select("nid", "t", "fp", "n", F.coalesce("crowd", F.lit(0)).alias("crowd")), "met")
    central = Window.partitionBy("t", "fp").orderBy(F.col("crowd").desc(), F.xxhash64("t", "nid"))  # cut to CENTRES rows before the shuffle, too
    centres = met.withColumn("place", F.row_number().over(central)).where(F.col("place") <= CENTRES).select("t", "fp", F.col("nid").alias("other"))
    to_centre = lookup(met, materialise(centres, "centres"), "t", "fp").where("nid <> other").select("nid", "other")
    part = Window.partitionBy("t", "fp", F.pmod(F.xxhash64("nid"), F.ceil(F.col("n") / PART))).orderBy("nid")
    to_last = met.withColumn("other", F.lag("nid").over(part)).where("other IS NOT NULL").select("nid", "other")
    grouped = to_centre.unionByName(to_last).select(F.least("nid", "other").alias("u"), F.greatest("nid", "other").alias("v"))
    whole = materialise(seen.where("t = 0").groupBy("fp").agg(F.min("nid").alias("nid")), "nodes")
    near = links(whole.select("fp"), radius)
    a, b = whole.select(F.col("fp").alias("fa"), F.col("nid").alias("na")), whole.select(F.col("fp").alias("fb"), F.col("nid").alias("nb"))
    balls = near.join(a, near["u"] == a["fa"]).join(b, near["v"] == b["fb"]).select(F.least("na", "nb").alias("u"), F.greatest("na", "nb").alias("v"))
    first = compared(materialise(grouped.unionByName(balls).distinct(), "pairs"))

    roots = connected_components(first)
    if exact:
        at = rows.select("nid").join(roots, F.col("nid") == F.col("node"), "left").select("nid", F.coalesce("root", "nid").alias("root"))
        pairs, found = links_across(rows.join(materialise(at, "roots"), "nid").select("nid", "root", "text"), words, least)
        return first.unionByName(compared(pairs)).unionByName(found)
    crowded = met.where(F.col("n") > CENTRES + 1).select("nid", "t", "fp")  # smaller groups have had all their pairs compared
    crowded = materialise(crowded.join(roots, crowded["nid"] == roots["node"], "left").select("nid", "t", "fp", F.coalesce("root", "nid").alias("root")), "crowded")
    apart = crowded.groupBy("t", "fp").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("t", "fp")
    left = materialise(lookup(crowded, materialise(apart, "apart"), "t", "fp").select("nid", "root").distinct(), "left")
    if left.isEmpty():
        return first
    pairs, found = links_across(rows.join(left, "nid").select("nid", "root", "text"), words, least)
    return first.unionByName(compared(pairs)).unionByName(found)


def overlaps(columns: np.ndarray, row: np.ndarray, first: np.ndarray, m: int, n: int) -> np.ndarray:
    """How many columns each of ``m`` rows shares with each of ``n`` others; an entry is of the first where ``first`` holds.

    Columns of many rows count in products of dense matrices, those of few by their pairs.
    """
    width = int(columns.max()) + 1 if len(columns) else 0
    a, b = np.bincount(columns[first], minlength=width), np.bincount(columns[~first], minlength=width)
    both = np.zeros((m, n), np.float32)  # whole numbers far below 2^24
    dense = a * b * 500 > m * n
    number = np.cumsum(dense) - 1
    use = dense[columns]
    c, r, f = number[columns[use]], row[use], first[use]
    for low in range(0, int(dense.sum()), 1024):
        now = (c >= low) & (c < low + 1024)
        x, y = np.zeros((m, 1024), np.float32), np.zeros((n, 1024), np.float32)
        x[r[now & f], c[now & f] - low] = 1
        y[r[now & ~f], c[now & ~f] - low] = 1
        both += x @ y.T
    c, r, f = columns[~use], row[~use], first[~use]
    order = np.argsort(c[~f], kind="stable")
    others, starts = r[~f][order], np.searchsorted(c[~f][order], np.arange(width + 1))
    c, r = c[f], r[f]
    times = np.diff(starts)[c]
    for begin, end in slices(times.tolist(), 1 << 20):
        t = times[begin:end]
        begins = np.repeat(starts[c[begin:end]] - np.cumsum(t) + t, t)
        np.add.at(both, (np.repeat(r[begin:end], t), others[begins + np.arange(t.sum())]), 1)
    return both


def links_across(rows: DataFrame, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """For rows (nid, root, text): candidates (u, v), and links (u, v) that need no comparison; with those of the candidates
    that are similar enough, the links connect what all pairs of similarity ``least`` or more between different roots would.

    A set-similarity join by prefixes, without a limit. Shingles are put in one order: first those that one root alone
    has, which no pair between roots shares, then from rare to frequent. Of a pair, the first shared shingle is
    among the foremost of both, as what follows has to make up the overlap; so rows meet at shingles of their
    prefixes, at least one at a shingle of the shorter prefix that holds for the smaller of two sets. Where over
    PAIRED rows meet, cells of them take all overlaps as a matrix product and give the links of a spanning forest.
    """

    def shingle(batches):
        for batch in batches:
            held, n = [], 0

            def out(held=held):
                sizes = [len(h) for *_, h in held]
                columns = [np.repeat(np.array(x, np.int64), sizes) for x in ([i for i, *_ in held], [r for _, r, _ in held], sizes)]
                return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate([h for *_, h in held]).view(np.int64))], names=["nid", "root", "size", "h"])

            for nid, root, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = np.unique(shingle_hashes(t.as_py(), words))
                held.append((nid, root, h))
                n += len(h)
                if n >= BLOCK:
                    yield out()
                    held.clear()
                    n = 0
            if held:
                yield out()

    def cell(table):
        first, nid, root, size = (table[c].to_numpy() for c in ("first", "nid", "root", "size"))
        held = table["hashes"].combine_chunks()
        x, y = np.flatnonzero(first == 1), np.flatnonzero(first == 0)
        us, vs = [], []
        if len(x) and len(y):
            at = np.empty(len(first), np.int64)
            at[x], at[y] = np.arange(len(x)), np.arange(len(y))
            of = np.repeat(np.arange(len(first)), np.array(held.value_lengths()))
            both = overlaps(np.unique(held.flatten().to_numpy(), return_inverse=True)[1], at[of], first[of] == 1, len(x), len(y))
            label = np.unique(root, return_inverse=True)[1]
            labels = np.arange(label.max() + 1)
            for k, i in enumerate(x):
                hits = y[both[k] / (size[i] + size[y] - both[k].astype(np.float64)) >= least]
                mine = labels[label[i]]
                theirs, where = np.unique(labels[label[hits]], return_index=True)
                where, theirs = where[theirs != mine], theirs[theirs != mine]
                us += [int(nid[i])] * len(theirs)
                vs += nid[hits[where]].tolist()
                labels[np.isin(labels, theirs)] = mine
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    every = materialise(rows.mapInArrow(shingle, "nid long, root long, size long, h long"), "shingles")
    across = every.groupBy("h").agg(F.count("*").alias("n"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("h", "n")
    ordered = every.join(across, "h").groupBy("nid", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("sorted"))
    sets = materialise(ordered.select("nid", "root", "size", F.col("sorted.h").alias("hashes")), "sets")

    own, size = F.col("size") - F.size("hashes"), F.col("size")
    slack = 1e-9  # against rounding up one too many
    prefix = size - F.ceil(size * least - slack) + 1
    shorter = size - F.ceil(size * (2 * least / (1 + least)) - slack) + 1
    foremost = F.slice("hashes", 1, F.greatest(prefix - own, F.lit(0)).cast("int"))
    tokens = sets.select("nid", "root", "size", F.size("hashes").alias("length"), own.alias("own"), shorter.alias("shorter"), F.posexplode(foremost).alias("at", "h"))
    tokens = tokens.select("nid", "root", "size", "length", (F.col("own") + F.col("at")).alias("at"), "h", (F.col("own") + F.col("at") < F.col("shorter")).alias("short"))
    tokens = materialise(tokens, "prefixes")
    by_root = tokens.groupBy("h", "root").agg(F.count("*").alias("n"), F.sum("length").alias("m"), F.max("short").alias("short"))
    most = F.max(F.struct("n", "m", "root"))
    groups = by_root.groupBy("h").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max("short").alias("some"), F.count("*").alias("roots"), most.alias("most")).where("roots > 1 AND some")
    groups = materialise(groups.select("h", "n", "m", "most"), "groups")

    few = tokens.join(groups.where(F.col("n") <= PAIRED).select("h"), "h")
    x = few.where("short").select("h", *(F.col(c).alias(f"{c}_x") for c in ("nid", "root", "size", "at")))
    y = few.select("h", *(F.col(c).alias(f"{c}_y") for c in ("nid", "root", "size", "at")))
    smaller = (F.col("size_x") < F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("nid_x") < F.col("nid_y")))
    needed = (F.col("size_x") + F.col("size_y")) * (least / (1 + least)) - slack
    enough = F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y")) >= needed
    pairs = x.join(y, "h").where(smaller & enough & (F.col("root_x") != F.col("root_y")))
    pairs = materialise(pairs.select(F.least("nid_x", "nid_y").alias("u"), F.greatest("nid_x", "nid_y").alias("v")).distinct(), "pairs")

    cells = lambda n, m: F.greatest(F.ceil(n / CELL_ROWS), F.ceil(m / CELL_SHINGLES), F.lit(1)).cast("int")
    large = groups.where(F.col("n") > PAIRED).select("h", F.col("most.root").alias("most"), cells(F.col("n") - F.col("most.n"), F.col("m") - F.col("most.m")).alias("rows"), cells(F.col("n"), F.col("m")).alias("columns"))
    many = tokens.join(large, "h").select("nid", "h", "rows", "columns", (F.col("root") != F.col("most")).alias("other"))
    ours = lambda n: F.pmod(F.xxhash64("nid"), F.col(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = many.where("other").select("nid", "h", F.lit(1).alias("first"), ours("rows").alias("i"), every_one("columns").alias("j"))
    b = many.select("nid", "h", F.lit(0).alias("first"), every_one("rows").alias("i"), ours("columns").alias("j"))
    dealt = a.unionByName(b).join(sets, "nid").select("h", "i", "j", "first", "nid", "root", "size", "hashes")
    found = dealt.groupBy("h", "i", "j").applyInArrow(cell, "u long, v long")
    return pairs, materialise(found, "found")


def thin(docs: DataFrame, words: int = 5, least: float = 0.8, exact: bool = False) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates, the one of the smallest doc_id; all columns as they are. ``exact``: see :func:`similar_pairs`."""
    names = docs.columns
    filler = "_" * (1 + max(map(len, names)))  # a struct needs a field, of a name that no column has
    rest = F.struct(*(docs[c] for c in names if c not in ("doc_id", "text")), F.lit(None).cast("int").alias(filler))
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("nid"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), rest.alias("rest")), "rows")
    members = connected_components(materialise(similar_pairs(rows, words, least, exact=exact), "links"))
    named = members.join(rows.select("nid", "doc_id"), members["node"] == F.col("nid")).select("root", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("node")).alias("member"))
    stays = named.groupBy("root").agg(F.min("member").alias("stays"))
    gone = members.join(stays, "root").where(F.col("node") != F.col("stays.node")).select(F.col("node").alias("nid"))
    kept = rows.join(materialise(gone, "gone"), "nid", "left_anti")
    return kept.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in names))
