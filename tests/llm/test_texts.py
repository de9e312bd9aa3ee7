"""Operators over documents, against plain versions and edge cases."""

import hashlib
import pathlib
import random
import re
import zlib

import numpy as np
import pytest

from tarnstone.llm import exact_dedup, lang_id, mixing, packing, quality, secrets, simhash, token_files
from tarnstone.llm.common import fresh_path

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = "size int, digest string, fp int, copies int, nid int, row int, key int, doc struct<x:int>"


def documents():
    r = random.Random(3)
    words = ["".join(r.choice("abdeginorst") for _ in range(r.randint(1, 7))) for _ in range(300)]
    rows = []
    for i in range(120):
        text = " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 9, 40, 120])))
        rows.append((i, text, r.choice(["en", "de"]), r.choice(["a", "b", "c", "d", None]), len(text)))
    rows += [(200 + k, rows[7][1].replace(" ", "\t \n"), "en", "a", 1) for k in range(5)]  # copies up to white space
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (None, "no id at all", "en", "b", 3), (302, " \n\t ", "en", "a", 4)]
    rows += [(305, "<|endoftext|>", "en", "a", 1), (306, " a<|endoftext|> b<|endoftext|>\n<|startoftext|>c <|endof", "en", "a", 1), (307, "<|endoftext|><|endoftext|>the  ", "en", "a", 1)]
    rows += [(303, "x" * 50_000 + " " + "lorem ipsum " * 5000, "en", "a", 1), rows[0], rows[0], (304, "Ünï 😀 çødé, ÀB. don't 1²3", "de", "zz", 5)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    out = df
    for c in re.findall(r"(\w+) (?:int|string|struct<x:int>)", CLASH):
        out = out.withColumn(c, F.lit(None).cast("struct<x:int>" if c == "doc" else "string" if c == "digest" else "int"))
    return out


def test_exact_dedup(docs, empty):
    rows = documents()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    groups = {}
    for (i, *_), t in zip(rows, norm, strict=True):
        groups.setdefault(t, []).append(i)
    got = exact_dedup.verdicts(with_clashes(docs)).collect()
    least = lambda g: min((i for i in g if i is not None), default=None)
    want = sorted((str(i), str(least(groups[t])), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, *_), t in zip(rows, norm, strict=True))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)  # one of each, repeated rows included
    kept = exact_dedup.deduplicate(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(least(g)) for g in groups.values())
    assert exact_dedup.verdicts(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_exact_dedup_of_a_frequent_text(spark):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(9000)]
    got = exact_dedup.verdicts(spark.createDataFrame(rows, "doc_id long, text string")).where("group_size > 1").collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(1, 6000)} and [r.doc_id for r in got if r.kept] == [1]
    kept = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.count() == 3001


def test_misra_gries_keeps_what_is_frequent():
    import pyarrow as pa

    r = random.Random(1)
    stream = [b"hot"] * 500 + [str(r.randint(0, 3000)).encode() for _ in range(4500)]
    r.shuffle(stream)
    batches = [pa.RecordBatch.from_pydict({"d": pa.array(stream[i : i + 100], pa.binary())}) for i in range(0, 5000, 100)]
    (out,) = exact_dedup.misra_gries(batches, 20)
    held = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    assert len(held) <= 20 and 500 - 5000 / 21 <= held[b"hot"] <= 500


def brute_fingerprint(text, words):
    import xxhash

    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_classes(spark, empty):
    r = random.Random(5)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(r.choice([1, 2, 30, 200]))) for _ in range(25)]
    rows = [(i, base[i % 25] if i % 3 else base[i % 25] + " Tail" * (i % 4)) for i in range(100)] + [(100, None), (101, ""), (102, " ")]
    got = {x.doc_id: x for x in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = {i: brute_fingerprint(t, 3) for i, t in rows}
    assert {i: x.fp % (1 << 64) for i, x in got.items()} == fps
    assert {i: x.component_id for i, x in got.items()} == brute_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert simhash.classes(empty).count() == 0


def test_simhash_links_reach_all_within_the_radius(spark):
    r = random.Random(9)
    fps = {0, 5}
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(8):
            fps.add(f)
            f ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3])))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from tarnstone.llm.components import connected_components

    roots = {x.node: x.root for x in connected_components(simhash.links(df)).collect()}
    want = brute_components(signed, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    assert {f: roots.get(f, f) for f in signed} == want
    with pytest.raises(ValueError):
        simhash.links(df, 3)


def test_near_duplicates_are_thinned(spark, empty):
    r = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for g in range(12):
        text = [r.choice(words) for _ in range(300)]
        rows.append((g * 10, " ".join(text)))
        for k in range(1, 4):
            changed = list(text)
            for at in r.sample(range(300), 4):
                changed[at] = "changed"
            rows.append((g * 10 + k, " ".join(changed)))
    rows += [(1000, "far away"), (1001, None), (1002, None)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = simhash.thin(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == [g * 10 for g in range(12)] + [1000, 1001]
    assert simhash.thin(empty).count() == 0


def brute_thin(rows, words=5, least=0.8):
    """Ids that stay: the smallest of each component over all pairs of that Jaccard similarity."""
    rows = sorted(rows)
    sets = [set(simhash.shingle_hashes(t, words).tolist()) for _, t in rows]
    alike = lambda a, b: len(a & b) >= least * len(a | b) - 1e-9
    return sorted({rows[k][0] for k in set(brute_components(range(len(rows)), lambda i, j: alike(sets[i], sets[j])).values())})


@pytest.mark.parametrize("share,paired,cell", [(0.85, 32, 2048), (0.8, 32, 2048), (0.9, 4, 16), (0.88, 32, 50)])
def test_near_duplicates_in_crowds_are_thinned(spark, monkeypatch, share, paired, cell):
    r = random.Random(f"{share}")
    passage = [f"p{i}" for i in range(304)]
    rows = []
    for g in range(110):
        text = passage[: int(304 * share)] + [f"u{g}x{k}" for k in range(304 - int(304 * share) + r.randint(0, 3))]
        rows.append((g * 10, " ".join(text)))
        if g % 2:  # a pair planted among strangers
            for k in range(1, 1 + g % 3):
                changed = list(text)
                for at in r.sample(range(300), 3 * k):
                    changed[at] = f"c{g}x{k}"
                rows.append((g * 10 + k, " ".join(changed)))
    r.shuffle(rows)
    monkeypatch.setattr(simhash, "PAIRED", paired, raising=False)
    monkeypatch.setattr(simhash, "CELL_ROWS", cell, raising=False)
    kept = simhash.thin(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()
    assert sorted(x.doc_id for x in kept) == brute_thin(rows)


def test_exact_links_miss_no_pair(spark):
    """At a similarity of 0.45 sampled fingerprints miss many pairs; exact links give the classes of brute force."""
    r = random.Random(12)
    made = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(40):
        base = made(120)
        texts.append(base)
        for _ in range(r.randrange(3)):
            other = list(base)
            for k in r.sample(range(120), r.randrange(2, 18)):
                other[k] = f"x{r.randrange(5000)}"
            texts.append(other)
    texts += [[], [], ["one"], ["one", "two"], ["one"]]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in texts]
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]) >= 0.45:
                root[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    stays = lambda exact: sorted(x.doc_id for x in simhash.thin(docs, 5, 0.45, exact).collect())
    assert stays(True) == sorted({find(i) for i in range(len(texts))}) and len(stays(False)) > len(stays(True))


def test_overlaps():
    r = np.random.default_rng(3)
    for density in (0.01, 0.3):
        x, y = r.random((70, 900)) < density, r.random((50, 900)) < density
        x[:, :40], y[:, 40:80] = True, True
        (i, a), (j, b) = np.nonzero(x), np.nonzero(y)
        got = simhash.overlaps(np.concatenate([a, b]), np.concatenate([i, j]), np.repeat([True, False], [len(i), len(j)]), 70, 50)
        assert (got == x.astype(int) @ y.T.astype(int)).all()
    assert simhash.overlaps(np.empty(0, int), np.empty(0, int), np.empty(0, bool), 2, 3).tolist() == [[0] * 3] * 2


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = documents()
    want = sorted(str((i, [*tok.encode(t or "", add_special_tokens=False).ids, 2])) for i, t, *_ in rows)
    pieces = packing.pack(with_clashes(docs), P.path("word_bpe_49k.json"), most=64).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) and all(p.offset == 0 and p.length & (p.length - 1) == 0 and p.length <= 64 for p in pieces)
    by = {}
    for p in sorted(pieces, key=lambda p: p.start):
        assert len(p.ids) == 4 * p.length and p.bucket == p.length.bit_length() - 1
        by.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    once = {k: v for k, v in by.items() if k[0] != 0}  # document 0 repeats
    got = [str((k[0], np.frombuffer(b"".join(p.ids for p in v), "<u4").tolist())) for k, v in once.items()]
    assert sorted(got) == [x for x in want if not x.startswith("(0,")]
    assert sum(p.length for p in by[next(k for k in by if k[0] == 0)]) == 3 * next(k[1] for k in by if k[0] == 0)
    assert packing.pack(empty, P.path("word_bpe_49k.json")).count() == 0


def test_buckets_hold_sequences_of_one_length(spark, docs, tmp_path):
    pieces = packing.pack(docs, P.path("word_bpe_49k.json"), most=64)
    packing.write_buckets(pieces, f"{tmp_path}/packed")
    back = spark.read.parquet(f"{tmp_path}/packed")
    kept = lambda df: sorted((x.sequence_id, x.length, x.bucket, bytes(x.ids)) for x in df.collect())
    assert kept(back) == kept(pieces)
    assert all(x.length == 1 << x.bucket for x in back.select("bucket", "length").distinct().collect())


@pytest.mark.parametrize("n", [0, 1, 5, 63, 64, 65, 1000])
def test_piece_lengths(n):
    got = packing.piece_lengths(n, 64)
    assert sum(got) == n and sorted(got, reverse=True) == got and len(set(x for x in got if x < 64)) == len([x for x in got if x < 64])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_tokenization_is_exact(name):
    import pyarrow as pa

    from tokenizers import Tokenizer

    from tarnstone.llm.tokens import Encoder

    e, whole = Encoder(P.path(name)), Tokenizer.from_file(P.path(name))
    r = random.Random(name)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "'s", "don't", ",", ".", "!", "%%%", "1", "23", "²", "中", "\u0301", "\u00a0", "\u2003", "\x1c", "\x00", "\x01", "<|endoftext|>", "<|startoftext|>", "<|endof", "_", "😀", "İ", "Σ", "ab,", "x.y", "\u200b", " the", " of"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(4000)] + [None, "", "a" * 3000]
    ids, sizes = e.encode(pa.array(texts))
    ends = np.cumsum(sizes)
    for t, end, n in zip(texts, ends, sizes, strict=True):
        assert ids[end - n : end].tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    path = fresh_path(spark, "t")
    manifest = token_files.write_token_files(docs, P.path("byte_bpe_50k.json"), path, length=32)
    got = token_files.read_token_files(spark, path).collect()
    rows = sorted(got, key=lambda x: x.start)
    keys = [-1 if x.doc_id is None else x.doc_id for x in rows]
    assert keys == sorted(keys) and [x.start for x in rows] == np.cumsum([0, *(x.n_tokens for x in rows)])[:-1].tolist()
    want = sorted(str((i, zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()))) for i, t, *_ in documents())
    assert sorted(str((x.doc_id, zlib.crc32(x.ids))) for x in got) == want
    shard = manifest.orderBy("shard").first()
    file = token_files.TokenFile(path, shard.file)
    (pathlib.Path(path.removeprefix("file://")) / "ids-000009-lost.arrow").write_bytes(b"")
    assert token_files.sweep(spark, path) == 1
    whole = np.concatenate([file.sequence(k)[0][file.sequence(k)[1]] for k in range(-(-shard.tokens // 32))])
    assert len(whole) == shard.tokens and file.ids(3, 50).tolist() == whole[3:53].tolist() and file.sequence(0)[0].dtype == np.uint16
    path = fresh_path(spark, "t")
    token_files.write_token_files(empty, P.path("byte_bpe_50k.json"), path)
    assert token_files.read_token_files(spark, path).count() == 0


def brute_spans(text):
    found = []
    for k, (name, (pattern, group, least, _)) in enumerate(secrets.BASE.items()):
        found += [(m.start(), k, m.end(), name) for m in re.finditer(pattern.replace(r"(?i:", "(?:"), text or "", re.I if name == "assign" else 0) if len(m[group]) >= least]
    return sorted(found)


def test_secrets(spark, docs, empty):
    key, token = "AKIA" + "Q" * 16, "0123456789abcdef" * 3
    rows = [
        (1, f"😀 password = '{token}' and {key} x"),
        (2, "token: secret: abcdefgh, password: token: abcdefgh api-key=1 APIKEY='abc.def=' "),
        (3, f"user: jane\nhost db://db.example.com:5432/x\nkey Ab3{'xY9' * 10} end {key}"),
        (4, "see https://example.com/a and user: jane"),  # weak parts alone stay unreported
        (5, f"{'z' * 900} Ab3{'xY9' * 10} {'z ' * 900} user: jane"),
        (6, None), (7, ""), (8, "AKIA" + "Q" * 15 + " " + "f" * 23), (1, f"😀 password = '{token}' and {key} x"), (None, f"secret={token}"),
    ]
    got = secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t in rows}
    for x in got:
        base = brute_spans(text[x.doc_id])
        assert [x.n_assign, x.n_access, x.n_hex] == [sum(s[1] == k for s in base) for k in range(3)]
        assert x.base_sha256 == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in base).encode()).hexdigest()
        if x.doc_id in (1, 2, 4, 5, 6, 7, 8):
            assert x.spans == ",".join(f"{n}:{a}:{b}" for a, _, b, n in base)
    third = next(x for x in got if x.doc_id == 3)
    assert [s.split(":")[0] for s in third.spans.split(",")] == ["ident", "endpoint", "opaque", "access"]
    assert secrets.report(empty).count() == 0 and secrets.report(with_clashes(docs)).count() == len(documents())


def water_level(sizes, most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w, full = {s: i % 3 + 1 for i, s in enumerate(order)}, set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        t = {s: most * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in sizes if x not in full) for s in sizes}
        if not (over := {s for s in sizes if s not in full and t[s] > most * sizes[s]}):
            return t
        full |= over


def plain_copies(cells, target):
    """Copies of all documents of each cell (size -> (n, rate)) of one source together."""
    import math

    out, carried = {}, 0.0
    for size in sorted(cells, reverse=True):
        n, rate = cells[size]
        base, part = math.floor(n * rate), (n * rate - math.floor(n * rate) if size else 0.0)
        out[size] = min(base + math.floor(carried + part + 0.5) - math.floor(carried + 0.5), 3 * n)
        carried += part
    for _ in range(3):
        left = target - sum(c * size for size, c in out.items())
        free = {size: 3 * cells[size][0] - c if left > 0 else c for size, c in out.items()}
        if fits := [size for size in out if 0 < size <= abs(left) and free[size] > 0]:
            out[max(fits)] += min(math.floor(abs(left) / max(fits)), free[max(fits)]) * (1 if left > 0 else -1)
    return out


def check_mix(rows):
    """Rows (source, size, source_size, target, rate, copies) of a plan against plain versions of all its steps."""
    import math

    by = {}
    for x in rows:
        by.setdefault(x.source, []).append(x)
    want = water_level({s: sum(x.size for x in xs) for s, xs in by.items()})
    for s, xs in by.items():
        total, target, mean = sum(x.size for x in xs), want[s], sum(x.size for x in xs) / len(xs)
        assert all(x.source_size == total and abs(x.target - target) < 1e-6 * (1 + target) for x in xs)
        low, high = -1e4, 1e4  # the multiplier, by halving
        for _ in range(200):
            l = (low + high) / 2  # noqa: E741
            words = sum(x.size * min(3.0, math.exp(min(50, l * x.size / max(mean, 1e-9)))) for x in xs if x.size)
            low, high = (l, high) if words < target else (low, l)
        cells = {}
        for x in xs:
            rate = 1.0 if not x.size else min(3.0, math.exp(min(50, low * x.size / mean)))
            assert abs(x.rate - rate) < 1e-4
            cells.setdefault(x.size, []).append(x)
        plain = plain_copies({size: (len(c), c[0].rate) for size, c in cells.items()}, xs[0].target)
        for size, c in cells.items():
            assert sum(x.copies for x in c) == plain[size] and {x.copies for x in c} <= {plain[size] // len(c), plain[size] // len(c) + 1}


@pytest.mark.parametrize("ranked", [256, 4])
def test_mixing(spark, docs, empty, monkeypatch, ranked):
    monkeypatch.setattr(mixing, "RANKED", ranked)  # 4: cells have many buckets
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 30, 200])), s) for i, s in enumerate(r.choices(["a", "b", "c", "d", "é", "😀", None], [50, 3, 10, 10, 2, 5, 20], k=1500))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(df).collect()
    assert len(got) == 1500
    sizes, taken = {}, {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.size * x.copies
    want = water_level(sizes)
    assert all(0 <= x.copies <= 3 for x in got) and all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 5 for s in sizes)
    check_mix(got)
    if ranked == 4:
        return
    again = {x.doc_id: x.copies for x in mixing.plan(df.repartition(7)).collect()}
    assert again == {x.doc_id: x.copies for x in got}
    mixed = mixing.mix(with_clashes(df))
    assert mixed.columns == with_clashes(df).columns and mixed.count() == sum(again.values())
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert len(mixing.plan(docs).collect()) == len(documents())


def test_language_id(spark, empty):
    r = random.Random(8)
    parts = {"en": ["the", "ing", "th", "er", "and", "ly"], "de": ["sch", "und", "ung", "ein", "ch", "zu"], "fr": ["eau", "ou", "qu", "ent", "les", "aux"]}
    make = lambda lang, n: " ".join("".join(r.choices(parts[lang], k=r.randint(1, 3))) for _ in range(n))
    rows = [(i, make(lang, 60), lang) for i, lang in enumerate(r.choices(list(parts), k=600))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.learn(df.where("doc_id < 400"))
    got = {x.doc_id: x for x in lang_id.predict(df, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if i >= 400]) >= 0.98
    odd = spark.createDataFrame([(1, None), (2, "123 !?"), (3, ""), (4, "x"), (None, "the"), (5, "the " * 100_000)], "doc_id long, text string")
    seen = {x.doc_id: x for x in lang_id.predict(odd, model).collect()}
    assert all(seen[i].lang_pred == "und" and seen[i].score == 0 for i in (1, 2, 3)) and seen[5].lang_pred == "en" and seen[4].lang_pred in parts
    assert all(0 <= x.score <= 1 for x in seen.values())
    none = lang_id.learn(empty)
    assert lang_id.predict(odd, none).select("lang_pred").distinct().collect()[0][0] == "und" and lang_id.predict(empty, model).count() == 0


def brute_grams(text):
    """4-grams as strings, cell by cell."""
    low = f" {text.lower()}   "
    shown = "".join(c if c.isalpha() else " " for c in low)
    return [shown[i : i + 4] for i in range(len(low) - 3) if shown[i + 1] != " " and shown[i + 2] != " "]


def test_language_id_against_sets(spark, monkeypatch):
    """Plain sets of n-grams instead of filters: the same languages, nearly the same scores, row by row."""
    from collections import Counter

    r = random.Random(21)
    letters = ["abcdefgh", "efghijkl", "ijklmnop", "abmnopqr", "ßéÀÜabmn"]
    make = lambda k, n: " ".join("".join(r.choice(letters[k]) for _ in range(r.randint(1, 6))) + r.choice(["", "", ",", "7"]) for _ in range(n))
    rows = [(i, make(k, r.randint(1, 50)), f"l{k}") for i, k in enumerate(r.choices(range(5), [9, 5, 4, 3, 2], k=300))]
    rows += [(300, None, "l1"), (301, "no", None), (302, " 12 ", "l2"), (None, make(1, 9), None), rows[3], (303, "A", None)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    known = [(t, k) for _, t, k in rows if t is not None and k is not None]
    sizes, grams = Counter(k for _, k in known), {}
    for t, k in known:
        grams.setdefault(k, Counter()).update(brute_grams(t))
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in grams.items()}
    most = {g: max(x.get(g, 0) for x in rate.values()) for x in rate.values() for g in x}
    own = {k: {g for g, x in c.items() if x >= lang_id.RATE and x * 4 >= most[g]} for k, c in rate.items()}
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    want = []
    for i, t, _ in rows:
        hits = [sum(g in own[k] for g in brute_grams(t or "")) for k in order]
        best = max(range(5), key=lambda k: (hits[k], -k))
        fine = any(c.isalpha() for c in t or "")
        want.append((str(i), order[best] if fine else "und", hits[best] / sum(hits) if fine and sum(hits) else 0.0))
    for group in (32, 2):
        monkeypatch.setattr(lang_id, "GROUP", group)
        model = lang_id.learn(df)
        assert model.groups == -(-5 // group)
        taught = {(x.lang, x.gram) for x in model.languages.join(model.own, "nth").collect()}
        assert len(taught) == sum(map(len, own.values()))
        got = sorted((str(x.doc_id), x.lang_pred, x.score) for x in lang_id.predict(df, model).collect())
        off = [abs(g[2] - w[2]) for g, w in zip(got, sorted(want), strict=True)]
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and max(off) < 0.15 and np.mean(off) < 0.01  # filters have false positives


def test_long_texts_come_in_stretches(monkeypatch):
    import pyarrow as pa

    r = random.Random(12)
    text = "".join(r.choice(["ab", "Cd", "é", " ", " ", "\n", "\n\n", ". ", "!!", "\t", "x1"]) for _ in range(900))
    text += "L" * 300 + "-" * 41 + "l" * 40 + " " * 90 + "é" * 90 + "end"  # runs that count as several
    monkeypatch.setattr(quality, "RUN", 40)
    for length in (10**6, 61, 200, 7):
        monkeypatch.setattr(lang_id, "SLICE", length)
        monkeypatch.setattr(quality, "SLICE", length)
        parts = list(lang_id.read(pa.array(["ab cd", text, ""])))
        found = sorted((lo + k, h) for lo, _, hashes, of, _ in parts for k, h in zip(of.tolist(), hashes.tolist(), strict=True))
        parts = list(quality._slices(pa.RecordBatch.from_pydict({"t": ["ab cd", text, None]}), 0))
        ngrams = sorted((lo + k, b) for lo, _, buckets, of in parts for k, b in zip(of.tolist(), buckets.tolist(), strict=True))
        if length == 10**6:
            first = found, ngrams
            assert len(ngrams) == len(brute_ngrams("ab cd")) + len(brute_ngrams(text))
        assert (found, ngrams) == first and len(found) == len(brute_grams("ab cd")) + len(brute_grams(text))


def test_bloom_slots_agree_with_a_set():
    h = np.arange(1, 4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    f = lang_id.Filter(["a", "b"], {"a": h[:2000], "b": h[1000:3000]})
    hits = f.hits(h, np.arange(len(h)), len(h))
    assert hits[:2000, 0].all() and hits[1000:3000, 1].all() and (hits[3000:] == 0).mean() > 0.98


def brute_ngrams(text):
    """Words, pairs and triples of shapes of a text, as tuples."""
    kind = lambda c: 0 if c in b" \t\x0b\x0c\r" else 1 if c >= 128 or chr(c).isalnum() else c
    runs, at = [], 0
    data = (text or "").encode()
    for i in range(1, len(data) + 1):
        if i == len(data) or kind(data[i]) != kind(data[at]):
            if kind(data[at]):
                runs += [data[j : min(j + quality.RUN, i)] for j in range(at, i, quality.RUN)]
            at = i
    upper = lambda c: 65 <= c <= 90

    def shape(i):
        w = runs[i]
        again = kind(w[0]) == 1 and w in runs[max(0, i - 4) : i]
        if kind(w[0]) == 1:
            return 1, min(int(np.log2(len(w) + 1)), 6), upper(w[0]), upper(w[0]) and len(w) > 1 and upper(w[1]), again
        return w[0], len(w) > 1, again

    shapes = [shape(i) for i in range(len(runs))]
    return [("w", x) for x in runs] + list(zip(runs, runs[1:])) + list(zip(shapes, shapes[1:], shapes[2:]))


def plain_quality(rows, label, df):
    """Weight of each (doc_id, text), and those that stay: counts, weights, keys, the cut and the largest keys one by one."""
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    bucket = {}  # of each n-gram: the same wherever it stands, and rarely that of another one
    for _, t, *_ in rows:
        for g, b in zip(brute_ngrams(t), quality.features([(t or "").encode()])[0].tolist(), strict=True):
            assert bucket.setdefault(g, b) == b
    assert len(set(bucket.values())) > 0.9 * len(bucket)
    buckets = lambda t: [bucket[g] for g in brute_ngrams(t)]
    raw, target = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(buckets(t))
        if label.get(i) == 1:
            target.update(buckets(t))
    smooth = lambda c, g: math.log((c[g] + 0.5) / (c.total() + 0.5 * quality.BUCKETS))
    weight = {(i, t): round(sum(smooth(target, g) - smooth(raw, g) for g in buckets(t)), 9) for i, t, *_ in rows}
    noise = {(x.i, x.t): -math.log(-math.log((x.h % (1 << 40) + 0.5) / (1 << 40))) for x in df.select(F.col("doc_id").alias("i"), F.col("text").alias("t"), F.xxhash64(F.lit(42), "doc_id", F.xxhash64("text")).alias("h")).collect()}
    labelled = {}
    for i, t, *_ in rows:
        if i in label:
            labelled[i] = min(weight[i, t], labelled.get(i, math.inf))
    cuts = sorted(set(labelled.values()))
    middles = [-math.inf, *((a + b) / 2 for a, b in zip(cuts, cuts[1:])), math.inf]
    good, bad = ([w for i, w in labelled.items() if label[i] == q] for q in (1, 0))
    cut = min(middles, key=lambda c: sum(w < c for w in good) / len(good) + sum(w >= c for w in bad) / len(bad))
    strata = {}
    for i, t, *_ in rows:
        strata.setdefault(len(brute_ngrams(t)).bit_length(), []).append((math.floor((weight[i, t] + noise[i, t]) * quality.UNITS), weight[i, t] >= cut, (i, t)))
    stay = set()
    for members in strata.values():
        edge = sorted((key for key, *_ in members), reverse=True)
        k = sum(above for _, above, _ in members)
        stay |= {row for key, _, row in members if k and key >= edge[k - 1]}
    return weight, stay


def test_quality_against_a_plain_model(spark):
    """Counts, weights, keys, the cut and the largest keys one by one."""
    r = random.Random(31)
    words = ["Ada", "bee", "CAT", "dog's", "e1", "--", "fig.", "x", "I", "zz!"]
    text = lambda good: " ".join(r.choices(words, [9, 8, 7, 6, 5, 1, 1, 1, 1, 1] if good else [1, 1, 2, 1, 3, 6, 7, 8, 9, 9], k=r.randint(1, 40)))
    rows = [(i, text(i % 3), int(i % 3 > 0)) for i in range(200)] + [(300, None, None), (301, "", 1), (None, text(1), None), (5, text(0), None)]
    rows.append(rows[7])
    df = with_clashes(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"))
    labels = spark.createDataFrame(sorted({(i, q) for i, _, q in rows if q is not None and i % 2}), "doc_id long, quality int")
    label = {x.doc_id: x.quality for x in labels.collect()}
    weight, kept = plain_quality(rows, label, df)
    got = quality.choose(df, labels).collect()
    want = sorted((str(i), weight[i, t]) for i, t, _ in rows)
    found = sorted((str(x.doc_id), x.log_weight) for x in got)
    assert [w[0] for w in want] == [g[0] for g in found] and np.allclose([w[1] for w in want], [g[1] for g in found], atol=1e-5)
    assert sorted(str(x.doc_id) for x in got if x.kept) == sorted(str(i) for i, t, _ in rows if (i, t) in kept) and 60 < len(kept) < 180


def test_kth_largest(spark):
    r = random.Random(6)
    keys = [r.randint(-(1 << 40), 1 << 40) for _ in range(300)] + [7] * 50
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 17, 175, 350):
        assert quality.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]
    assert quality.kth_largest(df, 351) is None and quality.kth_largest(df, 0) is None


def test_quality_draws_within_strata(spark):
    """A share of each stratum stays, long texts or short; tables without rows give none."""
    rows = [(i, "word " * (1 << i % 6), 1) for i in range(300)]
    df = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows[:30]], "doc_id long, quality int")
    kept = [x.doc_id for x in quality.choose(df, labels, share=0.5).collect() if x.kept]
    assert [sum(i % 6 == n for i in kept) for n in range(6)] == [25] * 6
    assert sorted(x.doc_id for x in quality.resample(df, labels, share=0.5).collect()) == sorted(kept)
    assert quality.resample(df, labels, share=0.0).count() == 0 and quality.resample(df, labels.limit(0)).count() == 300
    assert quality.choose(df.limit(0), labels).count() == 0
