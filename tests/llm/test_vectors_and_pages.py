"""Top-k search and host reputation against plain versions, and the pipeline against its stages' own results."""

import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from tarnstone.llm import mixing, topk, url_reputation


def brute_topk(rows, k):
    """Over all pairs, in Python's integers; a score ends where a long does."""
    floor = lambda v: tuple(math.floor(Fraction(x) * 1024) for x in v)
    usable = [(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qid, v in set(usable):
        if qid % 100 == 0:
            q = floor(v)
            score = lambda e: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, floor(e), strict=True))))  # noqa: B023, E731
            best = sorted((-score(e), i) for i, e in usable if i != qid and len(e) == len(q))[:k]
            out += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def with_clashes(df):
    """Columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("q", "dims", "bits", "rank", "score", "query_id", "host", "path", "best", "n", "mean", "bad", "verdict", "suffix")})


@pytest.mark.parametrize("dims,n,blocks", [(8, 700, 1), (3, 150, 7)])
def test_topk(spark, monkeypatch, dims, n, blocks):
    r = np.random.default_rng(dims)
    rows = [(i, r.normal(0, 0.3, dims).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(90)]  # ties beyond k
    rows += [(2000, None), (2100, [None] * dims), (2200, [float("nan")] * dims), (2300, [float("inf")] * dims), (None, [0.1] * dims), (2400, [0.0] * dims), (2500, [0.5] * (dims + 1)), (2501, [0.25] * (dims + 1)), (2600, [])]
    rows += [rows[100], (100, [0.5] * dims), (100, [0.25] * dims)]  # a repeated query, and other vectors of its id
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    monkeypatch.setattr(topk, "QUERY_BYTES", 14 * 8 * (dims + 1) // blocks)
    got = topk.search(df, df.where("vec_id % 100 = 0"), 10)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_topk(rows, 10)
    none = df.limit(0)
    assert topk.search(none, none).count() == 0


def test_blocks_of_queries_shuffle_nothing_of_the_index(spark):
    """Three blocks of queries against one index: each reads it where it lies, and only lists of k rows meet."""
    rows = [(i, [float(i % 7), 1.0]) for i in range(500)]
    index = topk.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for _ in range(3):
        shared = spark.sparkContext.broadcast([(0, 100, np.array([1.0, 2.0]))])
        best = topk.block_best(index, shared, 10)
        plan = best._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "FileScan parquet" in plan
        assert best.count() <= 10 * index.rdd.getNumPartitions()


@pytest.mark.parametrize("large", [70_000.0, 1e6, 3e7, 1e15, 1e300, 1.7e308])
def test_topk_of_large_components(spark, large):
    r = np.random.default_rng(7)
    rows = [(i, [*r.normal(0, 1, 3).tolist(), 0.0]) for i in range(300)]
    rows += [(1000 + i, [large * x for x in r.normal(0, 0.5, 4).clip(-1, 1).tolist()]) for i in range(30)] + [(2000, [large, 0.0, 0.0, 1.0]), (2001, [-large, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = topk.search(df, df.where("vec_id % 100 = 0"), 10)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_topk(rows, 10)


def test_slices_add_up():
    r = np.random.default_rng(1)
    v = r.integers(-500, 500, (200, 5))
    planes, low, real = topk.to_slices(v)
    q = np.array([3, -7, 0, 255, -1])
    for k in (1, 10, 200):
        rows = topk.candidates(planes, real, q, k, added=4)
        best = np.argsort(-(v @ q), kind="stable")[:k]
        assert set(best) <= set(rows)
    assert set(topk.candidates(planes, real, q, 3, added=4)) < set(range(200))


def test_hosts_rules_and_reputation(spark):
    urls = ["https://a.example.com/en/7?x#y", "http://WWW.Example.COM/EN/7", "HTTP://x.com/en/1", "ftp://com/en/", "http://y.net/de/8", "http://example.net/de/8", "http://z.org", "http://z.org?q=/es/", "no scheme", None, "://", "http://h.org/es/a://b", "http://notcom/en/7", "http://u@h.co.uk:80/x#/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_reputation.judge(pages).collect()}
    assert len(got) == len(urls)
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1][:3] == ("www.example.com", "/EN/7", None)
    assert got[2] == ("x.com", "/en/1", "com/en/", "block") and got[3] == ("com", "/en/", "com/en/", "block")
    assert got[4][2:] == ("net/de/", "block") and got[5][2:] == ("example.net/de/8", "block")
    assert got[6][:3] == ("z.org", "", None) and got[7][:3] == ("z.org", "", None)
    assert got[8][:3] == ("", "", None) and got[9][:3] == ("", "", None) and got[10][:3] == ("", "", None)
    assert got[11] == ("h.org", "/es/a://b", "org/es/", "block") and got[12][2] is None and got[13][0] == "u@h.co.uk:80"
    assert url_reputation.judge(pages.limit(0)).count() == 0


def test_each_rule_gives_the_contracts_word(spark):
    """Block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/; on hosts and subdomains."""
    want = {
        "http://com/en/": ("com/en/", "block"),
        "http://a.b.com/en/7": ("com/en/", "block"),
        "http://example.com/en/7": ("example.com/en/7", "allow"),
        "http://w.example.com/en/70?x": ("example.com/en/7", "allow"),
        "http://example.com/en/8": ("com/en/", "block"),
        "http://net/de/": ("net/de/", "allow"),
        "http://y.net/de/8": ("net/de/", "allow"),
        "http://W.Example.NET/de/7#8": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"),
        "http://w.example.net/de/80": ("example.net/de/8", "block"),
        "http://h.org/es/": ("org/es/", "block"),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in url_reputation.judge(pages).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
    # what a rule allows is a good outcome of its host
    pages = spark.createDataFrame([(i, "http://good.net/de/1") for i in range(30)] + [(30, "http://good.net/fr/1"), (31, "http://bad.com/en/1")], "page_id long, url string")
    got = {x.page_id: x for x in url_reputation.judge(pages).collect()}
    assert (got[30].rule, got[30].verdict) == (None, "allow") and got[30].block_rate < 0.1 < 0.5 < got[31].block_rate


def plain_beta_quantile(a, b, q):
    """By summing the density over ten million rates."""
    u = np.linspace(-60, 60, 2_000_001)
    log = a * u - (a + b) * np.logaddexp(0, u)
    mass = np.cumsum(np.exp(log - log.max()))
    return float(1 / (1 + np.exp(-u[np.searchsorted(mass, q * mass[-1])])))


def test_beta_quantiles(spark):
    from pyspark.sql import functions as F

    pairs = [(0.5, 0.5), (1.0, 1.0), (2.7, 0.3), (90.0, 10.0), (1.0, 1000.0), (5000.0, 3.0), (0.2, 40.0), (1e6, 1e6)]
    got = spark.createDataFrame(pairs, "a double, b double").select("a", "b", url_reputation.beta_quantile(F.col("a"), F.col("b"), 0.05).alias("q")).collect()
    for x in got:
        assert x.q == pytest.approx(plain_beta_quantile(x.a, x.b, 0.05), rel=0.02, abs=2e-4), x


def test_outcomes_are_those_of_pages_with_a_rule(spark):
    """Hosts against a plain version; pages without a rule have no outcome, whatever their number."""
    hosts = {"a.x.com": [1, 1, 1, None, None], "b.x.com": [None] * 50, "c.y.com": [0, 0, 0, 1], "d.z.org": [None], "e.z.org": [0] * 9}
    rows = [(h, o) for h, os in hosts.items() for o in os]
    got = {x.host: x for x in url_reputation.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert {h: (x.n, x.bad) for h, x in got.items()} == {h: (sum(o is not None for o in os), sum(o or 0 for o in os)) for h, os in hosts.items()}

    def strength(groups):  # (n, bad, mean of the parent)
        held = [g for g in groups if g[0]]
        v = [m * (1 - m) for _, _, m in held]
        slope = sum(x * (n - 1) for x, (n, _, _) in zip(v, held, strict=True))
        r = min(0.999, max(0.001, (sum(n * (bad / n - m) ** 2 for n, bad, m in held) - sum(v)) / slope)) if slope else 0.5
        return 1 / r - 1

    count = lambda end: (sum(got[h].n for h in hosts if h.endswith(end)), sum(got[h].bad for h in hosts if h.endswith(end)))
    n, bad = count("")
    means = {"": (bad + 1) / (n + 2)}
    for level, parent in ((("com", "org"), lambda k: ""), (("x.com", "y.com", "z.org"), lambda k: k[2:]), (tuple(hosts), lambda k: k[2:])):
        kappa = strength([(*count(k), means[parent(k)]) for k in level])
        means |= {k: (kappa * means[parent(k)] + count(k)[1]) / (kappa + count(k)[0]) for k in level}
    assert {h: round(x.mean, 9) for h, x in got.items()} == {h: round(means[h], 9) for h in hosts}
    assert got["b.x.com"].mean > got["d.z.org"].mean  # without outcomes of their own they follow their domains


def test_pages_of_every_kind(spark):
    from pyspark.sql import functions as F

    urls = ["http://a.com/en/1", "http://a.com/en/1", None, "http://a.com/" + "x" * 300_000, "http://" + "h" * 100_000 + ".net/de/" + "y" * 100_000]
    pages = spark.createDataFrame([(None if i < 2 else i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "best", "n", "bad", "mean")})
    got = url_reputation.judge(pages).collect()
    assert len(got) == 5 and [x.rule for x in got if x.page_id is None] == ["com/en/"] * 2
    assert {x.page_id: len(x.path) for x in got if x.page_id} == {2: 0, 3: 300_001, 4: 100_004} and {x.verdict for x in got if x.page_id == 4} == {"block"}
    none = url_reputation.judge(pages, rules=())
    assert {x.verdict for x in none.collect()} == {"allow"}


def test_reputation_shrinks_towards_the_parents(spark):
    r = random.Random(1)
    rows = [("bad.one.com", 1)] * 60 + [("bad.one.com", 0)] * 2 + [("new.one.com", 1)] + [(f"h{i}.two.com", int(r.random() < 0.05)) for i in range(200) for _ in range(5)] + [("new.two.com", 1)]
    got = {x.host: x for x in url_reputation.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.one.com"].mean > 0.9 and got["new.one.com"].mean > got["new.two.com"].mean
    assert got["new.two.com"].mean < 0.5 and all(0 <= x.mean <= 1 for x in got.values())
    from pyspark.sql import functions as F

    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("co.uk",), ("com",), ("x.com",), ("1.2.3.4",), ("",), ("y.x.com:8080",)], "host string")
    suffix = url_reputation.suffix_of(F.col("host"))
    cut = {x.host: (x.s, x.d) for x in hosts.select("host", suffix.alias("s"), url_reputation.domain_of(F.col("host"), suffix).alias("d")).collect()}
    assert cut == {"a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "com": ("com", "com"), "x.com": ("com", "x.com"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "": ("", ""), "y.x.com:8080": ("com", "x.com")}


def test_pipeline(spark, tmp_path):
    """Every stage's rows, and those of the whole, against plain versions; crowds, copies and a shared passage among them."""
    import public_tokenizers
    import test_texts as plain
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources", "packing"]
    r = random.Random(7)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(80):
        text = " ".join(r.choice(words) for _ in range(r.randint(5, 150)))
        rows.append((i, text, "en", f"s{i % 4}", 0))
    rows += [(100 + i, rows[i][1], "en", "s1", 0) for i in range(10)]
    rows += [(200 + i, "%%% | !! | " * 30, "en", "s2", 0) for i in range(15)] + [(300, None, None, None, None)]
    passage = [r.choice(words) for _ in range(100)]
    for g in range(40):
        own = [*passage, *(r.choice(words) for _ in range(22))]  # strangers that share a passage, most below 0.8
        for k in range(1 + (g % 4 == 0)):
            rows.append((400 + 2 * g + k, " ".join([*own, "tail"] if k else own), "en", "s3", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(200 + i, 0, 0) for i in range(10)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, names = docs, docs.columns
    stages = {}
    for name, stage in cp.STAGES:
        stages[name] = at = stage(spark, at, str(tmp_path))
        assert name == "packing" or at.columns == names
    ids = lambda name: sorted((-1 if x.doc_id is None else x.doc_id) for x in stages[name].select("doc_id").collect())
    # plain versions, each over what the plain version before it keeps
    _, kept = plain.plain_quality(rows, {i: q for i, q, _ in labels}, docs)
    left = [x for x in rows if x[:2] in kept]
    assert ids("quality classifier") == sorted(-1 if x[0] is None else x[0] for x in left) and len(left) >= 90
    first = {}
    for x in sorted(left, key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", x[1] or ""), x)
    left = list(first.values())
    assert ids("exact dedup") == sorted(x[0] for x in left)
    stay = set(plain.brute_thin([x[:2] for x in left]))
    left = [x for x in left if x[0] in stay]
    assert ids("SimHash near-dedup") == sorted(stay) and 0 < len(stay) < len(first)
    thinned = spark.createDataFrame(left, docs.schema)
    dealt = mixing.plan(thinned).collect()
    plain.check_mix(dealt)
    copies = {x.doc_id: x.copies for x in dealt}
    assert ids("mixing sources") == sorted(i for i, n in copies.items() for _ in range(n))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t, *_ in left:
        every, start = [*tok.encode(t or "", add_special_tokens=False).ids, 2], 0
        for n in [4096] * (len(every) // 4096) + [1 << b for b in range(11, -1, -1) if len(every) % 4096 >> b & 1]:
            want += [(i, start, n, len(every), every[start : start + n])] * copies[i]
            start += n
    out = cp.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.start, x.length, x.doc_tokens, np.frombuffer(x.ids, "<u4").tolist()) for x in out) == sorted(want)
    assert len({x.sequence_id for x in out}) == len(out)
