"""Search whatever the size: one result on both sides of each switch, questions as tables, ranks without scoring all."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnstone import errors
from tarnstone.config import RetrievalConfig
from tarnstone.functions.embedding import STAMP, deterministic_embedding
from tarnstone.operators import fts, fusion, vector
from tarnstone.plans import queries, search

CHUNKS = "id string, source_id string, content string, embedding array<float>, stamp struct<provider:string,model:string,dimensions:int>"


def vectors(n, dims=8, seed=1, spread=0.05):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(6, dims))
    return [(i, (middles[i % 6] + spread * r.normal(size=dims)).tolist()) for i in range(n)]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("digits", [None, 1, 2])
def test_one_result_on_both_sides_of_the_switch(spark, monkeypatch, digits):
    """Rounded to a digit or two most scores tie: rounding, floor and order are the same by either plan, and in several blocks."""
    table = vectors(300) + [(900, [0.0] * 8), (901, None), (902, [1.0, None] + [0.0] * 6), (903, [1.0, 2.0]), (904, [float("nan")] + [1.0] * 7)]
    e = spark.createDataFrame(table, "chunk_id long, embedding array<double>")
    q = e.where("chunk_id % 50 = 0 OR chunk_id > 800").select(F.col("chunk_id").alias("query_id"), "embedding")
    by_plan = rows(vector.similarities_sql(e, q, 0.3, 12, digits), "query_id", "rank", "chunk_id")
    by_block = rows(vector.similarities(e, q, 0.3, 12, digits), "query_id", "rank", "chunk_id")
    assert by_plan == by_block and len(by_plan) > 70
    monkeypatch.setattr(vector, "FEW_BYTES", 0)
    monkeypatch.setattr(vector, "QUERY_BYTES", 100)
    assert rows(vector.similarities_sql(e, q, 0.3, 12, digits), "query_id", "rank", "chunk_id") == by_plan


def test_pivots_skip_blocks_and_lose_nothing(spark):
    table = vectors(3000, 16, spread=0.1) + [(9000, [0.0] * 16), (9001, None), (9002, [1.0])] + [(9100 + i, vectors(1, 16, spread=0.1)[0][1]) for i in range(5)]
    e = spark.createDataFrame(table, "chunk_id long, embedding array<double>")
    q = e.where("chunk_id % 100 = 0 OR chunk_id = 9002").select(F.col("chunk_id").alias("query_id"), "embedding")
    index = vector.PivotIndex(e, 16, block=64)
    for floor, depth in ((-1.0, 10), (0.95, 50), (0.2, 1)):
        got, blocks = index.search(q.where("query_id < 9000"), floor, depth)
        want = vector.similarities(e, q.where("query_id < 9000"), floor, depth, digits=9)
        assert rows(got.withColumn("score", F.round("score", 9)), "query_id", "score") == rows(want, "query_id", "score")
        assert blocks["read"] < blocks["blocks"] / 2
    assert index.search(q.where("query_id = 9002"), -1.0, 3)[0].count() == 0
    nothing = vector.PivotIndex(e.limit(0), 16)
    assert nothing.search(q, -1.0, 3)[0].count() == 0


def corpus(spark, n=400):
    r = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    return [(i, " ".join(r.choice(words) for _ in range(r.choice([2, 5, 30, 90])))) for i in range(n)]


def plain_rank(texts, query, depth):
    """All matches scored, best first."""
    out = []
    for i, text in texts:
        toks, best, fits = text.split(), 0.0, False
        for alternative in fts.parse_query(query, "simple"):
            held = lambda parts: any(all(p + d < len(toks) and toks[p + d] == x for x, d in parts) for p in range(len(toks)))  # noqa: B023, E731
            if all(held(parts) != negated for negated, parts in alternative) and not all(n for n, _ in alternative):
                fits = True
            lexemes = sorted({x for n, parts in alternative if not n for x, _ in parts})  # whichever alternative fits, the densest counts
            hits = [(lexemes.index(x), p) for p, x in enumerate(toks, 1) if x in lexemes]
            best = max(best, fts.cover_density(hits, len(lexemes)))
        if fits:
            out.append((-best, i))
    return [(i, round(-s, 9)) for s, i in sorted(out)[:depth]]


def test_ranks_without_scoring_every_match(spark):
    texts = corpus(spark)
    chunks = spark.createDataFrame(texts, "chunk_id long, content string")
    posted = fts.postings(chunks, "simple")
    asked = {1: "alpha", 2: "alpha beta", 3: '"alpha beta" gamma', 4: "alpha -beta or delta eta theta", 5: "zeta or eta", 6: "nowhere", 7: "alpha beta gamma delta eps zeta eta theta"}
    terms = fts.query_table(spark, asked, "simple")
    got = {}
    for r in fts.search(posted, terms, 5, chunks).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 9)))
    assert got == {q: want for q, text in asked.items() if (want := plain_rank(texts, text, 5))}
    hit = fts.hits(posted, terms)
    found = fts.matches(posted, terms, chunks)
    bounded = fts.bounds(hit, terms, found)
    known, rest = fts.worth_scoring(bounded, 5)
    matched = bounded.select("query_id", "chunk_id").distinct().count()
    scored = known.count() + rest.select("query_id", "chunk_id").distinct().count()
    assert scored < matched / 2  # the others are skipped
    exact = {(r.query_id, r.chunk_id): r.score for r in fts._scored(bounded).collect()}
    assert all(exact[r.query_id, r.chunk_id] <= r.m for r in bounded.groupBy("query_id", "chunk_id").agg(F.max("most").alias("m")).collect())


@pytest.fixture
def chunks(spark):
    texts = ["red fox jumps", "blue fox sleeps", "red hen sings", "green door"]
    return spark.createDataFrame([(f"c{i}", "s", t, deterministic_embedding(t), STAMP) for i, t in enumerate(texts)], CHUNKS)


def test_questions_as_a_table(spark, chunks):
    """Two questions of one text keep vectors of their own; a refused row is left out and told, not the batch."""
    far, near = deterministic_embedding("nothing of the kind"), deterministic_embedding("green door")
    table = [(0, " red fox ", far), (1, "red fox", near), (2, "", near), (3, "x" * 1025, near), (4, None, near)]
    asked = spark.createDataFrame(table, "query_id long, query string, embedding array<double>")
    got = {(r.query_id, r.chunk_id): (r.fts_score, r.vector_score) for r in search.search(chunks, asked, RetrievalConfig(min_similarity=0.99)).collect()}
    assert set(got) == {(0, "c0"), (1, "c0"), (1, "c3")} and got[0, "c0"][1] is None and got[1, "c3"][1] == pytest.approx(1)
    told = search.check_queries(spark, asked).where("refusal IS NOT NULL")
    assert rows(told, "query_id") == [(2,), (3,), (4,)]
    mixed = search.search(chunks, {"a": "green door", "b": " "}, RetrievalConfig(min_similarity=0.99))
    assert rows(mixed, "query_id", "chunk_id") == [("a", "c3")]
    with pytest.raises(errors.EngineError):
        search.search(chunks, {"b": " "})
    wrong = chunks.withColumn("stamp", F.struct(F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit(32).alias("dimensions")))
    with pytest.raises(errors.EngineError, match="embedded with"):
        search.search(chunks.unionByName(wrong), {"a": "green"})


def test_negations_alone_ask_for_all_others(spark, chunks):
    asked = spark.createDataFrame([(i, "-fox") for i in range(3)] + [(3, "-red -green")], "query_id long, query string")
    got = search.search(chunks, asked, RetrievalConfig(min_similarity=1.0))
    assert rows(got, "query_id", "chunk_id") == [(i, c) for i in range(3) for c in ("c2", "c3")] + [(3, "c1")]


def test_a_replaced_table_gets_a_new_index(spark, tmp_path):
    d = str(tmp_path)
    table = lambda *ids: spark.createDataFrame([(i, "the one with that") for i in ids], "doc_id long, text string")
    table(1).coalesce(1).write.parquet(f"{d}/documents.parquet")
    assert rows(queries.fts_and_match(spark, d), "doc_id") == [(1,)]
    table(1, 2).coalesce(1).write.mode("overwrite").parquet(f"{d}/documents.parquet")
    assert rows(queries.fts_and_match(spark, d), "doc_id") == [(1,), (2,)]


def test_queries_over_an_empty_table_and_over_ties(spark, tmp_path):
    d = str(tmp_path)
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame([], schema).write.parquet(f"{d}/embeddings.parquet")
    for name in ("vector_readback", "vector_topk_batch", "fuse_rrf", "eval_outcomes", "rerank_reorder"):
        assert queries.QUERIES[name](spark, d).count() == 0, name
    d = f"{d}/ties"
    same = [(i, [1.0, 0.0] if i < 130 else [0.9999999999, 1e-9], i % 3) for i in range(260)]  # all equal after rounding
    spark.createDataFrame(same, schema).write.parquet(f"{d}/embeddings.parquet")
    got = rows(queries.vector_topk_batch(spark, d), "query_id", "chunk_id")
    assert got == [(q, i) for q in (0, 100, 200) for i in range(10)]
    assert rows(queries.vector_readback(spark, d), "query_id", "id") == [(0, 0), (100, 0), (200, 0)]


@pytest.mark.parametrize("digits", [None, 2, 12])
def test_best_rows_so_far_against_all_at_once(digits):
    from decimal import ROUND_HALF_UP, Decimal

    rng, depth, floor = np.random.default_rng(7), 5, -0.5
    scores = np.round(rng.uniform(-1, 1, (900, 4)), 3)  # many ties, and every tenth score halfway between two of two digits
    scores[rng.random(900) < 0.4] = 0.985
    fine, ids = rng.random(900) < 0.9, [f"c{i}" for i in rng.permutation(900)]
    best, most = vector._Best(4, floor, depth, digits), 0
    for at in range(0, 900, 45):
        best.take(scores[at : at + 45], fine[at : at + 45], pa.array(ids[at : at + 45]))
        most = max(most, best.held)
    assert most <= 4 * depth if digits != 2 else best.held < 4 * 900
    rounded = lambda x: x if digits is None else float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    got = sorted((q, -rounded(x), c) for qs, cs, xs in best.lists() for q, c, x in zip(qs.to_pylist(), cs.to_pylist(), xs.to_pylist(), strict=True))
    for q in range(4):
        want = sorted((-rounded(scores[i, q]), ids[i]) for i in range(900) if fine[i] and rounded(scores[i, q]) >= floor)[:depth]
        assert [x[1:] for x in got if x[0] == q and -x[1] >= floor][:depth] == want


def test_equal_vectors_are_cut_within_a_task(spark):
    """All scores tie: each task sends a query's list, not all rows."""
    rows = spark.range(0, 4000, 1, 2).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    asked = spark.createDataFrame([(1, [2.0, 4.0]), (2, [-1.0, -2.0])], "query_id long, embedding array<double>")
    sent = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(vector, "ranked", lambda df, depth: sent.append(df) or fusion.ranked(df, depth))
        found = vector.similarities(rows, asked, 0.2, 10, digits=7).collect()
    assert sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in found) == [(1, i, i + 1) for i in range(10)]
    assert sent[0].count() <= 2 * 10


#: Queries whose similarities are products of blocks, not expressions row by row.
BY_BLOCKS = ["vector_floor", "fuse_missing_signal", "rerank_reorder", "fuse_weighted", "fuse_rrf"]


@pytest.mark.parametrize("name", BY_BLOCKS)
def test_similarities_are_products_of_blocks(spark, name):
    from tarnstone.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan


def test_text_signal_looks_at_few_rows_where_labels_follow_ids(spark, tmp_path, monkeypatch):
    """Each label has a tenth of the residues then; questions still meet no more than their best."""
    spark.range(20_000).select(F.col("id").alias("vec_id"), (F.col("id") % 10).cast("int").alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    ranked, seen = fusion.ranked, []
    monkeypatch.setattr(fusion, "ranked", lambda df, depth: seen.append(df) or ranked(df, depth))
    got = rows(queries._text_signal(spark, str(tmp_path), 50).where("query_id < 300"), "query_id", "rank", "chunk_id", "score")
    want = []
    for q in range(0, 300, 100):
        best = sorted((-((c * 7919 + q * 104729) % 1000), c) for c in range(q % 10, 20_000, 10))[:50]
        want += [(q, n, c, float(-x)) for n, (x, c) in enumerate(best, 1)]
    assert got == want and seen[0].count() == 200 * 50
