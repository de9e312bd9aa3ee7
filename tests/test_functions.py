"""Pure parts: configuration, identities, analysis, embedding, parsers, chunking, with hand-computed expectations."""

import hashlib
import math

import pytest

from tarnstone import config, errors
from tarnstone.config import ChunkingParams
from tarnstone.functions import html as H
from tarnstone.functions.embedding import deterministic_embedding
from tarnstone.functions.stem import analyze, stem
from tarnstone.operators import fts, parsers
from tarnstone.operators.chunking import chunk_sections, split_prose, tail, units
from tarnstone.operators.reads import clamp_page


def test_retrieval_settings():
    c = config.resolve_retrieval({})
    assert (c.fusion, c.rrf_k, c.weight_alpha, c.min_similarity, c.candidate_depth, c.k, c.rerank, c.rerank_depth) == ("rrf", 60, 0.5, 0.2, 50, 10, False, 50)
    assert config.resolve_retrieval({"RETRIEVAL_K": "7"}, k=3).k == 3 and config.resolve_retrieval({"RETRIEVAL_FUSION": "weighted"}).fusion == "weighted"
    assert config.resolve_retrieval({"RETRIEVAL_RERANK": "on", "RERANKER_PROVIDER": "x"}).rerank
    for env, over in (({"RETRIEVAL_RERANK": "on"}, {}), ({"RETRIEVAL_K": "x"}, {}), ({}, {"fusion": "other"}), ({}, {"rrf_k": 0}), ({}, {"weight_alpha": 1.1}), ({}, {"min_similarity": -2}), ({}, {"candidate_depth": 501}), ({}, {"k": 51}), ({}, {"rerank_depth": 257}), ({}, {"depth": 1})):
        with pytest.raises(ValueError):
            config.resolve_retrieval(env, **over)
    assert '"rrf_k": 60' in c.to_json()
    assert config.resolve_chunking({"CHUNK_TARGET_CHARS": "10"}) == ChunkingParams(10, 400, 6000)
    with pytest.raises(ValueError):
        config.resolve_chunking({"CHUNK_MAX_CHARS": "0"})
    assert config.resolve_role({}, "embedder") is None and config.resolve_role({"EMBEDDER_PROVIDER": "p", "EMBEDDER_MODEL_ID": "m", "EMBEDDER_DIMENSIONS": "8"}, "embedder")["dimensions"] == 8
    with pytest.raises(ValueError):
        config.resolve_role({"EMBEDDER_PROVIDER": "p"}, "embedder")


def test_errors():
    assert errors.EngineError("unavailable", "x", "rerank").status == 503
    with pytest.raises(ValueError):
        errors.ParseError("other", "x")


def test_embedding_pins():
    v = deterministic_embedding("pin")
    assert [round(x, 6) for x in v[:3]] == [0.204653, -0.188128, -0.161116] and math.isclose(sum(x * x for x in v), 1) and len(v) == 32


@pytest.mark.parametrize("word,root", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("hopefulness", "hope"), ("electricity", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controlling", "control"), ("goblins", "goblin"), ("sky", "sky")])
def test_stems(word, root):
    assert stem(word) == root


def test_query_language():
    assert analyze("How does a riposte work?") == [("ripost", 4), ("work", 5)]
    q = fts.parse_query('goblin "deep caves" -dragons or potion')
    assert q == [[(False, [("goblin", 0)]), (False, [("deep", 0), ("cave", 1)]), (True, [("dragon", 0)])], [(False, [("potion", 0)])]]
    assert fts.parse_query("the of") == [] and fts.parse_query('"king of rome"')[0][0][1] == [("king", 0), ("rome", 2)]


def test_cover_density_prefers_close_words():
    near, far = fts.cover_density([(0, 1), (1, 2)], 2), fts.cover_density([(0, 1), (1, 9)], 2)
    assert near == 1.0 and math.isclose(far, 2 / 9) and fts.cover_density([(0, 1)], 2) == 0
    assert fts.cover_density([(0, 1), (1, 2), (0, 3)], 2) == 2.0


PAGE = """<!DOCTYPE html><html><head><title>Goblin | Field Guide | Sources</title><meta property="og:url" content="https://www.dndbeyond.com/monsters/1-goblin"></head>
<body><nav><h2>Menu</h2>skip</nav><main><article class="x"><h1 id="top">Goblin</h1><p>Small <b>folk</b>.</p><h2>Lore</h2><h3>Caves</h3><p>They <a href="javascript:x()" onclick="y()">live</a> there<br>still.<script>bad()</script></p>
<h2>Stats</h2><div class="mon-stat-block">AC 15</div><h2>Loot</h2><table><tr><td>Gold<td>Ten coins</table><h2>Lore</h2><p>Casting Time Range Duration now</article></main></body></html>"""


def test_saved_page():
    plugin, confidence, scores = parsers.detect("text/html", PAGE.encode())
    assert plugin is parsers.SAVED_PAGE and confidence == 0.95 and scores == {"saved-page": 0.95, "generic-html": 0.1}
    d = plugin.parse(PAGE.encode())
    assert d["title"] == "Goblin" and [s["kind"] for s in d["sections"]] == ["prose", "prose", "stat_block", "table", "spell_entry"]
    assert [s["path"] for s in d["sections"]] == [["Field Guide", "Goblin"], ["Field Guide", "Goblin", "Lore", "Caves"], ["Field Guide", "Goblin", "Stats"], ["Field Guide", "Goblin", "Loot"], ["Field Guide", "Goblin", "Lore"]]
    assert [a["id"] for a in d["artifacts"]] == ["full", "top", "caves", "stats", "loot", "lore-2"]
    caves = d["artifacts"][2]["content"]
    assert "javascript" not in caves and "onclick" not in caves and "bad()" not in caves and 'data-anchor="caves"' in caves
    assert d["sections"][1]["content"] == "They live therestill." and d["sections"][3]["content"] == "GoldTen coins"


def test_identity_needs_no_article_and_paths_count():
    saved = "<!-- saved from url=(0042)https://www.dndbeyond.com/spells/x --><html>"
    assert parsers.detect_saved(saved.encode()) == 0.95
    assert parsers.detect_saved(b"<link rel='canonical' href='https://www.dndbeyond.com/forums/x'><p>x") == 0
    assert parsers.detect_saved(b"<article data-x><p data-content-chunk-id='1'>text</article>") == 0.85
    with pytest.raises(errors.ParseError) as e:
        parsers.parse_saved(saved.encode())
    assert e.value.category == "unrecognized"


def test_generic_html_and_refusals():
    d = parsers.parse_html(b"<body><h1>A</h1><p>one<p>two</body>")
    assert d["title"] == "A" and d["sections"][0]["content"] == "one two"
    assert parsers.parse_html(b"<title>T</title><h2>A</h2>loose text")["sections"][0]["content"] == "loose text"
    assert parsers.detect_html(b"<html><head>") == 0.1 and parsers.detect_html(b"") == 0
    for bad in (b"", b"<body><p>no heading</body>"):
        with pytest.raises(errors.ParseError):
            parsers.parse_html(bad)


def test_markdown():
    d = parsers.parse_markdown(b"\xef\xbb\xbflead  text\r\n\r\n# One #\nbody\n## Two\n\n### Three\ndeep <b>\n# Two\nagain")
    assert d["title"] == "One" and [s["path"] for s in d["sections"]] == [[], ["One"], ["One", "Two", "Three"], ["Two"]]
    assert [s["anchor"]["artifact_id"] for s in d["sections"]] == ["intro", "one", "three", "two"]
    assert "&lt;b&gt;" in d["artifacts"][2]["content"] and parsers.parse_markdown(b"x" * 200)["title"] == "x" * 80
    for bad in (b" \n\t", b"# only\n## headings"):
        with pytest.raises(errors.ParseError):
            parsers.parse_markdown(bad)


def test_registry_rules():
    def boom(head):
        raise RuntimeError

    a, b, c = (parsers.Plugin(n, "1", ("t",), f, lambda x: {}) for n, f in (("a", lambda h: 0.5), ("b", lambda h: 0.5), ("c", boom)))
    assert parsers.detect("t", b"", [c, a, b]) == (a, 0.5, {"c": 0.0, "a": 0.5, "b": 0.5})
    assert parsers.detect("t", b"", [c])[0] is None and parsers.detect("u", b"", [a]) == (None, 0.0, {})
    assert parsers.detect("application/x-demo-sections", b"@@ x\nbody", (*parsers.SHIPPED, parsers.DEMO))[1] == 0.9


@pytest.mark.parametrize("plugin,good,bad", [(parsers.SAVED_PAGE, PAGE.encode(), b"<p>x"), (parsers.MARKDOWN, b"# a\nb", b" "), (parsers.HTML, b"<h1>a</h1>b", b"x"), (parsers.DEMO, b"@@ a\nb\n@@ c\n@@ d\ne", b"no markers")])
def test_conformance(plugin, good, bad):
    assert plugin.name and plugin.version and plugin.accepts
    for head in (good, bad, b"", b"\xff\x00\xfe", b"<" * 5000):
        assert 0 <= plugin.detect(head) <= 1
    first = plugin.parse(good)
    assert first == plugin.parse(good) and first["sections"]
    ids = [a["id"] for a in first["artifacts"]]
    assert len(set(ids)) == len(ids) and [s["index"] for s in first["sections"]] == list(range(len(first["sections"])))
    with pytest.raises(errors.ParseError) as e:
        plugin.parse(bad)
    assert e.value.category in errors.PARSE_FAILURES


def test_html_tree():
    tree = H.parse("<div id=a class='b c'><p>1<p>2<ul><li>x<li>y</ul></div><br/>&amp;")
    assert [n.text() for n in H.select(tree, "p")] == ["1", "2"] and [n.text() for n in H.select(tree, "div.b.c#a li")] == ["x", "y"]
    assert H.first(tree, "span") is None and H.sanitize(tree.children).endswith("<br />&amp;")
    deep = H.parse("<div>" * 5000 + "x")
    assert deep.text() == "x" and H.sanitize([deep]).count("<div>") == 5000


def sections(*items):
    return [{"index": i, "kind": k, "content": c} for i, (k, c) in enumerate(items)]


PARAMS = ChunkingParams(200, 40, 300)


def test_packing_rules():
    s = sections(("prose", "a" * 90), ("prose", "b" * 90), ("prose", "c" * 90), ("prose", " "), ("table", "d" * 301), ("prose", "e"))
    got = chunk_sections(s, PARAMS)
    assert [c["section_indexes"] for c in got] == [[0, 1], [2], [4], [5]] and [c["oversized"] for c in got] == [False, False, True, False]
    assert got[0]["content"] == "a" * 90 + "\n\n" + "b" * 90 and [c["chunk_index"] for c in got] == [0, 1, 2, 3]
    assert [c["section_indexes"] for c in chunk_sections(s[:3], PARAMS, keep_together=[[0, 1, 2]])] == [[0, 1, 2]]
    assert [c["section_indexes"] for c in chunk_sections(s[:2], PARAMS, break_before=[1])] == [[0], [1]]


def test_prose_is_split_with_overlap():
    text = " ".join(f"Sentence number {i} ends here." for i in range(20))
    pieces = split_prose(text, PARAMS)
    assert len(pieces) > 2 and all(b.startswith(a[-40:] + "\n\n") for a, b in zip(pieces, pieces[1:]))
    assert [c["anchor_section_index"] for c in chunk_sections(sections(("prose", text)), PARAMS)] == [0] * len(pieces)
    assert split_prose("one\n\ntwo", PARAMS) == ["one\n\ntwo"] and split_prose("x" * 900, PARAMS) == ["x" * 900]
    assert units("a😀") == 3 and tail("ab😀", 2) == "😀" and tail("abc", 0) == ""


def test_paging():
    assert clamp_page(None, None) == (50, 0) and clamp_page(0, -3) == (1, 0) and clamp_page(999, 5) == (200, 5)


def test_sha_pins():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_chunking_takes_time_in_proportion():
    """20,000 sections of one document, and one section of 20,000 sentences beyond ASCII, within a second on any machine."""
    import time

    for made in ([{"index": i, "kind": "prose", "content": f"section {i} " + "x" * 60} for i in range(20_000)], [{"index": i, "kind": "prose", "content": "x"} for i in range(20_000)], [{"index": 0, "kind": "prose", "content": "Ünï 😀. " * 20_000}]):
        began = time.perf_counter()
        got = chunk_sections(made, ChunkingParams(4000, 400, 6000))
        assert time.perf_counter() - began < 1 and got
        assert [i for c in got for i in c["section_indexes"]] == [s["index"] for s in made] or len(made) == 1
