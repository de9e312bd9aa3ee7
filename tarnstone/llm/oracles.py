"""DuckDB SQL that says what some of the queries say. What the contracts fix is written out here, apart from the operators."""

from __future__ import annotations

#: Kind: pattern, a pattern for the same matches where they are long enough, group whose length counts, least length, role; fixed values.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", None, 2, 6, "secret"),
    "access": (r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}", 0, 20, "ident"),
    "hex": (r"[0-9a-f]+", r"[0-9a-f]{24,}", 0, 24, "secret"),
    "ident": (r"""((?i:user(?:name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""", None, 2, 3, "ident"),
    "opaque": (r"[A-Za-z0-9+/_=-]{20,}", None, 0, 20, "secret"),
    "endpoint": (r"""[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D"'<>]+""", None, 0, 8, "endpoint"),
}
#: The first kinds are the contract's own; the others are reported with partners of these roles within so many code points.
BASE, SCOPE = 3, 300
PARTNERS = {"ident": ("secret",), "secret": ("ident",), "endpoint": ("ident", "secret")}
#: Rules by length, the longest first, and second-level names of registries; fixed values.
RULES = (("example.com/en/7", "allow"), ("example.net/de/8", "block"), ("com/en/", "block"), ("net/de/", "block"), ("org/es/", "block"))
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def op3_secrets() -> str:
    """Starts are sums of the gaps and matches before; links are looked up row by row."""
    found = []
    for n, (kind, (pattern, long, group, least, role)) in enumerate(KINDS.items()):
        quick = _quoted(long or pattern)
        fits = f"length(regexp_extract(m, {_quoted(pattern)}, {group})) >= {least}"
        if kind == "opaque":
            fits += "".join(f" AND regexp_matches(m, '[{c}]')" for c in ("0-9", "a-z", "A-Z"))
        found.append(f"""SELECT doc_id, {n} AS kind, '{kind}' AS name, '{role}' AS role, stop - length(m) AS start, stop
            FROM (SELECT doc_id, m, (sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS stop
                  FROM (SELECT doc_id, unnest(regexp_extract_all(t, {quick})) AS m, unnest(string_split_regex(t, {quick})[:-2]) AS gap, generate_subscripts(regexp_extract_all(t, {quick}), 1) AS i
                        FROM d WHERE regexp_matches(t, {quick}))) WHERE {fits}""")
    near = lambda p: f"EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.role = '{p}' AND o.start <= s.stop + {SCOPE} AND o.stop >= s.start - {SCOPE})"
    linked = " OR ".join(f"(s.role = '{r}' AND {' AND '.join(map(near, ps))})" for r, ps in PARTNERS.items())
    listed = "string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(list(KINDS)[:BASE]))
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(found)}),
             k AS (SELECT * FROM s WHERE kind < {BASE} OR {linked}),
             j AS (SELECT doc_id, {counts}, {listed} FILTER (kind < {BASE}) AS base, {listed} AS spans FROM k GROUP BY 1)
        SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in list(KINDS)[:BASE])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN j ON j.doc_id = d.doc_id"""


def op6_url_reputation(limit: float = 0.5, risk: float = 0.05, nodes: int = 100, step: float = 0.06) -> str:
    fits = {r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')" for r, _ in RULES}
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r}'" for r, _ in RULES) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES) + " END"
    second = "|".join(SECOND_LEVEL)

    def shrunk(groups: str, parents: str, key: str) -> str:
        """Groups around their parents' means, with the prior's strength by moments."""
        return f"""(WITH a AS (SELECT g.*, p.mean AS m FROM {groups} g JOIN {parents} p ON p.k = g.{key}),
            s AS (SELECT sum(n * (bad / n - m) ** 2) AS seen, sum(m * (1 - m)) AS pure, sum(m * (1 - m) * (n - 1)) AS slope FROM a WHERE n > 0),
            r AS (SELECT 1 / CASE WHEN slope > 0 THEN least(0.999, greatest(0.001, (seen - pure) / slope)) ELSE 0.5 END - 1 AS kappa FROM s)
            SELECT a.* EXCLUDE m, (kappa * m + bad) / (kappa + n) AS mean, kappa + n AS weight FROM a, r)"""

    return f"""
        WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
             q AS (SELECT *, {rule} AS rule FROM p), v AS (SELECT *, {verdict} AS ruled FROM q),
             b AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':\\d*$', '') AS bare, count(ruled)::DOUBLE AS n, count(*) FILTER (ruled = 'block')::DOUBLE AS bad FROM v GROUP BY 1),
             c AS (SELECT *, CASE WHEN regexp_matches(bare, '^[\\d.]+$|^\\[') OR bare = '' THEN bare WHEN regexp_matches(bare, '(^|\\.)({second})\\.[a-z][a-z]$') THEN regexp_extract(bare, '(?:^|\\.)(({second})\\.[a-z][a-z])$', 1) ELSE regexp_extract(bare, '([^.]*)$', 1) END AS suffix FROM b),
             hosts AS (SELECT *, CASE WHEN bare = suffix THEN suffix ELSE regexp_extract(left(bare, length(bare) - length(suffix) - 1), '([^.]*)$', 1) || '.' || suffix END AS domain FROM c),
             domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
             suffixes AS (SELECT suffix, '' AS root, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
             top AS (SELECT '' AS k, (sum(bad) + 1) / (sum(n) + 2) AS mean FROM suffixes),
             s1 AS (SELECT suffix AS k, mean FROM {shrunk("suffixes", "top", "root")}),
             s2 AS (SELECT domain AS k, mean FROM {shrunk("domains", "s1", "suffix")}),
             s3 AS (SELECT host, mean, weight * mean AS a, weight * (1 - mean) AS b FROM {shrunk("hosts", "s2", "domain")}),
             z AS (SELECT *, ln(a / b) AS c, sqrt(1 / a + 1 / b) AS w FROM s3),
             g AS (SELECT z.*, k, {step} * k AS t, c + w * sinh({step} * k) AS u FROM z, range(-{nodes}, {nodes} + 1) r(k)),
             f AS (SELECT host, mean, c, w, t, exp(a * u - (a + b) * (greatest(u, 0) + ln(1 + exp(-abs(u)))) - (a * c - (a + b) * (greatest(c, 0) + ln(1 + exp(-abs(c)))))) * cosh(t) AS d FROM g),
             e AS (SELECT *, sum(d) OVER (PARTITION BY host ORDER BY t) - d / 2 AS upto, sum(d) OVER (PARTITION BY host) AS total FROM f),
             x AS (SELECT host, mean, 1 / (1 + exp(-(c + w * sinh(t - {step} * (upto - {risk} * total) / d)))) AS bound FROM e WHERE upto >= {risk} * total QUALIFY row_number() OVER (PARTITION BY host ORDER BY t) = 1)
        SELECT page_id, v.host, path, rule, coalesce(ruled, CASE WHEN bound > {limit} THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS block_rate, round(bound, 6) AS bound FROM v JOIN x ON x.host = v.host"""


#: CRC-32 of a string's UTF-8 bytes: the table of its polynomial, then byte by byte.
CRC = """crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS tab)"""


def _crc32(of: str) -> str:
    """Needs crc_table in scope."""
    byte = f"list_transform(regexp_extract_all(hex({of}), '..'), lambda x: (16 * (instr('0123456789ABCDEF', x[1]) - 1) + instr('0123456789ABCDEF', x[2]) - 1)::BIGINT)"
    return f"xor(list_reduce({byte}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def op11_target_resampling(buckets: int = 10_000, percent: int = 5, least: int = 20) -> str:
    words = lambda c: f"list_filter(string_split_regex(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    runs = lambda t, i: " UNION ALL ".join(f"SELECT {i} AS i, unnest(list_transform(range(1, len(w) - {n} + 2), lambda a: array_to_string(w[a:a + {n - 1}], ' '))) AS f FROM {t}" for n in (1, 2, 3))
    return f"""
        WITH {CRC}, d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, {words("text")} AS w FROM documents), m AS (SELECT {words("text")} AS w FROM benchmark),
             df AS MATERIALIZED (SELECT i, f, count(*) AS n FROM ({runs("d", "i")}) GROUP BY 1, 2), mf AS MATERIALIZED (SELECT f, count(*) AS n FROM ({runs("m", "0")}) GROUP BY 1),
             b AS MATERIALIZED (SELECT f, {_crc32("f")} % {buckets} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM mf), crc_table),
             s AS (SELECT bucket, sum(n) AS n FROM df JOIN b USING (f) GROUP BY 1), t AS (SELECT bucket, sum(n) AS n FROM mf JOIN b USING (f) GROUP BY 1),
             a AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t_all),
             g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (s_all + {buckets}) / ((s.n::DOUBLE + 1) * (t_all + {buckets}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), a),
             x AS (SELECT i, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS weight FROM df JOIN b USING (f) JOIN g USING (bucket) GROUP BY 1),
             h AS (SELECT doc_id, len(w) AS words, coalesce(x.n, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT::DOUBLE AS h FROM d LEFT JOIN x USING (i)),
             k AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score FROM h),
             r AS (SELECT *, row_number() OVER (PARTITION BY words >= {least} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY words >= {least}) AS n FROM k)
        SELECT doc_id, n_features, weight, score, CASE WHEN words >= {least} AND place <= {percent} * n // 100 THEN place END AS rank FROM r"""


def op12_suffix_dedup(width: int = 50) -> str:
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, encode(coalesce(text, '')) AS x FROM documents),
             h AS MATERIALIZED (SELECT i, doc_id, unnest(range(0, octet_length(x) - {width} + 1)) AS pos, unnest(list_transform(range(0, octet_length(x) - {width} + 1), lambda a: hash(x[a + 1:a + {width}]))) AS k FROM d),
             m AS (SELECT k FROM h GROUP BY 1 HAVING count(*) > 1),
             p AS MATERIALIZED (SELECT i, h.doc_id, pos, x[pos + 1:pos + {width}] AS s FROM h JOIN m USING (k) JOIN d USING (i)),
             f AS (SELECT s, min(doc_id) AS first_id FROM p GROUP BY 1 HAVING count(*) > 1),
             q AS (SELECT i, pos FROM p JOIN f USING (s) WHERE coalesce(doc_id > first_id, first_id IS NOT NULL)),
             e AS (SELECT i, pos, coalesce(pos > lag(pos) OVER (PARTITION BY i ORDER BY pos) + {width}, true)::INTEGER AS fresh FROM q),
             r AS (SELECT i, min(pos) AS lo, max(pos) + {width} AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY i ORDER BY pos) AS k FROM e) GROUP BY i, k),
             g AS (SELECT i, list(lo ORDER BY lo) AS los, list(hi ORDER BY hi) AS his, sum(hi - lo)::BIGINT AS n_removed FROM r GROUP BY 1)
        SELECT doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(len(los), 0)::BIGINT AS n_spans,
               sha256(CASE WHEN los IS NULL THEN x ELSE unhex(array_to_string(list_transform(range(0, len(los) + 1), lambda k: hex(x[CASE WHEN k = 0 THEN 0 ELSE his[k] END + 1:CASE WHEN k = len(los) THEN octet_length(x) ELSE los[k + 1] END])), '')) END) AS kept_sha256
        FROM d LEFT JOIN g USING (i)"""


def op13_periodic_runs() -> str:
    return f"""
        WITH {CRC}, c AS (SELECT row_number() OVER () AS i, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc32("doc_id::VARCHAR")} END AS h FROM documents, crc_table),
             a AS (SELECT *, len(w) AS n, h // 10 % greatest(1, len(w)) AS a, h // 10 % 8 AS k FROM c),
             d AS MATERIALIZED (SELECT i, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda j: w[1 + CASE WHEN j < a THEN j ELSE a + (j - a) % (1 + (n - a) // (3 + k)) END]) ELSE w END AS w FROM a),
             u AS MATERIALIZED (SELECT i, n, unnest(w) AS x, unnest(range(n)) AS p FROM d),
             m AS MATERIALIZED (SELECT u.i, v.p - u.p AS q, u.p FROM u JOIN u v ON v.i = u.i AND v.x = u.x AND v.p > u.p AND v.p - u.p <= u.n // 4),
             o AS (SELECT i, q FROM m GROUP BY 1, 2 HAVING count(*) >= greatest(6 - q, 3 * q)),
             s AS MATERIALIZED (SELECT i, q, min(p) AS start, count(*) + q AS length FROM (SELECT m.*, p - row_number() OVER (PARTITION BY m.i, m.q ORDER BY p) AS k FROM m JOIN o ON o.i = m.i AND o.q = m.q) GROUP BY i, q, k HAVING count(*) >= greatest(6 - q, 3 * q)),
             r AS MATERIALIZED (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.i = s.i AND z.q < s.q AND z.start <= s.start AND z.start + z.length >= s.start + s.length)),
             l AS (SELECT i, count(*) AS n_runs, first(struct_pack(start, length, q) ORDER BY length DESC, start, q) AS top, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM r GROUP BY 1),
             y AS (SELECT i, string_agg(x, ' ' ORDER BY p) AS t FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.i = u.i AND u.p >= r.start + r.q AND u.p < r.start + r.length) GROUP BY 1)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.q AS period, 1000 * top.length // top.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
        FROM d LEFT JOIN l USING (i) LEFT JOIN y USING (i)"""
