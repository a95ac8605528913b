"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from trialytics.llm.queries import MIX_TARGETS

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE t END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, w.doc_id) AS component_id, coalesce(c.component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

LINES = r"""
WITH a AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
x AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM a),
y AS (SELECT doc_id, pos, regexp_replace(line, '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g') AS line FROM x),
z AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^ \t\x0B\f\r]+')) AS n FROM y WHERE line <> ''),
k AS (SELECT doc_id, pos, md5(line) AS h, n, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM z),
f AS (SELECT doc_id, sum(n) OVER w AS n, min(pos) OVER w AS first, max(pos) OVER w AS last, array_to_string(list(h) OVER w, '') AS content
      FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY upto - n RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
      UNION
      SELECT doc_id, sum(n) OVER w, min(pos) OVER w, max(pos) OVER w, array_to_string(list(h) OVER w, '')
      FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
d AS (SELECT doc_id, first, last FROM (SELECT *, rank() OVER (PARTITION BY content ORDER BY doc_id, first) AS r FROM f WHERE n >= 50) WHERE r > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM d),
o AS (SELECT x.doc_id, count(g.pos) AS gone, coalesce(string_agg(x.line, chr(10) ORDER BY x.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
      FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.pos = g.pos GROUP BY x.doc_id)
SELECT a.doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CASE WHEN a.text IS NULL THEN NULL ELSE sha256(o.kept) END AS kept_sha256
FROM a LEFT JOIN o USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def mixing(targets: dict, fraction: float, rounds: int = 20) -> str:
    """The raking as a chain of common table expressions, a step for each side and round."""
    ctes = [
        r"""d AS (SELECT doc_id, coalesce(source, '(none)') AS s, coalesce(lang, '(none)') AS l,
  CASE WHEN contains(lower(coalesce(text, '')), 'license') THEN 'legal' WHEN contains(coalesce(text, ''), '@') THEN 'contact' WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'numeric' ELSE 'prose' END AS t,
  coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) + 1 AS tokens FROM documents)""",
        "c AS MATERIALIZED (SELECT s, l, t, CAST(sum(tokens) AS DOUBLE) AS n FROM d GROUP BY ALL)",
    ]
    for side, name in (("s", "source"), ("l", "lang"), ("t", "topic")):
        target = targets[name]
        counts = f"(SELECT {side} AS v, sum(n) AS n FROM c GROUP BY 1)"
        if isinstance(target, dict):
            given = " ".join(f"WHEN '{k}' THEN {v!r}e0" for k, v in target.items())
            listed = ", ".join(f"'{k}'" for k in target)
            ctes.append(f"""g_{side} AS MATERIALIZED (SELECT v, CASE v {given} ELSE greatest(0, 1 - (SELECT coalesce(sum(CASE v {given} END), 0) FROM {counts})) * n / (SELECT sum(n) FROM {counts} WHERE v NOT IN ({listed})) END AS w FROM {counts})""")
        else:
            ctes.append(f"g_{side} AS MATERIALIZED (SELECT v, pow(n, {float(target)!r}e0) AS w FROM {counts})")
        ctes.append(f"h_{side} AS MATERIALIZED (SELECT v, w / (SELECT sum(w) FROM g_{side}) AS w FROM g_{side})")
    ctes.append("r0 AS MATERIALIZED (SELECT s, l, t, n, n / (SELECT sum(n) FROM c) AS w FROM c)")
    step = 0
    for _ in range(rounds):
        for side in "slt":
            ctes.append(f"r{step + 1} AS MATERIALIZED (SELECT s, l, t, n, r.w * h.w / sum(r.w) OVER (PARTITION BY r.{side}) AS w FROM r{step} r JOIN h_{side} h ON r.{side} = h.v)")
            step += 1
    ctes += [
        f"m AS MATERIALIZED (SELECT s, l, t, n, w / (n / (SELECT sum(n) FROM c)) AS m FROM r{step})",
        f"q AS MATERIALIZED (SELECT m, ({fraction!r} * (SELECT sum(n) FROM c) - coalesce(sum(n) OVER (ORDER BY m DESC, s, l, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(n * m) OVER (ORDER BY m DESC, s, l, t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM m)",
        "k AS (SELECT max(m) AS m, arg_max(scale, m) AS scale FROM q WHERE scale * m <= 1)",
        f"p AS (SELECT s, l, t, least(1, m.m * coalesce(k.scale, 1e300)) AS p, {fraction!r} * m.m AS f FROM m, k)",
    ]
    return "WITH " + ",\n".join(ctes) + """
SELECT doc_id, t AS topic, tokens, round(p, 9) AS probability, round(f / p, 9) AS weight,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0e0 < p AS kept
FROM d JOIN p USING (s, l, t)"""


QUALITY = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || source, '-') AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, h, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
three AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS i FROM three WHERE n > 1) GROUP BY doc_id),
lines AS MATERIALIZED (SELECT doc_id, h, regexp_replace(array_to_string(regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' '), '[0-9]+', '0', 'g') AS l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, h, unnest(ls) AS l FROM w)),
common AS (SELECT h, l FROM (SELECT h, l, count(DISTINCT doc_id) AS n FROM lines GROUP BY h, l) JOIN (SELECT h, count(*) AS docs FROM w GROUP BY h) USING (h) WHERE n > 5 AND 100 * n > 10 * docs),
lost AS (SELECT doc_id, sum(n) AS n FROM lines SEMI JOIN common USING (h, l) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_common_words FROM w LEFT JOIN again USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, base_failed = false AND 2 * n_common_words <= n_words AS kept FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
"""

ORACLES: dict[str, str] = {"op4_exact_topk": TOPK, "op5_minhash_dedup": NEAR, "op7_line_dedup": LINES, "op9_warc": WARC, "op10_mixing": mixing(MIX_TARGETS, 0.5), "op11_quality_rules": QUALITY}
