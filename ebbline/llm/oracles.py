"""DuckDB SQL of the queries, written independently of the Spark plans."""

from __future__ import annotations

from . import licenses, quality

UP, LOW = licenses.UPPER, licenses.LOWER
_q = lambda s: "'" + s.replace("'", "''") + "'"


def quality_sql(risk: float = 0.02, error: float = 0.05) -> str:
    tests = [(s, c) for s, cs in quality.CUTOFFS.items() for c in cs]
    score = {s: e.replace(" DIV ", " // ") for s, e in quality.SCORES.items()}
    part = risk / len(quality.SCORES)
    return f"""
    WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, lang, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
    c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY 1),
    f AS (SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words,
                 CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
                 CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(f"{e} AS s_{s}" for s, e in score.items())} FROM f),
    good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING max(quality) = 1),
    k AS ({" UNION ALL ".join(f"SELECT lang, '{s}' AS score, {c} AS cutoff, count(*) AS n, count(*) FILTER (s_{s} >= {c}) AS k FROM b SEMI JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY 1" for s, c in tests)}),
    m AS (SELECT count(*) AS strata FROM (SELECT DISTINCT lang FROM k)),
    p AS (SELECT lang, score, min(cutoff) AS cutoff FROM k, m WHERE k < n * {part!r} AND
          list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i < 1 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({part!r}) + (n - i) * ln(1 - {part!r})))) <= {error!r} / (strata * {len(tests)}) GROUP BY 1, 2)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND {" AND ".join(f"coalesce(s_{s} < (SELECT cutoff FROM p WHERE score = '{s}' AND p.lang IS NOT DISTINCT FROM b.lang), true)" for s in score)} AS kept
    FROM b"""


def license_sql(threshold: float = 0.8) -> str:
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + {len(p.split())}] = [{', '.join(map(_q, p.split()))}])) AS place, {_q(label)} AS label FROM w" for p, label in licenses.PHRASES.items()
    )
    templates = ", ".join(f"({_q(label)}, [{', '.join(map(_q, sorted(set(t.split()))))}])" for label, t in licenses.TEMPLATES)
    return f"""
    WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
    p AS ({phrases}),
    b AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, list_distinct(list(label)) AS labels FROM p GROUP BY 1),
    l AS (SELECT doc_id, list_distinct(string_split_regex(translate(line, '{UP}', '{LOW}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS s FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
    t AS (SELECT * FROM (VALUES {templates}) AS t(label, words)),
    m AS (SELECT doc_id, label, max(len(list_intersect(s, words)) / len(words)) AS c FROM l, t WHERE len(list_intersect(s, words)) >= ceil(len(words) * {threshold} - 1e-9) GROUP BY 1, 2),
    o AS (SELECT doc_id, list(label) AS labels, max(c) AS c FROM m GROUP BY 1)
    SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
           coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(o.labels, [])))), ','), '') AS labels,
           CAST(greatest(CASE WHEN n > 0 THEN 1 ELSE 0 END, coalesce(o.c, 0)) AS DOUBLE) AS score
    FROM w LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id)"""


SECRET_KINDS = (("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))


def secret_sql() -> str:
    def kind(k: int, name: str, pattern: str, group: int, least: int) -> str:
        return f"""SELECT doc_id, {k} AS rank, '{name}' AS kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS place, length(m[i]) AS n
            FROM (SELECT doc_id, g, m, h, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, {_q(pattern)}) AS g, regexp_extract_all(t, {_q(pattern)}, 0) AS m, regexp_extract_all(t, {_q(pattern)}, {group}) AS h
                  FROM d WHERE regexp_matches(t, {_q(pattern)}))) WHERE length(h[i]) >= {least}"""

    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    s AS ({" UNION ALL ".join(kind(k, *x) for k, x in enumerate(SECRET_KINDS))}),
    a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                 string_agg(kind || ':' || CAST(place AS BIGINT) || ':' || CAST(place + n AS BIGINT), ',' ORDER BY place, rank) AS spans FROM s GROUP BY 1)
    SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


SQL = {
    "op1_url_filter": """
        WITH r AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) AS r(h, p, v)),
        u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
        x AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        f AS (SELECT page_id, host, path, h || p AS rule, v FROM x, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
        b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM f GROUP BY 1)
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM x LEFT JOIN b USING (page_id)""",
    "op2_quality_rules": quality_sql(),
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS f FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN f IS NULL OR f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN f <> page_id THEN f END AS refers_to
        FROM f""",
    "op6_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
        n AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op7_secret_scan": secret_sql(),
    "op8_license_scan": license_sql(),
}
