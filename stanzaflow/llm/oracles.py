"""DuckDB SQL of the queries that SQL can express, written from the queries' contracts and not from the operators' code.

The others have none: op1 and op4 need a vocabulary's merges, op3 and op5 random draws by a hash DuckDB lacks, op6 and op10 trained models, op7 an approximate
index; the pipeline holds two of these. tests/llm compares each with a brute-force version, an exact round trip or held-out truth.
"""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"

#: Word-shingle sets by inverted lists, components by a closure over the links.
NEAR_DEDUP = rf"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN generate_series(1, len(w) - 2)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (SELECT doc_id, doc_id AS got FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.got),
least AS (SELECT doc_id, min(got) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""

_METRICS = {
    "symbol_pm": "n_symbols * 1000 // greatest(n_words, 1)", "bang_pm": "(length(t) - length(replace(t, '!', ''))) * 1000 // greatest(n_words, 1)",
    "dup_line_pm": "n_dup_lines * 1000 // greatest(n_lines, 1)", "repeat_pm": "n_repeat_words * 1000 // greatest(n_words, 1)",
    "upper_pm": "(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) * 1000 // greatest(word_chars, 1)", "word_len_c": "word_chars * 100 // greatest(n_words, 1)",
}
_STEP = {"symbol_pm": (1000, "n_words"), "bang_pm": (1000, "n_words"), "dup_line_pm": (1000, "n_lines"), "repeat_pm": (6000, "n_words"), "upper_pm": (1000, "word_chars"), "word_len_c": (100, "n_words")}


def _tenths(level: str, key: str) -> str:
    keys = key + ", " if key else ""
    at = ", ".join(f"min(bucket) FILTER (10 * upto >= {q} * total) AS q{q}" for q in (1, 5, 9))
    return f"""{level} AS (SELECT {keys}metric, max(total) AS total, {at} FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}metric) AS total
  FROM (SELECT {keys}metric, bucket, count(*) AS n FROM long GROUP BY ALL)) GROUP BY {keys}metric)"""


def _drawn(own: str, above: str, on: str) -> str:
    at = ", ".join(f"(o.total * o.q{q} + 30 * a.q{q}) // (o.total + 30) AS q{q}" for q in (1, 5, 9))
    return f"{own}_drawn AS (SELECT o.* EXCLUDE (q1, q5, q9), {at} FROM {own} o JOIN {above} a ON o.metric = a.metric {on})"


#: Counts by unnesting, the groups' sketches as histograms, the levels by three groupings.
QUALITY_RULES = rf"""WITH
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, {_WORD}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS l FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY rid),
c AS (SELECT w.* EXCLUDE (w, l), len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {', '.join(f'{v} AS {k}' for k, v in _METRICS.items())} FROM c),
long AS (SELECT lang, source, metric, CASE WHEN x < 128 THEN x ELSE (x >> (length(bin(x)) - 7)) << (length(bin(x)) - 7) END AS bucket
  FROM (UNPIVOT (SELECT lang, source, {', '.join(f'({k})::BIGINT AS {k}' for k in _METRICS)} FROM m WHERE NOT base_failed) ON {', '.join(_METRICS)} INTO NAME metric VALUE x)),
{_tenths('grp', 'lang, source')}, {_tenths('lng', 'lang')}, {_tenths('total', '')},
{_drawn('lng', 'total', '')}, {_drawn('grp', 'lng_drawn', 'AND o.lang IS NOT DISTINCT FROM a.lang')},
v AS (SELECT m.rid, bool_and(CASE f.metric {' '.join(f"WHEN '{k}' THEN m.{k} BETWEEN f.q1 - 3 * (f.q5 - f.q1) - s.{k} AND f.q9 + f.q9 // 64 + 3 * (f.q9 - f.q5) + s.{k}" for k in _METRICS)} END) AS inside
  FROM m JOIN grp_drawn f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
  JOIN (SELECT rid, {', '.join(f'({one} + greatest({of}, 1) - 1) // greatest({of}, 1) AS {k}' for k, (one, of) in _STEP.items())} FROM m) s ON s.rid = m.rid GROUP BY m.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, false) AS kept FROM m LEFT JOIN v USING (rid)"""

#: kind -> pattern, least length, what the length is measured on. Names in either case letter by letter, as case folding would let in letters beyond ASCII.
_NAME = "|".join("".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""(?:{_NAME})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = {
    "assign": (_ASSIGN, 12, 1), "access": ("AKIA[A-Z0-9]+", 18, 0), "hex": ("[0-9a-f]+", 16, 0),
    "pem": (r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?", 32, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, 0), "forge": (r"(?:ghp|gho|ghs|ghu|glpat|xox[abpr])[_-][A-Za-z0-9_-]+", 20, 0),
}


def _spans(order: int, kind: str) -> str:
    """Matches marked by characters 1 and 2, cut there; a match starts where the pieces before it end."""
    pattern, least, group = _SECRETS[kind]
    q = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT rid, {order} AS o, '{kind}' AS kind, pos, pos + length(hit) AS til FROM (SELECT rid, k, split_part(piece, chr(2), 1) AS hit, (sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY rid ORDER BY k) - length(replace(piece, chr(2), '')))::BIGINT AS pos
  FROM (SELECT rid, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (SELECT rid, string_split(regexp_replace(t, {q}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS p FROM d))) WHERE k > 1 AND length(regexp_extract(hit, {q}, {group})) >= {least}"""


_LINE = "coalesce(string_agg(kind || ':' || pos || ':' || til, ',' ORDER BY pos, o){}, '')"
SECRET_SCANS = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_spans(o, k) for o, k in enumerate(_SECRETS))}),
f AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ('assign', 'access', 'hex'))}, {_LINE.format(' FILTER (o < 3)')} AS base, {_LINE.format('')} AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (rid)"""


#: The loops by the checksum's own definition, runs as islands of equal words at each distance, of those over one stretch the one of least period.
PERIODIC_RUNS = rf"""WITH
tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w, xor(4294967295, list_reduce(list_prepend(4294967295, [ord(x) FOR x IN string_split(doc_id::VARCHAR, '')]),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h FROM documents, tab),
g AS (SELECT *, h // 10 AS g, len(w) AS n FROM d), a AS (SELECT *, g % n AS a FROM g), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
x AS (SELECT rid, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(n)] ELSE w END AS w FROM p),
t AS (SELECT rid, unnest(w) AS v, generate_subscripts(w, 1) - 1 AS i FROM x),
met AS (SELECT l.rid, r.i - l.i AS q, l.i FROM t l JOIN t r ON l.rid = r.rid AND l.v = r.v AND r.i > l.i),
isle AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS isle FROM met) GROUP BY rid, q, isle HAVING length >= greatest(12, 2 * q)),
runs AS (SELECT rid, start, length, min(q) AS period FROM isle GROUP BY ALL),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, period) = 1),
told AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM runs GROUP BY rid),
kept AS (SELECT rid, string_agg(v, ' ' ORDER BY i) AS words FROM t WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.rid = t.rid AND t.i >= r.start + r.period AND t.i < r.start + r.length) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256 FROM x LEFT JOIN best USING (rid) LEFT JOIN told USING (rid) LEFT JOIN kept USING (rid)"""

_TEST_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows as word lists, joined; hit words one by one.
DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TEST_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_TEST_WORDS} AS w FROM benchmark), s AS (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
tests AS (SELECT DISTINCT item, n, unnest([w[i:i + n - 1] FOR i IN range(1, len(w) - n + 2)]) AS x FROM s),
win AS (SELECT rid, n, i, w[i:i + n - 1] AS x FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM tests) WHERE len(w) >= n)),
hit AS (SELECT rid, i, n, item FROM win JOIN tests USING (n, x)),
marked AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
held AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN held USING (rid)"""


def _lloyd(k: int = 8, rounds: int = 10) -> str:
    """Full scans, a round after the other; distance and number packed in one integer give the least distance and of ties the smaller number."""
    near = lambda r: f"o{r} AS MATERIALIZED (SELECT rid, (m % {k})::BIGINT AS k, m // {k} AS d FROM (SELECT rid, min(d * {k} + k) AS m FROM (SELECT rid, k, sum((x - y) * (x - y)) AS d FROM x JOIN c{r} USING (j) GROUP BY rid, k) GROUP BY rid))"
    mean = lambda r: f"""c{r + 1} AS MATERIALIZED (SELECT c.k, c.j, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, c.y) AS y FROM c{r} c
  LEFT JOIN (SELECT k, j, sum(x) AS s, count(*) AS n FROM x JOIN o{r} USING (rid) GROUP BY k, j) USING (k, j))"""  # noqa: E731
    steps = ",\n".join(f"{near(r)},\n{mean(r)}" for r in range(rounds))
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM v),
c0 AS MATERIALIZED (SELECT k, unnest(v) AS y, generate_subscripts(v, 1) AS j FROM (SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS k FROM v) WHERE k < {k}),
{steps},
{near(rounds)},
i AS (SELECT k, sum(d) AS inertia FROM o{rounds} GROUP BY k),
h AS (SELECT k, sha256(string_agg(y::VARCHAR, ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, i.inertia::BIGINT AS cluster_inertia, (SELECT sum(inertia) FROM i)::BIGINT AS inertia, h AS centroid_sha256 FROM o{rounds} JOIN v USING (rid) JOIN i USING (k) JOIN h USING (k)"""


CLUSTERING = _lloyd()


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_dedup": NEAR_DEDUP, "op8_quality_rules": QUALITY_RULES, "op9_secret_scans": SECRET_SCANS, "op11_periodic_runs": PERIODIC_RUNS, "op12_decontamination": DECONTAMINATION,
        "op13_clustering": CLUSTERING,
    }
