"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_SPACE = r" \x09-\x0D"

SUBSTRING = rf"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS words FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS k
  FROM docs, unnest(range(1, len(words) - 48)) AS t(i)
), earliest AS MATERIALIZED (
  SELECT k, min(doc_id) AS m FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)
), gone AS MATERIALIZED (
  SELECT doc_id, list(DISTINCT i + j) AS places
  FROM (SELECT doc_id, i FROM windows JOIN earliest USING (k) WHERE doc_id > m), unnest(range(0, 50)) AS t(j)
  GROUP BY doc_id
), stay AS MATERIALIZED (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n_kept
  FROM (
    SELECT d.doc_id, unnest(d.words) AS word, unnest(range(1, len(d.words) + 1)) AS p
    FROM docs d JOIN gone USING (doc_id)
  ) JOIN gone USING (doc_id)
  WHERE NOT list_contains(places, p)
  GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words,
  CAST(coalesce(len(g.places), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN g.doc_id IS NULL THEN array_to_string(d.words, ' ') ELSE coalesce(s.kept, '') END) AS kept_sha256
FROM docs d LEFT JOIN gone g ON d.doc_id = g.doc_id LEFT JOIN stay s ON d.doc_id = s.doc_id
"""

TOP_K = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

QUALITY = rf"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines
  FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, i, words[i:i + 2] AS k FROM docs, unnest(range(1, len(words) - 1)) AS t(i)
), repeats AS MATERIALIZED (
  SELECT doc_id, count(DISTINCT i + j) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS times FROM windows), unnest(range(0, 3)) AS t(j)
  WHERE times > 1 GROUP BY doc_id
), facts AS MATERIALIZED (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[{_SPACE}]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS capitals,
    length(regexp_replace(text, '[^\p{{Ll}}]', '', 'g')) AS small,
    len(string_split(text, chr(10))) AS n_lines
  FROM docs d LEFT JOIN repeats r ON d.doc_id = r.doc_id
), judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM facts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 2 * capitals > capitals + small OR 2 * n_dup_lines > n_lines) AS kept
FROM judged
"""

JACCARD = rf"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_SPACE}]+') AS words
  FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS s
  FROM docs, unnest(range(1, greatest(len(words) - 3, 2))) AS t(i) WHERE len(words) > 0
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inner_size
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
  ) p JOIN sizes a ON a.doc_id = p.a JOIN sizes b ON b.doc_id = p.b
  WHERE 100 * inner_size >= 75 * (a.n + b.n - inner_size)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN reach r ON r.a = d.doc_id
GROUP BY d.doc_id, s.n
"""

_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LEXICAL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), sized AS MATERIALIZED (SELECT r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0
), total AS MATERIALIZED (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sized
), items AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), tf AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM items) GROUP BY r, term
), w AS MATERIALIZED (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
), scored AS (
  SELECT i.item_id, s.r, s.doc_id,
    CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * s.n * t.nd) // t.l)))) AS BIGINT) AS score
  FROM tf JOIN sized s ON s.r = tf.r JOIN w ON w.term = tf.term JOIN items i ON i.term = tf.term, total t
  GROUP BY i.item_id, s.r, s.doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

# crc32 by its table, which follows from its polynomial; then byte by byte
_CRC_TABLE = "list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(i AS BIGINT)))"
_CRC = "xor(4294967295, list_reduce({0}, lambda c, b: xor(c // 256, tab[CAST(xor(c, b) % 256 AS INTEGER) + 1]), 4294967295))"

SPELLING = rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab
), runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, {_LOWERED.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents
  ) GROUP BY doc_id, run
), spelt AS MATERIALIZED (
  SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) - 64 AS BIGINT)] END)) AS b FROM runs
), hashed AS MATERIALIZED (SELECT run, n, {_CRC.format("b")} AS h FROM spelt, crc
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n
    FROM hashed
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), places AS MATERIALIZED (
  SELECT word, n, substring(word, 1, CAST(i AS INTEGER) - 1) AS a, substring(word, CAST(i AS INTEGER) + 1) AS b FROM words, unnest(range(1, length(word) + 1)) AS t(i)
), pairs AS MATERIALIZED (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM places x JOIN places y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM places x JOIN words y ON y.word = x.a || x.b
  UNION SELECT y.word, y.n, x.word, x.n FROM places x JOIN words y ON y.word = x.a || x.b
), best AS MATERIALIZED (
  SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word, n
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form,
    CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), chain AS (
  SELECT word, coalesce(form, word) AS reached, 0 AS k FROM forms
  UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.reached WHERE f.form IS NOT NULL
), roots AS MATERIALIZED (SELECT word, arg_max(reached, k) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word
"""


def _draws(generations: list[tuple[int, list[int]]], name: str) -> str:
    """SQL for the shard of ``key`` by the hash tree of ``shards.even``: lists of (draw, node), level by level."""

    def step(children: str) -> str:
        u = "(CAST('0x' || substr(md5(key || '|' || c.name), 1, 8) AS BIGINT) + 0.5) / 4294967296.0"
        return f"list_min(list_transform({children}, lambda c: {{'draw': -ln({u}) / c.weight, 'name': c.name}})).name"

    below: dict[str, dict[str, float]] = {}
    for generation, numbers in generations:
        for s in numbers:
            region, rack = f"g{generation}r{s % 8 % 4}", f"g{generation}r{s % 8 % 4}k{s % 8}"
            for node, child in (("root", region), (region, rack), (rack, f"{rack}s{s}")):
                below.setdefault(node, {})[child] = below.get(node, {}).get(child, 0.0) + 1.0

    def listed(node: str) -> str:
        return "[" + ", ".join(f"{{'name': '{c}', 'weight': {w}}}" for c, w in below[node].items()) + "]"

    regions = list(below["root"])
    racks = [k for r in regions for k in below[r]]

    def chosen(nodes: list[str], at: str) -> str:
        return "CASE " + " ".join(f"WHEN {at} = '{n}' THEN {listed(n)}" for n in nodes) + " END"

    return f"""{name}_region AS MATERIALIZED (SELECT *, {step(listed("root"))} AS region FROM facts),
{name}_rack AS MATERIALIZED (SELECT *, {step(chosen(regions, "region"))} AS rack FROM {name}_region),
{name} AS MATERIALIZED (SELECT r, CAST(regexp_extract({step(chosen(racks, "rack"))}, '[0-9]+$') AS INTEGER) AS s FROM {name}_rack)"""


SHARDS = rf"""
WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
bytes AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) AS n,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents
), facts AS MATERIALIZED (
  SELECT r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, CAST(n + 16 AS BIGINT) AS size, {_CRC.format("b")} AS text_crc32 FROM bytes, crc
),
{_draws([(0, list(range(40)))], "now")},
{_draws([(0, list(range(40))), (1, [40])], "grown")}
SELECT f.doc_id, f.size, f.text_crc32, 'key' AS law, n.s AS shard,
  row_number() OVER (PARTITION BY n.s ORDER BY CAST('0x' || substr(md5(f.key), 1, 8) AS BIGINT) % 1024, f.key, f.size, f.text_crc32, g.s) - 1 AS slot,
  g.s AS grown_shard
FROM facts f JOIN now n ON n.r = f.r JOIN grown g ON g.r = f.r
"""

ORACLES = {
    "op1_substring_dedup": SUBSTRING,
    "op2_top_k": TOP_K,
    "op8_quality_rules": QUALITY,
    "op10_jaccard_join": JACCARD,
    "op11_lexical_search": LEXICAL,
    "op12_spelling_variants": SPELLING,
    "op13_sharding": SHARDS,
}
