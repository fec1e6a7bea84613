"""SQL (for DuckDB) that gives the rows of the registered queries, where SQL can express them on whole tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_COVERS = (5, 6, 7, 8, 9, 10)
_MOST = {5: 150, 6: 140, 7: 130, 8: 120, 9: 110, 10: 100}


def _inside(n: int) -> str:
    """k, i: words of row k that lie in a window of n words found twice and more in the row."""
    return f"""g{n} AS (SELECT k, i, list_slice(w, i, i + {n - 1}) AS g FROM (SELECT k, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n})),
r{n} AS (SELECT DISTINCT k, unnest(range(i, i + {n})) AS i FROM (SELECT k, i FROM g{n} QUALIFY count(*) OVER (PARTITION BY k, g) > 1))"""


OP6 = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
{", ".join(_inside(n) for n in (3, *_COVERS))},
l AS (SELECT k, n, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words, list_sum(list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), lambda x: length(x))) AS chars
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d)),
again AS (SELECT k, chars, row_number() OVER (PARTITION BY k, line ORDER BY n) AS nth FROM l WHERE words > 0),
dup AS (SELECT k, count(*) AS n, sum(chars) AS chars FROM again WHERE nth > 1 GROUP BY k),
{", ".join(f"c{n} AS (SELECT r.k, sum(length(w[i])) AS c FROM r{n} r JOIN d ON r.k = d.k GROUP BY r.k)" for n in _COVERS)},
x AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(dup.chars, 0) AS BIGINT) AS dup_line_chars, {", ".join(f"CAST(coalesce(c{n}.c, 0) AS BIGINT) AS cover_{n}" for n in _COVERS)}
  FROM d LEFT JOIN dup ON d.k = dup.k LEFT JOIN (SELECT k, count(*) AS n FROM r3 GROUP BY k) r ON d.k = r.k {" ".join(f"LEFT JOIN c{n} ON d.k = c{n}.k" for n in _COVERS)}),
y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT *, NOT base_failed AND 1000 * dup_line_chars <= 300 * word_chars AND {" AND ".join(f"1000 * cover_{n} <= {m} * word_chars" for n, m in _MOST.items())} AS kept FROM y"""

OP7 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
b AS (SELECT html, max(page_id) AS best FROM p WHERE n >= 1000 AND page_id IS NOT NULL GROUP BY html)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id < best THEN best END AS refers_to
FROM p LEFT JOIN b ON p.html = b.html"""

OP2 = f"""WITH RECURSIVE d AS (SELECT doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2)) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 90 * greatest(na.n, nb.n) GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(na.n) + any_value(nb.n) - count(*))),
walk AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT walk.doc_id, e.b FROM walk JOIN e ON walk.reach = e.a)
SELECT walk.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach) AS component_id FROM walk LEFT JOIN n ON n.doc_id = walk.doc_id GROUP BY walk.doc_id"""


def _doubled(have: int, step: int, of: str, to: str) -> str:
    """Strings of have + step bytes from strings of have bytes at each position; null where the text ends."""
    return f"{to} AS (SELECT doc_id, i, n, g || right(lead(g, {step}) OVER (PARTITION BY doc_id ORDER BY i), {2 * step}) AS g FROM {of})"


OP10 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
b1 AS (SELECT doc_id, generate_subscripts(l, 1) AS i, len(l) AS n, unnest(l) AS g FROM (SELECT doc_id, regexp_extract_all(h, '..') AS l FROM d)),
{_doubled(1, 1, "b1", "b2")}, {_doubled(2, 2, "b2", "b4")}, {_doubled(4, 4, "b4", "b8")}, {_doubled(8, 8, "b8", "b16")}, {_doubled(16, 16, "b16", "b32")}, {_doubled(32, 18, "b32", "b50")},
least AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS owner FROM (SELECT doc_id, i, md5_number(g) AS g FROM b50 WHERE i + 49 <= n)),
gone AS (SELECT doc_id, i, max(i) FILTER (hit) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS last FROM (SELECT b1.doc_id, b1.i, coalesce(owner < b1.doc_id, false) AS hit FROM b1 LEFT JOIN least ON least.doc_id = b1.doc_id AND least.i = b1.i)),
cut AS (SELECT doc_id, i, coalesce(last + 49 >= i, false) AS cut FROM gone),
runs AS (SELECT doc_id, i, cut, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM cut),
x AS (SELECT r.doc_id, count(*) AS n_bytes, count(*) FILTER (cut) AS n_removed, count(*) FILTER (first) AS n_spans, sha256(unhex(coalesce(string_agg(g, '' ORDER BY r.i) FILTER (NOT cut), ''))) AS kept_sha256 FROM runs r JOIN b1 ON b1.doc_id = r.doc_id AND b1.i = r.i GROUP BY r.doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN x ON x.doc_id = d.doc_id"""

ORACLES = {"op2_ngram_join": OP2, "op6_quality_rules": OP6, "op7_warc": OP7, "op10_suffix_dedup": OP10}
