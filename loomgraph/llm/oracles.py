"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from loomgraph.llm.decontaminate import WINDOW
from loomgraph.llm.quality_rules import RULES, STOP_WORDS
from loomgraph.llm.sharding import HASH_BITS, LIMIT

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}') AS w FROM benchmark),
b2 AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM b2, unnest(range(1, len(w) - k + 2)) u(i)),
ks AS (SELECT DISTINCT k FROM b2),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, unnest(range(1, len(w) - k + 2)) u(i)),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN iw USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + k)) u(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""



def sharding(limit: int) -> str:
    """Shards of rows by the shortest hash prefix whose rows fit the limit; equal rows that do not are dealt to pages."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS row_bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, 'null'))), 1, {HASH_BITS // 4}) AS BIGINT) AS h
           FROM documents),
paths AS (SELECT r, doc_id, h, row_bytes, b, h >> ({HASH_BITS} - b) AS p FROM d, unnest(range(0, {HASH_BITS + 1})) u(b)),
sums AS (SELECT b, p, CAST(sum(row_bytes) AS BIGINT) AS shard_bytes, count(*) AS n FROM paths GROUP BY b, p),
first AS (SELECT r, doc_id, h, row_bytes, b, p, n, shard_bytes, row_number() OVER (PARTITION BY r ORDER BY b) AS rn
          FROM paths JOIN sums USING (b, p) WHERE shard_bytes <= {limit} OR b = {HASH_BITS}),
paged AS (SELECT *, shard_bytes > {limit} AS over, greatest(1, {limit} // greatest(row_bytes, 1)) AS room,
                 row_number() OVER (PARTITION BY h ORDER BY r) - 1 AS place FROM first WHERE rn = 1)
SELECT doc_id, CASE WHEN b = 0 THEN 'root' ELSE lpad(bin(p), CAST(b AS INTEGER), '0') END || CASE WHEN over THEN '-' || (place // room) ELSE '' END AS shard_id,
       CAST(b AS BIGINT) AS shard_bits, row_bytes,
       CAST(CASE WHEN over THEN least(room, n - (place // room) * room) * row_bytes ELSE shard_bytes END AS BIGINT) AS shard_bytes
FROM paged
"""


SHARDING = sharding(LIMIT)

_FAILS = ", ".join(
    f"CASE WHEN {r.whole} > 0 AND NOT (1000 * {r.part} BETWEEN {r.least} * {r.whole} AND {r.most} * {r.whole}) THEN '{r.name}' END" for r in RULES
)
QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) u(i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, unnest(range(0, 3)) u(k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(t) - len(regexp_extract_all(t, '[\\x20\\x09-\\x0D]')) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(list_filter(w, lambda x: list_contains({STOP_WORDS}, lower(x)))) AS BIGINT) AS n_stop_words
      FROM w LEFT JOIN cov USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {_FAILS}) AS failed_rules FROM m)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM v
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, t.b FROM r JOIN both_ways t ON r.b = t.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""

_CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc_table"""


def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of ``text``, where ``crc_table`` is in scope."""
    code = f"list_transform(range(strlen({text})), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {code}), lambda c, b: xor(crc_table[(xor(c, b) & 255) + 1], c >> 8)))"


PERIODIC = f"""
WITH crc AS ({_CRC_TABLE}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
h AS (SELECT r, CAST(len(w) AS BIGINT) AS n, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM d, crc),
a AS (SELECT *, (h // 10) % n AS a FROM h WHERE h % 10 = 0 AND n > 0),
p AS (SELECT r, a, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS MATERIALIZED (SELECT r, doc_id, CASE WHEN p IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w
      FROM d LEFT JOIN p USING (r)),
x AS MATERIALIZED (SELECT r, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS v FROM t),
same AS (SELECT x.r, y.i - x.i AS q, x.i FROM x JOIN x y ON x.r = y.r AND x.v = y.v AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM same) GROUP BY r, q, g),
run AS (SELECT r, start, length, min(q) AS period FROM island WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
best AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY r),
top AS (SELECT x.* FROM run x WHERE NOT EXISTS (SELECT 1 FROM run y WHERE y.r = x.r
        AND (y.length * x.period > x.length * y.period OR y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period)))),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT r, string_agg(v, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (r) LEFT JOIN top USING (r) LEFT JOIN kept USING (r)
"""

SPELLING = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
raw AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all({_LOWER.format('text')}, '[A-Za-z\u00C0-\u00FF]+')) AS v FROM documents),
each AS (SELECT id, v, count(*) AS c FROM raw GROUP BY id, v),
coded AS (SELECT v, c, {_crc32("id || ':' || v")} AS h FROM each, crc),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(v, 1, h % length(v)) || substr(v, h % length(v) + 2) ELSE v END AS word, c FROM coded),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS k FROM words, unnest(range(length(word))) u(i)),
near AS MATERIALIZED (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
    UNION SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON l.k = w.word
    UNION SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON l.k = w.word),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near),
forms AS MATERIALIZED (SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form,
                 CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
          FROM words w LEFT JOIN best b ON b.word = w.word AND place = 1),
chain AS (SELECT word, word AS root, form FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.form)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""

SEARCH = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.w, b.w) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.r <> b.r),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""
