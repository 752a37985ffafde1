"""The query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import url_rules
from .html_mincut import op2_html_mincut
from .importance import op12_importance
from .jaccard_join import op3_jaccard_join
from .katz import op6_katz
from .lexicon_bpe import op5_lexicon_bpe
from .line_dedup import op11_line_dedup
from .mixing import op4_mixing
from .packed_tokens import op1_packed_tokens
from .robust_quality import op10_robust_quality
from .scaled_sketch import op9_scaled_sketch
from .suffix_dedup import op8_suffix_dedup
from .url_rules import op7_url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packed_tokens, op2_html_mincut, op3_jaccard_join, op4_mixing, op5_lexicon_bpe, op6_katz, op7_url_rules, op8_suffix_dedup, op9_scaled_sketch, op10_robust_quality, op11_line_dedup, op12_importance)}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "[^\\x20\\x09-\\x0D]+"


def _quoted(x: object) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def _url_sql() -> str:
    """Host rules by a ladder from the longest, pattern rules all tried."""
    hosts = sorted(url_rules.HOST_RULES, key=lambda r: -len(r[1]))
    ladder = ["CASE", "CASE"]
    for verdict, text in hosts:
        h, _, p = text.partition("/")
        fits = f" WHEN (host = {_quoted(h)} OR ends_with(host, {_quoted('.' + h)})) AND starts_with(path, {_quoted('/' + p)}) THEN "
        ladder = [ladder[0] + fits + _quoted(text), ladder[1] + fits + _quoted(verdict)]
    rules = ", ".join(f"({_quoted(r.text)}, {r.allow}, {_quoted(r.regex)})" for r in map(url_rules.parse_pattern, url_rules.PATTERN_RULES))
    return f"""WITH u AS (SELECT page_id, lower(coalesce(url, '')) AS low, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
    h AS (SELECT page_id, low, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
    j AS (SELECT *, {ladder[0]} END AS rule, {ladder[1]} END AS verdict, row_number() OVER () AS id FROM h),
    m AS (SELECT id, min(t) FILTER (allow) AS a, min(t) FILTER (NOT allow) AS b FROM j JOIN (VALUES {rules}) r(t, allow, re) ON j.rule IS NULL AND regexp_matches(low, re) GROUP BY id)
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN a IS NULL AND b IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, coalesce(a, b) AS pattern FROM j LEFT JOIN m USING (id)"""


_JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORDS}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT doc_id, unnest(s) AS g FROM s), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""

_SHARE = "least(1.0, ({k} * source_size + before + p{k} / 2.0) / greatest(target, 1e-9))"
_PLACE = "CASE WHEN p{k} > 0 THEN CASE place WHEN 0 THEN {s} WHEN 1 THEN (sqrt(0.25 + 2 * {s}) - 0.5) ELSE (sqrt(2.25 - 2 * {s}) - 1.5) / -1 END END"
_MIX_SQL = f"""WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS skey, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS BIGINT) AS size,
CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
b AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey), q AS (SELECT *, (row_number() OVER (ORDER BY skey) - 1) % 3 AS place FROM b),
c AS (SELECT *, CAST([3, 1, 2][place + 1] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget FROM q),
o AS (SELECT *, cap / w AS ratio, coalesce(sum(cap) OVER x, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER x, 0) AS rest FROM c WINDOW x AS (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (budget - capped) / rest AS own FROM o), l AS (SELECT first(own ORDER BY ratio, skey) AS level FROM v WHERE own <= ratio),
t AS (SELECT skey, source_size, place, least(cap, coalesce(level * w, cap)) AS target FROM v CROSS JOIN l),
f AS (SELECT d.*, source_size, place, target, CAST(round(target) AS BIGINT) AS aim, sum(size) OVER (PARTITION BY skey ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN t USING (skey)),
p AS (SELECT *, greatest(0, least(size, aim - before)) AS p0, greatest(0, least(size, aim - source_size - before)) AS p1 FROM f),
z AS (SELECT *, row_number() OVER () AS r, CAST({_PLACE.format(k=0, s=_SHARE.format(k=0))} AS DOUBLE) AS first, CAST({_PLACE.format(k=1, s=_SHARE.format(k=1))} AS DOUBLE) AS second FROM p),
y AS (SELECT r, doc_id, size, 0 AS turn, coalesce(first, 2) AS moment, p0 AS words FROM z UNION ALL SELECT r, doc_id, size, 1, second, p1 FROM z WHERE p1 > 0),
s AS (SELECT r, turn, sum(words) OVER (ORDER BY moment, doc_id NULLS FIRST, size, turn ROWS UNBOUNDED PRECEDING) - words AS start FROM y)
SELECT doc_id, size, source_size, target, CAST(p0 + p1 AS BIGINT) AS taken, round(first, 6) AS first, round(second, 6) AS second, CAST(CASE WHEN p0 > 0 THEN start END AS BIGINT) AS start FROM z JOIN s USING (r) WHERE turn = 0"""

_PASSAGE_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
i AS (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50), w AS (SELECT doc_id, i, substr(x, CAST(2 * i + 1 AS BIGINT), 100) AS g FROM i), f AS (SELECT g, min(doc_id) AS f FROM w GROUP BY g),
c AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (g) WHERE f < doc_id),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c) GROUP BY doc_id, run),
k AS (SELECT doc_id, x, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r JOIN d USING (doc_id)),
o AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(x, CAST(2 * z + 1 AS BIGINT), CAST(2 * (a - z) AS BIGINT)), '' ORDER BY a) AS head, max(b) AS tail FROM k GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE head || substr(x, CAST(2 * tail + 1 AS BIGINT)) END)) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)"""

_LINE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, i, lines[i] AS line, translate(regexp_replace(lines[i], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{_UP}', '{_LOW}') AS k FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
f AS (SELECT k FROM l WHERE k != '' GROUP BY k HAVING count(DISTINCT r) >= 10),
o AS (SELECT r, count(*) FILTER (f.k IS NOT NULL) AS n, string_agg(line, chr(10) ORDER BY i) FILTER (f.k IS NULL) AS kept FROM l LEFT JOIN f ON l.k = f.k GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(n AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN o USING (r)"""

#: The checksum of a feature is a fold over its bytes with a table that a fold of eight steps makes.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))))"
_RESAMPLE_SQL = f"""WITH x AS (SELECT row_number() OVER () AS r, doc_id, text, true AS own FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
w AS (SELECT r, own, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM x),
g AS (SELECT r, own, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
c AS (SELECT r, own, g, count(*) AS c FROM g GROUP BY ALL), t AS (SELECT {_CRC_TABLE} AS t),
h AS (SELECT g, list_transform(range(1, CAST(len(hex(encode(g))) / 2 AS BIGINT) + 1), lambda i: CAST('0x' || substr(hex(encode(g)), 2 * i - 1, 2) AS BIGINT)) AS bytes FROM (SELECT DISTINCT g FROM c)),
b AS (SELECT g, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS b FROM h, t),
n AS (SELECT range AS b, CAST(coalesce(sum(c) FILTER (own), 0) AS DOUBLE) AS s, CAST(coalesce(sum(c) FILTER (NOT own), 0) AS DOUBLE) AS t FROM range(10000) LEFT JOIN (c JOIN b USING (g)) ON b = range GROUP BY range),
k AS (SELECT b, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS k FROM n),
v AS (SELECT r, sum(c) AS n_features, sum(c * k) AS weight FROM c JOIN b USING (g) JOIN k USING (b) GROUP BY r),
o AS (SELECT x.r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h FROM x JOIN w USING (r) LEFT JOIN v USING (r) WHERE x.own),
p AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM o),
q AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM p)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score, CAST(CASE WHEN place <= 5 * n // 100 THEN place END AS BIGINT) AS rank, CAST(n_words AS BIGINT) AS n_words FROM q"""

ORACLE_SQL: dict[str, str] = {"op11_line_dedup": _LINE_SQL, "op12_importance": _RESAMPLE_SQL, "op3_jaccard_join": _JACCARD_SQL, "op4_mixing": _MIX_SQL, "op7_url_rules": _url_sql(), "op8_suffix_dedup": _PASSAGE_SQL}
