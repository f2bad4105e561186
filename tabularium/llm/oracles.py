"""SQL for DuckDB that gives the rows of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

from tabularium.llm import line_quality, secret_scan

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _small(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN strlen(h) >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 100 AND first <> page_id THEN first END AS refers_to FROM p JOIN m USING (h)"""

LINE_QUALITY = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
k AS (SELECT source, t, min(doc_id) AS first, any_value(lines) AS lines FROM d GROUP BY source, t),
u AS (SELECT source, first, {_WORDS.format(_small('l'))} AS w FROM (SELECT source, first, unnest(lines) AS l FROM k)),
h AS (SELECT source, first, array_to_string(w, ' ') AS line, sum(len(w)) AS n FROM u GROUP BY ALL),
b AS (SELECT source, line, count(*) AS n_docs, min(first) AS keeper, min(n) AS words FROM h GROUP BY source, line),
a AS (SELECT source, line, keeper FROM b JOIN (SELECT source, count(*) AS n_all FROM k GROUP BY source) USING (source) WHERE n_docs > {line_quality.MIN_DOCS} OR n_docs > {line_quality.SMALL_DOCS} AND n_docs > n_all * {line_quality.MAX_SHARE}::DOUBLE OR n_docs > {line_quality.LONG_DOCS} AND words >= {line_quality.LONG_WORDS}),
x AS (SELECT source, first, sum(n) AS n_removed FROM h JOIN a USING (source, line) WHERE first <> keeper GROUP BY ALL),
m AS (SELECT d.doc_id, len(d.w) AS n_words, list_sum(list_transform(d.w, lambda x: length(x))) AS word_chars, length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(d.lines) - len(list_distinct(d.lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(n_removed, 0) AS n_removed
  FROM d LEFT JOIN r USING (doc_id) JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.t = d.t LEFT JOIN x ON x.source = k.source AND x.first = k.first),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_removed >= n_words * {line_quality.MIN_LEFT}::DOUBLE AS kept, CAST(n_removed AS BIGINT) AS n_removed FROM f"""

_ITEM_WORDS = rf"regexp_extract_all({_small('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = rf"""WITH q AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, coalesce({_ITEM_WORDS}, []) AS w FROM documents),
s AS (SELECT item_id, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS i, w FROM q WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS window_text FROM s),
e AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS window_text FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
m AS (SELECT doc_id, n, i, item_id FROM e JOIN v USING (n, window_text)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY doc_id),
o AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS term FROM d),
r AS (SELECT item_id, term FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY n, term) AS k FROM (SELECT DISTINCT item_id, unnest(w) AS term FROM q) JOIN (SELECT term, count(*) AS n FROM o GROUP BY term) USING (term)) WHERE k <= 6),
l AS (SELECT item_id, greatest(2, (2 * count(*) + 2) // 3) AS least FROM r GROUP BY item_id),
x AS (SELECT item_id, doc_id, p, term FROM o JOIN r USING (term)),
y AS (SELECT DISTINCT a.item_id, a.doc_id FROM x a JOIN x b ON a.item_id = b.item_id AND a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 25 JOIN l ON l.item_id = a.item_id GROUP BY a.item_id, a.doc_id, a.p HAVING count(DISTINCT b.term) >= any_value(least)),
z AS (SELECT doc_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS near_items FROM y ANTI JOIN m USING (doc_id, item_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(near_items, '') AS near_items FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN z USING (doc_id)"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(pattern: str, rank: int, keep: str = "true", source: str = "d", key: str = "doc_id") -> str:
    """(key, rank, a, b, found) of all matches."""
    p = _quoted(pattern)
    value = f"regexp_extract_all(t, {p}, 2)" if "(" in pattern else f"regexp_extract_all(t, {p})"
    return f"""SELECT {key}, {rank} AS rank, a, a + length(found) AS b, found FROM (SELECT {key}, f[k] AS found, v[k] AS val, CAST(list_sum(list_transform(s[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM (SELECT {key}, f, v, s, unnest(range(1, len(f) + 1)) AS k FROM (SELECT {key}, regexp_extract_all(t, {p}) AS f, {value} AS v, regexp_split_to_array(t, {p}) AS s FROM {source} WHERE regexp_matches(t, {p})))) WHERE {keep}"""


def _parted(x: str) -> str:
    """Words that stand by themselves next to a separator, as spaces; twice, since two may share what stands between them."""
    for word in secret_scan.PARTING * 2:
        blank = " " * len(word)
        x = f"regexp_replace(regexp_replace({x}, '(^|[^A-Za-z0-9])(?i:{word})({secret_scan.SEPARATOR})', '\\1{blank}\\2', 'g'), '({secret_scan.SEPARATOR})(?i:{word})([^A-Za-z0-9]|$)', '\\1{blank}\\2', 'g')"
    return x


_BARE = {k: p.replace("(?<![0-9a-f])", "").replace("(?<![A-Za-z0-9+/_=-])", "") for k, p in (("hex", secret_scan.HEX), ("run", secret_scan.RUN))}
_ALLOWED = " OR ".join(f"regexp_matches(found, {_quoted(p)})" for p in secret_scan.ALLOWED)
_SAID = "coalesce(string_agg(['assign', 'access', 'hex', 'entropy'][rank + 1] || ':' || a || ':' || b, ',' ORDER BY a, rank, b), '')"
_W = secret_scan.WINDOW
SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_spans(secret_scan.ASSIGN, 0, 'length(val) >= 6')} UNION ALL {_spans(secret_scan.ACCESS, 1)} UNION ALL {_spans(_BARE['hex'], 2)}),
ends AS (SELECT doc_id, a, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM base UNION ALL SELECT doc_id, length(t), coalesce(max(b), 0) FROM d LEFT JOIN base USING (doc_id) GROUP BY doc_id, t),
pieces AS (SELECT doc_id, off, {_parted('substring(t, off + 1, a - off)')} AS t FROM ends JOIN d USING (doc_id) WHERE a > off),
runs AS (SELECT doc_id, off + a AS a, found, CASE WHEN regexp_full_match(found, '[0-9a-fA-F]+') THEN {secret_scan.HEX_BITS} ELSE {secret_scan.OTHER_BITS} END AS bits FROM ({_spans(_BARE['run'], 3, source='pieces', key='doc_id, off')})
  WHERE (regexp_matches(found, '[0-9]') AND regexp_matches(found, '[A-Za-z]') OR regexp_matches(found, '[A-Z]') AND regexp_matches(found, '[a-z]')) AND NOT ({_ALLOWED})),
wins AS (SELECT doc_id, a, found, bits, i, substring(found, i + 1, {_W}) AS w FROM (SELECT *, unnest(range(0, length(found) - {_W - 1})) AS i FROM runs)),
hot AS (SELECT doc_id, a, found, i FROM wins WHERE log2({_W}) - list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: ({_W} - length(replace(w, c, ''))) * log2({_W} - length(replace(w, c, ''))))) / {_W} >
  CASE WHEN regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]') THEN bits WHEN NOT regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]') THEN {secret_scan.LETTER_BITS} END),
marked AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, a ORDER BY i) AS g FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, a ORDER BY i) <= {_W} THEN 0 ELSE 1 END AS apart FROM hot)),
harm AS (SELECT doc_id, off AS run, a AS h1, b AS h2 FROM ({_spans(secret_scan.HARMLESS, 0, source='(SELECT DISTINCT doc_id, a AS off, found AS t FROM hot)', key='doc_id, off')})),
stretches AS (SELECT doc_id, a AS run, min(i) AS s, max(i) + {_W} AS e FROM marked GROUP BY doc_id, a, g),
added AS (SELECT doc_id, 3 AS rank, run + s AS a, run + e AS b FROM stretches x WHERE NOT EXISTS (SELECT 1 FROM harm h WHERE h.doc_id = x.doc_id AND h.run = x.run AND h1 < e + {_W} AND h2 > s - {_W})),
every AS (SELECT doc_id, rank, a, b FROM base UNION ALL SELECT doc_id, rank, a, b FROM added),
x AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2, {_SAID} AS said FROM base GROUP BY doc_id),
y AS (SELECT doc_id, {_SAID} AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(said, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)"""

_DRAW = "CAST('0x' || substring(h, {0}, 8) AS BIGINT)"
_CUT_AT = f"{_DRAW.format(1)} % (n + 1) AS x, {_DRAW.format(9)} % (n + 1) AS y, {_DRAW.format(17)} % 100 AS z, {_DRAW.format(25)} % 100 AS q"
FILL_MIDDLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, {_CUT_AT} FROM d),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR z >= 90 THEN 'plain' WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(prefix || middle || suffix) AS restored_sha256 FROM p"""

_TERMS = rf"regexp_extract_all({_small('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LEXICAL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents), q AS (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
s AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM d WHERE len(w) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
g AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM t, s GROUP BY term),
m AS (SELECT r, doc_id, CAST(25 + (75 * len(w) * n_docs) // n_terms AS BIGINT) AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN g USING (term) JOIN m USING (r) GROUP BY item_id, r),
y AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM y WHERE rank <= 10"""

ORACLES = {"op2_line_quality": LINE_QUALITY, "op4_warc": WARC, "op5_decontamination": DECONTAMINATION, "op7_secret_scan": SECRETS, "op12_fill_middle": FILL_MIDDLE, "op13_lexical_search": LEXICAL}
