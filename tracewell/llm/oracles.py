"""DuckDB SQL for the operators that SQL can express."""

import re

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2 = rf"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), hit AS (
  SELECT DISTINCT r, i, p.size, item
  FROM (SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
        FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)) p
  JOIN windows ON windows.win = p.win AND windows.size = p.size
), word AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN items USING (r)
"""

_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h || '0', (5 * i) // 4 + 1, 2) AS INTEGER) >> (3 - (5 * i) % 4)) & 31) + 1, 1)), '')"

OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, max(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to, 'ok' AS status
FROM p JOIN f USING (html)
"""


def _op9() -> str:
    from .quality_rules import CHAR_LEAST, CHAR_MOST, COMMON, LANG_LEAST, WORD_LEAST, WORD_MOST

    def less(chars: str) -> str:
        return f"length(t) - length(regexp_replace(t, '[{chars}]', '', 'g'))"

    def js(p: str, q: str, size: int) -> str:
        x = lambda a, i: f"({a}[{i}]::DOUBLE / greatest(list_sum({a}), 1))"
        half = lambda a, m: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / {m}) ELSE 0 END"
        terms = [f"({half(x(p, i), m)} + {half(x(q, i), m)}) / 2" for i in range(1, size + 1) for m in [f"(({x(p, i)} + {x(q, i)}) / 2)"]]
        return f"sqrt(greatest({' + '.join(terms)}, 0))"

    lists = "CASE lg " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in COMMON.items()) + " ELSE []::VARCHAR[] END"
    langs = ", ".join(f"'{k}'" for k in COMMON)
    size = len(COMMON["en"]) + 1
    failed = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang AS lg,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT r, i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), rep AS (
  SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1) GROUP BY r
), f AS (
  SELECT r, doc_id, lg, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({less('#*$%&|<>')} AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, length(t) AS chars, {less('A-Z')} AS up, {less('0-9')} AS dig, {less(r'.,;:!?' + "''" + r'"()\-')} AS pun, {less(r'^\x00-\x7F')} AS bey,
    list_transform({lists}, lambda x: len(list_filter(w, lambda y: lower(y) = x))) AS com
  FROM d LEFT JOIN rep USING (r)
), g AS (
  SELECT *, {failed} AS base_failed, [up, dig, pun, n_symbols, chars - word_chars, bey, greatest(chars - up - dig - pun - n_symbols - (chars - word_chars) - bey, 0)] AS p,
    list_concat(com, [n_words - coalesce(list_sum(com), 0)]) AS o FROM f
), ref AS (
  SELECT lg, [{', '.join(f'sum(p[{i}])' for i in range(1, 8))}] AS q, [{', '.join(f'sum(o[{i}])' for i in range(1, size + 1))}] AS s FROM g WHERE NOT base_failed AND lg IS NOT NULL GROUP BY lg HAVING count(*) >= {LANG_LEAST}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(CASE WHEN chars >= {CHAR_LEAST} AND q IS NOT NULL THEN {js('p', 'q', 7)} END, 0) <= {CHAR_MOST} AND coalesce(CASE WHEN n_words >= {WORD_LEAST} AND q IS NOT NULL AND lg IN ({langs}) THEN {js('o', 's', size)} END, 0) <= {WORD_MOST} AS kept
FROM g LEFT JOIN ref USING (lg)
"""


OP9 = _op9()


def _op3() -> str:
    from .secret_scan import BASE, RULES

    def either_case(pattern: str) -> str:
        """Letters of a pattern, in brackets or alone, in either case; escapes as they are. ``(?i)`` would fold beyond ASCII."""
        one = lambda x: x if x[0] == "\\" else x.replace("a-z", "A-Za-z") if x[0] == "[" and "A-Z" not in x else x if x[0] == "[" else f"[{x.upper()}{x}]"
        return re.sub(r"\\x[0-9A-F]{2}|\[[^\]]*\]|[a-z]", lambda m: one(m.group()), pattern)

    kinds = []
    for k, (name, pattern, fold, group, least) in enumerate(RULES):
        p = (either_case(pattern) if fold else pattern).replace("'", "''")
        kinds.append(f"""SELECT r, {k} AS k, '{name}' AS kind, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY i) AS upto, length(regexp_extract(hit, '{p}', {group})) >= {least} AS ok
  FROM (SELECT r, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS hit, unnest(g[1 : len(m)]) AS gap FROM (SELECT r, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d))""")
    base = f"k < {BASE}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  {' UNION ALL '.join(kinds)}
), s AS (
  SELECT r, k, CAST(upto - length(hit) AS BIGINT) AS a, CAST(upto AS BIGINT) AS b, concat(kind, ':', CAST(upto - length(hit) AS BIGINT), ':', CAST(upto AS BIGINT)) AS span FROM found WHERE ok
), a AS (
  SELECT r, {', '.join(f"count(*) FILTER (k = {k}) AS n_{RULES[k][0]}" for k in range(BASE))},
    string_agg(span, ',' ORDER BY a, k, b) FILTER ({base}) AS base, string_agg(span, ',' ORDER BY a, k, b) AS spans FROM s GROUP BY r
)
SELECT doc_id, {', '.join(f"coalesce(n_{RULES[k][0]}, 0) AS n_{RULES[k][0]}" for k in range(BASE))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""


def _op7() -> str:
    from .url_filter import ALPHABET, HELD, KEEP, ORDER, RULES, STEP, WEIGHT, masks

    labels, starts = masks()

    def case(value) -> str:
        fits = []
        for action, text in reversed(sorted(RULES, key=lambda r: len(r[1]))):
            own, _, start = text.partition("/")
            fits.append(f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{start}') THEN '{value(action, text)}'")
        return f"CASE {' '.join(fits)} END"

    sums = {f"{c}_{f}": f"count(*) FILTER (act = '{a}'{'' if f == 'full' else ' AND NOT held'})" for c, a in (("a", "allow"), ("b", "block")) for f in ("full", "fit")}
    size, levels = ORDER + 1, []
    for k in range(size):
        key, context = f"right(gram, {k + 1})", f"substr(gram, {size - k}, {k})"
        odds = [f"(sum({c}) OVER (PARTITION BY {key}) + {WEIGHT} * {f'p_{c}' if k else f'(1.0::DOUBLE / {len(ALPHABET) + 3})'}) / (sum({c}) OVER (PARTITION BY {context}) + {WEIGHT}) AS p_{c}" for c in sums]
        levels.append(f"l{k} AS (SELECT gram, {', '.join(sums)}, {', '.join(odds)} FROM {f'l{k - 1}' if k else 'c'})")
    marks = re.escape(ALPHABET.lstrip("abcdefghijklmnopqrstuvwxyz0"))
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), {_ABC}), '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(substr(md5(url), 1, 1) IN ({', '.join(f"'{h}'" for h in HELD)}), false) AS held,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://') || regexp_replace('.' || host || '.', '{labels}', '.', 'g')
      || regexp_replace(substr(url, strpos(url, '://') + 3 + length(host)), '{starts}', '/') ELSE coalesce(url, '') END AS seen,
    '{'^' * ORDER}' || regexp_replace(regexp_replace(translate(seen, {_ABC}), '[0-9]', '0', 'g'), '[^a-z0{marks}]', '*', 'g') || '$' AS s FROM pages
), u AS (
  SELECT *, {case(lambda a, t: t)} AS rule, {case(lambda a, t: a)} AS act FROM v
), g AS (
  SELECT r, act, held, substr(s, i, {size}) AS gram FROM (SELECT r, act, held, s, unnest(range(1, length(s) - {ORDER} + 1)) AS i FROM u)
), c AS (
  SELECT gram, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in sums.items())} FROM g GROUP BY gram
), {', '.join(levels)}, score AS (
  SELECT r, avg(ln(p_a_full) - ln(p_b_full)) AS full_, avg(ln(p_a_fit) - ln(p_b_fit)) AS fit_ FROM g JOIN l{ORDER} USING (gram) GROUP BY r
), h AS (
  SELECT act, CAST(round(fit_ * {STEP}) AS INTEGER) AS s, count(*) AS n FROM u JOIN score USING (r) WHERE held AND act IS NOT NULL GROUP BY ALL
), bound AS (
  SELECT t.s, (SELECT sum(n) FROM h WHERE act = 'allow' AND h.s >= t.s) / (SELECT sum(n) FROM h WHERE act = 'allow')::DOUBLE AS good
  FROM (SELECT DISTINCT s FROM h) t
), best AS (
  SELECT (s + coalesce((SELECT max(h.s) FROM h WHERE h.s < bound.s), s - 1))::DOUBLE / 2 / {STEP} AS b FROM bound WHERE (SELECT count(DISTINCT act) FROM h) = 2 AND good >= {KEEP} ORDER BY s DESC LIMIT 1
)
SELECT page_id, host, path, rule, coalesce(act, CASE WHEN full_ < (SELECT b FROM best) THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN score USING (r)
"""


OP3, OP7 = _op3(), _op7()
