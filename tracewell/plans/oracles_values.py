"""DuckDB SQL for evidence as a value, texts, exports and the rest of the baselines."""

from __future__ import annotations

from . import oracles
from .oracles import _OK, _REQ, JAN5, NOW, E, H, O, _b, _floor, _stats, _with, _fnv
from .oracles_ingest import _REPORTS
from .policy import default_bounds

_STATES = "['observed', 'incomplete', 'missing', 'stale', 'conflicting', 'unknown', 'unsupported', 'refused']"
_FRESH = "['fresh', 'aging', 'stale', 'expired', 'unknown']"
_CONF = "['high', 'moderate', 'low', 'degraded', 'none']"


def _ev(k: str) -> str:
    """Evidence by remainder: {s, f, c, r}."""
    made = [(2, 4, 4), (1, 4, 2), (3, 2, 4), (4, 4, 4), (5, 4, 4), (6, 4, 4), (7, 4, 4)]
    rows = " ".join(f"WHEN {i} THEN {{'s': {s}, 'f': {f}, 'c': {c}, 'r': ['also', 'why_{i}']}}" for i, (s, f, c) in enumerate(made))
    return f"CASE ({k}) % 9 {rows} ELSE {{'s': 0, 'f': CAST(({k}) % 5 AS INTEGER), 'c': CAST(({k}) % 3 AS INTEGER), 'r': ['evidence_fresh']}} END"


def _text(s: str, f: str, c: str, r: str) -> str:
    return f"concat_ws(' ', {_STATES}[{s} + 1] || '/' || {_FRESH}[{f} + 1] || '/' || {_CONF}[{c} + 1], array_to_string({r}, ' '))"


_HOPS = "(SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS hop_index)"
_BOUNDS = ",".join(map(str, default_bounds()))
_SAMPLE = oracles.ALL["export_samples"]
_TOTAL = f"""
w AS (SELECT path, generation, count(*) AS n, {_floor("sum(rtt_ns)", "count(*)")} AS mean FROM o WHERE generation IN ('gen.1997', 'gen.1998') GROUP BY ALL),
hm AS (SELECT path, generation, CAST(hop_index AS INTEGER) AS hop_index, count(*) AS n, {_floor("sum(dwell_ns)", "count(*)")} AS mean FROM o JOIN h USING (exchange_id)
  WHERE hop_index < 3 AND generation IN ('gen.1997', 'gen.1998') GROUP BY ALL),
z AS (
  SELECT p.path, p.generation, i.hop_index, 'hop' || i.hop_index AS hop, coalesce(hm.n, 0) AS n, hm.mean FROM (SELECT DISTINCT path, generation FROM w) p
    CROSS JOIN (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS hop_index) i LEFT JOIN hm USING (path, generation, hop_index)
  UNION ALL SELECT path, generation, 0, 'end_to_end', n, mean FROM w
)"""
_FIXED_HOPS = ", ".join(f"h{i}.dwell_ns AS hop{i}_dwell_ns, h{i}.queue_dwell_ns AS hop{i}_queue_dwell_ns" for i in range(7))
_FIXED_JOINS = " ".join(f"LEFT JOIN h h{i} ON h{i}.exchange_id = o.exchange_id AND h{i}.hop_index = {i}" for i in range(7))
_GAP = "(x.mean - y.mean)"

ALL: dict[str, str] = {
    "evidence_values": _with(O, f"v AS (SELECT exchange_id, {_ev('exchange_id')} AS a, {_ev('exchange_id + 4')} AS b FROM o)") + f"""SELECT exchange_id, {_text("a.s", "a.f", "a.c", "a.r")} AS text,
  {_text("CASE WHEN greatest(a.s, b.s) >= 3 THEN greatest(a.s, b.s) WHEN greatest(a.s, b.s) >= 1 THEN 1 ELSE 0 END", "greatest(a.f, b.f)", "greatest(a.c, b.c)", "list_sort(list_distinct(list_concat(a.r, b.r)))")} AS merged,
  a.s IN (0, 1, 3) AS has_value, CASE WHEN exchange_id % 10 <> 0 THEN a.s END AS parsed FROM v""",
    "evidence_rollup": _with(O, f"v AS (SELECT path, generation, {_ev('exchange_id')} AS e FROM o WHERE exchange_id % 9 > 6 OR exchange_id % 9 < 3 AND path < '3')",
        "m AS (SELECT path, generation, max(e.s) AS s, max(e.f) AS f, max(e.c) AS c, list_sort(list_distinct(flatten(list(e.r)))) AS r FROM v GROUP BY ALL)")
    + f"SELECT path, generation, {_text('CASE WHEN s >= 3 THEN s WHEN s >= 1 THEN 1 ELSE 0 END', 'f', 'c', 'r')} AS text FROM m",
    "number_parsing": """
WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '+' || p_partkey WHEN 1 THEN p_partkey || '99999999999999999' WHEN 2 THEN '-' || p_partkey WHEN 3 THEN p_partkey || ' ' ELSE CAST(p_partkey AS VARCHAR) END AS text FROM part),
v AS (SELECT *, CASE WHEN regexp_full_match(text, '[+-]?[0-9]+') THEN TRY_CAST(text AS BIGINT) END AS signed, CASE WHEN regexp_full_match(text, '[0-9]+') THEN TRY_CAST(text AS UBIGINT) END AS u FROM t)
SELECT p_partkey, text, signed, CAST(u AS VARCHAR) AS unsigned, CASE WHEN signed < 1500 THEN signed + 1 END AS next FROM v""",
    "coverage_texts": _with(O, H, "n AS (SELECT path, count(*) AS total FROM o GROUP BY 1)", "k AS (SELECT path, CAST(hop_index AS INTEGER) AS hop_index, count(*) AS seen FROM o JOIN h USING (exchange_id) GROUP BY ALL)")
    + f"SELECT n.path, i.hop_index, coalesce(seen, 0) || '/' || total || CASE WHEN coalesce(seen, 0) < total THEN ' (unknown=' || (total - coalesce(seen, 0)) || ')' ELSE '' END AS coverage FROM n CROSS JOIN {_HOPS} i LEFT JOIN k USING (path, hop_index)",
    "histogram_spec": f"SELECT sha256('histogram.bounds={_BOUNDS}' || chr(10)) AS digest, {len(default_bounds())} AS bounds",
    "restart_reclassified": _with(E, _REPORTS, f"""
st AS (SELECT exchange_id, CASE WHEN exchange_id % 4 = 1 THEN CAST(exchange_id % 100 + 1 AS VARCHAR) ELSE 'reference' END AS d, received_ns + (exchange_id % 7) * 1000000000 AS seen_at, CASE WHEN exchange_id % 3 = 0 THEN 4 ELSE 0 END AS state FROM e WHERE received_ns < {JAN5}),
ag AS (SELECT st.*, CASE WHEN d = 'reference' THEN {JAN5} - seen_at WHEN c.domain IS NULL OR c.reference <> 'reference' OR c.sync_state = 'unsynced' OR {JAN5} - c.observed_ns < 0 OR {JAN5} - c.observed_ns > c.valid_for_ns THEN NULL ELSE {JAN5} - (seen_at - c.offset_ns) END AS age
  FROM st LEFT JOIN c ON c.domain = d),
fr AS (SELECT *, CASE WHEN age IS NULL OR age < 0 THEN 4 WHEN age <= 2000000000 THEN 0 WHEN age <= 10000000000 THEN 1 WHEN age <= 86400000000000 THEN 2 ELSE 3 END AS f FROM ag)""")
    + f"SELECT exchange_id, {_FRESH}[f + 1] AS freshness, CASE WHEN state = 0 AND f > 1 THEN 'evidence_stale,' ELSE '' END || 'restart_loaded_evidence' AS reasons FROM fr",
    "provenance_sources": _with(O, f"i AS (SELECT * FROM o WHERE {_REQ} AND {_OK})") + """
SELECT exchange_id, arrival, source, CASE WHEN source < 'src.6' THEN CASE WHEN right(source, 1) IN ('0', '2', '4') THEN 'probe' ELSE 'agent' END END AS source_kind, CASE WHEN source < 'src.6' THEN 'primary' END AS authority,
  received_ns, observed_ns, state, freshness, (SELECT count(*) FROM i) > 64 AS truncated FROM i ORDER BY arrival LIMIT 64""",
    "export_fixed_columns": _with(O, H) + f"""
SELECT {_fnv("'measurement|' || source || '|e' || (o.exchange_id % 3) || '|i|' || o.exchange_id")} AS measurement, path, generation, source, 'e' || (o.exchange_id % 3) AS epoch, 'i' AS incarnation, o.exchange_id AS sequence,
  observed_ns AS observed_at_ns, domain AS observed_at_domain, received_ns AS received_at_ns, {_STATES}[state + 1] AS state, {_FRESH}[freshness + 1] AS freshness, {_CONF}[o.exchange_id % 5 + 1] AS confidence, rtt_ns, {_FIXED_HOPS}
FROM o {_FIXED_JOINS}""",
    "export_document": f"""
WITH samples AS ({_SAMPLE}), kept AS (SELECT sample, exchange_id FROM samples ORDER BY exchange_id LIMIT 400)
SELECT (SELECT count(*) FROM samples) AS matched, count(*) AS exported, (SELECT count(*) FROM samples) - count(*) AS skipped, (SELECT count(*) FROM samples) > count(*) AS truncated,
  sha256(string_agg(sample, chr(10) ORDER BY exchange_id)) AS sha256 FROM kept""",
    "summary_json": _with(E, f"d AS ({_stats('rtt_ns', 'path', 'e', 'p50')})") + """SELECT path, '{"path":"' || path || '","n":' || n || ',"min_ns":' || min_ns || ',"max_ns":' || max_ns || ',"sum_ns":' || sum_ns || ',"mean_ns":' || mean_ns || ',"remainder_ns":' || remainder_ns || ',"p50":' || p50 || '}' AS json FROM d""",
    "anomalies_and_total": _with(O, H, _TOTAL) + f"""
SELECT x.path, x.hop_index, x.hop, x.n AS current_n, y.n AS baseline_n, {_GAP} AS mean_delta_ns, CASE WHEN x.mean IS NULL OR y.mean IS NULL OR y.mean <= 0 THEN 0 ELSE {_b('greatest(x.mean, 0)::HUGEINT * 1000000 // y.mean')} END AS ratio_ppm,
  CASE WHEN x.n < 8 OR y.n < 8 OR {_GAP} IS NULL THEN 'unknown' WHEN {_GAP} >= 200000 THEN 'elevated' WHEN {_GAP} >= 20000 THEN 'watch' WHEN {_GAP} <= -200000 THEN 'suppressed_elevated' WHEN {_GAP} <= -20000 THEN 'suppressed' ELSE 'none' END AS anomaly,
  CASE WHEN x.n < 8 OR y.n < 8 THEN 'low' WHEN x.n >= 32 THEN 'high' ELSE 'moderate' END AS confidence
FROM (SELECT * FROM z WHERE generation = 'gen.1998') x JOIN (SELECT * FROM z WHERE generation = 'gen.1997') y USING (path, hop_index, hop)""",
    "baseline_shapes": _with(O, f"st AS ({_stats('rtt_ns', 'path, generation, domain', 'o', 'p99')})", """
sh AS (SELECT *, list_filter([CASE WHEN CAST(substr(generation, 8, 1) AS INT) % 2 <> 0 THEN 'histogram' END, CASE WHEN CAST(substr(generation, 8, 1) AS INT) % 3 = 0 THEN 'probes' END, CASE WHEN n < 8 THEN 'too_few_samples' END], lambda v: v IS NOT NULL) AS mm FROM st)""")
    + f"SELECT path, generation, domain, array_to_string(mm, ',') AS mismatches, len(mm) = 0 AS applicable, CASE WHEN len(mm) = 0 THEN {_b('0')} END AS p99_delta_ns FROM sh",
}
assert str(NOW) in _REPORTS
