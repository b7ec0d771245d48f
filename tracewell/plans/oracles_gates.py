"""DuckDB SQL for the queries of the clock gates of attribution."""

from __future__ import annotations

from .oracles import C, H, NOW, O, _b, _floor, _stats, _with
from .policy import DEFAULT

Y1992 = 694_224_000 * 10**9

_REPORTS = C.strip().replace(str(NOW), str(Y1992)).replace("c AS (", "gr0 AS (", 1) + f""",
gr AS (
  SELECT * REPLACE (CASE WHEN valid_for_ns > 1 THEN {10**18} ELSE valid_for_ns END AS valid_for_ns) FROM gr0
)"""


def _single(s: str) -> str:
    age = f"(p.received_ns - {s}.observed_ns)"
    return f"""CASE WHEN {s}.domain IS NULL THEN 'clock_offset_unavailable' WHEN {s}.sync_state = 'unsynced' THEN 'clock_unsynced'
      WHEN {age} < 0 THEN 'clock_offset_unavailable' WHEN {age} > {s}.valid_for_ns THEN 'clock_sync_expired' END"""


_GATES = f"""
gx AS (
  SELECT exchange_id, path, generation, source, received_ns, rtt_ns, CASE WHEN generation <> 'gen.1993' THEN 'reference' ELSE domain END AS domain
  FROM o WHERE state = 0
), gh AS (
  SELECT x.*, i.i AS hop_index, h.exchange_id IS NOT NULL AS seen, CASE WHEN (x.exchange_id + i.i) % 41 <> 5 THEN h.dwell_ns END AS dwell_ns, h.queue_dwell_ns,
    CASE WHEN (x.exchange_id + i.i) % 5 = 2 AND generation = 'gen.1994' THEN CAST(x.exchange_id % 100 + 1 AS VARCHAR)
      WHEN (x.exchange_id + i.i) % 5 = 2 AND generation = 'gen.1997' THEN '4' ELSE x.domain END AS entry_domain,
    CASE WHEN h.exchange_id IS NOT NULL THEN (x.exchange_id % 7) * 10 + i.i END AS uncertainty_ns
  FROM gx x CROSS JOIN (VALUES (0), (1)) i(i) LEFT JOIN h ON h.exchange_id = x.exchange_id AND h.hop_index = i.i
), gp AS (
  SELECT exchange_id, received_ns, -1 AS i, domain AS a, 'reference' AS b FROM gx
  UNION ALL SELECT exchange_id, received_ns, hop_index, entry_domain, domain FROM gh WHERE dwell_ns IS NOT NULL
), gc AS (
  SELECT p.exchange_id, p.i, coalesce(CASE WHEN a <> 'reference' THEN {_single("ca")} END, CASE WHEN b <> 'reference' THEN {_single("cb")} END,
    CASE WHEN a <> 'reference' AND ca.reference <> CASE WHEN b = 'reference' THEN 'reference' ELSE cb.reference END THEN 'clock_reference_mismatch'
      WHEN a = 'reference' AND cb.reference <> 'reference' THEN 'clock_reference_mismatch' END,
    CASE WHEN coalesce(ca.uncertainty_ns, 0) + coalesce(cb.uncertainty_ns, 0) > {DEFAULT.max_clock_uncertainty_ns} THEN 'clock_uncertainty_exceeded' END) AS why
  FROM gp p LEFT JOIN gr ca ON p.a = ca.domain AND p.a <> 'reference' LEFT JOIN gr cb ON p.b = cb.domain AND p.b <> 'reference' WHERE a <> b
), gf AS (
  SELECT exchange_id, list_sort(list(DISTINCT why)) AS clock_reasons, list_sort(coalesce(list(DISTINCT i) FILTER (WHERE i >= 0), [])) AS gated FROM gc
  WHERE why IS NOT NULL GROUP BY 1
), gs AS (
  SELECT exchange_id, count(dwell_ns) AS known, sum(dwell_ns) AS total, bool_or(seen AND dwell_ns IS NULL AND generation IN ('gen.1995', 'gen.1996')) AS told
  FROM gh GROUP BY 1
), ga AS (
  SELECT gx.*, coalesce(clock_reasons, []) AS clock_reasons, coalesce(gated, []) AS gated, clock_reasons IS NOT NULL OR told AS clocks_refused,
    clock_reasons IS NULL AND known = 2 AND rtt_ns >= 0 AS complete, total AS accounted_ns, rtt_ns - total AS residual_ns
  FROM gx JOIN gs USING (exchange_id) LEFT JOIN gf USING (exchange_id)
)"""
_LONG = """
lv AS (
  SELECT path, generation, 'end_to_end' AS measure, -1 AS hop_index, rtt_ns AS value FROM ga WHERE complete
  UNION ALL SELECT path, generation, 'residual', -1, CAST(residual_ns AS BIGINT) FROM ga WHERE complete
  UNION ALL SELECT gh.path, gh.generation, 'dwell', hop_index, dwell_ns FROM gh JOIN ga USING (exchange_id) WHERE complete
  UNION ALL SELECT gh.path, gh.generation, 'queue_dwell', hop_index, queue_dwell_ns FROM gh JOIN ga USING (exchange_id) WHERE complete
)"""
_KIND = f"""
gk AS (
  SELECT path, generation, count(*) AS included, count(*) FILTER (WHERE complete) AS nc, count(*) FILTER (WHERE NOT complete) AS ni,
    bool_or(clocks_refused) AS refused, bool_or(source = 'src.3') AS can, count(*) FILTER (WHERE complete AND residual_ns < 0) AS negative,
    {_floor("sum(rtt_ns) FILTER (WHERE complete)", "count(*) FILTER (WHERE complete)")} - {_floor("sum(accounted_ns) FILTER (WHERE complete)", "count(*) FILTER (WHERE complete)")} AS rest,
    list_distinct(flatten(list(clock_reasons))) AS clock
  FROM ga GROUP BY ALL
), gv AS (
  SELECT *, CASE WHEN NOT can THEN 'unsupported' WHEN refused OR nc = 0 THEN 'refused' WHEN ni > 0 THEN 'partial' ELSE 'observed_decomposition' END AS kind FROM gk
)"""
_ALL = (O, H, _REPORTS, _GATES)

ALL: dict[str, str] = {
    "attribution_gates": _with(*_ALL) + f"""SELECT exchange_id, array_to_string(clock_reasons, ',') AS clock_reasons, array_to_string(gated, ',') AS gated_hops, clocks_refused, complete,
  CASE WHEN complete THEN {_b("residual_ns")} END AS residual_ns FROM ga""",
    "attribution_distributions": _with(*_ALL, _LONG) + _stats("value", "path, generation, measure, hop_index", "lv", "p50 p99"),
    "attribution_contributions": _with(*_ALL, _KIND, """
gq AS (
  SELECT gh.path, gh.generation, hop_index, count(dwell_ns) FILTER (WHERE complete) AS observed, count(*) - count(dwell_ns) AS missing, sum(dwell_ns) FILTER (WHERE complete) AS s,
    sum(queue_dwell_ns) FILTER (WHERE complete) AS q, count(queue_dwell_ns) FILTER (WHERE complete) AS nq,
    max(uncertainty_ns) FILTER (WHERE dwell_ns IS NOT NULL AND NOT list_contains(gated, hop_index)) AS uncertainty_ns
  FROM gh JOIN ga USING (exchange_id) GROUP BY ALL
)""") + f"""SELECT path, generation, hop_index, observed, missing, {_b("s")} AS sum_ns, {_floor("s", "observed")} AS mean_ns, {_floor("q", "nq")} AS queue_mean_ns, uncertainty_ns,
  {_b("CASE WHEN observed + missing = 0 THEN 0 ELSE observed * 1000000 // (observed + missing) END")} AS coverage_ppm,
  {_b("CASE WHEN kind IN ('partial', 'observed_decomposition') THEN coalesce(s * 1000000 // sum(s) OVER (PARTITION BY path, generation), 0) ELSE 0 END")} AS share_ppm,
  CASE WHEN observed = 0 THEN 'unknown' WHEN missing > 0 THEN 'incomplete' ELSE 'observed' END AS hop_state
  FROM gq JOIN gv USING (path, generation)""",
    "attribution_reasons": _with(*_ALL, _KIND) + """SELECT path, generation, kind, array_to_string(list_sort(list_distinct(list_concat(list_filter([
    CASE WHEN kind = 'unsupported' THEN 'semantics_unsupported' END, CASE WHEN kind = 'partial' THEN 'partial_coverage' END,
    CASE WHEN kind = 'partial' OR kind = 'refused' AND NOT refused AND nc = 0 THEN 'non_tiling_coverage' END,
    CASE WHEN kind IN ('partial', 'observed_decomposition') THEN CASE WHEN abs(rest) <= 1000 THEN 'residual_within_tolerance' ELSE 'unaccounted_residual' END END,
    CASE WHEN kind = 'observed_decomposition' THEN 'attribution_complete' WHEN kind = 'partial' THEN 'attribution_partial' END,
    CASE WHEN negative > 0 THEN 'hop_overlap' END, 'no_causal_inference'], lambda r: r IS NOT NULL), CASE WHEN kind = 'refused' THEN clock ELSE [] END))), ',') AS reasons FROM gv""",
}
