"""DuckDB SQL for ingest as one operator."""

from __future__ import annotations

from .oracles import _REV, _SEQ, _SES, NOW, C, E, _with

_REPORTS = C.strip().replace("c AS (", "c0 AS (", 1) + f""",
c AS (
  SELECT * REPLACE (CASE WHEN valid_for_ns > 1 THEN {10**18} ELSE valid_for_ns END AS valid_for_ns) FROM c0
)"""
assert str(NOW) in _REPORTS
_CHECKED = """
r0 AS (
  SELECT e0.* REPLACE (CASE WHEN exchange_id % 61 <> 0 THEN epoch END AS epoch),
    CASE WHEN exchange_id % 97 = 0 THEN 'g.9' WHEN exchange_id % 5 = 0 THEN 'g.1' ELSE 'g.2' END AS generation,
    CASE WHEN source % 29 <> 0 THEN 2 + source % 2 END AS registered,
    CASE WHEN exchange_id % 4 = 1 THEN CAST(exchange_id % 100 + 1 AS VARCHAR) ELSE 'reference' END AS od,
    received_ns - (exchange_id % 90 - 2) * 1000000000 AS observed_at
  FROM e0
), r1 AS (
  SELECT r0.*, CASE WHEN od = 'reference' THEN 'observed' WHEN c.domain IS NULL THEN 'unknown' WHEN c.reference <> 'reference' THEN 'conflicting'
      WHEN c.sync_state = 'unsynced' THEN 'refused' WHEN received_ns - c.observed_ns < 0 OR received_ns - c.observed_ns > c.valid_for_ns THEN 'stale' ELSE 'observed' END AS clock,
    received_ns - (observed_at - CASE WHEN od = 'reference' THEN 0 ELSE c.offset_ns END) AS shifted
  FROM r0 LEFT JOIN c ON c.domain = od
), r2 AS (
  SELECT *, CASE WHEN clock = 'observed' THEN shifted END AS age_ns,
    CASE WHEN path = 'error' THEN 'unknown_path' WHEN source % 29 = 0 THEN 'unknown_source' WHEN generation = 'g.9' THEN 'unknown_generation' END AS first,
    list_filter([CASE WHEN epoch IS NULL OR exchange_id % 71 = 0 THEN 'invalid_field_value' END, CASE WHEN exchange_id % 67 = 0 THEN 'clock_reference_mismatch' END,
      CASE WHEN exchange_id % 73 <> 0 AND exchange_id % 79 = 0 THEN 'hop_not_contiguous' END,
      CASE WHEN exchange_id % 73 = 0 OR exchange_id % 83 = 0 OR (exchange_id + 1) % 83 = 0 THEN 'hop_conflicting' END], lambda v: v IS NOT NULL) AS rest
  FROM r1
), r AS (
  SELECT *, CASE WHEN first IS NOT NULL THEN [first] ELSE rest END AS structure, first IS NOT NULL OR len(rest) > 0 AS fatal,
    CASE WHEN age_ns IS NULL OR age_ns < 0 THEN 4 WHEN age_ns <= 2000000000 THEN 0 WHEN age_ns <= 10000000000 THEN 1 WHEN age_ns <= 60000000000 THEN 2 ELSE 3 END AS fresh
  FROM r2
), e AS (SELECT * FROM r WHERE NOT fatal)"""
_FENCED = """
adv AS (
  SELECT exchange_id, coalesce(source_revision > max(source_revision) OVER (PARTITION BY source, epoch, incarnation ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS advanced,
  FROM e
), cur AS (SELECT t.exchange_id, n.epoch AS newest_epoch FROM t JOIN n ON n.source = t.source AND n.session = t.newest),
f AS (
  SELECT s.exchange_id, decision, gap, session_current, session_reason, revision_current, advanced, newest_epoch
  FROM s JOIN ses USING (exchange_id) JOIN rev USING (exchange_id) JOIN adv USING (exchange_id) JOIN cur USING (exchange_id)
), w AS (
  SELECT r.*, f.* EXCLUDE (exchange_id), generation = 'g.1' AS late, NOT fatal AND (decision = 'replay' OR source_revision > registered) AS refused,
    NOT fatal AND (decision = 'reordered' OR NOT session_current OR NOT revision_current OR source_revision < registered OR generation = 'g.1' OR NOT (clock = 'observed' AND fresh <= 1)) AS old
  FROM r LEFT JOIN f USING (exchange_id)
)"""
_OUT = """SELECT exchange_id, array_to_string(list_sort(list_distinct(list_concat(structure, list_filter([
    CASE WHEN first IS NULL THEN ['evidence_fresh', 'evidence_aging', 'evidence_stale', 'evidence_expired', 'freshness_unknown'][fresh + 1] END,
    CASE WHEN NOT fatal AND late THEN 'generation_superseded' END,
    CASE WHEN session_reason IN ('epoch_advanced', 'incarnation_changed') THEN session_reason END,
    CASE WHEN session_reason = 'session_superseded' THEN CASE WHEN newest_epoch <> epoch THEN 'epoch_replayed' ELSE 'incarnation_replayed' END END,
    CASE WHEN NOT fatal AND (NOT revision_current OR advanced OR source_revision <> registered) THEN 'revision_changed' END,
    CASE WHEN gap > 0 THEN 'sequence_gap' END, CASE WHEN decision = 'reordered' THEN 'sequence_reordered' WHEN decision = 'replay' THEN 'sequence_replay' END
  ], lambda v: v IS NOT NULL)))), ',') AS reasons,
  CASE WHEN first IS NOT NULL THEN 'conflicting' WHEN fatal OR refused THEN CASE WHEN clock IN ('unknown', 'refused') THEN clock ELSE 'conflicting' END ELSE clock END AS state,
  CASE WHEN first IS NOT NULL OR decision = 'replay' THEN 'unknown' ELSE ['fresh', 'aging', 'stale', 'expired', 'unknown'][fresh + 1] END AS freshness,
  age_ns, decision, CAST(gap AS BIGINT) AS gap, session_current,
  CASE WHEN fatal OR refused THEN 'rejected' WHEN old THEN 'historical' ELSE 'current' END AS verdict FROM w"""
_HOPS = """
hx AS (
  SELECT e0.exchange_id AS arrival, e0.received_ns, i.i AS hop_index, CASE WHEN (exchange_id + i.i) % 83 = 0 THEN 'hx' WHEN exchange_id % 73 = 0 THEN 'h1' ELSE 'h' || i.i END AS hop,
    CASE WHEN exchange_id % 7 <> 1 THEN 'q' END AS queue, received_ns AS entry_ns, received_ns + (exchange_id % 50 - 5) * 1000 AS exit_ns,
    CASE WHEN exchange_id % 9 = 2 THEN CAST(exchange_id % 100 + 1 AS VARCHAR) ELSE 'reference' END AS a,
    CASE WHEN exchange_id % 8 <> 3 THEN received_ns + (exchange_id % 50 - 5) * 1000 - 1 END AS qx
  FROM e0 CROSS JOIN (VALUES (0), (1)) i(i) WHERE exchange_id % 73 <> 0 OR i.i = 0
), hv AS (
  SELECT hx.*, CASE WHEN a = 'reference' THEN NULL WHEN c.domain IS NULL THEN 'unknown:clock_offset_unavailable' WHEN c.sync_state = 'unsynced' THEN 'refused:clock_unsynced'
      WHEN received_ns - c.observed_ns < 0 THEN 'conflicting:clock_offset_unavailable' WHEN received_ns - c.observed_ns > c.valid_for_ns THEN 'stale:clock_sync_expired'
      WHEN c.reference <> 'reference' THEN 'conflicting:clock_reference_mismatch' WHEN c.uncertainty_ns > 3000000 THEN 'refused:clock_uncertainty_exceeded' END AS bad,
    CASE WHEN a = 'reference' THEN 0 ELSE c.offset_ns END AS off, CASE WHEN a = 'reference' THEN 0 ELSE c.uncertainty_ns END AS unc
  FROM hx LEFT JOIN c ON c.domain = a
), hd AS (
  SELECT *, hop <> 'hx' AS known, bad IS NULL AND exit_ns - (entry_ns - off) >= 0 AS good, bad IS NULL AND hop = 'h1' AND queue = 'q' AND qx IS NOT NULL AND qx >= entry_ns + 1 - off AS queued FROM hv
)"""
_EVENTS = E.strip().replace("e AS (", "e0 AS (", 1)

ALL: dict[str, str] = {
    "ingest_verdicts": _with(_EVENTS, _REPORTS, _CHECKED, _SEQ.format(k="source, epoch, incarnation"), _SES, _REV, _FENCED) + _OUT,
    "ingest_hop_dwells": _with(_EVENTS, _REPORTS, _HOPS) + """SELECT arrival, hop_index, CASE WHEN known AND good THEN exit_ns - (entry_ns - off) END AS dwell_ns,
  CASE WHEN queued THEN qx - (entry_ns + 1 - off) END AS queue_dwell_ns, CASE WHEN known AND good THEN unc END AS uncertainty_ns,
  CASE WHEN NOT known THEN 'unsupported' WHEN bad IS NOT NULL THEN split_part(bad, ':', 1) WHEN good THEN 'observed' ELSE 'conflicting' END AS state,
  CASE WHEN NOT known THEN 'unknown_hop' WHEN bad IS NOT NULL THEN split_part(bad, ':', 2) WHEN NOT good THEN 'hop_out_of_order' END AS reason FROM hd""",
}
