"""DuckDB SQL for every registered query, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from .policy import default_bounds

DAY = 86_400_000_000_000
Y1996, Y1999, JAN5, JAN25, NOW = 820_454_400 * 10**9, 915_148_800 * 10**9, 1_704_412_800 * 10**9, 1_706_140_800 * 10**9, 1_700_000_000 * 10**9
Y1997, Y1998 = 852_076_800 * 10**9, 883_612_800 * 10**9

E = """
e AS (
  SELECT event_id AS exchange_id, event_id AS arrival, event_type AS path, user_id AS source, epoch_us(ts) * 1000 AS received_ns,
    CAST(round(value * 1000) AS BIGINT) * 1000 AS rtt_ns, CAST(json_extract_string(props, '$.k') AS BIGINT) AS sequence,
    'epoch.' || (day(ts) // 10) AS epoch, 'inc.' || ((event_id // 400) % 3) AS incarnation, CAST(1 + event_id % 3 AS INTEGER) AS source_revision
  FROM events
)"""
O = """
o1 AS (
  SELECT o_orderkey AS exchange_id, o_orderkey AS arrival, o_orderpriority AS path, 'gen.' || year(o_orderdate) AS generation,
    'src.' || (o_custkey % 8) AS source, epoch_us(o_orderdate) * 1000 AS received_ns,
    epoch_us(o_orderdate) * 1000 - ((o_orderkey % 90) - 2) * 1000000000 AS observed_ns, CAST(round(o_totalprice * 100) AS BIGINT) AS rtt_ns,
    CASE WHEN o_orderkey % 11 = 0 THEN 4 WHEN o_orderkey % 11 = 1 THEN 6 ELSE 0 END AS state,
    CASE WHEN o_orderkey % 13 = 0 THEN 'edge' ELSE 'reference' END AS domain
  FROM orders
), o AS (
  SELECT *, CASE WHEN received_ns - observed_ns < 0 THEN 4 WHEN received_ns - observed_ns <= 2000000000 THEN 0 WHEN received_ns - observed_ns <= 10000000000 THEN 1
    WHEN received_ns - observed_ns <= 60000000000 THEN 2 ELSE 3 END AS freshness FROM o1
)"""
H = """
h AS (
  SELECT l_orderkey AS exchange_id, l_linenumber - 1 AS hop_index, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS dwell_ns,
    CASE WHEN min(l_returnflag) = 'R' THEN CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) END AS queue_dwell_ns
  FROM lineitem GROUP BY 1, 2
)"""
R = "r AS (SELECT path, rtt_ns - coalesce((SELECT sum(dwell_ns) FROM h WHERE h.exchange_id = o.exchange_id), 0) AS v FROM o)"
C = f"""
c AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS domain, CASE WHEN s_suppkey % 11 = 0 THEN 'other' ELSE 'reference' END AS reference,
    CASE WHEN s_suppkey % 5 = 0 THEN 'unsynced' WHEN s_suppkey % 5 = 1 THEN 'holdover' ELSE 'synchronized' END AS sync_state,
    CAST(round(s_acctbal * 100) AS BIGINT) * 2 AS offset_ns, CAST((s_suppkey % 7) * 250000 AS BIGINT) AS uncertainty_ns,
    CAST(1 + (s_suppkey % 3) * 1000000000000 AS BIGINT) AS valid_for_ns,
    CAST({NOW} - (s_suppkey % 13) * 100000000000 + CASE WHEN s_suppkey % 17 = 3 THEN 10000000000000 ELSE 0 END AS BIGINT) AS observed_ns, 2 AS revision
  FROM supplier
)"""
P = """
p AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 10 = 9 THEN 'reference' ELSE CAST(l_suppkey AS VARCHAR) END AS a,
    CASE WHEN l_partkey % 4 = 0 THEN 'reference' WHEN l_partkey % 4 = 1 THEN CAST(l_suppkey AS VARCHAR) WHEN l_partkey % 50 = 2 THEN NULL ELSE CAST(l_suppkey + 1 AS VARCHAR) END AS b,
    l_orderkey * 1000000 AS entry_ns, l_orderkey * 1000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS exit_ns
  FROM lineitem
)"""


def _b(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _floor(a: str, n: str) -> str:
    """Floored mean of a HUGEINT sum."""
    return f"CASE WHEN {n} > 0 THEN {_b(f'({a} - ((({a}) % {n}) + {n}) % {n}) // {n}')} END"


def _rem(a: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {_b(f'((({a}) % {n}) + {n}) % {n}')} ELSE 0 END"


def _stats(v: str, keys: str, source: str, probes: str = "", where: str = "TRUE") -> str:
    """Exact distribution of v by keys, quantiles by rank after a full sort."""
    over = f"PARTITION BY {keys}" if keys else ""
    names = {"p50": (50, 100), "p90": (90, 100), "p99": (99, 100), "p999_1000": (999, 1000)}
    qs = ", ".join(f"max(CASE WHEN rn = greatest(1, ({names[p][0]} * nn + {names[p][1] - 1}) // {names[p][1]}) THEN {v} END) AS {p}" for p in probes.split())
    k = f"{keys}, " if keys else ""
    return f"""
  SELECT {k}count({v}) AS n, min({v}) AS min_ns, max({v}) AS max_ns, {_b(f'sum({v})')} AS sum_ns, {_floor(f'sum({v})', f'count({v})')} AS mean_ns,
    {_rem(f'sum({v})', f'count({v})')} AS remainder_ns{', ' + qs if qs else ''}
  FROM (SELECT {k}{v}, row_number() OVER ({over} ORDER BY {v}) AS rn, count({v}) OVER ({over}) AS nn FROM {source} WHERE {where}) {f'GROUP BY {keys}' if keys else ''}"""


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(c.strip() for c in ctes) + "\n"


def _bucket(v: str, bounds: list[int]) -> str:
    return f"CASE WHEN {v} < 0 THEN -1 ELSE CAST(len(list_filter({bounds}::BIGINT[], lambda b: {v} >= b)) AS INTEGER) END"


_BOUNDS = default_bounds()
_REQ = f"path = '1-URGENT' AND generation = 'gen.1997' AND domain = 'reference' AND received_ns >= {Y1996} AND received_ns < {Y1999}"
_OK = "state NOT IN (2, 4, 5, 6, 7)"


def _classes(mode: str) -> str:
    stale = f"{_OK} AND NOT (state = 0 AND freshness <= 1)" if mode == "current" else "FALSE"
    mine = "path = '1-URGENT' AND generation = 'gen.1997'"
    inside = f"received_ns >= {Y1996} AND received_ns < {Y1999}"
    c = lambda x: f"count(*) FILTER (WHERE {x})"
    return f"""SELECT '{mode}' AS mode, count(*) AS considered, {c("path <> '1-URGENT'")} AS other_path, {c("path = '1-URGENT' AND generation <> 'gen.1997'")} AS other_generation,
  {c(f"{mine} AND domain <> 'reference'")} AS clock_domain_mismatch, {c(f"{mine} AND domain = 'reference' AND NOT ({inside})")} AS out_of_window,
  {c(f"{_REQ} AND state = 4")} AS conflicting, {c(f"{_REQ} AND state IN (2, 5, 6, 7)")} AS unsupported, {c(f"{_REQ} AND {stale}")} AS stale, {c(f"{_REQ} AND {_OK} AND NOT ({stale})")} AS included FROM o"""


def _history(lo: int, hi: int, width: int, current: bool) -> str:
    stale = f"({_OK} AND NOT (state = 0 AND freshness <= 1))" if current else "FALSE"
    own = f"({_OK} AND NOT {stale})"
    return f"""
  x AS (SELECT *, CAST((received_ns - {lo}) // {width} AS INTEGER) AS bucket, {own} AS own, {stale} AS old FROM o
        WHERE path = '1-URGENT' AND generation = 'gen.1997' AND domain = 'reference' AND received_ns >= {lo} AND received_ns < {hi}),
  cnt AS (SELECT bucket, count(*) AS considered, count(*) FILTER (WHERE own) AS included, count(*) FILTER (WHERE state = 4) AS conflicting,
            count(*) FILTER (WHERE state IN (2, 5, 6, 7)) AS unsupported, count(*) FILTER (WHERE old) AS stale,
            CASE WHEN count(*) FILTER (WHERE own) = 0 THEN 5 ELSE 0 END AS state, max(freshness) FILTER (WHERE own) AS freshness FROM x GROUP BY bucket),
  st AS ({_stats('rtt_ns', 'bucket', 'x', 'p50 p99', 'own')})"""


def _compare_sql(ceiling: int) -> str:
    def single(s: str) -> str:
        age = f"({NOW} - {s}.observed_ns)"
        return f"CASE WHEN {s}.domain IS NULL THEN 'unknown:clock_offset_unavailable' WHEN {s}.sync_state = 'unsynced' THEN 'refused:clock_unsynced' WHEN {age} < 0 THEN 'conflicting:clock_offset_unavailable' WHEN {age} > {s}.valid_for_ns THEN 'stale:clock_sync_expired' END"

    def conf(s: str) -> str:
        return f"CASE WHEN {s}.sync_state = 'holdover' THEN 3 WHEN {NOW} - {s}.observed_ns > {s}.valid_for_ns // 2 THEN 1 ELSE 0 END"

    return f"""
{P.strip()}, w AS (
  SELECT p.*, CASE WHEN a = 'reference' THEN 0 ELSE ca.uncertainty_ns END + CASE WHEN b = 'reference' THEN 0 ELSE cb.uncertainty_ns END AS unc, ca.offset_ns AS ao, cb.offset_ns AS bo,
    {conf('ca')} AS cfa, {conf('cb')} AS cfb,
    CASE WHEN a IS NULL OR b IS NULL THEN 'unknown:clock_domain_missing' WHEN a = b THEN 'comparable:clock_self_comparable' ELSE coalesce(
      CASE WHEN a <> 'reference' THEN {single('ca')} END, CASE WHEN b <> 'reference' THEN {single('cb')} END,
      CASE WHEN (CASE WHEN a = 'reference' THEN cb.reference <> 'reference' WHEN b = 'reference' THEN ca.reference <> 'reference' ELSE ca.reference <> cb.reference END) THEN 'conflicting:clock_reference_mismatch' END,
      CASE WHEN CASE WHEN a = 'reference' THEN 0 ELSE ca.uncertainty_ns END + CASE WHEN b = 'reference' THEN 0 ELSE cb.uncertainty_ns END > {ceiling} THEN 'refused:clock_uncertainty_exceeded' END,
      'comparable:clock_comparable') END AS why
  FROM p LEFT JOIN c ca ON p.a = ca.domain LEFT JOIN c cb ON p.b = cb.domain
), v AS (
  SELECT *, split_part(why, ':', 1) AS verdict, split_part(why, ':', 2) AS reason,
    CASE WHEN split_part(why, ':', 1) <> 'comparable' THEN 4 WHEN a = b THEN 0 WHEN a = 'reference' THEN cfb WHEN b = 'reference' THEN cfa ELSE greatest(cfa, cfb) END AS confidence,
    CASE WHEN split_part(why, ':', 1) = 'comparable' THEN CASE WHEN a = b THEN 0 ELSE unc END END AS uncertainty_ns,
    CASE WHEN a = b OR a = 'reference' THEN 0 ELSE ao END AS lo, CASE WHEN a = b OR b = 'reference' THEN 0 ELSE bo END AS ro FROM w
)"""


_SEQ = """
s1 AS (SELECT *, max(sequence) OVER (PARTITION BY {k} ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
         row_number() OVER (PARTITION BY {k}, sequence ORDER BY arrival) AS again FROM e),
s AS (SELECT *, CASE WHEN seen IS NULL THEN 'first' WHEN sequence > seen THEN 'advance' WHEN again > 1 THEN 'replay' ELSE 'reordered' END AS decision,
        CASE WHEN sequence > seen THEN sequence - seen - 1 ELSE 0 END AS gap FROM s1)"""
_SES = """
b AS (SELECT source, epoch, incarnation, min(arrival) AS born FROM e GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY born) AS session FROM b),
t AS (SELECT e.*, n.session, n.born, (SELECT max(m.session) FROM n m WHERE m.source = e.source AND m.born <= e.arrival) AS newest FROM e JOIN n USING (source, epoch, incarnation)),
ses AS (SELECT t.exchange_id, CAST(t.session AS INTEGER) AS session, t.session = t.newest AS session_current,
   CASE WHEN t.arrival = t.born AND t.session > 1 THEN CASE WHEN (SELECT m.epoch FROM n m WHERE m.source = t.source AND m.session = t.session - 1) <> t.epoch THEN 'epoch_advanced' ELSE 'incarnation_changed' END
     WHEN t.session < t.newest THEN 'session_superseded' END AS session_reason FROM t)"""
_REV = "rev AS (SELECT exchange_id, source_revision >= max(source_revision) OVER (PARTITION BY source, epoch, incarnation ORDER BY arrival) AS revision_current FROM e)"
_ADM = _with(E, _SEQ.format(k="source, epoch, incarnation"), _SES, _REV, """
adm AS (SELECT s.exchange_id, s.source, decision, gap, session_current, session_reason,
  CASE WHEN decision = 'replay' OR source_revision > 2 THEN 'rejected' WHEN decision = 'reordered' OR NOT session_current OR NOT revision_current OR source_revision < 2 THEN 'historical' ELSE 'current' END AS verdict
  FROM s JOIN ses USING (exchange_id) JOIN rev USING (exchange_id))""")  # fmt: skip
_GEN = "g AS (SELECT DISTINCT generation, CASE WHEN CAST(substr(generation, 5) AS INT) > 1995 THEN 'gen.' || (CAST(substr(generation, 5) AS INT) - 1) END AS supersedes FROM o)"
_FNV = "lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(hex({t})) // 2 + 1), lambda i: CAST('0x' || substr(hex({t}), 2 * i - 1, 2) AS HUGEINT))), lambda s, x: CAST(((xor(CAST(s AS UBIGINT), CAST(x AS UBIGINT)))::HUGEINT * 435 + ((xor(CAST(s AS UBIGINT), CAST(x AS UBIGINT)))::HUGEINT % 16777216) * 1099511627776) % 18446744073709551616 AS HUGEINT))::UBIGINT)), 16, '0')"


def _fnv(text: str) -> str:
    return _FNV.format(t=f"({text})")


_BASE = f"""st AS ({_stats('rtt_ns', 'path, generation, domain', 'o', 'p99')}), bl AS (SELECT {_fnv("'baseline|' || path || '|' || generation || '|' || domain || '|1|yearly'")} AS baseline_id, path, generation, domain, 'yearly' AS name, 1 AS revision,
  CAST({NOW - 5_000_000_000} AS BIGINT) AS created_ns, n, min_ns, max_ns, sum_ns, mean_ns, p99 FROM st)"""
_CMP = """
cur AS (SELECT s.path, CASE WHEN s.generation = 'gen.1997' THEN 'gen.1996' ELSE s.generation END AS generation, s.domain, s.n, s.min_ns, s.max_ns, s.mean_ns, s.p99,
   CASE WHEN s.generation <> 'gen.1999' THEN x.baseline_id END AS baseline_id FROM st s LEFT JOIN (SELECT * FROM bl WHERE generation = 'gen.1996') x ON x.path = s.path AND x.domain = s.domain),
m AS (SELECT cur.*, b.generation AS bg, b.mean_ns AS bmean, b.min_ns AS bmin, b.max_ns AS bmax, b.p99 AS bp99, b.n AS bn, b.path AS bp,
   CASE WHEN b.path IS NULL THEN ['missing'] ELSE list_filter([CASE WHEN cur.generation <> b.generation THEN 'generation' END, CASE WHEN cur.n < 8 OR b.n < 8 THEN 'too_few_samples' END], lambda v: v IS NOT NULL) END AS mm
   FROM cur LEFT JOIN bl b USING (baseline_id))"""
_J = "(SELECT path, hop_index FROM (SELECT DISTINCT path FROM o), (SELECT unnest(range(0, 7)) AS hop_index))"
_ACC = """
acc AS (SELECT o.*, (SELECT count(*) FROM h WHERE h.exchange_id = o.exchange_id AND hop_index < {n}) AS known_hops, (SELECT sum(dwell_ns) FROM h WHERE h.exchange_id = o.exchange_id AND hop_index < {n}) AS total FROM o),
ac AS (SELECT *, known_hops = {n} AND rtt_ns >= 0 AS complete, CASE WHEN known_hops = {n} AND rtt_ns >= 0 THEN total END AS accounted, CASE WHEN known_hops = {n} AND rtt_ns >= 0 THEN rtt_ns - total END AS residual FROM acc)"""


def _verdict(partial: str, tolerance: int) -> str:
    return _with(O, H, _ACC.format(n=2), f"""
g AS (SELECT path, generation, count(*) AS included, count(*) FILTER (WHERE complete) AS complete, count(*) FILTER (WHERE NOT complete) AS incomplete,
  bool_or(domain <> 'reference' AND generation = 'gen.1998') AS refused, bool_or(source = 'src.3') AS can, sum(rtt_ns) FILTER (WHERE complete) AS e2e, sum(accounted) AS acc, sum(residual) AS res,
  min(residual) AS lo, max(residual) AS hi, count(*) FILTER (WHERE residual < 0) AS neg FROM ac GROUP BY path, generation),
k AS (SELECT *, CASE WHEN NOT can THEN 'unsupported' WHEN refused OR complete = 0 THEN 'refused' WHEN incomplete > 0 THEN '{partial}' ELSE 'observed_decomposition' END AS kind FROM g),
z AS (SELECT *, {_floor('e2e', 'complete')} AS mean, CASE WHEN kind IN ('partial', 'observed_decomposition') AND acc <> 0 THEN {_floor('acc', 'complete')} END AS am FROM k)
""") + f"""SELECT path, generation, included, complete, incomplete, kind, mean AS e2e_mean_ns, {_floor('res', 'complete')} AS residual_mean_ns, {_b('lo')} AS residual_min_ns, {_b('hi')} AS residual_max_ns,
  neg AS negative_residuals, am AS accounted_mean_ns, mean - am AS unaccounted_mean_ns, CASE WHEN am IS NULL OR mean IS NULL THEN NULL WHEN abs(mean - am) <= {tolerance} THEN 'residual_within_tolerance' ELSE 'unaccounted_residual' END AS residual_reading FROM z"""  # fmt: skip


_VAL = """
val AS (SELECT exchange_id, CASE WHEN exchange_id % 41 = 0 THEN ['unknown_path'] WHEN exchange_id % 43 = 0 THEN ['unknown_source'] WHEN exchange_id % 47 = 0 THEN ['unknown_generation'] ELSE list_sort(list_distinct(list_filter([
  CASE WHEN exchange_id % 17 = 3 OR exchange_id % 29 = 0 AND rtt_ns > 0 OR exchange_id % 31 = 0 OR exchange_id % 29 = 0 AND rtt_ns <> 0 THEN 'invalid_field_value' END,
  CASE WHEN exchange_id % 19 < 1 THEN 'revision_changed' END,
  CASE WHEN domain <> (CASE WHEN exchange_id % 23 = 0 THEN 'edge' ELSE 'reference' END) THEN 'clock_reference_mismatch' END,
  CASE WHEN exchange_id % 37 = 0 THEN 'hop_not_contiguous' END], lambda v: v IS NOT NULL))) END AS reasons FROM o)"""
_I64 = "BETWEEN -9223372036854775808 AND 9223372036854775807"

ALL: dict[str, str] = {
    "summary_by_path": _with(E) + _stats("rtt_ns", "path", "e", "p50 p90 p99 p999_1000").replace("p999_1000", "p999_1000"),
    "summary_windowed": _with(E) + _stats("rtt_ns", "path", "e", "p50", f"received_ns >= {JAN5} AND received_ns < {JAN25}"),
    "summary_by_source": _with(E) + "SELECT path, count(*) AS n_sources, min(source) AS first_source, max(source) AS last_source, max(n) AS busiest_n FROM (SELECT path, source, count(*) AS n FROM e GROUP BY ALL) GROUP BY path",
    "summary_of_request": _with(O) + _stats("rtt_ns", "path, generation", "o", "p50 p90 p99 p999_1000", f"{_REQ} AND {_OK}"),
    "record_class_counts": _with(O) + _classes("current") + " UNION ALL " + _classes("historical"),
    "histogram_long": _with(E) + f"SELECT path, bucket, CASE WHEN bucket = 0 THEN 0 ELSE ({_BOUNDS}::BIGINT[])[bucket] END AS lower_ns, ({_BOUNDS}::BIGINT[])[bucket + 1] AS upper_ns, count(*) AS n FROM (SELECT path, {_bucket('rtt_ns', _BOUNDS)} AS bucket FROM e) GROUP BY path, bucket",
    "histogram_underflow": _with(O, H, R) + f"SELECT {_bucket('v', [10**k for k in range(3, 9)])} AS bucket, count(*) AS n FROM r GROUP BY 1",
    "quantiles_rational": _with(E, "k AS (SELECT path, rtt_ns, row_number() OVER (PARTITION BY path ORDER BY rtt_ns) AS rn, count(*) OVER (PARTITION BY path) AS n FROM e)") + "SELECT path, num, den, rtt_ns AS value FROM k, (VALUES (1, 3), (2, 3), (1, 1000), (999, 1000), (1, 1), (50, 100)) q(num, den) WHERE rn = greatest(1, (num * n + den - 1) // den)",
    "floor_mean_negative": _with(O, H, R, "rr AS (SELECT path, CAST(v AS BIGINT) AS v FROM r)") + _stats("v", "path", "rr", "p50"),
    "sum_overflow": _with(E, "x AS (SELECT path, rtt_ns * 10000000000 AS v FROM e)", f"y AS (SELECT path, count(*) AS n, min(v) AS min_ns, max(v) AS max_ns, sum(v) AS s, sum(v) {_I64} AS ok FROM x GROUP BY path)")
    + f"SELECT path, n, min_ns, max_ns, CASE WHEN ok THEN {_b('s')} END AS sum_ns, NOT ok AS sum_overflow, CASE WHEN ok THEN {_floor('s', 'n')} END AS mean_ns, CASE WHEN ok THEN {_rem('s', 'n')} ELSE 0 END AS remainder_ns FROM y",
    "checked_arithmetic": _with(E, "x AS (SELECT exchange_id, (rtt_ns * 10000000000)::HUGEINT AS v FROM e)") + ", ".join(["SELECT exchange_id", *[f"CASE WHEN {x} {_I64} THEN {_b(x)} END AS {n}" for n, x in (("sum", "(v + v)"), ("difference", "(-v - v)"), ("product", "(v * 10)"))]]) + " FROM x",
    "hop_summary": _with(O, H, f"""j AS (SELECT o.path, s.hop_index, h.dwell_ns, h.queue_dwell_ns, h.exchange_id IS NOT NULL AS seen FROM o JOIN {_J} s USING (path) LEFT JOIN h ON h.exchange_id = o.exchange_id AND h.hop_index = s.hop_index)""",
        f"st AS ({_stats('dwell_ns', 'path, hop_index', 'j', 'p90', 'dwell_ns IS NOT NULL')})",
        "cn AS (SELECT path, CAST(hop_index AS INTEGER) AS hop_index, count(*) AS exchanges, count(dwell_ns) AS observed, count(*) - count(dwell_ns) AS missing, count(queue_dwell_ns) AS queue_observed, count(*) FILTER (WHERE seen AND queue_dwell_ns IS NULL) AS queue_unknown FROM j GROUP BY 1, 2)")
    + f"SELECT cn.*, {_b('observed * 1000000 // exchanges')} AS coverage_ppm, CASE WHEN observed = 0 THEN 'missing' WHEN missing > 0 THEN 'incomplete' ELSE 'observed' END AS hop_state, min_ns, max_ns, sum_ns, mean_ns, coalesce(remainder_ns, 0) AS remainder_ns, p90 FROM cn LEFT JOIN st USING (path, hop_index)",
    "hop_coverage": _with(O, H) + f"SELECT path, count(*) * 7 AS positions, {_b('sum(k)')} AS observed, {_b('sum(k) * 1000000 // (count(*) * 7)')} AS coverage_ppm FROM (SELECT o.path, (SELECT count(*) FROM h WHERE h.exchange_id = o.exchange_id AND hop_index < 7) AS k FROM o) GROUP BY path",
    "undeclared_hops": _with(O, H) + "SELECT path, hop_index, count(*) AS n FROM h JOIN o USING (exchange_id) WHERE hop_index < 0 OR hop_index >= 5 GROUP BY ALL",
    "history_buckets": _with(O, _history(Y1997, Y1998, 30 * DAY, False)) + f"SELECT cnt.bucket, {Y1997} + cnt.bucket::BIGINT * {30 * DAY} AS from_ns, {Y1997} + (cnt.bucket::BIGINT + 1) * {30 * DAY} AS to_ns, considered, included, conflicting, unsupported, stale, state, freshness, min_ns, max_ns, sum_ns, mean_ns, remainder_ns, p50, p99 FROM cnt LEFT JOIN st USING (bucket)",
    "history_dense": _with(O, _history(Y1996, Y1999, 7 * DAY, True)) + f"SELECT CAST(i AS INTEGER) AS bucket, {Y1996} + i * {7 * DAY} AS from_ns, {Y1996} + (i + 1) * {7 * DAY} AS to_ns, coalesce(considered, 0) AS considered, coalesce(included, 0) AS included, coalesce(conflicting, 0) AS conflicting, coalesce(unsupported, 0) AS unsupported, coalesce(stale, 0) AS stale, coalesce(state, 5) AS state, sum_ns, mean_ns FROM (SELECT unnest(generate_series(0, {-(-(Y1999 - Y1996) // (7 * DAY)) - 1})) AS i) LEFT JOIN cnt ON cnt.bucket = i LEFT JOIN st ON st.bucket = i",
    "freshness_classes": _with(O) + "SELECT ['fresh', 'aging', 'stale', 'expired', 'unknown'][freshness + 1] AS freshness, state = 0 AND freshness <= 1 AS usable, count(*) AS n FROM o GROUP BY ALL",
    "evidence_merge": _with(O) + """SELECT path, generation, CASE WHEN max(state) = 6 THEN 'unsupported' WHEN max(state) = 4 THEN 'conflicting' ELSE 'observed' END AS state, ['fresh', 'aging', 'stale', 'expired', 'unknown'][max(freshness) + 1] AS freshness,
  concat_ws(',', CASE WHEN bool_or(domain <> 'reference') THEN 'clock_domain_missing' END, CASE WHEN bool_or(freshness = 4) THEN 'freshness_unknown' END, CASE WHEN bool_or(state = 4) THEN 'sequence_replay' END) AS reasons FROM o GROUP BY path, generation""",
    "clock_latest": _with(C) + "SELECT * FROM c",
    "clock_compare": _with(C, _compare_sql(1_000_000)) + f"SELECT verdict, reason, confidence, count(*) AS n, {_b('sum(uncertainty_ns)')} AS uncertainty_ns FROM v GROUP BY ALL",
    "cross_domain_dwell": _with(C, _compare_sql(3_000_000), """
d AS (SELECT *, (exit_ns - ro) - (entry_ns - lo) AS dw FROM v), d2 AS (SELECT *, CASE WHEN verdict <> 'comparable' THEN verdict WHEN dw < 0 THEN 'conflicting' ELSE 'observed' END AS dwell_state FROM d)""")
    + f"SELECT dwell_state, count(*) AS n, {_b('sum(CASE WHEN dwell_state = $$observed$$ THEN dw END)')} AS dwell_ns, {_b('sum(CASE WHEN dwell_state = $$observed$$ THEN uncertainty_ns END)')} AS uncertainty_ns FROM d2 GROUP BY 1",
    "clock_age": _with(C, f"""
q AS (SELECT CASE WHEN s_suppkey % 7 = 5 THEN 'reference' ELSE CAST(s_suppkey AS VARCHAR) END AS domain, s_suppkey, {NOW} - s_suppkey * 1000000000 AS observed_at_ns FROM supplier),
w AS (SELECT q.*, c.offset_ns, c.sync_state, CASE WHEN q.domain = 'reference' THEN 'comparable' WHEN c.domain IS NULL THEN 'unknown' WHEN c.reference <> 'reference' THEN 'conflicting' WHEN c.sync_state = 'unsynced' THEN 'refused'
  WHEN {NOW} - c.observed_ns < 0 OR {NOW} - c.observed_ns > c.valid_for_ns THEN 'stale' ELSE 'comparable' END AS verdict FROM q LEFT JOIN c ON c.domain = q.domain)""")
    + f"SELECT domain, s_suppkey, observed_at_ns, verdict, CASE WHEN verdict = 'comparable' THEN {NOW} - (observed_at_ns - CASE WHEN domain = 'reference' THEN 0 ELSE offset_ns END) END AS age_ns, CASE WHEN domain = 'reference' THEN 0 WHEN verdict <> 'comparable' THEN 4 WHEN sync_state = 'holdover' THEN 3 ELSE 1 END AS confidence FROM w",
    "queue_dwell": f"""WITH x AS (SELECT l_partkey % 7 <> 0 AS bound, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 11 = 1 THEN 'q2' ELSE 'q1' END AS queue, l_partkey % 3 <> 0 AS declared, CASE WHEN l_partkey % 13 <> 4 THEN l_orderkey END AS a, l_orderkey + CAST(l_quantity AS BIGINT) - 10 AS b FROM lineitem),
y AS (SELECT *, CASE WHEN NOT bound AND queue IS NULL THEN 'absent' WHEN NOT bound THEN 'unsupported' WHEN queue IS NULL THEN 'missing' WHEN queue <> 'q1' THEN 'conflicting' WHEN NOT declared THEN 'unsupported' WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN b < a THEN 'conflicting' ELSE 'observed' END AS queue_state FROM x)
SELECT queue_state, count(*) AS n, {_b("sum(CASE WHEN queue_state = 'observed' THEN b - a END)")} AS queue_dwell_ns FROM y GROUP BY 1""",
    "validation_reasons": _with(O, _VAL) + "SELECT exchange_id, array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS rejected FROM val",
    "reason_histogram": _with(O, _VAL) + "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM val) GROUP BY reason",
    "sequence_fence": _with(E, _SEQ.format(k="source")) + "SELECT exchange_id, source, sequence, seen, decision, gap FROM s",
    "sequence_gaps": _with(E, _SEQ.format(k="source")) + f"SELECT source, count(*) AS gaps, {_b('sum(gap)')} AS skipped FROM s WHERE gap > 0 GROUP BY source",
    "replay_rejects": _with(E, _SEQ.format(k="source")) + "SELECT decision, count(*) AS n FROM s GROUP BY decision",
    "session_fence": _with(E, _SES) + "SELECT * FROM ses",
    "revision_fence": _with(E, _REV) + "SELECT exchange_id, revision_current, CASE WHEN source_revision > 2 THEN 'rejected' WHEN source_revision < 2 THEN 'historical' ELSE 'current' END AS registry FROM rev JOIN e USING (exchange_id)",
    "generation_fence": _with(O, _GEN) + "SELECT exchange_id, generation IN (SELECT supersedes FROM g WHERE supersedes IS NOT NULL) AS historical FROM o",
    "admission_verdicts": _ADM + "SELECT exchange_id, decision, gap, session_current, session_reason, verdict FROM adm",
    "admission_report": _ADM + f"SELECT count(*) AS received, count(*) FILTER (WHERE verdict = 'current') AS current, count(*) FILTER (WHERE verdict = 'historical') AS historical, count(*) FILTER (WHERE verdict = 'rejected') AS rejected, count(*) FILTER (WHERE gap > 0) AS gaps, {_b('sum(gap)')} AS skipped, count(*) FILTER (WHERE decision = 'reordered') AS reordered, count(*) FILTER (WHERE decision = 'replay') AS replays, count(*) FILTER (WHERE session_reason = 'epoch_advanced') AS epochs_advanced FROM adm",
    "admission_bounds": _with(E) + "SELECT source, count(*) AS sessions, max(k) AS sequences FROM (SELECT source, epoch, incarnation, count(DISTINCT sequence) AS k FROM e GROUP BY ALL) GROUP BY source HAVING count(*) > 3 OR max(k) > 20",
    "baseline_create": _with(O, _BASE) + "SELECT * FROM bl",
    "baseline_add": _with(O, _BASE) + "SELECT path, generation, domain, n FROM bl WHERE generation >= 'gen.1998'",
    "baseline_latest": _with(O, _BASE) + """SELECT path, domain, max(CASE WHEN generation = 'gen.1997' THEN path || '/' || generation || '/' || domain END) AS baseline_id, max(CASE WHEN generation = 'gen.1997' THEN n END) AS n, max(CASE WHEN generation = 'gen.1997' THEN mean_ns END) AS mean_ns,
  NOT bool_or(generation = 'gen.1997') AS other_generation_only FROM bl WHERE path <> '5-LOW' OR generation < 'gen.1997' GROUP BY path, domain""",
    "baseline_compare": _with(O, _BASE, _CMP) + f"""SELECT path, generation, domain, n, min_ns, max_ns, mean_ns, p99, array_to_string(mm, ',') AS mismatches, len(mm) = 0 AS applicable, CASE WHEN len(mm) = 0 THEN mean_ns - bmean END AS mean_delta_ns, CASE WHEN len(mm) = 0 THEN min_ns - bmin END AS min_delta_ns,
  CASE WHEN len(mm) = 0 THEN max_ns - bmax END AS max_delta_ns, CASE WHEN len(mm) = 0 THEN p99 - bp99 END AS p99_delta_ns, CASE WHEN len(mm) = 0 THEN {_b('mean_ns::HUGEINT * 1000000 // bmean')} END AS ratio_ppm,
  CASE WHEN len(mm) = 0 THEN CASE WHEN mean_ns - bmean >= 100000 THEN 'elevated' WHEN mean_ns - bmean >= 100 THEN 'watch' WHEN mean_ns - bmean <= -100000 THEN 'suppressed_elevated' WHEN mean_ns - bmean <= -100 THEN 'suppressed' ELSE 'none' END END AS anomaly,
  CASE WHEN len(mm) = 0 THEN CASE WHEN n >= 32 THEN 'high' ELSE 'moderate' END END AS confidence FROM m""",
    "baseline_mismatches": _with(O, _BASE, _CMP) + "SELECT path, mismatch, count(*) AS n FROM (SELECT path, unnest(mm) AS mismatch FROM m) GROUP BY ALL",
    "anomaly_classes": _with(O, H, f"a AS (SELECT o.path, generation, CAST(hop_index AS INTEGER) AS hop_index, count(*) AS n, {_floor('sum(dwell_ns)', 'count(*)')} AS mean FROM o JOIN h USING (exchange_id) WHERE hop_index < 7 AND generation IN ('gen.1997', 'gen.1998') GROUP BY ALL)",
        f"z AS (SELECT p.path, i.hop_index, p.generation, coalesce(a.n, 0) AS n, a.mean FROM (SELECT DISTINCT path, generation FROM o WHERE generation IN ('gen.1997', 'gen.1998')) p CROSS JOIN (SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS hop_index) i LEFT JOIN a USING (path, generation, hop_index))")
    + f"""SELECT path, hop_index, x.n AS current_n, y.n AS baseline_n, x.mean - y.mean AS mean_delta_ns, CASE WHEN x.mean IS NULL OR y.mean IS NULL OR y.mean <= 0 THEN 0 ELSE {_b('greatest(x.mean, 0)::HUGEINT * 1000000 // y.mean')} END AS ratio_ppm,
  CASE WHEN x.n < 8 OR y.n < 8 THEN 'unknown' WHEN x.mean - y.mean >= 200000 THEN 'elevated' WHEN x.mean - y.mean >= 20000 THEN 'watch' WHEN x.mean - y.mean <= -200000 THEN 'suppressed_elevated' WHEN x.mean - y.mean <= -20000 THEN 'suppressed' ELSE 'none' END AS anomaly,
  CASE WHEN x.n < 8 OR y.n < 8 THEN 'low' WHEN x.n >= 32 THEN 'high' ELSE 'moderate' END AS confidence FROM (SELECT * FROM z WHERE generation = 'gen.1998') x JOIN (SELECT * FROM z WHERE generation = 'gen.1997') y USING (path, hop_index)""",
    "attribution_exchanges": _with(O, H, _ACC.format(n=2)) + f"SELECT exchange_id, path, rtt_ns, CAST(known_hops AS INTEGER) AS known_hops, {_b('accounted')} AS accounted_ns, {_b('residual')} AS residual_ns, complete FROM ac",
    "attribution_hops": _with(O, H, _ACC.format(n=3), "j AS (SELECT ac.path, ac.complete, i.hop_index, h.dwell_ns FROM ac CROSS JOIN (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS hop_index) i LEFT JOIN h ON h.exchange_id = ac.exchange_id AND h.hop_index = i.hop_index)",
        "g AS (SELECT path, hop_index, count(CASE WHEN complete THEN dwell_ns END) AS observed, count(*) - count(dwell_ns) AS missing, sum(CASE WHEN complete THEN dwell_ns END) AS s FROM j GROUP BY ALL)")
    + f"SELECT path, hop_index, observed, missing, {_b('s')} AS sum_ns, {_floor('s', 'observed')} AS mean_ns, {_b('CASE WHEN observed + missing = 0 THEN 0 ELSE observed * 1000000 // (observed + missing) END')} AS coverage_ppm, {_b('coalesce(s * 1000000 // sum(s) OVER (PARTITION BY path), 0)')} AS share_ppm FROM g",
    "attribution_verdict": _verdict("refused", 1_000),
    "attribution_partial": _verdict("partial", 5_000_000),
    "provenance": _with(O) + f"SELECT exchange_id, arrival, source, received_ns, rtt_ns FROM o WHERE {_REQ} AND {_OK} ORDER BY arrival LIMIT 64",
    "export_samples": _with(O, H, """j AS (SELECT o.*, coalesce((SELECT string_agg('{"index":' || hop_index || ',"dwell_ns":' || dwell_ns || ',"queue_dwell_ns":' || coalesce(CAST(queue_dwell_ns AS VARCHAR), 'null') || '}', ',' ORDER BY hop_index) FROM h WHERE h.exchange_id = o.exchange_id AND hop_index < 7), '') AS hops FROM o),
k AS (SELECT exchange_id, '{"exchange_id":' || exchange_id || ',"path":"' || path || '","generation":"' || generation || '","source":"' || source || '","received_ns":' || received_ns || ',"observed_ns":' || observed_ns || ',"rtt_ns":' || rtt_ns || ',"hops":[' || hops || ']}' AS sample FROM j)""") + "SELECT exchange_id, sample, sha256(sample) AS sha256 FROM k",
    "export_csv_pivot": _with(O, H) + "SELECT o.exchange_id, path, generation, source, received_ns, observed_ns, rtt_ns, " + ", ".join(f"h{i}.dwell_ns AS hop{i}_dwell_ns, h{i}.queue_dwell_ns AS hop{i}_queue_dwell_ns" for i in range(3)) + " FROM o " + " ".join(f"LEFT JOIN h h{i} ON h{i}.exchange_id = o.exchange_id AND h{i}.hop_index = {i}" for i in range(3)),
    "export_limit_accounting": _with(O) + "SELECT path, generation, count(*) AS matched, least(count(*), 400) AS exported, greatest(count(*) - 400, 0) AS skipped, count(*) > 400 AS truncated FROM o GROUP BY path, generation",
    "identity_fnv": f"SELECT p_partkey, {_fnv('concat_ws($$|$$, p_name, p_brand, p_partkey)')} AS identity FROM part",
    "identity_crc32c": """SELECT p_partkey, CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(t) + 1), lambda i: ascii(substr(t, i, 1))::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 2197175160 ELSE 0 END)))) AS BIGINT) AS crc
FROM (SELECT p_partkey, concat_ws('|', p_name, p_brand, p_partkey) AS t FROM part)""",
    "integer_roots": """SELECT o_orderkey, n, CASE WHEN n >= 0 THEN CAST(r - (CASE WHEN r::HUGEINT * r > n THEN 1 ELSE 0 END) + (CASE WHEN (r + 1)::HUGEINT * (r + 1) <= n THEN 1 ELSE 0 END) AS BIGINT) END AS root
FROM (SELECT o_orderkey, n, CAST(floor(sqrt(greatest(n, 0)::DOUBLE)) AS BIGINT) AS r FROM (SELECT o_orderkey, o_orderkey * o_orderkey + o_custkey % 5 - 2 AS n FROM orders))""",
    "synthetic_exchanges": """WITH k AS (SELECT i, j, ((42 + (i * 3 + j + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM range(0, 5000) a(i), range(0, 3) b(j)),
l AS (SELECT i, j, ((xor(z, z >> 30))::UHUGEINT * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM k),
m AS (SELECT i, j, ((xor(z, z >> 27))::UHUGEINT * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM l),
d AS (SELECT i, j, CAST([1000, 2000, 3000][j + 1] + xor(z, z >> 31) % [59001, 88001, 397001][j + 1]::UBIGINT AS BIGINT) AS ns FROM m)
SELECT i AS sequence, 900000000000 + i * 1000000 AS request_ns, CAST(900000000000 + i * 1000000 + sum(ns) AS BIGINT) AS response_ns, CAST(max(ns) FILTER (j = 0) AS BIGINT) AS hop0_dwell_ns, CAST(max(ns) FILTER (j = 1) AS BIGINT) AS hop1_dwell_ns, CAST(max(ns) FILTER (j = 2) AS BIGINT) AS hop2_dwell_ns FROM d GROUP BY i""",
    "identity_hex": "WITH x AS (SELECT event_id, event_id * 1000003 - 5000015 AS v FROM events) SELECT event_id, CASE WHEN v <> 0 THEN lpad(lower(to_hex(v)), 16, '0') END AS hex, CASE WHEN v <> 0 THEN v END AS number FROM x",
    "format_utc": "WITH x AS (SELECT event_id, epoch_us(ts) * 1000 - ((event_id % 10007) + 10007) % 10007 * 777000000777001 AS ns FROM events) SELECT event_id, ns, strftime(make_timestamp((ns - ((ns % 1000000000) + 1000000000) % 1000000000) // 1000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(((ns % 1000000000) + 1000000000) % 1000000000 AS VARCHAR), 9, '0') || 'Z' AS text, ns AS parsed FROM x",
    "name_validation": r"""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 7 = 0 THEN '-' || p_brand ELSE p_brand END AS name FROM part), y AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN '+' || p_partkey WHEN p_partkey % 5 = 1 THEN p_partkey || '99999999999999999' ELSE name END AS s FROM x)
SELECT p_partkey, name, regexp_full_match(replace(name, '#', ':'), '[A-Za-z0-9_][A-Za-z0-9_.:/@+-]{0,127}') AS valid, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN TRY_CAST(TRY_CAST(s AS HUGEINT) AS BIGINT) END AS number FROM y""",
    "catalog_lineage": _with(O, _GEN, "u AS (SELECT *, generation IN (SELECT supersedes FROM g WHERE supersedes IS NOT NULL) AS old FROM g)") + "SELECT generation, supersedes, old AS is_superseded, NOT old AS is_tip, NOT old AND (SELECT count(*) FROM u WHERE NOT old) = 1 AS is_current FROM u",
    "catalog_upsert": """WITH d AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS name, CAST(1 + o_orderkey % 4 AS INTEGER) AS revision, 'v' || (o_orderkey % 3) AS content, o_orderkey AS arrival FROM orders),
m AS (SELECT *, max(revision) OVER w AS top FROM d WINDOW w AS (PARTITION BY name ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT DISTINCT ON (name, revision) name, revision, content AS first_content FROM d ORDER BY name, revision, arrival)
SELECT m.name, m.revision, m.content, m.arrival, CASE WHEN top IS NULL THEN 'created' WHEN m.revision = top AND m.content = f.first_content THEN 'idempotent' WHEN m.revision > top THEN 'replaced' ELSE 'conflict' END AS outcome FROM m LEFT JOIN f ON f.name = m.name AND f.revision = m.top""",
    "catalog_held": "WITH d AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS name, CAST(1 + o_orderkey % 4 AS INTEGER) AS revision, 'v' || (o_orderkey % 3) AS content, o_orderkey AS arrival FROM orders) SELECT DISTINCT ON (name) name, revision, content, arrival FROM d ORDER BY name, revision DESC, arrival",
    "catalog_dangling": _with(O, _GEN) + "SELECT supersedes, generation FROM g WHERE generation <> 'gen.1997' AND supersedes = 'gen.1997'",
    "recovery_prefix": f"""WITH l AS (SELECT event_id // 100 AS segment, event_id % 100 AS position, value FROM events), f AS (SELECT min(segment * 1000 + position) AS p FROM l WHERE value > 100 AND position > 50 AND segment > 4)
SELECT segment, count(*) AS records, count(*) FILTER (WHERE p IS NULL OR segment * 1000 + position < p) AS kept, count(*) - count(*) FILTER (WHERE p IS NULL OR segment * 1000 + position < p) AS lost FROM l, f GROUP BY segment""",
    "ingest_requests": """SELECT event_id, event_id % 9 NOT IN (4, 5, 7) AS ok, CASE event_id % 9 WHEN 4 THEN 'missing_field' WHEN 5 THEN 'unsupported_operation' WHEN 7 THEN 'malformed_payload' END AS error, CASE WHEN event_id % 9 NOT IN (4, 5, 7) THEN event_type END AS path, CASE WHEN event_id % 9 NOT IN (4, 5, 7) THEN 5::BIGINT END AS rtt_ns
FROM (SELECT *, unnest(CASE WHEN event_id % 9 = 6 THEN [1, 2] ELSE [1] END) AS k FROM events)""",
    "capabilities": "SELECT * FROM (VALUES ('clock comparability', 'real'), ('exact aggregation', 'real'), ('generation-bound baselines', 'real'), ('hop attribution', 'real'), ('keyed admission fences', 'real'), ('causal inference', 'unsupported'), ('traffic control', 'unsupported')) t(capability, status)",
    "stream_fence": _ADM + "SELECT exchange_id, decision, gap, session_current, session_reason, verdict FROM adm",
    "stream_admission": _ADM + f"SELECT decision, verdict, count(*) AS n, {_b('sum(gap)')} AS skipped FROM adm GROUP BY ALL",
}
