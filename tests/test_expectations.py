"""Known expectations on tiny tables, properties on random ones, and the stream against the batch form."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from tracewell.functions import evidence as ev, identity, numeric
from tracewell.operators import admission, attribution, baseline, catalog, clocks, export, summary
from tracewell.plans import queries
from tracewell.plans.policy import DEFAULT, Policy, check_bounds, default_bounds, probe
from tracewell.plans.service import Service
from tracewell.sources import store
from tracewell.streaming import fences

BIG = 2**63 - 1


def values(spark, vs, key="a"):
    return spark.createDataFrame([(key, v) for v in vs], "k string, v long")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


# ---- numbers -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("vs", "want"), [
    ([150, 50, 250, 350, 150], {"n": 5, "min_ns": 50, "max_ns": 350, "sum_ns": 950, "mean_ns": 190, "remainder_ns": 0, "p50": 150, "p90": 350}),
    ([1, 2], {"mean_ns": 1, "remainder_ns": 1}),
    ([-50, 50], {"sum_ns": 0, "mean_ns": 0}),
    ([-1, -2], {"mean_ns": -2, "remainder_ns": 1}),
    ([BIG, BIG], {"sum_ns": None, "mean_ns": None, "sum_overflow": True, "max_ns": BIG, "p50": BIG}),
    ([-BIG - 1, -BIG - 1], {"sum_ns": None, "sum_overflow": True, "min_ns": -BIG - 1, "p90": -BIG - 1}),
    ([None, None], {"n": 0, "min_ns": None, "sum_ns": None, "mean_ns": None, "p50": None}),
    ([None, 7], {"n": 1, "sum_ns": 7, "p50": 7}),
])
def test_distribution(spark, vs, want):
    got = one(numeric.distribution(values(spark, vs), ["k"], "v", ((50, 100), (90, 100))))
    assert {k: got[k] for k in want} == want


def test_distribution_without_keys_and_without_rows(spark):
    assert one(numeric.distribution(values(spark, [1, 5, 9]), [], "v", ((50, 100),)))["p50"] == 5
    assert one(numeric.distribution(values(spark, []), [], "v", ((50, 100),)))["n"] == 0


def test_nearest_rank_is_exact_everywhere(spark):
    rng = random.Random(11)
    groups = {f"g{i}": [rng.randrange(-(10**rng.randrange(1, 19)), 10 ** rng.randrange(1, 19)) for _ in range(rng.randrange(1, 120))] for i in range(20)}
    groups |= {"same": [7] * 50, "edge": [-BIG - 1, -1, 0, 1, 63, 64, 65, 127, 128, 2**53, 2**53 + 1, 2**54 - 1, 2**54, BIG - 1, BIG], None: [3, 1, 2]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v long").repartition(5)
    probes = ((1, 3), (1, 2), (2, 3), (9, 10), (99, 100), (1, 1), (1, 1000))
    got = {(r["k"], r["num"], r["den"]): r["value"] for r in numeric.nearest_rank(df, ["k"], "v", probes).collect()}
    assert got == {(k, n, d): sorted(vs)[max(1, -(-n * len(vs) // d)) - 1] for k, vs in groups.items() for n, d in probes}


def test_mean_identity_and_histogram_partition(spark):
    rng = random.Random(5)
    rows = [(f"p{i}", rng.randrange(-500, 2 * 10**10)) for i in range(25) for _ in range(rng.randrange(1, 60))]
    df = spark.createDataFrame(rows, "k string, v long")
    for r in numeric.distribution(df, ["k"], "v", ()).collect():
        assert r["sum_ns"] == r["mean_ns"] * r["n"] + r["remainder_ns"] and 0 <= r["remainder_ns"] < r["n"]
    h = summary.histogram(df, ["k"], "v", default_bounds())
    assert {r["k"]: r["n"] for r in h.groupBy("k").agg(F.sum("n").alias("n")).collect()} == {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}


def test_histogram_buckets(spark):
    got = {r["bucket"]: (r["lower_ns"], r["upper_ns"], r["n"]) for r in summary.histogram(values(spark, [150, 50, 250, 350, 150, -5, 100]), ["k"], "v", [100, 200, 300]).collect()}
    assert got == {-1: (None, 0, 1), 0: (0, 100, 1), 1: (100, 200, 3), 2: (200, 300, 1), 3: (300, None, 1)}


def test_ppm_and_floor_div(spark):
    df = spark.createDataFrame([(1, 3), (0, 0), (5, 5), (7, 5), (BIG, BIG), (-7, 2), (7, -2), (1, None)], "a long, b long")
    got = [tuple(r) for r in df.select(numeric.ppm(F.col("a"), F.col("b")), numeric.floor_div(F.col("a"), F.col("b"))).collect()]
    assert [g[0] for g in got[:5]] == [333333, 0, 1_000_000, 1_000_000, 1_000_000]
    assert got[1][1] is None and got[5][1] == -4 and got[7] == (None, None)


def test_arguments_are_checked():
    for bad in ([], [5, 5], [-1, 2], list(range(600))):
        with pytest.raises(ValueError):
            check_bounds(bad)
    for n, d in ((0, 1), (2, 1), (1, 0)):
        with pytest.raises(ValueError):
            probe(n, d)
    for bad in ({"fresh_ns": 11 * 10**9}, {"watch_ns": 0}, {"min_samples": -1}):
        with pytest.raises(ValueError):
            Policy(**bad)
    assert len(default_bounds()) == 22 and DEFAULT.digest() == hashlib.sha256(DEFAULT.text().encode()).hexdigest() != Policy(min_samples=9).digest()
    with pytest.raises(ValueError):
        summary.Request("p", "g", 5, 5)


# ---- identity ----------------------------------------------------------------------------------------------------------


def test_identities_and_instants(spark):
    texts = ["", "a", "abc", "éß😀", "measurement|s|e|i|7", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(identity.fnv1a64(F.col("t"))).collect()] == [None if t is None else f"{identity.fnv1a64_of(t.encode()):016x}" for t in texts]
    assert identity.fnv1a64_of(b"a") == 0xAF63DC4C8601EC8C
    ns = spark.createDataFrame([(-1,), (0,), (1_000_000_001,), (-(10**18),)], "ns long").withColumn("t", identity.format_utc(F.col("ns"))).withColumn("back", identity.parse_utc(F.col("t")))
    rows = ns.collect()
    assert rows[0]["t"] == "1969-12-31T23:59:59.999999999Z" and all(r["ns"] == r["back"] for r in rows)
    bad = spark.createDataFrame([("2020-13-01T00:00:00Z",), ("x",), ("2020-01-01T00:00:00",), (None,)], "t string").select(identity.parse_utc(F.col("t")))
    assert [r[0] for r in bad.collect()] == [None] * 4
    ids = spark.createDataFrame([("af63dc4c8601ec8c",), ("0" * 16,), ("xyz",), ("AF63DC4C8601EC8C",)], "h string").select(identity.hex_id(identity.parse_hex_id(F.col("h"))))
    assert [r[0] for r in ids.collect()] == ["af63dc4c8601ec8c", None, None, None]


# ---- evidence ----------------------------------------------------------------------------------------------------------


def test_freshness_and_merge(spark):
    ages = [(-1, 4), (0, 0), (2 * 10**9, 0), (2 * 10**9 + 1, 1), (10**10, 1), (6 * 10**10, 2), (6 * 10**10 + 1, 3), (None, 4)]
    df = spark.createDataFrame(ages, "age long, want int")
    assert df.where(ev.freshness(F.col("age")) != F.col("want")).count() == 0
    merge = lambda s: one(spark.createDataFrame([(x,) for x in s], "s int").agg(ev.merged_state(F.col("s")).alias("m")))["m"]
    assert [merge(s) for s in ([0, 0], [0, 1], [2, 2], [0, 3], [4, 3, 0], [7, 1])] == [0, 1, 1, 3, 4, 7]


# ---- hops and attribution ----------------------------------------------------------------------------------------------


def exchange_rows(spark, rows):
    """rows of (rtt, {hop: dwell})"""
    data = [(i, i, "p", "g", "s", 1000, 1000, rtt, 0, "reference", 0, {k: (d, None) for k, d in hops.items()}) for i, (rtt, hops) in enumerate(rows)]
    return spark.createDataFrame(data, "exchange_id long, arrival long, path string, generation string, source string, received_ns long, observed_ns long, rtt_ns long, state int, domain string, freshness int, hops map<int,struct<dwell_ns:long,queue_dwell_ns:long>>")


def attributed(x, hops=3, policy=DEFAULT):
    return one(attribution.verdict(attribution.accounts(x, hops, ["path"]), ["path"], policy))


def test_missing_hops_are_not_zero(spark):
    x = exchange_rows(spark, [(400, {0: 100, 2: 300})] * 10)
    got = {r["hop_index"]: r for r in summary.hop_summary(x, ["path"], 3).collect()}
    assert (got[1]["missing"], got[1]["coverage_ppm"], got[1]["sum_ns"], got[1]["hop_state"]) == (10, 0, None, "missing")
    assert (got[0]["mean_ns"], got[0]["coverage_ppm"], got[0]["hop_state"]) == (100, 1_000_000, "observed")


def test_complete_decomposition(spark):
    x = exchange_rows(spark, [(3000, {0: 1000, 1: 1000, 2: 1000})] * 16)
    got = attributed(x)
    assert (got["kind"], got["e2e_mean_ns"], got["accounted_mean_ns"], got["unaccounted_mean_ns"], got["residual_reading"]) == ("observed_decomposition", 3000, 3000, 0, "residual_within_tolerance")
    assert {r["share_ppm"] for r in attribution.hop_contributions(x, 3, ["path"]).collect()} == {333333}


@pytest.mark.parametrize(("rtt", "reading", "negative"), [(8000, "unaccounted_residual", 0), (3100, "residual_within_tolerance", 0), (2950, "residual_within_tolerance", 4)])
def test_residuals(spark, rtt, reading, negative):
    got = attributed(exchange_rows(spark, [(rtt, {0: 1000, 1: 1000, 2: 1000})] * 4))
    assert (got["residual_reading"], got["residual_min_ns"], got["negative_residuals"]) == (reading, rtt - 3000, negative)


def test_incomplete_exchanges_refuse_unless_partial_is_allowed(spark):
    rows = [(600, {0: 100, 1: 200, 2: 300})] * 2 + [(600, {0: 100, 2: 300})] * 2
    refused, partial = attributed(exchange_rows(spark, rows)), attributed(exchange_rows(spark, rows), policy=Policy(allow_partial=True))
    assert (refused["kind"], refused["accounted_mean_ns"], refused["e2e_mean_ns"], refused["complete"]) == ("refused", None, 600, 2)
    assert (partial["kind"], partial["accounted_mean_ns"]) == ("partial", 600)


def test_overflowing_and_zero_hops(spark):
    q = BIG // 4
    got = attributed(exchange_rows(spark, [(q * 3, {0: q, 1: q, 2: q})] * 2))
    assert got["accounted_mean_ns"] == q * 3
    assert attributed(exchange_rows(spark, [(BIG, {0: BIG, 1: BIG, 2: 1})]))["complete"] == 0
    assert attributed(exchange_rows(spark, [(0, {0: 0, 1: 0, 2: 0})] * 3))["accounted_mean_ns"] is None


# ---- classes, history --------------------------------------------------------------------------------------------------


def test_record_classes_are_decided_in_order(spark):
    base = exchange_rows(spark, [(10, {})] * 9)
    i = F.col("exchange_id")
    x = (
        base.withColumn("path", F.when(i == 0, "q").otherwise("p")).withColumn("generation", F.when(i <= 1, "old").otherwise("g")).withColumn("source", F.when(i <= 2, "t").otherwise("s"))
        .withColumn("domain", F.when(i <= 3, "edge").otherwise("reference")).withColumn("received_ns", F.when(i <= 4, 5000).otherwise(1999)).withColumn("state", F.when(i == 5, 4).when(i == 6, 6).otherwise(0)).withColumn("freshness", F.when(i <= 7, 2).otherwise(1))
    )
    r = summary.Request("p", "g", 1000, 2000, "current", "s")
    assert tuple(x.orderBy("exchange_id").select(summary.record_class(r).alias("c")).toPandas()["c"]) == summary.CLASSES
    counts = one(summary.class_counts(x, r))
    assert counts["considered"] == 9 and counts["other_path"] == 2 and counts["included"] == 1
    assert [e["exchange_id"] for e in summary.included(x, r).collect()] == [8]


def test_history_is_dense_and_bounded(spark):
    x = exchange_rows(spark, [(v, {}) for v in (10, 20, 30)]).withColumn("received_ns", 1000 + F.col("exchange_id") * 150)
    got = summary.history(x, summary.Request("p", "g", 1000, 1450), 100).orderBy("bucket").collect()
    assert [(r["bucket"], r["included"], r["state"], r["mean_ns"]) for r in got] == [(0, 1, 0, 10), (1, 1, 0, 20), (2, 0, 5, None), (3, 1, 0, 30), (4, 0, 5, None)]
    assert got[-1]["to_ns"] == 1500
    with pytest.raises(ValueError):
        summary.history(x, summary.Request("p", "g", 0, 10**6), 1)


# ---- clocks ------------------------------------------------------------------------------------------------------------


def report(domain, **more):
    row = {"domain": domain, "reference": "reference", "sync_state": "synchronized", "offset_ns": 1000, "uncertainty_ns": 100, "valid_for_ns": 10**9, "observed_ns": 10**9, "revision": 1} | more
    return tuple(row.values())


def test_comparability_table(spark):
    now = 10**9 + 100
    reports = [
        report("ok"), report("two", offset_ns=400), report("unsynced", sync_state="unsynced"), report("hold", sync_state="holdover"), report("other", reference="elsewhere"), report("future", observed_ns=now + 1),
        report("expired", valid_for_ns=50), report("vague", uncertainty_ns=10**7), report("half", valid_for_ns=150), report("ok", offset_ns=-5, revision=0), report("wide", uncertainty_ns=BIG),
    ]
    kind = "domain string, reference string, sync_state string, offset_ns long, uncertainty_ns long, valid_for_ns long, observed_ns long, revision int"
    want = {
        (None, "ok"): ("unknown", "clock_domain_missing"), ("x", "x"): ("comparable", "clock_self_comparable"), ("none", "ok"): ("unknown", "clock_offset_unavailable"), ("ok", "unsynced"): ("refused", "clock_unsynced"),
        ("hold", "reference"): ("comparable", "clock_comparable"), ("reference", "other"): ("conflicting", "clock_reference_mismatch"), ("ok", "other"): ("conflicting", "clock_reference_mismatch"),
        ("future", "ok"): ("conflicting", "clock_offset_unavailable"), ("expired", "reference"): ("stale", "clock_sync_expired"), ("vague", "ok"): ("refused", "clock_uncertainty_exceeded"), ("wide", "ok"): ("refused", "clock_uncertainty_exceeded"),
        ("ok", "two"): ("comparable", "clock_comparable"), ("half", "ok"): ("comparable", "clock_comparable"), ("unsynced", "future"): ("refused", "clock_unsynced"),
    }
    pairs = spark.createDataFrame([(a, b, 5000, 5000) for a, b in want], "left_domain string, right_domain string, entry_ns long, exit_ns long")
    got = {(r["left_domain"], r["right_domain"]): r for r in clocks.dwell(clocks.compare(pairs, spark.createDataFrame(reports, kind), F.lit(now))).collect()}
    assert {k: (r["verdict"], r["reason"]) for k, r in got.items()} == want
    two = got["ok", "two"]
    assert (two["dwell_ns"], two["uncertainty_ns"], two["confidence"]) == (600, 200, 0) and got["half", "ok"]["confidence"] == 1 and got["hold", "reference"]["confidence"] == 3
    assert got["x", "x"]["dwell_ns"] == 0 and got["vague", "ok"]["dwell_ns"] is None and got["ok", "unsynced"]["dwell_state"] == "refused"
    strict = clocks.compare(pairs, spark.createDataFrame(reports, kind), F.lit(now), policy=Policy(allow_holdover=False)).where("left_domain = 'hold'")
    assert one(strict)["reason"] == "clock_holdover"


def test_age_is_shifted_by_the_offset(spark):
    kind = "domain string, reference string, sync_state string, offset_ns long, uncertainty_ns long, valid_for_ns long, observed_ns long, revision int"
    reports = spark.createDataFrame([report("edge", observed_ns=5000)], kind)
    r = spark.createDataFrame([("edge", 1000), ("reference", 1000), ("none", 1000)], "domain string, observed_at_ns long")
    got = {x["domain"]: (x["verdict"], x["age_ns"], x["confidence"]) for x in clocks.estimate_age(r, reports, F.lit(6000)).collect()}
    assert got == {"edge": ("comparable", 6000, 1), "reference": ("comparable", 5000, 0), "none": ("unknown", None, 4)}


# ---- admission ---------------------------------------------------------------------------------------------------------


def stream_rows(spark, rows, tmp=None):
    return spark.createDataFrame([(i, i, *r) for i, r in enumerate(rows)], "exchange_id long, arrival long, source long, epoch string, incarnation string, source_revision int, sequence long")


@pytest.mark.parametrize(("sequences", "want"), [([5, 5], ["first", "replay"]), ([1, 3], ["first", "advance"]), ([10, 7, 7, 11], ["first", "reordered", "replay", "advance"])])
def test_sequence_fence(spark, sequences, want):
    rows = admission.admit(stream_rows(spark, [(1, "e", "i", 1, s) for s in sequences]), 1).orderBy("arrival").collect()
    assert [r["decision"] for r in rows] == want
    assert [r["verdict"] for r in rows] == [{"first": "current", "advance": "current", "reordered": "historical", "replay": "rejected"}[w] for w in want]


def test_sessions_revisions_and_independent_sources(spark):
    rows = [(1, "e1", "i", 1, 1), (1, "e2", "i", 1, 1), (1, "e1", "i", 1, 2), (1, "e2", "j", 1, 1), (2, "e1", "i", 2, 1), (2, "e1", "i", 1, 2), (3, "e1", "i", 3, 5), (3, "e1", "i", 2, 5)]
    got = admission.admit(stream_rows(spark, rows), 2).orderBy("arrival").collect()
    assert [r["session_reason"] for r in got] == [None, "epoch_advanced", "session_superseded", "incarnation_changed", None, None, None, None]
    assert [r["verdict"] for r in got] == ["historical"] * 4 + ["current", "historical", "rejected", "rejected"]


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(4), f"e{i // 150}", f"i{rng.randrange(2)}", rng.randrange(1, 4), rng.randrange(40)) for i in range(600)]
    df = stream_rows(spark, rows)
    for k in range(4):
        df.where((F.col("arrival") >= k * 150) & (F.col("arrival") < (k + 1) * 150)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = fences.admit_stream(fences.file_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema), 2)
    columns = ["arrival", "decision", "gap", "session_current", "session_reason", "verdict"]
    got = fences.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).select(columns).orderBy("arrival").collect()
    for block in (admission.BLOCK, 150, 7, 1):
        assert got == admission.admit(df, 2, block=block).select(columns).orderBy("arrival").collect()


def test_blocks_of_arrivals_do_not_change_the_fences(spark):
    rng = random.Random(4)
    rows = [(1 if rng.random() < 0.7 else rng.randrange(5), rng.choice(["e0", f"e{i // 60}", None]), "i", rng.randrange(1, 4), rng.choice([None, i, i - 3, i // 2])) for i in range(300)]
    df = stream_rows(spark, rows).withColumn("arrival", F.col("arrival") * 3 - 400)
    fatal = F.col("epoch").isNull()
    want = admission.admit(df, 2, fatal=fatal).where(~fatal).orderBy("arrival").collect()
    assert {r["session_reason"] for r in want} == {None, "epoch_advanced", "session_superseded"} and want == admission.admit(df, 2, fatal=fatal, block=25).where(~fatal).orderBy("arrival").collect()
    # The rules record by record.
    for source in range(5):
        seen, newest, born = {}, None, []
        for r in (r for r in want if r["source"] == source):
            key = r["epoch"]
            if key not in born:
                born.append(key)
                newest = key
            assert (r["session"], r["session_current"], r["newest_epoch"]) == (born.index(key) + 1, key == newest, newest)
            own = seen.setdefault(key, [])
            top = max((s for s, _ in own if s is not None), default=None)
            assert (r["seen"], r["revision_current"]) == (top, all(v <= r["source_revision"] for _, v in own))
            own.append((r["sequence"], r["source_revision"]))


def test_state_is_bounded_and_forgets_as_defined():
    fence, policy = fences.Fence(), Policy(sessions_per_source=2, replay_window=2)
    assert [fence.admit("e", "i", 1, s, 1, policy)[0] for s in (1, 2, 3, 1, 3)] == ["first", "advance", "advance", "reordered", "replay"]
    for e in ("f", "g"):
        fence.admit(e, "i", 1, 1, 1, policy)
    assert len(fence.sessions) == 2 and fence.admit("e", "i", 1, 3, 1, policy)[:4] == ("first", 0, True, "epoch_advanced")


def test_validation_accumulates_reasons(spark):
    row = {"path": "p", "epoch": "e", "incarnation": "i", "source_revision": 1, "domain": "d", "response_domain": "d", "request_ns": 1, "response_ns": 5, "rtt_ns": 4, "hop_indexes": [0, 2], "known_path": True, "known_source": True, "known_generation": True}
    kind = "path string, epoch string, incarnation string, source_revision int, domain string, response_domain string, request_ns long, response_ns long, rtt_ns long, hop_indexes array<int>, known_path boolean, known_source boolean, known_generation boolean"
    cases = [({}, []), ({"known_source": False, "epoch": None}, ["unknown_source"]), ({"response_ns": 0}, ["invalid_field_value"]), ({"hop_indexes": [1, 1], "domain": None}, ["clock_domain_missing", "hop_not_contiguous"]), ({"hop_indexes": []}, []), ({"response_domain": "x", "source_revision": 0, "epoch": None}, ["clock_reference_mismatch", "invalid_field_value", "revision_changed"])]
    got = admission.validate(spark.createDataFrame([tuple((row | c).values()) for c, _ in cases], kind).coalesce(1)).collect()
    assert [r["reasons"] for r in got] == [w for _, w in cases] and [r["rejected"] for r in got] == [bool(w) for _, w in cases]


# ---- baselines ---------------------------------------------------------------------------------------------------------


def test_anomalies(spark):
    kind = "path string, hop_index int, n long, mean_ns long"
    ref = spark.createDataFrame([("p", 0, 64, 10**8), ("p", 1, 2, 5), ("p", 2, 64, 0), ("p", 9, 9, 9)], kind)
    cur = spark.createDataFrame([("p", 0, 64, 10**8 + 2 * 10**7), ("p", 1, 64, 5), ("p", 2, 10, -(10**6))], kind)
    got = {r["hop_index"]: r for r in baseline.anomalies(cur, ref, ["path", "hop_index"]).collect()}
    assert set(got) == {0, 1, 2}
    assert (got[0]["anomaly"], got[0]["mean_delta_ns"], got[0]["ratio_ppm"], got[0]["confidence"]) == ("elevated", 2 * 10**7, 1_200_000, "high")
    assert (got[1]["anomaly"], got[1]["confidence"]) == ("unknown", "low") and (got[2]["anomaly"], got[2]["ratio_ppm"], got[2]["confidence"]) == ("suppressed", 0, "moderate")


def test_baselines_apply_only_where_all_matches(spark):
    x = exchange_rows(spark, [(1000, {})] * 10)
    made = baseline.create(x, "b", F.lit(100))
    assert baseline.add(made, made).count() == 0
    now = summary.summarize(x, ["path", "generation", "domain"], ((99, 100),)).crossJoin(made.select("baseline_id"))
    check = lambda df, at: one(baseline.compare(df, made, "baseline_id", F.lit(at)))
    assert (check(now, 100)["applicable"], check(now, 100)["mean_delta_ns"], check(now, 100)["anomaly"]) == (True, 0, "none")
    assert check(now, 99)["mismatches"] == ["not_usable"] and check(now, 100 + 11 * 10**9)["mismatches"] == ["stale"] and check(now, 100 + 61 * 10**9)["mismatches"] == ["expired"]
    assert check(now.withColumn("generation", F.lit("h")).withColumn("n", F.lit(3).cast("bigint")), 100)["mismatches"] == ["generation", "too_few_samples"]
    assert check(now.withColumn("baseline_id", F.lit("none")), 100)["mismatches"] == ["missing"]


# ---- registry, store, export, service ----------------------------------------------------------------------------------


def test_lineage_tips(spark):
    def tip(rows):
        return [r["generation"] for r in catalog.lineage(spark.createDataFrame(rows, "generation string, supersedes string")).where("is_current").collect()]

    assert tip([("one", None)]) == ["one"] and tip([("one", None), ("two", "one")]) == ["two"] and tip([("one", None), ("two", "one"), ("three", "one")]) == []


def test_log_stops_at_first_damage(spark):
    log = spark.createDataFrame([(s, p, (s, p) == (1, 1)) for s in range(3) for p in range(3)], "segment int, position int, bad boolean")
    assert {(r["segment"], r["position"]) for r in store.undamaged_prefix(log, F.col("bad")).collect()} == {(0, 0), (0, 1), (0, 2), (1, 0)}
    assert store.undamaged_prefix(log, F.lit(False)).count() == 9
    assert {r["segment"]: r["lost"] for r in store.recovery_report(log, F.col("bad")).collect()} == {0: 0, 1: 2, 2: 3}


def test_hostile_documents_fail_whole(spark):
    good = '{"op":"ingest","records":[{"path":"p","generation":"g","source":"s","epoch":"e","incarnation":"i","source_revision":1,"sequence":1,"domain":"d","request_ns":1,"response_ns":2,"observed_at_ns":1,"observed_at_domain":"d"}]}'
    hostile = ["", "{", "[]", "null", '{"op":"explode"}', '{"op":"ingest"}', '{"op":"ingest","records":[{}]}', '{"op":"ingest","records":7}', good[:-2], good.replace('"sequence":1', '"sequence":"x"'), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([good, *hostile, '{"op":"ingest","records":[]}'])], "line int, value string")
    got = store.decode_requests(df).orderBy("line").collect()
    assert [(r["line"], r["ok"]) for r in got] == [(0, True)] + [(i + 1, False) for i in range(len(hostile))]


def test_partitioned_table_and_csv(spark, tmp_path):
    x = exchange_rows(spark, [(5, {0: 1}), (6, {1: 2})])
    store.write_exchanges(x, str(tmp_path / "t"))
    read = store.read_exchanges(spark, str(tmp_path / "t"), 0, 2000).where("path = 'p'")
    assert read.count() == 2 and "PartitionFilters: [" in read._jdf.queryExecution().toString()
    export.write_csv(export.csv_rows(x, 2).coalesce(1), str(tmp_path / "c"))
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv")).splitlines()
    assert text[0].endswith("hop0_dwell_ns,hop0_queue_dwell_ns,hop1_dwell_ns,hop1_queue_dwell_ns") and text[1].endswith(",5,1,,,")
    assert one(export.accounting(x, ["path"], 1))["skipped"] == 1
    with pytest.raises(ValueError):
        export.limited(x, 0)


def test_service_envelopes(spark):
    x = exchange_rows(spark, [(3000, {0: 1000, 1: 1000, 2: 1000})] * 16)
    s = Service(spark, x)
    ask = lambda **r: s.execute(r)
    assert len(ask(op="operations")["result"]) == 22
    assert ask(op="nope")["error"]["code"] == "unsupported_operation" and ask(op="define_link", name="l")["error"]["code"] == "missing_field" and s.execute(None)["ok"] is False
    assert ask(op="define_endpoint", name="a", role="client")["ok"] and ask(op="define_endpoint", name="a", role="client")["ok"]
    assert ask(op="define_endpoint", name="a", role="server")["error"]["code"] == "conflict" and ask(op="define_endpoint", name="a", role="server", revision=2)["ok"]
    assert ask(op="define_link", name="l", **{"from": "a", "to": "b"})["error"]["code"] == "not_found"
    for d, ref in (("r", True), ("d", False)):
        assert ask(op="define_clock_domain", name=d, is_reference=ref)["ok"]
    sync = {"op": "clock_sync", "domain": "d", "reference": "r", "state": "synchronized", "offset_ns": 1, "uncertainty_ns": 1, "valid_for_ns": 1, "revision": 2}
    assert s.execute(sync)["ok"] and s.execute(sync)["ok"] and s.execute(sync | {"revision": 1})["error"]["code"] == "conflict" and s.execute(sync | {"domain": "r"})["error"]["code"] == "invalid_argument"
    about = {"path": "p", "generation": "g", "to_ns": 2000, "hops": 3}
    assert one(ask(op="summarize", **about)["result"]["summary"])["mean_ns"] == 3000
    assert ask(op="history", bucket_ns=500, **about)["result"].count() == 4
    made = ask(op="baseline_create", name="b", created_ns=1900, **about)["result"].collect()
    assert ask(op="baseline_create", name="b", created_ns=1900, **about)["error"]["code"] == "already_exists" and ask(op="baseline_list")["result"].count() == 1
    told = ask(op="attribute", baseline=made[0]["baseline_id"], **about)["result"]
    assert one(told["verdict"])["kind"] == "observed_decomposition" and one(told["baseline"])["anomaly"] == "none"
    assert ask(op="explain", **about)["result"]["provenance"].count() == 16 and ask(op="export", kind="samples", limit=5, **about)["result"].count() == 5
    assert ask(op="export", kind="samples", limit=0, **about)["error"]["code"] == "invalid_argument" and ask(op="status")["result"]["records"] == 16


def registered(service):
    ask = lambda **r: service.execute(r)
    for d, ref in (("reference", True), ("edge", False)):
        assert ask(op="define_clock_domain", name=d, is_reference=ref)["ok"]
    assert ask(op="define_source", name="s", source_kind="probe", authority="primary", semantics="hop_dwell")["ok"] and ask(op="define_generation", name="g")["ok"]
    assert ask(op="define_endpoint", name="n", role="client")["ok"] and ask(op="define_link", name="l", **{"from": "n", "to": "n"})["ok"]
    assert ask(op="define_queue", name="q", link="l", semantics="queue_dwell")["ok"]
    assert ask(op="define_hop", name="h0", hop_kind="link")["ok"] and ask(op="define_hop", name="h1", hop_kind="link", queue="q")["ok"]
    assert ask(op="define_path", name="p", generation="g", hops=["h0", "h1"])["ok"]
    return ask


def document(*records, **more):
    import json

    base = {"path": "p", "generation": "g", "source": "s", "epoch": "e", "incarnation": "i", "source_revision": 1, "domain": "reference", "request_ns": 100, "response_ns": 130, "observed_at_ns": 100, "observed_at_domain": "reference"}
    return json.dumps({"op": "ingest", "received_at_ns": 200, "records": [base | r for r in records]} | more)


def test_service_ingests_documents_into_its_table(spark, tmp_path):
    s = Service(spark, exchange_rows(spark, [(1, {})]), table=str(tmp_path / "t"))
    ask = registered(s)
    hop = {"index": 1, "hop": "h1", "queue": "q", "entry_ns": 110, "entry_domain": "edge", "exit_ns": 120, "exit_domain": "reference", "queue_entry_ns": 112, "queue_exit_ns": 118}
    lines = [
        document({"sequence": 1, "hops": [{"index": 0, "hop": "h0", "entry_ns": 101, "entry_domain": "reference", "exit_ns": 108, "exit_domain": "reference"}, hop]}),
        document({"sequence": 3}, {"sequence": 9, "request_ns": 9, "response_ns": 3}, {"sequence": 2}, {"sequence": 3}),
        document({"sequence": 9}, {"sequence": 10, "path": "nope"}, {"sequence": 11, "source_revision": 2}, {"sequence": 12, "observed_at_ns": -(10**12)}),
        "junk", document(*[{"sequence": k} for k in range(4097)]),
    ]
    got = ask(op="ingest", records=spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1))["result"]
    rows = got["verdicts"].orderBy("arrival").collect()
    assert [r["verdict"] for r in rows] == ["current", "current", "rejected", "historical", "rejected", "current", "rejected", "rejected", "historical"]
    assert [r["decision"] for r in rows] == ["first", "advance", None, "reordered", "replay", "advance", None, "advance", "advance"]
    assert rows[2]["reasons"] == ["evidence_fresh", "invalid_field_value"] and "unknown_path" in rows[6]["reasons"] and "revision_changed" in rows[7]["reasons"]
    assert {k: (h["dwell_ns"], h["reason"]) for k, h in rows[0]["hops"].items()} == {0: (7, None), 1: (None, "clock_offset_unavailable")}
    assert {r["error"]: r["count"] for r in got["failed"].collect()} == {"malformed_payload": 1, "capacity_exceeded": 1}
    assert one(got["report"])["hop_dwells_computed"] == 1 and one(got["report"])["hop_dwells_unknown"] == 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
    sync = {"op": "clock_sync", "domain": "edge", "reference": "reference", "state": "synchronized", "offset_ns": 5, "uncertainty_ns": 1, "valid_for_ns": 10**6, "observed_ns": 150, "revision": 1}
    for bound, want in (({}, (15, 11)), ({"generation": "g", "revision": 2}, (15, 11)), ({"generation": "other", "revision": 3}, (None, None))):
        assert s.execute(sync | bound)["ok"]
        again = ask(op="ingest", records=spark.createDataFrame([(lines[0],)], "value string"))["result"]["verdicts"].first()["hops"][1]
        assert (again["dwell_ns"], again["queue_dwell_ns"]) == want
    assert ask(op="ingest", records=spark.createDataFrame([(1,)], "x int"))["error"]["code"] == "invalid_argument"


def test_stream_reads_a_folder_of_part_files(spark, tmp_path):
    df = stream_rows(spark, [(k % 3, "e", "i", 1, k) for k in range(200)])
    df.repartition(4).write.parquet(str(tmp_path / "many/events.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "x"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "x").glob("*.parquet")).rename(tmp_path / "one/events.parquet")
    for kind in ("many", "one"):
        stream = fences.admit_stream(fences.table_stream(spark, str(tmp_path / kind), "events", df.schema, 9), 1)
        assert fences.run_to_table(stream, str(tmp_path / kind / "out"), str(tmp_path / kind / "state")).where("verdict = 'current'").count() == 200


def test_crc32c_and_roots_at_the_edges(spark):
    from tracewell.functions import identity, numeric

    rows = [("123456789", 0), ("", 1), (None, None), ("é😀", -1), ("a", 2**63 - 1), ("b", 3037000499**2), ("c", 3037000499**2 - 1), ("d", 2**53 - 1)]
    got = spark.createDataFrame(rows, "t string, n long").select("t", "n", identity.crc32c(F.col("t")).alias("crc"), numeric.isqrt(F.col("n")).alias("root")).collect()
    assert [r["crc"] for r in got][:3] == [0xE3069283, 0, None]
    assert [r["root"] for r in got] == [0, 1, None, None, 3037000499, 3037000499, 3037000498, 94906265]


def test_synthetic_rows_depend_on_the_seed_alone(spark):
    from tracewell.sources import synthetic

    one = sorted(map(repr, synthetic.exchanges(spark, 300, 7).collect()))
    assert one == sorted(map(repr, synthetic.exchanges(spark, 300, 7).repartition(5).collect()))
    assert one != sorted(map(repr, synthetic.exchanges(spark, 300, 8).collect())) and synthetic.exchanges(spark, 0).count() == 0
    assert all(r["response_ns"] - r["request_ns"] == sum(r["dwells"]) for r in synthetic.exchanges(spark, 50, 1).collect())


# ---- larger tables -----------------------------------------------------------------------------------------------------


def test_format_utc_beyond_a_bigint(spark, tmp_path):
    edges = [-(2**63), -(2**63) + 145_224_193, 2**63 - 1, -1_000_000_000]
    t = spark.createDataFrame([(n,) for n in edges], "ns long").withColumn("t", identity.format_utc(F.col("ns"))).withColumn("back", identity.parse_utc(F.col("t"))).collect()
    assert [r["back"] for r in t] == edges and t[0]["t"] == "1677-09-21T00:12:43.145224192Z" and t[2]["t"] == "2262-04-11T23:47:16.854775807Z"
    beyond = spark.createDataFrame([("1677-09-21T00:12:43.145224191Z",), ("2262-04-11T23:47:16.854775808Z",)], "t string").select(identity.parse_utc(F.col("t")))
    assert [r[0] for r in beyond.collect()] == [None, None]
    ids = [0, 11_870, 11_871, 14_064, 599_999, 36_000_000]
    spark.createDataFrame([(i,) for i in ids], "event_id long").withColumn("ts", F.lit("2024-01-05 00:00:00").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r for r in queries.QUERIES["format_utc"](spark, str(tmp_path)).collect()}
    want = {i: 1_704_412_800 * 10**9 - i * 777_000_000_777_001 for i in ids}
    assert {i: r["ns"] for i, r in got.items()} == {i: n if -(2**63) <= n else None for i, n in want.items()}
    assert all(r["parsed"] == r["ns"] and (r["text"] is None) == (r["ns"] is None) for r in got.values())


def test_identities_cost_little_a_byte(spark):
    # A long text beside short ones: where each byte is looked up from the start of its text, the long one takes minutes.
    texts = [None if i % 7 == 3 else "é😀x|"[: i % 5] * (i % 11) for i in range(300)] + ["0123456789" * 30_000]
    table, began = identity.crc32c_table(), time.perf_counter()
    t = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = t.select(identity.fnv1a64(F.col("t")).alias("h"), identity.crc32c(F.col("t")).alias("c")).collect()
    assert time.perf_counter() - began < 60
    for text, r in zip(texts, got, strict=True):
        crc = 0xFFFFFFFF
        for b in (text or "").encode():
            crc = table[(crc ^ b) & 255] ^ (crc >> 8)
        assert tuple(r) == ((None, None) if text is None else (f"{identity.fnv1a64_of(text.encode()):016x}", crc ^ 0xFFFFFFFF))


def test_hops_of_an_export_come_from_the_lines_alone(spark, tmp_path, monkeypatch):
    small = "/root/testdata/sf0.001"
    orders, lines = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("orders", "lineitem"))
    made = F.col("o_orderkey").isin([r[0] for r in orders.select("o_orderkey").orderBy("o_orderkey").limit(60).collect()])
    orders.where(made).write.parquet(f"{tmp_path}/a/orders.parquet")
    keys = orders.where(made).select(F.col("o_orderkey").alias("l_orderkey"))
    own = lines.join(keys, "l_orderkey", "left_semi").where("l_linenumber <= 3")
    own.write.parquet(f"{tmp_path}/a/lineitem.parquet")
    looked = []
    whole = export.hop_count
    monkeypatch.setattr(export, "hop_count", lambda x: looked.append(1) or whole(x))
    wide = queries.QUERIES["export_fixed_columns"](spark, f"{tmp_path}/a")
    assert not looked and [c for c in wide.columns if c.endswith("queue_dwell_ns")] == [f"hop{i}_queue_dwell_ns" for i in range(3)] and wide.count() == 60
    orders.where(made).write.parquet(f"{tmp_path}/b/orders.parquet")  # lines of no order count for nothing
    own.unionByName(own.limit(1).withColumns({"l_orderkey": F.lit(-5).cast("bigint"), "l_linenumber": F.lit(9)})).write.parquet(f"{tmp_path}/b/lineitem.parquet")
    assert queries.QUERIES["export_fixed_columns"](spark, f"{tmp_path}/b").columns == wide.columns and looked


def test_attribution_reads_its_rows_once(spark, capsys):
    def scans(df):
        df.explain()
        return capsys.readouterr().out.count("Scan parquet")

    small = "/root/testdata/sf0.001"
    once = scans(queries.QUERIES["attribution_gates"](spark, small))
    assert [scans(queries.QUERIES[q](spark, small)) for q in ("attribution_contributions", "attribution_reasons")] == [once, once]


def test_no_task_reads_what_most_rows_share(spark, capsys):
    from tracewell.functions.lookup import looked_up

    rows = spark.range(4000).select("id", F.when(F.col("id") % 10 < 7, "reference").when(F.col("id") % 10 == 9, None).otherwise((F.col("id") % 50).cast("string")).alias("d"))
    names = spark.range(30).select(F.col("id").cast("string").alias("name"), (F.col("id") * 2).alias("v")).union(spark.range(1).select(F.lit("reference"), F.lit(7).cast("bigint")))
    want = {r["id"]: int(r["d"]) * 2 if (r["d"] or "x").isdigit() and int(r["d"]) < 30 else None for r in rows.collect()}
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1")):
            spark.conf.set(k, v)
        for most in (1000, 0):
            got = looked_up(rows, names, "d", "name", F.col("d") == "reference", most)
            assert got.columns == ["id", "d", "v"] and {r["id"]: r["v"] for r in got.collect()} == want
        shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert max(shares) < 2000  # of 4000 in 4 parts, though 2800 have one domain and 400 none
        queries.QUERIES["ingest_verdicts"](spark, "/root/testdata/sf0.001").explain()
        plan = capsys.readouterr().out
        assert not any(f"SortMergeJoin [{c}#" in plan for c in ("path", "observed_at_domain"))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
