"""The operations of the library by name: a request is a dict, an answer an envelope whose result is a DataFrame or plain data.

A service holds a registry (small, on the driver) and DataFrames; it computes nothing itself. Requests about facts name a
path, a generation and a window; all times are arguments, so an answer can be had again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.identity import fnv1a64_of
from ..operators import admission, attribution, baseline, export, ingest, summary
from ..sources import store
from .policy import DEFAULT, Policy, bounds_digest, default_bounds

#: What the library does and what it refuses to claim.
CAPABILITIES = (
    ("clock comparability", "real"), ("exact aggregation", "real"), ("generation-bound baselines", "real"), ("hop attribution", "real"),
    ("keyed admission fences", "real"), ("causal inference", "unsupported"), ("traffic control", "unsupported"),
)
#: Kinds of definition, the fields each needs, and what its references name.
DEFINITIONS: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "source": (("source_kind", "authority", "semantics"), {}),
    "generation": ((), {"supersedes": "generation"}),
    "endpoint": (("role",), {}),
    "link": (("from", "to"), {"from": "endpoint", "to": "endpoint"}),
    "queue": (("link", "semantics"), {"link": "link"}),
    "hop": (("hop_kind",), {"link": "link", "queue": "queue"}),
    "path": (("generation", "hops"), {"generation": "generation"}),
    "clock_domain": (("is_reference",), {}),
}


class Refused(ValueError):
    """A request that cannot be answered; the first argument is its code."""


class Service:
    def __init__(self, spark: SparkSession, exchanges: DataFrame, policy: Policy = DEFAULT, table: str | None = None):
        self.spark, self.exchanges, self.policy, self.table = spark, exchanges, policy, table
        self.registry: dict[str, dict[str, dict]] = {kind: {} for kind in DEFINITIONS}
        self.syncs: dict[str, dict] = {}
        self.baselines: DataFrame | None = None
        self.operations: dict[str, Callable[[dict], object]] = {
            "capabilities": lambda r: [{"capability": c, "status": s} for c, s in CAPABILITIES],
            "status": lambda r: {"records": self.exchanges.count(), **{k: len(v) for k, v in self.registry.items()}, "clock_syncs": len(self.syncs)},
            "operations": lambda r: sorted(self.operations),
            **{f"define_{kind}": (lambda r, kind=kind: self._define(kind, r)) for kind in DEFINITIONS},
            "clock_sync": self._clock_sync, "ingest": self._ingest, "summarize": self._summarize, "history": self._history,
            "baseline_create": self._baseline_create, "baseline_list": lambda r: self._stored().orderBy("baseline_id"), "attribute": self._attribute,
            "explain": self._explain, "export": self._export, "flush": lambda r: {"flushed": True}, "shutdown": lambda r: {"accepted": True},
        }

    def execute(self, request: dict) -> dict:
        op = request.get("op") if isinstance(request, dict) else None
        try:
            if op not in self.operations:
                raise Refused("unsupported_operation", str(op))
            return {"ok": True, "op": op, "policy_digest": self.policy.digest(), "result": self.operations[op](request)}
        except Refused as e:
            return {"ok": False, "op": op, "error": {"code": e.args[0], "message": " ".join(map(str, e.args[1:]))}}
        except AnalysisException as e:  # records that lack a column
            return {"ok": False, "op": op, "error": {"code": "invalid_argument", "message": str(e).split("\n")[0]}}
        except (KeyError, TypeError, ValueError) as e:
            return {"ok": False, "op": op, "error": {"code": "missing_field" if isinstance(e, KeyError) else "invalid_argument", "message": str(e)}}

    # ---- registry ------------------------------------------------------------------------------------------------------

    def _define(self, kind: str, r: dict) -> dict:
        needed, refs = DEFINITIONS[kind]
        name, revision = r["name"], r.get("revision", 1)
        row = {k: r[k] for k in needed} | {k: r[k] for k in refs if r.get(k) is not None}
        for field, target in refs.items():
            if row.get(field) is not None and row[field] not in self.registry[target]:
                raise Refused("not_found", target, row[field])
        if kind == "generation" and row.get("supersedes") == name:
            raise Refused("invalid_argument", "a generation cannot supersede itself")
        if kind == "path" and not (0 < len(row["hops"]) <= self.policy.hops_per_path and all(h in self.registry["hop"] for h in row["hops"])):
            raise Refused("not_found", "a path needs 1 to", self.policy.hops_per_path, "known hops")
        held = self.registry[kind].get(name)
        if held and held != {**row, "revision": revision} and (kind == "clock_domain" or revision <= held["revision"]):
            raise Refused("conflict", kind, name)
        self.registry[kind][name] = {**row, "revision": revision}
        return {"id": f"{fnv1a64_of(name.encode()) or 1:016x}", "name": name}

    def _clock_sync(self, r: dict) -> dict:
        domain, reference = r["domain"], r["reference"]
        if domain not in self.registry["clock_domain"] or reference not in self.registry["clock_domain"]:
            raise Refused("not_found", "clock domain")
        if domain == reference or r["uncertainty_ns"] < 0 or r["valid_for_ns"] <= 0:
            raise Refused("invalid_argument", "clock sync")
        row = {k: v for k, v in r.items() if k != "op"}
        held = self.syncs.get(domain)
        if held and (row["revision"] < held["revision"] or row["revision"] == held["revision"] and row != held):
            raise Refused("conflict", "clock sync", domain)
        self.syncs[domain] = row
        return {"domain": domain, "revision": row["revision"]}

    # ---- facts ---------------------------------------------------------------------------------------------------------

    def _rows(self, kind: str, columns: str, of) -> DataFrame:
        return self.spark.createDataFrame([of(name, d) for name, d in self.registry[kind].items()], columns)

    def _reports(self) -> DataFrame:
        """The clock reports given so far, one of each domain."""
        rows = [(d, *[r.get(k) for k in ("reference", "state", "offset_ns", "uncertainty_ns", "valid_for_ns")], r.get("observed_ns", 0), r["revision"], r.get("generation"), r.get("epoch"), r.get("incarnation")) for d, r in self.syncs.items()]
        kinds = "domain string, reference string, sync_state string, offset_ns long, uncertainty_ns long, valid_for_ns long, observed_ns long, revision int, generation string, epoch string, incarnation string"
        return self.spark.createDataFrame(rows, kinds)

    def _ingest(self, r: dict) -> dict:
        """verdicts, report and failed of a DataFrame of JSON documents (column value) or of records as of ``ingest.ingest``.

        A document that does not decode is told in ``failed`` and gives no record. What is not rejected is appended to the
        service's table, with the dwells of its hops.
        """
        rows, failed = r["records"], None
        if "value" in rows.columns:
            decoded = store.decode_requests(rows, most=self.policy.batch_records)
            failed = decoded.where(~F.col("ok")).select("error").groupBy("error").count()
            rows = ingest.from_documents(decoded.where("ok"), self.policy)
        paths = self._rows("path", "path string, generation string, hops array<string>", lambda n, d: (n, d["generation"], d["hops"]))
        sources = self._rows("source", "source string, revision int", lambda n, d: (n, d["revision"]))
        generations = self._rows("generation", "generation string, supersedes string", lambda n, d: (n, d.get("supersedes")))
        semantics = {n: d["semantics"] for n, d in self.registry["queue"].items()}
        hops = self._rows("hop", "hop string, queue string, declared string", lambda n, d: (n, d.get("queue"), semantics.get(d.get("queue"), "")))
        reports = self._reports()
        found = ingest.ingest(rows, paths, sources, generations, reports, self.policy)
        dwells = ingest.hop_dwells(rows, hops, reports, self.policy)
        found = found.drop("hops", "hop_indexes", "hop_names").join(dwells, "arrival", "left")
        if self.table:
            store.write_exchanges(found.where(F.col("verdict") != admission.REJECTED), self.table)
        return {"verdicts": found, "report": admission.report(found.withColumn("session_reason", F.when(F.array_contains("reasons", "epoch_advanced"), "epoch_advanced"))), "failed": failed}

    def _request(self, r: dict, mode: str) -> summary.Request:
        return summary.Request(r["path"], r["generation"], r.get("from_ns", 0), r["to_ns"], r.get("mode", mode), r.get("source"))

    def _included(self, r: dict, mode: str = "current") -> DataFrame:
        return summary.included(self.exchanges, self._request(r, mode))

    def _summarize(self, r: dict) -> dict:
        own, hops = self._included(r), int(r.get("hops", 0))
        out = {"counts": summary.class_counts(self.exchanges, self._request(r, "current")), "summary": summary.summarize(own, ["path", "generation"])}
        return out | ({"hops": summary.hop_summary(own, ["path"], hops)} if hops else {})

    def _history(self, r: dict) -> DataFrame:
        return summary.history(self.exchanges, self._request(r, "historical"), r["bucket_ns"], self.policy)

    def _stored(self) -> DataFrame:
        if self.baselines is None:
            raise Refused("not_found", "no baseline")
        return self.baselines

    def _baseline_create(self, r: dict) -> DataFrame:
        made = baseline.create(self._included(r, "historical"), r["name"], F.lit(r["created_ns"]))
        new = made if self.baselines is None else baseline.add(self.baselines, made)
        if new.isEmpty():
            raise Refused("already_exists" if self.baselines is not None and not made.isEmpty() else "refused", r["name"])
        self.baselines = new if self.baselines is None else self.baselines.unionByName(new)
        return new

    def _attribute(self, r: dict) -> dict:
        own, hops = self._included(r), int(r["hops"])
        accounts = attribution.accounts(own, hops, ["path", "generation"])
        out = {"verdict": attribution.verdict(accounts, ["path", "generation"], self.policy), "hops": attribution.hop_contributions(own, hops, ["path"])}
        if r.get("baseline"):
            now = summary.summarize(own, ["path", "generation", "domain"], ((99, 100),)).withColumn("baseline_id", F.lit(r["baseline"]))
            out["baseline"] = baseline.compare(now, self._stored(), "baseline_id", F.lit(r["to_ns"]), self.policy)
        return out

    def _explain(self, r: dict) -> dict:
        sources = self.spark.createDataFrame([(n, d["source_kind"], d["authority"]) for n, d in self.registry["source"].items()], "source string, source_kind string, authority string")
        window = {"from_ns": max(0, r.get("from_ns", 0)), "to_ns": r["to_ns"]}
        digests = {"policy_digest": self.policy.digest(), "histogram_digest": bounds_digest(default_bounds())}
        return {"policy": self.policy.text(), **digests, "window": window, "summary": self._summarize(r), "provenance": export.provenance_of(self._included(r), sources)}

    def _export(self, r: dict) -> DataFrame:
        kind, hops = r["kind"], int(r.get("hops", 0))
        if kind == "baselines":
            return self._stored()
        if kind == "summary":
            return self._summarize({**r, "mode": "historical"})["summary"]
        if kind != "samples":
            raise Refused("invalid_argument", kind)
        rows = self.exchanges
        for field in ("path", "generation"):
            rows = rows.where(F.col(field) == r[field]) if r.get(field) is not None else rows
        rows = export.limited(rows.where((F.col("received_ns") >= r.get("from_ns", 0)) & (F.col("received_ns") < r["to_ns"])), r.get("limit", 1000))
        return export.csv_rows(rows, hops) if r.get("format") == "csv" else export.json_rows(rows, hops)
