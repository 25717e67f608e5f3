"""Step graphs: G1 (define + check), G4 (run), G5 (JSON save/load), G6 (report).

A graph is a list of nodes ``{"id", "step", "options", "inputs": [ids]}``.
It is checked as a whole before any Spark job: unknown steps or inputs,
cycles, wrong number of inputs, repeated edges, no input node, option
errors of every step (collected together). Running is a topological fold
that builds lazy DataFrames; fits run in order (one aggregate each), sinks
are the only other actions. Fits of a chain that need no more than column
summaries come from one aggregate together. The output of a join followed by more than one
fit is persisted (memory and disk), so the join runs once instead of once per
fit; ``release()`` frees it.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark import StorageLevel
from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .. import step as stepmod
from ..errors import GraphError, OptionError
from ..functions import params, summaries
from ..ltypes import LType, ltypes
from ..sources import catalog, parquet
from ..sources import csv as csvsrc
from ..streaming import stream
from ..table import Table

#: Steps whose fits column summaries may answer.
FUSED = {"fill_nan", "minmax_scaler", "standard_scaler"}
SOURCES = {"input"}
SINKS = {"output"}


class StepGraph:
    def __init__(self, nodes: list[dict]):
        self.nodes = [dict(n) for n in nodes]
        self.by_id = {}
        self.steps = {}
        self._check()

    # ---- G1 ---------------------------------------------------------------
    def _check(self):
        errors = []
        for n in self.nodes:
            nid = n.get("id")
            if nid is None or nid in self.by_id:
                raise GraphError(f"node ids must be present and unique: {nid!r}")
            self.by_id[nid] = n
        for n in self.nodes:
            ins = list(n.get("inputs") or [])
            if len(set(ins)) != len(ins):
                raise GraphError(f"node {n['id']}: repeated edge")
            for i in ins:
                if i not in self.by_id:
                    raise GraphError(f"node {n['id']}: unknown input {i!r}")
            kind = n["step"]
            if kind in SOURCES:
                if ins:
                    raise GraphError(f"input node {n['id']} takes no inputs")
                continue
            if kind in SINKS:
                if len(ins) != 1:
                    raise GraphError(f"output node {n['id']} needs exactly one input")
                continue
            try:
                s = stepmod.make(kind, **(n.get("options") or {}))
            except OptionError as e:
                errors += [(f"{n['id']}.{c}", m) for c, m in e.errors]
                continue
            arity = getattr(s, "arity", 1)
            if len(ins) != arity:
                raise GraphError(f"node {n['id']}: {kind} needs {arity} input(s), got {len(ins)}")
            self.steps[n["id"]] = s
        if errors:
            raise OptionError(errors)
        if not any(n["step"] in SOURCES for n in self.nodes):
            raise GraphError("the graph has no input node")
        self.order = self._toposort()

    def _toposort(self):
        indeg = {n["id"]: len(n.get("inputs") or []) for n in self.nodes}
        children = defaultdict(list)
        for n in self.nodes:
            for i in n.get("inputs") or []:
                children[i].append(n["id"])
        ready = [k for k, d in indeg.items() if d == 0]
        order = []
        while ready:
            k = ready.pop(0)
            order.append(k)
            for c in children[k]:
                indeg[c] -= 1
                if indeg[c] == 0:
                    ready.append(c)
        if len(order) != len(self.nodes):
            raise GraphError("the graph has a cycle")
        self.children = children
        return order

    # ---- G5 ---------------------------------------------------------------
    def to_json(self, fitted: dict | None = None) -> str:
        """The graph as text. Learned tables stay where they are stored and are named by their full path; to take
        them along, use :meth:`save`."""
        doc = {"nodes": self.nodes}
        if fitted:
            doc["fitted"] = fitted
        return params.dumps(doc)

    @staticmethod
    def from_json(text: str) -> "StepGraph":
        doc = params.loads(text)
        g = StepGraph(doc["nodes"])
        g.saved_fitted = doc.get("fitted") or {}
        return g

    def save(self, spark: SparkSession, path: str, fitted: dict | None = None) -> None:
        """The graph as a folder: the JSON text and a copy of every learned table, named relative to the folder."""
        params.save(spark, path, {"nodes": self.nodes, "fitted": fitted or {}})

    @staticmethod
    def load(spark: SparkSession, path: str) -> "StepGraph":
        """A saved folder, wherever it lies now; its learned parameters are ``saved_fitted``."""
        doc = params.load(spark, path)
        g = StepGraph(doc["nodes"])
        g.saved_fitted = doc.get("fitted") or {}
        return g

    # ---- G4 / G6 ----------------------------------------------------------
    def run(self, spark: SparkSession, tables: dict | None = None, fitted: dict | None = None):
        """Build every node; run sinks. Returns (results by node id, report rows).

        ``fitted``: learned parameters by node id (``self.fitted`` of an earlier
        run, or the ``fitted`` part of a saved graph): those nodes are not fitted
        again, so a graph fitted on a batch applies to a stream unchanged."""
        from ..step import Model
        tables = tables or {}
        fitted = fitted or {}
        self.fitted = {}
        self.queries = []  # streaming sinks started by this run
        results: dict = {}
        report = []
        fan_out = {k: len(v) for k, v in self.children.items()}
        persisted = self._persisted = []
        keep = self._cache_nodes()
        known: dict = {}  # node -> summaries of the columns of its output
        for nid in self.order:
            n = self.by_id[nid]
            kind = n["step"]
            opts = n.get("options") or {}
            ins = [results[i] for i in n.get("inputs") or []]
            if kind == "input":
                t = self._source(spark, opts, tables)
                report.append((nid, kind, "option", "source", json.dumps(opts, sort_keys=True)))
            elif kind == "output" and ins[0].is_streaming:
                t = ins[0]
                q = stream.write_stream_table(t, opts["stream_table"], checkpoint=opts.get("checkpoint"),
                                              trigger_once=True)
                self.queries.append(q)
                report.append((nid, kind, "result", "stream", opts["stream_table"]))
            elif kind == "output":
                t = ins[0]
                obs = Observation(f"rows_{nid}")
                observed = Table(t.df.observe(obs, F.count(F.lit(1)).alias("rows")), t.index)
                self._sink(observed, opts)
                report.append((nid, kind, "result", "rows", str(obs.get["rows"])))
            else:
                s = self.steps[nid]
                if (fan_out.get(n["inputs"][0], 0) > 1 and s.streaming == "fit" and not ins[0].is_streaming
                        and ins[0].df.storageLevel == StorageLevel.NONE):
                    # fan-out input read by a fit and by other consumers
                    ins[0].df.persist(StorageLevel.MEMORY_AND_DISK)
                    persisted.append(ins[0].df)
                if nid in fitted and getattr(s, "arity", 1) == 1:
                    m = Model(s, fitted[nid])
                else:
                    m = self._fit(nid, s, ins, known)
                if nid in known:
                    known[nid] = s.summary_after(known[nid], m.params)
                self.fitted[nid] = m.params
                t = m.transform(*ins)
                if nid in keep and not Table.of(t).is_streaming:
                    # a shuffle join read again by later fits: computed once
                    Table.of(t).df.persist(StorageLevel.MEMORY_AND_DISK)
                    persisted.append(Table.of(t).df)
                    report.append((nid, s.key, "plan", "persisted", "MEMORY_AND_DISK"))
                report += [(nid,) + tuple(r) for r in m.report()]
                report.append((nid, s.key, "schema", "columns", json.dumps(Table.of(t).columns)))
            results[nid] = Table.of(t)
        return results, report

    def _fit(self, nid, s, ins, known):
        """Fits a step; where column summaries are all it needs, one aggregate serves it and the steps that follow it."""
        if getattr(s, "arity", 1) != 1 or ins[0].is_streaming:
            return s.fit(*ins)
        s.check_input(ins[0])
        types = {k: v for k, v in ltypes(ins[0].df).items() if k in ins[0].columns}
        cols = s.summary_columns(types)
        if cols is None:
            return s.fit(*ins)
        have = known.get(self.by_id[nid]["inputs"][0], {})
        if not set(cols) <= set(have):
            wanted, chain = [], nid
            while chain is not None:  # down the chain as long as steps need only summaries
                more = self.steps[chain].summary_columns(types) if chain in self.steps else None
                if more is None:
                    break
                wanted += [c for c in more if types.get(c) == LType.NUMERIC and c not in wanted]
                follow = self.children.get(chain, [])
                chain = follow[0] if len(follow) == 1 and getattr(self.steps.get(follow[0]), "arity", 1) == 1 else None
            have = summaries.measure(ins[0].df, wanted)
        known[nid] = have
        return stepmod.Model(s, s.fit_from(have))

    def _cache_nodes(self):
        """Join nodes with more than one fit downstream: each is a job over the
        join's output, so without persisting, the join would run once per fit
        plus once for the sinks. Steps that one aggregate fits together (see
        ``_fit``) count once, and a single fit costs less than storing the rows."""
        fitted = {nid for nid, s in self.steps.items() if s.streaming == "fit" or
                  (s.streaming == "no" and getattr(s, "arity", 1) == 1)}
        together = {nid for nid in fitted if self.steps[nid].key in FUSED}
        out = set()
        for nid, s in self.steps.items():
            if getattr(s, "arity", 1) != 2:
                continue
            stack, seen, fits = [(c, False) for c in self.children.get(nid, [])], set(), 0
            while stack:
                c, served = stack.pop()
                if c in seen:
                    continue
                seen.add(c)
                if c in fitted and not (served and c in together):
                    fits += 1
                stack.extend((x, c in together) for x in self.children.get(c, []))
            if fits > 1:
                out.add(nid)
        return out

    def release(self):
        """Unpersist what :meth:`run` persisted."""
        for df in getattr(self, "_persisted", []):
            df.unpersist()
        self._persisted = []

    def report_df(self, spark: SparkSession, report):
        return spark.createDataFrame(report, "node string, step string, kind string, key string, value string")

    @staticmethod
    def _source(spark, opts, tables):
        if "table" in opts:
            if opts["table"] in tables:
                return Table.of(tables[opts["table"]])
            return catalog.set_input(spark, opts["table"])
        if "parquet" in opts:
            return parquet.read_table(spark, opts["parquet"])
        if "csv" in opts:
            return Table.of(csvsrc.read_csv(spark, opts["csv"], sep=opts.get("sep", ","),
                                            schema=opts.get("schema")))
        if "stream_parquet" in opts:
            if not opts.get("schema"):
                raise GraphError("a stream input needs a schema")
            return Table.of(spark.readStream.schema(opts["schema"]).parquet(opts["stream_parquet"]))
        raise GraphError(f"input needs table, parquet, csv or stream_parquet: {opts}")

    @staticmethod
    def _sink(t: Table, opts):
        if "name" in opts:
            catalog.to_variable(t, opts["name"])  # writes the rows, which are counted on the way
        elif "parquet" in opts:
            parquet.write_table(t, opts["parquet"])
        elif "csv" in opts:
            csvsrc.write_csv(t, opts["csv"])
        else:
            t.df.write.format("noop").mode("overwrite").save()
