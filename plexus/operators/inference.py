"""Discrete probabilistic inference over the graph's variables and factors.

The active subgraph is found with DataFrame operations under documented caps
(10,000 nodes, 50,000 factors); what the caps admit is collected. Residual belief
propagation updates one message at a time, an order that only a single sequence
can keep, so it runs on the collected factors, with a priority queue in place of
a search over all messages. ``flooding`` updates all messages of a round at once
as a DataFrame plan, for factor graphs beyond the caps.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import pv_python
from ..model import GraphData
from .traversal import ball, check_damping, cut, is_number_text

MAX_NODES, MAX_FACTORS = 10_000, 50_000
#: What residual propagation, which is one sequence, takes at most; ``flooding`` has no such bound.
MAX_VARIABLES = 1_000_000
WARN = {"variables": 1000, "factors": 5000, "graph_nodes": 5000}


@dataclass
class Variable:
    id: int
    owner: int | None
    states: list[str]
    prior: dict[str, Any]
    posterior: dict[str, Any] = field(default_factory=dict)

    def state(self, name: str) -> int:
        if name not in self.states:
            raise ValueError(f'variable {self.id} has no state "{name}"')
        return self.states.index(name)


def _variables(df: DataFrame) -> dict[int, Variable]:
    plain = lambda m: {k: pv_python(v) for k, v in (m or {}).items()}
    return {r.id: Variable(r.id, r.owner_id, list(r.states), plain(r.prior), plain(r.posterior)) for r in df.collect()}


def number(value: Any) -> float | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, str) and is_number_text(value):
        return float(value)
    return None


def normalized(values: np.ndarray) -> np.ndarray:
    total = float(np.sum(values))
    if not math.isfinite(total) or total <= 0:
        raise ValueError("probability distribution cannot be normalized")
    return values / total


def distribution(variable: Variable, properties: dict[str, Any], what: str = "prior") -> np.ndarray:
    """Normalised state values; the key ``p`` serves binary variables without state keys; else uniform."""
    values, given = np.zeros(len(variable.states)), False
    for i, s in enumerate(variable.states):
        if s in properties:
            v = number(properties[s])
            if v is None:
                raise ValueError(f'{what} for state "{s}" must be numeric')
            if not math.isfinite(v) or v < 0:
                raise ValueError(f"{what} values must be finite and non-negative")
            values[i], given = v, True
    if not given and variable.states == ["false", "true"] and "p" in properties:
        p = number(properties["p"])
        if p is None:
            raise ValueError(f"binary {what} key 'p' must be numeric")
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"binary {what} key 'p' must be between 0.0 and 1.0")
        values, given = np.array([1.0 - p, p]), True
    return normalized(values) if given else np.full(len(values), 1.0 / len(values))


@dataclass
class Active:
    variables: list[int]
    factors: list[int]
    graph_nodes: list[int]
    boundary_variables: list[int]
    truncated: bool

    def as_dict(self) -> dict[str, Any]:
        return dict(self.__dict__)


def _wanted(data: GraphData, ids: list[int]) -> dict[int, Variable]:
    found = _variables(data.table("variables").where(F.col("id").isin(*ids))) if ids else {}
    for i in ids:
        if i not in found:
            raise KeyError(f"variable {i} not found")
    return found


def _bounded(df: DataFrame, what: str) -> None:
    if df.limit(MAX_VARIABLES + 1).count() > MAX_VARIABLES:
        raise ValueError(f"more than {MAX_VARIABLES} {what}; ask for some variables, or use flooding")


def compile_active_subgraph(data: GraphData, query_variables: list[int], evidence: dict[int, str] | None = None, radius: int = 2, max_nodes: int = MAX_NODES, max_factors: int = MAX_FACTORS) -> Active:
    """Variables, factors and nodes that an inference about ``query_variables`` looks at."""
    evidence = evidence or {}
    seeds = list(dict.fromkeys([*query_variables, *sorted(evidence)]))
    known = _wanted(data, seeds)
    for v, s in evidence.items():
        known[v].state(s)
    active, nodes, truncated = set(seeds), set(), False

    def admit(owner: int | None) -> None:
        nonlocal truncated
        if owner is None or owner in nodes:
            return
        if len(nodes) < max_nodes:
            nodes.add(owner)
        else:
            truncated = True

    for v in seeds:
        admit(known[v].owner)
    if not active:
        # Nothing was asked for, so all variables are; their ids and owners come in id order.
        _bounded(data.table("variables"), "variables")
        for r in data.table("variables").select("id", "owner_id").orderBy("id").toLocalIterator():
            active.add(r.id)
            admit(r.owner_id)
    around, cut_off = ball(data, sorted(nodes), radius, max_nodes)
    truncated |= cut_off
    nodes |= set(around)
    if nodes:
        # At most max_nodes ids, so the list side is small.
        here = F.broadcast(data.spark.createDataFrame([(n,) for n in nodes], "owner_id long"))
        active |= {r.id for r in data.table("variables").join(here, "owner_id", "left_semi").select("id").collect()}
    factors: list[int] = []
    if active:
        tables = data.table("factor_tables").select("factor_id", "variables")
        met = data.spark.createDataFrame([(v,) for v in active], "v long")
        touching = tables.select("factor_id", "variables", F.explode("variables").alias("v")).join(met, "v", "left_semi").select("factor_id", "variables").distinct()
        rows = touching.orderBy("factor_id").limit(max_factors + 1).collect()
        truncated |= len(rows) > max_factors
        owners: dict[int, int | None] = {}
        new = sorted({v for r in rows[:max_factors] for v in r.variables} - active)
        if new:
            ids = data.spark.createDataFrame([(v,) for v in new], "id long")
            owners = {r.id: r.owner_id for r in data.table("variables").join(ids, "id", "left_semi").select("id", "owner_id").collect()}
        for r in rows[:max_factors]:
            factors.append(r.factor_id)
            for v in r.variables:
                if v not in active:
                    active.add(v)
                    admit(owners.get(v))
    listed = sorted(active)
    ids = data.spark.createDataFrame([(v,) for v in listed], "id long")
    outside = data.table("variables").join(ids, "id", "left_semi").where("owner_id is not null").select("id", "owner_id")
    boundary = sorted(r.id for r in outside.collect() if r.owner_id not in nodes)
    return Active(listed, factors, sorted(nodes), boundary, truncated)


@dataclass
class Factor:
    id: int
    variables: list[int]
    table: np.ndarray  # an axis for each variable


def shaped(variables: list[int], values: list[float], is_cpd: bool, cards: dict[int, int]) -> np.ndarray:
    """A flat table as an array with an axis for each variable, in their order.

    Plain tables run the last variable fastest; conditional tables run the child,
    their first variable, fastest and then the last parent.
    """
    sizes = [cards[v] for v in variables]
    flat = np.asarray(values, float)
    if not is_cpd:
        return flat.reshape(sizes)
    child, parents = sizes[0], sizes[1:]
    return np.moveaxis(flat.reshape([*parents, child]), -1, 0)


class Residual:
    """Sum-product messages, the one with the largest residual first.

    Ties go to the first in factor order, then table order, then variable to
    factor before factor to variable.
    """

    def __init__(self, variables: dict[int, Variable], factors: list[Factor], evidence: dict[int, str]):
        self.variables, self.factors = variables, {f.id: f for f in factors}
        self.fixed = {}
        for v, s in evidence.items():
            if v in variables:
                hard = np.zeros(len(variables[v].states))
                hard[variables[v].state(s)] = 1.0
                self.fixed[v] = hard
        self.prior = {v: distribution(x, x.prior) for v, x in variables.items()}
        self.of: dict[int, list[int]] = {}
        self.message: dict[tuple, np.ndarray] = {}
        self.order: dict[tuple, int] = {}
        for f in factors:
            for v in f.variables:
                uniform = np.full(len(variables[v].states), 1.0 / len(variables[v].states))
                for key in (("v", v, f.id), ("f", f.id, v)):
                    self.order.setdefault(key, len(self.order))
                    self.message[key] = uniform.copy()
                self.of.setdefault(v, []).append(f.id)
        self.candidate: dict[tuple, np.ndarray] = {}
        self.residual: dict[tuple, float] = {}
        self.heap: list[tuple] = []
        for key in self.order:
            self.refresh(key)

    def compute(self, key: tuple) -> np.ndarray:
        if key[0] == "v":
            _, v, f = key
            if v in self.fixed:
                return self.fixed[v]
            out = self.prior[v].copy()
            for g in dict.fromkeys(self.of[v]):
                if g != f:
                    out = out * self.message["f", g, v]
            return normalized(out)
        _, f, v = key
        factor = self.factors[f]
        table = factor.table
        for axis, u in enumerate(factor.variables):
            if u != v:
                shape = [1] * table.ndim
                shape[axis] = -1
                table = table * self.message["v", u, f].reshape(shape)
        axis = factor.variables.index(v)
        return normalized(table.sum(axis=tuple(i for i in range(table.ndim) if i != axis)))

    def refresh(self, key: tuple) -> None:
        c = self.compute(key)
        self.candidate[key] = c
        r = float(np.abs(self.message[key] - c).sum())
        self.residual[key] = r
        heapq.heappush(self.heap, (-r, self.order[key], key))

    def best(self) -> tuple | None:
        while self.heap:
            r, _, key = self.heap[0]
            if -r == self.residual[key]:
                return key
            heapq.heappop(self.heap)
        return None

    def update(self, key: tuple, damping: float) -> None:
        self.message[key] = normalized((1.0 - damping) * self.candidate[key] + damping * self.message[key])
        self.refresh(key)
        if key[0] == "v":
            _, v, f = key
            for u in dict.fromkeys(self.factors[f].variables):
                if u != v:
                    self.refresh(("f", f, u))
        else:
            _, f, v = key
            for g in dict.fromkeys(self.of[v]):
                if g != f:
                    self.refresh(("v", v, g))

    def belief(self, v: int) -> np.ndarray:
        if v in self.fixed:
            return self.fixed[v]
        out = self.prior[v].copy()
        for f in dict.fromkeys(self.of.get(v, [])):
            out = out * self.message["f", f, v]
        return normalized(out)


def stored_evidence(data: GraphData) -> dict[int, str]:
    rows = data.table("evidence").where("payload['state'].t = 'string'").select("id", "variable_id", F.col("payload")["state"]["s"].alias("state"))
    last = rows.groupBy("variable_id").agg(F.max_by("state", "id").alias("state"))
    _bounded(last, "variables with evidence")
    return {r.variable_id: r.state for r in last.collect()}


def belief_propagation(data: GraphData, query_variables: list[int] | None = None, evidence: dict[int, str] | None = None, radius: int = 2, max_iters: int = 1000, tolerance: float = 1e-6, damping: float = 0.2) -> dict[str, Any]:
    """Beliefs of the queried variables (all active ones by default), with diagnostics."""
    if not math.isfinite(tolerance) or tolerance < 0:
        raise ValueError("tolerance must be finite and non-negative")
    check_damping(damping)
    asked = list(query_variables or [])
    evidence = {**stored_evidence(data), **(evidence or {})}
    active = compile_active_subgraph(data, asked, evidence, radius)
    ids = data.spark.createDataFrame([(v,) for v in active.variables], "id long")
    variables = _variables(data.table("variables").join(ids, "id", "left_semi")) if active.variables else {}
    cards = {k: len(v.states) for k, v in variables.items()}
    factors = []
    if active.factors:
        fid = data.spark.createDataFrame([(f,) for f in active.factors], "factor_id long")
        rows = data.table("factor_tables").join(fid, "factor_id", "left_semi").orderBy("factor_id").collect()
        factors = [Factor(r.factor_id, list(r.variables), shaped(r.variables, r["values"], r.is_cpd, cards)) for r in rows]
    net = Residual(variables, factors, evidence)
    iterations = updated = 0
    worst, converged = 0.0, not factors
    for i in range(max_iters):
        iterations = i + 1
        key = net.best()
        if key is None:
            converged, worst = True, 0.0
            break
        worst = net.residual[key]
        if worst <= tolerance:
            converged = True
            break
        net.update(key, damping)
        updated += 1
    beliefs = {v: dict(zip(variables[v].states, net.belief(v).tolist(), strict=True)) for v in (asked or active.variables) if v in variables}
    warnings = ["active subgraph was truncated"] if active.truncated else []
    for name, most in WARN.items():
        if (n := len(getattr(active, name))) > most:
            warnings.append(f"active subgraph has {n} {name.replace('_', ' ')}")
    if not converged:
        warnings.append(f"belief propagation did not converge within {max_iters} iterations")
    if max_iters and iterations * 10 >= max_iters * 9:
        warnings.append(f"belief propagation used {iterations} of {max_iters} configured iterations")
    return {
        "beliefs": beliefs,
        "active_subgraph": active.as_dict(),
        "schedule": "residual_async",
        "iterations": iterations,
        "messages_updated": updated,
        "converged": converged,
        "max_residual": worst,
        "trace_id": None,
        "warnings": warnings,
        "diagnostics": {
            "active_variables": len(active.variables),
            "active_factors": len(active.factors),
            "active_graph_nodes": len(active.graph_nodes),
            "boundary_variables": len(active.boundary_variables),
            "truncated": active.truncated,
            "iterations": iterations,
            "max_iters": max_iters,
            "messages_updated": updated,
            "converged": converged,
            "max_residual": worst,
            "tolerance": tolerance,
            "damping": damping,
        },
    }


def flooding(priors: DataFrame, pairs: DataFrame, rounds: int, damping: float = 0.0) -> DataFrame:
    """(variable, state, belief) after synchronous rounds on a pairwise factor graph.

    priors: (variable, state, p). pairs: (factor, a, b, sa, sb, potential) with a
    row for each pair of states. Every message of a round is one grouped sum.
    """
    check_damping(damping)
    both = pairs.select("factor", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("sa").alias("ss"), F.col("sb").alias("ds"), "potential").unionAll(pairs.select("factor", F.col("b"), F.col("a"), F.col("sb"), F.col("sa"), "potential"))
    both = cut(both)
    msg = cut(both.select("factor", "dst", F.col("ds").alias("state")).distinct().withColumn("m", F.lit(1.0)))

    def gathered(messages: DataFrame) -> DataFrame:
        logs = messages.groupBy("dst", "state").agg(F.sum(F.log("m")).alias("l"))
        p = priors.join(logs, (F.col("variable") == F.col("dst")) & (priors.state == logs.state), "left")
        return p.select("variable", priors.state, (F.log("p") + F.coalesce("l", F.lit(0.0))).alias("l"))

    for _ in range(rounds):
        g = gathered(msg)
        out = both.join(g, (F.col("src") == F.col("variable")) & (F.col("ss") == F.col("state"))).drop("state")
        back = msg.select(F.col("factor"), F.col("dst").alias("src"), F.col("state").alias("ss"), F.col("m").alias("back"))
        out = out.join(back, ["factor", "src", "ss"])
        new = out.groupBy("factor", "dst", F.col("ds").alias("state")).agg(F.sum(F.col("potential") * F.exp(F.col("l") - F.log("back"))).alias("m"))
        total = new.groupBy("factor", "dst").agg(F.sum("m").alias("z"))
        new = new.join(total, ["factor", "dst"]).withColumn("m", F.col("m") / F.col("z")).drop("z")
        old = msg.withColumnRenamed("m", "old")
        msg = cut(new.join(old, ["factor", "dst", "state"]).select("factor", "dst", "state", ((1 - damping) * F.col("m") + damping * F.col("old")).alias("m")))
    g = gathered(msg).withColumn("e", F.exp("l"))
    z = g.groupBy("variable").agg(F.sum("e").alias("z"))
    return g.join(z, "variable").select("variable", "state", (F.col("e") / F.col("z")).alias("belief"))


def posterior(data: GraphData, variable_id: int) -> dict[str, float]:
    """Stored belief, else posterior properties, else the prior."""
    v = _wanted(data, [variable_id])[variable_id]
    row = data.table("posteriors").where(F.col("variable_id") == variable_id).first()
    if row is not None:
        values = row.distribution
    else:
        values = distribution(v, v.posterior, "posterior").tolist() if v.posterior else distribution(v, v.prior).tolist()
    return dict(zip(v.states, values, strict=True))
