"""The table of policy configurations, and their ready rows in one pass.

A configuration is a row: family, variant, parameters, and an id that is a digest of these. A
grid is expanded from axes; all its configurations then meet the states together: the states get the
features that some configuration needs, and each row is exploded into the configurations that are ready there.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .policies import KEY, allow_look_ahead, gate_features

_THRESHOLDS = [round(0.05 * i, 2) for i in range(2, 20)]
#: The axes of the published search, family by family.
AXES = {
    "fixed-threshold": {"threshold": _THRESHOLDS},
    "fixed-lag": {"threshold": _THRESHOLDS, "lag_words": [0, 1, 2, 4, 8, 12]},
    "snapshot-patience": {"threshold": _THRESHOLDS, "patience": [1, 2, 3, 4, 5]},
    "rescore-patience": {"threshold": _THRESHOLDS, "patience": [1, 2, 3, 4, 5]},
    "ema": {"threshold": _THRESHOLDS, "alpha": [0.2, 0.5, 0.8]},
    "stability-gate": {
        "tau": [0.3, 0.4, 0.5, 0.6, 0.7],
        "min_rescores": [1, 2, 3],
        "instability_horizon": [3],
        "epsilon": [0.01, 0.025, 0.05, 0.1],
        "min_label_margin": [0.0, 0.1, 0.2],
        "max_extension_advantage": [0.0, 0.05, 0.1],
    },
    "oracle-stable": {"threshold": [0.5]},
}
#: Gates that an ablation switches off, with the axis that it then has no use for.
ABLATIONS = {"minus_instability": ("use_instability", "epsilon"), "minus_label_margin": ("use_label_margin", "min_label_margin"), "minus_extension": ("use_extension", "max_extension_advantage")}


@dataclass(frozen=True)
class Spec:
    """One configuration. A variant other than main and analysis-only is selected by itself."""

    family: str
    variant: str
    parameters: tuple[tuple[str, object], ...]

    @property
    def analysis_only(self) -> bool:
        return self.variant == "analysis-only"

    @property
    def parameters_json(self) -> str:
        return canonical(dict(self.parameters))

    @property
    def policy_id(self) -> str:
        whole = {"family": self.family, "variant": self.variant, "parameters": dict(self.parameters), "analysis_only": self.analysis_only}
        return f"{self.family}:{self.variant}:{hashlib.sha256(canonical(whole).encode()).hexdigest()[:16]}"

    @property
    def selection_key(self) -> str:
        return self.family if self.variant in ("main", "analysis-only") else f"{self.family}/{self.variant}"


def canonical(value) -> str:
    """JSON with sorted keys and no spaces: one text for one value."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _points(family: str, variant: str, axes: dict[str, list], fixed: dict[str, object]) -> list[Spec]:
    return [Spec(family, variant, tuple(sorted({**dict(zip(axes, values)), **fixed}.items()))) for values in product(*axes.values())]


def expand(axes: dict[str, dict[str, list]] = AXES) -> list[Spec]:
    """All configurations, by id. An ablation keeps the first value of the axis whose gate is off."""
    out: list[Spec] = []
    for family, of in axes.items():
        if family != "stability-gate":
            out += _points(family, "analysis-only" if family == "oracle-stable" else "main", of, {})
            continue
        gates = {gate: True for gate, _ in ABLATIONS.values()} | {"min_tail_distance_words": None}
        out += _points(family, "full", of, gates)
        for variant, (gate, axis) in ABLATIONS.items():
            out += _points(family, variant, {**of, axis: of[axis][:1]}, gates | {gate: False})
    if len({s.policy_id for s in out}) != len(out):
        raise ValueError("two configurations of the grid are the same")
    return sorted(out, key=lambda s: s.policy_id)


def observed_axes(obs: DataFrame, axes: dict[str, dict[str, list]] = AXES, step: float = 0.05) -> dict[str, dict[str, list]]:
    """The axes without the thresholds between which no probability lies: they part no scores, so they commit what the next one does."""
    per = round(1 / step)
    levels = {r["at"] for r in obs.select(F.floor(F.col("probability") * per).alias("at")).distinct().collect()}  # at most ``per`` + 1 rows
    kept = lambda of: {**of, "threshold": [t for t in of["threshold"] if round(t * per) in levels]}
    return {family: kept(of) if "threshold" in of and family != "oracle-stable" else of for family, of in axes.items()}


def pilot(specs: list[Spec]) -> list[Spec]:
    """One configuration for each selection key: the threshold 0.5, or the first by id."""
    first: dict[str, Spec] = {}
    for s in specs:
        if s.family != "fixed-threshold" or dict(s.parameters)["threshold"] == 0.5:
            first.setdefault(s.selection_key, s)
    return [first[k] for k in sorted(first)]


def gate_ablations(threshold: float, epsilon: float, min_margin: float, max_extension: float, min_tail: int) -> dict[str, Spec]:
    """The configurations of ``policies.gate_ablations``, by name."""
    on = {gate: True for gate, _ in ABLATIONS.values()}
    base = {"tau": threshold, "min_rescores": 1, "instability_horizon": 3, "epsilon": epsilon, "min_label_margin": min_margin, "max_extension_advantage": max_extension, "min_tail_distance_words": None}
    out = {"full": base | on} | {name: base | on | {gate: False} for name, (gate, _) in ABLATIONS.items()} | {"plus_tail_distance": base | on | {"min_tail_distance_words": min_tail}}
    return {name: Spec("stability-gate", name, tuple(sorted(q.items()))) for name, q in out.items()}


def frame(spark: SparkSession, specs: list[Spec]) -> DataFrame:
    """(policy_id, family, variant, selection_key, parameters_json, analysis_only): the table of configurations."""
    rows = [(s.policy_id, s.family, s.variant, s.selection_key, s.parameters_json, s.analysis_only) for s in specs]
    return spark.createDataFrame(rows, "policy_id string, family string, variant string, selection_key string, parameters_json string, analysis_only boolean")


def from_row(row) -> Spec:
    """The configuration of a stored row; one whose id does not fit its parameters is an error."""
    spec = Spec(row["family"], row["variant"], tuple(sorted(json.loads(row["parameters_json"]).items())))
    if spec.policy_id != row["policy_id"]:
        raise ValueError(f"{row['policy_id']} is not the id of its parameters")
    return spec


def _axis(specs: list[Spec], family: str, name: str) -> list:
    return sorted({dict(s.parameters)[name] for s in specs if s.family == family})


def features(states: DataFrame, specs: list[Spec]) -> DataFrame:
    """Adds to the gate's features what the configurations need of a candidate's past, in one fold over its rows.

    runs: per threshold of a snapshot patience the consecutive snapshots at it; averages: per
    alpha the exponential average; lows: per threshold of the oracle the last step below it (a look ahead).
    """
    patience, alphas, stable = _axis(specs, "snapshot-patience", "threshold"), _axis(specs, "ema", "alpha"), _axis(specs, "oracle-stable", "threshold")
    doubles = lambda values: F.array(*map(F.lit, values)).cast("array<double>")
    rows = gate_features(states, keep=("was_rescored",))
    payload = [c for c in rows.columns if c not in KEY]
    rows = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("step", F.struct(*payload).alias("s")))).alias("rows"))

    def point(s: Column, last: Column | None) -> Column:
        p = s["probability"]
        before = lambda name, i, kind: F.lit(None).cast(kind) if last is None else F.get(last[name], i)
        runs = F.transform(doubles(patience), lambda t, i: F.when(p < t, F.lit(0)).otherwise(F.coalesce(before("runs", i, "int"), F.lit(0)) + 1))
        average = lambda a, i: F.when(s["was_rescored"], p * a + before("averages", i, "double") * (F.lit(1.0) - a)).otherwise(before("averages", i, "double"))
        averages = F.transform(doubles(alphas), lambda a, i: F.coalesce(average(a, i), p))
        return F.struct(s.alias("s"), runs.alias("runs"), averages.alias("averages"))

    none = F.slice(F.transform("rows", lambda r: point(r["s"], None)), 1, 0)
    fold = F.aggregate("rows", none, lambda kept, r: F.array_append(kept, point(r["s"], F.try_element_at(kept, F.lit(-1)))))
    lows = F.transform(doubles(stable), lambda t: F.array_max(F.transform(F.filter("rows", lambda r: r["s"]["probability"] < t), lambda r: r["step"])))
    out = rows.select(*KEY, lows.alias("lows"), F.explode(fold).alias("r"))
    return out.select(*KEY, "lows", "r.s.*", "r.runs", "r.averages")


def ready(states: DataFrame, specs: list[Spec], *, look_ahead: bool = False) -> DataFrame:
    """(policy_id, key, step, probability, readiness): the ready rows of all configurations; those for analysis only must be allowed."""
    allow_look_ahead([s.policy_id for s in specs if s.analysis_only], look_ahead)
    rows = features(states, specs)
    at = {family: {v: i for i, v in enumerate(_axis(specs, family, name))} for family, name in (("snapshot-patience", "threshold"), ("ema", "alpha"), ("oracle-stable", "threshold"))}
    p, found = F.col("probability"), []

    def met(family: str, fields, condition, readiness=None) -> None:
        """The configurations of a family for which a row meets the condition: an array of (policy_id, readiness)."""
        of = [s for s in specs if s.family == family]
        if of:
            table = F.array(*(F.struct(F.lit(s.policy_id).alias("policy_id"), *(F.lit(v).alias(k) for k, v in fields(dict(s.parameters)).items())) for s in of))
            found.append(F.transform(F.filter(table, condition), lambda s: F.struct(s["policy_id"].alias("policy_id"), (p if readiness is None else readiness(s)).alias("readiness"))))

    same = lambda q: {k: float(v) if k == "threshold" else v for k, v in q.items()}
    met("fixed-threshold", same, lambda s: p >= s["threshold"])
    met("fixed-lag", same, lambda s: (p >= s["threshold"]) & (F.col("tail_distance_words") >= s["lag_words"]))
    met("snapshot-patience", lambda q: {"i": at["snapshot-patience"][q["threshold"]], "patience": q["patience"]}, lambda s: F.get("runs", s["i"]) >= s["patience"])
    met("rescore-patience", same, lambda s: (p >= s["threshold"]) & (F.col("rescore_count") >= s["patience"]))
    met("ema", lambda q: {"i": at["ema"][q["alpha"]], "threshold": q["threshold"]}, lambda s: F.get("averages", s["i"]) >= s["threshold"], lambda s: F.get("averages", s["i"]))
    met(
        "stability-gate",
        lambda q: {k: float(q[k]) if k not in ("min_rescores",) and not k.startswith("use_") else q[k] for k in ("tau", "min_rescores", "epsilon", "min_label_margin", "max_extension_advantage", "use_instability", "use_label_margin", "use_extension")},
        lambda s: (p >= s["tau"])
        & (F.col("rescore_count") >= s["min_rescores"])
        & (~s["use_instability"] | (F.col("instability") <= s["epsilon"]))
        & (~s["use_label_margin"] | (F.col("label_margin") >= s["min_label_margin"]))
        & (~s["use_extension"] | (F.col("extension_advantage") <= s["max_extension_advantage"])),
    )
    met("oracle-stable", lambda q: {"i": at["oracle-stable"][q["threshold"]]}, lambda s: F.get("lows", s["i"]).isNull() | (F.col("step") > F.get("lows", s["i"])))
    return rows.select(*KEY, "step", "probability", F.explode(F.concat(*found)).alias("m")).select("m.policy_id", *KEY, "step", "probability", "m.readiness")
