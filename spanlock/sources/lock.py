"""Selections that are locked before held-out data are read.

The winners of one split are written as a run whose fingerprint covers everything they were chosen from: the records they were
chosen by, the configurations that competed, and the rule. Opening a lock works these digests out anew; if any input is
not what it was, the lock is refused and nothing is evaluated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import specs as G
from . import runs as N


def _fingerprint(records: DataFrame, competed: DataFrame, rule: dict[str, object], split: str) -> N.Fingerprint:
    return N.fingerprint({"kind": "selection", "split": split}, rule, {"records": records, "competed": competed})


def freeze(spark: SparkSession, root: str, winners: DataFrame, records: DataFrame, competed: DataFrame, rule: dict[str, object], *, split: str) -> str:
    """Writes the winners (mode, selection_key, policy_id) with their configurations; returns the folder of the lock.

    records: the rows they were chosen by; competed: the table of configurations; rule: what else the choice depends on. The
    same inputs give the same lock, which is reused.
    """
    of = _fingerprint(records, competed, rule, split)
    own = winners.join(competed.select("policy_id", "family", "variant", "parameters_json", "analysis_only"), "policy_id")
    N.write_run(spark, root, of, {"winners": own})
    return N.folder_of(root, of.run_id)


def opened(spark: SparkSession, folder: str, records: DataFrame, competed: DataFrame, rule: dict[str, object], *, split: str) -> tuple[DataFrame, list[G.Spec]]:
    """(winners, their configurations) of a lock whose inputs are unchanged; anything else is an ``IntegrityError``.

    Configurations are rebuilt from their parameters, and one whose id does not fit them is an error too.
    """
    tables = N.read_run(spark, folder, expected=_fingerprint(records, competed, rule, split))
    rows = tables["winners"].select("policy_id", "family", "variant", "parameters_json").distinct().orderBy("policy_id").collect()  # a few winners
    return tables["winners"], [G.from_row(r) for r in rows]
