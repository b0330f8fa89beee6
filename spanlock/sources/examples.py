"""Examples with everything that belongs to them as one row, and back.

Several tables of a run meet by example in a single exchange: each row is put into a struct of its own column, the tables are
appended to each other, and one aggregate collects every column, so that neither joins nor repeated sorts are needed and
a table that has no rows for an example costs nothing. Rows that belong to no known example end up in the same aggregate and are
found there. If the tables are bucketed or partitioned by example, there is no exchange at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cogroup(tables: dict[str, DataFrame], order: dict[str, list[str]], key: str = "example_id") -> DataFrame:
    """(key, one array of structs for each table): all rows of all tables by key, each array in its order.

    A struct has the columns of its table but the key; those of the order come first. Rows of equal order follow each other
    by their other columns. Repeated rows stay repeated.
    """
    shape = {name: [*order[name], *(c for c in df.columns if c != key and c not in order[name])] for name, df in tables.items()}
    kinds = {name: df.select(F.struct(*shape[name]).alias("s")).schema["s"].dataType for name, df in tables.items()}
    parts = [df.select(key, *(F.struct(*shape[name]).alias(name) if name == own else F.lit(None).cast(kinds[name]).alias(name) for name in tables)) for own, df in tables.items()]
    rows = reduce(DataFrame.unionAll, parts)
    return rows.groupBy(key).agg(*(F.array_sort(F.collect_list(name)).alias(name) for name in tables))


def rows_of(nested: DataFrame, name: str, key: str = "example_id") -> DataFrame:
    """A table of nested rows, flat again."""
    return nested.select(key, F.explode(name).alias("__r")).select(key, "__r.*")


#: Rules of a nested example, by name; SQL over the arrays.
RULES = {
    "unknown_example": "size(examples) = 0",
    "repeated_example": "size(examples) > 1",
    "no_steps": "size(examples) > 0 and size(steps) = 0",
    "cold_missing": "size(examples) > 0 and size(cold) = 0",
    "cold_text": "exists(cold, c -> c.full_text is distinct from get(examples, 0).text)",
    "stream_text": "size(steps) > 0 and size(examples) > 0 and array_join(transform(steps, s -> s.chunk), '') is distinct from get(examples, 0).text",
    "step_gap": "exists(transform(steps, (s, i) -> s.step <> i + 1), x -> x)",
    "unknown_step": "exists(updates, u -> not array_contains(transform(steps, s -> s.step), u.step))",
}
ORDER = {"examples": [], "steps": ["step"], "updates": ["step", "start_word", "end_word"], "gold": ["start_char", "end_char", "label"], "cold": []}


def reconstruct(examples: DataFrame, steps: DataFrame, updates: DataFrame, gold: DataFrame, cold: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, examples, steps, updates, gold, cold, faults): whole examples, and which rules each breaks.

    A sound example has one row in ``examples``, steps that count from 1 and whose chunks are its text, a cold result of
    the same text, and score events at its own steps only.
    """
    nested = cogroup({"examples": examples, "steps": steps, "updates": updates, "gold": gold, "cold": cold}, ORDER, key)
    return nested.withColumn("faults", faults())


def faults() -> Column:
    """The names of the broken rules, in the order of ``RULES``."""
    return F.filter(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in RULES.items())), lambda x: x.isNotNull())


def sound(nested: DataFrame) -> DataFrame:
    """The nested examples; if one breaks a rule, reading it is an error that names it and the rules."""
    broken = F.concat(F.lit("example "), F.col(nested.columns[0]).cast("string"), F.lit(" breaks "), F.array_join("faults", ", "))
    return nested.where(F.when(F.size("faults") > 0, F.raise_error(broken).cast("boolean")).otherwise(F.lit(True)))
