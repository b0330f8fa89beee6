"""The edge buffer: predictions at the end of the visible text wait for more of it.

A candidate is eligible at a probability of at least ``tau``. The first step at which an
eligible candidate with a start word reaches the last visible word sets the deadline of that
start: ``updates`` steps later. Longer candidates with the same start do not set it anew. Until
the deadline nothing with that start is ready; from then on every candidate with it is, by its
current probability. Candidates whose start has never been eligible at the edge are ready at once.

Rows with phase ``live`` are ready before the stream ends. If the stream ends sooner than the
deadline, what is eligible at the last step becomes ready there with phase ``close``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .policies import KEY


def edge_buffer(states: DataFrame, tau: float, updates: int = 2, *, close: bool = True, steps: DataFrame | None = None) -> DataFrame:
    """(key, step, probability, readiness, phase): ready rows, for ``resolve.commits``. ``steps`` of the streams spare a second pass over states."""
    start = Window.partitionBy("example_id", "start_word")
    eligible = F.col("probability") >= tau
    touched = F.min(F.when(eligible & (F.col("tail_distance_words") == 0), F.col("step"))).over(start.orderBy("step").rangeBetween(Window.unboundedPreceding, 0))
    rows = states.withColumn("held_since", touched).where(eligible)
    rows = rows.withColumn("due", F.col("held_since").isNull() | (F.col("step") >= F.col("held_since") + updates))
    if close:
        # A stream has states at its last step, as cached ones are carried on.
        last = (states if steps is None else steps).groupBy("example_id").agg(F.max("step").alias("last_step"))
        rows = rows.join(last, "example_id")
        rows = rows.where(F.col("due") | (F.col("step") == F.col("last_step")))
    else:
        rows = rows.where("due")
    return rows.select(*KEY, "step", "probability", F.col("probability").alias("readiness"), F.when(F.col("due"), "live").otherwise("close").alias("phase"))
