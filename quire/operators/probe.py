"""Looking at the stages of a plan while another action runs: no second pass, no cached stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Probe:
    """Statistics and single values of named stages, collected by the action that consumes them.

    ``probe = Probe(); df = probe.watch(df, "scores", "embedding", at={"first": ("vec_id = 3", 0)})``; after an
    action on ``df`` (or on what is derived from it) ``probe.captures()`` has them. A stage can be watched under
    one name only; each watched frame reports its first action.
    """

    def __init__(self):
        self.stages: dict[str, tuple[Observation, str, list[str]]] = {}

    def watch(self, df: DataFrame, name: str, column: str, at: dict[str, tuple[str, int]] | None = None) -> DataFrame:
        """The same rows, watched: ``column`` is a number or an array of numbers.

        ``at``: sample -> (condition on the row, index in its array; any for a number). The smallest value
        of the rows that fit is taken, null if none does.
        """
        if name in self.stages:
            raise ValueError(f"stage {name} is watched already")
        array = df.schema[column].dataType.typeName() == "array"
        c = F.col(column)
        low, high = (F.array_min(c), F.array_max(c)) if array else (c, c)
        total = F.aggregate(c, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0))) if array else c.cast("double")
        held = F.size(F.filter(c, lambda x: x.isNotNull())) if array else F.when(c.isNotNull(), 1).otherwise(0)
        metrics = [F.count("*").alias("rows"), F.sum(F.when(c.isNotNull(), held)).alias("values"), F.min(low).cast("double").alias("min"), F.max(high).cast("double").alias("max"), F.sum(total).alias("sum")]
        metrics += [F.max(F.size(c)).alias("longest")] if array else []
        for sample, (condition, index) in (at or {}).items():
            value = F.get(c, F.lit(index)) if array else c
            metrics.append(F.min(F.when(F.expr(condition), value)).cast("double").alias(f"at_{sample}"))
        seen = Observation(name)
        self.stages[name] = (seen, df.schema[column].dataType.simpleString(), list(at or {}))
        return df.observe(seen, *metrics)

    def captures(self) -> dict[str, dict]:
        """name -> rows, values, min, max, mean, dtype, samples (and longest for arrays); waits for the action."""
        out = {}
        for name, (seen, dtype, samples) in self.stages.items():
            got = dict(seen.get)
            mean = got.pop("sum") / got["values"] if got["values"] else None
            taken = {s: got.pop(f"at_{s}") for s in samples}
            out[name] = got | {"mean": mean, "dtype": dtype, "samples": taken}
        return out
