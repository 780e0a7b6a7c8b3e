"""The engine: named schemas with an expression each, run as counts, sums and predictions."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions import unsigned as U
from tessera.operators import native
from tessera.plans.ir import MASK, Node, exceeds
from tessera.plans.lower import Lowering, is_forest
from tessera.plans.schema import Schema, SchemaError, SchemaRegistry

MODES = ("bit_sliced", "scalar", "gpu_throughput")  # hints: one plan serves all of them


class Engine:
    def __init__(self):
        self.schemas = SchemaRegistry()
        self._logic: dict[str, Node] = {}

    def register_schema(self, schema: Schema, replace: bool = False) -> Schema:
        if replace:
            self._logic.pop(schema.name, None)
        return self.schemas.register(schema, replace)

    def set_expression(self, schema: str, expression: Node, mode: str = "bit_sliced") -> None:
        """Bind an expression to a schema.  Unknown schemas, fields and modes raise."""
        if mode not in MODES:
            raise ValueError(f"no such mode: {mode}")
        known = self.schemas.get(schema)
        for f in expression.fields():
            known.field(f)
        Lowering(known)  # the tree is well-typed by construction
        self._logic[schema] = expression

    def set_threshold(self, schema: str, field: str, threshold: int) -> None:
        self.set_expression(schema, exceeds(field, threshold))

    def _bound(self, schema: str, lets: bool = False) -> tuple[Lowering, Node]:
        known = self.schemas.get(schema)
        if schema not in self._logic:
            raise SchemaError(f"{schema} has no expression")
        return Lowering(known, lets), self._logic[schema]

    def predicate(self, schema: str) -> Column:
        low, n = self._bound(schema)
        return low.mask(n)

    def _aggregate(self, low: Lowering, n: Node, name: str) -> Column:
        if n.result == MASK:
            return F.count_if(low.mask(n)).alias(name)
        if is_forest(n):
            return low.total(n).alias(name)
        v = low.plane(n)
        return U.sum_wrapped(v.column, v.most if v.plain else U.WORD - 1).alias(name)

    def aggregate(self, schema: str, name: str = "result") -> Column:
        """The aggregate of the bound expression: matches, a forest's sum, or the sum of a number."""
        return self._aggregate(*self._bound(schema), name)

    def matching(self, schema: str, rows: DataFrame) -> DataFrame:
        """The rows that the bound mask matches.  A filter is pushed below projections, so nothing is named here."""
        return rows.where(self.predicate(schema))

    def source(self, schema: str, stored: DataFrame) -> DataFrame:
        """The schema's fields made from a stored table; what a bound mask says about stored columns is asked first, and reaches the scan."""
        low, n = self._bound(schema)
        implied = low.implied(n) if n.result == MASK else None
        return low.schema.view(stored if implied is None else stored.where(implied))

    def execute_frame(self, schema: str, rows: DataFrame, name: str = "result") -> DataFrame:
        """One row with the result.  A count filters first, so the predicate reaches the scan."""
        low, n = self._bound(schema, True)
        value = self._aggregate(low, n, name)
        if n.result == MASK and not low.lets:
            return self.matching(schema, rows).agg(F.count(F.lit(1)).alias(name))
        return low.bind(rows).agg(value)

    def execute(self, schema: str, rows: DataFrame) -> int:
        return int(self.execute_frame(schema, rows).first()[0])

    def execute_vector(self, schema: str, rows: DataFrame, keys: list[str], precision: int = 1, name: str = "prediction") -> DataFrame:
        """A double for each row: 1 or 0 for a mask, the sum over trees or the signed number divided by ``precision``."""
        low, n = self._bound(schema, True)
        if n.result == MASK:
            value = F.when(low.mask(n), 1.0).otherwise(0.0)
        else:
            raw = low.row_sum(n) if is_forest(n) else low.plane(n).column
            value = raw.cast("double") / F.lit(float(precision))
        return low.bind(rows).select(*keys, value.alias(name))

    def execute_native(self, schema: str, planes: DataFrame, name: str = "result") -> DataFrame:
        """One row with the result, computed on bit-planes: ``planes`` has n_rows and an array of 64 words for each field."""
        known, n = self.schemas.get(schema), self._bound(schema)[1]
        partial = native.partial_sums(planes, n, [f.name for f in known.fields if f.name in n.fields()])
        if n.result == MASK:
            return partial.agg(F.coalesce(F.sum("value"), F.lit(0)).alias(name))
        return partial.agg(U.sum_wrapped(F.col("value")).alias(name))

    def execute_stats(self, schema: str, rows: DataFrame) -> dict[str, float]:
        """Result, number of rows, seconds and rows a second, from one pass."""
        seen, began = Observation(), time.perf_counter()
        low, n = self._bound(schema, True)
        value = self._aggregate(low, n, "result")
        result = low.bind(rows.observe(seen, F.count(F.lit(1)).alias("rows"))).agg(value).first()[0]
        seconds, count = time.perf_counter() - began, int(seen.get["rows"])
        return {"result": int(result), "rows": count, "seconds": seconds, "rows_per_second": count / seconds}
