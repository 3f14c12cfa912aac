"""Running values over each key's whole history, without one task per key.

A window partitioned by the key alone sends a hot key's full history to a single task. Here the history is cut into blocks
of consecutive offsets. Each block is reduced on the map side, the few block totals are scanned in order, and every row
combines its block's carry-in with a window that never leaves the block. No group exceeds ``block_rows`` rows as long as
offsets are distinct integers within a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 20

_BLOCK = "_block"


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is 'max', 'sum' or 'last' (last value that is not NULL)."""

    kind: str
    value: Column
    include_current: bool = False

    def block_total(self, column: str, offset: str) -> Column:
        c = F.col(column)
        if self.kind == "max":
            return F.max(c)
        if self.kind == "sum":
            return F.sum(c)
        return F.max_by(c, F.when(c.isNotNull(), F.col(offset)))

    def over(self, column: str, window) -> Column:
        c = F.col(column)
        if self.kind == "max":
            return F.max(c).over(window)
        if self.kind == "sum":
            return F.sum(c).over(window)
        return F.last(c, ignorenulls=True).over(window)

    def combine(self, carry: Column, local: Column) -> Column:
        if self.kind == "max":
            return F.greatest(carry, local)
        if self.kind == "sum":
            return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
        return F.coalesce(local, carry)


def with_running(
    df: DataFrame,
    keys: list[str],
    running: dict[str, Running],
    offset: str = "off",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add one column per entry of ``running``, evaluated in ``offset`` order within ``keys`` (which must not be NULL)."""
    inputs = {f"_in_{name}": spec.value for name, spec in running.items()}
    blocked = df.withColumns(inputs).withColumn(_BLOCK, F.call_function("div", F.col(offset), F.lit(block_rows)))

    totals = blocked.groupBy(*keys, _BLOCK).agg(
        *[spec.block_total(f"_in_{name}", offset).alias(f"_tot_{name}") for name, spec in running.items()]
    )
    before_block = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *keys, _BLOCK, *[spec.over(f"_tot_{name}", before_block).alias(f"_carry_{name}") for name, spec in running.items()]
    )

    inside = Window.partitionBy(*keys, _BLOCK).orderBy(offset)
    local = blocked.withColumns(
        {
            f"_local_{name}": spec.over(
                f"_in_{name}",
                inside.rowsBetween(Window.unboundedPreceding, 0 if spec.include_current else -1),
            )
            for name, spec in running.items()
        }
    )
    return local.join(carries.hint("merge"), [*keys, _BLOCK], "left").select(  # one row per key and block: too many to broadcast
        *df.columns,
        *[
            spec.combine(F.col(f"_carry_{name}"), F.col(f"_local_{name}")).alias(name)
            for name, spec in running.items()
        ],
    )
