"""First non-null value of several attributes, in one aggregation and without a sort.

``first`` depends on the row order, which a shuffle does not keep. Here the order is part of the
aggregated value. Nearly every event carries all attributes, so those events share one state
(order + all attributes); only events with gaps feed the per-attribute states, which otherwise
stay null and add almost nothing to the shuffle.
"""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


class Earliest:
    def __init__(self, attributes: Sequence[str], order: Sequence[str]):
        self.attributes = list(attributes)
        self.order = list(order)

    def aggregates(self) -> list[Column]:
        complete = F.lit(True)
        for name in self.attributes:
            complete = complete & F.col(name).isNotNull()
        whole = F.min(F.when(complete, F.struct(*self.order, *self.attributes))).alias("_whole")
        return [whole] + [
            F.min(F.when(~complete & F.col(name).isNotNull(), F.struct(*self.order, name))).alias(f"_part_{name}")
            for name in self.attributes
        ]

    def merges(self) -> list[Column]:
        """The same states for groups of rows that hold states already."""
        return [F.min(name).alias(name) for name in ["_whole", *[f"_part_{name}" for name in self.attributes]]]

    def value(self, name: str) -> Column:
        whole = F.col("_whole")
        from_whole = F.when(
            whole.isNotNull(), F.struct(*[whole[c].alias(c) for c in [*self.order, name]])
        )
        return F.least(from_whole, F.col(f"_part_{name}"))[name].alias(name)

    def values(self) -> list[Column]:
        return [self.value(name) for name in self.attributes]
