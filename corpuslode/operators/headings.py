"""Trees of headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_parents(headings: DataFrame, by: str, deepest: int = 6) -> DataFrame:
    """Adds `parent_pos`: of each heading (by, pos, level) the last one before it of a smaller level, or null.

    One window over a document's headings: the last place of each level is carried along, and no row meets another.
    """
    before = Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("pos")), True).over(before)) for k in range(1, deepest)]
    return headings.withColumn("parent_pos", F.greatest(*last))


def with_ancestors(headings: DataFrame, by: str, deepest: int = 6) -> DataFrame:
    """Adds `ancestors` (positions, outermost first) and `leaf` (no deeper heading follows) to headings (by, pos, level).

    A level's last heading before a place is an ancestor if no heading of a smaller level came after it.
    """
    order = Window.partitionBy(by).orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("pos")), True).over(before) for k in range(1, deepest)]
    rows = headings.withColumns({f"_l{k}": c for k, c in enumerate(last, 1)})
    kept = []
    for k in range(1, deepest):
        above = F.greatest(*[F.coalesce(f"_l{j}", F.lit(-1)) for j in range(1, k)], F.lit(-1), F.lit(-1))
        kept.append(F.when((F.col("level") > k) & (F.col(f"_l{k}") > above), F.col(f"_l{k}")))
    out = rows.withColumns({"ancestors": F.array_compact(F.array(*kept)), "leaf": F.coalesce(F.lead("level").over(order) <= F.col("level"), F.lit(True))})
    return out.drop(*[f"_l{k}" for k in range(1, deepest)])
