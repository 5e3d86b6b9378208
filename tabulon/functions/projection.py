"""Fitted row-wise transforms: a set of SQL expressions, reusable as an ML stage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, functions as F

from .columns import quoted


@dataclass(frozen=True)
class Projection:
    """Output column name -> SQL expression over the input row.

    A name that already exists is replaced in place, a new one is appended. ``dropped`` columns
    are removed and ``where`` filters rows. Everything stays inside one projection, so chains of
    fitted steps collapse to a single scan.
    """

    columns: dict[str, str] = field(default_factory=dict)
    dropped: tuple[str, ...] = ()
    where: str | None = None

    def _select(self, names: list[str]) -> list[str]:
        kept = [n for n in names if n not in self.dropped or n in self.columns]
        items = [
            f"{self.columns[n]} AS {quoted(n)}" if n in self.columns else quoted(n) for n in kept
        ]
        items += [f"{sql} AS {quoted(n)}" for n, sql in self.columns.items() if n not in kept]
        return items

    def apply(self, df: DataFrame) -> DataFrame:
        if self.where:
            df = df.where(F.expr(self.where))
        return df.selectExpr(*self._select(df.columns))

    def stage(self, input_columns: list[str]) -> SQLTransformer:
        """The same transform as a saveable ML stage."""
        where = f" WHERE {self.where}" if self.where else ""
        return SQLTransformer(
            statement=f"SELECT {', '.join(self._select(input_columns))} FROM __THIS__{where}"
        )
