"""The table every component works on.

``row_id BIGINT``, ``label INT``, ``split STRING`` in (train, test), and the features:
either scalar DOUBLE columns (narrow data, stays in code generation) or one
``array<double>`` column (wide outputs such as kernel maps, where thousands of columns
would break code generation).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE_LIMIT = 100  # whole-stage code generation stops at about this many fields
ARRAY = "features"
KEYS = ("row_id", "label", "split")


@dataclass(frozen=True)
class Features:
    df: DataFrame
    names: tuple[str, ...] = ()
    width: int = 0

    @property
    def is_wide(self) -> bool:
        return not self.names

    @property
    def dim(self) -> int:
        return self.width if self.is_wide else len(self.names)

    def elements(self) -> list[Column]:
        """One column expression per feature, in both layouts."""
        if self.is_wide:
            return [F.col(ARRAY)[j] for j in range(self.width)]
        return [F.col(c) for c in self.names]

    def array(self) -> Column:
        return F.col(ARRAY) if self.is_wide else F.array(*[F.col(c) for c in self.names])

    def keys(self) -> list[str]:
        return [c for c in KEYS if c in self.df.columns]

    def train(self) -> "Features":
        return replace(self, df=self.df.filter(F.col("split") == "train"))

    def with_array(self) -> DataFrame:
        """Keys and the features as one array column."""
        return self.df.select(*self.keys(), self.array().alias(ARRAY))

    def with_vector(self) -> DataFrame:
        """Keys and the features as one ML vector column."""
        return self.df.select(*self.keys(), array_to_vector(self.array()).alias(ARRAY))

    def select_columns(self, positions: list[int]) -> "Features":
        """Keep some features, in the given order."""
        if self.is_wide:
            picked = F.array(*[F.col(ARRAY)[j] for j in positions]).cast("array<double>")
            return from_array(self.df.select(*self.keys(), picked.alias(ARRAY)), len(positions))
        names = [self.names[j] for j in positions]
        return Features(self.df.select(*self.keys(), *names), tuple(names))

    def replace_elements(self, columns: list[Column], names: list[str] | None = None) -> "Features":
        """The same rows with new feature expressions."""
        if len(columns) > WIDE_LIMIT:
            return from_array(self.df.select(*self.keys(), F.array(*columns).alias(ARRAY)), len(columns))
        names = names or (list(self.names) if len(self.names) == len(columns) else None)
        names = names or [f"f_{j}" for j in range(len(columns))]
        return from_columns(
            self.df.select(*self.keys(), *[c.alias(n) for c, n in zip(columns, names)]), names
        )


def from_columns(df: DataFrame, names) -> Features:
    return Features(df, tuple(names))


def from_array(df: DataFrame, width: int) -> Features:
    return Features(df, (), width)


def spread(features: Features) -> Features:
    """Array layout to scalar columns f_0, f_1, ..."""
    if not features.is_wide:
        return features
    names = [f"f_{j}" for j in range(features.width)]
    columns = [e.alias(n) for e, n in zip(features.elements(), names)]
    return from_columns(features.df.select(*features.keys(), *columns), names)
