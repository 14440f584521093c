"""Mean imputation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from pipegrid.frame import Features


@dataclass(frozen=True)
class MeanImputer:
    means: tuple[float, ...]

    def apply(self, features: Features) -> Features:
        filled = [
            F.coalesce(F.nanvl(e, F.lit(None).cast("double")), F.lit(m))
            for e, m in zip(features.elements(), self.means)
        ]
        return features.replace_elements(filled)


def fit_mean_imputer(train: Features, seed: int = 0) -> MeanImputer:
    """One aggregation over all columns; NULL and NaN are missing."""
    clean = [F.nanvl(e.cast("double"), F.lit(None).cast("double")) for e in train.elements()]
    row = train.df.agg(*[F.avg(c).alias(f"m_{j}") for j, c in enumerate(clean)]).first()
    empty = [j for j, m in enumerate(row) if m is None]
    if empty:
        raise ValueError(f"columns without any value cannot be imputed: {empty}")
    return MeanImputer(tuple(row))
