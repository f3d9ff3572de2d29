"""Principal components."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.matrices import coo_from_numpy, to_coo
from .elementwise import FEATURES, max_abs_diff
from .gram import WIDE, as_block, gram, width
from .linalg import canonical, eigh_desc, random_svd, tall_t_times, times
from .sketch import RowSketch


class Transform(Protocol):
    """What a fitted model that maps rows both ways offers."""

    def transform(self, m: DataFrame) -> DataFrame: ...

    def inverse(self, z: DataFrame) -> DataFrame: ...


def round_trip_error(model: Transform, m: DataFrame, **how) -> float:
    """Largest gap between rows and what the model makes of them and back."""
    back = model.inverse(model.transform(m, **how))
    return float(max_abs_diff(to_coo(back), to_coo(m)).first()["max_diff"])


@dataclass(frozen=True)
class PcaModel:
    """means (k), components (r x k), singular_values (r), n."""

    n: int
    means: np.ndarray
    components: np.ndarray
    singular_values: np.ndarray

    @property
    def explained_var(self) -> np.ndarray:
        return self.singular_values**2 / (self.n - 1)

    def transform(self, m: DataFrame, center_on: str = "target") -> DataFrame:
        """Scores; centred on the target's own means (as first defined) or, with
        ``center_on='fit'``, on the means of the fit."""
        means = column_sums(m, len(self.means)) / m.count() if center_on == "target" else self.means
        return shifted(times(m, self.components.T), -(means @ self.components.T))

    def inverse(self, z: DataFrame) -> DataFrame:
        """Back to features; adds the means of the fit."""
        return shifted(times(z, self.components), self.means)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """(i, j, value) of the components."""
        return coo_from_numpy(spark, self.components)


def fit(m: DataFrame, rank: int, n_iters: int = 20, n_oversamples: int | None = None, method: str | None = None, seed: int = 0) -> PcaModel:
    """Gram matrix and eigenvectors up to ``WIDE`` columns, else the randomized
    SVD of the centred rows (centring is a Column expression, never stored)."""
    k = width(m)
    if rank > k:
        raise ValueError(f"rank {rank} exceeds {k}")
    if (method or ("gram" if k <= WIDE else "random")) == "gram":
        g = gram(m, k)
        w, v = eigh_desc(g.comoment)
        comp = v[:, :rank].T
        return PcaModel(g.n, g.mean, comp * canonical(comp)[:, None], np.sqrt(np.maximum(w[:rank], 0)))
    n = m.count()
    means = column_sums(m, k) / n
    found = random_svd(shifted(m, -means), rank, n_iters, min(k, 10) if n_oversamples is None else n_oversamples, seed, k)
    return PcaModel(n, means, found.vt, found.s)


def refit(old: RowSketch, new: RowSketch, rank: int) -> tuple[PcaModel, RowSketch]:
    """The model of all rows from a stored sketch of the old ones and that of
    new ones, and their merged sketch; old rows aren't read.  Squared singular
    values are at most ``loss`` of the merged sketch below the exact ones."""
    both = old.merge(new)
    return from_sketch(both, rank), both


def from_sketch(s: RowSketch, rank: int) -> PcaModel:
    if rank > len(s.sums):
        raise ValueError(f"rank {rank} exceeds {len(s.sums)}")
    w, v = eigh_desc(s.comoment)
    comp = v[:, :rank].T
    return PcaModel(s.n, s.means, comp * canonical(comp)[:, None], np.sqrt(np.maximum(w[:rank], 0)))


def column_sums(m: DataFrame, k: int) -> np.ndarray:
    """Sums of all columns in one pass, whatever their number."""
    return tall_t_times(m, None, lambda x: x.sum(0)[None], 1, k)[0]


def shifted(m: DataFrame, by: np.ndarray) -> DataFrame:
    """Each row plus ``by``, which is sent along."""
    shared = m.sparkSession.sparkContext.broadcast(np.asarray(by, float))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = as_block(b.column(1)) + shared.value
                ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["row_id", FEATURES])

    return m.select("row_id", FEATURES).mapInArrow(run, "row_id long, features array<double>")
