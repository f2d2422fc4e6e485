"""Paired bootstrap: weights that unit and draw decide, shared by all models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cumulated Poisson(1) probabilities, as in sampling.bootstrap_means; 7 and more count as 6.
CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
#: Fixed sizes: tasks that sum up draws (each gives n_boot numbers a model or pair), units and draws weighted at once.
TASKS, UNITS, DRAWS = 12, 500, 500


def weights(units: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) weights (draws x units) from a 64-bit mix of unit hash, draw and seed."""
    def mix(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    stream = mix(draws.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    u = (mix(units.astype(np.int64).view(np.uint64)[None, :] ^ stream[:, None]) >> np.uint64(11)) / float(1 << 53)
    return sum((u > c).astype(np.float64) for c in CUTS)


def paired_bootstrap(df: DataFrame, unit: str, value: str, model: str, n_boot: int = 10_000, seed: int = 1) -> DataFrame:
    """(model_a, model_b, n, point, low, high, p): of each model, with model_b null, the mean over its units; of each
    pair of models the mean difference a - b over the units that both have. Intervals are 95 % percentiles of the
    draws; p is two-sided, at least 1 / n_boot, null for a single model. df has one row a unit and model.

    A unit's models are gathered and weighted together, so all of them share its draws. Sums over units are matrix
    products within tasks; what is shuffled is n_boot numbers a task and model or pair.
    """
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, points, total, held = {}, [], [], [], []
        for batch in batches:
            for i in range(0, len(batch), UNITS):
                part = batch.iloc[i : i + UNITS]
                cells = []
                for k, x in enumerate(part["x"]):
                    models = [(r["m"], r["v"]) for r in x]
                    for j, (a, va) in enumerate(models):
                        cells.append((k, (a, None), va))
                        cells += [(k, (a, b), va - vb) for b, vb in models[j + 1 :]]
                for _, key, _ in cells:
                    if key not in at:
                        at[key] = len(at)
                        n.append(0)
                        points.append(0.0)
                        total.append(np.zeros(n_boot))
                        held.append(np.zeros(n_boot))
                keys = sorted({at[key] for _, key, _ in cells})
                column = {c: j for j, c in enumerate(keys)}
                values, present = np.zeros((len(part), len(keys))), np.zeros((len(part), len(keys)))
                for k, key, v in cells:
                    values[k, column[at[key]]], present[k, column[at[key]]] = v, 1
                    n[at[key]] += 1
                    points[at[key]] += v
                both, units = np.hstack([values, present]), part["h"].to_numpy()
                for b in range(0, n_boot, DRAWS):
                    s = weights(units, np.arange(b, min(b + DRAWS, n_boot)), seed) @ both
                    for c, j in column.items():
                        total[c][b : b + DRAWS] += s[:, j]
                        held[c][b : b + DRAWS] += s[:, len(keys) + j]
        for (a, b), c in at.items():
            yield pd.DataFrame({"model_a": [a], "model_b": [b], "n": [n[c]], "s": [points[c]], "total": [total[c]], "held": [held[c]]})

    def interval(rows: pd.DataFrame) -> pd.DataFrame:
        total, held = np.sum(np.stack(rows["total"].to_list()), axis=0), np.sum(np.stack(rows["held"].to_list()), axis=0)
        means = total[held > 0] / held[held > 0]  # a draw without any unit has no mean
        n, pair = int(rows["n"].sum()), pd.notna(rows["model_b"].iloc[0])
        low, high = np.percentile(means, [2.5, 97.5]) if len(means) else (None, None)
        p = min(1.0, max(2 * min((means <= 0).mean(), (means >= 0).mean()), 1 / n_boot)) if pair and len(means) else None
        return pd.DataFrame({"model_a": [rows["model_a"].iloc[0]], "model_b": [rows["model_b"].iloc[0] if pair else None], "n": [n], "point": [rows["s"].sum() / n], "low": [low], "high": [high], "p": [p]})

    cells = df.where(F.col(unit).isNotNull() & F.col(model).isNotNull() & F.col(value).isNotNull())
    units = cells.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(F.col(model).cast("string").alias("m"), F.col(value).cast("double").alias("v")))).alias("x"))
    spread = units.select(F.xxhash64(F.col(unit).cast("string")).alias("h"), "x").repartition(TASKS)
    parts = spread.mapInPandas(sums, "model_a string, model_b string, n long, s double, total array<double>, held array<double>")
    return parts.groupBy("model_a", "model_b").applyInPandas(interval, "model_a string, model_b string, n long, point double, low double, high double, p double")
