"""Simulations: draws are made once from a seed, firms are rows of a matrix product."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Beta parameters of the five exposures, and the exposures that each stress case multiplies.
DRAWS = ((2, 8), (2, 10), (1, 20), (2, 15), (2, 10))
STRESS = {"obsolescence": (1, 3, 1, 2, 1), "expiry": (2, 1, 1, 1, 1.5), "design": (1, 1, 2, 3, 1)}


def portfolio_var(exposures: DataFrame, firm: str, columns: list[str], draws: int = 1000, seed: int = 42) -> DataFrame:
    """(firm, var95, var99, cvar95 and the mean loss of the worst stress case) of simulated losses; one row of exposures a firm.

    All firms meet the same draws, so that they can be compared.
    """

    def run(frames):
        rng = np.random.default_rng(seed)
        beta = np.stack([rng.beta(a, b, draws) for a, b in DRAWS])
        for f in frames:
            x = f[columns].to_numpy(float)
            loss = np.sort(x @ beta, axis=1)
            v95, v99 = np.percentile(loss, [95, 99], axis=1)
            tail = np.where(loss >= v95[:, None], loss, np.nan)
            worst = np.max([(x * np.asarray(m)) @ beta.mean(1) for m in STRESS.values()], axis=0)
            yield pd.DataFrame({"firm": f[firm], "var95": v95.round(6), "var99": v99.round(6), "cvar95": np.nanmean(tail, axis=1).round(6), "worst_stress": worst.round(6)})

    kind = exposures.schema[firm].dataType.simpleString()
    return exposures.select(firm, *columns).mapInPandas(run, f"firm {kind}, var95 double, var99 double, cvar95 double, worst_stress double")


def npv_paths(firms: DataFrame, firm: str, income: str, growth: str, spread: str, paths: int = 5000, discount: float = 0.08, hazard: float = 0.1, seed: int = 42) -> DataFrame:
    """(firm, npv_mean, npv_low, npv_high): income grows by a normal rate and ends after an exponential life; 16 and 84 percentiles."""

    def run(frames):
        rng = np.random.default_rng(seed)
        z, life = rng.normal(size=paths), rng.exponential(1 / hazard, paths)
        for f in frames:
            out = []
            for name, x, g, s in zip(f[firm], f[income], f[growth], f[spread]):
                rate = np.log1p(np.clip(g + s * z, -0.9, 0.9)) - np.log1p(discount)
                value = x * np.where(np.abs(rate) < 1e-9, life, np.expm1(rate * life) / np.where(np.abs(rate) < 1e-9, 1, rate))
                low, high = np.percentile(value, [16, 84])
                out.append((name, round(float(value.mean()), 4), round(float(low), 4), round(float(high), 4)))
            yield pd.DataFrame(out, columns=["firm", "npv_mean", "npv_low", "npv_high"])

    kind = firms.schema[firm].dataType.simpleString()
    return firms.select(firm, income, growth, spread).mapInPandas(run, f"firm {kind}, npv_mean double, npv_low double, npv_high double")
