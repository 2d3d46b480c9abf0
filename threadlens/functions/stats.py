"""Two-sided significance of a Pearson correlation (F25), as a column expression.

Under independence r of n pairs is distributed like sin(phi) with a density in
proportion to cos(phi)^(n-3), so the p-value is the share of the area from
asin|r| to pi/2 in the area from 0 to pi/2. Both areas are Simpson sums over a
window of 40 standard deviations (1/sqrt(n-2) each), so any n is treated alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 2_000
WIDTH = 40.0


def _area(start: Column, dof: Column) -> Column:
    h = (F.least(F.lit(math.pi / 2), start + F.lit(WIDTH) / F.sqrt(dof)) - start) / F.lit(float(STEPS))

    def term(i: Column) -> Column:
        weight = F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        height = F.exp((dof - 1.0) * F.log(F.greatest(F.cos(start + i * h), F.lit(1e-300))))
        return weight * height

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda acc, i: acc + term(i)) * h


def pearson_p_col(r, n) -> Column:
    """p of Pearson r with n pairs; NULL without r or with fewer than three pairs. Meant for
    aggregated (few-row) frames."""
    rc = (F.col(r) if isinstance(r, str) else r).cast("double")
    nc = (F.col(n) if isinstance(n, str) else n).cast("double")
    dof = F.greatest(nc - 2.0, F.lit(1.0))
    angle = F.asin(F.least(F.abs(rc), F.lit(1.0)))
    return F.when((nc >= 3) & rc.isNotNull() & ~F.isnan(rc), _area(angle, dof) / _area(F.lit(0.0), dof))


def pearson_p_sql(r: str, n: str) -> str:
    """The same areas in DuckDB SQL, for the oracles; ``r`` and ``n`` are column names."""
    def area(start: str) -> str:
        h = f"((least(pi() / 2, {start} + {WIDTH} / sqrt(greatest({n} - 2.0, 1.0))) - {start}) / {STEPS}.0)"
        return (f"(list_sum([CASE WHEN i IN (0, {STEPS}) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END * "
                f"exp((greatest({n} - 2.0, 1.0) - 1.0) * ln(greatest(cos({start} + i * {h}), 1e-300))) "
                f"FOR i IN range(0, {STEPS + 1})]) * {h})")
    return f"(CASE WHEN {n} >= 3 AND {r} IS NOT NULL THEN {area(f'asin(least(abs({r}), 1.0))')} / {area('0.0')} END)"
