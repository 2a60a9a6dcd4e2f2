"""Ridge regression as SQL: normal equations of standardised columns, solved by elimination."""

from __future__ import annotations

from collections.abc import Sequence


def ridge(name: str, rows: str, features: Sequence[str], target: str = "response", penalty: str = "1.0") -> str:
    """CTEs that end with ``name``: a row for each g of ``rows`` with b0 and a weight w_<feature> for each feature.

    The penalty belongs to standardised columns and response. One CTE eliminates one column.
    """
    n, f = len(features), list(features)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    spread = [f"avg({x}) AS m{i}, stddev_pop({x}) AS s{i}" for i, x in enumerate(f)]
    link = [f"covar_pop({f[i]}, {f[j]}) AS v{i}_{j}" for i, j in pairs] + [f"covar_pop({x}, {target}) AS v{i}_y" for i, x in enumerate(f)]
    keep = ", ".join(["g", "my", "sy", *(f"m{i}, s{i}" for i in range(n))])
    ctes = [f"{name}_s AS (SELECT g, avg({target}) AS my, stddev_pop({target}) AS sy, any_value({penalty}) AS penalty, {', '.join(spread + link)} FROM ({rows}) GROUP BY g)"]
    start = [f"{'1 + penalty / sy' if i == j else f'v{i}_{j} / (s{i} * s{j})'} AS a{i}_{j}" for i, j in pairs] + [f"v{i}_y / (s{i} * sy) AS c{i}" for i in range(n)]
    ctes.append(f"{name}_e0 AS (SELECT {keep}, {', '.join(start)} FROM {name}_s)")
    for k in range(n - 1):
        done = [f"a{i}_{j}" for i, j in pairs if i <= k] + [f"c{i}" for i in range(k + 1)]
        rest = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i, j in pairs if i > k]
        rest += [f"c{i} - a{k}_{i} * c{k} / a{k}_{k} AS c{i}" for i in range(k + 1, n)]
        ctes.append(f"{name}_e{k + 1} AS (SELECT {', '.join([keep, *done, *rest])} FROM {name}_e{k})")
    back = [f"(c{i}{''.join(f' - a{i}_{j} * x{j}' for j in range(i + 1, n))}) / a{i}_{i} AS x{i}" for i in reversed(range(n))]
    ctes.append(f"{name}_x AS (SELECT *, {', '.join(back)} FROM {name}_e{n - 1})")
    weights = [f"x{i} * sy / s{i} AS w_{x}" for i, x in enumerate(f)]
    inner = " - ".join(["my", *(f"x{i} * sy / s{i} * m{i}" for i in range(n))])
    ctes.append(f"{name} AS (SELECT g, {inner} AS b0, {', '.join(weights)} FROM {name}_x)")
    return ", ".join(ctes)


def line(features: Sequence[str]) -> str:
    """The prediction from the columns of ``ridge``."""
    return " + ".join(["b0", *(f"w_{x} * {x}" for x in features)])
