"""Penalised logistic regressions in plain SQL: Newton steps written out, for the oracles."""

from __future__ import annotations


def newton_sql(name: str, rows: str, key: str, features: list[str], label: str, penalty: float = 1.0, steps: int = 14) -> str:
    """CTEs that end in ``name``: key, n, positives, b0 to bk of one regression for every key.

    ``rows`` is a CTE with the key, the features without NULLs and a 0/1 label.  Every step sums
    gradient and second derivatives and solves the linear system by elimination.
    """
    size = range(len(features) + 1)
    x = ["1.0", *features]
    ctes = [f"{name}_0 AS MATERIALIZED (SELECT {key}, {', '.join(f'0.0::DOUBLE AS b{i}' for i in size)} FROM {rows} GROUP BY {key})"]
    for k in range(1, steps + 1):
        z = " + ".join(f"b{i} * {x[i]}" for i in size)
        # Second derivatives with the gradient as the last column; then all but the diagonal is taken away, column by column.
        sums = {(i, j): f"sum(q * {x[i]} * {x[j]})" + (f" + {penalty}" if i == j and i else "") for i in size for j in size if i <= j}
        left = [f"sum(r * {x[i]})" + (f" + {penalty} * any_value(b{i})" if i else "") for i in size]
        upper = ", ".join(f"{v} AS h{i}_{j}" for (i, j), v in sums.items())
        matrix = ", ".join("[" + ", ".join([f"h{min(i, j)}_{max(i, j)}" for j in size] + [f"g{i}"]) + "]" for i in size)
        ctes.append(f"{name}_s{k} AS MATERIALIZED (SELECT {key}, {', '.join(f'any_value(b{i}) AS b{i}' for i in size)}, {upper}, "
                    f"{', '.join(f'{v} AS g{i}' for i, v in enumerate(left))} FROM (SELECT *, p * (1 - p) AS q, p - {label} AS r FROM ("
                    f"SELECT *, 1 / (1 + exp(-({z}))) AS p FROM {rows} JOIN {name}_{k - 1} USING ({key}))) GROUP BY {key})")
        solved = f"SELECT {key}, {', '.join(f'b{i}' for i in size)}, [{matrix}] AS m FROM {name}_s{k}"
        for e in range(1, len(features) + 2):
            solved = (f"SELECT * REPLACE (list_transform(m, lambda row, i: CASE WHEN i = {e} THEN row ELSE "
                      f"list_transform(row, lambda v, j: v - row[{e}] / m[{e}][{e}] * m[{e}][j]) END) AS m) FROM ({solved})")
        ctes.append(f"{name}_{k} AS MATERIALIZED (SELECT {key}, {', '.join(f'b{i} - m[{i + 1}][{len(features) + 2}] / m[{i + 1}][{i + 1}] AS b{i}' for i in size)} FROM ({solved}))")
    ctes.append(f"{name} AS MATERIALIZED (SELECT {key}, n, positives, {', '.join(f'b{i}' for i in size)} FROM {name}_{steps} "
                f"JOIN (SELECT {key}, count(*) AS n, CAST(sum({label}) AS BIGINT) AS positives FROM {rows} GROUP BY {key}) USING ({key}))")
    return ",\n".join(ctes)


def score_sql(features: list[str], prefix: str = "") -> str:
    """Probability of a row under b0 to bk."""
    z = " + ".join([f"{prefix}b0", *[f"{prefix}b{i + 1} * {c}" for i, c in enumerate(features)]])
    return f"1 / (1 + exp(-({z})))"
