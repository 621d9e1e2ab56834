"""The alternating fit at rank 1 as one SQL text, for the twins of model queries.

At rank 1 every solve is a quotient of sums, so a few iterations unroll into a
chain of common table expressions.
"""

from __future__ import annotations

from ratingspark.plans.config import Run
from ratingspark.workload import views as v

FEATURES = ("price", "size")  # one column each, in the order of their names


def uniform_sql(seed: int, tag: str, *keys: str) -> str:
    text = ", ".join([f"'{seed}'", f"'{tag}'", *keys])
    return f"((('0x' || substr(md5(concat_ws(':', {text})), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def normal_sql(seed: int, tag: str, *keys: str) -> str:
    radius = f"sqrt(-2.0 * ln({uniform_sql(seed, tag + '.r', *keys)}))"
    return f"0.1 * {radius} * cos(2.0 * pi() * {uniform_sql(seed, tag + '.a', *keys)})"


def runs_sql(runs: list[Run]) -> str:
    rows = []
    for run in runs:
        c = run.config
        rows.append(
            f"({run.run_id}, {'NULL' if run.fold is None else run.fold}, {c.lambda_u!r}, {c.lambda_v!r}, "
            f"{c.user_bias_penalty!r}, {c.item_bias_penalty!r}, {str(c.pop_reg_mode is not None).lower()}, "
            f"{(c.alpha if c.uses_graph else 0.0)!r}, {', '.join(repr(c.lambda_w.get(f, 0.0)) for f in FEATURES)})"
        )
    return f"""runs AS (SELECT CAST(run_id AS INTEGER) AS run_id, CAST(fold AS INTEGER) AS fold, CAST(lu AS DOUBLE) AS lu,
  CAST(lv AS DOUBLE) AS lv, CAST(lbu AS DOUBLE) AS lbu, CAST(lbi AS DOUBLE) AS lbi, pop, CAST(alpha AS DOUBLE) AS alpha,
  CAST(lw_price AS DOUBLE) AS lw_price, CAST(lw_size AS DOUBLE) AS lw_size
  FROM (VALUES {', '.join(rows)}) AS r(run_id, fold, lu, lv, lbu, lbi, pop, alpha, lw_price, lw_size))"""


def fit_sql(
    runs: list[Run],
    iterations: int,
    ratings: str = v.FOLDED,
    source: str = "folded",
    features: bool = False,
    edges: str | None = None,
    cold: bool = False,
) -> str:
    """CTEs users{t}, items{t}, means{t}: state after t iterations (0 = start).

    All runs must refit their projections on every iteration. ``cold`` adds users
    and items without ratings; they have no features.
    """
    shift0 = "0.0"
    parts = [ratings, runs_sql(runs)] + ([v.COLD] if cold else [])
    user, users = ("user_id", "wide_users") if cold else ("c_custkey", "customer")
    item, items = ("item_id", "wide_items") if cold else ("p_partkey", "part")
    if features:
        parts.append(v.SCALARS)
        parts.append(
            "w0 AS (SELECT run_id, "
            + ", ".join(f"{normal_sql(42, 'W.' + f, '0', '0')} AS w_{f}" for f in FEATURES)
            + " FROM runs)"
        )
        shift0 = " + ".join(f"x_{f} * w_{f}" for f in FEATURES)
    join0 = "JOIN feats ON item_id = p_partkey JOIN w0 USING (run_id)" if features else ""
    parts.append(
        f"""tr AS (SELECT run_id, user_id, item_id, rating FROM {source} f JOIN runs r ON r.fold IS NULL OR f.fold <> r.fold),
means0 AS (SELECT run_id, avg(rating) AS mu FROM tr GROUP BY 1),
users0 AS (SELECT run_id, {user} AS user_id, {normal_sql(42, 'U', user, '0')} AS u, 0.0 AS b_u FROM runs, {users}),
items0 AS (SELECT run_id, {item} AS item_id, {normal_sql(42, 'V', item, '0')} AS v, {shift0} AS f, 0.0 AS b_i
  FROM runs CROSS JOIN {items} {join0})"""
    )
    if edges:
        parts.append(edges)
    for t in range(1, iterations + 1):
        p = t - 1
        parts.append(
            f"""us{t} AS (SELECT run_id, user_id, count(*) AS n, sum(v + f) AS s, sum((v + f) * (v + f)) AS g,
  sum((v + f) * (rating - mu - b_i)) AS c, sum(rating - mu - b_i) AS t
  FROM tr JOIN items{p} USING (run_id, item_id) JOIN means{p} USING (run_id) GROUP BY 1, 2),
users{t} AS (SELECT run_id, user_id, coalesce(u1, u) AS u, coalesce((t - s * u1) / (n + lbu + 1e-10), b_u) AS b_u FROM
  (SELECT *, (c - b_u * s) / (g + lu + 1e-10) AS u1 FROM users{p} JOIN runs USING (run_id) LEFT JOIN us{t} USING (run_id, user_id)))"""
        )
        if edges:
            parts.append(
                f"pull{t} AS (SELECT run_id, src AS item_id, sum(sim) AS d, sum(sim * v) AS pull "
                f"FROM edges JOIN items{p} ON item_id = dst GROUP BY 1, 2)"
            )
        graph = f"LEFT JOIN pull{t} USING (run_id, item_id)" if edges else ""
        to_rhs = " + alpha * coalesce(pull, 0)" if edges else ""
        to_reg = " + alpha * coalesce(d, 0)" if edges else ""
        new_f = "f"
        parts.append(
            f"""is{t} AS (SELECT run_id, item_id, count(*) AS n, sum(u) AS s, sum(u * u) AS g,
  sum(u * (rating - mu - b_u)) AS c, sum(rating - mu - b_u) AS t
  FROM tr JOIN users{t} USING (run_id, user_id) JOIN means{p} USING (run_id) GROUP BY 1, 2),
half{t} AS (SELECT run_id, item_id, coalesce(v1, v) AS v, f, coalesce((t - s * v1) / (n + lbi + 1e-10), b_i) AS b_i FROM
  (SELECT *, (c - b_i * s{to_rhs}) / (g + CASE WHEN pop THEN lv / sqrt(n + 1.0) ELSE lv END + 1e-10{to_reg}) AS v1
   FROM items{p} JOIN runs USING (run_id) LEFT JOIN is{t} USING (run_id, item_id) {graph}))"""
        )
        if features:
            sums = ", ".join(
                f"sum(x_{f} * u * (rating - mu - b_u - b_i - u * (v + h.f - x_{f} * w_{f}))) "
                f"/ (sum(x_{f} * x_{f} * u * u) + any_value(lw_{f}) + 1e-10) AS w_{f}"
                for f in FEATURES
            )
            parts.append(
                f"""w{t} AS (SELECT run_id, {sums} FROM tr JOIN users{t} USING (run_id, user_id) JOIN half{t} h USING (run_id, item_id)
  JOIN means{p} USING (run_id) JOIN feats USING (item_id) JOIN w{p} USING (run_id) JOIN runs USING (run_id) GROUP BY 1),
items{t} AS (SELECT run_id, item_id, v, {' + '.join(f'x_{f} * w_{f}' for f in FEATURES)} AS f, b_i
  FROM half{t} JOIN feats USING (item_id) JOIN w{t} USING (run_id))"""
            )
        else:
            parts.append(f"items{t} AS (SELECT run_id, item_id, v, {new_f} AS f, b_i FROM half{t})")
        parts.append(
            f"""left{t} AS (SELECT run_id, rating - u * (v + f) - b_u - b_i AS e
  FROM tr JOIN users{t} USING (run_id, user_id) JOIN items{t} USING (run_id, item_id)),
means{t} AS (SELECT run_id, avg(e) AS mu, sqrt(avg(e * e) - avg(e) * avg(e)) AS rmse FROM left{t} GROUP BY 1)"""
        )
    return ",\n".join(parts)


def history_sql(iterations: int) -> str:
    return "history AS (" + " UNION ALL ".join(
        f"""SELECT run_id, {t} AS iter, mu, rmse AS train_rmse,
  (SELECT sqrt(sum(u * u)) FROM users{t} x WHERE x.run_id = m.run_id) AS u_norm,
  (SELECT sqrt(sum(v * v)) FROM items{t} x WHERE x.run_id = m.run_id) AS v_norm,
  (SELECT sqrt(sum(b_u * b_u)) FROM users{t} x WHERE x.run_id = m.run_id) AS bu_norm,
  (SELECT sqrt(sum(b_i * b_i)) FROM items{t} x WHERE x.run_id = m.run_id) AS bi_norm FROM means{t} m"""
        for t in range(1, iterations + 1)
    ) + ")"
