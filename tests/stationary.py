"""Checks a step of the fit by its conditions: each update must zero the gradient of its ridge objective."""

from __future__ import annotations

import numpy as np

EPS = 1e-10


def grouped(index, values, size):
    """Sums of ``values`` by ``index``."""
    out = np.zeros((size, *values.shape[1:]))
    np.add.at(out, index, values)
    return out


def gradients(before, after, rows, cfg, features, graph=None):
    """Largest gradient of each update from state ``before`` to ``after``.

    A state is a dict of u, v, bu, bi, mu and w (by feature). ``rows`` are arrays
    of user, item and rating. Users and items without a rating must not move.
    """
    user, item, rating = rows
    n_users, n_items = len(before["u"]), len(before["v"])
    seen_user, seen_item = np.bincount(user, minlength=n_users), np.bincount(item, minlength=n_items)
    shown = before["v"] + sum(features[f] @ w for f, w in before["w"].items()) if before["w"] else before["v"]
    slack = {}

    target = rating - before["mu"] - before["bi"][item]
    fitted = (shown[item] * after["u"][user]).sum(1)
    pull = grouped(user, shown[item] * (fitted + before["bu"][user] - target)[:, None], n_users)
    slack["u"] = pull + (cfg.lambda_u + EPS) * after["u"]
    slack["bu"] = grouped(user, fitted - target, n_users) + (seen_user + cfg.user_bias_penalty + EPS) * after["bu"]

    target = rating - before["mu"] - after["bu"][user]
    fitted = (after["u"][user] * after["v"][item]).sum(1)
    penalty = cfg.lambda_v / (np.sqrt(seen_item + 1.0) if cfg.pop_reg_mode else 1.0) + EPS
    pull = grouped(item, after["u"][user] * (fitted + before["bi"][item] - target)[:, None], n_items)
    slack["v"] = pull + np.broadcast_to(penalty, n_items)[:, None] * after["v"]
    if graph is not None:
        slack["v"] += cfg.alpha * (graph.sum(1)[:, None] * after["v"] - graph @ before["v"])
    slack["bi"] = grouped(item, fitted - target, n_items) + (seen_item + cfg.item_bias_penalty + EPS) * after["bi"]

    for name, x in features.items() if before["w"] else ():
        others = sum(((x2 @ before["w"][f])[item] for f, x2 in features.items() if f != name), np.zeros((len(user), cfg.n_factors)))
        point = after["v"][item] + others + (x @ after["w"][name])[item]
        miss = (after["u"][user] * point).sum(1) + before["mu"] + after["bu"][user] + after["bi"][item] - rating
        slack[f"w {name}"] = x[item].T @ (after["u"][user] * miss[:, None]) + (cfg.lambda_w.get(name, 0.0) + EPS) * after["w"][name]

    total = after["v"] + sum((features[f] @ w for f, w in after["w"].items()), np.zeros_like(after["v"]))
    slack["mu"] = np.array([np.mean(rating - (after["u"][user] * total[item]).sum(1) - after["bu"][user] - after["bi"][item]) - after["mu"]])
    for key, seen in (("u", seen_user), ("v", seen_item), ("bu", seen_user), ("bi", seen_item)):
        slack[key] = np.where((seen > 0).reshape(-1, *[1] * (after[key].ndim - 1)), slack[key], after[key] - before[key])
    return {key: float(np.abs(value).max()) for key, value in slack.items()}
