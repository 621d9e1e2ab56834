"""State of a fit between iterations, so that a restarted driver goes on where it stopped.

An iteration's folder holds the state tables and, written last, a manifest with what only the driver knows.
A folder without the manifest's success marker does not count. Runs that are done
lie in folders of their own, written once. After a save the folder of the iteration before goes.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession


@dataclass
class SavedState:
    iteration: int
    users: DataFrame
    items: DataFrame
    done_users: list[DataFrame]
    done_items: list[DataFrame]
    active: list[int]
    mu: dict[int, float]
    weights: dict[int, np.ndarray]
    curves: dict[int, list[float]]
    history: list[tuple]
    seconds: dict[int, float]


def fit_key(data, runs: list) -> str:
    """What a fit depends on besides the ratings themselves: settings, counts and sums by fold, feature widths."""
    sums = sorted((str(fold), n, total) for fold, (n, total) in data.fold_sums.items())
    return json.dumps([[asdict(run) for run in runs], [s[:2] for s in sums], [round(s[2], 6) for s in sums], data.slices], sort_keys=True)


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Folders of iterations whose manifest stands, in order."""
    place, system = _files(spark, f"{path}/iter=*/manifest/_SUCCESS")
    return sorted(str(f.getPath().getParent().getParent()) for f in system.globStatus(place) or [])


def save_state(path: str, key: str, iteration: int, users: DataFrame, items: DataFrame, done: tuple[DataFrame, DataFrame] | None,
               active: list[int], mu: dict, weights: dict, curves: dict, history: list, seconds: dict) -> None:
    """Write the state after ``iteration``; ``done`` are the tables of runs that ended with it."""
    spark = users.sparkSession
    folder, before = f"{path}/iter={iteration:05d}", _manifests(spark, path)
    users.write.mode("overwrite").parquet(f"{folder}/users")
    items.write.mode("overwrite").parquet(f"{folder}/items")
    ended = json.loads(_body(spark, before[-1]))["ended"] if before else []
    if done is not None:
        for name, table in zip(("users", "items"), done):
            table.write.mode("overwrite").parquet(f"{path}/done={iteration:05d}/{name}")
        ended = [*ended, iteration]
    body = json.dumps({
        "key": key, "iteration": iteration, "ended": ended, "active": active, "mu": mu, "curves": curves, "history": history, "seconds": seconds,
        "weights": {run: w.tolist() for run, w in weights.items()}})
    spark.createDataFrame([(body,)], "body string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    for old in before:
        if not old.endswith(f"iter={iteration:05d}"):
            place, system = _files(spark, old)
            system.delete(place, True)


def _body(spark: SparkSession, folder: str) -> str:
    return spark.read.schema("body string").parquet(f"{folder}/manifest").first().body


def load_state(spark: SparkSession, path: str, key: str) -> SavedState | None:
    """The last saved state; an error if it is that of another fit."""
    folders = _manifests(spark, path)
    if not folders:
        return None
    meta = json.loads(_body(spark, folders[-1]))
    if meta["key"] != key:
        raise ValueError(f"{path} holds the state of another fit")
    numbers = lambda values: {int(run): v for run, v in values.items()}
    done = [f"{path}/done={i:05d}" for i in meta["ended"]]
    read = lambda place: spark.read.parquet(place)
    return SavedState(
        meta["iteration"], read(f"{folders[-1]}/users"), read(f"{folders[-1]}/items"), [read(f"{d}/users") for d in done],
        [read(f"{d}/items") for d in done], meta["active"], numbers(meta["mu"]), {r: np.array(w) for r, w in numbers(meta["weights"]).items()},
        numbers(meta["curves"]), [tuple(h) for h in meta["history"]], numbers(meta["seconds"]))
