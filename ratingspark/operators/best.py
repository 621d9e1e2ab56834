"""The best few scores of each of many rows, as NumPy arrays inside a task."""

from __future__ import annotations

import numpy as np

RANK_DIGITS = 9  # scores equal to this many digits count as tied; ties go to the smaller id


class BestLists:
    """``n`` best (score, id) for each row; ``floor`` is what the next one has to reach."""

    def __init__(self, floor: np.ndarray, n: int):
        self.n, self.floor = n, floor.copy()
        self.scores = np.full((len(floor), n), -np.inf)
        self.ids = np.full((len(floor), n), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge candidates; those below the floor of their row are left out."""
        good = np.round(scores, RANK_DIGITS) >= self.floor[rows]
        rows, ids, scores = rows[good], ids[good], scores[good]
        touched = np.unique(rows)
        if not len(touched):
            return
        rows = np.concatenate([np.repeat(touched, self.n), rows])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((ids, -np.round(scores, RANK_DIGITS), rows))
        pick = order[np.searchsorted(rows[order], touched)[:, None] + np.arange(self.n)]
        self.scores[touched], self.ids[touched] = scores[pick], ids[pick]
        self.floor[touched] = np.maximum(self.floor[touched], np.round(self.scores[touched, -1], RANK_DIGITS))
