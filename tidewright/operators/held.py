"""The k best of each of a block of queries, from matrices of scores: what a task keeps while entries pass by.

Only scores that reach a query's k-th so far are looked at, so memory is k rows a query and a
task returns as many, however many entries it has seen."""

from __future__ import annotations

import numpy as np

#: Queries of a block: one matrix of scores is so many by the entries of a bucket or batch.
BLOCK = 256


class Held:
    """Scores are rounded, of equals the smallest id comes first. Scores under `least`, and those that are no numbers, don't count."""

    def __init__(self, queries: int, k: int, digits: int, least: float = -np.inf) -> None:
        self.k, self.digits, self.least = k, digits, least
        self.q, self.s, self.ids = np.zeros(0, np.int64), np.zeros(0), None
        self.floor = np.full(queries, -np.inf)  # the k-th score, once there is one

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: queries by entries; ids ascend."""
        slack, many = 10.0**-self.digits, 4 * self.k + 64
        bound = np.maximum(self.floor - slack, self.least)
        mask = scores >= bound[:, None]
        crowded = np.flatnonzero(np.count_nonzero(mask, axis=1) > many)
        if len(crowded):
            some = scores[crowded]
            some[np.isnan(some)] = -np.inf
            at = some.shape[1] - self.k
            bound[crowded] = np.maximum(bound[crowded], np.partition(some, at, axis=1)[:, at] - slack)
            mask[crowded] = some >= bound[crowded, None]
            for i in np.flatnonzero(np.count_nonzero(mask[crowded], axis=1) > many).tolist():  # equals
                mask[crowded[i]] = False
                mask[crowded[i], np.argsort(-np.round(some[i], self.digits), kind="stable")[: self.k]] = True
        q, e = np.nonzero(mask)
        if not len(q):
            return
        s, i = np.round(scores[q, e], self.digits), ids[e]
        if self.ids is not None:
            q, s, i = np.concatenate((self.q, q)), np.concatenate((self.s, s)), np.concatenate((self.ids, i))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.floor[q[last]] = s[last]
        keep = place < self.k
        self.q, self.s, self.ids = q[keep], s[keep], i[keep]
