"""The best k hits per query kept inside one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Scores are compared at this many decimals: equal vectors then tie whatever the order in
# which a matrix product happened to add their terms up.
DECIMALS = 12
_SLACK = 2 * 10.0**-DECIMALS
_SCORES_AT_ONCE = 1 << 21


class BestHits:
    """Keeps, per query, the k hits that come first by (score desc, doc id asc).

    Ties are settled by id here, so a task never emits more than k rows per query however
    many copies of a document it meets, and the global ranking stays exact.
    """

    def __init__(self, n_queries: int, k: int):
        self.k = k
        # The k-th hit of each query so far; -inf and no id while there are fewer.
        self.kth = np.full(n_queries, -np.inf)
        self.kth_id: pa.Array | None = None
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.pending = 0
        self.limit = max(1 << 16, 4 * n_queries * k)

    def offer(self, scores: np.ndarray, rows: np.ndarray, ids: pa.Array) -> None:
        """``scores[i, j]`` is the score of document ``ids[j]`` for query ``rows[i]``."""
        n = scores.shape[1]
        cut = self.kth[rows] - _SLACK
        fresh = np.isneginf(cut)
        if n > self.k and fresh.any():
            cut[fresh] = np.partition(scores[fresh], n - self.k, axis=1)[:, n - self.k] - _SLACK
        at, d = np.nonzero(scores >= cut[:, None])
        q, score = rows[at], np.round(scores[at, d], DECIMALS)
        if self.kth_id is not None:
            ahead = score > self.kth[q]
            # Copies of a document tie again and again; only a lower id can still enter.
            tie = np.flatnonzero(score == self.kth[q])
            if len(tie):
                lower = pc.less(ids.take(pa.array(d[tie])), self.kth_id.take(pa.array(q[tie])))
                ahead[tie[pc.fill_null(lower, False).to_numpy(zero_copy_only=False)]] = True
            q, score, d = q[ahead], score[ahead], d[ahead]
        if len(q) == 0:
            return
        self.parts.append((q, score, ids.take(pa.array(d))))
        self.pending += len(q)
        if self.pending > self.limit:
            self._trim()

    def _trim(self) -> None:
        if not self.parts:
            return
        table = pa.table({
            "q": np.concatenate([p[0] for p in self.parts]),
            "score": np.concatenate([p[1] for p in self.parts]),
            "id": pa.chunked_array([p[2] for p in self.parts]),
        }).sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
        q = table["q"].to_numpy()
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        table = table.filter(pa.array(place < self.k)).combine_chunks()
        place = place[place < self.k]
        q, score, ids = table["q"].to_numpy(), table["score"].to_numpy(), table["id"].combine_chunks()
        last = np.flatnonzero(place == self.k - 1)
        self.kth[q[last]] = score[last]
        where = np.full(len(self.kth), -1)
        where[q[last]] = last
        self.kth_id = ids.take(pa.array(where, mask=where < 0))
        self.parts = [(q, score, ids)]
        self.pending = len(q)

    def settle(self) -> None:
        """Hold at most k hits per query from here on."""
        self._trim()

    def hits(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        self._trim()
        return self.parts[0] if self.parts else None


def offer_all(bests: list[BestHits], queries: np.ndarray, rows: np.ndarray, docs: np.ndarray, ids: pa.Array) -> None:
    """Score a block of documents, in pieces of bounded size, and offer it to each of ``bests``."""
    step = max(1, _SCORES_AT_ONCE // max(1, len(rows)))
    for at in range(0, len(docs), step):
        scores = queries @ docs[at:at + step].T
        for best in bests:
            best.offer(scores, rows, ids.slice(at, step))
