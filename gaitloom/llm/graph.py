"""A robust-pruned directed proximity graph over unit vectors, built and searched in numpy.

Points enter in rounds of doubling size, each round in blocks of points that lie close together. A greedy beam search of
the graph so far proposes the neighbours of every point of a block, block mates add theirs, relaxed distance pruning keeps
a diverse few, and reverse edges are added, pruned again where a list overflows.

The queries of a block walk together: whatever one of them expands is scored for all of them by one matrix product, and
each keeps a beam of its own. A block ends when every point in any of its beams has been expanded, so each query has seen
at least what it would have seen alone.
"""

from __future__ import annotations

import numpy as np


def blocks(x: np.ndarray, size: int, seed: int = 4) -> list[np.ndarray]:
    """Places of the rows in groups of at most ``size`` that lie close together (median cuts between two rows)."""
    random, done, todo = np.random.default_rng(seed), [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            if len(own):
                done.append(own)
            continue
        a, b = random.choice(len(own), 2, replace=False)
        side = x[own] @ (x[own[a]] - x[own[b]])
        half = len(own) // 2
        order = np.argpartition(side, half)
        todo += [own[order[:half]], own[order[half:]]]
    return done


class Graph:
    """Rows of ``x`` must have unit length. ``degree`` bounds out-edges after pruning, ``slack`` the edges before."""

    def __init__(self, x: np.ndarray, *, degree: int = 24, slack: int = 24, beam: int = 16, relax: float = 1.1, block: int = 128, mates: int = 8, expand: int = 4):
        self.n, self.degree, self.width, self.block = len(x), degree, degree + slack, block
        self.relax2, self.expand = np.float32(relax * relax), expand
        self.x = np.vstack([x, np.zeros((1, x.shape[1]), np.float32)]).astype(np.float32)
        self.edges = np.full((self.n + 1, self.width), self.n, np.int32)
        self.fill = np.zeros(self.n + 1, np.int32)
        self.entry = int(np.argmax(x @ x.mean(0))) if self.n else 0
        order = np.random.default_rng(4).permutation(self.n)
        if self.n:
            order = np.concatenate(([self.entry], order[order != self.entry]))
        done = 0
        while done < self.n:
            more = order[done : done + max(block, done)]
            for own in blocks(self.x[more], block, done):
                self._enter(more[own], done > 0, beam, mates)
            done += len(more)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the beam of every query, best first; missing entries have id n and score -2."""
        ids = np.full((len(q), beam), self.n, np.int32)
        score = np.full((len(q), beam), -2, np.float32)
        for own in blocks(q, self.block):
            ids[own], score[own] = self._walk(q[own], beam)
        return ids, score

    def _walk(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        rows, n = np.arange(len(q))[:, None], self.n
        met, expanded, mark = (np.zeros(n + 1, bool) for _ in range(3))
        met[[n, self.entry]] = expanded[n] = True
        ids = np.full((len(q), beam), n, np.int32)
        score = np.full((len(q), beam), -2, np.float32)
        ids[:, 0], score[:, 0] = self.entry, q @ self.x[self.entry]
        while True:
            waiting = ~expanded[ids]
            if not waiting.any():
                return ids, score
            # the first few of every beam that wait, the beams being in order
            mark[ids[waiting & (np.cumsum(waiting, axis=1) <= self.expand)]] = True
            next_ = np.flatnonzero(mark)
            mark[next_], expanded[next_] = False, True
            mark[self.edges[next_].ravel()] = True
            mark[met] = False
            around = np.flatnonzero(mark)
            if not len(around):
                continue
            mark[around], met[around] = False, True
            value = q @ self.x[around].T
            useful = np.flatnonzero((value > score[:, -1:]).any(0))
            if not len(useful):
                continue
            every = np.concatenate([score, value[:, useful]], 1)
            best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            part = every[rows, best]
            order = np.argsort(-part, axis=1)
            best, score = best[rows, order], part[rows, order]
            fresh = np.broadcast_to(around[useful].astype(np.int32), (len(q), len(useful)))
            ids = np.concatenate([ids, fresh], 1)[rows, best]

    def _prune(self, p: np.ndarray, cand: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Relaxed distance pruning of candidate lists: kept ids (padded with n) and their number."""
        order = np.argsort(-score, axis=1, kind="stable")
        rows = np.arange(len(p))[:, None]
        cand, score = cand[rows, order], score[rows, order]
        points = self.x[cand]
        gap = self.relax2 * (2 - 2 * np.matmul(points, points.transpose(0, 2, 1)))
        own = 2 - 2 * score
        alive = score > -2
        alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        kept, count, line = np.full((len(p), most), self.n, np.int32), np.zeros(len(p), np.int32), np.arange(len(p))
        for k in range(most):
            first = alive.argmax(1)
            there = alive[line, first]
            if not there.any():
                break
            kept[there, k] = cand[line, first][there]
            count[there] = k + 1
            alive[line, first] = False
            alive &= ~(there[:, None] & (gap[line, first] <= own))
        return kept, count

    def _enter(self, p: np.ndarray, searched: bool, beam: int, mates: int) -> None:
        q = self.x[p]
        parts_i, parts_s = [], []
        if searched:
            i, s = self._walk(q, beam)
            parts_i.append(i)
            parts_s.append(s)
        if len(p) > 1:
            mutual = q @ q.T
            np.fill_diagonal(mutual, -2)
            m = min(mates, len(p) - 1)
            at = np.argpartition(-mutual, m - 1, axis=1)[:, :m]
            parts_i.append(p[at].astype(np.int32))
            parts_s.append(np.take_along_axis(mutual, at, 1))
        if not parts_i:
            return
        cand, score = np.concatenate(parts_i, 1), np.concatenate(parts_s, 1)
        kept, count = self._prune(p, cand, score, self.degree)
        self.edges[p, : self.degree] = kept
        self.fill[p] = count
        self._reverse(p, kept)

    def _reverse(self, p: np.ndarray, kept: np.ndarray) -> None:
        source, at = np.nonzero(kept < self.n)
        head, tail = kept[source, at], p[source].astype(np.int32)
        order = np.argsort(head, kind="stable")
        head, tail = head[order], tail[order]
        unique, start, number = np.unique(head, return_index=True, return_counts=True)
        place = np.arange(len(head)) - np.repeat(start, number)
        room = self.fill[head] + place
        fits = room < self.width
        self.edges[head[fits], room[fits]] = tail[fits]
        full = self.fill[unique] + number > self.width
        self.fill[unique] = np.minimum(self.fill[unique] + number, self.width)
        if full.any():
            over = unique[full]
            extra = int(number[full].max())
            more = np.full((len(over), extra), self.n, np.int32)
            row = np.cumsum(full) - 1
            mine = np.repeat(full, number)
            more[np.repeat(row, number)[mine], place[mine]] = tail[mine]
            cand = np.concatenate([self.edges[over, : self.width], more], 1)
            score = np.matmul(self.x[cand], self.x[over][:, :, None])[:, :, 0]
            score[cand == self.n] = -2
            keep, count = self._prune(over, cand, score, self.degree)
            self.edges[over, : self.degree], self.edges[over, self.degree :] = keep, self.n
            self.fill[over] = count
