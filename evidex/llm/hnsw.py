"""A hierarchical navigable small-world graph in numpy, searched and built in batches.

Rows come in random order; layer ``l`` holds the first ``n / FAN ** l`` of them.  A row links
to ``OWN`` rows chosen so that none is nearer to another choice than to the row itself (then
the nearest ones left), and keeps the ``OWN`` nearest rows that link to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 16
OWN = 16
BATCH = 1_024
WIDTH = 4  # rows a beam expands at a time
TOGETHER = 32  # queries whose pairs are held at a time


def layer_sizes(n: int) -> list[int]:
    sizes = [n]
    while sizes[-1] > 4 * FAN:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


class Seen:
    """Which rows each query has met, and the pairs at or over a bound."""

    def __init__(self, queries: int, rows: int, bound: float):
        self.met, self.bound, self.pairs = np.zeros((queries, rows), bool), bound, []

    def of(self, start: int, stop: int) -> Seen:
        """What the queries from ``start`` to ``stop`` have met, numbered from 0."""
        own = Seen(0, 0, self.bound)
        own.met = self.met[start:stop]
        own.pairs = [p[:, here] - np.array([[start], [0]]) for p in self.pairs if (here := (p[0] >= start) & (p[0] < stop)).any()]
        return own

    def note(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        over = np.flatnonzero(score >= self.bound)
        if len(over):
            self.pairs.append(np.stack([query[over], row[over]]))


def beam(rows: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, seen: Seen) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` nearest rows found for every query, best first; -1 where there are fewer."""
    q = len(queries)
    ids, scores = np.full((q, ef), -1, np.int64), np.full((q, ef), -np.inf, np.float32)
    fresh = np.zeros((q, ef), bool)
    entry = entry[:, :ef]
    e = entry.shape[1]
    here = entry >= 0
    ids[:, :e] = entry
    scores[:, :e] = np.where(here, np.einsum("qd,qed->qe", queries, rows[entry]), -np.inf)
    fresh[:, :e] = here
    at, col = np.nonzero(here)
    seen.met[at, entry[at, col]] = True
    seen.note(at, entry[at, col], scores[at, col])
    active = np.arange(q)
    while len(active):
        waiting = np.where(fresh[active], scores[active], -np.inf)
        k = min(WIDTH, ef)
        pick = np.argpartition(-waiting, k - 1, axis=1)[:, :k] if k < ef else np.tile(np.arange(ef), (len(active), 1))
        usable = np.take_along_axis(waiting, pick, 1) > -np.inf
        some = usable.any(1)
        active, pick, usable = active[some], pick[some], usable[some]
        if not len(active):
            break
        chosen = ids[active[:, None], pick]
        fresh[active[:, None], pick] = False
        near = np.where(usable[:, :, None], links[chosen], -1).reshape(len(active), -1)
        near.sort(axis=1)
        new = near >= 0
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        new &= ~seen.met[active[:, None], near]
        at, col = np.nonzero(new)
        row, query = near[at, col], active[at]
        seen.met[query, row] = True
        score = np.einsum("pd,pd->p", queries[query], rows[row])
        seen.note(query, row, score)
        both = np.full((len(active), ef + near.shape[1]), -np.inf, np.float32)
        both[:, :ef] = scores[active]
        both[at, ef + col] = score
        names = np.concatenate([ids[active], near], 1)
        open_ = np.concatenate([fresh[active], new], 1)
        best = np.argpartition(-both, ef - 1, axis=1)[:, :ef]
        ids[active], scores[active] = np.take_along_axis(names, best, 1), np.take_along_axis(both, best, 1)
        fresh[active] = np.take_along_axis(open_, best, 1)
    order = np.argsort(-scores, axis=1, kind="stable")
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    return np.where(scores > -np.inf, ids, -1), scores


def descend(rows: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, down_to: int) -> np.ndarray:
    """Entry rows for layer ``down_to``, from searches of the layers above it."""
    entry = np.zeros((len(queries), 1), np.int64)
    for links in reversed(layers[down_to + 1 :]):
        entry = beam(rows, links, queries, entry, 4, Seen(len(queries), len(links), np.inf))[0]
    return entry


def _choose(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """``OWN`` of the candidates of each row (best first): spread out ones, then the nearest left."""
    picked = rows[np.maximum(ids, 0)]
    between = picked @ picked.transpose(0, 2, 1)
    taken = np.zeros(ids.shape, bool)
    count = np.zeros(len(ids), np.int64)
    for j in range(ids.shape[1]):
        hidden = ((between[:, j, :] > scores[:, j, None]) & taken).any(1)
        ok = ~hidden & (ids[:, j] >= 0) & (count < OWN)
        taken[ok, j] = True
        count += ok
    order = np.argsort(np.where(taken, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :OWN]
    out = np.full((len(ids), OWN), -1, np.int64)
    out[:, : order.shape[1]] = np.take_along_axis(ids, order, 1)
    return out


def _link_back(rows: np.ndarray, links: np.ndarray, start: int, stop: int) -> None:
    """The targets of the links of rows ``start`` to ``stop`` keep the nearest that link to them."""
    source = np.repeat(np.arange(start, stop), OWN)
    target = links[start:stop, :OWN].ravel()
    source, target = source[target >= 0], target[target >= 0]
    old = np.unique(target)
    held = links[old, OWN:]
    at, col = np.nonzero(held >= 0)
    source, target = np.concatenate([source, held[at, col]]), np.concatenate([target, old[at]])
    score = np.einsum("pd,pd->p", rows[source], rows[target])
    order = np.lexsort((-score, target))
    source, target = source[order], target[order]
    first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, np.int64)
    rank = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
    keep = rank < OWN
    links[old, OWN:] = -1
    links[target[keep], OWN + rank[keep]] = source[keep]


def build(rows: np.ndarray, ef: int = 48) -> list[np.ndarray]:
    """The links of every layer, the largest layer first; ``rows`` are unit vectors."""
    sizes = layer_sizes(len(rows))
    layers: list[np.ndarray] = [np.zeros((0, 2 * OWN), np.int64)] * len(sizes)
    for level in range(len(sizes) - 1, -1, -1):
        n = sizes[level]
        links = np.full((n, 2 * OWN), -1, np.int64)
        start = 0
        while start < n:
            stop = min(n, start + min(BATCH, max(256, start)))
            batch = rows[start:stop]
            inner = batch @ batch.T
            np.fill_diagonal(inner, -np.inf)
            k = min(OWN, stop - start)
            near = np.argpartition(-inner, k - 1, axis=1)[:, :k]
            ids, scores = near + start, np.take_along_axis(inner, near, 1)
            ids = np.where(scores > -np.inf, ids, -1)
            if start:
                entry = descend(rows, layers, batch, level)
                entry = np.where(entry < start, entry, -1)
                entry[(entry < 0).all(1), 0] = 0
                found, far = beam(rows, links[:start], batch, entry, ef, Seen(len(batch), start, np.inf))
                ids, scores = np.concatenate([ids, found], 1), np.concatenate([scores, far], 1)
            order = np.argsort(-scores, axis=1, kind="stable")
            links[start:stop, :OWN] = _choose(rows, np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1))
            _link_back(rows, links, start, stop)
            start = stop
        layers[level] = links
    return layers


def flood(rows: np.ndarray, links: np.ndarray, queries: np.ndarray, seen: Seen, step: int = 1 << 15) -> None:
    """From every pair over the bound on to its links, until no new pair is found."""
    done = 0
    while done < len(seen.pairs):
        query, row = seen.pairs[done]
        done += 1
        for at in range(0, len(query), step):
            q = np.repeat(query[at : at + step], links.shape[1])
            r = links[row[at : at + step]].ravel()
            new = (r >= 0) & ~seen.met[q, r]
            key = np.unique(q[new] * len(rows) + r[new])
            q, r = key // len(rows), key % len(rows)
            seen.met[q, r] = True
            seen.note(q, r, np.einsum("pd,pd->p", queries[q], rows[r]))


def each_over(rows: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, bound: float, ef: int, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) of the pairs found at or over ``bound``, those of ``TOGETHER`` queries at a time."""
    for start in range(0, len(queries), block):
        some = queries[start : start + block]
        seen = Seen(len(some), len(rows), bound)
        beam(rows, layers[0], some, descend(rows, layers, some, 0), ef, seen)
        for at in range(0, len(some), TOGETHER):
            own = seen.of(at, at + TOGETHER)
            if own.pairs:
                flood(rows, layers[0], some[at : at + TOGETHER], own)
                query, row = np.concatenate(own.pairs, 1)
                yield query + (start + at), row


def pairs_over(rows: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, bound: float, ef: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the pairs found at or over ``bound``."""
    both = np.concatenate([np.zeros((2, 0), np.int64), *map(np.stack, each_over(rows, layers, queries, bound, ef, block))], 1)
    return both[0], both[1]
