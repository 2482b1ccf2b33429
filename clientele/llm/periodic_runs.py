"""Periodic runs of the words of texts.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are the same) of at least ``max(least, 2 q)`` words that no neighbouring
word extends.

* **LCE by a difference cover.** How far the words from two places agree is
  answered from a sample: only the suffixes that start at places of a difference
  cover modulo 31 (6 residues such that any two places reach two sampled ones at
  the same distance, below 31) are sorted, by the names of their blocks of 31
  words, doubling the number of blocks. A query compares few words up to the
  synchronised samples, then takes the minimum of the neighbours' common blocks
  between their ranks from a sparse table, then the words of the first different
  block. A second table over the words in reverse answers backwards.
* **Harmonic grid.** A run has ``max(least - q, q)`` words in a row that equal the
  word ``q`` later, so it meets a grid of that step. For every ``q`` the pairs
  ``(i, i + q)`` of that grid are extended both ways; their number is that of the
  words times a logarithm. A stretch found for several periods has the smallest.

Texts are worked on in chunks of some megabytes, put after each other with
separators that differ from everything; a text of any length is one piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import mix64, text_chunks

#: A perfect difference cover, every residue modulo V is the difference of two of its members.
V, COVER = 31, (1, 5, 11, 24, 25, 27)
CHUNK = 4_000_000  # characters worked on at once
PAIRS = 2_000_000  # pairs of the grid held at once
SHORT = 1 << 15  # texts up to so many words share one list of grid pairs

_PLACE = np.full(V, -1, np.int64)
_PLACE[list(COVER)] = range(len(COVER))
#: Words from places of residues a, b to the next two sampled ones.
_WAY = np.array([[next(k for k in range(V) if _PLACE[(a + k) % V] >= 0 and _PLACE[(b + k) % V] >= 0) for b in range(V)] for a in range(V)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Lce:
    """Longest common extensions of places of an array of ids whose last one stands nowhere else."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        filled = -(-n // V) * V + V
        self.ids = np.concatenate([ids, np.arange(filled + V - n) + ids.max() + 1])  # places behind the end are all different
        starts = np.arange(0, filled, V)
        self.at = (starts[:, None] + np.array(COVER)).ravel()
        self._sort(self._names())

    def _names(self) -> np.ndarray:
        """A number for the block of V words at each sampled place, the same for the same words."""
        ids = self.ids.astype(np.uint64)
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(ids) - 1, _BASE, np.uint64)]))
        back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(ids) - 1, _INVERSE, np.uint64)]))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(ids + np.uint64(1)) * power)])
        width = np.minimum(self.at + V, len(ids))
        hashes = mix64((total[width] - total[self.at]) * back[self.at])
        order = np.argsort(hashes, kind="stable")
        same = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
        # equal hashes are compared word by word, so a collision cannot change a result
        left, right = self.at[order[same]], self.at[order[same + 1]]
        for k in range(V):
            if (self.ids[left + k] != self.ids[right + k]).any():
                blocks = np.ascontiguousarray(self.ids[self.at[:, None] + np.arange(V)]).view(np.dtype((np.void, V * 8))).ravel()
                return np.unique(blocks, return_inverse=True)[1].ravel()
        return np.unique(hashes, return_inverse=True)[1].ravel()

    def _sort(self, names: np.ndarray) -> None:
        """Ranks of the sampled suffixes as sequences of block names, and the blocks neighbours share."""
        count, step = len(names), len(COVER)
        order = np.argsort(names, kind="stable")
        first = np.concatenate([[True], names[order][1:] != names[order][:-1]])
        rank = np.empty(count, np.int64)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(count), 0))
        levels = [rank]
        while True:  # each turn doubles the blocks compared; only suffixes still alike take part
            sizes = np.bincount(rank, minlength=count)
            tied = np.flatnonzero(sizes[rank] > 1)
            if not len(tied):
                break
            later = tied + step * (1 << (len(levels) - 1))
            key = rank[tied] * (count + 1) + np.where(later < count, rank[np.minimum(later, count - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            key, old = key[order], rank[tied][order]
            spot = np.arange(len(key))
            group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), spot, 0))
            part = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), spot, 0))
            rank = rank.copy()
            rank[tied[order]] = old + part - group
            levels.append(rank)
        self.rank = rank
        by_rank = np.empty(count, np.int64)
        by_rank[rank] = np.arange(count)
        a, b, shared = by_rank[:-1].copy(), by_rank[1:].copy(), np.zeros(max(count - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < count) & (b < count)
            alike = inside.copy()
            alike[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            shared += alike * (1 << k)
            a, b = a + alike * step * (1 << k), b + alike * step * (1 << k)
        self.table = [shared.astype(np.int32)]
        while 2 << (len(self.table) - 1) <= len(shared):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _blocks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Blocks shared by the sampled suffixes number a and b (a != b)."""
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out

    def _compare(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words alike from a and b on, up to ``most``."""
        out, open_ = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        while len(open_):
            k = out[open_]
            open_ = open_[self.ids[a[open_] + k] == self.ids[b[open_] + k]]
            out[open_] += 1
            open_ = open_[out[open_] < most[open_]]
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words alike from places a and b (a != b) on."""
        way = _WAY[a % V, b % V]
        out = self._compare(a, b, way)
        far = np.flatnonzero(out == way)
        if len(far):
            x, y = a[far] + way[far], b[far] + way[far]
            step = len(COVER)
            more = V * self._blocks(x // V * step + _PLACE[x % V], y // V * step + _PLACE[y % V])
            out[far] += more + self._compare(x + more, y + more, np.full(len(far), V))
        return out


def _grid(n: int, least: int, periods: range) -> tuple[np.ndarray, np.ndarray]:
    """Places i and periods q of the grid over n words."""
    q = np.arange(periods.start, periods.stop)
    step = np.maximum(q, least - q)
    size = np.maximum(-(-(n - q) // step), 0)
    q, step = np.repeat(q, size), np.repeat(step, size)
    return (np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)) * step, q


def _grids(lengths: np.ndarray, least: int, shared: dict):
    """Grid pairs of all texts, at most about PAIRS at once: numbers of the texts, places in them, periods."""
    short = np.flatnonzero((lengths >= least) & (lengths <= SHORT))
    if len(short):
        top = 1 << int(lengths[short].max() - 1).bit_length()
        if top not in shared:
            i, q = _grid(top, least, range(1, top // 2 + 1))
            order = np.argsort(i + q, kind="stable")  # the pairs inside n words come first
            shared.clear()
            shared[top] = i[order], q[order], np.searchsorted((i + q)[order], np.arange(top + 1))
        i, q, inside = shared[top]
        size = inside[lengths[short]]
        total, cut = np.cumsum(size), 0
        while cut < len(short):
            end = max(cut + 1, int(np.searchsorted(total, total[cut] - size[cut] + PAIRS)))
            part = size[cut:end]
            pick = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
            yield np.repeat(short[cut:end], part), i[pick], q[pick]
            cut = end
    for d in np.flatnonzero(lengths > SHORT).tolist():
        n, low = int(lengths[d]), 1
        while low <= n // 2:
            high = low
            held = 0
            while high <= n // 2 and held < PAIRS:
                held += n // max(high, least - high) + 1
                high += 1
            i, q = _grid(n, least, range(low, high))
            yield np.full(len(i), d), i, q
            low = high


def runs_of(texts: list[np.ndarray], least: int, shared: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of arrays of word ids: number of the text, start, length, period, sorted by text, start and period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    top = 1 + max((int(t.max()) for t in texts if len(t)), default=0)
    pieces = [np.array([top])]
    for k, t in enumerate(texts):
        pieces += [t, np.array([top + 1 + k])]
    ids = np.concatenate(pieces).astype(np.int64)
    base = 1 + np.cumsum(lengths + 1) - (lengths + 1)
    ahead = back = None
    found = []
    for d, i, q in _grids(lengths, least, {} if shared is None else shared):
        x = base[d] + i
        y = x + q
        # the words at the grid's places, and those on one side of them at least, are alike inside a run
        keep = np.flatnonzero(ids[x] == ids[y])
        x, y = x[keep], y[keep]
        next_to = (ids[x + 1] == ids[y + 1]) | (ids[x - 1] == ids[y - 1])
        x, y, d, q = x[next_to], y[next_to], d[keep][next_to], q[keep][next_to]
        if not len(x):
            continue
        if ahead is None:
            ahead, back = Lce(ids), Lce(ids[::-1].copy())
        right = ahead(x, y)
        left = back(len(ids) - x, len(ids) - y)
        ok = left + right >= np.maximum(least - q, q)
        found.append(np.stack([d[ok], (x - left - base[d])[ok], (left + right + q)[ok], q[ok]]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    d, start, length, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, length, start, d))
    d, start, length, q = d[order], start[order], length[order], q[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])])[:len(d)]
    d, start, length, q = d[new], start[new], length[new], q[new]
    order = np.lexsort((q, start, d))
    return d[order], start[order], length[order], q[order]


class _Ids(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(least: int, rewrite):
    def run(batches):
        shared = {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            keys = ids.to_pylist()
            for group in text_chunks(texts, CHUNK):
                words = [t.encode().split() for _, t in group]  # bytes are split at ASCII white space
                known = _Ids()
                numbers = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in words]
                for k, (row, _) in enumerate(group):
                    change = rewrite(keys[row], len(words[k])) if rewrite and words[k] else None
                    if change:
                        a, p = change
                        place = np.arange(len(words[k]))
                        place[a:] = a + (place[a:] - a) % p
                        words[k], numbers[k] = [words[k][j] for j in place.tolist()], numbers[k][place]
                d, start, length, period = runs_of(numbers, least, shared)
                cuts = np.searchsorted(d, np.arange(len(group) + 1))
                runs, kept = [], []
                for k, w in enumerate(words):
                    a, z = cuts[k], cuts[k + 1]
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in
                                 zip(start[a:z].tolist(), length[a:z].tolist(), period[a:z].tolist())])
                    if a < z:
                        edge = np.zeros(len(w) + 1, np.int64)
                        np.add.at(edge, start[a:z] + period[a:z], 1)
                        np.add.at(edge, start[a:z] + length[a:z], -1)
                        w = [w[j] for j in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                    kept.append(b" ".join(w).decode())
                rows = ids.take(pa.array([row for row, _ in group]))
                yield pa.RecordBatch.from_arrays([rows, pa.array([len(x) for x in numbers], pa.int64()), pa.array(runs, RUN), pa.array(kept, pa.string())],
                                                 names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def find_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text", rewrite=None) -> DataFrame:
    """Per row ``doc_id, n_words, runs, collapsed``: the runs (``start``, ``length`` and ``period`` in words, by start,
    then period) and the text without the repetitions, its words joined by one space: a word goes if a run has it
    behind the run's first period.

    Words are the parts between ASCII white space. ``rewrite(id, n)`` may return a place ``a`` and length ``p``
    for a text of ``n`` words: from word ``a`` on, its ``p`` words are repeated to the end first.
    Defined cases: null, empty and blank texts have no words, no runs and the collapsed text ''; rows are judged one
    by one, so repeated rows and null ids give a result each; no rows give none; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_find(least, rewrite), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def longest(runs: Column) -> Column:
    """The run of greatest length (ties: smallest start, then period) of a column of runs; null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["q"]).alias("period")))
