"""many k-means models in one scan.

A sweep over k with several starts each is hundreds of models on the same rows.
Here they advance together: a Lloyd round is one pass over the rows, in which every
Arrow block meets the centroids of all models that still move (a matrix product per
k), and what leaves a task is, per k, one vector of sums: rows, squared norms and
feature sums of each centroid. Spark adds these vectors up; the driver sees the sums,
which are as large as the models. A model whose centroids' squared moves add up to no
more than ``tol`` times the mean variance of a feature makes one closing round with its
final centroids and leaves. The pass after the last round scores the best start of every
k (silhouette, Davies-Bouldin; the other figures follow from the sums).

Models are bounded: more than ``WAVE_NUMBERS`` centroid coordinates go in several
waves, one after the other, each in the same way.

Starts are k-means++ sequences over a bounded sample, the ``START_ROWS`` distinct
vectors of least hash: it does not depend on how rows are dealt, and repeated rows do
not crowd it. The first k members of a sequence start the model of that k. With fewer
distinct vectors than k a model has as many centroids as there are.

Rows of few features are stored by place, packed in blocks that are trees of cells. A cell meets only those centroids of
a model that may be nearest to one of its rows (exact: the others cannot) and that its own cell met; its sums go whole to a
centroid that is alone, and where two are left only their difference is looked at further down.

Rows without a vector take no part. Dense arrays, and ML vectors, dense or sparse, are
accepted; wide sparse vectors stay sparse in the products.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import Scratch
from .quality import as_array

START_ROWS = 4096
#: Centroid coordinates of a wave, and distances of a block.
WAVE_NUMBERS, BLOCK_NUMBERS = 1 << 24, 1 << 20
#: Up to this width sparse rows are written out.
DENSE_WIDTH = 256
#: Distances that stay in a core's cache; rows of a cell; centroids from which rows are stored in cells; levels of the stored cells.
PIECE_NUMBERS, CELL_ROWS, MANY_CENTROIDS, CELL_LEVELS = 1 << 17, 64, 512, 10
#: Rows and coordinates of a packed block; halvings from one level of its cells to the next.
PACK_ROWS, PACK_NUMBERS, HALVINGS = 1 << 14, 1 << 17, 2
#: Squared norms from which distances may not be numbers: no cells there.
LARGE = 1e300


# ---- blocks of rows ---------------------------------------------------------------------------------------------------

class Block:
    """Some rows as a matrix: dense, or by the places and values of what is not 0. ``levels``: of rows in the order of a tree
    of cells, where the cells of each level start."""

    levels: list[np.ndarray] | None = None

    def __init__(self, start: np.ndarray, place: np.ndarray, value: np.ndarray, width: int):
        self.n, self.width = len(start) - 1, width
        self.start, self.place, self.value = start, place, value
        self.dense = None
        if width <= DENSE_WIDTH or len(value) == self.n * width:
            self.dense = np.zeros((self.n, width))
            self.dense[np.repeat(np.arange(self.n), np.diff(start)), place] = value
        self.squares = np.add.reduceat(np.append(value * value, 0.0), start[:-1]) * (np.diff(start) > 0) if self.n else np.zeros(0)

    def rows(self, which) -> "Block":
        """Some rows of a dense block."""
        part = object.__new__(Block)
        part.width, part.dense, part.squares = self.width, self.dense[which], self.squares[which]
        part.n = len(part.dense)
        return part

    @classmethod
    def of(cls, dense: np.ndarray, levels: list[np.ndarray]) -> "Block":
        """A block of rows that lie in the order of their cells."""
        x = object.__new__(cls)
        x.n, x.width, x.dense, x.squares, x.levels = len(dense), dense.shape[1], dense, (dense * dense).sum(1), levels
        return x

    def placed(self) -> "Block":
        """The rows of a dense block in the order of their cells."""
        if self.levels is not None:
            return self
        depth: list[int] = []
        cells = _cells(self.dense, CELL_ROWS, depth)
        starts, depths = np.cumsum([0, *map(len, cells[:-1])]), np.array(depth)
        levels = [starts[depths <= d] for d in range(0, depths.max() + HALVINGS, HALVINGS)]
        return Block.of(self.dense[np.concatenate(cells)], levels)

    def dot(self, m: np.ndarray) -> np.ndarray:
        """Rows times a matrix (width x columns)."""
        if self.dense is not None:
            return self.dense @ m
        out, m = np.zeros((self.n, m.shape[1])), np.ascontiguousarray(m)
        for i in np.flatnonzero(np.diff(self.start)):  # a row's part of the matrix stays in the cache
            at = slice(self.start[i], self.start[i + 1])
            np.dot(self.value[at], m.take(self.place[at], axis=0), out=out[i])
        return out

    def across(self, m: np.ndarray) -> np.ndarray:
        """The rows' transpose times a matrix (rows x columns): width x columns."""
        if self.dense is not None:
            return self.dense.T @ m
        size = np.diff(self.start)
        if len(self.place) * 4 >= self.width:
            return np.stack([np.bincount(self.place, self.value * np.repeat(column, size), self.width) for column in m.T], axis=1)
        out = np.zeros((self.width, m.shape[1]))
        np.add.at(out, self.place, self.value[:, None] * np.repeat(m, size, axis=0))
        return out

    def add(self, label: np.ndarray, groups: int) -> np.ndarray:
        """Feature sums per group: labels (rows x starts) -> groups x width."""
        starts = label.shape[1]
        if self.dense is not None and self.width <= DENSE_WIDTH:
            flat = label.ravel()
            return np.stack([np.bincount(flat, np.repeat(self.dense[:, j], starts), groups) for j in range(self.width)], axis=1)
        out = np.zeros(groups * self.width)
        size, many = np.diff(self.start), len(self.place) * 4 >= len(out)
        for s in range(starts):
            at = np.repeat(label[:, s] * self.width, size) + self.place
            if many:
                out += np.bincount(at, self.value, len(out))
            else:
                np.add.at(out, at, self.value)
        return out.reshape(groups, self.width)


def blocks(batches, column: str, width: int, rows: int):
    """Arrow batches of a vector column in blocks of at most ``rows`` rows."""
    for batch in batches:
        c = batch.column(batch.schema.get_field_index(column))
        if pa.types.is_binary(c.type):  # packed
            for packed, levels in zip(c, batch.column("_levels")):
                dense = np.frombuffer(packed.as_buffer(), np.float64).reshape(-1, width)
                yield Block.of(dense, [level.values.to_numpy(zero_copy_only=False) for level in levels.values])
            continue
        if pa.types.is_struct(c.type):  # ML vector: type (0 sparse, 1 dense), size, indices, values
            values = c.field("values")
            size = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
            value = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            place = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
            sparse = np.repeat(c.field("type").to_numpy(zero_copy_only=False) == 0, size)
            place[sparse] = c.field("indices").flatten().to_numpy(zero_copy_only=False)
        else:
            size = pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)
            value = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            place = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
        start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        for at in range(0, len(size), rows):
            cut = start[at:at + rows + 1]
            yield Block(cut - cut[0], place[cut[0]:cut[-1]], value[cut[0]:cut[-1]], width)


def _nearness(c: np.ndarray):
    """(matrix, constants) that give |c|^2 - 2xc, the distance less the row's own norm, of flat centroids."""
    return np.ascontiguousarray(-2.0 * c.T), (c * c).sum(1)


def _sums(x: Block, d: np.ndarray, s: int, k: int, out: np.ndarray) -> None:
    """Add a block's rows, squares and features to the sums of their nearest centroids: ``d`` rows x starts of k."""
    label = d.reshape(x.n, s, k).argmin(2) + np.arange(s) * k
    flat = label.ravel()
    out[:, 0] += np.bincount(flat, minlength=s * k)
    out[:, 1] += np.bincount(flat, np.repeat(x.squares, s), s * k)
    out[:, 2:] += x.add(label, s * k)


def _cells(rows: np.ndarray, most: int, depth: list[int] | None = None) -> list[np.ndarray]:
    """Row numbers in cells of at most ``most`` rows: parts along the widest side, cut at the widest gap of the middle half.
    ``depth`` gets, for each cell, the depth of the first part of rows that starts with it."""
    out, todo = [], [(np.arange(len(rows)), 0, 0)]
    while todo:
        at, first, deep = todo.pop()
        if len(at) <= most:
            out.append(at)
            if depth is not None:
                depth.append(first)
            continue
        part = rows[at]
        part = part[:, np.ptp(part, axis=0).argmax()]
        order = np.argsort(part, kind="stable")
        low, middle = len(at) // 4, len(at) // 2
        gap = np.diff(part[order[low:len(at) - low]])
        widest = np.flatnonzero(gap >= gap.max() * (1 - 1e-9)) if len(gap) and np.isfinite(gap).all() else [middle - low - 1]
        cut = low + 1 + min(widest, key=lambda i: abs(low + 1 + i - middle)) if len(widest) < 64 else middle
        todo += [(at[order[cut:]], deep + 1, deep + 1), (at[order[:cut]], first, deep + 1)]
    return out


class _Level:
    """The cells of one level of a block: middles (as rows of ``what``), half sides, sums, where rows and cells below start."""

    def __init__(self, low: np.ndarray, high: np.ndarray, sums: np.ndarray, start: np.ndarray, below: np.ndarray | None):
        middle = (low + high) / 2
        self.middle, self.half = np.column_stack([np.ones(len(low)), (middle * middle).sum(1), middle]), (high - low) / 2
        self.low, self.high, self.sums, self.start, self.below = low, high, sums, start, below


def _levels(x: Block, what: np.ndarray) -> list[_Level]:
    """Of a block in the order of its cells, from the whole down to the smallest."""
    out: list[_Level] = []
    for start in reversed(x.levels):
        if out:
            last = out[-1]
            at = np.searchsorted(last.start[:-1], start)
            low, high, sums = np.minimum.reduceat(last.low, at), np.maximum.reduceat(last.high, at), np.add.reduceat(last.sums, at)
            out.append(_Level(low, high, sums, np.append(start, x.n), np.append(at, len(last.low))))
        else:
            low, high, sums = np.minimum.reduceat(x.dense, start), np.maximum.reduceat(x.dense, start), np.add.reduceat(what, start)
            out.append(_Level(low, high, sums, np.append(start, x.n), None))
    return out[::-1]


def _first_of_equals(own: np.ndarray, first: np.ndarray) -> bool:
    """Keep, in each column, the first True of each run of rows; False where a run has none."""
    found = np.add.reduceat(own, first, axis=0, dtype=np.int64)
    ends = np.append(first[1:], len(own))
    for run, j in np.argwhere(found > 1):
        own[first[run] + np.flatnonzero(own[first[run]:ends[run], j])[1:], j] = False
    return bool(found.all())


class _Nearest:
    """The centroids of many models, and of each model those that may be nearest to some row of a cell.

    In a cell with middle b and half sides h the centroid c cannot beat the model's nearest to the middle, c*, if
    |b - c|^2 - |b - c*|^2 > 2 h |c - c*| (the sides one by one): the difference is linear, so its least value lies in a corner."""

    def __init__(self, models: list[np.ndarray]):
        self.size = np.array([len(c) for c in models])
        self.c = np.concatenate(models)
        self.m, self.constant = -2.0 * self.c, (self.c * self.c).sum(1)
        self.first = np.cumsum(self.size) - self.size
        self.model = np.repeat(np.arange(len(models)), self.size)
        #: times (1, square, features) of a row: its distance less its own norm
        self.full = np.column_stack([self.constant, np.zeros(len(self.c)), self.m])
        self.finite = bool((self.constant < LARGE).all())

    def candidates(self, x: np.ndarray) -> np.ndarray:
        low, high = x.min(0), x.max(0)
        middle, half = (low + high) / 2, (high - low) / 2
        d = self.m @ middle
        d += self.constant
        least, own, radius = np.minimum.reduceat(d, self.first), middle @ middle, np.sqrt(half @ half)
        slack = 1e-9 * (1.0 + np.abs(least).max() + own + radius * radius)  # for rounding
        # by distance alone: |b - c| <= |b - c*| + 2 |h|
        limit = (np.sqrt(np.maximum(least + own, 0.0)) + 2.0 * radius) ** 2 - own + slack
        at = np.flatnonzero(d <= np.repeat(limit, self.size))
        return at[self._may(at, d[at], half, slack)[0]]

    def _may(self, at: np.ndarray, d: np.ndarray, half: np.ndarray, slack: float):
        """(which of the candidates ``at`` stay, their model's number among those here, each model's nearest to the middle)."""
        model = self.model[at]
        new = np.empty(len(at), bool)
        new[:1] = True
        np.not_equal(model[1:], model[:-1], out=new[1:])
        run = np.cumsum(new) - 1
        gap = d - np.minimum.reduceat(d, np.flatnonzero(new))[run]
        zero = np.flatnonzero(gap == 0)
        best = np.empty(run[-1] + 1, np.int64)
        best[run[zero]] = at[zero]
        c = self.c[at]
        c -= self.c[best[run]]
        np.abs(c, out=c)
        return gap <= 2.0 * (c @ half) + slack, run, best

    def add(self, x: np.ndarray, what: np.ndarray, at: np.ndarray, out: np.ndarray) -> bool:
        """Add ``what`` of each row to its nearest candidate in ``out``, the first of equals; False, and nothing added, where a
        row has none."""
        count = np.bincount(self.model[at], minlength=len(self.size))
        open_ = count[self.model[at]] > 1
        several, count = at[open_], count[count > 1]
        if len(several):
            d = self.m[several] @ x.T
            d += self.constant[several][:, None]
            first = np.cumsum(count) - count
            own = d == np.repeat(np.minimum.reduceat(d, first, axis=0), count, axis=0)
            if np.count_nonzero(own) != len(count) * len(x):
                if not _first_of_equals(own, first):
                    return False
            out[several] += own.astype(np.float64) @ what
        out[at[~open_]] += what.sum(0)  # the cell lies whole with one centroid
        return True

    def wide(self, x: Block) -> bool:
        """Whether most centroids may be nearest in a cell, so that cells do not tell."""
        start = np.append(x.levels[-1], x.n)
        some = [len(start) // 4, len(start) // 2]
        return sum(len(self.candidates(x.dense[start[i]:start[i + 1]])) for i in some if i + 1 < len(start)) > len(self.c)

    def add_block(self, x: Block, what: np.ndarray, out: np.ndarray) -> None:
        """``add`` for all rows of a block in the order of its cells."""
        self.levels, self.what, self.out = _levels(x, what), what, out
        at = self.candidates(x.dense)
        none = np.zeros((0, what.shape[1]))
        self._below(0, 0, at, self.full[at] @ self.levels[0].middle[0], none)

    def _below(self, level: int, cell: int, at: np.ndarray, d: np.ndarray, planes: np.ndarray) -> np.ndarray:
        """Add a cell's rows to their nearest of the candidates ``at``, whose distances to the middle are ``d``. Returns the sums
        of those rows whose product with each of ``planes`` is not above 0: the differences of the two that are left of a model."""
        here, passed = self.levels[level], len(planes)
        whole = here.sums[cell]
        if len(at):
            half = here.half[cell]
            slack = 1e-9 * (1.0 + np.abs(d).max() + here.middle[cell, 1] + half @ half)
            stay, run, best = self._may(at, d, half, slack)
            count = np.bincount(run, stay)
            self.out[best[count == 1]] += whole  # the cell lies whole with one centroid
            count = count[run]
            two = at[stay & (count == 2)]
            at = at[stay & (count > 2)]
            if len(two):
                a, b = two[::2], two[1::2]
                planes = np.concatenate([planes, self.full[a] - self.full[b]])
        rows = slice(here.start[cell], here.start[cell + 1])
        if here.below is None:
            what = self.what[rows]
            found = (planes @ what.T <= 0).astype(np.float64) @ what
            if len(at) and not self.add(what[:, 2:], what, at, self.out):
                raise FloatingPointError("a row has no nearest centroid")
        else:
            cells = slice(here.below[cell], here.below[cell + 1])
            under = self.levels[level + 1]
            sides = planes @ under.middle[cells].T
            reach = np.abs(planes[:, 2:]) @ under.half[cells].T
            reach += 1e-9 * (1.0 + np.abs(sides) + under.middle[cells, 1])
            found = (sides < -reach).astype(np.float64) @ under.sums[cells]
            both = np.abs(sides) <= reach
            d = self.full[at] @ under.middle[cells].T
            for i, c in enumerate(range(cells.start, cells.stop)):
                k = np.flatnonzero(both[:, i])
                if len(k) or len(at):
                    found[k] += self._below(level + 1, c, at, d[:, i], planes[k])
        if len(planes) > passed:
            self.out[a] += found[passed:]
            self.out[b] += whole - found[passed:]
        return found[:passed]


def _lloyd(models, column: str, width: int):
    """Kernel of a round: ``models`` is a broadcast list of (group, centroids: starts x k x width)."""
    def run(batches):
        held = [(g, c.shape[0], c.shape[1], *_nearness(c.reshape(-1, width))) for g, c in models.value]
        out = {g: np.zeros((s * k, width + 2)) for g, s, k, _, _ in held}
        if width > DENSE_WIDTH:  # one product for all: the rows' entries are gathered once
            every, constants = np.concatenate([m for *_, m, _ in held], axis=1), np.concatenate([c for *_, c in held])
            held = [(g, s, k, None, None) for g, s, k, _, _ in held]
            for x in blocks(batches, column, width, max(16, BLOCK_NUMBERS // len(constants))):
                d, at = x.dot(every), 0
                d += constants
                for g, s, k, _, _ in held:
                    _sums(x, d[:, at:at + s * k], s, k, out[g])
                    at += s * k
        else:
            near = _Nearest([one for _, c in models.value for one in c])
            sums = np.zeros((len(near.c), width + 2))
            for x in blocks(batches, column, width, PACK_ROWS):
                if x.n and near.finite and (x.squares < LARGE).all():
                    x = x.placed()
                    if not near.wide(x):
                        near.add_block(x, np.column_stack([np.ones(x.n), x.squares, x.dense]), sums)
                        continue
                for g, s, k, m, constant in held:
                    rows = max(64, PIECE_NUMBERS // (s * k))
                    for at in range(0, x.n, rows):
                        part = x.rows(slice(at, at + rows))
                        d = part.dot(m)
                        d += constant
                        _sums(part, d, s, k, out[g])
            at = 0
            for g, s, k, _, _ in held:
                out[g] += sums[at:at + s * k]
                at += s * k
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([v.ravel() for v in out.values()],
                                                                                    pa.list_(pa.float64()))], ["g", "v"])
    return run


def _score(models, column: str, width: int):
    """Kernel of the last pass: (k, [sum of silhouettes, distance to the own mean per cluster]); ``models``: broadcast
    list of (k, centroids, rows, means, mean squared norms)."""
    def run(batches):
        held = [(k, *_nearness(c), *_nearness(mean), n, q - (mean * mean).sum(1)) for k, c, n, mean, q in models.value]
        out = {k: np.zeros(1 + len(n)) for k, *_, n, _ in held}
        most = max(16, BLOCK_NUMBERS // max((len(n) for *_, n, _ in held), default=1))
        cells = None
        for x in blocks(batches, column, width, most):
            if x.levels is not None and (x.squares < LARGE).all():
                cells = cells or _ScoreCells(models.value)
                if cells.near.finite and not cells.near.wide(x):
                    cells.add_block(x)
                    continue
            for x in [x] if x.n <= most else [x.rows(slice(at, at + most)) for at in range(0, x.n, most)]:
                _score_rows(x, held, out)
        if cells is not None:
            for (k, v), silhouettes, away in zip(out.items(), cells.silhouettes, np.split(cells.away, cells.near.first[1:])):
                v += [silhouettes, *away]
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([v for v in out.values()], pa.list_(pa.float64()))],
                                         ["g", "v"])
    return run


def _score_rows(x: Block, held: list, out: dict) -> None:
    """Add a block's rows to the scores of each model."""
    every = np.arange(x.n)
    for k, m, constant, mm, mconstant, n, spread in held:
        label = (x.dot(m) + constant).argmin(1)
        to_mean = x.dot(mm) + mconstant + x.squares[:, None]
        own = np.sqrt(np.maximum(to_mean[every, label], 0.0))
        out[k][1:] += np.bincount(label, own, len(n))
        # mean squared distance to the rows of a cluster = to its mean + the spread around that
        apart = to_mean + spread
        apart[:, n == 0] = np.inf
        mine = apart[every, label] * n[label] / np.maximum(n[label] - 1, 1)
        apart[every, label] = np.inf
        other = apart.min(1)
        top = np.maximum(mine, other)
        counts = (n[label] > 1) & (top > 0) & np.isfinite(other)
        out[k][0] += ((other - mine)[counts] / top[counts]).sum()


class _ScoreCells:
    """The same for blocks in the order of their cells: a cell meets those clusters of a model whose centroid may be nearest to
    one of its rows, or that may be one of the two nearest by the mean squared distance to their rows (linear as well)."""

    def __init__(self, models: list):
        self.near = _Nearest([c for _, c, *_ in models])
        self.n, self.mean, q = (np.concatenate([model[i] for model in models]) for i in (2, 3, 4))
        self.spread, self.dead = q - (self.mean * self.mean).sum(1), self.n == 0
        self.full = np.column_stack([q, np.ones(len(q)), -2.0 * self.mean])
        self.silhouettes, self.away = np.zeros(len(models)), np.zeros(len(q))

    def add_block(self, x: Block) -> None:
        self.what = np.column_stack([np.ones(x.n), x.squares, x.dense])
        self.levels = _levels(x, self.what)
        self._below(0, 0, np.arange(len(self.n)))

    def _below(self, level: int, cell: int, at: np.ndarray) -> None:
        here = self.levels[level]
        middle, half = here.middle[cell], here.half[cell]
        d = self.near.full[at] @ middle
        slack = 1e-9 * (1.0 + np.abs(d).max() + middle[1] + half @ half)
        stay, run, _ = self.near._may(at, d, half, slack)
        far = self.full[at] @ middle
        far[self.dead[at]] = np.inf
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        mean, least, beaten = self.mean[at], far.copy(), np.ones(len(at), bool)
        live = np.isfinite(far)
        slack = 1e-9 * (1.0 + np.abs(far[live]).max() + middle[1] + half @ half)
        for _ in range(2):  # by the nearest to the middle, and by the next
            low = np.minimum.reduceat(least, first)
            best = np.empty(len(first), np.int64)
            hit = np.flatnonzero(least == low[run])
            best[run[hit]] = hit
            gap = np.where(np.isfinite(low)[run], far - np.where(np.isfinite(low), low, 0.0)[run], 0.0)
            beaten &= gap > 2.0 * (np.abs(mean - mean[best[run]]) @ half) + slack
            least[best] = np.inf
        at = at[stay | (live & ~beaten)]
        if here.below is not None:
            for c in range(here.below[cell], here.below[cell + 1]):
                self._below(level + 1, c, at)
            return
        what = self.what[here.start[cell]:here.start[cell + 1]]
        model = self.near.model[at]
        first = np.flatnonzero(np.append(True, model[1:] != model[:-1]))
        size = np.diff(first, append=len(at))
        d = self.near.full[at] @ what.T
        own = d == np.repeat(np.minimum.reduceat(d, first), size, axis=0)
        _first_of_equals(own, first)
        apart = self.full[at] @ what.T
        mine = np.add.reduceat(np.where(own, apart, 0.0), first)
        n = np.add.reduceat(own * self.n[at][:, None], first)
        away = np.sqrt(np.maximum(mine - np.add.reduceat(own * self.spread[at][:, None], first), 0.0))
        self.away[at] += np.einsum("ij,ij->i", own, np.repeat(away, size, axis=0))
        apart[own | self.dead[at][:, None]] = np.inf
        other = np.minimum.reduceat(apart, first)
        mine *= n / np.maximum(n - 1, 1)
        top = np.maximum(mine, other)
        counts = (n > 1) & (top > 0) & np.isfinite(other)
        found = np.zeros(top.shape)
        found[counts] = (other[counts] - mine[counts]) / top[counts]
        self.silhouettes += found.sum(1)


def _summed(data: DataFrame, kernel, models, column: str, width: int) -> dict[int, np.ndarray]:
    """One pass: the kernel's vectors added up by Spark, one row per group on the driver."""
    sent = data.sparkSession.sparkContext.broadcast(models)
    parts = data.mapInArrow(kernel(sent, column, width), "g int, v array<double>")
    rows = parts.groupBy("g").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()
    sent.unpersist()
    return {r["g"]: r["v"].toArray() for r in rows}


# ---- starts -----------------------------------------------------------------------------------------------------------

def start_rows(data: DataFrame, column: str, width: int, seed: int, n: int | None = None) -> np.ndarray:
    """The ``START_ROWS`` distinct vectors of least hash, written out, in the order of their hash. With ``n``, the number of
    rows, those of larger hashes are left out before they are compared, as long as enough remain."""
    c = data[column]
    hashed = data.select(c.alias("x"), F.xxhash64(c, F.lit(seed)).alias("h"))

    def least(batches):
        kept = None
        for batch in batches:
            both = pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch])
            _, first = np.unique(both["h"].to_numpy(), return_index=True)  # sorted by hash
            kept = both.take(pa.array(first[:START_ROWS])).combine_chunks()
        if kept is not None:
            yield from kept.to_batches()

    share = 1.0 if n is None else 8.0 * START_ROWS / max(n, 1)
    while True:
        near = hashed if share >= 1.0 else hashed.where(F.col("h") < -(1 << 63) + int(share * (1 << 64)))
        few = near.mapInArrow(least, hashed.schema).groupBy("h").agg(F.first("x").alias("x")).orderBy("h").limit(START_ROWS).collect()
        if len(few) == START_ROWS or share >= 1.0:
            break
        share *= 16.0
    out = []
    for r in few:
        out.append(r["x"].toArray() if hasattr(r["x"], "toArray") else np.array(r["x"], float))
    return np.array(out).reshape(-1, width)


def plus_plus(rows: np.ndarray, most: int, seed: int) -> np.ndarray:
    """A k-means++ sequence of at most ``most`` distinct rows."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(rows)))]
    away = ((rows - rows[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(most, len(rows)) and away.max() > 0:
        chosen.append(int(np.searchsorted(np.cumsum(away), rng.random() * away.sum(), side="right").clip(0, len(rows) - 1)))
        away = np.minimum(away, ((rows - rows[chosen[-1]]) ** 2).sum(1))
        away[chosen] = 0.0
    return rows[chosen]


# ---- rows of one place together ----------------------------------------------------------------------------------------

def _splits(rows: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(side, value) of each inner node of a tree of halves over a sample, numbered as a heap."""
    side, value, held = np.zeros((1 << levels) - 1, int), np.zeros((1 << levels) - 1), {0: rows}
    for node in range(len(side)):
        part = held.pop(node)
        side[node] = np.ptp(part, axis=0).argmax() if len(part) else 0
        v = part[:, side[node]]
        value[node] = np.median(v) if len(part) else 0.0
        held[2 * node + 1], held[2 * node + 2] = part[v <= value[node]], part[v > value[node]]
    return side, value


def in_cells(data: DataFrame, column: str, rows: np.ndarray, parts: int, seed: int) -> DataFrame:
    """The rows of ``data`` dealt and sorted by the cells of a tree over the sample ``rows``; equal cells may be cut anywhere."""
    levels = max(1, min(CELL_LEVELS, len(rows).bit_length() - 3))
    side, value = _splits(rows, levels)
    width = rows.shape[1]

    def place(batches):
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for x in blocks([batch], column, width, 1 << 14):
                node = np.zeros(x.n, np.int64)
                for _ in range(levels):
                    node = 2 * node + 1 + (x.dense[np.arange(x.n), side[node]] > value[node])
                found.append(node)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found))], names=[*batch.schema.names, "_cell"])

    placed = data.mapInArrow(place, StructType([*data.schema.fields, StructField("_cell", LongType())])).withColumn("_at", F.rand(seed))
    return placed.repartitionByRange(parts, "_cell", "_at").sortWithinPartitions("_cell").drop("_cell", "_at")


def packed(data: DataFrame, column: str, width: int) -> DataFrame:
    """The rows of ``data`` in blocks, each in the order of its cells: the coordinates as bytes, and where the cells of each
    level start. What a round reads is then moved as it is, and sorted once."""
    most = max(CELL_ROWS, min(PACK_ROWS, PACK_NUMBERS // width))

    def pack(rows):
        x = Block.of(rows, None).placed()
        return pa.RecordBatch.from_arrays([pa.array([x.dense.tobytes()], pa.binary()), pa.array([x.levels], pa.list_(pa.list_(pa.int32())))],
                                          [column, "_levels"])

    def run(batches):
        held = np.zeros((0, width))
        for x in blocks(batches, column, width, most):
            held = np.concatenate([held, x.dense])
            if len(held) >= most:
                yield pack(held[:most])
                held = held[most:]
        if len(held):
            yield pack(held)

    return data.mapInArrow(run, f"`{column}` binary, _levels array<array<int>>")


# ---- the sweep --------------------------------------------------------------------------------------------------------

@dataclass
class Fitted:
    """A fitted model with the sums of its clusters."""
    k: int
    centroids: np.ndarray
    n: np.ndarray
    squares: np.ndarray
    sums: np.ndarray
    rounds: int
    scores: dict = field(default_factory=dict)

    @property
    def sse(self) -> float:
        c = self.centroids
        each = self.squares - 2 * (c * self.sums).sum(1) + self.n * (c * c).sum(1)
        return float(np.maximum(each, 0.0).sum())


def lloyd_together(data: DataFrame, column: str, width: int, models: dict[tuple[int, int], np.ndarray], max_iter: int = 300,
                   tol: float = 1e-4) -> dict[tuple[int, int], Fitted]:
    """Models by (k, start), from their first centroids to their last, one pass per round for all."""
    now, moving, rounds, done, still = dict(models), dict.fromkeys(models, True), 0, {}, None
    while now:
        rounds += 1
        groups: dict[int, list] = {}
        for key in sorted(now):
            groups.setdefault(key[0], []).append(key)
        sums = _summed(data, _lloyd, [(k, np.stack([now[key] for key in keys])) for k, keys in groups.items()], column, width)
        for k, keys in groups.items():
            if k not in sums:  # no rows
                continue
            each = sums[k].reshape(len(keys), -1, width + 2)
            if still is None:  # the mean variance of a feature, from the sums of any model
                rows, squares, total = each[0, :, 0].sum(), each[0, :, 1].sum(), each[0, :, 2:].sum(0)
                still = tol * max(0.0, squares / rows - ((total / rows) ** 2).sum()) / max(1, width)
            for key, v in zip(keys, each):
                n, c = v[:, 0], now[key]
                if not moving[key]:
                    done[key] = Fitted(k, c, n, v[:, 1], v[:, 2:], rounds)
                    del now[key]
                    continue
                new = np.where(n[:, None] > 0, v[:, 2:] / np.maximum(n, 1)[:, None], c)  # an empty cluster stays
                moving[key] = rounds < max_iter and bool(((new - c) ** 2).sum() > still)
                now[key] = new
        if not sums:
            break
    return done


def _scores(data: DataFrame, column: str, width: int, best: dict[int, Fitted]) -> None:
    """Fill in silhouette, Calinski-Harabasz and negated Davies-Bouldin of each model."""
    sent = []
    for k, m in best.items():
        live = np.maximum(m.n, 1)
        sent.append((k, m.centroids, m.n, m.sums / live[:, None], m.squares / live))
    found = _summed(data, _score, sent, column, width)
    for k, _, n, mean, q in sent:
        live, total = n > 0, n.sum()
        m, v = best[k], found[k]
        if live.sum() < 2:
            m.scores = {"silhouette": None, "calinski_harabasz": None, "neg_davies_bouldin": None}
            continue
        own = (mean * mean).sum(1)
        whole = (n[:, None] * mean).sum(0) / total
        between, within = max(0.0, float((n * own).sum() - total * (whole * whole).sum())), float((n * (q - own))[live].sum())
        groups = int(live.sum())
        away, centre = v[1:][live] / n[live], mean[live]
        worst = []
        for i in range(groups):
            gap = np.sqrt(((centre - centre[i]) ** 2).sum(1))
            r = np.where(gap > 0, (away + away[i]) / np.where(gap > 0, gap, 1.0), 0.0)
            r[i] = -np.inf
            worst.append(r.max())
        m.scores = {"silhouette": float(v[0] / total), "neg_davies_bouldin": -float(np.mean(worst)),
                    "calinski_harabasz": 1.0 if within <= 0 else float(between * (total - groups) / (within * (groups - 1)))}


def width_of(df: DataFrame, column: str) -> int:
    first = df.select(column).first()
    return 0 if first is None else len(first[0])


def sweep(df: DataFrame, features: str, ks, seed: int = 42, n_init: int = 1, max_iter: int = 300, tol: float = 1e-4,
          scored: bool = True) -> tuple[dict[int, Fitted], int]:
    """({k: best of ``n_init`` starts by cost, with its scores}, rows with a vector)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "k-sweep")
    kept = df.select(F.col(features) if isinstance(df.schema[features].dataType, VectorUDT)
                     else F.col(features).cast("array<double>").alias(features)).where(F.col(features).isNotNull())
    # dealt evenly once: every round reads all of it
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    data = scratch.save(kept.repartition(parts))
    n, width = data.count(), width_of(data, features)
    best: dict[int, Fitted] = {}
    ks = sorted({int(k) for k in ks if k >= 1})
    if n and ks:
        rows = start_rows(data, features, width, seed, n)
        starts = [plus_plus(rows, ks[-1], seed + i) for i in range(max(1, n_init))]
        if width <= DENSE_WIDTH and len(starts) * sum(ks) >= MANY_CENTROIDS:  # rows near each other have few centroids to meet
            placed = in_cells(as_array(data, features, features), features, rows, min(4 * parts, parts + n // PACK_ROWS), seed)
            data = scratch.save(packed(placed, features, width).repartition(parts))  # some places take longer: blocks are dealt anew
        todo = [((k, i), s[:k]) for k in ks for i, s in enumerate(starts)]
        while todo:
            wave, size = {}, 0
            while todo and (not wave or size + todo[0][1].size <= WAVE_NUMBERS):
                key, c = todo.pop(0)
                wave[key], size = c, size + c.size
            for (k, _), m in sorted(lloyd_together(data, features, width, wave, max_iter, tol).items()):
                if k not in best or m.sse < best[k].sse:
                    best[k] = m
        if scored:
            _scores(data, features, width, best)
    scratch.drop()
    return best, n
