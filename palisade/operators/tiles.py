"""Inner products of many queries with many entries, a tile at a time, of which only each query's best leave."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries and entries whose products are in memory at once.
QUERY_BLOCK, ENTRY_BLOCK = 512, 4096


def _exact(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Inner products along the first axis, summed from left to right as `vectors.dot` does."""
    total = np.zeros(np.broadcast_shapes(q.shape[1:], e.shape[1:]))
    for x, y in zip(q, e):
        total += x * y
    return total


def _first(line: np.ndarray, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each line by score, ties to the smaller place; as in Spark, NaN is above all."""
    own = np.lexsort((at, -score, ~np.isnan(score), line))
    line, at, score = line[own], at[own], score[own]
    rank = np.arange(len(line)) - np.searchsorted(line, line)
    return line[rank < k], at[rank < k], score[rank < k]


def _kth(score: np.ndarray, k: int) -> np.ndarray:
    n = score.shape[1]
    return np.partition(score, n - k, axis=1)[:, n - k] if n >= k else np.full(len(score), -np.inf)


def best(q: np.ndarray, e: np.ndarray, k: int, q_at: np.ndarray | None = None, e_at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, entry row and similarity of each query's k best; of equally similar entries the earlier rows.

    A matrix product proposes all that its rounding can't rule out, and the sums from left to right decide. With
    times, only entries of an earlier time than the query's count.
    """
    qt, et = np.ascontiguousarray(q.T), np.ascontiguousarray(e.T)
    with np.errstate(all="ignore"):
        size = np.sqrt((q * q).sum(axis=1))
        # Twice the rounding of either sum, and twice that again.
        slack = 8 * (q.shape[1] + 2) * np.finfo(np.float64).eps * size * np.sqrt((e * e).sum(axis=1)).max(initial=0) + 1e-300
        safe = bool(np.isfinite(slack).all())
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in range(0, len(q), QUERY_BLOCK):
            rows = slice(i, i + QUERY_BLOCK)
            line, at, score = found[0]
            floor, n = np.full(len(q[rows]), -np.inf), len(q[rows])
            for j in range(0, len(e), ENTRY_BLOCK):
                columns = slice(j, j + ENTRY_BLOCK)
                near = q[rows] @ e[columns].T if safe else _exact(qt[:, rows, None], et[:, None, columns])
                seen = None if q_at is None else e_at[None, columns] < q_at[rows, None]
                if seen is not None:
                    near[~seen] = -np.inf
                if j == 0:
                    floor = _kth(near, k) - (slack[rows] if safe else 0)
                open_ = ~(near < floor[:, None])  # NaN stays
                if np.count_nonzero(open_) > 16 * k * n:
                    open_ &= ~(near < np.fmax(floor, _kth(near, k) - (slack[rows] if safe else 0))[:, None])
                x, y = np.nonzero(open_ if seen is None else open_ & seen)
                if not len(x):
                    continue
                sure = np.concatenate([_exact(qt[:, i + x[p : p + 500_000]], et[:, j + y[p : p + 500_000]]) for p in range(0, len(x), 500_000)]) if safe else near[x, y]
                line, at, score = _first(np.concatenate([line, x]), np.concatenate([at, y + j]), np.concatenate([score, sure]), k)
                # The k-th so far, less the rounding of the products it is held against.
                last = np.flatnonzero(np.arange(len(line)) - np.searchsorted(line, line) == k - 1)
                floor[line[last]] = np.fmax(floor[line[last]], score[last] - (slack[rows][line[last]] if safe else 0))
            found.append((line + i, at, score))
    return tuple(np.concatenate(x) for x in zip(*found))


class _Side:
    """A table's vectors, by what they have in common."""

    def __init__(self, table: pa.Table, id_name: str, vector: str, time: str | None, dim: int | None):
        v = table.column(vector).combine_chunks()
        length = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = v.flatten()
        self.starts, self.length = np.cumsum(length) - length, length
        self.values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
        holes = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(flat.is_null().to_numpy(zero_copy_only=False), out=holes[1:])
        self.usable = v.is_valid().to_numpy(zero_copy_only=False) & (holes[self.starts + length] == holes[self.starts])
        if dim is not None:
            self.usable &= length == dim
        self.times = None
        if time is not None:
            t = table.column(time)
            self.usable &= t.is_valid().to_numpy()
            self.times = pc.fill_null(t, 0).to_numpy()
        self.ids = table.column(id_name)
        self.order = pc.sort_indices(self.ids, null_placement="at_start").to_numpy().astype(np.int64)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        n = self.length[rows[0]]
        return self.values[self.starts[rows][:, None] + np.arange(n)].astype(np.float64)


def _groups(side: _Side, scope: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Rows by scope and length, each in the order of the ids."""
    rows = side.order[side.usable[side.order]]
    rows = rows[np.lexsort((side.length[rows], scope[rows]))]
    change = np.flatnonzero((np.diff(scope[rows]) != 0) | (np.diff(side.length[rows]) != 0)) + 1
    return {(scope[r[0]], side.length[r[0]]): r for r in np.split(rows, change) if len(r)}


def _fewer(v: np.ndarray, k: int) -> np.ndarray:
    """The rows that are among the k first with their vector: no other can be among a query's k best."""
    met: Counter[bytes] = Counter()
    keep = []
    for i, x in enumerate(v):
        if met[b := x.tobytes()] < k:
            met[b] += 1
            keep.append(i)
    return np.array(keep, np.int64)


def _met(q: _Side, e: _Side, mine: np.ndarray, theirs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best() of these rows. Without times, queries of one vector are asked once, and of entries of one vector k take part."""
    qv, ev = q.vectors(mine), e.vectors(theirs)
    if q.times is not None:
        line, at, score = best(qv, ev, k, q.times[mine], e.times[theirs])
        return mine[line], theirs[at], score
    kept = _fewer(ev, k)
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(x.tobytes(), len(number)) for x in qv], np.int64)
    line, at, score = best(qv[np.unique(which, return_index=True)[1]], ev[kept], k)
    # Each asked vector's rows, for every query that has it.
    start, n = np.searchsorted(line, which), np.bincount(line, minlength=len(number))[which]
    each = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(mine, n), theirs[kept][at[each]], score[each]


def tile(k: int, dim: int | None, as_of: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For cogroups of queries and entries of some scopes: query_id, entry_id and similarity of each query's k best."""

    def found(q: _Side, e: _Side, left: pa.Table, right: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        scopes = pa.concat_arrays([left.column("scope").combine_chunks(), right.column("scope").combine_chunks()]).dictionary_encode().indices.to_numpy()
        entries = _groups(e, scopes[len(left) :])
        for key, rows in _groups(q, scopes[: len(left)]).items():
            if key in entries:
                yield _met(q, e, rows, entries[key], k)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        q, e = _Side(left, "query_id", "q_vec", "ts" if as_of else None, dim), _Side(right, "entry_id", "e_vec", "created_at" if as_of else None, dim)
        if len(left) and len(right):
            parts += found(q, e, left, right)
        line, at, score = (np.concatenate(x) for x in zip(*parts))
        return pa.table({"query_id": q.ids.take(pa.array(line)), "entry_id": e.ids.take(pa.array(at)), "similarity": score})

    return run


def marginal(v: np.ndarray, similarity: np.ndarray, weight: float) -> np.ndarray:
    """Each row's candidates in the order of marginal relevance: vectors by row and rank, similarities alike."""
    every, n = np.arange(len(v)), v.shape[1]
    like = np.einsum("mia,mja->mij", v, v)
    order, placed, most = np.zeros((len(v), n), np.int64), np.zeros((len(v), n), bool), like[:, :, 0]
    placed[:, 0] = True
    for i in range(1, n):
        score = np.maximum(weight * similarity - (1 - weight) * most, -np.finfo(np.float64).max)
        order[:, i] = pick = np.argmax(np.where(placed, -np.inf, score), axis=1)
        placed[every, pick] = True
        most = np.maximum(most, like[every, :, pick])
    return order


def diverse(weight: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows of a query and its candidates by rank: a row for each candidate, with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("c")
            n = pc.list_value_length(lists).to_numpy().astype(np.int64)
            start = np.cumsum(n) - n
            rank, entry, similarity, vector = lists.flatten().flatten()
            length = pc.fill_null(pc.list_value_length(vector), -1).to_numpy().astype(np.int64)
            score, values, at = similarity.to_numpy(), vector.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
            order = np.arange(len(entry))
            # Two candidates or fewer keep their order; the others by how many they are, and how long, some at a time.
            shape = np.stack([n, length[start]], axis=1)
            for many, long in np.unique(shape[n > 2], axis=0):
                queries = np.flatnonzero((n == many) & (length[start] == long))
                for part in np.array_split(queries, -(-len(queries) * many * many // 1_000_000)):
                    rows = start[part][:, None] + np.arange(many)
                    if (length[rows] != long).any() or long < 0:
                        raise ValueError("candidates of one query have vectors of one length")
                    v = values[at[rows][:, :, None] + np.arange(long)].astype(np.float64)
                    order[rows] = np.take_along_axis(rows, marginal(v, score[rows], weight), axis=1)
            take = pa.array(order)
            place = np.arange(len(entry)) - np.repeat(start, n) + 1
            yield pa.RecordBatch.from_arrays([pa.array(b.column("query_id").take(pa.array(np.repeat(np.arange(len(n)), n)))), entry.take(take), similarity.take(take), rank.take(take), pa.array(place.astype(np.int32))], ["query_id", "entry_id", "similarity", "rank", "place"])

    return run
