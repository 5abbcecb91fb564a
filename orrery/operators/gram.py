"""Sums and second moments of clusters in bounded memory.

A task never holds a matrix for every cluster: of K x D x D numbers (4.3 GB at K = 128, D = 2048) it keeps the
matrices of as many clusters as fit ``GRAM_BYTES``.  The tokens of each cluster wait in a buffer until there are more
of them than features; only then is their matrix smaller than they are themselves.  It is added to the cluster's
matrix if that is held, and sent on as tiles otherwise.  Buffers that end smaller are sent on as tokens.  All that a
task sends is as large as its tokens at most, and as the matrices it holds.

The parts are met by cluster and lane (a bounded number of tasks), then by cluster, always as a sorted stream of
which one cluster's matrix is in memory.  Tiles are the rows of a block, from the diagonal on; the order of addition
is the sort order, so that results don't follow the arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a matrix in one tile, tasks that meet in one lane.
BLOCK_ROWS, FAN_IN = 64, 256
#: Bytes of matrices and of waiting tokens that a task holds, and of one row and one batch that it sends.
GRAM_BYTES, WAITING_BYTES, ROW_BYTES, SENT_BYTES = 256 << 20, 64 << 20, 1 << 20, 4 << 20

#: block: -1 is the head (counts, and the sum of the tokens as values), -2 and -3 are tokens as doubles and floats, others are tiles.
HEAD, TOKENS, FLOATS = -1, -2, -3
PARTIAL = "cluster int, block int, lane int, part int, seq long, n long, changed long, obj double, sq double, values binary"
_KINDS = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
_NAMES = [c.split()[0] for c in PARTIAL.split(", ")]

Part = tuple[int, int, np.ndarray]  # cluster, block, values


class Grams:
    """Second moments that are added to token by token; what has no room is given back in parts."""

    def __init__(self, width: int, floats: bool = False, gram_bytes: int = GRAM_BYTES, waiting_bytes: int = WAITING_BYTES):
        self.width, self.floats, self.most_waiting = width, floats, waiting_bytes
        self.room = max(1, gram_bytes // (8 * width * width))
        self.held: dict[int, np.ndarray] = {}
        self.waiting: dict[int, list[np.ndarray]] = {}
        self.rows: dict[int, int] = {}
        self.bytes = 0

    def _taken(self, c: int) -> np.ndarray:
        y = np.concatenate(self.waiting.pop(c))
        self.bytes -= y.nbytes
        del self.rows[c]
        return y

    def _hold(self, c: int) -> bool:
        if c not in self.held and len(self.held) < self.room:
            self.held[c] = np.zeros((self.width, self.width))
        return c in self.held

    def _tiles(self, c: int, square: np.ndarray) -> Iterator[Part]:
        for lo in range(0, self.width, BLOCK_ROWS):
            yield c, lo // BLOCK_ROWS, square[lo : lo + BLOCK_ROWS, lo:]

    def _tokens(self, c: int) -> Iterator[Part]:
        y = self._taken(c)
        y = y.astype(np.float32) if self.floats else y
        step = max(1, ROW_BYTES // (self.width * y.itemsize))
        for lo in range(0, len(y), step):
            yield c, FLOATS if self.floats else TOKENS, y[lo : lo + step]

    def add(self, c: int, y: np.ndarray) -> Iterator[Part]:
        """Takes tokens of a cluster; gives what it has to let go."""
        self.waiting.setdefault(c, []).append(y)
        self.rows[c] = self.rows.get(c, 0) + len(y)
        self.bytes += y.nbytes
        if self.rows[c] > self.width:
            if self._hold(c):
                y = self._taken(c)
                self.held[c] += y.T @ y
            else:
                y = self._taken(c)
                yield from self._tiles(c, y.T @ y)
        while self.bytes > self.most_waiting:
            largest = max(self.rows, key=lambda k: (self.rows[k], -k))
            if largest in self.held:
                y = self._taken(largest)
                self.held[largest] += y.T @ y
            else:
                yield from self._tokens(largest)

    def take(self, c: int, block: int, values: np.ndarray) -> Iterator[Part]:
        """Takes a part that another task has given; tiles need room for the cluster's matrix."""
        if block < HEAD:
            yield from self.add(c, values.reshape(-1, self.width))
            return
        if not self._hold(c):
            raise MemoryError("no room for the matrix of a cluster")
        lo = block * BLOCK_ROWS
        self.held[c][lo : lo + BLOCK_ROWS, lo:] += values.reshape(-1, self.width - lo)

    def finish(self) -> Iterator[Part]:
        for c in sorted({*self.held, *self.waiting}):
            if c in self.held:
                if c in self.waiting:
                    y = self._taken(c)
                    self.held[c] += y.T @ y
                yield from self._tiles(c, self.held.pop(c))
            else:
                yield from self._tokens(c)

    def whole(self, c: int) -> np.ndarray:
        """The full matrix of a cluster, which is forgotten."""
        square = self.held.pop(c, None)
        if c in self.waiting:
            y = self._taken(c)
            square = y.T @ y if square is None else square + y.T @ y
        upper = np.triu(square) if square is not None else np.zeros((self.width, self.width))
        return upper + np.triu(upper, 1).T


class Sender:
    """Rows of PARTIAL, as Arrow batches of bounded size."""

    def __init__(self, lane: int, part: int):
        self.lane, self.part, self.seq, self.bytes = lane, part, 0, 0
        self.rows: list[tuple] = []

    def put(self, cluster: int, block: int, values: np.ndarray, n: int = 0, changed: int = 0, obj: float = 0.0, sq: float = 0.0) -> Iterator[pa.RecordBatch]:
        data = values.tobytes()
        self.rows.append((int(cluster), int(block), self.lane, self.part, self.seq, int(n), int(changed), float(obj), float(sq), data))
        self.seq += 1
        self.bytes += len(data)
        if self.bytes >= SENT_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*self.rows, strict=True), _KINDS, strict=True)], names=_NAMES)
        self.rows, self.bytes = [], 0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:-1]]
        yield from zip(*columns, batch.column("values"), strict=True)


def _values(block: int, data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), np.float32 if block == FLOATS else np.float64).astype(float, copy=False)


class Met:
    """One cluster's counts, sum and second moments, as far as they have met."""

    def __init__(self, cluster: int, lane: int, width: int, floats: bool):
        self.cluster, self.lane = cluster, lane
        self.n = self.changed = 0
        self.obj = self.sq = 0.0
        self.sum, self.grams = np.zeros(width), Grams(width, floats)


def _meet(width: int, floats: bool, by_lane: bool, close: Callable[[Met, Sender | None], Iterator[pa.RecordBatch]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cluster, lane), group in groupby(_rows(batches), key=lambda r: (r[0], r[2] if by_lane else 0)):
            met = Met(cluster, lane, width, floats)
            sender = Sender(lane, 0)
            for _, block, _, _, _, n, changed, obj, sq, data in group:
                met.n, met.changed, met.obj, met.sq = met.n + n, met.changed + changed, met.obj + obj, met.sq + sq
                if block == HEAD:
                    met.sum += _values(block, data)
                else:
                    for part in met.grams.take(cluster, block, _values(block, data)):
                        yield from sender.put(*part)
            yield from close(met, sender)

    return run


def _pass_on(met: Met, sender: Sender) -> Iterator[pa.RecordBatch]:
    yield from sender.put(met.cluster, HEAD, met.sum, met.n, met.changed, met.obj, met.sq)
    for part in met.grams.finish():
        yield from sender.put(*part)
    yield from sender.flush()


def met(partial: DataFrame, width: int, close: Callable[[Met], Iterator[pa.RecordBatch]], schema: str, floats: bool = False) -> DataFrame:
    """``close`` of each cluster's whole moments; ``partial`` has the columns of PARTIAL."""
    order = ("cluster", "lane", "block", "part", "seq")
    lanes = partial.repartition("cluster", "lane").sortWithinPartitions(*order).mapInArrow(_meet(width, floats, True, _pass_on), PARTIAL)
    whole = lanes.repartition("cluster").sortWithinPartitions(*order)
    return whole.mapInArrow(_meet(width, floats, False, lambda found, _: close(found)), schema)


def heads(found: Met) -> Iterator[pa.RecordBatch]:
    """For ``met``: counts and sums only."""
    yield pa.record_batch({"cluster": pa.array([found.cluster], pa.int32()), "n": pa.array([found.n], pa.int64()), "changed": pa.array([found.changed], pa.int64()), "obj": [found.obj], "sq": [found.sq], "sum": pa.array([found.sum], pa.list_(pa.float64()))})


HEADS = "cluster int, n long, changed long, obj double, sq double, sum array<double>"


def entries(found: Met) -> Iterator[pa.RecordBatch]:
    """For ``met``: the second moments themselves, i <= j."""
    square = found.grams.whole(found.cluster)
    for i in range(len(square)):
        j = np.arange(i, len(square))
        yield pa.record_batch({"cluster": pa.array(np.full(len(j), found.cluster), pa.int32()), "i": pa.array(np.full(len(j), i), pa.int32()), "j": pa.array(j, pa.int32()), "value": pa.array(square[i, i:])})


ENTRIES = "cluster int, i int, j int, value double"
