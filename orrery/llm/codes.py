"""Vector codes: product quantization fitted by filtering Lloyd iterations over kd-trees.

Every partition cuts its vectors into blocks and builds, for each part position of a block, a balanced kd-tree whose
nodes cache their bounding box, the sum of their points and (by position) their count.  The trees are written once and
read in every round.  A round walks a tree from the root with the codebook entries that can still be nearest to
some point of a node's box; a node with one entry left is assigned whole, by its cached sum and count, the points of
the leaves that are left are compared one by one.  All arithmetic is on whole numbers, so that any split into
partitions gives the same codebooks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import forget, settled

#: Vectors of one block, and the fewest points of a leaf.
BLOCK_ROWS, LEAF_POINTS = 8192, 16

_HEX = [f"{e:02x}" for e in range(256)]


class Tree:
    """A balanced kd-tree over whole-number points: node j of level l holds points n j // 2^l up to n (j + 1) // 2^l in ``order``."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.depth = max(0, int(np.log2(max(n // LEAF_POINTS, 1))))
        order = np.arange(n)
        for level in range(self.depth):
            edges = self.edges(n, level)
            x = points[order]
            wide = np.maximum.reduceat(x, edges[:-1]) - np.minimum.reduceat(x, edges[:-1])
            node = np.repeat(np.arange(1 << level), np.diff(edges))
            order = order[np.lexsort((x[np.arange(n), wide.argmax(axis=1)[node]], node))]  # each node is sorted along its widest side
        self.order, self.points = order, points[order]
        starts = self.edges(n, self.depth)[:-1]
        box = [(f.reduceat(self.points, starts)) for f in (np.minimum, np.maximum, np.add)]
        self.levels = [box]
        for _ in range(self.depth):  # a parent from its two children
            box = [f(a[0::2], a[1::2]) for f, a in zip((np.minimum, np.maximum, np.add), box, strict=True)]
            self.levels.insert(0, box)

    @staticmethod
    def edges(n: int, level: int) -> np.ndarray:
        return n * np.arange((1 << level) + 1) >> level

    def pack(self) -> bytes:
        return b"".join(a.tobytes() for a in (self.order, self.points, *(x for box in self.levels for x in box)))

    @classmethod
    def unpack(cls, data: bytes, n: int, width: int) -> Tree:
        tree, values = cls.__new__(cls), np.frombuffer(data, np.int64)
        tree.depth = max(0, int(np.log2(max(n // LEAF_POINTS, 1))))
        tree.order, values = values[:n], values[n:]
        tree.points, values = values[: n * width].reshape(n, width), values[n * width :]
        tree.levels = []
        for level in range(tree.depth + 1):
            size = width << level
            tree.levels.append([values[i * size : (i + 1) * size].reshape(-1, width) for i in range(3)])
            values = values[3 * size :]
        return tree

    def filtered(self, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first point, end, entry, sums) of nodes and points that go to one entry whole; together they hold every point once."""
        n, k = len(self.points), len(book)
        norms = np.einsum("kw,kw->k", book, book)
        nodes, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level, (low, high, sums) in enumerate(self.levels):
            edges = self.edges(n, level)
            lo, hi = low[nodes], high[nodes]
            middle = (lo + hi) / 2
            away = np.where(alive, norms - 2 * (middle @ book.T.astype(float)), np.inf)
            best = away.argmin(axis=1)  # any entry still alive will do; the nearest to the middle eliminates most
            for z in range(k):
                # The difference of the distances to z and to best is linear over the box: its least value is at a corner.
                step = book[z] - book[best]
                corner = np.where(step > 0, hi, lo)
                least = norms[z] - norms[best] - 2 * np.einsum("nw,nw->n", corner, step)
                alive[:, z] &= (z == best) | (least < 0) | ((least == 0) & (z < best))
            one = alive.sum(axis=1) == 1
            if one.any():
                yield edges[nodes[one]], edges[nodes[one] + 1], best[one], sums[nodes[one]]
            nodes, alive = nodes[~one], alive[~one]
            if not len(nodes):
                return
            if level < self.depth:
                nodes, alive = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel(), np.repeat(alive, 2, axis=0)
        edges = self.edges(n, self.depth)
        sizes = edges[nodes + 1] - edges[nodes]
        row = np.repeat(np.arange(len(nodes)), sizes)
        at = edges[nodes][row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        nearest, least = np.full(len(at), -1), np.zeros(len(at), np.int64)
        for z in range(k):
            open_ = alive[row, z]
            gap = self.points[at[open_]] - book[z]
            r = np.einsum("nw,nw->n", gap, gap)
            better = (nearest[open_] < 0) | (r < least[open_])
            spot = np.flatnonzero(open_)[better]
            nearest[spot], least[spot] = z, r[better]
        yield at, at + 1, nearest, self.points[at]

    def totals(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points and their sum for each entry."""
        n, sums = np.zeros(len(book), np.int64), np.zeros_like(book)
        for first, end, entry, s in self.filtered(book):
            np.add.at(n, entry, end - first)
            np.add.at(sums, entry, s)
        return n, sums

    def nearest(self, book: np.ndarray) -> np.ndarray:
        """The entry of each point, in the order the points were given."""
        out = np.empty(len(self.points), np.int64)
        for first, end, entry, _ in self.filtered(book):
            sizes = end - first
            at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            out[self.order[at]] = np.repeat(entry, sizes)
        return out


def whole_parts(vectors: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """parts x n x width whole numbers floor(scale x)."""
    numbers = np.floor(vectors.astype(float) * scale)
    if numbers.size and 4 * vectors.shape[1] * float(np.abs(numbers).max()) ** 2 >= 2.0**62:
        raise ValueError("a component is so large that squared distances don't fit 64 bits")
    return numbers.astype(np.int64).reshape(len(vectors), parts, -1).transpose(1, 0, 2)


def _plant(parts: int, scale: int, width: int):
    """Blocks of vectors with a packed tree for each part position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(lo, BLOCK_ROWS)
                flat = some.column("v").flatten().to_numpy(zero_copy_only=False)
                cut = whole_parts(flat.reshape(some.num_rows, width), parts, scale)
                trees = [Tree(np.ascontiguousarray(x)).pack() for x in cut]
                table = {c: pa.array([some.column(c).to_pylist()], pa.list_(some.column(c).type)) for c in ("vec_id", "label")}
                yield pa.record_batch(table | {"trees": pa.array([trees], pa.list_(pa.binary()))})

    return run


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[Tree]]]:
    for i in range(batch.num_rows):
        n = len(batch.column("vec_id")[i])
        yield i, [Tree.unpack(x.as_buffer(), n, width) for x in batch.column("trees")[i].values]


def _gather(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, width = books.shape
        n, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            for _, trees in _trees(batch, width):
                for p, tree in enumerate(trees):
                    found, total = tree.totals(books[p])
                    n[p] += found
                    sums[p] += total
        part, entry = np.nonzero(n)
        yield pa.record_batch({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(n[part, entry]), "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64()))})

    return run


def _encode(books: np.ndarray, ids: pa.DataType, labels: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = books.shape[2]
        for batch in batches:
            for i, trees in _trees(batch, width):
                entry = np.stack([t.nearest(books[p]) for p, t in enumerate(trees)])
                error = np.zeros(entry.shape[1], np.int64)
                for p, t in enumerate(trees):
                    gap = t.points - books[p][entry[p][t.order]]
                    error[t.order] += np.einsum("nw,nw->n", gap, gap)
                codes = ["".join(map(_HEX.__getitem__, column)) for column in entry.T.tolist()]
                yield pa.record_batch({"vec_id": pa.array(batch.column("vec_id")[i].as_py(), ids), "label": pa.array(batch.column("label")[i].as_py(), labels), "code": pa.array(codes, pa.string()), "error": pa.array(error)})

    return run


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, label_error, codebooks_sha256.

    Rows without vector, with an empty one, or with null or non-finite components are dropped.  Components become
    floor(scale x).  Codebooks start as the parts of the ``entries`` smallest vec_ids (null ids last, equal ids by
    their vectors; fewer rows make smaller codebooks).  Each round assigns every part to its nearest entry, the
    lower on ties, and sets each used entry to the floor of its parts' mean.  Repeated rows all count and all come
    back; null labels are one group.  An empty table gives no rows; vectors of different lengths, of lengths
    that ``parts`` doesn't divide, or too large for 64-bit distances fail.  Other columns don't matter.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits hold 256 entries")
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine).select("vec_id", "label", F.col(vector).alias("v"))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()  # at most ``entries`` rows
    out = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    if not first:
        return out.withColumns({"label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")}).where(F.lit(False))
    width = len(first[0]["v"])
    if any(len(r["v"]) != width for r in first):
        raise ValueError(f"a vector doesn't have {width} components")
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    books = np.ascontiguousarray(whole_parts(np.array([r["v"] for r in first], float).reshape(len(first), width), parts, scale))
    same = F.when(F.size("v") == width, F.col("v")).otherwise(F.raise_error(F.lit(f"a vector doesn't have {width} components")))
    types = {c: kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = ", ".join(f"{c} array<{t}>" for c, t in types.items()) + ", trees array<binary>"
    planted = settled(kept.withColumn("v", same).mapInArrow(_plant(parts, scale, width), schema))
    for _ in range(rounds):
        partial = planted.mapInArrow(_gather(books), "part int, entry int, n long, sums array<long>")
        long = partial.select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
        books = books.copy()
        for r in long.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # parts x entries x width numbers
            books[r["part"], r["entry"], r["at"]] = r["s"] // r["n"]
    import pyspark.sql.pandas.types as kinds

    ids, labels = (kinds.to_arrow_type(kept.schema[c].dataType) for c in ("vec_id", "label"))
    coded = settled(planted.mapInArrow(_encode(books, ids, labels), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"))
    forget(planted)
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    return rows.withColumn("codebooks_sha256", F.lit(digest))


def oracle(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """DuckDB SQL of the same result for vectors of ``parts`` x ``width`` components: one pair of steps a round."""
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, embedding FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (SELECT row, p, list_transform(range({width}), lambda i: CAST(floor({scale} * CAST(embedding[p * {width} + i + 1] AS DOUBLE)) AS BIGINT)) AS v FROM kept, range({parts}) r(p)),
book0 AS MATERIALIZED (SELECT p, row - 1 AS e, v AS c FROM points WHERE row <= {entries})"""]
    gap = " + ".join(f"(v[{i}] - c[{i}]) * (v[{i}] - c[{i}])" for i in range(1, width + 1))
    means = ", ".join(f"CAST(floor(sum(v[{i}]) / count(*)) AS BIGINT)" for i in range(1, width + 1))
    for r in range(rounds + 1):
        steps.append(f"near{r} AS MATERIALIZED (SELECT row, p, min(struct_pack(d := {gap}, e := e)) AS best FROM points JOIN book{r} USING (p) GROUP BY row, p)")
        if r < rounds:
            steps.append(f"mean{r} AS (SELECT p, best.e AS e, [{means}] AS c FROM near{r} JOIN points USING (row, p) GROUP BY p, best.e)")
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, e))")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY row),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (row), digest"""
