"""Lines that many documents share, found through levelled sorted runs of line hashes.

A run is a table of (line hash, documents that hold it, largest of them), bucketed and sorted by the hash.  The documents
come in batches, largest ids first.  The lines of a batch are counted, then anti-joined with the runs: what a run
already has as common, with a larger holder, can't change any more and is left out; the rest becomes a run of its own.
``fan`` runs of one level are compacted into one of the next.  Runs and batches have the same buckets, so that
neither anti-joins nor compactions shuffle the runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.shared import forget, parallel, settled, shared_folder, small_batches, whole_row

_FOLD = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))
_BLANKS = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point

#: Bytes of texts in one batch that a task sends back.
SENT_BYTES = 4 << 20


def line_keys(text: bytes, least: int) -> list[bytes | None]:
    """128 bits of each line's key, None for keys of under ``least`` code points."""
    out: list[bytes | None] = []
    for line in text.translate(_FOLD).split(b"\n"):
        key = line.strip(_BLANKS) if len(line) >= least else b""
        long = len(key) >= least and (key.isascii() or len(key.translate(None, _CONTINUED)) >= least)
        out.append(blake2b(key, digest_size=16).digest() if long else None)
    return out


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column("text").cast(pa.binary()):
        yield value.as_py() or b""


def _keys(least: int):
    """A row for each different key of each row of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [b"".join(dict.fromkeys(k for k in line_keys(text, least) if k)) for text in _texts(batch)]
            halves = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
            row = pa.array(np.repeat(np.arange(len(keys)), [len(k) // 16 for k in keys]))
            columns = {c: batch.column(c).take(row) for c in ("batch", "doc", "copy")}
            yield pa.record_batch(columns | {"h1": pa.array(halves[:, 0].copy()), "h2": pa.array(halves[:, 1].copy())})

    return run


_KEYS = "batch int, doc long, copy long, h1 long, h2 long"


@dataclass
class Runs:
    """Levels of runs: a level is one table, bucketed and sorted by hash, a run a partition of it; only names and counts are on the driver."""

    spark: SparkSession
    buckets: int
    fan: int = 4
    common: int = 3
    name: str = field(default_factory=lambda: f"line_runs_{uuid.uuid4().hex}")
    levels: list[int] = field(default_factory=list)  # runs of each level
    written: int = 0

    def _path(self, level: int) -> str:
        return f"{shared_folder(self.spark)}/{self.name}_{level}"

    def _level(self, level: int) -> DataFrame:
        return self.spark.table(f"{self.name}_{level}").drop("run")

    def _write(self, rows: DataFrame, level: int) -> None:
        rows = rows.withColumn("run", F.lit(self.written))
        rows.write.mode("append").partitionBy("run").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self._path(level)).saveAsTable(f"{self.name}_{level}")
        if level == len(self.levels):
            self.levels.append(0)
        self.levels[level] += 1
        self.written += 1

    def _empty(self, level: int) -> None:
        self.spark.sql(f"DROP TABLE {self.name}_{level}")
        gone = self.spark.range(0)
        gone.settled_path = self._path(level)
        forget(gone)
        self.levels[level] = 0

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("owner").alias("owner"))

    def add(self, keys: DataFrame) -> None:
        """Takes one batch of (h1, h2, doc); all rows of a document have to be in the same batch."""
        held = keys.where("doc is not null").select("h1", "h2", "doc").distinct()  # a document may have several rows
        new = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("owner")).alias("new")
        for level in (i for i, runs in enumerate(self.levels) if runs):
            run = self._level(level).where(F.col("n") >= self.common).alias("run")
            known = (F.col("new.h1") == F.col("run.h1")) & (F.col("new.h2") == F.col("run.h2")) & (F.col("run.owner") > F.col("new.owner"))
            new = new.join(run.hint("merge"), known, "left_anti").alias("new")
        self._write(new, 0)
        level = 0
        while self.levels[level] >= self.fan:
            self._write(self._merged(self._level(level)), level + 1)
            self._empty(level)
            level += 1

    def shared_lines(self) -> DataFrame:
        """(h1, h2, n, owner) of the keys that enough documents hold; settled, after which the runs are gone."""
        top = len(self.levels) - 1
        for level in range(top):  # what is left below goes up, as one more run of the next level
            if self.levels[level]:
                self._write(self._merged(self._level(level)), level + 1)
                self._empty(level)
        out = settled(self._merged(self._level(top)).where(F.col("n") >= self.common))
        self._empty(top)
        return out


def _pruned(least: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, int, int]] = []
            first, size = 0, 0
            drops = batch.column("drops")
            for i, text in enumerate(_texts(batch)):
                lines, gone = text.split(b"\n"), drops[i].as_py()
                kept = lines
                if gone:
                    keys = set(gone)
                    kept = [line for line, key in zip(lines, line_keys(text, least), strict=True) if key not in keys]
                out.append((text if len(kept) == len(lines) else b"\n".join(kept), len(lines), len(lines) - len(kept)))
                size += len(out[-1][0])
                if size >= SENT_BYTES or i == batch.num_rows - 1:
                    kept_texts, n_lines, n_dropped = zip(*out, strict=True)
                    columns = {kind: batch.column(kind).slice(first, len(out)), "kept": pa.array(kept_texts, pa.binary()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
                    yield pa.record_batch(columns)
                    out, first, size = [], i + 1, 0

    return run


def drop_shared_lines(docs: DataFrame, common: int = 3, least: int = 20, batches: int = 8, fan: int = 4, carry: bool = False) -> DataFrame:
    """doc_id (or the whole row as ``document``, with ``carry``), kept (text, binary), n_lines, n_dropped.

    A key is a line without ASCII white space at both ends, A-Z lower-cased.  Keys of at least ``least`` code points in
    at least ``common`` documents stay in the largest doc_id that holds them, with all their lines there, and go
    elsewhere.  Null and empty texts are one empty line.  Repeated rows of a doc_id count as one document and each
    gives a row.  Rows without doc_id hold nothing: they lose every common line.  Other columns don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []  # a few numbers
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + F.when(F.col("doc_id") <= cut, 1).otherwise(0)  # the largest ids come first
    doc, copy = F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("copy")
    keys = docs.select(batch.alias("batch"), doc, copy, "text").mapInArrow(_keys(least), _KEYS)
    keys = settled(keys)
    runs = Runs(spark, parallel(spark), fan, common)
    for number in range(len(cuts) + 1):
        runs.add(keys.where(F.col("batch") == number).select("h1", "h2", "doc"))
    shared = runs.shared_lines()
    lost = keys.join(shared, ["h1", "h2"]).where(F.col("doc").isNull() | (F.col("doc") < F.col("owner")))
    lists = lost.groupBy("doc", "copy").agg(F.collect_set(F.concat(*[F.unhex(F.lpad(F.hex(h), 16, "0")) for h in ("h1", "h2")])).alias("drops"))
    lists = settled(lists)
    forget(keys, shared)
    kind = "document" if carry else "doc_id"
    rows = docs.select(whole_row(docs) if carry else F.col("doc_id"), doc, copy, "text")
    joined = rows.join(lists.select(F.col("doc").alias("of"), F.col("copy").alias("as"), "drops"), F.col("doc").eqNullSafe(F.col("of")) & (F.col("copy") == F.col("as")), "left")
    schema = joined.select(kind).schema.add("kept", "binary").add("n_lines", "long").add("n_dropped", "long")
    return joined.select(kind, "text", "drops").mapInArrow(_pruned(least, kind), schema)


ORACLE = r"""WITH l AS (
  SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, i, line, owner IS NOT NULL AND doc_id <> owner AS gone FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
