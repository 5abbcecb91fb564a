"""N-gram Jaccard join with several global token orders.

Texts are sets of word-shingle hashes.  If two sets of n and m tokens have a
Jaccard similarity of t or more, then under ANY total order of all tokens their
prefixes of n - ceil(t n) + 1 and m - ceil(t m) + 1 tokens share a token.  Three
orders are used: by document frequency, by the logarithm of the frequency, and
with all repeated tokens equal, each with its own hash order among equals.
Tokens that only one set has come first in all of them, so a set whose prefix is
made up of such tokens has no partner and is never looked at again; the others
are candidates where they share a prefix token of the first order, if their
prefixes can overlap in every other order as well (the filters intersect as
pairs are made, by bitmaps of the prefixes, and exactly before a pair is
verified), and what is left is verified on the whole sets.

How it is laid out:

* Equal sets are one class from the start (its hash is the node), so copies
  cost nothing further.
* Frequencies are counted in one shuffle of packed tokens, dealt by token; only
  repeated tokens come back, dealt by node.  Tokens and classes that a bounded
  sample shows to be hot don't go through that shuffle: a hot token is known to
  be repeated, and its sample count places it behind all others (any order is
  right as long as it is one), a hot class is sent once, from the sample.
* Only components are asked for, so links inside a component needn't be tested
  again.  Rounds of stars come first, while they save more pairs than they cost:
  each bucket of a prefix token has a pivot, and each node tests the pivots of a
  few buckets that aren't known to be in its component; then linked labels become
  one and buckets of a single label are dropped.  The first round goes over all
  buckets, the others over the crowded ones only, with several pivots in each:
  there the pieces of a large component would meet in very many pairs.  All
  pairs of different labels that are left are tested, with length, positional
  and bitmap filters.  No link between components is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm import textkit
from orrery.llm.graph import components
from orrery.llm.shared import forget, free_name, release, settled, small_batches

SHINGLE = 5
#: Similarity in hundredths.
THRESHOLD = 75
#: Tokens that one counting task gets, about, and packed bytes of them that it sorts at once.
BUCKET_TOKENS, SLICE_BYTES = 4_000_000, 4 << 20
#: Counting tasks at least.
LEAST_PARTS = 8
#: The sample that finds hot tokens and classes, and the count there that makes one.
SAMPLE_ROWS, HOT = 1024, 8
#: Star rounds at most, and how many pairs a row a round has to save: fewer would be left as pairs of the last join, whose
#: number grows with the square of a component that is in pieces.
STAR_ROUNDS, FEW_PAIRS = 10, 1
#: Buckets of a node that a round draws: two in the first, which join most of a large component, then twice as many up to this.
DRAWN = 8
#: From the second round on: rows of a bucket that make it a crowded one, and pivots of a bucket.
CROWD, PIVOTS = 8, 4
#: Places in the bitmap that bounds a pair's overlap before whole sets are compared.
BITS = 1024
#: Places of the bitmaps that tell whether prefixes of the other orders can share a token.
PREFIX_BITS = 128

_DF_BITS = np.uint64(16)
_MOST_DF = 65535
_HOT_DF = 60000
_TOKEN = np.uint64(0xFFFFFFFFFFFF)


def prefix_length(n, threshold: int = THRESHOLD):
    """Of a set of n tokens; numbers or arrays."""
    return n - (-(-n * threshold // 100)) + 1


def shingle_sets(words: textkit.Words, size: int) -> Iterator[np.ndarray]:
    """For each row its distinct 48-bit tokens, ascending; a shorter row's words are one token."""
    hashes = words.hashes()
    grams = textkit.grams(hashes, size) >> np.uint64(16)
    for first, count in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
        if count >= size:
            tokens = np.sort(grams[first : first + count - size + 1])
            yield tokens[np.append(True, tokens[1:] != tokens[:-1])]
        elif count:
            yield textkit.grams(hashes[first : first + count], count) >> np.uint64(16)
        else:
            yield np.zeros(0, np.uint64)


def node_of(tokens: np.ndarray) -> int:
    """The class of a set: a 64-bit hash of its tokens, as a signed long."""
    mixed = textkit.mix(tokens + np.uint64(len(tokens)))
    both = (int(mixed.sum(dtype=np.uint64)) + 3 * int(np.bitwise_xor.reduce(mixed))) % (1 << 64)
    return int(textkit.mix(np.array([both], np.uint64)).view(np.int64)[0])


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in textkit.text_chunks(batches, "text", textkit.SOLID, True):
            n, nodes = [], []
            for tokens in shingle_sets(words, size):
                n.append(len(tokens))
                nodes.append(node_of(tokens) if len(tokens) else None)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "n": pa.array(n, pa.int64()), "node": pa.array(nodes, pa.int64())})

    return run


def _pack(nodes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> bytes:
    """Runs of tokens by node: 6 bytes a token, and 11 a run while sizes and counts fit two bytes and one, else up to 14.

    Each node's tokens are spread over all parts, so with many parts most runs are short and their heads count.
    """
    size_kind, count_kind = ("<u2" if sizes.max() < 1 << 16 else "<u4"), ("<u1" if counts.max() < 1 << 8 else "<u2")
    head = np.array([len(nodes), int(size_kind == "<u4"), int(count_kind == "<u2")], "<u4").tobytes()
    six = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return head + nodes.astype("<i8").tobytes() + sizes.astype(size_kind).tobytes() + counts.astype(count_kind).tobytes() + six


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, set size and token of each packed token."""
    runs, wide_sizes, wide_counts = np.frombuffer(blob, "<u4", 3).tolist()
    at = 12
    nodes = np.frombuffer(blob, "<i8", runs, at)
    at += 8 * runs
    sizes = np.frombuffer(blob, "<u4" if wide_sizes else "<u2", runs, at)
    at += sizes.nbytes
    counts = np.frombuffer(blob, "<u2" if wide_counts else "<u1", runs, at)
    at += counts.nbytes
    six = np.frombuffer(blob, np.uint8, offset=at).reshape(-1, 6)
    tokens = np.zeros((len(six), 8), np.uint8)
    tokens[:, :6] = six
    return np.repeat(nodes, counts), np.repeat(sizes.astype(np.uint32), counts), tokens.view("<u8").ravel().astype(np.uint64)


class Hot:
    """What the sample shows to be hot: tokens with their counts, and classes, which are left out of the stream."""

    def __init__(self, sets: list[np.ndarray], hot: int):
        nodes = Counter(node_of(t) for t in sets if len(t))
        once = {node_of(t): t for t in sets if len(t)}
        self.classes = {n: once[n] for n, c in nodes.items() if c >= hot}
        every = np.concatenate([*once.values(), np.zeros(0, np.uint64)])
        tokens, counts = np.unique(every, return_counts=True)
        self.tokens, self.counts = tokens[counts >= hot], counts[counts >= hot]

    def split(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the hot token, and whether it is one."""
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        at = np.searchsorted(self.tokens, tokens)
        at[at == len(self.tokens)] = 0
        return at, self.tokens[at] == tokens

    def frequency(self, number: np.ndarray) -> np.ndarray:
        return np.minimum(_HOT_DF + self.counts[number], _MOST_DF).astype(np.uint64)


_ENTRY = np.dtype([("node", "<i8"), ("size", "<u4"), ("token", "<u8")])
_PARTS = pa.schema([("part", pa.int32()), ("blob", pa.binary())])


def _deal_entries(entries: np.ndarray, parts: int) -> pa.RecordBatch:
    """Entries (node, size, token and frequency in one word) as a blob for each part of the nodes."""
    part = textkit.mix(entries["node"].astype(np.uint64)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    entries, part = entries[order], part[order]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    blobs = [e.tobytes() for e in np.split(entries, cuts[1:])] if len(part) else []
    return pa.record_batch([pa.array(part[cuts].astype(np.int32), pa.int32()), pa.array(blobs, pa.binary())], schema=_PARTS)


def _deal_tokens(shared, size: int, parts: int, hot_parts: int):
    """Rows (kind 0: tokens for counting, dealt by token; kind 1: entries of hot tokens, dealt by node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: Hot = shared.value
        done: set[int] = set()
        for _, words in textkit.text_chunks(batches, "text", textkit.SOLID, True):
            sets, nodes = [], []
            for tokens in shingle_sets(words, size):
                node = node_of(tokens) if len(tokens) else 0
                if len(tokens) and node not in hot.classes and node not in done:
                    done.add(node)
                    sets.append(tokens)
                    nodes.append(node)
            if sets:
                yield _dealt(hot, sets, nodes, parts, hot_parts)

    return run


def _dealt(hot: Hot, sets: list[np.ndarray], nodes: list[int], parts: int, hot_parts: int) -> pa.RecordBatch:
    sizes = np.array([len(s) for s in sets], np.uint32)
    tokens, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    node = np.array(nodes, np.int64)
    number, is_hot = hot.split(tokens)
    out_kind, out_part, out_blob = [], [], []
    if is_hot.any():
        r = row[is_hot]
        entries = np.empty(len(r), _ENTRY)
        entries["node"], entries["size"] = node[r], sizes[r]
        entries["token"] = (tokens[is_hot] << _DF_BITS) | hot.frequency(number[is_hot])
        dealt = _deal_entries(entries, hot_parts)
        out_kind += [1] * dealt.num_rows
        out_part += dealt.column(0).to_pylist()
        out_blob += dealt.column(1).to_pylist()
        tokens, row = tokens[~is_hot], row[~is_hot]
    part = (tokens % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")  # rows stay in order within a part
    tokens, row, part = tokens[order], row[order], part[order]
    ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)) if len(part) else []
    begin = 0
    for end in ends:
        r = row[begin:end]
        starts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        counts = np.diff(np.append(starts, len(r)))
        wide = counts > 65535
        if wide.any():  # a run's count has 16 bits: longer ones go as several
            starts = np.concatenate([np.arange(s, s + c, 65535) for s, c in zip(starts, counts, strict=True)])
            counts = np.diff(np.append(starts, len(r)))
        out_kind.append(0)
        out_part.append(int(part[begin]))
        out_blob.append(_pack(node[r[starts]], sizes[r[starts]], counts, tokens[begin:end]))
        begin = end
    return pa.record_batch({"kind": pa.array(out_kind, pa.int8()), "part": pa.array(out_part, pa.int32()), "blob": pa.array(out_blob, pa.binary())})


def _repeated(parts: int):
    """Of one task's tokens those that several nodes have, with their frequency, dealt by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list] = {}
        for batch in batches:
            for kind, part, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "blob")), strict=True):
                if kind:
                    yield pa.record_batch([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], schema=_PARTS)
                else:
                    by_part.setdefault(part, []).append(blob)
        for part in sorted(by_part):
            blobs = by_part.pop(part)
            slices = max(1, sum(map(len, blobs)) // SLICE_BYTES)
            for k in range(slices):
                entries = _several(blobs, parts, slices, k)
                if len(entries):
                    yield _deal_entries(entries, parts)

    return run


def _several(blobs: list[bytes], parts: int, slices: int, k: int) -> np.ndarray:
    """The tokens of a slice of a part that several nodes have, as entries."""
    kept = []
    for blob in blobs:
        node, size, token = _unpack(blob)
        mine = (token // np.uint64(parts)) % np.uint64(slices) == k
        kept.append((node[mine], size[mine], token[mine]))
    node, size, token = (np.concatenate([u[i] for u in kept]) for i in range(3))
    order = np.lexsort((node, token))
    node, size, token = node[order], size[order], token[order]
    fresh = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))[: len(token)]
    node, size, token = node[fresh], size[fresh], token[fresh]
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])
    df = np.diff(np.append(starts, len(token)))
    df = np.repeat(df, df)
    many = df > 1
    entries = np.empty(int(many.sum()), _ENTRY)
    entries["node"], entries["size"] = node[many], size[many]
    entries["token"] = (token[many] << _DF_BITS) | np.minimum(df[many], _HOT_DF - 1).astype(np.uint64)
    return entries


def _bitmap(words: np.ndarray) -> np.ndarray:
    """Parities of a set's repeated tokens in BITS buckets.

    Two sets of r and s such tokens whose bitmaps differ in h places share
    (r + s - h) / 2 of them at most.
    """
    spread = textkit.mix((words >> _DF_BITS) + np.uint64(11)) % np.uint64(BITS)
    parity = np.bincount(spread.astype(np.int64), minlength=BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view("<i8")


def _prefix_bits(words: np.ndarray, length: int) -> np.ndarray:
    """Which of PREFIX_BITS places the ``length`` first tokens of the second and of the third order fall into."""
    out = np.zeros(2 * PREFIX_BITS, np.uint8)
    for order, keys in enumerate(_other_orders(words)):
        least = np.argpartition(keys, length - 1)[:length] if length < len(keys) else slice(None)
        spread = textkit.mix((words[least] >> _DF_BITS) + np.uint64(29)) % np.uint64(PREFIX_BITS)
        out[order * PREFIX_BITS + spread.astype(np.int64)] = 1
    return np.packbits(out).view("<i8")


def _profiles(threshold: int):
    """Nodes that can have partners: set size, and their repeated tokens in the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list] = {}
        for batch in batches:
            for part, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "blob")), strict=True):
                by_part.setdefault(part, []).append(blob)
        for part in sorted(by_part):
            entries = np.frombuffer(b"".join(by_part.pop(part)), _ENTRY)
            df, token = entries["token"] & np.uint64(_MOST_DF), entries["token"] >> _DF_BITS
            order = np.lexsort((token, df, entries["node"]))
            node, size, word = entries["node"][order], entries["size"][order].astype(np.int64), entries["token"][order]
            fresh = np.append(True, (word[1:] != word[:-1]) | (node[1:] != node[:-1]))
            node, size, word = node[fresh], size[fresh], word[fresh]
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            counts = np.diff(np.append(starts, len(node)))
            n = size[starts]
            can = np.flatnonzero(n - counts < prefix_length(n, threshold))
            blobs = [word[s : s + c].tobytes() for s, c in zip(starts[can], counts[can], strict=True)]
            heads = [(word[s : s + p - (m - c)] >> _DF_BITS).astype(np.int64) for s, c, m, p in zip(starts[can], counts[can], n[can], prefix_length(n[can], threshold), strict=True)]
            bits = [_bitmap(word[s : s + c]) for s, c in zip(starts[can], counts[can], strict=True)]
            others = [_prefix_bits(word[s : s + c], p - (m - c)) for s, c, m, p in zip(starts[can], counts[can], n[can], prefix_length(n[can], threshold), strict=True)]
            yield pa.record_batch({"node": pa.array(node[starts[can]], pa.int64()), "n": pa.array(n[can], pa.int64()), "tokens": pa.array(blobs, pa.binary()), "shared": pa.array(counts[can], pa.int64()), "bits": pa.array(bits, pa.list_(pa.int64())), "others": pa.array(others, pa.list_(pa.int64())), "head": pa.array(heads, pa.list_(pa.int64()))})

    return run


def _other_orders(words: np.ndarray) -> list[np.ndarray]:
    """Sort keys of the second and third order."""
    token, df = words >> _DF_BITS, (words & np.uint64(_MOST_DF)).astype(np.float64)
    second = (np.log2(df).astype(np.uint64) << np.uint64(48)) | (textkit.mix(token ^ np.uint64(0xA5A5)) >> np.uint64(16))
    third = textkit.mix(token ^ np.uint64(0x5A5A5A))
    return [second, third]


def linked(n: int, a: np.ndarray, m: int, b: np.ndarray, threshold: int) -> bool:
    """Do two sets, given by size and repeated tokens, meet the threshold?  The orders' prefixes first, then the whole sets."""
    need = -(-threshold * (n + m) // (100 + threshold))
    if min(len(a), len(b)) < need:
        return False
    p, q = prefix_length(n, threshold) - (n - len(a)), prefix_length(m, threshold) - (m - len(b))
    for x, y in zip(_other_orders(a), _other_orders(b), strict=True):
        if not len(np.intersect1d(np.partition(x, p - 1)[:p] if p < len(x) else x, np.partition(y, q - 1)[:q] if q < len(y) else y, assume_unique=True)):
            return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= threshold * (n + m - shared)


def _verify(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(n, np.frombuffer(x, np.uint64), m, np.frombuffer(y, np.uint64), threshold) for n, x, m, y in zip(*(batch.column(c).to_pylist() for c in ("n", "x", "m", "y")), strict=True)]
            keep = pa.array(good, pa.bool_())
            yield pa.record_batch({"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)})

    return run


def _may_overlap(a: str, b: str, threshold: int):
    """Do the bitmaps of two sides (structs n, shared, bits) allow the overlap that a link needs?"""
    differ = F.lit(0)
    for i in range(BITS // 64):
        differ = differ + F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i]))
    return (F.col(f"{a}.shared") + F.col(f"{b}.shared") - differ) * (100 + threshold) >= 2 * threshold * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _may_share_prefixes(a: str, b: str):
    """Can the prefixes of two sides have a token in common in each of the other orders?  Both orders' filters are met before a pair is made."""
    width = PREFIX_BITS // 64
    met = F.lit(True)
    for order in range(2):
        common = F.lit(0).cast("long")
        for i in range(order * width, (order + 1) * width):
            common = common.bitwiseOR(F.col(f"{a}.others")[i].bitwiseAND(F.col(f"{b}.others")[i]))
        met = met & (common != 0)
    return met


def verified(pairs: DataFrame, profiles: DataFrame, threshold: int) -> DataFrame:
    """The linked ones of pairs (a, b) of nodes; ``pairs`` should be those only whose bitmaps allow it."""
    left = pairs.select("a", "b").join(profiles.select(F.col("node").alias("a"), "n", F.col("tokens").alias("x")), "a")
    both = left.join(profiles.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "n", "x", "m", "y").mapInArrow(_verify(threshold), "a long, b long")


def _likely(pairs: DataFrame, profiles: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose bitmaps allow a link."""
    side = lambda node, name: profiles.select(F.col("node").alias(node), F.struct("n", "shared", "bits").alias(name))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(_may_overlap("x", "y", threshold)).select(pairs.columns)


def _long_enough(n: str, m: str, threshold: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * threshold


def cross_pairs(rows: DataFrame) -> float:
    """Pairs of different components in the buckets, each bucket counted."""
    by_label = rows.groupBy("token", "label").agg(F.count(F.lit(1)).cast("double").alias("c"))
    by_token = by_label.groupBy("token").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("p"))
    return by_token.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("p")).first()["p"]


def _pivot_pairs(rows: DataFrame, profiles: DataFrame, seed: int, threshold: int) -> DataFrame:
    """For each node the pivots of a few of its buckets that have other labels, if the bitmaps allow a link: (a, b, label, to).

    In the first round (seed 0) buckets are drawn by hash, so that alike sets mostly draw alike, and so are pivots among a
    bucket's nodes, so that large components are met most.  Later what is left of a large component are mostly single
    nodes that link with a part of it only, so crowded buckets alone are looked at, and each draws pivots of its own.
    """
    if seed:
        return _crowd_pairs(rows, profiles, seed, threshold)
    pivots = rows.groupBy("token").agg(_least(F.xxhash64("node", F.lit(seed)))).select("token", "pivot.*")
    met = settled(_drawn(rows, seed), True).join(settled(pivots, True), "token").where((F.col("label") != F.col("to")) & _long_enough("n", "m", threshold))
    tested = settled(met.select("a", "b", "label", "to").distinct(), True)
    likely = settled(_likely(tested, profiles, threshold), True)
    forget(tested)
    return likely


def _least(draw) -> Column:
    return F.min(F.struct(draw.alias("draw"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("label").alias("to"))).alias("pivot")


def _drawn(rows: DataFrame, seed: int) -> DataFrame:
    """(a, n, label, token): a few buckets of each node."""
    drawn = F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("token", F.lit(seed)).alias("draw"), "token"))), 1, min(DRAWN, 2 << seed))  # of one node's prefix
    return rows.groupBy(F.col("node").alias("a"), "n", "label").agg(drawn.alias("drawn")).select("a", "n", "label", F.explode("drawn.token").alias("token"))


def _crowd_pairs(rows: DataFrame, profiles: DataFrame, seed: int, threshold: int) -> DataFrame:
    """As _pivot_pairs, of crowded buckets; the filters are met before a pair is made."""
    crowded = settled(rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CROWD).select("token"), True)
    crowd = settled(rows.join(crowded, "token", "left_semi"), True)
    slot = F.pmod(F.xxhash64("token", "node", F.lit(-seed)), F.lit(PIVOTS))
    pivots = crowd.groupBy("token", slot.alias("slot")).agg(_least(F.xxhash64("node", "token", F.lit(seed)))).select("token", "pivot.b", "pivot.m", "pivot.to")
    side = lambda node, name: profiles.select(F.col("node").alias(node), F.struct("n", "shared", "others", "bits").alias(name))
    left = settled(_drawn(crowd, seed), True).join(side("a", "x"), "a")
    right = settled(pivots, True).join(side("b", "y"), "b")
    alike = (F.col("label") != F.col("to")) & _long_enough("x.n", "y.n", threshold) & _may_share_prefixes("x", "y") & _may_overlap("x", "y", threshold)
    likely = settled(left.join(right, "token").where(alike).select("a", "b", "label", "to").distinct(), True)
    forget(crowded, crowd)
    return likely


def _open(rows: DataFrame) -> DataFrame:
    """The rows of buckets of several labels: the others have nothing left to test."""
    mixed = settled(rows.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("token"), True)
    return rows.join(mixed, "token", "left_semi")


def _contracted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The open rows after linked labels have become one; only rows whose label moves are touched."""
    moved = settled(components(links.select("label", "to").distinct(), "label", "to").where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("parent")), True)
    stay = rows.join(moved, "label", "left_anti").select(rows.columns)
    go = rows.join(moved, "label").withColumn("label", F.col("parent")).select(rows.columns)
    return settled(_open(settled(stay.union(go))))


def candidate_pairs(rows: DataFrame, profiles: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of all pairs of different labels that the filters leave.

    The smaller set of a pair has the first shared prefix token among its first
    n - ceil(2 t n / (1 + t)) + 1 tokens (its index prefix), the larger one
    anywhere in its prefix; so a bucket without such a token is dropped, and
    pairs are made of index tokens and prefix tokens only.  They are made if
    sizes and places allow the overlap, if the prefixes of the other orders can
    share a token too, and if the bitmaps allow the overlap.  The most common
    label of a bucket never meets itself, so a bucket costs what its pairs of
    different labels do.
    """
    index = (F.col("n") - F.col("place")) * (100 + threshold) >= 2 * threshold * F.col("n")
    by_label = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"), F.max(index).alias("index"))
    buckets = by_label.groupBy("token").agg(F.max(F.struct("c", "label")).alias("most"), F.max("index").alias("index"), F.count(F.lit(1)).alias("labels"))
    buckets = settled(buckets.where("index and labels > 1").select("token", F.col("most.label").alias("major"), (F.col("most.c") > 1).alias("split")))
    side = profiles.select("node", F.struct("shared", "others", "bits").alias("set"))
    placed = settled(rows.join(buckets, "token").join(side, "node").withColumn("minor", ~F.col("split") | (F.col("label") != F.col("major"))).drop("major", "split"))
    role = lambda node, at, label, name, minor: [F.col("node").alias(node), F.col("place").alias(at), F.col("label").alias(label), F.struct("n", "set.*").alias(name), F.col("minor").alias(minor)]
    larger, smaller = placed.select("token", *role("a", "i", "from", "x", "a_minor")), placed.where(index).select("token", *role("b", "j", "to", "y", "b_minor"))
    n, m = F.col("x.n"), F.col("y.n")
    in_order = (m < n) | ((m == n) & (F.col("a") < F.col("b")))
    far_enough = F.least(n - F.col("i"), m - F.col("j")) * (100 + threshold) >= (n + m) * threshold
    alike = (F.col("from") != F.col("to")) & in_order & _long_enough("x.n", "y.n", threshold) & far_enough & _may_share_prefixes("x", "y") & _may_overlap("x", "y", threshold)
    met = larger.join(smaller.where("b_minor"), "token").where(alike).select("a", "b")
    if not buckets.where("split").isEmpty():
        met = met.union(larger.where("a_minor").join(smaller.where("not b_minor"), "token").where(alike).select("a", "b"))
    pairs = settled(met.distinct())
    forget(placed, buckets)
    return pairs


def link_components(profiles: DataFrame, threshold: int, star_rounds: int = STAR_ROUNDS, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """(node, label) of the nodes that have links; label is the component's least node."""
    spark = profiles.sparkSession
    shared = settled(profiles.select("node", "n", F.posexplode("head").alias("at", "token"), "shared").select("token", "node", "n", (F.col("n") - F.col("shared") + F.col("at")).alias("place")))
    rows = settled(_open(shared.withColumn("label", F.col("node"))))
    forget(shared)
    every, gain = [], None
    left = cross_pairs(rows)
    for step in range(star_rounds):
        worth = few_pairs * rows.count()
        if left <= worth or (gain is not None and gain <= worth):
            break
        likely = _pivot_pairs(rows, profiles, step, threshold)
        links = settled(verified(likely, profiles, threshold).join(likely, ["a", "b"]), True)
        if not links.isEmpty():
            every.append(links.select("a", "b"))
            before, rows = rows, _contracted(rows, links)
            forget(before)
        forget(likely)
        release(spark)
        gain, left = left - (now := cross_pairs(rows)), now
    pairs = candidate_pairs(rows, profiles, threshold)
    links = settled(verified(pairs, profiles, threshold))
    forget(rows, pairs)
    for more in every:
        links = links.union(more)
    return settled(components(links))


def _assigned(docs: DataFrame, doc_id: str, text: str, size: int, threshold: int, sample_rows: int, hot: int, star_rounds: int, few_pairs: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), n, component_id of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    body = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    body = body.withColumn("text_key", F.xxhash64("text"))
    sets = settled(body.mapInArrow(_describe(size), T.StructType([T.StructField("doc_id", body.schema["doc_id"].dataType), T.StructField("text_key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.LongType())])))
    total, rows = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    texts = body.where("doc_id is not null").select("doc_id", "text")
    sampled = texts.select("text").sample(min(1.0, sample_rows / max(rows, 1)), seed=1).collect()
    column = pa.array([r["text"] for r in sampled], pa.large_string())
    known = Hot([s for _, words in textkit.text_chunks(iter([pa.record_batch({"text": column})]), "text", textkit.SOLID, True) for s in shingle_sets(words, size)], hot)
    parts = max(LEAST_PARTS, -(-total // BUCKET_TOKENS))  # by tokens alone: more parts make shorter runs, whose heads are sent too
    shared = spark.sparkContext.broadcast(known)  # of a bounded sample
    dealt = texts.select("text").mapInArrow(_deal_tokens(shared, size, parts, parts), "kind byte, part int, blob binary")
    if known.classes:
        once = _dealt(known, list(known.classes.values()), list(known.classes), parts, parts)
        dealt = dealt.union(spark.createDataFrame(once.to_pandas(), "kind byte, part int, blob binary"))
    counted = dealt.repartition(parts, "part").mapInArrow(_repeated(parts), "part int, blob binary")
    profiles = settled(counted.repartition(parts, "part").mapInArrow(_profiles(threshold), "node long, n long, tokens binary, shared long, bits array<long>, others array<long>, head array<long>"))
    del dealt, counted
    release(spark)
    labels = link_components(profiles, threshold, star_rounds, few_pairs)
    classes = settled(sets.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least")))
    grouped = settled(classes.join(labels, "node").groupBy("label").agg(F.min("least").alias("component")))
    named = classes.join(labels, "node", "left").join(grouped, "label", "left").select("node", F.coalesce("component", "least").alias("component_id"))
    out = sets.join(settled(named), "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_key", "n", component.alias("component_id"))


def jaccard_components(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD, sample_rows: int = SAMPLE_ROWS, hot: int = HOT,
    star_rounds: int = STAR_ROUNDS, few_pairs: int = FEW_PAIRS,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id reachable over links).

    A null or wordless text has no shingles, is linked with nothing and is its
    own component.  Rows without doc_id are linked with nothing either and have
    no component.  Repeated rows each get a row.  An empty table gives none.
    Columns beside the named ones are ignored.  Tokens are 48 bits of a word
    n-gram's hash and classes 64 bits of a set's: equal hashes count as equal.
    """
    found = _assigned(docs, doc_id, text, size, threshold, sample_rows, hot, star_rounds, few_pairs)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the least doc_id.

    Of rows with that doc_id the one with the least hash of its text stays, of
    equal rows one.  Rows without doc_id all stay.
    """
    found = settled(_assigned(docs, doc_id, text, size, threshold, SAMPLE_ROWS, HOT, STAR_ROUNDS, FEW_PAIRS).where("doc_id = component_id"))
    heads = settled(found.groupBy("doc_id").agg(F.min("text_key").alias("text_key"), F.count(F.lit(1)).alias("rows")))
    head_id, head_key = (free_name(c, docs.columns) for c in ("head_id", "head_key"))
    named = heads.select(F.col("doc_id").alias(head_id), F.col("text_key").alias(head_key))
    key = F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    kept = docs.join(named, (F.col(f"`{doc_id}`") == F.col(head_id)) & (key == F.col(head_key)), "left_semi")
    if not heads.where("rows > 1").isEmpty():
        kept = kept.dropDuplicates([doc_id])
    nameless = docs.where(F.col(f"`{doc_id}`").isNull())
    return kept if nameless.isEmpty() else kept.union(nameless)
