"""Near-duplicates by SimHash fingerprints and BK-trees.

1. Every whole text gets a 64-bit fingerprint: a bit is set where more than
   half of the XXH64 values of its word shingles have it set.
2. Two fingerprints that differ in at most ``radius`` bits agree on at least
   ``blocks - radius`` of ``blocks`` bit blocks.  Every distinct fingerprint
   is therefore sent, once for each choice of that many blocks, to the shard
   named by the choice and the bits in them; each pair to be linked meets in
   some shard.  The number of blocks grows with the number of fingerprints,
   so that shards stay small (``choose_blocks``).
3. In a shard a BK-tree (children keyed by their integer Hamming distance to
   the parent) is searched with every member, following only edges within
   the radius of the distance at hand.  A shard with more members than
   ``max_members`` is split into several trees, and its members are
   broadcast to each of them, so no task holds more than a bounded group.
4. A task reports links as a spanning forest of what it found (each
   fingerprint to the least one that it is connected with), never as all
   pairs; the links of all tasks are joined into components by alternating
   large-star and small-star steps on staged tables.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.common import drop_stage, map_texts, shuffle_partitions, stage, table

SHINGLE_WORDS = 4
RADIUS = 4
#: The fewest bit blocks; more are taken where the shards would be too large.
BLOCKS = 6
#: Fingerprints that a shard should hold on the average, at most.
SHARD_MEMBERS = 512
#: Members of one BK-tree; larger shards are split.
MAX_MEMBERS = 2048
#: Pairs of (query, tree node) held at once in a search.
FRONTIER = 1 << 20
_SEED = 42


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text (null or no words: zero)."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and the white
    # space \x20 \x09-\x0d
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    body = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    if len(parts) <= words:
        spans = [body]
    else:
        starts = [0, *(ends[:-words]).tolist()]
        spans = [body[i:j] for i, j in zip(starts, (ends[words - 1:] - 1).tolist())]
    hashes = np.array([xxhash.xxh64_intdigest(s, _SEED) for s in spans], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8),
                              axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: list[str], words: int = SHINGLE_WORDS) -> DataFrame:
    """``keep`` columns and ``fp`` (the fingerprint's bits as a signed long)."""
    return map_texts(docs, _print_column(words), "fp long", keep)


def _print_column(words: int):
    def run(texts):
        fp = np.array([fingerprint(t, words) for t in texts], np.uint64)
        return {"fp": pa.array(fp.view(np.int64))}

    return run


# -- BK-trees over many shards at once ---------------------------------------

class BKForest:
    """One BK-tree for each group of ``group`` (sorted), built level by level:
    the first member that reaches a (node, distance) edge becomes the node
    there, the others go on from it."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        n = len(fp)
        self.fp = fp
        roots = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
        self.root = np.repeat(roots, np.diff(np.concatenate([roots, [n]]))) if n else roots
        parent, edge = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        todo = np.flatnonzero(self.root != np.arange(n))
        at = self.root[todo]
        while len(todo):
            key = at * 65 + np.bitwise_count(fp[todo] ^ fp[at]).astype(np.int64)
            _, first, where = np.unique(key, return_index=True, return_inverse=True)
            child = todo[first]
            parent[child], edge[child] = at[first], key[first] % 65
            rest = np.ones(len(todo), bool)
            rest[first] = False
            at = child[where[rest]]
            todo = todo[rest]
        # children in order of (parent, edge): a range of edges is contiguous
        self.child = np.lexsort((edge, parent))
        self.child = self.child[parent[self.child] >= 0]
        self.key = parent[self.child] * 65 + edge[self.child]

    def search(self, query: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query index, node) within ``radius``; ``query`` holds
        fingerprints and ``root`` the tree that each one searches."""
        stack = [(np.arange(i, min(i + FRONTIER, len(query))), root[i:i + FRONTIER])
                 for i in range(0, len(query), FRONTIER)]
        while stack:
            who, node = stack.pop()
            d = np.bitwise_count(query[who] ^ self.fp[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield who[hit], node[hit]
            low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right")
            width = high - low
            reach = np.cumsum(width)
            begin = 0
            while begin < len(who):  # parts of at most FRONTIER next pairs
                base = reach[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(reach, base + FRONTIER, side="right")))
                w = width[begin:end]
                if total := int(w.sum()):
                    offset = np.arange(total) - np.repeat(np.cumsum(w) - w, w)
                    stack.append((np.repeat(who[begin:end], w),
                                  self.child[np.repeat(low[begin:end], w) + offset]))
                begin = end


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of ``a[i]`` and ``b[i]`` in the forest ``parent`` (every
    entry points at its set's least member afterwards)."""
    while True:
        pa_, pb = parent[a], parent[b]
        open_ = pa_ != pb
        if not open_.any():
            return
        a, b, pa_, pb = a[open_], b[open_], pa_[open_], pb[open_]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def shard_links(fp: np.ndarray, group: np.ndarray, member: np.ndarray, ask: np.ndarray,
                radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least one connected with it) found in whole shards.

    Rows are sorted by ``group``; rows with ``member`` are in the shard's
    tree, rows with ``ask`` search it.
    """
    inside = np.flatnonzero(member)
    if not len(inside):
        return np.zeros(0, fp.dtype), np.zeros(0, fp.dtype)
    forest = BKForest(fp[inside], group[inside])
    trees, first = np.unique(group[inside], return_index=True)
    slot = np.minimum(np.searchsorted(trees, group), len(trees) - 1)
    asks = np.flatnonzero(ask & (trees[slot] == group))
    parent = np.arange(len(fp))
    for who, node in forest.search(fp[asks], first[slot[asks]], radius):
        hook(parent, asks[who], inside[node])
    moved = np.flatnonzero(fp[parent] != fp)
    return fp[moved], fp[parent[moved]]


# -- routing and components -------------------------------------------------

def block_masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of all choices of ``blocks - radius`` bit blocks."""
    if not radius < blocks <= 64:
        raise ValueError("more blocks than differing bits are needed")
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (j - i)) - 1) << i for i, j in zip(cuts, cuts[1:])]
    return [sum(c) for c in itertools.combinations(parts, blocks - radius)]


def choose_blocks(prints: int, radius: int = RADIUS, least: int = BLOCKS, members: int = SHARD_MEMBERS) -> int:
    """The fewest blocks for which evenly spread fingerprints make shards of
    ``members`` on the average: more blocks name a shard by more bits, at the
    price of more copies of every fingerprint.  The links are the same."""
    blocks = max(least, radius + 1)
    while blocks < 16 and prints >> (64 * (blocks - radius) // blocks) > members:
        blocks += 1
    return blocks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _shards(prints: DataFrame, masks: list[int]) -> DataFrame:
    """One row (table, bits, fp) for every choice of blocks."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"))
                     for t, m in enumerate(masks)])
    return prints.select("fp", F.explode(keys).alias("s")).select("s.t", "s.k", "fp")


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None,
               max_members: int = MAX_MEMBERS) -> DataFrame:
    """Links (a, b) whose components are those of the distinct fingerprints
    ``prints`` under "at most ``radius`` differing bits"; ``blocks`` is
    chosen from their number if it is not given."""
    blocks = blocks or choose_blocks(prints.count(), radius)
    rows = _shards(prints, block_masks(blocks, radius))
    large = stage(rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_members)
                  .select("t", "k", F.ceil(F.col("n") / max_members).cast("int").alias("trees")))
    # a large shard of m trees: a task for each pair of trees (i <= j) holds
    # the tree j and the members of i that ask it
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("trees")).cast("int")
    routed = (rows.join(large, ["t", "k"], "left")
              .withColumn("trees", F.coalesce("trees", F.lit(1)))
              .withColumn("own", own)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
              .select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                      (F.col("own") >= F.col("other")).alias("member"),
                      (F.col("own") <= F.col("other")).alias("ask"), "fp"))
    n = max(shuffle_partitions(prints.sparkSession), 1)
    sorted_rows = routed.repartition(n, *_GROUP).sortWithinPartitions(*_GROUP, "fp")

    def search(batches):
        for fp, group, member, ask in _whole_groups(batches):
            a, b = shard_links(fp, group, member, ask, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                             names=["a", "b"])

    return sorted_rows.mapInArrow(search, "a long, b long").distinct()


_GROUP = ["t", "k", "i", "j"]


def _whole_groups(batches, target: int = 50_000):
    """(fp, group number, member, ask) of whole shards, about ``target`` rows at
    a time; a shard that goes on in the next batch is carried over."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < target:
                continue
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        keys = [t.column(c).to_numpy() for c in _GROUP]
        new = np.zeros(len(keys[0]), bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        end = len(new)
        if batch is not None:
            end = int(np.flatnonzero(new)[-1])
            if not end:
                target = rows * 2  # one shard so far: read on
                held = t.to_batches()
                continue
        fp = t.column("fp").to_numpy().view(np.uint64)
        member, ask = (t.column(c).to_numpy()[:end] for c in ("member", "ask"))
        yield fp[:end], np.cumsum(new)[:end], member, ask
        held = t.slice(end).to_batches()
        rows = len(new) - end


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least
    node of its component.  Alternating large-star and small-star steps;
    every round is a staged table, so lineage does not grow, and the tables of
    the round before are deleted."""
    edges = stage(links.filter("a != b"))
    state = (0, None)  # no links: nothing to settle
    for _ in range(max_rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a table of its own, so that a hub's edges can be split in the join
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        # large star: greater neighbours of a node go to its least neighbour
        large = (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a != b").distinct())
        # small star: smaller neighbours and the node itself go to the least
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b")))
                 .filter("a != b").distinct())
        before, edges = edges, stage(small)
        for done in (before, least):  # the new table holds all that is needed
            drop_stage(done)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def with_roots(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None,
               max_members: int = MAX_MEMBERS) -> DataFrame:
    """``nodes`` (one row a fingerprint ``fp``) and ``root``, the least
    fingerprint of its component."""
    comps = connected_components(near_links(nodes.select("fp"), radius, blocks, max_members))
    return (nodes.join(comps, nodes.fp == comps.node, "left")
            .select(*nodes.columns, F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, keep: list[str], key: str = "doc_id", words: int = SHINGLE_WORDS,
                    radius: int = RADIUS, blocks: int | None = None, max_members: int = MAX_MEMBERS) -> DataFrame:
    """``keep`` columns, ``fp`` and ``component_id`` (the least ``key`` among
    all rows whose fingerprints are linked, directly or over others).

    Null and empty texts have fingerprint zero and are linked like any
    other; very long texts are read whole; repeated rows keep their own output
    row; a null key takes no part in the minimum (a component of null keys only
    has a null id), equal keys share it; an empty table gives no rows.  Columns
    outside ``keep`` are not read; one in ``keep`` that is named ``fp`` gives
    way to the fingerprint, and ``root`` and ``component_id`` must not be in it.
    """
    prints = stage(fingerprints(docs.select(*keep, *([key] if key not in keep else []), "text"),
                                list(dict.fromkeys([*keep, key])), words))
    # one row a fingerprint: copies do not travel further
    nodes = stage(prints.groupBy("fp").agg(F.min(key).alias("_low")))
    rooted = with_roots(nodes, radius, blocks, max_members)
    lows = rooted.groupBy("root").agg(F.min("_low").alias("component_id"))
    classes = rooted.join(lows, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(*keep, "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, the one with the
    least doc_id (of equal ids the one of the least fingerprint, then of the
    least text hash; a null id only where the group has no other).

    Null and empty texts are one group; repeated rows leave one; an empty
    table gives no rows; long texts are read whole; all columns come back as
    they were, whatever their names.

    Whole rows are written once, with fingerprint and place; representatives
    are chosen on narrow rows, and the places of the rows that go are a table
    of their own, which Spark broadcasts where it is small by its size on
    disk: then no text is shuffled.
    """
    # columns by place, so that none clashes with fp or root
    names = [f"_{i}" for i in range(len(docs.columns))]
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    printed = stage(map_texts(docs.toDF(*names), _print_column(SHINGLE_WORDS), "fp long", names, text)
                    .withColumn("text_hash", F.xxhash64(F.col(text)))
                    .withColumn("place", F.monotonically_increasing_id()))
    # a group is named by its root, never by an id: ids may repeat or be null
    low = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), "text_hash", "place")
    nodes = stage(printed.groupBy("fp").agg(F.min(low).alias("low")))
    first = F.struct("low.no_id", "low.id", "fp")
    kept = with_roots(nodes).groupBy("root").agg(F.min_by("low.place", first).alias("place"))
    gone = stage(printed.select("place").join(kept, "place", "left_anti"))
    return printed.join(gone, "place", "left_anti").select(*names).toDF(*docs.columns)
