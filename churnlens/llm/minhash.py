"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

1. Every whole text becomes its set of distinct word shingles and a bit
   signature: bit i is one bit of the least shingle under hash i, so two sets
   of similarity s differ in each bit with probability (1 - s) / 2.
2. The signature is split into chunks.  Two signatures that differ in at most
   ``chunks * (errors + 1) - 1`` bits have a chunk that differs in at most
   ``errors`` bits (pigeonhole).  For two errors every signature stands in
   the buckets of its chunk and of all chunks one bit away: two chunks within
   two errors share such a bucket, so every pair under the threshold meets.
   Buckets with the same leading chunk bits are one shard; a signature is
   sent to its shards, and its buckets are enumerated there.
   ``plan`` takes as many chunks as make a pair at the similarity limit pass
   the threshold but with a chance of ``MISS``.
3. A bucket compares whole signatures.  A shard reports a spanning forest of
   the pairs under the threshold, each pair in the first chunk that is within
   the errors only; the forests of all shards give candidate groups.
4. Every candidate group is confirmed on full shingle sets: an inverted index
   over the group's texts counts all intersections exactly.  A group above a
   block's bounds is confirmed by pairs of blocks, each a task of its own.

Copies of one word sequence are one class from step 1 on and travel once.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.common import map_texts, shuffle_partitions, stage, table
from churnlens.llm.simhash import connected_components, hook

WORDS = 5
PERCENT = 80
#: Chance that a pair at the similarity limit is over the signature threshold.
MISS = 2e-6
ERRORS = 2
#: One class in so many, by hash, is counted to find hot shards.
SAMPLE = 16
#: Rows of a shard that one task compares; larger shards are split.
MAX_ROWS = 131_072
#: Bits of the filter of candidate rows: so many a row, at most so many (8 MB).
FILTER_BITS = 16
MOST_FILTER_BITS = 1 << 26
#: Texts and shingles of one confirming block.
BLOCK_TEXTS = 512
BLOCK_SHINGLES = 2_000_000
#: Size steps (of the similarity limit) in one size band.
BAND_STEPS = 8


@dataclass(frozen=True)
class Plan:
    """Chunks of a signature, its threshold, the leading chunk bits that name
    a shard, and the edges of size bands."""

    chunks: int
    bits: int
    radius: int
    prefix: int
    edges: tuple
    percent: int

    @property
    def length(self) -> int:
        return self.chunks * self.bits

    @property
    def per_word(self) -> int:
        return 64 // self.bits

    @property
    def words(self) -> int:
        return -(-self.chunks // self.per_word)


def _tail(n: int, p: float, above: int) -> float:
    """Chance of more than ``above`` of n bits differing."""
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
            + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(above + 1, n + 1)]
    return sum(map(math.exp, logs))


def plan(n: int, percent: int = PERCENT, miss: float = MISS) -> Plan:
    """The signature for ``n`` classes: chunks of more bits and shards of more
    leading bits for more classes, and as many chunks as ``miss`` asks for."""
    if not 50 <= percent < 100:
        raise ValueError("percent must be in 50..99")
    bits = min(24, max(16, math.ceil(math.log2(max(n, 1) / 64 + 1))))
    p = (100 - percent) / 200
    chunks = 1
    while _tail(chunks * bits, p, chunks * (ERRORS + 1) - 1) > miss:
        chunks += 1
        if chunks > 200:
            raise ValueError("similarity limit too low for chunks of this size")
    prefix = 3
    while prefix < bits - 2 and n * (prefix + 1) >> prefix > 2 * MAX_ROWS:
        prefix += 1
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(math.ceil(edges[-1] * (100 / percent) ** BAND_STEPS) + 1)
    return Plan(chunks, bits, chunks * (ERRORS + 1) - 1, prefix, tuple(edges), percent)


# -- shingles and signatures -----------------------------------------------------

def word_list(text: str | None) -> list[bytes]:
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and the white
    # space \x20 \x09-\x0d
    return (text or "").encode("utf-8", "replace").lower().split()


class Shingles:
    """Distinct shingles of texts, exact: words get local numbers."""

    def __init__(self, width: int):
        self.width = width
        self.numbers: dict[bytes, int] = defaultdict(itertools.count(1).__next__)

    def places(self, parts: list[bytes]) -> np.ndarray:
        """(shingles, width) word numbers from 1, a row for each distinct
        shingle; the places after a short text's only shingle are 0."""
        ids = np.fromiter(map(self.numbers.__getitem__, parts), np.int64, len(parts))
        if not len(ids):
            return np.zeros((0, self.width), np.int64)
        if len(ids) < self.width:
            return np.concatenate([ids, np.zeros(self.width - len(ids), np.int64)])[None, :]
        rows = np.lib.stride_tricks.sliding_window_view(ids, self.width)
        code = rows[:, 0]
        for j in range(1, self.width):
            # pairs of numbers renumbered, so codes of any width stay exact
            if j > 1:
                code = np.unique(code, return_inverse=True)[1]
            code = (code << 32) | rows[:, j]
        _, first = np.unique(code, return_index=True)
        return rows[first]


class Signer:
    def __init__(self, width: int, length: int, seed: int = 11):
        self.width, self.length = width, length
        rng = np.random.default_rng(seed)
        self.flip = rng.integers(0, 1 << 32, (length, 1), dtype=np.uint32)
        self.times = rng.integers(0, 1 << 32, (length, 1), dtype=np.uint32) | np.uint32(1)
        self.mix = rng.integers(0, 1 << 63, width, dtype=np.uint64) | np.uint64(1)

    def bits(self, hashes: np.ndarray) -> np.ndarray:
        """One bit of the least shingle under every hash."""
        least = np.full(self.length, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(hashes), 512):
            v = hashes[None, i:i + 512] ^ self.flip
            v *= self.times
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            np.minimum(least, v.min(axis=1), out=least)
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)

    def run(self, texts: list[str]) -> dict:
        """Class key (none without words), set size and signature."""
        keys, sizes, signs = [], [], []
        shingles = Shingles(self.width)
        known, by_word = 1, np.zeros(1024, np.uint64)  # word number -> hash
        for t in texts:
            parts = word_list(t)
            if not parts:
                keys.append(None)
                sizes.append(0)
                signs.append(None)
                continue
            rows = shingles.places(parts)
            words = len(shingles.numbers) + 1
            if words > known:
                if words > len(by_word):
                    by_word = np.resize(by_word, 2 * words)
                # numbers follow the order in which the words came
                fresh = itertools.islice(reversed(shingles.numbers), words - known)
                by_word[known:words] = [xxhash.xxh64_intdigest(w) for w in fresh][::-1]
                known = words
            mixed = np.zeros(len(rows), np.uint64)
            for j in range(self.width):
                mixed = (mixed ^ by_word[rows[:, j]]) * self.mix[j]
                mixed ^= mixed >> np.uint64(29)
            keys.append(hashlib.blake2b(b" ".join(parts), digest_size=16).digest())
            sizes.append(len(rows))
            signs.append(np.packbits(self.bits((mixed >> np.uint64(32)).astype(np.uint32))).tobytes())
        return {"class": pa.array(keys, pa.binary()), "n_shingles": pa.array(sizes, pa.int64()),
                "sign": pa.array(signs, pa.binary())}


# -- the multi-index Hamming join ----------------------------------------------------

def _chunks(column: pa.Array, p: Plan) -> np.ndarray:
    """(signatures, chunks) chunk values."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    bits = np.unpackbits(raw, axis=1)[:, :p.length].reshape(len(raw), p.chunks, p.bits)
    return bits.astype(np.int64) @ (1 << np.arange(p.bits))


def _packed(chunks: np.ndarray, p: Plan) -> np.ndarray:
    """Chunks side by side in 64-bit words, none across two words."""
    out = np.zeros((len(chunks), p.words), np.int64)
    for c in range(p.chunks):
        out[:, c // p.per_word] |= chunks[:, c] << (c % p.per_word * p.bits)
    return out


def _shards(classes: DataFrame, p: Plan) -> DataFrame:
    """(shard, node, s0..): a signature in every shard (size band, chunk,
    leading chunk bits) that holds one of its buckets.  Chunks one bit away
    share the leading bits, unless that bit is one of them."""
    schema = "shard long, node long, " + ", ".join(f"s{i} long" for i in range(p.words))
    edges = np.array(p.edges)
    flips = np.concatenate([[0], 1 << np.arange(p.prefix)]).astype(np.int64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                chunk = _chunks(part.column(2), p)
                packed = _packed(chunk, p)
                lead = ((chunk >> (p.bits - p.prefix))[:, :, None] ^ flips) | (np.arange(p.chunks) << 48)[:, None]
                n = part.column(1).to_numpy()
                low = np.searchsorted(edges, n, side="right")
                high = np.searchsorted(edges, n * 100 // p.percent, side="right")
                for band, who in ((low, np.arange(len(n))), (high, np.flatnonzero(high != low))):
                    per = p.chunks * len(flips)
                    key = lead[who].reshape(len(who), per) | (band[who] << 40)[:, None]
                    row = np.repeat(who, per)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel()), part.column(0).take(pa.array(row))]
                        + [pa.array(packed[row, i]) for i in range(p.words)],
                        names=["shard", "node", *[f"s{i}" for i in range(p.words)]])

    return classes.select("node", "n_shingles", "sign").mapInArrow(run, schema)


def _variants(shard: np.ndarray, signs: np.ndarray, p: Plan):
    """(row, variant): the chunk of each row and those one bit away that lie
    in the row's shard."""
    low = p.bits - p.prefix
    c, lead = shard >> 48, shard & ((1 << p.prefix) - 1)
    chunk = (signs[np.arange(len(c)), c // p.per_word].view(np.int64) >> (c % p.per_word * p.bits)) & ((1 << p.bits) - 1)
    home = np.flatnonzero(chunk >> low == lead)
    near = np.flatnonzero(chunk >> low != lead)
    flips = np.concatenate([[0], 1 << np.arange(low)]).astype(np.int64)
    row = np.concatenate([np.repeat(home, len(flips)), near])
    value = np.concatenate([(chunk[home, None] ^ flips).ravel(), (lead[near] << low) | (chunk[near] & ((1 << low) - 1))])
    return row, value


def near_pairs(signs: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int):
    """Blocks of (a, b): places of one group (sorted) whose signatures are
    within ``radius``; of two sides that are not 0 only pairs across."""
    def hits(a, b):
        d = np.bitwise_count(signs[a] ^ signs[b]).sum(axis=-1, dtype=np.int64)
        return (d <= radius) & ((side[a] == 0) | (side[a] != side[b]))

    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    size = np.diff(np.concatenate([begin, [len(group)]]))
    left = np.repeat(begin + size, size) - np.arange(len(group))  # places from here to the group's end
    left[np.repeat(size > 64, size)] = 0
    a, k = np.flatnonzero(left > 1), 1
    while len(a):
        ok = hits(a, a + k)
        if ok.any():
            yield a[ok], a[ok] + k
        k += 1
        a = a[left[a] > k]
    for lo, n in zip(begin[size > 64], size[size > 64]):
        for i in range(lo, lo + n, 256):
            rows = np.arange(i, min(i + 256, lo + n))
            for j in range(i, lo + n, 1024):
                cols = np.arange(j, min(j + 1024, lo + n))
                x, y = np.meshgrid(rows, cols, indexing="ij")
                ok = hits(x, y) & (x < y)
                if ok.any():
                    yield x[ok], y[ok]


def shard_links(shard: np.ndarray, part: np.ndarray, node: np.ndarray, signs: np.ndarray, side: np.ndarray,
                p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node connected with it) found in whole shards, each
    pair in the first chunk that is within ``ERRORS`` only.  ``part`` numbers
    the groups to be kept apart."""
    row, value = _variants(shard, signs, p)
    key = (part[row] << 32) | value
    by = np.argsort(key, kind="stable")
    row, key = row[by], key[by]
    names, at = np.unique(node, return_inverse=True)
    parent = np.arange(len(names))
    chunk = shard >> 48
    mask = np.uint64((1 << p.bits) - 1)
    for a, b in near_pairs(signs[row], key, side[row], p.radius):
        a, b = row[a], row[b]
        open_ = parent[at[a]] != parent[at[b]]
        a, b = a[open_], b[open_]
        apart = signs[a] ^ signs[b]
        first = np.ones(len(a), bool)
        for c in range(int(chunk[a].max(initial=0))):
            d = np.bitwise_count((apart[:, c // p.per_word] >> np.uint64(c % p.per_word * p.bits)) & mask)
            first &= (d > ERRORS) | (chunk[a] <= c)
        hook(parent, at[a[first]], at[b[first]])
    moved = np.flatnonzero(parent != np.arange(len(names)))
    return names[moved], names[parent[moved]]


def _whole_groups(batches, keys: list[str], target: int = 200_000):
    """Tables of whole groups of sorted rows, about ``target`` rows at a
    time, with the group's number; a group that goes on is carried over."""
    held, rows, want = [], 0, target
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows < want:
                continue
        if not held:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        end = t.num_rows if batch is None else int(np.flatnonzero(new)[-1])
        held, rows, want = t.slice(end).to_batches(), t.num_rows - end, target
        if end:
            yield t.slice(0, end), np.cumsum(new[:end])
        else:
            want = rows * 2  # one group so far: read on


def candidate_links(classes: DataFrame, p: Plan, max_rows: int = MAX_ROWS) -> DataFrame:
    """Links (a, b) whose components are those of ``classes`` (node,
    n_shingles, sign) under "at most ``radius`` differing bits" of sizes that
    the limit allows."""
    some = classes.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0)
    hot = stage(_shards(some, p).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") * SAMPLE > max_rows)
                .select("shard", F.ceil(F.col("n") * SAMPLE / max_rows).cast("int").alias("parts")))
    rows = _shards(classes, p).withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})
    if not hot.isEmpty():
        # a hot shard of m parts: a task for each pair of parts
        own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
        alone = F.array(F.lit(0))
        rows = (rows.drop("i", "j", "side").join(hot, "shard", "left")
                .withColumn("own", F.coalesce(own, F.lit(0)))
                .withColumn("other", F.explode(F.when(F.col("parts").isNull(), alone)
                                               .otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
                .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"),
                              "side": F.when(F.col("own") < F.col("other"), 1)
                              .when(F.col("own") > F.col("other"), 2).otherwise(0)})
                .drop("parts", "own", "other"))
    keys = ["shard", "i", "j"]
    parts = rows.repartition(max(shuffle_partitions(classes.sparkSession), 1), *keys).sortWithinPartitions(*keys)

    def search(batches):
        for t, group in _whole_groups(batches, keys):
            signs = np.column_stack([t.column(f"s{i}").to_numpy() for i in range(p.words)]).view(np.uint64)
            a, b = shard_links(*(t.column(c).to_numpy() if isinstance(c, str) else c for c in (
                "shard", group, "node", signs, "side")), p)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return parts.mapInArrow(search, "a long, b long").distinct()


# -- confirmation on full sets ----------------------------------------------------

def confirmed(texts: list[str], side: np.ndarray, width: int, percent: int) -> np.ndarray:
    """For every text the least text of its component under the similarity
    limit; of two sides that are not 0 only pairs across are compared."""
    shingles = Shingles(width)
    sets = [shingles.places(word_list(t)) for t in texts]
    size = np.array([len(s) for s in sets], np.int64)
    parent = np.arange(len(texts))
    if len(texts) < 2 or not size.sum():
        return parent
    rows = np.concatenate(sets)
    code = rows[:, 0]
    for j in range(1, width):
        if j > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = (code << 32) | rows[:, j]
    code = np.unique(code, return_inverse=True)[1]
    owner = np.repeat(np.arange(len(texts)), size)
    by = np.argsort(code, kind="stable")  # postings, by text within a shingle
    holders = owner[by]
    start = np.searchsorted(code[by], np.arange(int(code.max()) + 2))
    first = np.cumsum(size) - size
    for x in range(len(texts)):
        if not size[x]:
            continue
        own = code[first[x]:first[x] + size[x]]
        lo, n = start[own], start[own + 1] - start[own]
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(holders[at], minlength=len(texts))
        ok = (100 * both >= percent * (size[x] + size - both)) & (size > 0)
        if side[x]:
            ok &= side != side[x]
        near = np.flatnonzero(ok)
        hook(parent, np.full(len(near), x), near)
    return parent


def row_filter(members: DataFrame):
    """A function that tells which row hashes may be among ``members``: a
    bitmap of a size that is bounded however many they are (with very many it
    lets more through; the join that follows is exact)."""
    bits = 1 << 16
    while bits < MOST_FILTER_BITS and bits < FILTER_BITS * members.count():
        bits *= 2
    place = F.pmod(F.col("row"), F.lit(bits)) + 1  # Spark numbers bitmap places from 1
    maps = members.groupBy(F.bitmap_bucket_number(place).alias("k")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map")).collect()
    held = np.zeros((bits >> 15, 4096), np.uint8)
    for r in maps:
        held[r["k"] - 1] = np.frombuffer(r["map"], np.uint8)
    flags = members.sparkSession.sparkContext.broadcast(held.ravel())

    def test(rows: np.ndarray) -> np.ndarray:
        at = rows % bits
        return (flags.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    return test


def confirmed_links(docs: DataFrame, groups: DataFrame, width: int, percent: int,
                    block_texts: int = BLOCK_TEXTS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) between classes of one group whose sets reach the limit.

    ``docs`` holds (row, text), ``groups`` (row, node, root, n_shingles) for
    one row of every class."""
    need = groups.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_texts),
                                                 F.ceil(F.sum("n_shingles") / block_shingles)).cast("int").alias("m"))
    members = stage(groups.join(need, "root").select(
        "row", "node", "root", F.pmod(F.xxhash64("node"), F.col("m")).cast("int").alias("own"), "m"))

    wanted = row_filter(members)

    def asked(batches):
        for batch in batches:
            yield batch.filter(pa.array(wanted(batch.column(0).to_numpy())))

    def once(batches):
        seen: set[int] = set()
        for batch in batches:
            new = []
            for i, node in enumerate(batch.column(0).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    new.append(i)
            if new:
                yield batch.take(pa.array(new))

    # rows that cannot be members leave before the texts are shuffled
    chosen = docs.select("row", "text").mapInArrow(asked, "row long, text string") \
        .join(members, "row").select("node", "root", "own", "m", "text") \
        .mapInArrow(once, "node long, root long, own int, m int, text string")
    routed = (chosen.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
              .select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                      F.when(F.col("own") < F.col("other"), 1).when(F.col("own") > F.col("other"), 2)
                      .otherwise(0).alias("side"), "node", "text"))

    def check(group: pa.Table) -> pa.Table:
        node, at = np.unique(group.column("node").to_numpy(), return_index=True)
        texts = group.column("text").take(pa.array(at)).to_pylist()
        parent = confirmed(texts, group.column("side").to_numpy()[at], width, percent)
        moved = np.flatnonzero(parent != np.arange(len(node)))
        return pa.table({"a": node[moved], "b": node[parent[moved]]})

    return routed.groupBy("root", "i", "j").applyInArrow(check, "a long, b long").distinct()


def similar_documents(docs: DataFrame, keep: list[str], key: str = "doc_id", words: int = WORDS,
                      percent: int = PERCENT, **bounds) -> DataFrame:
    """``keep`` columns, ``n_shingles``, ``component_id`` (the least ``key``
    reachable over links of shingle similarity ``percent``) and ``kept``.

    Null, empty and white texts have no shingles and are linked with nothing:
    their component is their own id.  Repeated rows keep their own output
    row.  A null key takes no part in the minimum (a component of null keys
    has a null id and its rows are kept).  Very long texts are taken whole.
    An empty table gives no rows.  Other columns of the input, whatever their
    names, are only passed through if named in ``keep``; none of them may be
    named as a result column.
    """
    p = plan(docs.count(), percent)
    sizes = {k: bounds.pop(k) for k in ("block_texts", "block_shingles") if k in bounds}
    # columns by place, so that none clashes with the new ones
    cols = list(dict.fromkeys([*keep, key]))
    base = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(cols)], F.col("text").cast("string").alias("text"))
    low = f"_{cols.index(key)}"
    rows = base.withColumn("row", F.xxhash64(low, "text"))
    prints = stage(map_texts(rows, Signer(words, p.length).run, "class binary, n_shingles long, sign binary",
                             [*base.columns[:-1], "row"]))
    classes = stage(prints.filter("class is not null").groupBy("class", "n_shingles", "sign")
                    .agg(F.min(low).alias("low"), F.min("row").alias("row"))
                    .withColumn("node", F.monotonically_increasing_id()))
    near = connected_components(candidate_links(classes, p, **bounds))
    groups = near.union(near.select("root", "root").distinct())
    links = confirmed_links(rows.select("row", "text"), groups.join(classes.select("node", "row", "n_shingles"), "node"),
                            words, percent, **sizes)
    comps = connected_components(links)
    rooted = classes.join(comps, "node", "left").select("class", "low", F.coalesce("root", "node").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    names = rooted.join(lows, "root").select("class", "component_id")
    out = prints.join(names, "class", "left").withColumn(
        "component_id", F.when(F.col("class").isNull(), F.col(low)).otherwise(F.col("component_id")))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(cols) if c in keep], "n_shingles", "component_id",
                      F.col(low).eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: distinct 3-word shingles,
    links at a similarity of 0.85."""
    return similar_documents(table(spark, sf_dir, "documents"), ["doc_id"], words=3, percent=85)


def oracle(words: int = 3, percent: int = 85) -> str:
    """DuckDB SQL: all pairs that share a shingle, and their closure."""
    return rf"""
    WITH RECURSIVE d AS (
      SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
    s AS (
      SELECT DISTINCT doc_id, unnest(CASE
        WHEN w IS NULL OR len(w) = 0 THEN []
        WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + {words - 1}], ' ') FOR i IN range(1, len(w) - {words} + 2)] END) AS g
      FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
             GROUP BY 1, 2),
    link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
             WHERE 100 * k >= {percent} * (x.n + y.n - k)),
    reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
    least AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
           least(d.doc_id, coalesce(low, d.doc_id)) = d.doc_id AS kept
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id"""
