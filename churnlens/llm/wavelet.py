"""Token ids in wavelet-matrix files, one a shard.

A shard holds the ids of consecutive documents.  Its ids are numbered
densely (the shard's alphabet) and stored as a wavelet matrix: plane b has
the b-th highest bit of every code, and the codes go to the next plane
stably sorted by that bit.  With the counts of ones before every block of
512 bits the file supports, without being decoded as a whole:

* ``access(i)``: the id at a place,
* ``rank(id, i)`` / ``count(id, i, j)``: occurrences before a place / in a range,
* ``select(id, k)``: the place of the k-th occurrence.

File format (little-endian): magic, version, sizes; then, each zstd
compressed with its length, document keys, document lengths, alphabet,
zeros of each plane, block counts and bit planes.  Executors reach the
shared store through Spark alone, so a file is the ``file`` value of one row
of a Parquet table written with Spark's commit protocol.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm.common import arrow_slices, shuffle_partitions, stage, table
from churnlens.llm.tokens import library_encoder, tokenizer_path

#: A matrix of this size is built and read within a core's cache.
SHARD_TOKENS = 1 << 15
TOKENIZER = "byte_bpe_50k.json"
_MAGIC, _HEAD = b"WVM1", struct.Struct("<4sIQQ")
_BLOCK = 512  # bits a counted block


class WaveletMatrix:
    """A sequence of small unsigned integers as bit planes."""

    def __init__(self, size: int, alphabet: np.ndarray, zeros: np.ndarray,
                 planes: np.ndarray | Callable[[], np.ndarray], blocks: np.ndarray):
        self.size, self.alphabet, self.zeros, self.blocks = size, alphabet, zeros, blocks
        self.bits = len(zeros)
        self._planes = planes

    @property
    def planes(self) -> np.ndarray:
        """The bit planes; a function that unpacks them is called at first
        use, so a question about an id outside the alphabet unpacks none."""
        if callable(self._planes):
            self._planes = self._planes()
        return self._planes

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        n = len(values)
        seen = np.zeros(int(values.max()) + 1 if n else 0, bool)
        seen[values] = True
        alphabet = np.flatnonzero(seen).astype(np.uint32)
        code = np.zeros(len(seen), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        code[alphabet] = np.arange(len(alphabet))
        x = code[values]
        bits = max(len(alphabet) - 1, 0).bit_length()
        width = -(-n // _BLOCK) * _BLOCK // 8
        planes, zeros = np.zeros((bits, width), np.uint8), np.zeros(bits, np.int64)
        for p in range(bits):
            one = (x & x.dtype.type(1 << (bits - 1 - p))) != 0
            packed = np.packbits(one, bitorder="little")
            planes[p, :len(packed)] = packed
            order, zeros[p] = _stable_order(one)
            x = x.take(order)
        return cls(n, alphabet, zeros, planes, _block_counts(planes))

    def values(self) -> np.ndarray:
        """All values in order: from the last plane up, undo the sorting."""
        x = np.zeros(self.size, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[p], count=self.size, bitorder="little").view(bool)
            x[self.zeros[p]:] |= x.dtype.type(1 << (self.bits - 1 - p))
            up = np.empty_like(x)
            up[_stable_order(one)[0]] = x
            x = up
        return self.alphabet[x]

    def _ones(self, p: int, i: int) -> int:
        """Ones of plane p before place i."""
        b = i // _BLOCK
        lo, hi = b * _BLOCK // 8, i // 8
        n = int(self.blocks[p, b]) + int(np.bitwise_count(self.planes[p, lo:hi]).sum())
        return n + (int(self.planes[p, hi]) & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else n

    def _bit(self, p: int, i: int) -> int:
        return int(self.planes[p, i // 8]) >> (i % 8) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        code = 0
        for p in range(self.bits):
            bit = self._bit(p, i)
            code = code << 1 | bit
            ones = self._ones(p, i)
            i = int(self.zeros[p]) + ones if bit else i - ones
        return int(self.alphabet[code])

    def _range(self, value: int, i: int, j: int) -> tuple[int, int, int] | None:
        at = int(np.searchsorted(self.alphabet, value))
        if at == len(self.alphabet) or int(self.alphabet[at]) != value:
            return None
        for p in range(self.bits):
            a, b = self._ones(p, i), self._ones(p, j)
            if at >> (self.bits - 1 - p) & 1:
                i, j = int(self.zeros[p]) + a, int(self.zeros[p]) + b
            else:
                i, j = i - a, j - b
        return at, i, j

    def count(self, value: int, i: int = 0, j: int | None = None) -> int:
        found = self._range(value, i, self.size if j is None else j)
        return found[2] - found[1] if found else 0

    def rank(self, value: int, i: int) -> int:
        return self.count(value, 0, i)

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a value."""
        found = self._range(value, 0, self.size)
        if not found or not 0 <= k < found[2] - found[1]:
            raise IndexError(k)
        code, i, _ = found
        i += k
        for p in range(self.bits - 1, -1, -1):
            one = code >> (self.bits - 1 - p) & 1
            i = self._select(p, one, i - int(self.zeros[p]) if one else i)
        return i

    def places(self, value: int) -> np.ndarray:
        """All places of a value in ascending order: the value's rows of the
        last plane, taken up plane by plane."""
        found = self._range(value, 0, self.size)
        if not found:
            return np.zeros(0, np.int64)
        code, i, j = found
        at = np.arange(i, j)
        for p in range(self.bits - 1, -1, -1):
            one = code >> (self.bits - 1 - p) & 1
            bits = np.unpackbits(self.planes[p], count=self.size, bitorder="little")
            at = np.flatnonzero(bits == one)[at - int(self.zeros[p]) if one else at]
        return at

    def slice(self, i: int, j: int) -> np.ndarray:
        """The values of the places i to j (without j): the places go down
        the planes together."""
        at = np.arange(i, j)
        code = np.zeros(len(at), np.int64)
        for p in range(self.bits):
            lead = self.blocks[p].astype(np.int64)[at // _BLOCK]
            one = np.unpackbits(self.planes[p], bitorder="little").astype(np.int64)
            before = np.cumsum(one.reshape(-1, _BLOCK), axis=1).reshape(-1) - one
            ones = lead + before[at]
            bit = one[at]
            code = code << 1 | bit
            at = np.where(bit == 1, int(self.zeros[p]) + ones, at - ones)
        return self.alphabet[code]

    def _select(self, p: int, bit: int, k: int) -> int:
        """Place of the k-th one or zero of a plane."""
        held = self.blocks[p].astype(np.int64)
        if not bit:
            held = np.arange(len(held)) * _BLOCK - held
        b = int(np.searchsorted(held, k, side="right")) - 1
        lo = b * _BLOCK
        block = np.unpackbits(self.planes[p, lo // 8:(lo + _BLOCK) // 8], bitorder="little")
        return lo + int(np.flatnonzero(block == bit)[k - int(held[b])])


def _stable_order(one: np.ndarray) -> tuple[np.ndarray, int]:
    """Places of the zeros, then of the ones, and the number of zeros."""
    zeros = np.flatnonzero(~one)
    return np.concatenate([zeros, np.flatnonzero(one)]), len(zeros)


def _block_counts(planes: np.ndarray) -> np.ndarray:
    """Ones before every block, and in all."""
    per = np.bitwise_count(planes).reshape(len(planes), planes.shape[1] // (_BLOCK // 8), _BLOCK // 8).sum(axis=2, dtype=np.uint32)
    return np.concatenate([np.zeros((len(planes), 1), np.uint32), np.cumsum(per, axis=1, dtype=np.uint32)], axis=1)


class ShardFile:
    """A shard's documents: keys, lengths and the wavelet matrix of their ids."""

    def __init__(self, keys: list, lengths: np.ndarray, matrix: WaveletMatrix):
        self.keys, self.lengths, self.matrix = keys, lengths, matrix

    @classmethod
    def build(cls, keys: list, lengths: np.ndarray, ids: np.ndarray) -> ShardFile:
        return cls(keys, np.asarray(lengths, np.int64), WaveletMatrix.build(ids))

    def to_bytes(self) -> bytes:
        m = self.matrix
        null = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        codec = pa.Codec("zstd", compression_level=1)
        out = [_HEAD.pack(_MAGIC, m.bits, m.size, len(self.keys))]
        for a in (null, keys, self.lengths.astype("<i8"), m.alphabet.astype("<u4"),
                  m.zeros.astype("<i8"), m.blocks.astype("<u4"), m.planes):
            raw = a.tobytes()
            packed = codec.compress(raw, asbytes=True) if raw else b""
            out += [struct.pack("<QQ", len(raw), len(packed)), packed]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> ShardFile:
        magic, bits, size, _ = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a shard file")
        at, packs, codec = _HEAD.size, [], pa.Codec("zstd")
        for _ in range(7):
            raw, packed = struct.unpack_from("<QQ", data, at)
            at += 16
            packs.append((data[at:at + packed], raw))
            at += packed

        def unpack(pack: tuple[bytes, int]) -> bytes:
            return codec.decompress(pack[0], pack[1], asbytes=True) if pack[1] else b""

        def planes() -> np.ndarray:
            return np.frombuffer(unpack(packs[6]), np.uint8).reshape(bits, -1) if bits else np.zeros((0, 0), np.uint8)

        parts = [unpack(pack) for pack in packs[:6]]
        null, keys = np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], "<i8")
        blocks = np.frombuffer(parts[5], "<u4").reshape(bits, -1) if bits else np.zeros((0, 1), np.uint32)
        matrix = WaveletMatrix(size, np.frombuffer(parts[3], "<u4"), np.frombuffer(parts[4], "<i8"), planes, blocks)
        return cls([None if n else int(k) for n, k in zip(null, keys)], np.frombuffer(parts[2], "<i8"), matrix)


def write_token_files(docs: DataFrame, key: str = "doc_id", path: str | None = None, end_id: int = 2,
                      shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Write the ids of all documents in ascending key order.

    The texts are range partitioned by (key, text hash, row number), so that
    the copies of one row are split too (the number is its place in the table
    read: stage ``docs`` before if they are computed); a task encodes its range
    in order and closes a file at the first document end past
    ``shard_tokens`` ids, so a file holds whole documents and one that is
    longer has a file of its own.  Returns the table of files: part, seq
    (order in the part), before (ids of the part's files before it), tokens
    and file.  Null keys come first; a null text is its end id alone;
    repeated rows are documents of their own; an empty table has no file.
    """
    path = path or tokenizer_path(TOKENIZER)
    base = docs.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first()]
    n = partitions or shuffle_partitions(docs.sparkSession)
    ranged = (base.repartitionByRange(n, *order[:2], "row").drop("row").sortWithinPartitions(*order)
              .withColumn("part", F.spark_partition_id()))

    def run(batches):
        encoder = library_encoder(path)
        seq, before, part_id = 0, 0, None
        keys, lengths, ids, held = [], [], [], 0

        def close():
            nonlocal seq, before, keys, lengths, ids, held
            file = ShardFile.build(keys, np.array(lengths), np.concatenate(ids)).to_bytes()
            row = pa.RecordBatch.from_pydict(
                {"part": pa.array([part_id], pa.int32()), "seq": pa.array([seq], pa.int32()),
                 "before": [before], "tokens": [held], "file": pa.array([file], pa.binary())})
            seq, before, keys, lengths, ids, held = seq + 1, before + held, [], [], [], 0
            return row

        for batch in batches:
            for rows, texts in arrow_slices(batch, 1):
                part_id = rows.column(2)[0].as_py()
                flat, counts = encoder.encode(texts)
                at = np.concatenate([[0], np.cumsum(counts)])
                for i, k in enumerate(rows.column(0).to_pylist()):
                    keys.append(k)
                    lengths.append(int(counts[i]) + 1)
                    ids += [flat[at[i]:at[i + 1]], np.array([end_id], flat.dtype)]
                    held += lengths[-1]
                    if held >= shard_tokens:
                        yield close()
        if keys:
            yield close()

    return stage(ranged.mapInArrow(run, "part int, seq int, before long, tokens long, file binary"))


def _placed(files: DataFrame) -> DataFrame:
    """start (ids of all files before), file and tokens of every file."""
    # a row a part: its ids before those of the next part; a table of its
    # own, which Spark broadcasts where it is small by its size on disk
    sizes = files.groupBy("part").agg(F.sum("tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = stage(sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    return files.join(first, "part").select((F.col("_first") + F.col("before")).alias("start"), "file", "tokens")


def read_token_files(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of a table of files: key, start (ids of all documents
    before it), n_tokens and ids_crc32, decoded from the files."""
    def run(batches):
        for batch in batches:
            for begin, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                file = ShardFile.from_bytes(data.as_buffer().to_pybytes())
                ids = file.matrix.values().astype("<u4")
                ends = np.cumsum(file.lengths)
                starts = ends - file.lengths
                yield pa.RecordBatch.from_pydict({
                    key: pa.array(file.keys, pa.int64()), "start": pa.array(starts + begin),
                    "n_tokens": pa.array(file.lengths),
                    "ids_crc32": pa.array([zlib.crc32(ids[i:j]) for i, j in zip(starts, ends)], pa.int64())})

    return _placed(files).mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def _each_file(batches) -> Iterator[tuple[int, ShardFile]]:
    for batch in batches:
        for begin, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield begin, ShardFile.from_bytes(data.as_buffer().to_pybytes())


def count_ids(files: DataFrame, ids: Sequence[int]) -> DataFrame:
    """How often each of ``ids`` occurs in a table of files: id, n (zero
    where it does not occur; a repeated id is one row).  Every file answers by
    rank, unpacking its planes only if its alphabet has one of the ids; a row
    a file and id is summed."""
    wanted = sorted({int(i) for i in ids})
    spark = files.sparkSession

    def run(batches):
        for _, file in _each_file(batches):
            n = [file.matrix.count(i) for i in wanted]
            yield pa.RecordBatch.from_pydict({"id": pa.array(wanted, pa.int64()), "n": pa.array(n, pa.int64())})

    asked = spark.createDataFrame([(i, 0) for i in wanted], "id long, n long")
    found = files.select("before", "file").mapInArrow(run, "id long, n long")
    return found.union(asked).groupBy("id").agg(F.sum("n").alias("n"))


def find_ids(files: DataFrame, ids: Sequence[int], key: str = "doc_id") -> DataFrame:
    """Every occurrence of ``ids`` in a table of files: id, place (among the
    ids of all documents), key and offset in the document.  No file is decoded:
    the places come from the id's rows of the planes, at most a file's ids at
    a time; no ids or files: no rows."""
    wanted = sorted({int(i) for i in ids})

    def run(batches):
        for begin, file in _each_file(batches):
            ends = np.cumsum(file.lengths)
            for i in wanted:
                at = file.matrix.places(i)
                if len(at):
                    doc = np.searchsorted(ends, at, side="right")
                    keys = pa.array(file.keys, pa.int64()).take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), i)), pa.array(at + begin), keys,
                         pa.array(at - (ends - file.lengths)[doc])], names=["id", "place", key, "offset"])

    return _placed(files).mapInArrow(run, f"id long, place long, `{key}` long, offset long")


def read_ranges(files: DataFrame, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """The ids of places ``begin`` to ``end`` (without it) among the ids of
    all documents: begin, end, place (of the first id of the row) and ids, a
    row a file that meets the range.  Files outside all ranges are left out by
    their places and not unpacked; an empty range, or one past the last id,
    has no row."""
    asked = sorted({(int(a), int(b)) for a, b in ranges if a < b})
    meets = F.lit(False)
    for a, b in asked:
        meets |= (F.col("start") < b) & (F.col("start") + F.col("tokens") > a)

    def run(batches):
        for begin, file in _each_file(batches):
            for a, b in asked:
                i, j = max(a - begin, 0), min(b - begin, file.matrix.size)
                if i < j:
                    ids = pa.array([file.matrix.slice(i, j).astype(np.int64)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([a]), pa.array([b]), pa.array([i + begin]), ids],
                        names=["begin", "end", "place", "ids"])

    return _placed(files).filter(meets).mapInArrow(
        run, "begin long, end long, place long, ids array<long>")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as wavelet files and read them back."""
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")))
