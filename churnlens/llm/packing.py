"""Packing documents into training sequences by best-fit decreasing.

A document's ids (with an end id) are cut into full windows; what remains
(less than a window) is packed with other documents' remainders: longest
first, each into the open sequence whose free room fits it most tightly,
found in a segment tree indexed by free room.  Cuts depend on the document
alone, so only one small row a piece is shuffled.  Remainders are packed in
shards of about ``shard_pieces`` rows by a hash; every shard leaves a few
sequences part-filled at most, whatever the size of the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm.common import arrow_slices, stage, table
from churnlens.llm.tokens import library_encoder, tokenizer_path

WINDOW = 2048
SHARD_PIECES = 32_768
TOKENIZER = "byte_bpe_50k.json"


class RoomTree:
    """Open sequences by free room: leaf r holds those with r free places,
    an inner node whether any leaf below it holds one."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = bytearray(2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, sequence: int) -> None:
        held = self.open.setdefault(room, [])
        held.append(sequence)
        if len(held) == 1:
            node = self.size + room
            while node and not self.any[node]:
                self.any[node] = 1
                node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (room, sequence) with the least room >= length."""
        node = self.size + length
        while not self.any[node]:
            while node & 1:  # last child: up
                node >>= 1
            if not node:
                return None
            node += 1  # the neighbour to the right holds larger rooms
        while node < self.size:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.size
        held = self.open[room]
        sequence = held.pop()
        if not held:
            while node and not (node < self.size and (self.any[2 * node] or self.any[2 * node + 1])):
                self.any[node] = 0
                node >>= 1
        return room, sequence


def best_fit_decreasing(lengths, window: int = WINDOW) -> tuple[list[int], list[int]]:
    """(sequence, offset) of pieces given in order of falling length."""
    tree, sequences, offsets, n = RoomTree(window), [], [], 0
    for length in lengths:
        found = tree.take(length)
        if found:
            room, sequence = found
        else:
            room, sequence, n = window, n, n + 1
        sequences.append(sequence)
        offsets.append(window - room)
        if room > length:
            tree.add(room - length, sequence)
    return sequences, offsets


def cut_documents(docs: DataFrame, key: str, path: str, end_id: int, window: int,
                  keep_ids: bool = False) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens (and the
    piece's ids as little-endian 32-bit integers)."""
    base = docs.select(F.col(key), F.col("text").cast("string").alias("text"))
    names = [key, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def run(batches):
        encoder = library_encoder(path)
        for batch in batches:
            for part, texts in arrow_slices(batch, 1):
                ids, counts = encoder.encode(texts)
                at = np.concatenate([[0], np.cumsum(counts)])
                rows, start, length, crc, total, body = [], [], [], [], [], []
                for i in range(len(texts)):
                    full = np.append(ids[at[i]:at[i + 1]].astype("<u4"), np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(full), window):
                        data = full[s:s + window].tobytes()
                        rows.append(i)
                        start.append(s)
                        length.append(len(data) // 4)
                        crc.append(zlib.crc32(data))
                        total.append(len(full))
                        if keep_ids:
                            body.append(data)
                cols = [part.column(0).take(pa.array(rows, pa.int64()))]
                cols += [pa.array(v, pa.int64()) for v in (start, length, crc, total)]
                if keep_ids:
                    cols.append(pa.array(body, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = base.schema[key].dataType.simpleString()
    return base.mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long"
                           + ", ids binary" * keep_ids)


def pack_documents(docs: DataFrame, key: str = "doc_id", path: str | None = None, end_id: int = 1,
                   window: int = WINDOW, shard_pieces: int = SHARD_PIECES, keep_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``window`` ids.

    Returns a row a piece: key, start, length, ids_crc32, doc_tokens,
    sequence_id (gapless from 0) and offset, with ``keep_ids`` also ids.  A
    null or empty text is its end id alone; repeated rows are documents of
    their own; a null key is kept; an empty table gives no rows; other
    columns are not read.
    """
    path = path or tokenizer_path(TOKENIZER)
    cut = cut_documents(docs, key, path, end_id, window, keep_ids)
    pieces = stage(cut.withColumn("_piece", F.monotonically_increasing_id()))
    narrow = pieces.select("_piece", key, "start", "length", "ids_crc32", "doc_tokens")
    shards = max(1, -(-narrow.count() // shard_pieces))
    placed = narrow.withColumn("_shard", F.pmod(F.xxhash64("_piece"), F.lit(shards)))

    def pack(group: pa.Table) -> pa.Table:
        # longest first; equal lengths in the order of key, start and piece
        t = group.sort_by([("length", "descending"), (key, "ascending"), ("start", "ascending"),
                           ("_piece", "ascending")])
        sequences, offsets = best_fit_decreasing(t.column("length").to_pylist(), window)
        return (t.append_column("_local", pa.array(sequences, pa.int64()))
                .append_column("offset", pa.array(offsets, pa.int64())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    packed = stage(placed.groupBy("_shard").applyInArrow(pack, f"{schema}, _local long, `offset` long"))
    # a row a shard: its sequences before those of the next shard
    sizes = packed.groupBy("_shard").agg((F.max("_local") + 1).alias("_n"))
    before = Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    # a table of its own: Spark broadcasts it by its size on disk, or not
    first = stage(sizes.select("_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    out = (packed.join(first, "_shard")
           .withColumn("sequence_id", F.col("_first") + F.col("_local")))
    if keep_ids:
        out = out.join(pieces.select("_piece", "ids"), "_piece")
    return out.select(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                      *["ids"] * keep_ids)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of the documents that are left."""
    return pack_documents(docs)
