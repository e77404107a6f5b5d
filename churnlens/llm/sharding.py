"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Every (record key, shard) pair gets a uniform draw ``u`` from a hash of
both; the record goes to the shard with the smallest ``-ln(u) / weight``.
A shard's draw does not depend on the other shards, so a new shard only
takes the records whose draw on it is smallest and no record moves between
old shards.

Cases: a null key is a key of its own (all such rows share a shard); a
null text has size 1 and the checksum of the empty text; repeated rows are
separate records with slots of their own; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm.common import shuffle_partitions, stage, table

_DIGITS = 13  # hexadecimal digits of a draw: 52 bits, exact in a double


def draw_cost(key: Column, shard: int, weight: float) -> Column:
    """``-ln(u) / weight`` of a key on one shard."""
    digest = F.md5(F.concat(key, F.lit(f"#{shard}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 1) / F.lit(16.0 ** _DIGITS + 1)
    return -F.log(u) / F.lit(float(weight))


def choose_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among ``len(weights)`` shards (ties: the lower)."""
    name = F.coalesce(key.cast("string"), F.lit("\\N"))
    costs = [F.struct(draw_cost(name, s, w).alias("cost"), F.lit(s).alias("shard"))
             for s, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*costs))["shard"]


def _with_slots(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number the rows of each shard from 0 in ``order`` without gathering a
    shard in one task: range partitions hold consecutive rows, a row's
    place in its partition comes from the sorted order, and the counts per
    (shard, partition), at most partitions + shards rows, give the offsets."""
    keys = [F.col(c).asc_nulls_first() for c in ("shard", *order, "_row")]
    low = (1 << 33) - 1  # monotonically_increasing_id: place in the partition
    ranged = stage(
        rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(low))))
    counts = ranged.groupBy("shard", "_pid").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("shard").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # a table of its own, which Spark broadcasts where it is small by its size on disk
    offsets = stage(counts.select(
        "shard", "_pid", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off")))
    return (ranged.join(offsets, ["shard", "_pid"])
            .withColumn("slot", F.col("_off") + F.col("_at"))
            .drop("_pid", "_at", "_off", "_row"))


def shard_records(docs: DataFrame, n_shards: int = 8, weights: Sequence[float] | None = None,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """Assign every row to a shard by its key.

    ``weights`` (default: all 1) give the shards' relative shares; the
    grown layout adds one shard of the mean weight.  Returns key, size,
    text_crc32, shard, grown_shard and slot.
    """
    w = list(weights) if weights is not None else [1.0] * n_shards
    if len(w) != n_shards or not any(x > 0 for x in w):
        raise ValueError("weights must name every shard, and one must be positive")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        choose_shard(F.col(key), w).alias("shard"),
        choose_shard(F.col(key), [*w, sum(w) / len(w)]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"))
    return _with_slots(stage(rows), [key, "text_crc32"])


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 by the law `key`."""
    out = shard_records(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"),
                      "shard", "slot", "grown_shard")


def _nibble_crc_table() -> list[int]:
    out = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        out.append(c)
    return out


def oracle(n_shards: int = 8) -> str:
    """DuckDB SQL of ``op10_sharding`` (crc32 by half bytes)."""
    def pick(n):
        costs = ", ".join(
            f"struct_pack(cost := -ln((('0x' || substr(md5(k || '#{s}'), 1, {_DIGITS}))::BIGINT + 1)::DOUBLE"
            f" / (pow(16::DOUBLE, {_DIGITS}) + 1)), shard := {s})" for s in range(n))
        return f"list_sort([{costs}])[1].shard"

    crc = "[" + ", ".join(map(str, _nibble_crc_table())) + "]::BIGINT[]"
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '\\N') AS k, encode(coalesce(text, '')) AS body FROM documents
), digits AS (
  SELECT doc_id, k, octet_length(body)::BIGINT + 1 AS size, string_split(hex(body), '') AS h FROM base
), halves AS (
  SELECT doc_id, k, size, list_transform(range(0, size * 2 - 2),
    lambda i: (instr('0123456789ABCDEF', h[i // 2 * 2 + 2 - i % 2]) - 1)::BIGINT) AS nib FROM digits
), placed AS (
  SELECT doc_id, size,
    xor(list_reduce(list_concat([4294967295::BIGINT], nib),
        lambda c, d: xor(c >> 4, ({crc})[xor(c, d) % 16 + 1])), 4294967295::BIGINT) AS text_crc32,
    {pick(n_shards)} AS shard, {pick(n_shards + 1)} AS grown_shard
  FROM halves
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, grown_shard
FROM placed"""
