"""Shared helpers: table access, Arrow batch mapping and staged tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from churnlens.session import delete_path, write_stage

#: Rows and text characters that a task holds as Python objects at once.
SLICE_ROWS = 2048
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet below ``spark.checkpoint.dir`` and read
    it back: later reads, retries and lost executors use that copy."""
    return write_stage(df)


def drop_stage(df: DataFrame) -> None:
    """Delete the table of a staged frame that nothing reads any more."""
    delete_path(df.sparkSession, df._churnlens_stage_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(key: Column) -> Column:
    """crc32 of an id's decimal text, which fixes the held-out folds."""
    return F.crc32(key.cast("string"))


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Row slices of a batch with their texts (null: empty) as Python
    strings, bounded by rows and by characters."""
    col = batch.column(batch.schema.names.index(text))
    sizes = pc.binary_length(col).fill_null(0).to_pylist()
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and (i - begin >= SLICE_ROWS or held + n > SLICE_CHARS):
            yield batch.slice(begin, i - begin), _texts(col, begin, i)
            begin, held = i, 0
        held += n
    if len(sizes) > begin:
        yield batch.slice(begin), _texts(col, begin, len(sizes))


def arrow_slices(batch: pa.RecordBatch, text: int, chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Row slices of a batch with their texts (null: empty) as an Arrow
    array, of about ``chars`` bytes."""
    col = batch.column(text).fill_null("")
    ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(col):
        held = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, held + chars, side="right")))
        yield batch.slice(begin, end - begin), col.slice(begin, end - begin)
        begin = end


def _texts(col: pa.Array, i: int, j: int) -> list[str]:
    return [x if x is not None else "" for x in col.slice(i, j - i).to_pylist()]


def map_texts(df: DataFrame, fn: Callable[[list[str]], dict], schema: str,
              keep: list[str], text: str = "text") -> DataFrame:
    """Map slices of texts to columns of the same length.

    ``fn`` gets a list of texts and returns ``{column: values}``; the
    columns in ``keep`` are passed through, but those that have a new
    column's name.  ``schema`` is the DDL of the new columns.
    """
    taken = {n.lower() for n in StructType.fromDDL(schema).names}
    keep = [c for c in keep if c.lower() not in taken]
    base, read = df.select(*keep), text
    if text not in keep or dict(base.dtypes)[text] != "string":
        read = "_text"
        base = df.select(*keep, F.col(text).cast("string").alias(read))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:len(keep)])

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, read):
                new = fn(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.array(v) if not isinstance(v, pa.Array) else v for v in new.values()],
                    names=[*keep, *new])

    return base.mapInArrow(run, f"{kept}, {schema}" if kept else schema)


def keep_texts(docs: DataFrame, test: Callable[[list[str]], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts pass ``test`` (a list of texts to
    booleans), with all columns as they were: columns go by place, so that
    no name clashes with the mark."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    marked = map_texts(docs.toDF(*names), lambda texts: {"pass": pa.array(np.asarray(test(texts), bool))},
                       "pass boolean", names, names[docs.columns.index(text)])
    return marked.filter("pass").select(*names).toDF(*docs.columns)


_CUT = re.compile(r"(?<=\S) (?=\S)")
SLAB_CHARS = 1 << 20


def slabs(text: str, size: int = SLAB_CHARS) -> Iterator[str]:
    """A very long text in parts of about ``size`` characters, cut only
    before a single space between two non-space characters: no word
    pattern of the tokenizers used here looks across such a place."""
    begin = 0
    while len(text) - begin > size:
        m = _CUT.search(text, begin + size)
        if not m:
            break
        yield text[begin:m.start()]
        begin = m.start()
    yield text[begin:] if begin else text
