"""The hand-over files of a run, written together and published last.

All tables of a run are written below ``runs/<run id>``; a manifest that
names them and their schemas is then written under a temporary name and
renamed into ``manifests/``.  Readers take the newest manifest, so they see
either all tables of a run or none, and a run that fails leaves the manifest
before it in force.  Paths may be on any file system Spark writes to.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from churnlens.plans import catalog
from churnlens.sources.files import write_csv, write_parquet

#: output -> (registered analysis, formats)
OUTPUTS = {
    "master_delivered": ("master_delivered", ("parquet", "csv")),
    "rfm_segmentation": ("rfm_scores_qcut", ("parquet", "csv")),
    "segment_summary": ("rfm_segments_qcut", ("csv",)),
    "first_orders_analysis": ("first_orders", ("parquet",)),
    "review_retention": ("review_retention", ("csv",)),
    "category_retention": ("category_retention_nb", ("csv",)),
    "spend_retention": ("spend_bucket_retention", ("csv",)),
}
_WRITERS = {"parquet": write_parquet, "csv": write_csv}


def run_outputs(spark: SparkSession, sf_dir: str, path: str, outputs=None) -> str:
    """Write every output of ``sf_dir`` and publish them; the run id."""
    run = f"{time.time_ns() // 1000:020d}-{uuid.uuid4().hex[:8]}"
    tables = {}
    # every output of ours is of delivered rows
    with catalog.suite(spark, sf_dir, stage_master=False):
        for name, (analysis, formats) in (outputs or OUTPUTS).items():
            df = catalog.QUERIES[analysis](spark, sf_dir)
            for fmt in formats:
                _WRITERS[fmt](df, f"{path}/runs/{run}/{name}.{fmt}")
            tables[name] = {"formats": list(formats), "schema": json.loads(df.schema.json())}
    _publish(spark, path, run, {"run": run, "tables": tables})
    return run


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _publish(spark: SparkSession, path: str, run: str, manifest: dict) -> None:
    jvm, folder, fs = _fs(spark, f"{path}/manifests")
    fs.mkdirs(folder)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/_{run}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    if not fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{run}.json")):
        raise OSError(f"could not publish run {run}")


def published(spark: SparkSession, path: str) -> dict:
    """The newest manifest below ``path``."""
    jvm, folder, fs = _fs(spark, f"{path}/manifests")
    if not fs.exists(folder):
        raise FileNotFoundError(f"nothing is published below {path}")
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
    names = [n for n in names if n.endswith(".json") and not n.startswith(("_", "."))]
    if not names:
        raise FileNotFoundError(f"nothing is published below {path}")
    text = spark.read.text(f"{path}/manifests/{names[-1]}", wholetext=True).first()[0]
    return json.loads(text)


def read_output(spark: SparkSession, path: str, name: str, fmt: str | None = None,
                manifest: dict | None = None) -> DataFrame:
    """One published table, by the manifest's schema."""
    manifest = manifest or published(spark, path)
    table = manifest["tables"][name]
    fmt = fmt or table["formats"][0]
    reader = spark.read.schema(StructType.fromJson(table["schema"]))
    at = f"{path}/runs/{manifest['run']}/{name}.{fmt}"
    if fmt == "parquet":
        return reader.parquet(at)
    return reader.option("header", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(at)
