"""Ranked lexical search with bag deduplication.

For each item of a query table the ``k`` best documents:

1. One pass over whole texts keeps of every document its number of terms and
   its bag: the item vocabulary's terms in it with their frequencies.
2. The score depends on a document only by its bag and its length factor m.
   Documents are grouped by a hash of both, verified by both themselves, and
   a class is scored once.
3. Each task keeps every item's ``k`` best classes (score, then least id);
   any document among an item's ``k`` best is in one of its ``k`` best
   classes.  Only those classes' members are looked up and put in order.

Items are taken in blocks of a bounded vocabulary, so what a task holds does
not grow with the item table; a block is a pass of its own over the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm.common import map_texts, stage, table

K = 10
#: Items and distinct terms of one block of queries.
BLOCK_ITEMS = 2048
BLOCK_TERMS = 100_000
#: Partial scores (class and item) that a task holds at once.
PAIRS = 1 << 22

# Fixed values of the score: separators in ASCII, integer weights.
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text: ASCII letters (A-Z lower-cased), digits and all
    characters beyond ASCII; bytes of such characters are never separators."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class Block:
    """A block of items: its vocabulary and the items of every term."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.numbers: dict[bytes, int] = {}
        pairs = sorted({(self.numbers.setdefault(t, len(self.numbers)), i) for i, ts in items for t in ts})
        self.item = np.array([i for _, i in pairs], np.int64)
        self.start = np.searchsorted([t for t, _ in pairs], np.arange(len(self.numbers) + 1))

    def bags(self, texts: list[str]) -> dict:
        """Number of terms and bag (term numbers and frequencies, by term)."""
        sizes, bags = [], []
        known = self.numbers
        for text in texts:
            found = terms(text)
            sizes.append(len(found))
            own = [known[t] for t in found if t in known]
            term, tf = np.unique(np.array(own, np.int64), return_counts=True)
            bags.append(np.column_stack([term, tf]).astype("<i8").tobytes() if own else None)
        return {"n": pa.array(sizes, pa.int64()), "bag": pa.array(bags, pa.binary())}

    def best(self, classes, m: np.ndarray, weight: np.ndarray, low: np.ndarray, k: int):
        """(class, item, score): each item's ``k`` best of some classes.
        ``classes`` holds their bags, ``low`` their least ids (for ties)."""
        sizes = np.array([len(b) // 16 for b in classes])
        flat = np.frombuffer(b"".join(classes), "<i8").reshape(-1, 2)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        term, tf = flat[:, 0], flat[:, 1]
        part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
        some = np.flatnonzero(part > 0)
        owner, term, part = owner[some], term[some], part[some]
        fan = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - (np.cumsum(fan) - fan), fan) + np.arange(int(fan.sum()))
        items = int(self.item.max()) + 1
        cell = np.repeat(owner, fan) * items + self.item[at]
        by = np.argsort(cell, kind="stable")
        cell = cell[by]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        score = np.add.reduceat(np.repeat(part, fan)[by], first) if len(first) else np.zeros(0, np.int64)
        who, item = cell[first] // items, cell[first] % items
        return first_of_each(who, item, score, low[who], k)


def first_of_each(who: np.ndarray, item: np.ndarray, score: np.ndarray, low: np.ndarray, k: int):
    """Each item's ``k`` rows of the highest score, ties to the least id."""
    by = np.lexsort((low, -score, item))
    item = item[by]
    begin = np.searchsorted(item, item)
    by = by[np.arange(len(item)) - begin < k]
    return who[by], item[np.arange(len(item)) - begin < k], score[by], low[by]


def _parts(bags: list[bytes], block: Block):
    """Ranges of classes of at most about ``PAIRS`` partial scores."""
    widest = max(1, int(np.diff(block.start).max()))
    begin, held = 0, 0
    for i, b in enumerate(bags):
        if i > begin and held + len(b) // 16 * widest > PAIRS:
            yield begin, i
            begin, held = i, 0
        held += len(b) // 16 * widest
    if len(bags) > begin:
        yield begin, len(bags)


def _search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of one block of items; ``docs`` has a
    long ``doc_id`` and ``text``."""
    found = stage(map_texts(docs, block.bags, "n long, bag binary", ["doc_id"]).filter("n > 0"))
    # one row
    totals = found.agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    big_n, big_l = int(totals["N"]), int(totals["L"])
    held = found.filter("bag is not null").withColumn(
        "m", F.lit(10) + F.expr(f"(cast(90 as decimal(38, 0)) * n * {big_n}) div {max(big_l, 1)}"))
    held = held.select("doc_id", "bag", "m", F.xxhash64("bag", "m").alias("h"))
    # a hash of bag and m, verified by both; a null id is the greatest
    classes = stage(held.groupBy("h", "bag", "m").agg(
        F.count(F.lit(1)).alias("members"),
        F.coalesce(F.min("doc_id"), F.lit((1 << 63) - 1)).alias("low")))

    def spread(batches):
        seen = np.zeros(len(block.numbers), np.int64)
        for batch in batches:
            bags, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            sizes = [len(b) // 16 for b in bags]
            flat = np.frombuffer(b"".join(bags), "<i8").reshape(-1, 2)
            np.add.at(seen, flat[:, 0], np.repeat(n, sizes))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["term", "df"])

    # at most one row a term of the block's vocabulary
    df = np.zeros(len(block.numbers), np.int64)
    for r in classes.select("bag", "members").mapInArrow(spread, "term long, df long") \
            .groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weight = np.floor(1000 * np.log((2 * big_n + 2) / (2 * df + 1))).astype(np.int64)

    def score(batches):
        best = [np.zeros(0, np.int64)] * 5  # item, score, low, h, m
        bag_of = []
        for batch in batches:
            bags = batch.column(1).to_pylist()
            h, m, low = (batch.column(i).to_numpy() for i in (0, 2, 3))
            for i, j in _parts(bags, block):
                who, item, got, least = block.best(bags[i:j], m[i:j], weight, low[i:j], k)
                bag_of += [bags[i + w] for w in who]
                item, got, least, h2, m2 = (np.concatenate([a, b]) for a, b in zip(
                    best, (item, got, least, h[i:j][who], m[i:j][who])))
                keep, item, got, least = first_of_each(np.arange(len(item)), item, got, least, k)
                best = [item, got, least, h2[keep], m2[keep]]
                bag_of = [bag_of[x] for x in keep]
        yield pa.RecordBatch.from_arrays([*map(pa.array, best), pa.array(bag_of, pa.binary())],
                                         names=["item", "score", "low", "h", "m", "bag"])

    cls = "item long, score long, low long, h long, m long, bag binary"
    ahead = Window.partitionBy("item").orderBy(F.desc("score"), "low")
    tops = stage(classes.select("h", "bag", "m", "low").mapInArrow(score, cls)
                 .withColumn("r", F.row_number().over(ahead)).filter(F.col("r") <= k).drop("r", "low"))
    # the first k members of every class that leads some item's list
    inside = Window.partitionBy("h", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
    members = (held.join(tops.select("h", "m", "bag").distinct(), ["h", "m", "bag"], "left_semi")
               .withColumn("r", F.row_number().over(inside)).filter(F.col("r") <= k).drop("r"))
    final = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return (tops.join(members, ["h", "m", "bag"]).withColumn("rank", F.row_number().over(final))
            .filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", item_key: str = "item_id",
                  block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Each item's ``k`` best documents: item_id, rank, doc_id, score.

    Null and empty texts, of documents or items, have no terms; an item
    without a term in any document has no rows.  Scores are exact integers,
    ties go to the smaller id, a null id comes last.  Every row of a repeated
    document has its own place; every row of a repeated item its own list.
    Texts of any length are read whole, other columns are not read.  Empty
    tables give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the query set, numbered; a block of it at a time is in the driver
    asked = stage(items.select(F.col(item_key).alias("item_id"), F.col("text").cast("string").alias("text"))
                  .withColumn("item", F.monotonically_increasing_id()))
    out = spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    held: list[tuple[int, list[bytes]]] = []
    vocabulary: set[bytes] = set()

    def blocks():
        nonlocal held, vocabulary
        for row in asked.select("item", "text").toLocalIterator():
            own = sorted(set(terms(row["text"])))
            if held and (len(held) >= block_items or len(vocabulary | set(own)) > block_terms):
                yield held
                held, vocabulary = [], set()
            if own:
                held.append((row["item"], own))
                vocabulary.update(own)
        if held:
            yield held

    for part in blocks():
        numbers = [i for i, _ in part]
        names = spark.createDataFrame(list(enumerate(numbers)), "place long, item long")
        found = _search_block(docs, Block([(j, ts) for j, (_, ts) in enumerate(part)]), k)
        out = out.unionByName(found.withColumnRenamed("item", "place").join(names, "place")
                              .select("item", "rank", "doc_id", "score"))
    return out.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle(k: int = K) -> str:
    """DuckDB SQL: every document against every item over shared terms."""
    def split(t: str) -> str:
        return (rf"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                rf"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

    return f"""
    WITH q AS (SELECT DISTINCT item_id, unnest({split('text')}) AS term FROM benchmark),
    d AS (SELECT doc_id, {split('text')} AS w FROM documents),
    big AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
    t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d)
          WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    v AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
          FROM t, big GROUP BY term),
    s AS (SELECT item_id, doc_id, CAST(sum(v.w * ((1000000000 * tf)
                 // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms))))) AS BIGINT) AS score
          FROM q JOIN t USING (term) JOIN v USING (term), big GROUP BY item_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {k}"""
