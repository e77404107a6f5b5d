"""Exact ranking, tiling and quantiles without a single-partition step.

``ntile(n) over (order by x)`` and a global ``percentile`` both funnel every
row (or every distinct value) into one task.  Here the total order is
produced by a range-partitioned sort instead:

1. ``repartitionByRange`` on the full sort key (value columns + a unique
   tiebreak), so even a value held by a third of all rows is spread over
   many partitions; rows are then sorted inside each partition;
2. the in-partition position comes from ``monotonically_increasing_id``
   (partition id in the upper bits, position in the lower 33 bits);
3. the ranked frame is checkpointed to the cluster's shared checkpoint
   folder, so partition sizes and positions are read from one fixed copy
   (lineage is cut: a lost executor cannot re-sample different ranges);
4. per-partition row counts (one row per partition) give the offsets.

That is what a rank for every row costs.  Quantiles, quantile bins and tiles
need only a few rows of the order, so they select these
(:mod:`churnlens.operators.selection`) and never move the rest; the ranking
remains for unbounded groups, very many tiles and keys without an order
number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.operators.selection import Wanted, counts_of, not_before, orderable, select_keys, select_ranks
from churnlens.session import ensure_checkpoint_dir, materialize

_POS_BITS = 33  # monotonically_increasing_id keeps the in-partition index here


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sort_key(cols: Sequence) -> list[Column]:
    # nulls sort last, as in SQL ascending order and pandas
    return [_col(c).asc_nulls_last() for c in cols]


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    """Range partitions for a ranking: explicit, else the larger of the
    shuffle partitions and AQE's initial partition number (clusters tuned
    for AQE keep the former small and let coalescing shrink the latter;
    ranked partitions are never coalesced, so start from the larger)."""
    if num_partitions:
        return num_partitions
    conf = df.sparkSession.conf
    n = int(conf.get("spark.sql.shuffle.partitions"))
    initial = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(n, int(initial)) if initial else n


def global_rank(df: DataFrame, order_cols: Sequence, rank_col: str = "rank",
                num_partitions: int | None = None, materialized: bool = False) -> DataFrame:
    """Add ``rank_col`` = 1-based row number over ``order_cols`` (ascending,
    nulls last).  ``order_cols`` must define a total order (end with a
    unique tiebreak); ties would be numbered arbitrarily but consistently.

    The input is read twice (range sampling, then the sort), so unless
    ``materialized`` says it already is a checkpoint it is written once
    first.  Returns a DataFrame over the checkpointed ranked data.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if not materialized:
        df = materialize(df)
    keys = _sort_key(order_cols)
    ranged = (df.repartitionByRange(_num_partitions(df, num_partitions), *keys)
              .sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    # one row per partition: ordering this tiny frame in one task is harmless
    offsets = (ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(
                   F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
                       Window.unboundedPreceding, -1)), F.lit(0)))
               .select("_pid", "_off"))
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), _POS_BITS)
    # offsets has exactly one row per partition of `ranged`: bounded broadcast
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(rank_col, F.col("_off") + pos + 1)
            .drop("_pid", "_mid", "_off"))


def tile_of(rank, n, tiles: int) -> Column:
    """NTILE bucket of a 1-based ``rank`` among ``n`` rows.

    The first ``n % tiles`` buckets hold one row more, as in SQL NTILE.
    """
    rank, n = _col(rank), _col(n)
    q = F.floor(n / tiles)
    r = n - q * tiles
    big = r * (q + 1)
    return F.when(rank <= big, F.ceil(rank / (q + 1))) \
        .otherwise(r + F.ceil((rank - big) / F.when(q > 0, q))).cast("int")


#: More tiles than this are taken from a rank for every row.
MOST_CUTS = 64


def ntile_score(df: DataFrame, value_col: str, tiebreak: Sequence[str] | str,
                tiles: int = 5, out: str = "tile", invert: bool = False,
                num_partitions: int | None = None, materialized: bool = False) -> DataFrame:
    """Exact ``NTILE(tiles) OVER (ORDER BY value, tiebreak)`` computed in
    parallel; ``invert`` gives ``tiles + 1 - ntile`` (e.g. recency).

    Only the first keys of the tiles are selected and every row is compared
    with them.  Over ``MOST_CUTS`` tiles, or with keys of a type that has no
    order number, all rows are ranked instead.  Rows that are equal in value
    and tiebreak get the same tile.  ``materialized=True``: ``df`` is already
    a cheap view of a written copy; else it is written once."""
    keys = [value_col, *([tiebreak] if isinstance(tiebreak, str) else tiebreak)]
    if tiles > MOST_CUTS or not orderable(df, keys):
        return _ntile_by_rank(df, keys, tiles, out, invert, num_partitions, materialized)
    if not materialized:
        df = materialize(df)
    (n, known), = counts_of(df, [(value_col, None)])
    q, r = divmod(n, tiles)
    starts = [i * q + min(i, r) for i in range(1, tiles)]
    starts = [s for s in starts if s < n]
    tile = F.lit(1)
    if starts:
        for cut in select_keys(df.select(*dict.fromkeys(keys)), keys, starts, known):
            tile = tile + not_before(df, keys, cut).cast("int")
    return df.withColumn(out, (F.lit(tiles + 1) - tile if invert else tile).cast("int"))


def _ntile_by_rank(df: DataFrame, keys: list, tiles: int, out: str, invert: bool,
                   num_partitions: int | None, materialized: bool) -> DataFrame:
    ranked = global_rank(df, keys, "_rk", num_partitions, materialized=materialized)
    total = ranked.agg(F.count(F.lit(1)).alias("_cnt"))
    tile = tile_of("_rk", "_cnt", tiles)
    if invert:
        tile = F.lit(tiles + 1) - tile
    # `total` is a single row: bounded broadcast
    return (ranked.crossJoin(F.broadcast(total))
            .withColumn(out, tile.cast("int")).drop("_rk", "_cnt"))


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    by: Sequence[str] = (), prefix: str = "q",
                    num_partitions: int | None = None, materialized: bool = False,
                    max_groups: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (``quantile_cont`` / pandas), one row
    per group of ``by`` with ``{prefix}0..`` and ``n`` (non-null count).
    Null values and null groups are ignored.

    Without ``by``, or when the caller bounds the number of groups with
    ``max_groups``, the few ranks are selected; with unbounded groups all
    rows are ranked."""
    by = list(by)
    if by and max_groups is None:
        return _quantiles(df, value_col, probs, by, prefix, num_partitions, materialized)
    base = df.select(*by, F.col(value_col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    for b in by:
        base = base.filter(F.col(b).isNotNull())
    if not materialized:
        base = materialize(base)
    groups = [()]
    if by:
        groups = [tuple(r) for r in base.select(*by).distinct().limit(max_groups + 1).collect()]
        if len(groups) > max_groups:
            return _quantiles(base, "_v", probs, by, prefix, num_partitions, True)
    filters = []
    for g in groups:
        where = None
        for b, v in zip(by, g):
            same = F.col(b) == F.lit(v)
            where = same if where is None else where & same
        filters.append(where)
    sizes = [n for _, n in counts_of(base, [("_v", w) for w in filters])] if groups else []
    wanted: dict[tuple, Wanted] = {}
    for j, n in enumerate(sizes):
        for p in probs:
            low = int((n - 1) * float(p))
            for rank in {low, min(low + 1, n - 1)} if n else ():
                wanted[j, rank] = Wanted("_v", rank, filters[j], n)
    select_ranks(base, list(wanted.values()))
    rows = []
    for j, n in enumerate(sizes):
        if not n and by:
            continue
        row = [*groups[j], n]
        for p in probs:
            h = (n - 1) * float(p)
            low = int(h)
            if not n:
                row.append(None)
                continue
            a, b = wanted[j, low].value, wanted[j, min(low + 1, n - 1)].value
            row.append(a + (b - a) * (h - low))
        rows.append(tuple(row))
    types = [f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by]
    schema = ", ".join([*types, "n bigint", *[f"{prefix}{i} double" for i in range(len(probs))]])
    return df.sparkSession.createDataFrame(rows, schema)


def approx_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                     by: Sequence[str] = (), prefix: str = "q",
                     accuracy: int = 10000) -> DataFrame:
    """Approximate quantiles with Spark's ``percentile_approx`` sketch:
    one aggregation with partial (map-side) sketches, no ranking pass.
    Rank error is about ``1 / accuracy``; use :func:`exact_quantiles` where
    results must match pandas / SQL exactly."""
    by = list(by)
    src = df.filter(F.col(value_col).isNotNull())
    for b in by:
        src = src.filter(F.col(b).isNotNull())
    arr = F.percentile_approx(F.col(value_col).cast("double"), list(probs), accuracy)
    agg = src.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), arr.alias("_qs"))
    return agg.select(*by, "n", *[F.col("_qs")[i].alias(f"{prefix}{i}")
                                  for i in range(len(probs))])


def _quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
               by: list, prefix: str, num_partitions: int | None,
               materialized: bool = False, max_groups: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (``quantile_cont``/pandas semantics),
    one row per group of ``by`` with columns ``{prefix}0..{prefix}{k-1}``
    and ``n`` (non-null count).  Null values and null groups are ignored
    (pandas ``groupby`` drops null keys).  Only the narrow (group, value)
    projection is materialized and ranked (``materialized=True``: ``df`` is
    already a cheap projection of a checkpoint, so it is ranked directly).

    The ranks to read are a frame of (groups × probabilities × 2) rows.
    With no ``by``, or when the caller bounds the number of groups with
    ``max_groups``, it is broadcast, so the ranked rows are filtered in
    place instead of being shuffled to meet it; otherwise AQE decides.
    """
    base = df.select(*by, F.col(value_col).cast("double").alias("_v")) \
        .filter(F.col("_v").isNotNull())
    for b in by:
        base = base.filter(F.col(b).isNotNull())
    # Tied values are equal, so their order does not change any quantile;
    # but range partitioning cannot split identical keys, so a value held
    # by a third of the rows would land in one partition.  A row-position
    # tiebreak makes every key unique (stable: it is stored with the
    # materialized input, or recomputed over the same checkpointed files).
    base = base.withColumn("_tb", F.monotonically_increasing_id())
    ranked = global_rank(base, [*by, "_v", "_tb"], "_rk", num_partitions,
                         materialized=materialized)
    groups = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                     F.min("_rk").alias("_first"))
    wanted = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(float(p))
        lo = F.floor(h)
        wanted.append(F.struct(F.lit(i).alias("_i"),
                               (F.col("_first") + lo).alias("_lo"),
                               (F.col("_first") + F.least(lo + 1, F.col("n") - 1)).alias("_hi"),
                               (h - lo).alias("_frac")))
    need = groups.select(*by, "n", F.explode(F.array(*wanted)).alias("_w")) \
        .select(*by, "n", "_w.*")
    pts = ranked.select("_rk", "_v")
    lo_v = pts.withColumnsRenamed({"_rk": "_lo", "_v": "_vlo"})
    hi_v = pts.withColumnsRenamed({"_rk": "_hi", "_v": "_vhi"})
    if not by or max_groups is not None:
        need = F.broadcast(need)  # at most max_groups x len(probs) rows
        # rank -> value pairs of the wanted ranks only: each side is a
        # broadcast-hash filter over the ranked rows, no shuffle
        lo_pick = lo_v.join(need.select("_lo").distinct().hint("broadcast"), "_lo", "left_semi")
        hi_pick = hi_v.join(need.select("_hi").distinct().hint("broadcast"), "_hi", "left_semi")
        # ranks are unique, so each pick has at most one row per needed rank
        vals = need.join(F.broadcast(lo_pick), "_lo").join(F.broadcast(hi_pick), "_hi")
    else:
        vals = need.join(lo_v, "_lo").join(hi_v, "_hi")
    vals = vals.withColumn("_q", F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac"))
    aggs = [F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"{prefix}{i}")
            for i in range(len(probs))]
    return vals.groupBy(*by).agg(F.max("n").alias("n"), *aggs)


def quantile_bins(df: DataFrame, specs: dict[str, str], probs: Sequence[float],
                  on_duplicate: str = "error", num_partitions: int | None = None,
                  materialized: bool = False) -> DataFrame:
    """Right-closed quantile bins (``pandas.qcut`` semantics) for several
    columns (``specs``: output column → value column) with ONE ranking
    pass over the stacked (variable, value) pairs.  Bin 1 holds values ≤
    the first edge (the minimum included), bin k+1 values above the last.
    Repeated edges fail the job (``on_duplicate='error'``) or are collapsed
    (``'drop'``).  Null values get a null bin.
    """
    if on_duplicate not in ("error", "drop"):
        raise ValueError("on_duplicate must be 'error' or 'drop'")
    if not materialized:
        df = materialize(df)  # read twice: edges, then binning
    outs = list(specs)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("_var"), F.col(specs[o]).cast("double").alias("_x"))
        for i, o in enumerate(outs)])).alias("_s")).select("_s.*")
    per_var = exact_quantiles(long, "_x", probs, ["_var"], "_e", num_partitions, materialized=True,
                              max_groups=len(outs))
    k = len(probs)
    # one row: edge j of variable i becomes column _e{i}_{j}
    edges = per_var.agg(*[F.max(F.when(F.col("_var") == i, F.col(f"_e{j}"))).alias(f"_e{i}_{j}")
                          for i in range(len(outs)) for j in range(k)])
    bin_cols = {}
    for i, o in enumerate(outs):
        names = [f"_e{i}_{j}" for j in range(k)]
        x = F.col(specs[o]).cast("double")
        b = F.lit(1)
        for j, nme in enumerate(names):
            step = x > F.col(nme)
            if on_duplicate == "drop" and j:
                step = step & (F.col(nme) != F.col(names[j - 1]))
            b = b + F.when(step, 1).otherwise(0)
        if on_duplicate == "error" and k > 1:
            dup = None
            for a, c in zip(names, names[1:]):
                cond = F.col(a) == F.col(c)
                dup = cond if dup is None else dup | cond
            # added to the bin, so the check cannot be pruned away
            b = b + F.when(dup, F.raise_error(F.lit(
                f"quantile bins of {specs[o]}: bin edges must be unique"))).otherwise(F.lit(0))
        bin_cols[o] = F.when(x.isNotNull(), b).cast("int")
    # `edges` is a single row: bounded broadcast
    return (df.crossJoin(F.broadcast(edges)).withColumns(bin_cols).drop(*edges.columns))


def quantile_bin(df: DataFrame, value_col: str, probs: Sequence[float] = (0.2, 0.4, 0.6, 0.8),
                 out: str = "bin", on_duplicate: str = "error",
                 num_partitions: int | None = None, labels: Sequence | None = None,
                 label_col: str | None = None) -> DataFrame:
    """Single-column :func:`quantile_bins`.  With ``labels`` (one per bin,
    lowest first) the label of each row's bin is added as ``label_col``
    (default ``{out}_label``), like ``qcut(..., labels=...)``."""
    binned = quantile_bins(df, {out: value_col}, probs, on_duplicate, num_partitions)
    if labels is None:
        return binned
    if len(labels) != len(probs) + 1:
        raise ValueError("need one label per bin")
    lab = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col(out))
    return binned.withColumn(label_col or f"{out}_label", lab)


def first_row_per_key(df: DataFrame, key: Sequence[str] | str, order_cols: Sequence) -> DataFrame:
    """First row of each key under a total order (ascending, nulls last).

    ``row_number() = 1`` is planned with a partial WindowGroupLimit before
    the shuffle, so a key holding many rows ships one row per map task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*_sort_key(order_cols))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
