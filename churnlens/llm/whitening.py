"""Embedding whitening by FEAST contour integration.

Vectors become integers, so sums and second moments over all rows are exact:
tasks add up their rows about a common integer offset, Spark adds up the
tasks, and only the moments of one dimension pair each reach the driver.

The covariance is then cut into intervals by inertia counts (the signs of the
pivots of an LDL factorisation tell how many eigenvalues lie below a shift).
In an interval a quadrature over the circle around it, of complex shifted
solves, projects a block of vectors onto the interval's eigenspace; a
Rayleigh-Ritz step extracts the components, and is repeated until their
residuals vanish.  The inertia counts say how many there must be, so none is
missed and none is found twice.

Rows are whitened in place, and the covariance of the whitened rows is
measured, not derived.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.common import stage, table
from churnlens.llm.vectors import finite

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Eigenvalues of one interval, and points of the quadrature on a half circle.
PER_INTERVAL = 8
POINTS = 8
#: Components whose variance is below this share of the largest are no
#: directions of the data but rounding, and are not returned.
LEAST_SHARE = 1e-13
_SAFE = 1 << 53


# -- exact moments -------------------------------------------------------------

def exact_gram(y: np.ndarray) -> np.ndarray:
    """y'y of integers, exact (int64, or Python integers where needed)."""
    if not y.size:
        return np.zeros((y.shape[1], y.shape[1]), np.int64)
    top = max(abs(int(y.min())), abs(int(y.max())))
    if top * top * len(y) < _SAFE:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    whole = y.astype(object)
    return whole.T @ whole


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype != object and b.dtype != object:
        if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 1 << 61:
            return a + b
    return a.astype(object) + b.astype(object)


def _integers(column: pa.Array) -> np.ndarray:
    """Rows of whole vectors (floor(64 c) + 1000000) as int64."""
    width = len(column[0]) if len(column) else 0
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x


def moments(rows: DataFrame, width: int, offset: np.ndarray) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, second moments) about ``offset`` of the integer vectors
    ``x``, exact.  Every task adds up its rows, every row of the moment
    matrix is added up by a task of its own."""
    def part(batches):
        n, sums, gram = 0, np.zeros(width, np.int64), np.zeros((width, width), np.int64)
        for batch in batches:
            y = _integers(batch.column(0))
            if not len(y):
                continue
            y = y - offset if max(abs(int(y.min())), abs(int(y.max()))) < 1 << 61 else y.astype(object) - offset
            n += len(y)
            sums = added(sums, y.sum(axis=0))
            gram = added(gram, exact_gram(y))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()),
                 pa.array([pickle.dumps((sums[i], gram[i]), 5) for i in range(width)], pa.binary())],
                names=["i", "n", "part"])

    def total(group: pa.Table) -> pa.Table:
        n, s, g = 0, 0, np.zeros(width, np.int64)
        for count, blob in zip(group.column("n").to_pylist(), group.column("part").to_pylist()):
            own, row = pickle.loads(blob)
            n, s, g = n + count, s + int(own), added(g, row)
        return pa.table({"i": group.column("i").slice(0, 1), "n": [n],
                         "part": pa.array([pickle.dumps((s, g), 5)], pa.binary())})

    schema = "i int, n long, part binary"
    # one row a dimension
    found = rows.select("x").mapInArrow(part, schema).groupBy("i").applyInArrow(total, schema).collect()
    sums, gram, n = [0] * width, [np.zeros(width, np.int64)] * width, 0
    for r in found:
        n = r["n"]
        sums[r["i"]], gram[r["i"]] = pickle.loads(r["part"])
    return n, sums, np.array(gram)


def covariance(n: int, sums: list[int], gram: np.ndarray) -> np.ndarray:
    """Second central moments over n, each rounded once from integers."""
    width = len(sums)
    v = np.zeros((width, width))
    for i in range(width):
        for j in range(i + 1):
            v[i, j] = v[j, i] = (n * int(gram[i][j]) - sums[i] * sums[j]) / (n * n)
    return v


# -- FEAST -------------------------------------------------------------------------

def inertia(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of symmetric ``a`` lie below ``shift``: negative
    pivots of an LDL factorisation with 1x1 and 2x2 pivots (Bunch-Parlett)."""
    b = a - shift * np.eye(len(a))
    below = 0
    keep = (1 + 17 ** 0.5) / 8
    while len(b):
        off = np.abs(b - np.diag(np.diag(b)))
        d = int(np.argmax(np.abs(np.diag(b))))
        r, c = np.unravel_index(int(np.argmax(off)), off.shape)
        if abs(b[d, d]) >= keep * off[r, c]:
            pivot = b[d, d]
            if pivot == 0:
                return below  # all that is left is zero: none is below
            below += pivot < 0
            rest = np.delete(np.arange(len(b)), d)
            column = b[rest, d]
            b = b[np.ix_(rest, rest)] - np.outer(column, column) / pivot
        else:
            two, rest = [r, c], np.delete(np.arange(len(b)), [r, c])
            below += 1  # a 2x2 pivot of this rule has one eigenvalue of either sign
            b = b[np.ix_(rest, rest)] - b[np.ix_(rest, two)] @ np.linalg.solve(b[np.ix_(two, two)], b[np.ix_(two, rest)])
    return below


def intervals(a: np.ndarray, k: int, most: int = PER_INTERVAL) -> Iterator[tuple[float, float, int]]:
    """(low, high, count) of intervals that hold the ``k`` largest
    eigenvalues, at most ``most`` each unless they are all but equal."""
    width = len(a)
    reach = float(np.abs(a).sum(axis=1).max()) * (1 + 1e-12) or 1.0
    counts: dict[float, int] = {-reach: 0, reach: width}

    def below(x: float) -> int:
        if x not in counts:
            counts[x] = inertia(a, x)
        return counts[x]

    todo, found = [(-reach, reach)], 0
    while todo and found < k:
        low, high = todo.pop()
        n = below(high) - below(low)
        if not n:
            continue
        if n > most and high - low > 1e-11 * reach:
            middle = (low + high) / 2
            todo += [(low, middle), (middle, high)]  # the upper half first
            continue
        found += n
        yield low, high, n


def feast(a: np.ndarray, low: float, high: float, count: int, points: int = POINTS, rounds: int = 40,
          seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of the ``count`` eigenvalues of
    symmetric ``a`` between ``low`` and ``high``."""
    width = len(a)
    size = float(np.abs(a).sum(axis=1).max()) or 1.0
    # a circle a little wider than the interval, so that its ends converge too
    centre, radius = (low + high) / 2, max((high - low) / 2 * 1.05, 1e-12 * size)
    node, weight = np.polynomial.legendre.leggauss(points)
    angle = -np.pi / 2 * (node - 1)
    turn = np.exp(1j * angle)
    for wide in (False, True):
        block = count + max(4, count // 2)
        if wide:
            # all that lies in the circle of twice that radius, so that the rest fades fast
            near = inertia(a, centre + 2 * radius) - inertia(a, centre - 2 * radius)
            block = max(count, near) + max(4, count // 2)
        y = np.random.default_rng(seed).normal(size=(width, min(width, block)))
        for _ in range(rounds):
            q = np.zeros((width, y.shape[1]))
            for w, t in zip(weight, turn):
                z = centre + radius * t
                q += (w / 2 * radius * t * np.linalg.solve(z * np.eye(width) - a, y.astype(complex))).real
            u, s, _ = np.linalg.svd(q, full_matrices=False)
            u = u[:, s > s[0] * 1e-13]
            if u.shape[1] < count:  # too much of the block lay outside
                more = np.random.default_rng(seed + 1).normal(size=(width, count - u.shape[1] + 4))
                u = np.linalg.qr(np.column_stack([u, more]))[0]
            value, vector = np.linalg.eigh(u.T @ a @ u)
            y = u @ vector
            # the count of the interval, nearest to its centre; what the block
            # holds of both sides of the circle may mix to a value inside that
            # belongs to no eigenvector and never settles: the wide block
            # takes those that settled
            residual = np.abs(a @ y - y * value).max(axis=0)
            settled = residual <= 1e-13 * size * width ** 0.5
            of = np.flatnonzero(settled) if wide else np.arange(len(value))
            mine = np.sort(of[np.argsort(np.abs(value[of] - centre), kind="stable")[:count]])
            slack = 1e-10 * size
            if len(mine) == count and settled[mine].all() and low - slack <= value[mine].min() and value[mine].max() <= high + slack:
                return value[mine], y[:, mine]
    raise RuntimeError(f"contour integration between {low} and {high} did not settle")


def components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues (falling) of symmetric ``a`` and unit
    eigenvectors, as columns; their number is checked by inertia counts."""
    parts, wanted = [], 0
    for low, high, n in intervals(a, k):
        parts.append(feast(a, low, high, n)[1])
        wanted += n
    basis = np.linalg.qr(np.column_stack(parts))[0]
    # one more Rayleigh-Ritz step over all intervals
    value, vector = np.linalg.eigh(basis.T @ a @ basis)
    size = float(np.abs(a).sum(axis=1).max())
    gap = 1e-9 * size
    if len(value) != wanted or len(a) - inertia(a, value[0] - gap) < wanted or len(a) - inertia(a, value[0] + gap) > wanted:
        raise RuntimeError("components are missing")
    return value[::-1][:k], (basis @ vector)[:, ::-1][:, :k]


# -- whitening -----------------------------------------------------------------------

def whitened(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
             most: int = COMPONENTS) -> DataFrame:
    """For every row and component: vec_id, component, n, deviation,
    whitened, explained, identity_error.

    Null and empty vectors and those with a null or non-finite entry are left
    out; so are vectors of another length than most rows have (of equally
    frequent lengths the greater one counts).  Entries whose scaled value is
    beyond a long are refused with an error.  A null id is kept, repeated
    rows count and appear each time.  Components without variance (of
    constant or dependent columns) are not returned, so equal vectors only
    and empty tables give no rows.  A deviation beyond a long is null.
    Columns of other names are not read.
    """
    spark = rows.sparkSession
    entry = F.col(vector).cast("array<double>")
    # (non-finite entries are null here: the optimizer may compute this before the filter)
    whole = F.transform(entry, lambda c: F.when(F.abs(c) < F.lit(2.0 ** 56), F.floor(c * SCALE) + SHIFT)
                        .when(F.abs(c) < F.lit(float("inf")), F.raise_error(F.lit("an entry is beyond a long")).cast("long")))
    base = rows.filter(finite(vector)).select(F.col(id_col).alias("id"), whole.alias("x"))
    lengths = base.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if usual is None:
        return spark.createDataFrame([], schema)
    width, n = int(usual["d"]), int(usual["n"])
    base = base.filter(F.size("x") == width)
    # a common integer offset near the mean: centred before multiplying
    some = base.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("a")).collect()
    offset = np.zeros(width, np.int64)
    for r in some:
        offset[r["pos"]] = int(round(r["a"]))
    n, sums, gram = moments(base, width, offset)
    v = covariance(n, sums, gram)
    trace = float(np.trace(v))
    if trace <= 0:
        return spark.createDataFrame([], schema)
    value, vectors = components(v, min(most, width))
    real = value > LEAST_SHARE * value[0]
    value, vectors = value[real], vectors[:, real]
    mean = np.array([s / n for s in sums])  # of x - offset
    turn = vectors / np.sqrt(value)

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _integers(batch.column(1))
            far = max(abs(int(x.min())), abs(int(x.max()))) >= 1 << 61
            y = x.astype(object) - offset if far else x - offset
            w = (y.astype(np.float64) - mean) @ turn
            top = max(abs(int(y.min())), abs(int(y.max()))) + 1
            if width * (2 * n * top) ** 2 < 1 << 62:
                dev = ((n * y - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                dev = [d if d < 1 << 63 else None for d in
                       ((n * y.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dev, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))],
                names=["id", "deviation", "w"])

    white = stage(base.mapInArrow(project, f"id {dict(base.dtypes)['id']}, deviation long, w array<double>"))
    error = identity_error(white, len(value))
    share = F.array(*[F.lit(float(e / trace)) for e in value])
    return (white.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("w"))
            .select("vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                    F.col("col").alias("whitened"), share[F.col("pos")].alias("explained"),
                    F.lit(error).alias("identity_error")))


def identity_error(white: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``w`` minus the identity;
    tasks send counts, sums and second moments."""
    def part(batches):
        n, s, g = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            n, s, g = n + len(w), s + w.sum(axis=0), g + w.T @ w
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k), pa.int32()), pa.array([float(n)] * k), pa.array(s),
             pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * k, pa.int32()), pa.array(g.ravel()))],
            names=["i", "n", "s", "g"])

    parts = white.select("w").mapInArrow(part, "i int, n double, s double, g array<double>")
    entry = [F.sum(F.col("g")[j]).alias(f"g{j}") for j in range(k)]
    found = sorted(parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), *entry).collect())
    n = found[0]["n"]
    mean = np.array([r["s"] for r in found]) / n
    second = np.array([list(r)[3:] for r in found]) / n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the 32 leading components, whitened."""
    return whitened(table(spark, sf_dir, "embeddings"))
