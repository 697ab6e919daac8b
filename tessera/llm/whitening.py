"""Whitening by shifted CholeskyQR of the centred rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .negatives import integer_vector

#: Rows of a task's block; passes after which orthogonality is taken as it is (three are usual, more only for dependent dimensions).
BLOCK, MOST_PASSES = 8192, 12
UNIT = 2.0**-53


def blocks(batches, dims: int):
    """(batch, int64 rows) of Arrow batches with a column x."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            one = batch.slice(a, BLOCK)
            yield one, one.column("x").flatten().to_numpy(zero_copy_only=False).reshape(one.num_rows, dims)


def deviations(x, n: int, sums: list[int], largest: int):
    """n*x - sums, exact: int64 where it fits, Python integers otherwise."""
    import numpy as np

    if n * largest + max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def solve(a, r):
    """a times the inverse of the upper triangular r, column by column."""
    import numpy as np

    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def added(df: DataFrame, partial, dims: int, width: int):
    """The sum of an array of `width` doubles over df's blocks: one partial a task, then fewer, larger ones; only those reach the driver."""
    import numpy as np

    def each(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(width)
        for _, x in blocks(batches, dims):
            total += partial(x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["part"])

    def merge(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(width)
        for batch in batches:
            for part in batch.column("part"):
                total += np.frombuffer(part.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["part"])

    parts = df.select("x").mapInArrow(each, "part binary").repartition(16).mapInArrow(merge, "part binary")
    return sum((np.frombuffer(r[0]) for r in parts.collect()), np.zeros(width))


def integer_sums(fit: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """Rows, exact sums a dimension, and the largest absolute entry."""
    def each(batches):
        import numpy as np
        import pyarrow as pa

        n, high, low, most = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64), 0
        for _, x in blocks(batches, dims):
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
            most = max(most, abs(int(x.max())), abs(int(x.min())))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([min(most, 2**63 - 1)]), pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64()))], names=["n", "most", "high", "low"])

    parts = fit.select("x").mapInArrow(each, "n long, most long, high array<long>, low array<long>")
    each_dim = parts.select("n", "most", F.posexplode(F.arrays_zip("high", "low")).alias("i", "s"))
    got = each_dim.groupBy("i").agg(F.sum("n"), F.max("most"), F.sum("s.high"), F.sum(F.col("s.low").cast("decimal(38,0)"))).orderBy("i").collect()  # one row a dimension
    return got[0][1], [(h << 32) + int(lo) for *_, h, lo in got], got[0][2]


class Whitening:
    """What whiten() learned: n, sums, components (a column each), eigenvalues, trace, identity_error."""

    def __init__(self, dims, n, sums, largest, components, eigenvalues, trace):
        self.dims, self.n, self.sums, self.largest = dims, n, sums, largest
        self.components, self.eigenvalues, self.trace, self.identity_error = components, eigenvalues, trace, 0.0

    def apply(self, x):
        """Whitened coordinates of int64 rows."""
        return deviations(x, self.n, self.sums, self.largest).astype(float) / self.n @ self.components / self.eigenvalues**0.5


def fit_whitening(fit: DataFrame, dims: int, components: int) -> Whitening | None:
    """Learns from fit(x), whose rows are distinct int64 vectors of `dims` entries; None where nothing varies.

    Each pass adds up the Gram matrix of the rows as orthogonalised so far - the exact centred
    rows, solved against every factor found - and its Cholesky factor becomes the next factor.
    The first is shifted, as is any that fails, so dependent dimensions are no obstacle. The
    product of the factors is R of the centred rows; its singular values and right vectors give
    the eigenvalues and components. Only dims x dims matrices reach the driver.
    """
    import numpy as np

    n, sums, largest = integer_sums(fit, dims)
    factors: list = []

    def gram(x):
        q = deviations(x, n, sums, largest).astype(float) / n
        for r in factors:
            q = solve(q, r)
        return q.T @ q

    whole = np.eye(dims)
    for _ in range(MOST_PASSES):
        g = added(fit, gram, dims, dims * dims).reshape(dims, dims)
        g = (g + g.T) / 2
        top = float(np.linalg.norm(g, 2))
        if not top:
            return None
        if factors and np.abs(g - np.eye(dims)).max() < 1e-12 * dims:
            break
        shift = 0.0 if factors else 11 * (n * dims + dims * (dims + 1)) * UNIT * top
        while True:
            try:
                r = np.linalg.cholesky(g + shift * np.eye(dims)).T
                if r.diagonal().min() > 0:
                    break
            except np.linalg.LinAlgError:
                pass
            shift = max(10 * shift, 11 * (n * dims + dims * (dims + 1)) * UNIT * top)
        factors.append(r)
        whole = r @ whole
    _, sigma, right = np.linalg.svd(whole)
    kept = int((sigma > sigma[0] * 8 * dims * n**0.5 * UNIT).sum())
    e, v = sigma**2 / n, right.T
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(dims)] < 0, -1.0, 1.0)
    k = min(components, kept)
    found = Whitening(dims, n, sums, largest, v[:, :k], e[:k], float(e.sum()))

    def second(x):
        w = found.apply(x)
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    total = added(fit, second, dims, k * k + k)
    mean = total[k * k :] / n
    found.identity_error = float(np.abs(total[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return found


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Entries become x = floor(256*c). The fit list is each distinct x once, so copies weigh
    nothing: n vectors with sums S. whitened is x - S/n on the component over the root of its
    eigenvalue, explained the eigenvalue's share of the trace, deviation the exact sum of
    (n*x-S)^2 over the dimensions (null beyond a long), identity_error the largest absolute entry
    of the whitened fit list's covariance minus the identity.

    Null vectors and those with null or non-finite entries are dropped, repeated rows each keep
    theirs, a null vec_id stays null. Only vectors of the commonest dimension take part (the larger of
    equals); an entry too large for a long becomes the nearest one. Components number at most as
    many as vary: with one distinct vector or none, or an empty table, there are no rows. Other
    columns are ignored.
    """
    ready = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integer_vector(F.col("embedding")).alias("x")).where("x is not null and size(x) > 0")
    fit = cut(ready.select("x").distinct())
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usual = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    found = fit_whitening(fit.where(F.size("x") == usual["d"]), usual["d"], components) if usual else None
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, k = found.dims, len(found.eigenvalues)
    explained = found.eigenvalues / found.trace

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for one, x in blocks(batches, dims):
            d = deviations(x, found.n, found.sums, found.largest)
            most = max(abs(int(d.max())), abs(int(d.min())))
            if d.dtype != object and dims * most * most < 2**63:
                exact = pa.array((d * d).sum(1).repeat(k))
            else:
                exact = pa.array([v if v < 2**63 else None for v in (d.astype(object) ** 2).sum(1) for _ in range(k)], pa.int64())
            m = one.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    one.column("vec_id").take(pa.array(np.arange(m).repeat(k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.n)),
                    exact, pa.array(found.apply(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, found.identity_error)),
                ],
                names=[f.split()[0] for f in schema.split(", ")],
            )

    return ready.where(F.size("x") == dims).mapInArrow(run, schema)
