"""Embedding whitening by incremental eigendecomposition.

Fit list.  Entries c become whole numbers x = floor(scale * c); each distinct x vector counts once, merged where it is read, so a vector that a
third of all rows share is one row of the shuffle.

Spectra.  Each partition of the fit list keeps (n, mean, directions Q, values d) of its scatter matrix and takes one vector at a time: the
scatter grows by n / (n + 1) times the outer product of the vector's offset from the mean, a rank-one update diag(d) + rho z z' in the
directions' own coordinates.  Coordinates of z that vanish, or whose values coincide (rotated into one), are deflated; the others' new values
are the roots of the secular equation 1 + rho sum z_i^2 / (d_i - v) = 0, found between neighbouring values by rational interpolation inside a
bracket, each as an offset from its nearer pole; vectors follow from z recomputed for these roots, so they are orthogonal even for close ones.
Two spectra are combined by as many rank-one updates as the second has directions, and one more for the distance of the means; FAN at a time,
over a logarithmic number of rounds.  A spectrum has dimension^2 numbers, whatever the rows.

Refinement.  A last pass over the fit list projects centred vectors on the directions, sums the products (Rayleigh quotients) in the tasks,
and a small symmetric eigenproblem turns the directions into eigenvectors of the exact covariance; only dimension^2 numbers a task leave it.

Rows are dropped where the vector is null, empty, holds null or non-finite entries or entries too large for a long, or has another length
than most (ties: the longer).  Rows that repeat an id or a vector are each returned; null ids are rows like others.  Directions without
variance are no components, so one distinct vector, or an empty table, gives no rows.  deviation is null beyond the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, staged, table

SCALE = 256.0
COMPONENTS = 4
#: Spectra that one task combines.
FAN = 16
#: Rows of the fit list for each partition that keeps a spectrum, about.
ROWS = 2048
EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho sum z2 / (d - v) for rising distinct d, positive z2 and rho: nearest pole of each root, and its offset from there."""
    k = len(d)
    i = np.arange(k)
    top = np.r_[d[1:], d[-1] + rho * z2.sum()]
    gap = top - d
    # the sign half-way tells which pole is nearer; the last root belongs to its own pole
    middle = 1 + rho * (z2 / (d[None, :] - (d + gap / 2)[:, None])).sum(1)
    pole = np.where((middle < 0) & (i < k - 1), i + 1, i)
    delta = d[None, :] - d[pole][:, None]
    left, right = d - d[pole], top - d[pole]
    half = left + gap / 2
    lo, hi = np.where(middle < 0, half, left), np.where(middle < 0, right, half)
    hi = np.where((middle < 0) & (i == k - 1), right, hi)
    v = (lo + hi) / 2
    below = (i[None, :] <= i[:, None]).astype(float)
    live = i
    for _ in range(80):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            apart = (delta if len(live) == k else delta[live]) - v[live, None]
            w = z2 / apart
            slope = w / apart
            mine = below if len(live) == k else below[live]
            # poles below a root count negative, those above positive
            under, total = np.einsum("ij,ij->i", w, mine), w.sum(1)
            f, size = 1 + rho * total, 1 + rho * (total - 2 * under)
            psi = rho * np.einsum("ij,ij->i", slope, mine)
            phi = rho * slope.sum(1) - psi
            lo[live] = np.where(f <= 0, v[live], lo[live])
            hi[live] = np.where(f >= 0, v[live], hi[live])
            a1, a2 = left[live] - v[live], right[live] - v[live]
            a = (a1 + a2) * f - a1 * a2 * (psi + phi)
            b = a1 * a2 * f
            c = f - a1 * psi - a2 * phi
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = v[live] + step
            new = np.where((new > lo[live]) & (new < hi[live]), new, (lo[live] + hi[live]) / 2)
        done = (np.abs(f) <= 4 * EPS * k * size) | (hi[live] - lo[live] <= 2 * EPS * np.maximum(np.abs(lo[live]), np.abs(hi[live])))
        v[live] = np.where(done, v[live], new)
        live = live[~done]
        if not len(live):
            break
    return pole, v


class Spectrum:
    """Eigenvalues (rising) and eigenvectors (columns) of the scatter matrix of n vectors around their mean."""

    def __init__(self, n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray):
        self.n, self.mean, self.values, self.vectors = n, mean, values, vectors

    @staticmethod
    def empty(size: int) -> Spectrum:
        return Spectrum(0, np.zeros(size), np.zeros(size), np.eye(size))

    def grow(self, u: np.ndarray, rho: float) -> None:
        """Add rho u u' to the matrix."""
        q, d = self.vectors, self.values
        z = q.T @ u
        norm = np.sqrt((z * z).sum())
        if rho <= 0 or norm == 0:
            return
        rho, z = rho * norm * norm, z / norm
        tiny = 8 * EPS * max(abs(d[-1]), rho)
        q, d = q.copy(), d.copy()
        # coinciding values: rotate their directions until one alone meets u
        close = np.flatnonzero(np.diff(d) <= 64 * EPS * max(d[-1], rho))
        for j in close:
            r = np.hypot(z[j], z[j + 1])
            if r == 0:
                continue
            c, s = z[j + 1] / r, z[j] / r
            if abs((d[j + 1] - d[j]) * c * s) > tiny:
                continue
            q[:, [j, j + 1]] = q[:, [j, j + 1]] @ np.array([[c, s], [-s, c]])
            z[j], z[j + 1] = 0.0, r
            d[j], d[j + 1] = d[j] * c * c + d[j + 1] * s * s, d[j] * s * s + d[j + 1] * c * c
        use = np.flatnonzero(rho * np.abs(z) > tiny)
        # what is still closer than the roots can be told apart waits for the refinement
        use = use[np.r_[True, np.diff(d[use]) > 0]] if len(use) else use
        if len(use):
            di, zi = d[use], z[use]
            pole, offset = secular_roots(di, zi * zi, rho)
            # root minus value, exact near its pole
            far = (di[pole][:, None] - di[None, :]) + offset[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                between = di[:, None] - di[None, :]
                ratio = far / np.where(np.eye(len(use), dtype=bool), 1, between)
                again = np.sqrt(np.abs(ratio.prod(0) / rho)) * np.where(zi < 0, -1, 1)
                w = again[:, None] / -far.T
            w = np.where(np.isfinite(w), w, 0)
            w /= np.sqrt((w * w).sum(0))
            q[:, use] = q[:, use] @ w
            d[use] = di[pole] + offset
        o = np.argsort(d, kind="stable")
        self.values, self.vectors = np.maximum(d[o], 0), q[:, o]

    def add(self, x: np.ndarray) -> None:
        """One more vector."""
        off = x - self.mean
        self.grow(off, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + off / self.n

    def merge(self, other: Spectrum) -> None:
        """All vectors of another spectrum, by rank-one updates along its directions and the distance of the means."""
        if not other.n:
            return
        off, both = other.mean - self.mean, self.n + other.n
        for value, u in zip(other.values, other.vectors.T):
            self.grow(u, value)
        self.grow(off, self.n * other.n / both)
        self.mean = self.mean + off * (other.n / both)
        self.n = both

    def row(self) -> dict:
        return {"n": self.n, "mean": self.mean.tobytes(), "vals": self.values.tobytes(), "vecs": np.ascontiguousarray(self.vectors).tobytes()}

    @staticmethod
    def of(r) -> Spectrum:
        mean = np.frombuffer(r["mean"])
        return Spectrum(int(r["n"]), mean, np.frombuffer(r["vals"]), np.frombuffer(r["vecs"]).reshape(len(mean), len(mean)))


def rows_of(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """A column of number lists of one length as a matrix."""
    a = batch.column(name)
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1) if len(a) else np.zeros((0, 0), np.int64)


def whole(docs: DataFrame, vector: str, scale: float = SCALE) -> DataFrame:
    """docs of usable vectors with x, their whole numbers."""
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall(c, lambda v: F.coalesce(F.abs(v * scale) < F.lit(2.0**63), F.lit(False)))
    return docs.where(fine & (F.size(vector) > 0)).withColumn("x", F.transform(c, lambda v: F.floor(v * scale)))


class Whitening:
    """What the rows need: exact count and sums, eigenvectors (columns) by falling value, shares of the trace, and the identity error."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors
        self.explained = values / trace
        self.identity_error = float("nan")

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, from the exact n x - S where it fits a long."""
        top = max([abs(s) for s in self.sums], default=0) + self.n * int(np.abs(x).max(initial=0))
        if top < 2**62:
            return (self.n * x - np.array(self.sums, np.int64)) / self.n
        return ((self.n * x.astype(object) - np.array(self.sums, object)) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact."""
        top = max([abs(s) for s in self.sums], default=0) + self.n * int(np.abs(x).max(initial=0))
        if top * top * x.shape[1] < 2**63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        out = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in out]

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x) @ self.vectors / np.sqrt(self.values)


def spectra(fit: DataFrame, size: int) -> DataFrame:
    """One spectrum for each partition of fit, with the exact sums of its vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = Spectrum.empty(size), [0] * size
        for batch in batches:
            x = rows_of(batch)
            if len(x):
                exact = x.sum(0) if int(np.abs(x).max()) * len(x) < 2**62 else x.astype(object).sum(0)
                sums = [a + int(b) for a, b in zip(sums, exact)]
            for v in x.astype(float):
                own.add(v)
        if own.n:
            yield pa.RecordBatch.from_pylist([own.row() | {"part": TaskContext.get().partitionId(), "sums": [str(s) for s in sums]}], schema=pa.schema([("n", pa.int64()), ("mean", pa.binary()), ("vals", pa.binary()), ("vecs", pa.binary()), ("part", pa.int32()), ("sums", pa.list_(pa.string()))]))
    return fit.select("x").mapInArrow(run, "n long, mean binary, vals binary, vecs binary, part int, sums array<string>")


def combined(parts: DataFrame, n_parts: int) -> Spectrum:
    """All spectra in one: FAN a task, until one is left."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [Spectrum.of(r) for r in pdf.sort_values("part").to_dict("records")]
        own = Spectrum(got[0].n, got[0].mean, got[0].values, got[0].vectors)
        for other in got[1:]:
            own.merge(other)
        return pd.DataFrame([own.row() | {"part": int(pdf["part"].min()) // FAN}])
    parts = parts.drop("sums")
    while n_parts > 1:
        n_parts = -(-n_parts // FAN)
        parts = staged(parts.groupBy(F.floor(F.col("part") / FAN).alias("at")).applyInPandas(run, "n long, mean binary, vals binary, vecs binary, part int"), "spectra")
    return Spectrum.of(parts.first())


def moments(fit: DataFrame, centre: Whitening, width: int, project) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums, sums of products and count of project(x) over fit; width numbers a row."""
    held = fit.sparkSession.sparkContext.broadcast((centre, project))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, f = held.value
        s, p, n = np.zeros(width), np.zeros((width, width)), 0
        for batch in batches:
            x = rows_of(batch)
            if len(x):
                y = f(model, x)
                s, p, n = s + y.sum(0), p + y.T @ y, n + len(y)
        if n:
            yield pa.RecordBatch.from_pylist([{"s": s.tolist(), "p": p.ravel().tolist(), "n": n}], schema=pa.schema([("s", pa.list_(pa.float64())), ("p", pa.list_(pa.float64())), ("n", pa.int64())]))

    rows = fit.select("x").mapInArrow(run, "s array<double>, p array<double>, n long")
    # summed place by place in Spark: width^2 numbers reach the driver
    places = rows.select("n", F.posexplode(F.concat("s", "p")).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("at").collect()
    held.destroy()
    flat = np.array([r["v"] for r in places])
    return flat[:width], flat[width:].reshape(width, width), places[0]["n"] if places else 0


def offsets_in(model: Whitening, x: np.ndarray) -> np.ndarray:
    return model.offsets(x) @ model.vectors


def whitened_by(model: Whitening, x: np.ndarray) -> np.ndarray:
    return model.project(x)


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows (x, all of one length); None without variance."""
    fit = staged(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    n = fit.count()
    if n < 2:
        return None
    size = len(fit.first()["x"])
    fit = fit.coalesce(max(1, -(-n // ROWS)))
    parts = staged(spectra(fit, size), "spectra")
    sums = parts.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    n_parts = parts.agg(F.max("part")).first()[0] + 1
    spectrum = combined(parts, n_parts)
    model = Whitening(n, [int(r["s"]) for r in sums], spectrum.values, spectrum.vectors, 1.0)
    _, products, _ = moments(fit, model, size, offsets_in)
    values, turn = np.linalg.eigh(products / n)
    trace = float(np.trace(products) / n)
    if trace <= 0:
        return None
    vectors = np.linalg.qr(spectrum.vectors @ turn[:, ::-1])[0]
    values = values[::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(size)] < 0, -1, 1)
    use = (np.arange(size) < components) & (values > size * EPS * trace)
    model = Whitening(n, model.sums, values[use], vectors[:, use], trace)
    s, p, _ = moments(fit, model, int(use.sum()), whitened_by)
    model.identity_error = float(np.abs(p / n - np.outer(s / n, s / n) - np.eye(len(s))).max())
    return model


def whitened(docs: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, out: str = "whitening") -> DataFrame:
    """The usable rows of docs with `out`: a struct of n, deviation, whitened, explained (arrays by component) and identity_error."""
    kind = "struct<n: bigint, deviation: bigint, whitened: array<double>, explained: array<double>, identity_error: double>"
    mine = [c for c in docs.columns if c != out]
    rows = whole(docs.select(F.struct(*mine).alias("row"), F.col(vector).alias("v")), "v", scale).select("row", "x")
    lengths = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    model = fitted(rows.where(F.size("x") == lengths["size"]).select("x"), components) if lengths else None
    if model is None:
        return docs.select(*mine).withColumn(out, F.lit(None).cast(kind)).where(F.lit(False))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        shape = pa.struct([("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64())), ("explained", pa.list_(pa.float64())), ("identity_error", pa.float64())])
        for batch in batches:
            x = rows_of(batch)
            if not len(x):
                continue
            got = [{"n": m.n, "deviation": dev, "whitened": w, "explained": m.explained.tolist(), "identity_error": m.identity_error} for dev, w in zip(m.deviations(x), m.project(x).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(got, shape)], names=["row", "w"])

    done = rows.where(F.size("x") == lengths["size"]).mapInArrow(run, f"row {dict(rows.dtypes)['row']}, w {kind}")
    return done.select("row.*", F.col("w").alias(out))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = out.select("vec_id", "whitening.*").select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
