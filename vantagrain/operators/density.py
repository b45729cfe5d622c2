"""Kernel densities, principal components and small-sample geometry."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.special import chi2_ppf
from .blocks import kernel_sum
from .common import MeasureResult, complete, quantiles, scalar_row
from .distributions import covariance


def bandwidth(df: DataFrame, col: str) -> float:
    """The rule-of-thumb bandwidth: 0.9 min(sd, IQR / 1.34) n ** -0.2."""
    row = df.agg(F.stddev_samp(col).alias("s"), F.count(col).alias("n"), F.max(F.abs(col)).alias("m")).first()
    q1, q3 = quantiles(df, col, [0.25, 0.75])
    spread = min(row.s or 0.0, (q3 - q1) / 1.34) or row.s or row.m or 1.0
    return 0.9 * spread * row.n**-0.2


def density(df: DataFrame, col: str, grid: np.ndarray, *, bw: float | None = None, bins: int = 4096, weight: str | None = None) -> np.ndarray:
    """Gaussian kernel density on a grid.

    Values are binned linearly into ``bins`` cells in one pass over the rows (two
    numbers a cell reach the driver), and the kernel is applied to cells, so the
    cost beyond the pass does not depend on the rows.
    """
    rows = df.filter(F.col(col).isNotNull())
    bw = bw or bandwidth(rows, col)
    low, high = float(grid[0]) - 4 * bw, float(grid[-1]) + 4 * bw
    width = (high - low) / bins
    at = (F.col(col) - low) / width
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    inside = rows.filter((at >= 0) & (at < bins)).select(F.floor(at).alias("b"), (at - F.floor(at)).alias("f"), w.alias("w"))
    cells = inside.groupBy("b").agg(F.sum(F.col("w") * (1 - F.col("f"))).alias("l"), F.sum(F.col("w") * F.col("f")).alias("r")).collect()
    total = rows.agg(F.sum(w)).first()[0] or 1.0
    mass = np.zeros(bins + 1)
    for c in cells:
        mass[c.b] += c.l
        mass[c.b + 1] += c.r
    centres = low + np.arange(bins + 1) * width
    some = mass > 0
    z = (grid[:, None] - centres[None, some]) / bw
    return (np.exp(-0.5 * z * z) @ mass[some]) / (total * bw * math.sqrt(2 * math.pi))


def density_difference(x: DataFrame, y: DataFrame, col: str, *, steps: int = 1000) -> MeasureResult:
    """Distances between the densities of a column on both sides, plain and as
    centred log ratios."""
    low, high = x.select(col).unionByName(y.select(col)).agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    grid = np.linspace(low, high, steps)
    a, b = (np.maximum(density(d, col, grid), 1e-300) for d in (x, y))
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2
    clr = lambda v: np.log(v) - np.log(v).mean()
    kl = float((p * np.log(p / q)).sum())
    js = float(0.5 * (p * np.log(p / m)).sum() + 0.5 * (q * np.log(q / m)).sum())
    ratio = a / b
    spark = x.sparkSession
    summary = scalar_row(
        spark, distance=float(np.sqrt(((a - b) ** 2).sum() * (grid[1] - grid[0]))), distance_bayes=float(np.sqrt(((clr(a) - clr(b)) ** 2).mean())),
        kl=kl, jsd=js, mean_ratio=float(ratio.mean()), sd_ratio=float(ratio.std(ddof=1)),
    )
    curve = spark.createDataFrame(list(zip(map(float, grid), map(float, a), map(float, b), strict=True)), "point double, density_x double, density_y double")
    return MeasureResult(summary, groups=curve)


def density_kl(x: DataFrame, y: DataFrame, cols: Sequence[str], *, n_grid: int = 50) -> DataFrame:
    """KL divergence of product-kernel densities on a grid in one, two or three
    dimensions; rows are counted at their nearest grid points (n_grid to the
    power of the dimension at most), then smoothed along each axis."""
    p = len(cols)
    if not 1 <= p <= 3:
        raise ValueError("one to three columns")
    axes, binned = [], []
    for c in cols:
        low, high = x.select(c).unionByName(y.select(c)).agg(F.min(c).cast("double"), F.max(c).cast("double")).first()
        axes.append(np.linspace(low, high, n_grid))
    for d in (x, y):
        rows = complete(d, cols)
        at = [F.least(F.lit(n_grid - 1), F.greatest(F.lit(0), F.round((F.col(c) - float(a[0])) / ((a[1] - a[0]) or 1.0)))).cast("int").alias(f"i{k}") for k, (c, a) in enumerate(zip(cols, axes, strict=True))]
        mass = np.zeros((n_grid,) * p)
        for r in rows.select(*at).groupBy(*[f"i{k}" for k in range(p)]).agg(F.count(F.lit(1)).alias("n")).collect():
            mass[tuple(r[f"i{k}"] for k in range(p))] = r.n
        for k, c in enumerate(cols):
            z = (axes[k][:, None] - axes[k][None, :]) / bandwidth(rows, c)
            mass = np.moveaxis(np.tensordot(np.exp(-0.5 * z * z), mass, axes=(1, k)), 0, k)
        mass = np.maximum(mass, 1e-300)
        binned.append(mass / mass.sum())
    p, q = binned
    return scalar_row(x.sparkSession, kl=float((p * np.log(p / q)).sum()))


def density_kl_2d(x: DataFrame, y: DataFrame, cols: Sequence[str], *, n_grid: int = 50) -> DataFrame:
    return density_kl(x, y, cols, n_grid=n_grid)


def principal_components(df: DataFrame, cols: Sequence[str], k: int = 2, *, centre: bool = True, scale: bool = True) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(table with array ``scores``, loadings, explained shares); the largest
    loading of each component is positive."""
    rows = VectorAssembler(inputCols=list(cols), outputCol="__v").transform(complete(df, cols))
    scaler = StandardScaler(inputCol="__v", outputCol="__s", withMean=centre, withStd=scale).fit(rows)
    rows = scaler.transform(rows)
    model = PCA(k=k, inputCol="__s", outputCol="__p").fit(rows)
    loadings = model.pc.toArray()
    sign = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    scores = F.zip_with(vector_to_array("__p"), F.array(*[F.lit(float(s)) for s in sign]), lambda a, b: a * b)
    out = model.transform(rows).withColumn("scores", scores).drop("__v", "__s", "__p")
    return out, loadings * sign, model.explainedVariance.toArray()


def compare_pca(x: DataFrame, y: DataFrame, cols: Sequence[str], k: int = 2) -> DataFrame:
    """(component, variable, loading_x, loading_y, explained_x, explained_y)."""
    (_, a, ea), (_, b, eb) = principal_components(x, cols, k), principal_components(y, cols, k)
    rows = [(j + 1, c, float(a[i, j]), float(b[i, j]), float(ea[j]), float(eb[j])) for j in range(k) for i, c in enumerate(cols)]
    return x.sparkSession.createDataFrame(rows, "component int, variable string, loading_x double, loading_y double, explained_x double, explained_y double")


def density_difference_pca(x: DataFrame, y: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Density differences of the first two component scores of each side."""
    sides = [principal_components(d, cols)[0].select(F.col("scores")[0].alias("pc1"), F.col("scores")[1].alias("pc2")) for d in (x, y)]
    out = None
    for pc in ("pc1", "pc2"):
        one = density_difference(*sides, pc, steps=200).summary.withColumn("component", F.lit(pc))
        out = one if out is None else out.unionByName(one)
    return out


def bounded_sample(df: DataFrame, id_col: str, cols: Sequence[str], n: int, seed: int = 1) -> np.ndarray:
    """At most n rows in the order of a hash of the id, as a matrix."""
    rows = complete(df, cols).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(n)
    return np.array([[float(v) for v in r] for r in rows.select(*cols).collect()]).reshape(-1, len(cols))


def robust_covariance(points: np.ndarray, *, starts: int = 20, steps: int = 20, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Minimum covariance determinant of a small sample, by concentration steps."""
    n, p = points.shape
    if n <= 2 * p:
        return points.mean(axis=0), np.cov(points.T).reshape(p, p) if n > 1 else np.eye(p)
    rng, h = np.random.default_rng(seed), (n + p + 1) // 2
    best = None
    for _ in range(starts):
        pick = points[rng.choice(n, p + 1, replace=False)]
        for _ in range(steps):
            mean, cov = pick.mean(axis=0), np.cov(pick.T).reshape(p, p)
            d = np.einsum("ij,jk,ik->i", points - mean, np.linalg.pinv(cov), points - mean)
            new = points[np.argsort(d, kind="stable")[:h]]
            if np.array_equal(new, pick):
                break
            pick = new
        det = np.linalg.det(np.cov(pick.T).reshape(p, p))
        if best is None or det < best[0]:
            best = (det, pick)
    pick = best[1]
    mean, cov = pick.mean(axis=0), np.cov(pick.T).reshape(p, p)
    d = np.einsum("ij,jk,ik->i", points - mean, np.linalg.pinv(cov), points - mean)
    return mean, cov * float(np.median(d)) / chi2_ppf(0.5, p)


def concentrated_covariance(df: DataFrame, cols: Sequence[str], *, sample: int = 2000, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Minimum covariance determinant over all rows.

    The search starts from the estimate on at most ``sample`` rows; each
    concentration step takes the half of all rows that is nearest, by an exact
    quantile of the squared distance, and its mean and covariance, until these
    no longer change.
    """
    rows, p = complete(df, cols).select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(cols)]), len(cols)
    names = rows.columns
    start = rows.orderBy(F.xxhash64(*names), *names).limit(sample)
    points = np.array([list(r) for r in start.collect()]).reshape(-1, p)
    mean, cov = robust_covariance(points)
    n = rows.count()
    if n <= 2 * p:
        return mean, cov
    share = ((n + p + 1) // 2 - 1) / (n - 1)
    # the distance is scaled so that the steps compare like with like
    for _ in range(steps):
        near = rows.withColumn("d2", squared_distance(names, mean, cov))
        cut = quantiles(near, "d2", [share])[0]
        new_mean, new_cov, _ = covariance(near.filter(F.col("d2") <= cut + 1e-12 * abs(cut)), names)
        still = np.allclose(new_mean, mean, rtol=1e-9, atol=1e-12) and np.allclose(new_cov, cov, rtol=1e-9, atol=1e-12)
        mean, cov = new_mean, new_cov
        if still:
            break
    middle = quantiles(rows.withColumn("d2", squared_distance(names, mean, cov)), "d2", [0.5])[0]
    return mean, cov * middle / chi2_ppf(0.5, p)


def squared_distance(cols: Sequence[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Squared Mahalanobis distance of a row as an expression."""
    inv = np.linalg.pinv(cov)
    parts = [F.col(c).cast("double") - float(mean[k]) for k, c in enumerate(cols)]
    return sum((parts[i] * parts[j] * float(inv[i, j]) for i in range(len(cols)) for j in range(len(cols))), F.lit(0.0))


def robust_outliers(df: DataFrame, id_col: str, cols: Sequence[str], *, level: float = 0.975) -> DataFrame:
    """(id, d2, outlier): squared robust distance of every row, from the minimum
    covariance determinant of all rows."""
    mean, cov = concentrated_covariance(df, cols)
    d2 = squared_distance(cols, mean, cov)
    return complete(df, cols).select(F.col(id_col).alias("id"), d2.alias("d2")).withColumn("outlier", F.col("d2") > chi2_ppf(level, len(cols)))


def robust_correlation(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    _, cov = concentrated_covariance(df, cols)
    sd = np.sqrt(np.diag(cov))
    return cov / np.outer(sd, sd)


def dbscan_noise(df: DataFrame, id_col: str, cols: Sequence[str], *, eps: float, min_points: int = 5) -> DataFrame:
    """(id, n_near, core, noise): rows near no core row.

    Points fall into cells of side eps; a point meets the cells around its own
    in an equi-join, so far points never meet.
    """
    cell = [F.floor(F.col(c) / eps) for c in cols]
    rows = complete(df, cols).select(F.col(id_col).alias("id"), *cols, *[e.alias(f"c{k}") for k, e in enumerate(cell)])
    near = rows.select(F.col("id").alias("o_id"), *[F.col(c).alias(f"o_{c}") for c in cols], *[F.col(f"c{k}").alias(f"o{k}") for k in range(len(cols))])
    for k in range(len(cols)):
        near = near.withColumn(f"o{k}", F.explode(F.array(*[F.col(f"o{k}") + d for d in (-1, 0, 1)])))
    on = [F.col(f"c{k}") == F.col(f"o{k}") for k in range(len(cols))]
    d2 = sum((F.pow(F.col(c) - F.col(f"o_{c}"), 2) for c in cols), F.lit(0.0))
    pairs = rows.join(near, on).filter(d2 <= eps * eps).select("id", "o_id")
    counts = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"))
    cores = counts.filter(F.col("n_near") >= min_points).select(F.col("id").alias("o_id"), F.lit(True).alias("is_core"))
    reached = pairs.join(cores, "o_id").select("id").distinct().withColumn("reached", F.lit(True))
    out = counts.join(reached, "id", "left")
    return out.select("id", "n_near", (F.col("n_near") >= min_points).alias("core"), F.col("reached").isNull().alias("noise"))


def classical_scaling(points: np.ndarray, k: int = 2) -> np.ndarray:
    """Classical multidimensional scaling of Euclidean distances; signs fixed."""
    centred = points - points.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    out = u[:, :k] * s[:k]
    return out * np.where(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])] < 0, -1, 1)


def stochastic_neighbours(points: np.ndarray, *, perplexity: float = 30.0, steps: int = 300, seed: int = 1) -> np.ndarray:
    """t-distributed stochastic neighbour embedding of a small sample."""
    n = len(points)
    d2 = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    p = np.zeros((n, n))
    target = math.log(min(perplexity, (n - 1) / 3))
    for i in range(n):
        low, high, beta = 0.0, np.inf, 1.0
        row = np.delete(d2[i], i)
        for _ in range(50):
            e = np.exp(-(row - row.min()) * beta)
            e /= e.sum()
            h = -(e * np.log(np.maximum(e, 1e-12))).sum()
            if abs(h - target) < 1e-5:
                break
            low, high = (beta, high) if h > target else (low, beta)
            beta = beta * 2 if high == np.inf else (low + high) / 2
        p[i, np.arange(n) != i] = e
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, 2))
    move = np.zeros_like(y)
    for step in range(steps):
        q = 1 / (1 + ((y[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))
        np.fill_diagonal(q, 0)
        w = (p * (4 if step < 100 else 1) - q / q.sum()) * q
        grad = 4 * (np.diag(w.sum(axis=1)) - w) @ y
        move = (0.5 if step < 100 else 0.8) * move - 100 * grad
        y = y + move - move.mean(axis=0)
    return y


def compare_embedding(x: DataFrame, y: DataFrame, id_col: str, cols: Sequence[str], *, method: str = "mds", sample: int = 200) -> DataFrame:
    """(side, id, dim1, dim2): each side in two dimensions.

    ``mds`` is classical scaling of Euclidean distances, which is linear: its
    axes come from the covariance of all rows and every row is projected.
    ``tsne`` embeds at most ``sample`` rows a side, in the order of a hash of the
    id, since its cost grows with the square of the rows.
    """
    if method == "mds":
        out = None
        for side, d in (("x", x), ("y", y)):
            rows = complete(d, cols)
            mean, cov, _ = covariance(rows, cols)
            sd = np.where(np.diag(cov) > 0, np.sqrt(np.diag(cov)), 1)
            values, axes = np.linalg.eigh(cov / np.outer(sd, sd))
            axes = axes[:, np.argsort(-values, kind="stable")[:2]]
            axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)
            z = [(F.col(c).cast("double") - float(mean[k])) / float(sd[k]) for k, c in enumerate(cols)]
            dims = [sum((z[k] * float(axes[k, j]) for k in range(len(cols))), F.lit(0.0)).alias(f"dim{j + 1}") for j in range(axes.shape[1])]
            one = rows.select(F.lit(side).alias("side"), F.col(id_col).alias("id"), *dims)
            out = one if out is None else out.unionByName(one)
        return out
    rows = []
    for side, d in (("x", x), ("y", y)):
        ids = [r[0] for r in complete(d, cols).orderBy(F.xxhash64(id_col, F.lit(1)), id_col).limit(sample).select(id_col).collect()]
        pts = bounded_sample(d, id_col, cols, sample)
        pts = (pts - pts.mean(axis=0)) / np.where(pts.std(axis=0) > 0, pts.std(axis=0), 1)
        rows += [(side, i, float(a), float(b)) for i, (a, b) in zip(ids, stochastic_neighbours(pts), strict=True)]
    kind = x.schema[id_col].dataType.simpleString()
    return x.sparkSession.createDataFrame(rows, f"side string, id {kind}, dim1 double, dim2 double")


def ci_overlap(x: DataFrame, y: DataFrame, id_col: str, estimator: Callable[[DataFrame], float], *, rounds: int = 20, level: float = 0.95, seed: int = 1) -> DataFrame:
    """Bootstrap intervals of any estimator on both sides, and their overlap.

    A resample repeats a row as often as a Poisson draw of its hash says.
    """
    from .models import _POISSON

    out = []
    for d in (x, y):
        values = []
        for b in range(rounds):
            u = (F.pmod(F.xxhash64(id_col, F.lit(seed + b)), F.lit(1 << 30)) + 0.5) / (1 << 30)
            w = sum(((u > c).cast("int") for c in _POISSON), F.lit(0))
            values.append(float(estimator(d.withColumn("__w", w).filter("__w > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__w")))).drop("__w", "__k"))))
        out.append((float(estimator(d)), *np.quantile(values, [(1 - level) / 2, (1 + level) / 2]), float(np.std(values, ddof=1))))
    (m1, l1, u1, s1), (m2, l2, u2, s2) = out
    union, inter = max(u1, u2) - min(l1, l2), max(0.0, min(u1, u2) - max(l1, l2))
    return scalar_row(x.sparkSession, m_x=m1, m_y=m2, lower_x=float(l1), upper_x=float(u1), lower_y=float(l2), upper_y=float(u2), overlap_perc=100 * inter / union if union else 100.0 * (m1 == m2), ratio_se=s2 / s1 if s1 else float("nan"))


def mmd_exact(
    x: DataFrame, y: DataFrame, id_col: str, cols: Sequence[str], *, heuristic_rows: int = 2000, sigma: float | None = None, kernel: str = "gaussian", n_perm: int = 0, seed: int = 1
) -> DataFrame:
    """Unbiased squared maximum mean discrepancy over all pairs of rows, after
    pooled z-scores, with a ``gaussian`` or ``rational_quadratic`` kernel.  The
    bandwidth is the median distance; only that heuristic looks at
    ``heuristic_rows`` pooled rows at most.  With ``n_perm`` also ``p_value``:
    the share of permutations, by a hash of the rows, with at least that value."""
    x, y = complete(x, cols), complete(y, cols)
    both = x.select(id_col, *cols).unionByName(y.select(id_col, *cols))
    m = both.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(cols)], *[F.stddev_samp(c).alias(f"s{k}") for k, c in enumerate(cols)]).first()
    mean, sd = [float(m[f"m{k}"]) for k in range(len(cols))], [float(m[f"s{k}"] or 1.0) for k in range(len(cols))]
    if sigma is None:
        pts = (bounded_sample(both, id_col, cols, heuristic_rows) - mean) / sd
        dist = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(axis=2))
        sigma = float(np.median(dist[np.triu_indices(len(pts), 1)])) or 1.0
    z = lambda d: d.select(F.col(id_col).cast("bigint").alias("id"), F.array(*[(F.col(c).cast("double") - mean[k]) / sd[k] for k, c in enumerate(cols)]).alias("nums"))
    zx, zy = z(x), z(y)

    def value(a: DataFrame, b: DataFrame) -> float:
        n, k = a.count(), b.count()
        xx, yy, xy = (kernel_sum(p, q, sigma, kernel=kernel) for p, q in ((a, a), (b, b), (a, b)))
        return (xx - n) / (n * (n - 1)) + (yy - k) / (k * (k - 1)) - 2 * xy / (n * k)  # a row with itself counts one

    mmd2 = value(zx, zy)
    extra = {}
    if n_perm:
        n = zx.count()
        pool = zx.withColumn("side", F.lit(0)).unionByName(zy.withColumn("side", F.lit(1)))
        null = []
        for b in range(n_perm):
            drawn = pool.withColumn("u", F.xxhash64("id", "side", F.lit(seed + b)))
            share = n / max(1, drawn.count())
            cut = quantiles(drawn, "u", [share])[0]  # the sizes stay as they were, but for the rounding of hashes
            null.append(value(drawn.filter(F.col("u") <= cut).select("id", "nums"), drawn.filter(F.col("u") > cut).select("id", "nums")))
        extra = {"p_value": (1 + sum(v >= mmd2 for v in null)) / (1 + n_perm)}
    return scalar_row(x.sparkSession, mmd2=mmd2, sigma=sigma, utility_score=min(1.0, max(0.0, math.exp(-max(0.0, mmd2) / sigma**2))), **extra)


def mutual_information_distance(x: DataFrame, y: DataFrame, cols: Sequence[str], *, n_bins: int = 10) -> DataFrame:
    """Jensen-Shannon divergence of joint equal-width histograms; each side is
    binned over its own range."""
    from .cells import cells

    sides = []
    for d in (x, y):
        r = d.agg(*[F.min(c).cast("double").alias(f"l{k}") for k, c in enumerate(cols)], *[F.max(c).cast("double").alias(f"h{k}") for k, c in enumerate(cols)]).first()
        at = []
        for k, c in enumerate(cols):
            width = (r[f"h{k}"] - r[f"l{k}"]) / n_bins or 1.0
            at.append(F.least(F.lit(n_bins), F.greatest(F.lit(1), F.ceil(F.round((F.col(c) - r[f"l{k}"]) / width, 9)))).cast("int").alias(c))
        sides.append(complete(d, cols).select(*at))
    both = cells(*sides, cols)
    totals = both.agg(F.sum("o").alias("no"), F.sum("r").alias("nr"))
    p, q = F.col("o") / F.col("no"), F.col("r") / F.col("nr")
    m = (p + q) / 2
    part = lambda a: F.when(a > 0, a * F.log(a / m)).otherwise(0.0)
    return both.join(F.broadcast(totals)).agg((0.5 * F.sum(part(p)) + 0.5 * F.sum(part(q))).alias("distance"))

