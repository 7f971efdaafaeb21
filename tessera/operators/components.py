"""Structure of many features: factors, independent components, chance eigenvalues, clusters.

What reads the rows is one aggregate each: tasks add up products of their rows' features, so what leaves them and what the
driver holds is the square of the number of features, whatever the number of rows. The models are fitted to that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def summed(rows: DataFrame, names: list[str], f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``f`` of batches of them (rows by ``names``); rows with nulls in ``names`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                part = f(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(names)))
                held = part if held is None else held + part
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(held.size)), pa.array(held.reshape(-1))], ["at", "v"])

    x = rows.select(*names).dropna().select(F.array(*[F.col(n).cast("double") for n in names]).alias("x"))
    got = x.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    return np.array([r["v"] for r in got])


def covariance(rows: DataFrame, names: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, means and population covariance: sums first, then products about the means."""
    first = summed(rows, names, lambda x: np.append(x.sum(axis=0), len(x)))
    if not len(first):
        return 0, np.zeros(len(names)), np.zeros((len(names), len(names)))
    n, mean = int(first[-1]), first[:-1] / first[-1]
    return n, mean, summed(rows, names, lambda x: (x - mean).T @ (x - mean)).reshape(len(names), -1) / n


def scaled(cov: np.ndarray) -> np.ndarray:
    """Covariance of standardised features; constant ones stay without variance."""
    s = np.sqrt(np.diag(cov))
    s = np.where(s > TINY, s, 1)
    return cov / np.outer(s, s)


# --- factors


def factors(cov: np.ndarray, k: int, steps: int = 2000, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Loadings, noise variances and the mean log-likelihood after each step of expectation maximisation, which starts
    at the principal components."""
    p = len(cov)
    values, vectors = np.linalg.eigh(cov)
    load = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k] - values[: p - k].mean(), TINY))
    noise = np.maximum(np.diag(cov) - np.square(load).sum(axis=1), 0.05 * np.maximum(np.diag(cov), TINY))
    found: list[float] = []
    for _ in range(steps):
        whole = load @ load.T + np.diag(noise)
        inverse = np.linalg.inv(whole)
        found.append(-0.5 * float(p * np.log(2 * np.pi) + np.linalg.slogdet(whole)[1] + np.trace(inverse @ cov)))
        if len(found) > 1 and found[-1] - found[-2] < tol * abs(found[-2]):
            break
        beta = load.T @ inverse
        load = cov @ beta.T @ np.linalg.inv(np.eye(k) - beta @ load + beta @ cov @ beta.T)
        noise = np.maximum(np.diag(cov - load @ beta @ cov), TINY)
    return load, noise, found


def criterion(n: int, p: int, k: int, likelihood: float) -> float:
    """Bayesian information: loadings without their rotation, and noise variances, are what is free."""
    return -2 * n * likelihood + (p * k - k * (k - 1) // 2 + p) * float(np.log(n))


def factor_sweep(rows: DataFrame, names: list[str], start: int = 1, stop: int | None = None, step: int = 5, half: int = 2, fine: int = 1) -> DataFrame:
    """``n_components, bic, mean_ll, phase, best`` of factor models of standardised features: every ``step`` factors
    from ``start`` to ``stop``, then every ``fine`` within ``half`` steps of the best of these unless it is the last."""
    n, _, cov = covariance(rows, names)
    p, corr = len(names), scaled(cov)
    found: dict[int, tuple[float, float, str]] = {}

    def try_all(counts: range, phase: str) -> int:
        for k in counts:
            if 0 < k < p and k not in found:
                ll = factors(corr, k)[2][-1]
                found[k] = criterion(n, p, k, ll), ll, phase
        return min(found, key=lambda k: (found[k][0], k))

    coarse = range(start, min(stop or p, p - 1) + 1, step)
    if n and len(coarse):
        best = try_all(coarse, "coarse")
        if best != coarse[-1]:
            try_all(range(max(start, best - half * step), best + half * step + 1, fine), "fine")
    best = min(found, key=lambda k: (found[k][0], k), default=None)
    return rows.sparkSession.createDataFrame([(k, *found[k], k == best) for k in sorted(found)], "n_components int, bic double, mean_ll double, phase string, best boolean")


# --- independent components


def decorrelated(w: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(w @ w.T)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, TINY))) @ vectors.T @ w


def independent(rows: DataFrame, names: list[str], k: int, steps: int = 200, tol: float = 1e-4, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Unmixing matrix (``k`` by features), mixing matrix, and the number of steps of the symmetric fixed-point iteration
    with the logarithm of the hyperbolic cosine.

    Each step is one aggregate of k x k sums over the whitened rows; keep ``rows`` in a written table. A component's sign
    makes its largest mixing weight positive; components go by the length of their mixing weights."""
    _, mean, cov = covariance(rows, names)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    white = vectors.T / np.sqrt(np.maximum(values, TINY))[:, None]
    w = decorrelated(np.random.default_rng(seed).standard_normal((k, k)))
    taken = 0
    for _ in range(steps):
        taken += 1

        def step(x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = (x - mean) @ white.T
            g = np.tanh(z @ w.T)
            return np.concatenate([(g.T @ z).reshape(-1), (1 - g * g).sum(axis=0), [len(x)]])

        got = summed(rows, names, step)
        fresh = decorrelated((got[: k * k].reshape(k, k) - got[k * k : -1, None] * w) / got[-1])
        moved = np.abs(np.abs((fresh * w).sum(axis=1)) - 1).max()
        w = fresh
        if moved < tol:
            break
    unmix = w @ white
    mixing = np.linalg.pinv(unmix)
    sign = np.sign(mixing[np.abs(mixing).argmax(axis=0), np.arange(k)])
    order = np.argsort(-np.square(mixing).sum(axis=0), kind="stable")
    return (unmix * sign[:, None])[order], (mixing * sign)[:, order], taken


# --- eigenvalues by chance


def chance_eigenvalues(rows: DataFrame, names: list[str], draws: int = 100, seed: int = 1, block: int | None = None, known: tuple[int, np.ndarray] | None = None) -> np.ndarray:
    """Eigenvalues (draws by features, descending) of the correlation of rows whose columns are permuted one by one. ``known``:
    the number of rows and their means, where the caller has them.

    Rows are dealt to random blocks of about ``block`` rows (four million values unless given), so that none is hot, and
    columns are permuted inside a block, all draws in one pass: rows that fit a block are permuted as a whole, of more rows
    each value still meets random others."""
    p = len(names)
    n, mean = known or covariance(rows, names)[:2]
    if not n:
        return np.zeros((draws, p))
    blocks = max(1, -(-n // (block or max(1000, (1 << 22) // p))))

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, values in zip(batch.column("b").to_pylist(), batch.column("xs"), strict=True):
                x = values.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                x = x[np.lexsort(x.T[::-1])] - mean  # whatever the order in which the rows came
                x = np.ascontiguousarray(x.T)  # a column's values lie together, for permuting goes all over them
                rng, out = np.random.default_rng([seed, number]), np.empty((draws, p, p))
                for d in range(draws):
                    y = rng.permuted(x, axis=1)
                    out[d] = y @ y.T
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.reshape(-1))], ["at", "v"])

    x = rows.select(*names).dropna().select(F.array(*[F.col(c).cast("double") for c in names]).alias("x"))
    # by place and not by value, for equal rows must not fill one block
    dealt = x.select("x", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(blocks)).alias("b"))
    sums = dealt.groupBy("b").agg(F.collect_list("x").alias("xs")).mapInArrow(permute, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    matrices = np.array([r["v"] for r in sums]).reshape(draws, p, p) / n
    return np.stack([np.sort(np.linalg.eigvalsh(scaled(m)))[::-1] for m in matrices])


def parallel_analysis(rows: DataFrame, names: list[str], draws: int = 100, seed: int = 1, block: int | None = None) -> DataFrame:
    """``component, eigenvalue, chance, retained``: eigenvalues of the correlation matrix against the 95th percentile of
    those by chance."""
    n, mean, cov = covariance(rows, names)
    real = np.sort(np.linalg.eigvalsh(scaled(cov)))[::-1]
    limit = np.percentile(chance_eigenvalues(rows, names, draws, seed, block, (n, mean)), 95, axis=0)
    return rows.sparkSession.createDataFrame([(k + 1, float(a), float(b), bool(a > b)) for k, (a, b) in enumerate(zip(real, limit, strict=True))], "component int, eigenvalue double, chance double, retained boolean")


# --- clusters


def linkage(distance: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Average linkage of a symmetric distance matrix as ``(a, b, height, size)``, by chains of nearest neighbours.

    Clusters are numbered as they form, after the single ones, in order of height; ``a < b``. Of equal distances the
    neighbour that a chain came from is preferred, then the first by number."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, live, chain, merges = np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(live)[0]))
        while True:
            at = chain[-1]
            near = np.where(live, d[at], np.inf)
            best = chain[-2] if len(chain) > 1 and near[chain[-2]] <= near.min() else int(near.argmin())
            if len(chain) > 1 and best == chain[-2]:
                break
            chain.append(best)
        b, a = chain.pop(), chain.pop()
        merges.append((float(d[a, b]), min(a, b), max(a, b)))
        both = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        keep, gone = min(a, b), max(a, b)
        d[keep], d[:, keep] = both, both
        d[keep, keep] = np.inf
        live[gone], size[keep] = False, size[a] + size[b]
    # the chains find merges in any order; their heights put them in order
    name, held, out = list(range(n)), [1] * n, []
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (height, a, b) in enumerate(sorted(merges)):
        x, y = root(a), root(b)
        out.append((min(name[x], name[y]), max(name[x], name[y]), height, held[x] + held[y]))
        parent[y], held[x], name[x] = x, held[x] + held[y], n + k
    return out


def cut_at(merges: list[tuple[int, int, float, int]], n: int, height: float) -> list[int]:
    """Number of the cluster of each of ``n`` items when merges above ``height`` are undone, from 0 by first item."""
    group = {k: [k] for k in range(n)}
    for k, (a, b, h, _) in enumerate(merges):
        if h <= height:
            group[n + k] = group.pop(a) + group.pop(b)
    of = {i: min(items) for items in group.values() for i in items}
    numbers = {first: k for k, first in enumerate(sorted(set(of.values())))}
    return [numbers[of[i]] for i in range(n)]


def correlation_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    """M2: ``a, b, r`` for every pair of ``names``, ``a`` before ``b``, from one aggregate of products; 0 where one is constant."""
    r = covariance(rows, names)[2]
    s = np.sqrt(np.diag(r))
    ok = np.outer(s, s) > TINY
    r = np.where(ok, r / np.where(ok, np.outer(s, s), 1), 0.0)
    return rows.sparkSession.createDataFrame([(*sorted((names[i], names[j])), float(r[i, j])) for i in range(len(names)) for j in range(i)], "a string, b string, r double")


def feature_distances(matrix: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and ``1 - |r|`` of a correlation matrix ``(a, b, r)`` that has a row per pair: at most a few hundred features."""
    pairs = [(r["a"], r["b"], r["r"]) for r in matrix.select("a", "b", "r").collect()]
    names = sorted({x for a, b, _ in pairs for x in (a, b)})
    at = {f: k for k, f in enumerate(names)}
    d = np.ones((len(names), len(names)))
    np.fill_diagonal(d, 0)
    for a, b, r in pairs:
        d[at[a], at[b]] = d[at[b], at[a]] = 1 - min(abs(r or 0.0), 1.0)
    return names, d


def clustered(matrix: DataFrame) -> DataFrame:
    """``step, a, b, height, size``: merges of the features of a correlation matrix; ``a`` and ``b`` name single
    features, or ``#k`` the cluster of step k."""
    names, d = feature_distances(matrix)
    merges = linkage(d) if len(names) > 1 else []
    label = lambda k: names[k] if k < len(names) else f"#{k - len(names) + 1}"
    return matrix.sparkSession.createDataFrame([(k, label(a), label(b), h, s) for k, (a, b, h, s) in enumerate(merges, 1)], "step int, a string, b string, height double, size int")


def feature_clusters(matrix: DataFrame, height: float = 0.05) -> DataFrame:
    """``feature, cluster`` with the tree cut at a height."""
    names, d = feature_distances(matrix)
    found = cut_at(linkage(d) if len(names) > 1 else [], len(names), height)
    return matrix.sparkSession.createDataFrame(list(zip(names, found, strict=True)), "feature string, cluster int")
