"""Entropic transport without a matrix, for costs that are means over columns.

Rows that agree in all columns but one number are a cell.  Between two cells a
cost is a constant and a multiple of the difference of that number, so that the
sum of exp(-cost) over a side comes from running sums along the number, from
below and from above.  Sums and the median are those over all pairs; nulls
change only the constant and the multiple of a pair of cells.
"""

from __future__ import annotations

import math

import numpy as np

#: Costs over epsilon up to which products of exponentials stay within doubles.
_PLAIN = 200.0
#: Pairs of rows that are listed to read an order statistic off.
_LISTED = 1_000_000


def alike(v: tuple) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Different rows of (numbers, category hashes), the one of each row, and their counts."""
    bits = np.hstack([np.ascontiguousarray(v[0] + 0.0).view(np.int64).reshape(len(v[0]), -1), v[1]])
    _, first, which, n = np.unique(bits, axis=0, return_index=True, return_inverse=True, return_counts=True)
    return tuple(c[first] for c in v), which.ravel(), n


class _Side:
    """Rows in the order of number ``k``, and their cells."""

    def __init__(self, v: tuple, k: int):
        x = v[0][:, k]
        empty = np.isnan(x)
        (nums, self.cats), cell, n = alike((np.column_stack([np.delete(v[0], k, axis=1), empty.astype(float)]), v[1]))
        self.nums, self.empty = nums[:, :-1], nums[:, -1] > 0
        x = np.where(empty, 0.0, x)
        self.order = np.argsort(x, kind="stable")
        self.x, self.cell = x[self.order], cell[self.order]
        self.rows = np.split(np.argsort(self.cell, kind="stable"), np.cumsum(n)[:-1])


class Lines:
    """Costs between two sides of rows (Gower distances, nulls ignored)."""

    def __init__(self, a: tuple, b: tuple, spec: dict):
        self.spec, self.shape = spec, (len(a[0]), len(b[0]))
        k = int(np.argmax([len(np.unique(np.concatenate([a[0][:, n], b[0][:, n]]))) for n in range(a[0].shape[1])]))
        self.own, self.num_w = spec["num_w"][k], np.delete(spec["num_w"], k)
        self.a, self.b = _Side(a, k), _Side(b, k)
        self.low = min(self.a.x[0], self.b.x[0])
        self.span = max(self.a.x[-1], self.b.x[-1]) - self.low

    @staticmethod
    def fit(a: tuple, b: tuple, spec: dict) -> Lines | None:
        """The lines of two sides, if sums along them are less work than all pairs."""
        if spec["kind"] != "gower" or spec["na"] != "ignore" or not a[0].shape[1] or not len(a[0]) or not len(b[0]):
            return None
        lines = Lines(a, b, spec)
        (n, m), (p, q) = lines.shape, lines.cells
        return lines if n * m > p * m + q * n + 5000 * (p + q) else None

    @property
    def cells(self) -> tuple[int, int]:
        return len(self.a.rows), len(self.b.rows)

    def between(self, p: _Side, c: int, q: _Side) -> tuple[np.ndarray, np.ndarray]:
        """Of cell ``c`` of ``p`` and each cell of ``q``: the cost of rows with equal numbers,
        and what a difference of one adds."""
        total, weight = np.zeros(len(q.rows)), np.zeros(len(q.rows))
        for n, w in enumerate(self.num_w):
            d = np.abs(p.nums[c, n] - q.nums[:, n])
            known = ~np.isnan(d)
            total += w * np.where(known, d, 0.0)
            weight += w * known
        for n, w in enumerate(self.spec["cat_w"]):
            known = (p.cats[c, n] != self.spec["null"]) & (q.cats[:, n] != self.spec["null"])
            total += w * (known & (p.cats[c, n] != q.cats[:, n]))
            weight += w * known
        line = np.where(p.empty[c] | q.empty, 0.0, self.own)
        weight += line
        some = weight > 0
        return np.divide(total, weight, out=np.ones(len(total)), where=some), np.divide(line, weight, out=np.zeros(len(total)), where=some)

    @property
    def highest(self) -> float:
        """A bound of all costs."""
        return max(float((const + slope * self.span).max()) for c in range(len(self.a.rows)) for const, slope in [self.between(self.a, c, self.b)])

    def sums(self, p: _Side, q: _Side, h: np.ndarray, eps: float, plain: bool) -> np.ndarray:
        """log of the sum of exp(h - cost / eps) over the rows of ``q``, for each row of ``p``."""
        out, h, powers = np.empty(len(p.x)), h[q.order], {}
        top = h.max()
        v, y, mid = np.exp(h - top), q.x, self.low + self.span / 2
        for c, rows in enumerate(p.rows):
            const, slope = self.between(p, c, q)
            x = p.x[rows]
            got = np.zeros(len(x)) if plain else np.full(len(x), -np.inf)
            for s in np.unique(slope):
                every = bool((slope == s).all())
                some = slice(None) if every else np.flatnonzero((slope == s)[q.cell])
                at = y[some]
                if s == 0:
                    z = h[some] - const[q.cell[some]] / eps
                    high = z.max()
                    each = high + math.log(np.exp(z - high).sum())
                    got = got + math.exp(each - top) if plain else np.logaddexp(got, each)
                    continue
                place = np.searchsorted(at, x, "right")
                below, above = np.empty(len(at) + 1), np.empty(len(at) + 1)
                z = (x - mid) * (s / eps)
                if plain:
                    if s not in powers:
                        powers[s] = np.exp((y - mid) * (s / eps))
                    e = powers[s][some]
                    w = v[some] * np.exp(const / -eps)[q.cell[some]]
                    below[0] = above[-1] = 0.0
                    np.cumsum(w * e, out=below[1:])
                    w /= e
                    np.cumsum(w[::-1], out=above[-2::-1])
                    got = got + below[place] * np.exp(-z) + above[place] * np.exp(z)
                else:
                    w, e = h[some] - const[q.cell[some]] / eps, (at - mid) * (s / eps)
                    below[0] = above[-1] = -np.inf
                    np.logaddexp.accumulate(w + e, out=below[1:])
                    above[-2::-1] = np.logaddexp.accumulate((w - e)[::-1])
                    got = np.logaddexp(got, np.logaddexp(below[place] - z, above[place] + z))
            out[p.order[rows]] = np.log(got) + top if plain else got
        return out

    def potentials(self, wa: np.ndarray, wb: np.ndarray, eps: float, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
        """(f, g) of ``linkage.sinkhorn`` where row i stands for ``wa[i]`` equal ones and column j for ``wb[j]``."""
        f, g = np.zeros(len(wa)), np.zeros(len(wb))
        la, lb = -math.log(wa.sum()), -math.log(wb.sum())
        plain = self.highest <= _PLAIN * eps
        for _ in range(max_iter):
            f = eps * (la - self.sums(self.a, self.b, np.log(wb) + g / eps, eps, plain))
            new = eps * (lb - self.sums(self.b, self.a, np.log(wa) + f / eps, eps, plain))
            done = np.abs(new - g).max() < tol
            g = new
            if done:
                break
        return f, g

    def median_positive(self, wa: np.ndarray, wb: np.ndarray) -> float:
        """The exact median of the positive costs of all pairs of records; 0 without any.

        Costs are halved by counting until few pairs are left, which are listed.
        """
        wa, wb = wa[self.a.order], wb[self.b.order]
        xs, ys = ([side.x[r] for r in side.rows] for side in (self.a, self.b))
        us, vs = ([w[r] for r in side.rows] for w, side in ((wa, self.a), (wb, self.b)))
        runs = [np.concatenate([[0.0], np.cumsum(v)]) for v in vs]
        known: dict[float, tuple[float, float]] = {}
        rates = [self.between(self.a, c, self.b) for c in range(len(xs))]

        def reach(c: int, k: int, t: float) -> tuple[np.ndarray, np.ndarray]:
            """The rows of cell k within ``t`` of each row of cell c: from, to."""
            const, slope = rates[c][0][k], rates[c][1][k]
            x, y = xs[c], ys[k]
            if t < const or slope == 0:
                return np.zeros(len(x), int), np.full(len(x), len(y) if t >= const else 0)
            far = (t - const) / slope
            return np.searchsorted(y, x - far, "left"), np.searchsorted(y, x + far, "right")

        def within(t: float) -> tuple[float, float]:
            """Pairs of records and of rows with costs up to ``t``."""
            if t not in known:
                records = rows = 0.0
                for c, u in enumerate(us):
                    for k, run in enumerate(runs):
                        low, high = reach(c, k, t)
                        records += float(u @ (run[high] - run[low]))
                        rows += float((high - low).sum())
                known[t] = records, rows
            return known[t]

        def listed(low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
            """Costs above ``low`` and up to ``high``, with the pairs of records that have them."""
            values, counts = [np.zeros(0)], [np.zeros(0)]
            for c, (x, u) in enumerate(zip(xs, us, strict=True)):
                for k, (y, v) in enumerate(zip(ys, vs, strict=True)):
                    (a, d), (b, e) = reach(c, k, high), reach(c, k, low)
                    b, e = np.where(e > b, b, d), np.where(e > b, e, d)
                    for left, right in ((a, b), (e, d)):
                        n = right - left
                        i = np.repeat(np.arange(len(x)), n)
                        j = np.arange(len(i)) + np.repeat(left - np.cumsum(n) + n, n)
                        values.append(rates[c][0][k] + rates[c][1][k] * np.abs(x[i] - y[j]))
                        counts.append(u[i] * v[j])
            values, counts = np.concatenate(values), np.concatenate(counts)
            order = np.argsort(values)
            return values[order], counts[order]

        def ranked(r: float) -> float:
            low, high = 0.0, top
            while within(high)[1] - within(low)[1] > _LISTED and high - low > 1e-14 * high:
                half = (low + high) / 2
                low, high = (low, half) if within(half)[0] > r else (half, high)
            if within(high)[1] - within(low)[1] > _LISTED:
                return high
            if (low, high) not in lists:
                lists[low, high] = listed(low, high)
            values, counts = lists[low, high]
            return float(values[np.searchsorted(within(low)[0] + np.cumsum(counts), r, "right")])

        lists: dict[tuple[float, float], tuple[np.ndarray, np.ndarray]] = {}
        top = self.highest * (1 + 1e-9)
        none, total = within(0.0)[0], float(wa.sum() * wb.sum())
        if total <= none:
            return 0.0
        return float(np.mean([ranked(none + r) for r in ((total - none - 1) // 2, (total - none) // 2)]))
