"""Filling missing values from similar records (problem 2).

A mixture of Gaussian-categorical classes is fitted by expectation-maximisation over all rows: numbers are
Gaussian given the class, the category is multinomial given the class, and missing entries are integrated
out. A row's numbers are the logs of its values and, of its donors (records of the same group, the row itself left
out), the mean logs of those within a window of time and of those of the same time. A missing number is filled with its
conditional expectation, a category with its conditional mode given the group's records. Every step sums sufficient
statistics over the partitions; the driver only holds the model. The rows are kept as blocks of arrays, so that a step is
a plain job of one stage and neither plans a query nor converts rows.
"""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.skew import skew_safe_left_join

#: Rows of a class's fair share that weigh as much as the prior on its covariance, which is the spread of all rows without correlation.
RIDGE = 1e-3
#: Records of a group that the classes' categories weigh as much as; pseudo-records of each category in a class.
PRIOR, SMOOTH = 1.0, 0.01
#: Most codes a category may have, so that a class's table is bounded.
MOST_CODES = 20_000
#: Rows of a block, and partitions whose sums may go to the driver at once; those of more are added up in tasks first.
BLOCK, AT_ONCE = 65_536, 32


@dataclass
class Model:
    weight: object  # K
    mean: object  # K x d
    cov: object  # K x d x d
    cats: dict = field(default_factory=dict)  # category -> column of `table`
    table: object = None  # K x categories, rows sum to 1
    steps: int = 0  # passes over the rows
    rows: int = 0
    loglik: float = float("-inf")  # log likelihood with the priors, before the last step
    converged: bool = False

    def vector(self):
        """Unconstrained parameters: logs of weights and tables, means, Cholesky factors with log diagonals."""
        import numpy as np

        low = np.linalg.cholesky(self.cov)
        k, d = self.mean.shape
        at = np.arange(d)
        low[:, at, at] = np.log(low[:, at, at])
        parts = [np.log(np.maximum(self.weight, 1e-12)), self.mean.ravel(), low[:, *np.tril_indices(d)].ravel()]
        return np.concatenate(parts + ([np.log(self.table).ravel()] if self.table is not None else []))

    def of(self, v) -> Model:
        """A model of the same shape from unconstrained parameters."""
        import numpy as np

        k, d = self.mean.shape
        size = d * (d + 1) // 2
        w, mean, low, table = np.split(v, np.cumsum([k, k * d, k * size]))
        factor = np.zeros((k, d, d))
        factor[:, *np.tril_indices(d)] = low.reshape(k, size)
        at = np.arange(d)
        factor[:, at, at] = np.exp(factor[:, at, at])
        share = lambda x: (e := np.exp(x - x.max(axis=-1, keepdims=True))) / e.sum(axis=-1, keepdims=True)
        return Model(share(w), mean.reshape(k, d), factor @ factor.transpose(0, 2, 1), self.cats, share(table.reshape(k, -1)) if self.table is not None else None)


def _given(model: Model, o, m) -> list[tuple]:
    """Of every class: precision and log determinant of the numbers o, and gain and covariance of the numbers m given those."""
    import numpy as np

    out = []
    for s in model.cov:
        low = s[np.ix_(o, o)]
        inv = np.linalg.inv(low) if len(o) else low
        gain = s[np.ix_(m, o)] @ inv
        out.append((inv, np.linalg.slogdet(low)[1] if len(o) else 0.0, gain, s[np.ix_(m, m)] - gain @ s[np.ix_(o, m)]))
    return out


def _shares(logp):
    """Responsibilities and log likelihoods from the classes' log densities (n x K)."""
    import numpy as np

    top = logp.max(axis=1, keepdims=True)
    like = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
    return np.exp(logp - like[:, None]), like


def expect(model: Model, x, cat):
    """Responsibilities (n x K), conditional means (K x n x d), conditional covariances by row pattern, log likelihoods."""
    import numpy as np

    n, d, k = len(x), x.shape[1], len(model.weight)
    logp = np.tile(np.log(np.maximum(model.weight, 1e-300)), (n, 1))
    filled, extra = np.empty((k, n, d)), []
    seen = ~np.isnan(x)
    pattern = seen @ (1 << np.arange(d))
    for p in np.unique(pattern):
        rows = np.flatnonzero(pattern == p)
        o, m = np.flatnonzero(seen[rows[0]]), np.flatnonzero(~seen[rows[0]])
        xo, covs = x[np.ix_(rows, o)], np.zeros((k, d, d))
        for j, (inv, det, gain, rest) in enumerate(_given(model, o, m)):
            dev = xo - model.mean[j][o]
            logp[rows, j] -= 0.5 * (((dev @ inv) * dev).sum(axis=1) + det + len(o) * np.log(2 * np.pi))
            filled[j][np.ix_(rows, o)] = xo
            filled[j][np.ix_(rows, m)] = model.mean[j][m] + dev @ gain.T
            covs[j][np.ix_(m, m)] = rest
        extra.append((rows, covs))
    if model.table is not None:
        known = np.flatnonzero(cat >= 0)
        logp[known] += np.log(np.maximum(model.table[:, cat[known]].T, 1e-300))
    r, like = _shares(logp)
    return r, filled, extra, like


def _features(f, width: int, cats: dict):
    import numpy as np

    x = np.column_stack([f[f"__x{i}"].to_numpy("float64") for i in range(width)]) if width else np.empty((len(f), 0))
    cat = f["__cat"].map(cats).fillna(-1).to_numpy("int64") if cats else np.full(len(f), -1)
    return x, cat


def _pack(frames: Iterator, width: int) -> Iterator:
    """Blocks of up to about BLOCK rows, pickled: for every pattern of seen numbers (and category, the highest bit) the numbers, codes and weights."""
    import numpy as np
    import pandas as pd

    def block(held: list):
        f = pd.concat(held)
        x = np.column_stack([f[f"__x{i}"].to_numpy("float64") for i in range(width)]) if width else np.empty((len(f), 0))
        coded = f["__cat"].notna().to_numpy()
        cat, w = f["__cat"].fillna(0).to_numpy("int64"), f["__w"].to_numpy("float64")
        pattern = ~np.isnan(x) @ (1 << np.arange(width)) + (coded.astype("int64") << width)
        parts = []
        for p in np.unique(pattern):
            at = np.flatnonzero(pattern == p)
            o = [i for i in range(width) if p >> i & 1]
            parts.append((int(p), x[np.ix_(at, o)], cat[at] if p >> width else None, w[at]))
        return pd.DataFrame({"block": [pickle.dumps(parts, 5)]})

    held, n = [], 0
    for f in frames:
        if f.empty:
            continue
        held.append(f)
        n += len(f)
        if n >= BLOCK:
            yield block(held)
            held, n = [], 0
    if held:
        yield block(held)


def _summed(blocks: RDD, of, add):
    """`add` over what `of` makes of every partition's blocks; None without partitions."""
    n = blocks.getNumPartitions()
    return blocks.mapPartitions(lambda bs: [of(bs)]).treeReduce(add, depth=1 if n <= AT_ONCE else 2) if n else None


def _totals(blocks: Iterator, width: int, centre) -> tuple:
    """Weight, and by number the weights, sums and squares of its deviations from `centre`; codes."""
    import numpy as np

    total, codes = np.zeros(1 + 3 * width), set()
    for p, x, cat, w in (part for b in blocks for part in b):
        total[0] += w.sum()
        o = np.array([i for i in range(width) if p >> i & 1], dtype="int64")
        dev = x - centre[o]
        total[1 + o] += w.sum()
        total[1 + width + o] += w @ dev
        total[1 + 2 * width + o] += w @ dev**2
        if cat is not None:
            codes.update(np.unique(cat).tolist())
    return total, codes


def _statistics(blocks: Iterator, model: Model):
    """Of every class: weight, and sums and products of the deviations from its mean; the log likelihood; weights of the codes."""
    import numpy as np

    k, d = model.mean.shape
    size, levels = 1 + d + d * d, np.array(list(model.cats), dtype="int64")  # in ascending order
    total = np.zeros(k * size + 1 + (model.table.size if model.table is not None else 0))
    classes, given = total[: k * size].reshape(k, size), {}
    by_code = total[k * size + 1 :].reshape(k, -1)
    prior = np.log(np.maximum(model.weight, 1e-300))
    table = np.log(np.maximum(model.table.T, 1e-300)) if model.table is not None else None
    for p, x, cat, w in (part for b in blocks for part in b):
        at = p & ((1 << d) - 1)
        if at not in given:
            o, m = (np.array([i for i in range(d) if (at >> i & 1) == is_seen], dtype="int64") for is_seen in (1, 0))
            given[at] = o, m, _given(model, o, m)
        o, m, parts = given[at]
        logp, devs = np.tile(prior, (len(w), 1)), []
        for j, (inv, det, _, _) in enumerate(parts):
            devs.append(dev := x - model.mean[j][o])
            logp[:, j] -= 0.5 * (((dev @ inv) * dev).sum(axis=1) + det + len(o) * np.log(2 * np.pi))
        if cat is not None:
            code = np.searchsorted(levels, cat)
            logp += table[code]
        r, like = _shares(logp)
        r *= w[:, None]
        total[k * size] += w @ like
        for j, (_, _, gain, rest) in enumerate(parts):
            whole, own = np.empty((d, len(o))), r[:, j]  # from deviations of the seen numbers to expected ones of all
            whole[o], whole[m] = np.eye(len(o)), gain
            second = whole @ (devs[j].T @ (devs[j] * own[:, None])) @ whole.T
            second[np.ix_(m, m)] += own.sum() * rest
            classes[j] += np.concatenate([[own.sum()], whole @ (own @ devs[j]), second.ravel()])
            if cat is not None:
                by_code[j] += np.bincount(code, weights=own, minlength=len(levels))
    return total


def _step(blocks: RDD, model: Model, n: int, spread) -> tuple[Model, float]:
    """One step of expectation and maximisation over all rows, and the log likelihood (with priors) of the model before it."""
    import numpy as np

    k, d = model.mean.shape
    total = _summed(blocks, lambda bs, m=model: _statistics(bs, m), np.add)
    base = k * (1 + d + d * d)
    draw, prior = RIDGE * n / k, np.diag(spread**2)
    like = total[base] - 0.5 * draw * sum(np.linalg.slogdet(c)[1] + np.trace(np.linalg.solve(c, prior)) for c in model.cov) + (SMOOTH * np.log(np.maximum(model.table, 1e-300)).sum() if model.table is not None else 0.0)
    weight, mean, cov = model.weight.copy(), model.mean.copy(), model.cov.copy()
    for j, (m, *rest) in enumerate(total[:base].reshape(k, -1)):
        weight[j] = max(m / n, 1e-12)
        if m < 1e-6:
            cov[j] = prior
            continue  # an empty class keeps its place
        dev = np.array(rest[:d]) / m
        mean[j] += dev
        c = np.array(rest[d:]).reshape(d, d) / m - np.outer(dev, dev)
        cov[j] = (m * (c + c.T) / 2 + draw * prior) / (m + draw)
    table = None
    if model.table is not None:
        table = total[base + 1 :].reshape(k, -1) + SMOOTH
        table /= table.sum(axis=1, keepdims=True)
    return Model(weight / weight.sum(), mean, cov, model.cats, table), float(like)


def fit(rows: DataFrame, width: int, classes: int, max_steps: int, tolerance: float) -> Model:
    """Model of columns __x0.. (null where missing) and __cat over all rows; deterministic.

    Equal rows are merged to one with a weight. Steps are extrapolated in pairs (squared extrapolation), and an
    extrapolation that lowers the likelihood is dropped. It ends when a step gains at most `tolerance` nats a row; where that
    takes more than max_steps passes, it warns and the model isn't marked as converged.
    """
    import numpy as np

    merged = rows.groupBy(*[f"__x{i}" for i in range(width)], "__cat").agg(F.count(F.lit(1)).alias("__w"))
    blocks = merged.mapInPandas(lambda fs: _pack(fs, width), "block binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    both = lambda a, b: (a[0] + b[0], a[1] | b[1])
    none = np.zeros(1 + 3 * width), set()
    total, codes = _summed(blocks, lambda bs: _totals(bs, width, np.zeros(width)), both) or none
    count, sums, _ = total[1:].reshape(3, -1)
    centre = np.where(count > 0, sums / np.maximum(count, 1), 0.0)
    _, rest, squares = (_summed(blocks, lambda bs: _totals(bs, width, centre), both) or none)[0][1:].reshape(3, -1)
    deviation = np.sqrt(np.maximum(squares / np.maximum(count, 1) - (rest / np.maximum(count, 1)) ** 2, 0.0))
    spread = np.maximum(np.where(deviation > 1e-9 * np.maximum(np.abs(centre), 1.0), deviation, 1.0), 1e-3)
    levels = sorted(codes)  # at most MOST_CODES
    shares = np.full((classes, len(levels)), 1 / len(levels)) if levels else None
    n, steps, converged, like = int(total[0]), 0, False, float("-inf")
    model = Model(np.full(classes, 1 / classes), np.array([centre + spread * (j - (classes - 1) / 2) for j in range(classes)]), np.array([np.diag(spread**2)] * classes), {c: i for i, c in enumerate(levels)}, shares, rows=n)
    if not n:
        blocks.unpersist()
        return model

    def step(m: Model) -> tuple[Model, float]:
        nonlocal steps
        steps += 1
        return _step(blocks, m, n, spread)

    while not converged and steps < max_steps:
        one, before = step(model)
        two, like = step(one)
        if converged := like - before <= tolerance * n:
            model = two
            break
        v0, v1, v2 = (m.vector() for m in (model, one, two))
        r, v = v1 - v0, v2 - 2 * v1 + v0
        alpha = min(-1.0, -np.linalg.norm(r) / max(np.linalg.norm(v), 1e-12))
        try:
            far, got = step(model.of(v0 - 2 * alpha * r + alpha**2 * v))
        except np.linalg.LinAlgError:
            got = float("nan")
        model, like = (far, got) if got >= like else (two, like)
    blocks.unpersist()
    if not converged:
        warnings.warn(f"the mixture still gains after {steps} passes", RuntimeWarning, stacklevel=2)
    model.steps, model.rows, model.loglik, model.converged = steps, n, like, converged
    return model


def with_features(df: DataFrame, group: str, time: str, numeric: dict[str, tuple[float, float]], window: int, category: str | None = None, valid: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """`df` with its features: __x<i> (logs of the values), then of the window's donors, then of those of the same time; __cat; the same before anything is joined; their rows.

    Donors are merged by (group, time) before anything is joined, and joined with frequent groups spread out.
    """
    if category and valid[1] - valid[0] >= MOST_CODES:
        raise ValueError(f"{category}: more than {MOST_CODES} codes")
    m = len(numeric)
    rows = df.withColumns({f"__x{i}": F.when((F.col(c) > lo) & (F.col(c) < hi), F.log(F.col(c).cast("double"))) for i, (c, (lo, hi)) in enumerate(numeric.items())})
    rows = rows.withColumn("__cat", F.when(F.col(category).between(*valid), F.col(category).cast("bigint")) if category else F.lit(None).cast("bigint"))
    rows = own = rows.withColumns({"__g": F.col(group), "__t": F.col(time).cast("bigint")})
    total = df.count()
    if m:
        per = rows.where("__g is not null and __t is not null").groupBy("__g", "__t").agg(*[g(f"__x{i}").alias(f"__{g.__name__}{i}") for i in range(m) for g in (F.sum, F.count)])
        near = per.withColumn("__off", F.explode(F.sequence(F.lit(-window), F.lit(window)))).withColumn("__t", F.col("__t") + F.col("__off"))
        sums = [F.sum(F.col(f"__{g}{i}") if at == "w" else F.when(F.col("__off") == 0, F.col(f"__{g}{i}"))).alias(f"__{g}{at}{i}") for i in range(m) for g in ("sum", "count") for at in ("w", "s")]
        rows = skew_safe_left_join(rows, near.groupBy("__g", "__t").agg(*sums), ["__g", "__t"], total)
        for k, at in enumerate(("w", "s"), 1):
            for i in range(m):
                given = F.when(F.col(f"__x{i}").isNotNull(), 1).otherwise(0)
                others = F.coalesce(F.col(f"__count{at}{i}"), F.lit(0)) - given
                rows = rows.withColumn(f"__x{k * m + i}", F.when(others > 0, (F.col(f"__sum{at}{i}") - F.coalesce(F.col(f"__x{i}"), F.lit(0.0))) / others))
        rows = rows.drop(*[f"__{g}{at}{i}" for i in range(m) for g in ("sum", "count") for at in ("w", "s")])
    return rows, own, total


def with_codes(rows: DataFrame, own: DataFrame, total: int, category: str | None = None) -> DataFrame:
    """What with_features returns, as one table with __codes (the group's categories with their counts)."""
    if category:
        counts = own.where("__g is not null and __cat is not null").groupBy("__g", "__cat").agg(F.count(F.lit(1)).alias("__n"))
        codes = counts.groupBy("__g").agg(F.array_sort(F.collect_list(F.struct("__cat", "__n"))).alias("__codes"))  # at most MOST_CODES
        return skew_safe_left_join(rows, codes, ["__g"], total, counted=own)
    return rows.withColumn("__codes", F.lit(None).cast("array<struct<__cat: bigint, __n: bigint>>"))


def mark_missing(df: DataFrame, group: str, time: str, numeric: dict[str, tuple[float, float]], window: int, category: str | None = None, valid: tuple[int, int] | None = None) -> DataFrame:
    """`df` with `<column>_filled`: whether fill_missing fills it. The same stages up to the donors, without a model."""
    df = df.drop(*[f"{c}_filled" for c in [*numeric, *([category] if category else [])]])
    rows, m = with_codes(*with_features(df, group, time, numeric, window, category, valid), category), len(numeric)
    marks = [(F.col(f"__x{i}").isNull() & F.col(f"__x{m + i}").isNotNull()).alias(f"{c}_filled") for i, c in enumerate(numeric)]
    if category:
        marks.append((F.col("__cat").isNull() & F.col("__codes").isNotNull()).alias(f"{category}_filled"))
    return rows.select(*df.columns, *marks)


def fill_missing(df: DataFrame, group: str, time: str, numeric: dict[str, tuple[float, float]], window: int, category: str | None = None, valid: tuple[int, int] | None = None, classes: int = 3, max_steps: int = 400, tolerance: float = 1e-5, guess: bool = False) -> DataFrame:
    """`df` with `<column>_value` (given or filled) and `<column>_filled` (true where filled) for each column.

    numeric: column -> (low, high); a number is missing unless low < value < high, where low >= 0. It is filled
    with its conditional expectation if a record of the same group and at most `window` time units away has a value; a
    category (whole number, missing unless within `valid`, both ends included) with the conditional mode given the
    group's categories of any time, the least of equals. Without such a record, a group or (numbers)
    a time, it stays null and unmarked. NaN counts as missing; repeated rows each keep their row; an empty table
    stays empty. Existing columns of the result's names are replaced; all others are kept. With `guess`,
    `<column>_guess` has what would be filled if the row's own value were missing, wherever there are donors besides it.
    """
    spark = df.sparkSession
    names = list(numeric)
    every = [*names, *([category] if category else [])]
    made = [f"{c}_{x}" for c in every for x in ("value", "filled", *(["guess"] if guess else []))]
    df = df.drop(*made)
    rows, own, total = with_features(df, group, time, numeric, window, category, valid)
    m = len(names)
    width = 3 * m
    model = fit(rows.select(*[f"__x{i}" for i in range(width)], "__cat"), width, classes, max_steps, tolerance)
    shared = spark.sparkContext.broadcast(model)
    rows = with_codes(rows, own, total, category).drop("__g", "__t")
    if not guess:
        rows = rows.withColumn("__codes", F.when(F.col("__cat").isNull(), F.col("__codes")))  # the others aren't asked
    kinds = [(c, "double") for c in names] + ([(category, "bigint")] if category else [])
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{c}_value` {t}, `{c}_filled` boolean" + (f", `{c}_guess` {t}" if guess else "") for c, t in kinds])
    columns, ends = df.columns, list(numeric.values())

    def expected(model: Model, x, cat, i: int):
        """Conditional expectation of number i, its own value left out."""
        import numpy as np

        x = x.copy()
        x[:, i] = np.nan
        r, filled, extra, _ = expect(model, x, cat)
        spread = np.empty((len(r), len(model.weight)))
        for at, covs in extra:
            spread[at] = covs[:, i, i]
        lo, hi = np.nextafter(ends[i][0], np.inf), np.nextafter(ends[i][1], -np.inf)
        of_class = np.exp(np.minimum(filled[:, :, i] + spread.T / 2, np.log(hi)))  # no class expects what counts as missing
        return np.clip(np.einsum("nk,kn->n", r, of_class), lo, hi)

    def mode(model: Model, r, codes, own) -> int | None:
        """Category of the greatest conditional probability given the classes' weights and the group's other records."""
        best = None
        for cat, n in codes:
            n -= cat == own
            if n > 0:
                score = n + PRIOR * float(r @ model.table[:, model.cats[cat]])
                if best is None or score > best[0]:
                    best = score, cat
        return best and best[1]

    def apply(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        model = shared.value
        for f in frames:
            if f.empty:
                continue
            x, cat = _features(f, width, model.cats)
            out = f[columns].copy()
            for i, c in enumerate(names):
                own, donors = x[:, i], ~np.isnan(x[:, m + i])
                can = np.isnan(own) & donors
                value = expected(model, x, cat, i) if guess or can.any() else np.full(len(f), np.nan)
                given = f[c].to_numpy("float64", na_value=np.nan)
                out[f"{c}_value"] = np.where(can, value, np.where(np.isnan(own), np.nan, given))
                out[f"{c}_filled"] = can
                if guess:
                    out[f"{c}_guess"] = np.where(donors, value, np.nan)
            if category:
                own = f["__cat"].to_numpy("float64", na_value=np.nan)
                asked = [codes is not None and (guess or v != v) for v, codes in zip(own, f["__codes"])]
                r = expect(model, x, np.full(len(f), -1))[0] if any(asked) else None
                found = [mode(model, r[j], [(c["__cat"], c["__n"]) for c in codes], own[j]) if asked[j] else None for j, codes in enumerate(f["__codes"])]
                filled = [v != v and g is not None for v, g in zip(own, found)]
                out[f"{category}_value"] = pd.array([g if put else None if v != v else int(v) for v, g, put in zip(own, found, filled)], "Int64")
                out[f"{category}_filled"] = filled
                if guess:
                    out[f"{category}_guess"] = pd.array(found, "Int64")
            yield out

    return rows.mapInPandas(apply, fields)


def fit_report(df: DataFrame, group: str, time: str, numeric: dict[str, tuple[float, float]], window: int, category: str | None = None, valid: tuple[int, int] | None = None, classes: int = 3, max_steps: int = 400, tolerance: float = 1e-5) -> DataFrame:
    """n_rows, steps (passes over the rows), loglik (nats a row, with priors), converged: of the model that fill_missing fits; nothing without rows."""
    rows, width = with_features(df, group, time, numeric, window, category, valid)[0], 3 * len(numeric)
    model = fit(rows.select(*[f"__x{i}" for i in range(width)], "__cat"), width, classes, max_steps, tolerance)
    report = [(model.rows, model.steps, float(model.loglik / model.rows), model.converged)] if model.rows else []
    return df.sparkSession.createDataFrame(report, "n_rows bigint, steps int, loglik double, converged boolean")
