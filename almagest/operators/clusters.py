"""Consensus clusters of names by how their returns move together, fitted anew at the start of each year."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.operators import models
from almagest.session import checkpoint


def packed(returns: DataFrame) -> DataFrame:
    """Returns as blocks of names, a row each: names in order and a matrix of their returns (names by calendar positions).

    NaN stands where there is no return. Names are spread by a hash over as many blocks as the session has shuffle
    partitions. ``years`` and ``ends`` are the last positions of each year that the block has seen.
    """
    blocks = int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = returns.schema["ticker"].dataType.simpleString()
    block = F.when(F.col("ticker").isNull(), -1).otherwise(F.pmod(F.hash("ticker"), F.lit(blocks)))  # no name, no group

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        nameless = part["ticker"].isna().all()
        names, at = (np.array([None]), np.zeros(len(part), dtype=int)) if nameless else np.unique(part["ticker"].to_numpy(), return_inverse=True)
        wide = np.full((len(names), int(part["day_idx"].max()) + 1), np.nan)
        if not nameless:
            wide[at, part["day_idx"].to_numpy()] = part["ret"].to_numpy(float)
        ends = part.groupby("year")["day_idx"].max()
        return pd.DataFrame({"block": part["block"].iloc[:1], "names": [names], "x": [wide.tobytes()], "years": [ends.index.to_numpy(int)], "ends": [ends.to_numpy(int)]})

    rows = returns.filter("day_idx is not null").select(block.alias("block"), "ticker", F.year("date").alias("year"), "day_idx", "ret")
    return rows.groupBy("block").applyInPandas(pack, f"block int, names array<{kind}>, x binary, years array<int>, ends array<long>")


def matrix(names: np.ndarray, x: bytes, days: int) -> np.ndarray:
    """The returns of a block, with NaN up to ``days`` calendar positions."""
    wide = np.frombuffer(x).reshape(len(names), -1)
    return wide if wide.shape[1] >= days else np.hstack([wide, np.full((len(names), days - wide.shape[1]), np.nan)])


def fit_years(blocks: DataFrame) -> list[tuple[int, int]]:
    """Years of the panel that have history, with the last calendar position before 1 January."""
    seen = blocks.select(F.explode(F.arrays_zip("years", "ends")).alias("y")).groupBy(F.col("y.years").alias("year")).agg(F.max("y.ends").alias("end"))
    ends = sorted((r.year, r.end) for r in seen.collect())  # a row per year
    return [(year, last) for (_, last), (year, _) in zip(ends, ends[1:])]


def coassign(labels: DataFrame, by: list[str]) -> DataFrame:
    """Pairs ``a <= b`` of names, with the numbers of runs that put them in one group and that have both.

    ``labels`` has ``by, run, ticker, label``. Each name meets the list of its group in each run, which is broadcast
    (a name per run), so that pairs are counted where they arise. Pairs that are never together have no row.
    """
    tasks = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = labels.groupBy(*by, "run", "label").agg(F.sort_array(F.collect_list("ticker")).alias("names"))
    spread = labels.repartition(tasks, *by, "ticker").join(F.broadcast(lists), [*by, "run", "label"])
    after = F.slice("names", F.array_position("names", F.col("ticker")).cast("int"), F.size("names"))
    pairs = spread.select(*by, F.col("ticker").alias("a"), F.explode(after).alias("b")).groupBy(*by, "a", "b").agg(F.count("*").alias("together"))
    runs = labels.groupBy(*by, "ticker").agg(F.collect_list("run").alias("runs"))
    for side in ("a", "b"):
        pairs = pairs.join(runs.select(*by, F.col("ticker").alias(side), F.col("runs").alias(f"runs_{side}")), [*by, side])
    return pairs.select(*by, "a", "b", "together", F.size(F.array_intersect("runs_a", "runs_b")).cast("long").alias("both"))


def labelled(blocks: DataFrame, years: list[tuple[int, int]], k: int, seeds: int, windows: list[int], components: int, coverage: float) -> DataFrame:
    """Labels of each year and window, a row for both: names, their blocks and a matrix of labels (names by seeds).

    Names are those with returns on a share ``coverage`` of the window's days. Blocks add their products of days, whose
    sums give the components; then each block has the loadings of its names.
    """
    spans = [(year, w, last, min(w, last)) for year, last in years for w in windows if min(w, last) >= coverage * w]
    kind = blocks.schema["names"].dataType.elementType.simpleString()

    def covered(names: np.ndarray, x: bytes):
        """For each span, which names of a block are covered, and their standardised returns (days by names)."""
        for year, w, last, days in spans:
            part = matrix(names, x, last + 1)[:, last - days + 1 : last + 1]
            enough = (~np.isnan(part)).sum(axis=1) >= coverage * days
            if enough.any():
                yield year, w, enough, models.standardised(np.nan_to_num(part[enough].T, nan=0.0))

    def products(batches):
        for batch in batches:
            for block, names, x in zip(batch["block"], batch["names"], batch["x"]):
                for year, w, enough, z in covered(names, x):
                    upper = (z @ z.T)[np.triu_indices(len(z))]
                    yield pd.DataFrame({"fit_year": year, "w": w, "block": block, "n": enough.sum(), "g": [upper.tobytes()]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        total = np.frombuffer(part["g"].iloc[0]).copy()
        for g in part["g"].iloc[1:]:
            total += np.frombuffer(g)
        return part.iloc[:1].assign(n=part["n"].sum(), g=[total.tobytes()])

    def direct(part: pd.DataFrame) -> pd.DataFrame:
        part = add(part)
        if part["n"].iloc[0] < 3 * k:
            return pd.DataFrame({"fit_year": [], "w": [], "d": []}, dtype=object)
        total = np.frombuffer(part["g"].iloc[0])
        days = int(np.sqrt(2 * len(total)))
        square = np.zeros((days, days))
        square[np.triu_indices(days)] = total
        square += np.triu(square, 1).T
        return part[["fit_year", "w"]].assign(d=[models.directions(square, components).tobytes()])

    sums = blocks.select("block", "names", "x").mapInPandas(products, one := "fit_year int, w int, block int, n long, g binary")
    sums = sums.groupBy("fit_year", "w", F.pmod("block", F.lit(32))).applyInPandas(add, one)  # no task has the matrices of all blocks
    found = sums.groupBy("fit_year", "w").applyInPandas(direct, "fit_year int, w int, d binary").collect()  # days times components per span
    weights = {(r.fit_year, r.w): np.frombuffer(r.d).reshape(-1, components) for r in found}

    def load(batches):
        for batch in batches:
            for block, names, x in zip(batch["block"], batch["names"], batch["x"]):
                for year, w, enough, z in covered(names, x):
                    if (year, w) in weights:
                        yield pd.DataFrame({"fit_year": year, "w": w, "block": block, "names": [np.asarray(names)[enough]], "x": [models.unit_rows(z.T @ weights[year, w]).tobytes()]})

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        names, w = np.concatenate(part["names"].to_list()), int(part["w"].iloc[0])
        order = np.argsort(names)
        points = np.vstack([np.frombuffer(x).reshape(-1, components) for x in part["x"]])[order]
        label = np.column_stack([models.kmeans(points, k, w * 1000 + seed) for seed in range(seeds)]).astype(np.int32)
        block = np.repeat(part["block"].to_numpy(), part["names"].map(len))[order]
        return part.iloc[:1][["fit_year", "w"]].assign(names=[names[order]], blocks=[block], labels=[label.tobytes()])

    loaded = blocks.select("block", "names", "x").mapInPandas(load, f"fit_year int, w int, block int, names array<{kind}>, x binary")
    return loaded.groupBy("fit_year", "w").applyInPandas(cluster, f"fit_year int, w int, names array<{kind}>, blocks array<int>, labels binary")


def profiles(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of ``ticker, run, label`` and two matrices whose products of rows are their shares of common runs.

    A row has a one for each run and the label in it. Products of such rows count the runs that put two names together;
    the share divides by the runs that have both, which depends on the sets of runs of the two names only. So there is a
    block of columns for each such set, and one side carries the divisors.
    """
    names, at = np.unique(part["ticker"].to_numpy(), return_inverse=True)
    runs, run = np.unique(part["run"].to_numpy(), return_inverse=True)
    cells, cell = np.unique(run * (int(part["label"].max()) + 1) + part["label"].to_numpy(), return_inverse=True)
    ones, has = np.zeros((len(names), len(cells))), np.zeros((len(names), len(runs)), dtype=bool)
    ones[at, cell], has[at, run] = 1.0, True
    sets, kind = np.unique(has, axis=0, return_inverse=True)
    kind, both = kind.ravel(), sets.astype(int) @ sets.T.astype(int)
    over = np.where(both > 0, 1 / np.maximum(both, 1), 0.0)
    right = np.equal.outer(kind, np.arange(len(sets)))[:, :, None] * ones[:, None, :]
    left = over[kind][:, :, None] * ones[:, None, :]
    return names, left.reshape(len(names), -1), right.reshape(len(names), -1)


def core_groups(labels: DataFrame, k: int, least: int) -> DataFrame:
    """Groups of the names that are in any run, by linkage of their shares of common runs: one task a year.

    A task holds a row of labels for each name of its year, not the pairs of names, and names of equal labels count as
    one row with a weight. There is a row for each block of names. Years with fewer than ``k * least`` names give none.
    """
    kind = labels.schema["names"].dataType.elementType.simpleString()

    def link(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("w")
        names, at = np.unique(np.concatenate(part["names"].to_list()), return_inverse=True)
        none = pd.DataFrame({"block": [], "fit_year": [], "names": [], "grp": []}, dtype=object)
        if len(names) < k * least:
            return none
        tables = [np.frombuffer(x, dtype=np.int32).reshape(len(n), -1) for n, x in zip(part["names"], part["labels"])]
        every, block, done = np.full((len(names), sum(t.shape[1] for t in tables)), -1, dtype=np.int32), np.zeros(len(names), dtype=int), [0, 0]
        for t, blocks in zip(tables, part["blocks"]):
            own = at[done[0] : done[0] + len(t)]
            every[own, done[1] : done[1] + t.shape[1]], block[own] = t, blocks
            done = [done[0] + t.shape[0], done[1] + t.shape[1]]
        _, one, same = np.unique(every, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(one)  # rows in order of their first names, which decides between equal ones
        ones, sets, over = shares(every[one[order]])
        grp = models.linkage_groups(ones, ones, k, least, sets, over, np.argsort(order)[same.ravel()])
        if (grp < 0).all():
            return none
        out = pd.DataFrame({"block": block, "names": names, "grp": grp}).groupby("block").agg(list).reset_index()
        return out.assign(fit_year=part["fit_year"].iloc[0])[none.columns]

    return labels.groupBy("fit_year").applyInPandas(link, f"block int, fit_year int, names array<{kind}>, grp array<int>")


def shares(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of common runs as products: ``over[kind[i], kind[j]] * (ones[i] @ ones[j])``.

    ``labels`` has a row per name and a column per run, -1 where a run doesn't have the name. ``ones`` has a one for each
    run and the label in it, so products count the runs that put two names together. The runs that have both depend on
    the names' sets of runs (``kind``) only.
    """
    has, k = labels >= 0, int(labels.max()) + 1
    sets, kind = np.unique(has, axis=0, return_inverse=True)
    both = sets.astype(int) @ sets.T.astype(int)
    ones = np.zeros((len(labels), labels.shape[1] * k), dtype=np.uint8)
    at, run = np.nonzero(has)
    ones[at, run * k + labels[at, run]] = 1
    return ones, kind.ravel(), np.where(both > 0, 1 / np.maximum(both, 1), 0.0)


def follow(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The row of ``means`` that each row of ``x`` correlates with most, over the days that have both; -1 where none does.

    Correlations are compared to nine digits, and the first of equal ones counts.
    """
    best, at = np.full(len(x), -np.inf), np.full(len(x), -1)
    for g, mean in enumerate(means):
        days = ~np.isnan(mean)
        y = mean[days]
        a, both = x[:, days], ~np.isnan(x[:, days])
        n = np.maximum(both.sum(axis=1), 1)
        changes = lambda v: np.where(both, v, -np.inf).max(axis=1, initial=-np.inf) > np.where(both, v, np.inf).min(axis=1, initial=np.inf)
        ok = changes(a) & changes(np.broadcast_to(y, a.shape))
        da = np.where(both, a - (np.where(both, a, 0.0).sum(axis=1) / n)[:, None], 0.0)
        dy = np.where(both, y - (np.where(both, y, 0.0).sum(axis=1) / n)[:, None], 0.0)
        scale = np.sqrt((da**2).sum(axis=1) * (dy**2).sum(axis=1))
        corr = np.where(ok & (scale > 0), (da * dy).sum(axis=1) / np.where(scale > 0, scale, 1.0), -np.inf).round(9)
        better = corr > best
        best[better], at[better] = corr[better], g
    return at


def homes(blocks: DataFrame, years: list[tuple[int, int]], core: DataFrame, k: int, longest: int, min_days: int) -> DataFrame:
    """Group of every name in every year: its own, or for names with ``min_days`` returns the one they follow most.

    What a name follows is the mean return of a group's names on each day. Blocks add sums and numbers of returns.
    """
    kind = blocks.schema["names"].dataType.elementType.simpleString()
    spans = [(year, max(0, last - longest + 1), last + 1) for year, last in years]
    own = core.groupBy("block").agg(F.collect_list(F.struct("fit_year", "names", "grp")).alias("core"))
    known = blocks.select("block", "names", "x").join(own, "block", "left").select("block", "names", "x", *[F.col(f"core.{c}").alias(f"core_{c}") for c in ("fit_year", "names", "grp")])

    def placed(batch: pd.DataFrame):
        """Of each block and year the names, their returns in the window and their groups, -1 where they have none."""
        for row in batch.itertuples():
            names = np.asarray(row.names)
            for year, start, end in spans:
                grp = np.full(len(names), -1)
                for y, some, groups in zip(*[[] if v is None else v for v in (row.core_fit_year, row.core_names, row.core_grp)]):
                    if y == year:
                        grp[np.searchsorted(names, np.asarray(some))] = groups
                yield row.block, year, names, matrix(names, row.x, end)[:, start:end], grp

    def add(batches):
        for batch in batches:
            for block, year, _, x, grp in placed(batch):
                if (grp >= 0).any():
                    there = ~np.isnan(x)
                    sums = np.array([[np.where(there[grp == g], x[grp == g], 0.0).sum(axis=0), there[grp == g].sum(axis=0)] for g in range(k)])
                    yield pd.DataFrame({"fit_year": year, "block": block, "s": [sums.tobytes()]})

    def mean(part: pd.DataFrame) -> pd.DataFrame:
        total, n = sum(np.frombuffer(s) for s in part.sort_values("block")["s"]).reshape(k, 2, -1).transpose(1, 0, 2)
        return part.iloc[:1][["fit_year"]].assign(m=[np.where(n > 0, total / np.maximum(n, 1), np.nan).tobytes()])

    found = known.mapInPandas(add, "fit_year int, block int, s binary").groupBy("fit_year").applyInPandas(mean, "fit_year int, m binary").collect()  # a row per year
    means = {r.fit_year: np.frombuffer(r.m).reshape(k, -1) for r in found}

    def place(batches):
        for batch in batches:
            for _, year, names, x, grp in placed(batch):
                if year in means:
                    rest = np.flatnonzero((grp < 0) & ((~np.isnan(x)).sum(axis=1) >= min_days))
                    grp[rest] = follow(x[rest], means[year])
                yield pd.DataFrame({"fit_year": year, "ticker": names, "grp": [f"cluster{g}" if g >= 0 else "other" for g in grp]})

    return known.mapInPandas(place, f"fit_year int, ticker {kind}, grp string")


def consensus(returns: DataFrame, k: int, seeds: int, windows: list[int], components: int, coverage: float, least: int, min_days: int) -> DataFrame:
    """Group of every ticker in every fit year (``cluster0`` ... or ``other``), from returns before 1 January only.

    ``returns`` has ``ticker, date, day_idx, ret``; a missing return is null, never a value carried on.
    """
    blocks = checkpoint(packed(returns))  # read several times below
    years = fit_years(blocks)
    core = checkpoint(core_groups(labelled(blocks, years, k, seeds, windows, components, coverage), k, least))
    return homes(blocks, years, core, k, max(windows), min_days)
