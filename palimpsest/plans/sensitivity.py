"""Sensitivity analysis of a scoring function as DataFrame jobs: Saltelli designs, Sobol indices, Morris screening."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.designs import Morris, Saltelli, drawn_counts

_MASK = (1 << 53) - 1


def _uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return (F.xxhash64(F.lit(seed), *parts).bitwiseAND(_MASK)) / float(1 << 53)


def saltelli_design(spark: SparkSession, n: int, parameters: int, seed: int = 1) -> DataFrame:
    """sample, matrix (A, B, AB0, AB1, ...) and x: n * (parameters + 2) rows.  A larger n keeps the rows of a smaller one."""
    base = spark.range(n).select(F.col("id").alias("sample"))
    a = F.array(*[_uniform(seed, F.col("sample"), F.lit(2 * k)) for k in range(parameters)])
    b = F.array(*[_uniform(seed, F.col("sample"), F.lit(2 * k + 1)) for k in range(parameters)])
    rows = base.withColumn("a", a).withColumn("b", b)
    mixes = [F.struct(F.lit("A").alias("matrix"), F.col("a").alias("x")), F.struct(F.lit("B").alias("matrix"), F.col("b").alias("x"))]
    for k in range(parameters):
        mixed = F.array(*[F.col("b")[j] if j == k else F.col("a")[j] for j in range(parameters)])
        mixes.append(F.struct(F.lit(f"AB{k}").alias("matrix"), mixed.alias("x")))
    return rows.select("sample", F.explode(F.array(*mixes)).alias("m")).select("sample", "m.matrix", "m.x")


def sobol_indices(outputs: DataFrame, parameters: int) -> DataFrame:
    """parameter, s1 (Saltelli 2010) and st (Jansen) from columns sample, matrix and y."""
    names = ["A", "B"] + [f"AB{k}" for k in range(parameters)]
    wide = outputs.groupBy("sample").pivot("matrix", names).agg(F.first("y"))
    # population variance of A and B together
    square = (F.avg(F.pow(F.col("A"), F.lit(2))) + F.avg(F.pow(F.col("B"), F.lit(2)))) / 2
    variance = square - F.pow((F.avg("A") + F.avg("B")) / 2, F.lit(2))
    sums = [F.avg(F.col("B") * (F.col(f"AB{k}") - F.col("A"))).alias(f"s{k}") for k in range(parameters)]
    sums += [(F.avg(F.pow(F.col("A") - F.col(f"AB{k}"), F.lit(2))) / 2).alias(f"t{k}") for k in range(parameters)]
    one = wide.agg(variance.alias("v"), *sums)
    rows = F.array(*[F.struct(F.lit(k).alias("parameter"), (F.col(f"s{k}") / F.col("v")).alias("s1"), (F.col(f"t{k}") / F.col("v")).alias("st")) for k in range(parameters)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def morris_screening(spark: SparkSession, trajectories: int, parameters: int, step: float, model: Callable[[Column], Column], seed: int = 3) -> DataFrame:
    """parameter, mu, mu_star and sigma (population) of the elementary effects.

    Each trajectory moves one parameter after another, in an order of its own.
    """
    start = F.array(*[_uniform(seed, F.col("t"), F.lit(k)) * (1 - step) for k in range(parameters)])
    order = F.transform(F.array_sort(F.array(*[F.struct(_uniform(seed + 1, F.col("t"), F.lit(k)).alias("u"), F.lit(k).alias("k")) for k in range(parameters)])), lambda s: s["k"])
    rows = spark.range(trajectories).select(F.col("id").alias("t")).withColumn("start", start).withColumn("order", order)
    rows = rows.select("t", "start", "order", F.explode(F.sequence(F.lit(0), F.lit(parameters))).alias("i"))
    moved = F.slice("order", F.lit(1), F.col("i"))
    point = F.transform("start", lambda v, j: F.when(F.array_contains(moved, j), v + step).otherwise(v))
    rows = rows.withColumn("x", point).withColumn("y", model(F.col("x")))
    before = F.lag("y").over(Window.partitionBy("t").orderBy("i"))
    effects = rows.withColumn("effect", (F.col("y") - before) / step).where("i > 0").withColumn("parameter", F.col("order")[F.col("i") - 1])
    return effects.groupBy("parameter").agg(F.avg("effect").alias("mu"), F.avg(F.abs("effect")).alias("mu_star"), F.stddev_pop("effect").alias("sigma"))


def rescored(candidates: DataFrame, design: DataFrame, score: Callable[[Column, DataFrame], Column]) -> DataFrame:
    """Mean score of the candidates under every parameter row.

    Candidates are summarised by the caller to a bounded table, which is
    broadcast to the design's rows.
    """
    rows = design.crossJoin(F.broadcast(candidates))
    return rows.withColumn("_s", score(F.col("x"), rows)).groupBy("sample", "matrix").agg(F.sum(F.col("_s") * F.col("weight")).alias("y"))


def rank_stability(screenings: DataFrame, top: int) -> DataFrame:
    """Mean overlap of the ``top`` parameters of any two seeds, and the greatest change of rank of a parameter that is in some seed's top.

    ``screenings``: seed, parameter and mu_star; some dozens of rows, so all windows are small.
    """
    w = Window.partitionBy("seed").orderBy(F.desc("mu_star"), "parameter")
    ranked = screenings.withColumn("rank", F.row_number().over(w))
    tops = ranked.where(F.col("rank") <= top).select("seed", "parameter")
    seeds = ranked.select("seed").distinct()
    pairs = seeds.join(seeds.select(F.col("seed").alias("other")), F.col("seed") < F.col("other"))
    both = tops.join(tops.select(F.col("seed").alias("other"), "parameter"), "parameter").where("seed < other").groupBy("seed", "other").agg(F.count("*").alias("n"))
    overlap = pairs.join(both, ["seed", "other"], "left").agg(F.coalesce(F.avg(F.coalesce("n", F.lit(0)) / top), F.lit(1.0)).alias("agreement"))
    moved = ranked.join(tops.select("parameter").distinct(), "parameter").groupBy("parameter").agg((F.max("rank") - F.min("rank")).alias("d"))
    return overlap.crossJoin(moved.agg(F.coalesce(F.max("d"), F.lit(0)).alias("displacement")))  # of one row each


def bootstrap_indices(outputs: DataFrame, parameters: int, resamples: int = 1000, confidence: float = 0.95, seed: int = 5) -> DataFrame:
    """parameter, and the percentile intervals of s1 and st over resamples of the samples.

    Every sample is drawn a Poisson (mean 1) number of times in each resample, told by a hash, so all resamples come from
    one pass of weighted sums; the sums, (4 + 2 parameters) a resample, are what is shuffled.
    """
    names = ["A", "B"] + [f"AB{k}" for k in range(parameters)]
    wide = outputs.groupBy("sample").pivot("matrix", names).agg(F.first("y"))
    rows = wide.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = _uniform(seed, F.col("sample"), F.col("resample"))
    steps, share, below = [], 0.36787944117144233, 0.0
    for k in range(12):  # the distribution function of Poisson, to the last double
        below += share
        steps.append(below)
        share /= k + 1
    rows = rows.withColumn("w", sum((u >= s).cast("int") for s in steps))
    mean = lambda c: F.sum(c * F.col("w")) / F.sum("w")
    a, b = F.col("A"), F.col("B")
    variance = (mean(a * a) + mean(b * b)) / 2 - F.pow((mean(a) + mean(b)) / 2, F.lit(2))
    sums = [x for k in range(parameters) for x in (mean(b * (F.col(f"AB{k}") - a)).alias(f"s{k}"), (mean((a - F.col(f"AB{k}")) * (a - F.col(f"AB{k}"))) / 2).alias(f"t{k}"))]
    each = rows.groupBy("resample").agg(variance.alias("v"), *sums)
    told = F.array(*[F.struct(F.lit(k).alias("parameter"), (F.col(f"s{k}") / F.col("v")).alias("s1"), (F.col(f"t{k}") / F.col("v")).alias("st")) for k in range(parameters)])
    each = each.select(F.explode(told).alias("r")).select("r.*")
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    ends = [F.percentile(c, p).alias(f"{c}_{name}") for c in ("s1", "st") for p, name in ((low, "low"), (high, "high"))]
    return each.groupBy("parameter").agg(*ends)


def converged_samples(measure: Callable[[int], DataFrame], target: float, start: int = 128, most: int = 4096, top: int = 10) -> list[tuple[int, float, bool]]:
    """Doublings of the number of samples until the widest half interval of the ``top`` total indices is at most ``target`` and
    their membership doesn't change: (samples, half width, met) for each.

    ``measure(n)`` gives parameter, st, st_low and st_high, a row for each parameter; a larger n keeps the samples of a smaller one.
    """
    steps: list[tuple[int, float, bool]] = []
    before: set[int] = set()
    n = start
    while True:
        rows = sorted(measure(n).select("parameter", "st", "st_low", "st_high").collect(), key=lambda r: (-r.st, r.parameter))[:top]
        names, widest = {r.parameter for r in rows}, max((r.st_high - r.st_low) / 2 for r in rows)
        met = widest <= target and names == before
        steps.append((n, widest, met))
        if met or n >= most:
            return steps
        before, n = names, 2 * n


def required_samples(steps: DataFrame, target: float) -> DataFrame:
    """needed and slope: the samples at which the half width (columns samples and width) falls to the target, by a line through the logs;
    null with fewer than two points or where it doesn't fall."""
    x, y = F.log("samples"), F.log("width")
    fit = steps.where("width > 0").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))
    needed = F.ceil(F.exp((F.log(F.lit(target)) - F.col("intercept")) / F.col("slope")))
    falls = (F.col("n") >= 2) & (F.col("slope") < 0)
    return fit.select(F.when(falls, needed).alias("needed"), F.when(falls, F.col("slope")).alias("slope"))


def by_sample(outputs: DataFrame, matrices: int, row: str = "row", y: str = "y") -> DataFrame:
    """sample and its ``y`` under all matrices of a ``designs.Saltelli``, in order, from one row for each row of the design."""
    one = outputs.select(F.floor(F.col(row) / matrices).alias("sample"), F.struct(row, y).alias("_r"))
    return one.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r[y]).alias("y"))


def _features(y: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """What the indices are means of, for each sample: (samples, 5 + 2 k + pairs)."""
    k = y.shape[1] // 2 - 1
    a, b, ab, ba = y[:, 0], y[:, 1], y[:, 2 : 2 + k], y[:, 2 + k :]
    columns = [np.ones(len(y)), a, b, a * a + b * b, a * b, *(b[:, None] * (ab - a[:, None])).T, *((a[:, None] - ab) ** 2).T]
    return np.column_stack(columns + [ba[:, i] * ab[:, j] for i, j in pairs])


def _estimates(sums: np.ndarray, k: int, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First order (Saltelli 2010), total (Jansen 1999) and pair indices (Saltelli 2002) from sums, (..., 5 + 2 k + pairs); 0 where nothing varies."""
    n = sums[..., 0]
    variance = (sums[..., 3] - (sums[..., 1] + sums[..., 2]) ** 2 / (2 * n)) / (2 * n - 1)
    flat = variance <= 0
    scale = (n * np.where(flat, 1.0, variance))[..., None]
    first = np.where(flat[..., None], 0.0, sums[..., 5 : 5 + k] / scale)
    total = np.where(flat[..., None], 0.0, sums[..., 5 + k : 5 + 2 * k] / scale / 2)
    both = np.where(flat[..., None], 0.0, (sums[..., 5 + 2 * k :] - sums[..., 4, None]) / scale)
    if pairs:
        i, j = np.array(pairs).T
        both = np.where(flat[..., None], 0.0, both - first[..., i] - first[..., j])
    return first, total, both


def all_pairs(parameters: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(parameters) for j in range(i + 1, parameters)]


def indices_with_pairs(samples: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(name, s1, st, share) and (first, second, s2) from ``by_sample`` rows.

    Each task adds up what the indices are means of, all pairs among them as k (k - 1) / 2 sums; those of the tasks are added, and
    are all that the driver gets: their number depends on the parameters alone.  ``share`` is the part of a total index that the first order leaves to interactions.
    """
    k = len(names)
    pairs = all_pairs(k)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(5 + 2 * k + len(pairs))
        for batch in batches:
            if batch.num_rows:
                total += _features(batch.column("y").flatten().to_numpy().reshape(batch.num_rows, -1), pairs).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "part"])

    parts = samples.select("y").mapInArrow(add, "at long, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()
    sums = np.zeros(5 + 2 * k + len(pairs))
    for r in parts:
        sums[r.at] = r.part
    first, total, both = _estimates(sums, k, pairs) if sums[0] else (np.zeros(k), np.zeros(k), np.zeros(len(pairs)))
    spark = samples.sparkSession
    singles = [(n, float(s), float(t), float((t - s) / t) if t > 0 else 0.0) for n, s, t in zip(names, first, total, strict=True)]
    doubles = [(names[i], names[j], float(v)) for (i, j), v in zip(pairs, both, strict=True)]
    return spark.createDataFrame(singles, "name string, s1 double, st double, share double"), spark.createDataFrame(doubles, "first string, second string, s2 double")


def pairs_involving(pairs: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """The pairs of one parameter, the strongest first."""
    return pairs.where((F.col("first") == name) | (F.col("second") == name)).orderBy(F.desc(F.abs("s2")), "first", "second").limit(limit)


def supported(interval_low: Column, interval_high: Column) -> Column:
    """Whether data support an index: its interval excludes zero; null without an interval."""
    return (interval_low > 0) | (interval_high < 0)


def resampled_indices(
    samples: DataFrame, names: list[str], total: int, pairs: list[tuple[int, int]] | None = None, resamples: int = 1000, confidence: float = 0.95, seed: int = 5, slice_rows: int = 256
) -> DataFrame:
    """kind (s1, st or s2), name, other, low and high: percentile intervals over ``resamples`` resamples of the ``total`` samples, exactly
    ``total`` draws in each.

    How often a row is drawn follows from its number (``designs.drawn_counts``), so one pass gives all resamples: a task holds
    (resamples, 5 + 2 k + pairs) sums, and these are what is shuffled.
    """
    k, pairs = len(names), pairs or []
    slices = -(-total // slice_rows)
    width = 5 + 2 * k + len(pairs)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((resamples, width))
        held: list[np.ndarray] = []
        now = None

        def add() -> None:
            y = np.array(held)
            counts = drawn_counts(now * slice_rows, len(y), slices, slice_rows, total, resamples, seed)
            np.add(sums, counts @ _features(y, pairs), out=sums)
            held.clear()

        for batch in batches:
            for sample, y in zip(batch.column("sample").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if held and sample // slice_rows != now:
                    add()
                now = sample // slice_rows
                held.append(np.array(y))
        if held:
            add()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(list(sums), pa.list_(pa.float64()))], names=["resample", "sums"])

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = [("s1", n, None) for n in names] + [("st", n, None) for n in names] + [("s2", names[i], names[j]) for i, j in pairs]
        for batch in batches:
            for sums in batch.column("sums").to_pylist():
                values = np.concatenate(_estimates(np.array(sums), k, pairs))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in zip(*labels, strict=True)), pa.array(values)], names=["kind", "name", "other", "value"])

    placed = samples.repartition(F.floor(F.col("sample") / slice_rows)).sortWithinPartitions("sample").select("sample", "y")
    parts = placed.mapInArrow(draw, "resample long, sums array<double>").select("resample", F.posexplode("sums").alias("at", "part"))
    added = parts.groupBy("resample", "at").agg(F.sum("part").alias("part"))
    whole = added.groupBy("resample").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda s: s["part"]).alias("sums"))
    values = whole.select("sums").mapInArrow(estimate, "kind string, name string, other string, value double")
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    return values.groupBy("kind", "name", "other").agg(F.percentile("value", low).alias("low"), F.percentile("value", high).alias("high"))


def design_rows(spark: SparkSession, design: Saltelli, span: int = 4096) -> DataFrame:
    """sample, matrix and x of all rows of a design, made by the tasks that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("id").to_pylist():
                x = design.vectors(at * span, min(span, design.rows - at * span))
                sample, matrix = np.divmod(np.arange(at * span, at * span + len(x)), design.matrices)
                yield pa.RecordBatch.from_arrays([pa.array(sample), pa.array(matrix), pa.array(list(x), pa.list_(pa.float64()))], names=["sample", "matrix", "x"])

    return spark.range(-(-design.rows // span)).mapInArrow(run, "sample long, matrix long, x array<double>")


def screening(outputs: DataFrame, design: Morris, names: list[str], row: str = "row", y: str = "y") -> DataFrame:
    """name, mu, mu_star, sigma (population) and flags of the elementary effects, from one row for each row of a ``Morris`` design.

    ``interaction``: the effects vary by more than their size, so they interact or bend; ``no_effect``: all are 0; ``distinguishable``: beyond two standard errors.
    Each trajectory is one row of the only shuffle.
    """
    paths = by_sample(outputs, len(design.varied) + 1, row, y)

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told: list[tuple[str, float]] = []
            for t, values in zip(batch.column("sample").to_pylist(), batch.column("y").to_pylist(), strict=True):
                _, sign, order = design.path(t)
                told.extend((names[k], (b - a) / (design.step * sign[k])) for k, a, b in zip(order, values[:-1], values[1:], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in told], pa.string()), pa.array([e for _, e in told], pa.float64())], names=["name", "effect"])

    each = paths.mapInArrow(effects, "name string, effect double").groupBy("name").agg(
        F.avg("effect").alias("mu"), F.avg(F.abs("effect")).alias("mu_star"), F.stddev_pop("effect").alias("sigma"), F.count("*").alias("n")
    )
    error = F.when(F.col("n") > 1, F.col("sigma") / F.sqrt("n")).otherwise(0.0)
    flags = {"interaction": (F.col("sigma") > F.col("mu_star")) & (F.col("mu_star") > 0), "no_effect": F.col("mu_star") == 0, "distinguishable": F.col("mu_star") > 2 * error}
    return each.select("name", "mu", "mu_star", "sigma", *[test.alias(name) for name, test in flags.items()])
