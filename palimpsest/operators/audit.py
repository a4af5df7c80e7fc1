"""Audits of record stores and counters of guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inventory(rows: DataFrame, kind: str, size: Column, order: str) -> DataFrame:
    """Count, bytes, first and last of each kind, and of all (kind ``total``)."""
    out = rows.withColumn("_size", size).rollup(kind).agg(
        F.grouping(kind).alias("_g"), F.count("*").alias("records"), F.sum("_size").alias("bytes"), F.min(order).alias("first"), F.max(order).alias("last")
    )
    return out.withColumn(kind, F.when(F.col("_g") == 1, "total").otherwise(F.coalesce(F.col(kind), F.lit("none")))).drop("_g")


def missing_fields(rows: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """Rows without a field, by kind and field."""
    flags = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f).isNull() | (F.col(f).cast("string") == "")).alias("missing")) for f in fields])
    return rows.select(kind, F.explode(flags).alias("x")).where("x.missing").groupBy(kind, F.col("x.field").alias("field")).agg(F.count("*").alias("n"))


def duplicate_groups(rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Groups of equal keys: their first id and surplus copies."""
    return rows.groupBy(*keys).agg(F.min(id_).alias("first_id"), (F.count("*") - 1).alias("surplus")).where("surplus > 0")


def junk_rates(rows: DataFrame, kind: str, tests: dict[str, Column]) -> DataFrame:
    counts = [F.sum(test.cast("int")).alias(name) for name, test in tests.items()]
    any_ = reduce(lambda a, b: a | b, tests.values())
    return rows.groupBy(kind).agg(F.count("*").alias("n"), *counts, F.round(F.avg(any_.cast("double")), 9).alias("junk_rate"))


def verdict(junk: Column, duplicates: Column) -> Column:
    return F.when((junk > 0.2) | (duplicates > 0.2), "RED").when((junk > 0.05) | (duplicates > 0.05), "YELLOW").otherwise("GREEN")


def daily_growth(rows: DataFrame, ts: str, size: Column, project_days: int = 30) -> DataFrame:
    """Bytes and records of each day, bytes so far, and the projection at the mean growth so far."""
    days = rows.groupBy(F.to_date(ts).alias("day")).agg(F.sum(size).alias("bytes"), F.count("*").alias("records"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row for each day
    days = days.withColumn("total", F.sum("bytes").over(w)).withColumn("_n", F.datediff("day", F.min("day").over(w)) + 1)
    return days.withColumn("projected", F.round(F.col("total") + F.col("total") / F.col("_n") * project_days, 6)).drop("_n")


def guard_counters(rows: DataFrame, sites: dict[str, Column], order: str) -> DataFrame:
    """For each site (a predicate): evaluations, firings, first and last seen.  All sites in one pass."""
    flags = F.array(*[F.struct(F.lit(name).alias("site"), F.coalesce(test, F.lit(False)).alias("fired")) for name, test in sites.items()])
    each = rows.select(order, F.explode(flags).alias("x"))
    return each.groupBy(F.col("x.site").alias("site")).agg(
        F.count("*").alias("evaluations"), F.sum(F.col("x.fired").cast("long")).alias("firings"), F.min(order).alias("first_seen"), F.max(order).alias("last_seen")
    )


def branch_counters(rows: DataFrame, branches: dict[str, Column], reached: list[str], order: str, predicates: dict[str, Column] | None = None) -> DataFrame:
    """site, kind, parent, evaluations, firings, first_seen, last_seen and denominator, of predicates, branches and reached sites in one pass.

    A branch site's parent has the evaluations; each arm that was taken (``site=arm``) has its firings, and its parent's evaluations as
    its denominator.  Others are their own.  A null arm or predicate isn't evaluated.
    """
    # a generator's output is computed once a row, and each arm is asked for twice
    tests = {f"p{k}": test for k, test in enumerate((predicates or {}).values())} | {f"b{k}": arm for k, arm in enumerate(branches.values())}
    if tests:
        rows = rows.select(order, F.explode(F.array(F.struct(*[test.alias(name) for name, test in tests.items()]))).alias("_t"))
    predicates = {name: F.col(f"_t.p{k}") for k, name in enumerate(predicates or {})}
    branches = {name: F.col(f"_t.b{k}") for k, name in enumerate(branches)}
    cell = lambda site, kind, parent, n, fired: F.struct(site.alias("site"), F.lit(kind).alias("kind"), parent.alias("parent"), F.lit(n).alias("n"), fired.alias("fired"))
    none = F.lit(None).cast("string")
    cells = [F.when(test.isNotNull(), cell(F.lit(name), "predicate", none, 1, test.cast("long"))) for name, test in predicates.items()]
    for name, arm in branches.items():
        cells.append(F.when(arm.isNotNull(), cell(F.lit(name), "parent", none, 1, F.lit(0).cast("long"))))
        cells.append(F.when(arm.isNotNull(), cell(F.concat(F.lit(f"{name}="), arm), "branch", F.lit(name), 0, F.lit(1).cast("long"))))
    cells += [cell(F.lit(name), "reached", none, 1, F.lit(1).cast("long")) for name in reached]
    each = rows.select(order, F.explode(F.array_compact(F.array(*cells))).alias("x")).select(order, "x.*")
    counts = each.groupBy("site").agg(
        F.first("kind").alias("kind"), F.first("parent").alias("parent"), F.sum("n").cast("long").alias("evaluations"), F.sum("fired").alias("firings"),
        F.min(order).alias("first_seen"), F.max(order).alias("last_seen"),
    )
    parents = counts.where("kind = 'parent'").select(F.col("site").alias("parent"), F.col("evaluations").alias("_all"))
    return counts.join(parents, "parent", "left").select(*counts.columns, F.coalesce("_all", "evaluations").alias("denominator"))


def site_states(counters: DataFrame, declared: DataFrame) -> DataFrame:
    """dead, unreached, always or live for every declared site."""
    rows = declared.join(counters, "site", "left")
    n, fired = F.coalesce("evaluations", F.lit(0)), F.coalesce("firings", F.lit(0))
    state = F.when(n == 0, "unreached").when(fired == 0, "dead").when(fired == n, "always").otherwise("live")
    return rows.select("site", n.alias("evaluations"), fired.alias("firings"), state.alias("state"))


def grouped_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each of the columns alone, in one pass of grouping sets."""
    sets = [[F.col(c)] for c in columns]
    out = rows.groupingSets(sets, *columns).agg(F.grouping_id(*columns).alias("_g"), F.count("*").alias("n"))
    n = len(columns)
    full = (1 << n) - 1
    value = F.coalesce(*[F.when(F.col("_g") == (full ^ (1 << (n - 1 - k))), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for k, c in enumerate(columns)])
    name = F.coalesce(*[F.when(F.col("_g") == (full ^ (1 << (n - 1 - k))), F.lit(c)) for k, c in enumerate(columns)])
    return out.select(name.alias("column"), value.alias("value"), "n")
