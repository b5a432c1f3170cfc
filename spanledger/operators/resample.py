"""Bootstrap intervals and paired comparisons.

A replicate mean depends only on how often each distinct value is drawn, so the record table is
read once to count outcomes; everything after that works on a few rows per comparison.

There is one method for every size.  Replicate b draws unit ``position(b, k)`` for k = 0 .. n - 1, in
integer arithmetic that any SQL engine reproduces.  The draws of a replicate are cut into pieces of
``piece`` positions, so a row of work is small and the number of rows, not their size, grows with n;
the sums of the pieces are the same however they are cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger import constants as K
from spanledger.functions.formats import p_value_display
from spanledger.session import materialize

MODULUS = 2147483647  # fixed value: draws are taken modulo this prime
PIECE = 250_000
REPLICATES_PER_ROW = 50
RANK_BLOCK = 1 << 16
COMPARISON = ["scope", "metric", "arm_a", "arm_b"]


def draw_indexes(replicate: int, n: int, seed: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The indexes in [0, n) that one replicate draws at positions ``first`` to ``last`` (all n by default)."""
    k = np.arange(first, n if last is None else min(last, n), dtype=np.int64)
    x = (replicate * 1000003 + k * 7919 + seed * 104729) % MODULUS
    x = (x * x + 48271 * x + 12345) % MODULUS
    return (x * MODULUS + (x * x + 69621 * x + 54321) % MODULUS) % n


def indicator(metric: str) -> Column:
    """Boolean per-case indicator under a compared metric (for evaluable records)."""
    span, sem = F.col("evidence_span_found"), F.col("evidence_semantically_supports_prediction")
    correct = F.coalesce(F.col("correct"), F.lit(False))
    yes = {
        "accuracy": correct,
        "abstention_rate": F.col("abstained"),
        "coverage": ~F.col("abstained"),
        "span_unsupported_rate_over_evaluable": ~span,
        "semantic_unsupported_rate_over_evaluable": F.coalesce(~span, F.lit(False)) | F.coalesce(~sem, F.lit(False)),
        "semantic_supported_accuracy_over_evaluable": correct & span & sem,
    }[metric]
    return F.coalesce(yes, F.lit(False))


# ------------------------------------------------------------------ outcomes of pairs
def paired_outcomes(records: DataFrame, pairs: Iterable[tuple[str, str]] = K.COMPARISON_PAIRS) -> DataFrame:
    """Joint outcome counts (target, arm_a, arm_b, code_a, code_b, n) of units that both arms have.

    Each record is reduced to a bit code of its indicators; one grouping by (case, target) places
    the arms side by side without a self-join, for any number of arms.
    """
    return paired_sides(records, pairs).groupBy("target", "arm_a", "arm_b", "code_a", "code_b").agg(F.count(F.lit(1)).alias("n"))


def paired_sides(records: DataFrame, pairs: Iterable[tuple[str, str]], carried: Iterable[str] = ()) -> DataFrame:
    """(carried, target, arm_a, arm_b, code_a, code_b) of every unit that both arms of a pair have."""
    pairs, carried = list(pairs), list(carried)
    arms = sorted({a for p in pairs for a in p})
    unit = list(dict.fromkeys(["case_id", *carried, "target"]))
    code = sum((indicator(m).cast("int") * (1 << i) for i, m in enumerate(K.COMPARISON_METRICS)), F.lit(0))
    sides = (
        records.filter(F.col("ground_truth").isNotNull() & F.col("arm").isin(*arms))
        .select(*unit, "arm", code.alias("code"))
        .groupBy(*unit)
        .agg(*(F.max(F.when(F.col("arm") == a, F.col("code"))).alias(f"code_{i}") for i, a in enumerate(arms)))
    )
    options = F.explode(F.array(*(
        F.struct(
            F.lit(a).alias("arm_a"), F.lit(b).alias("arm_b"),
            F.col(f"code_{arms.index(a)}").alias("code_a"), F.col(f"code_{arms.index(b)}").alias("code_b"),
        ) for a, b in pairs
    ))).alias("p")
    return sides.select(*carried, "target", options).select(*carried, "target", "p.*").filter(
        "code_a is not null and code_b is not null")


def paired_counts(outcomes: DataFrame) -> DataFrame:
    """Per scope, metric and pair: units, and how many differ by +1 and by -1."""
    scopes = F.explode(F.array(F.lit("overall"), F.col("target"))).alias("scope")
    metrics = F.explode(F.array(*(
        F.struct(
            F.lit(m).alias("metric"),
            (F.shiftright("code_a", i).bitwiseAND(1) - F.shiftright("code_b", i).bitwiseAND(1)).alias("d"),
        ) for i, m in enumerate(K.COMPARISON_METRICS)
    ))).alias("m")
    return (
        outcomes.select("*", scopes).select("scope", "arm_a", "arm_b", "n", metrics)
        .groupBy("scope", F.col("m.metric").alias("metric"), "arm_a", "arm_b")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("m.d") > 0, F.col("n")).otherwise(0)).alias("n_pos"),
            F.sum(F.when(F.col("m.d") < 0, F.col("n")).otherwise(0)).alias("n_neg"),
        )
    )


def cluster_counts(records: DataFrame, cluster: str = "case_id",
                   pairs: Iterable[tuple[str, str]] = K.COMPARISON_PAIRS) -> DataFrame:
    """Per scope, metric and pair: how many clusters have ``size`` units and a sum of differences ``total``.

    The units of a case are its targets.  They are not independent, so resampling draws cases and
    carries all of their units along.
    """
    sides = paired_sides(records, pairs, [cluster]).withColumn("scope", F.explode(F.array(F.lit("overall"), F.col("target"))))
    keys = ["scope", "arm_a", "arm_b"]
    per_cluster = sides.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("size"), F.array(*(
        F.struct(F.lit(m).alias("metric"), F.sum(
            F.shiftright("code_a", i).bitwiseAND(1) - F.shiftright("code_b", i).bitwiseAND(1)).alias("total"))
        for i, m in enumerate(K.COMPARISON_METRICS))).alias("metrics"))
    return per_cluster.select(*keys, "size", F.explode("metrics").alias("m")).groupBy(
        *keys, F.col("m.metric").alias("metric"), "size", F.col("m.total").alias("total")).agg(F.count(F.lit(1)).alias("n_clusters"))


# ------------------------------------------------------------------ replicates
def _work(rows: DataFrame, n: Column, n_boot: int, piece: int) -> DataFrame:
    """One row for each block of replicates and piece of draws (columns block, at), spread over all cores."""
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = F.sequence(F.lit(0), F.lit((n_boot - 1) // REPLICATES_PER_ROW))
    cut = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(piece).cast("long"))))
    return cut.withColumn("block", F.explode(blocks)).repartition(tasks, "n", "block", "at").sortWithinPartitions("n", "block", "at")


def _replicates(block: int, n_boot: int) -> np.ndarray:
    first = int(block) * REPLICATES_PER_ROW
    return np.arange(first, min(first + REPLICATES_PER_ROW, n_boot), dtype=np.int64)


def _same_draws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that share their draws, together as far as a batch holds them."""
    for batch in batches:
        for _, rows in batch.groupby(["n", "block", "at"], sort=False):
            yield rows


def replicate_means(counts: DataFrame, keys: list[str], *, seed: int, n_boot: int, piece: int = PIECE) -> DataFrame:
    """(keys, n, observed, replicate, mean) of the difference with values -1, 0 and +1.

    Positions run from +1 over 0 to -1.  Comparisons over the same number of units draw the same
    indexes; those that meet in a batch share the work.
    """
    label = F.concat_ws("\u0001", *keys)
    rows = counts.filter(F.col("n") > 0).select(label.alias("label"), "n", "n_pos", "n_neg")

    def run(batches):
        for rows in _same_draws(batches):
            n, block, at = (int(rows[c].iloc[0]) for c in ("n", "block", "at"))
            pos, neg = rows["n_pos"].to_numpy(), n - rows["n_neg"].to_numpy()
            replicates = _replicates(block, n_boot)
            totals = np.empty((len(replicates), len(rows)), dtype=np.int64)
            for i, b in enumerate(replicates):
                drawn = np.sort(draw_indexes(int(b), n, seed, at, at + piece))
                totals[i] = np.searchsorted(drawn, pos) - (len(drawn) - np.searchsorted(drawn, neg))
            yield pd.DataFrame({"label": np.tile(rows["label"].to_numpy(), len(replicates)),
                                "replicate": np.repeat(replicates, len(rows)), "total": totals.ravel()})

    totals = (
        _work(rows, F.col("n"), n_boot, piece).mapInPandas(run, "label string, replicate long, total long")
        .groupBy("label", "replicate").agg(F.sum("total").alias("total"))
    )
    head = counts.select(*keys, label.alias("label"), "n",
                         ((F.col("n_pos") - F.col("n_neg")) / F.col("n")).alias("observed"))
    return head.join(totals, "label").select(
        *keys, "n", "observed", "replicate", (F.col("total") / F.col("n")).alias("mean")
    )


def cluster_means(counts: DataFrame, keys: list[str], *, seed: int, n_boot: int, piece: int = PIECE) -> DataFrame:
    """(keys, n, n_clusters, observed, replicate, mean) when whole clusters are drawn, from ``cluster_counts``.

    Clusters stand in order of falling total, then of rising size, so clusters of one unit draw as single units do.  A
    replicate's mean is the sum of its totals over the sum of its sizes.
    """
    label = F.concat_ws("\u0001", *keys)
    kinds = counts.groupBy(*keys).agg(
        F.sum("n_clusters").alias("n_clusters"), F.sum(F.col("n_clusters") * F.col("size")).alias("n"),
        F.sum(F.col("n_clusters") * F.col("total")).alias("sum"),
        F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("minus"), "size", "n_clusters"))).alias("kinds"))
    rows = kinds.select(label.alias("label"), F.col("n_clusters").alias("n"), F.col("kinds.minus").alias("minus"),
                        F.col("kinds.size").alias("sizes"), F.col("kinds.n_clusters").alias("times"))

    def run(batches):
        for rows in _same_draws(batches):
            n, block, at = (int(rows[c].iloc[0]) for c in ("n", "block", "at"))
            replicates, out = _replicates(block, n_boot), []
            kinds = [(np.concatenate([[0], np.cumsum(r.times)]), np.stack([-np.asarray(r.minus), np.asarray(r.sizes)]), r.label)
                     for r in rows.itertuples(index=False)]
            for b in replicates:
                drawn = np.sort(draw_indexes(int(b), n, seed, at, at + piece))
                out += [(name, b, *(numbers @ np.diff(np.searchsorted(drawn, bound))).tolist()) for bound, numbers, name in kinds]
            yield pd.DataFrame(out, columns=["label", "replicate", "total", "size"])

    sums = (
        _work(rows, F.col("n"), n_boot, piece).mapInPandas(run, "label string, replicate long, total long, size long")
        .groupBy("label", "replicate").agg(F.sum("total").alias("total"), F.sum("size").alias("size"))
    )
    head = kinds.select(*keys, label.alias("label"), "n", "n_clusters", (F.col("sum") / F.col("n")).alias("observed"))
    return head.join(sums, "label").select(
        *keys, "n", "n_clusters", "observed", "replicate", (F.col("total") / F.col("size")).alias("mean"))


def _position(p: float, n_boot: int) -> int:
    return int(p * (n_boot - 1)) + 1


def _summary_frame(means: DataFrame, keys: list[str]) -> DataFrame:
    """One row per comparison with its sorted replicate means (n_boot values)."""
    d, obs = F.col("mean"), F.col("observed")
    return means.groupBy(*keys).agg(
        F.first("n").alias("n_paired_cases"), F.first("observed").alias("diff"),
        F.sort_array(F.collect_list("mean")).alias("means"),
        F.percentile("mean", [0.025, 0.975]).alias("linear"),
        F.count_if(((obs > 0) & (d <= 0)) | ((obs < 0) & (d >= 0)) | (obs == 0)).alias("n_opposite"),
        F.least(F.count_if(d <= 0), F.count_if(d >= 0)).alias("n_cross"),
    )


def compare_pairs(
    counts: DataFrame, keys: list[str] | None = None, *, seed: int = 42, n_boot: int = 2000,
    ci: float = 0.95, piece: int = PIECE,
) -> DataFrame:
    """Paired bootstrap: difference, interval by index, two-sided p from the opposite sign."""
    keys = keys or COMPARISON
    return _compared(replicate_means(counts, keys, seed=seed, n_boot=n_boot, piece=piece), keys, seed, n_boot, ci)


def compare_clusters(
    counts: DataFrame, keys: list[str] | None = None, *, seed: int = 42, n_boot: int = 2000,
    ci: float = 0.95, piece: int = PIECE,
) -> DataFrame:
    """As :func:`compare_pairs` from ``cluster_counts``: whole clusters are drawn."""
    keys = keys or COMPARISON
    return _compared(cluster_means(counts, keys, seed=seed, n_boot=n_boot, piece=piece), keys, seed, n_boot, ci)


def _compared(means: DataFrame, keys: list[str], seed: int, n_boot: int, ci: float) -> DataFrame:
    low = (1 - ci) / 2
    table = _summary_frame(means, keys)
    return table.select(
        *keys, "diff",
        F.element_at("means", _position(low, n_boot)).alias("ci_low"),
        F.element_at("means", _position(1 - low, n_boot)).alias("ci_high"),
        F.least(F.lit(1.0), 2 * F.col("n_opposite") / F.lit(n_boot)).alias("p_value"),
        F.lit(n_boot).alias("n_boot"), F.lit(seed).alias("seed"), "n_paired_cases",
    )


def comparison_grid(records: DataFrame, *, pairs=K.COMPARISON_PAIRS, cluster: str | None = None, **options) -> DataFrame:
    """Every scope, metric and arm pair in one job; a pair with a missing arm gives no rows.

    With ``cluster`` (a column, say case_id) the units of a cluster are drawn together.
    """
    if cluster:
        return compare_clusters(cluster_counts(records, cluster, pairs), **options)
    return compare_pairs(paired_counts(paired_outcomes(records, pairs)), **options)


def baseline_comparison(rows: DataFrame, baseline: str, *, seed: int = 42, n_boot: int = 5000,
                        piece: int = PIECE) -> DataFrame:
    """Accuracy of the baseline minus every other system per target, on their shared cases.

    Interpolated percentiles, p from the smaller tail, and a flag for intervals without zero.
    """
    correct = F.col("correct").cast("int")
    base = rows.filter(F.col("system") == baseline).select("case_id", "target", correct.alias("a"))
    other = rows.filter(F.col("system") != baseline).select("case_id", "target", "system", correct.alias("b"))
    counts = other.join(base, ["case_id", "target"]).groupBy("target", "system").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("a") > F.col("b")).alias("n_pos"),
        F.count_if(F.col("a") < F.col("b")).alias("n_neg"),
    )
    keys = ["target", "system"]
    table = _summary_frame(replicate_means(counts, keys, seed=seed, n_boot=n_boot, piece=piece), keys)
    low, high = F.col("linear")[0], F.col("linear")[1]
    p = F.least(F.lit(1.0), 2 * F.col("n_cross") / F.lit(n_boot))
    return table.select(
        *keys, "diff", low.alias("ci_low"), high.alias("ci_high"), p.alias("p_value"),
        p_value_display(p, F.lit(n_boot), at_most_one_draw=True).alias("p_display"),
        (~((low <= 0) & (high >= 0))).alias("significant"), "n_paired_cases",
    )


# ------------------------------------------------------------------ interval of one mean
def bootstrap_mean(
    df: DataFrame, by: list[str], value: str, *, seed: int = 42, n_boot: int = 2000, ci: float = 0.95,
    piece: int = PIECE, block: int = RANK_BLOCK,
) -> DataFrame:
    """Percentile interval of the mean of ``value`` per group (at least one column in ``by``).

    NULL and NaN are dropped; a group with fewer than two values gets its point as both bounds.  A group
    with more than ``block`` different values is cut into blocks of ranks; the draws are the same.
    """
    if not by:
        raise ValueError("name at least one column to group by")
    if block > RANK_BLOCK:
        raise ValueError(f"places in a block of ranks have two bytes: block can be {RANK_BLOCK} at most")
    usable = F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value)), F.col(value).cast("double"))
    counts = materialize(df.groupBy(*by, usable.alias("value")).agg(F.count(F.lit(1)).alias("times")), "value-counts")
    points = counts.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("times"))), F.lit(0)).alias("n"),
        F.try_divide(
            F.sum(F.col("value") * F.col("times")),
            F.sum(F.when(F.col("value").isNotNull(), F.col("times"))).cast("double"),
        ).alias("point_estimate"),
        F.count("value").alias("n_values"),
    )
    held = counts.filter("value is not null").join(points.filter("n > 1"), by)
    few = _means_of_few(held.filter(F.col("n_values") <= block), by, seed, n_boot, piece)
    many = _means_of_many(held.filter(F.col("n_values") > block), by, seed, n_boot, piece, block)
    means = few.unionByName(many).groupBy(*by, "replicate").agg((F.sum("part_sum") / F.first("n")).alias("mean"))
    low = (1 - ci) / 2
    summary = means.groupBy(*by).agg(F.sort_array(F.collect_list("mean")).alias("means"))
    return points.join(summary, by, "left").select(
        *by, "n", "point_estimate",
        F.coalesce(F.element_at("means", _position(low, n_boot)), "point_estimate").alias("ci_low"),
        F.coalesce(F.element_at("means", _position(1 - low, n_boot)), "point_estimate").alias("ci_high"),
        F.lit(n_boot).alias("n_boot"), F.lit(seed).alias("seed"),
    )


def _typed(df: DataFrame, by: list[str], more: str) -> str:
    return ", ".join([*(f"`{k}` {dict(df.dtypes)[k]}" for k in by), more])


def _means_of_few(held: DataFrame, by: list[str], seed: int, n_boot: int, piece: int) -> DataFrame:
    """Sums of the draws of groups whose different values fit one row: each piece counts its draws among the values' ranks."""
    ready = held.groupBy(*by).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("value", "times"))).alias("items"),
    ).select(*by, "n", F.col("items.value").alias("values"), F.col("items.times").alias("times"))

    def run(batches):
        for rows in _same_draws(batches):
            n, block, at = (int(rows[c].iloc[0]) for c in ("n", "block", "at"))
            replicates, out = _replicates(block, n_boot), []
            bounds = [np.concatenate([[0], np.cumsum(t)]) for t in rows["times"]]
            sums = np.empty((len(replicates), len(rows)))
            for i, b in enumerate(replicates):
                drawn = np.sort(draw_indexes(int(b), n, seed, at, at + piece))
                for j, (bound, values) in enumerate(zip(bounds, rows["values"], strict=True)):
                    sums[i, j] = np.diff(np.searchsorted(drawn, bound)) @ np.asarray(values, dtype=float)
            for i, b in enumerate(replicates):
                out.append(rows[by].assign(replicate=b, part_sum=sums[i], n=n))
            yield pd.concat(out)[[*by, "n", "replicate", "part_sum"]]

    schema = _typed(held, by, "n long, replicate long, part_sum double")
    return _work(ready, F.col("n"), n_boot, piece).mapInPandas(run, schema)


def rank_blocks(held: DataFrame, by: list[str], block: int) -> DataFrame:
    """(by, n, rank_block, starts, values): the sorted units of each group in blocks of ``block`` ranks.

    ``held`` has one row for each different value and how many ``times`` it occurs.  Values are dealt by ranges; the sizes of the
    ranges give each one the rank of its first unit, and a value that spans blocks has a row in each of them.  A
    block lists its values and where in the block each starts, so it has ``block`` entries at most.
    """
    spread = materialize(held.repartitionByRange(*by, "value").withColumn("range", F.spark_partition_id()), "values")
    sizes = spread.groupBy(*by, "range").agg(F.sum("times").alias("size"))
    ahead = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "range", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*by, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("times").over(inside), F.lit(0))
    ranked = spread.join(offsets, [*by, "range"]).withColumn("first", first)
    whole = F.lit(block).cast("long")
    cut = ranked.withColumn("rank_block", F.explode(F.sequence(
        F.floor(F.col("first") / whole), F.floor((F.col("first") + F.col("times") - 1) / whole))))
    start = F.greatest(F.col("first") - F.col("rank_block") * whole, F.lit(0))
    return cut.groupBy(*by, "rank_block").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(start.alias("start"), "value"))).alias("items"),
    ).select(*by, "n", "rank_block", F.col("items.start").alias("starts"), F.col("items.value").alias("values"))


def _means_of_many(held: DataFrame, by: list[str], seed: int, n_boot: int, piece: int, block: int) -> DataFrame:
    """Sums of the draws of groups with many different values: drawn ranks meet the blocks of values that hold them.

    A piece of draws sends each block one row: the places that its 50 replicates draw there, two bytes each, and how many
    each replicate draws.  All rows of a block and 50 replicates hold ``50 x block`` places on average, whatever the size of
    the group.  The planner takes the draws for as small as the list of groups and would broadcast them, so the join is named.
    """
    blocks = materialize(rank_blocks(held, by, block), "value-blocks")
    groups = blocks.filter("rank_block = 0").select(*by, "n")

    def draw(batches):
        for rows in _same_draws(batches):
            n, part, at = (int(rows[c].iloc[0]) for c in ("n", "block", "at"))
            draws = [np.sort(draw_indexes(int(b), n, seed, at, at + piece)) for b in _replicates(part, n_boot)]
            bounds = np.arange(-(-n // block) + 1, dtype=np.int64) * block
            edges = np.stack([np.searchsorted(d, bounds) for d in draws])
            sizes = np.diff(edges).T.astype("<u4", order="C")  # a row for each block, a column for each replicate
            ends = np.cumsum(sizes, dtype=np.int64).reshape(sizes.shape)
            places = np.empty(sum(map(len, draws)), dtype="<u2")
            for i, d in enumerate(draws):
                shift = ends[:, i] - sizes[:, i] - edges[i, :-1]
                places[np.arange(len(d)) + np.repeat(shift, sizes[:, i])] = d % block
            met = np.flatnonzero(sizes.any(axis=1))
            first = np.concatenate([[0], ends[:, -1]])
            drawn = pd.DataFrame({
                "block": part, "rank_block": met, "sizes": [sizes[k].tobytes() for k in met],
                "places": [places[first[k]:first[k + 1]].tobytes() for k in met]})
            for _, row in rows[by].iterrows():
                yield drawn.assign(**row)[[*by, "block", "rank_block", "sizes", "places"]]

    drawn = _work(groups, F.col("n"), n_boot, piece).mapInPandas(
        draw, _typed(held, by, "block int, rank_block long, sizes binary, places binary"))
    met = drawn.repartition(*by, "rank_block").groupBy(*by, "rank_block", "block").agg(
        F.collect_list(F.struct("sizes", "places")).alias("draws")).join(blocks.hint("merge"), [*by, "rank_block"])

    def add(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                starts, values = np.asarray(row["starts"]), np.asarray(row["values"], dtype=float)
                replicates = _replicates(row["block"], n_boot)
                sums = np.zeros(len(replicates))
                for d in row["draws"]:
                    found = values[np.searchsorted(starts, np.frombuffer(d["places"], "<u2"), side="right") - 1]
                    sizes = np.frombuffer(d["sizes"], "<u4")
                    sums += np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=found, minlength=len(sizes))
                out = pd.DataFrame({"replicate": replicates, "part_sum": sums})
                yield out.assign(n=row["n"], **row[by])[[*by, "n", "replicate", "part_sum"]]

    return met.mapInPandas(add, _typed(held, by, "n long, replicate long, part_sum double"))


def arm_pair_table(grid: DataFrame) -> DataFrame:
    """Report form of the grid: display p, a mark for intervals without zero, fixed order.

    Every scope, metric and pair has a row; one that was not compared has NULL numbers.
    """
    def named(values: Iterable, name: str) -> Column:
        return F.explode(F.array(*(F.struct(F.lit(i).alias(f"{name}_order"), F.lit(v).alias(name))
                                   for i, v in enumerate(values)))).alias(name)

    pairs = F.explode(F.array(*(
        F.struct(F.lit(i).alias("pair_order"), F.lit(a).alias("arm_a"), F.lit(b).alias("arm_b"))
        for i, (a, b) in enumerate(K.COMPARISON_PAIRS)
    ))).alias("p")
    one = grid.sparkSession.range(1)
    wanted = (
        one.select(named(("overall", *K.TARGETS), "scope"))
        .select("scope.*", named(K.COMPARISON_METRICS, "metric"))
        .select("scope_order", "scope", "metric.*", pairs).select("scope_order", "scope", "metric_order", "metric", "p.*")
    )
    labels = F.create_map(*[F.lit(x) for kv in K.METRIC_LABELS.items() for x in kv])
    crosses = (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)
    return wanted.join(grid, COMPARISON, "left").select(
        "scope_order", "metric_order", "pair_order", *COMPARISON,
        labels[F.col("metric")].alias("label"), "diff", "ci_low", "ci_high",
        F.when(F.col("diff").isNotNull(), p_value_display(F.col("p_value"), F.col("n_boot"))).alias("p_display"),
        F.when(crosses, "").when(~crosses, "**").alias("marker"),
    )
