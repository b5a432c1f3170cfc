"""Deterministic samples in hash order.

The draw key of a row is the MD5 of the seed and the row's id: a uniform order that does not depend
on partitioning and that other engines reproduce.  A quota takes the first rows in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger import constants as K

BUCKET_DIGITS = 4


def draw_key(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in ids)))


def take_first(df: DataFrame, by: list[str], quota: Column | int, *, key: str) -> DataFrame:
    """The first ``quota`` rows of every group in order of ``key`` (a hex digest column).

    The key's first digits cut each group into buckets.  Their counts say in which bucket the quota
    falls; the keys of that bucket alone are ranked, which gives the group's last key, and one filter
    takes the rows up to it.  What the rows meet is one line per group, which is broadcast: dealing the rows by
    a handful of groups would put a whole group into one task.  The two narrow passes read only the key.  Keys come from ids that are unique; rows that share an id are taken together.
    """
    rows = df.withColumn("_quota", F.lit(quota) if isinstance(quota, int) else quota).filter("_quota > 0")
    narrow = rows.select(*by, "_quota", F.col(key).alias("_key"), F.substring(key, 1, BUCKET_DIGITS).alias("_bucket"))
    sizes = narrow.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"), F.max("_quota").alias("_take"))
    upto = F.sum("_size").over(Window.partitionBy(*by).orderBy("_bucket"))
    edge = sizes.withColumn("_before", upto - F.col("_size")).filter("_before < _take and _before + _size >= _take").select(
        *by, "_bucket", (F.col("_take") - F.col("_before")).alias("_left"))
    rank = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_key"))
    last = _join_groups(narrow.select(*by, "_bucket", "_key"), edge, [*by, "_bucket"], "inner").withColumn("_rank", rank)
    last = last.filter("_rank = _left").select(*by, F.col("_key").alias("_last"))
    kept = _join_groups(rows, last, by, "left")  # a group without a last key is taken whole
    return kept.filter(F.col("_last").isNull() | (F.col(key) <= F.col("_last"))).select(*df.columns)


def _join_groups(rows: DataFrame, groups: DataFrame, by: list[str], how: str) -> DataFrame:
    """Join with one row per group, on columns that may be NULL, or on none at all."""
    r, g = rows.withColumn("_one", F.lit(1)).alias("r"), groups.withColumn("_one", F.lit(1)).alias("g")
    same = F.col("r._one") == F.col("g._one")
    for c in by:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}"))
    return r.join(F.broadcast(g), same, how).select(
        *(f"r.{c}" for c in rows.columns), *(f"g.{c}" for c in groups.columns if c not in by))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add 1, 2, 3... in order of a hex digest column without sorting in one task."""
    rows = df.withColumn("_bucket", F.substring(key, 1, BUCKET_DIGITS))
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        "_bucket", (F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size")).alias("_before")
    )
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return rows.join(offsets, "_bucket").withColumn(name, (F.col("_before") + rank).cast("long")).drop(
        "_bucket", "_before"
    )


def allocation(sizes: DataFrame, strata: list[str], n: int) -> DataFrame:
    """Largest-remainder allocation of n rows over strata sizes (column ``size``).

    Integer arithmetic; equal remainders go to the larger stratum, then to the smaller key.
    A request for at least everything takes everything.
    """
    everything = Window.partitionBy()  # a handful of rows: one per availability pattern
    exact = sizes.withColumn("total", F.sum("size").over(everything)).withColumn(
        "share", F.col("size").cast("decimal(20,0)") * F.lit(n).cast("decimal(18,0)")
    )
    based = exact.withColumn("base", F.expr("share div total")).withColumn("rest", F.expr("share % total"))
    order = Window.orderBy(F.desc("rest"), F.desc("size"), *strata)
    spare = F.lit(n) - F.sum("base").over(everything)
    share = F.col("base") + F.when(F.row_number().over(order) <= spare, 1).otherwise(0)
    return based.withColumn("alloc", F.when(F.col("total") <= n, F.col("size")).otherwise(share)).select(
        *strata, "size", "alloc"
    )


def stratified_sample(
    df: DataFrame, n: int, seed: int, *, id_col: str = "case_id",
    gold_cols: tuple[str, ...] = ("gold_T", "gold_N", "gold_M"),
) -> DataFrame:
    """min(n, all) rows, proportional over the gold-availability patterns; adds ``sample_key``.

    Sorting by ``sample_key`` gives the shuffled output order.
    """
    pattern = F.concat(*(F.when(F.col(c).isNotNull(), "1").otherwise("0") for c in gold_cols))
    rows = df.withColumn("stratum", pattern).withColumn("sample_key", draw_key(seed, id_col))
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    quotas = allocation(sizes, ["stratum"], n).select("stratum", "alloc")
    return take_first(
        rows.join(F.broadcast(quotas), "stratum"), ["stratum"], F.col("alloc"), key="sample_key",
    ).drop("stratum", "alloc")


def sampling_summary(pool: DataFrame, sample: DataFrame, seed: int) -> DataFrame:
    """Size of the pool and of the sample, and gold counts of the sample."""
    golds = [F.col(f"gold_{t}").isNotNull() for t in K.TARGETS]
    total = pool.agg(F.count(F.lit(1)).alias("total_reports")).scalar()
    return sample.agg(
        F.count(F.lit(1)).alias("n_sampled"),
        *(F.count_if(g).alias(f"n_with_{t}") for t, g in zip(K.TARGETS, golds)),
        F.count_if(golds[0] & golds[1] & golds[2]).alias("n_with_all_TNM"),
    ).withColumn("total_reports", total).withColumn("seed", F.lit(seed))


def per_class_sample(df: DataFrame, class_col: str, n: int, seed: int, *, id_col: str = "case_id") -> DataFrame:
    """The same number of rows from every class: n // number of classes, or the whole class."""
    rows = df.filter(F.col(class_col).isNotNull()).withColumn("sample_key", draw_key(seed, id_col))
    classes = rows.agg(F.count_distinct(class_col).alias("k")).select(F.expr(f"{n} div k").alias("quota"))
    quoted = rows.withColumn("quota", classes.scalar())
    return take_first(quoted, [class_col], F.col("quota"), key="sample_key").drop("quota")


def cell_sample(df: DataFrame, cells: list[str], quotas, seed: int, *, ids: list[str]) -> DataFrame:
    """Rows per cell up to its quota; ``quotas`` lists (cell values..., rows)."""
    limits = F.create_map(*(F.lit(x) for q in quotas for x in ("\u0001".join(q[:-1]), q[-1])))
    rows = df.withColumn("sample_key", draw_key(seed, *ids)).withColumn(
        "quota", limits[F.concat_ws("\u0001", *cells)]
    )
    return take_first(rows.filter("quota > 0"), cells, F.col("quota"), key="sample_key").drop("quota")


def uniform_sample(df: DataFrame, n: int, seed: int, *, ids: list[str]) -> DataFrame:
    """min(n, all) rows, each row equally likely."""
    return take_first(df.withColumn("sample_key", draw_key(seed, *ids)), [], n, key="sample_key")
