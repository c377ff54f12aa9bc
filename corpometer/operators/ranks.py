"""Exact ranks and running sums over groups of any size.

A window function over one group runs in one task, which fails when a group holds a third of all
rows. The functions here cut every group into ranges first, of a hash or of the order itself: each
range is ranked or summed by itself, and a small table of range totals gives what comes before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpometer.functions.keys import order_key
from corpometer.operators.joins import attach, bounded, group_key
from corpometer.session import stored

HASH_DIGITS = 4  # 65,536 hash ranges per group
REPEATED = "rows of a group share their id, so no exact number of them can be chosen; name all columns that make the id"


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def id_columns(id_col: str | Sequence[str]) -> list[str]:
    """The columns that make a row's id: one, or several where tables with their own numbers are in one."""
    return [id_col] if isinstance(id_col, str) else list(id_col)


def _hash_ranges(df: DataFrame, by: Sequence[str], seed, id_cols: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {"__g": group_key(*by), "__h": order_key(seed, *id_cols)}
    ).withColumn("__r", F.substring("__h", 1, HASH_DIGITS))


def hash_rank(
    df: DataFrame,
    seed,
    id_col: str | Sequence[str] = "doc_id",
    by: Sequence[str] = (),
    name: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Add each row's place (from 1) within its group in the seed's hash order.

    With ``total``, also add the number of rows in the group. Rows that share all columns of the id
    take neighbouring places in any order.
    """
    ids = id_columns(id_col)
    keyed = _hash_ranges(df, by, seed, ids)
    counts = keyed.groupBy("__g", "__r").agg(F.count(F.lit(1)).alias("__n"))
    ranges = Window.partitionBy("__g")
    columns = [
        F.coalesce(F.sum("__n").over(_before(ranges.orderBy("__r"))), F.lit(0)).alias("__before")
    ]
    if total:
        columns.append(F.sum("__n").over(ranges).alias(total))
    offsets = counts.select("__g", "__r", *columns)
    inner = Window.partitionBy("__g", "__r").orderBy("__h", *ids)
    ranked = keyed.withColumn("__i", F.row_number().over(inner))
    placed = ranked.join(offsets, ["__g", "__r"]).withColumn(
        name, (F.col("__before") + F.col("__i")).cast("bigint")
    )
    return placed.drop("__g", "__r", "__h", "__i", "__before")


def first_by_hash(
    df: DataFrame,
    sizes: DataFrame,
    seed,
    id_col: str | Sequence[str] = "doc_id",
    by: Sequence[str] = (),
    flag: str | None = None,
) -> DataFrame:
    """Keep the first ``size`` rows of each group in the seed's hash order.

    ``sizes`` has the group columns and ``size``; a group it does not name keeps nothing. With
    ``flag`` all rows stay and a boolean column tells which ones were chosen. The rows themselves
    are not moved: the id columns alone give the hash at which each group is cut. ``id_col`` names
    all columns that tell a group's rows apart; a cut between rows that share them all is an error.
    """
    names = id_columns(id_col)
    keyed = _hash_ranges(df, by, seed, names)
    ids = keyed.select("__g", "__r", "__h", F.struct(*names).alias("__id"))
    wanted = sizes.select(group_key(*by).alias("__g"), F.col("size").alias("__size"))
    local = bounded(wanted)
    wanted = wanted if local is None else local
    counts = attach(ids.groupBy("__g", "__r").agg(F.count(F.lit(1)).alias("__n")), wanted, ["__g"])
    upto = Window.partitionBy("__g").orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        counts.withColumn("__upto", F.sum("__n").over(upto))
        .withColumn("__left", F.col("__size") - (F.col("__upto") - F.col("__n")))
        .where((F.col("__left") >= 1) & (F.col("__upto") >= F.col("__size")))
        .select("__g", "__r", "__left")
    )
    within = Window.partitionBy("__g", "__r").orderBy("__h", "__id")
    last = (
        attach(ids, edge, ["__g", "__r"], how="inner")
        .withColumns({"__i": F.row_number().over(within), "__next": F.lead("__id").over(within)})
        .where(F.col("__i") == F.col("__left"))
        .select("__g", F.col("__h").alias("__last_h"), F.col("__id").alias("__last_id"), (F.col("__next") == F.col("__id")).alias("__torn"))
    )
    cuts = wanted.join(last, "__g", "left")
    if not by:
        return _cut_at(keyed, cuts.first(), names, df.columns, flag)
    before = (F.col("__h") < F.col("__last_h")) | ((F.col("__h") == F.col("__last_h")) & (F.struct(*names) <= F.col("__last_id")))
    chosen = (F.col("__size") > 0) & (F.col("__last_h").isNull() | before)
    checked = F.when(F.col("__torn"), F.raise_error(F.lit(REPEATED)).cast("boolean")).otherwise(chosen)
    result = attach(keyed, cuts, ["__g"]).withColumn("__keep", F.coalesce(checked, F.lit(False)))
    if flag:
        return result.withColumn(flag, F.col("__keep")).select(*df.columns, flag)
    return result.where("__keep").select(*df.columns)


def _cut_at(keyed: DataFrame, cut, names: Sequence[str], columns: Sequence[str], flag: str | None) -> DataFrame:
    """Choose rows of a table that is one single group by comparing them with the cut row."""
    if cut is not None and cut["__torn"]:
        raise ValueError(REPEATED)
    if cut is None or cut["__size"] <= 0:
        keep = F.lit(False)
    elif cut["__last_h"] is None:
        keep = F.lit(True)
    else:
        kinds = {f.name: f.dataType for f in keyed.schema.fields}
        last = F.struct(*[F.lit(cut["__last_id"][n]).cast(kinds[n]).alias(n) for n in names])
        same = F.col("__h") == cut["__last_h"]
        keep = (F.col("__h") < cut["__last_h"]) | (same & (F.struct(*names) <= last))
    if flag:
        return keyed.withColumn(flag, keep).select(*columns, flag)
    return keyed.where(keep).select(*columns)


def running_sums(
    df: DataFrame,
    order_col: str,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    following: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add running sums up to and including each row, in the order of a column of any type with an order.

    Nulls come first. ``following`` also adds the next value of the order column in the group. Rows
    that share a value are taken in the order of ``ties``; group equal values first where there are
    many. Rows are dealt into ``ranges`` (one for each shuffle partition) of the order of group and
    value, at borders that Spark samples, so neither a large group nor an outlier fills one task. The
    dealt rows are written once, as their range is read twice.
    """
    names = list(sums)
    rows = df.withColumns({"__g": group_key(*by), **{f"__s_{n}": expr for n, expr in sums.items()}})
    order = [F.col(order_col).asc_nulls_first(), *[F.col(t).asc_nulls_first() for t in ties]]
    count = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(count, F.col("__g"), *order).withColumn("__p", F.spark_partition_id())
    rows = stored(dealt, "ranges")
    # A struct with the null flag ahead sorts nulls first, which a plain minimum would leave out.
    first = F.min(F.struct(F.col(order_col).isNotNull(), F.col(order_col).alias("value")))["value"]
    totals = rows.groupBy("__g", "__p").agg(*[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in names], first.alias("__first"))
    along = Window.partitionBy("__g").orderBy("__p")
    offsets = totals.select(
        "__g",
        "__p",
        *[F.coalesce(F.sum(f"__s_{n}").over(_before(along)), F.lit(0)).alias(f"__o_{n}") for n in names],
        F.lead("__first").over(along).alias("__o_next"),
    )
    inside = Window.partitionBy("__g", "__p").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    added = {f"__i_{n}": F.sum(f"__s_{n}").over(upto) for n in names}
    if following:
        added["__i_next"] = F.lead(F.struct(F.col(order_col).alias("value"))).over(inside)
    out = rows.withColumns(added).join(offsets, ["__g", "__p"])
    columns = [(F.col(f"__o_{n}") + F.col(f"__i_{n}")).alias(n) for n in names]
    if following:
        columns.append(F.when(F.col("__i_next").isNotNull(), F.col("__i_next")["value"]).otherwise(F.col("__o_next")).alias(following))
    return out.select(*df.columns, *columns)


def position(
    df: DataFrame,
    order_col: str,
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    name: str = "position",
) -> DataFrame:
    """Add each row's place (from 1) within its group in the order of a column, nulls first."""
    return running_sums(df, order_col, {name: F.lit(1).cast("bigint")}, by=by, ties=ties)
