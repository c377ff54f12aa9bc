"""Small helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from gc import collect as free_cycles

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BROADCAST_ROWS = 100_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other letter as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(name: str, taken: Iterable[str]) -> str:
    """``name``, behind as many underscores as it takes to differ from all ``taken`` names, case aside."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def bounded(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """``small`` as a local table of at most ``max_rows`` rows, or None; no more than one row above is read."""
    head = small.limit(max_rows + 1).toArrow()
    return None if head.num_rows > max_rows else small.sparkSession.createDataFrame(head, schema=small.schema)


def heaviest(rows: DataFrame, weight: str, most: int) -> pa.Table:
    """The rows of a stored table with the largest weights, at most ``most`` of them, on the driver.

    Rows of one weight stay together: the least weight taken is the one down to which all rows still
    fit. It is found from the number of rows of each weight, so no task sorts what it does not keep.
    """
    sizes = rows.groupBy(weight).agg(F.count(F.lit(1)).alias("__rows"))
    down = Window.orderBy(F.desc(weight)).rowsBetween(Window.unboundedPreceding, 0)
    fits = sizes.withColumn("__upto", F.sum("__rows").over(down)).where(F.col("__upto") <= most)
    least = fits.agg(F.min(weight)).scalar()
    return rows.where(F.col(weight) >= least).toArrow()


def let_go() -> None:
    """Free what an earlier task of the same worker holds in cycles, such as a model and the classes with it."""
    free_cycles()


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int
) -> DataFrame:
    """Texts of at most about ``max_rows`` labelled rows outside the held-out fold, as (text, label).

    Both classes are kept in proportion. Which rows are taken follows a hash of the id, so it is the
    same on every run. Rows with a null id or label, and ids that carry both labels, are left out.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold_of(F.col("doc_id"), folds) != held_out))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
        .where("label = other")
        .drop("other")
    )
    total = known.count()
    if total > max_rows:
        share = int(max_rows / total * 2**31)
        known = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(2**31)) < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    # The sample is at most a little over max_rows rows of twelve bytes.
    return texts.join(F.broadcast(known), "doc_id").select("text", "label")


def with_columns_from(
    df: DataFrame, text: str, added: str, score: Callable[[list[str | None]], list[pa.Array]], chars: int = 2_000_000
) -> DataFrame:
    """``df`` and new columns worked out from whole texts, a bounded number of characters at a time.

    ``added`` is the schema of the new columns; they replace columns of the same name. Rows stay in
    their partition; an empty partition gives none.
    """
    new = T.StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name.lower() not in {n.name.lower() for n in new.fields}]
    schema = T.StructType(kept + new.fields)
    passed = [f.name for f in kept]
    given = unused("__text", passed)
    types = [to_arrow(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(given))
            for low, high in pieces(texts, chars):
                values = score(texts.slice(low, high - low).to_pylist())
                columns = [batch.column(batch.schema.get_field_index(n)).slice(low, high - low) for n in passed]
                columns += [v.cast(t) if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return df.select(*[F.col(f"`{n}`") for n in passed], F.col(text).alias(given)).mapInArrow(run, schema)


def kept_by(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], added: Iterable[str], condition: str) -> DataFrame:
    """The rows of ``docs`` for which ``condition`` holds on the columns that ``judge`` adds, with the columns they had.

    Columns of the docs that have one of the ``added`` names wait under another name meanwhile.
    """
    away: dict[str, str] = {}
    for name in docs.columns:
        if name.lower() in {a.lower() for a in added}:
            away[name] = unused(f"own_{name}", [*docs.columns, *away.values()])
    kept = judge(docs.withColumnsRenamed(away)).where(condition)
    return kept.select(*[F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns])


def pieces(texts: pa.Array, chars: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``chars`` bytes at most; a longer text is a range of its own."""
    low = held = 0
    for i, value in enumerate(texts):
        size = value.as_buffer().size if value.is_valid else 0
        if i > low and held + size > chars:
            yield low, i
            low, held = i, 0
        held += size
    if len(texts) > low:
        yield low, len(texts)


def to_arrow(kind: T.DataType) -> pa.DataType:
    simple = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, to_arrow(f.dataType)) for f in kind.fields])
    return simple[kind.simpleString()]
