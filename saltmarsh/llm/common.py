"""What the operators of this subpackage share: tables and the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from ..shared import forget_path, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the tables that saved() has made and nothing has deleted yet, in order.
_made: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder; cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by saved(), once nothing reads it any more."""
    shared.forget(df)


def mark() -> int:
    """A point in time for sweep()."""
    return len(_made)


def sweep(spark: SparkSession, since: int, *keep: str) -> None:
    """Deletes the tables that saved() has made since a mark(), but for those of the names in ``keep``, which a result still reads."""
    own, _made[since:] = _made[since:], []
    for path in own:
        if path.rpartition("/")[2].rpartition("-")[0] in keep:
            _made.append(path)
        else:
            forget_path(spark, path)


def join_spread(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """left with the columns of right (which has each key once) by ``key``, null where there is no such key.

    Keys with more than a ``share``-th of left's rows, at most ``share`` of them, are joined by broadcast: their rows stay where they
    are, and at most ``share`` rows are sent.  Rows with a null key stay as well.  left is read four times: let it be a saved table.
    """
    known = left.where(F.col(key).isNotNull())
    hot = [r[0] for r in known.groupBy(key).count().where(F.col("count") > F.lit(left.count() / share)).select(key).collect()]
    is_hot = F.col(key).isin(hot)
    cold = known.where(~is_hot).join(right, key, "left")
    warm = known.where(is_hot).join(F.broadcast(right.where(is_hot)), key, "left")
    none = left.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key])
    out = cold.unionByName(warm).unionByName(none) if hot else cold.unionByName(none)
    return out.select(*left.columns, *[c for c in right.columns if c != key])


def batches(kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: applies kernel to each batch that has rows, or to each ``rows`` of its rows, to bound what it holds.

    After a task's last batch the worker, which waits for other tasks then, gives unused memory back.
    """

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            step = rows or max(part.num_rows, 1)
            for at in range(0, part.num_rows, step):
                if (out := kernel(part.slice(at, step))) is not None:
                    yield out

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(parts)
        pa.default_memory_pool().release_unused()

    return run


def with_answers(docs: DataFrame, text: Column, kernel: Callable[[pa.Array], pa.StructArray], answers: str, rows: int = 1000) -> DataFrame:
    """docs with the columns ``answers`` (as in DDL) that kernel finds from the texts alone; columns of these names are replaced.

    Only ``text`` goes to Python and only the answers come back: the rows wait in the JVM.  Python works on ``rows`` texts at once.
    """

    def run(texts: pa.Array) -> pa.Array:
        out = pa.concat_arrays([kernel(texts.slice(at, rows)) for at in range(0, max(len(texts), 1), rows)])
        pa.default_memory_pool().release_unused()
        return out

    kind = T.StructType.fromDDL(answers)
    others = [c for c in docs.columns if c not in kind.names]
    # Not deterministic: or a filter on the answers would move below this and have them found twice.
    found = F.arrow_udf(run, kind).asNondeterministic()
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), found(text).alias("found"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in others], "found.*")


def text_groups(texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in order, in groups of at most about ``limit`` characters; a longer text is a group of its own."""
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > limit:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group
