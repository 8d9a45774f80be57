"""Tables written to the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders made by this process, which ``clean_up`` and the end of the process remove.
_MADE: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names a folder that the driver and all executors see. Only
    where it is unset and all runs on one machine (tests) is a local one chosen; on a
    cluster each executor would write to a disk of its own, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="wayfare-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, name: str, compact: bool = True, codec: str | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    ``codec``: the files' compression, if not the session's. ``by``: a folder for each
    value of this column, which the files then lack; read back it is the last column.

    ``compact``: about one file for each core, which is as many tasks as can run at once,
    instead of one for each shuffle partition. Leave it out where the last stage is heavy.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if compact:
        df = df.coalesce(max(1, spark.sparkContext.defaultParallelism))
    writer = df.write if codec is None else df.write.option("compression", codec)
    (writer if by is None else writer.partitionBy(by)).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _MADE:
        _MADE.remove(path)


def forget(*tables: DataFrame) -> None:
    """Remove the folders of tables from ``written`` that nothing will read again."""
    for t in tables:
        path = getattr(t, "_written_to", None)
        if path in _MADE:
            _remove(t.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Remove every folder that this process made. Results that haven't been read or saved yet are gone too."""
    for path in list(_MADE):
        _remove(spark, path)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if _MADE else None
    if spark is not None:
        clean_up(spark)


def _width(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint") + 16
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
        return F.greatest(F.size(value), F.lit(0)).cast("bigint") * 8 + 16
    if isinstance(kind, T.StructType):
        parts = [_width(value[f.name], f.dataType) for f in kind.fields]
        return sum(parts[1:], parts[0]) if parts else F.lit(0).cast("bigint")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)).cast("bigint")
    return F.lit(16).cast("bigint")


#: Most bytes of a table that is sent to every executor.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows and ``max_bytes`` bytes, else itself.

    ``df`` should be a written table, as it is measured here.
    """
    if df.count() > max_rows:  # from the files' footers
        return df
    width = _width(F.struct(*(F.col(f"`{c}`") for c in df.columns)), df.schema)
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= max_bytes else df


#: Rows of a few numbers each that are sent whole.
FEW_ROWS = 300_000


def sent(df: DataFrame, rows: int) -> DataFrame:
    """A table of narrow rows (ids, numbers) marked for broadcast if it is known to have few of them."""
    return F.broadcast(df) if rows <= FEW_ROWS else df


#: A key is hot if it holds more than one row in so many; thus no more keys than this are.
HOT_KEYS = 10_000
#: Rows that any key may have without being hot.
HOT_LEAST = 1000


def join_keyed(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "inner", max_rows: int = 300_000) -> DataFrame:
    """``rows`` joined with a written ``table`` of one row a key, whose column ``count`` says how many rows have the key.

    A small table is sent whole. Of a large one the hot keys are, a bounded number, so
    that their rows stay where they are and no task gets all rows of a key; the other
    keys are shuffled. ``how`` is inner or left. ``rows`` is read twice, so it should be
    written or kept. Keys are not null.
    """
    side = small(table, max_rows)
    if side is not table:
        return rows.join(side, key, how)
    total = table.agg(F.sum(count)).first()[0] or 0
    limit = max(HOT_LEAST, total // HOT_KEYS)
    hot, cold = table.where(F.col(count) > limit), table.where(F.col(count) <= limit)
    if hot.isEmpty():
        return rows.join(table, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how))


def fresh(frame: DataFrame | list[str], *names: str) -> list[str]:
    """Column names like ``names`` that the frame doesn't have in any case."""
    taken = {c.lower() for c in (frame if isinstance(frame, list) else frame.columns)}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
