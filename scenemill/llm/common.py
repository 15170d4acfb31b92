"""What the operators of this subpackage share: table access, staged tables and checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import Files

#: Rows up to which a small side is broadcast; beyond it the join is dealt out by salted keys.
BROADCAST_ROWS = 100_000
#: Salts of a dealt-out join: a key with a third of all rows is spread over so many tasks.
JOIN_SALTS = 64
#: Bytes of a batch of rows that goes to a Python worker, at most (one longer row is a batch of its own).
BATCH_BYTES = 4 << 20
_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Set here only where the session has none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="scenemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to a table in the shared folder and reads them back.

    It cuts the lineage, survives lost executors, and fixes whatever is not deterministic in
    ``df``. The table stays until discarded() or until the folder is cleaned, as later plans read it lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scenemill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED[id(out)] = path
    weakref.finalize(out, _STAGED.pop, id(out), None)
    return out


#: Where staged tables lie, by the identity of their frame.
_STAGED: dict[int, str] = {}


def discarded(*frames: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for df in frames:
        path = _STAGED.pop(id(df), None)
        if path:
            Files(df.sparkSession).remove(path)


def bounded_join(
    large: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "inner", limit: int = BROADCAST_ROWS, salts: int = JOIN_SALTS
) -> DataFrame:
    """Joins a table of one row per key to a large one, null keys matching.

    The small side is counted first. Up to ``limit`` rows it is broadcast; beyond it each of its
    rows is repeated for every salt, and the rows of the large side are dealt out by key and by
    ``spread`` (any column that varies within a key). ``how`` is inner or left.
    """
    key2, salt, salt2 = fresh(large, "join_key", "join_salt", "join_salt2")
    right = small.withColumnRenamed(key, key2)
    if small.count() <= limit:
        return large.join(F.broadcast(right), large[key].eqNullSafe(right[key2]), how).drop(key2)
    salted = large.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = right.withColumn(salt2, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = salted[key].eqNullSafe(right[key2]) & (F.col(salt) == F.col(salt2))
    return salted.join(right, on, how).drop(key2, salt, salt2)


class Shared:
    """A broadcast value of bounded size with an id that worker processes can keep what they build from it by."""

    def __init__(self, held: Broadcast):
        self.held, self.id = held, uuid.uuid4().hex

    @property
    def value(self) -> Any:
        return self.held.value


def shared_value(spark: SparkSession, value: Any) -> Shared:
    return Shared(spark.sparkContext.broadcast(value))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` clashes with: the given ones, with underscores as needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def known(value: Column) -> Column:
    """A value as text in which null differs from every value."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def hashable(schema: T.StructType) -> list[str]:
    """The columns whose values can be hashed: all but those with maps or variants in them."""
    def plain(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return all(plain(f.dataType) for f in kind)
        if isinstance(kind, T.ArrayType):
            return plain(kind.elementType)
        return not isinstance(kind, (T.MapType, T.VariantType))

    return [f.name for f in schema if plain(f.dataType)]


#: What lets go of the caches that a module's functions fill in a worker, by module.
CACHES: dict[str, Callable[[], None]] = {}


def keeps_cache(owner: str, clear: Callable[[], None]) -> None:
    CACHES[owner] = clear


def _let_go(owner: str | None) -> None:
    """Clears the caches of other owners. Workers are used again by later stages, whose memory these would take."""
    for name, clear in CACHES.items():
        if name != owner:
            clear()


def _give_back() -> None:
    """Returns freed memory to the system, which allocators else keep for a worker's life."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def tidy(work: Callable[[Iterator], Iterator], owner: str | None = None) -> Callable[[Iterator], Iterator]:
    """``work`` over batches, which starts without the caches of others and gives memory back at its end."""

    def tidied(batches: Iterator) -> Iterator:
        _let_go(owner)
        try:
            yield from work(batches)
        finally:
            _give_back()

    return tidied


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's batches to Python workers have at most BATCH_BYTES, or less if it is set lower."""
    held = spark.conf.get(_BYTES_CONF, None)
    held = int(held.rstrip("b")) if held and held.rstrip("b").lstrip("-").isdigit() else 0
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(_BYTES_CONF, str(BATCH_BYTES))


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, owner: str | None = None) -> DataFrame:
    """mapInArrow in batches of bounded bytes, by a worker that keeps no memory of others' work or its own."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(tidy(work, owner), schema)
