"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows handled at once inside a Python task; bounds what one step of a task holds.
ROWS_PER_STEP = 256

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Maps A-Z to a-z and every byte outside 0-9, a-z and 0x80-0xFF to a space, so that
#: ``bytes.translate(...).split()`` yields the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder that the cluster names; set one of our own only where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, which
    only a local session may leave so, a folder in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int, share: int = 1_000) -> DataFrame:
    """``left`` joined to ``right``, which has each key once and in ``count`` how many rows of ``left``
    have it; ``total`` is their sum. Keys with more than one in ``share`` of all rows (fewer than
    ``share`` keys, whatever the size) are joined by broadcast where their rows are, so that no task
    gets a hot key's rows; the others are shuffled. ``right`` is read three times."""
    hot = F.col(count) * share > F.lit(total)
    big = F.broadcast(right.filter(hot))
    rest = left.join(big.select(key), key, "left_anti").join(right.filter(~hot), key)
    return left.join(big, key).unionByName(rest)


def row_key(text: str = "text") -> Column:
    """A digest that rows have in common only if both their id and their text are the same."""
    name = F.col("doc_id").cast("string")
    size = F.coalesce(F.length(name), F.lit(-1)).cast("string")
    return F.md5(F.concat(size, F.lit(":"), F.coalesce(name, F.lit("")), F.coalesce(F.concat(F.lit(":"), F.col(text)), F.lit(""))))


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the path in it."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")


def fresh(taken: Sequence[str], base: str) -> str:
    """A column name that none of ``taken`` equals, whatever the case."""
    low = {c.lower() for c in taken}
    name = base
    while name.lower() in low:
        name = f"_{name}"
    return name


#: What Python workers remember from task to task; dealt with below by name, so that no closure carries it.
CACHES: list[dict] = []


def forget() -> None:
    for cache in CACHES:
        cache.clear()


def give_back() -> None:
    """Return memory that is no longer used to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], remembers: bool = False) -> Callable:
    """``run``, after which a worker gives the memory that it no longer uses back to the system. Workers
    live on between tasks, and what one stage had needed would else count beside the next one's; so a
    task that does not use what earlier ones remembered (``remembers``) drops it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def per_row(
    df: DataFrame,
    keep: Sequence[str],
    inputs: Sequence[str],
    added: Sequence[tuple[str, T.DataType]],
    make: Callable[[], Callable[..., Sequence[Sequence]]],
) -> DataFrame:
    """Append the columns ``added`` to the columns ``keep``, row by row, in Arrow batches.

    ``make()`` runs once per task and returns a function of the input columns (string columns come
    as lists of UTF-8 bytes or None, others as Python values) that returns one sequence per added
    column. A column of ``keep`` that has the name of an added one is replaced by it.
    """
    new = [n for n, _ in added]
    keep = [c for c in keep if c not in new]
    need = list(dict.fromkeys([*keep, *inputs]))
    src = df.select(*[f"`{c}`" for c in need])
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(n, t, True) for n, t in added])
    kinds = [to_arrow_type(t) for _, t in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_PER_STEP):
                part = batch.slice(lo, ROWS_PER_STEP)
                out = fn(*[values(part.column(part.schema.get_field_index(c))) for c in inputs])
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                cols += [pa.array(v, type=k) for v, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *new])

    return src.mapInArrow(released(run), schema)


def values(col: pa.Array) -> list:
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return col.to_pylist()


def signed(x: int) -> int:
    """An unsigned 64-bit integer as the Spark long with the same bits."""
    return x - (1 << 64) if x >> 63 else x
