"""What several operators of this subpackage share: the shared folder, ranges and word splitting."""

from __future__ import annotations

import atexit
import contextlib
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: bounds what a Python worker holds of long texts at once. All
#: operators of this subpackage use the same value, so that plans built earlier aren't changed.
ARROW_ROWS = 1000
#: Bytes of text that a worker takes apart at once.
SLICE_BYTES = 1 << 20

_own_dir: str | None = None
_written: dict[str, SparkSession] = {}
_cached: dict[tuple, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the setting is missing, a local master gets a temporary folder; on a cluster
    that would be a different disk on every machine, so there it is an error.
    """
    global _own_dir
    if at := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="spark-lodestone-")
    return f"file://{_own_dir}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    with contextlib.suppress(Exception):  # the session may be over
        for path, spark in _written.items():
            delete(spark, path)


atexit.register(_clean)


def keep(df: DataFrame, name: str, instead_of: Iterable[DataFrame] = ()) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors.

    The kept tables of ``instead_of`` are deleted once df is written: those that only df reads.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    drop(*instead_of)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more. Others are left alone."""
    for table in tables:
        path = getattr(table, "_kept_at", None)
        if path in _written:
            delete(_written.pop(path), path)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting for the jobs run within, and the former one afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def worker_cache(key: tuple, make: Callable[[], object]):
    """What a Python worker keeps from task to task. One thing at a time: when another operator begins, what the last one kept is freed."""
    if key not in _cached:
        _cached.clear()
        _cached[key] = make()
    return _cached[key]


class Recent:
    """Values of words met lately, in at most about ``most`` bytes.

    Two generations: when the young one has half of the bytes it becomes the old one, and the
    former old one is forgotten. Words that are met again move to the young one.
    """

    def __init__(self, most: int) -> None:
        self.half, self.size = most // 2, 0
        self.young: dict = {}
        self.old: dict = {}

    def get(self, word):
        got = self.young.get(word)
        if got is None and (got := self.old.get(word)) is not None:
            self.put(word, got)
        return got

    def put(self, word, value) -> None:
        if self.size >= self.half:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[word] = value
        self.size += 100 + sys.getsizeof(word) + sys.getsizeof(value)


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to most at most; what is larger by itself is alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes)


def arrow_rows(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for what follows in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranged(df: DataFrame, *order: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows in ascending order over all partitions, with ``part`` (rising with the order) and ``at`` (place in the part from 0).

    Rows that are equal in ``order`` meet in one part and are sorted by ``ties`` there.
    """
    mid = F.monotonically_increasing_id()
    return (
        df.repartitionByRange(partitions(df.sparkSession), *order)
        .sortWithinPartitions(*order, *ties)
        .withColumn("_mid", mid)
        .withColumns({"part": F.shiftright("_mid", 33).cast("int"), "at": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))})
        .drop("_mid")
    )


def running_start(totals: DataFrame, amount: str, key: str = "part") -> DataFrame:
    """(key, start): the sum of the amounts of all smaller keys. totals has one row for each partition, so its size is bounded by their number."""
    rows, start, out = totals.select(key, amount).collect(), 0, []
    for k, v in sorted((r[0], r[1]) for r in rows):
        out.append((k, start))
        start += v
    return totals.sparkSession.createDataFrame(out, f"{key} int, start long")


def column(batch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def raw_texts(batch, name: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a string column, without making Python strings."""
    import pyarrow as pa

    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def to_batches(rows: Iterator[tuple], schema, size: int = ARROW_ROWS):
    """Arrow batches of at most size rows."""
    import pyarrow as pa

    def batch(held: list[tuple]):
        cols = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch(held)
            held = []
    if held:
        yield batch(held)
