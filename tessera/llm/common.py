"""What the operators of this subpackage share: tables, shared files, word patterns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import pickle
import shutil
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def words(column: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it.

    A higher-order function evaluates a column that its lambda mentions anew for each element;
    a lambda variable is only read. Here ``value`` is the result of a fold over nothing, and ``body`` finishes it.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def scalar(df: DataFrame):
    """The only row of a global aggregate."""
    return df.first()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, as in tests, a local session gets a
    folder of its own; on a cluster that is an error, as no executor could read what another wrote to its own disk.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", place)
        spark.sparkContext.setCheckpointDir(place)
    return place


#: Tables that this process wrote and hasn't deleted.
_written: dict[str, SparkSession] = {}


#: Lists that are told of new tables.
_collecting: list[list[str]] = []


@contextlib.contextmanager
def collected(made: list[str]):
    """While it is open, ``made`` gets the tables that are written."""
    _collecting.append(made)
    try:
        yield
    finally:
        _collecting.remove(made)


def sweep(made: list[str], docs: DataFrame) -> None:
    """Deletes those tables of ``made`` that ``docs`` doesn't read."""
    give_back_driver(docs.sparkSession)
    read = " ".join(docs.inputFiles())
    for path in [p for p in made if p.rpartition("/")[2] not in read]:
        _delete(docs.sparkSession, path)
        _written.pop(path, None)
        made.remove(path)


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it: cuts the lineage, survives lost executors.

    The files go when the process ends, or by ``discard``: results are lazy and read them until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    for made in _collecting:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(docs: DataFrame) -> DataFrame:
    """``_row``, a struct of the columns of ``docs``, whatever their names, and ``_place``, a number of its own, as a written table.

    A number made anew by each read would depend on how that read is cut into tasks.
    """
    return materialize(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_place")))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` wrote and nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tessera-" in path:
            _delete(df.sparkSession, path)
            for known in [k for k in _written if k.rpartition("/")[2] == path.rpartition("/")[2]]:
                del _written[known]


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        with contextlib.suppress(Exception):  # the session may be over
            _delete(spark, path)


def unit_interval(hashed: Column) -> Column:
    """A 64-bit hash as a double in [0, 1], in the hash's signed order."""
    return hashed.cast("double") / F.lit(2.0**64) + F.lit(0.5)


def piece_of(hashed: Column, pieces: Column | int) -> Column:
    """The hash's place among ``pieces`` equal parts of its range, from 0; monotone in the hash."""
    pieces = pieces if isinstance(pieces, Column) else F.lit(pieces)
    return F.least(F.floor(unit_interval(hashed) * pieces), pieces - 1).cast("int")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 4 << 20):
    """While it is open, batches to and from Python have so many rows and bytes at most: less memory where rows are long.

    Only actions inside it are concerned, so what needs it is materialized inside.
    """
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextlib.contextmanager
def short_plans(spark: SparkSession, most: int = 20_000):
    """While it is open, descriptions of plans have so many characters at most: of a plan with a large literal they are larger than the literal,
    and the driver makes one at the start of each execution and whenever its plan adapts.
    """
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def give_back() -> None:
    """Returns what this process holds but doesn't use."""
    gc.collect()
    for pool in pa.supported_memory_backends():  # Arrow's functions use its own pool, whatever is set
        getattr(pa, f"{pool}_memory_pool")().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def give_back_driver(spark: SparkSession) -> None:
    """The same in the driver, its JVM included: what compilers of plans and code have freed stays in the C library's arenas else.

    A collection comes first: the heap grows with what nothing refers to any more, and a full one gives it back. A JVM without that
    command (before 17.0.9, or not on Linux) keeps what is in the arenas.
    """
    give_back()
    context = spark.sparkContext
    context._jvm.java.lang.System.gc()
    jvm, array = context._jvm, context._gateway.new_array
    find, command = jvm.java.lang.Class.forName, jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    types, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[i] = find(name)
    for i, value in enumerate((command, "systemTrimNativeHeap", array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0))):
        values[i] = value
    with contextlib.suppress(Py4JJavaError):  # by the interface, as the server's own class isn't public
        invoke = find("javax.management.MBeanServer").getMethod("invoke", types)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def tidy(run: Callable) -> Callable:
    """``run`` (over a task's batches) in a worker that gives its memory back: workers outlive tasks, and what they keep is lost to others."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # larger blocks are mapped, and unmapped when free
        pa.set_memory_pool(pa.system_memory_pool())
        pa.set_cpu_count(1)  # a task has one core, and threads have heaps of their own
        pa.set_io_thread_count(1)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def slices(lengths: np.ndarray, rows: int, total: int) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive runs of rows: ``rows`` rows at most, and ``total`` of ``lengths`` unless one row alone has more."""
    ends, start = np.cumsum(lengths), 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        end = max(start + 1, min(start + rows, int(np.searchsorted(ends, done + total, side="right"))))
        yield start, end
        start = end


def text_lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, null as none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


#: Bytes before a large bytes object in a pickled file.
_HEADER = pickle.dumps(b"\xff" * (1 << 17), pickle.HIGHEST_PROTOCOL).index(b"\xff" * 9)


class Mapped:
    """Broadcast 64-bit words that an executor's workers map from the one file that its broadcast is in, instead of a copy each.

    Where that file isn't found as expected (it may be encrypted, or another version's), a worker takes the broadcast's value.
    """

    def __init__(self, spark: SparkSession, data: bytes):
        self._pad, self._size = -_HEADER % 8, len(data)
        self._shared = spark.sparkContext.broadcast(bytes(self._pad) + data)

    def words(self) -> np.ndarray:
        path, size = getattr(self._shared, "_path", None), self._pad + self._size
        if path and 1 << 17 <= size < 1 << 32:
            with open(path, "rb") as f:
                begin = f.read(_HEADER)
            if begin[-5:] == b"B" + size.to_bytes(4, "little"):
                return np.memmap(path, dtype=np.uint64, mode="r", offset=_HEADER + self._pad, shape=(self._size // 8,))
        return np.frombuffer(self._shared.value, dtype=np.uint64, offset=self._pad)


def packed(df: DataFrame) -> bytes:
    """A table of bounded size as Arrow bytes, to be broadcast: rows as Python objects would take the driver ten times as much."""
    table, sink = df.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows whose ``n`` is above a threshold that ``most`` rows at most pass, found from a histogram of n.

    A sort with a limit would send ``most`` rows of every task to the driver; the histogram has a bounded number of rows.
    """
    step = F.floor(F.log2("n") * 32).cast("int")
    histogram = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, total = None, 0
    for at, n in histogram:
        total += n
        if total > most:
            break
        least = at
    return counts.where(step >= least) if least is not None else counts.limit(0)
