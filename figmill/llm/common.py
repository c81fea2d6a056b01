"""Helpers shared by the training-data operators: scratch tables, text columns, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word pattern of the contracts: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; on one machine, a folder of our own where none is set (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="figmill-")
    return _own_roots[app]


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def saved(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The new frame has no lineage: a lost executor costs a file read, and row
    identifiers taken from it stay the same however often it is scanned.
    ``batch``: most rows that Python functions get at once while it is written,
    where rows may be large.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/figmill/{uuid.uuid4().hex}-{name}"
    usual = spark.conf.get(_BATCH)
    if batch:
        spark.conf.set(_BATCH, str(batch))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, usual)
    out = spark.read.schema(df.schema).parquet(path)
    out._figmill_path = path
    return out


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _parquet_scan(df: DataFrame) -> bool:
    """Whether ``df`` only picks columns and rows of one Parquet table, the same ones each time."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    relation = plan.relation() if plan.nodeName() == "LogicalRelation" else None
    return relation is not None and relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` with a number for each row, and that column's name; later plans see the same numbers however a scan is split.

    Rows of a Parquet table are numbered by file and place in it, which costs no copy; others are saved.
    """
    row = unused(df, "figmill_row")
    if not _parquet_scan(df):
        return saved(df.withColumn(row, F.monotonically_increasing_id()), name), row
    file, at = unused(df, "figmill_file"), unused(df, "figmill_at")
    place = df.metadataColumn("_metadata")
    files = df.select(place["file_path"].alias(file)).distinct()
    # one row a file
    files = saved(files.withColumn(row, F.shiftleft(F.row_number().over(Window.orderBy(file)).cast("long"), 40)), name)
    found = df.withColumn(file, place["file_path"]).withColumn(at, place["row_index"]).join(F.broadcast(files), file)
    return found.withColumn(row, F.col(row) + F.col(at)).select(*[F.col(f"`{c}`") for c in df.columns], row), row


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_figmill_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


#: Words of 64 bits in a key filter: 2 MB whatever the number of keys.
FILTER_WORDS = 1 << 17


def _place(column: str) -> tuple[Column, Column]:
    """Slot and bit of a hashed key, from its low bits."""
    slot = F.col(column).bitwiseAND(FILTER_WORDS - 1)
    return slot, F.expr(f"shiftleft(1L, cast(shiftright({column}, 17) & 63 AS int))")


def key_filter(keys: DataFrame, column: str) -> DataFrame:
    """A bitmap of a column of 64-bit hashes as rows (slot, bits), at most FILTER_WORDS of them."""
    slot, bit = _place(column)
    return keys.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits"))


def passing(rows: DataFrame, column: str, bitmap: DataFrame) -> DataFrame:
    """Rows whose hashed key may be in the bitmap: none that is in it is lost, and nothing is moved for it."""
    slot, bit = _place(column)
    met = rows.withColumn("slot", slot).join(F.broadcast(bitmap), "slot")
    return met.filter(F.col("bits").bitwiseAND(bit) != 0).drop("slot", "bits")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not at the driver's next full collection; the driver gives back what it no longer uses."""
    gc.collect()
    spark._jvm.System.gc()
    give_back()
    _give_back_jvm(spark)


def give_back() -> None:
    """Memory that this process no longer uses goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _give_back_jvm(spark: SparkSession) -> None:
    """The same for the driver's JVM: what compiling plans took outside of its heap stays with it otherwise, stage after stage."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    text, forname = jvm.java.lang.String, jvm.java.lang.Class.forName
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # by the interface, as the server's own class is not open to callers
    types = [forname(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    kinds, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    for i, kind in enumerate(types):
        kinds[i] = kind
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = new(jvm.java.lang.Object, 0), new(text, 0)
    try:
        forname("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    except Py4JJavaError:
        pass  # this JVM has no such command


def first_by_hash(df: DataFrame, keys: list[str], most: int, total: int) -> DataFrame:
    """The first ``most`` rows of ``df`` by a hash of ``keys``, of ``total`` rows in all.

    A bound on the hash leaves some four times as many before they are ordered, so
    that partitions do not each send ``most`` rows.
    """
    order = F.xxhash64(*keys)
    if total > 4 * most:
        df = df.filter(F.pmod(order, F.lit(1 << 32)) < int((1 << 32) * (4 * most / total)))
    return df.orderBy(order, *keys).limit(most)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as no bytes."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``links(a, b)`` as ``(id, component)``; component is the least id.

    Alternating large-star and small-star steps: each keeps components, replaces
    links by links to smaller ids and needs O(log^2) rounds whatever the shape; rounds
    go on until one changes nothing.
    Every round is written to the shared folder. Links without ends of their own
    (self links) only name their node. Nothing but a change count meets the driver.
    """
    base = links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo <> hi").distinct()
    edges = saved(base, name)
    previous = None
    while True:
        # large star: every neighbour above a node moves to the least id around it
        both = edges.select(F.col("lo").alias("n"), F.col("hi").alias("m")).unionAll(edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("root"))
        large = both.filter("m > n").join(least, "n").select(F.col("root").alias("lo"), F.col("m").alias("hi")).filter("lo <> hi").distinct()
        # small star: every node sends itself and its smaller neighbours to the least of them
        floor = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(floor, "hi")
        step = small.select(F.col("root").alias("lo"), "hi").unionAll(small.select(F.col("root").alias("lo"), F.col("lo").alias("hi"))).filter("lo <> hi").distinct()
        after = saved(step, name)
        mark = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.lit(0))).first()
        discard(edges)
        edges = after
        if mark == previous:
            break
        previous = mark
    release(links.sparkSession)
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(edges.select(F.col("lo").alias("id"), F.col("lo").alias("component"))).distinct()
