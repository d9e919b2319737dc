"""What executors asked for and what they used: memory by precedence of settings, peaks against it, and spill by stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import share, size_to_bytes
from .extract import KEY

MIB = 1 << 20
#: Spark's defaults, and what it keeps of each heap for itself.
HEAP, LEAST_OVERHEAD, RESERVED, OVERHEAD_FACTOR, MEMORY_FRACTION, STORAGE_FRACTION = 1 << 30, 384 * MIB, 300 * MIB, 0.1, 0.6, 0.5
_KEYS = (
    "spark.executor.memory", "spark.executor.memoryOverhead", "spark.executor.memoryOverheadFactor", "spark.memory.offHeap.enabled", "spark.memory.offHeap.size", "spark.executor.pyspark.memory",
    "spark.memory.fraction", "spark.memory.storageFraction", "spark.driver.memory",
)


def memory_config(settings: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """heap, overhead, off_heap, python, container, unified and driver_heap in bytes, and the two fractions, per application.

    The heap is that of the default resource profile, else the setting, else Spark's default. The overhead is the setting, else the profile's, else a share of
    the heap, at least LEAST_OVERHEAD. Off-heap memory counts only where it is enabled. What can't be read as a size or number counts as not set.
    """
    conf = settings.filter("section = 'spark'").groupBy(*KEY).pivot("key", list(_KEYS)).agg(F.first("value"))
    get = lambda k: F.col(f"`{k}`")
    if profiles is None:
        conf = conf.withColumn("p_heap", F.lit(None).cast("long")).withColumn("p_over", F.lit(None).cast("long"))
    else:
        base = profiles.filter("profile = 0").groupBy(*KEY).agg((F.max("memory_mb") * MIB).alias("p_heap"), (F.max("overhead_mb") * MIB).alias("p_over"))
        conf = conf.join(base, list(KEY), "left")
    above = lambda c: F.when(c > 0, c)
    size = lambda k, unit="m": above(size_to_bytes(get(k), unit))
    number = lambda k: get(k).try_cast("double")
    heap = F.coalesce(above(F.col("p_heap")), size("spark.executor.memory"), F.lit(HEAP)).cast("long")
    factor = F.coalesce(above(number("spark.executor.memoryOverheadFactor")), F.lit(OVERHEAD_FACTOR))
    overhead = F.coalesce(size("spark.executor.memoryOverhead"), above(F.col("p_over")), F.greatest(F.lit(LEAST_OVERHEAD).cast("long"), F.floor(factor * heap).cast("long")))
    off = F.when(F.lower(get("spark.memory.offHeap.enabled")) == "true", F.coalesce(size("spark.memory.offHeap.size", "b"), F.lit(0))).otherwise(0).cast("long")
    out = conf.select(
        *KEY, heap.alias("heap"), overhead.alias("overhead"), off.alias("off_heap"), F.coalesce(size("spark.executor.pyspark.memory"), F.lit(0)).cast("long").alias("python"),
        F.coalesce(number("spark.memory.fraction"), F.lit(MEMORY_FRACTION)).alias("memory_fraction"), F.coalesce(number("spark.memory.storageFraction"), F.lit(STORAGE_FRACTION)).alias("storage_fraction"),
        F.coalesce(size("spark.driver.memory"), F.lit(HEAP)).cast("long").alias("driver_heap"),
    )
    unified = F.floor(F.greatest(F.lit(0), F.col("heap") - RESERVED) * F.col("memory_fraction")).cast("long")
    return out.withColumn("container", F.col("heap") + F.col("overhead") + F.col("off_heap") + F.col("python")).withColumn("unified", unified)


def memory_use(peaks: DataFrame, totals: DataFrame, config: DataFrame) -> DataFrame:
    """Per executor: the highest heap, off-heap, process, storage and execution memory seen, heap against what it may have, and the share of task time spent on collection. Null peaks weren't measured; the share of a heap that no setting tells of is null."""
    whole = lambda *xs: sum((F.coalesce(F.col(x), F.lit(0)) for x in xs[1:]), F.coalesce(F.col(xs[0]), F.lit(0)))
    use = peaks.select(
        *KEY, "executor_id", F.col("JVMHeapMemory").alias("peak_heap"), F.col("JVMOffHeapMemory").alias("peak_off_heap"), whole("ProcessTreeJVMRSSMemory", "ProcessTreePythonRSSMemory", "ProcessTreeOtherRSSMemory").alias("peak_process"),
        whole("OnHeapStorageMemory", "OffHeapStorageMemory").alias("peak_storage"), whole("OnHeapExecutionMemory", "OffHeapExecutionMemory").alias("peak_execution"),
    )
    gc = totals.select(*KEY, "executor_id", share(F.col("gc_ms"), F.col("run_ms")).alias("gc_share"))
    rows = use.join(gc, [*KEY, "executor_id"], "left").join(config.select(*KEY, "heap", "driver_heap"), list(KEY), "left")
    may = F.when(F.col("executor_id") == "driver", F.col("driver_heap")).otherwise(F.col("heap"))
    return rows.withColumn("heap", may).drop("driver_heap").withColumn("heap_share", F.when((F.col("peak_heap") > 0) & F.col("heap").isNotNull(), share(F.col("peak_heap"), F.col("heap"))))


def stage_spill(totals: DataFrame) -> DataFrame:
    """Stage attempts that spilled, with what they wrote to shuffles, and their place by bytes on disk."""
    from pyspark.sql import Window as W

    rows = totals.filter("mem_spill > 0 or disk_spill > 0").select(*KEY, "stage_id", "stage_attempt", "mem_spill", "disk_spill", "shuffle_write_bytes")
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("disk_spill"), "stage_id", "stage_attempt")).cast("long"))
