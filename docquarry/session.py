"""Session defaults used by the tests, the bench and the command line."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # fat text rows: bound an Arrow batch by bytes, not only by rows
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
    "spark.ui.enabled": "false",
}


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A local session; a cluster passes its own through spark-submit."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("docquarry")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df):
    """df, dealt anew if it has fewer partitions than the cluster has cores, as a file of one row group has; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


#: Rows, and bytes, that Python works on together.
SLICE, SLICE_BYTES = 1024, 4 << 20


def slices(batches):
    """Arrow batches cut, without a copy, to SLICE rows and SLICE_BYTES at most (or one row), so that what Python makes of them is bounded however large the batches are."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            n = part.num_rows
            if n > 1 and (n > SLICE or part.nbytes > SLICE_BYTES):
                todo += [part.slice(n // 2), part.slice(0, n // 2)]
            elif n:
                yield part


def ship(spark: SparkSession) -> None:
    """Send the package to workers of a session whose own path lacks it, once per session."""
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if getattr(context, "_docquarry_shipped", False) or not (root / "docquarry").is_dir():
        return
    context._docquarry_shipped = True
    inherited = context.environment.get("PYTHONPATH", "") + os.pathsep + context._jvm.System.getenv().getOrDefault("PYTHONPATH", "")
    if str(root) in inherited.split(os.pathsep):
        return
    archive = os.path.join(tempfile.mkdtemp(), "docquarry.zip")  # the driver serves it to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.glob("docquarry/**/*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(archive)
