"""Shared helpers: shared work folder, lineage cuts, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` wins.  Where it is unset a local session (tests)
    gets a temporary folder, any other one an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="geoloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs that run inside: rows may be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, min(rows, int(old)) if old and int(old) > 0 else rows)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


#: Tables this process has written and not deleted.
_made: list[str] = []


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder, read it back.

    The files outlive lost executors; a column of type array or struct is fine.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geoloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _tables_of(df: DataFrame) -> set[str]:
    """Names of the folders that a plan reads."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            roots = leaf.relation().location().rootPaths()
            out |= {roots.apply(j).getName() for j in range(roots.size())}
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _made.remove(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files of stashed frames that no later plan reads."""
    names = _tables_of(df)
    for path in [p for p in _made if p.rsplit("/", 1)[1] in names]:
        _delete(df.sparkSession, path)


def made() -> int:
    """A mark for ``release``."""
    return len(_made)


def release(mark: int, result: DataFrame) -> DataFrame:
    """Delete the tables stashed since ``mark`` that ``result`` does not read."""
    names = _tables_of(result)
    for path in [p for p in _made[mark:] if p.rsplit("/", 1)[1] not in names]:
        _delete(result.sparkSession, path)
    return result


def tidy(run):  # noqa: ANN001, ANN201
    """A query or stage that leaves no table behind but those its result reads."""

    @wraps(run)
    def tidied(*args) -> DataFrame:  # noqa: ANN002
        mark = made()
        return release(mark, run(*args))

    return tidied


def text_of(column: str = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def least_hashed(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those whose key has the least hash (column ``__h``).

    A count gives the share of hashes that is enough, so a sorted limit meets a
    few times ``rows`` rows in all and not ``rows`` of every task.
    """
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    n = df.count()
    some = df.withColumn("__h", h)
    if n > 4 * rows:
        some = some.where(F.col("__h") < int(2 * rows / n * (1 << 40)))
    return some.orderBy("__h", key).limit(rows)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node id for every node that occurs in ``edges``.

    ``edges`` has columns ``a`` and ``b`` (same type; order and repeats do not
    matter, nulls are not allowed).  Returns ``node, component``.

    Alternating large-star / small-star rounds: every round is two
    aggregations with map-side combine and two equi joins, so no node's
    neighbour list is ever gathered in one task, and the number of rounds is
    logarithmic in practice.  Each round is written to the shared folder.
    An empty input gives an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stash(e, "cc")
    state = None
    for _ in range(max_rounds):
        # large star: a node's larger neighbours move to its smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = stash(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        new = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        drop_stash(e)
        e = nxt
        if (new.n, new.s) == state:
            break
        state = (new.n, new.s)
    else:
        raise RuntimeError("connected components did not settle")
    members = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots.join(members.select("node"), "node", "left_anti"))
