"""Session-level helpers: table access, lineage cuts and size-checked joins."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as JSON text) up to which a side may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 128 << 20
#: Share of a side's rows from which a key is hot.
HOT_SHARE = 1 / 64
#: Copies made of the small side of a salted join.
SALTS = 16


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_evigraph_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="evigraph-code-"), "evigraph.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for n in names:
                if not n.endswith(".pyc"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("evigraph", os.path.relpath(path, home)))
    sc.addPyFile(target)
    sc._evigraph_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that ``spark.checkpoint.dir`` names; only on one machine a folder of its own may stand in."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="evigraph-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` once in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``most`` rows and ``most_bytes`` bytes; reads no more than that many rows."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("width")
    rows, size = df.select(width).limit(most + 1).agg(F.count("*"), F.coalesce(F.sum("width"), F.lit(0))).first()
    return rows <= most and size <= most_bytes


def salted_join(left: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a lookup, unique in ``on``, that is repeated ``SALTS`` times; every key of ``left`` spreads over as many tasks."""
    salt = "__salt"
    spread = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = left.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(spread, [*on, salt], how).drop(salt)


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list[object]:
    """The keys that hold ``share`` of the rows or more, at most ``1 / share`` of them, by one pass with a bounded sketch.

    The sketch may name a key that isn't hot, or miss one at the margin; it steers the plan of a join, never its result.
    """
    rows, top = df.agg(F.count(key), F.expr(f"approx_top_k(`{key}`, {int(1 / share)}, {64 * int(1 / share)})")).first()
    return [t["item"] for t in top or () if t["item"] is not None and t["count"] >= share * rows]


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str, hot: list[object]) -> DataFrame:
    """Join on one key; ``right``, unique in it, is repeated for the ``hot`` keys only, and their rows of ``left`` spread."""
    if not hot:
        return left.join(right, key, how)
    salt, is_hot = "__salt", F.coalesce(F.col(key).isin(hot), F.lit(False))
    salted = left.withColumn(salt, F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(right.withColumn(salt, F.explode(copies)), [key, salt], how).drop(salt)


def lookup_join(
    left: DataFrame, small: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_ROWS
) -> DataFrame:
    """Join ``left`` with a lookup table whose rows are unique in ``on``.

    Up to ``most`` rows and ``BROADCAST_BYTES`` the lookup is broadcast, so a hot key costs
    nothing. Beyond that both sides are shuffled on the key and a salt.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join can't do {how}")
    return left.join(F.broadcast(small), on, how) if fits(small, most) else salted_join(left, small, on, how)


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over enough tasks for a costly pass.

    Few large files make few tasks. Only then rows are dealt out round robin, so that no key
    is hot; a scan that already has two tasks a core, as any large one has, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(4 * cores)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b), frames)
