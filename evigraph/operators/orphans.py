"""References to records that do not exist (problem 6).

A blocked Bloom filter over the parent keys is built by ``groupBy`` + ``bit_or`` into chunk
rows (chunk number, 128 words); a reference whose bits are not all set is proved an orphan
without its parent. Only filter-positive references carry their key into the exact join, which
also tells deleted, late and earlier parents apart; all others pass it under keys of their own.

The filter has ``BITS_PER_KEY`` bits for each distinct key, counted by a sketch. Up to
``MOST_FILTER_ROWS`` chunks it is broadcast; beyond that references meet the same chunks in a
join on the chunk number, salted, so that a hot key's chunk isn't one task. References are
reduced to distinct (key, row) pairs and tested once. Keys that hold a large share of the
references are found by a bounded sketch and their parents repeated under salts.

Defined results: null references are no case; a blank reference is a missing one; copies of a
reference count once; a parent delivered several times exists from its first ``loaded_at``
and has the ``deleted_at`` of its last; null ``loaded_at`` of a reference compares as neither
deleted nor late; an empty parent table makes every reference missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import strip
from evigraph.session import hot_join, hot_keys, salted_join, union_all

WORDS_PER_CHUNK = 128
BITS_PER_KEY = 12
MOST_FILTER_ROWS = 65_536  # 64 MB of bits


def _place(key: Column, chunks: int) -> tuple[Column, Column, Column]:
    """Chunk, word and bit mask of a key: four bits in one 64-bit word."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit("mask"))
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(g, shift).bitwiseAND(F.lit(63)).cast("int"))
    mask = bit(0).bitwiseOR(bit(8)).bitwiseOR(bit(16)).bitwiseOR(bit(24))
    return (
        F.pmod(h, F.lit(chunks)).cast("int"),
        F.pmod(F.shiftright(h, 32), F.lit(WORDS_PER_CHUNK)).cast("int"),
        mask,
    )


def bloom_chunks(keys: DataFrame, key: str, chunks: int) -> DataFrame:
    """(__chunk, __bits) rows of a filter over ``key``."""
    chunk, word, mask = _place(F.col(key), chunks)
    words = keys.select(chunk.alias("__chunk"), word.alias("__word"), mask.alias("__mask")).groupBy("__chunk", "__word").agg(F.bit_or("__mask").alias("__mask"))
    return (
        words.groupBy("__chunk")
        .agg(F.map_from_entries(F.collect_list(F.struct("__word", "__mask"))).alias("__m"))  # at most 128 words
        .select("__chunk", F.transform(F.sequence(F.lit(0), F.lit(WORDS_PER_CHUNK - 1)), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0).cast("bigint"))).alias("__bits"))
    )


def held_by_bloom(refs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``refs`` with ``__held``: false is proof that ``keys`` has no such key. Both keys are one text column; ``keys`` may repeat."""
    expected = keys.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    chunks = max(1, -(-expected * BITS_PER_KEY // (64 * WORDS_PER_CHUNK)))
    chunk, word, mask = _place(F.col(key), chunks)
    rows, numbered = bloom_chunks(keys, key, chunks), refs.withColumn("__chunk", chunk)
    met = numbered.join(F.broadcast(rows), "__chunk", "left") if chunks <= MOST_FILTER_ROWS else salted_join(numbered, rows, ["__chunk"])
    held = F.coalesce(F.get(F.col("__bits"), word).bitwiseAND(mask) == mask, F.lit(False))
    return met.withColumn("__held", held).drop("__chunk", "__bits")


def split_by_bloom(refs: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(possible, definite): references that may have a parent and those proved to have none."""
    tested = held_by_bloom(refs, keys, key)
    return tested.where("__held").drop("__held"), tested.where(~F.col("__held")).drop("__held")


def _key(*parts: Column) -> Column:
    return F.concat_ws("\u0001", *parts)


def classify(refs: DataFrame, keys: DataFrame, parents: DataFrame, verdict: Column) -> DataFrame:
    """Orphan rows of ``refs`` (__key, payload columns) against ``parents`` (__key, facts).

    ``keys`` holds the parents' keys as they are stored, ``parents`` one row per key.

    ``verdict`` names the orphan kind of a reference that found its key, null if it is sound.
    """
    payload = [c for c in refs.columns if c != "__key"]
    hot = hot_keys(refs, "__key")
    distinct = refs.distinct()
    tested = held_by_bloom(distinct, keys, "__key")
    # a proved orphan keeps no key to meet a parent by, but one of its own, so that they spread
    own = F.concat(F.lit("\u0002"), F.xxhash64(*[F.col(c) for c in payload]).cast("string"))
    keyed = tested.withColumn("__key", F.when(F.col("__held"), F.col("__key")).otherwise(own))
    joined = hot_join(keyed, parents.withColumn("__found", F.lit(True)), "__key", "left", hot)
    kind = F.when(F.col("__found").isNull(), "missing").otherwise(verdict)
    return joined.select(*payload, F.explode(F.array_compact(F.array(kind))).alias("orphan_kind"))


def task_orphans(tasks: DataFrame, targets: DataFrame, field: str) -> DataFrame:
    """Orphans of one reference column of tasks; ``targets`` has id, deleted_at, loaded_at."""
    refs = (
        tasks.where(F.col(field).isNotNull() & F.col("id").isNotNull())
        .select(F.col(field).cast("string").alias("__key"), F.col("id").cast("string").alias("row_key"), F.col("loaded_at").alias("__at"))
    )
    present = targets.where(F.col("id").isNotNull()).withColumn("__key", F.col("id").cast("string"))
    parents = (
        present.groupBy("__key")
        .agg(F.min("loaded_at").alias("__loaded"), F.max_by("deleted_at", "loaded_at").alias("__deleted"))
    )
    verdict = F.when(F.col("__deleted") <= F.col("__at"), "deleted").when(F.col("__loaded") > F.col("__at"), "late")
    return classify(refs, present.select("__key"), parents, verdict).select(
        F.lit("tasks").alias("src_table"), F.lit(field).alias("ref_field"), "row_key",
        F.date_format("__at", "yyyy-MM").alias("month_key"), "orphan_kind",
    )


def edge_orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge ends that are no node of the edge's own project and snapshot."""
    ends = F.array(*[F.struct(F.lit(f).alias("ref_field"), strip(F.col(f)).alias("__ref")) for f in ("src", "dst")])
    refs = (
        edges.where(F.col("project_id").isNotNull())
        .select("project_id", "snapshot_no", F.concat_ws("@", "edge_id", F.col("snapshot_no").cast("string")).alias("row_key"), F.date_format("analyzed_at", "yyyy-MM").alias("month_key"), F.inline(ends))
        .where(F.col("__ref").isNotNull())
        .select(_key(F.col("project_id"), F.col("__ref")).alias("__key"), F.col("snapshot_no").alias("__no"), "ref_field", "row_key", "month_key")
    )
    present = nodes.where(F.col("project_id").isNotNull() & F.col("node_id").isNotNull() & F.col("snapshot_no").isNotNull()).select(
        _key(F.col("project_id"), F.col("node_id")).alias("__key"), "snapshot_no"
    )
    # the snapshots of one node are as many as its project has deliveries of different number
    parents = present.groupBy("__key").agg(F.collect_set("snapshot_no").alias("__nos"))
    verdict = F.when(
        ~F.array_contains("__nos", F.col("__no")),
        F.when(F.array_min("__nos") < F.col("__no"), "deleted").otherwise("late"),
    )
    return classify(refs, present.select("__key"), parents, verdict).select(F.lit("edges").alias("src_table"), "ref_field", "row_key", "month_key", "orphan_kind")


def orphan_references(tasks: DataFrame, users: DataFrame, projects: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return union_all([
        task_orphans(tasks, projects, "project_id"),
        task_orphans(tasks, users, "assignee_id"),
        edge_orphans(edges, nodes),
    ]).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, month and kind."""
    return found.groupBy("src_table", "ref_field", "month_key", "orphan_kind").agg(F.count_distinct("row_key").alias("orphans"))
