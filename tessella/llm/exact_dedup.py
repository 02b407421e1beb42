"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest.  A batch is reduced to one row per
digest (pre-aggregated before the shuffle, so a digest that a third of all rows share costs one row
per map task), the digests that the index lacks are found by a sort-merge anti-join that reads the
index in place, bucket by bucket, and only those are appended.  Everything is a DataFrame operation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.store import keep_rows, looked_up, new_path, persist, with_row_key

#: Deleted before texts are compared: space and the control characters from tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes of ``text`` without white space; a null text counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, ""), 256))


class DigestIndex:
    """A table (digest, keep_id, n_rows, batch) of every text seen so far.

    ``path`` names a folder of an earlier index to go on with; without it a new one is made in the
    shared folder.  ``buckets`` is fixed when the index is made: choose it so that a bucket of the
    full index (about 60 bytes a text) fits in a task.  ``close`` takes the table's name out of the
    catalog and leaves the files; what ``dedup`` has returned does not need the name.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 32) -> None:
        self.spark, self.buckets = spark, buckets
        self.path = path or new_path(spark, "digest-index")
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, n_rows BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame, batch: str) -> None:
        """Add the digests of ``fresh`` (digest, keep_id, n_rows) that this batch has not added yet;
        one file for each bucket and call.  ``fresh`` must lack what other batches have added.  No
        rows, or only known ones, add nothing."""
        own = self.read().filter(F.col("batch") == batch).select("digest").hint("merge")
        dealt = fresh.select("digest", "keep_id", "n_rows", F.lit(batch).alias("batch")).join(own, "digest", "left_anti")
        dealt.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)

    def dedup(self, docs: DataFrame, row_key: str | None = None, batch: str | None = None) -> DataFrame:
        """Decide on every row of ``docs`` (doc_id, text) and append what is new.

        Returns doc_id, keep_id, group_size, kept, text_sha256, and ``row_key`` if one is named.

        ``batch`` names the batch.  A batch that comes again, because what was to be done with its
        rows failed, is not held against itself: it gets the same result and adds nothing twice.
        Without a name every call is a batch of its own.

        Of equal texts in a batch, the row with the most code points stays, then the smallest
        doc_id, then (with ``row_key``) the smallest key.  A text that an earlier batch had is
        dropped in favour of the earlier row.  group_size counts the batch's rows with that text and
        the rows of the batch that brought the text into the index.

        Null and empty texts, and texts of white space alone, are equal to each other.  A null
        doc_id loses ties against any number.  Without ``row_key``, rows that repeat both doc_id and
        text are all marked kept when that doc_id is kept.  Very long texts are digested whole.  An
        empty table gives no rows and appends none.  Other columns of ``docs``, whatever their
        names, are not read.
        """
        batch = batch or uuid.uuid4().hex
        key = F.col(row_key) if row_key else F.lit(0).cast("long")
        rows = persist(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                key.alias("k"),
                F.length(F.coalesce("text", F.lit(""))).alias("size"),
                text_digest(F.col("text")).alias("digest"),
            ),
            "digests",
        )
        best = F.min(F.struct((-F.col("size")).alias("s"), F.col("doc_id").isNull().alias("z"), "doc_id", "k"))
        groups = persist(
            rows.groupBy("digest").agg(best.alias("b"), F.count(F.lit(1)).alias("n"))
            .select("digest", F.col("b.doc_id").alias("keep_id"), F.col("b.k").alias("keep_key"), "n"),
            "batch",
        )
        earlier = self.read().filter(F.col("batch") != batch)
        fresh = groups.join(earlier.select("digest").hint("merge"), "digest", "left_anti")
        fresh = persist(fresh.withColumn("n_rows", F.col("n")), "fresh")
        seen = groups.join(earlier.select("digest", F.col("keep_id").alias("first"), F.col("n_rows").alias("before")).hint("merge"), "digest")
        seen = seen.select("digest", F.col("first").alias("keep_id"), F.lit(None).cast(rows.schema["k"].dataType).alias("keep_key"), "n", (F.col("n") + F.col("before")).alias("n_rows"))
        decided = persist(fresh.select("digest", "keep_id", "keep_key", "n", "n_rows").unionByName(seen), "decided")
        self.append(fresh, batch)
        joined = looked_up(rows, decided, ["digest"], "n")
        return joined.select(
            "doc_id",
            "keep_id",
            F.col("n_rows").alias("group_size"),
            (F.col("keep_key").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("k") == F.col("keep_key"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            *([F.col("k").alias(row_key)] if row_key else []),
        )


def dedup_documents(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns.

    Null and empty texts are equal, so one of them stays; of repeated rows one stays; very long texts
    are compared whole; an empty table gives no rows.  With ``index``, texts that its earlier batches
    had do not stay; name the ``batch`` so that it can be done again.
    """
    keyed, key = with_row_key(docs)
    if index:
        return keep_rows(keyed, key, index.dedup(keyed, key, batch).filter("kept"))
    with DigestIndex(spark) as own:
        return keep_rows(keyed, key, own.dedup(keyed, key).filter("kept"))
