"""Exact dedup with a log-structured merge index of digests. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import KeyFilter, ascii_lower, key_filter, with_maybe
from tidemark.sources.scratch import cut, forget, new_path


def sha256_digest(text: Column) -> Column:
    """32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


#: Memtables of one input, and runs of a level that are merged into one of the next.
MEMTABLES, FAN = 4, 2
#: Hits of one digest are verified in groups of about so many rows.
GROUP = 2000


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class DigestIndex:
    """Sorted runs of ``digest, keep_id, n`` in the shared folder, in levels.

    ``flush`` writes a memtable as a run of level 0: a sorted file for each of its splits, with the digests' range and
    a Parquet Bloom filter for look-ups of a few digests. When a level has ``fan`` runs they are merged into one run of the
    next: a row for each digest with its smallest (or largest) identifier, dealt by ranges of digests, so
    that its files don't overlap. ``compact`` merges all levels into one run. Merged runs are deleted.

    ``filter`` is what whole tables ask: a bounded bit table of the digests that more than one row has.
    """

    def __init__(self, spark: SparkSession, path: str, keep: str = "min", id_type: str = "bigint", fan: int = 8):
        self.spark, self.path, self.keep, self.id_type, self.fan = spark, path, keep, id_type, fan
        self.levels: list[list[str]] = [[]]
        self.count = 0

    @property
    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _write(self, df: DataFrame, level: int, per_file: int) -> str:
        self.count += 1
        run = f"{self.path}/level{level}/run-{self.count:05d}"
        (
            df.sortWithinPartitions("digest")
            .write.option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.expected.ndv#digest", str(per_file))
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .option("compression", "zstd")
            .parquet(run)
        )
        return run

    def read(self, *runs: str) -> DataFrame:
        return self.spark.read.schema(f"digest binary, keep_id {self.id_type}, n long").parquet(*runs)

    def flush(self, docs: DataFrame, per_file: int = 200_000) -> DataFrame:
        """Adds rows ``doc_id, digest``, about ``per_file`` in a split; gives them back as ``digest, keep_id, n``."""
        run = self._write(docs.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")), 0, per_file)
        back = self.read(run)
        self.levels[0].append(run)
        level = 0
        while len(self.levels[level]) >= self.fan:
            self._merge([level], level + 1)
            level += 1
        return back

    def _merge(self, levels: list[int], into: int) -> None:
        """Equal digests meet after a map-side combine, so a digest that a third of all rows have reaches its task as
        one row from each map task."""
        best = F.min if self.keep == "min" else F.max
        old = [run for k in levels for run in self.levels[k]]
        merged = self.read(*old).groupBy("digest").agg(best("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        run = self._write(merged.repartitionByRange("digest"), into, 200_000)
        for k in levels:
            self.levels[k] = []
        self.levels += [[] for _ in range(into + 1 - len(self.levels))]
        self.levels[into].append(run)
        for path in old:
            _delete(self.spark, path)

    def compact(self) -> DataFrame:
        """All runs as one, in a level of its own."""
        self._merge(list(range(len(self.levels))), len(self.levels))
        return self.read(*self.runs)

    def filter(self) -> KeyFilter:
        """Of the digests with several rows, after ``compact``. What it lets pass has such a digest but for one row in 32."""
        return key_filter(self.read(*self.runs).filter("n > 1"), "digest")

    def lookup(self, digest: bytes) -> DataFrame:
        """The index rows of one digest; run ranges and filters skip the files that can't have it."""
        return self.read(*self.runs).filter(F.col("digest") == F.lit(bytearray(digest)))

    def drop(self) -> None:
        """Deletes the index, once nothing that is still to run reads it."""
        _delete(self.spark, self.path)


def exact_dedup(docs: DataFrame, keep: str = "max", digest=sha256_digest, path: str | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the largest (``keep="max"``) or smallest ``doc_id`` stays; ids may be of any type that has an
    order. Rows that repeat both id and text are one document: each counts in ``group_size``, and they
    stay together. Null ids stay only where no row of the group has an id. ``text_sha256`` is the digest in
    hexadecimal. No rows give none; columns beside ``doc_id`` and ``text`` are ignored.

    Hits (rows whose digest another row has) are compared byte for byte with the row that stays.
    Only their texts are shuffled, by id and then by digest and salt: a digest of very many rows is
    verified in groups of GROUP, each with its own copy of the one text that stays. Should bytes
    differ under one digest, the rows of that digest are grouped by the text itself.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, path or new_path(spark, "digest-index"), keep, docs.schema["doc_id"].dataType.simpleString(), FAN)
    best = F.min if keep == "min" else F.max

    def normal(df: DataFrame) -> DataFrame:
        return df.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm")).withColumn("digest", digest(F.col("norm")))

    # Texts are hashed once; the table is parted by memtable.
    hashed = normal(docs).select("doc_id", "digest", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(MEMTABLES)).cast("int").alias("_memtable"))
    where = new_path(spark, "digests")
    hashed.write.partitionBy("_memtable").option("compression", "zstd").parquet(where)
    rows = spark.read.schema(hashed.schema).parquet(where)
    for k in range(MEMTABLES):
        index.flush(rows.filter(F.col("_memtable") == k))
    index.compact()
    # Rows ask the filter: those that it turns away are their own group, and only the others meet the index.
    asked = with_maybe(rows.select("doc_id", "digest"), index.filter(), "_maybe", "digest")
    alone = asked.filter("not _maybe").select("digest", "doc_id", F.lit(None).cast(index.id_type).alias("keep_id"), F.lit(1).cast("long").alias("n"))
    repeated = index.read(*index.runs).filter("n > 1")
    met = asked.filter("_maybe").select("digest", "doc_id").join(repeated, "digest", "left")
    found = cut(alone.unionByName(met), "looked-up")
    _delete(spark, where)
    if path is None:
        index.drop()

    hits = cut(found.filter("n > 1").groupBy("doc_id", "digest").agg(F.first("keep_id").alias("keep_id"), F.first("n").alias("n")), "hits")
    few = normal(with_maybe(docs.select("doc_id", "text"), key_filter(hits, "doc_id"), "_maybe", "doc_id").filter("_maybe")).alias("t")
    same = (F.col("t.digest") == F.col("h.digest")) & F.col("t.doc_id").eqNullSafe(F.col("h.doc_id"))
    salts = F.ceil(F.col("n") / GROUP)
    texts = few.join(hits.alias("h"), same).select("h.*", "norm").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), salts))
    texts = cut(texts, "hit-texts")
    stays = texts.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("norm").alias("kept_norm"), F.first("n").alias("n"))
    stays = stays.select("digest", "kept_norm", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("_salt"))
    differ = cut(texts.join(stays, ["digest", "_salt"], "left").filter(~F.col("norm").eqNullSafe(F.col("kept_norm"))).select("digest").distinct(), "collisions")

    def result(joined: DataFrame) -> DataFrame:
        keep_id = F.when(F.col("n") > 1, F.col("keep_id")).otherwise(F.col("doc_id"))
        return joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    none = differ.isEmpty()
    forget(hits, texts)
    if none:
        return result(found)
    clash = normal(docs).join(differ, "digest", "left_semi")
    groups = clash.groupBy("digest", "norm").agg(best("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return result(found.join(differ, "digest", "left_anti")).unionByName(result(clash.join(groups, ["digest", "norm"])))
