"""Line deduplication over levelled, sorted runs of line hashes.

``LineRuns`` keeps, per batch of documents, a run: the 128-bit hashes of its lines with the number of documents that
hold them, sorted by hash. When ``fanout`` runs have gathered on a level they are merged into one run of the next, so
a hash is rewritten once per level and only a few runs are open at any time. A new batch merge-anti-joins the runs
(sort-merge on the hash): the lines that come through are kept. The batch then adds its own run.

Two uses are built on it:

* ``drop_frequent``: the batches of one corpus are added first; then all lines are anti-joined with the hashes that
  enough documents hold;
* ``keep_new``: incremental use; a batch keeps the lines that earlier batches held in fewer documents than asked for.

Hashes and counts are combined per task before they are shuffled, so a line that a third of all documents share
reaches a merge as one row per task. Line texts are never shuffled, only hashes and positions; a document's text
moves once, to meet its kept positions.

Defined results: a null or empty text is one empty line; a repeated row counts as a document of its own; keys
shorter than ``min_chars`` are never dropped; a document without kept lines has an empty text; an empty table gives an
empty result. Other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicegrad.llm.common import drop_saved, fresh, saved, text_of
from slicegrad.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case and nothing else; texts in ASCII take the faster built-in way to the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def line_keys(text: Column) -> Column:
    """One key per line: lower-cased and stripped of white space."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds; together unique up to far more lines than a corpus has."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class LineRuns:
    """The levelled runs of one corpus, as tables under the shared scratch folder."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []
        self.owned: list[str] = []

    def add(self, path: str, level: int = 0) -> None:
        """Take over the run at ``path``; merge the level once it is full."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self.add(self._merge(full), level + 1)
            drop_saved(self.spark, *full)

    def add_lines(self, docs: DataFrame, text: str = "text", min_chars: int = 1) -> None:
        """Add the run of one batch of documents."""
        path = scratch_path(self.spark, "run")
        batch_counts(docs, text, min_chars).sortWithinPartitions("h1", "h2").write.parquet(path)
        self.add(path)

    def add_batches(self, docs: DataFrame, batches: int, text: str = "text", min_chars: int = 1) -> None:
        """Add the documents as so many batches; all their runs are made in one pass over the texts."""
        root = scratch_path(self.spark, "runs")
        batch = F.pmod(F.xxhash64(text_of(text)), F.lit(batches)).cast("int")
        counts = batch_counts(docs.select(F.col(f"`{text}`"), batch.alias("sg_batch")), text, min_chars, "sg_batch")
        counts.sortWithinPartitions("sg_batch", "h1", "h2").write.partitionBy("sg_batch").parquet(root)
        self.owned.append(root)
        present = self.spark.read.schema("h1 long, h2 long, n long, sg_batch int").parquet(root).select("sg_batch").distinct()
        for row in present.orderBy("sg_batch").toLocalIterator():  # as many rows as batches
            self.add(f"{root}/sg_batch={row[0]}")

    def _merge(self, paths: list[str]) -> str:
        path = scratch_path(self.spark, "run")
        self._summed(paths).sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def _summed(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        runs = self.spark.read.schema("h1 long, h2 long, n long").parquet(*paths)
        return runs.groupBy("h1", "h2").agg(F.sum("n").alias("n")) if len(paths) > 1 else runs

    def frequent(self, min_docs: int) -> DataFrame:
        """Hashes that at least ``min_docs`` documents of all batches hold."""
        return self._summed([p for level in self.levels for p in level]).filter(F.col("n") >= min_docs).select("h1", "h2")

    def release(self) -> None:
        """Delete all runs."""
        drop_saved(self.spark, *[p for level in self.levels for p in level], *self.owned)
        self.levels, self.owned = [], []


def batch_counts(docs: DataFrame, text: str, min_chars: int, *by: str) -> DataFrame:
    """``h1, h2, n``: documents of a batch that hold a line, a document counting once."""
    key = F.explode(F.array_distinct(line_keys(text_of(text)))).alias("key")
    keys = docs.select(*by, key).filter(F.char_length("key") >= min_chars)
    return keys.select(*by, *key_hash(F.col("key"))).groupBy(*by, "h1", "h2").agg(F.count(F.lit(1)).alias("n"))


def anti_join(docs: DataFrame, hashes: DataFrame, text: str, min_chars: int) -> DataFrame:
    """``docs`` with new columns kept text, ``n_lines`` and ``n_dropped``; lines with one of the ``hashes`` are gone.

    Returns the columns of ``docs``, then the three new ones under the names ``kept``, ``n_lines``, ``n_dropped``,
    altered only where ``docs`` has such columns already.
    """
    kept, n_lines, n_dropped, k1, k2, at = fresh(docs, "kept", "n_lines", "n_dropped", "sg_k1", "sg_k2", "sg_at")
    own = [F.xxhash64(*[F.col(f"`{c}`") for c in _plain(docs)]), F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in _plain(docs)])]
    keyed = docs.withColumn(k1, own[0]).withColumn(k2, own[1])
    lines = keyed.select(k1, k2, F.posexplode(line_keys(text_of(text))).alias(at, "key"))
    lines = lines.select(k1, k2, at, F.char_length("key").alias("size"), *key_hash(F.col("key")))
    through = lines.hint("merge").join(hashes, ["h1", "h2"], "left_anti")
    places = through.groupBy(k1, k2).agg(F.array_sort(F.collect_set(at)).alias(at))  # a set: equal rows share a key
    joined = keyed.join(places, [k1, k2], "left")
    rebuilt = F.transform(
        F.array(F.split(text_of(text), "\n", -1)),  # bound once, then picked from by position
        lambda lines: F.array_join(F.transform(F.coalesce(F.col(at), F.array().cast("array<int>")), lambda p: F.get(lines, p)), "\n"),
    )
    total = F.size(F.split(text_of(text), "\n", -1)).cast("long")
    gone = total - F.coalesce(F.size(at), F.lit(0)).cast("long")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*names, F.get(rebuilt, F.lit(0)).alias(kept), total.alias(n_lines), F.when(F.col(at).isNull(), total).otherwise(gone).alias(n_dropped))


def _plain(docs: DataFrame) -> list[str]:
    """Columns that a hash can cover; maps cannot be hashed and do not matter for telling rows with equal texts apart."""
    return [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]


def drop_frequent(docs: DataFrame, min_docs: int, *, text: str = "text", min_chars: int = 1, batches: int = 4, fanout: int = 4) -> DataFrame:
    """Drop, in every document, all lines whose key at least ``min_docs`` documents hold."""
    runs = LineRuns(docs.sparkSession, fanout)
    runs.add_batches(docs, batches, text, min_chars)
    hashes, _ = saved(runs.frequent(min_docs), "frequent-lines")
    runs.release()
    return anti_join(docs, hashes, text, min_chars)


def keep_new(docs: DataFrame, runs: LineRuns, *, text: str = "text", min_docs: int = 1, min_chars: int = 1) -> DataFrame:
    """Drop the lines that earlier batches hold in ``min_docs`` documents or more; then add this batch to the runs."""
    hashes, _ = saved(runs.frequent(min_docs), "seen-lines")
    out = anti_join(docs, hashes, text, min_chars)
    runs.add_lines(docs, text, min_chars)
    return out
