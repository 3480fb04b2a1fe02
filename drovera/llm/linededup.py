"""Line dedup over levelled sorted runs of line hashes (DataFrame operations only).

A run is a Parquet table ``(h1, h2, n_docs, keeper)`` with one row per line hash, hash-partitioned
and sorted by it. Each batch of documents is reduced to one row per hash and merged against the runs:
hashes that no run holds (anti-join) become a run of level 0, further counts of known hashes
(semi-join) become another. When a level holds ``FANOUT`` runs they are compacted into one run of the
next level, so a hash is rewritten once per level.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stage

MIN_CHARS = 40
MIN_DOCS = 5
FANOUT = 4
#: The third batch makes the first compaction, the fourth is merged against a compacted run.
BATCHES = 4
_KEY = ["h1", "h2"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at both ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(_BLANKS)), _UPPER, _LOWER)


def _ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; ``lower`` where it can't touch other letters, as it is many times faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _keys(text: Column) -> Column:
    """Keys of all lines of a text, in order."""
    return F.transform(F.split(_ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda x: F.trim(x, F.lit(_BLANKS)))


def _hashes(key: Column) -> Column:
    """128 bits of a key."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


class LineRuns:
    """Levelled runs of line hashes."""

    def __init__(self, fanout: int = FANOUT) -> None:
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.fanout = fanout
        self.levels: dict[int, list[DataFrame]] = defaultdict(list)

    def runs(self) -> list[DataFrame]:
        return [run for level in sorted(self.levels) for run in self.levels[level]]

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*_KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    @staticmethod
    def _write(rows: DataFrame, label: str) -> DataFrame:
        return stage(rows.sortWithinPartitions(*_KEY), label)

    def add(self, lines: DataFrame) -> None:
        """Take a batch ``(doc_id, h1, h2)``, each hash once per document."""
        batch = lines.groupBy(*_KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        known = self.runs()
        if not known:
            self.levels[0].append(self._write(batch, "run"))
        else:
            batch = stage(batch, "batch")
            seen = reduce(DataFrame.unionAll, [run.select(*_KEY) for run in known])
            fresh = batch.join(seen, _KEY, "left_anti")
            again = batch.join(seen, _KEY, "left_semi")
            self.levels[0] += [self._write(fresh, "run"), self._write(again, "run")]
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._merged(reduce(DataFrame.unionAll, self.levels[level]))
            self.levels[level] = []
            self.levels[level + 1].append(self._write(merged, "run"))
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """``(h1, h2, keeper)`` of hashes found in at least ``min_docs`` documents."""
        rows = reduce(DataFrame.unionAll, self.runs())
        return self._merged(rows).where(F.col("n_docs") >= min_docs).select(*_KEY, "keeper")


def _decide(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """``(i, none, t, gone)``: for each document with lines to drop, the hashes of their keys."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tag", _tag(F.col("doc_id"), F.col("text")))
    hashes = F.array_distinct(
        F.transform(F.filter(_keys(F.col("text")), lambda k: F.char_length(k) >= min_chars), _hashes)
    )
    lines = stage(rows.select("doc_id", "tag", F.explode(hashes).alias("h")).select("doc_id", "tag", "h.h1", "h.h2"), "lines")
    runs = LineRuns()
    for k in range(batches):
        runs.add(lines.where(F.pmod(F.xxhash64("doc_id", "tag"), F.lit(batches)) == k))
    common = stage(runs.frequent(min_docs), "frequent")
    return (
        lines.join(common, _KEY)
        .where("keeper is not null and (doc_id is null or doc_id < keeper)")
        .groupBy(*_ident(F.col("doc_id"), F.col("tag"))).agg(F.collect_set("h1").alias("__gone"))
    )


def _tag(doc_id: Column, text: Column) -> Column:
    """Tells documents without an id apart by their text."""
    return F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def _ident(doc_id: Column, tag: Column) -> list[Column]:
    return [F.coalesce(doc_id, F.lit(0).cast("long")).alias("__i"), doc_id.isNull().alias("__none"), tag.alias("__t")]


def drop_common_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
) -> DataFrame:
    """``docs`` with all its columns and ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line whose key has ``min_chars`` code points or more and stands in at least ``min_docs``
    documents stays only in the document with the largest id that holds it. Null texts count as
    empty, and an empty text has one empty line. Rows are documents: a repeated row counts again,
    and all rows with the largest id keep the line. Lines of a document without an id go unless no
    document with an id holds them. An empty table gives no rows. Columns of ``docs`` with a new
    column's name are replaced.
    """
    drops = _decide(docs, id_col, text_col, min_chars, min_docs, batches)
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumn("__text", text).select("*", *_ident(doc_id, _tag(doc_id, F.col("__text"))))
    lines = F.split("__text", "\n", -1)
    keep = F.filter(
        F.arrays_zip(lines.alias("line"), _keys(F.col("__text")).alias("key")),
        lambda z: ~((F.char_length(z["key"]) >= min_chars) & F.array_contains("__gone", F.xxhash64(z["key"]))),
    )
    kept = F.when(F.col("__gone").isNull(), F.struct(F.lit(0).alias("n"), F.col("__text").alias("text"))).otherwise(
        F.transform(F.array(keep), lambda a: F.struct(
            (F.size(lines) - F.size(a)).alias("n"), F.array_join(F.transform(a, lambda z: z["line"]), "\n").alias("text"),
        ))[0]
    )
    joined = marked.join(drops, ["__i", "__none", "__t"], "left").withColumn("__k", kept)
    return joined.withColumns({
        "n_lines": F.size(lines).cast("long"), "n_dropped": F.col("__k.n").cast("long"), "kept_text": F.col("__k.text"),
    }).drop("__i", "__none", "__t", "__text", "__gone", "__k")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """One row per document: ``doc_id``, ``n_lines``, ``n_dropped``, ``kept_text``; see ``drop_common_lines``."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return drop_common_lines(own, **settings).select("doc_id", "n_lines", "n_dropped", "kept_text")
