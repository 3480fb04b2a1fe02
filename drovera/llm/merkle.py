"""WARC records and a Merkle audit of their replicas."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import stage

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
FILE_BITS = 10
FILE_RECORDS = 1 << FILE_BITS
_DATE = "2024-01-01T00:00:00Z"


def record_bytes(url: Column, body: Column) -> Column:
    """A WARC/1.1 response record of an HTTP answer with this body; nulls count as empty."""
    body = F.coalesce(body.cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body), F.lit("\r\n\r\n"), body)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")),
        F.lit(f"\r\nWARC-Date: {_DATE}\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha256:"),
        F.sha2(body, 256), F.lit("\r\nContent-Length: "), F.octet_length(http), F.lit("\r\n\r\n"),
    )
    return F.concat(head, http, F.lit("\r\n\r\n"))


def parse_warc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an uncompressed WARC file; a cut record ends it."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers.get("content-length", "0") or 0)
        if end + 4 + size > len(data):
            return
        yield at, headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzipped: ``path offset type url block``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                data = gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c
                rows = [(p, at, h.get("warc-type"), h.get("warc-target-uri"), block) for at, h, block in parse_warc(data)]
                yield pd.DataFrame(rows, columns=["path", "offset", "type", "url", "block"])

    return files.mapInPandas(work, "path string, offset long, type string, url string, block binary")


def lay_out(records: DataFrame, id_col: str) -> DataFrame:
    """``(id, record)`` to ``(file, seq, id, size, digest)``: files of about ``FILE_RECORDS`` records.

    A record's file follows from its id alone, its place from the id and the digest, so two
    replicas line up whatever their row order. Records without an id spread over files by digest.
    """
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.octet_length("record").cast("long").alias("size"), F.sha2("record", 256).alias("digest"))
    return rows.select(
        F.coalesce(F.shiftright("id", FILE_BITS), -1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 20))).alias("file"),
        F.coalesce(F.pmod("id", F.lit(FILE_RECORDS)), F.lit(0)).cast("long").alias("slot"), "id", "size", "digest",
    )


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above: a node hashes up to ``FANOUT`` children in order."""
    kids = F.array_sort(F.collect_list(F.struct("node", "digest")))
    return nodes.groupBy("replica", "file", F.shiftright("node", FANOUT_BITS).alias("up")).agg(
        F.sha2(F.array_join(F.transform(kids, lambda k: F.concat(k["node"].cast("string"), F.lit(":"), k["digest"])), ";"), 256).alias("digest"),
        F.sum("size").alias("size"), F.sum("records").alias("records"),
    ).withColumnRenamed("up", "node")


def audit(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """Records that two replicas ``(id, record)`` do not share.

    One row per differing id: ``id, file, offset_a, size_a, size_b, digest_a, digest_b, status``
    (``changed``, ``missing`` from b, ``extra`` in b). Records are hashed into leaves, ``FANOUT``
    neighbours into a node, up to one root per file and one over all files. Only children of nodes
    whose hashes differ are compared further, so equal branches end at their root. ``offset_a`` is
    where the first record of the differing leaf range starts in the file. Repeated rows of an id
    form one leaf, whatever their order, of all their kinds and counts; records without an id are
    leaves by content, id null. Two
    empty replicas give no rows.
    """
    both = lay_out(a, id_col).withColumn("replica", F.lit("a")).unionAll(lay_out(b, id_col).withColumn("replica", F.lit("b")))
    # Equal rows of an id are counted before they meet.
    kinds = both.groupBy("replica", "file", F.col("slot").alias("node"), "digest").agg(
        F.min("id").alias("id"), F.sum("size").alias("size"), F.count("*").alias("records")
    )
    leaves = kinds.groupBy("replica", "file", "node").agg(
        F.min("id").alias("id"), F.sum("size").alias("size"), F.sum("records").alias("records"),
        F.array_sort(F.collect_list(F.struct("digest", "records"))).alias("kinds"),
    ).select("*", F.when(
        (F.size("kinds") == 1) & (F.col("records") == 1), F.col("kinds")[0]["digest"]
    ).otherwise(F.sha2(F.to_json("kinds"), 256)).alias("digest")).drop("kinds")
    leaves = stage(leaves, "leaves")
    inside = [leaves.drop("id")]
    depth, reach = 0, 1
    while reach < FILE_RECORDS:
        inside.append(stage(_parents(inside[-1]), f"level{depth}"))
        depth, reach = depth + 1, reach * FANOUT
    # From here a node is a file, and the tree goes on over files until one node is left.
    files = inside[-1].select("replica", F.lit(0).cast("long").alias("file"), F.col("file").alias("node"), "digest", "size", "records")
    above = [files]
    wide = files.agg(F.min("node").alias("low"), F.max("node").alias("high")).first()
    low, high = wide["low"] or 0, wide["high"] or 0
    while low // FANOUT != low or high // FANOUT != high:
        above.append(stage(_parents(above[-1]), "files"))
        low, high = low // FANOUT, high // FANOUT

    def differing(nodes: DataFrame) -> DataFrame:
        of = lambda r: F.max(F.when(F.col("replica") == r, F.col("digest")))  # noqa: E731  one row per replica and node
        both = nodes.groupBy("file", "node").agg(of("a").alias("da"), of("b").alias("db"))
        return both.where(~F.col("da").eqNullSafe(F.col("db"))).select("file", "node")

    def descend(bad: DataFrame, nodes: DataFrame) -> DataFrame:
        under = bad.select("file", F.col("node").alias("up"))
        kids = nodes.withColumn("up", F.shiftright("node", FANOUT_BITS)).join(under, ["file", "up"], "left_semi").drop("up")
        return differing(kids)

    bad = differing(above[-1])
    for nodes in reversed(above[:-1]):
        bad = descend(bad, nodes)
    bad = bad.select(F.col("node").alias("file"), F.lit(0).cast("long").alias("node"))
    bad = differing(inside[-1].join(bad, ["file", "node"], "left_semi"))
    for nodes in reversed(inside[:-1]):
        bad = descend(bad, nodes)
    ranges = stage(bad, "differing")
    # Offsets of the leaves before a differing one, in its file only.
    before = Window.partitionBy("file").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    touched = leaves.where("replica = 'a'").join(ranges.select("file").distinct(), "file", "left_semi")
    starts = touched.select("file", "node", F.sum("size").over(before).alias("offset_a")).join(ranges, ["file", "node"], "left_semi")
    x = leaves.where("replica = 'a'").join(ranges, ["file", "node"], "left_semi").select("file", "node", F.col("id").alias("id_a"), F.col("size").alias("size_a"), F.col("digest").alias("digest_a"))
    y = leaves.where("replica = 'b'").join(ranges, ["file", "node"], "left_semi").select("file", "node", F.col("id").alias("id_b"), F.col("size").alias("size_b"), F.col("digest").alias("digest_b"))
    return x.join(y, ["file", "node"], "full").join(starts, ["file", "node"], "left").select(
        F.coalesce("id_a", "id_b").alias("id"), "file", F.coalesce("offset_a", F.lit(0).cast("long")).alias("offset_a"),
        "size_a", "size_b", "digest_a", "digest_b",
        F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed").alias("status"),
    )
