"""WARC fixity: Merkle trees over the records of a collection, compared between replicas.

Leaves are records in the order of their key; a node covers ``FANOUT`` neighbours, so each stands for a range of offsets.  A
leaf's digest is that of the record's bytes, a node's that of its children's digests in order.  An audit compares the roots and goes
down only where digests differ.  Offsets and positions are sums over buckets of the key, so no task sees all records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mark, saved, sweep, table
from .ordering import bucket_of, cuts

FANOUT = 16


def warc_record(url: Column, record_id: Column, body: Column) -> Column:
    """A WARC/1.1 resource record as text; null parts count as empty."""
    body = F.coalesce(body, F.lit(""))
    size = F.octet_length(body).cast("string")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(body.cast("binary"), 256), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), size, F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(records: DataFrame) -> DataFrame:
    """(key, node, begin, end, digest) for each record of ``records`` (key: integer, record: text or binary), in order of the key.

    node is the record's position from 0, begin and end its offsets in bytes.  Null keys come first, equal keys in the order of
    their bytes; null records are empty.
    """
    raw = F.coalesce(F.col("record").cast("binary"), F.lit(b""))
    rows = records.select("key", F.octet_length(raw).cast("long").alias("size"), F.sha2(raw, 256).alias("digest"))
    rows = rows.withColumn("bucket", bucket_of(F.col("key"), cuts(records, F.col("key"))))
    rows = saved(rows, "records")
    total = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    start = total.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"))
    own = Window.partitionBy("bucket").orderBy(F.col("key").asc_nulls_first(), "digest", "size")
    run = rows.withColumn("i", F.row_number().over(own) - 1).withColumn("end", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return run.join(start, "bucket").select("key", (F.col("n0") + F.col("i")).cast("long").alias("node"), (F.col("b0") + F.col("end") - F.col("size")).alias("begin"), (F.col("b0") + F.col("end")).alias("end"), "digest")


def _above(level: DataFrame, fanout: int) -> DataFrame:
    up = level.groupBy(F.floor(F.col("node") / fanout).alias("node")).agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("below"),
    )
    return saved(up.select(F.lit(None).cast("long").alias("key"), "node", "begin", "end", F.sha2(F.array_join("below.digest", "").cast("binary"), 256).alias("digest")), "tree")


def merkle_tree(records: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of the tree, leaves first, the root (one node) last; an empty collection has one level without nodes."""
    level = saved(leaves(records), "tree")
    out, size = [level], level.count()
    while size > 1:
        level = _above(level, fanout)
        out.append(level)
        size = -(-size // fanout)
    return out


def audit(ours: list[DataFrame], theirs: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """The roots, and below them every node whose digests differ: level, node, key, begin, end, digest and replica_digest.

    Level 0 has the damaged records.  A node that one replica lacks has null there.  The lower of two trees is raised by nodes
    of one child each, so that both have a root on the same level; of an empty replica every node is lacking.
    """
    ours, theirs = list(ours), list(theirs)
    for tree, other in ((ours, theirs), (theirs, ours)):
        while len(tree) < len(other):
            tree.append(_above(tree[-1], fanout))
    found = []
    open_nodes: DataFrame | None = None
    for level in reversed(range(len(ours))):
        a = ours[level]
        b = theirs[level].select("node", F.col("digest").alias("replica_digest"), F.col("begin").alias("begin_b"), F.col("end").alias("end_b"), F.col("key").alias("key_b"))
        if open_nodes is not None:
            a, b = (x.withColumn("parent", F.floor(F.col("node") / fanout)).join(open_nodes, "parent", "left_semi").drop("parent") for x in (a, b))
        both = a.join(b, "node", "full_outer")
        both = both.select(F.lit(level).alias("level"), "node", F.coalesce("key", "key_b").alias("key"), F.coalesce("begin", "begin_b").alias("begin"), F.coalesce("end", "end_b").alias("end"), "digest", "replica_digest")
        differ = ~F.col("digest").eqNullSafe(F.col("replica_digest"))
        here = saved(both if open_nodes is None else both.where(differ), "audit")
        found.append(here)
        open_nodes = here.where(differ).select(F.col("node").alias("parent"))
    return reduce(DataFrame.unionByName, found)


def page_records(pages: DataFrame, damaged: bool = False) -> DataFrame:
    """WARC records of ``pages``; the damaged copy has one character changed in the page of every 97th id."""
    html = F.coalesce("html", F.lit(""))
    if damaged:
        middle = (F.length(html) / 2).cast("int") + 1
        other = F.when(F.substring(html, middle, F.lit(1)) == "~", "#").otherwise("~")
        html = F.when((F.col("page_id") % 97 == 5) & (F.length(html) > 0), F.concat(F.substring(html, F.lit(1), middle - 1), other, F.substring(html, middle + 1, F.length(html)))).otherwise(html)
    return pages.select(F.col("page_id").alias("key"), warc_record(F.col("url"), F.col("page_id"), html).alias("record"))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the pages' records against a replica in which some are damaged."""
    pages, since = table(spark, sf_dir, "pages"), mark()
    found = audit(merkle_tree(page_records(pages)), merkle_tree(page_records(pages, damaged=True)))
    sweep(spark, since, "audit")
    return found.withColumn("key", F.coalesce("key", F.lit(-1)))  # -1: an inner node


def _sql(levels: int = 7) -> str:
    record = "'WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:' || page_id || '>\r\nWARC-Target-URI: ' || coalesce(url, '') || '\r\nWARC-Payload-Digest: sha256:' || sha256(h) || '\r\nContent-Type: text/html\r\nContent-Length: ' || strlen(h) || '\r\n\r\n' || h || '\r\n\r\n'"
    m = "CAST(floor(length(h) / 2) AS BIGINT) + 1"
    harm = f"CASE WHEN page_id % 97 = 5 AND length(h) > 0 THEN left(h, {m} - 1) || CASE WHEN substr(h, {m}, 1) = '~' THEN '#' ELSE '~' END || substr(h, {m} + 1) ELSE h END"
    out = ["WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages)", f"q AS (SELECT page_id, url, {harm} AS h FROM p)"]
    for name, source in (("a", "p"), ("b", "q")):
        out.append(f"{name}r AS (SELECT page_id, {record} AS rec FROM {source})")
        out.append(f"{name}0 AS (SELECT page_id AS key, row_number() OVER (ORDER BY page_id) - 1 AS node, sum(strlen(rec)) OVER (ORDER BY page_id) - strlen(rec) AS b, sum(strlen(rec)) OVER (ORDER BY page_id) AS e, sha256(rec) AS d FROM {name}r)")
        for k in range(1, levels):
            out.append(f"{name}{k} AS (SELECT NULL::BIGINT AS key, node // {FANOUT} AS node, min(b) AS b, max(e) AS e, sha256(string_agg(d, '' ORDER BY node)) AS d FROM {name}{k - 1} GROUP BY node // {FANOUT} HAVING (SELECT count(*) FROM {name}{k - 1}) > 1)")
    rows = " UNION ALL ".join(
        f"SELECT {k} AS level, a.node, a.key, CAST(a.b AS BIGINT) AS begin, CAST(a.e AS BIGINT) AS end, a.d AS digest, b.d AS replica_digest FROM a{k} a JOIN b{k} b USING (node) WHERE a.d <> b.d OR (SELECT count(*) FROM a{k}) = 1" for k in range(levels)
    )
    return ", ".join(out) + f" SELECT level, node, coalesce(key, -1) AS key, begin, \"end\", digest, replica_digest FROM ({rows.replace(' AS end,', ' AS \"end\",')})"


OP10_SQL = _sql()
