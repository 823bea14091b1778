"""Operator 9: WARC records and a Merkle fixity audit of replicas.

Pages become WARC/1.1 response records, stored in the order of their keys and, within a key, of
their digests. A radix tree over the keys has at its leaves the records of one key and at
each level above nodes of ordered ranges; a node holds the hash of its children's hashes in
order, its bytes and so, with its elder siblings, its offset range. Trees are built by
grouping level by level, which combines within tasks before each shuffle; there is no
global sort, and no group has more children than `LEVELS` allows. The records of a key are
reduced to sums of parts of their hashes, and placed by two levels of digits of their
digests, so that a key that holds most rows is not gathered either.

An audit compares two trees from the roots, follows only nodes that differ, and under a key
that differs names the records that the replica lacks.

Defined cases: a null html, url or key is the empty text (a null key sorts first); line breaks in
a url are percent-encoded; records that are equal and share a key are one row with their
number, and differ from the replica if that differs; an empty table has a tree without
nodes; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Hex digits that each level takes off a key of 16, from the leaves up: nodes of the two
#: lowest levels, where the rows are, have up to 256 children, the others up to 65,536.
LEVELS = (2, 2, 4, 4, 4)


#: Digits of a digest by which the records of one key are placed: so many groups, and as many in each.
PLACED = 3
#: The time of capture that records tell where the pages have none.
DATE = "1970-01-01T00:00:00Z"


def records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", date: Column | None = None) -> DataFrame:
    """key and the bytes of a WARC/1.1 response record for every page: an HTTP response without
    further headers."""
    target = F.replace(F.replace(F.coalesce(F.col(url), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    content = F.coalesce(F.col(body), F.lit(""))
    size = F.octet_length(content)
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    name = F.sha2(F.concat_ws("\n", F.coalesce(F.col(key).cast("string"), F.lit("")), target).cast("binary"), 256)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:sha256:"), name, F.lit(">\r\nWARC-Date: "), F.lit(DATE) if date is None else date,
        F.lit("\r\nWARC-Target-URI: "), target, F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(content.cast("binary"), 256),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), (size + F.octet_length(answer)).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(F.col(key).cast("long").alias("key"), F.concat(head, answer, content, F.lit("\r\n\r\n")).alias("record"))


def parse(data: bytes):
    """The records of a WARC file: (offset, headers, block) of each. Raises ValueError where one is cut
    off or is none."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at {at}")
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        begin = end + 4
        stop = begin + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end")
        yield at, headers, data[begin:stop]
        at = stop + 4


def read(spark: SparkSession, folder: str) -> DataFrame:
    """path, offset, type, uri, payload_digest and block of the records of uncompressed WARC files. A
    task holds one file at a time."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for at, headers, block in parse(content):
                    row = [path, at, headers.get("warc-type"), headers.get("warc-target-uri"), headers.get("warc-payload-digest"), block]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    names, kinds = ["path", "offset", "type", "uri", "payload_digest", "block"], [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    files = C.tune(spark).read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, "path string, offset long, type string, uri string, payload_digest string, block binary")


def _ordered(key: Column) -> Column:
    """Keys as numbers of 16 hex digits that sort as the keys do; null is 16 zeros' elder."""
    shifted = F.lpad(F.hex(key.bitwiseXOR(F.lit(-(2**63)).cast("long"))), 16, "0")
    return F.when(key.isNull(), F.lit("")).otherwise(shifted)


def digests(stored: DataFrame) -> DataFrame:
    """A row for each key and record: path, digest, bytes and number of equal records."""
    rows = stored.select(_ordered(F.col("key")).alias("path"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"), F.octet_length("record").cast("long").alias("bytes"))
    return rows.groupBy("path", "digest").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("records"))


def leaves(found: DataFrame) -> DataFrame:
    """A row for each key: path, hash, bytes and number of records."""
    part = lambda k: F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") * F.col("records").cast("decimal(18,0)")
    sums = found.groupBy("path").agg(*[F.sum(part(k)).alias(f"h{k}") for k in range(4)], F.sum("bytes").alias("bytes"), F.sum("records").alias("records"))
    return sums.select("path", F.sha2(F.concat_ws(":", "path", "h0", "h1", "h2", "h3", "records").cast("binary"), 256).alias("hash"), "bytes", "records")


def _parent(digits: int) -> Column:
    return F.when(F.col("path") == "", F.lit("")).otherwise(F.expr(f"substring(path, 1, length(path) - {digits})"))


def parents(level: DataFrame, digits: int) -> DataFrame:
    """The nodes one level up: a path is some hex digits shorter."""
    grouped = level.groupBy(_parent(digits).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("path", "hash"))).alias("children"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records"))
    text = F.array_join(F.transform("children", lambda c: F.concat(c["path"], F.lit("="), c["hash"])), ",")
    return grouped.select(F.col("parent").alias("path"), F.sha2(text.cast("binary"), 256).alias("hash"), "bytes", "records")


def tree(stored: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The digests of the records, and the levels of the tree, leaves first, the root last. Both are
    checkpointed; they hold some dozen bytes per record and key."""
    found = C.checkpoint(digests(stored))
    out = [C.checkpoint(leaves(found))]
    for digits in LEVELS:
        out.append(C.checkpoint(parents(out[-1], digits)))
    return found, out


def offsets(levels: list[DataFrame]) -> DataFrame:
    """The leaves with the offset at which each range begins: down the tree, a node begins
    where its parent does, after its elder siblings."""
    above = levels[-1].select("path", F.lit(0).cast("long").alias("offset"))
    for level, digits in zip(levels[-2::-1], LEVELS[::-1], strict=True):
        nodes = level.withColumn("parent", _parent(digits))
        elder = F.coalesce(F.sum("bytes").over(Window.partitionBy("parent").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = nodes.withColumn("before", elder).join(above.select(F.col("path").alias("parent"), F.col("offset").alias("start")), "parent")
        above = placed.select("path", (F.col("start") + F.col("before")).alias("offset"))
    return levels[0].join(above, "path")


def placed(found: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The records with the offset at which each begins (or the first of equal ones): after those of
    its key with a lesser digest, which are counted by groups of their first digits."""
    near = [F.substring("digest", 1, k * PLACED) for k in (1, 2)]
    rows = found.withColumn("a", near[0]).withColumn("b", near[1])
    elder = lambda *by: Window.partitionBy("path", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("path", "a", "b").agg(F.sum("bytes").alias("bytes"))
    tops = groups.groupBy("path", "a").agg(F.sum("bytes").alias("bytes")).withColumn("top", F.coalesce(F.sum("bytes").over(elder("a")), F.lit(0))).drop("bytes")
    groups = groups.withColumn("middle", F.coalesce(F.sum("bytes").over(elder("a", "b")), F.lit(0))).drop("bytes")
    own = rows.withColumn("own", F.coalesce(F.sum("bytes").over(elder("a", "b", "digest")), F.lit(0)))
    begun = C.join_hot(own.join(groups, ["path", "a", "b"]).join(tops, ["path", "a"]), offsets(levels).select("path", "offset"), "path")
    return begun.select("path", "digest", "bytes", "records", (F.col("offset") + F.col("top") + F.col("middle") + F.col("own")).alias("offset"))


def fixity(stored: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of `stored` (key, record) with its place and whether the replica has as many: path,
    digest, bytes, records, offset, corrupt."""
    (ours, levels), (theirs, others) = tree(stored), tree(replica)
    keys = C.checkpoint(audit(levels, others).select("path", F.lit(True).alias("differs")))
    own = C.join_hot(placed(ours, levels), keys, "path", "left")
    there = C.join_hot(theirs, keys, "path").select("path", "digest", F.col("records").alias("held"))
    told = own.join(there, ["path", "digest"], "left")
    corrupt = F.coalesce(F.col("differs"), F.lit(False)) & ~F.col("records").eqNullSafe(F.col("held"))
    return told.select("path", "digest", "bytes", "records", "offset", corrupt.alias("corrupt"))


def audit(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """The leaves (paths) at which two trees differ, found from the roots by following only
    nodes whose hashes differ: path, left_hash, right_hash (null where a side has no node)."""
    differing = None
    for a, b, digits in zip(left[::-1], right[::-1], (0, *LEVELS[::-1]), strict=True):
        if differing is not None:
            a, b = (x.withColumn("parent", _parent(digits)).join(differing, "parent", "left_semi") for x in (a, b))
        both = a.select("path", F.col("hash").alias("left_hash")).join(b.select("path", F.col("hash").alias("right_hash")), "path", "full")
        found = both.filter(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
        differing = found.select(F.col("path").alias("parent"))
    return found


def decayed(stored: DataFrame, every: int = 101) -> DataFrame:
    """A replica with planted decay: in each record whose SHA-256 has first seven digits that are a
    multiple of `every`, the last byte but four is another. For audits of a table that has no replica."""
    digits = F.substring(F.sha2(F.col("record").cast("binary"), 256), 1, 7)
    hit = F.conv(digits, 16, 10).cast("long") % every == 0
    return stored.select("key", F.when(hit, F.concat(F.expr("substring(record, 1, length(record) - 5)"), F.lit("\x00"), F.expr("right(record, 4)"))).otherwise(F.col("record")).alias("record"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each record of `pages`: its offset range, its hash, and whether the audit finds its
    replica corrupt."""
    stored = records(C.table(spark, sf_dir, "pages"))
    key = F.when(F.col("path") == "", F.lit(None)).otherwise(F.conv("path", 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long")))
    found = fixity(stored, decayed(stored))
    return found.select(key.alias("page_id"), "offset", F.col("bytes").alias("n_bytes"), F.col("records").alias("n_records"), F.col("digest").alias("record_hash"), "corrupt")


#: The same without a tree: hashes of all records, running offsets, and records that the rule decays.
_ORACLE = r"""
WITH content AS (SELECT page_id::BIGINT AS key, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS url, coalesce(html, '') AS html FROM pages),
answers AS (
  SELECT *, octet_length(encode(html)) AS size, chr(13) || chr(10) AS nl,
    'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || size || nl || nl AS answer FROM content),
stored AS (
  SELECT key, 'WARC/1.1' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: <urn:sha256:' || sha256(coalesce(key::VARCHAR, '') || chr(10) || url) || '>' || nl
    || 'WARC-Date: 1970-01-01T00:00:00Z' || nl || 'WARC-Target-URI: ' || url || nl || 'WARC-Payload-Digest: sha256:' || sha256(html) || nl
    || 'Content-Type: application/http;msgtype=response' || nl || 'Content-Length: ' || (size + length(answer)) || nl || nl
    || answer || html || nl || nl AS record FROM answers),
hashed AS (
  SELECT key, octet_length(encode(record)) AS bytes, sha256(record) AS digest,
    coalesce(upper(lpad(to_hex((key::HUGEINT + 9223372036854775808)::UBIGINT), 16, '0')), '') AS path FROM stored),
grouped AS (SELECT key, path, digest, sum(bytes)::BIGINT AS n_bytes, count(*) AS n_records FROM hashed GROUP BY key, path, digest)
SELECT key AS page_id, (sum(n_bytes) OVER (ORDER BY path, digest) - n_bytes)::BIGINT AS "offset", n_bytes, n_records, digest AS record_hash,
  ('0x' || substr(digest, 1, 7))::BIGINT % 101 = 0 AS corrupt FROM grouped"""

QUERIES = {"op9_merkle_audit": query}
ORACLES = {"op9_merkle_audit": _ORACLE}
