"""Operator 6: secret scans over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. The ledger holds
a row for each pair of a blob and a rule version that has been scanned; the version is
a hash of the rules, so that an edited rule makes all blobs unseen. A scan takes one copy
of each blob of which the ledger has no row for `RULE_VERSION`, and its findings are
joined back to all documents (paths) that hold the blob. `scan_stored` adds a run's new
rows to the ledger of a folder, which the next run reads.

A blob that only one row holds is scanned where the row lies; a bitmap of fixed size tells
which may have copies, and only the texts of those are shuffled to choose one.

Spans are in code points, end exclusive, over the whole match. The base kinds are
assign, access and hex; the further kinds add spans and take none away.

Defined cases: a null text is empty and has no findings; copies, repeated rows and
repeated doc_ids each get their row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmap as B
from . import common as C

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20
_KEYWORDS = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
KINDS = ["assign", "access", "hex", "private_key", "github", "google", "slack", "jwt"]
# Public formats of further credentials: a literal that must occur, and the pattern.
FURTHER = {
    "private_key": ("PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    "github": ("gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    "google": ("AIza", re.compile(r"AIza[0-9A-Za-z_-]{35}")),
    "slack": ("xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    "jwt": ("eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
}
LEDGER = "blob string, rule_version long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def rule_version() -> int:
    """A hash of all patterns and limits."""
    rules = [(k, p.pattern, int(p.flags)) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("keywords", _KEYWORDS))]
    rules += [(k, literal, p.pattern, int(p.flags)) for k, (literal, p) in FURTHER.items()] + [MIN_VALUE, MIN_ACCESS]
    return int.from_bytes(hashlib.sha256(repr(rules).encode()).digest()[:8], "little", signed=True)


RULE_VERSION = rule_version()


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind."""
    out: dict[str, list[tuple[int, int]]] = {}
    if _KEYWORDS.search(text):
        out["assign"] = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out["access"] = [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out["hex"] = [m.span() for m in HEX.finditer(text)]
    for kind, (literal, pattern) in FURTHER.items():
        if literal in text:
            out[kind] = [m.span() for m in pattern.finditer(text)]
    return out


def told(found: dict[str, list[tuple[int, int]]], kinds: list[str]) -> str:
    rows = sorted((start, KINDS.index(k), end) for k in kinds for start, end in found.get(k, ()))
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in rows)


def _scan(batches):
    for batch in batches:
        rows = []
        for blob, text in zip(batch.column("blob").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = find(text or "")
            base = told(found, KINDS[:3])
            rows.append((blob, RULE_VERSION, *(len(found.get(k, ())) for k in KINDS[:3]), hashlib.sha256(base.encode()).hexdigest(), told(found, KINDS)))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in LEDGER.split(", ")])


def catalog(docs: DataFrame) -> DataFrame:
    """doc_id, text and the content address of each document."""
    return C.texts(docs).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))


def copies(docs: DataFrame) -> DataFrame:
    """blob, count: how many rows hold each blob."""
    return catalog(docs).groupBy("blob").count()


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Ledger rows for the blobs of `docs` that the ledger lacks at this rule version. `counted`: what
    `copies` tells, if it is at hand."""
    C.tune(docs.sparkSession)
    known = ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob") if ledger is not None else None
    counted = copies(docs) if counted is None else counted
    apart = counted.filter("count > 1").select("blob")
    apart = apart if known is None else apart.union(known)
    held = B.build(apart, F.xxhash64("blob"))

    def dealt(may: bool, then, schema: str):
        def run(batches):
            for batch in batches:
                hit = B.passes(held, np.asarray(batch.column("h")).view(np.uint64))
                yield batch.filter(pa.array(hit if may else ~hit)).select(["blob", "text"])

        return catalog(docs).select("blob", "text", F.xxhash64("blob").alias("h")).mapInArrow(lambda batches: then(run(batches)), schema)

    some = dealt(True, iter, "blob string, text string")
    if known is not None:
        some = some.join(known.distinct(), "blob", "left_anti")
    # copies are dropped before the shuffle too, so that a text arrives once from each task
    one = some.groupBy("blob").agg(F.first("text").alias("text"))
    # scanned where they are dealt: a second Python function in a task has a worker of its own, which stays
    return dealt(False, _scan, LEDGER).union(one.mapInArrow(_scan, LEDGER))


def _scanned(docs: DataFrame, ledger: DataFrame | None) -> tuple[DataFrame, DataFrame, list]:
    """The new rows of the ledger, the whole ledger, and the blobs that are hot among the documents."""
    C.tune(docs.sparkSession)
    counted = C.checkpoint(copies(docs))
    hot = C.hot_keys(counted, "blob", counted.agg(F.sum("count")).first()[0] or 0)
    now = C.checkpoint(scan_unseen(docs, ledger, counted))
    return now, now if ledger is None else ledger.select(now.columns).unionByName(now), hot


def scan(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of every document, and the ledger with the blobs newly scanned."""
    _, whole, hot = _scanned(docs, ledger)
    known = whole.filter(F.col("rule_version") == RULE_VERSION).drop("rule_version")
    return C.join_hot(catalog(docs).select("doc_id", "blob"), known, "blob", hot=hot).drop("blob"), whole


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger in a folder, or None where there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def scan_stored(docs: DataFrame, folder: str) -> DataFrame:
    """Findings of every document; what the ledger in `folder` lacks is scanned and appended to it."""
    now, whole, hot = _scanned(docs, read_ledger(docs.sparkSession, folder))
    known = C.checkpoint(whole.filter(F.col("rule_version") == RULE_VERSION).drop("rule_version"))
    now.write.mode("append").parquet(folder)
    return C.join_hot(catalog(docs).select("doc_id", "blob"), known, "blob", hot=hot).drop("blob")


def redact(docs: DataFrame, ledger: DataFrame | None = None, mark: str = "<secret>") -> DataFrame:
    """The rows of `docs`, all columns, each span that the ledger scan finds replaced by `mark`;
    where a text changes and there is an n_chars, it is counted anew."""
    _, whole, hot = _scanned(docs, ledger)
    blob, spans_of = C.fresh(docs, "found_blob"), C.fresh(docs, "found_spans")
    known = whole.filter((F.col("rule_version") == RULE_VERSION) & (F.col("spans") != "")).select(F.col("blob").alias(blob), F.col("spans").alias(spans_of))
    names, schema = docs.columns, docs.schema
    address = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)

    def run(batches):
        for batch in batches:
            old, new = batch.column("text").to_pylist(), []
            for text, spans in zip(old, batch.column(spans_of).to_pylist(), strict=True):
                if spans:
                    parts, at = [], 0
                    for start, end in sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",")):
                        if start >= at:
                            parts += [text[at:start], mark]
                        at = max(at, end)
                    text = "".join([*parts, text[at:]])
                new.append(text)
            columns = {c: batch.column(c) for c in names} | {"text": pa.array(new, pa.string())}
            if "n_chars" in names:
                was = batch.column("n_chars")
                counted = [n if x == y else len(y) for n, x, y in zip(was.to_pylist(), old, new, strict=True)]
                columns["n_chars"] = pa.array(counted, was.type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return C.join_hot(docs.withColumn(blob, address), known, blob, "left", hot).drop(blob).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))[0]


QUERIES = {"op6_secret_ledger": query}
ORACLES: dict[str, str] = {}
