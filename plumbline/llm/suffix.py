"""Operator 1: removal of long repeats by a logarithmic family of sparse suffix arrays.

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier: in a
document of smaller doc_id, or earlier in the same one.

Suffixes are indexed only where every window of `LENGTH` bytes is sure to hold one, in
the same place of equal windows: at the least of the hashes of the `ANCHOR`-byte
strings within the window (the leftmost of equals). The consecutive windows that share
an anchor are an entry; the bytes they span are its segment. So there is an entry for
about 26 bytes, and equal windows lie in entries of the same anchor.

Entries are dealt to shards by the hash of their anchor string. Each shard takes them in
document order, in batches. A batch becomes an array of suffixes sorted by the
fingerprint of their segments; it is merge-scanned against the levels of the family,
which finds segments that occurred before; what is new becomes a level, and levels of
like size are merged, so that there are logarithmically many. `extend` takes a further
batch of documents against levels that were stored, and tells the levels to store next.
Sorting by fingerprint instead of by bytes makes the same matches and spares storing the
bytes with each suffix.

A segment seen before repeats as a whole. Where first segments share an anchor string
but are not equal, as at the ends of a repeat, single windows decide: their
fingerprints are dealt to shards again, and all but the earliest repeat.

Within a task, entries with a segment that the task has met leave as finished repeats,
so that a passage that many documents share reaches its shard once per batch of rows.
Fingerprints have 96 bits, of two hashes: among the 4e12 entries of 100 TB of text about 1e-4
chance meetings are to be expected.

Defined cases: a null text is empty; a text shorter than `LENGTH` keeps all; a null
doc_id sorts with the least one; rows that repeat a doc_id are told apart, and ordered, by a hash of
their texts; rows that repeat a doc_id and its text are the same document, and do not
remove one another. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmap as B
from . import common as C

LENGTH, ANCHOR = 100, 50
#: Entries in a batch of the family, and bytes of text for each shard.
BATCH, SHARD_BYTES = 1 << 16, 8 << 20
#: Shards whose spans, which are few, are checkpointed in one file.
SHARDS_A_FILE = 16
_PLACE = np.uint64((1 << 31) - 1)
FIRST = -(2**63)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, not linear in either."""
    out = a * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(31)
    out += b
    out *= np.uint64(0xD1342543DE82EF95)
    out ^= out >> np.uint64(29)
    return out


def _thirty_two(data: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the 32 bytes from each place on, by doubling."""
    h = C.loads(data)[: max(len(data) - 7, 0)]
    h = _pair(h + np.uint64(0xA0761D6478BD642F * (seed + 1) % (1 << 64)), h)
    for size in (8, 16):
        h = _pair(h[:-size], h[size:])
    return h


def _window(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the `LENGTH` bytes from each of some places on, of four overlapping parts."""
    return _pair(_pair(h[at], h[at + 32]), _pair(h[at + 36], h[at + 68]))


def entries(data: np.ndarray, offsets: np.ndarray):
    """Of each entry: its anchor's hash, its segment's two, its row, the first window's offset in
    the row, and the number of further windows."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64), none, none, none
    h = _thirty_two(data, 0)
    anchors = C.mix(_pair(h[: n - ANCHOR + 1], h[ANCHOR - 32 :]))
    least = (anchors & ~_PLACE) | np.arange(len(anchors), dtype=np.uint64)
    width, have = LENGTH - ANCHOR + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    whole = offsets[row + 1] - np.arange(len(at)) >= LENGTH
    begin = whole.copy()
    begin[1:] &= (at[1:] != at[:-1]) | ~whole[:-1]
    stop = whole.copy()
    stop[:-1] &= (at[1:] != at[:-1]) | ~whole[1:]
    first, last = np.flatnonzero(begin), np.flatnonzero(stop)
    hashes = [_segment(x, first, last) for x in (h, _thirty_two(data, 1))]
    return anchors[at[first]], *hashes, row[first], first - offsets[row[first]], last - first


def _segment(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the bytes from the first window to the end of the last, which overlap."""
    return C.mix(_pair(_window(h, first), _window(h, last)) + (last - first).astype(np.uint64))


def _order(rows: np.ndarray) -> np.ndarray:
    """Document order: by doc, tie and start."""
    return np.lexsort((rows["start"], rows["tie"], rows["doc"]))


def _same_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a["doc"] == b["doc"]) & (a["tie"] == b["tie"]) & (a["start"] == b["start"])


def _by_segment(rows: np.ndarray) -> np.ndarray:
    return np.lexsort((rows["check"], rows["segment"]))


def _find(level: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its place in a sorted array, and whether its segment is there."""
    at = np.searchsorted(level["segment"], rows["segment"])
    while True:  # past other segments of the same first hash
        place = np.minimum(at, len(level) - 1)
        same = (at < len(level)) & (level["segment"][place] == rows["segment"])
        less = same & (level["check"][place] < rows["check"])
        if not less.any():
            return place, same & (level["check"][place] == rows["check"])
        at = at + less


def earliest(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first of their segment in document order, and which come after it.
    Rows at the place of the first are neither."""
    order = np.lexsort((rows["start"], rows["tie"], rows["doc"], rows["check"], rows["segment"]))
    sorted_ = rows[order]
    k, c = sorted_["segment"], sorted_["check"]
    fresh = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0)) if len(k) else np.zeros(0, np.int64)
    first, later = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    first[order] = fresh
    later[order] = ~_same_place(sorted_, sorted_[lead])
    return first, later


class Family:
    """Levels of suffixes sorted by segment fingerprint, each fingerprint once over all. `given` are
    the numbered levels of a stored family."""

    def __init__(self, given: dict[int, np.ndarray] | None = None):
        self.levels = sorted((given or {}).items(), key=lambda x: -len(x[1]))
        self.next, self.dropped, self.stored = max(given or {}, default=-1) + 1, [], set(given or {})
        self.added: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> np.ndarray:
        """Take a batch (in document order, later than all before it); tell which of its suffixes
        repeat a segment."""
        first, later = earliest(batch)
        array = batch[first]
        array = array[_by_segment(array)]
        known, same = np.zeros(len(array), bool), np.zeros(len(array), bool)
        for _, level in self.levels:
            at, hit = _find(level, array)
            known |= hit
            same |= hit & _same_place(level[at], array)
        if known.any():
            _, seen = _find(array[known], batch)
            lead = array[known & same]
            if len(lead):  # another row of the same document at the same offset
                at, own = _find(lead, batch)
                seen &= ~(own & _same_place(lead[at], batch))
            later |= seen
        if len(new := array[~known]):
            self.added.append(new)
            self.levels.append((self.next, new))
            self.next += 1
            while len(self.levels) > 1 and len(self.levels[-2][1]) < 2 * len(self.levels[-1][1]):
                (j, b), (i, a) = self.levels.pop(), self.levels.pop()
                self.dropped += [k for k in (i, j) if k in self.stored]
                both = np.concatenate([a, b])
                self.levels.append((self.next, both[_by_segment(both)]))
                self.next += 1
        return later

    def ambiguous(self) -> np.ndarray:
        """The suffixes whose anchor string has several segments, of which one at least is new."""
        if not self.added:
            return np.zeros(0, ENTRY)
        anchors = np.unique(np.concatenate([x["anchor"] for x in self.added]))
        every = np.concatenate([x for _, x in self.levels])
        place = np.minimum(np.searchsorted(anchors, every["anchor"]), len(anchors) - 1)
        every = every[anchors[place] == every["anchor"]]
        every = every[np.argsort(every["anchor"], kind="stable")]
        same = every["anchor"][1:] == every["anchor"][:-1]
        return every[np.r_[False, same] | np.r_[same, False]] if len(every) > 1 else every[:0]

    def changed(self) -> list[tuple[int, np.ndarray]]:
        """The levels that are not stored yet."""
        return [(k, x) for k, x in self.levels if k not in self.stored]


ENTRY = np.dtype([("anchor", "<u4"), ("segment", "<u8"), ("check", "<u4"), ("doc", "<i8"), ("tie", "<i8"), ("start", "<u4"), ("more", "u1")])
WINDOW = np.dtype([("segment", "<u8"), ("check", "<u4"), ("doc", "<i8"), ("tie", "<i8"), ("start", "<u4")])
_SPAN = np.dtype([("start", "<u4"), ("more", "<u4")])


def _pack(rows: np.ndarray) -> bytes:
    """Column by column, which compresses better than row by row."""
    return b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names)


def _unpack(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    out = []
    for blob in blobs:
        n, at = len(blob) // kind.itemsize, 0
        rows = np.zeros(n, kind)
        for c in kind.names:
            t = kind[c]
            rows[c] = np.frombuffer(blob, t, n, at)
            at += n * t.itemsize
        out.append(rows)
    return np.concatenate(out) if out else np.zeros(0, kind)


def _dealt(rows: np.ndarray, shard: np.ndarray):
    """(shard, packed rows) for each shard that has rows."""
    order = np.argsort(shard, kind="stable")
    rows, shard = rows[order], shard[order]
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(shard[a]), _pack(rows[a:b])


def _by_doc(rows: np.ndarray, more: np.ndarray):
    """(doc, tie, packed spans) for each document; a span is `more` + 1 windows that repeat."""
    order = _order(rows)
    rows, spans = rows[order], np.zeros(len(rows), _SPAN)
    spans["start"], spans["more"] = rows["start"], more[order]
    doc, tie = rows["doc"], rows["tie"]
    edges = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]), True]) if len(doc) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(doc[a]), int(tie[a]), spans[a:b].tobytes()


def _rows(columns: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


_OUT = "kind int, doc long, tie long, shard int, blob binary"
#: What a shard tells: spans that repeat, spans to be compared by windows, a level to be stored (its
#: number in `doc`) and the number of one that is no more.
_REPEAT, _OPEN, _LEVEL, _DROPPED = 0, 1, 2, 3
#: A stored family: the packed arrays of every shard by number.
INDEX = "shard int, level long, blob binary"


def _out(shard: int, repeats, open_=(), levels=(), dropped=()) -> pa.Table:
    told = [(_REPEAT, d, t, shard, b) for d, t, b in repeats] + [(_OPEN, d, t, shard, b) for d, t, b in open_]
    told += [(_LEVEL, k, None, shard, _pack(rows)) for k, rows in levels] + [(_DROPPED, k, None, shard, None) for k in dropped]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.Table.from_batches([_rows([list(c) for c in zip(*told, strict=True)] or [[] for _ in kinds], kinds, ["kind", "doc", "tie", "shard", "blob"])])


def _documents(docs: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, doc, tie and text, of the documents and of those before. The tie is a hash of the text
    where some doc_id repeats, and else 0, which takes no room."""
    text, doc = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))
    every = docs.select(doc.alias("doc"))
    every = every if before is None else every.union(before.select(doc.alias("doc")))
    again = every.groupBy("doc").count().filter("count > 1").limit(1).count()
    tie = F.xxhash64(text, F.col("doc_id").isNull()) if again else F.lit(0).cast("long")
    rows = [None if x is None else x.select(F.col("doc_id").cast("long").alias("doc_id"), doc.alias("doc"), tie.alias("tie"), text.alias("text")) for x in (docs, before)]
    return rows[0], rows[1]


def _deal(rows: DataFrame, shards: int) -> DataFrame:
    """shard, doc, tie, blob: entries (doc null) for the shards, and repeats found on the spot."""

    def run(batches):
        for batch in batches:
            data, offsets = C.buffers(batch.column("text"))
            ids, ties, parts, anchors = np.asarray(batch.column("doc")), np.asarray(batch.column("tie")), [], []
            for a, b in C.chunks(offsets):
                anchor, segment, check, row, start, more = entries(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = np.zeros(len(anchor), ENTRY)
                part["anchor"], part["segment"], part["check"], part["start"], part["more"] = (anchor >> np.uint64(32)).astype(np.uint32), segment, check >> np.uint64(32), start, more
                part["doc"], part["tie"] = ids[a + row], ties[a + row]
                parts.append(part)
                anchors.append(anchor & np.uint64(0xFFFFFFFF))
            if not parts:
                continue
            rows, low = np.concatenate(parts), np.concatenate(anchors)
            first, later = earliest(rows)
            out = [(d % shards, d, t, blob) for d, t, blob in _by_doc(rows[later], rows["more"][later])]
            out += [(k, None, None, blob) for k, blob in _dealt(rows[first], (low[first] % np.uint64(shards)).astype(np.int64))]
            yield _rows([list(c) for c in zip(*out, strict=True)] or [[], [], [], []], [pa.int32(), pa.int64(), pa.int64(), pa.binary()], ["shard", "doc", "tie", "blob"])

    return rows.mapInArrow(run, "shard int, doc long, tie long, blob binary")


def _index(store: bool):
    """One shard: its entries through a family; repeats found before pass through. The stored levels of
    the shard come with the level's number in `level`."""

    def run(table: pa.Table) -> pa.Table:
        given = list(zip(*(table.column(c).to_pylist() for c in ("doc", "tie", "level", "blob")), strict=True))
        rows = _unpack([b for d, _, k, b in given if d is None and k is None], ENTRY)
        rows = rows[_order(rows)]
        family = Family({k: _unpack([b], ENTRY) for _, _, k, b in given if k is not None})
        gone = [part[family.add(part)] for part in (rows[k : k + BATCH] for k in range(0, len(rows), BATCH))]
        gone = np.concatenate(gone) if gone else rows
        open_ = family.ambiguous()
        told = [(d, t, b) for d, t, _, b in given if d is not None]
        stored = (family.changed(), family.dropped) if store else ((), ())
        return _out(table.column("shard")[0].as_py(), told + list(_by_doc(gone, gone["more"])), _by_doc(open_, open_["more"]), *stored)

    return run


def _first_windows(table: pa.Table) -> pa.Table:
    """One shard of single windows: all but the first of each repeat, neighbours as one span."""
    rows = _unpack(table.column("blob").to_pylist(), WINDOW)
    _, later = earliest(rows)
    gone = rows[later]
    gone = gone[_order(gone)]
    doc, tie, start = gone["doc"], gone["tie"], gone["start"].astype(np.int64)
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > start[:-1] + 1)]) if len(gone) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(gone)] - 1 if len(gone) else first
    return _out(table.column("shard")[0].as_py(), _by_doc(gone[first], start[last] - start[first]))


def _spans(lists) -> np.ndarray:
    return np.concatenate([np.frombuffer(x["blob"], _SPAN) for x in lists]) if lists else np.zeros(0, _SPAN)


def _deal_windows(joined: DataFrame) -> DataFrame:
    """shard, blob: the windows of the open entries of each document. Equal windows have the same
    anchor, so they meet in the shard of their entries, and neighbours stay together."""

    def run(batches):
        for batch in batches:
            parts, shards = [np.zeros(0, WINDOW)], [np.zeros(0, np.int64)]
            for doc, tie, text, lists in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "text", "blobs")), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                hashes = None
                for x in lists:
                    spans = np.frombuffer(x["blob"], _SPAN)
                    start = C.ragged(spans["start"].astype(np.int64), spans["more"].astype(np.int64) + 1)
                    start = start[start + LENGTH <= len(data)]
                    part = np.zeros(len(start), WINDOW)
                    if len(start):
                        hashes = hashes or [_thirty_two(data, seed) for seed in (0, 1)]
                        part["segment"] = C.mix(_window(hashes[0], start))
                        part["check"] = C.mix(_window(hashes[1], start)) >> np.uint64(32)
                    part["doc"], part["tie"], part["start"] = doc, tie, start
                    parts.append(part)
                    shards.append(np.full(len(start), x["shard"], np.int64))
            out = list(_dealt(np.concatenate(parts), np.concatenate(shards)))
            yield _rows([list(c) for c in zip(*out, strict=True)] or [[], []], [pa.int32(), pa.binary()], ["shard", "blob"])

    return joined.mapInArrow(run, "shard int, blob binary")


def _only(rows: DataFrame, wanted: np.ndarray, inside: bool) -> DataFrame:
    """The documents that may be in the bitmap, or the others."""

    def run(batches):
        for batch in batches:
            held = B.passes(wanted, (np.asarray(batch.column("doc")) ^ np.asarray(batch.column("tie"))).view(np.uint64))
            yield batch.filter(pa.array(held if inside else ~held))

    return rows.mapInArrow(run, "doc_id long, doc long, tie long, text string")


def _with_spans(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """doc_id, doc, tie, text, blobs of the documents that `found` has spans for; and their bitmap."""
    grouped = found.groupBy("doc", "tie").agg(F.collect_list(F.struct("shard", "blob")).alias("blobs"))
    wanted = B.build(found, F.col("doc").bitwiseXOR(F.col("tie")))
    return _only(rows, wanted, True).join(grouped, ["doc", "tie"], "left"), wanted


def repeats(rows: DataFrame, index: DataFrame | None = None, before: DataFrame | None = None, store: bool = False, shards: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """doc, tie, shard, blob: the packed spans of repeating windows, some rows per document; and the
    stored family with these documents, if it is asked for."""
    shards = shards or max(16, math.ceil(C.text_bytes(rows) / SHARD_BYTES))
    files = math.ceil(shards / SHARDS_A_FILE)
    dealt = _deal(rows, shards).select("shard", "doc", "tie", F.lit(None).cast("long").alias("level"), "blob")
    if index is not None:
        dealt = dealt.union(index.select("shard", F.lit(None).cast("long"), F.lit(None).cast("long"), "level", "blob"))
    told = C.checkpoint(dealt.groupBy("shard").applyInArrow(_index(store), _OUT), files)
    open_ = told.filter(F.col("kind") == _OPEN).select("doc", "tie", "shard", "blob")
    every = rows if before is None else rows.union(before)
    windows = _deal_windows(_with_spans(every, open_)[0].filter("blobs IS NOT NULL"))
    single = C.checkpoint(windows.groupBy("shard").applyInArrow(_first_windows, _OUT), files)
    found = told.filter(F.col("kind") == _REPEAT).union(single).select("doc", "tie", "shard", "blob")
    if not store:
        return found, None
    new = told.filter(F.col("kind") == _LEVEL).select("shard", F.col("doc").alias("level"), "blob")
    if index is not None:
        dropped = told.filter(F.col("kind") == _DROPPED).select("shard", F.col("doc").alias("level"))
        new = index.select("shard", "level", "blob").join(dropped, ["shard", "level"], "left_anti").union(new)
    return found, new


def marked(data_length: int, spans: np.ndarray) -> np.ndarray:
    """Which bytes the spans remove."""
    change = np.zeros(data_length + 1, np.int64)
    np.add.at(change, np.minimum(spans["start"].astype(np.int64), data_length), 1)
    np.add.at(change, np.minimum(spans["start"].astype(np.int64) + spans["more"] + LENGTH, data_length), -1)
    return np.cumsum(change[:-1]) > 0


_RESULT = "doc_id long, kept binary, starts array<long>, ends array<long>"
_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _applied(rows: DataFrame, digest: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            blobs = batch.column("blobs").to_pylist() if "blobs" in batch.schema.names else [None] * len(ids)
            for doc, text, lists in zip(ids, texts, blobs, strict=True):
                raw = text.encode()
                kept, starts, ends = raw, [], []
                if lists:
                    data = np.frombuffer(raw, np.uint8)
                    gone = marked(len(data), _spans(lists))
                    kept = data[~gone].tobytes()
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    starts, ends = edge[::2].tolist(), edge[1::2].tolist()
                out.append((doc, len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()) if digest else (doc, kept, starts, ends))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] if digest else [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield _rows([list(c) for c in zip(*out, strict=True)] or [[] for _ in kinds], kinds, [x.split()[0] for x in (_DIGEST if digest else _RESULT).split(", ")])

    return rows.mapInArrow(run, _DIGEST if digest else _RESULT)


def _result(rows: DataFrame, found: DataFrame, digest: bool) -> DataFrame:
    """Documents without repeats are not shuffled."""
    joined, wanted = _with_spans(rows, found)
    return _applied(joined, digest).union(_applied(_only(rows, wanted, False), digest))


def deduplicate(docs: DataFrame, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, the bytes kept and the removed spans, or digests of them."""
    C.tune(docs.sparkSession)
    rows, _ = _documents(docs)
    return _result(rows, repeats(rows)[0], digest)


def extend(docs: DataFrame, shards: int, index: DataFrame | None = None, before: DataFrame | None = None, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same for a new batch of documents after the documents `before`, whose family of `shards`
    shards is `index` (see `INDEX`); and the index with the batch, to be written where the next
    call reads it. Only levels that the batch merges are made anew. Of `before`, texts are read
    where a repeat begins or ends."""
    C.tune(docs.sparkSession)
    rows, old = _documents(docs, before)
    found, stored = repeats(rows, index, old, True, shards)
    return _result(rows, found, digest), stored


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(C.table(spark, sf_dir, "documents"), digest=True)


#: All windows by brute force, on hexadecimal texts: byte p is digits 2p + 1 and 2p + 2.
_ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
b AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d)),
marked AS (
  SELECT b.doc_id, p, x, coalesce(p - max(later.i) OVER (PARTITION BY b.doc_id ORDER BY p) < 100, false) AS gone
  FROM b LEFT JOIN later ON b.doc_id = later.doc_id AND b.p = later.i),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM marked),
told AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans,
    coalesce(string_agg(x, '' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM edges GROUP BY doc_id)
SELECT d.doc_id, length(h)::BIGINT // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN told ON d.doc_id = told.doc_id"""

QUERIES = {"op1_suffix_dedup": query}
ORACLES = {"op1_suffix_dedup": _ORACLE}
