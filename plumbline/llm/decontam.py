"""Operator 2: benchmark decontamination by template windows.

Tokens are canonicalised: numbers, names (capitalised words within a sentence) and
units (after a number) become typed placeholders, other words lose their case. The
windows of `WINDOW` tokens of all benchmark items are hash-joined with those of all
documents; items shorter than a window are one window as long as they are. Windows
need `LITERALS` words that are no placeholders (or all, if shorter). On each alignment of a
document with an item, the filled slots are compared: within a run a value of the item must
meet one value of the document, so that a question with other numbers or names is caught and
a chance meeting of templates is not.

A document is contaminated by an item if an alignment holds all windows of a run of `RUN`
tokens (all that the item has, if those are fewer) and the run's slots are consistent. What
templates cannot tell is matched by its tokens as they are but for case: items of up to `RUN`
tokens as a whole, and runs of `RUN` tokens that have a window with too few words. An
alignment is of one text with one item's text. `n_windows` and `n_slots` are of the windows in
consistent runs.

Document windows that a bitmap of the benchmark's hashes excludes never leave the
task. The benchmark's windows are broadcast only if they are counted and no more than
`BROADCAST_ROWS`; beyond that the join shuffles.

Defined cases: null or empty texts match nothing; items of fewer than `SHORTEST` tokens
match as they are only; repeated documents are each told, rows that repeat a doc_id count as one
document; a null doc_id or item_id is a value like any other; an empty benchmark
contaminates nothing. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmap as B
from . import common as C

WINDOW, RUN, LITERALS, SHORTEST = 10, 13, 4, 5
#: Windows of a whole run.
FULL = RUN - WINDOW + 1
BROADCAST_ROWS = 200_000
# Words that are units where they follow a number.
UNITS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons cup cups second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees mph kmh hz khz mhz ghz kb mb gb tb watt watts volt volts".split()

_DIGIT, _WORD, _UPPER, _LOWERS, _STOP = (np.zeros(256, bool) for _ in range(5))
_DIGIT[48:58] = True
_UPPER[65:91] = True
_LOWERS[97:123] = True
_LOWERS[128:] = True
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = _WORD[39] = True
_STOP[list(b".!?:;\n\"")] = True
_NUMBER, _NAME, _UNIT, _RUN = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333, 0x4444444444444444))
_STEP = pow(0xD1342543DE82EF95, 1, 1 << 64)


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer("".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    return np.sort(C.span_hash(C.loads(data), ends - [len(u) for u in UNITS], ends))


_UNIT_HASHES = _unit_hashes()


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Of each token: its template hash, its value's hash, whether it is a placeholder; and
    the rows' offsets among the tokens."""
    inside = _WORD[data]
    if len(data) > 2:
        digit = _DIGIT[data]
        inside[1:-1] |= ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    start, end, at = C.spans(inside, offsets)
    n = len(start)
    value = C.span_hash(C.loads(C.LOWER[data]), start, end)
    if not n:
        return value, value, np.zeros(0, bool), at
    letters = np.concatenate([[0], np.cumsum(_UPPER[data] | _LOWERS[data])])
    number = (letters[end] == letters[start]) & _DIGIT[data[start]]
    first = np.zeros(n, bool)
    first[at[:-1][np.diff(at) > 0]] = True
    after_number = np.r_[False, number[:-1]] & ~first
    place = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
    unit = after_number & (_UNIT_HASHES[place] == value)
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    fresh = np.r_[True, stops[start[1:]] > stops[end[:-1]]] | first
    second = data[np.minimum(start + 1, len(data) - 1)]
    name = _UPPER[data[start]] & (end - start > 1) & _LOWERS[second] & ~fresh & ~number
    template = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    return template, value, number | unit | name, at


def windows(data: np.ndarray, offsets: np.ndarray, size: int):
    """Windows of `size` tokens: their first token, hash; the tokens' values and placeholders; row offsets."""
    template, value, slot, at = tokens(data, offsets)
    n = len(template) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), value, slot, at
    h, step = np.zeros(n, np.uint64), 1
    for k in range(size):
        h += template[k : k + n] * np.uint64(step)
        step = step * _STEP % (1 << 64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    literal = np.concatenate([[0], np.cumsum(~slot)])
    enough = literal[size:] - literal[:-size] >= min(LITERALS, size)
    kept = np.flatnonzero((row[:n] == row[size - 1 :]) & enough)
    return kept, C.mix(h[kept] + np.uint64(size)), value, slot, at


def runs(data: np.ndarray, offsets: np.ndarray, size: int):
    """Runs of `size` tokens by their values: first token, hash, and whether a window in them has
    too few literals; row offsets."""
    _, value, slot, at = tokens(data, offsets)
    n = len(value) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), at
    h, step = np.zeros(n, np.uint64), 1
    for k in range(size):
        h += value[k : k + n] * np.uint64(step)
        step = step * _STEP % (1 << 64)
    poor = np.zeros(n, bool)
    literal = np.concatenate([[0], np.cumsum(~slot)])
    for k in range(size - WINDOW + 1):
        poor |= literal[k + WINDOW : k + WINDOW + n] - literal[k : k + n] < LITERALS
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    kept = np.flatnonzero(row[:n] == row[size - 1 :])
    return kept, C.mix((h[kept] + np.uint64(size)) ^ _RUN), poor[kept], at


def _slots(first, size, value, slot):
    """The values in each window's slots, as an Arrow list."""
    count = np.concatenate([[0], np.cumsum(slot)])
    of_slots = value[slot].view(np.int64)
    start, length = count[first], count[first + size] - count[first]
    flat = of_slots[C.ragged(start, length)] if len(first) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(flat))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id") -> DataFrame:
    """h, item_id, item_hash, item_at, size, plain (a run of tokens as they are), needed (windows in
    a run), item_slots."""
    names = ["h", "item_id", "item_hash", "item_at", "size", "plain", "needed", "item_slots"]

    def run(batches):
        for batch in batches:
            data, offsets = C.buffers(batch.column("text"))
            *_, at = tokens(data, offsets)
            lengths, ids, hashes = np.diff(at), batch.column("item_id"), batch.column("item_hash")
            for size in range(SHORTEST, WINDOW + 1):
                first, h, value, slot, at = windows(data, offsets, size)
                row = np.searchsorted(at, first, "right") - 1
                held = (lengths[row] >= size) if size == WINDOW else (lengths[row] == size)
                first, h, row = first[held], h[held], row[held]
                has = np.bincount(row, minlength=len(lengths))[row]
                needed = np.minimum(has, np.maximum(1, np.minimum(RUN, lengths[row]) - size + 1))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids.take(pa.array(row)), hashes.take(pa.array(row)), pa.array((first - at[row]).astype(np.int64)), pa.array(np.full(len(h), size, np.int32)), pa.array(np.zeros(len(h), bool)), pa.array(needed.astype(np.int64)), _slots(first, size, value, slot)], names=names)
            for size in range(1, RUN + 1):
                first, h, poor, at = runs(data, offsets, size)
                row = np.searchsorted(at, first, "right") - 1
                held = (lengths[row] == size) | poor & (size == RUN)
                first, h, row = first[held], h[held], row[held]
                none = pa.array([[]] * len(h), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids.take(pa.array(row)), hashes.take(pa.array(row)), pa.array((first - at[row]).astype(np.int64)), pa.array(np.full(len(h), size, np.int32)), pa.array(np.ones(len(h), bool)), pa.array(np.ones(len(h), np.int64)), none], names=names)

    rows = benchmark.select(F.col(item).cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("item_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "h long, item_id long, item_hash long, item_at long, size int, plain boolean, needed long, item_slots array<long>")


def document_windows(docs: DataFrame, wanted: np.ndarray, sizes: list[tuple[int, bool]]) -> DataFrame:
    """doc_id, text_hash, h, doc_at, doc_slots of the windows that the bitmap lets pass."""

    def run(batches):
        for batch in batches:
            whole, all_offsets = C.buffers(batch.column("text"))
            for a, b in C.chunks(all_offsets):
                data, offsets = whole[all_offsets[a] : all_offsets[b]], all_offsets[a : b + 1] - all_offsets[a]
                for size, plain in sizes:
                    if plain:
                        first, h, _, at = runs(data, offsets, size)
                    else:
                        first, h, value, slot, at = windows(data, offsets, size)
                    held = B.passes(wanted, h)
                    first, h = first[held], h[held]
                    row = np.searchsorted(at, first, "right") - 1
                    of = pa.array(row + a)
                    slots = pa.array([[]] * len(h), pa.list_(pa.int64())) if plain else _slots(first, size, value, slot)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("text_hash").take(of), pa.array(h.view(np.int64)), pa.array((first - at[row]).astype(np.int64)), slots], names=["doc_id", "text_hash", "h", "doc_at", "doc_slots"])

    rows = C.texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, h long, doc_at long, doc_slots array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item it holds: doc_id, item_id, n_windows on the best
    alignment, n_slots, and whether all its slots hold the item's own values (exact)."""
    C.tune(docs.sparkSession)
    ours = C.checkpoint(benchmark_windows(benchmark))
    sizes = sorted((r["size"], r["plain"]) for r in ours.select("size", "plain").distinct().collect())
    few = ours.count() <= BROADCAST_ROWS
    theirs = document_windows(docs, B.build(ours, F.col("h")), sizes)
    met = theirs.join(F.broadcast(ours) if few else ours, "h")
    found = F.array_sort(F.collect_set(F.struct("doc_at", "item_slots", "doc_slots")))
    aligned = met.groupBy("doc_id", "text_hash", "item_id", "item_hash", "plain", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(found.alias("met"), F.max("needed").alias("needed"))
    enough = aligned.filter(F.size("met") >= F.col("needed"))
    # an item with fewer windows than a run is one run; else runs begin at each window
    starts = F.when(F.col("needed") < FULL, F.array(F.col("met"))).otherwise(
        F.filter(F.transform("met", lambda w, k: F.slice("met", k + 1, FULL)), lambda run: (F.size(run) == FULL) & (F.element_at(run, -1)["doc_at"] == run[0]["doc_at"] + FULL - 1))
    )
    good = enough.withColumn("runs", F.filter(starts, lambda run: _consistent(_pairs(run)))).filter(F.size("runs") > 0)
    whole = good.select("doc_id", "item_id", F.array_distinct(F.flatten("runs")).alias("windows")).withColumn("pairs", _pairs(F.col("windows")))
    told = whole.select("doc_id", "item_id", F.struct(F.size("windows").cast("long").alias("n_windows"), F.size("pairs").cast("long").alias("n_slots"), F.forall("pairs", lambda p: p["item_slots"] == p["doc_slots"]).alias("exact")).alias("best"))
    return told.groupBy("doc_id", "item_id").agg(F.max("best").alias("best")).select("doc_id", "item_id", "best.*")


def _pairs(windows: Column) -> Column:
    """The distinct pairs of an item's and a document's value in the slots of some windows."""
    return F.array_distinct(F.flatten(F.transform(windows, lambda w: F.arrays_zip(w["item_slots"].alias("item_slots"), w["doc_slots"].alias("doc_slots")))))


def _consistent(pairs: Column) -> Column:
    """Whether no value of the item meets two of the document."""
    return F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["item_slots"])))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark item. Rows are told apart by
    a hash of their text, so that null or repeated ids share no decision."""
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_id"), "text")
    gone = contaminated(keyed, benchmark).select(F.col("doc_id").alias(C.fresh(docs, "gone"))).distinct()
    return docs.join(gone, F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone[gone.columns[0]], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontamination": query}
ORACLES: dict[str, str] = {}
