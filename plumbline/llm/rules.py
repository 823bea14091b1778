"""Operator 8: quality rules, and an isolation forest over the rule statistics.

Every whole text is measured: words, symbols, repeated lines, words in repeated
three-word windows. Repeats are found by hashes and then compared by their bytes. A forest of
random splits over all these statistics, as shares or on a scale of ratios, and over the shares
of capitals and of punctuation, is grown on a bounded sample (`SAMPLE` of the labelled rows,
the least by a hash; unlabelled ones only where those are fewer); documents that few splits
isolate are anomalous. The score above which a document goes is read from the labelled rows,
all of them: it parts good from bad best, and no more than `LOST` of the rows marked good
go by it.

Defined cases: a null or empty text has no words and all statistics 0, and fails
the base rule; repeated doc_ids are measured row by row; labels that are null do
not count, and where a doc_id has several the largest does; without any good label
the threshold is `DEFAULT_THRESHOLD`. Other columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SAMPLE, TREES, SUBSAMPLE, SEED = 8192, 384, 512, 17
LOST, DEFAULT_THRESHOLD = 0.01, 0.65
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Bins of the score between 0 and 1 in which labelled rows are counted.
BINS = 2000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "punctuation_share"]
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"

_SYMBOL, _UPPER, _PUNCTUATION = (np.zeros(256, bool) for _ in range(3))
for _set, _chars in ((_SYMBOL, b"#*$%&|<>"), (_UPPER, bytes(range(65, 91))), (_PUNCTUATION, string.punctuation.encode())):
    _set[list(_chars)] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(key: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each span of bytes, of which equal ones of a row have equal keys: whether another of its row is
    equal, and whether an earlier one is."""
    order = np.argsort(key, kind="stable")
    a, b = order[:-1], order[1:]
    same = key[a] == key[b]
    pair = np.flatnonzero(same)
    a, b = a[pair], b[pair]
    true = (row[a] == row[b]) & (end[a] - start[a] == end[b] - start[b])
    true[true] = C.same_bytes(data, start[a[true]], start[b[true]], (end - start)[a[true]])
    if not true.all():  # different spans of one key: told apart by their bytes
        seen: dict[tuple, int] = {}
        key = np.array([seen.setdefault((r, data[x:y].tobytes()), len(seen)) for r, x, y in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)])
        order = np.argsort(key, kind="stable")
        same = key[order[:-1]] == key[order[1:]]
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return any_, later


def measure_buffers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts (one column of `COUNTS` each) and features of the rows of one chunk."""
    rows = len(offsets) - 1
    start, end, at = C.words(data, offsets)
    n_words = np.diff(at)
    loaded = C.loads(data)
    inside = ~C.SPACE[data]
    word_chars = _per_row(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = _per_row(_SYMBOL[data], offsets)

    line_start, line_end, line_at = C.spans(data != 10, offsets)
    word_total = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    full = word_total[line_end] > word_total[line_start]
    line_start, line_end = line_start[full], line_end[full]
    kept_before = np.concatenate([[0], np.cumsum(full)])
    line_at = kept_before[line_at]
    line_row = np.repeat(np.arange(rows), np.diff(line_at))
    line_key = C.mix(C.span_hash(loaded, line_start, line_end) + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, later = _repeated(line_key, data, line_start, line_end, line_row)
    dup_lines = _per_row(later, line_at)

    repeat = np.zeros(rows, np.int64)
    if len(start) > 2:
        row = np.repeat(np.arange(rows), n_words)
        whole = np.flatnonzero(row[:-2] == row[2:])
        # the words of a window one after another, each with the blank before the next
        size = end - start
        sizes = (size[whole] + 1, size[whole + 1] + 1, size[whole + 2])
        total = sizes[0] + sizes[1] + sizes[2]
        hashes = C.span_hash(loaded, start, end)
        key = C.mix(C.mix(C.mix(hashes[whole] + row[whole].astype(np.uint64)) + hashes[whole + 1]) + hashes[whole + 2])
        order = np.argsort(key, kind="stable")
        twice = np.zeros(len(key), bool)
        twice[order[1:]] |= key[order[1:]] == key[order[:-1]]
        twice[order[:-1]] |= key[order[1:]] == key[order[:-1]]
        some = np.flatnonzero(twice)  # the bytes of windows that may repeat
        sizes, total = [x[some] for x in sizes], total[some]
        ends = np.cumsum(total)
        plain, at_ = np.full(int(total.sum()), 32, np.uint8), ends - total
        for k, more in enumerate(sizes):
            width = more - (k < 2)
            plain[C.ragged(at_, width)] = data[C.ragged(start[whole[some] + k], width)]
            at_ = at_ + more
        found, _ = _repeated(key[some], plain, ends - total, ends, row[whole[some]])
        window = np.zeros(len(start) - 2, bool)
        window[whole[some][found]] = True
        cover = np.zeros(len(start), bool)
        for k in range(3):
            cover[k : len(window) + k] |= window
        repeat = _per_row(cover, at)

    size = np.maximum(word_chars, 1)
    n = np.maximum(n_words, 1)
    lines = np.maximum(np.diff(line_at), 1)
    features = [np.log1p(n_words), np.log1p(word_chars / n), symbols / size, dup_lines / lines, repeat / n, _per_row(_UPPER[data], offsets) / size, _per_row(_PUNCTUATION[data], offsets) / size]
    return np.stack([n_words, word_chars, symbols, dup_lines, repeat], 1), np.stack(features, 1)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, and the features of every whole text."""
    C.tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = C.buffers(batch.column("text"))
            for a, b in C.chunks(offsets):
                counts, features = measure_buffers(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * len(FEATURES)), pa.array(features.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(c) for c in counts.T.astype(np.int64)), lists], names=["doc_id", *COUNTS, "features"])

    return C.texts(docs).mapInArrow(run, _SCHEMA)


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n <= 1, 0, np.where(n == 2, 1, 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m))


class Forest:
    """Complete binary trees in arrays: node k has children 2k + 1 and 2k + 2."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = min(subsample, max(len(rows), 1))
        self.depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((trees, nodes), np.int16)
        self.cut = np.full((trees, nodes), np.inf)
        self.path = np.zeros((trees, nodes))
        self.norm = max(float(_average_path(size)), 1e-9)
        for t in range(trees):
            picked = rows[rng.permutation(len(rows))[:size]] if len(rows) else rows
            self._grow(t, 0, 0, picked, rng)

    def _grow(self, t, node, depth, rows, rng):
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
        open_ = np.flatnonzero(high > low)
        if depth == self.depth or len(rows) <= 1 or not len(open_):
            length = depth + float(_average_path(len(rows)))
            stack = [node]
            while stack:  # every path that would lead further ends with this length
                k = stack.pop()
                if k < self.path.shape[1]:
                    self.path[t, k] = length
                    stack += [2 * k + 1, 2 * k + 2]
            return
        f = int(rng.choice(open_))
        cut = rng.uniform(low[f], high[f])
        self.feature[t, node], self.cut[t, node] = f, cut
        left = rows[:, f] <= cut
        self._grow(t, 2 * node + 1, depth + 1, rows[left], rng)
        self._grow(t, 2 * node + 2, depth + 1, rows[~left], rng)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the mean path, the nearer 1."""
        out = np.zeros(len(rows))
        trees = np.arange(len(self.cut))
        for a in range(0, len(rows), 1024):
            part = rows[a : a + 1024]
            at, each = np.zeros((len(part), len(trees)), np.int64), np.arange(len(part))[:, None]
            for _ in range(self.depth):
                at = 2 * at + 1 + (part[each, self.feature[trees, at]] > self.cut[trees, at])
            out[a : a + 1024] = 2 ** (-self.path[trees, at].mean(1) / self.norm)
        return out


def _lists(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), len(FEATURES))


def scored(measured: DataFrame, forest: Forest) -> DataFrame:
    """The measured rows with the column `anomaly`."""

    def run(batches):
        for b in batches:
            score = forest.score(_lists(b.column("features")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ["doc_id", *COUNTS]), pa.array(score)], names=["doc_id", *COUNTS, "anomaly"])

    return measured.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", anomaly double")


def _marks(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("labelled"), "quality").dropna().groupBy("labelled").agg(F.max("quality").alias("quality"))


def fit(measured: DataFrame, labels: DataFrame) -> Forest:
    marked = measured.join(_marks(labels), F.col("doc_id") == F.col("labelled"), "left")
    rows = marked.orderBy(F.col("labelled").isNull(), F.xxhash64("doc_id", "features")).limit(SAMPLE).select("features").toArrow()
    return Forest(_lists(rows.column("features").combine_chunks()))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def threshold(rows: DataFrame, labels: DataFrame, lost: float = LOST) -> float:
    """The score that parts the labelled rows that pass the base rule with the least sum of the
    shares lost of the good and kept of the bad, where at most `lost` of the good are lost."""
    held = rows.filter(~base_failed()).join(_marks(labels), F.col("doc_id") == F.col("labelled"))
    counts = held.groupBy(F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), (F.col("quality") == 1).alias("good")).count().collect()
    good, bad = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for r in counts:
        (good if r.good else bad)[r.bin] += r["count"]
    if not good.sum():
        return DEFAULT_THRESHOLD
    gone = (good.sum() - np.cumsum(good)) / good.sum()
    cost = gone + np.cumsum(bad) / max(bad.sum(), 1)
    cost[gone > lost] = np.inf
    best = np.flatnonzero(cost == cost.min())
    return float((best[len(best) // 2] + 1) / BINS)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, and the anomaly score."""
    measured = C.checkpoint(measure(docs))
    rows = scored(measured, fit(measured, labels))
    limit = threshold(rows, labels)
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= limit))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that `judge` keeps. The verdict is formed where the
    row is, so that rows with null or repeated ids get their own."""
    measured = C.checkpoint(measure(docs))
    forest = fit(measured, labels)
    limit = threshold(scored(measured, forest), labels)

    def run(batches):
        for batch in batches:
            data, offsets = C.buffers(batch.column("text"))
            for a, b in C.chunks(offsets):
                counts, features = measure_buffers(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
                yield batch.slice(a, b - a).filter(pa.array(~failed & (forest.score(features) <= limit)))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return rows.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")


QUERIES = {"op8_quality_rules": query}
ORACLES: dict[str, str] = {}
