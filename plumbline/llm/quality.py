"""Operator 7: quality by a factorisation machine.

Inputs are hashed words and hashed word shapes (letters, digits and runs of them
folded), statistics of the text's structure, and the stored n_chars as metadata. Every
input i has a weight and a vector of `RANK` numbers; a pair's interaction is the product
of its vectors. All pairs together are half of the square of the sum less the sum of the
squares, so a text is scored in time linear in its distinct words.

The machine is fitted on a bounded sample of the labelled rows it may learn from:
`SAMPLE` rows, the least by a hash of doc_id. Scores never use labels, lang, source or
doc_id.

Defined cases: a null text is empty and is scored from its statistics and metadata; a
null or absent n_chars counts as no metadata; null labels do not count, and of several
for one doc_id the largest does; rows that repeat a doc_id are scored each; without
labels all scores are 0.5; a null doc_id counts as held out. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import rules

SAMPLE, RANK, HASHED, EPOCHS, BATCH, RATE, SEED = 8000, 8, 1 << 14, 8, 64, 0.05, 5
#: Structure statistics and metadata, the inputs after the hashed ones: the shares of the quality
#: rules, and words and lines on scales of about 1.
DENSE = [*rules.FEATURES[2:], "word_length", "line_words", "log_words", "digit_share", "log_n_chars", "has_n_chars"]
INPUTS = HASHED + len(DENSE)

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97


def inputs(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, input and value of all inputs that are not 0, by row. n_chars: -1 if unknown."""
    rows = len(offsets) - 1
    counts, features = rules.measure_buffers(data, offsets)
    start, end, at = C.words(data, offsets)
    row = np.repeat(np.arange(rows), np.diff(at))
    # a shape is the word without bytes whose class repeats the one before
    shape = _SHAPE[data]
    novel = np.ones(len(shape), bool)
    novel[1:] = shape[1:] != shape[:-1]
    novel[start] = True
    begins = np.concatenate([[0], np.cumsum(novel)])
    hashes = [C.span_hash(C.loads(C.LOWER[data]), start, end), C.span_hash(C.loads(shape[novel]), begins[start], begins[end])]
    key = np.concatenate([row * HASHED + ((h ^ np.uint64(k)) >> np.uint64(64 - 14)).astype(np.int64) for k, h in enumerate(hashes)])
    key, count = np.unique(key, return_counts=True)
    which, value = key // HASHED, np.log1p(count)
    norm = np.sqrt(np.bincount(which, value**2, rows))
    value = value / np.maximum(norm, 1e-9)[which]
    size, words = np.maximum(counts[:, 1], 1), np.maximum(counts[:, 0], 1)
    lines = rules._per_row(data == 10, offsets) + 1
    known = n_chars >= 0
    dense = np.concatenate([features[:, 2:], np.stack([counts[:, 1] / words / 10, np.log1p(counts[:, 0] / lines) / 5, np.log1p(counts[:, 0]) / 10, rules._per_row((data >= 48) & (data < 58), offsets) / size, np.where(known, np.log1p(np.maximum(n_chars, 0)) / 15, 0), known], 1)], 1)
    all_rows = np.concatenate([which, np.repeat(np.arange(rows), len(DENSE))])
    all_inputs = np.concatenate([key % HASHED, np.tile(np.arange(HASHED, INPUTS), rows)])
    all_values = np.concatenate([value, np.minimum(dense, 2).ravel()])
    order = np.argsort(all_rows, kind="stable")
    return all_rows[order], all_inputs[order], all_values[order].astype(np.float32)


class Machine:
    def __init__(self, seed: int = SEED):
        self.bias = 0.0
        self.weight = np.zeros(INPUTS, np.float32)
        self.factor = np.random.default_rng(seed).normal(0, 0.01, (INPUTS, RANK)).astype(np.float32)

    def raw(self, rows: int, row, which, value):
        """Scores before the logistic, and the sums of factors."""
        at = np.searchsorted(row, np.arange(rows + 1))
        scaled = self.factor[which] * value[:, None]
        total = np.concatenate([np.zeros((1, RANK)), np.cumsum(scaled, 0, dtype=np.float64)])
        sums = total[at[1:]] - total[at[:-1]]
        squares = np.bincount(row, (scaled**2).sum(1), rows)
        return self.bias + np.bincount(row, self.weight[which] * value, rows) + 0.5 * ((sums**2).sum(1) - squares), sums

    def score(self, rows: int, row, which, value) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows, row, which, value)[0], -30, 30)))

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = EPOCHS) -> Machine:
        """Minibatches with AdaGrad; both labels weigh the same."""
        good = label.mean() if len(label) else 0
        if not 0 < good < 1:
            self.factor[:] = 0
            self.bias = 0.0 if not len(label) else 4.0 if good else -4.0
            return self
        share = np.where(label == 1, 0.5 / good, 0.5 / (1 - good))
        rng = np.random.default_rng(SEED)
        seen_w, seen_v = np.full(INPUTS, 1e-4, np.float32), np.full((INPUTS, RANK), 1e-4, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for a in range(0, len(order), BATCH):
                picked = order[a : a + BATCH]
                row = np.repeat(np.arange(len(picked)), [len(examples[k][0]) for k in picked])
                which = np.concatenate([examples[k][0] for k in picked])
                value = np.concatenate([examples[k][1] for k in picked])
                raw, sums = self.raw(len(picked), row, which, value)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[picked]) * share[picked] / len(picked)
                self.bias -= RATE * float(error.sum())
                places, back = np.unique(which, return_inverse=True)
                own = error[row] * value
                step_w = np.bincount(back, own) + 1e-6 * self.weight[places]
                each = own[:, None] * (sums[row] - self.factor[which] * value[:, None])
                step_v = np.stack([np.bincount(back, each[:, f]) for f in range(RANK)], 1) + 1e-5 * self.factor[places]
                seen_w[places] += step_w**2
                seen_v[places] += step_v**2
                self.weight[places] -= (RATE * step_w / np.sqrt(seen_w[places])).astype(np.float32)
                self.factor[places] -= (RATE * step_v / np.sqrt(seen_v[places])).astype(np.float32)
        return self


def _prepared(docs: DataFrame, *more: str) -> DataFrame:
    known = F.coalesce(F.col("n_chars").cast("long"), F.lit(-1)) if "n_chars" in docs.columns else F.lit(-1)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), known.cast("long").alias("n_chars"), *more)


def _parts(batch):
    data, offsets = C.buffers(batch.column("text"))
    n_chars = np.asarray(batch.column("n_chars"))
    for a, b in C.chunks(offsets):
        yield a, b, inputs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n_chars[a:b])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most `sample` labelled rows that are not held out. The sample's
    ids are broadcast: `sample` rows at most."""
    marks = labels.select(F.col("doc_id").alias("marked"), "quality").dropna().filter(~held_out(F.col("marked")))
    chosen = marks.groupBy("marked").agg(F.max("quality").alias("label")).orderBy(F.xxhash64("marked")).limit(sample)
    rows = _prepared(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("marked")).select("doc_id", "text", "n_chars", "label")

    def run(batches):
        for batch in batches:
            for a, b, (row, which, value) in _parts(batch):
                at = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(which.astype(np.int32))), pa.ListArray.from_arrays(pa.array(at), pa.array(value))], names=["doc_id", "label", "inputs", "values"])

    found = rows.mapInArrow(run, "doc_id long, label int, inputs array<int>, values array<float>").orderBy("doc_id").limit(sample).toArrow()
    examples = [(np.asarray(i.values), np.asarray(v.values)) for i, v in zip(found.column("inputs"), found.column("values"), strict=True)]
    return Machine().fit(examples, (np.asarray(found.column("label")) == 1).astype(float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches):
        for batch in batches:
            for a, b, (row, which, value) in _parts(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(machine.score(b - a, row, which, value))], names=["doc_id", "score"])

    C.tune(docs.sparkSession)
    return _prepared(docs).mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    machine = fit(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_factorisation_machine": query}
ORACLES: dict[str, str] = {}
