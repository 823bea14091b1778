"""Operator 4: language-model scores of whole documents by a gated recurrent network.

Words (lower-cased A-Z, between ASCII white space) and one end per text are counted over
all training documents, in shards by hash. The `HEAD` most frequent are words of the
network; every other word falls into one of `TAILS` classes by its last two bytes, and
within its class has the probability (count + 0.5) / (N + 0.5 (V + 1)) of the training
words of that class. So the model is a distribution over the words seen and an unseen
one per class. The counts of the `KNOWN` most frequent words, a table of that size, are
sent to all tasks; the others' occurrences go to the shard that has their count.

Texts are encoded once, as two-byte ids of the network. The network learns in `ROUNDS`
rounds from all training documents, each of them in one round, chosen by a hash of its
doc_id: in a round the documents are dealt by doc_id to parts, each part trains a copy of
the network on all of its tokens in the order of doc_id, and the copies are averaged, weighted by
tokens, in a tree of `FAN` at a time. The number of parts follows from the number of training
tokens alone, so that the weights do not depend on how the input is split. Documents are
scored whole, side by side on lanes, with the state carried from window to window.

Defined cases: a null text is empty, and has its end only; a null doc_id counts as held
out; rows that repeat a doc_id are scored each, and train each; without training
documents every base probability is 1 and the network has only its first weights; an
empty table has no rows. Rows that share a doc_id train in one part. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .gru import RATE, Gru

HEAD, KNOWN, TAILS = 2048, 1 << 18, 32
ROUNDS, FAN = 2, 8
#: Training tokens for each part of a round, while there are at most `MOST_PARTS`; beyond that for
#: each part, so that the copies to be averaged stay small beside the corpus.
PART_TOKENS, MOST_PARTS, LARGE_PART = 1_000_000, 512, 32_000_000
#: Tokens that a part holds in memory while it learns them.
PIECE = 400_000
SHARD_BYTES = 8 << 20
#: Tokens that a task scores at a time.
POOL = 2_000_000

COUNT = np.dtype([("word", "<u8"), ("n", "<u8"), ("tail", "u1")])
ID = np.dtype("<u2")
RARE = np.dtype([("word", "<u8"), ("row", "<i8"), ("n", "<u4")])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(True))


def _words(data: np.ndarray, offsets: np.ndarray):
    """Hash and tail class of each word, and the rows' offsets among the words."""
    low = C.LOWER[data]
    start, end, at = C.words(low, offsets)
    h = C.span_hash(C.loads(low), start, end)
    last = low[end - 1].astype(np.int64) * 31 + low[np.maximum(end - 2, start)] * 7 if len(end) else np.zeros(0, np.int64)
    return h, (last * 40503 % 65536 >> 4) % TAILS, at


def _dealt(rows: np.ndarray, shards: int):
    shard = (rows["word"] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    rows, shard = rows[order], shard[order]
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else []
    return [(int(shard[a]), rows[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(parts) if parts else np.zeros(0, COUNT)
    word, first, back = np.unique(rows["word"], return_index=True, return_inverse=True)
    out = rows[first]
    out["n"] = np.bincount(back, rows["n"], len(word)).astype(np.uint64) if len(word) else 0
    return out


def count_words(docs: DataFrame, shards: int) -> DataFrame:
    """shard, words, tokens, blob: the counts of all words of `docs`, in shards by hash."""

    def count(batches):
        for batch in batches:
            whole, all_offsets = C.buffers(batch.column("text"))
            parts = []
            for a, b in C.chunks(all_offsets):
                h, tail, _ = _words(whole[all_offsets[a] : all_offsets[b]], all_offsets[a : b + 1] - all_offsets[a])
                word, first, n = np.unique(h, return_index=True, return_counts=True)
                part = np.zeros(len(word), COUNT)
                part["word"], part["n"], part["tail"] = word, n, tail[first]
                parts.append(part)
            out = _dealt(_merged(parts), shards)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["shard", "blob"])

    def gather(table: pa.Table) -> pa.Table:
        total = np.zeros(0, COUNT)
        for batch in table.to_batches():
            total = _merged([total, *(np.frombuffer(b, COUNT) for b in batch.column("blob").to_pylist())])
        return pa.table({"shard": table.column("shard").slice(0, 1), "words": pa.array([len(total)], pa.int64()), "tokens": pa.array([int(total["n"].sum())], pa.int64()), "blob": pa.array([total.tobytes()], pa.binary())})

    return docs.select("text").mapInArrow(count, "shard int, blob binary").groupBy("shard").applyInArrow(gather, "shard int, words long, tokens long, blob binary")


def most_frequent(counts: DataFrame, most: int) -> np.ndarray:
    """The `most` most frequent words (ties by hash): a bounded table."""

    def best(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                rows = np.frombuffer(blob, COUNT)
                rows = rows[np.lexsort((rows["word"], -rows["n"].astype(np.int64)))][:most]
                yield pa.RecordBatch.from_arrays([pa.array(rows["word"].view(np.int64)), pa.array(rows["n"].astype(np.int64)), pa.array(rows["tail"].astype(np.int32))], names=["word", "n", "tail"])

    rows = counts.select("blob").mapInArrow(best, "word long, n long, tail int").orderBy(F.col("n").desc(), "word").limit(most).toArrow()
    out = np.zeros(rows.num_rows, COUNT)
    out["word"], out["n"], out["tail"] = np.asarray(rows.column("word")).view(np.uint64), np.asarray(rows.column("n")), np.asarray(rows.column("tail"))
    return out[np.lexsort((out["word"], -out["n"].astype(np.int64)))]


def tail_totals(counts: DataFrame, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each tail class: words that are not of the head."""
    named = np.sort(head["word"])

    def total(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                rows = np.frombuffer(blob, COUNT)
                if len(named):
                    place = np.minimum(np.searchsorted(named, rows["word"]), len(named) - 1)
                    rows = rows[named[place] != rows["word"]]
                n, v = np.bincount(rows["tail"], rows["n"], TAILS).astype(np.int64), np.bincount(rows["tail"], minlength=TAILS)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAILS, dtype=np.int32)), pa.array(n), pa.array(v.astype(np.int64))], names=["tail", "n", "v"])

    tokens, distinct = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in counts.select("blob").mapInArrow(total, "tail int, n long, v long").groupBy("tail").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        tokens[r.tail], distinct[r.tail] = r.n, r.v
    return tokens, distinct


class Vocabulary:
    """The most frequent words, by hash: their counts, and the network's ids (0 is the end)."""

    def __init__(self, known: np.ndarray, head: int):
        order = np.argsort(known["word"], kind="stable")
        self.word, self.n = known["word"][order], known["n"][order].astype(np.int64)
        self.id = np.where(order < head, order + 1, -1)
        self.head = min(head, len(known)) + 1

    def find(self, word: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its id for the network and its count, or -1 where that is elsewhere."""
        if not len(self.word):
            return self.head + tail, np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        hit = self.word[at] == word
        own = np.where(hit, self.id[at], -1)
        return np.where(own >= 0, own, self.head + tail), np.where(hit, self.n[at], -1)


def _texts(batch, vocabulary: Vocabulary):
    """By chunks of rows: row range, ids, counts, distinct words, their place, offsets of rows."""
    whole, all_offsets = C.buffers(batch.column("text"))
    for a, b in C.chunks(all_offsets):
        h, tail, at = _words(whole[all_offsets[a] : all_offsets[b]], all_offsets[a : b + 1] - all_offsets[a])
        word, first, back = np.unique(h, return_index=True, return_inverse=True)
        ids, n = vocabulary.find(word, tail[first])
        yield a, b, ids.astype(np.int32), n, word, back, at


def _averaged(copies: DataFrame) -> tuple[np.ndarray, int]:
    """The mean of the copies' steps, weighted by tokens, `FAN` at a time, in the order of k. Copies
    tell their steps as halves of floats; means have floats."""

    def mean_of(kind):
        def mean(table: pa.Table) -> pa.Table:
            table = table.sort_by("k")
            weights = table.column("tokens").to_pylist()
            total = np.zeros(1)
            for w, blob in zip(weights, table.column("blob").to_pylist(), strict=True):
                total = total + w * np.frombuffer(blob, kind).astype(np.float64)
            out = (total / max(sum(weights), 1)).astype(np.float32)
            return pa.table({"k": pa.array([table.column("k")[0].as_py() // FAN], pa.int64()), "tokens": pa.array([sum(weights)], pa.int64()), "blob": pa.array([out.tobytes()], pa.binary())})

        return mean

    kind, left = np.float16, 2
    while left > 1:
        copies = C.checkpoint(copies.groupBy(F.floor(F.col("k") / FAN)).applyInArrow(mean_of(kind), "k long, tokens long, blob binary"))
        kind, left = np.float32, copies.count()
    row = copies.first()
    return (np.frombuffer(row.blob, np.float32), row.tokens) if row else (np.zeros(0, np.float32), 0)


def parts_of(tokens: int) -> int:
    """Parts, and so copies of the network, in a round."""
    return max(1, min(MOST_PARTS, math.ceil(tokens / PART_TOKENS)), math.ceil(tokens / LARGE_PART))


def train(encoded: DataFrame, head: int, counts: np.ndarray, tokens: int, rounds: int = ROUNDS) -> Gru:
    """A network for the encoded training documents (doc_id, ids), which hold `tokens`."""
    model, parts = Gru(head, TAILS, counts), parts_of(tokens // rounds)
    for k in range(rounds):
        now, rate = model.flat(), RATE / 2**k

        def learn(batches, now=now, rate=rate):
            from pyspark import TaskContext

            C.one_thread()
            own, learnt, seen, texts = None, 0, 0, []

            def piece():
                nonlocal own, learnt
                own = own or Gru(head, TAILS, counts).load(now)
                learnt += own.learn(texts, rate)

            for batch in batches:
                for blob in batch.column("ids").to_pylist():
                    texts.append(np.frombuffer(blob, ID))
                    seen += len(texts[-1]) + 1
                    if seen >= PIECE:
                        piece()
                        seen, texts = 0, []
            if texts:
                piece()
            if learnt:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([learnt], pa.int64()), pa.array([(own.flat() - now).astype(np.float16).tobytes()], pa.binary())], names=["k", "tokens", "blob"])

        mine = encoded.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k).select("doc_id", "ids")
        dealt = mine.repartition(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("ids"))
        step, learnt = _averaged(dealt.select("ids").mapInArrow(learn, "k long, tokens long, blob binary"))
        if learnt:
            model.load(now + step)
    return model


class Totals:
    """Counts of training that every task needs."""

    def __init__(self, tail_tokens: np.ndarray, tail_words: np.ndarray, ends: int):
        self.tail_log, self.ends = np.log10(tail_tokens + 0.5 * (tail_words + 1)), ends


_ENCODED = "shard int, uid long, doc_id long, n_tokens long, n_known long, logs double, tails double, blob binary"


def encode(docs: DataFrame, vocabulary: Vocabulary, totals: Totals, shards: int) -> DataFrame:
    """Rows of documents (shard null): uid, doc_id, n_tokens, n_known, logs (of base counts), tails
    (what words outside the network add to its score) and the ids; and of shards: the words
    counted there, by uid."""
    if vocabulary.head + TAILS > 1 << 16:
        raise ValueError("ids have two bytes")
    names = [x.split()[0] for x in _ENCODED.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
    end_log, end_known = math.log10(totals.ends + 0.5), int(totals.ends > 0)

    def run(batches):
        for batch in batches:
            uid, doc = np.asarray(batch.column("uid")), batch.column("doc_id").to_pylist()
            for a, b, ids, n, word, back, at in _texts(batch, vocabulary):
                line, count = ids[back], n[back]
                row = np.repeat(np.arange(b - a), np.diff(at))
                here = count >= 0
                log = np.where(here, np.log10(np.maximum(count, 0) + 0.5), 0)
                logs = np.bincount(row, log, b - a) + end_log
                known = (np.bincount(row, here & (count > 0), b - a) + end_known).astype(int)
                tail = line >= vocabulary.head
                tails = np.bincount(row, np.where(tail, log - totals.tail_log[np.maximum(line - vocabulary.head, 0)], 0), b - a)
                away = np.flatnonzero(~here)
                key, times = np.unique(row[away].astype(np.int64) << 32 | back[away], return_counts=True)
                rare = np.zeros(len(key), RARE)
                rare["word"], rare["row"], rare["n"] = word[key & 0xFFFFFFFF], uid[a + (key >> 32)], times
                line = line.astype(ID)
                rows = [(None, int(uid[a + i]), doc[a + i], int(at[i + 1] - at[i]) + 1, int(known[i]), float(logs[i]), float(tails[i]), line[at[i] : at[i + 1]].tobytes()) for i in range(b - a)]
                rows += [(k, None, None, None, None, None, None, blob) for k, blob in _dealt(rare, shards)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select("uid", "doc_id", "text").mapInArrow(run, _ENCODED)


def network_scores(encoded: DataFrame, model: Gru) -> DataFrame:
    """uid, doc_id, n_tokens, n_known, logs, and the network's score with `tails`."""
    names = ["uid", "doc_id", "n_tokens", "n_known", "logs"]

    def run(batches):
        C.one_thread()
        pool, size = [], 0

        def told():
            held = pa.Table.from_batches(pool).combine_chunks()
            found = model.score([np.frombuffer(x, ID) for x in held.column("blob").to_pylist()]) / math.log(10)
            return pa.RecordBatch.from_arrays([*(held.column(c).combine_chunks() for c in names), pa.array(found + np.asarray(held.column("tails")))], names=[*names, "score"])

        for batch in batches:
            pool.append(batch)
            size += sum(batch.column("n_tokens").to_pylist())
            if size >= POOL:
                yield told()
                pool, size = [], 0
        if size:
            yield told()

    return encoded.select(*names, "tails", "blob").mapInArrow(run, "uid long, doc_id long, n_tokens long, n_known long, logs double, score double")


def _rare(table: pa.Table) -> pa.Table:
    """One shard: the logs and number of known ones among its words, summed by document."""
    counted = _merged([np.frombuffer(b, COUNT) for b, k in zip(table.column("blob").to_pylist(), table.column("kind").to_pylist(), strict=True) if k == 0])
    rows = [np.frombuffer(b, RARE) for b, k in zip(table.column("blob").to_pylist(), table.column("kind").to_pylist(), strict=True) if k == 1]
    rows = np.concatenate(rows) if rows else np.zeros(0, RARE)
    n = np.zeros(len(rows), np.int64)
    if len(counted):
        at = np.minimum(np.searchsorted(counted["word"], rows["word"]), len(counted) - 1)
        n = np.where(counted["word"][at] == rows["word"], counted["n"][at].astype(np.int64), 0)
    uid, back = np.unique(rows["row"], return_inverse=True)
    return pa.table({"uid": pa.array(uid), "n_known": pa.array(np.bincount(back, (n > 0) * rows["n"], len(uid)).astype(np.int64)), "logs": pa.array(np.bincount(back, rows["n"] * np.log10(n + 0.5), len(uid)))})


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    C.tune(docs.sparkSession)
    rows = C.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learnt = rows.filter(~held_out(F.col("doc_id")))
    shards = max(16, math.ceil(C.text_bytes(rows) / SHARD_BYTES))
    counts = C.checkpoint(count_words(learnt, shards))
    totals = counts.agg(F.sum("words").alias("v"), F.sum("tokens").alias("n")).first()
    ends = learnt.count()
    tokens, distinct = (totals.n or 0) + ends, (totals.v or 0) + (ends > 0)
    known = most_frequent(counts, KNOWN)
    vocabulary = Vocabulary(known, HEAD)
    tail_tokens, tail_words = tail_totals(counts, known[:HEAD])
    told = C.checkpoint(encode(rows.withColumn("uid", F.monotonically_increasing_id()), vocabulary, Totals(tail_tokens, tail_words, ends), shards))
    encoded = told.filter("shard IS NULL")
    model = train(encoded.filter(~held_out(F.col("doc_id"))).withColumnRenamed("blob", "ids"), vocabulary.head, np.r_[ends, known["n"][:HEAD], tail_tokens].astype(float), tokens)
    apart = counts.select("shard", F.lit(0).alias("kind"), "blob").union(told.filter("shard IS NOT NULL").select("shard", F.lit(1).alias("kind"), "blob"))
    rare = apart.groupBy("shard").applyInArrow(_rare, "uid long, n_known long, logs double")
    parts = network_scores(encoded, model).union(rare.select("uid", F.lit(None).cast("long"), F.lit(0).cast("long"), "n_known", "logs", F.col("logs").alias("score")))
    whole = parts.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "score")])
    per_token = math.log10(tokens + 0.5 * (distinct + 1))
    return whole.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents"))


QUERIES = {"op4_gru_language_model": query}
ORACLES: dict[str, str] = {}
