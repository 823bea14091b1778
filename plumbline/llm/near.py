"""Operator 10: MinHash near-duplicates by ProbMinHash over weighted word shingles.

Words are ASCII-lower-cased runs without white space or ASCII punctuation; shingles
are `WORDS` words, or all words of a shorter text, weighted by how often they occur.
Each shingle is a Poisson process whose rate is its weight, and each of its arrivals
falls on a random register; a register keeps the shingle that arrives first. Shingles
whose next arrival is later than all registers of the document's are done, so a long
text costs little more than one arrival a shingle. Two registers agree with the
probability Jaccard similarity J_P of the weighted sets.

Texts with equal shingles and weights are one node. Nodes that agree on a band of
`ROWS` registers share a bucket. In each bucket all nodes are compared with a centre,
the one with most neighbours over all buckets; links need an exact J_P of at least
`THRESHOLD`. Then the nodes of a bucket that are still in different classes are
compared with each other: buckets of up to `SMALL` by a join, larger ones in blocks, where
products of matrices tell the weight that two sets have in common; its lesser share is an
upper bound on J_P, and only pairs below the threshold by that bound are left out. So a large
group of near copies costs about one comparison for each node that the centre links, and
every candidate pair across classes is decided exactly. If registers are independent, a
pair at the threshold shares no band, and so is no candidate, with a chance of 3.6e-4.

Defined cases: a null or empty text, and one without words, is in a class of its own;
a null doc_id forms no class (its class_id is null); rows that repeat a doc_id are
judged by their texts and take part like any others; an empty table has no rows.
Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmap as B
from . import common as C

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
SMALL, BLOCK, BLOCK_BYTES = 64, 512, 8 << 20
#: Shingles that a product of matrices takes at once.
COLUMNS = 4096
#: Bits of the filter for documents that need comparing.
FILTER_BITS = 26
EMPTY = b""

_PLAIN = C.LOWER.copy()
_PLAIN[[b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]] = 32
_G = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of the distinct shingles, sorted by row and hash."""
    plain = _PLAIN[data]
    start, end, at = C.words(plain, offsets)
    h, n = C.span_hash(C.loads(plain), start, end), len(start)
    counts = np.diff(at)
    row = np.repeat(np.arange(len(counts)), counts)
    keys, rows = [], []
    for size in range(1, WORDS + 1):  # shorter sizes only for texts that are as short
        m = n - size + 1
        if m <= 0 or size < WORDS and not (counts == size).any():
            continue
        held = row[:m] == row[size - 1 :]
        if size < WORDS:
            held &= counts[row[:m]] == size
        first = np.flatnonzero(held)
        if len(first):
            out, step = np.zeros(len(first), np.uint64), 1
            for k in range(size):
                out += h[first + k] * np.uint64(step)
                step = step * int(_G) % (1 << 64)
            keys.append(C.mix(out + np.uint64(size)))
            rows.append(row[first])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(row[order].astype(np.uint32 if len(counts) > 65535 else np.uint16), kind="stable")]
    key, row = key[order], row[order]
    fresh = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])])
    return row[fresh], key[fresh], np.diff(np.r_[fresh, len(key)])


def signatures(rows: int, row: np.ndarray, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each row and register the hash of the shingle that arrives first (0 in rows without any)."""
    time = np.full(rows * REGISTERS, np.inf)
    value = np.zeros(rows * REGISTERS, np.uint64)
    now = np.zeros(len(h))
    rate = weight.astype(float)
    k, scale = 0, 2.0**-53
    while len(h):
        k += 1
        x = C.mix(h + np.uint64(k * int(_G) % (1 << 64)))
        now = now - np.log(((x >> np.uint64(11)) + np.uint64(1)).astype(float) * scale) / rate
        x ^= np.uint64(0xA5A5A5A5A5A5A5A5)
        register = (C.mix(x) % np.uint64(REGISTERS)).astype(np.int64)
        place = row * REGISTERS + register
        better = now < time[place]
        p, t = place[better], now[better]
        np.minimum.at(time, p, t)
        won = time[p] == t
        value[p[won]] = h[better][won]
        last = time.reshape(rows, REGISTERS).max(1)
        go = now < last[row]
        row, h, now, rate = row[go], h[go], now[go], rate[go]
    return value.reshape(rows, REGISTERS)


def _sums(rows: int, row, key, weight):
    """Two order-free 64-bit sums over each row's weighted shingles: a text's node."""
    out = np.zeros((rows, 2), np.uint64)
    for k, salt in enumerate((0x94D049BB133111EB, 0xBF58476D1CE4E5B9)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(key * np.uint64(salt) + weight.astype(np.uint64) * _G))])
        at = np.searchsorted(row, np.arange(rows + 1))
        out[:, k] = total[at[1:]] - total[at[:-1]]
    return out


def _chunked(batches):
    for batch in batches:
        data, offsets = C.buffers(batch.column("text"))
        for a, b in C.chunks(offsets):
            part = offsets[a : b + 1] - offsets[a]
            yield batch.column("doc_id").slice(a, b - a), b - a, *shingles(data[offsets[a] : offsets[b]], part)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, node (16 bytes, empty without words), buckets (a hash for each band), registers."""

    def run(batches):
        for ids, n, row, key, weight in _chunked(batches):
            value = signatures(n, row, key, weight)
            some = np.bincount(row, minlength=n) > 0
            bands = np.zeros((n, BANDS), np.uint64)
            for k in range(ROWS):
                bands = C.mix(bands * _G + value[:, k::ROWS] + np.uint64(k))
            bands = C.mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            nodes = _sums(n, row, key, weight)
            short = (C.mix(value.copy()) >> np.uint64(32)).astype("<u4")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some) * BANDS]).astype(np.int32)), pa.array(bands[some].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() if s else EMPTY for x, s in zip(nodes, some, strict=True)], pa.binary()), lists, pa.array([x.tobytes() if s else EMPTY for x, s in zip(short, some, strict=True)], pa.binary())], names=["doc_id", "node", "buckets", "registers"])

    return C.texts(docs).mapInArrow(run, "doc_id long, node binary, buckets array<long>, registers binary")


def weighted_sets(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """node and its shingles, for documents whose node may be in the bitmap."""

    def run(batches):
        for _, n, row, key, weight in _chunked(batches):
            nodes, at = _sums(n, row, key, weight), np.searchsorted(row, np.arange(n + 1))
            held = np.flatnonzero(B.passes(wanted, nodes[:, 0]) & (at[1:] > at[:-1]))
            blobs = [key[at[k] : at[k + 1]].tobytes() + weight[at[k] : at[k + 1]].astype("<u4").tobytes() for k in held]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[k].tobytes() for k in held], pa.binary()), pa.array(blobs, pa.binary())], names=["node", "shingles"])

    return C.texts(docs).mapInArrow(run, "node binary, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def unpack(blob) -> tuple[np.ndarray, np.ndarray]:
    n = memoryview(blob).nbytes // 12
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, "<u4", n, 8 * n)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P: the sum over common d of 1 / sum over e of max(x_e / x_d, y_e / y_d)."""
    common, i, j = np.intersect1d(*(k[0] for k in (a, b)), assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1].astype(float), b[1].astype(float)
    x_d, y_d = x[i], y[j]
    # in the order of x / y, those above a common d count by x and the others by y
    ratio = x_d / y_d
    order = np.argsort(ratio, kind="stable")
    ranked = ratio[order]
    x_up = np.r_[np.cumsum(x_d[order][::-1])[::-1], 0.0]
    y_down = np.r_[0.0, np.cumsum(y_d[order])]
    cut = np.searchsorted(ranked, ratio, "right")
    only_x, only_y = x.sum() - x_d.sum(), y.sum() - y_d.sum()
    return float((1 / ((x_up[cut] + only_x) / x_d + (y_down[cut] + only_y) / y_d)).sum())


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose exact similarity reaches the threshold."""
    involved = C.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    wanted = B.build(involved, _first_half(F.col("node")), FILTER_BITS)
    sets = weighted_sets(docs, wanted).join(involved, "node", "left_semi")
    sets = C.checkpoint(sets)
    hot = [C.hot_keys(pairs.groupBy(c).count(), c, pairs.count()) for c in ("a", "b")]
    joined = C.join_hot(pairs, sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a", hot=hot[0])
    joined = C.join_hot(joined, sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b", hot=hot[1])

    def run(batches):
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            near = [similarity(unpack(x.as_buffer()), unpack(y.as_buffer())) >= THRESHOLD - 1e-9 for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    links = C.checkpoint(joined.select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary"), -(-involved.count() // C.NARROW_ROWS) or 1)
    involved.unpersist()
    return links


def _first_half(node):
    """The first 8 bytes of a node, little endian, as a long."""
    digits = F.hex(node)
    swapped = F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)])
    return F.conv(swapped, 16, -10).cast("long")


def components(links: DataFrame, most: int = 200) -> DataFrame:
    """node and label (its class's least node): labels spread along links and then jump to
    their label's label, until none changes."""
    both = C.keep(links.select("a", "b").union(links.select("b", "a")).distinct())
    n = both.count()
    labels = C.checkpoint(C.narrow(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), n))
    for _ in range(most):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        named = labels.groupBy(F.col("label").alias("node")).count()
        up = named.join(labels, "node").select(F.col("node").alias("next"), F.col("label").alias("up"))
        after = C.checkpoint(C.narrow(C.join_hot(spread, up, "next", hot=C.hot_keys(named, "node", n)).select("node", F.least("next", "up").alias("label"), "old"), n))
        labels = after.drop("old")
        if not after.filter(F.col("label") != F.col("old")).limit(1).count():
            break
    else:
        raise RuntimeError(f"classes did not settle in {most} rounds")
    both.unpersist()
    return labels


def candidates(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of nodes that share a small bucket and whose classes differ, but for those with
    the centre, which were compared; the members of large buckets of several classes; and the
    frame that is kept for both."""
    now = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = now.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("n"))
    open_ = split.filter((F.col("l0") != F.col("l1")) & (F.col("n") > 2)).select("bucket", F.col("n").alias("size"))
    now = C.keep(now.select("bucket", "band", "node", "label", "centre").join(open_, "bucket"))
    small = now.filter(F.col("size") <= SMALL)
    a, b = (small.select("bucket", F.col("node").alias(x), F.col("label").alias(f"l{x}"), F.col("centre").alias(f"c{x}")) for x in "ab")
    tested = (F.col("ca") == F.col("a")) | (F.col("ca") == F.col("b"))
    few = a.join(b, "bucket").filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & ~tested).select("a", "b")
    return few, now.filter(F.col("size") > SMALL), now


class _Sets:
    """Weighted sets of a block: their shingles one after another, and where each begins."""

    def __init__(self, blobs):
        self.each = [unpack(b) for b in blobs]
        self.size = np.array([len(k) for k, _ in self.each], np.int64)
        keys = np.concatenate([k for k, _ in self.each])
        order = np.argsort(keys, kind="stable")
        self.keys, self.row = keys[order], np.repeat(np.arange(len(self.each)), self.size)[order]
        self.weight = np.concatenate([w for _, w in self.each])[order].astype(np.float32)
        self.total = np.array([w.sum(dtype=np.float64) for _, w in self.each])

    def dense(self, columns: np.ndarray) -> np.ndarray:
        """The weights of some shingles, which are sorted, as a matrix."""
        a, b = np.searchsorted(self.keys, columns[0], "left"), np.searchsorted(self.keys, columns[-1], "right")
        place = np.minimum(np.searchsorted(columns, self.keys[a:b]), len(columns) - 1)
        held = columns[place] == self.keys[a:b]
        out = np.zeros((len(self.each), len(columns)), np.float32)
        out[self.row[a:b][held], place[held]] = self.weight[a:b][held]
        return out

    def may_be_near(self, other: _Sets) -> np.ndarray:
        """Pairs of own and other sets whose similarity may reach the threshold: J_P is no more than the
        share that the common shingles have of either set's weight."""
        ours, theirs = (np.zeros((len(self.each), len(other.each))) for _ in range(2))
        both = np.intersect1d(np.unique(self.keys), np.unique(other.keys), assume_unique=True)
        for k in range(0, len(both), COLUMNS):
            x, y = (side.dense(both[k : k + COLUMNS]) for side in (self, other))
            ours += x @ (y > 0).astype(np.float32).T
            theirs += (x > 0).astype(np.float32) @ y.T
        return np.minimum(ours / self.total[:, None], theirs / other.total[None, :]) >= THRESHOLD - 1e-4


def _root(parent: dict, x):
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def in_blocks(docs: DataFrame, large: DataFrame, registers: DataFrame) -> DataFrame:
    """Links between classes within large buckets, found in pairs of blocks of about `BLOCK` nodes
    and `BLOCK_BYTES` of shingles, so that no task holds a whole bucket. A pair is compared in the
    first of the buckets that it shares; of the links a block's spanning ones are told."""
    involved = C.keep(large.select("node").distinct())
    wanted = B.build(involved, _first_half(F.col("node")), FILTER_BITS)
    sets = weighted_sets(docs, wanted).join(involved, "node", "left_semi")
    known = C.checkpoint(sets.join(registers, "node"))
    weight = large.join(known.select("node", F.octet_length("shingles").alias("bytes")), "node").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    rows = large.join(weight, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keyed = rows.select("bucket", "band", "node", "label", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).join(known, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf[pdf.own == pdf.low.iloc[0]], pdf[pdf.own == pdf.high.iloc[0]]
        band, same = int(pdf.band.iloc[0]), pdf.low.iloc[0] == pdf.high.iloc[0]
        if not len(low) or not len(high):
            return pd.DataFrame({"a": [], "b": []})
        x, y = (np.stack([np.frombuffer(r, "<u4") for r in p.registers]) for p in (low, high))
        C.one_thread()
        own, others = _Sets(low.shingles), _Sets(high.shingles)
        may = own.may_be_near(others)
        labels, nodes = high.label.to_numpy(), high.node.to_numpy()
        out, parent = [], {}
        for k, (node, label) in enumerate(zip(low.node, low.label, strict=True)):
            near = may[k] & (labels != label)
            if same:
                near[: k + 1] = False
            for j in np.flatnonzero(near):
                if (x[k] == y[j]).reshape(BANDS, ROWS).all(1).argmax() != band:
                    continue
                p, q = _root(parent, label), _root(parent, labels[j])
                if p != q and similarity(own.each[k], others.each[j]) >= THRESHOLD - 1e-9:
                    parent[p] = q
                    out.append((node, nodes[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return keyed.groupBy("bucket", "low", "high").applyInPandas(compare, "a binary, b binary")


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), class_size."""
    C.tune(docs.sparkSession)
    signed = C.checkpoint(sign(docs))
    full = signed.filter(F.length("node") > 0)
    nodes = full.groupBy("node").agg(F.first("buckets").alias("buckets"))
    spread = nodes.select("node", F.posexplode("buckets").alias("band", "bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a bucket is hot among the rows of its nodes' bands
    hot = C.hot_keys(shared.withColumnRenamed("n", "count"), "bucket", BANDS * nodes.count())
    held = C.keep(C.join_hot(spread, shared, "bucket", hot=hot))
    weight = held.groupBy("node").agg(F.sum("n").alias("weight"))
    centre = held.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("best")).select("bucket", F.col("best.node").alias("centre"))
    members = C.checkpoint(C.narrow(C.join_hot(held, centre, "bucket", hot=hot).select("bucket", "band", "node", "centre"), held.count()))
    held.unpersist()
    pairs = C.keep(members.filter(F.col("node") != F.col("centre")).select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct())
    links = verify(docs, pairs)
    pairs.unpersist()
    labels = components(links)
    few, large, now = candidates(members, labels)
    few = C.keep(few.distinct().join(links, ["a", "b"], "left_anti"))
    found = [links]
    if few.limit(1).count():
        found.append(verify(docs, few))
    if large.limit(1).count():
        registers = full.groupBy("node").agg(F.first("registers").alias("registers"))
        found.append(C.checkpoint(in_blocks(docs, large, registers), -(-large.count() // C.NARROW_ROWS)))
    for kept in (few, now):
        kept.unpersist()
    if len(found) > 1:
        labels = components(reduce(DataFrame.union, found))
    named = C.join_hot(signed.select("doc_id", "node"), labels, "node", "left")
    # texts without words, and rows without an id, are their own classes
    alone = F.concat(F.lit("doc "), F.col("doc_id").cast("string")).cast("binary")
    named = C.checkpoint(named.select("doc_id", F.when(F.length("node") == 0, alone).otherwise(F.coalesce("label", "node")).alias("label")))
    known = named.filter("doc_id IS NOT NULL")
    sizes = known.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    found = C.join_hot(known, sizes, "label").select("doc_id", "class_id", "class_size")
    nameless = named.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return found.union(nameless)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, of which the first row of each class stays: that of the least
    doc_id, rows without one last, and then by text hash. Rows are told apart by doc_id and text, so
    rows that repeat a doc_id, or have none, get their own verdicts; of rows with equal doc_id and
    text one stays."""
    row_id = F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.coalesce(docs["text"], F.lit("")))
    own = C.checkpoint(docs.select(row_id.alias("doc_id"), docs["doc_id"].cast("long").alias("named")))
    found = C.checkpoint(classes(docs.select(row_id.alias("doc_id"), "text")))
    rows = found.select("doc_id", "class_id").distinct().join(own.distinct(), "doc_id")
    order = F.struct(F.col("named").isNull().alias("nameless"), "named", "doc_id")
    first = rows.groupBy("class_id").agg(F.min(order)["doc_id"].alias("first"))
    gone = C.join_hot(rows, first, "class_id").filter(F.col("doc_id") != F.col("first")).select(F.col("doc_id").alias(C.fresh(docs, "gone")))
    kept = docs.join(gone, row_id == gone[gone.columns[0]], "left_anti")
    again = own.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if again else kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(C.table(spark, sf_dir, "documents"))


QUERIES = {"op10_prob_minhash": query}
ORACLES: dict[str, str] = {}
