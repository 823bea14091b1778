"""Operator 5: byte-level BPE by batched numpy merge rounds.

The distinct pieces of many texts lie as symbols in one flat array. In each round
every piece finds its lowest-ranked adjacent pair by binary search over the sorted
pair keys, and merges it at all its places, left to right. A merged symbol only
occurs in pairs of a later rank, so this is the order of one-at-a-time merging.
Pieces of over `LONG` bytes, which could need a round per distinct pair, go through
a heap instead, with the same result.

Defined cases: a null text is empty and has no ids; the empty ids decode to the
empty text; repeated rows each give a row; ids that are no valid UTF-8 together
decode with U+FFFD for each ill-formed part; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: Where the public tokenizer files lie; a parameter of every function here.
TOKENIZER = "byte_bpe_50k.json"
#: Pieces longer than this many bytes are merged with a heap.
LONG = 512
#: Distinct pieces that a task remembers before it starts afresh.
CACHE = 400_000
_NONE = np.int64(1 << 60)
# The piece pattern of byte-level BPE, in general and for ASCII texts.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Bpe:
    """The tables of one tokenizer file. About 2 MB, whatever the data; sent with each task."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            pieces[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.reset()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "flat", "at", "used", "n")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reset()

    def reset(self):
        self.cache: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.n = np.zeros(1 << 12, np.int64), 0

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair (`_NONE` if it never merges) and its place in the tables."""
        key = left << 32 | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], _NONE), place

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and each piece's number of ids."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        for k, p in enumerate(pieces):
            if len(p) > LONG:
                out[k] = self.heap_merge(p)
        todo = np.array([k for k, p in enumerate(pieces) if out[k] is None], np.int64)
        done_words, done_symbols = [], []
        raw = np.frombuffer(b"".join(pieces[k] for k in todo), np.uint8)
        symbols = self.byte_ids[raw]
        word = np.repeat(todo, [len(pieces[k]) for k in todo]) if len(todo) else np.zeros(0, np.int64)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(symbols), _NONE)
            place = np.zeros(len(symbols), np.int64)
            rank[:-1], place[:-1] = self.ranked(symbols[:-1], symbols[1:])
            rank[:-1][word[1:] != word[:-1]] = _NONE
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(symbols)])
            least = np.repeat(least, size)
            ended = least == _NONE
            if ended.any():
                done_words.append(word[ended])
                done_symbols.append(symbols[ended])
            chosen = (rank == least) & ~ended
            at = np.flatnonzero(chosen)
            # of overlapping places, as in a run of one symbol, the 1st, 3rd, ... merge
            fresh = np.r_[True, np.diff(at) != 1] if len(at) else np.zeros(0, bool)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.made[place[at]]
            keep = ~ended
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        for k, ids in enumerate(out):
            if ids is not None:
                done_words.append(np.full(len(ids), k))
                done_symbols.append(ids)
        if not done_words:
            return np.zeros(0, np.uint32), np.zeros(len(pieces), np.int64)
        words, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(words, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(words, minlength=len(pieces))

    def heap_merge(self, piece: bytes) -> np.ndarray:
        symbols = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(symbols)
        after, before, gone = [*range(1, n), -1], [-1, *range(n - 1)], [False] * n

        def pair(i: int):
            j = after[i]
            if j < 0:
                return None
            key = symbols[i] << 32 | symbols[j]
            k = int(np.searchsorted(self.keys, key))
            return (int(self.ranks[k]), i, key, int(self.made[k])) if k < len(self.keys) and self.keys[k] == key else None

        rank, place = self.ranked(np.array(symbols[:-1]), np.array(symbols[1:]))
        heap = [(int(rank[i]), i, symbols[i] << 32 | symbols[i + 1], int(self.made[place[i]])) for i in np.flatnonzero(rank < _NONE).tolist()]
        heapq.heapify(heap)
        while heap:
            _, i, key, made = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or symbols[i] << 32 | symbols[j] != key:
                continue
            symbols[i], gone[j], after[i] = made, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (x := pair(k)):
                    heapq.heappush(heap, x)
        return np.array([s for s, g in zip(symbols, gone, strict=True) if not g], np.int64)

    def learn(self, pieces: list[str]) -> None:
        ids, sizes = self.merge([p.encode() for p in pieces])
        need, count = self.used + len(ids), self.n + len(pieces) + 1
        while need > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while count > len(self.at):
            self.at = np.resize(self.at, 2 * len(self.at))
        self.flat[self.used : need] = ids
        self.at[self.n + 1 : count] = self.used + np.cumsum(sizes)
        for p in pieces:
            self.cache[p] = self.n
            self.n += 1
        self.used = need

    def split(self, text: str) -> list[str]:
        return (_ASCII if text.isascii() else _ANY).findall(text)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        if len(self.cache) > CACHE:
            self.reset()
        pieces, special, ends = [], [], []
        for text in texts:
            parts = regex.split("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")", text) if any(t in text for t in self.added) else [text]
            for k, part in enumerate(parts):
                if k % 2:
                    special.append((len(pieces), self.added[part]))
                    pieces.append("")
                else:
                    pieces += self.split(part)
            ends.append(len(pieces))
        if "" not in self.cache:
            self.learn([""])
        if unseen := [p for p in set(pieces) if p not in self.cache]:
            self.learn(unseen)
        index = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        first, size = self.at[index], self.at[index + 1] - self.at[index]
        if special:
            size[[k for k, _ in special]] = 1
        flat = self.flat[np.minimum(C.ragged(first, size), max(self.used - 1, 0))]
        at = np.concatenate([[0], np.cumsum(size)])
        for k, i in special:
            flat[at[k]] = i
        bounds = at[np.r_[0, np.array(ends, np.int64)]] if texts else [0]
        return [flat[bounds[k] : bounds[k + 1]] for k in range(len(texts))]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as UTF-8; ill-formed parts become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        first = self.piece_at[ids]
        raw = self.piece_bytes[C.ragged(first, self.piece_at[ids + 1] - first)].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


_ANY, _ASCII = regex.compile(PIECES), __import__("re").compile(ASCII_PIECES)


def _run(batches: Iterator[pa.RecordBatch], bpe: Bpe, want_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = C.buffers(batch.column("text"))
        for first, last in C.chunks(offsets):
            part = batch.slice(first, last - first)
            found = bpe.encode_batch([t or "" for t in part.column("text").to_pylist()])
            if want_ids:
                at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = pa.array(np.concatenate(found).astype(np.int32)) if found else pa.array([], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), flat)], names=["doc_id", "ids"])
            else:
                digests = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]
                decoded = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids of each whole text."""
    C.tune(docs.sparkSession)
    bpe = Bpe(path or default_path())
    return C.texts(docs).mapInArrow(lambda b: _run(b, bpe, True), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of its ids."""
    bpe = Bpe(path or default_path())

    def run(batches):
        for b in batches:
            out = [None if x is None else bpe.decode(np.array(x, np.int64)).decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: its number of ids, and digests of the ids and of their decoding."""
    C.tune(docs.sparkSession)
    bpe = Bpe(path or default_path())
    return C.texts(docs).mapInArrow(lambda b: _run(b, bpe, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"))


QUERIES = {"op5_bpe_round_trip": query}
ORACLES: dict[str, str] = {}
