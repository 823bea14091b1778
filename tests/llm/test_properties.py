"""Properties of the numpy kernels on arbitrary texts, without Spark."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import bpe, lm, near, rules, secrets, suffix
from plumbline.llm import common as C

from .test_brute import brute_rules, brute_secrets

ALPHABET = "ab AB\n\t.,|#é漢1'<>-"
texts = st.lists(st.text(st.one_of(st.sampled_from(ALPHABET), st.characters(codec="utf-8")), max_size=60), max_size=8)
BPE = bpe.Bpe(bpe.default_path())


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


TOKENIZER = library()


@settings(max_examples=300, deadline=None)
@given(texts)
def test_bpe_is_the_library(found):
    for text, ids in zip(found, BPE.encode_batch(found), strict=True):
        want = TOKENIZER.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert BPE.decode(ids).decode() == TOKENIZER.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_rule_counts(found):
    data, offsets = C.buffers(pa.array(found, pa.string()))
    counts, features = rules.measure_buffers(data, offsets)
    assert counts.tolist() == [brute_rules(t) for t in found]
    assert np.isfinite(features).all()


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words(found):
    data, offsets = C.buffers(pa.array(found, pa.string()))
    start, end, at = C.words(data, offsets)
    own = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    assert [own[at[k] : at[k + 1]] for k in range(len(found))] == [t.encode().split() for t in found]
    hashes = C.span_hash(C.loads(data), start, end)
    assert len(set(zip(own, hashes.tolist(), strict=True))) == len(set(own)) == len(set(hashes.tolist()))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("tokenscrpawdAKI=: \"'0123456789abcdefé_-"), max_size=90))
def test_secret_spans(text):
    found = secrets.find(text)
    counts, base = brute_secrets(text)
    assert [len(found.get(k, ())) for k in secrets.KINDS[:3]] == counts and secrets.told(found, secrets.KINDS[:3]) == base


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 400), st.integers(0, 400)), min_size=1, max_size=6))
def test_repeats_through_a_family(cuts):
    """Entries through a family, and windows where segments differ, find exactly the repeated bytes."""
    rng = np.random.default_rng(4)
    pool = [bytes(rng.integers(97, 103, 450).astype(np.uint8)) for _ in range(4)]
    docs = [pool[k][min(a, b) : max(a, b)] + pool[(k + 1) % 4][a : a + 130] for k, a, b in cuts]
    data = np.frombuffer(b"".join(docs), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    anchor, segment, check, row, start, more = suffix.entries(data, offsets)
    rows = np.zeros(len(anchor), suffix.ENTRY)
    rows["anchor"], rows["segment"], rows["check"], rows["doc"], rows["start"], rows["more"] = (anchor >> np.uint64(32)).astype(np.uint32), segment, check >> np.uint64(32), row, start, more
    rows = rows[np.lexsort((rows["start"], rows["doc"]))]
    family, spans = suffix.Family(), [set() for _ in docs]
    for k in range(0, len(rows), 7):
        part = rows[k : k + 7]
        for e in part[family.add(part)]:
            spans[e["doc"]] |= set(range(int(e["start"]), int(e["start"]) + int(e["more"]) + 1))
    windows = [(d, s) for e in family.ambiguous() for d in [int(e["doc"])] for s in range(int(e["start"]), int(e["start"]) + int(e["more"]) + 1)]
    seen = {}
    for d, s in sorted(set(windows)):
        w = docs[d][s : s + 100]
        if w in seen:
            spans[d].add(s)
        seen.setdefault(w, (d, s))
    first = {}
    for d, raw in enumerate(docs):
        for s in range(len(raw) - 99):
            again = raw[s : s + 100] in first
            assert again == (s in spans[d])
            first.setdefault(raw[s : s + 100], (d, s))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=30), st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=30))
def test_nodes_are_weighted_sets(x, y):
    found = [" ".join(x), " ".join(y), " ".join(x).upper().replace(" ", ", ")]
    data, offsets = C.buffers(pa.array(found, pa.string()))
    row, key, weight = near.shingles(data, offsets)
    nodes = near._sums(3, row, key, weight)
    assert (nodes[0] == nodes[2]).all()
    grams = [sorted(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) > 4 else [tuple(w)] if w else [] for w in (x, y)]
    assert (grams[0] == grams[1]) == bool((nodes[0] == nodes[1]).all())


def thue_morse(doublings: int) -> tuple[str, str]:
    """A text of a and b in which polynomial hashes modulo powers of two meet its complement."""
    a, b = "a", "b"
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def test_regular_words_differ():
    for doublings in (7, 10, 13):
        a, b = thue_morse(doublings)
        pair, offsets = C.buffers(pa.array([f"{a} {b} {a}", f"{a}\n{b}\n{a}\n"]))
        counts, _ = rules.measure_buffers(pair, offsets)
        assert counts[:, 3].tolist() == [0, 1]  # repeated lines
        start, end, _ = C.words(pair, offsets)
        h = C.span_hash(C.loads(pair), start, end)
        assert len(set(h.tolist())) == 2 and h[0] == h[2] != h[1]
        assert len(set(lm._words(pair, offsets)[0].tolist())) == 2
        data, offsets = C.buffers(pa.array([" ".join([a, a, b, a, b, b]), " ".join([b, b, a, b, a, a])]))
        nodes = near._sums(2, *near.shingles(data, offsets))
        assert (nodes[0] != nodes[1]).any()
        data, offsets = C.buffers(pa.array([a + "x" * 100, b + "x" * 100]))
        segment = suffix.entries(data, offsets)[1]
        assert len(set(segment.tolist())) > 2


def test_hash_of_bytes_is_stable():
    data = np.frombuffer(b"hello world hello", np.uint8)
    h = C.span_hash(C.loads(data), np.array([0, 6, 12]), np.array([5, 11, 17]))
    assert h[0] == h[2] != h[1]
    assert re.fullmatch("[0-9a-f]{64}", hashlib.sha256(b"").hexdigest())
