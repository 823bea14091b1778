"""Operators against brute-force versions on the small documents."""

import collections
import functools
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontam, gru, licenses, lm, near, quality, rules, secrets, suffix, warc
from plumbline.llm import common as C
from plumbline.llm.lm import Vocabulary

from ..conftest import SMALL, same_rows
from .corpus import IDS, clashing, odd, odd_rows, prose


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def removed(texts: dict) -> dict:
    """doc -> which bytes a 100-byte string covers that starts earlier too."""
    seen, out = set(), {}
    for d in sorted(texts):
        raw = texts[d].encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        out[d] = gone
    return out


def test_suffix_dedup(spark, docs, texts):
    got = {r.doc_id: r for r in suffix.deduplicate(docs, True).collect()}
    for d, gone in removed(texts).items():
        raw = texts[d].encode()
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_overlaps(spark):
    passage, other = prose(50, 40), prose(51, 40)
    made = {1: passage + " one " + other, 2: "x" + passage[10:] + other[:150], 3: "aa" * 300, 4: passage[20:140] + other[30:160] + passage[5:150], 5: "é" * 120 + passage, 6: "é" * 120}
    got = {r.doc_id: r for r in suffix.deduplicate(spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(3)).collect()}
    for d, gone in removed(made).items():
        raw = made[d].encode()
        assert got[d].kept == bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        assert [*zip(got[d].starts, got[d].ends, strict=True)] == [m.span() for m in re.finditer(b"\1+", bytes(gone))]


def test_suffix_dedup_of_repeated_and_null_ids(spark):
    """Rows of one id but other texts are documents of their own; equal rows are the same one."""
    passage = prose(60, 30)
    rows = [(None, passage + " x"), (None, prose(61, 40)), (1, "a " + passage), (1, prose(62, 40) + passage), (1, prose(62, 40) + passage), (2, prose(63, 30))]
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), True).collect()]
    size = len(passage.encode())
    want = [(None, size + 2, 0), (None, len(rows[1][1].encode()), 0), (1, size + 2, size), (1, len(rows[3][1].encode()), size), (1, len(rows[3][1].encode()), size), (2, len(rows[5][1].encode()), 0)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_stored_levels_serve_further_batches(spark):
    passage, other = prose(150, 60), prose(151, 60)
    texts = {k: f"{prose(200 + k, 30)} {passage[k:]} {prose(300 + k, 20)} {other[: 200 + k]}" if k % 3 else prose(400 + k, 90) for k in range(30)}
    want = removed(texts)
    index = before = None
    for part in range(3):
        docs = spark.createDataFrame([(k, t) for k, t in texts.items() if k // 10 == part], "doc_id long, text string")
        found, index = suffix.extend(docs, 4, index, before, digest=True)
        got = {r.doc_id: r.n_removed for r in found.collect()}
        assert got == {k: sum(want[k]) for k in got}
        index = C.checkpoint(index)
        before = docs if before is None else before.union(docs)
    assert index.groupBy("shard", "level").count().filter("count > 1").count() == 0


def test_extreme_ids_stay(spark):
    docs = spark.createDataFrame([(-(2**63), prose(8, 40)), (None, prose(8, 40) + " x"), (2**63 - 1, "")], "doc_id long, text string")
    assert {r.doc_id for r in suffix.deduplicate(docs, True).collect()} == {-(2**63), None, 2**63 - 1}


def test_family_levels_are_logarithmic():
    family, seen = suffix.Family(), set()
    rng = np.random.default_rng(1)
    for k in range(64):
        batch = np.zeros(100, suffix.ENTRY)
        batch["segment"], batch["doc"], batch["start"] = rng.integers(0, 4000, 100), k, np.arange(100)
        later = family.add(batch)
        for s, again in zip(batch["segment"].tolist(), later.tolist(), strict=True):
            assert again == (s in seen)
            seen.add(s)
        assert len(family.levels) <= 8
    assert sorted(np.concatenate([x["segment"] for _, x in family.levels]).tolist()) == sorted(seen)


def test_contamination(spark, docs, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert got >= {(d, i) for i, item in items.items() for d, t in texts.items() if item in t}
    for d, i in got:  # what is told shares a run of 13 words with the item
        norm = lambda t: re.findall(r"[^\W_]+", t.lower())
        words, other = norm(items[i]), " " + " ".join(norm(texts[d])) + " "
        n = min(13, len(words))
        assert any(" " + " ".join(words[k : k + n]) + " " in other for k in range(len(words) - n + 1))


def test_templates_and_slots(spark):
    item = "A train leaves the old station at 9 and travels 120 km to meet Alice who then walks 3 miles home with Bob before 9 strikes again"
    same = item.replace("120", "455").replace("Alice", "Carol").replace("9", "7").replace("3 miles", "8 yards")
    broken = item.replace("at 9", "at 7")  # one value of the item meets two, but in no run of 13 tokens
    twice = "If 9 boys and 9 girls share cakes how many are left over"
    never = twice.replace("9 girls", "4 girls").replace("9 boys", "7 boys")
    docs = spark.createDataFrame([(1, f"intro text. {item} and more"), (2, f"Some words here. {same} end"), (3, f"lead in. {broken} end"), (4, prose(9, 200)), (5, f"so. {never} end"), (6, f"so. {twice.replace('9', '5')} end")], "doc_id long, text string")
    found = {r.doc_id: r for r in decontam.contaminated(docs, spark.createDataFrame([(7, item), (8, twice)], "item_id long, text string")).collect()}
    assert set(found) == {1, 2, 3, 6}
    assert found[1].exact and not found[2].exact and found[2].n_slots >= 5


@functools.cache
def canonical(text):
    """Template, value and whether a slot, for each token of a text, by regular expressions."""
    raw, out = text.encode().decode("latin-1"), []
    before = 0
    for m in re.finditer(r"(?:[0-9A-Za-z'\x80-\xff]|(?<=[0-9])[.,](?=[0-9]))+", raw):
        w = m[0]
        low = "".join(c.lower() if c < "\x80" else c for c in w)
        number = re.fullmatch(r"[0-9][^A-Za-z\x80-\xff]*", w)
        unit = low in decontam.UNITS and out and out[-1][0] == "#"
        fresh = not out or re.search(r'[.!?:;\n"]', raw[before : m.start()])
        name = re.match(r"[A-Z][a-z\x80-\xff]", w) and not fresh
        out.append(("#", low, True) if number else ("%", low, True) if unit else ("@", low, True) if name else (low, low, False))
        before = m.end()
    return out


def holds(text, item):
    """The rule of the operator, one alignment and one run after another."""
    doc, own = canonical(text), canonical(item)
    n, run = len(own), min(13, len(own))
    size = min(10, n)
    ok = lambda k, m=own: sum(not t[2] for t in m[k : k + size]) >= min(4, size)
    has = [k for k in range(n - size + 1) if n >= 5 and ok(k)]
    needed = min(len(has), run - size + 1)
    poor = [k for k in range(n - 12) if any(sum(not t[2] for t in own[j : j + 10]) < 4 for j in range(k, k + 4))] if n >= 13 else []
    step = 3 if n > 4 else 1
    places = [{tuple(t[k] for t in own[j : j + step]): [] for j in range(n - step + 1)} for k in (0, 1)]
    for k in (0, 1):
        for j in range(n - step + 1):
            places[k][tuple(t[k] for t in own[j : j + step])].append(j)
    shifts = {i - j for k in (0, 1) for i in range(len(doc) - step + 1) for j in places[k].get(tuple(t[k] for t in doc[i : i + step]), ())}
    for shift in shifts:  # where some tokens in a row are equal
        at = lambda k, m: 0 <= k + shift and k + shift + m <= len(doc)  # noqa: B023, E731
        for k, m in [(0, n)] * (n <= 13) + [(k, 13) for k in poor]:
            if m and at(k, m) and [t[1] for t in own[k : k + m]] == [t[1] for t in doc[k + shift : k + shift + m]]:
                return True
        met = [k for k in has if at(k, size) and [t[0] for t in own[k : k + size]] == [t[0] for t in doc[k + shift : k + shift + size]]]
        for part in [met] if needed < 4 else [[k, k + 1, k + 2, k + 3] for k in met if {k + 1, k + 2, k + 3} <= set(met)]:
            if needed and len(part) >= needed:
                pairs = {(own[j][1], doc[j + shift][1]) for k in part for j in range(k, k + size) if own[j][2]}
                if len(pairs) == len({a for a, _ in pairs}):
                    return True
    return False


def test_contamination_by_brute_force(spark, docs, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    some = dict(list(items.items())[:40])
    some |= {10**6 + k: t for k, t in enumerate(["Ada met Bob at 9 with 3 cups", "at 9", "", "In 1999 Ada, 5 km off, saw 12 birds with 7 eggs near 44 trees and 3 more, by 6 roads of 9 miles"])}
    changed = {10**6 + k: " ".join(re.sub(r"\d+", str(k), w) if k % 2 else w for w in f"Well then, {t} And on it went".split()).replace("Ada", "Eve") for k, t in enumerate(some.values())}
    every = dict(list(texts.items())[:40]) | changed
    rows = spark.createDataFrame(list(every.items()), "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(rows, spark.createDataFrame(list(some.items()), "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in every.items() for i, x in some.items() if holds(t, x)}
    assert len(got) > 40


def test_items_that_templates_cannot_tell(spark):
    items = [
        (1, "What is 12 + 345 * 7 - 18 / 3 + 44"), (2, "Ada Lovelace, Alan Turing, Grace Hopper, Kurt Godel, Emmy Noether, John Neumann, Max Planck, Lise Meitner"),
        (3, "Name the capital"), (4, "Seven birds sat upon the old wall"), (5, "On 3 May 1999 and 4 June 2001 rain fell all day here"),
    ]
    half = "one stone bridge crosses the wide river near our little town where children often play"
    items.append((6, half))
    held = {k: f"lead in, {t.lower() if k == 4 else t}, and more of it" for k, t in items}
    words = half.split()
    halves = [(9, " ".join(words[:11])), (9, " ".join(["x", "z", *words[2:13]]))]
    docs = spark.createDataFrame([*held.items(), (8, "nothing of the kind 12 + 345 - 7"), *halves], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(k, k) for k in held}  # 9: two rows hold parts of the item, and neither enough of it


@pytest.mark.parametrize("module", [suffix, licenses, warc])
def test_against_sql(spark, duck, module):
    for name, sql in module.ORACLES.items():
        same_rows(module.QUERIES[name](spark, SMALL), duck.sql(sql))


def test_license_texts(spark):
    full = licenses.TEMPLATES["mit-full"]
    rows = [(1, full), (2, "Copyright me\n\n" + licenses.TEMPLATES["mit-grant"].replace("free of charge", "gratis") + "\nmore"), (3, "x y"), (4, "RELEASED under the: MIT license!")]
    got = {r.doc_id: {h.id for h in r.hits} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: {"mit-full"}, 2: {"mit-grant"}, 3: set(), 4: {"mit"}}
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {str(k): "a b c" for k in range(300)})


def base_scores(texts):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = {d: [*t.encode().translate(low).split(), None] for d, t in texts.items()}
    counts = collections.Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    return {d: (len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)) for d, ws in words.items()}


def test_wrapped_notices(spark, duck):
    import textwrap

    def wrap(name, width, start=""):
        return "\n".join(start + line for line in textwrap.wrap(licenses.TEMPLATES[name], width))

    code = "\n".join(f"int f{k}(int x) {{ return x * {k}; }}" for k in range(120))
    made = {
        1: wrap("mit-full", 70, " * ") + "\n\n" + code, 2: code + "\n" + wrap("apache-2.0-header", 60, "# ") + "\n" + code, 3: code,
        4: f"{code}\n{wrap('bsd-3-clause-full', 78)}\n{code}", 5: "Released under\nthe MIT License.\nand more of it all here", 6: wrap("gpl-3.0-header", 40).replace("useful", "of use") + "\nint x;\n" + code, 7: None, 8: "a\n\nb",
    }
    rows = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    got = {r.doc_id: {h.id: h.dice for h in r.hits} for r in licenses.scan(rows).collect()}
    held = {1: "mit-full", 2: "apache-2.0-header", 4: "bsd-3-clause-full", 5: "mit", 6: "gpl-3.0-header"}
    assert all(i in got[d] for d, i in held.items()) and not got[3] and not got[7] and not got[8]
    con = duck.cursor()
    con.execute("CREATE OR REPLACE TEMP TABLE documents AS SELECT * FROM (VALUES " + ", ".join("(?::BIGINT, ?::VARCHAR)" for _ in made) + ") d(doc_id, text)", [x for r in made.items() for x in r])
    want = {d: (n, i, pytest.approx(b)) for d, n, i, b in con.sql(licenses.ORACLES["op3_license_scan"]).fetchall()}
    assert {d: (len(list(h)), ",".join(sorted(h)), max(h.values(), default=0.0)) for d, h in got.items()} == want


def test_language_model(spark, docs, texts, monkeypatch):
    for limit in (None, 500):  # with few known words, counts come from the shards
        if limit:
            monkeypatch.setattr(lm, "KNOWN", limit)
            monkeypatch.setattr(lm, "HEAD", 200)
            monkeypatch.setattr(lm, "ROUNDS", 1)
        got = {r.doc_id: r for r in lm.score(docs).collect()}
        for d, (n, known, total, score) in base_scores(texts).items():
            assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (n, known, total)
            assert got[d].base_score == pytest.approx(score, rel=1e-9)
        held = [r for r in got.values() if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_network_learns_all_tokens_of_any_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 3000)
    rows = [(k, "ha lo mi " * 10) for k in range(900)] + [(5000 + k, "ne re ta ku " * 10) for k in range(900)]
    docs = C.tune(spark).createDataFrame(rows, "doc_id long, text string")
    words = lm.most_frequent(lm.count_words(docs, 2), 100)
    vocabulary, counts = lm.Vocabulary(words, 100), np.r_[1800, words["n"], np.zeros(lm.TAILS)].astype(float)
    totals = lm.Totals(np.zeros(lm.TAILS), np.zeros(lm.TAILS), 1800)

    def network(of):
        coded = lm.encode(of.withColumn("uid", F.monotonically_increasing_id()), vocabulary, totals, 2).filter("shard IS NULL")
        return lm.train(coded.withColumnRenamed("blob", "ids"), vocabulary.head, counts, 70_000)

    batch = docs.filter("doc_id = 5000").toArrow().to_batches()[0]
    text = [ids[back] for _, _, ids, _, _, back, _ in lm._texts(batch, vocabulary)]
    whole, early = network(docs.coalesce(1)), network(docs.filter("doc_id < 5000"))
    assert whole.score(text)[0] / 41 > early.score(text)[0] / 41 + 0.3  # the order of the late words is learnt
    assert network(docs.repartition(7)).flat() == pytest.approx(whole.flat(), abs=1e-6)
    assert [lm.parts_of(n) for n in (0, 10**6, 10**9, 10**12)] == [1, 1, 512, 31250]
    model = gru.Gru(101, lm.TAILS, np.ones(101 + lm.TAILS))
    assert model.learn([np.arange(1, 100)]) == 100  # no rest is left out


def test_scores_word_by_word(spark, docs, texts, monkeypatch):
    """The score of a network with given weights: one word after another, with the counts of a dictionary."""
    monkeypatch.setattr(lm, "HEAD", 50)
    kept = {}

    def given(encoded, head, counts, tokens):
        model = kept["model"] = gru.Gru(head, lm.TAILS, counts)
        model.classes[:] = np.random.default_rng(3).normal(0, 0.3, model.classes.shape)
        return model

    monkeypatch.setattr(lm, "train", given)
    monkeypatch.setattr(lm, "Vocabulary", lambda known, head: kept.setdefault("vocabulary", Vocabulary(known, head)))
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    model, vocabulary = kept["model"], kept["vocabulary"]
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = {d: t.encode().translate(low).split() for d, t in texts.items()}
    counts = collections.Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)

    def coded(word):
        h, tail, _ = lm._words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        return int(vocabulary.find(h, tail)[0][0])

    ids = {w: coded(w) for ws in words.values() for w in ws}
    tails = collections.Counter(), collections.Counter()
    for w, n in counts.items():
        if ids[w] >= model.head:
            tails[0][ids[w]] += n
            tails[1][ids[w]] += 1
    for d in sorted(texts)[:12]:
        h, total, before = np.zeros((1, gru.SIZE)), 0.0, 0
        for w in [*words[d], None]:
            k = ids[w] if w else 0
            h, _ = model.step(model.vectors[model.rows(np.array([before]))] @ model.input + model.bias, h)
            kind = int(model.class_of(np.array([k]))[0])
            logits = (h @ model.classes + model.class_bias)[0]
            total += logits[kind] - math.log(np.exp(logits).sum())
            if k < model.head:
                inner = (h @ model.vectors[kind * gru.WIDTH : (kind + 1) * gru.WIDTH].T + model.word_bias[kind])[0]
                total += inner[k % gru.WIDTH] - math.log(np.exp(inner).sum())
            else:
                total += math.log((counts[w] + 0.5) / (tails[0][k] + 0.5 * (tails[1][k] + 1)))
            before = k
        assert got[d] == pytest.approx(total / math.log(10), rel=1e-4)


def test_network_sums_to_one_and_carries_state():
    model = gru.Gru(300, 7, np.arange(307) + 1.0)
    rng = np.random.default_rng(0)
    model.classes[:] = rng.normal(0, 0.3, model.classes.shape)
    h = rng.normal(0, 1, (5, gru.SIZE)).astype(np.float32)
    every = np.stack([model.log_probabilities(h.copy(), np.full(5, k)) for k in range(307)])
    assert np.exp(every).sum(0) == pytest.approx(np.ones(5), abs=1e-4)
    texts = [rng.integers(0, 307, n) for n in (0, 1, 5, 31, 32, 33, 200, 77)]
    for t in texts:
        t[t == 0] = 5
    alone = [model.score([t])[0] for t in texts]
    assert model.score(texts) == pytest.approx(alone, rel=1e-4)
    state, total = np.zeros((1, gru.SIZE), np.float32), 0.0
    table = model.vectors @ model.input + model.bias
    for x, y in zip([0, *texts[6]], [*texts[6], 0], strict=True):
        state, _ = model.step(table[model.rows(np.array([x]))], state)
        total += model.log_probabilities(state.copy(), np.array([y]))[0]
    assert alone[6] == pytest.approx(total, rel=1e-4)


def test_network_gradients(monkeypatch):
    monkeypatch.setattr(gru, "_F", np.float64)
    monkeypatch.setattr(gru, "SIZE", 4)
    monkeypatch.setattr(gru, "WIDTH", 3)
    model = gru.Gru(7, 2, np.arange(9) + 1.0)
    for n in model.names:
        setattr(model, n, getattr(model, n).astype(float))
    rng = np.random.default_rng(0)
    ids, target = rng.integers(0, 9, (2, 5, 3))

    def loss():
        h, total = np.zeros((3, 4)), 0.0
        table = model.vectors[model.rows(ids)] @ model.input + model.bias
        for t in range(5):
            h, _ = model.step(table[t], h * (ids[t] != 0)[:, None])
            total -= model.log_probabilities(h.copy(), target[t]).sum()
        return total / 15

    grads, _ = model._window(ids, target, np.zeros((3, 4)))
    for n in model.names:
        p = getattr(model, n)
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in p.shape)
            old = p[i]
            p[i] = old + 1e-5
            up = loss()
            p[i] = old - 1e-5
            down = loss()
            p[i] = old
            assert grads[n][i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_bpe(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([*list(texts.values())[:60], "a" * 5000, "<|endoftext|>a <|endoftext|>", "  \n\t x", "it's we'll 12³ ½ 漢字́", "=" * 900, "\x1c\x85\xa0 "])], "doc_id long, text string")
    encoded = {r.doc_id: r.ids for r in bpe.encode(rows).collect()}
    decoded = {r.doc_id: r.text for r in bpe.decode(bpe.encode(rows)).collect()}
    digests = {r.doc_id: r for r in bpe.digests(rows).collect()}
    for d, x in rows.collect():
        want = t.encode(x, add_special_tokens=False).ids
        assert encoded[d] == want and decoded[d] == t.decode(want, skip_special_tokens=False)
        assert (digests[d].n_tokens, digests[d].ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert digests[d].decoded_sha256 == hashlib.sha256(decoded[d].encode()).hexdigest()
    b = bpe.Bpe(bpe.default_path())
    assert b.decode(np.array([b.byte_ids[0xE6], b.byte_ids[0x41]])) == "�A".encode()
    for x in (b"abcabcabc" * 9, b"aaaa", "é漢".encode() * 7):
        assert b.heap_merge(x).tolist() == b.merge([x])[0].tolist()


def brute_secrets(text):
    found = []
    for k, (kind, pattern, ok) in enumerate([
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]):
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if ok(m)]
    found.sort()
    return [sum(f[1] == k for f in found) for k in range(3)], ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in found)


def test_secrets(spark, docs, texts):
    extra = {10**6: "é PASSWORD = 'abcdef' token:short1 ſecret=abcdefgh AKIA" + "A" * 16 + " AKIAAKIA " + "0a" * 13, 10**6 + 1: "api_key='x' apikey: \"yyyyyyyy\" -----BEGIN RSA PRIVATE KEY----- " + "f" * 30 + "g"}
    more = spark.createDataFrame(list(extra.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(docs.select("doc_id", "text").union(more))[0].collect()}
    for d, t in (texts | extra).items():
        counts, base = brute_secrets(t)
        assert [got[d].n_assign, got[d].n_access, got[d].n_hex] == counts
        assert got[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(got[d].spans.split(",")) | {""}
    assert "private_key:" in got[10**6 + 1].spans


def test_ledger_is_incremental(spark, monkeypatch):
    a = spark.createDataFrame([(1, "token = abcdefgh"), (2, "nothing"), (3, "nothing")], "doc_id long, text string")
    _, ledger = secrets.scan(a)
    assert ledger.count() == 2
    b = spark.createDataFrame([(2, "nothing"), (4, "secret: zzzzzzzz"), (5, "token = abcdefgh")], "doc_id long, text string")
    assert [r.spans for r in secrets.scan_unseen(b, ledger).collect()] == ["assign:0:16"]
    found, after = secrets.scan(b, ledger)
    assert {r.doc_id: r.n_assign for r in found.collect()} == {2: 0, 4: 1, 5: 1} and after.count() == 3
    monkeypatch.setattr(secrets, "RULE_VERSION", 2)
    assert secrets.scan_unseen(b, ledger).count() == 3


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "my token = abcdefgh end", 23), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, secrets.redact(docs).collect())) == [(1, "my <secret> end", 15), (2, "clean", 5), (3, None, None)]


def labelled(spark):
    return {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    machine = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.score(docs, machine).collect()}
    held = [(got[d], q) for d, q in labelled(spark).items() if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(0 <= s <= 1 for s in got.values()) and np.mean([(s >= 0.5) == (q == 1) for s, q in held]) > 0.97
    blind = docs.select("doc_id", "text", "n_chars")
    assert {r.doc_id: r.score for r in quality.score(blind, machine).collect()} == pytest.approx(got)


def test_machine_identity():
    machine = quality.Machine()
    rng = np.random.default_rng(0)
    machine.factor[:], machine.weight[:] = rng.normal(0, 1, machine.factor.shape), rng.normal(0, 1, machine.weight.shape)
    which, value = rng.permutation(quality.INPUTS)[:9], rng.normal(0, 1, 9)
    want = machine.weight[which] @ value + sum(machine.factor[which[a]] @ machine.factor[which[b]] * value[a] * value[b] for a in range(9) for b in range(a))
    assert machine.raw(1, np.zeros(9, int), which, value)[0][0] == pytest.approx(want, rel=1e-4)


def brute_rules(text):
    words, seen, dups = re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    windows, cover = collections.Counter(zip(words, words[1:], words[2:], strict=False)), set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(cover)]


def test_rules(spark, docs, texts):
    extra = {10**6 + k: r[1] or "" for k, r in enumerate(odd_rows())} | {2 * 10**6: "a b c a b c\n\nx\nx\n x y\n", 2 * 10**6 + 1: "|".join("#é" * 9) + "\x0b\x0c "}
    more = spark.createDataFrame(list(extra.items()), "doc_id long, text string")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = {r.doc_id: r for r in rules.judge(docs.select("doc_id", "text").union(more), labels).collect()}
    for d, t in (texts | extra).items():
        counts = brute_rules(t)
        assert [got[d][c] for c in rules.COUNTS] == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert got[d].base_failed == failed and not (failed and got[d].kept)


def test_forest_parts_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in rules.judge(docs, labels).collect()}
    marks = labelled(spark)
    good = [rows[d].kept for d, q in marks.items() if q == 1 and not rows[d].base_failed]
    bad = [rows[d].kept for d, q in marks.items() if q == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.05
    kept = {r.doc_id for r in rules.keep(docs, labels).collect()}
    assert kept == {d for d, r in rows.items() if r.kept}


def test_isolation_paths():
    rng = np.random.default_rng(0)
    rows = np.r_[rng.normal(0, 1, (500, 3)), [[9, 9, 9]]]
    score = rules.Forest(rows).score(rows)
    assert score.argmax() == 500 and 0 < score.min() and score.max() < 1


def weighted(text):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def probability_jaccard(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in set(a) & set(b))


def test_near_duplicates(spark, docs, texts):
    got = {r.doc_id: r.class_id for r in near.classes(docs).collect()}
    sets = {d: weighted(t) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            if len(sets[a] & sets[b]) > 0.3 * len(sets[a]) and probability_jaccard(sets[a], sets[b]) >= 0.8 - 1e-12:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert got == {d: root(d) for d in sets}


def test_similarity_and_signatures():
    rng = np.random.default_rng(3)
    for _ in range(20):
        keys = rng.choice(10**6, 60, replace=False).astype(np.uint64)
        a, b = np.sort(keys[:40]), np.sort(keys[15:])
        x, y = rng.integers(1, 4, 40).astype("<u4"), rng.integers(1, 4, 45).astype("<u4")
        want = probability_jaccard(collections.Counter(dict(zip(a.tolist(), x.tolist(), strict=True))), collections.Counter(dict(zip(b.tolist(), y.tolist(), strict=True))))
        assert near.similarity((a, x), (b, y)) == pytest.approx(want)
    agreed = []
    for seed in range(40):
        keys = np.random.default_rng(seed).integers(1, 2**63, 60).astype(np.uint64)
        w = np.ones(60, np.int64)
        v = near.signatures(2, np.r_[np.zeros(50, int), np.ones(50, int)], np.r_[keys[:50], keys[10:]], np.r_[w[:50], w[10:]])
        agreed.append((v[0] == v[1]).mean())
    assert np.mean(agreed) == pytest.approx(40 / 60, abs=0.03)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies that drift from each other link in a chain; none of its links is lost in blocks."""
    monkeypatch.setattr(near, "SMALL", 4)
    monkeypatch.setattr(near, "BLOCK", 8)
    words, rows = prose(77, 150).split(), []
    for k in range(60):
        words[(k * 7) % 150] = f"changed{k}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}


def test_one_of_each_by_row(spark):
    a, b, c = prose(70, 120), prose(71, 120), prose(72, 120)
    near_a, near_c = a + " more", c + " more"
    rows = [(3, a), (5, near_a), (5, b), (6, c), (6, near_c), (None, prose(73, 120)), (None, prose(73, 120)), (None, near_a), (7, ""), (8, None)]
    for part in (rows, rows[5:7]):  # what stays of null ids does not turn on other rows
        docs = spark.createDataFrame(part, "doc_id long, text string").repartition(3)
        kept = [tuple(r) for r in near.one_of_each(docs).collect()]
        ours = {(3, a), (5, b), (7, ""), (8, None), (None, prose(73, 120))} & set(part)
        assert ours <= set(kept) and len(kept) == len(ours) + (part is rows)  # and one of doc_id 6
        assert sum(d == 6 for d, _ in kept) == (part is rows)


def test_warc_finds_corruption(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    stored = warc.records(pages)
    ours = warc.tree(stored)[1]
    spoiled = warc.decayed(stored, 7)
    found = {r.path for r in warc.audit(ours, warc.tree(spoiled)[1]).collect()}
    changed = {a.key for a, b in zip(stored.orderBy("key").collect(), spoiled.orderBy("key").collect(), strict=True) if a.record != b.record}
    assert changed and {int(p, 16) - 2**63 for p in found} == changed
    lost = warc.audit(ours, warc.tree(stored.filter("key <> 3"))[1]).collect()
    assert len(lost) == 1 and lost[0].right_hash is None


def test_records_of_one_key_are_told_apart(spark):
    """A key with most rows: the audit names the changed record and its place, not the key."""
    rows = [(7, "u", f"<p>{k % 150}</p>") for k in range(200)] + [(k, "v\r\nX: y", "") for k in range(20)] + [(None, None, None)] * 3
    stored = C.checkpoint(warc.records(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)))
    bad = [r for r in stored.filter("key = 7").distinct().collect()][:2]
    replica = stored.withColumn("record", F.when(F.col("record") == bad[0].record, F.lit("other")).otherwise(F.col("record"))).filter(F.col("record") != bad[1].record)
    found = warc.fixity(stored, replica).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert {r.digest for r in found if r.corrupt} == {digest(x.record) for x in bad}
    order = sorted(stored.collect(), key=lambda r: (r.key is not None, r.key, digest(r.record)) if r.key is not None else (False, 0, digest(r.record)))
    data = "".join(r.record for r in order).encode()
    for r in found:
        assert digest(data[r.offset : r.offset + r.bytes // r.records].decode()) == r.digest
    assert sum(r.records for r in found) == len(rows)


def test_warc_bytes_are_read_back(spark, tmp_path):
    rows = [(1, "http://a/?x=1", "<p>\u00e9\r\n\r\n</p>"), (2, "http://b\r\nEvil: 1", None)]
    stored = warc.records(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("key").collect()
    data = "".join(r.record for r in stored).encode()
    (tmp_path / "x.warc").write_bytes(data)
    found = warc.read(spark, str(tmp_path)).orderBy("offset").collect()
    assert [r.uri for r in found] == ["http://a/?x=1", "http://b%0D%0AEvil: 1"] and found[0].type == "response"
    for r, (_, _, html) in zip(found, rows, strict=True):
        head, body = bytes(r.block).split(b"\r\n\r\n", 1)
        assert head.startswith(b"HTTP/1.1 200 OK") and body == (html or "").encode()
        assert r.payload_digest == "sha256:" + hashlib.sha256(body).hexdigest()
    every = list(warc.parse(data))
    assert all({"warc-record-id", "warc-date", "warc-type", "content-length"} <= set(h) for _, h, _ in every)
    with pytest.raises(ValueError):
        list(warc.parse(data[:-1]))


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "tokens"]
    steps, now = {}, docs
    for n, f in p.STAGES:
        now = C.checkpoint(f(spark, now, SMALL))
        steps[n] = now
        if n != "tokens":
            assert now.columns == docs.columns
    assert p.run(spark, SMALL).count() == now.count()
    texts = {r.doc_id: r.text for r in steps["secret_scan"].collect()}
    assert all(brute_secrets(t)[0] == [0, 0, 0] for t in texts.values())
    sets = {d: weighted(r) for d, r in texts.items()}
    order = sorted(sets)
    assert not any(len(sets[a] & sets[b]) > 0.5 * len(sets[a]) and probability_jaccard(sets[a], sets[b]) >= 0.85 for i, a in enumerate(order) for b in order[:i])
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert not any(i in t for t in texts.values() for i in items)
    decoded = {r.doc_id: r.text for r in bpe.decode(now).collect()}
    assert decoded == texts


def test_registered(spark):
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
    assert len([n for n in names if re.match(r"op\d+_", n)]) == 10 and "pipeline" in names
    assert len(IDS) == len(odd_rows()) and odd(spark).count() == clashing(spark).count()
