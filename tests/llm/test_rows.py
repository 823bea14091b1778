"""Every operator on odd rows, on clashing columns and on an empty table: a defined result, a row
for each document where that is due, and no crash."""

import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontam, licenses, lm, near, quality, rules, secrets, suffix, warc

from .corpus import IDS, clashing, empty, ids, odd

LABELS = "doc_id long, quality int, toxic int"


def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 0), (3, None, 1), (0, 1, 0)], LABELS)


def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (None, None), (2, "")], "item_id long, text string")


ONE_ROW_EACH = {
    "op1": lambda s, d: suffix.deduplicate(d, True), "op1_bytes": lambda s, d: suffix.deduplicate(d), "op3": lambda s, d: licenses.scan(d), "op4": lambda s, d: lm.score(d),
    "op5": lambda s, d: bpe.digests(d), "op5_ids": lambda s, d: bpe.encode(d), "op6": lambda s, d: secrets.scan(d)[0], "op7": lambda s, d: quality.score(d, quality.fit(d, labels(s))),
    "op8": lambda s, d: rules.judge(d, labels(s)), "op10": lambda s, d: near.classes(d),
}
FILTERS = {
    "rules": lambda s, d: rules.keep(d, labels(s)), "near": lambda s, d: near.one_of_each(d), "decontam": lambda s, d: decontam.clean(d, bench(s)), "redact": lambda s, d: secrets.redact(d),
}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_odd_rows(spark, name):
    assert ids(ONE_ROW_EACH[name](spark, odd(spark))) == IDS


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_clashing_columns(spark, name):
    assert ids(ONE_ROW_EACH[name](spark, clashing(spark))) == IDS


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_empty_table(spark, name):
    assert ONE_ROW_EACH[name](spark, empty(spark)).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(spark, name):
    for docs in (odd(spark), clashing(spark), empty(spark)):
        out = FILTERS[name](spark, docs)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert set(ids(out)) <= set(IDS)


def test_empty_labels_and_benchmark(spark):
    none = spark.createDataFrame([], LABELS)
    assert rules.judge(odd(spark), none).count() == len(IDS)
    assert {r.score for r in quality.score(odd(spark), quality.fit(odd(spark), none)).collect()} == {0.5}
    assert decontam.contaminated(odd(spark), spark.createDataFrame([], "item_id long, text string")).collect() == []
    assert decontam.contaminated(empty(spark), bench(spark)).collect() == []


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (2, None, None), (None, "v", "b"), (-5, "w", ""), (2**40, "x", "é")], "page_id long, url string, html string")
    stored = warc.records(pages.withColumn("path", F.lit(1)).withColumn("hash", F.lit(2)))
    trees = warc.tree(stored)[1]
    assert warc.audit(trees, warc.tree(stored.repartition(5))[1]).count() == 0
    placed = sorted(warc.offsets(trees).collect(), key=lambda r: r.offset)
    assert [r.offset for r in placed] == [0, *[sum(x.bytes for x in placed[: k + 1]) for k in range(len(placed) - 1)]]
    assert sum(r.records for r in placed) == 6
    nothing = warc.tree(warc.records(pages.limit(0)))[1]
    assert warc.offsets(nothing).count() == 0 and warc.audit(nothing, nothing).count() == 0
    assert warc.audit(trees, nothing).count() == len(placed)


def test_secrets_are_scanned_by_one_python_worker_of_a_task(spark):
    docs = spark.createDataFrame([(k, f"password = hunter{k % 7}{'x' * k}" if k % 3 else "password = hunter22") for k in range(30)], "doc_id long, text string")
    found = secrets.scan_unseen(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
    assert len(rows := found.collect()) == len({r.blob for r in rows}) == docs.select("text").distinct().count()
    assert all(r.spans.startswith("assign:0:") for r in rows)
