"""The digest index: batches run again, ids of any type, rare digests met by merge join."""

import pytest

from tessera.llm import exact_dedup as E


@pytest.fixture
def index(spark):
    with E.scratch_index(spark) as made:
        yield made


def answers(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)


def test_a_batch_run_again_gets_its_answers_again(spark, documents, index):
    first = documents([(i, f"text {i % 7}") for i in range(40)])
    second = documents([(i, f"text {i % 9}") for i in range(40, 80)])
    one, two = answers(index.add(first)), answers(index.add(second))
    assert answers(index.add(first)) == one and answers(index.add(second)) == two
    assert sum(r[3] for r in one) == 7 and sum(r[3] for r in two) == 2
    assert index.rows().count() == 9


def test_named_batches(spark, documents, index):
    rows = documents([(1, "a"), (2, "b")])
    assert [r[3] for r in answers(index.add(rows, "monday"))] == [True, True]
    assert [r[3] for r in answers(index.add(rows, "tuesday"))] == [False, False]
    assert [r[3] for r in answers(index.add(rows, "monday"))] == [True, True]


def test_rare_digests_meet_by_merge_join(spark, documents, monkeypatch):
    """With few digests counted as hot most go the other way; the rows are the same."""
    rows = [(i, "common" if i % 3 == 0 else f"rare {i // 2}") for i in range(600)]
    want = answers(E.batched_duplicates(documents(rows)))
    monkeypatch.setattr(E, "HOT_SHARE", 4)
    assert answers(E.batched_duplicates(documents(rows))) == want
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    assert want == sorted(((i, max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in rows), key=str)


def test_ids_of_text(spark):
    df = spark.createDataFrame([(f"d{i:03}", f"t {i % 5}") for i in range(50)] + [(None, "t 1"), (None, None)], "doc_id string, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in E.batched_duplicates(df).collect() if r.doc_id}
    assert got["d003"] == ("d048", 10) and got["d001"] == ("d046", 11)
    assert E.batched_duplicates(df.limit(0)).count() == 0


def test_a_very_long_text(spark, documents):
    rows = [(1, "Word " * 400_000), (2, "word " * 400_000), (3, "word")]
    assert [r[3] for r in answers(E.batched_duplicates(documents(rows)))] == [False, True, True]


def test_no_table_is_left_behind(spark, documents):
    before = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(RuntimeError):
        with E.scratch_index(spark) as made:
            made.add(documents([(1, "a")]))
            raise RuntimeError
    assert {t.name for t in spark.catalog.listTables()} == before
