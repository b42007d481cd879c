"""The pipeline against plain passes over the same rows."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm.queries import table, tokenizer_path
from tessera.session import staged

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


def _kept(spark, folder):
    """Ids that the first two stages keep, and the texts: scores from the operator, the rest by brute force."""
    labels = table(spark, folder, "labels")
    docs = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").select("doc_id", "text").collect()}
    good = {r["doc_id"] for r in quality.quality_scores(table(spark, folder, "documents"), labels).filter("score >= 0.3").collect()}
    latest = {}
    for d in good:
        key = brute.fold(docs[d])
        latest[key] = max(latest.get(key, d), d)
    return [good, set(latest.values())], docs


def _clean(spark, folder, docs, ids):
    items = [tuple(r) for r in table(spark, folder, "benchmark").select("item_id", "text").collect()]
    found = brute.contaminated([(d, docs[d]) for d in ids], items)
    return {d for d in ids if not found[d][1]}


def _is_single(docs, unique, kept):
    """Nothing goes that has no near copy, and nearly every near copy goes."""
    least = brute.near_groups([(d, docs[d]) for d in unique])
    single = {d for d in unique if least[d] == d}
    assert single <= kept
    assert len(kept - single) <= 0.05 * len(unique - single)


@pytest.mark.parametrize("folder", FOLDERS)
def test_stages_equal_brute_force(spark, folder):
    want, texts = _kept(spark, folder)
    docs = table(spark, folder, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), "test-stage")
        assert docs.columns == columns, name
        ids = [r[0] for r in docs.select("doc_id").collect()]
        assert len(ids) == len({*ids}), name
        kept.append({*ids})
    assert kept[:2] == want
    _is_single(texts, want[1], kept[2])
    assert kept[3] == _clean(spark, folder, texts, kept[2])
    name, last = corpus_pipeline.STAGES[-1]
    pieces = last(spark, docs, folder).select("doc_id", "start", "length", "doc_tokens").collect()
    sizes = {}
    for r in pieces:
        sizes.setdefault(r["doc_id"], []).append(r["length"])
        assert 0 <= r["start"] < r["doc_tokens"]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert {d: sum(n) for d, n in sizes.items()} == {d: len(tokenizer.encode(texts[d], add_special_tokens=False).ids) + 1 for d in kept[3]}


def test_run_is_all_stages(spark):
    folder = FOLDERS[0]
    docs = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), "test-run")
    ids = lambda df: {r[0] for r in df.select("doc_id").distinct().collect()}
    assert ids(corpus_pipeline.run(spark, folder)) == ids(docs)


def test_odd_rows_go_through(spark, documents):
    """Nulls, blanks, repeated rows, clashing columns and an empty table."""
    rows = [(None, None), (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y z"), (4, "word " * 3000)]
    for source in (rows, []):
        docs = documents(source)
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = staged(stage(spark, docs, FOLDERS[0]), "test-odd")
            assert docs.columns == columns
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDERS[0])
        assert packed.select(F.count("*")).first()[0] >= docs.count()
