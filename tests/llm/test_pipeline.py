"""The stages against plain versions, each on what the one before kept."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_documents import base_spans
from tests.llm.test_near_duplicates import brute
from tests.llm.test_tokens import ids_of
from waybill.llm import mixing
from waybill.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The rows after each stage, the input first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], sf_dir), "stage"))
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(df.columns == COLUMNS for df in stages[:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_clean_documents_of_a_language_stay(stages):
    assert ids(stages[1]) == ids(stages[0])


FOREIGN = [
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.", "所有幸福的家庭都彼此相似而不幸的家庭各有各的不幸",
    "Tutte le famiglie felici sono simili fra loro, ogni famiglia infelice è infelice a modo suo.",
    "def train(docs, folds=5):\n    for batch in batches:\n        yield pd.DataFrame(out, columns=names)", "asdfjkl qwerty zxcvb hjklasd wqrtzp xcvbnm qqwx zzxk jkjkjh wvbzx", "1234 !!", ""]


def test_texts_of_no_learned_language_go(spark, sf_dir):
    """Other scripts, another language, program code, keyboard noise and texts without letters, among the given documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(10 ** 9 + k, t, None, None, len(t)) for k, t in enumerate(FOREIGN)], docs.schema)
    kept = ids(corpus_pipeline.in_a_language(spark, docs.unionByName(more), sf_dir))
    assert kept == ids(docs)


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    kept = Counter(i for (i, _), (own, _, part) in zip(rows, brute(rows, 5)) if own == part)
    assert ids(stages[2]) == kept and len(kept) < len(rows)


def test_personal_data_goes(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, row in before.items():
        spans = base_spans(row.text)
        assert not base_spans(after[i].text)
        if not spans:
            assert after[i] == row
    assert any(base_spans(r.text) for r in before.values())


def test_mix_follows_its_plan(stages):
    assert ids(stages[4]) == +Counter({r.doc_id: r.copies for r in mixing.plan(stages[3]).collect()})


def test_packed_rows_hold_all_tokens(stages):
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    copies = ids(stages[4])
    lengths, sequences = defaultdict(int), defaultdict(int)
    for r in stages[5].collect():
        lengths[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
    assert dict(lengths) == {i: n * (len(ids_of(texts[i])) + 1) for i, n in copies.items()}
    assert max(sequences.values()) <= 2048


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    rows = lambda df: Counter(map(tuple, df.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(stages[5])


def test_equal_ids_with_unlike_texts_go_through_all_stages(spark, sf_dir):
    """Rows that share a doc_id are documents of their own: near copies, long texts and plain repetitions."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null").limit(60)
    texts = [r.text for r in given.collect() if len(r.text) > 200][:12]
    rows = [(7, t, "en", "s", len(t)) for t in texts] + [(7, texts[0], "en", "s", 1)] * 3 + [(8, " ".join(texts * 60), "en", "t", 1), (None, texts[1], "en", None, 1)]
    # Without the documents they were taken from, which would stand for them.
    others = given.join(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "left_anti").select(given.columns)
    docs = others.unionByName(spark.createDataFrame(rows, given.schema))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    assert docs.where("doc_id = 7 or doc_id = 8 or doc_id is null").select("doc_id", "text").distinct().count() > 5
    mixed = staged(corpus_pipeline.STAGES[3][1](spark, docs, sf_dir), "stage")
    assert mixed.where("doc_id = 7").count() > 0
    assert corpus_pipeline.STAGES[4][1](spark, mixed, sf_dir).where("doc_id = 7 and start = 0").count() == mixed.where("doc_id = 7").count()


def test_odd_and_no_rows(spark, odd, empty, sf_dir):
    for docs in (odd, empty):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = staged(stage(spark, docs, sf_dir), "stage")
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()
