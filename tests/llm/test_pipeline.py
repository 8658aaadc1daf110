"""The pipeline against a plain version of its stages, and its queries against SQL."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import language_id, oracles, pii, queries
from gridloom.llm.samples import fold
from tests.llm.test_exact import expect_hits, expect_links


def plain(value):
    return repr(value) if isinstance(value, float) and not math.isnan(value) else str(value)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    relation = duck.sql(oracles.SQL[name])
    names = list(relation.columns)
    assert sorted(names) == columns
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in relation.fetchall())


def test_pipeline(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    model = language_id.fit(table, fold("doc_id", 4) != 2)
    keep = {r.doc_id for r in language_id.identify(table, model).collect() if r.lang_pred != "und"}
    keep = {d for d, _, c in expect_links([(d, docs[d]) for d in sorted(keep)]) if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    keep = {d for d, n, hit, _ in expect_hits([(d, docs[d]) for d in sorted(keep)], items) if not (hit and 20 * hit >= n)}
    placed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in placed} == keep
    clean = corpus_pipeline.redact_personal_data(spark, table, sf_dir)
    assert clean.columns == list(corpus_pipeline.COLUMNS)
    assert not [r for r in clean.collect() if list(x for x in pii.base_spans(r.text.encode()) if x[3])]


@pytest.mark.parametrize("languages", [3, 4])
def test_evenly_mixed_documents_stay(spark, sf_dir, languages):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = table.where(F.col("lang").isNotNull() & (F.col("n_chars") > 1500)).orderBy("doc_id").collect()
    lines = [" ".join(next(r.text for r in rows if r.lang == lang).split()[:40]) for lang in sorted({r.lang for r in rows})]
    assert len(lines) >= 4
    text = "\n".join(lines[-languages:])
    mixed = spark.createDataFrame([(-1, text, None, "planted", len(text)), (-2, text + " ", "en", "planted", len(text) + 1), (-3, "12 34 ...", "en", "planted", 9)], table.schema)
    kept = corpus_pipeline.identify_language(spark, table.unionByName(mixed), sf_dir).where("doc_id < 0").collect()
    assert {r.doc_id for r in kept} == {-1, -2}
    assert all(r.lang for r in kept)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def kept_texts(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "s", None, 1, "x") for d, t in rows], DOCUMENTS + ", row int, component_id string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    return sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)


def test_duplicates_are_decided_by_row(spark, prose):
    a, b, c = prose(40), prose(40), prose(40)
    near = a + " " + prose(1)
    got = kept_texts(spark, [(1, a), (7, a), (7, b), (9, c), (9, c), (4, near), (None, b), (None, "only here " * 9), (5, None), (5, ""), (6, None)])
    assert got == sorted([(1, a), (7, b), (9, c), (None, "only here " * 9), (5, None), (5, ""), (6, None)], key=str)


def test_stages_on_empty_and_odd_rows(spark, sf_dir, odd_docs, no_docs, prose):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, no_docs, sf_dir)
        assert out.count() == 0
        odd = odd_docs.unionByName(spark.createDataFrame([(50, prose(30), "en", "src", 1, "x", "x", 1, "x", "x")] * 2, odd_docs.schema))
        found = stage(spark, odd, sf_dir).collect()
        if name == "best_fit_packing":
            assert len({r.doc_id for r in found}) == odd.select("doc_id").distinct().count()
            continue
        assert out.columns == list(corpus_pipeline.COLUMNS)
        texts = [(r.doc_id, r.text) for r in found]
        whole = [(r.doc_id, r.text) for r in odd.collect()]
        if name == "language_id":
            assert sorted(texts, key=str) == sorted(((d, t) for d, t in whole if t and any(x.isalpha() for x in t)), key=str)
            assert all(r.lang for r in found)
        elif name == "ngram_jaccard_join":
            assert len(texts) == len(set(texts)) and {t for _, t in texts} <= {t for _, t in whole}
        elif name == "decontaminate":
            assert sorted(texts, key=str) == sorted(whole, key=str)
        else:
            assert len(texts) == len(whole) and [r for r in found if r.doc_id == 14][0].text.endswith("mail [EMAIL]")
