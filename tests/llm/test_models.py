"""Trained operators, by held-out accuracy and on odd rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import language_id, quality, queries, toxicity
from gridloom.llm.samples import draw, fold, labelled


@pytest.fixture(scope="module")
def more(sf_dir):
    """The next larger tables, if there: training needs some hundreds of labels."""
    from pathlib import Path

    larger = Path(sf_dir).parent / "sf0.01"
    return str(larger) if larger.exists() else sf_dir


def recalls(df, want):
    """Shares of held-out rows of label 0 and of label 1 that are predicted so: a constant answer has 0 in one of them."""
    rows = df.where("held_out").select("predicted", F.col(want).alias("y")).collect()
    return tuple(sum(r.predicted == y for r in rows if r.y == y) / sum(r.y == y for r in rows) for y in (0, 1))


def check_scored(spark, found, sf_dir, folds, held):
    """Every output column of a classifier's query."""
    assert dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert len({r.predicted for r in rows}) == 2


def test_language_id(spark, more, odd_docs, no_docs):
    docs = spark.read.parquet(f"{more}/documents.parquet")
    found = queries.op9_language_id(spark, more).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    model = language_id.fit(docs, fold("doc_id", 4) != 2)
    odd = {(r.doc_id, r.text): r for r in language_id.identify(odd_docs, model, "doc_id", "text", "source").collect()}
    assert {odd[4, None].lang_pred, odd[5, ""].lang_pred, odd[13, "12 34 ..."].lang_pred} == {"und"}
    assert language_id.identify(odd_docs, model).count() == odd_docs.count()
    assert language_id.identify(no_docs, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd_docs, language_id.fit(no_docs, F.lit(True))).collect()} == {"und"}


def test_words_of_switched_text(spark, more):
    import numpy as np
    import pyarrow as pa

    docs = spark.read.parquet(f"{more}/documents.parquet")
    model = language_id.fit(docs, fold("doc_id", 4) != 2)
    lines = {r.lang: r.text.split("\n")[0] for r in docs.where((fold("doc_id", 4) == 2) & F.col("lang").isin("en", "de")).orderBy("doc_id").limit(40).collect()}
    text = " ".join(lines[k] for k in ("en", "de"))
    _, _, starts, _, _, both = next(language_id.label_words(pa.array([text]), model))
    labels = np.array(model.languages)[both.argmax(axis=1)]
    switch = len(lines["en"].encode())
    assert (labels == np.where(starts < switch, "en", "de")).mean() > 0.9


@pytest.mark.parametrize("segment", [1, 2, 3, 100])
def test_forward_backward_by_enumeration(segment):
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    scores, moves = rng.normal(size=(12, 3)), rng.normal(size=(3, 3))
    first, size = np.array([0, 4, 5, 7]), np.array([4, 1, 2, 5])
    both, gained, _ = language_id.posteriors(scores, first, size, moves, want_moves=True, segment=segment)
    want_moves = np.zeros((3, 3))
    for s, n in zip(first, size, strict=True):
        weight, pairs, total = np.zeros((n, 3)), np.zeros((3, 3)), 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(scores[s + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += p
            for i, y in enumerate(path):
                weight[i, y] += p
            for a, b in itertools.pairwise(path):
                pairs[a, b] += p
        assert np.allclose(both[s : s + n], weight / total)
        want_moves += pairs / total
    assert np.allclose(gained, want_moves)


def test_a_long_line_is_one_chain(prose):
    import numpy as np
    import pyarrow as pa

    model = language_id.train([prose(200), "la el los de que " * 40], ["xx", "es"])
    text = pa.array([prose(700) + " " + "la el los de que " * 260, prose(3), ""])
    _, _, _, _, at, both = next(language_id.label_words(text, model))
    assert at[1] == 2000
    for a, b, data, starts, ends, at in language_id._words(text):
        scores = language_id.emissions(language_id.features(data, starts, ends, language_id.bt.span_hashes(data, starts, ends)), model.weights).astype(np.float64)
        first, size = language_id.chains(data, starts, at)
        assert size.tolist() == [2000, 3]
        whole, _, _ = language_id.posteriors(scores, first, size, model.moves.astype(np.float64), segment=10**6)
    assert np.allclose(both, whole, atol=1e-4)


def test_quality(spark, more, odd_docs, no_docs):
    labels = spark.read.parquet(f"{more}/labels.parquet")
    found = queries.op2_quality(spark, more)
    check_scored(spark, found, more, 3, 1)
    low, high = recalls(found.join(labels, "doc_id"), "quality")
    assert low >= 0.6 and high >= 0.85
    net = quality.start(1)
    assert all(0 <= r.score <= 1 for r in quality.score(odd_docs, net).collect())
    assert quality.score(no_docs, net).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(odd_docs, quality.fit(odd_docs, none, F.lit(True))).collect()} == {0.5}


def test_a_score_does_not_depend_on_neighbours(prose):
    import numpy as np
    import pyarrow as pa

    from gridloom.llm import bytetext

    net = quality.start(4)
    texts = [prose(n) for n in (1, 40, 300)] + ["", "x" * 251, "y" * 252, "z" * 256]
    together = quality.scores(net, *bytetext.flat(pa.array(texts)))
    alone = np.concatenate([quality.scores(net, *bytetext.flat(pa.array([t]))) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def test_gradients(prose):
    import numpy as np
    import pyarrow as pa

    from gridloom.llm import bytetext

    net = quality.start(7)
    for name in ("embed", "filters", "shift", "combine", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    data, offsets = bytetext.flat(pa.array([prose(n) for n in (30, 200)]))
    y, weight = np.array([1.0, 0.0]), np.ones(2)

    def loss():
        p = quality.scores(net, data, offsets)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    slopes = quality._slopes(net, data, offsets, y, weight)
    for parameter, slope in zip(net.parameters(), slopes, strict=True):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        kept, step = parameter[at], 1e-3
        parameter[at] = kept + step
        high = loss()
        parameter[at] = kept - step
        low = loss()
        parameter[at] = kept
        assert (high - low) / (2 * step) == pytest.approx(slope[at], rel=0.1, abs=1e-4)


def test_toxicity(spark, more, odd_docs, no_docs):
    labels = spark.read.parquet(f"{more}/labels.parquet")
    found = queries.op3_toxicity(spark, more)
    check_scored(spark, found, more, 5, 0)
    clean, toxic = recalls(found.join(labels, "doc_id"), "toxic")
    assert clean >= 0.9 and toxic >= 0.5
    model = toxicity.train(["you scum idiot", "what a scum", "idiot trash here"] * 5, ["a fine day", "some idiot words", "words of the day"] * 20, 0.1, least_texts=2)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd_docs, model).collect())
    assert toxicity.score(no_docs, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, none, F.lit(True))).collect()} == {0.0}


def test_samples_are_bounded_and_stable(spark):
    rows = spark.range(20_000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    sized = rows.withColumn("n", F.when(F.col("y") == 1, 2000).otherwise(18_000))
    one = draw(sized, "n", 500, 1, "id", "y")
    two = draw(sized.repartition(7), "n", 500, 1, "id", "y")
    assert sorted(r.id for r in one.collect()) == sorted(r.id for r in two.collect())
    assert [r["count"] for r in one.groupBy("y").count().collect()] == [500, 500]
    assert draw(rows, 20_000, 30_000, 1, "id").count() == 20_000
    # the cut stays fine for tables of any size
    assert abs(draw(rows, 10**7, 500, 1, "id").count() - 2 * 500 * 20_000 / 10**7) <= 6


def test_an_id_that_repeats_is_drawn_once(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 5).alias("text"))
    got = draw(rows, 30_000, 400, 5, "doc_id").collect()
    assert len(got) == len({r.doc_id for r in got}) == 400


def test_long_texts_are_learned_from(spark, prose):
    texts = [(i, prose(30)) for i in range(20)] + [(100, prose(40_000)), (101, None), (None, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert len(texts[20][1]) > 100_000
    labels = spark.createDataFrame([(i, int(i == 100 or i % 4 == 0), 0, "x") for i in [*range(20), 100, 101]] + [(100, 1, 0, "x"), (None, 1, 0, "x"), (3, None, 0, "x")], "doc_id long, quality int, toxic int, text string")
    rows = labelled(docs, labels, "quality", F.lit(True), 1000, 16 << 20, 2)
    assert {(r.doc_id, r.y) for r in rows} == {(i, int(i == 100 or i % 4 == 0)) for i in [*range(20), 100]}
    assert max(len(r.text) for r in rows) == len(texts[20][1])
    few = labelled(docs, labels, "quality", F.lit(True), 1000, 1, 2)
    assert sorted(r.y for r in few) == [0, 1]  # one text of either label, whole
