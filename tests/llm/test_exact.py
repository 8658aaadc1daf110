"""Operators with exact results, against brute force."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bytetext, chat, decontaminate, jaccard_join, nearest, packing, pii, queries, token_records
from gridloom.llm.shared import connected_components
from gridloom.llm.wordtokens import WordTokens, encode_groups

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(x):
    return (x is not None, x if x is not None else 0)


# --- decontamination


def expect_hits(docs, items, span=13):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOW))
    windows = collections.defaultdict(set)
    for item, text in items:
        words = split(text)
        m = min(span, len(words))
        for i in range(len(words) - m + 1 if words else 0):
            windows[tuple(words[i : i + m])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for m in sizes:
            for i in range(len(words) - m + 1):
                if s := windows.get(tuple(words[i : i + m])):
                    found |= s
                    hit |= set(range(i, i + m))
        out.append((doc, len(words), len(hit), sorted(found)))
    return sorted(out, key=lambda r: (key(r[0]), r[1:]))


@pytest.mark.parametrize("block_bytes", [1 << 20, 300, 0])
def test_decontaminate(spark, odd_docs, prose, block_bytes):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    base = docs[0][1].split(" ")
    items = [(1, " ".join(base[5:30])), (2, "One"), (3, "TWO, words!"), (4, None), (5, ""), (None, docs[0][1]), (6, " ".join(base[20:33])), (6, " ".join(base[20:33])), (7, prose(40)), (8, " ".join(docs[9][1].split(" ")[100:113]))]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    found = decontaminate.decontaminate(odd_docs, bench, block_bytes=block_bytes)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in found.collect()), key=lambda r: (key(r[0]), r[1:]))
    want = expect_hits(docs, [i for i in items if i[0] is not None])
    assert got == want
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in found.collect())


def test_decontaminate_empty(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(no_docs, none).count() == 0
    assert decontaminate.decontaminate(odd_docs, none).where("n_hit > 0 OR contaminated").count() == 0


def covered(docs, items, span, gram):
    """(hit words, items) of each text, without Spark."""
    index = decontaminate.index([i for i, _ in items], [t for _, t in items], span, gram)
    words, at = decontaminate.word_hashes(*bytetext.flat(pa.array(docs)))
    hit, rows, ids = decontaminate.find(words, at, index, span, gram)
    row, low, high = decontaminate.hit_runs(hit, at)
    assert np.bincount(row, weights=high - low, minlength=len(docs)).sum() == hit.sum()
    return [(int(hit[at[i] : at[i + 1]].sum()), sorted(ids[rows == i].tolist())) for i in range(len(docs))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=40), min_size=1, max_size=3), st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=30), min_size=1, max_size=3))
def test_every_shared_window_is_found(docs, items):
    texts, named = [" ".join(d) for d in docs], [(7 + i, " ".join(x)) for i, x in enumerate(items)]
    want = expect_hits(list(enumerate(texts)), named, 5)
    assert covered(texts, named, 5, 3) == [(r[2], r[3]) for r in want]


def test_repeated_words_and_shared_passages(spark, prose):
    """Memory and time stay linear in the text where one word repeats and where items share a passage."""
    import tracemalloc

    tracemalloc.start()
    assert covered(["a " * 200_000, "b"], [(1, "a " * 4000), (2, "a " * 12)], 13, 6) == [(200_000, [1, 2]), (0, [])]
    passage = prose(60)
    items = [(i, f"{passage} {prose(5)}") for i in range(2000)]
    assert covered([f"{prose(20)} {passage} {prose(20)}"], items, 13, 6) == [(60, list(range(2000)))]
    assert tracemalloc.get_traced_memory()[1] < 600 << 20
    tracemalloc.stop()
    docs = spark.createDataFrame([(i, f"{prose(5)} {passage}") for i in range(40)] + [(99, "a " * 3000)], "doc_id long, text string")
    bench = spark.createDataFrame([*items[:30], (5000, "a " * 40)], "item_id long, text string")
    one = sorted(decontaminate.decontaminate(docs, bench).collect())
    assert one == sorted(decontaminate.decontaminate(docs, bench, block_bytes=0).collect())
    assert [len(r.item_ids) for r in one] == [30] * 40 + [1]


# --- similarity join


def expect_links(docs, k=4, percent=85):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = {d: d for d, _ in docs if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(docs):
        for j, (b, _) in enumerate(docs[:i]):
            both = len(sets[i] & sets[j])
            if a is not None and b is not None and both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted(((d, len(s), root(d) if d is not None else None) for (d, _), s in zip(docs, sets, strict=True)), key=lambda r: (key(r[0]), r[1]))


def joined(df, **options):
    return sorted((tuple(r) for r in jaccard_join.ngram_jaccard_join(df, **options).collect()), key=lambda r: (key(r[0]), r[1]))


def test_jaccard_join(odd_docs):
    assert joined(odd_docs) == expect_links([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_jaccard_join_of_a_group_over_many_tasks(spark, prose):
    base = prose(80).split(" ")
    rng = np.random.default_rng(3)
    docs = []
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, len(words), int(rng.integers(0, 5))):
            words[at] = f"w{rng.integers(0, 40)}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, prose(60)) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert joined(df, common=3, task_tokens=2000) == expect_links(docs)


def test_jaccard_join_empty(no_docs):
    assert joined(no_docs) == []


def test_connected_components(spark):
    edges = [(i + 1, i) for i in range(1, 60)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 150: 100, 200: 100}


# --- tokenizers, records, packing

FILES = {"words": "word_bpe_49k.json", "spaces": "byte_bpe_50k.json"}


@pytest.mark.parametrize("mode", ["words", "spaces"])
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'!- 　 éÉß×aBc1x<|>"), st.characters(exclude_categories=("Cs",))), max_size=40))
def test_pieces_encode_as_the_whole_text(mode, text):
    path = public_tokenizers.path(FILES[mode])
    tokens = WordTokens.of(path, mode)
    for case in (text, f"it's {text} <|endoftext|> we'll, {text}"):
        data, offsets = bytetext.flat(pa.array([case, "a", case]))
        ids, at = tokens.encode(data, offsets, 77)
        want = [*tokens.tokenizer.encode(case, add_special_tokens=False).ids, 77]
        assert ids[at[0] : at[1]].tolist() == want and ids[at[2] : at[3]].tolist() == want


def test_records_round_trip(spark, odd_docs, no_docs):
    path = public_tokenizers.path(FILES["words"])
    library = Tokenizer.from_file(path)
    folder = token_records.new_folder(spark)
    token_records.write_records(odd_docs, folder, path, file_bytes=100_000)
    docs = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (key(r[0]), r[1]))
    start, want = 0, []
    for doc, text in docs:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_records.positions(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    some = token_records.read_some(spark, folder, odd_docs.where("doc_id IN (7, 14)")).collect()
    assert {r.doc_id: r.ids[:-1] for r in some} == {d: library.encode(t, add_special_tokens=False).ids for d, t in docs if d in (7, 14)}
    empty = token_records.new_folder(spark)
    token_records.write_records(no_docs, empty, path)
    assert token_records.positions(spark, empty).count() == 0


def test_damage_is_noticed():
    data = token_records.frame(5, np.arange(10)) + b"\n"
    doc, ids, end = token_records.record(data, 0)
    assert (doc, ids.tolist(), end) == (5, list(range(10)), len(data))
    wide = token_records.frame(None, np.array([70000])) + b"\n"
    assert token_records.record(wide, 0)[0] is None and token_records.record(wide, 0)[1].tolist() == [70000]
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises((ValueError, Exception)):
            token_records.record(bytes(broken), 0)


def check_packed(placed, size):
    sums = collections.defaultdict(list)
    for r in placed:
        sums[r.sequence_id].append((r.offset, r.length))
    for parts in sums.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sums)


def first_fit(lengths, size):
    """Sequences that first-fit decreasing takes."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, gap in enumerate(gaps) if gap >= n), None)
        if at is None:
            gaps.append(size - n)
        else:
            gaps[at] -= n
    return len(gaps)


def test_packing(spark, odd_docs, no_docs):
    path, size = public_tokenizers.path(FILES["spaces"]), 64
    library = Tokenizer.from_file(path)
    pieces = packing.cut_pieces(odd_docs, path, size=size)
    got = collections.Counter()
    for r in pieces.collect():
        got[r.doc_id, r.piece, r.start, bytes(r.ids)] += 1
        assert len(r.ids) == 4 * r.length
    want = collections.Counter()
    for r in odd_docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r.doc_id, i, a, ids[a:b].tobytes()] += 1
    assert got == want
    placed = packing.place(pieces.drop("ids"), size=size, rows_per_group=50).collect()
    assert len(placed) == sum(want.values())
    assert all((r.sequence_id < 0) == (r.length == size) for r in placed)
    assert check_packed(placed, size) <= first_fit([r.length for r in placed], size)
    whole = packing.sequences(pieces.where("doc_id = 1"), packing.place(pieces.where("doc_id = 1").drop("ids"), size=size)).collect()
    assert sum(len(r.parts) for r in whole) == sum(r.doc_id == 1 for r in placed)
    assert packing.place(packing.cut_pieces(no_docs, path).drop("ids")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=21, max_size=21))
def test_plan_places_every_piece_once(counts):
    counts = np.array([0, *counts[1:]])
    plan = packing.make_plan(counts, 20)
    fill, used = collections.Counter(), collections.Counter()
    order = np.lexsort((plan.rank, plan.length))
    for n, length in enumerate(np.repeat(np.arange(21), counts)):
        rank = used[length]
        used[length] += 1
        at = np.searchsorted(plan.length[order] * 10**6 + plan.rank[order], length * 10**6 + rank, side="right") - 1
        fill[int(plan.sequence[order][at] + (rank - plan.rank[order][at]) // plan.each[order][at])] += int(length)
    assert all(v <= 20 for v in fill.values()) and len(fill) == plan.sequences


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=17, max_size=17), st.lists(st.tuples(st.integers(1, 16), st.integers(-3, 3)), max_size=8))
def test_index_of_sums(counts, changes):
    index = packing.SumIndex(np.array([0, *counts[1:]]))
    for length, by in [(1, 0), *changes]:
        index.change(length, max(by, -int(index.left[length])))
        have = np.flatnonzero(index.left).tolist()
        sums = [collections.Counter(), collections.Counter(), collections.Counter()]
        for n in (1, 2, 3):
            for some in itertools.combinations_with_replacement(have, n):
                if all(index.left[x] >= some.count(x) for x in some):
                    sums[n - 1][sum(some)] += 1
        assert index.pairs.tolist() == [sums[1][s] for s in range(17)] and index.triples.tolist() == [sums[2][s] for s in range(17)]
        for gap in range(1, 17):
            fill = index.exact(gap)
            assert (fill is not None) == any(x[gap] for x in sums)
            assert fill is None or (sum(fill) == gap and all(index.left[x] >= fill.count(x) for x in fill))


# --- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def expect_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        if kind == "email" and "@" not in text:  # cannot match, but would take time that grows with the square
            continue
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".") if kind == "ip"), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


PII_TEXTS = [
    "é a@b.c%d@e.f x", "@@a@b@c.d.e.@", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "4111 1111 1111 1111-2, 4111111111111111 4111-1111-1111-1111", "+1 (162) 555-6820 +12 +1-- ++49 30 1234567é",
    "x" * 2000 + "@y.z", "1" * 3000, "1." * 500, None, "", "mail: joe (at) example (dot) com, call (717) 555-0202", "y" * 300 + " (at) example.com",
]


def test_pii_base_spans(spark, odd_docs, no_docs):
    texts = [(i, t) for i, t in enumerate(PII_TEXTS)] + [(None, "a@b.de"), (3, "a@b.de")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").union(odd_docs.select("doc_id", "text"))
    model = pii.fit(docs)
    assert set(model.reliability) == set(pii.LABELERS)
    source = docs.collect()
    found = pii.detect(docs, model, redact=True).collect()
    assert len(found) == len(source)
    for a, b in zip(source, found, strict=True):
        assert a.doc_id == b.doc_id
        base = [(s.kind, s.start, s.end) for s in b.spans if s.base]
        assert base == expect_spans(a.text or "")
        if a.text is None or not b.spans:
            assert b.text == a.text
        else:
            assert not expect_spans(re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", "\n", b.text))
    assert pii.detect(no_docs, pii.fit(no_docs), "lang").count() == 0
    long = f"mail {'y' * 300} (at) {'d' * 90}.com"
    assert [(k, s, e) for k, s, e in pii._wider(long.encode())] == [(0, 5, len(long))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1290.@+-() %_é\n", max_size=60))
def test_pii_patterns(text):
    data = text.encode()
    got = [(pii.KINDS[k], len(data[:s].decode()), len(data[:e].decode())) for k, s, e, kept in pii.base_spans(data) if kept]
    assert sorted(got) == sorted(expect_spans(text))


def test_labelers_outvote_a_bad_one():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    votes = np.zeros((4000, 5), int)
    for j, (right, asked) in enumerate([(0.95, 0.9), (0.9, 0.9), (0.85, 0.6), (0.8, 0.5), (0.55, 1.0)]):
        good = rng.random(4000) < right
        votes[:, j] = np.where(rng.random(4000) < asked, np.where(good == truth, pii.YES, pii.NO), pii.ABSTAIN)
    patterns, back, n = np.unique((votes * 3 ** np.arange(5)).sum(axis=1), return_inverse=True, return_counts=True)
    likely, shares = pii._estimate(np.zeros(len(patterns), int), patterns, n.astype(float))
    assert ((likely[back] > 0.5) == truth).mean() > 0.95
    reliability = shares[1, :, pii.YES] / (shares[1, :, pii.YES] + shares[1, :, pii.NO])
    assert reliability[4] < 0.7 < reliability[1]


# --- nearest neighbours


def brute_nearest(ids, x, q, k):
    """The k nearest of row q, from one vector for each id."""
    scores = nearest.exact(x[q], x)
    order = [i for i in np.lexsort((ids, -scores)) if i != q][:k]
    return [(ids[i], scores[i]) for i in order]


def by_query(df):
    got = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.mark.parametrize("way", [{}, {"recall": None, "eps": np.inf}, {"list_rows": 50, "chunk_rows": 30, "query_rows": 7, "recall": None, "eps": np.inf}, {"list_rows": 50, "sample_rows": 250, "chunk_rows": 30, "query_rows": 7}])
def test_nearest(spark, way):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 70)).round(3)
    x[300:360] = x[7]
    rows = [(i, [float(v) for v in r], "t", 1) for i, r in enumerate(x)]
    bad = [(1000, None), (1020, [0.0] * 70), (1040, [float("nan")] * 70), (1060, [float("inf")] + [1.0] * 69), (1080, [None] * 70), (1100, [1.0] * 3), (None, rows[0][1])]
    rows += [(i, v, "t", 1) for i, v in bad] + [rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, list int").repartition(3)
    got = by_query(nearest.search(df, F.col("vec_id") % 20 == 0, k=5, **way))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        want = brute_nearest(np.arange(600), x, q, 5)
        assert len(found) == 5 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(s == nearest.exact(x[q], x[i : i + 1])[0] for i, s in found)
        hits += len({i for i, _ in want} & {i for i, _ in found})
        if way.get("recall", 1) is None:
            assert found == want
    assert hits >= 0.9 * 5 * len(got)


@pytest.mark.parametrize("clusters", [0, 60])
def test_nearest_recall_and_visits(spark, clusters):
    """Queries with ids divisible by 50 against all rows; clustered data take few lists."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 32))
    if clusters:
        x = rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 6000)] * 3 + 0.3 * x
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = by_query(nearest.search(df, F.col("vec_id") % 50 == 0, k=20, list_rows=100, sample_rows=2000, chunk_rows=60, query_rows=30))
    assert len(got) == 120
    hits = sum(len({i for i, _ in brute_nearest(np.arange(6000), x, q, 20)} & {i for i, _ in found}) for q, found in got.items())
    assert hits >= 0.9 * 20 * 120
    fitted = nearest.fit(np.arange(2000), x[:2000], 61, 20, 0.98)
    assert fitted.probes <= 6 if clusters else fitted.probes > 6


def test_a_vector_of_most_rows(spark):
    x = np.random.default_rng(2).normal(size=(400, 16)).round(2)
    x[100:] = x[100]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = by_query(nearest.search(df, F.col("vec_id") % 20 == 0, k=4, recall=None, eps=np.inf, list_rows=40))
    assert got == {q: brute_nearest(np.arange(400), x, q, 4) for q in range(0, 400, 20)}


def test_nearest_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.search(df, F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nearest.search(one, F.col("vec_id") % 20 == 0).count() == 0


# --- chat


def test_fold(spark):
    events = [
        (1, 0, "message", 1, "user", "hi"), (1, 1, "delta", 2, "assistant", "he"), (1, 2, "delta", 2, None, "llo"), (1, 2, "delta", 2, None, "llo"), (1, 3, "regenerate", 2, None, None), (1, 4, "delta", 2, None, "by"), (1, 5, "delta", 2, None, "e"),
        (1, 6, "edit", 1, None, "hey"), (2, 0, "message", 1, None, None), (None, 5, "message", 1, "user", "n"),
    ]
    log = spark.createDataFrame(events, "conv_id long, seq long, kind string, message long, role string, text string").repartition(3)
    got = {(r.conv_id, r.message): (r.place, r.role, r.text) for r in chat.reconstruct(log).collect()}
    assert got == {(1, 1): (0, "user", "hey"), (1, 2): (1, "assistant", "bye"), (2, 1): (0, "", ""), (None, 1): (5, "user", "n")}
    assert chat.render(chat.reconstruct(log.where("false"))).count() == 0


def test_control_strings_survive(spark):
    texts = ["<|im_end|>", "<|", "\\", "\\\\", "<\\|", "<\\\\|", "<\\+", "a\nb", "", "<<||", "é<|im_start|>assistant ok\n"]
    rows = [(i, t, ("assistant", "user", "od\nd<|")[(i + t) % 3], x) for i in range(2) for t, x in enumerate(texts)] + [(9, t, "assistant", None if t % 2 else "x" * 2000) for t in range(2500)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.render(chat.reconstruct(chat.events_of(turns)))
    read = {r.conv_id: r for r in done.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    for conv in (0, 1, 9):
        mine = [(r[2], r[3] or "") for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in read[conv].turns] == mine
        assert read[conv].loss == "".join(x for role, x in mine if role == "assistant")


def test_repeated_turns_stay(spark):
    rows = [(1, 0, "user", "again"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 2, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    read = chat.render(chat.reconstruct(chat.events_of(turns))).select(chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("mask")).alias("loss")).first()
    assert [(t.role, t.text) for t in read.turns] == [(role, text or "") for _, _, role, text in rows]
    assert read.loss == "yesyesyes"


def test_a_log_of_finished_turns_folds_back(spark):
    """Deltas, edits and regenerations; nulls, ties, repeats, extra columns; an empty table."""
    rows = [(c, t, role, text, "x", "x") for c in (1, None) for t, role, text in ((0, "user", "héllo"), (1, "assistant", "a😀bcdefg"), (1, "assistant", "other"), (None, None, None), (None, "", ""), (5, "assistant", None))]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, kind string, seq string").repartition(4)
    log = chat.events_of(turns)
    assert {r.kind for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    twice = log.union(log)  # delivered twice
    done = chat.render(chat.reconstruct(twice)).select("conv_id", "mask", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256((r[3] or "").encode()).hexdigest())
    assert {r.conv_id for r in done} == {1, None}
    for r in done:
        mine = sorted((x for x in rows if x[0] == r.conv_id), key=order)
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.loss == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert sum(m.chars for m in r.mask) == len(r.formatted) and len(r.mask) == 3 * len(mine)
    assert chat.render(chat.reconstruct(chat.events_of(turns.where("false")))).count() == 0


def test_chat_query(spark, sf_dir):
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.conv_id: r for r in queries.op10_chat(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    for conv in {r.conv_id for r in rows}:
        turns = [(r.role, r.text or "") for r in rows if r.conv_id == conv]
        assert got[conv].turns_sha256 == digest("".join(f"{a}\n{b}\n" for a, b in turns))
        assert got[conv].loss_sha256 == digest("".join(b for a, b in turns if a == "assistant"))
    tricky = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(tricky) and got[-1].loss_sha256 == digest(tricky)


# --- whole queries against brute force


@pytest.fixture(scope="module")
def all_docs(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]


def ids_of(file, text, end_id):
    return np.array([*file.encode(text, add_special_tokens=False).ids, end_id], "<u4")


def test_pii_query(spark, sf_dir, all_docs):
    df = queries.op5_pii(spark, sf_dir)
    assert dict(df.dtypes) == {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in pii.KINDS}, "base_sha256": "string", "spans": "string"}
    got = {r.doc_id: r for r in df.collect()}
    assert sorted(got) == [d for d, _ in all_docs]
    seen = collections.Counter()
    for doc, text in all_docs:
        want = expect_spans(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        row = got[doc]
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in row.spans.split(",") if x)]
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1])) and set(want) <= set(spans)
        for k, s, e in set(spans) - set(want):  # what the method adds touches no base span
            assert 0 <= s < e <= len(text) and all(e <= a or b <= s for _, a, b in want)
        seen.update(k for k, _, _ in want)
    assert all(seen[k] for k in ("email", "phone"))


def test_records_query(spark, sf_dir, all_docs):
    library = Tokenizer.from_file(public_tokenizers.path(FILES["words"]))
    df = queries.op6_token_records(spark, sf_dir)
    assert dict(df.dtypes) == {c: "bigint" for c in ("doc_id", "start", "n_tokens", "ids_crc32")}
    start, want = 0, []
    for doc, text in all_docs:
        ids = ids_of(library, text, 1)
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in df.collect()) == want


def test_packing_query(spark, sf_dir, all_docs):
    library = Tokenizer.from_file(public_tokenizers.path(FILES["spaces"]))
    df = queries.op7_best_fit_packing(spark, sf_dir)
    assert dict(df.dtypes) == {"doc_id": "bigint", "piece": "int", **{c: "bigint" for c in ("start", "length", "ids_crc32", "sequence_id", "offset")}}
    rows = df.collect()
    want = []
    for doc, text in all_docs:
        ids = ids_of(library, text, 0)
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    lengths = [r.length for r in rows]
    assert check_packed(rows, 2048) <= min(first_fit(lengths, 2048), -(-sum(lengths) // 2048) + 1)
