"""Prefix trie, SimHash and collocations against brute force on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import collocations, queries, simhash, trie

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TURNS = "conv_id long, turn long, role string, text string, place string, depth int, a string"


def key(x):
    return (x is not None, x if x is not None else 0)


# --- prefix trie


def rebuilt(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((key(turn), role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in convs.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    return out


def expect_trie(sequences):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, s in sequences.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        own = (len(m) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += not children[node]
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], digest(ends[n])) for n, m in members.items()), key=str)


def trie_of(spark, tmp_path, rows):
    path = str(tmp_path / "sf")
    spark.createDataFrame([(*r, "x", 1, "x") for r in rows], TURNS).repartition(3).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in queries.op11_prefix_trie(spark, path).select(*names).collect()), key=str)


def test_trie_against_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "ccc é😀"])) for c in [*range(40), 100, 101, 205, -7, 7_000_000_000_000] for t in range(rng.randint(1, 9))]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 360) for t in range(8)]  # a third of all, identical
    rows += [(500, None, "user", "null turn"), (500, 0, "user", "x"), (500, 0, "user", "x"), (500, 0, "system", "tie"), (None, 1, "user", "no id")]
    rows += [(600, t, "user", f"long {t % 7}") for t in range(60)] + [(700, 0, "user", "y" * 300_000)]
    monkeypatch.setattr(trie, "BLOCK_BITS", 3)  # conversations and member lists cross blocks
    monkeypatch.setattr(trie, "CHUNK_BITS", 2)
    assert trie_of(spark, tmp_path, rows) == expect_trie(rebuilt(rows))


def test_trie_of_nothing(spark, tmp_path):
    assert trie_of(spark, tmp_path, []) == []


# --- simhash


def expect_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))


def expect_components(prints):
    """prints: (id, fingerprint); the smallest id reached over links of 2 bits or fewer."""
    ids = sorted({p for _, p in prints})
    parent = {p: p for p in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(a ^ b).count("1") <= 2:
                parent[root(a)] = root(b)
    least = {}
    for d, p in prints:
        least[root(p)] = min(least.get(root(p), d), d)
    return {d: least[root(p)] for d, p in prints}


def test_simhash_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(((r.doc_id, r.print & (1 << 64) - 1, r.component_id) for r in simhash.simhash(odd_docs).collect()), key=lambda r: (key(r[0]), r[1]))
    parts = expect_components([(d, expect_print(t)) for d, t in rows if d is not None])
    assert [r[:2] for r in got] == sorted(((d, expect_print(t)) for d, t in rows), key=lambda r: (key(r[0]), r[1]))
    by_print = {(d, expect_print(t)): expect_components([(i, expect_print(x)) for i, x in rows if i is not None]) for d, t in rows if d is not None}
    for d, p, c in got:
        assert c is None if d is None else c == by_print[d, p][d] == parts[d]
    assert simhash.simhash(no_docs).count() == 0


@pytest.mark.parametrize("most", [1, 4, 32])
def test_near_fingerprints(spark, most):
    """Chains and large clouds of near fingerprints; with a small ``most`` all lists are long ones."""
    rng = random.Random(most)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            prints.add(at)
            step = at
            for bit in rng.sample(range(64), rng.randint(0, 3)):
                step ^= 1 << bit
            at = rng.choice([at, step])
            prints.add(step)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "print long"), most)
    rows = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in links.collect()]
    assert all(bin(a ^ b).count("1") <= 2 for a, b in rows)
    found = simhash.connected_components(links)
    got = {r.node & (1 << 64) - 1: r.component & (1 << 64) - 1 for r in found.collect()}
    named = expect_components([(p, p) for p in prints])
    same = collections.defaultdict(set)
    for p in prints:
        same[got.get(p, p)].add(named[p])
    assert all(len(x) == 1 for x in same.values()) and len(same) == len(set(named.values()))


def test_long_lists_make_few_rows(spark):
    """A cloud of 2,000 fingerprints that share four bytes makes links in proportion to them, not all pairs."""
    rng = np.random.default_rng(1)
    cloud = spark.createDataFrame([(int(x),) for x in np.unique(rng.integers(0, 1 << 13, 3000))], "print long")
    links = simhash.near_links(cloud)
    assert links.count() <= 6 * 33 * cloud.count()
    assert links.where("bit_count(a ^ b) > 2").count() == 0
    assert simhash.connected_components(links).select("component").distinct().count() == 1


def test_xxh64(prose):
    data = np.frombuffer(prose(3000).encode(), np.uint8)
    rng = random.Random(2)
    at, n = np.array([rng.randrange(4000) for _ in range(800)]), np.array([rng.choice([0, 1, 3, 4, 7, 8, 31, 32, 33, 63, 64, 65, 500]) for _ in range(800)])
    assert simhash.xxh64(data, at, n).tolist() == [xxhash.xxh64(data[a : a + m].tobytes(), seed=42).intdigest() for a, m in zip(at, n, strict=True)]
    assert simhash.fingerprints(pa.array([None, "", " ", "One"])).tolist() == [expect_print(t) for t in [None, "", " ", "One"]]


def test_votes_over_many_shingles(prose):
    texts = [prose(n) for n in (1, 2, 3, 250, 260, 3000)]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [expect_print(t) for t in texts]


# --- collocations


def expect_phrases(docs, most, least, longest):
    count, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    count[lang or "und"][tuple(words[i : i + m])] += 1
            n[lang or "und"] += len(words)
    out = []
    for lang, f in count.items():
        rows = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + m] for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if a >= candidates[p[i : i + m]]}
        for p, a in candidates.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most])]
    return sorted(out)


def phrases(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


@pytest.mark.parametrize(("most", "least", "longest"), [(3, 2, 5), (40, 3, 4), (2000, 2, 2)])
def test_collocations_against_brute_force(spark, most, least, longest):
    """Few phrases are asked of many, so that the bounds settle the languages before all words are opened."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["en", "xx", "É", "the"]
    passage = "rare passage of words, that stays. Together always"
    docs = []
    for lang in ("en", "xx", None):
        for _ in range(60):
            text = " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=80))
            docs.append((lang, f"{text}\n{passage} {text[:90]}!\tThe THE\x0bthe the" if rng.random() < 0.4 else text))
    docs += [("en", None), ("en", ""), ("yy", "only once here"), ("yy", ".,;"), ("en", "a b " * 4000)]
    df = spark.createDataFrame([(lang, text, "x", 1, "x") for lang, text in docs], "lang string, text string, hash string, n int, word string").repartition(4)
    got = phrases(df, most=most, least=least, longest=longest)
    assert got == expect_phrases(docs, most, least, longest)
    assert len({r[0] for r in got}) == 3


def test_collocations_of_nothing(spark, no_docs, odd_docs):
    assert phrases(no_docs) == []
    assert phrases(odd_docs, least=10**9) == []


def test_bounds_open_few_words(spark, monkeypatch):
    """Frequent words are never opened where the best phrases have rare ones."""
    rng = random.Random(1)
    docs = [("en", " ".join(rng.choices(["a", "b", "c", "d"], k=200)) + f" x{i % 50} y{i % 50}") for i in range(400)]
    df = spark.createDataFrame(docs, "lang string, text string")
    opened = []
    of = collocations.Bitmap.of
    monkeypatch.setattr(collocations.Bitmap, "of", staticmethod(lambda h, *c: opened.append(h.count()) or of(h, *c)))
    got = phrases(df, most=10, least=3)
    assert got == expect_phrases(docs, 10, 3, 5)
    assert opened[1] <= 100 < opened[0]  # the words with both a number are open, a to d are not


def test_filter_has_all_members(spark):
    rng = np.random.default_rng(3)
    members = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    held = collocations.Bitmap.of(spark.createDataFrame([(int(x),) for x in members], "hash long"))
    assert held.has(members.view(np.uint64)).all()
    assert held.has(rng.integers(0, 1 << 63, 50_000).astype(np.uint64)).mean() < 0.01
    assert not collocations.Bitmap.of(spark.createDataFrame([], "hash long")).has(members.view(np.uint64)).any()
