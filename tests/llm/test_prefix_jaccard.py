import random
import re
from itertools import combinations
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pytest
from oracle import connection, same

from tabulon.llm import prefix_jaccard as p
from tabulon.llm.components import components
from tabulon.llm.shared import session_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def exact(text, size):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, percent):
    sets = [(i, exact(t, size)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}
    links = dict.fromkeys(range(len(sets)), 0)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (x, (i, a)), (y, (j, b)) in combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            links[x] += 1
            links[y] += 1
            r, s = top(i), top(j)
            root[max(r, s)] = min(r, s)
    return sorted((i, len(s), top(i), links[x]) for x, (i, s) in enumerate(sets))


def compare(spark, rows, size, percent, chunked=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS sid", "3 AS family")
    got = sorted(tuple(r) for r in p.similar_components(df, size, percent).select("doc_id", "n_shingles", "component_id", "n_links").collect())
    want = brute(rows, size, percent)
    assert got == want
    if not chunked:  # without families of several chunks both ways are one
        return
    alone = p.similar_components(df, size, percent, links=False)
    assert alone.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(tuple(r) for r in alone.collect()) == [w[:3] for w in want]


def family(rng, base, count, most, start):
    out = []
    for i in range(count):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((start + i, " ".join(w)))
    return out


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_equals_brute_force(spark, size, percent):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(120)]
    for f in range(4):
        rows += family(rng, rng.choices(vocabulary, k=80), 12, 8, 1000 * (f + 1))
    compare(spark, rows, size, percent)


def test_hot_family_over_chunks(spark, monkeypatch):
    """A family far over HOT, most of its pairs just under the threshold, in many chunks."""
    monkeypatch.setattr(p, "CHUNK_SETS", 40)
    monkeypatch.setattr(p, "ALONE_SETS", 30)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = family(rng, base, 160, 9, 0) + [(5000 + i, " ".join(base)) for i in range(40)] + [(9000 + i, " ".join([*base[:60], *(f"u{i}_{j}" for j in range(30))])) for i in range(60)]
    compare(spark, rows, 3, 90, chunked=True)


@pytest.mark.parametrize(("size", "percent", "tail"), [(3, 90, 16), (5, 80, 36)])
def test_hot_tokens_of_unlike_levels(spark, size, percent, tail):
    """One text, and 60 of the whole of it and a tail of their own each: like the
    base at the threshold and unlike each other, the base of another level."""
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))] + [(1 + i, " ".join([*base, *(f"t{i}_{j}" for j in range(tail))])) for i in range(60)]
    found = brute(rows, size, percent)
    assert found[0][3] == 60 and found[1][3] == 1
    compare(spark, rows, size, percent)


def varied(rng, count, start):
    """Families of a text by replacement, addition, deletion, containment and all of them."""
    rows = []
    for f in range(count):
        base = [f"f{f}_{i}" for i in range(rng.randint(30, 160))]
        kind, fixed = f % 6, rng.randint(1, 30)
        for i in range(rng.randint(3, 9)):
            w, own = list(base), [f"x{f}_{i}_{j}" for j in range(200)]
            if kind in (0, 5):
                for _ in range(rng.randint(0, 6)):
                    w[rng.randrange(len(w))] = own.pop()
            if kind in (1, 5):
                w += own[: rng.randint(0, 30)]
            if kind == 2:
                w += own[:fixed]
            if kind in (3, 5):
                at = rng.randrange(len(w) - 10)
                del w[at : at + rng.randint(0, 9)]
            if kind == 4:
                w = w[: rng.randint(len(w) * 3 // 4, len(w))]
            rows.append((start + len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize(("hot", "often", "size", "percent"), [(2, 10, 3, 90), (24, 0, 3, 90), (2, 1, 5, 80)])
def test_families_of_all_kinds(spark, monkeypatch, hot, often, size, percent):
    monkeypatch.setattr(p, "HOT", hot)
    monkeypatch.setattr(p, "OFTEN", often)
    monkeypatch.setattr(p, "CHUNK_SETS", 4)
    monkeypatch.setattr(p, "ALONE_SETS", 3)
    monkeypatch.setattr(p, "PIVOTS", 2)
    compare(spark, varied(random.Random(hot * size), 110, 0), size, percent, chunked=True)


@pytest.mark.parametrize(("size", "percent", "base", "tail"), [(3, 90, 102, 10), (5, 80, 104, 22)])
def test_forty_copies_with_a_tail_of_equal_length(spark, size, percent, base, tail):
    words = [f"b{i}" for i in range(base)]
    rows = [(0, " ".join(words))] + [(1 + i, " ".join([*words, *(f"t{i}_{j}" for j in range(tail))])) for i in range(40)]
    assert brute(rows, size, percent)[0][3] == 40
    compare(spark, rows, size, percent)


def test_a_family_of_many_classes(spark, monkeypatch):
    """10,000 different copies of one text: their components cost no square."""
    words = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join([*words, f"t{i}"])) for i in range(10_000)] + [(20_000 + i, " ".join([*words[:40], *(f"u{i}_{j}" for j in range(40))])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    met = []
    plain = p.Meetings.compared
    monkeypatch.setattr(p.Meetings, "compared", lambda self, rows: met.append(rows.count()) or plain(self, rows))
    got = {r["doc_id"]: r["component_id"] for r in p.similar_components(df, 5, 80, links=False).collect()}
    assert got == {i: 0 if i < 20_000 else i for i, _ in rows}
    assert sum(met) < 45_000


def test_repeated_ids(spark):
    """One id with several texts, and rows that are there several times."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, a), (1, a), (1, b), (1, b + " end"), (2, a + " end"), (3, b), (3, b), (4, a + " stop")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in p.similar_components(df, 3, 90).collect())
    assert got == sorted([(1, 58, 1, 4)] * 3 + [(2, 59, 1, 4), (4, 59, 1, 4)] + [(1, 58, 1, 3), (1, 59, 1, 3), (3, 58, 1, 3), (3, 58, 1, 3)])


def test_empty_chunk_counts_no_pair_again():
    """Both classes of a family in chunk 0 of two: they meet with each other in
    (0, 0), and with nobody in (0, 1)."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, 0, j, s, 0, 2, 1, t) for j in (0, 1) for s, t in ((1, text), (2, text + " end"))]
    met = pd.DataFrame(rows, columns=["family", "i", "j", "sid", "chunk", "chunks", "copies", "text"])
    out = pd.concat(p.compared(iter([met]), 3, 90))
    assert out.groupby("sid")["links"].sum().to_dict() == {1: 1, 2: 1}


def test_query_equals_its_oracle(spark, sf_dir):
    same(p.op5_prefix_jaccard(spark, sf_dir), connection(sf_dir), p.ORACLE)


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    got = sorted(tuple(r) for r in p.similar_components(odd_documents, 3, 90).collect())
    assert got == brute(rows, 3, 90)
    assert p.similar_components(no_documents).collect() == []


def test_shingles_of_long_texts():
    texts = ["x " * 400_000 + "q r s", "y" * 700_000 + " z w", "Ab  cd\tEF", "ab cd ef", None, ""]
    sets = p.shingle_sets(texts, 3)
    assert [len(s) for s in sets] == [len(exact(t, 3)) for t in texts]
    assert (sets[2] == sets[3]).all()


def test_prefix_guarantee():
    rng = np.random.default_rng(2)
    logs = rng.integers(0, 6, 1 << p.SKETCH_BITS).astype(np.uint8)
    for _ in range(200):
        n = int(rng.integers(5, 120))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.05], rng.integers(0, 2**63, 2).astype(np.uint64)]))
        inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        pa, la, often = p.choose_prefix(a, logs, 1.0, 90)
        pb, lb, _ = p.choose_prefix(b, logs, 1.0, 90)
        assert len(often) == len(pa)
        if 100 * inter >= 90 * union:
            assert len(np.intersect1d(pa, pb)) >= min(la, lb)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rare_shingles_are_told_from_common_ones_where_buckets_are_full(spark, monkeypatch):
    """600,000 shingles on a sketch of 16,384 bytes: 37 to a byte, as many as would make
    a token hot. Rare ones still look rare, and those of 40 texts do not."""
    for name, bits in (("SKETCH_BITS", 14), ("SLICE_BITS", 14), ("FINE_BITS", 18), ("GROUP_BITS", 4)):
        monkeypatch.setattr(p, name, bits, raising=False)
    often = [" ".join(f"c{k}_{j}" for j in range(5)) for k in range(20)]
    rows = [(i, " ".join([*(f"w{i}_{j}" for j in range(400)), *(often[k] for k in range(20) if i % 37 == k)])) for i in range(1500)]
    logs = p.sketch(spark.createDataFrame(rows, "doc_id long, text string"), 3)
    assert len(logs) == 1 << 14

    def rarity(texts):
        return logs[(np.concatenate(p.shingle_sets(texts, 3)) >> np.uint64(65 - len(logs).bit_length())).astype(np.int64)]

    assert rarity(often).min() >= 5
    assert (rarity([t for _, t in rows[20:37]]) < 4).mean() > 0.95


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for top, n in ((1 << 22, 50_000), (1 << 22, 12), (40, 500), (1 << 22, 1), (1, 3)):
        at = np.sort(rng.integers(0, top, n)).astype(np.uint32)
        found, counts = p.unpacked_counts(p.packed(at))
        assert (np.repeat(found, counts) == at).all() and (np.diff(found) > 0).all()


def test_buckets_grow_with_the_texts(spark):
    one = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert p.fine_bits(one) == p.SLICE_BITS and p.fine_bits(one.limit(0)) == p.SLICE_BITS
    many = spark.range(2000).selectExpr("id AS doc_id", "repeat('abcde ', 5000) AS text")
    assert p.fine_bits(many) == (10_000_000).bit_length() + 1


def test_common_phrases_make_no_families_where_buckets_are_full(spark, monkeypatch):
    """1,500 texts unlike each other, each with 20 phrases that 25 of them have, on a
    sketch of 38 shingles to a byte: no texts are compared for the phrases' sake."""
    for name, bits in (("SKETCH_BITS", 14), ("SLICE_BITS", 14), ("FINE_BITS", 18), ("GROUP_BITS", 4)):
        monkeypatch.setattr(p, name, bits, raising=False)
    rng = random.Random(4)
    phrases = [k for k in range(1200) for _ in range(25)]
    rng.shuffle(phrases)
    rows = [(i, " ".join([*(f"w{i}_{j}" for j in range(320)), *(w for k in set(phrases[20 * i : 20 * i + 20]) for w in [f"s{i}_{k}", *(f"c{k}_{j}" for j in range(5))])])) for i in range(1500)]
    met = []
    plain = p.Meetings.compared
    monkeypatch.setattr(p.Meetings, "compared", lambda self, rows: met.append(rows.count()) or plain(self, rows))
    got = p.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, links=False).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == 1500
    assert sum(met) < 50


def test_few_pairs_tie_the_classes_of_a_token_together():
    rng = np.random.default_rng(5)
    rows = [(token, sid, int(rng.integers(10, 30)), int(rng.choice([1, 1, 2, 8]))) for token in range(200) for sid in rng.choice(10_000, rng.integers(1, p.HOT + 1), replace=False)]
    pdf = pd.DataFrame(rows, columns=["token", "sid", "n", "level"])

    def parts(pairs):
        root = {}

        def top(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[top(a)] = top(b)
        return {frozenset(x for x in root if top(x) == r) for r in map(top, list(root))}

    for token, group in pdf.groupby("token"):
        asked = [(a, b, min(a.level, b.level)) for a, b in combinations(group.itertuples(), 2) if 100 * min(a.n, b.n) >= 80 * max(a.n, b.n)]
        found = pd.concat([pd.DataFrame(columns=["a", "b", "level"]), *p.meetings([group], 80)])
        sure = found[found.level == 1]
        assert parts(zip(sure.a, sure.b)) == parts((a.sid, b.sid) for a, b, level in asked if level == 1)
        assert sorted(zip(*(found[found.level > 1][c] for c in ("a", "b", "level")))) == sorted((min(a.sid, b.sid), max(a.sid, b.sid), level) for a, b, level in asked if level > 1)
        assert len(sure) <= 2 * len(group)
    copies = pd.DataFrame({"token": 1, "sid": range(p.HOT), "n": 50, "level": 1})
    assert sum(map(len, p.meetings([copies], 80))) == p.HOT - 1


def test_tables_with_prefixes_are_gone_and_the_session_is_as_before(spark):
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 7}") for i in range(40)], "doc_id long, text string")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    folder = Path(urlparse(session_dir(spark)).path)
    had = {x.name for x in folder.glob("*")}
    got = {r["doc_id"]: r["component_id"] for r in p.similar_components(docs, 3, 90, links=False).collect()}
    assert got == {i: i % 7 for i in range(40)}
    left = {x.name for x in folder.glob("*")} - had
    assert not [x for x in left if x.startswith(("sets-", "classes-")) and "narrow" not in x]
    assert spark.conf.get(key, None) == before
