import pickle

import numpy as np

from tabulon.llm import byte_language as b

TEXTS = {"en": "the cat and the dog went with them to this house where they were thinking ", "de": "der hund und die katze gehen nicht ohne mich über die straße zum schönen haus ", "fr": "le chat et le chien sont allés à la maison où ils étaient très heureux ensemble "}


def labelled(n=60):
    rng = np.random.default_rng(1)
    out = []
    for lang, t in TEXTS.items():
        words = t.split()
        out += [(" ".join(rng.choice(words, 40)), lang) for _ in range(n)]
    return out


def test_learns(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    told = b.identify(docs, b.fit(docs)).select("lang", "lang_pred", "score", b.held_out(docs["doc_id"]).alias("out")).collect()
    held = [r for r in told if r["out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in told)


def test_tables_equal_convolution():
    rows = labelled(8)
    net = b.train([t.encode() for t, _ in rows], [g for _, g in rows], rounds=1)
    x, _, sizes = b.windows([rows[0][0].encode()[:150], b"ab", b""])
    got = b.pooled(x, sizes, net, net.pair_tables())
    for i in range(len(x)):
        want = []
        for w in net.filters:
            e = net.embed[x[i]]
            conv = np.stack([sum(e[p + j] @ w[j] for j in range(len(w))) for p in range(max(1, sizes[i] - len(w) + 1))])
            want.append(conv.max(axis=0))
        assert np.allclose(got[i], np.maximum(np.concatenate(want) + net.bias, 0), atol=1e-4)


def test_every_byte_counts():
    x, owner, sizes = b.windows([b"x" * 1000, b"y"])
    assert sizes.sum() == 1001 and (owner == 1).sum() == 1


def test_odd_rows(spark, odd_documents, no_documents):
    blob = b.fit(odd_documents)
    told = {r["doc_id"]: r for r in b.identify(odd_documents, blob).collect()}
    assert all(told[i]["lang_pred"] == "und" and told[i]["score"] == 0 for i in (4, 5, 6, 8))
    assert told[7]["lang_pred"] != "und" and told[7]["kept"] == 2
    assert b.identify(no_documents, blob).collect() == []
    nothing = b.fit(no_documents)
    assert {r["lang_pred"] for r in b.identify(odd_documents, nothing).collect()} == {"und"}
    assert pickle.loads(nothing).languages == []


def test_query_on_held_out_documents(spark, sf_dir):
    told = b.op3_byte_language(spark, sf_dir).where("held_out")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = told.join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.9 * len(rows)


def test_eighty_languages(spark):
    """Every language is learned: each of 80 has letters of its own."""
    rows = []
    for k in range(80):
        letters = [chr(0x4E00 + 97 * k + j) for j in range(6)]
        rows += [(k * 12 + i, "".join(letters[(i * 5 + j * j) % 6] for j in range(60)), f"l{k:02d}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(pickle.loads(b.fit(docs)).languages) == 80


def test_learns_from_the_whole_text(spark):
    """The first 300,000 characters are alike; windows come from beyond them too."""
    parts = b.spread_windows(b"a" * 300_000 + b"b" * 300_000)
    assert len(parts) == 3 and set(parts[0]) == {97} and set(parts[2]) == {98}
    assert b.spread_windows(b"") == [b""] and len(b.spread_windows(b"x" * 193)) == 2


def test_repeated_ids_are_one_text(spark):
    docs = spark.createDataFrame([(1, "the same old text", "en")] * 500 + [(3, "der alte text", "de")], "doc_id long, text string, lang string")
    seen = []
    with __import__("pytest").MonkeyPatch.context() as p:
        p.setattr(b, "train", lambda texts, labels: seen.append((texts, labels)))
        b.fit(docs)
    assert seen == [([b"der alte text", b"the same old text"], ["de", "en"])]


def test_clashing_columns(clashing_documents):
    out = b.identify(clashing_documents, b.fit(clashing_documents))
    assert sorted(out.columns) == sorted(clashing_documents.columns)
    assert all(r[n] == "mine" for r in out.collect() for n in clashing_documents.columns[5:] if n not in ("lang_pred", "score"))
