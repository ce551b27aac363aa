"""Language identification by a byte convolutional network, trained in numpy.

A text is its UTF-8 bytes, cut into windows of a fixed length that cover all of
it. Filters of several widths run over a window's byte embeddings, each filter
keeps its maximum, and a softmax over the pooled values gives the window's
languages. A text's score is the mean of its windows' probabilities, weighted
by their bytes.

Filter widths are multiples of two, so a filter is a sum of byte-pair tables,
worked out once from embeddings and weights; applying the network is looking up
pairs and adding, batch by batch, at one cost for each byte however the texts
are split.

Learning reads a bounded, documented number of labelled texts; every text is
scored whole.

Defined results: null text, and text without a letter, is ``und`` with score 0;
texts of under four bytes are padded; ties go to the language first in order;
repeated rows score alike; an empty table, or no labels to learn from, gives
``und``; other columns stay as they are, whatever their names, but for those called
like an output, which are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.shared import bounded_batches, free_name, table

#: Bytes of a window; the last window of a text may be shorter.
WINDOW = 192
WIDTHS, FILTERS, EMBED = (2, 4, 6), 12, 8
#: Learning reads at most this many labelled texts of each language, those with
#: the lowest hash of doc_id; with very many languages fewer of each, about FIT_ROWS
#: together and one at least. Of a text it takes so many windows, spread evenly over
#: all of it. Scoring has no such bounds, and every language is learned.
FIT_TEXTS, FIT_ROWS, FIT_WINDOWS = 600, 60_000, 3
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # for each width: width x EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # all filters x languages
    out_bias: np.ndarray

    def pair_tables(self) -> list[list[np.ndarray]]:
        """For each width, one 65,536-row table for each pair of its places."""
        tables = []
        for w in self.filters:
            per = [(self.embed @ w[j]).astype(np.float32) for j in range(len(w))]
            tables.append([(per[j][:, None, :] + per[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, len(w), 2)])
        return tables


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte windows (count x WINDOW, zero-padded), the text of each, its bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // WINDOW))
    owner = np.repeat(np.arange(len(texts)), counts)
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) * WINDOW
    for t, s in zip(texts, starts, strict=True):
        flat[s : s + len(t)] = np.frombuffer(t, np.uint8)
    no = np.arange(len(owner)) - np.repeat(starts // WINDOW, counts)
    return flat.reshape(-1, WINDOW), owner, np.minimum(WINDOW, np.maximum(1, sizes[owner] - no * WINDOW))


def spread_windows(text: bytes) -> list[bytes]:
    """Up to FIT_WINDOWS windows of a text, spread over the whole of it."""
    count = max(1, -(-len(text) // WINDOW))
    return [text[i * WINDOW : (i + 1) * WINDOW] for i in sorted(set(np.linspace(0, count - 1, min(FIT_WINDOWS, count)).astype(int).tolist()))]


def pooled(x: np.ndarray, sizes: np.ndarray, net: Network, tables: list[list[np.ndarray]]) -> np.ndarray:
    """Maximum of each filter over each window (windows x filters)."""
    pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
    out = []
    for per in tables:
        width = 2 * len(per)
        places = x.shape[1] - width + 1
        total = per[0][pairs[:, :places]]
        for j in range(1, len(per)):
            total += per[j][pairs[:, 2 * j : 2 * j + places]]
        short = np.flatnonzero(sizes < x.shape[1])
        for i in short:  # places that reach into the padding don't count, but for the first
            total[i, max(1, sizes[i] - width + 1) :] = -np.inf
        out.append(total.max(axis=1))
    return np.maximum(np.concatenate(out, axis=1) + net.bias, 0)


def probabilities(x: np.ndarray, sizes: np.ndarray, net: Network, tables: list[list[np.ndarray]], step: int = 256) -> np.ndarray:
    out = np.empty((len(x), len(net.languages)), np.float32)
    for at in range(0, len(x), step):
        z = pooled(x[at : at + step], sizes[at : at + step], net, tables) @ net.out + net.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        out[at : at + step] = z / z.sum(axis=1, keepdims=True)
    return out


def train(texts: list[bytes], labels: list[str], rounds: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 7) -> Network:
    """Minibatch Adam on cross entropy over the texts' windows; the gradient of a
    pooled filter goes to the place that was its maximum."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y_of = {k: i for i, k in enumerate(languages)}
    parts = [(w, y_of[k]) for t, k in zip(texts, labels, strict=True) for w in spread_windows(t)]
    x, _, sizes = windows([w for w, _ in parts])
    x, y = x.astype(np.int64), np.array([k for _, k in parts])
    total = FILTERS * len(WIDTHS)
    params = {"embed": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.3, (total, len(languages))), "bias": np.zeros(total), "out_bias": np.zeros(len(languages))}
    params |= {f"w{w}": rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS}
    m, v, t = {k: np.zeros_like(p) for k, p in params.items()}, {k: np.zeros_like(p) for k, p in params.items()}, 0
    shares = np.bincount(y, minlength=len(languages)) / max(1, len(y))
    weight = (1 / np.maximum(shares, 1e-9) / len(languages))[y]
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            xb, n = x[rows], len(rows)
            e = params["embed"][xb]
            values, spots = [], []
            for w in WIDTHS:
                places = WINDOW - w + 1
                conv = sum(e[:, j : j + places] @ params[f"w{w}"][j] for j in range(w))
                for i in np.flatnonzero(sizes[rows] < WINDOW):
                    conv[i, max(1, sizes[rows][i] - w + 1) :] = -1e9
                spot = conv.argmax(axis=1)
                spots.append(spot)
                values.append(np.take_along_axis(conv, spot[:, None, :], axis=1)[:, 0])
            h = np.concatenate(values, axis=1) + params["bias"]
            a = np.maximum(h, 0)
            z = a @ params["out"] + params["out_bias"]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[rows]] -= 1
            p *= weight[rows][:, None] / n
            grads = {"out": a.T @ p, "out_bias": p.sum(axis=0)}
            gh = (p @ params["out"].T) * (h > 0)
            grads["bias"] = gh.sum(axis=0)
            ge = np.zeros_like(params["embed"])
            for k, w in enumerate(WIDTHS):
                g = gh[:, k * FILTERS : (k + 1) * FILTERS]
                gw = np.zeros_like(params[f"w{w}"])
                for j in range(w):
                    byte = np.take_along_axis(xb, spots[k] + j, axis=1)  # batch x FILTERS
                    gw[j] = np.einsum("bfe,bf->ef", params["embed"][byte], g)
                    np.add.at(ge, byte.ravel(), (g[:, :, None] * params[f"w{w}"][j].T[None]).reshape(-1, EMBED))
                grads[f"w{w}"] = gw
            grads["embed"] = ge
            t += 1
            for name, grad in grads.items():
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.999 * v[name] + 0.001 * grad**2
                params[name] = params[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
    f32 = {k: p.astype(np.float32) for k, p in params.items()}
    return Network(languages, f32["embed"], [f32[f"w{w}"] for w in WIDTHS], f32["bias"], f32["out"], f32["out_bias"])


@lru_cache(maxsize=2)
def _ready(blob: bytes) -> tuple[Network, list[list[np.ndarray]]]:
    net = pickle.loads(blob)
    return net, net.pair_tables()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(texts: list[str | None], blob: bytes) -> tuple[list[str], np.ndarray]:
    net, tables = _ready(blob)
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    told = [i for i, t in enumerate(texts) if t is not None and net.languages and has_letter(t)]
    group: list[int] = []
    size = 0

    def flush() -> None:
        x, owner, sizes = windows([texts[i].encode("utf-8", "replace") for i in group])
        p = probabilities(x, sizes, net, tables).astype(np.float64) * sizes[:, None]
        total = np.zeros((len(group), p.shape[1]))
        np.add.at(total, owner, p)
        total /= total.sum(axis=1, keepdims=True)
        for i, row in zip(group, total, strict=True):
            best = int(row.argmax())
            names[i], scores[i] = net.languages[best], min(1.0, float(row[best]))

    for i in told:
        group.append(i)
        size += len(texts[i])
        if size > 1 << 20:
            flush()
            group, size = [], 0
    if group:
        flush()
    return names, scores


def held_out(doc_id: Column) -> Column:
    """Rows never learned from; a null id counts as learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, limit: int = FIT_TEXTS) -> bytes:
    """The trained network, pickled. docs has doc_id, text and lang. Texts are
    counted by language, those of the lowest hashes are cut into windows where
    they lie, and the driver gets the windows of at most ``limit`` texts a language."""
    spark = docs.sparkSession
    bounded_batches(spark)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = [(r["lang"], r["count"]) for r in usable.groupBy("lang").count().collect()]
    if not counts:
        return _nothing_learned()
    each = max(1, min(limit, FIT_ROWS // len(counts)))
    # a share by hash that holds the lowest ``each`` of a language all but surely
    shares = spark.createDataFrame([(lang, int(min(1.0, (2.0 * each + 100) / n) * 2**32)) for lang, n in counts], "lang string, _below long")
    hashed = F.crc32(F.encode(F.concat(F.lit("fit"), F.col("doc_id").cast("string")), "UTF-8"))
    near = usable.join(F.broadcast(shares), "lang").withColumn("_hash", hashed).where("_hash < _below").select("doc_id", "lang", "_hash", F.xxhash64("text").alias("_text"), "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[np.array([has_letter(t) for t in pdf["text"]], bool)]
            parts = [spread_windows(t.encode("utf-8", "replace")) for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(windows=pd.Series(parts, index=pdf.index, dtype=object))

    told = near.mapInPandas(cut, "doc_id long, lang string, _hash long, _text long, windows array<binary>")
    # one text of an id, however often it is repeated
    one = told.groupBy("doc_id", "lang", "_hash").agg(F.min_by("windows", "_text").alias("windows"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "doc_id"))
    rows = one.withColumn("_number", number).where(F.col("_number") <= each).collect()
    if not rows:
        return _nothing_learned()
    rows.sort(key=lambda r: (r["lang"], r["_hash"], r["doc_id"]))
    parts = [(bytes(w), r["lang"]) for r in rows for w in r["windows"]]
    return pickle.dumps(train([w for w, _ in parts], [k for _, k in parts]))


def _nothing_learned() -> bytes:
    none = np.zeros(0)
    return pickle.dumps(Network([], none, [], none, none, none))


def identify(docs: DataFrame, blob: bytes, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; other columns of those names are replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(blob)  # some kilobytes, whatever the table

    @F.pandas_udf("lang_pred string, score double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = predict([t if isinstance(t, str) else None for t in texts], held.value)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    kept, own = [f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score")], free_name(docs, "_told")
    return docs.select(*kept, told(F.col(text)).alias(own)).select(*kept, f"{own}.lang_pred", f"{own}.score")


def op3_byte_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document."""
    docs = table(spark, sf_dir, "documents")
    told = identify(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
