"""Toxicity by a subsequence string-kernel machine with Nystroem landmarks.

The kernel of two words counts the three-letter subsequences they share, each
weighted by ``DECAY`` to the power of its spread in either word, so ``idxiot``
and ``i.diot`` stay close to ``idiot``. Kernel values against landmark words,
whitened by the landmarks' own kernel matrix, are the features of a linear
support vector machine (squared hinge, solved by Newton steps).

Labels are on whole texts, so learning is on witnesses: the word of a toxic text
that speaks most for it, chosen again after each fit, against all words of clean
texts. A text's score is a logistic function of its two strongest words.

The kernel is an inner product of subsequence weights, so the fitted machine
folds into one number for each subsequence of the landmarks: a word is scored by
looking up its subsequences and dividing by its own norm, and a text of any
length by its distinct words.

Learning reads a bounded, documented number of labelled texts; every text is
scored whole. Defined results: null text scores as empty text does; no labels,
or only one label, gives every text the same low score and ``predicted`` 0;
repeated rows score alike; words of over 24 letters are scored by overlapping
parts; an empty table gives an empty result; other columns stay as they are, but
for those called like an output, which are replaced.
"""

from __future__ import annotations

import heapq
import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.byte_language import held_out
from tabulon.llm.shared import bounded_batches, table

LENGTH, DECAY, LONGEST = 3, 0.8, 26
#: Learning reads at most so many toxic and clean texts, those with the lowest
#: hash of doc_id, each of them whole. Scoring has no bounds.
FIT_TOXIC, FIT_CLEAN = 2000, 4000
#: Landmarks: the words that speak most for toxic texts, and clean words like them.
SPEAKING, ALIKE = 96, 96
#: Log odds times root of count from which a word is a witness wherever it stands.
SURE = 8.0
#: Weight of all witnesses together, in that of all words of clean texts.
BALANCE = 0.1
#: Distinct words that a worker keeps between batches.
KEPT_WORDS = 250_000
THRESHOLD = 0.3
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
INSIDE = re.compile(r"[\W_]+")
SPELLED = re.compile(r"(?<!\w)(?:\w[ .\-_*]){2,}\w(?!\w)")


def units(raw: str) -> list[str]:
    """The strings that a raw word is scored by: its core between word marks, and
    the core without what stands between its letters."""
    if raw.isalpha() and len(raw) <= LONGEST - 2:
        return [f"^{raw}$"]
    core = EDGE.sub("", raw)
    if not core:
        return []
    plain = INSIDE.sub("", core)
    out = []
    for w in {core, plain}:
        marked = f"^{w}$"
        if len(marked) <= LONGEST:
            out.append(marked)
        else:
            half = LONGEST // 2
            out += [marked[i : i + LONGEST] for i in range(0, len(marked) - half, half)]
    return out


def raw_words(text: str | None) -> set[str]:
    """Distinct lower-case words of a whole text, and words spelled out letter by letter."""
    low = (text or "").lower()
    found = set(low.split())
    found |= {INSIDE.sub("", m) for m in SPELLED.findall(low)}
    return found


def code_matrix(strings: list[str], size: int) -> np.ndarray:
    """Code points of equally long strings."""
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(len(strings), size)


@lru_cache(maxsize=64)
def places(size: int) -> tuple[np.ndarray, np.ndarray]:
    spots = np.array(list(combinations(range(size), LENGTH)), np.int32).reshape(-1, LENGTH)
    return spots, (DECAY ** (spots[:, -1] - spots[:, 0] + 1)).astype(np.float32) if len(spots) else np.zeros(0, np.float32)


def norms(codes: np.ndarray) -> np.ndarray:
    """Square roots of each string's kernel with itself, by dynamic programming
    over prefixes; every string of the matrix has one length."""
    rows, n = codes.shape
    same = [[(codes[:, i] == codes[:, j]) for j in range(n)] for i in range(n)]
    inner = np.ones((n + 1, n + 1, rows), np.float32)
    for _ in range(LENGTH - 1):
        nxt = np.zeros_like(inner)
        for i in range(1, n + 1):
            run = np.zeros(rows, np.float32)
            for j in range(1, n + 1):
                run = DECAY * run + same[i - 1][j - 1] * (DECAY**2 * inner[i - 1, j - 1])
                nxt[i, j] = DECAY * nxt[i - 1, j] + run
        inner = nxt
    total = np.zeros(rows, np.float32)
    for i in range(1, n + 1):
        for j in range(1, n + 1):
            total += same[i - 1][j - 1] * (DECAY**2 * inner[i - 1, j - 1])
    return np.sqrt(np.maximum(total, 1e-12))


def by_size(strings: list[str], most: int = 400_000) -> Iterator[tuple[int, list[int]]]:
    """Strings of one length at a time, at most about ``most`` subsequences together."""
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        groups.setdefault(len(s), []).append(i)
    for size, which in groups.items():
        step = max(8, most // max(1, math.comb(size, LENGTH)))
        for at in range(0, len(which), step):
            yield size, which[at : at + step]


@dataclass
class Letters:
    """The landmarks' letters, numbered from 1; every other letter is 0."""

    chars: str

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        order = np.array(sorted(map(ord, self.chars)), np.uint32)
        at = np.searchsorted(order, codes).clip(max=max(0, len(order) - 1))
        return np.where(order[at] == codes, at + 1, 0).astype(np.int32) if len(order) else np.zeros(codes.shape, np.int32)

    def keys(self, codes: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """A number for each string's subsequences; -1 where a foreign letter is in it."""
        n, base = self.numbers(codes), len(self.chars) + 1
        key = np.zeros((len(codes), len(spots)), np.int32)
        foreign = np.zeros(key.shape, bool)
        for k in range(LENGTH):
            part = n[:, spots[:, k]]
            key = key * base + part
            foreign |= part == 0
        key[foreign] = -1
        return key


def kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values, strings by landmarks."""
    letters = Letters("".join(sorted(set("".join(landmarks)))))
    index: dict[int, int] = {}
    rows = []
    for m in landmarks:
        spots, weights = places(len(m))
        row: Counter = Counter()
        if len(spots):
            codes = code_matrix([m], len(m))
            norm = float(norms(codes)[0])
            for key, w in zip(letters.keys(codes, spots)[0].tolist(), weights.tolist(), strict=True):
                row[index.setdefault(key, len(index))] += w / norm
        rows.append(row)
    dense = np.zeros((len(index) + 1, len(landmarks)), np.float32)
    for j, row in enumerate(rows):
        for i, w in row.items():
            dense[i, j] = w
    keys = np.array(sorted(index), np.int32)
    where = np.array([index[k] for k in keys], np.int32)
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    for size, which in by_size(strings, 60_000):
        spots, weights = places(size)
        if not len(spots) or not len(keys):
            continue
        codes = code_matrix([strings[i] for i in which], size)
        key = letters.keys(codes, spots)
        at = np.searchsorted(keys, key).clip(max=len(keys) - 1)
        hit_row, hit_col = np.nonzero(keys[at] == key)
        if not len(hit_row):
            continue
        own, starts = np.unique(hit_row, return_index=True)
        sums = np.add.reduceat(dense[where[at[hit_row, hit_col]]] * weights[hit_col, None], starts, axis=0)
        out[np.array(which)[own]] = sums / norms(codes)[own][:, None]
    return out


@dataclass
class Machine:
    """The folded machine: a weight for each subsequence, and the text-level curve."""

    letters: Letters
    theta: np.ndarray
    bias: float
    curve: np.ndarray

    def word_scores(self, strings: list[str]) -> np.ndarray:
        out = np.full(len(strings), self.bias, np.float32)
        for size, which in by_size(strings):
            spots, weights = places(size)
            if not len(spots):
                continue
            codes = code_matrix([strings[i] for i in which], size)
            out[which] += (self.theta[self.letters.keys(codes, spots)] @ weights) / norms(codes)
        return out

    def raw_scores(self, raws: list[str]) -> np.ndarray:
        strings = [units(r) for r in raws]
        flat = self.word_scores([u for s in strings for u in s])
        out, at = np.full(len(raws), -9.0, np.float32), 0
        for i, s in enumerate(strings):
            if s:
                out[i] = flat[at : at + len(s)].max()
            at += len(s)
        return out

    def text_score(self, top: list[float]) -> float:
        x = text_features(top)
        return 1 / (1 + math.exp(-float(np.clip(x @ self.curve, -30, 30))))


def text_features(top: list[float]) -> np.ndarray:
    """A constant, and a text's two strongest words, held within the margin."""
    first, second = ([*top, -1.0, -1.0])[:2]
    return np.array([1.0, min(1.0, max(-1.0, first)), min(1.0, max(-1.0, second))])


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 20.0, steps: int = 25) -> np.ndarray:
    """Squared-hinge linear machine (last coefficient: bias), by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    c = cost * weight
    active_before = None
    for _ in range(steps):
        active = y * (x @ w) < 1
        if active_before is not None and (active == active_before).all():
            break
        active_before = active
        xa, ca = x[active], c[active]
        w = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, xa.T @ (ca * y[active]))
    return w


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 0.05
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge @ w)
    return w


def first_copies(docs: list[np.ndarray], raws: list[str], hashes: int = 8, shared: int = 4) -> list[int]:
    """Indexes of texts that are no near copy of an earlier one, by how many of
    their minimum hashes agree: copies of one text are one witness, not many."""
    seen: dict[tuple[int, int], list[int]] = {}
    mixes = np.random.default_rng(5).integers(1, 2**63, hashes, dtype=np.uint64) | np.uint64(1)
    raw = np.array([hash_word(w) for w in raws], np.uint64)
    kept = []
    for i, d in enumerate(docs):
        own = raw[d] if len(d) else np.zeros(1, np.uint64)
        least = [(k, int(((own * m) ^ ((own * m) >> np.uint64(29))).min())) for k, m in enumerate(mixes)]
        agree = Counter(j for key in least for j in seen.get(key, ()))
        if not agree or max(agree.values()) < shared:
            kept.append(i)
            for key in least:
                seen.setdefault(key, []).append(i)
    return kept


def bent(words: list[str]) -> list[str]:
    """Each longer word with a rare letter put in at every place: forms
    that learning should count as the word."""
    return [w[:i] + "xyzq"[(i + len(w)) % 4] + w[i:] for w in words if len(w) >= 5 for i in range(1, len(w))]


def hash_word(word: str) -> int:
    data = word.encode("utf-8", "replace")
    return zlib.crc32(data) << 32 | zlib.adler32(data)


def nothing_learned() -> Machine:
    return Machine(Letters(""), np.zeros(1, np.float32), -1.0, np.array([-4.0, 0.0, 0.0]))


def train(texts: list[str], toxic: list[int]) -> Machine:
    return train_words([joined_words(t) for t in texts], toxic)


def joined_words(text: str | None) -> bytes:
    """A text's distinct words in order, as one value."""
    return "\n".join(sorted(raw_words(text))).encode("utf-8", "surrogatepass")


def train_words(texts: Iterable[bytes], toxic: list[int]) -> Machine:
    """texts are joined words, and are turned into arrays of word numbers one by
    one; only distinct words are held as strings."""
    y = np.array(toxic)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in t.decode("utf-8", "surrogatepass").split("\n") if w], np.int32) for t in texts]
    raws = list(number)
    single = first_copies(docs, raws)
    docs, y = [docs[i] for i in single], y[single]
    if not len(y) or y.min() == y.max():
        return nothing_learned()
    core_number: dict[str, int] = {}
    core_of = np.array([core_number.setdefault(EDGE.sub("", r), len(core_number)) for r in raws], np.int32)
    cores = list(core_number)
    held = [c[[cores[i] != "" for i in c]] for c in (np.unique(core_of[d]) if len(d) else np.zeros(0, np.int32) for d in docs)]
    n_bad, n_good = int(y.sum()), int((1 - y).sum())
    bad, good = np.zeros(len(cores), np.int64), np.zeros(len(cores), np.int64)
    for c, t in zip(held, y, strict=True):
        (bad if t else good)[c] += 1
    odds = np.log(((bad + 0.5) / (n_bad + 1)) / ((good + 0.5) / (n_good + 1)))
    worth = np.where((bad >= 2) & (odds > 1.0), odds * np.sqrt(bad), 0.0)
    ranked = [i for i in sorted(np.flatnonzero(worth), key=lambda i: (-worth[i], cores[i]))][:SPEAKING]
    if not ranked:
        return nothing_learned()
    marked = lambda ids: [units(cores[i])[0] for i in ids]
    clean = np.array(sorted(np.flatnonzero((good > 0) & (worth <= 0)), key=lambda i: cores[i]), np.int64)
    clean = clean[[bool(units(cores[i])) for i in clean]]
    near = kernel(marked(clean), marked(ranked[:32])).max(axis=1) if len(clean) else np.zeros(0)
    order = np.argsort(-near, kind="stable")
    landmarks = list(dict.fromkeys(marked(ranked) + marked(clean[order[:ALIKE]])))
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-3))
    features = lambda strings: kernel(strings, landmarks).astype(np.float64) @ whiten
    # words of clean texts: those most like a speaking word, the commonest, and an even choice of the rest
    common = np.argsort(-good[clean], kind="stable")[:4000]
    picked = sorted(set(order[:7000].tolist()) | set(common.tolist()) | set(range(0, len(clean), max(1, len(clean) // 4000))))
    x_neg, w_neg = features(marked(clean[picked])), np.log2(1 + good[clean[picked]])
    sure = [i for i in ranked if worth[i] >= SURE]
    told = np.where(worth > 0, worth, odds * 0.01)
    best_of = [c[np.argsort(-told[c], kind="stable")[:6]] for c, t in zip(held, y, strict=True) if t and len(c)]
    candidates = sorted(set(sure) | {int(i) for c in best_of for i in c if units(cores[i])})
    if not candidates:
        return nothing_learned()
    x_cand, at = features(marked(candidates)), {c: i for i, c in enumerate(candidates)}
    x_bent = features([f"^{w}$"[:LONGEST] for w in bent([cores[i] for i in sure])]) if sure else np.zeros((0, len(landmarks)))
    witness = Counter(int(c[0]) for c in best_of)
    coefs = np.zeros(0)
    for _ in range(3):
        # a witness that clean texts hold just as often speaks for nothing
        chosen = {w: int(bad[w]) for w in sure} | {w: n for w, n in witness.items() if w in at and odds[w] > 2.0 and bad[w] > 2}
        rows = sorted(chosen.items()) or [(candidates[0], 1)]
        x_pos = np.concatenate([x_cand[[at[w] for w, _ in rows]], x_bent])
        w_pos = np.array([math.log2(1 + n) for _, n in rows] + [1.0] * len(x_bent))
        w_pos *= BALANCE * max(1.0, w_neg.sum()) / w_pos.sum()
        coefs = svm(np.concatenate([x_pos, x_neg]), np.concatenate([np.ones(len(x_pos)), -np.ones(len(x_neg))]), np.concatenate([w_pos, w_neg]))
        f = x_cand @ coefs[:-1] + coefs[-1]
        witness = Counter(max((int(w) for w in c if int(w) in at), key=lambda w: (f[at[w]], w)) for c in best_of if any(int(w) in at for w in c))
    machine = fold(landmarks, whiten @ coefs[:-1], float(coefs[-1]))
    score = machine.raw_scores(raws)
    x = np.stack([text_features(sorted(score[d].tolist(), reverse=True)[:2]) for d in docs])
    machine.curve = logistic(x, y.astype(float))
    return machine


def fold(landmarks: list[str], alpha: np.ndarray, bias: float) -> Machine:
    """Sums the landmarks' subsequence weights, each times its landmark's coefficient."""
    letters = Letters("".join(sorted(set("".join(landmarks)))))
    theta = np.zeros((len(letters.chars) + 1) ** LENGTH + 1, np.float64)
    for m, a in zip(landmarks, alpha, strict=True):
        spots, weights = places(len(m))
        if len(spots):
            codes = code_matrix([m], len(m))
            np.add.at(theta, letters.keys(codes, spots)[0], a * weights / float(norms(codes)[0]))
    theta[-1] = 0  # a subsequence with a foreign letter
    return Machine(letters, theta.astype(np.float32), bias, np.zeros(3))


_known: dict[str, float] = {}
_known_for: list = [None]


def text_scores(texts: list[str | None], machine: Machine, key: object = None) -> np.ndarray:
    if _known_for[0] is not key or key is None:
        _known.clear()
        _known_for[0] = key
    sets = [raw_words(t) for t in texts]
    new = list(set().union(*sets) - _known.keys()) if sets else []
    if len(_known) + len(new) > KEPT_WORDS:
        _known.clear()
        new = list(set().union(*sets))
    for a in range(0, len(new), 50_000):
        _known.update(zip(new[a : a + 50_000], machine.raw_scores(new[a : a + 50_000]).tolist(), strict=True))
    return np.array([machine.text_score(heapq.nlargest(2, map(_known.__getitem__, s))) for s in sets])


@lru_cache(maxsize=2)
def _ready(blob: bytes) -> Machine:
    return pickle.loads(blob)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> bytes:
    """The trained machine, pickled. At most FIT_TOXIC + FIT_CLEAN ids are chosen
    from the narrow label table and broadcast to fetch their texts; the distinct
    words of whole texts are made where the texts lie."""
    bounded_batches(docs.sparkSession)
    narrow = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("_toxic"))
    hashed = F.crc32(F.encode(F.concat(F.lit("fit"), F.col("doc_id").cast("string")), "UTF-8"))
    some = [narrow.where(F.col("_toxic") == v).orderBy(hashed, "doc_id").limit(n) for v, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))]
    ids = some[0].unionByName(some[1])
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id").select("doc_id", "_toxic", F.xxhash64("text").alias("_text"), "text")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="text").assign(words=pd.Series([joined_words(t) for t in pdf["text"]], index=pdf.index, dtype=object))

    told = texts.mapInPandas(listed, "doc_id long, _toxic int, _text long, words binary")
    # one text of an id, however often it is repeated
    rows = told.groupBy("doc_id", "_toxic").agg(F.min_by("words", "_text").alias("words")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return pickle.dumps(train_words((bytes(r["words"]) for r in rows), [r["_toxic"] for r in rows]))


def score_documents(docs: DataFrame, blob: bytes, text: str = "text") -> DataFrame:
    """docs with score and predicted; other columns of those names are replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(blob)  # letters cubed numbers: a few megabytes at most

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            machine = _ready(held.value)
            yield pd.Series(text_scores([t if isinstance(t, str) else None for t in texts], machine, machine))

    kept = [f"`{c}`" for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, scored(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6_gapped_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
