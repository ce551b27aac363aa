"""Exact Jaccard self-join on word n-grams by adaptive multi-match prefixes.

Two sets with Jaccard similarity t or more share at least ``l`` tokens among the
first ``n - ceil(t * n) + l`` of each, in any one order of tokens. Tokens are
ordered from rare to common by a sketch of fixed size that counts every shingle
of every text. Each document lengthens its prefix, l = 1, 2, 3, ..., as far as
the estimated cost of its candidates asks for, and a pair must then share l
tokens (the smaller l of the two) before it is verified.

1. Texts become sets of shingle hashes; equal sets are one class from here on.
2. Prefix tokens meet by token. Up to ``HOT`` classes of one token give pairs,
   summed by pair; where one shared token is enough, a chain of them. More give no pairs: the token is hot. Tokens that the sketch
   says are in very many texts are counted first, so a hot one's classes, be they
   a third of all, never come to one task. With h hot tokens in
   its prefix a pair must still share l - h others. A class with its own l hot
   ones or more is full; a hot token of full classes is tied by a star, not by
   pairs, to all its classes with as many hot ones as the least l of the full.
3. Pairs with enough shared tokens, and stars, make families (connected
   components). A family is dealt over chunks of bounded size, which are compared
   exactly, on whole sets. What leaves a comparison is each class's root among
   those linked with it and its number of links, never the pairs.
4. Components over chunks give the result.

To count links, every pair of a family's chunks is compared. Components alone
(``links=False``) need less: chunks are compared each in itself, then with a few
pivots, the roots of the family's largest parts; what is then still apart from the
family's main part, and only that, is compared with everything. Classes that are
in one component already are not compared again, so a family of copies of one text
costs its size, not its square.

Nothing is capped: a hot token or a large family changes the way, not the result.

Defined results: null or empty text, and text without a word, has an empty set,
no links and its own doc_id as component; with fewer words than n the whole
sequence is one shingle; a null doc_id is dropped, since it cannot be named;
repeated rows (also of one doc_id) are linked copies; an empty table gives an
empty result; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.components import FEW_FILES, components
from tabulon.llm.shared import bounded_batches, forgotten, join_counted, shuffles_dropped, table, written

#: Classes of one token that still give pairs; candidates of l worth trying.
HOT, LEVELS = 24, (1, 2, 3, 4, 6, 8)
#: Shingles are counted in up to 2**FINE_BITS buckets, at least two for each, 2**SLICE_BITS
#: of them in a task at a time. A byte of the sketch has the largest count of
#: 2**GROUP_BITS neighbours: at most 2**SKETCH_BITS bytes (64 MB) on a worker.
FINE_BITS, SLICE_BITS, GROUP_BITS = 30, 22, 4
SKETCH_BITS = FINE_BITS - GROUP_BITS
#: Shingles whose counts are sent at once, and bytes of text that a shingle has, about.
SENT_SHINGLES, SHINGLE_BYTES = 4_000_000, 6
#: log2 of the count from which a token is counted before it is dealt: the sketch
#: bounds the classes of every other one, so no task gets more than 2**(OFTEN + 1)
#: rows of one token.
OFTEN = 10
#: Shingles and classes of a chunk of a family, about.
CHUNK_SHINGLES, CHUNK_SETS = 250_000, 800
#: Classes of a chunk where components alone are asked for: small chunks cost nothing
#: there, for no two are compared with each other unless they are apart.
ALONE_SETS = 240
#: Chunks that meet everything are about so many, as far as ALONE_SETS and CHUNK_SETS let them.
GROWN_CHUNKS = 8
#: Classes of a family that all others are compared with first.
PIVOTS = 8
#: Rows of hot tokens (16 bytes each) up to which their keys are broadcast.
SENT_HOT = 200_000
#: Family members are sent to the readers of texts up to this many; beyond, joined.
SENT_MEMBERS = 400_000

#: Bytes hashed together.
BLOCK_BYTES = 1 << 19

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20260101)
LETTER = _rng.integers(1, 2**64, 256, dtype=np.uint64)
STEP = np.uint64(int(_rng.integers(1, 2**63)) * 2 + 1)
UNSTEP = np.uint64(pow(int(STEP), -1, 1 << 64))
PLACE = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse, as many as a block has bytes."""
    out = []
    for base in (STEP, UNSTEP):
        p = np.full(BLOCK_BYTES, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of at most BLOCK_BYTES bytes, and where they start: a
    running sum of letter values times powers of an odd number, differenced at
    word ends."""
    flat = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(SPACE[flat], prepend=True, append=True))
    first, last = edge[::2], edge[1::2]
    power, back = powers()
    total = np.empty(len(flat) + 1, np.uint64)
    total[0] = 0
    np.cumsum(LETTER[flat] * power[: len(flat)], out=total[1:])
    return mix((total[last] - total[first]) * back[first] + (last - first).astype(np.uint64) * PLACE[63]), first


def long_text_words(data: bytes) -> np.ndarray:
    """Word hashes of a text of any length, block by block, cut between words. A
    word longer than a block is hashed by its digest."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        if end < len(data):
            gaps = np.flatnonzero(SPACE[np.frombuffer(data[at:end], np.uint8)])
            if not len(gaps):
                while end < len(data) and not SPACE[data[end]]:
                    end += 1
                digest = hashlib.blake2b(data[at:end], digest_size=8).digest()
                out.append(np.frombuffer(digest, np.uint64))
                at = end
                continue
            end = at + int(gaps[-1]) + 1
        out.append(word_hashes(data[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(word: np.ndarray, size: int) -> np.ndarray:
    whole = max(0, len(word) - size + 1)
    out = np.zeros(whole, np.uint64)
    for k in range(size):
        out += word[k : k + whole] * PLACE[k]
    return mix(out)


def one_set(word: np.ndarray, windows: np.ndarray, size: int) -> np.ndarray:
    if len(word) >= size:
        return np.unique(windows)
    return mix((word * PLACE[32 : 32 + len(word)]).sum(dtype=np.uint64, keepdims=True)) if len(word) else word


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (unsigned 64 bit) of each whole text. Short
    texts are hashed together, a block at a time."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    total = 0

    def flush() -> None:
        word, first = word_hashes(b"\n".join(held) + b"\n")
        windows = shingles(word, size)
        starts = np.cumsum([0] + [len(d) + 1 for d in held])
        bounds = np.searchsorted(first, starts)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            out.append(one_set(word[a:b], windows[a : max(a, b - size + 1)], size))
        held.clear()

    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass").translate(LOWER)
        if held and total + len(data) + 1 > BLOCK_BYTES:
            flush()
            total = 0
        if len(data) >= BLOCK_BYTES:
            word = long_text_words(data)
            out.append(one_set(word, shingles(word, size), size))
        else:
            held.append(data)
            total += len(data) + 1
    if held:
        flush()
    return out


def least_shared(n: np.ndarray | int, percent: int):
    """What a set of n must share with any set similar to it."""
    return (percent * n + 99) // 100


def packed(at: np.ndarray) -> bytes:
    """Sorted numbers as their differences, byte by byte; the first byte is the width."""
    steps = np.diff(at, prepend=at.dtype.type(0))
    wide = 2 if not len(steps) or steps.max() < 1 << 16 else 4
    return zlib.compress(bytes([wide]) + steps.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T.tobytes(), 1)


def unpacked_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers that were packed, and how often each was."""
    raw = zlib.decompress(data)
    wide = raw[0]
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(wide, -1).T).view(f"<u{wide}").ravel()
    at = np.cumsum(steps, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], steps[1:] > 0])) if len(at) else np.zeros(0, np.int64)
    return at[first], np.diff(np.append(first, len(at)))


def fine_bits(docs: DataFrame) -> int:
    """Bits that number two buckets or more for each shingle, from SLICE_BITS to FINE_BITS."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    return min(FINE_BITS, max(SLICE_BITS, (total // SHINGLE_BYTES).bit_length() + 1))


def sketch(docs: DataFrame, size: int) -> np.ndarray:
    """log2 of the largest count of each group of buckets of shingles, over all texts.
    A shingle's bucket is its hash's upper bits, so none is counted as rarer than it
    is, and a rare one is counted as common only if a common one shares its group.
    Tasks send numbers of buckets by slices; each slice is summed on its own."""
    bits = fine_bits(docs)
    slices = 1 << (bits - SLICE_BITS)

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def sent() -> pd.DataFrame:
            at = np.sort(np.concatenate(held))
            bounds = np.searchsorted(at >> np.uint32(SLICE_BITS), np.arange(slices + 1))
            held.clear()
            there = [i for i in range(slices) if bounds[i] < bounds[i + 1]]
            return pd.DataFrame({"slice": there, "data": [packed(at[bounds[i] : bounds[i + 1]] & np.uint32((1 << SLICE_BITS) - 1)) for i in there]})

        for pdf in batches:
            for u in shingle_sets([t if isinstance(t, str) else None for t in pdf["text"]], size):
                held.append((u >> np.uint64(64 - bits)).astype(np.uint32))
            if sum(map(len, held)) >= SENT_SHINGLES:
                yield sent()
        if held:
            yield sent()

    def add(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, np.zeros(1 << SLICE_BITS, np.uint32)

        def done() -> pd.DataFrame:
            most = total.reshape(-1, 1 << GROUP_BITS).max(axis=1)
            return pd.DataFrame({"slice": [now], "data": [zlib.compress(np.log2(np.maximum(most, 1)).astype(np.uint8).tobytes(), 1)]})

        for pdf in batches:
            for i, data in zip(pdf["slice"], pdf["data"], strict=True):
                if now is not None and i != now:
                    yield done()
                    total[:] = 0
                now = i
                at, n = unpacked_counts(data)
                total[at] += n.astype(np.uint32)
        if now is not None:
            yield done()

    parts = docs.select("text").mapInPandas(count, "slice int, data binary").repartition(min(slices, shuffle_parts(docs.sparkSession)), "slice")
    out = np.zeros((slices, 1 << (SLICE_BITS - GROUP_BITS)), np.uint8)
    for row in parts.sortWithinPartitions("slice").mapInPandas(add, "slice int, data binary").collect():
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["data"]), np.uint8)
    return out.ravel()


def choose_prefix(u: np.ndarray, logs: np.ndarray, usual: float, percent: int) -> tuple[np.ndarray, int, np.ndarray]:
    """The prefix of a set in the order of rarity, its l, and which of its tokens
    may be in very many sets."""
    n = len(u)
    if n == 0:
        return u, 1, np.zeros(0, bool)
    rarity = logs[(u >> np.uint64(65 - len(logs).bit_length())).astype(np.int64)]
    order = np.argsort(rarity, kind="stable")
    base = n - int(least_shared(n, percent))
    # a token's candidates: what its bucket holds above the usual
    cost = np.maximum(0.0, 2.0 ** rarity[order[: base + LEVELS[-1]]] - usual)
    running = np.cumsum(cost)
    best, pick = np.inf, 1
    for level in LEVELS:
        length = base + level
        if length > n:
            break
        # l matches each: at most running / l candidates are verified
        price = running[length - 1] * (1 + 8 / level) + length
        if price < best:
            best, pick = price, level
    picked = order[: base + pick]
    return u[picked], pick, rarity[picked] > OFTEN


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def set_table(docs: DataFrame, logs: np.ndarray, size: int, percent: int) -> DataFrame:
    """doc_id, text_id (a hash of the text), n, sid, check (two independent hashes of
    the set), level, prefix, often."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(logs)
    levels = np.bincount(logs)
    usual = 2.0 * float((2.0 ** np.arange(len(levels)) * levels).sum() / len(logs)) + 2.0

    def told(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = shingle_sets([t if isinstance(t, str) else None for t in pdf["text"]], size)
            rows = []
            for u in sets:
                prefix, level, often = choose_prefix(u, held.value, usual, percent)
                m = mix(u ^ PLACE[40])
                sid, check = mix(m.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(u))), mix(np.bitwise_xor.reduce(mix(u * PLACE[41]), keepdims=True) if len(u) else np.zeros(1, np.uint64))
                rows.append((len(u), int(signed(sid)[0]), int(signed(check)[0]), level, signed(np.ascontiguousarray(prefix)), often))
            out = pd.DataFrame(rows, columns=["n", "sid", "check", "level", "prefix", "often"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            out.insert(1, "text_id", pdf["text_id"].to_numpy())
            yield out

    return docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text").mapInPandas(told, "doc_id long, text_id long, n int, sid long, check long, level int, prefix array<long>, often array<boolean>")


def runs(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and their lengths."""
    starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(t)))


def near_sizes(n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n[a], n[b]).astype(np.int64) >= percent * np.maximum(n[a], n[b]).astype(np.int64)


def chained(t: np.ndarray, n: np.ndarray, one: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that make the same components as all pairs of near sizes, of one token,
    of which a class has level 1: each class with the next smaller one of level 1, and
    with the next larger one if it has another level itself. Rows come by t, then n."""
    at = np.arange(len(t))
    below = np.append(-1, np.maximum.accumulate(np.where(one, at, -1)))[: len(t)]
    above = np.minimum.accumulate(np.where(one, at, len(t))[::-1])[::-1]
    a = np.concatenate([at[below >= 0], at[~one & (above < len(t))]])
    b = np.concatenate([below[below >= 0], above[~one & (above < len(t))]])
    fit = (t[a] == t[b]) & near_sizes(n, a, b, percent)
    return a[fit], b[fit]


def all_pairs(t: np.ndarray, n: np.ndarray, more: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of near sizes, of one token, of two classes of more levels than one."""
    rows = np.flatnonzero(more)
    starts, sizes = runs(t[rows])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for m in np.unique(sizes[sizes > 1]):
        at = starts[sizes == m]
        i, j = np.triu_indices(m, 1)
        found.append((rows[(at[:, None] + i).ravel()], rows[(at[:, None] + j).ravel()]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    fit = near_sizes(n, a, b, percent)
    return a[fit], b[fit]


def meetings(batches: Iterable[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Pairs (a, b, level) of the classes of each token, or the classes of a hot
    token (a, b = token, level = 0). A pair of level 1 needs no other token, so of
    those only as many are given as tie the same classes together. Rows come sorted by token; of a token that
    goes on into the next batch at most HOT + 1 rows are carried."""
    columns = ["token", "sid", "n", "level"]
    carry, hot_token = None, None

    def flush(t: np.ndarray, s: np.ndarray, n: np.ndarray, lv: np.ndarray) -> list[pd.DataFrame]:
        out = []
        starts, sizes = runs(t)
        group = np.repeat(sizes, sizes)
        few = np.flatnonzero((group > 1) & (group <= HOT))
        few = few[np.lexsort((s[few], n[few], t[few]))]
        for a, b in (chained(t[few], n[few], lv[few] == 1, percent), all_pairs(t[few], n[few], lv[few] > 1, percent)):
            a, b = few[a], few[b]
            out.append(pd.DataFrame({"a": np.minimum(s[a], s[b]), "b": np.maximum(s[a], s[b]), "level": np.minimum(lv[a], lv[b])}))
        hot = np.repeat(sizes > HOT, sizes)
        if hot.any():
            out.append(pd.DataFrame({"a": s[hot], "b": t[hot], "level": 0}))
        return out

    for pdf in batches:
        if carry is not None:
            pdf = pd.concat([carry, pdf[columns]], ignore_index=True)
            carry = None
        if pdf.empty:
            continue
        t, s, n, lv = (pdf[c].to_numpy() for c in columns)
        if hot_token is not None:
            same = t == hot_token
            if same.any():
                yield pd.DataFrame({"a": s[same], "b": t[same], "level": 0})
            if same.all():
                continue
            t, s, n, lv, hot_token = t[~same], s[~same], n[~same], lv[~same], None
        tail = int(np.searchsorted(t, t[-1]))
        if len(t) - tail > HOT:
            hot_token, tail = int(t[-1]), len(t)
        yield from flush(t[:tail], s[:tail], n[:tail], lv[:tail])
        if tail < len(t):
            carry = pd.DataFrame({"token": t[tail:], "sid": s[tail:], "n": n[tail:], "level": lv[tail:]})
    if carry is not None:
        yield from flush(*(carry[c].to_numpy() for c in columns))


def compare(sids: np.ndarray, side: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], percent: int, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Root (by union of linked pairs) and number of linked copies of each class.
    With ``across`` only pairs of two sides count, so none where one is empty."""
    m = len(sids)
    sizes = np.array([len(s) for s in sets], np.int64)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1] if m else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(m), sizes)
    held = np.bincount(token)
    number = np.cumsum(held > 1) - 1
    shared = held[token] > 1
    token, owner = number[token[shared]], owner[shared]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    parent, links = np.arange(m), np.zeros(m, np.int64)
    inter = np.zeros((m, m), np.float32)
    wide = int(number[-1]) + 1 if len(number) else 0
    step = max(256, 8_000_000 // max(1, m))
    for at in range(0, wide, step):
        a, b = np.searchsorted(token, [at, at + step])
        block = np.zeros((m, min(step, wide - at)), np.float32)
        block[owner[a:b], token[a:b] - at] = 1
        inter += block @ block.T
    union = sizes[:, None] + sizes[None, :] - inter
    linked = np.triu((100 * inter >= percent * union) & (inter > 0), 1)
    if across:
        linked &= side[:, None] != side[None, :]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(linked), strict=True):
        links[i] += copies[j]
        links[j] += copies[i]
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
    return sids[[root(i) for i in range(m)]], links


def compared(batches: Iterable[pd.DataFrame], size: int, percent: int) -> Iterator[pd.DataFrame]:
    """sid, root, links, chunks for each class and meeting; rows come sorted by
    meeting, and one meeting at a time is held."""
    held: list[pd.DataFrame] = []

    def done() -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        root, links = compare(pdf["sid"].to_numpy(), pdf["chunk"].to_numpy(), pdf["copies"].to_numpy(), shingle_sets(pdf["text"].tolist(), size), percent, now[1] != now[2])
        return pd.DataFrame({"sid": pdf["sid"], "root": root, "links": links, "chunks": pdf["chunks"]})

    now = None
    for pdf in batches:
        keys = list(zip(pdf["family"], pdf["i"], pdf["j"], strict=True))
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if now is not None and keys[at] != now:
                yield done()
                held.clear()
            now = keys[at]
            held.append(pdf.iloc[at:end])
            at = end
    if held:
        yield done()


def similar_components(docs: DataFrame, size: int = 5, percent: int = 80, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and, with ``links``, n_links for docs
    (doc_id, text): the connected components of documents whose shingle sets have a
    Jaccard similarity of ``percent`` hundredths or more."""
    bounded_batches(docs.sparkSession)
    with shuffles_dropped(docs.sparkSession):
        return _similar_components(docs, size, percent, links)


def _similar_components(docs: DataFrame, size: int, percent: int, links: bool) -> DataFrame:
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    sets = written(set_table(docs, sketch(docs, size), size, percent), "sets")
    classes = written(
        sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min_by("text_id", F.struct("doc_id", "text_id")).alias("text_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("level").alias("level"), F.first("prefix").alias("prefix"), F.first("often").alias("often"), F.min("check").alias("check"), F.max("check").alias("_check")),
        "classes",
    )
    if not classes.where(F.col("check") != F.col("_check")).isEmpty():
        raise RuntimeError("two different sets share a 64-bit hash: change the seed")
    # prefixes are most of both tables: each is kept without them once they have been read
    wide, sets = sets, written(sets.select("doc_id", "text_id", "n", "sid"), "sets-narrow")
    forgotten(wide)
    family = written(components(candidates(classes, percent)), "families")
    wide, classes = classes, written(classes.select("sid", "doc_id", "text_id", "copies", "n"), "classes-narrow")
    forgotten(wide)
    members = family.join(classes.select(F.col("sid").alias("node"), "doc_id", "text_id", "copies", "n"), "node").select(F.col("node").alias("sid"), F.col("root").alias("family"), "doc_id", "text_id", "copies", "n")
    members = written(dealt(members, "chunks", "chunk", CHUNK_SETS if links else ALONE_SETS), "members")
    # of a row that is there several times one is taken; narrow rows tell whether there are any
    repeated = not sets.groupBy("doc_id", "text_id").count().where("count > 1").isEmpty()
    meetings_of = Meetings(docs, size, percent, repeated)
    if links:
        told = meetings_of.pairs(members, "chunk", "chunks")
        several = told.where("chunks > 1 and sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b"))
    else:
        told = meetings_of.alone(members)
        several = apart(told, members, meetings_of)
    one = told.where("chunks = 1").select(F.col("sid").alias("node"), "root").distinct()
    roots = one.unionByName(components(several)) if not several.isEmpty() else one
    named = roots.join(classes.select(F.col("sid").alias("node"), "doc_id"), "node")
    least = written(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least-ids")
    placed = named.join(least, "root").select("node", "component_id")
    by_class = classes.select(F.col("sid").alias("node"), "copies", "doc_id").join(placed, "node", "left")
    counted = told.groupBy(F.col("sid").alias("node")).agg(F.sum("links").alias("links"))
    by_class = by_class.join(counted, "node", "left").select(F.col("node").alias("sid"), F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("_copies"))
    out = join_counted(sets.select("doc_id", "sid", "n"), written(by_class, "by-class"), "sid", "_copies", "doc_id")
    empty = F.col("n") == 0
    own = [F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links")] if links else []
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *own)


def shuffle_parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Edges a, b among classes such that every linked pair is in one component."""
    columns = ["token", "sid", "n", "level"]
    postings = classes.select("sid", "n", "level", F.explode(F.arrays_zip("prefix", "often")).alias("p")).select(F.col("p.prefix").alias("token"), "sid", "n", "level", F.col("p.often").alias("often"))
    meeting, more = postings.where("not often").select(columns), None
    often = written(postings.where("often").select(columns), "often")
    if not often.isEmpty():
        counts = written(often.groupBy("token").agg(F.count(F.lit(1)).alias("held")), "often-counts")
        counted = often.join(counts, "token")
        meeting = meeting.unionByName(counted.where(F.col("held") <= HOT).select(columns))
        more = counted.where(F.col("held") > HOT).select("sid", "token")
    met = meeting.repartition(shuffle_parts(classes.sparkSession), "token").sortWithinPartitions("token").mapInPandas(lambda it: meetings(it, percent), "a long, b long, level int")
    met = written(met, "meetings")
    hot = met.where("level = 0").select(F.col("a").alias("sid"), F.col("b").alias("token"))
    hot = hot if more is None else written(hot.unionByName(more), "hot")
    pairs = met.where("level > 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("level").alias("level"))
    warmth = hot.limit(SENT_HOT + 1).count()
    if not warmth:
        return pairs.where("shared >= greatest(1, level)").select("a", "b")
    # of few hot rows (counted) keys are broadcast; of more they are written, so that both
    # sides of the joins by token are plain exchanges and a hot one can be split
    few = warmth <= SENT_HOT
    kept = lambda df, name: written(df.coalesce(FEW_FILES) if few else df, name)
    keys = lambda df, name: F.broadcast(kept(df, name)) if few else kept(df, name)
    heat = kept(hot.groupBy("sid").agg(F.count(F.lit(1)).alias("heat")), "heat")
    for side in ("a", "b"):
        own = heat.select(F.col("sid").alias(side), F.col("heat").alias(f"heat_{side}"))
        pairs = pairs.join(F.broadcast(own) if few else own, side, "left")
    least_heat = F.least(F.coalesce("heat_a", F.lit(0)), F.coalesce("heat_b", F.lit(0)))
    found = pairs.where(F.col("shared") >= F.greatest(F.lit(1), F.col("level") - least_heat)).select("a", "b")
    # who shares only hot tokens shares the smaller level of them, so one of the two is full
    levels = heat.join(classes.select("sid", "level"), "sid")
    warm = kept(hot.join(keys(levels, "levels"), "sid"), "warm")
    asked = warm.where("heat >= level").groupBy("token").agg(F.min("level").alias("asked"))
    held = kept(warm.join(keys(asked, "asked"), "token").where("heat >= asked").select("sid", "token"), "held")
    hubs = held.groupBy("token").agg(F.min("sid").alias("hub"))
    stars = held.join(keys(hubs, "hubs"), "token").select(F.col("sid").alias("a"), F.col("hub").alias("b"))
    return found.unionByName(stars)


def dealt(members: DataFrame, chunks: str, chunk: str, sets: int | None = None) -> DataFrame:
    """members with the number of chunks of their family, of ``sets`` classes at
    most or so, and their own. Without ``sets`` chunks grow with the family, from
    ALONE_SETS to CHUNK_SETS: texts that meet every chunk are sent once for each."""
    held = F.count(F.lit(1))
    most = F.lit(sets) if sets else F.least(F.lit(CHUNK_SETS), F.greatest(F.lit(ALONE_SETS), F.floor(held / F.lit(GROWN_CHUNKS))))
    widths = written(members.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / F.lit(CHUNK_SHINGLES)), F.ceil(held / most)).cast("int").alias(chunks)), "widths")
    return members.join(widths, "family").withColumn(chunk, F.pmod(F.xxhash64("sid"), F.col(chunks)).cast("int"))


class Meetings:
    """Comparisons of members' texts, group by group (family, i, j)."""

    def __init__(self, docs: DataFrame, size: int, percent: int, repeated: bool) -> None:
        self.docs = docs.withColumn("text_id", F.xxhash64("text"))
        self.size, self.percent, self.repeated = size, percent, repeated

    def texts(self, members: DataFrame) -> DataFrame:
        """members are sent to the readers of texts, or else joined."""
        few = members.limit(SENT_MEMBERS + 1).count() <= SENT_MEMBERS
        found = self.docs.join(F.broadcast(members) if few else members, ["doc_id", "text_id"])
        return found.dropDuplicates(["sid"]) if self.repeated else found

    def compared(self, rows: DataFrame) -> DataFrame:
        size, percent = self.size, self.percent
        dealt_ = rows.select("family", "i", "j", "sid", "chunk", "chunks", "copies", "text").repartition(shuffle_parts(rows.sparkSession), "family", "i", "j")
        return written(dealt_.sortWithinPartitions("family", "i", "j").mapInPandas(lambda it: compared(it, size, percent), "sid long, root long, links long, chunks int"), "compared")

    def pairs(self, members: DataFrame, chunk: str, chunks: str) -> DataFrame:
        """Every chunk with every chunk of its family."""
        return self.compared(_paired(self.texts(members), chunk, chunks))

    def alone(self, members: DataFrame) -> DataFrame:
        """Every chunk in itself."""
        return self.compared(self.texts(members).withColumn("i", F.col("chunk")).withColumn("j", F.col("chunk")))


def _paired(texts: DataFrame, chunk: str, chunks: str) -> DataFrame:
    other = texts.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(chunks) - 1)))
    return other.withColumn("i", F.least(chunk, "_other")).withColumn("j", F.greatest(chunk, "_other"))


def _edges(told: DataFrame) -> DataFrame:
    return told.where("chunks > 1 and sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b"))


#: Chunks of a family's main part are numbered from here where they meet the rest.
MAIN = 1 << 30


def apart(told: DataFrame, members: DataFrame, meet: Meetings) -> DataFrame:
    """Links of families of several chunks, enough for their components: within
    chunks (``told``), with pivots, and of all that is then apart from the family's
    main part with everything."""
    links = _edges(told)
    wide = members.where("chunks > 1")
    if wide.isEmpty():
        return links
    parts = told.where("chunks > 1").join(wide.select("sid", "family"), "sid").groupBy("family", "root").agg(F.count(F.lit(1)).alias("_size"))
    number = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("_size"), "root"))
    pivots = parts.withColumn("_no", number).where(F.col("_no") <= PIVOTS).select(F.col("root").alias("sid"))
    pivots = written(wide.join(pivots, "sid"), "pivots")
    theirs = meet.texts(pivots).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("chunk", F.lit(-1))
    own = meet.texts(wide).withColumn("i", F.col("chunk"))
    links = links.unionByName(_edges(meet.compared(own.unionByName(theirs.select(own.columns)).withColumn("j", F.lit(-1)))))
    whole = written(components(links), "parts").withColumnsRenamed({"node": "sid", "root": "_part"})
    placed = written(wide.join(whole, "sid", "left").withColumn("_part", F.coalesce("_part", "sid")), "placed")
    largest = placed.groupBy("family", "_part").agg(F.count(F.lit(1)).alias("_size")).groupBy("family").agg(F.max_by("_part", F.struct("_size", "_part")).alias("_main"))
    placed = placed.join(written(largest, "largest"), "family")
    rest = placed.where("_part <> _main").drop("_part", "_main")
    if rest.isEmpty():
        return links
    rest = written(dealt(rest, "_parts", "_own"), "rest")
    main = dealt(placed.where("_part = _main").drop("_part", "_main"), "_mains", "_at")
    main = written(main.join(written(rest.select("family", "_parts").distinct(), "rest-parts"), "family"), "main")
    rest = rest.join(written(main.select("family", "_mains").distinct(), "main-parts"), "family")
    columns = ["family", "i", "j", "sid", "chunk", "chunks", "copies", "text"]
    ours = meet.texts(rest).withColumn("chunk", F.col("_own"))
    among = _paired(ours, "_own", "_parts").select(columns)
    against = ours.withColumn("i", F.col("_own")).withColumn("j", F.explode(F.sequence(F.lit(MAIN), F.col("_mains") + F.lit(MAIN - 1)))).select(columns)
    others = meet.texts(main).withColumn("j", F.col("_at") + F.lit(MAIN)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("chunk", F.col("j")).select(columns)
    return links.unionByName(_edges(meet.compared(among.unionByName(against).unionByName(others))))


def op5_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 0.9 on three-word shingles, and, as this is a
    join, each document's number of links."""
    return similar_components(table(spark, sf_dir, "documents"), 3, 90)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(sh)) AS h FROM s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT ways.y, reach.r FROM reach JOIN ways ON ways.x = reach.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = n.doc_id) AS component_id,
  (SELECT count(*) FROM ways WHERE ways.x = n.doc_id) AS n_links
FROM n
"""
