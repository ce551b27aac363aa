"""Quality rules as a learned decision list: native SQL only.

Statistics of every whole text are computed by array functions, without a
shuffle. A list of rules is learned from labelled rows by sequential covering:
a rule grows by the threshold condition that gains most, is pruned on rows held
back from growing, and is kept if it is precise enough; the rows it covers are
then set aside and the next rule is grown. The list becomes one ordered chain
of WHEN ... THEN conditions.

Defined results: null text has no words and fails the base rules; empty text
likewise; ties between conditions go to the earlier statistic and the lower
threshold, so learning is repeatable; repeated rows are judged alike; an empty
table gives an empty result; without usable labels the list is empty and only
the base rules decide; other columns stay as they are, whatever their names, but
for those called like an output (STATISTICS and VERDICTS), which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.shared import row_of, table, unpacked, words

#: Learning reads at most this many labelled documents, those with the lowest
#: hash of doc_id. Fitting only; scoring and statistics cover every row.
FIT_ROWS = 8000
#: Statistics a condition may use, in order of preference.
FEATURES = ("symbol_share", "repeat_share", "dup_line_share", "upper_share", "digit_share", "mean_word", "distinct_share", "line_words", "n_words")
#: What the operator adds; columns of these names are replaced, all others stay.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", *(f for f in FEATURES if f != "n_words"))
VERDICTS = ("base_failed", "rule", "kept")
MIN_PRECISION, MIN_COVER, MAX_CONDITIONS, MAX_RULES, CUTS = 0.97, 8, 3, 12, 24


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, row) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    verdict: int

    def holds(self, row) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window found at two places or more.

    Window hashes with the window's place in the low bits are sorted as plain
    longs, so equal windows become neighbours; the places of those that have an
    equal neighbour are sorted again and the union of their three-word spans is
    measured. Where unequal windows share a hash, the same is done on the
    windows themselves.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        zero_state = F.struct(F.lit(-3).cast("long").alias("last"), zero.alias("n"))
        return F.aggregate(places, zero_state, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(p - s["last"], F.lit(3).cast("long"))).alias("n")), lambda s: s["n"])

    def window(ws: Column, p: Column) -> Column:
        return F.struct(F.get(ws, p), F.get(ws, p + 1), F.get(ws, p + 2))

    def by_words(ws: Column, spots: Column) -> Column:
        keyed = F.array_sort(F.transform(spots, lambda p: F.struct(window(ws, p).alias("k"), p.cast("long").alias("p"))))
        pairs = let(keyed, lambda s: F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["k"].eqNullSafe(x["k"])) | (F.get(s, i + 1)["k"].eqNullSafe(x["k"]))), lambda x: x["p"]))
        return covered(F.array_sort(pairs))

    def by_hash(ws: Column) -> Column:
        spots = F.sequence(F.lit(0), F.size(ws) - F.lit(3))
        # the low bits of a packed value are the place
        mask = let(F.size(ws), lambda n: F.call_function("shiftleft", one, F.length(F.bin(n))) - one)

        def packed(ws_: Column, mask_: Column) -> Column:
            return F.sort_array(F.transform(spots, lambda p: F.xxhash64(F.get(ws_, p), F.get(ws_, p + 1), F.get(ws_, p + 2)).bitwiseAND(F.bitwise_not(mask_)).bitwiseOR(p.cast("long"))))

        def found(mask_: Column, s: Column) -> Column:
            same = lambda a, b: F.coalesce(a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(mask_)) == zero, F.lit(False))
            hits = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))

            def judged(h: Column) -> Column:
                unlike = F.exists(F.sequence(F.lit(1), F.size(h) - F.lit(1)), lambda i: same(F.get(h, i), F.get(h, i - 1)) & ~window(ws, F.get(h, i).bitwiseAND(mask_).cast("int")).eqNullSafe(window(ws, F.get(h, i - 1).bitwiseAND(mask_).cast("int"))))
                exact = by_words(ws, spots)
                return F.when(F.size(h) == 0, zero).when((F.size(h) > 1) & unlike, exact).otherwise(covered(F.array_sort(F.transform(h, lambda x: x.bitwiseAND(mask_)))))

            return let(hits, judged)

        return let(mask, lambda m: let(packed(ws, m), lambda s: found(m, s)))

    return F.when(F.size(w) < 3, zero).otherwise(by_hash(w))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with STATISTICS: the base counts and the shares that conditions test."""
    return unpacked(_statistics(docs, text, STATISTICS), *STATISTICS)


def _statistics(docs: DataFrame, text: str, replaced: tuple[str, ...]) -> DataFrame:
    """``_row``, STATISTICS and working columns."""
    body = F.coalesce(F.col("_text"), F.lit(""))
    w = F.col("_words")
    long0 = lambda c: c.cast("long")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = (
        docs.select(row_of(docs, *(c for c in replaced if c != text)), F.col(text).alias("_text"))
        .withColumn("_words", words(F.col("_text")))
        .withColumn("n_words", long0(F.size(w)))
        .withColumn("word_chars", long0(F.length(F.array_join(w, ""))))
        .withColumn("n_symbols", long0(F.regexp_count(body, F.lit(r"[#*$%&|<>]"))))
        .withColumn("_lines", lines)
        .withColumn("n_lines", long0(F.size("_lines")))
        .withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
        .withColumn("n_repeat_words", let(w, repeated_words))
        .withColumn("_distinct", long0(F.size(F.array_distinct(w))))
        .withColumn("_upper", long0(F.regexp_count(body, F.lit(r"\p{Lu}"))))
        .withColumn("_digits", long0(F.regexp_count(body, F.lit(r"[0-9]"))))
    )
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = F.col
    shares = {
        "symbol_share": share(c("n_symbols"), c("word_chars")),
        "repeat_share": share(c("n_repeat_words"), c("n_words")),
        "dup_line_share": share(c("n_dup_lines"), c("n_lines")),
        "upper_share": share(c("_upper"), c("word_chars")),
        "digit_share": share(c("_digits"), c("word_chars")),
        "mean_word": share(c("word_chars"), c("n_words")),
        "distinct_share": share(c("_distinct"), c("n_words")),
        "line_words": share(c("n_words"), c("n_lines")),
    }
    return counted.select("*", *[v.alias(k) for k, v in shares.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """The labelled documents learned from: the ``limit`` lowest by hash of
    doc_id. The ids are chosen from the narrow label table; at most ``limit``
    of them are broadcast."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label"))
    chosen = chosen.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def cut_points(rows: list, feature: str) -> list[float]:
    values = sorted({r[feature] for r in rows})
    if len(values) < 2:
        return []
    picks = sorted({values[(len(values) - 1) * i // CUTS] for i in range(1, CUTS)} | {values[len(values) * 99 // 100], values[len(values) // 100]})
    return [float(v) for v in picks if v < values[-1]]


def learn(rows: list, label: str = "_label", bad: int = 0) -> list[Rule]:
    """Ordered rules for ``bad`` rows; every rule's verdict is ``bad``.

    Two rows of three grow rules and the third prunes them. A rule is kept if,
    on both parts together, it covers MIN_COVER rows of which MIN_PRECISION are
    bad: rejecting a clean row costs more than letting a bad one pass."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[Rule] = []
    cuts = {f: cut_points(grow, f) for f in FEATURES}
    while len(rules) < MAX_RULES and any(r[label] == bad for r in grow):
        left, made = grow, []
        while len(made) < MAX_CONDITIONS and any(r[label] != bad for r in left):
            best, pick = 0.0, None
            p0 = sum(r[label] == bad for r in left)
            base = p0 / len(left)
            for f in FEATURES:
                for cut in cuts[f]:
                    n_high = p_high = 0
                    for r in left:
                        if r[f] > cut:
                            n_high += 1
                            p_high += r[label] == bad
                    for above, n, p in ((True, n_high, p_high), (False, len(left) - n_high, p0 - p_high)):
                        if n >= MIN_COVER // 2 and n < len(left) and p:
                            gain = p * ((p + 0.1) / (n + 0.2) - base)
                            if gain > best + 1e-12:
                                best, pick = gain, Condition(f, above, cut)
            if pick is None:
                break
            made.append(pick)
            left = [r for r in left if pick.holds(r)]
        while len(made) > 1:  # drop the last conditions while the held-back rows don't mind
            worth = lambda cs: (lambda hit: sum(1 if r[label] == bad else -3 for r in hit))([r for r in prune if all(c.holds(r) for c in cs)])
            if worth(made[:-1]) < worth(made):
                break
            made = made[:-1]
        rule = Rule(tuple(made), bad)
        hit = [r for r in grow + prune if rule.holds(r)] if made else []
        good = sum(r[label] == bad for r in hit)
        if not made or len(hit) < MIN_COVER or good < MIN_PRECISION * len(hit):
            break
        rules.append(rule)
        grow, prune = [r for r in grow if not rule.holds(r)], [r for r in prune if not rule.holds(r)]
    return rules


def verdict(rules: list[Rule], otherwise: int = 1) -> Column:
    """The list as one ordered conditional expression."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(rule.verdict)) if out is None else out.when(rule.column(), F.lit(rule.verdict))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def fired(rules: list[Rule]) -> Column:
    """The number of the rule that decided, from 1; 0 if none did."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(rule.column(), F.lit(i)) if out is None else out.when(rule.column(), F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = FIT_ROWS) -> list[Rule]:
    """Rules for documents labelled 0. Rows that fail the base rules are decided
    already and are not learned from."""
    # filtered here: a filter in the plan would move below the join and have
    # every document's statistics computed
    sample = with_statistics(fit_sample(docs, labels, label, limit)).select("doc_id", "_label", base_failed().alias("_failed"), *FEATURES)
    # one row of an id, however often it is repeated: what is collected stays bounded
    ones = sample.groupBy("doc_id", "_label").agg(F.min(F.struct("_failed", *FEATURES)).alias("s")).select("doc_id", "_label", "s.*")
    rows = sorted((r.asDict() for r in ones.collect() if not r["_failed"]), key=lambda r: r["doc_id"])
    return learn(rows)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with STATISTICS and VERDICTS."""
    told = _statistics(docs, "text", STATISTICS + VERDICTS).withColumn("base_failed", base_failed()).withColumn("rule", fired(rules))
    return unpacked(told.withColumn("kept", ~F.col("base_failed") & (verdict(rules) == F.lit(1))), *STATISTICS, *VERDICTS)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
