"""Mixing sources to target weights by iterative proportional fitting: native SQL only.

Documents fall into cells of source, language and topic. One aggregation sums
each cell's tokens; the multipliers of the three margins are then raked in turn
until the weighted token shares meet all three target margins. A document is
kept with its cell's weight over the largest weight, decided by a hash of its
id, so the margins are met in expectation, one seed gives one sample, and copies
of a row share its fate.

The topic is a column of the caller's, or else the first of a list of patterns
that a whole text holds (TOPICS, a parameter).

Up to ``ONE_ROW_CELLS`` cells are raked as one array fold in one row. More stay a
table: each step is one grouped sum, a margin's multipliers are a table joined
back, and raking ends when the margins are met. Documents meet their cell's
probability through a broadcast of at most ``MAX_CELLS`` cells, whose bound is
checked, else through a join with hot cells dealt over parts. No number of cells
is refused, and a hot cell is neither sorted nor gathered anywhere.

Targets that cannot be met (a category without tokens, margins that contradict)
are told by a warning with the largest distance of a share from its target.

Defined results: a null source, language or topic is a category of its own,
apart from every text; null text has no tokens and the topic ``general``; a null
id is decided as an empty one; a category without tokens keeps weight 0 where its
target cannot be met, and its documents are dropped only if the cell holds no
token at all, that is never if they have words; an empty table gives an empty
result; extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

import warnings
from operator import itemgetter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.shared import join_counted, row_of, table, unpacked, words, written

#: Cells of the fold in one row, and of a broadcast; more go other ways.
ONE_ROW_CELLS, MAX_CELLS = 2_000, 20_000
#: Rounds of the three margins; tables stop earlier, where no share is further from
#: its target than SETTLED. A distance over TOLD is warned of.
ROUNDS, SETTLED, TOLD = 20, 1e-13, 1e-4
#: Margins and the power that flattens each one's token shares where no target is given.
MARGINS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Topics by the first pattern that a whole text holds.
TOPICS = (("legal", r"[Ll]icen[sc]e|[Cc]opyright"), ("contact", r"@[A-Za-z]"), ("figures", r"[0-9]{2}"))


def topic_of(text: Column, rules: tuple[tuple[str, str], ...] = TOPICS) -> Column:
    body, out = F.coalesce(text, F.lit("")), None
    for name, pattern in rules:
        out = F.when(body.rlike(pattern), F.lit(name)) if out is None else out.when(body.rlike(pattern), F.lit(name))
    return F.lit("general") if out is None else out.otherwise(F.lit("general"))


def tokens_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that key and seed decide."""
    digest = F.md5(F.encode(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")), "UTF-8"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def category(value: Column) -> Column:
    """A margin's category as a key without nulls: null is apart from every text."""
    return F.struct(value.isNull().alias("none"), F.coalesce(value.cast("string"), F.lit("")).alias("v"))


def named(key: Column, name: str) -> Column:
    return F.when(~key["none"], key["v"]).alias(name)


def _looked_up(targets: dict[str | None, float]):
    texts = [F.lit(v) for k, t in targets.items() if k is not None for v in (k, float(t))]
    known = F.create_map(*texts) if texts else F.create_map().cast("map<string,double>")
    return lambda key: F.when(key["none"], F.lit(float(targets.get(None, 0.0)))).otherwise(F.coalesce(F.element_at(known, key["v"]), F.lit(0.0)))


def _flattened(d: str, power: float):
    def own(i: Column) -> Column:
        share = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + F.when(x[d] == i, x["share"]).otherwise(F.lit(0.0)))
        return F.pow(share, F.lit(power))

    return own


def _share_of(array: str):
    return lambda v: F.coalesce(F.try_divide(v, F.aggregate(array, F.lit(0.0), lambda a, b: a + b)), F.lit(0.0))


def _margin(d: str, others: list[str], state: Column):
    """A category's multiplier that meets its target, given the other margins'."""

    def multiplier(i: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            weighted = x["share"]
            for o in others:
                weighted = weighted * F.get(state[o], x[o])
            return acc + F.when(x[d] == i, weighted).otherwise(F.lit(0.0))

        return F.coalesce(F.try_divide(F.get(F.col(f"t_{d}"), i), F.aggregate("p", F.lit(0.0), add)), F.lit(0.0))

    return multiplier


def raked_weights(cells: DataFrame, targets: dict[str, dict[str | None, float]] | None = None, powers: dict[str, float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """cells (the margins' columns and ``tokens``) with ``weight`` and
    ``probability``. A margin's target shares come from ``targets``; without them
    its own shares raised to its power are used. At most ONE_ROW_CELLS cells."""
    powers = powers or MARGINS
    names = list(powers)
    if cells.limit(ONE_ROW_CELLS + 1).count() > ONE_ROW_CELLS:
        raise ValueError(f"more than {ONE_ROW_CELLS} cells: raked_tables rakes any number")
    one = cells.agg(F.array_sort(F.collect_list(F.struct(*[category(F.col(d)).alias(d) for d in names], F.col("tokens").cast("double").alias("tokens")))).alias("c"))
    for d in names:
        one = one.withColumn(f"v_{d}", F.array_sort(F.array_distinct(F.transform("c", itemgetter(d)))))
    total = F.aggregate("c", F.lit(0.0), lambda acc, x: acc + x["tokens"])
    one = one.withColumn("total", total)
    # cells with places in each margin instead of names, and shares instead of tokens
    one = one.withColumn("p", F.transform("c", lambda x: F.struct(*[(F.array_position(F.col(f"v_{d}"), x[d]) - 1).cast("int").alias(d) for d in names], F.coalesce(F.try_divide(x["tokens"], F.col("total")), F.lit(0.0)).alias("share"))))
    for d in names:
        places = F.sequence(F.lit(0), F.size(f"v_{d}") - 1)
        if targets and d in targets:
            raw = F.transform(f"v_{d}", _looked_up(targets[d]))
        else:
            raw = F.transform(places, _flattened(d, powers[d]))
        one = one.withColumn(f"r_{d}", raw)
        one = one.withColumn(f"t_{d}", F.transform(f"r_{d}", _share_of(f"r_{d}")))

    def rake(state: Column, step: Column) -> Column:
        fields = []
        for at, d in enumerate(names):
            margin = _margin(d, [o for o in names if o != d], state)
            fields.append(F.when(step % len(names) == at, F.transform(F.sequence(F.lit(0), F.size(f"t_{d}") - 1), margin)).otherwise(state[d]).alias(d))
        return F.struct(*fields)

    start = F.struct(*[F.transform(f"v_{d}", lambda _: F.lit(1.0)).alias(d) for d in names])
    fitted = one.where(F.size("c") > 0).withColumn("m", F.aggregate(F.sequence(F.lit(0), F.lit(rounds * len(names) - 1)), start, rake))

    def weigh(x: Column) -> Column:
        out = F.lit(1.0)
        for d in names:
            out = out * F.get(F.col(f"m.{d}"), x[d])
        return out

    weighed = fitted.withColumn("w", F.transform("p", weigh)).withColumn("most", F.array_max("w"))
    rows = weighed.select("most", F.explode(F.arrays_zip("c", "w")).alias("z"))
    return rows.select(*[named(F.col(f"z.c.{d}"), d) for d in names], F.col("z.c.tokens").cast("long").alias("tokens"), F.col("z.w").alias("weight"), F.coalesce(F.try_divide(F.col("z.w"), F.col("most")), F.lit(0.0)).alias("probability"))


def _times(cells: DataFrame, margins: dict[str, DataFrame]) -> DataFrame:
    """cells with ``w``, the product of the margins' multipliers; small margins
    are broadcast."""
    out, w = cells, F.lit(1.0)
    for d, m in margins.items():
        own = m.select(d, F.col("m").alias(f"_m_{d}"))
        out = out.join(F.broadcast(own) if own.count() <= MAX_CELLS else own, d)
        w = w * F.col(f"_m_{d}")
    return out.withColumn("w", w).drop(*[f"_m_{d}" for d in margins])


def raked_tables(cells: DataFrame, targets: dict[str, dict[str | None, float]] | None = None, powers: dict[str, float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """As ``raked_weights``, for any number of cells; rounds end early once the
    margins are met."""
    powers = powers or MARGINS
    names = list(powers)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    share = F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.lit(total)), F.lit(0.0))
    own = written(cells.select(*[category(F.col(d)).alias(d) for d in names], "tokens", share.alias("share")), "mix-shares")
    margins: dict[str, DataFrame] = {}
    for d in names:
        raw = _looked_up(targets[d])(F.col(d)) if targets and d in targets else F.pow("s", F.lit(powers[d]))
        t = written(own.groupBy(d).agg(F.sum("share").alias("s")).select(d, raw.alias("raw")), "mix-target")
        whole = float(t.agg(F.sum("raw")).first()[0] or 0)
        margins[d] = t.select(d, F.coalesce(F.try_divide(F.col("raw"), F.lit(whole)), F.lit(0.0)).alias("t"), F.lit(1.0).alias("m"), F.lit(1.0).alias("off"))
    for _ in range(rounds):
        furthest = 0.0
        for d in names:
            sums = _times(own, {o: m for o, m in margins.items() if o != d}).groupBy(d).agg(F.sum(F.col("share") * F.col("w")).alias("s"))
            off = F.abs(F.col("s") * F.col("m") - F.col("t"))
            margins[d] = written(sums.join(margins[d], d).select(d, "t", F.coalesce(F.try_divide(F.col("t"), F.col("s")), F.lit(0.0)).alias("m"), off.alias("off")), "mix-multipliers")
            furthest = max(furthest, float(margins[d].agg(F.max("off")).first()[0] or 0))
        if furthest <= SETTLED:
            break
    weighed = written(_times(own, margins), "mix-weighed")
    most = float(weighed.agg(F.max("w")).first()[0] or 0)
    return weighed.select(*[named(F.col(d), d) for d in names], F.col("tokens").cast("long").alias("tokens"), F.col("w").alias("weight"), F.coalesce(F.try_divide(F.col("w"), F.lit(most)), F.lit(0.0)).alias("probability"))


def largest_gap(weights: DataFrame, targets: dict[str, dict[str | None, float]] | None = None, powers: dict[str, float] | None = None) -> float:
    """The largest distance of a weighted share from its target in any margin."""
    out = 0.0
    for d, power in (powers or MARGINS).items():
        sums = weights.groupBy(category(F.col(d)).alias("k")).agg(F.sum("tokens").cast("double").alias("s"), F.sum(F.col("tokens") * F.col("weight")).alias("w"))
        ends = sums.agg(F.sum("s"), F.sum("w")).first()
        own = F.coalesce(F.try_divide(F.col("s"), F.lit(float(ends[0] or 0))), F.lit(0.0))
        raw = sums.select("w", (_looked_up(targets[d])(F.col("k")) if targets and d in targets else F.pow(own, F.lit(power))).alias("raw"))
        whole = float(raw.agg(F.sum("raw")).first()[0] or 0)
        share = lambda c, of: F.coalesce(F.try_divide(F.col(c), F.lit(of)), F.lit(0.0))
        out = max(out, float(raw.agg(F.max(F.abs(share("w", float(ends[1] or 0)) - share("raw", whole)))).first()[0] or 0))
    return out


def fitted_weights(cells: DataFrame, targets: dict[str, dict[str | None, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Written weights of any number of cells; warns of targets that are not met."""
    cells = written(cells, "mix-cells")
    fit = raked_weights if cells.limit(ONE_ROW_CELLS + 1).count() <= ONE_ROW_CELLS else raked_tables
    out = written(fit(cells, targets, rounds=rounds), "mix-weights")
    gap = largest_gap(out, targets)
    if gap > TOLD:
        warnings.warn(f"the margins' targets are not all met: a share is {gap:.3g} off", stacklevel=2)
    return out


def with_probability(rows: DataFrame, cells: DataFrame, names: dict[str, str]) -> DataFrame:
    """rows with their cell's ``_probability``; names maps the margins to rows'
    columns; at most MAX_CELLS cells are broadcast, more are joined."""
    if cells.limit(MAX_CELLS + 1).count() > MAX_CELLS:
        cell = lambda own: F.struct(*[category(F.col(own[d])).alias(d) for d in names])
        placed = rows.withColumn("_cell", cell(names))
        counts = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows"))
        known = written(counts.join(cells.select(cell({d: d for d in names}).alias("_cell"), F.col("probability").alias("_probability")), "_cell"), "mix-known")
        return join_counted(placed, known, "_cell", "_rows", "doc_id").drop("_cell", "_rows")
    told = F.broadcast(cells.select(*[F.col(d).alias(f"_c_{d}") for d in names], F.col("probability").alias("_probability")))
    match = F.lit(True)
    for d, own in names.items():
        match = match & rows[own].eqNullSafe(told[f"_c_{d}"])
    return rows.join(told, match, "left").drop(*[f"_c_{d}" for d in names])


def cells_of(docs: DataFrame) -> DataFrame:
    return docs.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))


def mixed(docs: DataFrame, seed: int = 1, targets: dict[str, dict[str | None, float]] | None = None, topic: Column | None = None) -> DataFrame:
    """The sampled documents, with their own columns."""
    topic = topic_of(F.col("text")) if topic is None else topic
    weights = fitted_weights(cells_of(docs.select("source", "lang", topic.alias("topic"), tokens_of(F.col("text")).alias("tokens"))), targets)
    placed = docs.select(row_of(docs), "doc_id", "source", "lang", topic.alias("topic"))
    told = with_probability(placed, weights, {d: d for d in MARGINS})
    return unpacked(told.where(uniform(F.col("doc_id"), seed) < F.col("_probability")))


def op2_raked_mix(spark: SparkSession, sf_dir: str, seed: int = 1) -> DataFrame:
    """Every document's cell, tokens, calibrated probability and fate."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"), tokens_of(F.col("text")).alias("tokens"))
    narrow = written(docs, "mix-rows")
    weights = fitted_weights(cells_of(narrow))
    told = with_probability(narrow, weights, {d: d for d in MARGINS})
    return told.select("doc_id", "source", "lang", "topic", "tokens", F.round("_probability", 9).alias("probability"), (uniform(F.col("doc_id"), seed) < F.col("_probability")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, lang,
    CASE WHEN regexp_matches(coalesce(text, ''), '[Ll]icen[sc]e|[Cc]opyright') THEN 'legal'
         WHEN regexp_matches(coalesce(text, ''), '@[A-Za-z]') THEN 'contact'
         WHEN regexp_matches(coalesce(text, ''), '[0-9]{2}') THEN 'figures' ELSE 'general' END AS topic,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
  FROM documents),
cells AS (
  SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens,
    CAST(dense_rank() OVER (ORDER BY source) AS INT) AS i, CAST(dense_rank() OVER (ORDER BY lang) AS INT) AS j,
    CAST(dense_rank() OVER (ORDER BY topic) AS INT) AS k
  FROM docs GROUP BY source, lang, topic),
shares AS (SELECT *, tokens / (SELECT sum(tokens) FROM cells) AS share FROM cells),
a AS (SELECT list({'i': i, 'j': j, 'k': k, 's': share} ORDER BY source, lang, topic) AS c FROM shares),
ti AS (SELECT list(r / rs ORDER BY i) AS t FROM (SELECT i, r, sum(r) OVER () AS rs FROM (SELECT i, pow(sum(share), 0.5) AS r FROM shares GROUP BY i))),
tj AS (SELECT list(r / rs ORDER BY j) AS t FROM (SELECT j, r, sum(r) OVER () AS rs FROM (SELECT j, pow(sum(share), 0.7) AS r FROM shares GROUP BY j))),
tk AS (SELECT list(r / rs ORDER BY k) AS t FROM (SELECT k, r, sum(r) OVER () AS rs FROM (SELECT k, pow(sum(share), 0.8) AS r FROM shares GROUP BY k))),
rake AS (
  SELECT 0 AS step, c, ti.t AS ti, tj.t AS tj, tk.t AS tk,
    list_transform(ti.t, lambda x: 1.0::DOUBLE) AS mi, list_transform(tj.t, lambda x: 1.0::DOUBLE) AS mj, list_transform(tk.t, lambda x: 1.0::DOUBLE) AS mk
  FROM a, ti, tj, tk
  UNION ALL
  SELECT step + 1, c, ti, tj, tk,
    CASE WHEN step % 3 = 0 THEN list_transform(ti, lambda t, n: t / list_sum(list_transform(c, lambda x: CASE WHEN x.i = n THEN x.s * mj[x.j] * mk[x.k] ELSE 0 END))) ELSE mi END,
    CASE WHEN step % 3 = 1 THEN list_transform(tj, lambda t, n: t / list_sum(list_transform(c, lambda x: CASE WHEN x.j = n THEN x.s * mi[x.i] * mk[x.k] ELSE 0 END))) ELSE mj END,
    CASE WHEN step % 3 = 2 THEN list_transform(tk, lambda t, n: t / list_sum(list_transform(c, lambda x: CASE WHEN x.k = n THEN x.s * mi[x.i] * mj[x.j] ELSE 0 END))) ELSE mk END
  FROM rake WHERE step < 60),
weighed AS (SELECT s.*, r.mi[s.i] * r.mj[s.j] * r.mk[s.k] AS w FROM shares s, (SELECT * FROM rake WHERE step = 60) r),
probable AS (SELECT *, w / max(w) OVER () AS p FROM weighed)
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(p, 9) AS probability,
  CAST(('0x' || md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':1')[1:8]) AS BIGINT) / 4294967296.0::DOUBLE < p AS kept
FROM docs d JOIN probable c ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND d.topic = c.topic
"""
