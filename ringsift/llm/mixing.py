"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

Time runs in slots of one block. Source s with weight a, of weights that add up to q, may place its
i-th block from slot floor(i*q/a) on (release) and must have placed it before slot ceil((i+1)*q/a)
(deadline). In every slot the released block with the earliest deadline goes. After t slots a source
has placed more than t*a/q - 1 and fewer than t*a/q + 1 blocks. The weights are whole numbers and are
met as they are, so the schedule repeats after q slots: one cycle is worked out, and every row finds
its slot by arithmetic and by its block's place in the cycle.

Sources of one weight take turns, as their releases and deadlines are the same. The state of the
schedule is one number per different weight, of which there are fewer than sqrt(2q); neither the
number of sources nor that of rows makes it larger.
"""

from __future__ import annotations

import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import named, numbered, stored

#: Without given weights a source's weight is its share of so many slots, rounded, one at least.
CYCLE = 1000
#: Given weights, reduced to the smallest whole numbers, add up to this much at most; above it they are refused.
LONGEST = 1 << 20
#: Rows of a block.
BLOCK_ROWS = 8
#: Without given weights, a source's share goes by its number of rows to this power.
TEMPERATURE = 0.8
#: Slots that are worked out before their picks are put behind those of earlier slots.
STRETCH = 1024


def whole_weights(weights: dict[str | None, float | Fraction]) -> dict[str | None, int]:
    """The smallest whole numbers in the same ratios; a float counts as the decimal that it is written as."""
    exact = {k: w if isinstance(w, (int, Fraction)) else Fraction(str(w)) for k, w in weights.items()}
    scale = math.lcm(*[Fraction(w).denominator for w in exact.values()])
    whole = {k: int(w * scale) for k, w in exact.items()}
    least = math.gcd(*whole.values()) or 1
    whole = {k: w // least for k, w in whole.items()}
    if any(w < 0 for w in whole.values()) or sum(whole.values()) > LONGEST:
        raise ValueError(f"weights are not negative, and as whole numbers add up to {LONGEST} at most")
    return whole


def _shares(docs: DataFrame, weights: dict[str | None, float | Fraction] | None, temperature: float, cycle: int) -> DataFrame:
    """One row per source that takes part: rows (n), weight (a), all weights (q), turn among equal weights (x) of how many (m)."""
    counts = docs.groupBy(named(F.col("source")).alias("_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        raw = counts.withColumn("w", F.round(F.pow(F.col("n").cast("double"), F.lit(temperature)) * 1000).cast("bigint"))
        total = raw.withColumn("t", F.greatest(F.sum("w").over(Window.partitionBy()), F.lit(1)))
        known = total.withColumn("a", F.greatest(F.expr(f"({2 * cycle}L * w + t) div (2 * t)"), F.lit(1)).cast("bigint"))
    else:
        given = json.dumps({"-" if k is None else f"={k}": w for k, w in whole_weights(weights).items()})
        pairs = F.explode(F.from_json(F.lit(given), "map<string, bigint>")).alias("_source", "a")
        known = counts.join(docs.sparkSession.range(1).select(pairs), "_source").filter("a > 0")
    alike = Window.partitionBy("a")
    turns = known.withColumn("x", F.row_number().over(alike.orderBy("_source")) - 1).withColumn("m", F.count(F.lit(1)).over(alike))
    return turns.select("_source", "n", "a", F.sum("a").over(Window.partitionBy()).alias("q"), F.col("x").cast("bigint").alias("x"), "m")


def _cycle(shares: DataFrame) -> DataFrame:
    """The slots of one cycle: _source places its k-th block at slot ``at``; one row per slot."""
    weights = shares.groupBy("a", "m").agg(F.max("q").alias("q"))
    lists = weights.groupBy().agg(F.sort_array(F.collect_list(F.struct("a", "m"))).alias("s"), F.max("q").alias("q")).filter("q is not null")
    # The next block of weight i is the (done[i] div m)-th of the source whose turn is done[i] % m.
    best = """
      array_min(transform(
        filter(sequence(0, size(s) - 1), i -> (st.done[i] div s[i].m) * q < (t + 1) * s[i].a),
        i -> struct(((st.done[i] div s[i].m + 1) * q + s[i].a - 1) div s[i].a as deadline, i as i))).i"""
    step = f"""transform(array({best}), b -> named_struct(
        'done', transform(st.done, (d, j) -> d + if(j = b, 1L, 0L)),
        'picks', concat(st.picks, array(b))))[0]"""
    none = "cast(array() as array<int>)"
    stretch = f"""aggregate(sequence(c * {STRETCH}L, least(q, (c + 1) * {STRETCH}L) - 1),
        named_struct('done', so.done, 'picks', {none}), (st, t) -> {step})"""
    picks = f"""aggregate(sequence(0L, (q - 1) div {STRETCH}),
        named_struct('done', array_repeat(0L, size(s)), 'picks', {none}),
        (so, c) -> transform(array({stretch}), r -> named_struct('done', r.done, 'picks', concat(so.picks, r.picks)))[0]).picks"""
    slots = lists.select("s", F.posexplode(F.expr(picks)).alias("at", "i")).select(F.expr("s[i].a").alias("a"), F.expr("s[i].m").alias("m"), F.col("at").cast("bigint"))
    turn = slots.withColumn("j", F.row_number().over(Window.partitionBy("a").orderBy("at")) - 1)
    dealt = turn.select("a", F.expr("j % m").alias("x"), F.expr("j div m").alias("k"), "at")
    return shares.select("_source", "a", "x").join(dealt, ["a", "x"]).select("_source", "k", "at")


def mix(docs: DataFrame, weights: dict[str | None, float | Fraction] | None = None, temperature: float = TEMPERATURE, block_rows: int = BLOCK_ROWS, cycle: int = CYCLE) -> DataFrame:
    """Interleave the rows of all sources to their target weights until every row has been placed.

    A source that is used up starts again (epoch 1, 2, ...), so no row is dropped and the shares hold
    up to the end. Adds epoch, block (number within the source), slot, position (of the row in the
    mixture), release and deadline to the columns of the input; a clashing input column is replaced.
    Given weights are met exactly, in their ratios. Null is a source of its own; a source of weight 0,
    or one that given weights do not name, has no share and takes no part. Empty texts and tables, very
    long texts and null ids are rows like others. Rows that repeat are placed as often as they stand in the input.
    """
    if block_rows < 1 or cycle < 1 or temperature < 0:
        raise ValueError("block_rows and cycle are at least 1, the temperature is not negative")
    columns = [c for c in docs.columns if c.lower() not in ("epoch", "block", "slot", "position", "release", "deadline")]
    # The input's columns travel as one, so that none clashes with those of the plan.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.select(whole.alias("_row"), F.col("doc_id").alias("_doc"), named(F.col("source")).alias("_source"), F.xxhash64(whole).alias("_hash"))
    shares = stored(_shares(docs, weights, temperature, cycle), "pfair_shares")
    slots = stored(_cycle(shares), "pfair_cycle")
    last = shares.withColumn("k", F.expr(f"((n - 1) div {block_rows}) % a")).join(slots, ["_source", "k"])
    stop = last.agg(F.max(F.expr(f"((n - 1) div {block_rows}) div a * q + at + 1")).alias("_stop"))
    plan = shares.join(F.broadcast(stop)).select("_source", "_stop", *[F.col(c).alias(f"_plan_{c}") for c in ("n", "a", "q")])
    rows = numbered(held, "_source", "_doc", "_r", "_hash").join(plan, "_source")
    epochs = F.expr(f"sequence(0L, (((_stop + _plan_q - 1) div _plan_q) * _plan_a * {block_rows}L - 1 - _r) div _plan_n)")
    spread = rows.withColumn("_epoch", F.explode(epochs)).withColumn("_p", F.expr("_r + _epoch * _plan_n")).withColumn("_block", F.expr(f"_p div {block_rows}"))
    found = spread.withColumn("_k", F.expr("_block % _plan_a")).join(slots.select("_source", F.col("k").alias("_k"), F.col("at").alias("_at")), ["_source", "_k"])
    placed = found.withColumn("_slot", F.expr("_block div _plan_a * _plan_q + _at")).filter("_slot < _stop")
    return placed.select(
        *[F.col("_row").getField(c).alias(c) for c in columns],
        F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_slot").alias("slot"),
        F.expr(f"_slot * {block_rows} + _p % {block_rows}").alias("position"),
        F.expr("(_block * _plan_q) div _plan_a").alias("release"),
        F.expr("((_block + 1) * _plan_q + _plan_a - 1) div _plan_a").alias("deadline"),
    )


#: Twin of ``mix`` over documents, with the defaults above; the last SELECT is left to the caller.
MIX_SQL = f"""WITH RECURSIVE n AS (
    SELECT coalesce('=' || source, '-') AS g, count(*) AS n FROM {{docs}} GROUP BY 1),
w AS (SELECT g, n, CAST(round(pow(CAST(n AS DOUBLE), {TEMPERATURE}) * 1000) AS BIGINT) AS w FROM n),
t AS (SELECT *, CAST(sum(w) OVER () AS BIGINT) AS t FROM w),
a AS (SELECT g, n, greatest(({2 * CYCLE} * w + t) // (2 * t), 1) AS a FROM t),
s AS (SELECT g, n, CAST(a AS BIGINT) AS a, CAST(sum(a) OVER () AS BIGINT) AS q, row_number() OVER (ORDER BY a, g) AS i FROM a),
l AS (SELECT list(a ORDER BY i) AS a, max(q) AS q, count(*) AS k FROM s),
c AS (
    SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS b, list_transform(range(0, k), lambda x: CAST(0 AS BIGINT)) AS done FROM l
    UNION ALL
    SELECT t + 1, b, list_transform(done, lambda x, j: x + CASE WHEN j = b THEN 1 ELSE 0 END) FROM (
        SELECT c.t, c.done, list_min(list_transform(
            list_filter(range(1, l.k + 1), lambda i: c.done[i] * l.q < (c.t + 2) * l.a[i]),
            lambda i: {{{{'d': ((c.done[i] + 1) * l.q + l.a[i] - 1) // l.a[i], 'i': i}}}})).i AS b
        FROM c, l WHERE c.t + 1 < l.q) p),
p AS (SELECT s.g, s.n, s.a, s.q, list(c.t ORDER BY c.t) AS slots FROM s JOIN c ON c.b = s.i GROUP BY ALL),
e AS (SELECT *, max((((n - 1) // {BLOCK_ROWS}) // a) * q + slots[((n - 1) // {BLOCK_ROWS}) % a + 1] + 1) OVER () AS stop FROM p),
d AS (SELECT *, coalesce('=' || source, '-') AS g, row_number() OVER (PARTITION BY coalesce('=' || source, '-')
    ORDER BY substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 4), doc_id NULLS FIRST) - 1 AS r FROM {{docs}}),
x AS (SELECT d.*, e.n, e.a, e.q, e.slots, e.stop, unnest(range(0, (((stop + q - 1) // q) * a * {BLOCK_ROWS} - 1 - r) // n + 1)) AS epoch FROM d JOIN e USING (g)),
y AS (SELECT *, (r + epoch * n) // {BLOCK_ROWS} AS block, (r + epoch * n) % {BLOCK_ROWS} AS within FROM x),
z AS (SELECT *, (block // a) * q + slots[block % a + 1] AS slot FROM y)
"""
