"""Deduplication, ranking, splits, samples and look-back windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import merge as M
from ..operators import sample
from .bindings import Tables
from .registry import query
from .scalars import valid_sql


@query("wn01_source_priority", """SELECT package, label, rank, ord, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY rank, ord) AS rn, min(ord) OVER (PARTITION BY package) AS first_seen
    FROM app_corpus WHERE trim(package) <> '') x WHERE rn = 1""")
def _(t: Tables):
    return M.source_priority(t.app_corpus.filter(F.trim("package") != ""), "package", "rank", "ord").select("package", "label", "rank", "ord", "first_seen")


@query("wn02_first_wins", "SELECT package, ord FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY ord) AS rn FROM app_corpus) x WHERE rn = 1")
def _(t: Tables):
    return M.first_wins(t.app_corpus, ["package"], "ord").select("package", "ord")


_CV = "coalesce(TRY_CAST(c AS DOUBLE), 0.70)"


@query("wn03_confidence_upgrade", f"""SELECT normalized_number, category, ord, cv AS confidence_value FROM (SELECT *, row_number() OVER (PARTITION BY normalized_number ORDER BY cv DESC, ord) AS rn FROM (
    SELECT ord, normalized_number, categories AS category, CASE WHEN ord % 4 = 0 THEN 0.70 ELSE source_confidence END AS cv FROM reputation_raw WHERE {valid_sql('normalized_number')}) x) y WHERE rn = 1""", "confidence_value")
def _(t: Tables):
    rows = t.reputation_raw.select(
        "ord", "normalized_number", F.col("categories").alias("category"),
        F.when(F.col("ord") % 4 == 0, "n/a").otherwise(F.col("source_confidence").cast("string")).alias("source_confidence"))
    return M.confidence_upgrade(rows, "ord").select("normalized_number", "category", "ord", "confidence_value")


_KEYS = ", ".join(M.SNAPSHOT_KEY)
_SAME = " AND ".join(f"m.{c} IS NOT DISTINCT FROM s.{c}" for c in M.SNAPSHOT_KEY)


@query("wn04_append_snapshots", f"""SELECT {_KEYS}, ord FROM reputation_raw UNION ALL SELECT {_KEYS}, ord FROM (SELECT {_KEYS}, ord, row_number() OVER (PARTITION BY {_KEYS} ORDER BY ord) AS rn
    FROM (SELECT * REPLACE (negative_count % 2 AS negative_count, CAST('' AS VARCHAR) AS detail_date, substr(last_review_at, 1, 7) AS last_review_at) FROM reputation_raw) q WHERE {valid_sql('normalized_number')}) s
    WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM reputation_raw m WHERE {_SAME})""")
def _(t: Tables):
    r = t.reputation_raw
    shards = r.withColumns({"negative_count": F.col("negative_count") % 2, "detail_date": F.lit(""), "last_review_at": F.substring("last_review_at", 1, 7)})
    return M.append_snapshots(r, shards, "ord").select(*M.SNAPSHOT_KEY, "ord")


@query("wn05_new_evidence", """SELECT normalized_number, source, url, ord FROM (SELECT *, row_number() OVER (PARTITION BY normalized_number, source, url ORDER BY ord) AS rn FROM reputation_raw) x
    WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM blocklist b WHERE b.normalized_number = x.normalized_number)""")
def _(t: Tables):
    r = t.reputation_raw
    stored = r.join(t.blocklist, "normalized_number", "left_semi")
    return M.new_evidence(stored, r, "ord").select("normalized_number", "source", "url", "ord")


def _rank(seed: int, label: str = "label", where: str = "") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}:' || key)) AS rn, count(*) OVER (PARTITION BY {label}) AS n FROM classed {where}"


@query("wn06_stratified_split", f"SELECT key, label, CASE WHEN rn <= round_even(n * 0.8, 0) THEN 'train' WHEN rn <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS split FROM ({_rank(42)}) x")
def _(t: Tables):
    return sample.stratified_split(t.classed, "label", "key").select("key", "label", "split")


@query("wn07_two_stage_split", f"""WITH first AS (SELECT *, rn <= n - CAST(ceil(n * 0.2) AS BIGINT) AS train FROM ({_rank(42)}) x),
    second AS (SELECT key, row_number() OVER (PARTITION BY label ORDER BY md5('43:' || key)) AS r2, count(*) OVER (PARTITION BY label) AS n2 FROM first WHERE NOT train)
    SELECT f.key, f.label, CASE WHEN f.train THEN 'train' WHEN s.r2 <= round_even(n2 * 0.5, 0) THEN 'val' ELSE 'test' END AS split FROM first f LEFT JOIN second s USING (key)""")
def _(t: Tables):
    return sample.two_stage_split(t.classed, "label", "key").select("key", "label", "split")


@query("wn08_proportional_holdout", f"SELECT key, rn <= round_even(n * 1000.0 / (SELECT count(*) FROM classed), 0) AS held_out FROM ({_rank(42)}) x")
def _(t: Tables):
    return sample.proportional_holdout(t.classed, "label", "key", 1000).select("key", "held_out")


_W, _B = "(SELECT count(*) FROM classed WHERE label = 'WARN')", "(SELECT count(*) FROM classed WHERE label = 'BLOCK')"
_NW = f"least(round_even(1500.0 * {_W} / ({_W} + {_B}), 0), {_W})"


@query("wn09_teacher_student", f"""WITH teacher AS (SELECT key, label FROM ({_rank(42)}) x WHERE rn <= CASE label WHEN 'ALLOW' THEN 1000 WHEN 'WARN' THEN {_NW} ELSE 1500 - {_NW} END),
    tw AS (SELECT count(*) FILTER (label = 'WARN') AS w, count(*) FILTER (label = 'BLOCK') AS b FROM teacher),
    ranked AS (SELECT key, label, row_number() OVER (PARTITION BY label ORDER BY md5('43:' || key)) AS rn FROM teacher)
    SELECT r.key, r.label, rn <= CASE label WHEN 'ALLOW' THEN 200 WHEN 'WARN' THEN least(round_even(300.0 * w / (w + b), 0), w) ELSE 300 - least(round_even(300.0 * w / (w + b), 0), w) END AS in_student FROM ranked r, tw""")
def _(t: Tables):
    teacher = sample.teacher_sample(t.classed, "label", "key", 1000, 1500)
    return sample.student_subset(teacher, "label", "key", 200, 300).select("key", "label", "in_student")


@query("wn09_sample_shortfall", "SELECT 'legit' AS pool, 1000000000::BIGINT AS wanted, count(*) AS available FROM classed WHERE label = 'ALLOW'")
def _(t: Tables):
    return sample.sample_shortfall(t.classed, "label", 1_000_000_000, 10)


def _entries(t: Tables):
    o = F.col("key")
    zero = F.lit(0).cast("bigint")
    return t.classed.select(
        "key", "label", (o % 3 == 0).alias("cold"), (o % 7 == 0).alias("in_allow"), (o % 11 == 0).alias("in_black"), F.lit(False).alias("is_contact"),
        *[zero.alias(c) for c in sample.BLANKED], F.lit(0.5).alias("source_confidence"), F.lit(0.5).alias("source_reliability"), F.lit("").alias("categories"))


def _u(i: int) -> str:
    return f"(('0x' || substr(md5('{142 + i}:' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_POS = f"greatest(1, round_even((floor({_u(1)} * 10) + 1) * (0.70::DOUBLE + 0.30::DOUBLE * {_u(2)}), 0))"


@query("wn10_enrich_cold_allow", f"""SELECT key, hit AS synthetic, CASE WHEN hit THEN floor({_u(1)} * 10) + 1 ELSE 0 END AS review_count, CASE WHEN hit THEN {_POS} ELSE 0 END AS positive_count,
    CASE WHEN hit THEN floor({_u(4)} * 50) + 1 ELSE 0 END AS search_volume, CASE WHEN hit THEN round_even(0.70::DOUBLE + 0.25::DOUBLE * {_u(5)}, 4) ELSE 0.5 END AS source_confidence,
    CASE WHEN hit AND {_u(6)} < 0.20 THEN 'верифицированный_бизнес' ELSE '' END AS categories FROM (
    SELECT c.key, coalesce(x.rn <= round_even(x.n * 0.3, 0), false) AS hit FROM classed c LEFT JOIN (SELECT key, row_number() OVER (ORDER BY md5('42:' || key)) AS rn, count(*) OVER () AS n FROM classed WHERE label = 'ALLOW' AND key % 3 = 0) x USING (key)) y""",
       "source_confidence", "review_count positive_count search_volume")
def _(t: Tables):
    return sample.enrich_cold_allow(_entries(t), "key", 0.3).select("key", "synthetic", "review_count", "positive_count", "search_volume", "source_confidence", "categories")


@query("wn11_thin_cold_allow", """SELECT c.key, c.label FROM classed c LEFT JOIN (SELECT key, row_number() OVER (ORDER BY md5('43:' || key)) AS rn, count(*) OVER () AS n FROM classed WHERE label = 'ALLOW' AND key % 3 = 0 AND key % 7 <> 0) x USING (key)
    WHERE x.key IS NULL OR x.rn > round_even(x.n * 0.25, 0)""")
def _(t: Tables):
    return sample.thin_cold_allow(_entries(t), "key", 0.25).select("key", "label")


@query("wn12_cold_shadows", """SELECT key, label, false AS shadow, key % 3 = 0 AS cold, 0.5 AS source_confidence FROM classed UNION ALL SELECT key, label, true, true, 0.0 FROM (
    SELECT *, row_number() OVER (ORDER BY md5('44:' || key)) AS rn, count(*) OVER () AS n FROM classed WHERE label <> 'ALLOW') x WHERE rn <= round_even(n * 0.1, 0)""", "source_confidence")
def _(t: Tables):
    return sample.add_cold_shadows(_entries(t), "key", 0.1).select("key", "label", "shadow", "cold", "source_confidence")


@query("wn13_masked_copies", f"""SELECT key, "reputationScore", "noMetadata", 1.0 AS extra_weight, false AS masked FROM classed UNION ALL
    SELECT key, 0.0, 1.0, 1.5, true FROM ({_rank(42)}) x WHERE rn <= round_even(n * 0.5, 0)""", "reputationScore noMetadata extra_weight")
def _(t: Tables):
    return sample.add_masked_copies(t.classed, "label", "key", ["reputationScore"], 0.5, weight=1.5).select("key", "reputationScore", "noMetadata", "extra_weight", "masked")


@query("wn13_balanced_copies", """WITH s AS (SELECT label, count(*) AS n FROM classed WHERE label IN ('WARN', 'BLOCK') GROUP BY label), g AS (SELECT label, n, greatest(n, least((SELECT max(n) FROM s), floor(n * 4.0))) AS goal FROM s),
    r AS (SELECT c.key, c.label, g.n, g.goal, row_number() OVER (PARTITION BY c.label ORDER BY md5('42:' || c.key)) AS rn FROM classed c JOIN g ON g.label = c.label)
    SELECT label, masked, count(*) AS rows, count(DISTINCT key) AS keys, sum(key)::BIGINT AS checksum FROM (SELECT key, label, false AS masked FROM classed UNION ALL
    SELECT key, label, true FROM r, range(1, 10) k(i) WHERE i <= floor(goal / n) + CASE WHEN rn <= goal % n THEN 1 ELSE 0 END) x GROUP BY ALL""")
def _(t: Tables):
    out = sample.add_balanced_masked_copies(t.classed, "label", "key", ["reputationScore"], ["WARN", "BLOCK"], cap=4.0)
    return out.groupBy("label", "masked").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("key").alias("keys"), F.sum("key").alias("checksum"))


@query("wn14_oversample_rare", """SELECT label, copy, count(*) AS rows FROM (SELECT key, label, 0::BIGINT AS copy FROM classed UNION ALL
    SELECT c.key, c.label, i FROM classed c JOIN (SELECT label, count(*) AS n FROM classed GROUP BY label) s ON s.label = c.label, range(1, 2000) k(i) WHERE s.n < 100000 AND i <= greatest(1, 100000 // s.n)) x GROUP BY ALL""")
def _(t: Tables):
    out = sample.oversample_rare(t.classed, "label", "key", ["reputationScore", "prefixRisk"], 100_000)
    return out.groupBy("label", "copy").agg(F.count(F.lit(1)).alias("rows"))


@query("wn15_cap_total", """SELECT key FROM classed WHERE key % 7 = 0 UNION ALL SELECT key FROM (SELECT key, row_number() OVER (ORDER BY md5('42:' || key)) AS rn FROM classed WHERE key % 7 <> 0) x
    WHERE rn <= greatest(5000 - (SELECT count(*) FROM classed WHERE key % 7 = 0), 0)""")
def _(t: Tables):
    return sample.cap_total(t.classed, "key", F.col("key") % 7 == 0, 5000).select("key")


@query("wn25_cap_per_source", "SELECT key, source FROM (SELECT key, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || key)) AS rn FROM classed) x WHERE rn <= 500")
def _(t: Tables):
    return sample.cap_per_source(t.classed, "source", "key", 500).select("key", "source")


def _past(key: str, days: int, test: str = "true") -> str:
    return f"(SELECT count(*) FROM calls h WHERE h.{key} = c.{key} AND h.ts < c.ts AND h.ts >= c.ts - {days * 86400000} AND {test})"


@query("wn16_call_frequency", f"SELECT c.id, {_past('number', 7)} AS number_calls, least({_past('number', 7)} / 10.0, 1.0) AS call_frequency FROM calls c", "number_calls call_frequency")
def _(t: Tables):
    return E.call_frequency(t.calls).select("id", "number_calls", "call_frequency")


@query("wn17_prefix_calls", """SELECT c.id, count(h.id) AS prefix_calls, least(count(h.id) / 10.0, 1.0) AS prefix_calls_norm FROM calls c LEFT JOIN calls h ON substr(h.number, 1, 5) = substr(c.number, 1, 5) AND h.ts < c.ts AND h.ts >= c.ts - 604800000 GROUP BY c.id""", "prefix_calls prefix_calls_norm")
def _(t: Tables):
    return E.prefix_calls(t.calls).select("id", "prefix_calls", "prefix_calls_norm")


@query("wn18_previously_blocked", "SELECT d.id, EXISTS (SELECT 1 FROM decisions h WHERE h.number = d.number AND h.verdict = 'BLOCK' AND h.ts < d.ts AND h.ts >= d.ts - 172800000) AS previously_rejected FROM decisions d")
def _(t: Tables):
    return E.previously(t.decisions, F.col("verdict") == "BLOCK", 2).select("id", "previously_rejected")


@query("wn19_missed_no_callback", """SELECT id, coalesce(last_missed >= ts - 86400000 AND (last_outgoing IS NULL OR last_outgoing <= last_missed), false) AS missed_no_callback FROM (SELECT c.id, c.ts,
    (SELECT max(h.ts) FROM calls h WHERE h.number = c.number AND h.ts < c.ts AND h.state = 'MISSED') AS last_missed, (SELECT max(h.ts) FROM calls h WHERE h.number = c.number AND h.ts < c.ts AND h.direction = 'OUTGOING') AS last_outgoing FROM calls c) x""")
def _(t: Tables):
    return E.missed_without_callback(t.calls).select("id", "missed_no_callback")


@query("wn20_recent_packages", """SELECT user, package, ts, position FROM (SELECT user, package, max(ts) AS ts, row_number() OVER (PARTITION BY user ORDER BY max(ts) DESC, package) AS position FROM usage
    WHERE ts >= (SELECT max(ts) FROM usage) - 86400000 GROUP BY user, package) x WHERE position <= 3""")
def _(t: Tables):
    u = t.usage
    return M.recent_distinct(u, "user", "package", "ts", u.agg(F.max("ts")).scalar(), 86_400_000, 3)


@query("wn21_top_contributions", """SELECT l_quantity, l_discount, l_tax, count(*) AS n, list_reduce([x.name FOR x IN list_slice(list_sort([struct_pack(o := -abs(l_quantity * 0.01), i := 0, name := 'q'), struct_pack(o := -abs(l_discount * -3.0), i := 1, name := 'd'),
    struct_pack(o := -abs(l_tax * 1.5), i := 2, name := 't')]), 1, 2)], lambda a, b: a || ',' || b) AS names FROM scores GROUP BY l_quantity, l_discount, l_tax""", "l_quantity l_discount l_tax")
def _(t: Tables):
    per = t.scores.groupBy("l_quantity", "l_discount", "l_tax").agg(F.count(F.lit(1)).alias("n"))
    top = E.top_contributions(["q", "d", "t"], [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")], [F.lit(0.01), F.lit(-3.0), F.lit(1.5)], 2)
    return per.withColumn("names", F.array_join(F.transform(top, lambda x: x["name"]), ","))


@query("wn22_warm_up", """SELECT l.id, (SELECT count(*) FROM feedback h WHERE h.user = l.user AND h.ts <= l.ts) AS labels_so_far, (l.ts - i.installed_at >= 1209600000) OR (SELECT count(*) FROM feedback h WHERE h.user = l.user AND h.ts <= l.ts) >= 30 AS warm
    FROM feedback l JOIN installs i USING (user)""")
def _(t: Tables):
    return E.warm_up(t.feedback.select("id", "user", "ts"), t.installs).select("id", "labels_so_far", "warm")


@query("wn23_latest_snapshot", "SELECT number, arg_max(id, struct_pack(a := ts, b := id)) AS id, max(ts) AS ts FROM snapshots GROUP BY number")
def _(t: Tables):
    return M.best_row(t.snapshots, ["number"], [F.col("ts"), F.col("id")], "max").select("number", "id", "ts")


_RANGES = """(SELECT *, sum(size) OVER (ORDER BY def_code, start_number) - size AS before FROM (SELECT def_code, start_number, operator, region, least(end_number, coalesce(lead(start_number) OVER (PARTITION BY def_code ORDER BY start_number) - 1, 9999999)) - start_number + 1 AS size
    FROM (SELECT def_code, start_number, m.e AS end_number, m.o AS operator, m.r AS region FROM (SELECT def_code, start_number, max(struct_pack(e := end_number, o := operator, r := region)) AS m FROM numbering_plan GROUP BY 1, 2) u0) u WHERE def_code BETWEEN 900 AND 999) v WHERE size > 0)"""


@query("wn24_plan_numbers", f"""WITH r AS (SELECT * FROM {_RANGES} z), total AS (SELECT sum(size) AS s FROM r),
    asked AS (SELECT i AS id, CAST(floor((('0x' || substr(md5('7:' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * s) AS BIGINT) AS position FROM range(6000) k(i), total),
    drawn AS (SELECT '+7' || r.def_code || lpad(CAST(r.start_number + position - before AS VARCHAR), 7, '0') AS normalized_number, min(id) AS id FROM asked JOIN r ON position >= before AND position < before + size GROUP BY 1)
    SELECT normalized_number FROM drawn d WHERE NOT EXISTS (SELECT 1 FROM numbers n WHERE n.normalized_number = d.normalized_number) AND NOT EXISTS (SELECT 1 FROM blocklist b WHERE b.normalized_number = d.normalized_number) ORDER BY id LIMIT 2000""")
def _(t: Tables):
    return sample.sample_plan_numbers(t.numbering_plan, 2000, 7, t.numbers, t.blocklist).select("normalized_number")


