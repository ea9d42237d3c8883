"""Aggregations, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import aggregate as A
from ..operators import merge as M
from ..operators import quality as Q
from ..operators import stats
from .bindings import Tables
from .joins import _MODE, _OPC, _risk
from .registry import query
from .scalars import any_of, bucket_sql, class_sql, def_text_sql, norm_sql, valid_sql

_NUM = """sum(negative_count)::BIGINT AS negative_count, sum(positive_count)::BIGINT AS positive_count, sum(neutral_count)::BIGINT AS neutral_count,
    greatest(sum(review_count), sum(negative_count) + sum(positive_count) + sum(neutral_count))::BIGINT AS review_count, max(search_volume) AS search_volume, max(view_count) AS view_count,
    max(related_count) AS related_count, max(source_confidence) AS source_confidence, max(source_reliability) AS source_reliability"""
_BEST = "row_number() OVER (PARTITION BY normalized_number ORDER BY source_confidence DESC, (categories <> '') DESC, ord)"


@query("ag01_reputation", f"""SELECT a.*, s.source, s.categories, s.last_review_at, s.first_seen_at, s.detail_date, s.page_title, s.url FROM (SELECT normalized_number, {_NUM} FROM reputation_raw GROUP BY 1) a
    JOIN (SELECT *, {_BEST} AS rn FROM reputation_raw) s ON s.rn = 1 AND s.normalized_number = a.normalized_number""", "source_confidence source_reliability")
def _(t: Tables):
    return A.reputation_by_number(t.reputation_raw, "ord")


@query("ag02_prefix_risk", f"SELECT prefix, risk, seen AS seen_count FROM ({_risk(6, 10, 3)}) x", "risk")
def _(t: Tables):
    return stats.prefix_risk(t.labeled)


def _hist(n: int) -> str:
    def share(label: str) -> str:
        return f"round_even((sum(CASE WHEN label = '{label}' THEN 1 ELSE 0 END) + 10.0::DOUBLE * (SELECT avg(CASE WHEN label = '{label}' THEN 1.0 ELSE 0.0 END) FROM labeled)) / (count(*) + 10.0::DOUBLE), 4)"

    ent = " + ".join(
        f"CASE WHEN count(*) FILTER (label = '{x}') > 0 THEN -(count(*) FILTER (label = '{x}'))::DOUBLE / count(*) * log2((count(*) FILTER (label = '{x}'))::DOUBLE / count(*)) ELSE 0.0::DOUBLE END" for x in S.LABELS)
    return f"""SELECT {n}::BIGINT AS prefix_length, substr(number, 1, {n}) AS prefix, {share('BLOCK')} AS block_share, {share('WARN')} AS warn_share, count(*) AS seen_count,
        round_even(greatest(0.0, least(1.0, ({ent}) / log2(3.0::DOUBLE))), 4) AS entropy FROM labeled WHERE starts_with(number, '+7') GROUP BY 2 HAVING count(*) >= 3"""


_HIST = " UNION ALL ".join(_hist(n) for n in (5, 6, 9))


@query("ag03_prefix_histogram", _HIST, "block_share warn_share entropy")
def _(t: Tables):
    return stats.prefix_histogram(t.labeled)


@query("ag03_histogram_header", f"""SELECT prefix_length, round_even(ln(1.0 + max(seen_count)), 4) AS seen_log_norm, count(*) AS prefixes, (SELECT count(*) FROM labeled) AS source_rows,
    (SELECT round_even(avg(CASE WHEN label = 'BLOCK' THEN 1.0 ELSE 0.0 END), 4) FROM labeled) AS overall_block_rate, (SELECT round_even(avg(CASE WHEN label = 'WARN' THEN 1.0 ELSE 0.0 END), 4) FROM labeled) AS overall_warn_rate,
    30.0 AS sample_size_saturation FROM ({_HIST}) h GROUP BY prefix_length""", "seen_log_norm overall_block_rate overall_warn_rate sample_size_saturation")
def _(t: Tables):
    return stats.histogram_header(t.labeled, stats.prefix_histogram(t.labeled))


def _ent(p: str) -> str:
    return f"CASE WHEN {p} > 0 THEN -({p}) * log2({p}) ELSE 0.0 END"


@query("ag04_share_entropy", f"SELECT p_block, p_warn, count(*) AS n, greatest(0.0, least(1.0, ({_ent('p_block')} + {_ent('p_warn')} + {_ent('greatest(0.0, 1.0 - p_block - p_warn)')}) / log2(3.0::DOUBLE))) AS entropy FROM scores GROUP BY 1, 2", "p_block p_warn entropy")
def _(t: Tables):
    per = t.scores.groupBy("p_block", "p_warn").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("entropy", stats.entropy_of_shares(F.col("p_block"), F.col("p_warn")))


@query("ag05_code_risk", f"SELECT prefix AS def_code, risk, seen AS seen_count FROM ({_risk(0, 20, 5, def_text_sql('number'))}) x", "risk")
def _(t: Tables):
    return stats.code_risk(t.labeled)


@query("ag06_operator_code_risk", f"SELECT * FROM {_OPC} x", "risk")
def _(t: Tables):
    return stats.operator_code_risk(t.labeled)


_BO = bucket_sql("operator")


@query("ag06_operator_code_risk_joined", f"""SELECT b.bucket, {def_text_sql('l.number')} AS def_code, round_even((sum(CASE WHEN label = 'BLOCK' THEN 1 ELSE 0 END) + 20.0::DOUBLE * (SELECT avg(CASE WHEN label = 'BLOCK' THEN 1.0 ELSE 0.0 END) FROM labeled)) / (count(*) + 20.0::DOUBLE), 4) AS risk,
    count(*) AS seen_count FROM labeled l JOIN (SELECT number, arg_max({_BO}, ord) AS bucket FROM labeled WHERE {_BO} <> 'unknown' GROUP BY number) b ON b.number = l.number GROUP BY 1, 2 HAVING count(*) >= 5""", "risk")
def _(t: Tables):
    return stats.operator_code_risk_joined(t.labeled, t.labeled, "ord")


@query("ag07_bucket_by_code", f"SELECT def_code, bucket FROM {_MODE} m")
def _(t: Tables):
    return stats.operator_bucket_by_code(t.labeled, min_share=0.15).select("def_code", "bucket")


_LW = "lower(categories)"
_COLD = f"NOT (review_count > 0 OR search_volume > 0 OR view_count > 0 OR {any_of(_LW, S.COLD_CATEGORY_WORDS)})"
_LAB = "CASE ord % 3 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'WARN' ELSE 'BLOCK' END"


@query("ag08_label_counts", f"""SELECT {_LAB} AS label, count(*) AS rows, sum(CASE WHEN {_COLD} THEN 1 ELSE 0 END)::BIGINT AS cold_rows,
    (SELECT sum(CASE WHEN {_COLD} AND ord % 3 = 0 THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN {_COLD} THEN 1 ELSE 0 END), 1) FROM reputation_raw) AS allow_given_cold FROM reputation_raw GROUP BY 1""", "allow_given_cold")
def _(t: Tables):
    k = F.col("ord") % 3
    rows = t.reputation_raw.withColumn("label", F.when(k == 0, "ALLOW").when(k == 1, "WARN").otherwise("BLOCK"))
    c = {n: F.col(n) for n in ("review_count", "search_volume", "view_count", "categories")}
    return A.label_counts(rows, A.no_metadata({**c, "in_allow": F.lit(False), "in_black": F.lit(False)}))


@query("ag09_class_counts", "SELECT y, count(*) AS rows FROM scores GROUP BY y")
def _(t: Tables):
    return A.class_counts(t.scores, "y")


@query("ag24_class_weights", "SELECT y, count(*) AS rows, (SELECT count(*) FROM scores) / (3.0 * count(*)) AS weight, CASE y WHEN 1 THEN 3.0 ELSE 1.0 END AS fixed FROM scores GROUP BY y", "weight fixed")
def _(t: Tables):
    w = A.class_balanced_weights(t.scores, "y", 3)
    return w.withColumn("fixed", A.fixed_class_weight(F.col("y"), (1.0, 3.0, 1.0)))


_IN = ", ".join(f"'{c}'" for c in S.APP_CATEGORIES)


@query("ag25_corpus_counters", f"""SELECT count(*) AS input_rows, sum(CASE WHEN trim(package) = '' THEN 1 ELSE 0 END)::BIGINT AS dropped_blank,
    sum(CASE WHEN trim(package) <> '' AND upper(trim(category)) NOT IN ({_IN}) THEN 1 ELSE 0 END)::BIGINT AS unknown_category, count(DISTINCT CASE WHEN trim(package) <> '' THEN package END) AS packages FROM app_corpus""")
def _(t: Tables):
    return A.corpus_counters(t.app_corpus)


_DIM = " UNION ALL ".join(f"SELECT {i}::BIGINT AS position, '{c}' AS category" for i, c in enumerate(S.APP_CATEGORIES))
_CATN = f"(SELECT CASE WHEN upper(trim(category)) IN ({_IN}) THEN upper(trim(category)) ELSE 'OTHER' END AS category, count(DISTINCT package) AS packages FROM app_corpus WHERE trim(package) <> '' GROUP BY 1)"


@query("ag25_category_counts", f"SELECT d.position, d.category, coalesce(c.packages, 0) AS packages FROM ({_DIM}) d LEFT JOIN {_CATN} c ON c.category = d.category")
def _(t: Tables):
    return A.category_counts(t.app_corpus.filter(F.trim("package") != ""))


@query("ag26_corpus_floors", f"""SELECT d.category, coalesce(c.packages, 0) AS found, 300::BIGINT AS floor FROM ({_DIM}) d LEFT JOIN {_CATN} c ON c.category = d.category WHERE d.category <> 'OTHER' AND coalesce(c.packages, 0) < 300
    UNION ALL SELECT '*', sum(packages)::BIGINT, 200000 FROM {_CATN} x HAVING sum(packages) < 200000""")
def _(t: Tables):
    return A.corpus_floors(A.category_counts(t.app_corpus.filter(F.trim("package") != "")), 200_000, 300)


_RN = norm_sql("raw")


@query("ag27_phone_column", f"""SELECT sum(c)::BIGINT AS rows, sum(CASE WHEN NOT {valid_sql('n')} THEN c ELSE 0 END)::BIGINT AS invalid_rows, sum(CASE WHEN n <> '' AND c > 1 THEN 1 ELSE 0 END)::BIGINT AS duplicated_numbers
    FROM (SELECT coalesce({_RN}, '') AS n, count(*) AS c FROM raw_numbers GROUP BY 1) x""")
def _(t: Tables):
    from ..functions import phone as P

    return Q.phone_column_profile(t.raw_numbers.select(P.normalize("raw").alias("n")), "n")


@query("ag27_phone_samples", f"""SELECT 'invalid' AS kind, number, rows FROM (SELECT coalesce(normalized_number, '') AS number, count(*) AS rows FROM numbers WHERE NOT {valid_sql('normalized_number')} GROUP BY 1 ORDER BY 1 LIMIT 30) a
    UNION ALL SELECT 'duplicate', number, rows FROM (SELECT normalized_number AS number, count(*) AS rows FROM reputation_raw GROUP BY 1 HAVING count(*) > 1 ORDER BY rows DESC, number LIMIT 20) b""")
def _(t: Tables):
    bad = Q.invalid_numbers(t.numbers, "normalized_number").select(F.lit("invalid").alias("kind"), "number", "rows")
    return bad.unionByName(Q.duplicated_numbers(t.reputation_raw, "normalized_number").select(F.lit("duplicate").alias("kind"), "number", "rows"))


@query("ag28_feature_profile", """SELECT * FROM (SELECT 'p_block' AS column_name, 'range' AS issue, sum(CASE WHEN p_block < 0 OR p_block > 1 THEN 1 ELSE 0 END)::BIGINT AS rows_hit FROM scores
    UNION ALL SELECT 'l_quantity', 'range', sum(CASE WHEN l_quantity < 0 OR l_quantity > 1 THEN 1 ELSE 0 END)::BIGINT FROM scores UNION ALL SELECT 'l_discount', 'range', sum(CASE WHEN l_discount < 0 OR l_discount > 1 THEN 1 ELSE 0 END)::BIGINT FROM scores
    UNION ALL SELECT '*', 'bad_label', sum(CASE WHEN y = 2 THEN 1 ELSE 0 END)::BIGINT FROM scores) x WHERE rows_hit > 0""")
def _(t: Tables):
    return Q.feature_table_profile(t.scores, ["p_block", "l_quantity", "l_discount"], "y", [0, 1])


@query("ag28_class_share", "SELECT y AS class, count(*) AS rows_found, count(*) / (SELECT count(*) FROM scores) AS share FROM scores GROUP BY y HAVING count(*) / (SELECT count(*) FROM scores) < 0.3334", "share")
def _(t: Tables):
    return Q.class_share_issues(t.scores, "y", [0, 1, 2], 0.3334)


_FEED = "(SELECT ord, CASE WHEN ord % 50 = 0 THEN '' ELSE normalized_number END AS n, CASE WHEN ord % 40 = 0 THEN 'many' ELSE CAST(negative_count AS VARCHAR) END AS cnt FROM reputation_raw)"


@query("ag29_feed_issues", f"""SELECT 'empty_number' AS issue, ord AS row_order, n AS value FROM {_FEED} a WHERE n = '' UNION ALL SELECT 'invalid_number', ord, n FROM {_FEED} b WHERE n <> '' AND NOT {class_sql('n')['national']}
    UNION ALL SELECT 'duplicate_number', ord, n FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY ord) AS rn FROM {_FEED} c WHERE n <> '') d WHERE rn > 1 UNION ALL SELECT 'bad_count', ord, n FROM {_FEED} e WHERE cnt = 'many'""")
def _(t: Tables):
    o = F.col("ord")
    feed = t.reputation_raw.select(
        "ord", F.when(o % 50 == 0, "").otherwise(F.col("normalized_number")).alias("n"),
        F.when(o % 40 == 0, "many").otherwise(F.col("negative_count").cast("string")).alias("cnt"))
    return Q.feed_issues(feed, "n", ["cnt"], "ord")


@query("ag29_label_issues", "SELECT source AS label, count(*) AS rows FROM reputation_raw GROUP BY source")
def _(t: Tables):
    return Q.label_issues(t.reputation_raw, "source")


@query("ag30_range_counts", "SELECT number_type, count(*) AS ranges, sum(capacity)::BIGINT AS capacity FROM numbering_plan GROUP BY 1")
def _(t: Tables):
    return A.range_counts(t.numbering_plan)


_AGR = "(verdict IN ('BLOCK', 'WARN') AND user_action IN ('IS_SCAM', 'MARK_SPAM', 'DISMISS')) OR (verdict = 'ALLOW' AND user_action IN ('NOT_SPAM', 'UNBLOCK', 'ANSWER'))"


@query("ag31_decision_stats", f"""SELECT count(*) AS total, count(*) FILTER (verdict = 'ALLOW') AS n_allow, count(*) FILTER (verdict = 'WARN') AS n_warn, count(*) FILTER (verdict = 'BLOCK') AS n_block,
    count(*) FILTER (source IN ('server_model', 'cloud_model', 'tflite_model')) AS by_model, count(*) FILTER (source = 'rule_engine') AS by_rules, count(user_action) AS with_feedback,
    count(*) FILTER ({_AGR}) AS agreeing, count(*) FILTER ({_AGR}) / count(user_action) AS agreement_rate FROM decisions""", "agreement_rate")
def _(t: Tables):
    return A.decision_stats(t.decisions)


@query("ag32_verdicts_since", "SELECT verdict, count(*) AS calls FROM decisions WHERE ts >= (SELECT max(ts) FROM decisions) - 864000000 GROUP BY verdict")
def _(t: Tables):
    return A.verdict_counts_since(t.decisions, t.decisions.agg(F.max("ts")).scalar() - 864_000_000)


@query("ag33_prefix_overrides", """SELECT user, prefix, n AS marks, last_seen FROM (SELECT user, substr(number, 1, 6) AS prefix, count(*) AS n, max(ts) AS last_seen FROM feedback
    WHERE action IN ('NOT_SPAM', 'UNBLOCK') AND ts >= (SELECT max(ts) FROM feedback) - 2592000000 GROUP BY 1, 2) x WHERE n >= 5
    AND NOT EXISTS (SELECT 1 FROM contacts c WHERE c.user = x.user AND substr(c.number, 1, 6) = x.prefix)""")
def _(t: Tables):
    f = t.feedback
    marks = f.filter(F.col("action").isin("NOT_SPAM", "UNBLOCK"))
    listed = t.contacts.select("user", F.substring("number", 1, 6).alias("prefix"))
    return A.prefix_override_candidates(marks, f.agg(F.max("ts")).scalar(), listed, listed.filter("prefix = 'none'"))


@query("ag34_number_history", """SELECT number, count(*) FILTER (direction = 'INCOMING' AND state = 'REJECTED') > 0 AS previously_rejected, count(*) FILTER (direction = 'INCOMING') AS incoming,
    CASE WHEN count(*) FILTER (direction = 'INCOMING') > 0 THEN count(*) FILTER (direction = 'INCOMING' AND state = 'ANSWERED') / count(*) FILTER (direction = 'INCOMING') ELSE 0.0 END AS answer_rate
    FROM calls WHERE number IS NOT NULL AND ts >= (SELECT max(ts) FROM calls) - 864000000 GROUP BY number""", "answer_rate")
def _(t: Tables):
    return A.number_history(t.calls, t.calls.agg(F.max("ts")).scalar(), 10)


_GR = " UNION ALL ".join(f"SELECT substr(s, i, {n}) AS token FROM (SELECT s, unnest(range(1, length(s) - {n} + 2)) AS i FROM src) x{n}" for n in (3, 4, 5))
_TOK = f"(WITH src AS (SELECT lower(p_name || ' ' || p_brand) AS s FROM part) SELECT token, count(*) AS n FROM ({_GR}) g GROUP BY token)"


def _names(t: Tables):
    return t.part.select(F.concat_ws(" ", "p_name", "p_brand").alias("s"))


@query("ag35_ngram_counts", f"SELECT * FROM {_TOK} x")
def _(t: Tables):
    return A.ngram_counts(_names(t), "s")


@query("srt04_vocabulary", f"SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM (SELECT * FROM {_TOK} x ORDER BY n DESC, token LIMIT 98) y")
def _(t: Tables):
    return A.vocabulary(A.ngram_counts(_names(t), "s"), 100)


_V100 = f"(SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM (SELECT * FROM {_TOK} x ORDER BY n DESC, token LIMIT 98) y)"


@query("sc20_ngram_ids", f"""SELECT key, array_to_string(list_resize(list(coalesce(v.id, 1) ORDER BY g.size, g.i), 64, 0), ',') AS ids FROM (
    SELECT p_partkey AS key, n.size, i, substr(lower(p_name), i, n.size) AS token FROM part, (VALUES (3), (4), (5)) n(size), range(1, 200) r(i) WHERE i <= length(p_name) - n.size + 1) g
    LEFT JOIN {_V100} v ON v.token = g.token GROUP BY key""")
def _(t: Tables):
    vocab = A.vocabulary(A.ngram_counts(_names(t), "s"), 100)
    return A.encode_ngrams(t.part.select(F.col("p_partkey").alias("key"), "p_name"), "key", "p_name", vocab, 64).select(
        "key", F.array_join("ids", ",").alias("ids"))


@query("ag37_scoring_summary", """SELECT count(*) AS total, count(*) FILTER (id % 9 = 0) AS errors, count(*) FILTER (id % 9 <> 0 AND verdict <> 'WARN') AS disagreements,
    count(*) FILTER (id % 9 <> 0 AND verdict = 'ALLOW') AS n_allow, count(*) FILTER (id % 9 <> 0 AND verdict = 'WARN') AS n_warn, count(*) FILTER (id % 9 <> 0 AND verdict = 'BLOCK') AS n_block FROM decisions""")
def _(t: Tables):
    bad = F.col("id") % 9 == 0
    rows = t.decisions.select(
        F.when(bad, "invalid_number").otherwise("").alias("error"), F.when(bad, "").otherwise(F.col("verdict")).alias("verdict"),
        (~bad & (F.col("verdict") != "WARN")).alias("disagreement"))
    return A.scoring_summary(rows)


_KIND = "CASE a.category WHEN 'BANK' THEN 'banking' WHEN 'INVESTMENTS' THEN 'crypto' WHEN 'GOVERNMENT' THEN 'gov' WHEN 'MARKETPLACE' THEN 'marketplace' ELSE 'delivery' END"


@query("ag38_installed_profile", f"""SELECT user, max(CASE WHEN k = 'banking' THEN 1 ELSE 0 END) AS has_banking, (max(CASE WHEN k = 'banking' THEN 10 ELSE 0 END) + max(CASE WHEN k = 'gov' THEN 5 ELSE 0 END)
    + max(CASE WHEN k = 'marketplace' THEN 5 ELSE 0 END) + max(CASE WHEN k = 'crypto' THEN 10 ELSE 0 END))::BIGINT AS digital_points, (max(CASE WHEN k = 'marketplace' THEN 5 ELSE 0 END) + max(CASE WHEN k = 'delivery' THEN 5 ELSE 0 END))::BIGINT AS ads_points,
    max(CASE WHEN k = 'crypto' THEN 5 ELSE 0 END)::BIGINT AS awareness_points FROM (SELECT u.user, {_KIND} AS k FROM usage u JOIN known_apps a USING (package)) x GROUP BY user""", ints="has_banking")
def _(t: Tables):
    c = F.col("category")
    kind = F.when(c == "BANK", "banking").when(c == "INVESTMENTS", "crypto").when(c == "GOVERNMENT", "gov").when(c == "MARKETPLACE", "marketplace").otherwise("delivery")
    packages = t.known_apps.select("package", kind.alias("category"))
    return A.installed_profile(t.usage.select("user", "package"), packages).select("user", "has_banking", "digital_points", "ads_points", "awareness_points")


_SET = "coalesce(array_to_string(list_sort(list_distinct(flatten(list(string_split(nullif({c}, ''), '{s}'))))), '{s}'), '')"


@query("ag39_review_rollup", f"SELECT normalized_number, sum(negative_count)::BIGINT AS negative_count, sum(positive_count)::BIGINT AS positive_count, sum(review_count)::BIGINT AS review_count, {_SET.format(c='categories', s=';')} AS categories FROM reputation_raw GROUP BY 1")
def _(t: Tables):
    return M.review_rollup(t.reputation_raw)


@query("ag41_reputation_union", f"""SELECT normalized_number, {_NUM}, max(last_review_at) AS last_review_at, coalesce(min(nullif(first_seen_at, '')), '') AS first_seen_at, coalesce(max(nullif(detail_date, '')), '') AS detail_date,
    coalesce(arg_min(nullif(page_title, ''), CASE WHEN page_title <> '' THEN ord END), '') AS page_title, {_SET.format(c='categories', s=';')} AS categories, array_to_string(list_sort(list(DISTINCT source)), '+') AS source FROM reputation_raw GROUP BY 1""", "source_confidence source_reliability")
def _(t: Tables):
    return A.reputation_union(t.reputation_raw, "ord")


@query("ag41_reputation_urls", "SELECT DISTINCT normalized_number, url FROM reputation_raw WHERE url <> ''")
def _(t: Tables):
    return A.reputation_urls(t.reputation_raw)


@query("ag42_verdict_calendar", """SELECT 'day' AS period, CAST(ts // 86400000 AS BIGINT) AS slot, verdict, count(*) AS n FROM decisions GROUP BY ALL
    UNION ALL SELECT 'week', CAST((ts // 86400000 + 3) // 7 AS BIGINT), verdict, count(*) FROM decisions GROUP BY ALL""")
def _(t: Tables):
    return A.verdict_calendar(t.decisions)


@query("ag43_row_gates", "SELECT * FROM (SELECT 'classed' AS table_name, least(count(*), 100) AS rows_seen, 100::BIGINT AS floor FROM classed UNION ALL SELECT 'regions', least(count(*), 100), 100 FROM region) x WHERE rows_seen < floor")
def _(t: Tables):
    return A.row_count_gates({"classed": (t.classed, 100), "regions": (t.region, 100)})


# --- sorts and limits -------------------------------------------------------


@query("srt01_sorted_numbers", "SELECT normalized_number FROM whitelist ORDER BY normalized_number")
def _(t: Tables):
    return t.whitelist.select("normalized_number").orderBy("normalized_number")


@query("srt02_best_row_first", f"SELECT normalized_number, ord FROM (SELECT *, {_BEST} AS rn FROM reputation_raw) x WHERE rn = 1")
def _(t: Tables):
    rank = [-F.col("source_confidence"), F.when(F.col("categories") != "", 0).otherwise(1), F.col("ord")]
    return M.best_row(t.reputation_raw, ["normalized_number"], rank).select("normalized_number", "ord")


@query("srt03_recent_feed", "SELECT id, verdict, ts FROM decisions ORDER BY ts DESC, id DESC LIMIT 100")
def _(t: Tables):
    return t.decisions.select("id", "verdict", "ts").orderBy(F.desc("ts"), F.desc("id")).limit(100)


@query("srt05_category_number_sort", "SELECT category, phone, name FROM allow_feed ORDER BY category, phone, name")
def _(t: Tables):
    return t.allow_feed.select("category", "phone", "name").orderBy("category", "phone", "name")


@query("srt06_first_candidates", "SELECT normalized_number FROM whitelist ORDER BY normalized_number LIMIT 50")
def _(t: Tables):
    return t.whitelist.select("normalized_number").orderBy("normalized_number").limit(50)

