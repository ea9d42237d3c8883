"""Readers and writers. Tables derived from the driver's tables are written to the shared folder
and read back by the reader under test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import html as H
from ..functions import phone as P
from ..functions.numeric import safe_float, safe_int
from ..operators import aggregate as A
from ..operators import merge as M
from ..operators import stats
from ..session import scratch_path
from ..sources import feeds, sinks
from .bindings import Tables
from .registry import query
from .scalars import norm_sql, valid_sql


def _csv(t: Tables, df: DataFrame, label: str, **options: object) -> str:
    path = scratch_path(t.spark, label)
    df.write.csv(path, **{"header": True, "escape": '"', **options})
    return path


@query("src01_translated_scan", "SELECT normalized_number, source, negative_count, source_confidence, categories, url FROM reputation_raw", "source_confidence")
def _(t: Tables):
    path = _csv(t, feeds.to_russian(t.reputation_raw.drop("ord")), "feed")
    df = feeds.read_feed(t.spark, path, S.RAW_REPUTATION_COLUMNS)
    missing = feeds.read_feed(t.spark, path + "-absent", S.RAW_REPUTATION_COLUMNS)
    both = df.unionByName(missing)
    return both.select("normalized_number", "source", safe_int("negative_count").alias("negative_count"),
                       safe_float("source_confidence").alias("source_confidence"), "categories", "url")


@query("src02_rename_both_ways", "SELECT normalized_number AS номер, source AS источник, review_count AS отзывов, categories, ord FROM reputation_raw")
def _(t: Tables):
    ru = feeds.to_russian(t.reputation_raw)
    return ru.withColumnRenamed("категории", "categories").select("номер", "источник", "отзывов", "categories", "ord")


_PT = "CASE WHEN def_code BETWEEN 900 AND 999 THEN 'mobile' WHEN def_code BETWEEN 300 AND 499 THEN 'landline' WHEN def_code = 800 THEN 'tollfree' WHEN def_code IN (700, 780) THEN 'virtual' ELSE 'other' END"


@query("src03_plan_scan", f"SELECT def_code, start_number, end_number, replace(operator, '\"', '') AS operator, region, capacity, {_PT} AS number_type FROM numbering_plan")
def _(t: Tables):
    p = t.numbering_plan
    line = F.concat_ws(";", "def_code", "start_number", "end_number", "capacity", F.translate("operator", '"', ""), "region")
    good = p.select(line.alias("value"))
    bad = p.select(F.concat(F.lit("# "), "operator").alias("value")).unionByName(p.select(F.concat(F.lit("x;"), "def_code").alias("value")))
    path = scratch_path(t.spark, "plan")
    lines = good.unionByName(bad).select(feeds.to_cp1251(F.col("value")).alias("value"))
    lines.write.csv(path, sep="\x01", quote="", escape="", header=False, encoding="iso-8859-1")
    return feeds.read_plan(t.spark, path)


@query("src04_typed_plan", "SELECT def_code, start_number, end_number, operator, region, capacity, number_type FROM numbering_plan")
def _(t: Tables):
    cols = ["def_code", "start_number", "end_number", "operator", "region", "capacity", "number_type"]
    return feeds.read_typed_plan(t.spark, _csv(t, t.numbering_plan.select(*cols), "typed-plan", escape="\\"))


@query("src05_feed_union", "SELECT ord, normalized_number, CASE WHEN ord % 3 = 0 THEN 'feed_a' ELSE source END AS source FROM reputation_raw UNION ALL SELECT ord, phone, 'feed_b' FROM black_feed")
def _(t: Tables):
    a = t.reputation_raw.select("ord", "normalized_number", F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("source")).alias("source"))
    b = t.black_feed.select("ord", F.col("phone").alias("normalized_number"), F.lit(None).cast("string").alias("source"))
    return M.union_feeds({"feed_a": a, "feed_b": b})


_BN = norm_sql("phone")


@query("src06_blacklist_scan", f"""SELECT ord, num AS normalized_number, 'public_blacklist' AS source, 1::BIGINT AS negative_count, 1::BIGINT AS review_count,
    coalesce(nullif(category, ''), 'мошенничество') AS categories, coalesce(TRY_CAST(confidence AS DOUBLE), 0.85) AS source_confidence, 0.85 AS source_reliability, url
    FROM (SELECT *, {_BN} AS num FROM black_feed) x WHERE {valid_sql('num')}""", "source_confidence source_reliability")
def _(t: Tables):
    df = feeds.canonical_blacklist(t.black_feed, "public_blacklist")
    return df.select("ord", "normalized_number", "source", "negative_count", "review_count", "categories", "source_confidence", "source_reliability", "url")


_SRC = "coalesce(nullif(source, ''), 'legitimate')"
_CONF = "coalesce(TRY_CAST(replace(source_confidence, ',', '.') AS DOUBLE), 0)"


@query("src07_allowlist", f"""SELECT normalized_number, name, category, source, source_confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY normalized_number ORDER BY r, o) AS rn FROM (
      SELECT {norm_sql('number')} AS normalized_number, name, category, 'whitelist_official' AS source, 0.95 AS source_confidence, 0 AS r, -ord AS o FROM official_feed
      UNION ALL SELECT {norm_sql('phone')}, name, category, 'legitimate_' || {_SRC}, CASE WHEN {_CONF} > 0 THEN {_CONF} WHEN {_SRC} IN ('official_whitelist', 'official_hotline') THEN 0.95
        WHEN category = 'personal_mobile' OR starts_with({_SRC}, 'numbering_plan') THEN 0.25 WHEN category IN ('freelancer', 'private_seller', 'realestate_owner') THEN 0.55
        WHEN category IN ('delivery', 'government', 'bank', 'medical') THEN 0.85 ELSE 0.70 END, 1, ord FROM allow_feed) u WHERE {valid_sql('normalized_number')}) w WHERE rn = 1""", "source_confidence")
def _(t: Tables):
    return feeds.canonical_allowlist(t.official_feed, t.allow_feed, "ord")


@query("src08_foreign_csv", f"""SELECT num AS normalized_number, 'import' AS source, negative_count, 0::BIGINT AS positive_count, neutral_count, CASE WHEN review_count = 0 THEN 0 ELSE review_count END AS review_count,
    view_count AS search_volume, categories, source_confidence, url FROM (SELECT *, {norm_sql('normalized_number', chr(39) + '+' + chr(39) + ' || {d}')} AS num FROM reputation_raw) x WHERE num IS NOT NULL""", "source_confidence")
def _(t: Tables):
    r = t.reputation_raw
    theirs = r.select(F.lit("").alias("phone"), F.col("normalized_number").alias("Телефон"), F.col("negative_count").alias("bad"), F.col("neutral_count").alias("neutral"),
                      F.col("review_count").alias("reviews"), F.col("view_count").alias("views"), F.col("categories").alias("tags"), F.col("source_confidence").alias("confidence"), "url")
    df = feeds.read_feed(t.spark, _csv(t, theirs, "foreign"))
    out = feeds.import_foreign(df, "import")
    return out.drop("last_review_at", "first_seen_at")


@query("src09_candidates", f"SELECT DISTINCT {norm_sql('raw', chr(39) + '+' + chr(39) + ' || {d}')} AS normalized_number FROM raw_numbers WHERE {norm_sql('raw', chr(39) + '+' + chr(39) + ' || {d}')} IS NOT NULL")
def _(t: Tables):
    path = scratch_path(t.spark, "candidates")
    r = t.raw_numbers
    lines = r.select(F.concat(F.col("raw"), F.lit(",note")).alias("value")).unionByName(r.select(F.concat(F.lit("# "), F.col("raw")).alias("value")))
    lines.write.text(path)
    return feeds.read_candidates(t.spark, path)




@query("src10_blocklist_text", """SELECT 'exact' AS kind, normalized_number AS key, CAST(NULL AS VARCHAR) AS pattern FROM (SELECT DISTINCT normalized_number FROM numbers) n
    UNION ALL SELECT 'prefix', p, '^\\' || p FROM (SELECT DISTINCT substr(normalized_number, 1, 6) AS p FROM numbers) x
    UNION ALL SELECT 'regex', '8' || p || '.*', '8' || p || '.*' FROM (SELECT DISTINCT substr(normalized_number, 3, 3) AS p FROM numbers) y""")
def _(t: Tables):
    n = t.numbers
    line = lambda c, k: n.select(c.alias("value"), (F.col("id") * 4 + k).alias("ord"))
    num = F.col("normalized_number")
    lines = (
        line(F.concat(F.lit(" "), num), 0).unionByName(line(F.concat(F.lit("prefix: "), F.substring(num, 1, 6)), 1))
        .unionByName(line(F.concat(F.lit("regex:8"), F.substring(num, 3, 3), F.lit(".*")), 2))
        .unionByName(line(F.concat(F.lit("regex:["), F.substring(num, 3, 3)), 3)).unionByName(line(F.lit("# note"), 4))
    )
    return feeds.parse_blocklist(lines, "ord").select("kind", "key", "pattern")


@query("src11_strict_corpus", "SELECT package AS packageName, label, trim(category) AS category FROM app_corpus WHERE trim(package) <> ''")
def _(t: Tables):
    rows = t.app_corpus.select(F.trim("package").alias("packageName"), "label", F.trim("category").alias("category")).filter("packageName <> ''")
    path = _csv(t, rows, "corpus")
    return feeds.read_corpus(t.spark, path)


@query("src12_posts", "SELECT id, from_id, 7::BIGINT AS owner_id, text FROM posts")
def _(t: Tables):
    item = F.to_json(F.struct(F.struct(F.array(F.struct("id", "from_id", F.lit(7).alias("owner_id"), "text")).alias("items")).alias("response")))
    return feeds.parse_posts(t.posts.select(item.alias("j")), "j").select("id", "from_id", "owner_id", "text")


def _sitemap(t: Tables):
    url = F.concat(F.lit("https://example.org/sitemap-"), "page_id", F.lit(".xml"))
    body = F.concat(
        F.lit('<?xml version="1.0"?><urlset><url><loc> https://example.org/p/'), F.col("page_id"), F.lit("</loc></url><url><loc>https://m.example.org/"),
        F.col("page_id"), F.lit("</loc></url><url><loc>https://other.net/x</loc></url><url><loc>https://example.org/p/"), F.col("page_id"), F.lit("</loc></url></urlset>"), F.col("html"))
    return t.pages.select("page_id", url.alias("url"), body.alias("body"))


@query("src13_sitemap_locations", "SELECT page_id, 'https://example.org/p/' || page_id AS location FROM pages UNION ALL SELECT page_id, 'https://m.example.org/' || page_id FROM pages")
def _(t: Tables):
    return _sitemap(t).select("page_id", F.explode(H.sitemap_locations(F.col("url"), F.col("body"))).alias("location"))


@query("src14_is_sitemap", "SELECT page_id, contains(lower(html), '<urlset') OR contains(lower(html), '<sitemapindex') OR ends_with(url, '.xml') OR ends_with(url, '.xml.gz') OR (contains(lower(url), 'sitemap') AND starts_with(ltrim(html), '<?xml')) AS page, true AS map FROM pages")
def _(t: Tables):
    maps = _sitemap(t).select("page_id", H.looks_like_sitemap(F.col("url"), F.col("body")).alias("map"))
    own = t.pages.select("page_id", H.looks_like_sitemap(F.col("url"), F.col("html")).alias("page"))
    return own.join(maps, "page_id")


@query("src16_risk_table_lines", """SELECT '' || sum(n)::BIGINT AS labelled, count(*) AS prefixes FROM (SELECT substr(number, 1, 6) AS prefix, count(*) AS n FROM labeled GROUP BY 1 HAVING count(*) >= 3) x""")
def _(t: Tables):
    risk = stats.prefix_risk(t.labeled)
    path = scratch_path(t.spark, "risk")
    sinks.write_risk_tables({"prefix_risk": risk}, path)
    lines = sinks.nested_json(t.spark.read.parquet(path + "/prefix_risk"), "prefix", ["risk", "seen_count"])
    seen = F.get_json_object("entry", "$.seen_count").cast("bigint")
    return lines.agg(F.sum(seen).cast("string").alias("labelled"), F.count(F.lit(1)).alias("prefixes"))


_CUR = " UNION ALL ".join(f"SELECT 0::BIGINT AS section, 'prefix:{p}' AS line" for p in S.CURATED_PREFIXES)


@query("src17_spam_bundle", f"{_CUR} UNION ALL SELECT DISTINCT 1::BIGINT, number FROM labeled WHERE label = 'BLOCK' AND starts_with(number, '+')")
def _(t: Tables):
    lines = sinks.spam_bundle(t.labeled)
    path = scratch_path(t.spark, "bundle")
    sinks.write_lines(lines, path)
    back = t.spark.read.text(path).select(F.when(F.col("value").startswith("prefix:"), 0).otherwise(1).alias("section"), F.col("value").alias("line"))
    return back


@query("src18_verdict_table", """SELECT normalized_number, '' AS expected_label, verdict, verdict AS model_verdict, printf('%.6f', c) AS "probs_BLOCK", 'cold' AS feature_source FROM (
    SELECT normalized_number, source_confidence AS c, CASE WHEN source_confidence >= 0.7 THEN 'BLOCK' WHEN source_confidence >= 0.4 THEN 'WARN' ELSE 'ALLOW' END AS verdict FROM reputation_raw) x""")
def _(t: Tables):
    c = F.col("source_confidence")
    verdict = F.when(c >= 0.7, "BLOCK").when(c >= 0.4, "WARN").otherwise("ALLOW")
    rows = t.reputation_raw.select(
        "normalized_number", F.lit("").alias("expected_label"), verdict.alias("verdict"), verdict.alias("model_verdict"),
        F.round(c * 100).cast("bigint").alias("risk_score"), F.lit(0.0).alias("probs_ALLOW"), (1 - c).alias("probs_WARN"), c.alias("probs_BLOCK"),
        F.lit("cold").alias("feature_source"), F.lit("").alias("rule_overrides"), F.lit(False).alias("disagreement"), F.lit("").alias("error"))
    path = _csv(t, sinks.verdict_table(rows), "verdicts")
    back = t.spark.read.csv(path, header=True, schema=S.string_schema(sinks.VERDICT_COLUMNS)).na.fill("")
    return back.select("normalized_number", "expected_label", "verdict", "model_verdict", "probs_BLOCK", "feature_source")


@query("src20_build_report", """SELECT 42::BIGINT AS seed, count(*) AS input_rows, sum(CASE WHEN trim(package) = '' THEN 1 ELSE 0 END)::BIGINT AS dropped_blank,
    (SELECT count(DISTINCT package) FROM app_corpus WHERE trim(package) <> '' AND upper(trim(category)) = 'BANK')::BIGINT AS bank FROM app_corpus""")
def _(t: Tables):
    kept = t.app_corpus.filter(F.trim("package") != "")
    report = sinks.build_report(A.category_counts(kept), A.corpus_counters(t.app_corpus), 42)
    j = lambda c, p: F.get_json_object(c, p).cast("bigint")
    return report.select(j("counters", "$.seed").alias("seed"), j("counters", "$.input_rows").alias("input_rows"),
                         j("counters", "$.dropped_blank").alias("dropped_blank"), j("categories", "$.BANK").alias("bank"))


def _share_sql(label: str) -> str:
    rate = f"(SELECT avg(CASE WHEN label = '{label}' THEN 1.0 ELSE 0.0 END) FROM labeled)"
    return f"round_even((sum(CASE WHEN label = '{label}' THEN 1 ELSE 0 END) + 10.0::DOUBLE * {rate}) / (count(*) + 10.0::DOUBLE), 4)"


@query("src21_quantised_histogram", f"""SELECT CAST(substr(prefix, 3) AS BIGINT) AS prefix_key, CAST(round_even(b * 255, 0) AS BIGINT) AS block_q, CAST(round_even(w * 255, 0) AS BIGINT) AS warn_q, seen FROM (
    SELECT substr(number, 1, 9) AS prefix, {_share_sql('BLOCK')} AS b, {_share_sql('WARN')} AS w, count(*) AS seen FROM labeled GROUP BY 1 HAVING count(*) >= 3) x""")
def _(t: Tables):
    return stats.quantise(stats.prefix_histogram(t.labeled, (9,)), 9).drop("entropy_q")


@query("src22_personal_export", """SELECT 'calls' AS table_name, user, count(*) AS rows_kept, sum(ts)::BIGINT AS checksum FROM calls GROUP BY user UNION ALL SELECT 'usage', user, count(*), sum(ts)::BIGINT FROM usage GROUP BY user
    UNION ALL SELECT 'feedback', user, count(*), sum(ts)::BIGINT FROM feedback GROUP BY user UNION ALL SELECT 'decisions', user, count(*), sum(ts)::BIGINT FROM decisions GROUP BY user""")
def _(t: Tables):
    tables = {n: getattr(t, n) for n in ("calls", "usage", "feedback", "decisions")}
    path = scratch_path(t.spark, "personal")
    sinks.export_personal(tables).write.json(path)
    lines = t.spark.read.json(path, schema="table_name string, schema_version int, user bigint, row string")
    back = sinks.import_personal(lines, {n: "user bigint, ts bigint" for n in tables})
    out = None
    for n, df in back.items():
        part = df.groupBy("user").agg(F.count(F.lit(1)).alias("rows_kept"), F.sum("ts").alias("checksum")).withColumn("table_name", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


@query("src23_official_directory", f"""SELECT n.id, n.normalized_number, o.name AS official_name, o.category AS official_category, o.num IS NOT NULL AS official FROM numbers n
    LEFT JOIN (SELECT num, max(name) AS name, max(category) AS category FROM (SELECT {norm_sql('number')} AS num, name, category FROM official_feed) x GROUP BY num) o ON o.num = n.normalized_number""")
def _(t: Tables):
    path = _csv(t, t.official_feed.select("number", "name", "category"), "official", header=False)
    return sinks.official_directory(t.numbers, feeds.read_official(t.spark, path))


