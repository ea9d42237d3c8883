"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import numeric as N
from ..functions import phone as P
from ..functions import text as T
from .bindings import Tables
from .registry import query


def any_of(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')"


def norm_sql(raw: str, foreign: str = "NULL") -> str:
    """The canonical number of a text column, as SQL."""
    t = f"trim({raw})"
    d = DIGITS.format(f"coalesce({t}, '')")
    return f"""CASE WHEN {d} IN ('101','102','103','104','112') THEN '+7' || {d}
        WHEN length({d}) = 11 AND substr({d}, 1, 1) IN ('7','8') THEN '+7' || substr({d}, 2, 10)
        WHEN length({d}) = 10 AND substr({d}, 1, 1) IN ('9','3','4','8') THEN '+7' || {d}
        WHEN starts_with({t}, '+') AND length({d}) >= 11 THEN
            CASE WHEN substr({d}, 1, 1) = '7' THEN '+7' || substr({d}, 2, 10) ELSE {foreign.format(d=d)} END END"""


CODES = ", ".join(str(c) for c in S.LANDLINE_CODES)


def code_sql(n: str) -> str:
    return f"CASE WHEN starts_with({n}, '+7') THEN TRY_CAST(substr({n}, 3, 3) AS INTEGER) END"


def class_sql(n: str) -> dict[str, str]:
    c, rest = code_sql(n), f"substr({n}, 3)"
    long = f"length({rest}) >= 3"
    own = {
        "mobile": f"coalesce({long} AND {c} BETWEEN 900 AND 999, false)",
        "landline": f"coalesce({long} AND {c} IN ({CODES}), false)",
        "tollfree": f"coalesce({long} AND {c} IN (800, 804), false)",
        "short_code": f"coalesce(starts_with({n}, '+7') AND ({rest} IN ('101','102','103','104','112') OR regexp_full_match({rest}, '[0-9]{{1,4}}')), false)",
        "placeholder": f"coalesce(starts_with({n}, '+7') AND length({rest}) >= 7 AND regexp_matches({rest}, '0{{6,}}$'), false)",
    }
    own["national"] = (
        f"(coalesce(starts_with({n}, '+7') AND {rest} IN ('101','102','103','104','112'), false) OR {own['mobile']} OR {own['landline']} OR {own['tollfree']})"
    )
    own["valid"] = f"({own['national']} AND NOT {own['placeholder']})"
    return own


def valid_sql(n: str) -> str:
    return class_sql(n)["valid"]


def type_sql(n: str) -> str:
    c = class_sql(n)
    return f"""CASE WHEN {n} IS NULL OR {n} = '' THEN 'unknown' WHEN {c['short_code']} THEN 'short' WHEN {c['tollfree']} THEN 'tollfree'
        WHEN {c['mobile']} THEN 'mobile' WHEN {c['landline']} THEN 'landline' WHEN starts_with({n}, '+7') THEN 'ru_other' ELSE 'foreign' END"""


def def_text_sql(n: str) -> str:
    d = DIGITS.format(f"coalesce({n}, '')")
    return f"CASE WHEN length({d}) >= 4 AND substr({d}, 1, 1) IN ('7','8') THEN substr({d}, 2, 3) WHEN length({d}) >= 3 THEN substr({d}, 1, 3) ELSE '' END"


def bucket_sql(op: str) -> str:
    t = f"lower(trim(coalesce({op}, '')))"
    rules = " ".join(f"WHEN {any_of(t, words)} THEN '{b}'" for b, words in S.OPERATOR_RULES)
    return f"CASE WHEN {t} = '' THEN 'unknown' {rules} ELSE 'other' END"


def offset_sql(region: str) -> str:
    t = f"lower(coalesce({region}, ''))"
    rules = " ".join(f"WHEN {any_of(t, words)} THEN {h}" for h, words in S.UTC_OFFSET_RULES)
    return f"CAST(CASE {rules} ELSE 3 END AS BIGINT)"


def flags_sql(cats: str) -> dict[str, str]:
    t = f"lower(coalesce({cats}, ''))"
    return {
        "fraud": any_of(t, S.FRAUD_WORDS), "tele": any_of(t, S.TELEMARKETING_WORDS), "fin": any_of(t, S.FINANCE_WORDS),
    }


def entropy_sql(d: str) -> str:
    terms = " + ".join(
        f"CASE WHEN contains({d}, '{x}') THEN -((length({d}) - length(replace({d}, '{x}', '')))::DOUBLE / length({d})) * log2((length({d}) - length(replace({d}, '{x}', '')))::DOUBLE / length({d})) ELSE 0.0::DOUBLE END"
        for x in "0123456789"
    )
    return f"CASE WHEN length({d}) > 0 THEN ({terms}) / log2(10.0::DOUBLE) ELSE 0.0 END"


def repeat_sql(d: str) -> str:
    return f"CASE WHEN length({d}) > 1 THEN list_sum([CASE WHEN substr({d}, i, 1) = substr({d}, i - 1, 1) THEN 1 ELSE 0 END FOR i IN range(2, length({d}) + 1)])::DOUBLE / (length({d}) - 1) ELSE 0.0::DOUBLE END"


def run_sql(d: str) -> str:
    alts = "|".join(f"{x}+" for x in "0123456789")
    return f"CASE WHEN length({d}) > 0 THEN least(list_max([length(r) FOR r IN regexp_extract_all({d}, '{alts}')])::DOUBLE / length({d}), 1.0::DOUBLE) ELSE 0.0::DOUBLE END"


def beautiful_sql(d: str) -> str:
    tail = f"right({d}, 7)"
    up = ["".join(str((s + i) % 10) for i in range(4)) for s in range(10)]
    down = ["".join(str((s - i) % 10) for i in range(4)) for s in range(10)]
    pairs = "(" + " OR ".join(
        f"(length(substr({tail}, {i + k}, {k})) = {k} AND substr({tail}, {i}, {k}) = substr({tail}, {i + k}, {k}))"
        for i in range(1, 7) for k in (2, 3) if i + 2 * k - 1 <= 7
    ) + ")"
    return (
        f"(length({tail}) > 0 AND (({repeat_sql(tail)}) >= 0.45 OR ({run_sql(tail)}) >= 4.0::DOUBLE / greatest(length({tail}), 1) OR {pairs} OR {any_of(tail, up + down)}))"
    )


@query("sc01_normalize", f"SELECT id, {norm_sql('raw')} AS strict_number, {norm_sql('raw', chr(39) + '+' + chr(39) + ' || {d}')} AS any_number FROM raw_numbers")
def _(t: Tables):
    return t.raw_numbers.select("id", P.normalize("raw").alias("strict_number"), P.normalize("raw", False).alias("any_number"))


_T, _D = "trim(raw)", DIGITS.format("coalesce(trim(raw), '')")


@query("sc02_block_key", f"""SELECT id, CASE WHEN length({_D}) = 0 THEN NULL WHEN starts_with({_T}, '+') THEN '+' || {_D}
    WHEN length({_D}) = 11 AND substr({_D}, 1, 1) IN ('7','8') THEN '+7' || substr({_D}, 2, 10) WHEN length({_D}) = 10 THEN '+7' || {_D}
    WHEN length({_D}) >= 7 THEN '+' || {_D} END AS block_key FROM raw_numbers""")
def _(t: Tables):
    return t.raw_numbers.select("id", P.normalize_block_key("raw").alias("block_key"))


@query("sc03_device_number", f"""SELECT id, CASE WHEN length({_T}) <= 20 AND regexp_full_match({_T}, '[+0-9 ().-]+') AND length({_D}) BETWEEN 2 AND 15
    THEN CASE WHEN length({_D}) <= 6 THEN {_D} ELSE {norm_sql('raw', chr(39) + '+' + chr(39) + ' || {d}')} END END AS number FROM raw_numbers""")
def _(t: Tables):
    return t.raw_numbers.select("id", P.normalize_device("raw").alias("number"))


_N = "n.num"
_NUMS = f"(SELECT id, {norm_sql('raw', chr(39) + '+' + chr(39) + ' || {d}')} AS num FROM raw_numbers UNION ALL SELECT id + 1000000000, normalized_number FROM numbers)"
_CLASS = class_sql(_N)


def _nums(t: Tables):
    raw = t.raw_numbers.select("id", P.normalize("raw", False).alias("num"))
    return raw.unionByName(t.numbers.select((F.col("id") + 1000000000).alias("id"), F.col("normalized_number").alias("num")))


@query("sc04_classes", "SELECT n.id, " + ", ".join(f"{v} AS {k}" for k, v in _CLASS.items()) + f" FROM {_NUMS} n")
def _(t: Tables):
    fns = {
        "mobile": P.is_mobile, "landline": P.is_landline, "tollfree": P.is_tollfree, "short_code": P.is_short_code,
        "placeholder": P.is_placeholder, "national": P.is_national, "valid": P.is_valid,
    }
    return _nums(t).select("id", *[f("num").alias(k) for k, f in fns.items()])


@query("sc05_def_code", f"SELECT n.id, {code_sql(_N)} AS code, {def_text_sql(_N)} AS code_text FROM {_NUMS} n", ints="code")
def _(t: Tables):
    return _nums(t).select("id", P.def_code("num").alias("code"), P.def_code_text("num").alias("code_text"))


@query("sc06_number_type", f"SELECT n.id, {type_sql(_N)} AS number_type FROM {_NUMS} n")
def _(t: Tables):
    return _nums(t).select("id", P.number_type("num").alias("number_type"))


_RAWT = "regexp_replace(trim(raw), '[ ()-]', '', 'g')"
_NRM = norm_sql("raw", "'+' || {d}")


@query("sc07_spoofed_prefix", f"""SELECT id, coalesce((starts_with({_RAWT}, '+84') AND starts_with({DIGITS.format(_RAWT)}, '8495'))
    OR (starts_with({_RAWT}, '0084') AND starts_with({DIGITS.format(_RAWT)}, '008495'))
    OR coalesce(starts_with({_NRM}, '+84') AND starts_with({DIGITS.format(_NRM)}, '8495'), false), false) AS spoofed FROM raw_numbers""")
def _(t: Tables):
    return t.raw_numbers.select("id", P.spoofed_prefix(F.col("raw"), P.normalize("raw", False)).alias("spoofed"))


_DN = "d.digits"
_DIG = f"(SELECT id, {DIGITS.format('raw')} AS digits FROM raw_numbers)"


@query("sc08_digit_entropy", f"SELECT d.id, {entropy_sql(_DN)} AS entropy FROM {_DIG} d", "entropy")
def _(t: Tables):
    return t.raw_numbers.select("id", P.digit_entropy(P.digits("raw")).alias("entropy"))


@query("sc09_repeat_ratio", f"SELECT d.id, {repeat_sql(_DN)} AS ratio FROM {_DIG} d", "ratio")
def _(t: Tables):
    return t.raw_numbers.select("id", P.repeat_ratio(P.digits("raw")).alias("ratio"))


@query("sc10_max_run", f"SELECT d.id, {run_sql(_DN)} AS run FROM {_DIG} d", "run")
def _(t: Tables):
    return t.raw_numbers.select("id", P.max_run(P.digits("raw")).alias("run"))


_STEPS = "|".join(["".join(str((s + i * k) % 10) for i in range(4)) for k in (1, -1) for s in range(10)])


@query("sc11_monotonic_run", f"SELECT d.id, regexp_matches(d.digits, '{_STEPS}') AS monotonic FROM {_DIG} d")
def _(t: Tables):
    return t.raw_numbers.select("id", P.has_monotonic_run(P.digits("raw")).alias("monotonic"))


@query("sc12_beautiful", f"SELECT d.id, {beautiful_sql(_DN)} AS beautiful FROM {_DIG} d")
def _(t: Tables):
    return t.raw_numbers.select("id", P.is_beautiful(P.digits("raw")).alias("beautiful"))


@query("sc13_operator_bucket", f"SELECT number, ord, {bucket_sql('operator')} AS bucket, {bucket_sql('operator')} = 'mvno' AS is_mvno FROM labeled")
def _(t: Tables):
    b = P.operator_bucket("operator")
    return t.labeled.select("number", "ord", b.alias("bucket"), (b == "mvno").alias("is_mvno"))


_UP = "upper(trim(operator))"
_OPR = " ".join(f"WHEN {any_of(_UP, w)} THEN '{n}'" for w, n in S.REGISTRY_OPERATORS)


@query("sc14_registry_names", f"""SELECT s.def_code, s.start_number, CASE {_OPR} ELSE trim(regexp_replace(regexp_replace(trim(operator), '^(ПАО|ООО|АО|ЗАО|ОАО)\\s+', ''), '^["'']+|["'']+$', '', 'g')) END AS operator,
    trim(regexp_replace(regexp_replace(trim(split_part(trim(split_part(region, '|', 1)), '*', 1)), '^г\\.\\s+', ''), '\\s+обл\\.\\s*$', ' обл.')) AS region
    FROM numbering_plan s""")
def _(t: Tables):
    return t.numbering_plan.select(
        "def_code", "start_number", P.registry_operator("operator").alias("operator"), P.registry_region("region").alias("region"))


_CH = "list_reduce(list_prepend(0::BIGINT, [unicode(c)::BIGINT FOR c IN string_split(lower(trim({x})), '')]), lambda a, c: (a * 31 + c) % 1000003)"


@query("sc15_text_bucket", f"SELECT def_code, start_number, region, CASE WHEN trim(region) = '' THEN 0 ELSE {_CH.format(x='region')} % 16 END AS bucket FROM numbering_plan", ints="bucket")
def _(t: Tables):
    return t.numbering_plan.select("def_code", "start_number", "region", P.text_bucket("region").alias("bucket"))


@query("sc16_utc_offset", f"SELECT def_code, start_number, {offset_sql('region')} AS utc_offset FROM numbering_plan")
def _(t: Tables):
    return t.numbering_plan.select("def_code", "start_number", P.utc_offset("region").alias("utc_offset"))


_FL = flags_sql("text")


@query("sc17_category_flags", f"SELECT doc_id, CASE WHEN {_FL['fraud']} THEN 1.0 ELSE 0.0 END AS has_fraud_category, CASE WHEN {_FL['tele']} THEN 1.0 ELSE 0.0 END AS has_telemarketing_category, CASE WHEN {_FL['fin']} THEN 1.0 ELSE 0.0 END AS has_finance_category FROM texts",
       "has_fraud_category has_telemarketing_category has_finance_category")
def _(t: Tables):
    return t.texts.select("doc_id", *[c.alias(n) for n, c in T.category_flags("text").items()])


@query("sc18_strip_label", "SELECT doc_id, trim(nfc_normalize(text)) AS label FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", T.strip_label(F.col("text")).alias("label"))


_CATS = ", ".join(f"'{c}'" for c in S.APP_CATEGORIES)


@query("sc19_app_category", f"SELECT ord, CASE WHEN upper(trim(category)) IN ({_CATS}) THEN upper(trim(category)) ELSE 'OTHER' END AS category, upper(trim(category)) NOT IN ({_CATS}) AS unknown FROM app_corpus")
def _(t: Tables):
    return t.app_corpus.select("ord", T.app_category(F.col("category")).alias("category"), T.app_category_unknown(F.col("category")).alias("unknown"))


_TW = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query("sc21_truncate", f"SELECT doc_id, CASE WHEN length({_TW}) <= 120 THEN {_TW} ELSE substr({_TW}, 1, 119) || '…' END AS sample FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", T.truncate(F.col("text"), 120).alias("sample"))


@query("sc22_mask_number", "SELECT id, CASE WHEN length(normalized_number) > 6 THEN substr(normalized_number, 1, 5) || '•••' || right(normalized_number, 2) ELSE normalized_number END AS masked FROM numbers")
def _(t: Tables):
    return t.numbers.select("id", P.mask_number(F.col("normalized_number")).alias("masked"))


@query("sc23_split_phones", """SELECT s_suppkey AS id, trim(p) AS part FROM (SELECT s_suppkey, unnest(string_split_regex(s_name || ' ;' || s_suppkey || '|,' || s_nationkey, '[;,|]')) AS p FROM supplier) x WHERE trim(p) <> ''""")
def _(t: Tables):
    joined = F.concat("s_name", F.lit(" ;"), "s_suppkey", F.lit("|,"), "s_nationkey")
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), joined.alias("tag"))
    return rows.select("id", F.explode(P.split_phones("tag")).alias("part"))


@query("sc24_source_kind", """SELECT ord, starts_with(lower(source), 'whitelist') OR starts_with(lower(source), 'static_whitelist') AS listed,
    contains(lower(source), 'moshelovka') OR contains(lower(source), 'public_blacklist') AS blacklisted FROM reputation_raw""")
def _(t: Tables):
    return t.reputation_raw.select("ord", T.is_list_source(F.col("source")).alias("listed"), T.is_public_blacklist_source(F.col("source")).alias("blacklisted"))


@query("sc30_parse_date", """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN epoch_ms(date_trunc('day', ts)) WHEN 1 THEN epoch_ms(date_trunc('second', ts))
    WHEN 2 THEN epoch_ms(date_trunc('day', ts)) WHEN 3 THEN epoch_ms(date_trunc('minute', ts)) END AS parsed_ms FROM events""")
def _(t: Tables):
    ts, k = F.col("ts"), F.col("event_id") % 5
    text = (
        F.when(k == 0, F.date_format(ts, "yyyy-MM-dd")).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 2, F.date_format(ts, "dd.MM.yyyy")).when(k == 3, F.date_format(ts, "dd.MM.yyyy HH:mm")).otherwise("soon")
    )
    rows = t.events.select(F.col("event_id").alias("id"), text.alias("written"))
    return rows.select("id", N.wall_ms(N.parse_date("written")).alias("parsed_ms"))


_AGE = "greatest(date_diff('day', CAST(first_seen_at AS DATE), CAST(last_review_at AS DATE))::DOUBLE, 1.0)"


@query("sc31_review_velocity", f"""SELECT ord, CASE WHEN first_seen_at = '' OR review_count <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, review_count / {_AGE.replace("CAST(first_seen_at AS DATE)", "CAST(nullif(first_seen_at, '') AS DATE)")} / 2)) END AS v48,
    CASE WHEN first_seen_at = '' OR review_count <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, review_count / {_AGE.replace("CAST(first_seen_at AS DATE)", "CAST(nullif(first_seen_at, '') AS DATE)")} / 7)) END AS v7 FROM reputation_raw""", "v48 v7")
def _(t: Tables):
    v = lambda d: N.review_velocity(F.col("last_review_at"), F.col("first_seen_at"), F.col("review_count"), d)
    return t.reputation_raw.select("ord", v(2).alias("v48"), v(7).alias("v7"))


@query("sc32_night_weekend", "SELECT event_id AS id, hour(ts + INTERVAL 3 HOUR) >= 22 OR hour(ts + INTERVAL 3 HOUR) < 8 AS night, dayofweek(ts + INTERVAL 3 HOUR) IN (0, 6) AS weekend FROM events")
def _(t: Tables):
    return t.calls.select("id", N.night_flag(F.col("ts"), 3).alias("night"), N.weekend_flag(F.col("ts"), 3).alias("weekend"))


@query("sc33_page_date", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(\d{1,2})[./](\d{1,2})[./](\d{4})') THEN regexp_extract(text, '(\d{1,2})[./](\d{1,2})[./](\d{4})', 3) || '-' ||
    lpad(regexp_extract(text, '(\d{1,2})[./](\d{1,2})[./](\d{4})', 2), 2, '0') || '-' || lpad(regexp_extract(text, '(\d{1,2})[./](\d{1,2})[./](\d{4})', 1), 2, '0')
    WHEN regexp_matches(text, '(\d{4})[/-](\d{1,2})[/-](\d{1,2})') THEN regexp_extract(text, '(\d{4})[/-](\d{1,2})[/-](\d{1,2})', 1) || '-' ||
    lpad(regexp_extract(text, '(\d{4})[/-](\d{1,2})[/-](\d{1,2})', 2), 2, '0') || '-' || lpad(regexp_extract(text, '(\d{4})[/-](\d{1,2})[/-](\d{1,2})', 3), 2, '0') ELSE '' END AS page_date FROM texts""")
def _(t: Tables):
    return t.texts.select("doc_id", T.page_date(F.col("text")).alias("page_date"))


_BF = "TRY_CAST(replace(trim(confidence), ',', '.') AS DOUBLE)"


@query("sc34_safe_numbers", f"SELECT ord, coalesce({_BF}, 0.85) AS as_float, CAST(coalesce(trunc({_BF} * 1), 7) AS BIGINT) AS as_int, greatest(0.0, least(1.0, coalesce({_BF}, 0.85) * 3 - 1)) AS clamped FROM black_feed", "as_float clamped")
def _(t: Tables):
    return t.black_feed.select(
        "ord", N.safe_float("confidence", 0.85).alias("as_float"), N.safe_int("confidence", 7).alias("as_int"),
        N.clamp01(N.safe_float("confidence", 0.85) * 3 - 1).alias("clamped"))


_RAT = "negative_count::DOUBLE / greatest(negative_count + positive_count + neutral_count, review_count, 1)"
_CF = flags_sql("categories")


def reputation_sql(ratio: str, reviews: str, search: str, fraud: str, tele: str) -> str:
    return f"""greatest(0.0, least(1.0, ({ratio}) * 0.55 + greatest(0.0, least(1.0, ln(1.0 + {reviews}) / ln(101.0))) * 0.15
        + greatest(0.0, least(1.0, ln(1.0 + {search}) / ln(10001.0))) * 0.15 + CASE WHEN {fraud} THEN 0.25 ELSE 0 END + CASE WHEN {tele} THEN 0.12 ELSE 0 END))"""


@query("sc35_reputation_score", f"SELECT ord, {reputation_sql(_RAT, 'review_count', 'search_volume', _CF['fraud'], _CF['tele'])} AS score FROM reputation_raw", "score")
def _(t: Tables):
    from ..plans.features import reputation_score

    flags = T.category_flags("categories")
    ratio = F.col("negative_count") / F.greatest(F.col("negative_count") + F.col("positive_count") + F.col("neutral_count"), F.col("review_count"), F.lit(1))
    return t.reputation_raw.select(
        "ord",
        reputation_score(ratio, F.col("review_count"), F.col("search_volume"), flags["has_fraud_category"], flags["has_telemarketing_category"]).alias("score"))


_LOWC = "lower(categories)"


@query("sc36_no_metadata", f"""SELECT ord, CASE WHEN review_count > 0 OR search_volume > 0 OR view_count > 0 OR {_CF['fraud']} OR {_CF['tele']} OR {_CF['fin']} THEN 0.0 ELSE 1.0 END AS by_features,
    NOT (review_count > 0 OR search_volume > 0 OR view_count > 0 OR {any_of(_LOWC, S.COLD_CATEGORY_WORDS)}) AS by_entry FROM reputation_raw""", "by_features")
def _(t: Tables):
    from ..operators.aggregate import no_metadata
    from ..plans.features import no_metadata_flag

    c = {n: F.col(n) for n in ("review_count", "search_volume", "view_count", "categories")}
    a = no_metadata_flag(c["review_count"], c["search_volume"], c["view_count"], F.lit(False), T.category_flags("categories"))
    b = no_metadata({**c, "in_allow": F.lit(False), "in_black": F.lit(False)})
    return t.reputation_raw.select("ord", a.alias("by_features"), b.alias("by_entry"))


@query("sc37_sample_size", "SELECT ord, least(1.0, search_volume / 30.0) AS linear_size, least(1.0, ln(1.0 + search_volume) / ln(51.0)) AS log_size FROM reputation_raw", "linear_size log_size")
def _(t: Tables):
    seen = F.col("search_volume").cast("double")
    return t.reputation_raw.select("ord", N.clamp01(seen / 30.0).alias("linear_size"), N.log_share(seen, 50).alias("log_size"))


def _clip(x: str) -> str:
    return f"least(greatest({x}, 1e-9), 1.0)"


_PW = [f"pow({_clip(p)}, 1.0 / 3.0)" for p in ("p_allow", "p_warn", "p_block")]


@query("sc38_soft_targets", f"""SELECT y, l_quantity, l_extendedprice, sum(t_allow) AS t_allow, sum(t_warn) AS t_warn, sum(t_block) AS t_block, sum(m_block) AS m_block FROM (
    SELECT *, {_PW[0]} / ({' + '.join(_PW)}) AS t_allow, {_PW[1]} / ({' + '.join(_PW)}) AS t_warn, {_PW[2]} / ({' + '.join(_PW)}) AS t_block,
    0.7 * p_block + 0.3 * l_discount AS m_block FROM scores) x GROUP BY y, l_quantity, l_extendedprice""", "t_allow t_warn t_block m_block")
def _(t: Tables):
    from ..plans.model import blended, soft_targets

    s = t.scores
    soft = soft_targets([F.col("p_allow"), F.col("p_warn"), F.col("p_block")], 3.0)
    mixed = blended([[F.col("p_block")], [F.col("l_discount")]], [0.7, 0.3])[0]
    rows = s.select("y", "l_quantity", "l_extendedprice", soft[0].alias("a"), soft[1].alias("w"), soft[2].alias("b"), mixed.alias("m"))
    return rows.groupBy("y", "l_quantity", "l_extendedprice").agg(
        F.sum("a").alias("t_allow"), F.sum("w").alias("t_warn"), F.sum("b").alias("t_block"), F.sum("m").alias("m_block"))


@query("sc39_logistic_score", "SELECT y, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, count(*) AS n, 1.0 / (1.0 + exp(-(0.02 * l_quantity - 3.0 * l_discount + 1.5 * l_tax - 0.5))) AS p FROM scores GROUP BY ALL", "p")
def _(t: Tables):
    x = F.array("l_quantity", "l_discount", "l_tax")
    w = F.array(F.lit(0.02), F.lit(-3.0), F.lit(1.5))
    keys = ["y", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"]
    return t.scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("p", N.sigmoid(N.dot(x, w) - 0.5))


_CL = "least(greatest(p_block, 1e-7), 1 - 1e-7)"


@query("sc40_platt_map", f"SELECT p_block, count(*) AS n, 1.0 / (1.0 + exp(-(1.3 * ln({_CL} / (1 - {_CL})) - 0.2))) AS calibrated FROM scores GROUP BY p_block", "p_block calibrated")
def _(t: Tables):
    from ..plans.model import platt_map

    return t.scores.groupBy("p_block").agg(F.count(F.lit(1)).alias("n")).withColumn("calibrated", platt_map(F.col("p_block"), 1.3, -0.2))


@query("sc41_json_features", "SELECT id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN json_exists(props, '$.k') THEN 1 ELSE 0 END AS complete FROM snapshots", "k", "complete")
def _(t: Tables):
    m = F.from_json("props", "map<string,double>")
    wanted = ["k"]
    whole = F.when(F.forall(F.array(*[F.lit(w) for w in wanted]), lambda w: F.map_contains_key(F.col("_m"), w)), F.col("_m"))
    rows = t.snapshots.withColumn("_m", m).withColumn("_w", whole)
    return rows.select("id", F.try_element_at("_w", F.lit("k")).alias("k"), F.col("_w").isNotNull().cast("int").alias("complete"))


@query("sc42_local_reputation", """SELECT ord, CASE WHEN ord % 9 = 0 THEN 0.0 WHEN ord % 10 = 0 THEN 1.0 ELSE least(1.0, source_confidence * 0.55 + CASE WHEN ord % 4 = 0 THEN 0.35 ELSE 0 END
    + CASE WHEN ord % 3 = 0 THEN 0.1 ELSE 0 END) END AS score FROM reputation_raw""", "score")
def _(t: Tables):
    from ..plans.features import local_reputation

    o = F.col("ord")
    return t.reputation_raw.select("ord", local_reputation(F.col("source_confidence"), o % 10 == 0, o % 9 == 0, o % 4 == 0, o % 3 == 0).alias("score"))
