"""Column contracts, label ids, key lists and key words."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. They must equal the source system's for results to agree.
# ---------------------------------------------------------------------------

LABELS = ["ALLOW", "WARN", "BLOCK"]
LABEL_TO_ID = {"ALLOW": 0, "WARN": 1, "BLOCK": 2}

COMPACT_FEATURES = [
    "isContact", "isRussianNumber", "isForeignNumber", "isShortCode", "isStandardLen",
    "isTollFree8800", "isGeographical", "isMobileRu", "isValidRuRange", "spoofingPrefixFlag",
    "digitEntropy", "repeatDigitRatio", "maxSameDigitRun", "beautifulNumberFlag", "prefixRisk",
    "callFrequency", "isNightTime", "recentBankApp", "recentGovApp", "recentMarketplaceApp",
    "recentMessengerApp", "previouslyRejected", "inBlacklist", "inAllowlist", "hiddenNumber",
    "callerVerifyFailed", "userVulnerability", "userBusinessActivity", "contactsAvailable",
    "usageAccessAvailable", "reputationScore", "sourceConfidence", "operatorMts",
    "operatorMegafon", "operatorBeeline", "operatorTele2", "operatorMvno", "defCodeRisk",
    "prefixBlockShare", "prefixWarnShare", "prefixSeenLog", "reviewsLog", "negativeRatio",
    "searchVolumeLog", "hasFraudCategory", "hasTelemarketingCategory", "noMetadata",
    "prefixBlockShare3", "prefixBlockShare7", "prefixEntropy", "defCodeOperatorRisk",
    "prefixSampleSize",
]

METADATA_COLUMNS = [
    "normalized_number", "label", "label_id", "weight", "source", "source_confidence",
    "negative_count", "positive_count", "neutral_count", "review_count", "negative_ratio",
    "positive_ratio", "search_volume", "search_volume_log", "review_velocity_48h",
    "review_velocity_7d", "has_fraud_category", "has_telemarketing_category",
    "has_finance_category", "number_type", "def_code", "operator", "region", "timezone_offset",
    "is_mvno", "source_reliability", "view_count", "view_count_log", "related_count",
    "detail_date",
]

COLD_MASK = [
    "inAllowlist", "inBlacklist", "reputationScore", "sourceConfidence", "reviewsLog",
    "negativeRatio", "searchVolumeLog", "hasFraudCategory", "hasTelemarketingCategory",
]

DEVICE_FEATURES = [
    "is_contact", "previously_rejected", "is_night_time", "is_weekend",
    "prev_missed_no_callback_24h", "prev_outgoing_after_missed", "recent_bank_app_30m",
    "recent_gov_app_30m", "recent_marketplace_app_30m", "recent_messenger_app_30m",
    "notif_bank_recent_10m", "notif_marketplace_recent_10m", "same_carrier_as_user",
    "is_short_code", "same_prefix_call_count_7d_norm", "answer_rate_for_number_norm",
    "hidden_number",
]
DEVICE_WEIGHTS = [
    -3.0, 2.0, 0.5, 0.0, 1.0, -1.5, 0.8, 0.5, 0.3, -0.2, 0.7, 0.3, -0.4, 0.0, 1.5, -1.5, 1.5,
]
DEVICE_BIAS = -0.5

RAW_REPUTATION_COLUMNS = [
    "normalized_number", "source", "negative_count", "positive_count", "neutral_count",
    "review_count", "search_volume", "categories", "last_review_at", "first_seen_at",
    "source_confidence", "source_reliability", "view_count", "related_count", "detail_date",
    "page_title", "url",
]

EMERGENCY_CODES = ["101", "102", "103", "104", "112"]
TOLLFREE_CODES = [800, 804]
MOBILE_CODES = (900, 999)
LANDLINE_CODES = [
    301, 302, 341, 342, 343, 345, 346, 347, 349, 351, 352, 353, 365, 381, 382, 383, 384, 385,
    388, 390, 391, 394, 395, 411, 413, 415, 416, 421, 422, 423, 424, 425, 426, 427, 471, 472,
    473, 474, 475, 481, 482, 483, 484, 485, 486, 487, 491, 492, 493, 494, 495, 496, 497, 498,
    499, 812, 813, 814, 815, 816, 817, 818, 820, 821, 822, 831, 833, 834, 835, 841, 842, 843,
    844, 845, 846, 847, 848, 851, 852, 853, 855, 861, 862, 863, 865, 866, 867, 871, 872, 873,
    877, 878, 879,
]
LEGACY_RISKY_MOBILE = [
    900, 901, 902, 903, 904, 905, 906, 908, 909, 950, 951, 952, 953, 958, 966, 969,
]
FAKE_NATIONAL_DIGITS = ["1234567890", "9876543210", "0000000000"]

FRAUD_WORDS = [
    "мошен", "фрод", "scam", "fraud", "фишинг", "вымог", "служба безопасности", "подозр",
    "обман", "карта", "банк мошен", "безопасности банка",
]
TELEMARKETING_WORDS = [
    "спам", "реклама", "телемаркетинг", "колл", "опрос", "робот", "робозвон", "навязы", "займ",
    "кредит", "мфо", "коллектор", "продажи",
]
FINANCE_WORDS = ["банк", "кредит", "займ", "мфо", "карта", "финанс", "страхов"]
COLD_CATEGORY_WORDS = [
    "мошен", "фрод", "scam", "fraud", "спам", "реклам", "телемаркет", "банк", "кредит", "займ",
    "мфо", "карта", "финанс", "страхов",
]
MVNO_WORDS = [
    "tinkoff", "тинькофф мобайл", "yota", "йота", "сбермобайл", "ростелеком",
    "газпромбанк мобайл", "втб мобайл", "алло инкогнито",
]
OPERATOR_RULES = [
    ("mts", ["мтс", "mts"]),
    ("megafon", ["мегафон", "megafon"]),
    ("beeline", ["билайн", "beeline", "вымпел"]),
    ("tele2", ["tele2", "теле2", "t2"]),
    ("mvno", MVNO_WORDS),
]
OPERATOR_BUCKETS = ["mts", "megafon", "beeline", "tele2", "mvno", "other", "unknown"]
UTC_OFFSET_RULES = [
    (12, ["камчат", "чукот"]),
    (11, ["магадан", "сахалин"]),
    (10, ["якут", "примор", "хабаров"]),
    (8, ["иркут", "бурят"]),
    (7, ["краснояр", "кемеров", "томск", "новосибир"]),
    (6, ["омск"]),
    (5, ["екатерин", "свердлов", "челябин", "перм", "тюмень"]),
    (4, ["самар", "саратов", "удмурт"]),
    (2, ["калининград"]),
]
UTC_OFFSET_DEFAULT = 3

CURATED_PREFIXES = [
    "+7800", "+7804", "+7844", "+7495", "+7499", "+7493", "+7494", "+7496", "+7498", "+7812",
    "+7900", "+7901", "+7902", "+7903", "+7904", "+7905", "+7906", "+7908", "+7909", "+7950",
    "+7951", "+7952", "+7953", "+7958", "+7966", "+7969",
]

REGISTRY_OPERATORS = [
    (["МТС", "МОБИЛЬНЫЕ ТЕЛЕСИСТЕМЫ"], "МТС"),
    (["ВЫМПЕЛКОМ", "BEELINE", "БИЛАЙН"], "Билайн"),
    (["МЕГАФОН"], "МегаФон"),
    (["Т2 МОБАЙЛ", "Т2МОБАЙЛ", "TELE2", "ТЕЛЕ2", "Т2-МОБАЙЛ", "ЕКАТЕРИНБУРГ-2000"], "Tele2"),
    (["РОСТЕЛЕКОМ", "БАШИНФОРМСВЯЗЬ"], "Ростелеком"),
    (["ТИНЬКОФФ", "ТИНКОФФ", "TINKOFF", "Т-МОБ"], "Т-Мобайл"),
    (["МОТИВ"], "Мотив"),
    (["СКАЙЛИНК", "SKYLINK"], "СкайЛинк"),
    (["YOTA", "ЙОТА", "СКАРТЕЛ"], "Yota"),
    (["СБЕРБАНК-ТЕЛЕКОМ", "СБЕРБАНК ТЕЛЕКОМ"], "СберМобайл"),
    (["ТРАНСТЕЛЕКОМ", "ТТК-"], "ТрансТелеКом"),
    (["ТАТТЕЛЕКОМ"], "ТатТелеКом"),
]
REGION_REWRITES = [
    (" - Кузбасс", ""),
    ("Москва и Московская область", "Москва и МО"),
    ("г. Санкт-Петербург и Ленинградская область", "СПб и ЛО"),
    ("Санкт-Петербург и Ленинградская область", "СПб и ЛО"),
    ("Ханты-Мансийский АО - Югра", "Ханты-Мансийский АО"),
    ("Чувашская Республика", "Чувашия"),
]

APP_CATEGORIES = [
    "BANK", "INVESTMENTS", "GOVERNMENT", "MARKETPLACE", "DELIVERY", "TRANSPORT", "TRAVEL",
    "HEALTH", "MESSENGER", "SOCIAL", "EMAIL", "NEWS", "MEDIA", "GAMES", "DATING", "EDUCATION",
    "BROWSER", "VPN", "PRODUCTIVITY", "OTHER",
]
APP_BUCKETS = {
    "BANK": "BANK", "INVESTMENTS": "BANK", "MARKETPLACE": "MARKETPLACE",
    "DELIVERY": "MARKETPLACE", "MESSENGER": "MESSENGER", "EMAIL": "EMAIL",
}

EVIDENCE_FRAUD = [
    "телефонное мошенничество", "мошен", "развод", "обман", "фишинг", "scam", "fraud",
    "служба безопасности", "безопасности банка", "cvv", "код из смс", "код смс", "данные карты",
    "карта", "банк мошен", "госуслуг", "персональные данные", "требуют деньги", "вымог",
    "украли", "списали", "деньги",
]
EVIDENCE_WARN = [
    "реклама", "спам", "нежелательный звонок", "нежелательное сообщение", "телемаркетинг",
    "опрос", "коллектор", "хулиганство", "угрозы", "робот", "робозвон", "автоответчик",
    "немой звонок", "молчок", "звонят и сбрасывают", "сбрасывают", "навязывают", "навязывание",
    "кредит", "займ", "мфо", "страховк", "предложения", "названивает",
]
EVIDENCE_POSITIVE = [
    "организация", "компания", "доставка", "поддержка", "официальный", "безопасный",
]
EVIDENCE_CATEGORIES = [
    "Телефонное мошенничество", "Реклама, спам", "Нежелательный звонок, сообщение",
    "Телефонное хулиганство, угрозы", "Опросы", "Коллекторы", "Другое", "Организация",
]
NEUTRAL_CATEGORIES = ["Другое", "Организация"]
SOURCE_RELIABILITY = {
    "spravportal": 0.86, "callfilter": 0.70, "zvonili": 0.62, "moshelovka": 0.95, "bloha": 0.75,
    "getscam": 0.55, "znomer": 0.55,
}

#: English column name -> header used in the files.
FIELD_TO_RU = {
    "normalized_number": "номер", "source": "источник", "label": "метка",
    "label_id": "id_метки", "weight": "вес", "label_hint": "подсказка_метки",
    "evidence_type": "тип_доказательства", "evidence_text": "текст_доказательства",
    "full_text": "полный_текст", "page_title": "заголовок_страницы",
    "negative_count": "негативных", "positive_count": "позитивных",
    "neutral_count": "нейтральных", "review_count": "отзывов", "view_count": "просмотров",
    "related_count": "связанных", "categories": "категории",
    "source_confidence": "уверенность_источника", "source_reliability": "надёжность_источника",
    "detail_date": "дата_детали", "fraud_hits": "мошеннических_совпадений",
    "warn_hits": "предупреждений", "url": "ссылка", "collected_at": "собрано",
    "search_volume": "объём_поиска", "search_volume_log": "лог_объёма_поиска",
    "last_review_at": "последний_отзыв", "first_seen_at": "первое_появление",
    "negative_ratio": "доля_негативных", "positive_ratio": "доля_позитивных",
    "review_velocity_48h": "скорость_отзывов_48ч", "review_velocity_7d": "скорость_отзывов_7д",
    "has_fraud_category": "есть_мошенничество",
    "has_telemarketing_category": "есть_телемаркетинг", "has_finance_category": "есть_финансы",
    "number_type": "тип_номера", "def_code": "деф_код", "operator": "оператор",
    "region": "регион", "timezone_offset": "смещение_часового_пояса", "is_mvno": "мвно",
    "view_count_log": "лог_просмотров", "isContact": "в_контактах",
    "isRussianNumber": "российский_номер", "isForeignNumber": "иностранный_номер",
    "isShortCode": "короткий_номер", "isStandardLen": "стандартная_длина",
    "isTollFree8800": "бесплатный_8800", "isGeographical": "географический",
    "isMobileRu": "мобильный_рф", "isValidRuRange": "валидный_диапазон_рф",
    "spoofingPrefixFlag": "флаг_подмены_префикса", "digitEntropy": "энтропия_цифр",
    "repeatDigitRatio": "доля_повторов_цифр", "maxSameDigitRun": "макс_повтор_цифры",
    "beautifulNumberFlag": "красивый_номер", "prefixRisk": "риск_префикса",
    "callFrequency": "частота_звонков", "isNightTime": "ночное_время",
    "recentBankApp": "недавнее_приложение_банка", "recentGovApp": "недавнее_приложение_госуслуг",
    "recentMarketplaceApp": "недавнее_приложение_маркетплейса",
    "recentMessengerApp": "недавнее_приложение_мессенджера",
    "previouslyRejected": "ранее_отклонён", "inBlacklist": "в_чёрном_списке",
    "inAllowlist": "в_белом_списке", "hiddenNumber": "скрытый_номер",
    "callerVerifyFailed": "проверка_звонящего_не_пройдена",
    "userVulnerability": "уязвимость_пользователя",
    "userBusinessActivity": "деловая_активность", "contactsAvailable": "контакты_доступны",
    "usageAccessAvailable": "доступ_к_использованию", "reputationScore": "рейтинг_репутации",
    "sourceConfidence": "уверенность_источника_компакт", "operatorMts": "оператор_мтс",
    "operatorMegafon": "оператор_мегафон", "operatorBeeline": "оператор_билайн",
    "operatorTele2": "оператор_теле2", "operatorMvno": "оператор_мвно",
    "defCodeRisk": "риск_деф_кода", "prefixBlockShare": "доля_блока_в_префиксе",
    "prefixWarnShare": "доля_предупр_в_префиксе", "prefixSeenLog": "лог_видимости_префикса",
    "reviewsLog": "лог_отзывов", "negativeRatio": "доля_негативных_компакт",
    "searchVolumeLog": "лог_объёма_поиска_компакт",
    "hasFraudCategory": "есть_мошенничество_компакт",
    "hasTelemarketingCategory": "есть_телемаркетинг_компакт", "noMetadata": "нет_метаданных",
    "prefixBlockShare3": "доля_блока_префикс3", "prefixBlockShare7": "доля_блока_префикс7",
    "prefixEntropy": "энтропия_лейблов_префикса",
    "defCodeOperatorRisk": "риск_деф_код_оператор",
    "prefixSampleSize": "размер_выборки_префикса",
}
RU_TO_FIELD = {ru: en for en, ru in FIELD_TO_RU.items()}

# ---------------------------------------------------------------------------
# Table shapes
# ---------------------------------------------------------------------------


def string_schema(columns: list[str]) -> T.StructType:
    """All files are read as text and coerced later."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


NUMBERING_PLAN = T.StructType([
    T.StructField("def_code", T.LongType()),
    T.StructField("start_number", T.LongType()),
    T.StructField("end_number", T.LongType()),
    T.StructField("operator", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("capacity", T.LongType()),
    T.StructField("number_type", T.StringType()),
])

CALL_EVENT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("user", T.LongType()),
    T.StructField("number", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("ts", T.LongType()),
])

LEGITIMATE_COLUMNS = [
    "normalized_number", "name", "category", "source", "city", "url", "source_confidence",
]
