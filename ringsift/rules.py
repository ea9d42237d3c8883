"""Fixed rule tables, in the order in which they are tried. Values must equal the source system's."""

# Word in a package name -> app category.
PACKAGE_WORDS = [
    (".bank", "BANK"), ("bank.", "BANK"), ("banking", "BANK"), (".pay", "BANK"), ("wallet", "BANK"),
    ("broker", "INVESTMENTS"), ("invest", "INVESTMENTS"), ("trading", "INVESTMENTS"),
    ("crypto", "INVESTMENTS"), ("exchange", "INVESTMENTS"), ("binance", "INVESTMENTS"),
    ("gosuslug", "GOVERNMENT"), (".gov", "GOVERNMENT"), ("government", "GOVERNMENT"),
    (".fns", "GOVERNMENT"), (".fssp", "GOVERNMENT"), (".mvd", "GOVERNMENT"), ("shop", "MARKETPLACE"),
    ("market", "MARKETPLACE"), ("wildberries", "MARKETPLACE"), ("ozon", "MARKETPLACE"),
    ("delivery", "DELIVERY"), ("doordash", "DELIVERY"), ("ubereats", "DELIVERY"),
    ("samokat", "DELIVERY"), ("lavka", "DELIVERY"), (".eda", "DELIVERY"), (".pizza", "DELIVERY"),
    ("taxi", "TRANSPORT"), (".uber", "TRANSPORT"), ("yandex.taxi", "TRANSPORT"),
    ("rideshare", "TRANSPORT"), ("scooter", "TRANSPORT"), ("booking", "TRAVEL"), ("airline", "TRAVEL"),
    ("aviasales", "TRAVEL"), ("trip", "TRAVEL"), ("hotel", "TRAVEL"), ("flight", "TRAVEL"),
    ("messenger", "MESSENGER"), ("messaging", "MESSENGER"), ("whatsapp", "MESSENGER"),
    ("telegram", "MESSENGER"), ("viber", "MESSENGER"), ("signal", "MESSENGER"), (".chat", "MESSENGER"),
    ("vkontakte", "SOCIAL"), ("instagram", "SOCIAL"), ("twitter", "SOCIAL"), ("tiktok", "SOCIAL"),
    ("facebook", "SOCIAL"), ("snapchat", "SOCIAL"), ("mail", "EMAIL"), ("outlook", "EMAIL"),
    ("news", "NEWS"), (".rbc", "NEWS"), ("lenta", "NEWS"), ("youtube", "MEDIA"), ("kinopoisk", "MEDIA"),
    (".music", "MEDIA"), (".video", "MEDIA"), ("spotify", "MEDIA"), ("twitch", "MEDIA"),
    ("browser", "BROWSER"), ("chrome", "BROWSER"), ("firefox", "BROWSER"), ("opera", "BROWSER"),
    ("edge", "BROWSER"), ("vpn", "VPN"), ("doctor", "HEALTH"), ("health", "HEALTH"),
    ("medsi", "HEALTH"), ("fitness", "HEALTH"), ("dating", "DATING"), ("tinder", "DATING"),
    ("mamba", "DATING"), ("edu.", "EDUCATION"), ("english", "EDUCATION"), ("duolingo", "EDUCATION"),
    ("skyeng", "EDUCATION"), ("lessons", "EDUCATION"), ("calendar", "PRODUCTIVITY"),
    ("todoist", "PRODUCTIVITY"), ("notion", "PRODUCTIVITY"), ("evernote", "PRODUCTIVITY"),
    (".game", "GAMES"), ("games", "GAMES"), ("playrix", "GAMES"), ("nexters", "GAMES"),
    ("supercell", "GAMES"), ("tencent", "GAMES"),
]

# Word in an app label -> app category.
LABEL_WORDS = [
    ("банк", "BANK"), ("карта", "BANK"), ("оплата", "BANK"), ("инвест", "INVESTMENTS"),
    ("брокер", "INVESTMENTS"), ("госуслуг", "GOVERNMENT"), ("налог", "GOVERNMENT"),
    ("магазин", "MARKETPLACE"), ("доставк", "DELIVERY"), ("такси", "TRANSPORT"),
    ("месенджер", "MESSENGER"), ("мессенджер", "MESSENGER"), ("почта", "EMAIL"), ("новост", "NEWS"),
    ("клиник", "HEALTH"), ("доктор", "HEALTH"), ("знакомств", "DATING"), ("обучен", "EDUCATION"),
    ("образован", "EDUCATION"), ("браузер", "BROWSER"), ("видео", "MEDIA"), ("музык", "MEDIA"),
    ("игр", "GAMES"), ("vpn", "VPN"), ("путешеств", "TRAVEL"), ("перелёт", "TRAVEL"),
    ("отель", "TRAVEL"),
]

# Word in an organisation type -> category, confidence.
ORGANISATION_WORDS = [
    ("hospital", "medical", 0.95), ("больниц", "medical", 0.95), ("clinic", "medical", 0.94),
    ("поликлиник", "medical", 0.95), ("university", "education", 0.93), ("институт", "education", 0.92),
    ("университет", "education", 0.93), ("школ", "education", 0.92), ("school", "education", 0.92),
    ("library", "education", 0.9), ("библиотек", "education", 0.9), ("museum", "tourism", 0.92),
    ("музей", "tourism", 0.92), ("government", "gov", 0.95), ("министерств", "gov", 0.95),
    ("федеральн", "gov", 0.95), ("агентство", "gov", 0.92), ("embassy", "gov", 0.93),
    ("посольств", "gov", 0.93), ("police", "gov", 0.95), ("court", "gov", 0.93), ("суд", "gov", 0.93),
    ("bank", "bank", 0.93), ("банк", "bank", 0.93), ("insurance", "insurance", 0.85),
    ("страхов", "insurance", 0.85), ("hotel", "tourism", 0.85), ("отел", "tourism", 0.85),
    ("гостиниц", "tourism", 0.85), ("theatre", "tourism", 0.9), ("театр", "tourism", 0.9),
    ("airline", "official", 0.92), ("авиакомпан", "official", 0.92), ("railway", "official", 0.92),
    ("телеком", "official", 0.92), ("telecom", "official", 0.92), ("стадион", "sport", 0.85),
    ("stadium", "sport", 0.85), ("agency", "gov", 0.85),
]

# Fixed values: (category, tag key, tag value, feature, confidence); * is any value.
TAG_RULES = [
    ("medical", "amenity", "hospital", "medical", 0.95),
    ("medical", "amenity", "clinic", "medical", 0.95),
    ("medical", "amenity", "doctors", "medical", 0.93),
    ("medical", "amenity", "dentist", "medical", 0.92),
    ("medical", "amenity", "pharmacy", "medical", 0.9),
    ("medical", "amenity", "veterinary", "medical", 0.88),
    ("medical", "healthcare", "*", "medical", 0.93),
    ("education", "amenity", "school", "education", 0.92),
    ("education", "amenity", "university", "education", 0.93),
    ("education", "amenity", "college", "education", 0.91),
    ("education", "amenity", "kindergarten", "education", 0.92),
    ("education", "amenity", "library", "education", 0.9),
    ("education", "amenity", "childcare", "education", 0.88),
    ("education", "amenity", "driving_school", "education", 0.85),
    ("education", "amenity", "language_school", "education", 0.85),
    ("gov", "amenity", "police", "gov", 0.95),
    ("gov", "amenity", "post_office", "gov", 0.93),
    ("gov", "amenity", "townhall", "gov", 0.95),
    ("gov", "amenity", "courthouse", "gov", 0.95),
    ("gov", "amenity", "fire_station", "gov", 0.95),
    ("gov", "amenity", "embassy", "gov", 0.93),
    ("gov", "office", "government", "gov", 0.92),
    ("gov", "office", "lawyer", "gov", 0.85),
    ("gov", "office", "notary", "gov", 0.88),
    ("gov", "office", "tax_advisor", "gov", 0.85),
    ("gov", "office", "advocate", "gov", 0.85),
    ("gov", "office", "ngo", "gov", 0.83),
    ("finance", "amenity", "bank", "bank", 0.93),
    ("finance", "amenity", "bureau_de_change", "bank", 0.85),
    ("finance", "amenity", "money_transfer", "bank", 0.85),
    ("finance", "office", "insurance", "insurance", 0.83),
    ("finance", "office", "financial", "bank", 0.85),
    ("tourism", "tourism", "hotel", "tourism", 0.85),
    ("tourism", "tourism", "hostel", "tourism", 0.83),
    ("tourism", "tourism", "guest_house", "tourism", 0.82),
    ("tourism", "tourism", "motel", "tourism", 0.82),
    ("tourism", "tourism", "museum", "tourism", 0.9),
    ("tourism", "tourism", "attraction", "tourism", 0.8),
    ("tourism", "tourism", "information", "tourism", 0.85),
    ("retail", "shop", "supermarket", "retail", 0.82),
    ("retail", "shop", "mall", "retail", 0.8),
    ("retail", "shop", "department_store", "retail", 0.8),
    ("retail", "shop", "car", "retail", 0.78),
    ("retail", "shop", "car_repair", "autoservice", 0.78),
    ("retail", "shop", "electronics", "retail", 0.78),
    ("retail", "shop", "furniture", "retail", 0.78),
    ("retail", "shop", "hardware", "retail", 0.78),
    ("retail", "shop", "optician", "retail", 0.8),
    ("retail", "shop", "jewelry", "retail", 0.78),
    ("retail", "shop", "bicycle", "retail", 0.78),
    ("food", "amenity", "restaurant", "restaurant", 0.8),
    ("food", "amenity", "cafe", "restaurant", 0.78),
    ("food", "amenity", "fast_food", "restaurant", 0.78),
    ("food", "amenity", "food_court", "restaurant", 0.78),
    ("food", "amenity", "bar", "restaurant", 0.75),
    ("food", "amenity", "pub", "restaurant", 0.75),
    ("auto", "amenity", "fuel", "autoservice", 0.88),
    ("auto", "amenity", "car_wash", "autoservice", 0.83),
    ("auto", "amenity", "charging_station", "autoservice", 0.85),
    ("auto", "amenity", "car_rental", "autoservice", 0.83),
    ("auto", "amenity", "car_sharing", "autoservice", 0.83),
    ("sport", "leisure", "fitness_centre", "sport", 0.82),
    ("sport", "leisure", "sports_centre", "sport", 0.82),
    ("sport", "leisure", "swimming_pool", "sport", 0.82),
    ("sport", "leisure", "stadium", "sport", 0.85),
    ("sport", "leisure", "sports_hall", "sport", 0.82),
    ("office_other", "office", "company", "office", 0.83),
    ("office_other", "office", "coworking", "office", 0.8),
    ("office_other", "office", "consulting", "office", 0.83),
    ("office_other", "office", "estate_agent", "realestate", 0.78),
    ("office_other", "office", "it", "office", 0.85),
    ("office_other", "office", "telecommunication", "office", 0.88),
    ("office_other", "office", "employment_agency", "office", 0.78),
    ("office_other", "office", "accountant", "office", 0.83),
    ("office_other", "office", "architect", "office", 0.83),
    ("office_other", "office", "educational_institution", "education", 0.88),
    ("office_other", "office", "logistics", "office", 0.83),
    ("office_other", "office", "research", "office", 0.85),
    ("office_other", "office", "travel_agent", "office", 0.78),
    ("office_other", "office", "private_postal_service", "office", 0.8),
    ("office_other", "office", "newspaper", "office", 0.82),
    ("office_other", "office", "tutoring", "education", 0.78),
    ("office_other", "office", "water_utility", "gov", 0.85),
    ("office_other", "office", "visa", "gov", 0.8),
    ("office_other", "office", "guide", "tourism", 0.78),
    ("office_other", "office", "union", "office", 0.78),
    ("office_other", "office", "yes", "office", 0.72),
    ("craft", "craft", "*", "craft", 0.78),
    ("public_transport", "public_transport", "station", "official", 0.85),
    ("public_transport", "railway", "station", "official", 0.85),
    ("public_transport", "aeroway", "aerodrome", "official", 0.9),
    ("public_transport", "aeroway", "terminal", "official", 0.9),
    ("public_transport", "amenity", "taxi", "official", 0.78),
    ("public_transport", "amenity", "bus_station", "official", 0.85),
    ("public_transport", "amenity", "ferry_terminal", "official", 0.85),
    ("shop_extended", "shop", "clothes", "retail", 0.78),
    ("shop_extended", "shop", "shoes", "retail", 0.78),
    ("shop_extended", "shop", "beauty", "beauty", 0.78),
    ("shop_extended", "shop", "hairdresser", "beauty", 0.78),
    ("shop_extended", "shop", "cosmetics", "beauty", 0.78),
    ("shop_extended", "shop", "florist", "retail", 0.78),
    ("shop_extended", "shop", "gift", "retail", 0.78),
    ("shop_extended", "shop", "sports", "retail", 0.78),
    ("shop_extended", "shop", "toys", "retail", 0.78),
    ("shop_extended", "shop", "books", "retail", 0.78),
    ("shop_extended", "shop", "kiosk", "retail", 0.74),
    ("shop_extended", "shop", "convenience", "retail", 0.74),
    ("shop_extended", "shop", "butcher", "retail", 0.78),
    ("shop_extended", "shop", "bakery", "retail", 0.78),
    ("shop_extended", "shop", "beverages", "retail", 0.78),
    ("shop_extended", "shop", "wine", "retail", 0.78),
    ("shop_extended", "shop", "alcohol", "retail", 0.74),
    ("shop_extended", "shop", "tobacco", "retail", 0.74),
    ("shop_extended", "shop", "travel_agency", "tourism", 0.8),
    ("shop_extended", "shop", "mobile_phone", "retail", 0.78),
    ("shop_extended", "shop", "computer", "retail", 0.78),
    ("shop_extended", "shop", "tea", "retail", 0.78),
    ("shop_extended", "shop", "coffee", "retail", 0.78),
    ("shop_extended", "shop", "pastry", "retail", 0.78),
    ("shop_extended", "shop", "baby_goods", "retail", 0.78),
    ("shop_extended", "shop", "pet", "retail", 0.78),
    ("shop_extended", "shop", "paint", "retail", 0.78),
    ("shop_extended", "shop", "tyres", "autoservice", 0.78),
    ("shop_extended", "shop", "motorcycle", "retail", 0.78),
    ("shop_extended", "shop", "massage", "beauty", 0.78),
    ("shop_extended", "shop", "tattoo", "beauty", 0.74),
    ("shop_extended", "shop", "photo", "retail", 0.78),
    ("shop_extended", "shop", "art", "retail", 0.78),
    ("shop_extended", "shop", "antiques", "retail", 0.78),
    ("shop_extended", "shop", "musical_instrument", "retail", 0.78),
    ("shop_extended", "shop", "video_games", "retail", 0.78),
    ("shop_extended", "shop", "bag", "retail", 0.78),
    ("amenity_extended", "amenity", "community_centre", "gov", 0.85),
    ("amenity_extended", "amenity", "social_facility", "gov", 0.85),
    ("amenity_extended", "amenity", "social_centre", "gov", 0.85),
    ("amenity_extended", "amenity", "place_of_worship", "religious", 0.78),
    ("amenity_extended", "amenity", "cinema", "tourism", 0.82),
    ("amenity_extended", "amenity", "theatre", "tourism", 0.85),
    ("amenity_extended", "amenity", "arts_centre", "tourism", 0.82),
    ("amenity_extended", "amenity", "nightclub", "restaurant", 0.74),
    ("amenity_extended", "amenity", "events_venue", "tourism", 0.8),
    ("amenity_extended", "amenity", "studio", "office", 0.78),
    ("amenity_extended", "amenity", "spa", "beauty", 0.78),
]

# Tags that hint at an organisation, a name, an address, or at neither.
ORGANISATION_TAGS = [
    "amenity", "shop", "office", "tourism", "leisure", "craft", "healthcare", "industrial", "building",
    "public_transport", "aeroway", "historic", "man_made", "club", "emergency", "landuse",
]
NAME_TAGS = ["name", "name:ru", "official_name"]
ADDRESS_TAGS = ["addr:street", "addr:housenumber", "addr:city", "addr:full", "addr:place"]
NEGATIVE_TAGS = [
    ("amenity", "bench"), ("amenity", "waste_basket"), ("amenity", "recycling"),
    ("amenity", "parking_space"), ("amenity", "vending_machine"), ("highway", "street_lamp"),
    ("emergency", "fire_hydrant"), ("barrier", "*"),
]

# Fixed values: (question, answer, axis, points) of the questionnaire.
PROFILE_AXES = [
    "vulnerability", "business", "digital", "ads", "spam_tolerance", "false_alarm", "awareness",
]
PROFILE_POINTS = [
    ("age", "UNDER_25", "awareness", 10), ("age", "RANGE_25_40", "awareness", 5),
    ("age", "RANGE_40_60", "vulnerability", 15), ("age", "OVER_60", "vulnerability", 40),
    ("age", "OVER_60", "awareness", -10),
    ("occupation", "OFFICE", "business", 10), ("occupation", "FREELANCE", "business", 15),
    ("occupation", "ENTREPRENEUR", "business", 30), ("occupation", "ENTREPRENEUR", "digital", 10),
    ("occupation", "PENSIONER", "vulnerability", 20), ("occupation", "STUDENT", "digital", 10),
    ("occupation", "STUDENT", "awareness", 5),
    ("work_calls", "YES", "business", 25), ("work_calls", "SOMETIMES", "business", 10),
    ("mobile_banking", "YES", "digital", 15),
    ("bank_apps", "ONE_TWO", "digital", 10), ("bank_apps", "THREE_PLUS", "digital", 20),
    ("bank_apps", "THREE_PLUS", "vulnerability", 5),
    ("online_purchases", "OFTEN", "digital", 15), ("online_purchases", "SOMETIMES", "digital", 5),
    ("marketplaces", "YES", "digital", 10), ("marketplaces", "YES", "ads", 5),
    ("ads_posting", "OFTEN", "ads", 25), ("ads_posting", "SOMETIMES", "ads", 10),
    ("delivery", "OFTEN", "ads", 15), ("delivery", "SOMETIMES", "ads", 5),
    ("whatsapp", "YES", "digital", 5), ("telegram", "YES", "digital", 5),
    ("telegram", "YES", "awareness", 5), ("stranger_calls", "YES", "vulnerability", 5),
    ("spam_frequency", "EVERY_DAY", "spam_tolerance", 10),
    ("spam_frequency", "SEVERAL_WEEK", "spam_tolerance", 5),
    ("scam_experience", "LOST_MONEY", "vulnerability", 30),
    ("scam_experience", "LOST_MONEY", "false_alarm", -10),
    ("scam_experience", "CAUGHT_IN_TIME", "vulnerability", 10),
    ("scam_experience", "CAUGHT_IN_TIME", "awareness", 10),
    ("scam_awareness", "GOOD", "awareness", 25), ("scam_awareness", "NONE", "vulnerability", 15),
    ("scam_awareness", "NONE", "awareness", -15),
    ("priority", "DONT_MISS", "false_alarm", 25), ("priority", "NO_SPAM", "spam_tolerance", 25),
    ("answer_strangers", "ALWAYS", "business", 10), ("answer_strangers", "NEVER", "spam_tolerance", 10),
    ("auto_block", "BLOCK", "spam_tolerance", 20), ("auto_block", "DECIDE_EACH", "false_alarm", 10),
    ("had_false_block", "YES", "false_alarm", 30),
]
