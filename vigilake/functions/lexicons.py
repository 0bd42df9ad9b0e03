"""Keyword lists and scoring tables.

Everything in this module is a fixed value: the words, their order and their
weights decide results, so they are written out as plain literals. Operators
take them as default arguments and accept any other list of the same shape.
"""

# --- relevance -------------------------------------------------------------
RELEVANCE_WORDS = [
    "missile", "rocket", "drone", "uav", "air defense", "interceptor",
    "attack", "strike", "explosion", "blast", "bomb", "shelling",
    "siren", "alert", "warning", "evacuation", "shelter",
    "hostile", "enemy", "threat", "incursion", "infiltration",
    "casualties", "killed", "wounded", "injured", "dead",
    "idf", "gaza", "hamas", "hezbollah", "houthi",
    "iran", "israel", "palestine", "lebanon", "syria",
    "gulf", "uae", "saudi", "qatar", "bahrain", "kuwait", "oman",
    "yemen", "iraq", "jordan", "egypt", "turkey",
    "صاروخ", "طائرة", "مسيرة", "هجوم", "انفجار", "قصف",
    "تحذير", "إنذار", "دفاع", "عدو", "معادٍ",
]

# --- type lexicons: label -> keywords, first label that matches wins --------
EVENT_TYPES = {
    "missile": ["missile", "rocket", "ballistic"],
    "airstrike": ["air strike", "airstrike", "bombing", "bombed"],
    "drone": ["drone", "uav", "suicide drone"],
    "naval": ["ship", "vessel", "maritime", "navy", "houthi"],
    "cyber": ["cyber", "hack", "cyberattack"],
    "ground": ["ground", "infantry", "troop", "clash"],
    "explosion": ["explosion", "blast", "exploded"],
    "raid": ["raid", "operation", "strike"],
}
GROUPING_TYPES = {**EVENT_TYPES, "missile": ["missile", "rocket", "ballistic", "projectile"]}
INGEST_TYPES = {
    "missile": ["missile", "rocket", "صاروخ"],
    "drone": ["drone", "uav", "مسيرة", "طائرة"],
    "air_defense": ["air defense", "interceptor", "دفاع"],
    "explosion": ["explosion", "blast", "bomb", "انفجار"],
    "alert": ["siren", "alert", "warning", "تحذير", "إنذار"],
    "attack": ["attack", "strike", "هجوم", "قصف"],
}
STATS_TYPES = {
    "missile": ["missile", "rocket", "ballistic", "intercepted", "iron dome", "patriot"],
    "airstrike": ["airstrike", "air strike", "bombing", "bombed", "warplanes", "jets"],
    "drone": ["drone", "uav", "suicide drone", "loitering munition", "quadcopter"],
}
STATS_TYPE_CONFIDENCE = {"missile": 0.9, "airstrike": 0.85, "drone": 0.8, "general": 0.5}
STATUS_WORDS = {
    "confirmed": ["confirmed", "official", "verify"],
    "reported": ["reported", "claim", "alleged"],
}

# --- places ----------------------------------------------------------------
SIGNATURE_PLACES = [
    "tehran", "iran", "israel", "gaza", "lebanon", "beirut",
    "baghdad", "iraq", "syria", "damascus", "yemen", "saudi",
    "uae", "dubai", "qatar", "bahrain", "kuwait", "oman",
    "gulf", "red sea", "mediterranean", "strait of hormuz",
]
GROUPING_PLACES = [
    "tehran", "iran", "israel", "gaza", "lebanon", "beirut",
    "baghdad", "iraq", "syria", "damascus", "yemen", "saudi",
    "uae", "dubai", "abu dhabi", "qatar", "doha", "bahrain",
    "kuwait", "oman", "muscat", "jordan", "amman",
]
COUNTRY_MENTIONS = {
    "iran": ["iran", "tehran", "iranian", "irgc"],
    "israel": ["israel", "tel aviv", "jerusalem", "israeli", "idf"],
    "palestine": ["palestine", "palestinian", "west bank"],
    "gaza": ["gaza", "gazan"],
    "lebanon": ["lebanon", "lebanese", "beirut"],
    "syria": ["syria", "syrian", "damascus"],
    "yemen": ["yemen", "yemeni", "sanaa", "houthi", "houthis"],
    "saudi": ["saudi", "saudi arabia", "riyadh", "ksa"],
    "uae": ["uae", "emirates", "dubai", "abu dhabi", "emirati"],
    "jordan": ["jordan", "jordanian", "amman"],
    "iraq": ["iraq", "iraqi", "baghdad"],
    "kuwait": ["kuwait", "kuwaiti"],
    "bahrain": ["bahrain", "bahraini"],
    "qatar": ["qatar", "qatari", "doha"],
    "oman": ["oman", "omani", "muscat"],
}
# (country, lat above, lat below, lng above, lng below); first box that holds wins
COUNTRY_BOXES = [
    ("iran", 24.0, 40.0, 44.0, 63.0),
    ("israel", 29.0, 34.0, 34.0, 36.0),
    ("gaza", 31.0, 32.0, 34.0, 35.0),
]

# --- recap score -----------------------------------------------------------
RECAP_PHRASES = [
    ("weekly roundup", 2.0), ("weekly wrap", 2.0), ("weekly summary", 2.0),
    ("death toll rises", 2.0), ("casualties mount", 2.0), ("toll reaches", 2.0),
    ("total now stands", 2.0), ("cumulative total", 2.0),
    ("recap", 1.5), ("roundup", 1.5), ("wrap-up", 1.5), ("wrap up", 1.5),
    ("summary of", 1.5), ("this week", 1.5), ("last week", 1.5),
    ("update", 1.0), ("summary", 1.0), ("wrap", 1.0),
    ("over the past", 1.0), ("in the last", 1.0), ("week of", 1.0),
    ("since january", 1.0), ("since february", 1.0), ("since march", 1.0),
    ("latest count", 1.0), ("total now", 1.0), ("cumulative", 1.0),
    ("have died", 1.0), ("killed in", 1.0),
]
RECAP_PATTERNS = [
    r"\d+\s+(days?|weeks?|months?)",
    r"since\s+(january|february|march|april|may|june|july|august|september|october|november|december)",
    r"over\s+the\s+past",
    r"in\s+the\s+last\s+\d+",
]
RECAP_MANY_PLACES = 3
RECAP_MANY_PLACES_WEIGHT = 1.5
RECAP_PATTERN_WEIGHT = 1.0
RECAP_FLAG_AT = 2.5
RECAP_DROP_ABOVE = 3.0

# --- article confidence: (points, column, words) ----------------------------
CONFIDENCE_POINTS = [
    (40, "source", ["ministry", "defence", "defense", "military", "army", "idf", "forces", "government"]),
    (30, "source", ["reuters", "bbc", "associated press", "al jazeera", "france24", "dw"]),
    (20, "source", ["national", "times of israel", "jerusalem post", "gulf news", "arab news"]),
    (15, "title", ["confirmed", "verify", "officials say", "authorities say",
                   "according to", "reported that", "sources say"]),
]
CONFIDENCE_LEVELS = [(70, "VERIFIED"), (50, "LIKELY"), (30, "PARTIAL")]

# --- source tiers ----------------------------------------------------------
MAJOR_NEWS = ["reuters", "bbc", "associated press", "ap", "al jazeera",
              "france24", "dw", "times of israel", "jerusalem post"]
REGIONAL_NEWS = ["the national", "gulf news", "khaleej times", "arab news",
                 "egypt today", "jordan times", "defense news"]
TIER_WEIGHTS = {"government": 50, "major_news": 40, "regional_news": 30, "social": 10}
RELIABILITY_GROUPS = {
    "Government": ["ministry", "defense", "moi", "idf", "government", "official"],
    "Major News": ["reuters", "bbc", "ap", "al jazeera", "france24", "dw"],
    "Regional News": ["news", "times", "post", "agency"],
}

# --- casualties ------------------------------------------------------------
CASUALTY_PATTERNS_MAX = [
    r"(\d+)\s+(?:killed|dead|martyred|died)",
    r"(\d+)\s+(?:wounded|injured|hurt)",
    r"(\d+)\s+(?:casualties|casualty)",
    r"(?:killed|dead|martyred|died)[:\s]+(\d+)",
    r"(?:wounded|injured|hurt)[:\s]+(\d+)",
    r"(?:death toll|toll)(?:\s+rises?\s+to|\s*:\s*|\s+of)\s*(\d+)",
    r"(\d+)\s+(?:people|persons|palestinians|israelis|iranians|civilians|soldiers|troops)?\s*(?:were\s+)?(?:killed|dead|injured|wounded)",
]
CASUALTY_PATTERNS_SUM = [
    r"(\d+)\s+(?:killed|dead|martyred|died)",
    r"(\d+)\s+(?:wounded|injured|hurt)",
    r"(\d+)\s+(?:casualties|casualty)",
    r"(?:killed|dead|martyred)\s+(\d+)",
]
MILITARY_CONTEXT_MAX = ["soldier", "military", "army", "forces", "troops", "idf", "irgc", "combatant"]
MILITARY_CONTEXT_SUM = ["soldier", "military", "army", "forces", "troops", "idf", "irgc"]

# --- sentiment -------------------------------------------------------------
POSITIVE_WORDS = [
    "victory", "success", "peace", "deal", "agreement", "alliance", "support",
    "strong", "win", "advance", "achievement", "celebration", "historic",
    "cooperation", "collaboration", "partnership", "stability", "progress",
    "development", "growth", "prosperity", "security", "defense", "protection",
    "triumph", "liberation",
]
NEGATIVE_WORDS = [
    "attack", "threat", "war", "crisis", "conflict", "death", "killed",
    "destroyed", "terrorism", "explosion", "missile", "drone", "strike",
    "violence", "terror", "warning", "alert", "emergency", "disaster",
    "tragedy", "casualties", "injured", "detained", "arrested", "sanctions",
    "condemn", "rejected",
]
CRITICAL_WORDS = [
    "nuclear", "ballistic", "missile", "launch", "weapon", "military", "army",
    "navy", "air force", "corvette", "frigate", "destroyer", "submarine",
    "aircraft carrier", "drone", "uav", "rocket", "artillery", "tank",
    "soldier", "troops", "warfighter",
]

# --- actors and actions, first match wins -----------------------------------
ACTORS = {
    "houthi": ["houthi", "houthis"],
    "israel": ["israel", "israeli", "idf"],
    "iran": ["iran", "iranian", "irgc"],
    "saudi": ["saudi", "arabia", "ksa"],
    "uae": ["uae", "emirates", "emirati"],
    "us": ["us", "usa", "american", "pentagon"],
    "uk": ["uk", "british", "britain"],
    "yemen": ["yemen", "yemeni"],
    "hezbollah": ["hezbollah", "hizbullah"],
    "hamas": ["hamas"],
    "isis": ["isis", "islamic state", "daesh"],
}
ACTIONS = {
    "strike": ["strike", "strikes", "struck", "attack", "attacks", "attacked"],
    "drone": ["drone", "drones", "uav"],
    "missile": ["missile", "missiles", "rocket", "rockets", "ballistic"],
    "intercept": ["intercept", "intercepted", "shot down", "destroyed"],
    "bomb": ["bomb", "bombing", "explosion", "explosive"],
    "naval": ["naval", "ship", "ships", "vessel", "houthi ship"],
    "sanction": ["sanction", "sanctions", "embargo"],
    "deploy": ["deploy", "deployment", "deployed", "troops", "forces"],
}

# --- post threats (the list keeps its repeated word and leading space) -------
THREAT_WORDS = [
    "missile", "attack", "strike", "drone", "explosion", "alert",
    "security", "defense", "military", "forces", "aircraft", "jet",
    "launch", "intercept", "defense", "threat", "warning", " sirens",
    "shelling", "bombing", "terrorism", "incident", "breach", "infiltration",
]

# --- defence dashboard -----------------------------------------------------
DEFENSE_TYPES = ["missile", "air_defense", "drone", "attack"]
DEFENSE_WORDS = ["missile", "rocket", "ballistic", "intercept",
                 "air defense", "shot down", "drone", "uav"]
INTERCEPTION_WORDS = [
    "intercepted", "shot down", "downed", "destroyed", "neutralized",
    "air defense", "patriot", "thaad", "iron dome", "arrow",
    "successfully intercepted", "defense system", "intercept",
]
IMPACT_TYPES = ["missile", "attack"]
IMPACT_WORDS = ["impact", "hit", "strike"]
BALLISTIC_WORDS = ["missile", "ballistic", "rocket"]
DRONE_WORDS = ["drone", "uav"]

# --- severity and intensity ------------------------------------------------
HIGH_SEVERITY_WORDS = ["killed", "death", "attack"]
MEDIUM_SEVERITY_WORDS = ["intercept", "defense"]
INTENSITY_WEIGHTS = {"missile": 4, "airstrike": 4, "attack": 4, "explosion": 3,
                     "drone": 3, "air_defense": 2, "security": 1, "alert": 1}
SEVERITY_MULTIPLIERS = {"critical": 3.0, "high": 2.0, "medium": 1.5, "low": 1.0}
INTENSITY_MAX_PER_ROW = 12
INTENSITY_SCALE = 0.3

# --- response timeline -----------------------------------------------------
PHASES = ["observe", "orient", "decide", "act"]
PHASE_BASES = {
    "high": {"observe": 2, "orient": 5, "decide": 15, "act": 5},
    "medium": {"observe": 5, "orient": 15, "decide": 45, "act": 15},
    "low": {"observe": 15, "orient": 30, "decide": 120, "act": 30},
}
ACTOR_MODIFIERS = [
    (r"israel|idf|us|usa|american|british|uk|french|france", 0.5),
    (r"houthi|hezbollah|hamas|isis|isil|iranian|irgc", 1.2),
]
THREAT_MODIFIERS = [
    (r"missile|ballistic|rocket", 0.3),
    (r"drone|uav", 0.5),
    (r"attack|strike|raid", 0.7),
]
IDEAL_RESPONSE_MINUTES = 27

# --- report reasons --------------------------------------------------------
REPORT_REASONS = {
    "false_info": "False or misleading information",
    "wrong_location": "Wrong location",
    "outdated": "Outdated (already resolved)",
    "duplicate": "Duplicate of another incident",
    "wrong_title": "Misleading headline",
}
HIDE_AT_REPORTS = 5

# --- URL cleansing ---------------------------------------------------------
DANGEROUS_SCHEMES = ["javascript:", "data:", "vbscript:", "file:", "about:",
                     "chrome:", "livescript:", "mocha:"]
ALLOWED_SCHEMES = ["http://", "https://", "ftp://", "ftps://", "mailto:"]
