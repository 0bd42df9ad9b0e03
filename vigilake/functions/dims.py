"""Seed dimension tables (fixed values) and the helper that turns them into
small DataFrames. Every table here is bounded by this file; a caller may pass
any DataFrame with the same columns instead, in which case Spark's own
size-based choice decides between a broadcast and a shuffle join."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SEED_ROW_LIMIT = 1000

COUNTRY_COLUMNS = ("code", "name", "iso2", "flag")
COUNTRIES = [
    ("iran", "Iran", "IR", "🇮🇷"),
    ("israel", "Israel", "IL", "🇮🇱"),
    ("palestine", "Palestine", "PS", "🇵🇸"),
    ("gaza", "Gaza", "PS", "🇵🇸"),
    ("lebanon", "Lebanon", "LB", "🇱🇧"),
    ("syria", "Syria", "SY", "🇸🇾"),
    ("yemen", "Yemen", "YE", "🇾🇪"),
    ("saudi", "Saudi Arabia", "SA", "🇸🇦"),
    ("uae", "UAE", "AE", "🇦🇪"),
    ("jordan", "Jordan", "JO", "🇯🇴"),
    ("iraq", "Iraq", "IQ", "🇮🇶"),
    ("kuwait", "Kuwait", "KW", "🇰🇼"),
    ("bahrain", "Bahrain", "BH", "🇧🇭"),
    ("qatar", "Qatar", "QA", "🇶🇦"),
    ("oman", "Oman", "OM", "🇴🇲"),
]
HEAT_COUNTRIES = ["uae", "saudi", "qatar", "bahrain", "kuwait", "oman", "israel",
                  "palestine", "lebanon", "syria", "iraq", "jordan", "egypt",
                  "yemen", "iran"]
DEFENSE_COUNTRIES = ["uae", "saudi", "qatar", "bahrain", "kuwait", "israel", "iran"]

# lower-cased country name -> code
COUNTRY_ALIASES = [
    ("uae", "uae"), ("united arab emirates", "uae"),
    ("saudi", "saudi"), ("saudi arabia", "saudi"),
    ("qatar", "qatar"), ("bahrain", "bahrain"), ("kuwait", "kuwait"),
    ("oman", "oman"), ("israel", "israel"), ("iran", "iran"),
    ("lebanon", "lebanon"), ("palestine", "palestine"), ("syria", "syria"),
    ("yemen", "yemen"), ("iraq", "iraq"), ("jordan", "jordan"),
    ("egypt", "egypt"), ("gaza", "gaza"),
]
DISPLAY_NAMES = [
    ("uae", "🇦🇪 United Arab Emirates"), ("saudi", "🇸🇦 Saudi Arabia"),
    ("qatar", "🇶🇦 Qatar"), ("bahrain", "🇧🇭 Bahrain"), ("kuwait", "🇰🇼 Kuwait"),
    ("oman", "🇴🇲 Oman"), ("israel", "🇮🇱 Israel"), ("iran", "🇮🇷 Iran"),
]
ISO_NAMES = [
    ("IR", "Iran"), ("IQ", "Iraq"), ("SA", "Saudi Arabia"), ("AE", "UAE"),
    ("YE", "Yemen"), ("SY", "Syria"), ("IL", "Israel"), ("JO", "Jordan"),
    ("LB", "Lebanon"), ("KW", "Kuwait"), ("QA", "Qatar"), ("BH", "Bahrain"),
    ("OM", "Oman"), ("EG", "Egypt"), ("TR", "Turkey"), ("US", "United States"),
    ("RU", "Russia"), ("CN", "China"), ("GB", "United Kingdom"), ("FR", "France"),
    ("DE", "Germany"), ("PK", "Pakistan"), ("AF", "Afghanistan"),
]

THREAT_BASELINE = [
    ("IR", 85, "critical", ["Nuclear program", "Ballistic missiles", "Proxy forces"]),
    ("YE", 78, "high", ["Houthi attacks", "Civil war", "Humanitarian crisis"]),
    ("SY", 72, "high", ["Civil war", "ISIS remnants", "Foreign occupation"]),
    ("IQ", 65, "high", ["Political instability", "ISIS cells", "Iranian influence"]),
    ("LB", 58, "medium", ["Economic collapse", "Hezbollah", "Political deadlock"]),
    ("IL", 90, "critical", [" Gaza conflict", "Iranian threats", "Regional isolation"]),
    ("SA", 45, "medium", ["Yemen war", "Regional rivalry", "Economic reforms"]),
    ("AE", 35, "low", ["Regional diplomacy", "Economic hub", "Stable"]),
]
DEFAULT_THREAT = (30, "low")

ORGANIZATIONS = [
    ("IRGC", "Islamic Revolutionary Guard Corps"), ("Quds", "Quds Force"),
    ("Houthis", "Ansar Allah (Houthis)"), ("Hezbollah", "Hezbollah"),
    ("ISIS", "Islamic State"), ("Al-Qaeda", "Al-Qaeda"),
    ("ISIS-K", "ISIS-Khorasan"), ("Taliban", "Taliban"),
    ("PLO", "Palestine Liberation Organization"), ("PA", "Palestinian Authority"),
    ("Mosad", "Mossad"), ("CIA", "CIA"), ("MI6", "MI6"),
    ("GID", "General Intelligence Directorate"), ("Mukhabarat", "Mukhabarat"),
    ("Coalition", "Coalition Forces"), ("US Navy", "US Navy"),
    ("IRAF", "Islamic Republic Air Force"), ("SyAAF", "Syrian Arab Air Force"),
    ("RSAF", "Royal Saudi Air Force"), ("UAE Air Force", "UAE Air Force"),
]

SOURCE_PROFILES = [
    ("IRNA", "IR", 0.6, "pro-government"), ("PressTV", "IR", 0.5, "pro-government"),
    ("Al Jazeera", "QA", 0.8, "neutral"), ("Al Arabiya", "SA", 0.8, "pro-government"),
    ("Reuters", "GB", 0.95, "neutral"), ("AP", "US", 0.95, "neutral"),
    ("AFP", "FR", 0.9, "neutral"), ("MEE", "UK", 0.75, "neutral"),
    ("Twitter", "US", 0.4, "mixed"), ("Telegram", "RU", 0.5, "mixed"),
    ("ISNA", "IR", 0.6, "pro-government"),
]

# feed registry: name, country, credibility, is_government
FEEDS = [
    ("Reuters Middle East", "International", 95, False),
    ("BBC Middle East", "International", 95, False),
    ("The Guardian", "International", 90, False),
    ("Al Jazeera", "Qatar", 90, False),
    ("The National UAE", "UAE", 85, False),
    ("Gulf News", "UAE", 85, False),
    ("Khaleej Times", "UAE", 80, False),
    ("Arab News", "Saudi Arabia", 80, False),
    ("Saudi Gazette", "Saudi Arabia", 80, False),
    ("Al Riyadh (EN)", "Saudi Arabia", 75, False),
    ("Saudi Press Agency", "Saudi Arabia", 85, False),
    ("Bahrain News Agency", "Bahrain", 80, False),
    ("Gulf Daily News", "Bahrain", 75, False),
    ("Oman News Agency", "Oman", 80, False),
    ("Oman Daily Observer", "Oman", 75, False),
    ("Times of Israel", "Israel", 85, False),
    ("Jerusalem Post", "Israel", 85, False),
    ("Haaretz", "Israel", 85, False),
    ("Defense News", "International", 90, False),
    ("Breaking Defense", "International", 85, False),
    ("Egypt Today", "Egypt", 75, False),
    ("Daily Star Lebanon", "Lebanon", 75, False),
    ("Jordan Times", "Jordan", 75, False),
    ("Morocco World News", "Morocco", 70, False),
    ("Tunisia Live", "Tunisia", 70, False),
    ("UAE Ministry of Interior", "UAE", 100, True),
    ("UAE NCEMA", "UAE", 100, True),
    ("UAE Ministry of Defence", "UAE", 100, True),
    ("UAE National Guard", "UAE", 100, True),
    ("UAE Government Media Office", "UAE", 100, True),
    ("WAM News Agency", "UAE", 95, True),
    ("WAM English", "UAE", 95, True),
    ("Dubai Media Office", "UAE", 95, True),
    ("Abu Dhabi Civil Defence", "UAE", 100, True),
    ("Dubai Civil Defence", "UAE", 100, True),
    ("Sharjah Civil Defence", "UAE", 100, True),
    ("UAE GCAA", "UAE", 95, True),
    ("UAE Ministry of Foreign Affairs", "UAE", 100, True),
    ("Saudi Ministry of Interior", "Saudi Arabia", 100, True),
    ("Saudi Civil Defense", "Saudi Arabia", 100, True),
    ("Qatar Ministry of Interior EN", "Qatar", 100, True),
    ("Qatar Civil Defence", "Qatar", 100, True),
    ("Kuwait Ministry of Interior EN", "Kuwait", 100, True),
    ("Kuwait Fire Force", "Kuwait", 100, True),
    ("Bahrain Ministry of Interior", "Bahrain", 100, True),
    ("Royal Oman Police", "Oman", 100, True),
    ("Israel Defense Forces", "Israel", 95, True),
    ("Israel Ministry of Defense", "Israel", 95, True),
    ("Magen David Adom", "Israel", 95, True),
    ("COGAT", "Israel", 95, True),
]

ACCOUNTS = [
    ("moiuae", "UAE Ministry of Interior", "UAE", 95),
    ("Gordonmmike", "Mike Gordon (UAE analyst)", "UAE", 75),
    ("IDF", "Israel Defense Forces", "Israel", 90),
    ("IsraelROM", "Israel Radio/Defense news", "Israel", 80),
    ("manniefabian", "Manu Fabian (Defense reporter)", "Israel", 70),
    ("SaudiDCD", "Saudi Civil Defense", "Saudi Arabia", 90),
    ("spa_medien", "Saudi Press Agency", "Saudi Arabia", 85),
    ("MOI_QatarEn", "Qatar Ministry of Interior", "Qatar", 90),
    ("Saberlinux", "Yemen News", "Yemen", 60),
    ("aramnews", "Aram News (Iran)", "Iran", 65),
    ("IranPro", "Iran Updates", "Iran", 55),
    ("PentagonBuzz", "Pentagon Updates", "US", 85),
    ("Arab_Themi", "Arab Threat Intel", "Regional", 70),
]

# ingest gazetteer: key, name, country, lat, lng (cities first, then countries)
INGEST_CITIES = [
    ("dubai", "Dubai", "UAE", 25.2048, 55.2708),
    ("abu dhabi", "Abu Dhabi", "UAE", 24.4539, 54.3773),
    ("riyadh", "Riyadh", "Saudi Arabia", 24.7136, 46.6753),
    ("jeddah", "Jeddah", "Saudi Arabia", 21.4858, 39.1925),
    ("doha", "Doha", "Qatar", 25.2854, 51.5310),
    ("manama", "Manama", "Bahrain", 26.2285, 50.5860),
    ("kuwait city", "Kuwait City", "Kuwait", 29.3759, 47.9774),
    ("muscat", "Muscat", "Oman", 23.5880, 58.3829),
    ("tel aviv", "Tel Aviv", "Israel", 32.0853, 34.7818),
    ("jerusalem", "Jerusalem", "Israel", 31.7683, 35.2137),
    ("gaza", "Gaza", "Palestine", 31.5017, 34.4668),
    ("beirut", "Beirut", "Lebanon", 33.8938, 35.5018),
    ("damascus", "Damascus", "Syria", 33.5138, 36.2765),
    ("baghdad", "Baghdad", "Iraq", 33.3152, 44.3661),
    ("cairo", "Cairo", "Egypt", 30.0444, 31.2357),
    ("amman", "Amman", "Jordan", 31.9454, 35.9284),
    ("tehran", "Tehran", "Iran", 35.6892, 51.3890),
    ("sanaa", "Sanaa", "Yemen", 15.3694, 44.1910),
    ("aden", "Aden", "Yemen", 12.7855, 45.0215),
]
INGEST_COUNTRIES = [
    ("uae", "Unknown City", "UAE", 23.4241, 53.8478),
    ("united arab emirates", "Unknown City", "UAE", 23.4241, 53.8478),
    ("saudi", "Unknown City", "Saudi Arabia", 23.8859, 45.0792),
    ("qatar", "Unknown City", "Qatar", 25.3548, 51.1839),
    ("bahrain", "Unknown City", "Bahrain", 26.0667, 50.5577),
    ("kuwait", "Unknown City", "Kuwait", 29.3117, 47.4818),
    ("oman", "Unknown City", "Oman", 21.4735, 55.9754),
    ("israel", "Unknown City", "Israel", 31.0461, 34.8516),
    ("palestine", "Unknown City", "Palestine", 31.9522, 35.2332),
    ("gaza", "Gaza", "Palestine", 31.5017, 34.4668),
    ("lebanon", "Unknown City", "Lebanon", 33.8547, 35.8623),
    ("syria", "Unknown City", "Syria", 34.8021, 38.9968),
    ("iraq", "Unknown City", "Iraq", 33.2232, 43.6793),
    ("jordan", "Unknown City", "Jordan", 30.5852, 36.2384),
    ("egypt", "Unknown City", "Egypt", 26.8206, 30.8025),
    ("yemen", "Unknown City", "Yemen", 15.5527, 48.5164),
    ("iran", "Unknown City", "Iran", 32.4279, 53.6880),
]
INGEST_FALLBACK = ("Unknown", 25.0, 45.0)

# geocoder gazetteer: key, lat, lng, country
GEO_CITIES = [
    ("tehran", 35.6892, 51.3890, "Iran"), ("isfahan", 32.6539, 51.6660, "Iran"),
    ("mashhad", 36.2605, 59.6168, "Iran"), ("tabriz", 38.0962, 46.2738, "Iran"),
    ("shiraz", 29.5926, 52.5836, "Iran"), ("bandar abbas", 27.1833, 56.2667, "Iran"),
    ("ahvaz", 31.3183, 48.6706, "Iran"), ("kermanshah", 34.3142, 47.0650, "Iran"),
    ("tel aviv", 32.0853, 34.7818, "Israel"), ("jerusalem", 31.7683, 35.2137, "Israel"),
    ("haifa", 32.7940, 34.9896, "Israel"), ("gaza", 31.5017, 34.4668, "Palestine"),
    ("gaza city", 31.5017, 34.4668, "Palestine"), ("rafah", 31.2968, 34.2453, "Palestine"),
    ("khan yunis", 31.3461, 34.3063, "Palestine"), ("beersheba", 31.2589, 34.7997, "Israel"),
    ("ashdod", 31.8044, 34.6553, "Israel"), ("ashkelon", 31.6695, 34.5715, "Israel"),
    ("eilat", 29.5581, 34.9482, "Israel"),
    ("beirut", 33.8938, 35.5018, "Lebanon"), ("tripoli", 34.4346, 35.8362, "Lebanon"),
    ("sidon", 33.5631, 35.3689, "Lebanon"), ("tyre", 33.2700, 35.2033, "Lebanon"),
    ("baalbek", 34.0058, 36.2181, "Lebanon"),
    ("damascus", 33.5138, 36.2765, "Syria"), ("aleppo", 36.2021, 37.1343, "Syria"),
    ("homs", 34.7308, 36.7094, "Syria"),
    ("baghdad", 33.3152, 44.3661, "Iraq"), ("basra", 30.5156, 47.7804, "Iraq"),
    ("mosul", 36.3566, 43.1642, "Iraq"), ("erbil", 36.1911, 44.0092, "Iraq"),
    ("sanaa", 15.3694, 44.1910, "Yemen"), ("aden", 12.7855, 45.0187, "Yemen"),
    ("hodeidah", 14.7974, 42.9570, "Yemen"),
    ("dubai", 25.2048, 55.2708, "UAE"), ("abu dhabi", 24.4539, 54.3773, "UAE"),
    ("sharjah", 25.3463, 55.4209, "UAE"),
    ("riyadh", 24.7136, 46.6753, "Saudi Arabia"), ("jeddah", 21.4858, 39.1925, "Saudi Arabia"),
    ("mecca", 21.3891, 39.8579, "Saudi Arabia"), ("medina", 24.5247, 39.5692, "Saudi Arabia"),
    ("dammam", 26.3927, 50.0916, "Saudi Arabia"), ("khobar", 26.2172, 50.1971, "Saudi Arabia"),
    ("tabuk", 28.3835, 36.5662, "Saudi Arabia"), ("dhahran", 26.2361, 50.0393, "Saudi Arabia"),
    ("doha", 25.2854, 51.5310, "Qatar"), ("manama", 26.2285, 50.5860, "Bahrain"),
    ("kuwait city", 29.3759, 47.9774, "Kuwait"),
    ("muscat", 23.5859, 58.4059, "Oman"), ("salalah", 17.0151, 54.0924, "Oman"),
    ("amman", 31.9454, 35.9284, "Jordan"),
    ("cairo", 30.0444, 31.2357, "Egypt"), ("alexandria", 31.2001, 29.9187, "Egypt"),
    ("suez", 29.9668, 32.5498, "Egypt"),
]
GEO_COUNTRIES = [
    ("iran", 32.4279, 53.6880), ("israel", 31.0461, 34.8516),
    ("palestine", 31.9522, 35.2332), ("gaza", 31.5017, 34.4668),
    ("lebanon", 33.8547, 35.8623), ("syria", 34.8021, 38.9968),
    ("iraq", 33.2232, 43.6793), ("yemen", 15.5527, 48.5164),
    ("uae", 23.4241, 53.8478), ("saudi arabia", 23.8859, 45.0792),
    ("qatar", 25.3548, 51.1839), ("bahrain", 26.0667, 50.5577),
    ("kuwait", 29.3117, 47.4818), ("oman", 21.4735, 55.9754),
    ("jordan", 30.5852, 36.2384), ("egypt", 26.8206, 30.8025),
]
GEO_REGIONS = [
    ("strait of hormuz", 26.5, 56.5), ("red sea", 20.0, 38.0),
    ("gulf of aden", 12.0, 47.0), ("persian gulf", 26.0, 52.0),
    ("mediterranean sea", 34.5, 32.0), ("west bank", 31.9466, 35.3027),
]
GEO_FALLBACK = (29.0, 48.0, "gulf_region_center")
COORDINATE_PATTERNS = [
    r"lat(?:itude)?[:\s]+(-?\d+\.?\d*)[:\s,]+lng(?:itude)?[:\s]+(-?\d+\.?\d*)",
    r"(-?\d+\.?\d*)°?[\s]*[Nn][,\s]+(-?\d+\.?\d*)°?[\s]*[Ee]",
    r"coordinates?:?\s*(-?\d+\.?\d*)[,\s]+(-?\d+\.?\d*)",
]

# bounding boxes: lat_min, lat_max, lng_min, lng_max
BOXES = {
    "thermal": (12.0, 35.0, 34.0, 60.0),
    "satellite": (10.0, 40.0, 30.0, 65.0),
    "aircraft": (12.0, 35.0, 34.0, 60.0),
}
# thermal regions in match order: name, lat_min, lat_max, lng_min, lng_max
THERMAL_REGIONS = [
    ("Levant", 32.0, 36.0, 34.0, 40.0),
    ("Iraq", 28.0, 35.0, 40.0, 50.0),
    ("Gulf", 24.0, 30.0, 50.0, 56.0),
    ("Gulf of Oman", 20.0, 28.0, 56.0, 60.0),
    ("Arabian Sea", 12.0, 24.0, 42.0, 54.0),
]

AIRPORTS = [
    ("OMDB", "Dubai International", "UAE", 25.2532, 55.3657),
    ("OMAA", "Abu Dhabi International", "UAE", 24.4330, 54.6511),
    ("OERK", "King Khalid International", "Saudi Arabia", 24.9576, 46.6988),
    ("OEJN", "King Abdulaziz International", "Saudi Arabia", 21.6796, 39.1565),
    ("OTHH", "Hamad International", "Qatar", 25.2731, 51.6080),
    ("OKBK", "Kuwait International", "Kuwait", 29.2266, 47.9689),
    ("OBBI", "Bahrain International", "Bahrain", 26.2708, 50.6336),
    ("OOMS", "Muscat International", "Oman", 23.5933, 58.2844),
    ("ORBI", "Baghdad International", "Iraq", 33.2625, 44.2346),
    ("OIIE", "Imam Khomeini International", "Iran", 35.4161, 51.1522),
    ("LLBG", "Ben Gurion Airport", "Israel", 32.0117, 34.8867),
    ("OLBA", "Beirut-Rafic Hariri", "Lebanon", 33.8209, 35.4884),
]
NOTAM_RADIUS_KM = {"AIRSPACE": 50, "HAZARD": 30, "CONFLICT": 40, "AIRPORT": 10,
                   "NAVIGATION": 5, "COMMUNICATION": 3, "GENERAL": 5}
NOTAM_DEFAULT_RADIUS_KM = 5
NOTAM_COLORS = {"CRITICAL": "#e74c3c", "WARNING": "#e67e22",
                "ELEVATED": "#f39c12", "INFORMATION": "#3498db"}
NOTAM_DEFAULT_COLOR = "#95a5a6"

# price symbols: key, name, decimals, thousands separator
PRICE_SYMBOLS = [
    ("brent", "Brent Oil", 2, False), ("gas", "Natural Gas", 3, False),
    ("gold", "Gold", 0, False), ("bitcoin", "Bitcoin", 0, True),
    ("iron", "Iron Ore", 2, False), ("copper", "Copper", 2, False),
]

# default outcomes per action: action, category, outcome, probability, timeframe, confidence
_STRIKE_RULES = [
    ("Military Response", "Retaliatory strikes or defense activation", 75,
     "Within 48 hours", "Standard military doctrine"),
    ("Market Impact", "Oil price volatility (+2-5%)", 60, "24 hours",
     "Historical commodity response"),
    ("Diplomatic Response", "Emergency consultations or condemnations", 45,
     "24-72 hours", "Standard diplomatic protocol"),
]
_NAVAL_RULES = [
    ("Maritime Security", "Increased naval patrols in region", 70,
     "48-96 hours", "Standard naval response"),
    ("Shipping Impact", "Insurance premiums rise, route changes", 55,
     "1-2 weeks", "Market response pattern"),
]
_INTERCEPT_RULES = [
    ("Escalation Risk", "Attacker may attempt follow-up strikes", 65,
     "24-48 hours", "Post-interception patterns"),
    ("Defense Posture", "Heightened alert status maintained", 80,
     "7+ days", "Standard defense protocol"),
]
FALLBACK_RULES = [
    ("Monitoring", "Continued surveillance and analysis", 90, "Ongoing",
     "Standard procedure"),
    ("Diplomatic", "Official statements from involved parties", 70,
     "24 hours", "Standard protocol"),
]
ACTION_RULES = (
    [(a, *r) for a in ("missile", "drone", "strike") for r in _STRIKE_RULES]
    + [(a, *r) for a in ("naval", "ship") for r in _NAVAL_RULES]
    + [("intercept", *r) for r in _INTERCEPT_RULES]
)
SCENARIO_ACTORS = [
    ("houthi", "Houthis (Yemen)", "Yemen"), ("israel", "Israel / IDF", "Israel"),
    ("iran", "Iran / IRGC", "Iran"), ("saudi", "Saudi Arabia", "Saudi Arabia"),
    ("uae", "UAE", "UAE"), ("us", "United States", "US"),
    ("uk", "United Kingdom", "UK"), ("hezbollah", "Hezbollah", "Lebanon"),
    ("hamas", "Hamas", "Palestine"), ("isis", "ISIS/ISIL", "Regional"),
]
SCENARIO_ACTIONS = [
    ("strike", "Airstrike / Attack"), ("missile", "Missile Launch"),
    ("drone", "Drone Attack"), ("naval", "Naval Action"),
    ("intercept", "Intercept / Defense"), ("bomb", "Bombing / Explosion"),
    ("deploy", "Troop Deployment"), ("sanction", "Sanctions"),
]
SCENARIO_TARGETS = [
    ("oil_facility", "Oil Facility"), ("military_base", "Military Base"),
    ("civilian_area", "Civilian Area"), ("shipping", "Commercial Shipping"),
    ("naval_vessel", "Naval Vessel"), ("infrastructure", "Infrastructure"),
    ("airport", "Airport"), ("port", "Port"),
]
SCENARIO_COUNTRIES = [
    ("uae", "UAE"), ("saudi", "Saudi Arabia"), ("qatar", "Qatar"),
    ("bahrain", "Bahrain"), ("kuwait", "Kuwait"), ("oman", "Oman"),
    ("israel", "Israel"), ("iran", "Iran"), ("yemen", "Yemen"),
    ("iraq", "Iraq"), ("lebanon", "Lebanon"),
]
TYPE_NAMES = {"air_defense": "Air Defense", "attack": "Attack", "alert": "Alert",
              "security": "Security", "missile": "Missile", "drone": "Drone"}
TYPE_SHORT_LABELS = {"missile": "MSL", "airstrike": "AIR", "drone": "UAV", "general": "INC"}
FRAME_NAMES = {"24h": "Within 24 hours", "72h": "Within 72 hours", "7d": "Within 7 days"}
FRAME_SECONDS = {"24h": 86_400, "72h": 259_200, "7d": 604_800}

# orbital elements: name, norad id, kind, line 1, line 2
ELEMENTS = [
    ("NOAA-20", "43013", "Weather",
     "1 43013U 17073A   25078.12345678 -.00000011  00000-0  12345-4 0  9999",
     "2 43013  98.7396 123.4567 0001234  56.7890 303.4567 14.19567890123456"),
    ("NOAA-21", "54234", "Weather",
     "1 54234U 22114A   25078.12345678 -.00000011  00000-0  12345-4 0  9999",
     "2 54234  98.7396 234.5678 0001234  67.8901 214.5678 14.19567890123456"),
    ("METOP-B", "38771", "Weather",
     "1 38771U 12049A   25078.12345678 -.00000011  00000-0  12345-4 0  9999",
     "2 38771  98.7396 345.6789 0001234  78.9012 125.6789 14.19567890123456"),
    ("ISS (ZARYA)", "25544", "Crewed",
     "1 25544U 98067A   25078.45678901  .00012345  00000-0  23456-3 0  9999",
     "2 25544  51.6416 123.4567 0005678  12.3456 347.8901 15.50987654321098"),
    ("Tianzhou-7", "58932", "Cargo",
     "1 58932U 24023A   25078.45678901  .00012345  00000-0  23456-3 0  9999",
     "2 58932  51.6416 234.5678 0005678  23.4567 256.7890 15.50987654321098"),
    ("GPS BIIRM-7", "38833", "Navigation",
     "1 38833U 12053A   25078.78901234 -.00000022  00000-0  34567-4 0  9999",
     "2 38833  55.0000 123.4567 0098765  34.5678 125.6789  2.00567890123456"),
    ("BeiDou-3M3", "45807", "Navigation",
     "1 45807U 20050A   25078.78901234 -.00000022  00000-0  34567-4 0  9999",
     "2 45807  55.0000 234.5678 0098765  45.6789  36.7890  2.00567890123456"),
    ("Starlink-1007", "44713", "Communications",
     "1 44713U 19074A   25078.32165498  .00001122  00000-0  12345-3 0  9999",
     "2 44713  53.0000 123.4567 0001111  67.8901 292.3456 15.06432198765432"),
    ("Starlink-1008", "44714", "Communications",
     "1 44714U 19074B   25078.32165498  .00001122  00000-0  12345-3 0  9999",
     "2 44714  53.0000 234.5678 0001111  78.9012 183.4567 15.06432198765432"),
    ("USA-224 (KH-11)", "37386", "Reconnaissance",
     "1 37386U 11002A   25078.65432109 -.00000033  00000-0  45678-4 0  9999",
     "2 37386  97.9000 123.4567 0500000  89.0123 271.0987 14.87654321098765"),
]
GRAVITY_CONSTANT = 398600.8
EARTH_RADIUS_KM = 6378.135


def seed_table(spark: SparkSession, rows, columns) -> DataFrame:
    """A seed list as a DataFrame with known (tiny) size statistics."""
    if len(rows) > SEED_ROW_LIMIT:
        raise ValueError(f"seed table of {len(rows)} rows: land it as a table instead")
    names = [columns] if isinstance(columns, str) else list(columns)
    tuples = [r if isinstance(r, (tuple, list)) else (r,) for r in rows]
    return spark.createDataFrame(
        pa.table({name: [t[i] for t in tuples] for i, name in enumerate(names)})
    )


def ranked(rows):
    """Append the list position, the tie-break that keeps first-match order."""
    return [(*(r if isinstance(r, tuple) else (r,)), i) for i, r in enumerate(rows)]
