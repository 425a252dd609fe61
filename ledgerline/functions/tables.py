"""Word lists, lookup tables and ordered rewrite rules that results depend on, in the order they apply."""

from __future__ import annotations

# fixed values: street abbreviations of the first pass; with a final dot anywhere in the text, else as a whole word
STREET_WORDS = [
    ("St", "Street"), ("St.", "Street"), ("Rd", "Road"), ("Rd.", "Road"),
    ("Blvd", "Boulevard"), ("Blvd.", "Boulevard"), ("Ave", "Avenue"), ("Ave.", "Avenue"),
    ("Dr", "Drive"), ("Dr.", "Drive"), ("Ln", "Lane"), ("Ln.", "Lane"),
    ("Ct", "Court"), ("Ct.", "Court"), ("Pkwy", "Parkway"), ("Hwy", "Highway"),
    ("Pl", "Place"), ("Pl.", "Place"), ("Cir", "Circle"),
    ("Str.", "Straße"), ("str.", "straße"),
    ("Av.", "Avenida"), ("C/", "Calle "), ("Rda.", "Ronda"),
    ("Ctra.", "Carretera"), ("Pza.", "Plaza"),
    ("V.le", "Viale"), ("V.", "Via"), ("R.", "Rua"),
]

STATES_FIRST_PASS = {
    "VER.": "Veracruz", "MICH.": "Michoacán", "HGO.": "Hidalgo",
    "CDMX": "Ciudad de México", "JAL.": "Jalisco",
}

STATES_ES = {"GU": "Guadalajara", "M": "Madrid", "B": "Barcelona", "V": "Valencia"}

STATES_MX = {
    "AGS.": "Aguascalientes", "BC.": "Baja California", "BCS.": "Baja California Sur",
    "CAMP.": "Campeche", "CHIS.": "Chiapas", "CHIH.": "Chihuahua",
    "CDMX": "Ciudad de México", "COAH.": "Coahuila", "COL.": "Colima",
    "DGO.": "Durango", "GTO.": "Guanajuato", "GRO.": "Guerrero",
    "HGO.": "Hidalgo", "JAL.": "Jalisco", "MEX.": "México",
    "MICH.": "Michoacán", "MOR.": "Morelos", "NAY.": "Nayarit",
    "NL.": "Nuevo León", "OAX.": "Oaxaca", "PUE.": "Puebla",
    "QRO.": "Querétaro", "QROO.": "Quintana Roo", "SLP.": "San Luis Potosí",
    "SIN.": "Sinaloa", "SON.": "Sonora", "TAB.": "Tabasco",
    "TAMPS.": "Tamaulipas", "TLAX.": "Tlaxcala", "VER.": "Veracruz",
    "YUC.": "Yucatán", "ZAC.": "Zacatecas",
}

# fixed values: street rules of the second pass by language (pattern, replacement)
STREET_RULES = {
    "en": [
        (r"\bSt\b(?!\.)", "Street"), (r"\bSt\.", "Street"),
        (r"\bRd\b", "Road"), (r"\bRd\.", "Road"),
        (r"\bBlvd\b", "Boulevard"), (r"\bBlvd\.", "Boulevard"),
        (r"\bAve\b", "Avenue"), (r"\bAve\.", "Avenue"),
        (r"\bDr\b(?!\.)", "Drive"), (r"\bDr\.", "Drive"),
        (r"\bLn\b", "Lane"), (r"\bLn\.", "Lane"),
        (r"\bCt\b", "Court"), (r"\bCt\.", "Court"),
        (r"\bPkwy\b", "Parkway"), (r"\bHwy\b", "Highway"),
        (r"\bPl\b", "Place"), (r"\bCir\b", "Circle"),
        (r"\bSte\b", "Suite"), (r"\bSte\.", "Suite"),
        (r"\bApt\b", "Apartment"), (r"\bApt\.", "Apartment"),
        (r"\bFl\b(?=\s*\d)", "Floor"),
        (r"\bN\b(?=\s+\w+\s+(St|Ave|Rd|Blvd))", "North"),
        (r"\bS\b(?=\s+\w+\s+(St|Ave|Rd|Blvd))", "South"),
        (r"\bE\b(?=\s+\w+\s+(St|Ave|Rd|Blvd))", "East"),
        (r"\bW\b(?=\s+\w+\s+(St|Ave|Rd|Blvd))", "West"),
    ],
    "es": [
        (r"\bAv\.?(?=\s)", "Avenida"), (r"\bC/", "Calle "), (r"\bRda\.", "Ronda"),
        (r"\bCtra\.", "Carretera"), (r"\bPza\.", "Plaza"), (r"\bPº\.?(?=\s)", "Paseo"),
        (r"\bUrb\.", "Urbanización"), (r"\bEdif\.", "Edificio"), (r"\bS/[Nn]", "Sin Número"),
    ],
    "de": [(r"\bStr\.", "Straße"), (r"\bstr\.", "straße"), (r"\bPl\.", "Platz"), (r"\bpl\.", "platz")],
    "it": [
        (r"\bV\.le\b", "Viale"), (r"\bV\.(?=\s)", "Via"), (r"\bP\.zza\b", "Piazza"),
        (r"\bPzza\.?(?=\s)", "Piazza"), (r"\bC\.so\b", "Corso"), (r"\bL\.go\b", "Largo"),
    ],
    "pt": [(r"\bR\.(?=\s)", "Rua"), (r"\bAv\.(?=\s)", "Avenida"), (r"\bTrav\.", "Travessa"), (r"\bEstr\.", "Estrada")],
    "fr": [(r"\bRue\b", "Rue"), (r"\bBd\.?(?=\s)", "Boulevard"), (r"\bAv\.(?=\s)", "Avenue"), (r"\bPl\.(?=\s)", "Place")],
}

# fixed values: countries, cities and languages
CITY_COUNTRY = {
    "beijing": "CN", "shanghai": "CN", "shenzhen": "CN", "guangzhou": "CN",
    "london": "GB", "manchester": "GB", "birmingham": "GB",
    "paris": "FR", "lyon": "FR", "marseille": "FR",
    "moscow": "RU", "saint petersburg": "RU",
}
CJK_COUNTRIES = ["CN", "TW", "HK", "MO", "JP", "KR"]
MAINLAND_CITIES = ["北京", "上海", "深圳", "广州"]
COUNTRY_LANGUAGE = {
    "US": "en", "GB": "en", "CA": "en", "AU": "en", "IE": "en", "GU": "en",
    "ES": "es", "MX": "es", "AR": "es", "CL": "es", "HN": "es",
    "DE": "de", "IT": "it", "PT": "pt", "BR": "pt",
    "FR": "fr", "BE": "fr", "NL": "nl",
    "CN": "zh", "HK": "zh", "RU": "ru", "KZ": "ru",
}
UNICODE_LANGUAGES = ["zh", "ja", "ko"]
TRANSLITERATED_LANGUAGES = ["ru", "ar", "he", "th"]

# fixed values: name sub-categories that mean internal codes
CODED_NAMES = [
    "Company Location and Department Codes",
    "Company Names with Parenthetical Descriptors",
    "Company Names with Contact or Attention Descriptors",
]

# fixed values: the deterministic address validator
STREET_TYPES = "Street|Road|Avenue|Boulevard|Drive|Lane|Way|Place|Court|Calle|Avenida|Via|Rue|Straße|Rua|Corso|Viale|Piazza"
FAVOURED_COUNTRIES = ["US", "GB", "CA", "AU", "DE", "FR"]
LATITUDE = {
    "US": 39.0, "CA": 45.0, "GB": 51.5, "DE": 51.0, "FR": 46.0, "ES": 40.0, "IT": 42.0, "MX": 23.0,
    "CN": 35.0, "AU": -33.0, "BR": -15.0, "PT": 39.0, "BE": 50.8, "NL": 52.3, "RU": 55.7,
}
LONGITUDE = {
    "US": -98.0, "CA": -75.0, "GB": -0.1, "DE": 10.0, "FR": 2.3, "ES": -3.7, "IT": 12.5, "MX": -102.0,
    "CN": 105.0, "AU": 151.2, "BR": -47.9, "PT": -8.0, "BE": 4.4, "NL": 4.9, "RU": 37.6,
}
UNIT_WORDS = "Suite|Ste|Apt|Unit|Floor|Fl|Room|Rm|Bldg|Building"
FAILURE_REASONS = {
    "digit": "No street number found in address",
    "short": "Address too short to validate",
    "unrecognized": "Street name not recognized by validation service",
    "insufficient": "Too few address components for reliable matching",
    "none": "Address could not be matched to a known location after multiple correction attempts",
}

# fixed values: comparing a service's answer with the address that was sent
ADDRESS_WORDS = [
    (r"\bn\b", "north"), (r"\bs\b", "south"), (r"\be\b", "east"), (r"\bw\b", "west"),
    (r"\brd\b", "road"), (r"\brd\.\b", "road"), (r"\bave\b", "avenue"), (r"\bave\.\b", "avenue"),
    (r"\bst\b", "street"), (r"\bst\.\b", "street"), (r"\bln\b", "lane"), (r"\bln\.\b", "lane"),
    (r"\bdr\b", "drive"), (r"\bdr\.\b", "drive"), (r"\bblvd\b", "boulevard"), (r"\bblvd\.\b", "boulevard"),
    (r"\bsgt\b", "sargeant"), (r"\bste\b", "suite"),
]
COUNTRY_WORDS = r"\b(us|usa|united states|ca|canada|gb|uk|de|fr|es|it|au)\b"
PLACEHOLDERS = r"\b(x+x+|closed|tbd|operational|unknown|n/?a)\b"
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten"
LOCALITIES = ["geography", "municipality", "municipalitysubdivision", "countrysecondarysubdivision"]

# fixed values: company verification
GENERIC_PLACES = ["street", "road", "avenue", "boulevard", "drive", "lane", "place", "route", "highway", "residential", "commercial", "building"]
DECISIONS = ["VERIFIED", "LIKELY_MATCH", "ADDRESS_MISMATCH", "CORRECT_ADDRESS_CANDIDATE", "UNVERIFIED"]
TRUSTED = ["VERIFIED", "LIKELY_MATCH"]
PROMOTABLE = ["ADDRESS_MISMATCH", "CORRECT_ADDRESS_CANDIDATE"]
PROMOTION_CONFIDENCE = 0.75
FIRMOGRAPHICS = [
    "legal_name", "website", "email_domain", "naics_code", "sic_code", "parent_company", "domestic_ultimate",
    "global_ultimate", "headquarters_address", "employee_count", "revenue_range", "year_established",
]
COVERAGE_FIELDS = ["legal_name", "enriched_full_address", *FIRMOGRAPHICS[1:]]
ROUTES = {
    "trusted": ("AUTO_ENRICH", "NONE", "Trusted company-address match; record eligible for firmographic enrichment."),
    "mismatch": ("AUTO_NO_ENRICH_ADDRESS_MISMATCH", "NONE", "High-confidence evidence indicates a different occupant/entity at the validated address."),
    "low": ("REVIEW_LOW_CONFIDENCE_MISMATCH", "MEDIUM", "Address mismatch evidence exists but confidence is below the automatic no-enrich threshold."),
    "candidate": ("REVIEW_CORRECT_ADDRESS_CANDIDATE", "HIGH", "Company candidate was found at a different address; review for possible source address correction."),
    "error": ("REVIEW_API_ERROR", "MEDIUM", "Verification failed due to API error; retry or inspect service response."),
    "none": ("DEFER_NO_EVIDENCE", "LOW", "No reliable company/address candidate was found; needs additional source coverage before human review."),
}

# fixed values: texts that are read as missing
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
USABLE = ["VALIDATED", "CORRECTED", "PARTIAL_VALIDATED"]
EXACT = ["VALIDATED", "CORRECTED"]
