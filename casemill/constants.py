"""Fixed values the results depend on. Everything here is data; no behaviour."""

# --- Fixed values: labels and splits -------------------------------------------------------------
CATCH_ALL_RULE = "FINRA:2010"
PROCEDURAL_SECTIONS = ("SEC_SECTION:19", "SEC_SECTION:15A")
TRAIN_YEARS = (2016, 2022)
VALIDATION_YEARS = (2023, 2023)
TEST_YEARS = (2024, 2026)
MIN_SERIES_CASES = 30
OTHER_LABEL = "other"
THRESHOLD = 0.5
MIN_SUPPORT = 10
LABEL_GATE = 0.98

# --- Fixed values: rulebook numbering ------------------------------------------------------------
FIVE_DIGIT_RANGES = {"FINRA": (11000, 14999), "NASD": (10000, 11999)}
HIGHEST_RULE = {"FINRA": 14999, "NASD": 11999}
NASD_ONLY = ("2110", "2510", "3010", "3011", "3012", "3013", "3030", "3040", "3050")
FINRA_ONLY = ("2010", "2111", "3270", "3280", "4511")

# --- Fixed values: NASD rules and the FINRA rules that replaced them -----------------------------
NASD_SUCCESSOR = {
    "1014": "1014", "1017": "1017", "1021": "1210", "1022": "1220", "1031": "1210", "1032": "1220",
    "1050": "1220", "2011": "2010", "2020": "2020", "2110": "2010", "2120": "2020", "2210": "2210",
    "2211": "2210", "2212": "3230", "2230": "2232", "2310": "2111", "2320": "5310", "2330": "2150",
    "2340": "2231", "2360": "2360", "2370": "3240", "2420": "2040", "2430": "2122", "2440": "2121",
    "2510": "3260", "2520": "4210", "2711": "2241", "2821": "2330", "2830": "2341", "2860": "2360",
    "3010": "3110", "3011": "3310", "3012": "3120", "3013": "3130", "3030": "3270", "3040": "3280",
    "3050": "3210", "3070": "4530", "3110": "4511", "3240": "3240", "3260": "3260", "3310": "5210",
    "3360": "4560", "6230": "6730", "6620": "6622", "6730": "6730", "6955": "7450", "8210": "8210",
    "8211": "8211", "8213": "8213",
    "IM-1000": "1122", "IM-1000-1": "1122", "IM-2110-2": "5320", "IM-2210-1": "2210", "IM-2310": "2111",
    "IM-2310-2": "2111", "IM-2440": "2121", "IM-2440-1": "2121", "IM-2440-2": "2121", "IM-3310": "5210",
}

# --- Fixed values: parts of the Rulebook by rule number ------------------------------------------
RULEBOOK_PARTS = (
    (9000, "conduct rules (0100-8000)"),
    (10000, "Code of Procedure (9000)"),
    (12000, "Uniform Practice Code (11000)"),
    (None, "arbitration and mediation codes (12000-14000)"),
)

# --- Fixed values: chunking and retrieval --------------------------------------------------------
CHUNK_WORDS = 250
CHUNK_OVERLAP = 40
CHUNK_MIN_WORDS = 8
TOP_K = 5
RRF_K = 60
BM25_K1 = 1.2
BM25_B = 0.75
STOP_WORDS = tuple(
    "a an and are as at be by for from has have if in into is it its of on or that the their this to was "
    "were which with not no may can will shall should must any such other".split()
)

# --- Fixed values: facts sections ----------------------------------------------------------------
FACTS_MIN_CHARS = 300
OCR_MIN_CHARS = 500

# --- Fixed values: reasons a document gave no rule, best first ------------------------------------
UNLABELED_ORDER = ("apart", "no violation", "no citation", "neither", "no text", "not cached")

# --- Fixed values: expectations (name, threshold) -------------------------------------------------
EXPECTATIONS = {
    "finetune_gain": 0.05,
    "zeroshot_gap": 0.10,
    "hit_rate": 0.70,
    "declined": 18,
    "kappa": 0.60,
    "facts_gain": 0.03,
}

# --- Fixed values: calendar ----------------------------------------------------------------------
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september",
          "october", "november", "december")
