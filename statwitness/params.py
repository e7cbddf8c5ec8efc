"""Thresholds and word lists.

The values in this file are fixed: results depend on them, so they are stated once, plainly, here.
"""

# --- column profiling -------------------------------------------------------------------------
SUPPRESSION_NUMERIC_SHARE = 0.3
METRIC_DISTINCT_SHARE = 0.5
FILTER_MAX_DISTINCT = 50
SAMPLE_ALL_MAX_DISTINCT = 20
SAMPLE_TOP_N = 10
TIME_KEYWORDS = ["year", "period", "date", "time", "quarter", "month"]
AGGREGATE_WORDS = ["total", "all", "national", "overall"]
SUPPRESSION_MARKERS = ["c", "z", "x", ".", "C", "Z", "X"]
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- headline detection (font sizes in points) ------------------------------------------------
H1_MIN_SIZE = 16.0
H2_MIN_SIZE = 12.0
HEADLINE_MIN_SIZE = 11.5
BODY_BAND = (14.0, 15.0)
SMALL_BOLD_BELOW = 13.0
MIN_WORDS = 2
MAX_WORDS = 10
MIN_CHARS = 5
MIN_SPACING = 25.0
WIDE_SPACING = 30.0
UNFINISHED_ENDINGS = [
    ", with an", "and key", "in the", "by the", "of the", "for the", "to the", "from the",
    ", and", ", followed",
]
HEADLINE_PATTERNS = [
    r"^[A-Z].*",
    r"^\d+\..*",
    r"^(Chapter|Section|Part)\s+\d+",
    r".*Summary$",
    r".*Results$",
    r".*Analysis$",
    r".*Methodology$",
    r".*Introduction$",
    r".*Conclusion$",
    r".*Overview$",
    r".*Discussion$",
    r".*Findings$",
    r".*Background.*",
    r".*Key.*",
    r"About\s+the.*",
]

# --- extraction -------------------------------------------------------------------------------
TABLE_ROW_LIMIT = 1000
FALLBACK_ROW_LIMIT = 10
CONTEXT_PARAGRAPHS = 3
UNSAFE_KEYWORDS = [
    "__import__", "eval", "exec", "compile", "open", "file", "os.", "sys.", "subprocess",
    "__builtins__", "__globals__", "__locals__",
]

# --- chunking and retrieval -------------------------------------------------------------------
CHUNK_CHARS = 500
CHUNK_OVERLAP = 100
CHUNK_WORDS_MAX = 500
CHUNK_WORDS_MIN = 200
SEMANTIC_MIN_CHARS = 100
SEMANTIC_MAX_CHARS = 1000
SEMANTIC_SIMILARITY = 0.7
CONTEXT_WINDOW = 2
TABLE_CHUNK_ROWS = 5
TOP_K = 5
RERANK_TOP_K = 3
EMBEDDING_DIMENSION = 384
SUGGEST_MIN_SIMILARITY = 0.8
SUGGEST_MAX = 3

# --- verification, style, scoring -------------------------------------------------------------
DIRECT_MATCH_CONFIDENCE = 0.95
TABLE_ONLY_CONFIDENCE = 0.5
METRIC_NAME_PATTERN = "average|percent|score"
SUPPRESSION_PHRASES = ["suppressed", "not available", "not applicable", "confidential"]
STYLE_MARKERS = ["c", "x", "z"]
NUMERIC_WEIGHT = 0.7
STYLE_WEIGHT = 0.3
STYLE_FAILED_SCORE = 0.5
PASS_SCORE = 0.85
LONG_SENTENCE_WORDS = 25
VARIANT_MIN_LENGTH = 6

# --- feedback ---------------------------------------------------------------------------------
TOP_ERRORS = 5
LEARNING_RATE = 0.1
MIN_FEEDBACK = 5
GUIDANCE_RULES = [
    ("suppression_marker_error", 5, "suppression markers"),
    ("time_period_mismatch", 3, "time periods"),
]
