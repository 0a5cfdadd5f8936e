"""Label vocabularies, codings, limits and patterns the results depend on."""

# Closed label sets, in the order reports list them.
SENTIMENTS = ("positive", "negative", "neutral")
ASPECTS = ("food", "service", "ambiance", "price", "location", "general")
IRONY = ("non_irony", "irony")

# Index order of model outputs and of the sentiment training task.
MODEL_SENTIMENTS = ("negative", "neutral", "positive")

# Aspect category names that are renamed on load.
ASPECT_RENAMES = {"anecdotes/miscellaneous": "general", "ambience": "ambiance"}

# Integer label codings. The English and the Vietnamese source disagree on purpose.
EN_CODES = {0: "positive", 1: "neutral", 2: "negative"}
VI_CODES = {0: "negative", 1: "neutral", 2: "positive"}
IRONY_CODES = {0: "not_sarcastic", 1: "sarcastic"}

SUPPORTED_LANGUAGES = ("en", "vi")
DEFAULT_LANGUAGE = "en"
MIN_TOKENS = 3
VIETNAMESE_LETTERS = (
    "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
)

# Code point ranges per script, in tie-break order.
SCRIPT_RANGES = {
    "ko": ((0xAC00, 0xD7A3), (0x1100, 0x11FF)),
    "zh": ((0x4E00, 0x9FFF),),
    "ja": ((0x3040, 0x30FF),),
    "ar": ((0x0600, 0x06FF),),
    "hi": ((0x0900, 0x097F),),
    "latin": ((0x0041, 0x007A), (0x00C0, 0x024F)),
}
SCRIPT_LOCALES = {
    "ko": "ko-KR",
    "zh": "zh-CN",
    "ja": "ja-JP",
    "ar": "ar-SA",
    "hi": "hi-IN",
    "latin": "",
}

# Strings a CSV scan reads as missing.
CSV_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Polarity values an XML aspect may carry that mean "no label".
EMPTY_POLARITY = ("none", "null", "na")

MISSING_SPLIT = "<missing_split>"
NULL_LABEL = "<null_or_na>"

MIN_TEXT, MAX_TEXT = 3, 2000
MIN_SAMPLES, MAX_NULL_RATIO = 100, 0.01
ASPECT_THRESHOLD = 0.45
EMPTY_ROW_ERROR = "Empty text — skipped"

# Upper bounds of latency buckets in seconds (the metrics client's defaults); +Inf is implied.
LATENCY_BUCKETS = (
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
)

# Dashboard colour bands: first value is where yellow starts, second where red starts.
RATE_BANDS = (50.0, 200.0)
ERROR_BANDS = (0.05, 0.1)
LATENCY_BANDS = (0.1, 0.2)
INFERENCE_BANDS = (0.3, 0.5)

RUN_TAGS = ("task", "git_sha", "device", "environment", "dataset_version", "seed", "user")
