"""Regular-expression classes and fixed values shared by the column functions.

The cleaning rules are defined on Unicode text, while a bare ``\\w``, ``\\d`` or
``\\s`` is ASCII-only on the JVM.  Every pattern of the library is therefore put
together from the three classes below.
"""

# A letter, a number or an underscore of any script.
WORD = r"\p{L}\p{N}_"
# A decimal digit of any script.
DIGIT = r"\p{Nd}"
# White space of any script, with the four ASCII separators.
SPACE = r"(?U:\s)\x1c-\x1f"

STRIP_PATTERN = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# --- fixed values: results depend on these texts being exactly as written ----
NULL_TOKEN_PATTERN = r"""(?iU)^[\s\x1c-\x1f]*["']?(nan|null|none|""|)[\s\x1c-\x1f]*$"""
EMAIL_PATTERN = r"(?U)^[^@\s\x1c-\x1f]+@[^@\s\x1c-\x1f]+\.[^@\s\x1c-\x1f]{2,}$"
NOISE_PATTERN = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f.\-@:/()&]"
NON_WORD_PATTERN = r"[^\p{L}\p{N}_]"
DATE_LIKE_PATTERN = r"\p{Nd}{2,4}[/-]\p{Nd}{1,2}[/-]\p{Nd}{1,2}"
MONEY_MARK_PATTERN = r"[$€£]|\p{Nd}"
MONEY_LIKE_PATTERN = r"[\p{Nd}$€£][\p{Nd},.kmb]+"
ARABIC_PATTERN = r"[\u0600-\u06FF]"
ARABIC_MARKS_PATTERN = r"[\u064B-\u065F\u0670]"
ARABIC_TATWEEL = "\u0640"
ARABIC_ALEFS = "\u0623\u0625\u0622"
ARABIC_BARE_ALEF = "\u0627"
ARABIC_ALEF_MAKSURA = "\u0649"
ARABIC_YEH = "\u064A"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "0123456789"

SAMPLE_SIZE = 15
SAMPLE_SHARE = 0.3
EMAIL_NAME_PARTS = ("email", "mail")
PHONE_NAME_PARTS = ("phone", "mobile", "tel", "cell")
MASK_EMAIL_NAME_PARTS = ("mail",)
MASK_PHONE_NAME_PARTS = ("phone",)
MASK_TEXT_NAME_PARTS = ("name", "client")
MASK_TEXT_VETO_PARTS = ("id",)
MONEY_VETO_NAME_PARTS = (
    "email", "phone", "id", "date", "year", "day", "zip", "address", "street",
    "location",
)
IGNORE_HINT_NAME_PARTS = ("id", "address", "desc", "comment")

# Cell texts that a CSV scan reads as missing.
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

DEDUPE_CUTOFF = 90
LOOKUP_CUTOFF = 75
REMOVED_PREVIEW_ROWS = 20
PREVIEW_CHANGED_ROWS = 20
CLEAN_CHANGED_ROWS = 100
DEFAULT_CHANGED_ROWS = 50
HEAD_ROWS = 5
# -----------------------------------------------------------------------------
