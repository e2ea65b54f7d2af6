"""Word lists, lookup tables, patterns and numbers that decide the results."""

# ---- fixed values: labels -------------------------------------------------------------
FAKE, REAL, ABSTAIN = 0, 1, -1

# ---- fixed values: canonical article columns -------------------------------------------
ARTICLE_COLUMNS = [
    "title", "text", "url", "source", "category",
    "author", "date_published", "rating", "type", "label",
]

# ---- fixed values: risk word lists -------------------------------------------------------
HIGH_RISK_PLATFORMS = ["facebook", "twitter", "reddit", "whatsapp", "telegram", "tiktok"]
LOW_RISK_PLATFORMS = ["website", "news site", "official"]
HEADLINE_KEYWORDS = ["shocking", "secret", "breaking", "amazing", "you won’t believe", "unbelievable"]
RISKY_EXTENSIONS = ["co", "xyz", "info", "top"]
TRUSTED_EXTENSIONS = ["com", "org", "edu", "gov", "net"]
TRUSTED_CHANNELS = [
    "CNN", "ABC News", "BBC", "CBS", "TIME", "The Telegraph", "Inside Edition", "CBC", "HISTORY",
]
SATIRE_CHANNELS = [
    "The Hummus News", "Sportspickle", "Scrappleface", "Reductress",
    "Reel Truth History Documentaries",
]
FAKE_TYPES = [
    "fake", "satire", "unreliable", "clickbait", "rumor", "conspiracy", "hate", "bias", "junksci",
]
REAL_TYPES = ["reliable"]

# ---- fixed values: code tables -----------------------------------------------------------
CATEGORY_CODES = {
    "politics": "Politics",
    "Politics": "Politics",
    "politicsNews": "Politics",
    "left-news": "Left",
    "left": "Left",
    "right": "Right",
    "Government News": "Politics",
    "US_News": "US",
    "National": "US",
    "International": "International",
    "Middle-east": "International",
    "Editorial": "Opinion",
    "Finance": "Finance",
    "Technology": "Technology",
    "Education": "Education",
    "Entertainment": "Entertainment",
    "Sports": "Sports",
    "Lifestyle": "Lifestyle",
    "gossip": "Entertainment",
    "Crime": "Crime",
    "News": "News",
    "mainstream": "News",
    "articles": "News",
    "stories": "News",
    "Videos": "Media",
    "Miscellaneous": "unknown",
    "unknown": "unknown",
    "unknow": "unknown",
    "other": "unknown",
    "": "unknown",
}
TYPE_CODES = {
    "clickbaits": "clickbait",
    "Clickbaits": "clickbait",
    "clickbait": "clickbait",
    "fake": "fake",
    "Fake": "fake",
    "unreliable": "unreliable",
    "reliable": "reliable",
    "bias": "bias",
    "rumor": "rumor",
    "junksci": "junk_science",
    "vaccines": "health",
    "flatearth": "conspiracy",
    "moonlanding": "conspiracy",
    "chemtrails": "conspiracy",
    "911": "conspiracy",
    "conspiracy": "conspiracy",
    "hate": "hate",
    "satire": "satire",
    "Satire": "satire",
    "bs": "fake",
    "all": "unknown",
    "state": "unknown",
    "": "unknown",
    "unknown": "unknown",
}

# ---- fixed values: fact-check history ----------------------------------------------------
FACT_CHECK_FAKE = ["false", "pants-fire", "barely-true"]
FACT_CHECK_WEIGHTS = {
    "pants_on_fire_c": -2.0,
    "false_c": -1.5,
    "barely_true_c": -1.0,
    "half_true_c": 0.5,
    "mostly_true_c": 1.0,
}
FACT_CHECK_COLUMNS = [
    "id", "label", "statement", "subject", "speaker", "job", "state", "party",
    "barely_true_c", "false_c", "half_true_c", "mostly_true_c", "pants_on_fire_c", "venue",
]
SOCIAL_RATINGS = {
    "mostly true": 1.0,
    "mixture of true and false": 0.5,
    "no factual content": 0.25,
    "mostly false": 0.0,
}

# ---- fixed values: text patterns and phrases ---------------------------------------------
BOILERPLATE = [
    "continue reading", "main story", "advertisement", "email address", "subscribe",
    "products and services", "special offers", "newsletter", "an error occurred",
    "try again later", "view new york times newsletters", "receive occasional",
]
HEBREW_STOP_WORDS = [
    "של", "על", "עם", "אל", "מן", "מ", "ל", "ב", "כ", "ש", "ו", "ה",
    "הוא", "היא", "הם", "הן", "אני", "אתה", "את", "אנחנו", "אתם", "אתן",
    "זה", "זאת", "יש", "אין", "היה", "היו", "גם", "כמו", "כל", "או", "אבל", "אם", "כי", "לא", "כן",
    "מה", "מי", "מתי", "איפה", "עוד", "רק",
]
ENGLISH_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "if", "because", "as", "of", "at", "by", "for", "with",
    "about", "against", "between", "into", "through", "during", "before", "after", "to", "from",
    "in", "out", "on", "over", "under", "again", "then", "once", "here", "there", "when", "where",
    "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such",
    "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "can", "will", "just",
    "should", "now",
]
HEBREW_MARKS = r"[֑-ׇ]"
NON_WORD_CHARS = r"(?U)[^0-9A-Za-z֐-׿\s]"
URL_PATTERN = r"(?U)(https?://\S+|www\.\S+)"
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CLICKBAIT_PHRASES = [
    "לא תאמינו", "מזעזע", "חובה לראות", "צפו", "בלעדי", "חשיפה",
    "you won't believe", "shocking", "must see", "exclusive", "what happened next", "watch now",
]
NUMBER_PATTERN = r"(?U)\b\d+(\.\d+)?\b"
CURRENCY_SIGNS = "$₪€£"

# ---- fixed values: augmentation alphabets ------------------------------------------------
EMOJIS = ["🙂", "🔥", "❗", "❓", "😮", "🤔", "📢", "💥"]
HOMOGLYPHS = {
    "O": "0", "o": "0", "I": "1", "l": "1", "B": "8", "S": "5", "s": "5", "E": "3", "e": "3",
}
TYPO_ALPHABET = "אבגדהוזחטיךכלםמןנסעףפץצקרשתabcdefghijklmnopqrstuvwxyz0123456789"

# ---- fixed values: context bins ----------------------------------------------------------
CONTEXT_KEYS = (
    "source", "category", "len_bin", "punc_bin", "clickbait", "hour_bin", "dow_bin", "age_bin",
)
CALIBRATION_KEYS = CONTEXT_KEYS[:5]
LENGTH_BINS = ([50, 150, 400], ["S", "M", "L", "XL"])
PUNCTUATION_BINS = ([0.005, 0.015, 0.04], ["P0", "P1", "P2", "P3"])
HOUR_BINS = ([6, 12, 18], ["H0", "H1", "H2", "H3"])
WEEKDAY_BINS = ([1, 5], ["D0", "D1", "D2"])
AGE_BINS = ([3, 7, 30], ["A0", "A1", "A2", "A3"])
UNKNOWN_AGE_DAYS = 9999

# ---- fixed values: threshold grid, the binary doubles of a step sequence --------------------
def _steps(start: float, step: float, n: int) -> list[float]:
    width = (start + step) - start
    return [start + i * width for i in range(n)]


GRID_LOWS = _steps(0.1, 0.05, 10)
GRID_HIGHS = _steps(0.4, 0.05, 10)
DEFAULT_TAU_LOW, DEFAULT_TAU_HIGH = 0.3, 0.7

# ---- fixed values: prompts -----------------------------------------------------------------
PROMPT_INSTRUCTION = "[INSTRUCTION] Decide if the news is FAKE or REAL."
TAG_REAL, TAG_FAKE = "<REAL>", "<FAKE>"
BACKGROUND_REQUEST = (
    "The following text is a news article or text post.\n"
    "Briefly summarize (up to ~{max_chars} characters) Neutral factual context:\n"
    "General concepts/background/events worth knowing to understand the topic.\n"
    "Do not declare whether the content is true or false, and do not include personally "
    "identifiable information.\n\n"
    "Text:\n"
)
