"""Values that results depend on.

Fixed values: the word lists, patterns and thresholds below define what counts
as spam, sarcasm, an anomaly and so on. They are data, not logic; every
operator takes them as defaults and accepts others as arguments.
"""

from __future__ import annotations

# --- Fixed values: speech markers -------------------------------------------
SARCASM_MARKERS = ("not", "but", "however", "though", "although")

INTENSIFIERS = ("very", "extremely", "absolutely", "incredibly", "unbelievably")
SUPERLATIVES = ("best", "worst", "amazing", "terrible", "horrible", "fantastic")
ABSOLUTES = ("never", "always", "every", "all")

FIRST_PERSON = ("i", "me", "my", "mine", "we", "our", "us")
EXPERIENCE_VERBS = ("think", "feel", "believe", "experience", "tried", "used")

ADVICE_WORDS = ("recommend", "suggest", "advise", "should", "must", "worth")
PRAISE_WORDS = ("good", "great", "excellent", "worth", "value")

# --- Fixed values: thresholds -----------------------------------------------
EXTREME_POLARITY = 0.8
HIGH_INTENSITY = 0.7
HIGH_BAND = 0.5
MAX_SEVERITY = 3
RECONSTRUCTION_THRESHOLD = 0.1
SCORE_CUT = 0.5

# --- Fixed values: sizes ----------------------------------------------------
MAX_FEATURES = 1000
MIN_DF = 2
TOP_KEYWORDS = 20
TOP_CATEGORIES = 10
PCA_COMPONENTS = 50
FOREST_TREES = 100
SEED = 42

# --- Fixed values: review types, in chart order -----------------------------
REVIEW_TYPES = ("Emotional", "Sarcastic", "Exaggerated", "Personal", "Recommendation")

# --- Fixed values: contractions a word tokeniser splits in two ---------------
CONTRACTIONS = {
    "cannot": ("can", "not"),
    "gimme": ("gim", "me"),
    "gonna": ("gon", "na"),
    "gotta": ("got", "ta"),
    "lemme": ("lem", "me"),
    "wanna": ("wan", "na"),
}

# --- Fixed values: review date formats, tried in order -----------------------
REVIEW_DATE_FORMATS = ("MM d, yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")

# --- Fixed values: cells a CSV reader of data frames takes as missing ---------
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- Fixed values: CSV header names and what they are called here -------------
CSV_RENAMES = {
    "Title": "title",
    "description": "text",
    "authors": "author",
    "ratingsCount": "rating",
    "categories": "category",
}

# --- Fixed values: word lists, one entry per line, word|category|severity -----
INAPPROPRIATE_WORDS = """
fuck|profanity|5
shit|profanity|4
damn|profanity|3
hell|profanity|2
ass|profanity|3
hate|hate_speech|4
racist|hate_speech|5
bigot|hate_speech|4
discriminate|hate_speech|3
prejudice|hate_speech|3
sex|adult_content|4
nude|adult_content|4
porn|adult_content|5
explicit|adult_content|3
adult|adult_content|2
kill|violence|4
murder|violence|5
attack|violence|3
abuse|violence|4
harm|violence|3
"""

QUALITY_INDICATORS = """
excellent|positive|5
amazing|positive|5
outstanding|positive|5
perfect|positive|5
brilliant|positive|4
terrible|negative|5
awful|negative|5
horrible|negative|5
poor|negative|4
disappointing|negative|4
average|neutral|3
okay|neutral|2
decent|neutral|3
fair|neutral|3
moderate|neutral|3
"""

SPAM_INDICATORS = """
free|promotional|3
discount|promotional|2
sale|promotional|2
offer|promotional|2
limited time|promotional|3
exclusive|promotional|2
buy now|promotional|4
special offer|promotional|3
deal|promotional|2
bonus|promotional|2
act now|urgency|4
hurry|urgency|3
expires soon|urgency|3
last chance|urgency|4
only today|urgency|3
don't wait|urgency|3
time sensitive|urgency|3
urgent|urgency|4
immediate|urgency|3
deadline|urgency|3
guaranteed|deception|4
risk free|deception|4
no risk|deception|3
100% free|deception|4
you won|deception|5
congratulations|deception|3
selected winner|deception|5
prize|deception|4
lottery|deception|5
inheritance|deception|5
make money|financial|4
earn fast|financial|4
get rich|financial|5
income|financial|3
investment|financial|3
profit|financial|3
cash|financial|3
money back|financial|3
no fees|financial|4
free money|financial|5
you won't believe|clickbait|4
shocking|clickbait|3
amazing|clickbait|3
unbelievable|clickbait|4
secret|clickbait|3
revealed|clickbait|3
miracle|clickbait|4
life-changing|clickbait|4
revolutionary|clickbait|3
discover|clickbait|2
"""

# --- Fixed values: speech pattern list, phrase, category, severity ------------
SPEECH_PATTERNS = """
excited, emotion_positive, 4
thrilled, emotion_positive, 4
delighted, emotion_positive, 4
amazed, emotion_positive, 4
wonderful, emotion_positive, 4
disappointed, emotion_negative, 4
frustrated, emotion_negative, 4
angry, emotion_negative, 4
upset, emotion_negative, 4
heartbroken, emotion_negative, 5
absolutely, intensity, 3
completely, intensity, 3
totally, intensity, 3
extremely, intensity, 3
incredibly, intensity, 3
barely, intensity, 2
slightly, intensity, 2
somewhat, intensity, 2
moderately, intensity, 2
partially, intensity, 2
yeah right, sarcasm, 4
sure thing, sarcasm, 3
whatever, sarcasm, 3
as if, sarcasm, 3
right, sarcasm, 3
obviously, sarcasm, 3
clearly, sarcasm, 3
of course, sarcasm, 3
definitely, sarcasm, 3
absolutely, sarcasm, 3
best ever, exaggeration, 4
worst ever, exaggeration, 4
never again, exaggeration, 4
always, exaggeration, 3
never, exaggeration, 3
every time, exaggeration, 3
constantly, exaggeration, 3
forever, exaggeration, 3
endless, exaggeration, 3
infinite, exaggeration, 3
better than, comparison, 3
worse than, comparison, 3
compared to, comparison, 2
similar to, comparison, 2
different from, comparison, 2
unlike, comparison, 2
versus, comparison, 2
relative to, comparison, 2
in contrast to, comparison, 2
as opposed to, comparison, 2
maybe, uncertainty, 2
perhaps, uncertainty, 2
possibly, uncertainty, 2
might, uncertainty, 2
could be, uncertainty, 2
not sure, uncertainty, 2
unsure, uncertainty, 2
doubtful, uncertainty, 2
questionable, uncertainty, 2
debatable, uncertainty, 2
highly recommend, recommendation, 4
strongly suggest, recommendation, 4
must read, recommendation, 4
worth it, recommendation, 3
skip it, recommendation, 3
avoid, recommendation, 3
consider, recommendation, 2
think about, recommendation, 2
look into, recommendation, 2
check out, recommendation, 2
my experience, personal, 3
i found, personal, 3
i think, personal, 3
in my opinion, personal, 3
from my perspective, personal, 3
i believe, personal, 3
i feel, personal, 3
i would, personal, 3
i have, personal, 3
i will, personal, 3
recently, time, 2
lately, time, 2
nowadays, time, 2
currently, time, 2
these days, time, 2
in the past, time, 2
previously, time, 2
before, time, 2
after, time, 2
since, time, 2
worthless, value, 4
priceless, value, 4
valuable, value, 3
useful, value, 3
helpful, value, 3
beneficial, value, 3
pointless, value, 3
waste, value, 3
investment, value, 3
quality, value, 3
"""

DEFAULT_WORD_LISTS = {
    "inappropriate_words": INAPPROPRIATE_WORDS,
    "quality_indicators": QUALITY_INDICATORS,
    "spam_indicators": SPAM_INDICATORS,
}

# A small sentiment lexicon of our own; scores lie in [-1, 1].
DEFAULT_LEXICON = {
    "excellent": 1.0, "perfect": 1.0, "wonderful": 1.0, "best": 1.0,
    "amazing": 0.8, "brilliant": 0.9, "great": 0.8, "love": 0.7, "loved": 0.7,
    "good": 0.7, "enjoyed": 0.6, "nice": 0.6, "happy": 0.8, "useful": 0.3,
    "helpful": 0.4, "interesting": 0.5, "fun": 0.4, "recommend": 0.4,
    "fair": 0.3, "decent": 0.2, "okay": 0.1,
    "worst": -1.0, "terrible": -1.0, "awful": -1.0, "horrible": -1.0,
    "hate": -0.8, "hated": -0.8, "bad": -0.7, "boring": -0.9, "poor": -0.4,
    "disappointing": -0.6, "disappointed": -0.7, "waste": -0.3, "dull": -0.4,
    "slow": -0.3, "worthless": -0.8, "stupid": -0.8, "weak": -0.4,
}
