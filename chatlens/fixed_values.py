"""Lists, maps, patterns and limits that results depend on.

Everything in this file is data. Operators take these values as arguments and
use them as defaults, so each can be replaced by the caller.
"""

# --- Fixed values: language heuristics -------------------------------------

# Characters that count as blank when trimming and splitting text.
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK_CLASS = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD_CLASS = r"\p{L}\p{N}_"

# Devanagari, Bengali, Gurmukhi, Gujarati, Odia, Tamil, Telugu, Kannada and
# Malayalam blocks, which follow each other without a gap.
INDIC_PATTERN = r"[\x{0900}-\x{0D7F}]"

ENGLISH_WORDS = [
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been",
    "before", "but", "by", "can", "come", "could", "day", "do", "for", "from", "get", "give", "go", "good",
    "have", "he", "her", "here", "him", "how", "i", "if", "in", "into", "is", "it", "its", "just", "know",
    "like", "long", "look", "make", "man", "many", "me", "more", "my", "new", "no", "not", "now", "of", "on",
    "one", "only", "or", "other", "our", "out", "people", "say", "see", "she", "so", "some", "take", "than",
    "that", "the", "their", "them", "then", "there", "these", "they", "thing", "think", "this", "those", "time",
    "to", "two", "up", "use", "very", "want", "was", "we", "well", "what", "when", "which", "who", "will",
    "with", "work", "would", "year", "you", "your",
]

ROMANISED_HINDI_WORDS = [
    "hai", "hain", "ho", "hona", "hogaa", "hoga", "honge", "hun", "hu", "hua", "haii", "kya", "kyu", "kyun",
    "kyon", "kaise", "kaisey", "kahaan", "kahan", "kab", "kar", "kare", "karen", "karenge", "kariye", "karo",
    "karna", "karne", "karte", "nahi", "nahin", "mujhe", "hum", "hume", "humko", "batao", "kripya", "mein",
    "mera", "meri", "mere", "tha", "thi", "tum", "unka", "unki", "unke", "vala", "wala", "wale", "wali", "ky",
    "kr", "raha", "rahe", "rahi", "sakta", "sakte", "sakthi", "sakti",
]

ENGLISH_MIN_RATIO = 0.4
HINDI_MIN_HITS = 2
HINDI_SINGLE_HIT_MAX_RATIO = 0.3
ENGLISH_MAX_DROP = 0.2

# Price in USD per million tokens.
INPUT_COST_PER_1M = 0.150
OUTPUT_COST_PER_1M = 0.600

# Strings that a CSV reader of the data-frame kind takes as missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# --- Fixed values: topic preparation ---------------------------------------

MIN_MESSAGE_TOKENS = 4

SHORT_RESPONSES = [
    "ok", "okay", "yes", "no", "yup", "nope", "sure", "done", "fine", "alright", "right", "k", "kk",
    "hmm", "hmmm", "hm", "h", "mhm", "mm", "mmm", "understood", "noted", "noted sir", "yes sir", "ok sir",
]

# The rules that use it add the anchor at the start and the word boundary, which differ between engines.
ASSISTANT_OPENERS = "sure|please provide|please share|provide|send|done|okay|ok|thank|thanks"
ASSISTANT_TEMPLATES = [
    "please provide (the )?text",
    "summari[sz]e this",
    "upload (your )?idea",
    "send (it|the details)",
    "share (the )?(details|text)",
]

# Phrase and the token that replaces it; applied in this order.
PHRASE_TOKENS = [
    ("people planet profit", "people_planet_profit"),
    ("triple bottom line", "triple_bottom_line"),
    ("entrepreneurial mindset", "entrepreneurial_mindset"),
    ("business model", "business_model"),
    ("social impact", "social_impact"),
    ("value proposition", "value_proposition"),
    ("customer segment", "customer_segment"),
    ("revenue stream", "revenue_stream"),
    ("cost structure", "cost_structure"),
    ("key resource", "key_resource"),
    ("key activity", "key_activity"),
    ("key partner", "key_partner"),
    ("problem solving", "problem_solving"),
    ("critical thinking", "critical_thinking"),
    ("team registration", "team_registration"),
    ("team register", "team_registration"),
    ("program deadline", "program_deadline"),
    ("submission deadline", "submission_deadline"),
    ("business idea", "business_idea"),
    ("project idea", "project_idea"),
    ("make product", "make_product"),
    ("build product", "make_product"),
    ("meaning of", "meaning_of"),
    ("translate into", "translate_into"),
    ("teacher support", "teacher_support"),
    ("mentor support", "teacher_support"),
    ("bb program", "bb_program"),
    ("kb purpose", "kb_purpose"),
    ("what next", "what_next"),
    ("account issue", "account_issue"),
    ("login issue", "login_issue"),
]

# Endings of English plural nouns and what stands in their place in the singular.
DETACHMENTS = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")]

# Irregular English plurals for the built-in lemmatiser.
# Nouns that the suffix rules would get wrong.
IRREGULAR_NOUNS = {
    "analyses": "analysis", "aliases": "alias", "biases": "bias", "bonuses": "bonus", "buses": "bus", "calories": "calorie",
    "calves": "calf", "campuses": "campus", "canvases": "canvas", "censuses": "census", "children": "child",
    "cookies": "cookie", "crises": "crisis", "criteria": "criterion", "echoes": "echo", "elves": "elf", "feet": "foot",
    "focuses": "focus", "gases": "gas", "geese": "goose", "goes": "go", "gurus": "guru", "halves": "half", "heroes": "hero",
    "hypotheses": "hypothesis", "knives": "knife", "leaves": "leaf", "lenses": "lens", "lives": "life", "loaves": "loaf",
    "men": "man", "menus": "menu", "mice": "mouse", "movies": "movie", "phenomena": "phenomenon", "potatoes": "potato",
    "quizzes": "quiz", "selfies": "selfie", "selves": "self", "shelves": "shelf", "statuses": "status", "taxis": "taxi",
    "teeth": "tooth", "theses": "thesis", "thieves": "thief", "tomatoes": "tomato", "viruses": "virus", "wives": "wife",
    "wolves": "wolf", "women": "woman", "zombies": "zombie",
}
# Words in -s that are no plurals.
UNCHANGED_NOUNS = [
    "always", "perhaps", "besides", "sometimes", "towards", "afterwards", "nowadays", "whereas", "series", "species",
    "news", "thanks", "alias", "atlas", "bias", "canvas", "christmas", "lens", "chaos", "mathematics", "physics",
    "economics", "electronics", "politics", "athletics",
]

SEED_TOPICS = [
    ["register", "team", "portal"],
    ["program", "deadline", "submit"],
    ["business", "idea", "help"],
    ["product", "make", "material"],
    ["translation", "meaning", "english"],
    ["teacher", "support", "mentor"],
    ["purpose", "kb", "use"],
    ["task", "today", "next"],
    ["account", "profile", "login"],
    ["eligibility", "rules", "program"],
]

ENGLISH_STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they",
    "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at",
    "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most",
    "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "don", "should", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren",
    "couldn", "didn", "doesn", "hadn", "hasn", "haven", "isn", "ma", "mightn", "mustn", "needn", "shan",
    "shouldn", "wasn", "weren", "won", "wouldn",
]

PLATFORM_STOPWORDS = [
    "kbc", "portal", "please", "clarify", "thanks", "thank", "hello", "hi", "hey", "okay", "ok", "yes", "no",
    "yeah", "fine", "sir", "madam", "ma'am", "maa'm", "pls", "plz", "dear", "regards", "understood", "noted",
    "done", "teacher", "respected", "nice", "great", "thankyou", "super", "awesome", "chat", "message",
    "messages", "cluster", "clusters", "theme", "themes", "topic", "topics", "conversation", "conversations",
    "sure", "provide", "upload", "summarize", "send", "kindly",
]

FILLER_STOPWORDS = ["eh", "ah", "uh", "mm", "mmm", "hm", "hmm", "um", "umm", "ya", "yo"]

# --- Fixed values: topic labels --------------------------------------------

BANNED_LABEL_WORDS = [
    "chat", "message", "messages", "cluster", "clusters", "theme", "themes", "topic", "topics",
    "conversation", "conversations",
]
BANNED_LABEL_PARTS = ["sure", "please", "provide", "help request", "label accordingly", "assistant"]

INTENT_WORDS = {
    "register": "Registration",
    "registration": "Registration",
    "signup": "Registration",
    "log": "Registration",
    "deadline": "Deadlines",
    "deadlines": "Deadlines",
    "submit": "Submission",
    "submission": "Submission",
    "translate": "Translation Help",
    "translation": "Translation Help",
    "meaning": "Translation Help",
    "idea": "Idea Support",
    "ideas": "Idea Support",
    "profile": "Account Support",
    "account": "Account Support",
    "teacher": "Teacher Support",
    "mentor": "Teacher Support",
    "product": "Product Support",
    "materials": "Product Support",
    "purpose": "Program Purpose",
    "kb": "Program Purpose",
}

TOO_SPECIFIC_PARTS = [
    "colgate", "neem", "orange", "mat", "pistachio", "dairy", "sock", "instagram", "facebook", "whatsapp",
]

# --- Fixed values: limits ---------------------------------------------------

AGENCY_HIGH = 0.3
AGENCY_LOW = -0.3
AGENCY_NEUTRAL_BAND = 0.15
AGENCY_MAX_TOKENS = 256
AGENCY_BATCH_SIZE = 32
SENTIMENT_BATCH_SIZE = 16
SENTIMENT_MAX_TOKENS = 512
SENTIMENT_LABELS = ["1 star", "2 stars", "3 stars", "4 stars", "5 stars"]
HISTOGRAM_BINS = 40
SAMPLE_SEED = 42

MIN_TERM_DOCS = 3
MAX_TERM_SHARE = 0.65
MIN_CLUSTER_SIZE = 15
MIN_SAMPLES = 5
REDUCED_DIMENSIONS = 5
MERGE_THRESHOLD = 0.95
MAX_MERGES = 2
LOW_QUALITY_TOKENS = 3
LOW_QUALITY_ASSISTANT_SHARE = 0.6
TOPIC_COUNT_RANGE = (10, 30)
MIN_DIVERSITY = 0.6

# --- Word lists of the built-in scorers (not taken from any model) ----------

POSITIVE_WORDS = [
    "good", "great", "nice", "excellent", "helpful", "happy", "love", "like", "thanks", "thank", "best",
    "better", "easy", "clear", "useful", "success", "win", "awesome", "amazing", "interesting", "enjoy", "glad",
    "excited", "proud", "perfect", "support", "correct", "right", "fine",
]
NEGATIVE_WORDS = [
    "bad", "worse", "worst", "hard", "difficult", "confused", "confusing", "problem", "issue", "error", "wrong",
    "fail", "failed", "failure", "sad", "angry", "hate", "boring", "useless", "unclear", "stuck", "lost",
    "slow", "broken", "late", "never", "cannot", "unable",
]
AGENTIC_WORDS = [
    "achieve", "build", "change", "choose", "create", "decide", "design", "develop", "goal", "improve",
    "initiative", "lead", "learn", "make", "plan", "prepare", "solve", "start", "try", "win", "work", "manage",
    "organise", "register", "submit", "sell", "launch",
]
PASSIVE_WORDS = [
    "cannot", "confused", "depend", "difficult", "fail", "failed", "forced", "helpless", "impossible", "lost",
    "must", "never", "problem", "stuck", "told", "unable", "wait", "waiting", "worried", "afraid", "hopeless",
]
AGENCY_SCALE = 5.0
