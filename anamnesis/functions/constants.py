"""Constants, word lists and tables whose values decide results."""

# Words that carry no signal.
STOPWORDS = tuple(
    """
    the and but for nor yet so with from into onto upon than that this these those there here
    you your yours she her hers him his they them their theirs we our ours ourself myself itself
    am is are was were be been being do does did doing done have has had having will would shall
    should can could may might must ought
    just also very really quite some any all more most other such only own same too s t don now
    get got make made want like well back
    over not instead rather off again further once no both each few about after before during
    through under above below between because why how what when where which who whom let lets
    please thanks hello hi hey yes sure
    or of my mine at by as in on it its via per if since until unless whether
    """.split()
)

# Short words that are kept.
SHORT_TOKENS = tuple("ai ml js ts go py os ui ux db ci cd qa vm io ip sh r c npm aws gcp api css sql gpu cpu ram ssh ftp".split())
MIN_TOKEN_LEN, MAX_NUMBER_LEN, MAX_QUERY_TERMS = 2, 4, 12

# Fixed values: (suffix, what replaces it, least length of the word), first match wins.
STEM_RULES = (
    ("sses", "ss", 5),
    ("ches", "ch", 5),
    ("shes", "sh", 5),
    ("iest", "y", 5),
    ("ies", "y", 4),
    ("ied", "y", 4),
    ("ier", "y", 4),
    ("xes", "x", 4),
    ("zes", "z", 4),
    ("ing", "", 5),
    ("ed", "", 4),
    ("ly", "", 5),
    ("s", "", 4),
)
STEM_KEEP_S = ("ss", "us", "is", "as", "os")

# Fixed values: (type, half-life in days, importance, days to live, user may write).
POLICY = (
    ("identity", 720.0, 0.95, None, True),
    ("preference", 365.0, 0.80, None, True),
    ("instruction", 540.0, 0.90, None, True),
    ("goal", 270.0, 0.85, None, True),
    ("project", 180.0, 0.75, None, True),
    ("fact", 120.0, 0.60, None, True),
    ("event", 21.0, 0.40, None, True),
    ("session", 3.0, 0.30, 2.0, False),
)
DEFAULT_TYPE = "fact"
TYPE_ALIASES = {
    "personal": "identity",
    "bio": "identity",
    "profile": "identity",
    "user": "identity",
    "persona": "identity",
    "prefs": "preference",
    "style": "preference",
    "settings": "preference",
    "rule": "instruction",
    "guideline": "instruction",
    "constraint": "instruction",
    "objective": "goal",
    "todo": "goal",
    "task": "goal",
    "repo": "project",
    "codebase": "project",
    "context": "project",
    "info": "fact",
    "knowledge": "fact",
    "memory": "fact",
    "log": "event",
    "activity": "event",
    "history": "event",
    "temporary": "session",
    "temp": "session",
    "ephemeral": "session",
}

# Retrieval.
RRF_K, MAGNITUDE_WEIGHT, MIN_MAGNITUDE_SPREAD = 60, 0.5, 0.02
MIN_SCORE, SHARPNESS, SALIENCE_WEIGHT, SALIENCE_BIAS, RECENCY_DAYS = 0.05, 2.0, 0.30, 0.70, 45.0
COVERAGE_BIAS, COVERAGE_WEIGHT, SUBJECT_WEIGHT, SUBJECT_SEED, SUBJECT_PREFIX = 0.4, 0.6, 0.6, 0.5, 0.35
MMR_LAMBDA, MAX_CANDIDATES, TOP_K = 0.7, 200, 6
VECTOR_FLOOR, VECTOR_STRONG, VECTOR_LIMIT, VECTOR_SCAN = 0.12, 0.55, 40, 5000
ESCALATION_SCORE, ESCALATION_COVERAGE = 0.35, 0.6
BM25_K1, BM25_B, BM25_MIN_IDF = 1.2, 0.75, 1e-6

# Duplicates and consolidation.
NEAR_DUPE, AUTO_MERGE, ASK_FLOOR, TRIGRAM_DISCOUNT, PROMOTION = 0.78, 0.88, 0.58, 0.92, 1.5
LOW_CONFIDENCE, LOW_IMPORTANCE, MAX_PAIRS, CONSOLIDATE_EVERY = 0.12, 0.35, 12, 25

# Decay and reinforcement.
FLOOR_WEIGHT, ARCHIVE_BELOW, WRITE_SKIP, FLOOR_SLACK, IDLE_DAYS = 0.35, 0.05, 0.005, 0.01, 365.0
BOOST, RELIEF, MIN_RATE, RELIEF_USES, MIN_HALF_LIFE = 0.12, 0.85, 1e-4, 8, 0.5
FORECAST_DAYS = (0, 7, 14, 30, 60, 90)

# Context, inbox and history.
CONTEXT_BUDGET, CONTEXT_IMPORTANCE, LINE_CHARS, HEDGE = 2400, 0.25, 220, 0.5
CONTEXT_HEADING = "What you know about the user"
GUIDANCE = (
    "These notes may be out of date: what the user says now counts, and what has no bearing on the request stays unsaid. "
    "Lasting facts that no file holds are worth a remember() call."
)
INBOX_CHARS, HISTORY_KEPT, HISTORY_PART = 4000, 8, 220

# Routing.
TECH_WORDS = tuple("implement debug architect analyze optimize design compare explain refactor algorithm function class error build write fix".split())
ROUTE_AT = 5

# Extraction.
EXTRACT_MIN, EXTRACT_MAX, EXTRACT_TOKENS, EXTRACT_PER_TURN, ECHO = 12, 4000, 2, 3, 0.4
COMMANDS = tuple(
    """run execute open create delete remove write read edit list show fix commit push pull build install
    search find explain refactor add update print cat cd ls grep make""".split()
)
SELF_MARKS = ("my ", "i ", "i'm", "i've", "call me", "prefer", "always")
TRUNCATE_AT = tuple("and but or so because then while when which who that although though however since until with for".split())
TRIM_WORDS = tuple(
    """the a an is am are i we my our me us use uses using prefer prefers live lives based work works
    working called call very really just""".split()
)
CONJUNCTIONS = ("and", "or", "&", "+")
CLAUSE_STARTERS = tuple("i we you he she they it my our me us im ive id the a an this that there then so but because".split())
# What a turn says of the user, as (trigger and capture, type, subject, importance, sentence; None: by the turn's
# words). Triggers ignore case, captures do not. Which turns give facts, their order and their sentences depend on each of them.
EXTRACT_PATTERNS = (
    (r"\b(?i:my name(?:'s| is)\s+)([A-Z][\w'-]*(?:\s+[A-Z][\w'-]*)?)", "identity", "user.name", 0.95, "The user's name is {}."),
    (r"\b(?i:call me\s+)([A-Z][\w'-]*)", "identity", "user.name", 0.95, "The user's name is {}."),
    (r"\b(?i:i(?:'m| am)\s+called\s+)([A-Z][\w'-]*)", "identity", "user.name", 0.95, "The user's name is {}."),
    (r"\b(?i:i (?:live|reside) in\s+)([A-Za-z][\w .'-]{2,40})", "identity", "user.location", 0.80, "The user lives in {}."),
    (r"\b(?i:i(?:'m| am) (?:based|located) in\s+)([A-Za-z][\w .'-]{2,40})", "identity", "user.location", 0.80, "The user lives in {}."),
    (r"\b(?i:i(?:'m| am) from\s+)([A-Z][\w .'-]{2,40})", "identity", "user.location", 0.75, "The user lives in {}."),
    (r"\b(?i:i(?:'m| am) an?\s+)([a-z][\w -]{0,30}?(?:developer|engineer|designer|student|manager|founder|researcher|analyst))", "identity", "user.role", 0.85, "The user is a {}."),
    (r"\b(?i:i (?:use|prefer)\s+)((?:the\s+)?[a-z0-9.+#-]{2,20}(?:\s*(?:,|and|or)\s*[a-z0-9.+#-]{2,20})*(?:\s+[a-z0-9.+#-]{2,20})?)", "preference", None, 0.70, None),
    (r"\b(?i:my favou?rite \w+ is\s+)([\w .+#-]{2,40})", "preference", None, 0.75, None),
    (r"\b(?i:i (?:really )?(?:hate|can't stand|dislike)\s+)([\w .+#-]{2,40})", "preference", None, 0.70, None),
    (r"\b(?i:always\s+)(.{8,120})", "instruction", None, 0.85, "The user has asked to always {}."),
    (r"\b(?i:never\s+)(.{8,120})", "instruction", None, 0.90, "The user has asked to never {}."),
    (r"\b(?i:from now on,?\s+)(.{8,120})", "instruction", None, 0.85, "From now on, the user will {}."),
    (r"\b(?i:don'?t ever\s+)(.{8,120})", "instruction", None, 0.90, "The user has asked to never {}."),
    (r"\b(?i:i(?:'m| am) (?:trying|working) to\s+)(.{5,120})", "goal", None, 0.80, "The user is trying to {}."),
    (r"\b(?i:my goal is to\s+)(.{5,120})", "goal", "goal.primary", 0.85, "The user is trying to {}."),
    (r"\b(?i:i want to\s+)(.{5,120})", "goal", None, 0.65, "The user is trying to {}."),
    (r"\b(?i:i(?:'m| am) (?:working on|building|developing)\s+)(.{5,120})", "project", None, 0.75, "The user is working on {}."),
    (r"\b(?i:remember that\s+)(.{8,200})", "fact", None, 0.70, "The user stated: {}."),
    (r"\b(?i:my (?:timezone|time zone) is\s+)([\w/ +-]{3,30})", "identity", "user.timezone", 0.70, "The user's timezone is {}."),
)
