"""Default rule tables of lease review.  Every operator takes these as parameters."""

# --- Fixed values: words, patterns, messages and limits that results depend on ---

RETRIEVAL_STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "of", "to", "for", "in", "on",
    "and", "or", "there", "any", "does", "do", "what", "who", "how", "i", "my",
    "this", "that", "it", "be", "can", "may", "has", "have", "with", "at",
)

GROUNDING_STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "of", "to", "for", "in", "on", "and",
    "or", "shall", "will", "not", "be", "by", "at", "with", "this", "that", "it", "as",
    "any", "if", "may", "must", "such", "under", "upon", "which", "who", "whom",
)

LABELS = ("GREEN", "YELLOW", "RED")
RATING_WORDS = {"GREEN": "Looks standard", "YELLOW": "Worth a look", "RED": "Needs attention"}
STATES = ("Maharashtra", "Delhi")
CENTRAL = "Central"

MAHARASHTRA_SIGNALS = r"(?i)\b(maharashtra|mumbai|pune|nagpur|thane|navi mumbai|nashik|andheri|bandra)\b"
DELHI_SIGNALS = r"(?i)\b(delhi|new delhi|ncr)\b"
OTHER_STATE_SIGNALS = (
    ("Karnataka", r"(?i)\b(karnataka|bengaluru|bangalore|mysuru|mysore)\b"),
    ("Tamil Nadu", r"(?i)\b(tamil nadu|chennai|coimbatore|madurai)\b"),
    ("Uttar Pradesh", r"(?i)\b(uttar pradesh|lucknow|kanpur|noida|ghaziabad)\b"),
    ("West Bengal", r"(?i)\b(west bengal|kolkata|howrah)\b"),
    ("Punjab", r"(?i)\b(punjab|chandigarh|ludhiana|amritsar)\b"),
    ("Rajasthan", r"(?i)\b(rajasthan|jaipur|jodhpur|udaipur)\b"),
    ("Gujarat", r"(?i)\b(gujarat|ahmedabad|surat|vadodara)\b"),
)

TOPICS = (
    ("security_deposit", r"(?i)\b(security deposit|deposit)\b"),
    ("eviction", r"(?i)\b(evict|terminat|re-?enter|forfeit|repossess|vacate)\w*"),
    ("maintenance", r"(?i)\b(maintain|maintenance|repair)\w*"),
    ("rent_escalation", r"(?i)\b(rent|licen[cs]e fee)\w*\s+\w*\s*(increase|escalat|enhance)"),
    ("registration", r"(?i)\b(regist(er|ration)|stamp duty)\w*"),
    ("notice", r"(?i)\bnotice\b"),
)

#: Lower-case words one of which is, in either case, in any text that a rule of TOPICS finds, or that has a signal of a state.
TOPIC_WORDS = (
    "deposit", "evict", "terminat", "reenter", "re-enter", "forfeit", "repossess", "vacate", "maintain", "maintenance",
    "repair", "increase", "escalat", "enhance", "register", "registration", "stamp duty", "notice",
)
STATE_WORDS = (
    "maharashtra", "mumbai", "pune", "nagpur", "thane", "nashik", "andheri", "bandra", "delhi", "ncr",
    "karnataka", "bengaluru", "bangalore", "mysuru", "mysore", "tamil nadu", "chennai", "coimbatore", "madurai",
    "uttar pradesh", "lucknow", "kanpur", "noida", "ghaziabad", "west bengal", "kolkata", "howrah",
    "punjab", "chandigarh", "ludhiana", "amritsar", "rajasthan", "jaipur", "jodhpur", "udaipur",
    "gujarat", "ahmedabad", "surat", "vadodara",
)

NUMBER = r"\d{1,3}(?:,\d{3})*(?:\.\d+)?"
STATUTE_REFERENCE = r"(?i)\b(section|sec\.?)\s+\d+[a-zA-Z()0-9.]*|\b\d{4}\s+act\b|\bact,?\s+\d{4}\b"
CONCLUSIONS = (
    r"\bis illegal\b",
    r"\bis void\b",
    r"\bis unenforceable\b",
    r"\bis not enforceable\b",
    r"\bis not legal\b",
    r"\byou can void\b",
    r"\bthis (clause|term) is invalid\b",
)
VERDICTS = (
    *CONCLUSIONS,
    r"\b(?:is|are) (?:perfectly |completely |fully )?(?:legal|lawful|valid|enforceable)\b",
    r"\b(?:is|are) (?:unlawful|invalid)\b",
)
ID_TOKEN = r"\b(?:c\d{3}|[A-Z]{2,}_[A-Z]+_\d{3})\b"
LIST_MARKER = r"(?m)^\s*\d+[.)]\s"
BULLET = r"(?m)^\s*[-*] "
MIN_OVERLAP_RATIO = 0.20
MIN_OVERLAP_WORDS = 2
MIN_CONCERN_CHARS = 20

NUMBERED_HEADING = r"^(?:(?i:clause|article|section|para(?:graph)?)\s+)?(\d+)\.\s+([A-Za-z][A-Za-z &'\-/]{2,60}?)\.\s+(?=[A-Z\"“(])"
CAPS_HEADING = r"^(?:(?i:clause|article|section|para(?:graph)?)\s+)?(?:\d+[.)]\s+)?([A-Z][A-Z &'\-/()]{2,45}?)\s+(?=[A-Z][a-z]|•)"
COLON_HEADING = r"^([A-Z][A-Za-z][A-Za-z ,/&'\-]{1,44}):\s+(?=\S)"
CLAUSE_NUMBER = r"^(?:(?i:clause|article|section|para(?:graph)?)\s+)?(\d+(?:\.\d+)+|\d+(?=[.)]\s*[A-Z(])|[IVXLC]+(?=[.)]\s))"
INLINE_NUMBER = r"(?<![\w.])(\d{1,3})((?:\.\d{1,2})*)[.)]\s*(?=[A-Z\"“(])"
SENTENCE_ENDS = (".", ";", ":", "!", "?", ")", "”", '"', "-", "–", "—")
BULLET_LINE = r"^\s*[•▪◦‣·*]\s+"
ARTICLE = r"^(?i:ARTICLE|SECTION|CHAPTER|PART)\s+(?:[IVXLC]+|\d+)\s*[-–—:.]*\s*([A-Z]{2,}(?:[ &'()/-]+[A-Z]{2,})*)?\s*(.*)$"
STANDALONE_HEADING = r"^[(A-Z0-9][A-Z0-9 &,.'\-/()]{2,60}:?$"
CLOSING_FORMULA = r"(?i)^IN\s+WITNESS(?:ES)?\s+WHERE"
INLINE_BANNER = r"^([A-Z][A-Z0-9 &,'/()-]{2,60}):\s+(?=\d+[.)]\s)"
SIGNATURE_RUN = r"(?:[A-Z][A-Z\s.0-9]*:|\d{1,2}\.)\s*_{3,}[\s_]*"
DEED_CONNECTOR = r"^(BETWEEN|AND|WITNESSETH)\b\s*:?\s+(?=\S)"
SECTION_DIVIDER = r"^[A-Z0-9][^a-z]{10,}[;:]\s*$"
DEFINED_TERM_OPENING = r"^[A-Z]{2,}\s+[a-z]"
NUMBERED_OPENING = r"^(?:\d{1,3}|[IVXLC]+)[.)]"
BARE_HEADING_CHARS = 60
HEADING_WORDS, HEADING_CHARS = 5, 45
TITLE_PARAGRAPHS, TITLE_CHARS = 3, 150

BULLET_GLYPHS = (127, 149, 183)
PAGE_TEXT_CHARS = 20
LINE_TOLERANCE = 3.0
PARAGRAPH_GAP = 1.35

SAME_LINE = 0.012
SEARCH_WINDOW = 4000
MAX_SKIP = 6
MIN_COVERAGE = 0.6

PARTY_A = r"\b(licensee|tenant|lessee)\b"
PARTY_B = r"\b(licensor|landlord|lessor|owner)\b"
PROPERTY = r"\b(licensed premises|premises|demised premises|rented premises|said property)\b"
AMOUNT = r"rs\.?\s?[\d,]+"
LEADING_NUMBER = r"^\s*(?:\d+(?:\.\d+)*[.)])\s*"
BLANK = r"(?:_{2,}|\.{4,}|…+|-{3,}\s*\(\d+[A-Z]?\)\s*-*|-{3,})"
COVERAGE_TOKEN = r"[A-Za-z0-9][A-Za-z0-9'/,.\-]*"

ERROR_CLASSIFICATION = "The risk level could not be determined for this clause."
ERROR_LIMIT = "The AI provider's daily limit was reached, so no explanation was generated."
ERROR_OTHER = "An explanation could not be generated for this clause."
LIMIT_MARKERS = ("daily limit", "rate limit", "quota", "429")

SMALL_WORDS = ("and", "of", "the")
CITIES = ("mumbai", "bangalore", "chennai", "lucknow", "kolkata", "chandigarh", "jaipur", "pune")

UPLOAD_TYPES = ("application/pdf", "image/jpeg", "image/png")
UPLOAD_BYTES = 20 * 1024 * 1024
LIST_LIMIT = 12
QUESTION_CHARS, TURN_CHARS, HISTORY_TURNS = 1000, 1000, 6
CONTEXT_CLAUSES, CONTEXT_CHARS, CONTEXT_STATUTES = 6, 6000, 4
EXCERPT_CHARS, SNIPPET_CHARS = 700, 140
SHORTLIST_TOP, SHORTLIST_SIMILARITY = 2, 0.25
DEDUP_SIMILARITY, CLOSE_SIMILARITY, BLOCK_ROWS = 0.95, 0.90, 30
SYNTHETIC_GROUP_OFFSET = 1_000_000
RETENTION_HOURS, STALE_MINUTES, LIMITER_SECONDS = 24, 15, 3600
WILSON_Z = 1.96
CONFIDENT = 0.8
C_GRID = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0)
TEMPERATURE_RANGE = (0.3, 5.0)
PROBABILITY_FLOOR = 1e-9
