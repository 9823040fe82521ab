"""Lists, patterns, labels and constants that results depend on.

Everything here is data, stated in its natural order.  The logic that uses it
lives in the sibling modules.
"""

# --- fixed values: thresholds and limits --------------------------------------
DUPLICATE_THRESHOLD = 0.85
POSSIBLE_DUPLICATE_THRESHOLD = 0.50
TOP_MATCHES = 5
SEARCH_DEFAULT_K = 10
SEARCH_MAX_K = 50
MAX_PER_PAGE = 100
PREVIEW_CHARS = {"title": 120, "raw_description": 1000, "combined_text": 1500, "normalized_text": 500}
N_CLUSTERS = 12
N_RECLUSTERS = 5
MIN_NORMALIZED_CHARS = 10
UNTITLED = "Untitled Bug Report"

# --- fixed values: the characters a Unicode-aware strip removes ----------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: cleaning patterns, applied in this order --------------------
CLEANING_PATTERNS = [
    (r"https?://\S+|www\.\S+", " urltoken "),
    (r"\S+@\S+\.\S+", " emailtoken "),
    (r"<[^>]+>", " "),
    (r"\b[0-9a-f]{7,40}\b", " hashtoken "),
    (r"0x[0-9a-fA-F]+", " hextoken "),
    (r"[/\\][\w./\\-]+\.\w+", " filepathtoken "),
    (r"\b\d+\.?\d*\b", " numtoken "),
]

# --- fixed values: title prefix -------------------------------------------------
TITLE_PREFIX = r"^(bug|issue|defect|report)\s*[:#-]?\s*"

# --- fixed values: section header patterns, tried in list order ------------------
SECTION_PATTERNS = {
    "steps": [
        r"steps\s*to\s*reproduce",
        r"stm|str",
        r"reproduction\s*steps",
        r"how\s*to\s*reproduce",
    ],
    "expected": [
        r"expected\s*(?:result|behavior|outcome|output)",
        r"should\s*(?:be|show|display|work)",
    ],
    "actual": [
        r"actual\s*(?:result|behavior|outcome|output)",
        r"what\s*happened",
        r"instead",
    ],
    "environment": [
        r"environment",
        r"platform",
        r"os\s*version",
        r"browser\s*version",
        r"system\s*info",
        r"build\s*id",
        r"user\s*agent",
    ],
    "logs": [
        r"log\s*(?:output|file|message)",
        r"stack\s*trace",
        r"error\s*(?:message|log|output)",
        r"traceback",
        r"console\s*output",
    ],
}
NEXT_HEADER = (
    r"\n\s*(?:steps|expected|actual|environment|log|stack|error|platform|os|browser)"
)

# --- fixed values: required fields, their labels and suggestions -----------------
REQUIRED_FIELDS = [
    ("title", "Bug title/summary", "Add a concise, descriptive title summarizing the bug"),
    ("description", "Detailed description", "Provide a detailed description of the issue"),
    (
        "steps",
        "Steps to reproduce",
        "List numbered steps to reproduce the bug (e.g., 1. Open app 2. Click X)",
    ),
    ("expected", "Expected result", "Describe what you expected to happen"),
    ("actual", "Actual result", "Describe what actually happened"),
    ("environment", "Environment details", "Include OS, browser/app version, device info"),
    (
        "severity",
        "Severity level",
        "Rate severity: blocker, critical, major, normal, minor, trivial",
    ),
]
LOGS_SUGGESTION = ("logs", "Logs", "Attach relevant error logs or stack traces")

# --- fixed values: severity fold ------------------------------------------------
SEVERITY_FOLD = {
    "blocker": "Critical",
    "critical": "Critical",
    "major": "High",
    "high": "High",
    "normal": "Medium",
    "medium": "Medium",
    "minor": "Low",
    "low": "Low",
    "trivial": "Low",
}

# --- fixed values: display names of clusters --------------------------------------
CLUSTER_NAMES = [
    "C1: Security & Authentication Failures",
    "C2: UI Rendering & Visual Layout Bugs",
    "C3: Performance Degradation & Latency",
    "C4: Data Corruption & Processing Errors",
    "C5: Network, API & Connectivity Issues",
    "C6: Build, Package & Configuration Errors",
    "C7: Memory Leaks & Resource Exhaustion",
    "C8: Application Crashes & System Stability",
    "C9: File System & I/O Operations",
    "C10: Database & Query Execution Bugs",
    "C11: Concurrency, Threading & Race Conditions",
    "C12: Plugin, Extension & Integration Failures",
    "C13: Browser Compatibility & Web Standards",
    "C14: Logging, Monitoring & Observability",
    "C15: Test Failures & CI/CD Pipeline",
    "C16: Mobile & Responsive Design Issues",
    "C17: Dependency & Version Conflicts",
    "C18: Documentation & Error Messaging",
    "C19: Search & Indexing Defects",
    "C20: Distributed Systems & Cluster Coordination",
]

# --- fixed values: words skipped when picking cluster keywords ---------------------
KEYWORD_STOPWORDS = [
    "created", "by", "on", "the", "a", "an", "in", "to", "for", "and", "is",
    "was", "it", "of", "at", "from", "with",
]

# --- fixed values: words the stopword audit looks for ------------------------------
AUDIT_STOPWORDS = [
    "the", "is", "at", "which", "on", "a", "an", "and", "or", "but", "in", "of",
    "to", "for", "it", "this", "that", "with", "as", "by",
]

# --- fixed values: question intents, first rule that fires wins ---------------------
# Each rule is (intent, [alternatives]); an alternative is a list of words that must
# all occur in the lower-cased question.
INTENT_RULES = [
    ("cluster_dist", [["cluster", "show"], ["cluster", "dist"], ["cluster", "break"]]),
    ("clusters", [["cluster"]]),
    ("severity", [["sever"], ["priority"]]),
    ("triage", [["decision"], ["duplic"], ["triage"]]),
    ("totals", [["total"], ["how many"], ["count"], ["stat"]]),
    ("project_cassandra", [["cassandra"]]),
    ("project_firefox", [["firefox"], ["mozilla"]]),
    ("project_hadoop", [["hadoop"]]),
    ("project_spark", [["spark"]]),
    ("project_vscode", [["vscode"], ["vs code"], ["visual studio code"]]),
    ("project_hbase", [["hbase"]]),
    ("project_thunderbird", [["thunderbird"]]),
    ("datasets", [["dataset"], ["project"], ["source"]]),
    ("search", [["search"], ["find"], ["look"]]),
    ("help", [["help"], ["what can"]]),
]
INTENT_FALLBACK = "fallback_search"
SEARCH_TERM_PATTERN = r"search|find|look for|look up"

# --- fixed values: English stopwords --------------------------------------------
# The widely published English list.  Entries with an apostrophe are left out: the
# cleaning step turns apostrophes into spaces, so such an entry could never match.
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what
which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for
with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn
hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()

# --- fixed values: nouns whose lemma no suffix rule gives ---------------------------
LEMMA_EXCEPTIONS = {
    "children": "child",
    "feet": "foot",
    "geese": "goose",
    "mice": "mouse",
    "teeth": "tooth",
    "indices": "index",
    "matrices": "matrix",
    "vertices": "vertex",
    "appendices": "appendix",
    "analyses": "analysis",
    "bases": "base",
    "crises": "crisis",
    "hypotheses": "hypothesis",
    "parentheses": "parenthesis",
    "theses": "thesis",
    "buses": "bus",
    "statuses": "status",
    "viruses": "virus",
    "leaves": "leaf",
    "halves": "half",
    "lives": "life",
    "shelves": "shelf",
    "threads": "thread",
    "movies": "movie",
    "cookies": "cookie",
    "always": "always",
    "across": "across",
    "afterwards": "afterwards",
    "besides": "besides",
    "news": "news",
    "perhaps": "perhaps",
    "series": "series",
    "sometimes": "sometimes",
    "species": "species",
    "towards": "towards",
    "unless": "unless",
    "whereas": "whereas",
}
# Ordered (suffix, replacement); the first suffix that fits applies.
LEMMA_SUFFIXES = [
    ("ss", "ss"),
    ("us", "us"),
    ("is", "is"),
    ("ies", "y"),
    ("sses", "ss"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("xes", "x"),
    ("zes", "z"),
    ("men", "man"),
    ("s", ""),
]
