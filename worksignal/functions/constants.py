"""Fixed values.

These word lists, patterns and thresholds decide results, so they are stated as they are.
"""

# --- fixed values: words that are no title keywords ---
TITLE_STOP_WORDS = (
    "a", "an", "the", "of", "for", "and", "or", "on", "in", "to", "with",
    "is", "are", "at", "by", "from", "this", "that",
    "fix", "get", "now", "due", "new", "add", "run", "set", "put", "use",
    "our", "you", "all", "not", "but", "yet", "off", "out", "via",
)

# --- fixed values: further words dropped from prose ---
PROSE_STOP_WORDS = (
    "you", "your", "yours", "have", "has", "had", "do", "does", "did",
    "already", "need", "needs", "needed", "today", "yesterday", "tomorrow",
    "top", "yet", "was", "were", "will", "would", "could", "should",
    "also", "just", "still", "get", "gets", "got", "make", "makes",
    "made", "may", "might", "can", "cannot", "into", "onto", "any",
    "some", "when", "then", "than", "more", "most", "much", "many",
    "over", "before", "after", "again", "here", "there", "what", "which",
    "who", "whom",
)

# --- fixed values: keyword matching ---
KEYWORD_PATTERN = "[A-Za-z][A-Za-z'-]*"
IDENTIFIER_PATTERN = "#\\d+"
MIN_KEYWORD_LENGTH = 3
MIN_MATCH_RATIO = 0.4
COMMON_TERM_THRESHOLD = 0.5
MIN_SOURCES_FOR_COMMON_FILTER = 4
EXCERPT_WINDOW = 250

# --- fixed values: mail ---
SIGNATURE_PREFIXES = (
    "--", "best,", "cheers,", "regards,", "thanks,", "warmly,", "sincerely,",
    "best regards,", "many thanks,", "slack", "pagerduty", "jira",
    "thanks for", "talk soon",
)
SIGNATURE_LINES = 5
BODY_LIMIT = 1000
BODY_TRUNCATED = "... [body truncated]"
REPLY_PREFIXES = ("re:", "fwd:", "fw:")
FROM_HEADER_PATTERN = r'^"?([^"<]*)"?\s*<?([\w.+-]+@[\w.-]+)?>?$'
QUIET_AFTER_DAYS = 3

# --- fixed values: calendar ---
FOCUS_WORDS = ("deep work", "focus time")
LUNCH_WORDS = ("lunch",)
ONE_ON_ONE_WORDS = ("1:1", "one-on-one")
EXTERNAL_WORDS = ("customer", "investor", "board")
CEREMONY_WORDS = ("standup", "retro", "planning", "all-hands", "all hands", "pipeline review")
MEETING_CATEGORIES = ("one_on_one", "external", "internal_ceremony", "other")

# --- fixed values: tasks ---
PRIORITIES = ("P0", "P1", "P2", "P3", "P4")
UNKNOWN_PRIORITY_RANK = 9
DUE_SOON_DAYS = 7
STALLED_AFTER_DAYS = 7
STALLED_BELOW_RATIO = 0.34
TASK_BUCKETS = ("overdue", "due_soon", "blocked", "stalled")
LOW_PRIORITIES = ("P3", "P4")
URGENT_BUCKETS = ("overdue", "due_today")

# --- fixed values: ledger ---
SOURCES = ("email", "calendar", "notes")
STALE_AFTER_DAYS = 1
RETENTION_DAYS = 30
DELTA_CATEGORIES = {
    "email": ("deadlines", "decisions", "action_items", "thread_progressions"),
    "calendar": ("meetings_needing_prep", "family_calendar_items", "pattern_flags", "notable_events"),
    "notes": ("decisions", "open_items_still_relevant", "key_people"),
}

# --- fixed values: required keys of model output, with and without the persona's priorities ---
MAP_SCHEMAS = {
    ("email", "persona"): {
        "deadlines": ("description", "priority"),
        "decisions": ("description", "priority"),
        "action_items": ("description", "priority"),
        "thread_progressions": ("thread", "progression"),
    },
    ("email", "no_persona"): {
        "deadlines": ("description",),
        "decisions": ("description",),
        "action_items": ("description",),
        "thread_progressions": ("thread", "progression"),
    },
    ("notes", "persona"): {
        "decisions": ("description", "priority"),
        "open_items_still_relevant": ("text", "priority"),
        "key_people": ("name",),
    },
    ("notes", "no_persona"): {
        "decisions": ("description",),
        "open_items_still_relevant": ("text",),
        "key_people": ("name",),
    },
    ("calendar", "persona"): {
        "meetings_needing_prep": ("summary",),
        "family_calendar_items": ("summary",),
        "pattern_flags": ("description",),
        "notable_events": ("summary",),
    },
}
MAP_SCHEMAS[("calendar", "no_persona")] = MAP_SCHEMAS[("calendar", "persona")]
CONTRADICTION_SCHEMA = {"contradictions": ("entity", "sources", "description")}
SYNTHESIS_SCHEMA = {"dispatchable_items": ("id", "type", "summary")}
DRAFT_SCHEMA = {"drafts": ("id", "draft_text")}
JUDGE_SCHEMA = {"matches": ("claim_index", "evidence")}
STRUCTURED_SCHEMA = {"items": ("id", "type", "title", "summary", "priority")}

# --- fixed values: brief text ---
UNDRAFTED_LINE = "*(surfaced for you to handle directly — not drafted)*"
BRIEF_TITLE = "# Daily Brief"
MATTERS_HEADER = "What Matters Today"
MISSED_HEADER = "What You Might Be Missing"
DISPATCH_HEADER = "Quick Dispatches"
JUDGE_TEXT_CHARS = 300
EXCERPT_TEXT_CHARS = 200

# --- fixed values: output checks ---
SCHEMA_NARRATION_PATTERNS = (
    "this (?:is|file) (?:a|an) (?:json|profile)",
    "contains an array of objects",
    "each (?:object|entry|record) represents",
    "the file (?:is in|contains|appears to be)",
    "breakdown of (?:the|this) (?:properties|information|data)",
    "here'?s a breakdown",
    "top-level key",
)
MIN_WORDS = 50
BLOAT_LIMITS = {"email": (8, 4.0), "calendar": (4, 3.0), "notes": (35, 0.0)}
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# --- fixed values: tenants and calls ---
TENANT_PATTERN = "^[a-z0-9][a-z0-9_-]{0,63}$"
DEFAULT_TENANT = "default"
DEFAULT_SYSTEM = {
    "max_qps_per_tenant": 2.0,
    "allowed_providers": ["ollama", "anthropic", "google", "openrouter", "deepseek"],
    "circuit_breaker_threshold": 5,
}
TERMINAL_STATUS_CODES = (400, 401, 402, 403)
