"""Column layouts of the source and derived tables (DDL strings)."""

EMAILS = (
    "tenant_id string, filename string, message_id string, subject string, from_hdr string, "
    "to_hdr string, date_iso string, sent_at timestamp, date_key string, body string, "
    "thread_id string, is_hot boolean, parse_error string"
)

ATTENDEES = "array<struct<name:string,email:string,partstat:string>>"

EVENTS = (
    "tenant_id string, uid string, summary string, status string, description string, "
    "location string, start timestamp_ntz, end timestamp_ntz, date_key string, "
    f"attendees {ATTENDEES}, is_hot boolean, parse_error string"
)

CHECKLIST = "array<struct<text:string,done:boolean>>"

NOTES = (
    "tenant_id string, note_id string, title string, created_at string, date_key string, "
    f"body string, checklist_items {CHECKLIST}, linked_entity_ids array<string>"
)

TASK_FILE = (
    "id string, title string, description string, status string, priority string, "
    "assignee string, due_date string, created_at string, tags array<string>, "
    "blocked_by string, subtasks array<struct<title:string,done:boolean>>"
)
TASKS = "tenant_id string, " + TASK_FILE

TENANT_CONFIG_FILE = (
    "use_persona_in_map boolean, "
    "never_draft_contacts array<struct<name:string,email:string>>, "
    "map_noise_filter struct<blocked_senders:array<string>,blocked_domains:array<string>>"
)
SYSTEM_CONFIG_FILE = (
    "max_qps_per_tenant double, allowed_providers array<string>, circuit_breaker_threshold int"
)

# One row per processed day (email, calendar), note, or rolled-up week.
LEDGER_ENTRIES = (
    "tenant_id string, source string, entry_key string, day string, note_id string, "
    "item_count bigint, stats map<string,double>, map_variant string, hot boolean, "
    "compacted boolean, sort_day date"
)
#: Section of the facts of a day or note that a week covers: this and the day's or note's key.
COVERED_FACTS = "stats:"
# One row per item of an entry's extraction (section delta) or of its facts (section stats).
LEDGER_ITEMS = (
    "tenant_id string, source string, entry_key string, section string, category string, "
    "ordinal bigint, payload string, text string"
)
# Which days and notes a rolled-up week stands for, with that day's or note's facts.
LEDGER_COVER = (
    "tenant_id string, source string, entry_key string, day string, note_id string, "
    "item_count bigint, stats map<string,double>"
)

CALL_METRICS = (
    "ts double, tenant_id string, provider string, model string, latency_ms double, "
    "success boolean, retries int, breaker_state string"
)

EVAL_RUNS = (
    "ts string, eval_name string, variant string, prompt_snapshot string, provider string, "
    "model string, trials_per_scenario int, "
    "scenarios map<string,struct<expected:string,results:array<string>,accuracy:double>>, "
    "aggregate_accuracy double"
)

REQUESTS = (
    "tenant_id string, stage string, unit_key string, "
    "system_text string, user_text string"
)
RESPONSES = (
    "tenant_id string, stage string, unit_key string, response string, error string"
)
