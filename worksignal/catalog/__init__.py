"""The operators run over the given tables, each with the same question in SQL."""

from worksignal.catalog import (  # noqa: F401  (importing registers the queries)
    briefs_q,
    calendar_q,
    days_q,
    evals_q,
    ledger_q,
    mail_q,
    matching_q,
    model_q,
    sources_q,
    stages_q,
    stores_q,
    streams_q,
    tasks_q,
    text_q,
)
from worksignal.catalog.registry import ORACLES, QUERIES  # noqa: F401
