"""Schemas and fixed values of the event-timeline model."""

from __future__ import annotations

# Kinds, priorities, thresholds and word lists that results depend on.
EVENT_KINDS = ["filing", "earnings", "history", "press", "news", "citation", "regulation", "annotation", "onchain", "corporate_action", "governance", "exploit"]
PRECISIONS = ["day", "month", "year"]
OUTCOMES = ["ok", "empty", "throttled", "error"]
RUNGS = ["known_company", "known_subject", "edgar", "salvaged_prefix", "assumed_topic", "unresolved", "network_timeout", "empty"]
CORPUS_RUNGS = ["known_company", "known_subject", "salvaged_prefix"]

RELEVANCE_THRESHOLD = 0.4
SIMILARITY_FLOOR = 0.5
UNSCORED_PRIOR = 0.7
SIGNAL_FLOOR, SIGNAL_SIGMA, DIVERGENCE_POINTS, LOOKBACK_MONTHS = 5, 2.0, 15.0, 30
HOVER_REACH, FILING_STACK, PEEK = 5, 3, 8
PREHISTORY_GAP = 120
ABSOLUTE_FLOOR = {"company": 1780, "topic": 1500}
CATALYST_LOOKBACK, MIN_MOVE_PCT, MAX_MOVES, MOVE_SPACING, MOVE_GAP_DAYS = 5, 2.0, 6, 5, 7
CITATION_CAP = 160
INDUSTRY_ROWS, SECTOR_ROWS = 400, 120

MARKER_PRIORITY = {"earnings": 3, "filing": 2, "history": 2, "regulation": 2, "annotation": 4, "onchain": 3, "corporate_action": 2, "press": 1, "news": 1, "citation": 1, "governance": 2, "exploit": 5}
CATALYST_PRIORITY = {"earnings": 5, "corporate_action": 4, "filing": 4, "onchain": 3, "governance": 3, "exploit": 6, "annotation": 0, "regulation": 3, "history": 2, "press": 1, "news": 1, "citation": 1}
KIND_RELEVANCE = {"filing": 1.0, "earnings": 1.0, "history": 1.0, "corporate_action": 1.0, "onchain": 1.0, "annotation": 1.0, "citation": 0.9, "press": 0.7, "governance": 1.0, "exploit": 1.0}
NEWS_NAMED, NEWS_UNNAMED_STRICT = 0.9, 0.2
HEADLINE_KINDS = ["news", "press", "citation"]
TONED_KINDS = ["news", "press", "citation"]
RECHECK_MINUTES = {"gdelt": 60, "yahoo": 60, "finnhub": 120, "newsdata": 240, "currents": 240, "marketaux": 240, "sec": 360, "gnews": 360, "eodhd": 360, "nyt": 360, "guardian": 360, "snapshot": 720, "defillama": 720, "wikipedia": 1440, "federal_register": 1440, "onchain": 1440, "internet_archive": 1440, "loc": 10080}
RECHECK_DEFAULT = 360
DAILY_QUOTA = {"gnews": 100, "newsdata": 200, "currents": 600, "marketaux": 100, "eodhd": 20, "nyt": 500, "guardian": 5000, "onchain": 100000}
FINALITY_SECONDS = {"ethereum": 3600, "bitcoin": 21600}
BACKOFF_MINUTES = [30, 120, 480, 10080]
CLAIM_COOLDOWN_MINUTES = 360
RETENTION_DAYS = 90
ZOOMS = {"compact": (1.5, 132, 240, "year"), "default": (6.0, 148, 520, "year"), "wide": (20.0, 176, 1100, "month")}

WEAK_TOKENS = [
    "the", "and", "of", "for", "inc", "corp", "corporation", "company", "co", "group",
    "holdings", "holding", "limited", "ltd", "plc", "sa", "nv", "ag", "se", "motor",
    "motors", "international", "technologies", "technology", "systems", "industries",
]
FOCUS_WEAK = [
    "the", "and", "of", "for", "on", "in", "to", "a", "an", "at", "by", "with", "from",
    "his", "her", "its", "their", "this", "that", "these", "those",
    "how", "did", "does", "do", "has", "have", "had", "was", "were", "is", "are", "be",
    "effect", "effects", "impact", "impacts", "influence", "affected", "affect",
    "stock", "stocks", "share", "shares", "price", "prices", "company", "inc", "corp",
]
QUERY_WEAK = [
    "the", "and", "of", "for", "a", "an", "in", "on", "to", "how", "what", "why", "when", "did",
    "does", "do", "is", "was", "were", "affected", "affect", "effect", "impact", "vs", "versus",
    "earnings", "stock", "stocks", "share", "shares", "price", "prices", "news", "report",
    "results", "quarter", "quarterly", "revenue", "history", "q1", "q2", "q3", "q4",
]
POSITIVE = [
    "beat", "beats", "tops", "topped", "surge", "surges", "surged", "soar", "soars", "soared",
    "jump", "jumps", "jumped", "rally", "rallies", "rallied", "climb", "climbs", "climbed",
    "gain", "gains", "gained", "rise", "rises", "rose", "record", "profit", "profits",
    "growth", "grew", "upgrade", "upgraded", "raises", "raised", "boost", "boosts", "boosted",
    "wins", "won", "approval", "approves", "approved", "expands", "expansion", "strong", "outperform",
    "breakthrough", "milestone", "launch", "launches", "launched", "partnership", "dividend",
]
NEGATIVE = [
    "miss", "misses", "missed", "plunge", "plunges", "plunged", "slump", "slumps", "slumped",
    "fall", "falls", "fell", "drop", "drops", "dropped", "sink", "sinks", "sank", "slide",
    "slides", "slid", "tumble", "tumbles", "tumbled", "loss", "losses", "cut", "cuts",
    "downgrade", "downgraded", "lawsuit", "sued", "probe", "investigation", "recall", "recalls",
    "recalled", "fine", "fined", "penalty", "layoffs", "layoff", "bankruptcy", "default",
    "delay", "delays", "delayed", "warns", "warning", "weak", "underperform", "halt", "halted",
    "strike", "shortage", "defect", "fraud", "breach", "scandal", "resign", "resigns", "resigned",
]
NEGATORS = ["no", "not", "never", "without", "avoids", "avoided", "denies", "denied"]
NEGATION_WINDOW = 3

# Schemas, as DDL.
EVENTS = "id long, kind string, occurred_on date, date_precision string, title string, body string, image_url string, dedup_key string, content_hash string, ingested_at timestamp, updated_at timestamp"
ATTESTATIONS = "event_id long, source_id int, external_id string, url string, source_label string, is_primary boolean, retrieved_at timestamp"
EVENT_SUBJECTS = "event_id long, subject_id long, relevance float, scored_by string, scored_at timestamp"
SUBJECTS = "id long, kind string, slug string, display_name string, ticker string, cik string, sic string, wikipedia_title string, summary string, site_domain string, first_event_on date"
PRICES = "subject_id long, on_date date, close decimal(18,6), volume long"
