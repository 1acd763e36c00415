"""Fixed values that must equal the reference behaviour for identical results.

Everything here is plain data (word lists, maps, patterns, thresholds). The
operators turn these into broadcast dimension tables or literal maps; no logic
lives in this module.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — discrepancy matching
# ---------------------------------------------------------------------------

MATCH_THRESHOLD = 0.55   # Jaccard on label tokens, inclusive
DELTA_LOW = 0.01         # relative difference floor, inclusive
DELTA_HIGH = 0.25        # relative difference ceiling, inclusive
SNIPPET_CHARS = 80

LABEL_STOP_WORDS = [
    "the", "a", "an", "of", "in", "for", "and", "or", "to", "by",
    "with", "at", "from", "per", "as", "is", "are", "was", "were",
    "total", "net", "gross",
]

LABEL_SYNONYMS = {
    "revenues": "revenue",
    "sales": "revenue",
    "turnover": "revenue",
    "earnings": "income",
    "profit": "income",
    "profits": "income",
    "losses": "loss",
    "expenditure": "expense",
    "expenditures": "expenses",
    "costs": "cost",
    "headcount": "employees",
    "workforce": "employees",
    "staff": "employees",
}

# Magnitude suffix letter -> multiplier (first letter of the suffix, any case).
SUFFIX_MULTIPLIERS = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}

# Numeric-fact patterns, tried in this order over the whole text. Groups:
# 1 label, 2 sign, 3 number, 4 magnitude suffix. Case-insensitive.
_NUM = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
_SUFFIX = r"\s*([KkMmBbTt](?:illion|n|)?)?"
FACT_PATTERNS = [
    # "Label: $1,234" / "label = 5M" / "label - 12"
    r"([A-Za-z][A-Za-z0-9 _/\-]{1,60}?)\s*[:\-=]\s*([-–]?)\s*[\$£€¥]?\s*" + _NUM + _SUFFIX,
    # "revenue of $1.2M" / "sales were 45,000"
    r"([A-Za-z][A-Za-z0-9 _/\-]{1,60}?)\s+(?:was|were|is|are|of|totaling?|equaling?|reached?|hit|at)\s+"
    r"([-–]?)\s*[\$£€¥]?\s*" + _NUM + _SUFFIX,
    # "Net Income $330M" (currency symbol required)
    r"([A-Za-z][A-Za-z0-9 _/\-]{1,40}?)\s*[:\-]?\s+([-–]?)\s*[\$£€¥]\s*" + _NUM + _SUFFIX,
]

# ---------------------------------------------------------------------------
# FIXED VALUES — PII patterns (Python `re` syntax; Java accepts the same text)
# ---------------------------------------------------------------------------

PII_EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PII_PHONE_US = r"(?<!\d)(?:\+?1[\s\-.]?)?(?:\(?\d{3}\)?[\s\-.]?)\d{3}[\s\-.]?\d{4}(?!\d)"
PII_PHONE_UK = r"(?<!\d)(?:\+44[\s\-.]?7\d{3}[\s\-.]?\d{6}|07\d{3}[\s\-.]?\d{6})(?!\d)"
PII_PHONE_IN = r"(?<!\d)\+91[\s\-]?\d{5}[\s\-]?\d{5}(?!\d)"
PII_PHONE_EU = r"(?<!\d)\+(?:3[0-9]|4[0-35-9])[\s\-.]?\d[\d\s\-.]{7,11}(?!\d)"
PII_SSN = r"(?<!\d)(?!000|666|9\d{2})\d{3}[-\s](?!00)\d{2}[-\s](?!0000)\d{4}(?!\d)"
PII_CARD = (r"(?<!\d)(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6011|(?:2131|1800|35\d{3}))"
            r"[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{1,4}(?!\d)")

# Summary counts cover these four kinds only (UK/IN/EU phones are masked but
# not counted).
PII_SUMMARY_KINDS = [
    ("email", PII_EMAIL),
    ("phone", PII_PHONE_US),
    ("ssn", PII_SSN),
    ("credit_card", PII_CARD),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — document typing (keyword containment in lower-cased text)
# ---------------------------------------------------------------------------

# Chunking type: first 500 characters; financial wins over legal.
CHUNK_TYPE_CHARS = 500
CHUNK_FINANCIAL_KEYWORDS = [
    "annual report", "10-k", "10-q", "financial statements", "balance sheet",
    "income statement", "form 10-k", "form 10-q", "form 8-k",
    "securities and exchange commission", "registrant",
    "consolidated statements", "notes to financial statements",
    "stockholders' equity", "cash flows",
]
CHUNK_LEGAL_KEYWORDS = ["agreement", "contract", "whereas", "hereinafter", "indemnification"]

# Extraction type: hits over the full text, >= 3 hits and >= 50 tokens; ties go
# to the earlier type in this order.
DOC_TYPE_MIN_TOKENS = 50
DOC_TYPE_MIN_HITS = 3
NUMERIC_DENSITY = 0.015
DOC_TYPE_KEYWORDS = [
    ("financial", [
        "revenue", "arr", "mrr", "ebitda", "margin", "forecast", "budget",
        "projection", "target", "actuals", "gross", "net", "profit", "loss",
        "p&l", "income", "expense", "capex", "opex", "cogs", "arpu", "ltv",
        "cac", "runway", "burn", "headcount", "yoy", "qoq", "cagr", "fy",
        "quarter", "q1", "q2", "q3", "q4", "fiscal", "annual", "monthly",
    ]),
    ("legal", [
        "agreement", "contract", "party", "parties", "clause", "liability",
        "indemnify", "indemnification", "warrant", "warranty", "breach",
        "termination", "jurisdiction", "governing law", "obligation",
        "penalty", "damages", "arbitration", "confidential", "whereas",
        "hereinafter", "executed", "effective date", "term", "covenant",
    ]),
    ("medical", [
        "patient", "diagnosis", "treatment", "medication", "dosage", "mg",
        "prescription", "symptom", "clinical", "laboratory", "lab",
        "blood pressure", "glucose", "cholesterol", "hemoglobin", "bmi",
        "icd", "cpt", "procedure", "surgery", "prognosis", "chronic",
        "acute", "physician", "pharmacist", "dose", "mmhg", "bpm",
    ]),
    ("research", [
        "abstract", "hypothesis", "methodology", "sample size", "p-value",
        "confidence interval", "statistical significance", "regression",
        "correlation", "cohort", "randomized", "controlled trial",
        "literature review", "findings", "conclusion", "journal",
        "participants", "mean", "median", "standard deviation", "effect size",
        "peer-reviewed", "citation", "bibliography",
    ]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — persona suggestion for an upload (file names + first 5000
# characters of the first 6 pages; >= 2 hits; ties to the earlier persona)
# ---------------------------------------------------------------------------
PERSONA_SAMPLE_CHARS = 5000
PERSONA_SAMPLE_PAGES = 6
PERSONA_MIN_HITS = 2
UPLOAD_PERSONA_KEYWORDS = [
    ("Doctor", [
        "medical", "health", "clinical", "doctor", "patient", "diagnosis",
        "treatment", "symptom", "hospital", "prescription", "dosage",
        "pathology", "surgery", "therapy", "disease", "chronic", "medication",
    ]),
    ("AI/ML Expert", [
        "machine learning", "artificial intelligence", "neural network", "deep learning",
        "dataset", "training data", "nlp", "computer vision", "transformer",
        "gradient", "overfitting", "reinforcement learning", "embedding",
        "fine-tuning", "llm", "backpropagation", "epoch", "loss function",
    ]),
    ("Finance Expert", [
        "financial", "finance", "investment", "revenue", "profit", "loss",
        "balance sheet", "income statement", "cash flow", "quarterly", "annual report",
        "earnings", "dividend", "portfolio", "equity", "debt", "valuation",
        "fiscal", "ebitda", "roi", "asset", "liability", "audit",
    ]),
    ("Lawyer", [
        "legal", "contract", "agreement", "terms", "policy", "clause",
        "indemnity", "jurisdiction", "plaintiff", "defendant", "regulation",
        "compliance", "statute", "arbitration", "intellectual property",
        "copyright", "patent", "trademark", "gdpr", "litigation",
    ]),
    ("Strategy Analyst", [
        "strategy", "consulting", "business plan", "proposal", "market analysis",
        "competitive", "stakeholder", "kpi", "roadmap", "go-to-market",
        "swot", "operational", "transformation", "management",
    ]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — question routing: primary hit 2 points, secondary 1, at least
# 2 points; ties to more primary hits, then this order. Generalist is the
# fallback and is never scored.
# ---------------------------------------------------------------------------
ROUTE_PRIMARY_WEIGHT = 2
ROUTE_SECONDARY_WEIGHT = 1
ROUTE_MIN_SCORE = 2
ROUTE_FALLBACK = "Generalist"
ROUTING_KEYWORDS = [
    ("Doctor",
     ["diagnosis", "patient", "clinical", "symptom", "treatment", "prescription", "dosage", "pathology",
      "surgery", "chronic", "medication", "lab result", "vital"],
     ["health", "medical", "hospital", "therapy", "disease", "physician", "nursing", "drug"]),
    ("Finance Expert",
     ["revenue", "profit", "ebitda", "balance sheet", "cash flow", "earnings", "quarterly", "annual report",
      "valuation", "roi", "equity", "debt", "dividend", "fiscal", "margin"],
     ["financial", "investment", "forecast", "budget", "growth", "expense", "asset", "liability", "audit",
      "fund"]),
    ("Lawyer",
     ["contract", "agreement", "clause", "jurisdiction", "indemnity", "liability", "plaintiff", "defendant",
      "arbitration", "statute", "copyright", "patent", "gdpr", "compliance"],
     ["legal", "regulation", "policy", "obligation", "intellectual property", "breach", "penalty", "dispute"]),
    ("Strategy Analyst",
     ["strategy", "roadmap", "kpi", "go-to-market", "swot", "stakeholder", "competitive analysis",
      "market share", "transformation", "business case"],
     ["consulting", "business plan", "proposal", "operational", "market analysis", "management", "growth",
      "change management"]),
    ("Data Analyst",
     ["query", "sql", "table", "row", "column", "count", "average", "group by", "join", "aggregate", "null",
      "outlier", "distribution", "chart"],
     ["data", "database", "metric", "percentage", "total", "filter", "report", "dashboard", "correlation",
      "summarize"]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — query expansion: (trigger words, expansion phrases), in order.
# Triggers are compared with the question's \w+ tokens.
# ---------------------------------------------------------------------------
EXPANSION_RULES = [
    (["position", "title", "role", "job", "designation", "occupation", "work"],
     ["job title", "position title", "job title occupation title", "SOC occupation title",
      "role designation", "current job title"]),
    (["name", "full name", "who"],
     ["full legal name", "applicant name", "employee name", "worker name"]),
    (["salary", "wage", "compensation", "pay", "income", "earning"],
     ["wage rate", "prevailing wage", "offered wage", "annual salary", "hourly wage", "compensation amount"]),
    (["location", "address", "workplace", "office", "site", "place", "where"],
     ["work location", "place of employment", "worksite address", "employer address"]),
    (["employer", "company", "organization", "organisation", "firm"],
     ["employer name", "company name", "legal business name"]),
    (["date", "when", "period", "duration", "start", "end", "begin", "expire"],
     ["employment period", "validity period", "begin date end date", "start date"]),
    (["visa", "status", "classification", "h1b", "h-1b", "lca", "immigration"],
     ["visa classification", "nonimmigrant classification", "H-1B classification",
      "labor condition application"]),
    (["soc", "code", "occupation code"],
     ["SOC code", "SOC occupation code", "occupational classification code"]),
    (["hours", "schedule", "weekly", "part", "full", "time"],
     ["hours per week", "work schedule", "full-time part-time"]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — chunking and HTML
# ---------------------------------------------------------------------------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
CHUNK_SEPARATORS = ["\n\n", "\n", " "]       # coarsest first: paragraph, line, word
HTML_DROP_TAGS = ["script", "style"]          # element and content removed
HTML_DROP_VOID_TAGS = ["meta", "link"]        # empty elements, removed with the tags
# a tag ends at the first > outside its quoted values (possessive: no backtracking)
HTML_TAG = r"""<[/!?a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
PAGE_MIN_CHARS = 50
