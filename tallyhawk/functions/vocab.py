"""Fixed word lists and phrase tables (values that must equal the reference's)."""

from __future__ import annotations

# fixed values: summarizer stop words (general English list, then domain words)
SUMMARY_STOP_WORDS = frozenset("""
a about above after again against all also am an and any are aren't as at be because been
before being below between both but by can couldn't did didn't do does doesn't doing don
don't down during each few for from further get had hadn't has hasn't have haven't having he
he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've
if in into is isn't it it's its itself let let's me more most mustn't my myself no nor not
of off on once only or other ought our ours ourselves out over own same shan't she she'd
she'll she's should shouldn't so some such than that that's the their theirs them themselves
then there there's therefore these they they'd they'll they're they've this those through to
too under until up us very was wasn't we we'd we'll we're we've were weren't what what's when
when's where where's which while who who's whom why why's will with won't would wouldn't you
you'd you'll you're you've your yours yourself yourselves
said say says also however therefore thus hence one two three four five six seven eight nine
ten per within between across among towards regarding including following based may shall
will can could use used using make made need needs via many much several various
""".split())

# fixed values: tone words
POSITIVE_WORDS = frozenset("""
increase growth improve improved success positive benefit gain profit efficient effective
achievement strong excellent compliant approved resolved optimised savings reduced better
""".split())
NEGATIVE_WORDS = frozenset("""
risk fraud error violation discrepancy missing overdue penalty dispute reject failed delay
non-compliant breach loss concern anomaly suspicious exception blocked cancelled reversed
incorrect
""".split())

# fixed values: document types, first list with a contained word wins
DOC_TYPES = [
    ("SAP Finance / Invoice Document", ["invoice", "billing", "payment", "vendor", "accounts payable"]),
    ("SAP Procurement Document", ["purchase order", "procurement", "material", "goods receipt"]),
    ("SAP Sales Document", ["sales order", "customer", "delivery", "shipment", "revenue"]),
    ("Policy / Compliance Document", ["policy", "procedure", "guideline", "compliance", "audit"]),
    ("Contract / Legal Document", ["contract", "agreement", "terms", "clause", "obligations"]),
    ("Business Report / Analysis", ["report", "analysis", "data", "performance", "kpi", "metric"]),
    ("Presentation", ["presentation", "slide", "overview", "agenda"]),
]
DOC_TYPE_DEFAULT = "General SAP Business Document"

TONE_RISK = "⚠️ Risk / Concern Signals Detected"
TONE_POSITIVE = "✅ Positive / Compliant Tone"
TONE_NEUTRAL = "🔵 Neutral / Informational"

# fixed values: entity patterns (Java regex syntax, same meaning)
CURRENCY_PATTERN = (r"(?i)(?:USD|EUR|GBP|INR|₹|\$|€|£)\s?[\d,]+(?:\.\d{1,2})?"
                    r"(?:\s?(?:million|billion|lakh|crore|thousand|k|M|B))?")
PERCENT_PATTERN = r"\d+(?:\.\d+)?\s?%"
DATE_PATTERN = (r"(?i)\b(?:\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}|"
                r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}|"
                r"\d{4}[\/\-]\d{2}[\/\-]\d{2})\b")
CODE_PATTERN = r"\b(?:FB[0-9LVZ]+|VK\d+|ME\d+|MIRO|MIGO|F110|FK\d+|XK\d+)\b"
ORG_PATTERN = (r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\s+(?:Ltd|LLC|GmbH|AG|Corp|Inc|Pvt|Private|Limited|"
               r"Group|Solutions|Services|Technologies|Systems)\b")

# fixed values: question normalisation (source → target), in table order
TEXT_REPLACEMENTS = [
    ("pls", "please"), ("plz", "please"), ("po no", "po"), ("purchase order", "po"),
    ("bill", "invoice"), ("bills", "invoices"), ("payment", "invoice"), ("payments", "invoices"),
    ("supplier", "vendor"), ("suppliers", "vendors"), ("fraudulent", "fraud"),
    ("suspiscious", "suspicious"), ("suspecious", "suspicious"), ("anamoly", "anomaly"),
    ("abnormal", "anomaly"), ("weird", "suspicious"), ("strange", "suspicious"),
    ("dangerous", "high risk"), ("duplicate bills", "duplicate invoices"),
    ("same bill", "duplicate invoice"), ("same payment", "duplicate invoice"),
    ("twice paid", "duplicate"), ("paid twice", "duplicate"), ("double payment", "duplicate"),
    ("without po", "missing po"), ("no po", "missing po"), ("po missing", "missing po"),
    ("blank po", "missing po"), ("high amt", "high amount"), ("large amount", "high amount"),
    ("huge amount", "high amount"), ("overpriced", "high amount"), ("costly", "high amount"),
    ("expensive", "high amount"), ("dikhao", "show"), ("batao", "tell"), ("mujhe", "me"),
    ("ka", ""), ("ke", ""), ("ki", ""), ("wala", ""), ("wali", ""),
]

# fixed values: month names in table order
MONTHS = [
    ("january", 1), ("jan", 1), ("february", 2), ("feb", 2), ("march", 3), ("mar", 3),
    ("april", 4), ("apr", 4), ("may", 5), ("june", 6), ("jun", 6), ("july", 7), ("jul", 7),
    ("august", 8), ("aug", 8), ("september", 9), ("sep", 9), ("sept", 9), ("october", 10),
    ("oct", 10), ("november", 11), ("nov", 11), ("december", 12), ("dec", 12),
]

# fixed values: intent phrases, intents in priority order for ties
INTENT_PHRASES = [
    ("duplicate", [
        "duplicate", "duplicate invoice", "duplicate invoices", "repeated invoice",
        "repeat invoice", "same invoice", "same invoices", "same vendor same amount",
        "paid twice", "double payment", "same bill", "same payment",
        "invoice repeated", "invoice repeated twice", "same vendor date amount",
        "duplicate case", "duplicate cases", "duplicate payment", "same invoice number",
        "repeat payment", "multiple same invoice", "repeated bill", "duplicate bills",
        "double billed", "same transaction twice", "twice billed"]),
    ("high_risk", [
        "risky", "risk", "high risk", "medium risk", "suspicious", "fraud",
        "fraud case", "fraud cases", "anomaly", "anomalies", "flagged",
        "danger", "dangerous", "need attention", "needs attention", "problematic",
        "issue invoices", "concerning invoices", "alert invoices", "red flags",
        "suspicious invoices", "risky invoices", "fraudulent invoices",
        "bad invoices", "odd invoices", "weird invoices"]),
    ("missing_po", [
        "missing po", "without po", "no po", "po missing", "po blank",
        "purchase order missing", "purchase order blank", "missing purchase order",
        "no purchase order", "invoice without po", "invoices without po",
        "po not available", "po empty", "blank po number"]),
    ("high_amount", [
        "high amount", "very high amount", "large amount", "huge amount",
        "unusual amount", "too much amount", "too expensive", "expensive invoice",
        "overpriced", "costly", "abnormal amount", "amount anomaly", "outlier amount",
        "high value invoices", "big invoices", "large invoices", "too high",
        "vendor historical median", "higher than usual", "above average amount",
        "unusually expensive", "too costly"]),
    ("vendor_search", [
        "vendor", "vendors", "supplier", "suppliers", "from vendor",
        "from supplier", "for vendor", "for supplier", "vendor invoices",
        "supplier invoices", "vendor related", "particular vendor"]),
    ("explain", [
        "why", "explain", "reason", "tell reason", "what is reason",
        "why risky", "why suspicious", "why flagged", "why high risk",
        "explain invoice", "explain risk", "what happened", "what is wrong",
        "why marked", "why selected", "how is this risky"]),
    ("top_vendors", [
        "top vendors", "risky vendors", "vendors with most risk", "which vendor has most risk",
        "most suspicious vendor", "top suspicious vendors", "top risky vendors"]),
    ("recent", ["recent", "latest", "new", "current", "recent invoices", "latest invoices"]),
    ("count", ["how many", "count", "number of", "total number", "how much count"]),
]

# fixed values: question stop words
QUESTION_STOP_WORDS = frozenset("""
show me the is are a an for of to in on all with this that from about please tell find get give
list need want can you do we there any which what who where when
""".split())

# fixed values: expansion text per intent
EXPANSIONS = {
    "duplicate": "duplicate repeated same invoice same vendor same amount same date same invoice number paid twice duplicate payment",
    "high_risk": "high risk suspicious fraud anomaly flagged invoice red flags concern",
    "missing_po": "missing po blank po no po purchase order missing purchase order blank",
    "high_amount": "high amount unusual amount outlier overpriced higher than usual amount anomaly",
    "vendor_search": "vendor supplier invoice history transactions risk vendor analysis",
    "explain": "explain why risky suspicious anomaly reason flagged invoice reason",
    "top_vendors": "top risky vendors suspicious vendors most flagged vendors highest risk vendors",
    "recent": "recent latest new current invoices recent suspicious invoices",
    "count": "count total number of invoices count risky suspicious duplicate invoices",
    "general": "invoice risk fraud anomalies suspicious vendor amount po duplicate invoices",
}

# fixed values: answer texts
NO_MATCH_TEXT = ("I could not find matching invoices for that question in the current dataset. "
                 "Try asking things like 'show duplicate invoices', 'find missing PO invoices', "
                 "'show high-risk invoices for Vendor X', or 'which invoices have unusually high amounts?'.")
ANSWER_HINTS = ["", "You can also ask:", "- show duplicate invoices", "- find invoices with missing po",
                "- show risky invoices for a vendor", "- which invoices have unusually high amounts",
                "- show high risk invoices in april 2025"]

# fixed values: patterns of direct answers, tried in order, and answer texts
DIRECT_PATTERNS = {
    "tax": [r"tax procedure(?:.*?)(TAX[A-Z0-9]+)", r"\b(TAXINN|TAXVAT|TAX[A-Z0-9]+)\b"],
    "pricing": [r"pricing procedure(?:.*?)(Z[A-Z0-9]+)", r"\b(ZEXP\d+|Z[A-Z0-9]+)\b"],
    "threshold": [r"(INR\s?[0-9,]+)", r"(USD\s?[0-9,]+)"],
    "groups": [r"domestic.*?(Z[A-Z0-9]+)", r"import.*?(Z[A-Z0-9]+)"],
    "tolerance": [r"tolerance key\s+([A-Z0-9]+).*?([0-9]+ ?percent)", r"([A-Z0-9]+).*?([0-9]+ ?percent)"],
    "terms": [r"payment terms\s+([A-Z0-9]+)", r"\b(Z[0-9]{3})\b"],
    "posting": [r"\bBSX\b", r"\bWRX\b"],
}
DIRECT_TEXTS = {
    "posting": "BSX for inventory posting; WRX for GR/IR clearing",
    "error": "Duplicate invoice control was strengthened by changing the message to error instead of warning.",
    "prevention": "Duplicate invoice prevention improved after making the duplicate check error-based rather than warning-based.",
}
