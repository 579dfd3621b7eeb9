"""The target schema and the fixed values of the roster domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
FIELDS = [
    "Transaction Type",
    "Transaction Attribute",
    "Effective Date",
    "Term Date",
    "Term Reason",
    "Provider Name",
    "Provider NPI",
    "Provider Specialty",
    "State License",
    "Organization Name",
    "TIN",
    "Group NPI",
    "Complete Address",
    "Phone Number",
    "Fax Number",
    "PPG ID",
    "Line Of Business",
]

SENTINEL = "Information not found"

# Older column names still accepted for a target field, in order of preference.
ALIASES = {
    "Provider NPI": ["NPI"],
    "Provider Specialty": ["Specialty"],
    "Phone Number": ["Phone"],
    "Complete Address": ["Address"],
    "State License": ["License"],
    "Organization Name": ["Organization"],
    "Fax Number": ["Fax"],
    "PPG ID": ["PPG"],
    "Line Of Business": ["LOB", "Line of Business", "Line Of Business (Medicare/Commercial/Me)"],
    "Transaction Type": ["Type"],
    "Transaction Attribute": ["Attribute"],
    "Term Reason": ["Reason"],
}

JOB_STATUSES = ["pending", "processing", "needs_review", "ready", "exported", "failed"]
ISSUE_LEVELS = ["error", "warning", "info"]

# Keyword rules for free-form headers: the first rule with a term inside the
# cleaned header decides.
HEADER_RULES = [
    ("Provider Name", ["provider name", "name", "physician", "doctor"]),
    ("Provider NPI", ["npi", "national provider"]),
    ("Provider Specialty", ["specialty", "specialization", "practice"]),
    ("State License", ["license", "lic", "state license"]),
    ("Organization Name", ["organization", "practice", "group", "facility"]),
    ("TIN", ["tin", "tax id", "tax identification"]),
    ("Group NPI", ["group npi", "group national provider"]),
    ("Complete Address", ["address", "location", "street"]),
    ("Phone Number", ["phone", "telephone", "tel"]),
    ("Fax Number", ["fax", "facsimile"]),
    ("PPG ID", ["ppg", "ppg id", "practice group"]),
    ("Line Of Business", ["lob", "line of business", "business"]),
    ("Effective Date", ["effective date", "start date", "beginning"]),
    ("Term Date", ["term date", "end date", "termination date"]),
    ("Term Reason", ["term reason", "reason", "termination reason"]),
    ("Transaction Type", ["transaction type", "type", "action"]),
    ("Transaction Attribute", ["transaction attribute", "attribute", "change type"]),
]

# Words that make a first row a header row, and words that make a table a roster.
HEADER_HINTS = ["provider", "npi", "specialty", "name", "date", "reason"]
ROSTER_TERMS = ["npi", "provider", "specialty", "name", "phone", "email", "address", "terminate", "voluntary"]

# Patterns read from narrative text, tried without regard to case.
NARRATIVE_PATTERNS = {
    "Provider Name": r"([A-Z][a-z]+ [A-Z][a-z]+(?:,?\s*(?:MD|DO|NP|PA|RN))?)",
    "Effective Date": r"(?:effective|starting|beginning)\s+(?:on\s+)?(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})",
    "Term Date": r"(?:terminat|ending|stopping)\s+(?:on\s+)?(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})",
    "Provider NPI": r"NPI[:\s#]*(\d{10})",
    "Group NPI": r"Group\s+NPI[:\s#]*(\d{10})",
    "State License": r"(?:License|Lic\.)[:\s#]*([A-Z0-9]+)",
    "TIN": r"TIN[:\s#]*(\d{2}-?\d{7})",
    "Provider Specialty": r"(?:specialty|specializing in|practice)[:\s]*([A-Za-z\s]+?)(?:\.|,|$)",
    "Phone Number": r"(?:Phone|Tel)[:\s]*(\d{3}[-.]?\d{3}[-.]?\d{4})",
    "Fax Number": r"Fax[:\s]*(\d{3}[-.]?\d{3}[-.]?\d{4})",
    "Complete Address": r"(?:Address|Location)[:\s]*([^,\n]+(?:,\s*[^,\n]+)*)",
    "Organization Name": r"(?:Organization|Practice|Group|Facility)[:\s]*([^,\n]+)",
    "PPG ID": r"PPG\s+ID[:\s]*([A-Z0-9]+)",
    "Line Of Business": r"(?:Line of Business|LOB)[:\s]*([A-Za-z\s]+)",
    "Term Reason": r"(?:Reason|Because)[:\s]*([^,\n]+?)(?:\.|$)",
}

# Dictionary phrases, matched as written.
PHRASES = {
    "Transaction Type": ["Add", "Update", "Term", "Terminate", "Termination", "Addition", "New Provider"],
    "Transaction Attribute": [
        "Specialty", "Provider", "Address", "PPG", "Phone Number", "LOB", "Line of Business",
        "Location", "Practice", "License", "NPI", "TIN",
    ],
    "Provider Specialty": [
        "Internal Medicine", "Family Medicine", "Pediatrics", "Cardiology", "Orthopedics",
        "Dermatology", "Neurology", "Psychiatry", "Radiology", "Anesthesiology",
        "Emergency Medicine", "Obstetrics", "Gynecology", "Oncology", "Urology",
        "Ophthalmology", "ENT", "Pulmonology", "Endocrinology", "Gastroenterology",
        "Nephrology", "Rheumatology", "Hematology", "Infectious Disease", "Geriatrics",
    ],
    "Line Of Business": ["Medicare", "Medicaid", "Commercial", "Medicare Advantage", "HMO", "PPO", "POS"],
    "Term Reason": [
        "Provider Left Group", "Contract Ended", "License Expired", "Retired", "Resigned",
        "Terminated", "No Longer Practicing", "Practice Closure", "Relocation", "Death",
    ],
}

# Whole-token patterns.
TOKEN_PATTERNS = {
    "Provider NPI": r"^\d{10}$",
    "TIN": r"^\d{2}-?\d{7}$",
    "phone": r"^\d{3}[-.]?\d{3}[-.]?\d{4}$",
    "State License": r"^[A-Z]{1,3}\d{4,8}$",
    "PPG ID": r"^(P\d{2,3}|\d{3,4})$",
}

# Words deciding the transaction type of a text, tried in this order.
TRANSACTION_WORDS = [
    ("Add", ["add", "new", "joining", "welcome"]),
    ("Update", ["update", "change", "modify", "revise"]),
    ("Term", ["term", "terminate", "remove", "leaving", "retire"]),
]

# Fields that read the sentinel when a source row does not carry them.
TABLE_SENTINEL_FIELDS = [
    "Effective Date", "Term Date", "Term Reason", "State License", "Group NPI",
    "Complete Address", "Phone Number", "Fax Number", "PPG ID",
]
NARRATIVE_SENTINEL_FIELDS = [
    "Effective Date", "Term Date", "Term Reason", "Provider NPI", "State License", "TIN",
    "Group NPI", "Complete Address", "Phone Number", "Fax Number", "PPG ID", "Line Of Business",
]

EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERNS = [
    r"^\(\d{3}\) \d{3}-\d{4}$",
    r"^\d{3}-\d{3}-\d{4}$",
    r"^\d{3}\.\d{3}\.\d{4}$",
    r"^\d{10}$",
    r"^\+1\d{10}$",
]
LATENCY_BUCKETS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0]
END_TO_END_BUCKETS = [1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0, 1200.0]
# --- end of fixed values ----------------------------------------------------


def column_name(field: str) -> str:
    """Typed column that holds a target field: ``Provider NPI`` -> ``provider_npi``."""
    return field.lower().replace(" ", "_")


FIELD_COLUMNS = [column_name(f) for f in FIELDS]


def field_col(field: str) -> Column:
    return F.col(column_name(field))
