"""Fixed values.

Names, labels, patterns, weights and thresholds that decide the results. They
are part of the published screening rules, so they stand here as plain text.
Regular expressions are in Java syntax.
"""

# --- fixed values: document types, categories, profiles ---------------------

DOCUMENT_TYPES = (
    "PASSPORT", "VISA", "NATIONAL_ID", "DRIVING_LICENCE", "PERMIT",
    "PAN", "AADHAAR", "OTHER", "UNKNOWN",
)

CORE_TYPES = (
    "PASSPORT", "VISA", "NATIONAL_ID", "DRIVING_LICENCE", "PERMIT", "OTHER", "UNKNOWN",
)

SUBTYPE_CATEGORY = {"PAN": "NATIONAL_ID", "AADHAAR": "NATIONAL_ID"}

# (document_type, profile_id, display_name, expected_fields, supports_mrz)
PROFILES = (
    ("PASSPORT", "passport", "Passport",
     ("name", "date_of_birth", "document_number", "nationality", "sex",
      "issue_date", "expiry_date", "mrz", "photo"), True),
    ("VISA", "visa", "Visa",
     ("name", "visa_number", "visa_type", "nationality", "date_of_birth",
      "issue_date", "expiry_date", "entries", "duration_of_stay"), True),
    ("NATIONAL_ID", "national_id", "National ID",
     ("name", "date_of_birth", "gender", "document_number", "address", "photo"), True),
    ("DRIVING_LICENCE", "driving_licence", "Driving Licence",
     ("name", "date_of_birth", "document_number", "issue_date", "expiry_date",
      "address", "photo"), False),
    ("PERMIT", "permit", "Permit",
     ("name", "document_number", "permit_type", "issue_date", "expiry_date",
      "nationality"), False),
    ("PAN", "pan", "Permanent Account Number (PAN) Card",
     ("name", "father_name", "date_of_birth", "document_number", "signature"), False),
    ("AADHAAR", "aadhaar", "Aadhaar Card",
     ("name", "date_of_birth", "gender", "document_number", "address", "photo"), False),
    ("OTHER", "generic", "Other / Unsupported Document",
     ("name", "document_number", "date_of_birth"), False),
    ("UNKNOWN", "unknown", "Unknown Document", (), False),
)

NON_OCR_FIELDS = ("photo", "signature", "mrz")

# --- fixed values: masking ---------------------------------------------------

NUMBER_FIELDS = (
    "document_number", "pan_number", "passport_number", "aadhaar_number", "visa_number",
)
PERSON_FIELDS = ("name", "father_name")
DATE_FIELDS = ("date_of_birth", "issue_date", "expiry_date")
SENSITIVE_FIELDS = (
    "document_number", "aadhaar_number", "pan_number", "passport_number", "visa_number",
    "address", "name", "father_name", "mrz", "mrz_line1", "mrz_line2", "mrz_line3",
)

# --- fixed values: field patterns (public shapes) ----------------------------

_DATE_VALUE = (
    r"([0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4}|[0-9]{1,2}\s+[A-Za-z]{3}\s+[0-9]{4})"
)

PATTERNS = {
    "pan": r"\b([A-Z]{5}[0-9]{4}[A-Z])\b",
    "aadhaar": r"\b(\d{4}\s?\d{4}\s?\d{4})\b",
    "passport": r"\b([A-Z][0-9]{7})\b",
    "licence": r"(?i)\b([A-Z]{2}[\-\s]?\d{2}[\-\s]?\d{4}[\-\s]?\d{7})\b",
    "generic_id": r"\b([A-Z]{1,3}[0-9]{6,12}[A-Z0-9]?)\b",
    "name_label": (
        r"(?i)(?:(?:surname|given\s*names?|full\s*name|holder(?:'s)?\s*name|"
        r"(?<!father\s)(?<!mother\s)(?<!husband\s)name)\s*[:\-]\s*)"
        r"([A-Z][A-Za-z]+(?:[\s,]+[A-Z][A-Za-z]+){0,4})"
    ),
    "father_name": (
        r"(?i)(?:father(?:'s)?\s*name|s/?o)\s*[:\-]\s*"
        r"([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3})"
    ),
    "dob_label": r"(?i)(?:dob|date\s*of\s*birth|birth(?:\s*date)?)\s*[:\-]?\s*" + _DATE_VALUE,
    "date": r"\b(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{1,2}\s+[A-Za-z]{3}\s+\d{4})\b",
    "expiry": (
        r"(?i)(?:expir(?:y|es|ation)|valid\s*(?:till|until|to)|date\s*of\s*expiry)\s*[:\-]?\s*"
        + _DATE_VALUE
    ),
    "issue": r"(?i)(?:date\s*of\s*issue|issue(?:d)?(?:\s*date)?|doi)\s*[:\-]?\s*" + _DATE_VALUE,
    "nationality": (
        r"(?i)(?:nationality(?:\s*/\s*nationalit[eé])?|citizen(?:ship)?|country)\s*[:\-]?\s*"
        r"(?:\n|\r\n)?\s*([A-Za-z]{3,20})"
    ),
    "sex": (
        r"(?i)(?:sex(?:\s*/\s*sexe)?|gender)\s*[:\-]?\s*(?:\n|\r\n)?\s*"
        r"([MF]|Male|Female|Other)\b"
    ),
    "address": r"(?i)(?:address|addr)\s*[:\-]?\s*(.{8,100})",
    "visa_number": r"(?i)(?:visa\s*(?:no\.?|number|#))\s*[:\-]?\s*([A-Z0-9]{6,14})",
    "visa_type": r"(?i)(?:visa\s*type|type\s*of\s*visa|category)\s*[:\-]?\s*([A-Za-z0-9/\-]{2,24})",
    "entries": r"(?i)(?:entries|number\s*of\s*entries)\s*[:\-]?\s*(Single|Double|Multiple|\d+)",
    "duration": (
        r"(?i)(?:duration(?:\s*of\s*stay)?|period\s*of\s*stay|stay)\s*[:\-]?\s*"
        r"(\d+\s*(?:days?|months?|years?)|[A-Za-z0-9 ]{2,20})"
    ),
    "permit_type": (
        r"(?i)(?:permit\s*type|type\s*of\s*permit|permit)\s*[:\-]?\s*([A-Za-z0-9/\- ]{3,40})"
    ),
    "passport_label": r"(?i)(?:passport\s*(?:no|number|#))\s*[:\-]?\s*([A-Z][0-9]{7})",
    "pan_label": (
        r"(?i)(?:permanent\s*account\s*(?:number|no)|pan)\s*[:\-]?\s*([A-Z]{5}[0-9]{4}[A-Z])"
    ),
    "licence_label": (
        r"(?i)(?:(?:dl|licence|license)\s*(?:no|number|#)|driving\s*licen[cs]e)\s*[:\-]?\s*"
        r"([A-Z]{2}[\-\s]?\d{2}[\-\s]?\d{4}[\-\s]?\d{7})"
    ),
    "surname": (
        r"(?i)(?:surname(?:\s*/\s*nom)?|nom)\s*[:/\-]?\s*(?:\n|\r\n)?\s*"
        r"([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,2})"
    ),
    "given_names": (
        r"(?i)(?:given\s*names?(?:\s*/\s*prenoms?)?|prenoms?|forenames?)\s*[:/\-]?\s*"
        r"(?:\n|\r\n)?\s*([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,4})"
    ),
    "name_colon": (
        r"(?i)(?<!father\s)(?<!mother\s)(?:full\s*)?name\s*[:\-]\s*"
        r"([A-Z][A-Za-z]+(?:[\s,]+[A-Z][A-Za-z]+){0,4})"
    ),
}

# A captured person name ends where one of these label words starts.
LABEL_WORDS = (
    "address", "addr", "aadhaar", "birth", "category", "citizen", "citizenship", "country",
    "date", "dl", "dob", "doi", "driving", "duration", "entries", "expires", "expiry",
    "father", "gender", "given", "husband", "issue", "issued", "licence", "license",
    "mother", "name", "names", "nationality", "number", "pan", "passport", "permanent",
    "permit", "sex", "surname", "type", "valid", "visa",
)

NATIONALITY_STOP_WORDS = ("of", "the", "and", "for")

MIN_EXTRACTED_CONFIDENCE = 0.35

# --- fixed values: uploads ----------------------------------------------------

DANGEROUS_PREFIXES = (
    "MZ", "\x7fELF", "<!DOCTYPE", "<!doctype", "<html", "<HTML", "<?php", "#!/",
)
EXTENSION_MIME = {
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
    ".webp": "image/webp", ".pdf": "application/pdf",
}

# --- fixed values: weights and thresholds ---------------------------------------

QUALITY_MIN = 0.45

QUALITY_WEIGHTS = {
    "res_score": 0.16, "blur_score": 0.20, "lighting_score": 0.10, "noise_score": 0.08,
    "rotation_score": 0.08, "perspective_score": 0.12, "crop_score": 0.06,
    "visibility_score": 0.08, "compression_score": 0.12,
}

TAMPER_WEIGHTS = {
    "ela_inconsistency": 0.25, "compression_inconsistency": 0.15,
    "noise_inconsistency": 0.15, "edge_inconsistency": 0.10,
    "local_image_anomaly": 0.20, "copy_move_indicators": 0.15,
}
TAMPER_THRESHOLDS = {
    "ela_inconsistency": 0.55, "compression_inconsistency": 0.55,
    "noise_inconsistency": 0.55, "edge_inconsistency": 0.55,
    "local_image_anomaly": 0.60, "copy_move_indicators": 0.85,
}

HEAT_WEIGHTS = {"ela": 0.45, "hf": 0.30, "noise": 0.25}
HOTSPOT_MIN = 0.65
HOTSPOT_MAX = 8

FACE_MATCH_MIN = 0.96
FACE_NO_MATCH_MAX = 0.70

PAD_WEIGHTS = {
    "flat": 0.30, "moire": 0.25, "specular": 0.20, "cast": 0.10,
    "static_penalty": 0.15, "size_penalty": 0.10,
}

CONFIDENCE_WEIGHTS = {
    "evidence_quality": 0.28, "document_type": 0.14, "ocr": 0.14,
    "field_completeness": 0.10, "vision_backbones": 0.12, "fusion": 0.10,
    "cross_validation": 0.08, "calibration": 0.04,
}

CLASSIFIER_FEATURES = (
    "aspect", "card_like", "tall_page", "blue_frac", "warm_frac", "cyan_frac",
    "mean_sat_n", "mean_val_n", "top_edge", "mid_edge", "bottom_edge", "photo_left_bias",
    "prior_passport", "prior_visa", "prior_national_id", "prior_dl", "prior_permit",
    "prior_pan", "prior_aadhaar",
)

FILENAME_PATTERNS = {
    "PAN": (r"\bpan\b", r"permanent.?account"),
    "AADHAAR": (r"aadhaar", r"aadhar", r"uidai", r"\buid\b"),
    "PASSPORT": (r"passport", r"\bppt\b"),
    "VISA": (r"\bvisa\b",),
    "DRIVING_LICENCE": (r"driving", r"\bdl\b", r"licence", r"license"),
    "PERMIT": (r"permit", r"work.?permit", r"residence.?permit"),
    "NATIONAL_ID": (r"national.?id", r"\bnid\b", r"identity.?card", r"\bid.?card\b"),
}
FILENAME_PRIOR = 0.35
FILENAME_OTHER_PRIOR = 0.05

# --- fixed values: fusion vector layout --------------------------------------------

FUSION_LAYOUT = (
    ("enet_fp", 12), ("enet_auth", 1), ("enet_tamp", 1), ("enet_present", 1),
    ("vit_fp", 12), ("vit_auth", 1), ("vit_tamp", 1), ("vit_present", 1),
    ("clip_fp", 16), ("clip_proto", 7), ("clip_present", 1),
    ("evidence_quality", 1), ("ocr_confidence", 1), ("field_completeness", 1),
    ("doc_type_confidence", 1), ("mrz_check_pass_rate", 1), ("mrz_parsed", 1),
)
FUSION_DIM = sum(n for _, n in FUSION_LAYOUT)

# --- fixed values: officer labels and actions ----------------------------------------

OFFICER_LABELS = {
    "PASS_AUTHENTIC": "PASS — AUTHENTIC",
    "TAMPERING_INDICATED": "TAMPERING INDICATED",
    "SUSPICIOUS": "SUSPICIOUS / FAKE INDICATION",
    "INCONCLUSIVE": "INCONCLUSIVE",
}

#: What a decision shows: the code that stands for it, its tone and how strong the evidence against the document is.
#: An elevated decision is one with raised tamper signals.
DECISION_VIEW = {
    "PASS": ("PASS_AUTHENTIC", "ok", "LOW"),
    "INCONCLUSIVE": ("INCONCLUSIVE", "muted", "INCONCLUSIVE"),
    "REVIEW": ("INCONCLUSIVE_REVIEW", "warn", "MEDIUM"),
    "HIGH-RISK": ("SUSPICIOUS", "danger", "HIGH"),
    "HIGH-RISK, elevated": ("TAMPERING_INDICATED", "danger", "HIGH"),
}
#: Labels of codes that only a decision gives, and tones of codes that do not leave them to the decision.
CODE_LABELS = {"INCONCLUSIVE_REVIEW": "INCONCLUSIVE — REVIEW REQUIRED"}
CODE_TONES = {"PASS_AUTHENTIC": "ok", "TAMPERING_INDICATED": "danger", "SUSPICIOUS": "danger", "INCONCLUSIVE_REVIEW": "warn"}
#: Marks beside the parts of a case; what is not listed is "na", or "ok" for the result.
MARKS = {
    "cv_mark": {"PASS": "ok", "WARNING": "warn", "FAIL": "fail"},
    "face_mark": {"DETECTED": "ok", "MULTIPLE_DETECTED": "ok", "NOT_DETECTED": "warn"},
    "result_mark": {"HIGH-RISK": "fail", "INCONCLUSIVE": "warn"},
}

ACTIONS = {
    "PASS": (
        "Routine review acceptable. Confirm with authorized procedures if required — "
        "PASS is not government verification."
    ),
    "HIGH-RISK": (
        "Prioritize human review. Treat as elevated screening risk — "
        "do not treat as a legal fraud finding."
    ),
    "INCONCLUSIVE": (
        "Improve image quality / capture a clearer face match / resubmit if needed."
    ),
}

GENESIS_HASH = "0" * 64

# --- fixed values: texts of reports ---------------------------------------------------

DISCLAIMER = (
    "This report is an AI-assisted screening summary for authorized reviewers. It is not a legal "
    "authenticity certificate, not an official government verification result, and not a "
    "blockchain-anchored credential unless explicitly marked otherwise (current build: LOCAL only)."
)
BANNER = "DEMO / SYNTHETIC PROXY SIGNALS — NOT OFFICIAL VERIFICATION"
