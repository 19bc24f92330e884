"""Fixed values that must equal the loader's documented behaviour.

Everything here is data, kept in the natural order the rules read it in:
the first entry that applies wins wherever order matters.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay equal for identical results)
# ---------------------------------------------------------------------------

# Anchored value patterns (email, phone, numeric, date).
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^[\+]?[1-9][\d]{0,15}$"
NUMERIC_PATTERN = r"^-?\d*\.?\d+$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$|^\d{2}/\d{2}/\d{4}$|^\d{2}-\d{2}-\d{4}$"

# Date formats tried in this order when text is turned into a timestamp.
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy"]

# Words read as booleans when converting a column.
BOOL_TRUE_WORDS = ["true", "1", "yes", "si", "verdadero", "sí"]
BOOL_FALSE_WORDS = ["false", "0", "no", "falso"]

# Words accepted by the boolean type check of the row validator (a different set).
BOOL_CHECK_WORDS = ["true", "false", "yes", "no", "y", "n", "1", "0"]

# Text tokens that stand for a missing value.
NULL_TOKENS = ["", "null", "none", "n/a", "na", "#n/a", "nan"]

# Type-vote patterns: date, date-time, integer, decimal (tested in that order
# after the boolean words).
VOTE_DATE_PATTERNS = [r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$", r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}$"]
VOTE_DATETIME_PATTERN = r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\s+\d{1,2}:\d{2}(:\d{2})?(\s*(AM|PM))?$"
VOTE_INTEGER_PATTERN = r"^-?\d+$"
VOTE_DECIMAL_PATTERNS = [r"^-?\d+\.\d+$", r"^-?\d{1,3}(,\d{3})*(\.\d+)?$"]
VOTE_THRESHOLD = 0.6
KIND_THRESHOLD = 0.7
KIND_SAMPLE_ROWS = 100

# Substrings that flag a text value for the special-character rule, in order.
SPECIAL_CHARS = ["'", '"', ";", "--", "/*", "*/", "xp_", "sp_"]

# Column-name words that switch on the positive-number rule.
POSITIVE_NAME_WORDS = ["price", "amount", "quantity", "count", "total", "precio", "cantidad"]

# Column-name words that mark a column as an identifier for the duplicate warning.
UNIQUE_NAME_WORDS = ["id", "code", "number", "codigo", "numero"]

# Valid date window of the date-range rule and the far-future horizon.
DATE_RANGE_MIN = "1900-01-01"
DATE_RANGE_MAX = "2100-12-31"
FUTURE_YEARS = 10

# Error rate above which a validated batch is not valid.
MAX_ERROR_RATE = 0.1

# Column-name normalisation: one prefix, then one suffix is removed.
NAME_PREFIXES = ["tbl", "col", "fld", "field"]
NAME_SUFFIXES = ["id", "key", "code", "num", "no"]

# Pattern families for the name-matching bonus, in order.
PATTERN_FAMILIES = [
    ("id", ["id", "identifier", "key", "codigo", "code"]),
    ("name", ["name", "nombre", "title", "titulo", "descripcion", "description"]),
    ("date", ["date", "fecha", "time", "tiempo", "created", "updated", "modified"]),
    ("email", ["email", "correo", "mail"]),
    ("phone", ["phone", "telefono", "tel", "celular", "mobile"]),
    ("address", ["address", "direccion", "location", "ubicacion"]),
    ("status", ["status", "estado", "active", "activo", "enabled"]),
    ("amount", ["amount", "monto", "price", "precio", "cost", "costo", "value", "valor"]),
    ("quantity", ["quantity", "cantidad", "qty", "count", "numero"]),
]

# Linkage thresholds (0-100 scale).
LINK_ACCEPT = 70
LINK_HIGH = 85
LEV_ACCEPT = 80

# Weighted linkage: weights of ratio, partial ratio, token-sort ratio, token-set ratio.
LINK_WEIGHTS = (0.3, 0.2, 0.3, 0.2)
# Earlier linkage variant: its weights and acceptance score (no bonus, no normalisation).
LINK_WEIGHTS_EARLY = (0.4, 0.2, 0.2, 0.2)
LINK_EARLY_ACCEPT = 80

# Name-pattern bonus: both names in a family, one name in a family, length gap ≤ 2, length
# gap ≤ 5, cap.
BONUS_BOTH = 15.0
BONUS_ONE = 5.0
BONUS_GAP_2 = 5.0
BONUS_GAP_5 = 2.0
BONUS_CAP = 20.0

# difflib suggestions: how many, the case-sensitive cutoff, the low-confidence mark.
CLOSE_MATCHES = 3
CLOSE_CUTOFF = 0.6
LOW_CONFIDENCE = 0.5

# Alternatives for unmatched names: how many, the minimum token-sort score.
ALTERNATIVES = 3
ALTERNATIVE_MIN = 50

# Group similarity: member scorer weights (ratio, partial, token-sort), mean-best vs share
# weights, "good member" score, member vs group-name weights, groups kept.
GROUP_MEMBER_WEIGHTS = (0.5, 0.3, 0.2)
GROUP_MEAN_SHARE = (0.7, 0.3)
GROUP_GOOD_MEMBER = 70
GROUP_TOTAL_WEIGHTS = (0.6, 0.4)
GROUP_TOP = 5

# Match-quality bands of confidence (0-1): high from, medium from.
MATCH_HIGH = 0.85
MATCH_MEDIUM = 0.7

# Column profile: null share that warns, null share that errors (off by default).
NULL_WARN_PCT = 50
NULL_ERROR_PCT = 80
# Invalid-email share that warns.
EMAIL_WARN_RATE = 0.1
# Outlier fences: quartiles and the IQR factor.
QUARTILES = (0.25, 0.75)
IQR_FACTOR = 1.5

# Issue report: first errors and warnings kept.
TOP_ERRORS = 10
TOP_WARNINGS = 5

# Rows checked by the duplicate preview.
PREVIEW_ROWS = 100

# Customer status windows, in months before the reference date: Active, Inactive.
ACTIVE_MONTHS = 3
INACTIVE_MONTHS = 12

# Status and operation labels of the audit summary.
STATUS_LABELS = {"SUCCESS": "Exitoso", "FAILED": "Fallido", "PARTIAL": "Parcial"}
OPERATION_LABELS = {
    "INSERT": "Inserción",
    "UPDATE": "Actualización",
    "DELETE": "Eliminación",
    "SELECT": "Consulta",
    "BULK_INSERT": "Inserción Masiva",
}

# Spanish month names, January first (month column default of the reconciliation load).
SPANISH_MONTHS = ["ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO", "JULIO",
                  "AGOSTO", "SEPTIEMBRE", "OCTUBRE", "NOVIEMBRE", "DICIEMBRE"]

# Lockout policy: failures in a row that lock, and the lock length.
LOCK_AFTER_FAILURES = 3
LOCK_MINUTES = 15

# Month partition boundaries of the audit log (RANGE RIGHT).
AUDIT_MONTH_BOUNDARIES = [f"2025-{m:02d}-01" for m in range(1, 13)]
