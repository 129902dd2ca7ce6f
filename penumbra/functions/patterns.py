"""Patterns, tables and constants that decide what counts as an entity.

They are written for Java's regular expressions and need (?U), so that word boundaries and digits are Unicode's.
"""

#: Entity types in the order in which findings of one document are listed.
ORDER = ("FR_NIR", "EMAIL_ADDRESS", "US_SSN", "IBAN_CODE", "CREDIT_CARD", "PHONE_NUMBER", "EU_VAT", "FR_SIRET", "FR_SIREN")

COUNTRIES = "AT BE BG CY CZ DE DK EE EL ES FI FR HR HU IE IT LT LU LV MT NL PL PT RO SE SI SK".split()

PATTERN = {
    "FR_NIR": r"\b[12][ .]?\d{2}[ .]?(?:0[1-9]|1[0-2]|[2-9]\d)[ .]?(?:\d{2}|2[AB])[ .]?\d{3}[ .]?\d{3}[ .]?\d{2}\b",
    "EMAIL_ADDRESS": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "US_SSN": r"\b\d{3}[ -]\d{2}[ -]\d{4}\b",
    "IBAN_CODE": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4})*[ ]?[A-Z0-9]{0,3}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]?){12,18}\d\b",
    "PHONE_NUMBER": r"\+\d{1,3}[ .-]?\d{1,4}(?:[ .-]?\d{1,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\b0[1-9](?:[ .-]?\d\d){4}\b|\b\d{3}[ .-]\d{3}[ .-]\d{4}\b",
    "EU_VAT": r"\b(?i:" + "|".join(COUNTRIES) + r")[ \u00a0]?[A-Za-z0-9]{2,13}\b",
    "FR_SIRET": r"\b\d{3}[ .]?\d{3}[ .]?\d{3}[ .]?\d{5}\b",
    "FR_SIREN": r"\b\d{3}[ .]?\d{3}[ .]?\d{3}\b",
}

#: (lead, pattern) that finds the same as the patterns above in time and stack that long texts allow. A lead is read
#: over and no part of what is found.
#: Emails: a run of an address's characters has one place where a match can start, its first word boundary; a start
#: further on would have to reach the same @. So a run is read once, from its beginning or from the last match's end.
#: IBANs: groups are read without going back, which Java does in a loop; where the end then isn't at a word boundary,
#: going back can only end behind the space of the last group that has one.
LOCAL = r"[A-Za-z0-9._%+-]"
SCAN = {
    "EMAIL_ADDRESS": (rf"(?>\G|(?<!{LOCAL}))(?>\b|(?:[.%+-]++|[A-Za-z0-9_]++)\b)", rf"{LOCAL}++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b"),
    "IBAN_CODE": ("", r"\b[A-Z]{2}\d{2}(?:(?:[ ]?[A-Z0-9]{4})*+[ ]?[A-Z0-9]{0,3}\b|(?:[A-Z0-9]{4})*+(?:[ ][A-Z0-9]{4}(?:[A-Z0-9]{4})*+(?=[ ][A-Z0-9]{4}))*+[ ](?=[A-Z0-9]{4}))"),
}

SCORE = {"FR_NIR": 1.0, "EMAIL_ADDRESS": 0.9, "US_SSN": 0.85, "IBAN_CODE": 1.0, "CREDIT_CARD": 1.0, "PHONE_NUMBER": 0.75, "FR_SIRET": 1.0, "FR_SIREN": 1.0}
VAT_CHECKED, VAT_FORMAT = 1.0, 0.8

#: What any valid finding of a type holds: (substring or None, pattern or None). Cheap tests before a scan; those of the
#: long numbers are one and the same, so a plan works it out once.
DIGITS = r"\d(?:[ .-]?[\dAB]){8}"
GATE = {t: (None, DIGITS) for t in ("FR_NIR", "US_SSN", "CREDIT_CARD", "FR_SIRET", "FR_SIREN")} | {
    "EMAIL_ADDRESS": ("@", None),
    "IBAN_CODE": (None, r"[A-Z]{2}\d{2}[ ]?[A-Z0-9]{4}"),
    "PHONE_NUMBER": (None, r"\d(?:[ .()-]{0,2}\d){6}"),
    "EU_VAT": (None, r"[A-Za-z]{2}[ \u00a0]?[A-Za-z0-9]{0,2}[0-9]"),
}

#: Card prefixes with the lengths their issuers use; the first that holds decides: (digits compared, from, to, lengths).
ISSUERS = (
    ("visa", 1, 4, 4, (13, 16, 19)),
    ("mastercard", 2, 51, 55, (16,)),
    ("mastercard", 4, 2221, 2720, (16,)),
    ("amex", 2, 34, 34, (15,)),
    ("amex", 2, 37, 37, (15,)),
    ("discover", 4, 6011, 6011, (16, 19)),
    ("discover", 6, 622126, 622925, (16, 19)),
    ("discover", 3, 644, 649, (16, 19)),
    ("discover", 2, 65, 65, (16, 19)),
    ("diners", 3, 300, 305, (14,)),
    ("diners", 4, 3095, 3095, (14,)),
    ("diners", 2, 36, 36, (14,)),
    ("diners", 2, 38, 39, (14,)),
    ("jcb", 4, 3528, 3589, (16, 17, 18, 19)),
    ("unionpay", 2, 62, 62, (16, 17, 18, 19)),
)

#: VAT bodies known by their form alone.
VAT_FORMS = {
    "AT": "U[0-9]{8}", "DE": "[0-9]{9}", "EE": "[0-9]{9}", "EL": "[0-9]{9}", "PT": "[0-9]{9}", "DK": "[0-9]{8}", "FI": "[0-9]{8}", "HU": "[0-9]{8}", "MT": "[0-9]{8}", "SI": "[0-9]{8}",
    "BG": "[0-9]{9,10}", "CZ": "[0-9]{8,10}", "RO": "[0-9]{2,10}", "PL": "[0-9]{10}", "SK": "[0-9]{10}", "HR": "[0-9]{11}", "IT": "[0-9]{11}", "LV": "[0-9]{11}", "SE": "[0-9]{12}",
    "LT": "([0-9]{9}|[0-9]{12})", "CY": "[0-9]{8}[A-Z]", "ES": "[A-Z0-9][0-9]{7}[A-Z0-9]", "IE": "([0-9]{7}[A-Z]{1,2}|[0-9][A-Z0-9][0-9]{5}[A-Z])",
}

#: Labels of company numbers, sought in this many characters before the number.
LABELS, LABEL_REACH = "SIRET|SIREN|RCS|EUID", 49
#: A postal operator's company number, whose establishments have a check of their own.
LA_POSTE = "356000000"
BLOCK = "█"
