"""Shapes of personal data, for java.util.regex.

Digits are ASCII.  Word boundaries are Unicode-aware on every JVM by the scoped
flag, and white space is what Python's ``\\s`` means.
"""

from __future__ import annotations

from dataclasses import dataclass

B = r"(?U:\b)"
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The characters of WS.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_URL = r"[^\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000<>\"')]"

# The shapes that are scanned for.
EMAIL = rf"{B}[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}{B}"
IBAN = rf"{B}[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{10,30}}{B}"
CARD = rf"{B}(?:[0-9][ \-]?){{13,19}}{B}"
CF_IT = rf"(?iu){B}[A-Z]{{6}}[0-9]{{2}}[A-Z][0-9]{{2}}[A-Z][0-9]{{3}}[A-Z]{B}"
VAT_IT = rf"{B}IT[0-9]{{11}}{B}"
NIF_ES = rf"{B}[XYZ]?[0-9]{{7,8}}[A-Z]{B}"
SSN_US = rf"{B}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{B}"
IPV4 = rf"{B}(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}{B}"
IPV6 = rf"{B}(?:[0-9a-fA-F]{{1,4}}:){{2,7}}[0-9a-fA-F]{{1,4}}{B}"
PHONE = rf"(?:(?<![0-9])\+[0-9]{{1,3}}(?:{WS}|[.\-])?)?(?:\(?[0-9]{{2,4}}\)?(?:{WS}|[.\-])?){{2,4}}[0-9]{{2,4}}(?![0-9])"
DATE = rf"(?iu){B}(?:[0-9]{{1,2}}[/.\-][0-9]{{1,2}}[/.\-][0-9]{{2,4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}{WS}+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?{WS}+[0-9]{{2,4}}){B}"
PLATE_IT = rf"{B}[A-Z]{{2}}{WS}?[0-9]{{3}}{WS}?[A-Z]{{2}}{B}"
URL = rf"{B}https?://{NOT_URL}+"
# Shapes on offer that no default scan looks for.
POSTAL_IT = rf"{B}[0-9]{{5}}{B}"
POSTAL_UK = rf"{B}[A-Z]{{1,2}}[0-9]{{1,2}}[A-Z]?{WS}?[0-9][A-Z]{{2}}{B}"
PASSPORT = rf"{B}[A-Z]{{1,2}}[0-9]{{6,9}}{B}"
NHS_UK = rf"{B}[0-9]{{3}}{WS}?[0-9]{{3}}{WS}?[0-9]{{4}}{B}"

# The kinds that findings may have, URL among them because the scan finds it.
KINDS = (
    "PERSON", "EMAIL", "PHONE", "ADDRESS", "SSN_NATIONAL_ID", "PASSPORT", "DRIVING_LICENCE", "TAX_ID", "IBAN", "CREDIT_CARD", "DOB", "BANK_ACCOUNT",
    "MEDICAL", "BIOMETRIC", "USERNAME", "IP_ADDRESS", "LICENCE_PLATE", "EMPLOYER", "PHOTO", "OTHER",
)
SCANNED_ONLY = ("URL",)
# Kinds that a reviewer's rejection cannot overrule when a check has confirmed them.
HARD_KINDS = ("EMAIL", "IBAN", "CREDIT_CARD", "PHONE", "SSN_NATIONAL_ID", "TAX_ID", "IP_ADDRESS")
# Other names of kinds.
ALIASES = {
    "NAME": "PERSON", "FULL_NAME": "PERSON", "PERSON_NAME": "PERSON", "MAIL": "EMAIL", "E_MAIL": "EMAIL",
    "TELEPHONE": "PHONE", "MOBILE": "PHONE", "PHONE_NUMBER": "PHONE",
    "BIRTH_DATE": "DOB", "DATE_OF_BIRTH": "DOB", "STREET_ADDRESS": "ADDRESS", "LOCATION": "ADDRESS",
    "SOCIAL_SECURITY_NUMBER": "SSN_NATIONAL_ID", "SSN": "SSN_NATIONAL_ID", "NATIONAL_ID": "SSN_NATIONAL_ID", "ID_NUMBER": "SSN_NATIONAL_ID",
    "FISCAL_CODE": "TAX_ID", "VAT": "TAX_ID", "TAX_CODE": "TAX_ID", "CARD": "CREDIT_CARD", "PAN": "CREDIT_CARD", "CREDITCARD": "CREDIT_CARD",
    "BANK_ACCOUNT_NUMBER": "BANK_ACCOUNT", "ACCOUNT_NUMBER": "BANK_ACCOUNT", "LICENSE_PLATE": "LICENCE_PLATE", "PLATE": "LICENCE_PLATE",
    "PHONE_OR_FAX": "PHONE", "HEALTH": "MEDICAL", "DIAGNOSIS": "MEDICAL", "FACE": "BIOMETRIC", "PORTRAIT": "PHOTO", "IMAGE_OF_PERSON": "PHOTO",
    "COMPANY": "EMPLOYER", "ORGANISATION": "EMPLOYER", "ORGANIZATION": "EMPLOYER",
}


@dataclass(frozen=True)
class Scanner:
    """One shape: what it is called, what a text must hold for it to be tried, and how sure a match is."""

    name: str
    kind: str
    pattern: str
    needs: str
    confidence: float
    reason: str
    gate: str | None = None


# The scanners in the order in which they report, with their confidences and reasons.
SCANNERS = (
    Scanner("email", "EMAIL", EMAIL, "@", 0.99, "regex"),
    Scanner("iban", "IBAN", IBAN, "", 0.99, "iban_mod97", "iban"),
    Scanner("card", "CREDIT_CARD", CARD, "", 0.98, "luhn", "luhn"),
    Scanner("cf", "TAX_ID", CF_IT, "", 0.85, "codice_fiscale_shape", "cf"),
    Scanner("vat", "TAX_ID", VAT_IT, "IT", 0.9, "vat_shape"),
    Scanner("nif", "SSN_NATIONAL_ID", NIF_ES, "", 0.95, "nif_checksum", "nif"),
    Scanner("ssn", "SSN_NATIONAL_ID", SSN_US, "-", 0.95, "us_ssn_shape"),
    Scanner("ipv4", "IP_ADDRESS", IPV4, ".", 0.85, "ipv4", "ipv4"),
    Scanner("ipv6", "IP_ADDRESS", IPV6, ":", 0.8, "ipv6"),
    Scanner("phone", "PHONE", PHONE, "", 0.8, "digit_shape", "phone"),
    Scanner("date", "DOB", DATE, "", 0.5, "date_shape_needs_context"),
    Scanner("plate", "LICENCE_PLATE", PLATE_IT, "", 0.7, "it_plate_shape"),
    Scanner("url", "URL", URL, "://", 0.6, "regex"),
)
#: Offered by name, off by default.
EXTRA = (
    Scanner("postal_it", "ADDRESS", POSTAL_IT, "", 0.4, "postal_it_shape"),
    Scanner("postal_uk", "ADDRESS", POSTAL_UK, "", 0.6, "postal_uk_shape"),
    Scanner("passport", "PASSPORT", PASSPORT, "", 0.6, "passport_shape"),
    Scanner("nhs", "MEDICAL", NHS_UK, "", 0.6, "nhs_shape"),
)
