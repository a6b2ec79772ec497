"""Names that tell what a column's values mean, beyond their type."""

from __future__ import annotations

# The names are part of stored schemas.
EMAIL, PHONE, URL, IP, UUID = "email", "phone", "url", "ip", "uuid"
ENUM = "enum"
DATE_STRING, DATETIME_STRING = "date_string", "datetime_string"
JSON_BLOB = "json_blob"
PAN, AADHAAR, GSTIN, SSN = "pan", "aadhaar", "gstin", "ssn"
CREDIT_CARD, IBAN, VAT, SWIFT = "credit_card", "iban", "vat", "swift"

ALL_SEMANTICS = frozenset({EMAIL, PHONE, URL, IP, UUID, ENUM, DATE_STRING, DATETIME_STRING, JSON_BLOB, PAN, AADHAAR, GSTIN, SSN, CREDIT_CARD, IBAN, VAT, SWIFT})

UNION = "union:"


def union_name(members: list[str]) -> str:
    return UNION + "|".join(members)


def union_members(semantic: str | None) -> list[str] | None:
    return semantic[len(UNION) :].split("|") if semantic and semantic.startswith(UNION) else None
