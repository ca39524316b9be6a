"""Which declared fields may leave the house, and free text that keeps only declared values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.functions import patterns as P
from evidloom.functions.text import collapse

# The fields that a company may declare, and what kind of value each holds.
FIELD_KINDS = {
    "company_name": "freeform", "legal_entity": "freeform", "registration_number": "identifier", "vat_id": "identifier", "hq_address": "freeform", "website": "url", "iso_scope": "freeform",
    "security_contact_name": "freeform", "security_contact_email": "email", "security_contact_phone": "phone", "dpo_name": "freeform", "dpo_email": "email", "dpo_phone": "phone",
}


def classify_fields(df: DataFrame, name: str, value: str) -> DataFrame:
    """Adds field_class (1 for declared company data, else 2) and class_reason. Unknown names and values that do not fit
    their kind are class 2; null values are empty."""
    low = F.lower(F.trim(F.col(name)))
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in FIELD_KINDS.items() for x in kv)), low)
    v = collapse(F.coalesce(F.col(value), F.lit("")))
    digits = F.length(F.regexp_replace(v, r"\D", ""))
    ok = (
        F.when(v == "", F.lit(False))
        .when(kind == "email", v.rlike(r"(?i)^[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\z"))
        .when(kind == "phone", digits.between(7, 15))
        .when(kind == "url", v.rlike(r"(?i)^https?://[^\s/]+\.[^\s]+\z"))
        .when(kind == "identifier", v.rlike(r"^[A-Za-z0-9][A-Za-z0-9 ./_-]*\z"))
        .otherwise(F.lit(True))
    )
    reason = F.when(kind.isNull(), "field_not_company_metadata").when(~ok, "declared_field_failed_validation").otherwise("declared_company_metadata")
    return df.withColumn("class_reason", reason).withColumn("field_class", F.when(reason == "declared_company_metadata", 1).otherwise(2))


def _spelled(value: str) -> str:
    """A pattern of a declared telephone number in whatever spacing: its digits with blanks and signs between them."""
    digits = [c for c in value if c.isdecimal()]
    lead = r"\+?" if value.lstrip().startswith("+") else ""
    return rf"(?<![\w+]){lead}\(?{r'[ \t()./-]*'.join(digits)}(?!\w)"


def keepable(value: str) -> bool:
    """Whether a declared value may be kept at all: accounts and tokens never are."""
    return not P.never_kept(value)


def guard_text(text: Column, declared: list[str]) -> Column:
    """(text, masked_types): sensitive values masked, except the declared ones, which are few and known to the driver.

    A declared value is swapped for a harmless word, the whole text is masked, and the word is swapped back; longer values
    go first, so that one inside another does not tear it. A declared telephone number (7 to 15 digits and signs only) is
    found in any spacing and kept as it stands in the text. A text that holds the sign KEPT keeps nothing. Account numbers and tokens are masked even if declared.
    """
    ordered = sorted({d for d in declared if d and keepable(d)}, key=lambda d: (-len(d), d))
    numbers = [d for d in ordered if re.fullmatch(r"[+\d\s()./-]+", d) and 7 <= sum(c.isdecimal() for c in d) <= 15]
    patterns = [_spelled(d) if d in numbers else f"\\Q{d}\\E" for d in ordered if "\\E" not in d]
    if not patterns:
        masked = P.mask(text)
        return F.struct(masked.alias("text"), _types(masked).alias("masked_types"))
    pattern = f"({'|'.join(patterns)})"
    kept = F.regexp_extract_all(text, F.lit(pattern), 1)
    # what is kept is one sign that no detector knows, between words, so that its neighbours are seen as they were
    masked = P.mask(F.when(text.contains(KEPT), text).otherwise(F.regexp_replace(text, pattern, KEPT)))
    parts = F.split(masked, KEPT, -1)
    back = F.array_join(F.zip_with(parts, F.concat(kept, F.array(F.lit(""))), lambda p, k: F.concat(p, F.coalesce(k, F.lit("")))), "")
    whole = F.when(text.contains(KEPT), masked).otherwise(back)
    return F.struct(whole.alias("text"), _types(masked).alias("masked_types"))


KEPT = "\ue001"  # stands for a value that is kept


def _types(masked: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(masked, F.lit(r"\[([a-z_]+):redacted\]"), 1)))
