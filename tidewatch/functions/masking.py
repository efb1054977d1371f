"""Seven masking policies as native column expressions. NULL stays NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Masked shapes and readable-data patterns.
ADDRESS_MASK = "*** (masked)"
PHONE_READABLE = r"^\+91\d{10}$"
PAN_READABLE = r"^[A-Z]{5}\d{4}[A-Z]$"


def mask_name(value: Column) -> Column:
    words = F.regexp_replace(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.regexp_replace(words, r"(?U)(\S)\S*", "$1***")


def mask_phone(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 3), F.lit("******"), F.right(value, F.lit(4)))


def mask_email(value: Column) -> Column:
    at = F.instr(value, "@")
    domain = F.substr(value, at + 1)
    user = F.when(at > 1, F.substring(value, 1, 1)).otherwise("")
    return F.when(value.isNull(), None).when(
        (at > 0) & (domain != ""), F.concat(user, F.lit("***@"), domain)).otherwise("***")


def mask_pan(value: Column) -> Column:
    return F.when(F.length(value) == 10, F.concat(F.lit("*****"), F.substring(value, 6, 4), F.lit("*"))).when(
        value.isNotNull(), "*" * 10)


def mask_licence(value: Column) -> Column:
    hidden = F.greatest(F.length(value) - 4, F.lit(0))
    return F.concat(F.substring(value, 1, 4), F.repeat(F.lit("*"), hidden))


def mask_address(value: Column) -> Column:
    return F.when(value.isNotNull(), ADDRESS_MASK)


def mask_dob(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 4), F.lit("-**-**"))


POLICIES: dict[str, Callable[[Column], Column]] = {
    "name": mask_name, "phone": mask_phone, "email": mask_email, "licence_no": mask_licence,
    "pan": mask_pan, "address": mask_address, "dob": mask_dob,
}


def mask_table(df: DataFrame, when: Column | None = None) -> DataFrame:
    """Mask every personal column present; with ``when``, only rows that satisfy it."""
    changes = {}
    for name, policy in POLICIES.items():
        if name in df.columns:
            masked = policy(F.col(name).cast("string"))
            changes[name] = masked if when is None else F.when(when, masked).otherwise(F.col(name).cast("string"))
    return df.withColumns(changes) if changes else df


def mask_payload(payload: Column, contract_columns: list[str]) -> Column:
    """Mask a raw map row. Keys outside the contract may be renamed personal data: hidden whole."""
    def hide(key: Column, value: Column) -> Column:
        out = F.when(key.isin(*contract_columns), value).otherwise(F.lit(ADDRESS_MASK))
        for name, policy in POLICIES.items():
            out = F.when(key == name, policy(value)).otherwise(out)
        return out
    return F.transform_values(payload, hide)


def readable(phone: Column, pan: Column, masked: Column) -> Column:
    """The row still shows personal data."""
    return (F.coalesce(masked, F.lit(0)) == 0) | F.coalesce(phone.rlike(PHONE_READABLE), F.lit(False)) | F.coalesce(
        pan.rlike(PAN_READABLE), F.lit(False))
