"""Personal data in message texts: findings and redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns stay in the subset that Java and RE2 read alike. Order is the order of redaction.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\b",
    "ipv6": r"\b(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}\b|\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b",
    "phone": r"\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?[ -][0-9]{3}[ -]?[0-9]{4}\b",
}


# A text without this character holds no match, which spares it the pattern.
_NEEDS = {"email": "@", "phone": "+", "ipv4": ".", "ipv6": ":"}


def _may_hold(text: Column, kind: str) -> Column:
    return text.contains(_NEEDS[kind]) if kind in _NEEDS else text.rlike("[A-Z]{2}[0-9]{2}" if kind == "iban" else "[0-9]{4}")


def _searched(kind: str) -> Column:
    """The text a kind is looked for in: card numbers not inside bank numbers."""
    text = F.col("text")
    if kind != "card":
        return text
    return F.when(_may_hold(text, "iban"), F.regexp_replace(text, PATTERNS["iban"], "[IBAN]")).otherwise(text)


def findings(messages: DataFrame) -> DataFrame:
    """Rows ``channel, timestamp, kind, value, n``; ``valid`` is the test of the check digits of cards and bank numbers, and of the number of groups of IPv6 addresses."""
    matches = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.when(_may_hold(F.col("text"), kind), F.regexp_extract_all(_searched(kind), F.lit(pattern), F.lit(0))).alias("values"),
            )
            for kind, pattern in PATTERNS.items()
        ]
    )
    found = messages.select("channel", "timestamp", F.explode(matches).alias("m")).select(
        "channel", "timestamp", "m.kind", F.explode("m.values").alias("value")
    )
    return (
        found.groupBy("channel", "timestamp", "kind", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "valid",
            F.when(F.col("kind") == "card", check_digit(F.col("value")))
            .when(F.col("kind") == "iban", bank_check(F.col("value")))
            .when(F.col("kind") == "ipv6", _few_groups(F.col("value")))
            .otherwise(True),
        )
    )


def redact(text: Column, remove: bool = False) -> Column:
    """Mask findings as ``[KIND]``, or remove them."""
    return reduce(
        lambda acc, item: F.regexp_replace(acc, item[1], "" if remove else f"[{item[0].upper()}]"),
        PATTERNS.items(),
        text,
    )


def check_digit(number: Column) -> Column:
    """Luhn test over the digits of a number."""
    digits = F.reverse(F.split(F.regexp_replace(number, r"[^0-9]", ""), ""))
    weighted = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(weighted, F.lit(0), lambda acc, d: acc + d) % 10 == 0


def bank_check(number: Column) -> Column:
    """Remainder test over a bank number: its first four signs go last, letters count from 10, and 97 leaves 1."""
    compact = F.replace(number, F.lit(" "), F.lit(""))
    signs = F.split(F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4)), "")

    def step(rest: Column, sign: Column) -> Column:
        return F.when(sign.rlike("[0-9]"), rest * 10 + sign.cast("int")).otherwise(rest * 100 + F.ascii(sign) - 55) % 97

    return F.length(compact).between(15, 34) & (F.aggregate(signs, F.lit(0), step) == 1)


def _few_groups(address: Column) -> Column:
    groups = F.size(F.filter(F.split(address, ":"), lambda g: g != ""))
    return F.when(address.contains("::"), groups <= 7).otherwise(groups == 8)
