"""Damage triage from seller text and structured claims; never an inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DAMAGE_MIX
from . import text as tx

# Phrases of the damage classes and of the wider risk rules.
SEVERE = (
    r"\b(?:telaio\s+(?:piegato|danneggiato|deformato)|danni?\s+struttural\w*|"
    r"airbag.{0,24}(?:esplos\w*|scoppi\w*|apert\w*|attivat\w*)|"
    r"alluvionat\w*|incendiat\w*|motore\s+(?:rotto|fuso|da\s+(?:rifare|sostituire|cambiare|riparare))|"
    r"(?:guasto|problemi|rottura)\s+(?:al\s+|del\s+)?(?:motore|cambio)|non\s+marciante|"
    r"batteria\s+(?:alta\s+tensione|trazione).{0,20}(?:danneggiat\w*|guast\w*)|"
    r"gravemente\s+incidentat\w*|uso\s+ricambi)\b"
)
NON_SEVERE = (
    r"\b(?:grandin\w*|ammaccatur\w*|ammaccat\w*|"
    r"(?:paraurti|parafango|portiera|cofano|carrozzeria|lamiera).{0,30}"
    r"(?:da\s+(?:riparare|sistemare|verniciare|sostituire)|danneggiat\w*|rott\w*|crepa)|"
    r"(?:dann\w*|crepa|riparazione).{0,25}(?:paraurti|parafango|portiera|carrozzeria)|"
    r"carrozzeria\s+scolorita)\b"
)
MINIMAL = (
    r"\b(?:graffi\w*|lievi\s+segni|piccol[ie]\s+segni|segni\s+superficiali|"
    r"lievi\s+ammaccature|piccol[ae]\s+ammaccatur\w*)\b"
)
DISCLOSED = r"\b(?:incidentat\w*|sinistrat\w*|danneggiat\w*)\b"
GOOD_CONDITION = (
    r"(?:\b(?:auto|vettura|macchina).{0,35}(?:in\s+)?(?:buone|ottime|perfette)\s+condizioni|"
    r"\b(?:ottime|perfette)\s+condizioni\s+(?:generali|meccaniche\s+e\s+di\s+carrozzeria))"
)
SEVERE_INDICATORS = ("structural", "airbags", "fire", "flood", "high_voltage_battery")
NOT_NOW = r"\b(?:non|prima|era|erano)\b"
INNER_NEGATION = r"\b(?:non|mai)\s+(?:esplos|scoppi|apert|attivat)"
RISK = (
    r"\b(?:incidentat\w*|sinistrat\w*|danneggiat\w*|grandin\w*|airbag.{0,15}(?:scoppi|esplos)|alluvionat\w*|"
    r"incendiat\w*|uso ricambi|non marciante|motore\s+(?:da\s+(?:cambiare|sostituire|rifare)|rotto|fuso)|"
    r"(?:problemi|guasto|guasti)\s+(?:al\s+)?(?:motore|cambio)|carrozzeria\s+scolorita|crepa\s+sul\s+parafango)\b"
)
SEVERE_REVIEW = (
    r"(?:gravemente incidentat\w*|severely damaged|structural damage|"
    r"longheron\w* (?:piegat\w*|deformat\w*|danneggiat\w*)|telaio (?:piegato|deformato|danneggiato)|"
    r"airbag\w* (?:scoppiat\w*|esplos\w*|deployed)|alluvionat\w*|incendiat\w*|auto bruciat\w*)"
)


def signals(text: Column, pattern: str) -> Column:
    """Declared phrases: not negated before, and not negated inside the phrase."""
    return F.filter(tx.declared(text, pattern), lambda m: ~F.rlike(m, F.lit("(?iuU)" + INNER_NEGATION)))


def risk_signals(text: Column) -> Column:
    return tx.declared(text, RISK, tx.NARROW_NEGATION)


def severe_signals(text: Column) -> Column:
    return tx.declared(F.lower(text), SEVERE_REVIEW, tx.NARROW_NEGATION)


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def risky(df: DataFrame) -> Column:
    """Damaged, severe, flagged or described as damaged without negation."""
    body = tx.full_text(_column(df, "title", "string"), _column(df, "description", "string"))
    return (
        F.coalesce(_column(df, "condition", "string") == "damaged", F.lit(False))
        | F.coalesce(_column(df, "damage_severity", "string") == "severe", F.lit(False))
        | F.coalesce(F.size(_column(df, "damage_indicators", "array<string>")) > 0, F.lit(False))
        | (F.size(risk_signals(body)) > 0)
    )


def with_damage(df: DataFrame) -> DataFrame:
    """Add ``damage_category``, ``damage_evidence`` and ``damage_group``.

    Optional inputs beyond title and description: condition, damage_severity, damage_indicators,
    claimed_damaged, claimed_damaged_now, had_accident (booleans) and declared_damages (array).
    Every scan of the text happens once, in its own projection.
    """
    text_of = lambda n: _column(df, n, "string")
    flag = lambda n: F.coalesce(_column(df, n, "boolean"), F.lit(False))
    declared_list = _column(df, "declared_damages", "array<string>")
    body = F.concat_ws(
        " ", tx.full_text(text_of("title"), text_of("description")), F.array_join(declared_list, " ")
    )
    scanned = tx.staged(tx.staged(df, {"_body": body}), {
        "_scan": F.struct(
            signals(F.col("_body"), SEVERE).alias("severe"),
            signals(F.col("_body"), MINIMAL).alias("minimal"),
            signals(F.col("_body"), NON_SEVERE).alias("moderate"),
            (F.size(signals(F.col("_body"), DISCLOSED)) > 0).alias("disclosed"),
            F.filter(
                signals(F.col("_body"), GOOD_CONDITION), lambda m: ~F.rlike(m, F.lit("(?iuU)" + NOT_NOW))
            ).alias("good"),
        ),
    }).drop("_body")
    severe, minimal = F.col("_scan.severe"), F.col("_scan.minimal")
    # A generic phrase nested inside a milder one is the milder one.
    moderate = F.filter(
        F.col("_scan.moderate"),
        lambda m: ~F.exists(F.col("_scan.minimal"), lambda n: F.lower(n).contains(F.lower(m))),
    )
    severity = text_of("damage_severity")
    known = F.array(*(F.lit(i) for i in SEVERE_INDICATORS))
    given = F.coalesce(_column(df, "damage_indicators", "array<string>"), F.array().cast("array<string>"))
    indicators = F.filter(given, lambda i: F.array_contains(known, i))
    condition = text_of("condition")
    search_now = _column(df, "claimed_damaged", "boolean")
    detail_now = _column(df, "claimed_damaged_now", "boolean")
    current = F.when(F.coalesce(search_now, F.lit(False)) | detail_now.isNull(), search_now).otherwise(detail_now)
    has_list = F.coalesce(F.size(declared_list) > 0, F.lit(False))
    unknown = (
        F.coalesce(condition == "damaged", F.lit(False)) | F.coalesce(current, F.lit(False))
        | flag("had_accident") | has_list | F.col("_scan.disclosed")
    )
    clean = (
        F.coalesce(condition == "undamaged", F.lit(False)) | F.coalesce(~current, F.lit(False))
        | (F.size("_scan.good") > 0)
    )
    category = (
        F.when(F.coalesce(severity == "severe", F.lit(False)) | (F.size(indicators) > 0) | (F.size(severe) > 0), "severe")
        .when((F.size(moderate) > 0) | F.coalesce(severity == "moderate", F.lit(False)), "non_severe")
        .when((F.size(minimal) > 0) | F.coalesce(severity == "minor", F.lit(False)), "minimal")
        .when(unknown, "unknown")
        .when(clean, "clean")
        .otherwise("unknown")
    )
    evidence = (
        F.when(F.col("damage_category") == "severe", F.concat(severe, indicators))
        .when(F.col("damage_category") == "non_severe", moderate)
        .when(F.col("damage_category") == "minimal", minimal)
        .when(F.col("damage_category") == "clean", F.col("_scan.good"))
        .otherwise(F.array().cast("array<string>"))
    )
    disclosed = (
        F.coalesce(condition == "damaged", F.lit(False)) | flag("had_accident") | flag("claimed_damaged")
        | flag("claimed_damaged_now") | F.col("_scan.disclosed")
    )
    group = F.when(F.col("damage_category") != "unknown", F.col("damage_category")).otherwise(
        F.when(disclosed, "damaged_unspecified").otherwise("condition_unknown")
    )
    judged = tx.staged(scanned, {"damage_category": category})
    return judged.withColumn("damage_evidence", evidence).withColumn("damage_group", group).drop("_scan")


def eligible(category: Column | str) -> Column:
    return tx.col(category).isin(*DAMAGE_MIX)
