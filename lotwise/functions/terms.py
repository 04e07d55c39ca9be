"""Wording rules on sale terms: payment plans, conditions, services and anomalies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# Wording of sale terms.
PAYMENT = r"(?:\b(?:anticipo|acconto|rata|rate mensili)\b|(?:€|eur)\s*/\s*mese)"
EXPORT_ONLY = (
    r"(?:\bnon\s+immatricolabil\w*|\besclusivamente\s+per\s+esportazione|"
    r"\besportazione\s+fuori\s+dall[’']\s*unione\s+europea)"
)
CONDITIONAL = (
    r"(?:prezzo.{0,40}(?:solo con|con obbligo|vincolato|soggetto).{0,25}finanziament|finanziamento obbligatorio|"
    r"prezzo.{0,25}con finanziament|iva\s*esclusa|\+\s*iva|(?:solo|per)\s*ricambi|fermo amministrativo|senza documenti)"
)
BUYING_SERVICE = r"\b(?:ritiriamo|compriamo|acquistiamo)\s+(?:le\s+)?auto\s+usate\b"
SERVICE_OFFER = r"\b(?:qualsiasi tipo|se vuoi vendere|valutazioni|pagamento rapido)\b"
ANOMALIES = {
    "conditional_financing_price": r"(?:prezzo.{0,25}(?:solo|con|vincolato).{0,20}finanziamento|finanziamento obbligatorio)",
    "deposit_or_installment": r"(?:prezzo.{0,15}(?:acconto|anticipo)|solo\s+\d+\s*(?:€|euro)\s*(?:al mese|/mese)|rata mensile)",
    "parts_only_vehicle": r"(?:solo (?:per )?ricambi|uso ricambi|non vend(?:o|esi) intera)",
    "unresolved_mileage": r"(?:km non (?:certificati|verificabili)|chilometri (?:scalati|non verificabili))",
    "documents_unavailable": r"(?:senza documenti|documenti mancanti|fermo amministrativo)",
}
ALWAYS_OPEN = ("inactive_source", "non_total_price", "conflicting_vehicle_identity")


def market_restricted(text: Column) -> Column:
    return tx.says(text, EXPORT_ONLY)


def amount_usable(price: Column, kind: Column, text: Column) -> Column:
    """A positive whole amount that is neither a part payment nor export-only."""
    k = F.coalesce(kind, F.lit(""))
    return (
        F.coalesce(price > 0, F.lit(False))
        & ~k.isin("deposit", "installment")
        & ~((k != "total") & tx.says(text, PAYMENT))
        & ~market_restricted(text)
    )


def conditional_price(text: Column) -> Column:
    return tx.says(F.coalesce(tx.squash(text), F.lit("")), CONDITIONAL)


def buying_service(description: Column) -> Column:
    body = F.coalesce(tx.squash(description), F.lit(""))
    return tx.says(body, BUYING_SERVICE) & tx.says(body, SERVICE_OFFER)


def anomaly_flags(text: Column, kind: Column, active: Column, identity_conflict: Column, resolved: Column) -> Column:
    """Announcement flags left after a reviewer resolved some; three kinds stay open."""
    body = F.lower(text)
    found = {name: tx.says(body, pattern) for name, pattern in ANOMALIES.items()}
    found["non_total_price"] = F.coalesce(kind != "total", F.lit(True))
    found["inactive_source"] = F.coalesce(~active, F.lit(False))
    found["conflicting_vehicle_identity"] = identity_conflict
    flags = tx.labels(**found)
    done = F.coalesce(resolved, F.array().cast("array<string>"))
    return F.filter(flags, lambda f: ~F.array_contains(done, f) | f.isin(*ALWAYS_OPEN))
