"""Row types and the fixed policy values the operators depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns that must agree before two listings are comparable.
COHORT = ("make", "model", "generation", "trim", "fuel", "transmission", "seller_type")
BENCHMARK_MATCH = COHORT[:6] + ("province", "seller_type")
VARIANT_MATCH = COHORT[:6]
SPEC_FIELDS = COHORT[:6] + ("year",)

# Peer bands and minimum peer counts per screening profile.
PROFILES = {
    "strict": dict(min_peers=8, years=1, km=20_000, headroom=2000, discount_pct=25, stress_pct=15),
    "exploratory": dict(min_peers=3, years=2, km=40_000, headroom=500, discount_pct=10, stress_pct=0),
    "opportunities": dict(min_peers=3, years=2, km=40_000, headroom=500, discount_pct=10, stress_pct=0),
    "discovery": dict(min_peers=2, years=3, km=60_000, headroom=2000, discount_pct=0, stress_pct=0),
}

# Share of each damage category in a mixed shortlist, in percent.
DAMAGE_MIX = {"clean": 30, "minimal": 20, "non_severe": 50}

# Accepted enumerations.
SELLER_TYPES = ("private", "dealer")
CONDITIONS = ("undamaged", "damaged", "unknown")
PRICE_KINDS = ("total", "installment", "deposit", "unknown")
SEVERITIES = ("unknown", "none", "minor", "moderate", "severe")
INDICATORS = ("structural", "airbags", "flood", "fire", "high_voltage_battery")
PLACEHOLDERS = ("unknown", "n/a", "na", "sconosciuto", "-")
ABSENT_MARKS = ("", "unknown", "unclassified", "n/a", "-", "sconosciuto")

# Stress policy for conservative economics (basis points, cents, days).
STRESS = {
    "ordinary": dict(
        sale_bps=1000, repair_bps=2500, reserve_min=75_000, reserve_bps=1500, shock_sale_bps=500,
        shock_repair_bps=1500, return_bps=2500, holding_days=45, comparables=12,
    ),
    "severe": dict(
        sale_bps=1500, repair_bps=4000, reserve_min=200_000, reserve_bps=3000, shock_sale_bps=500,
        shock_repair_bps=2000, return_bps=3000, holding_days=90, comparables=20,
    ),
}
MAX_PURCHASE_CENTS = 2_000_000
REPAIRED_COMPARABLES = 8
COMPARABLE_MAX_AGE_DAYS = 14

# Cost vocabularies.
OPERATING_COSTS = ("transfer", "transport", "preparation", "warranty", "taxes", "fees", "contingency")
BODYWORK_LINES = (
    "strip_and_measure", "structural_work", "paint", "materials", "restraints", "diagnostics",
    "adas_calibration", "alignment", "subcontract_transport",
)
COLLISION_CHECKS = (
    "structural_measurement", "oem_repairability", "restraints_scope", "hidden_damage_inspection",
    "diagnostic_and_adas_plan", "repair_history_resale", "bodyshop_capacity_and_schedule",
)
HOLDING_COSTS = ("funding", "storage", "insurance")

_TEXT = (
    "source source_id url make model generation trim fuel transmission province seller_type condition "
    "vehicle_id title description country city price_kind damage_severity version_text engine_code "
    "engine_name drivetrain body_type"
).split()

LISTING_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in _TEXT]
    + [T.StructField(name, T.LongType()) for name in ("year", "mileage_km", "price_eur", "power_hp", "displacement_cc")]
    + [T.StructField(name, T.DoubleType()) for name in ("latitude", "longitude", "power_kw")]
    + [T.StructField("observed_at", T.TimestampType()), T.StructField("active", T.BooleanType())]
    + [T.StructField(name, T.ArrayType(T.StringType())) for name in ("image_urls", "damage_indicators")]
)

PAGE_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source", "run_id", "page_id", "mode", "scope", "input_cursor", "next_cursor")]
    + [
        T.StructField("complete", T.BooleanType()),
        T.StructField(
            "records",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("source_id", T.StringType()),
                        T.StructField("observed_at", T.StringType()),
                        T.StructField("url", T.StringType()),
                        T.StructField("active", T.BooleanType()),
                        T.StructField("payload", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
