"""Vehicle identity fields: aliases, claims found in text, families and variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

FIELDS = (
    "engine_code", "engine_name", "displacement_cc", "power_kw", "power_hp", "fuel", "transmission",
    "drivetrain", "body_type", "generation", "trim",
)

# Where a listing's original record states each field.
SOURCE_PATHS = {
    "engine_code": ("engineCode", "rawData.engine.engineCode.formatted"),
    "engine_name": ("motorTypeName", "rawData.engine.motorType.formatted"),
    "displacement_cc": ("rawCylinderCapacity", "rawDisplacementInCCM", "engineDisplacementInCCM"),
    "power_hp": ("rawPowerInHp",),
    "power_kw": ("rawPowerInKw",),
    "fuel": ("fuelCategory.formatted", "fuel", "primaryFuel.formatted"),
    "transmission": ("transmissionType", "transmission"),
    "drivetrain": ("driveTrain",),
    "body_type": ("bodyType",),
    "generation": ("rawData.classification.modelGeneration.formatted",),
    "trim": ("rawData.classification.trimLine.formatted",),
}
DAMAGE_PATHS = ("hadAccident", "damageConditions", "rawData.condition.damage", "isCurrentlyDamaged")

# Source spellings and the term each stands for.
ALIASES = {
    "transmission": {
        "manuale": "manual", "cambio manuale": "manual", "automatico": "automatic",
        "cambio automatico": "automatic", "semiautomatico": "semi_automatic",
        "cambio semiautomatico": "semi_automatic",
    },
    "fuel": {
        "benzina": "petrol", "gasoline": "petrol", "gasolio": "diesel", "metano": "cng", "gpl": "lpg",
        "elettrica": "electric", "elettrico": "electric", "benzina/metano": "petrol_cng",
        "benzina/gas": "petrol_lpg", "gas naturale h": "cng", "gas naturale l": "cng", "biogas": "cng",
        "gas di petrolio liquefatto": "lpg",
    },
    "drivetrain": {
        "anteriore": "fwd", "trazione anteriore": "fwd", "posteriore": "rwd", "trazione posteriore": "rwd",
        "integrale": "awd", "4x4": "awd", "4wd": "awd",
    },
    "body_type": {
        "berlina": "sedan", "station wagon": "wagon", "city car": "city_car",
        "suv/fuoristrada/pick-up": "suv_offroad_pickup", "cabrio": "convertible",
    },
}
NUMERIC_LIMITS = {"displacement_cc": 20_000, "power_hp": 3_000, "power_kw": 3_000}


def _alias(field: str, value: Column) -> Column:
    pairs = ALIASES.get(field)
    if not pairs:
        return value
    if field == "fuel":
        # A petrol or diesel grade is that fuel.
        value = F.regexp_replace(value, r"^(?:(benzina) e?\d+|(diesel) b?\d+).*$", "$1$2")
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), value)


def normalize_field(field: str, value: Column | str) -> Column:
    """Canonical text or bounded number of one identity field, always as a string."""
    c = tx.col(value)
    if field not in NUMERIC_LIMITS:
        return _alias(field, tx.known(c.cast("string")))
    raw = F.trim(c.cast("string"))
    if field == "displacement_cc":
        unit = F.regexp_extract(raw, r"(?i)^(\d{1,2}[ .]\d{3}|\d{3,5})\s*(?:cm³|cm3|cc)$", 1)
        raw = F.when(unit != "", F.regexp_replace(unit, "[ .]", "")).otherwise(raw)
    number = raw.try_cast("decimal(20,6)")
    bounded = F.when((number > 0) & (number <= NUMERIC_LIMITS[field]), number)
    whole = F.when(bounded == F.floor(bounded), F.floor(bounded).cast("bigint").cast("string"))
    if field == "power_kw":
        return F.coalesce(whole, bounded.cast("double").cast("string"))
    return whole


def normalized_number(field: str, value: Column | str) -> Column:
    return normalize_field(field, value).cast("double" if field == "power_kw" else "bigint")


def gearbox(value: Column | str) -> Column:
    """Transmission with semi-automatic read as automatic."""
    v = normalize_field("transmission", value)
    return F.when(v == "semi_automatic", "automatic").otherwise(v)


# Claims read from free text, one capture each, with what voids a match.
TEXT_CLAIMS = {
    "power_hp": r"\b(\d{2,4})\s*(?:cv|hp|ps)\b",
    "power_kw": r"\b(\d{2,4})\s*kw\b",
    "displacement_cc": r"\b(\d{3,5})\s*(?:cc|cm3|cm³)(?!\w)",
    "engine_code": r"\bcodice\s+motore\s*[:=]?\s*([a-z0-9-]{3,15})\b",
    "transmission": r"\bcambio\s+(automatico|manuale|semiautomatico)\b",
}
_VOID_BEFORE = {
    "power_hp": r"(?<!fiscal.{0,20})",
    "power_kw": r"(?<!(?:ricarica|colonnina|charger|charging).{0,30})",
}
_VOID_AFTER = {"power_hp": r"(?!\s*fiscal)"}
TRIM_LABELS = ("sport line", "m sport", "climbing", "expression", "ambition", "lounge", "easy", "pop", "active")
ROMAN = r"\b(VIII|VII|VI|IV|III|II|IX|V|I)(?=\s|20\d{2}|$)"


def text_claim_values(field: str, text: Column | str) -> Column:
    """All values one field is given in a text, fiscal horsepower and charger power excluded."""
    before, after = _VOID_BEFORE.get(field, ""), _VOID_AFTER.get(field, "")
    body = TEXT_CLAIMS[field]
    if not (before or after):
        return F.regexp_extract_all(tx.col(text), F.lit("(?iuU)" + body), F.lit(1))
    # A voided mention is consumed without a capture, as a scan over all mentions would do.
    voided = body.replace("(", "(?:", 1)
    kept = F.regexp_extract_all(
        tx.col(text), F.lit(f"(?iuU)(?={voided})(?:{before}{body}{after}|{voided})"), F.lit(1)
    )
    return F.filter(kept, lambda v: v != "")


def generation_claim(version: Column | str) -> Column:
    return F.nullif(F.regexp_extract(tx.col(version), ROMAN, 1), F.lit(""))


def trim_claims(version: Column | str) -> Column:
    v = tx.col(version)
    return F.filter(
        F.array(*[F.when(tx.says(v, r"\b" + label + r"\b"), F.lit(label)) for label in TRIM_LABELS]),
        lambda x: x.isNotNull(),
    )


# How a kilometre figure is written, and service notes that are not the odometer.
_NUMBER = r"(?:\d{1,3}(?:[ .]\d{3})+|\d{4,7})"
KM_FORMS = (
    (rf"(?<!\d)({_NUMBER})\s*(?:km|chilometri|kilometri)\b", 1),
    (rf"\b(?:km|chilometri|kilometri)\s*[:=]?\s*({_NUMBER})(?!\d|[.,]\d)", 1),
    (r"(?<!\d)(\d{1,3})\s*(?:mila|k)\s*(?:km|chilometri)\b", 1000),
)
_SERVICE = (70, r"(?:distribuzion\w*|cinghia|tagliando|sostituit\w*|cambiat\w*|motore rifatto|batteria).{0,45}$")


def _kilometres(factor: int):
    return lambda v: F.regexp_replace(v, "[ .]", "").cast("bigint") * factor


def mileage_claims(text: Column | str) -> Column:
    """Distinct kilometre values claimed by a text, as an ascending array of bigint."""
    found = []
    for pattern, factor in KM_FORMS:
        found.append(F.transform(tx.unpreceded(tx.col(text), pattern, _SERVICE, 1), _kilometres(factor)))
    every = F.concat(*found)
    return F.array_sort(F.array_distinct(F.filter(every, lambda v: (v >= 0) & (v <= 1_000_000))))


# Seller words for each fuel.
FUEL_WORDS = {
    "diesel": r"\b(?:diesel|gasolio)\b",
    "petrol": r"\b(?:benzina|petrol|gasoline)\b",
    "lpg": r"\bgpl\b",
    "cng": r"\bmetano\b",
    "electric": r"\b(?:elettrica|elettrico|electric)\b",
}


def fuel_claims(text: Column | str, structured: Column | None = None) -> Column:
    """Sorted distinct fuels a text states; petrol plus one gas is a bi-fuel claim."""
    body = tx.col(text)
    said = F.array_sort(
        tx.labels(**{f: F.size(tx.declared(body, p, tx.TRAILING_NEGATION)) > 0 for f, p in FUEL_WORDS.items()})
    )
    merged = (
        F.when(said == F.array(F.lit("lpg"), F.lit("petrol")), F.array(F.lit("petrol_lpg")))
        .when(said == F.array(F.lit("cng"), F.lit("petrol")), F.array(F.lit("petrol_cng")))
        .otherwise(said)
    )
    if structured is None:
        return merged
    extra = F.array_compact(F.array(normalize_field("fuel", structured)))
    return F.array_sort(F.array_distinct(F.concat(merged, extra)))


# Model families per make, in the order they are tried.
FAMILIES = {
    "Fiat": ("500X", "500L", "500", "Panda", "Punto", "Tipo", "Bravo"),
    "Volkswagen": ("Golf", "Polo", "Passat", "Tiguan", "T-Roc", "Up"),
    "Audi": ("A1", "A3", "A4", "A5", "A6", "Q2", "Q3", "Q5"),
    "BMW": ("Serie 1", "Serie 2", "Serie 3", "Serie 5", "X1", "X3"),
    "Mercedes-Benz": ("Classe A", "Classe B", "Classe C", "GLA"),
    "Renault": ("Clio", "Captur", "Megane", "Scenic"),
    "Peugeot": ("208", "308", "2008", "3008"),
    "Toyota": ("Yaris", "Aygo", "Auris", "Corolla", "RAV4"),
    "Ford": ("Fiesta", "Focus", "Kuga"),
    "Opel": ("Corsa", "Astra", "Mokka"),
    "Citroen": ("C3", "C4"),
    "Dacia": ("Sandero", "Duster"),
    "Hyundai": ("i10", "i20", "i30", "Tucson"),
    "Kia": ("Picanto", "Rio", "Sportage"),
    "Nissan": ("Micra", "Juke", "Qashqai"),
    "Honda": ("Jazz", "Civic", "CR-V"),
    "Seat": ("Ibiza", "Leon"),
    "Skoda": ("Fabia", "Octavia"),
    "Alfa Romeo": ("Giulietta", "MiTo"),
    "Mini": ("Cooper", "Countryman"),
    "Smart": ("Fortwo", "Forfour"),
}
_MAKE_SPELLING = {"Mercedes-Benz": r"Mercedes(?:[- ]Benz)?", "Citroen": r"Citro[eë]n"}


def title_identity(title: Column | str) -> Column:
    """``struct<make, model, year>`` read from 'YEAR MAKE MODEL ...', NULL when unrecognised."""
    clean = F.trim(F.regexp_replace(F.replace(tx.col(title), F.lit("+"), F.lit(" ")), r"(?U)\s+", " "))
    year = F.regexp_extract(clean, r"^((?:19|20)\d{2})\s+.+$", 1)
    rest = F.regexp_replace(clean, r"^(?:19|20)\d{2}\s+", "")
    model, make_out = F.lit(None).cast("string"), F.lit(None).cast("string")
    for make, models in reversed(list(FAMILIES.items())):
        spelling = "(?i)^" + _MAKE_SPELLING.get(make, make.replace("-", r"\-")) + r"\s+"
        # Titles may repeat the make; one repetition is removed.
        body = F.regexp_replace(F.regexp_replace(rest, spelling, ""), spelling, "")
        found = F.lit(None).cast("string")
        for name in reversed(models):
            found = F.when(F.rlike(body, F.lit("(?iU)^" + name.replace("-", r"\-") + r"\b")), F.lit(name)).otherwise(found)
        if make == "BMW":
            digit = F.coalesce(
                F.nullif(F.regexp_extract(body, r"(?iU)^SERIE\s+([1-8])\b", 1), F.lit("")),
                F.nullif(F.regexp_extract(body, r"(?iU)^([1-8])\d{2}[a-z]*\b", 1), F.lit("")),
            )
            found = F.coalesce(F.concat(F.lit("Serie "), digit), found)
        if make == "Fiat":
            suffix = F.nullif(F.regexp_extract(body, r"(?iU)^500\s+([LX])\b", 1), F.lit(""))
            found = F.coalesce(F.concat(F.lit("500"), F.upper(suffix)), found)
        if make == "Mercedes-Benz":
            letter = F.nullif(F.regexp_extract(body, r"(?iU)^(?:Classe\s+)?([ABCES])(?:\s+\d{3}|\b)", 1), F.lit(""))
            found = F.coalesce(F.concat(F.lit("Classe "), F.upper(letter)), found)
        hit = F.rlike(rest, F.lit(spelling)) & found.isNotNull()
        model = F.when(hit, found).otherwise(model)
        make_out = F.when(hit, F.lit(make)).otherwise(make_out)
    return F.when(
        (year != "") & model.isNotNull(),
        F.struct(make_out.alias("make"), model.alias("model"), year.cast("bigint").alias("year")),
    )


# Base models whose longer names belong to one family.
BASE_MODELS = ("golf", "polo", "clio", "fiesta", "focus", "208", "308")


def family_model(make: Column | str, model: Column | str) -> Column:
    """Model family used to match adverts across sources."""
    mk, md = F.coalesce(tx.squash(make), F.lit("")), F.coalesce(tx.squash(model), F.lit(""))
    series = F.regexp_extract(md, r"^([1-8])\d{2}[a-z]*$", 1)
    klass = F.regexp_extract(md, r"^([abces ])\s*\d{3}(?:\s.*)?$", 1)
    named = (
        F.when((mk == "bmw") & (series != ""), F.concat(F.lit("serie "), series))
        .when((mk == "mercedes-benz") & (klass != ""), F.concat(F.lit("classe "), klass))
        .otherwise(md)
    )
    base = F.regexp_extract(named, "^(" + "|".join(BASE_MODELS) + ") ", 1)
    return F.when(base != "", base).otherwise(named)


# Sport, drive and body words in a headline.
SPORT_TAGS = r"\b(gti|gtd|abarth|amg|jcw|rs|type r|cooper s|gr|st)\b"
AWD_WORDS = r"\b(?:4x4|4wd|quattro|xdrive|4matic|allgrip|awd)\b"
WAGON_WORDS = r"\b(?:sw|touring|avant|wagon|variant)\b"
OPEN_WORDS = r"\b(?:cabrio|convertible)\b"


def variant(title: Column, model: Column, version: Column, drivetrain: Column, body_type: Column) -> Column:
    """``struct<sport, drive, body, litres>`` read from a headline and the stated fields."""
    body = F.coalesce(tx.squash(tx.full_text(title, model, version)), F.lit(""))
    litres = F.regexp_extract(body, r"(?<![\d.])([1-6][.,]\d)(?!\d)", 1)
    return F.struct(
        F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit("(?U)" + SPORT_TAGS), F.lit(1)))), "|").alias("sport"),
        tx.squash(F.when(tx.says(body, AWD_WORDS), F.lit("awd")).otherwise(drivetrain)).alias("drive"),
        tx.squash(
            F.when(tx.says(body, WAGON_WORDS), F.lit("wagon")).when(tx.says(body, OPEN_WORDS), F.lit("convertible")).otherwise(body_type)
        ).alias("body"),
        F.when(litres != "", F.replace(litres, F.lit(","), F.lit(".")).cast("double")).alias("litres"),
    )


def version_signature(version: Column, model: Column, year: Column) -> Column:
    """``struct<label, roman>``: a headline without repeated model, generation or trailing year."""
    v, m = tx.squash(version), tx.squash(model)
    v = F.when(m.isNotNull(), F.regexp_replace(v, F.concat(F.lit(r"^(?:\Q"), m, F.lit(r"\E\s+)+")), F.lit(""))).otherwise(v)
    roman = F.nullif(F.regexp_extract(v, r"(?U)^(viii|vii|vi|iv|iii|ii|i|v)\b", 1), F.lit(""))
    v = F.regexp_replace(v, r"(?U)^(?:viii|vii|vi|iv|iii|ii|i|v)\b(?:\s+(?:19|20)\d{2})?\s*", "")
    v = F.when(year.isNotNull(), F.regexp_replace(v, F.concat(F.lit(r"\s+"), year.cast("string"), F.lit("$")), F.lit(""))).otherwise(v)
    return F.struct(F.nullif(F.trim(v), F.lit("")).alias("label"), roman.alias("roman"))
