"""Row mappers: configured field maps, native page records and provider rows.

Each mapper is a plain ``DataFrame -> DataFrame`` function, so a user's own mapper plugs in with
``df.transform(mapper)``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as doc, identity as ident, text as tx, urls

WHOLE = ("price_eur", "year", "mileage_km", "power_hp", "displacement_cc")
MAPPABLE = (
    "source_id", "url", "make", "model", "generation", "trim", "fuel", "transmission", "province", "seller_type", "condition",
    "title", "description", "city", "price_kind", "version_text", "active",
) + WHOLE


def _whole(original: Column | str, path: str, top: int) -> Column:
    """A whole number stated as JSON number, decimal or text; anything else is missing."""
    kind = doc.kind_of(original, path)
    text = F.when(kind != "BOOLEAN", doc.at(original, path))
    number = text.try_cast("decimal(20,6)")
    return F.when((number == F.floor(number)) & (number >= 0) & (number <= top), F.floor(number).cast("bigint"))


def map_fields(items: DataFrame, mapping: Mapping[str, object], item: str = "item") -> DataFrame:
    """Project JSON items by configuration.

    Each field maps to a dotted path or to ``{path, values, require}``: a value table and a guard
    that must hold, or the field stays missing. Items are a VARIANT column.
    """
    unknown = set(mapping) - set(MAPPABLE)
    if unknown:
        raise ValueError(f"unsupported fields: {sorted(unknown)}")
    out = {}
    for field, spec in mapping.items():
        spec = {"path": spec} if isinstance(spec, str) else dict(spec)
        if set(spec) - {"path", "values", "require"}:
            raise ValueError("a mapping supports path, values and require")
        value = doc.at(item, spec["path"])
        if "values" in spec:
            pairs = [F.lit(str(x)) for kv in spec["values"].items() for x in kv]
            value = F.try_element_at(F.create_map(*pairs), value)
        if field in WHOLE:
            value = value.try_cast("decimal(20,6)")
            value = F.when((value == F.floor(value)) & (value > (0 if field == "price_eur" else -1)) & (value <= 10_000_000), F.floor(value).cast("bigint"))
        if field == "active":
            value = F.coalesce(value.try_cast("boolean"), F.lit(True))
        if "require" in spec:
            guard = spec["require"]
            value = F.when(doc.at(item, guard["path"]).eqNullSafe(F.lit(str(guard["value"]))), value)
        out[field] = value
    return items.select(*[c for c in items.columns if c != item], *[v.alias(k) for k, v in out.items()])


# Finance and part-payment wording that makes a native price unclear.
FINANCE = (
    r"(?:prezzo.{0,60}\b(?:con|tramite|(?<!non )vincolato|(?<!non )condizionato)\b.{0,25}finanziamento|"
    r"finanziamento\s+obbligatorio|solo\s+(?:con|tramite)\s+finanziamento)"
)
PART_PAYMENT = (
    r"(?:\b(?:rata|rate|anticipo|acconto)\s*(?:di|da|:|€)\s*[\d€]|\b\d[\d.,]*\s*€\s*(?:/|al|a)\s*mese|"
    r"\bprezzo.{0,40}\b(?:anticipo|acconto|rata)\b)"
)
SELLERS = {"Dealer": "dealer", "Private": "private", "PrivateSeller": "private"}
TRACKED = (
    "title", "description", "image_urls", "make", "model", "version_text", "generation", "trim", "fuel", "transmission",
    "year", "mileage_km", "price_eur", "province", "seller_type",
)


def native_listing(items: DataFrame, as_of: Column, item: str = "item", detailed: bool = True, strip_html=None) -> DataFrame:
    """Typed listing of a native page record with the source path of every field and its gaps."""
    at = lambda path: doc.at(item, path)
    whole = lambda path, top: _whole(item, path, top)
    flag = lambda path: F.when(doc.kind_of(item, path) == "BOOLEAN", doc.at(item, path, "boolean"))
    clean = strip_html or (lambda c: c)
    registered = at("vehicle.firstRegistrationDateRaw") if detailed else at("tracking.firstRegistration")
    year = F.regexp_extract(registered, r"^(\d{4})-\d{2}-\d{2}$" if detailed else r"^\d{2}-(\d{4})$", 1).try_cast("bigint")
    description = clean(at("description"))
    context = F.concat_ws("\n", description, at("vehicle.subtitle"), at("vehicle.modelVersionInput"))
    amount = whole("prices.public.priceRaw" if detailed else "price.priceRaw", 10_000_000)
    shown = at("prices.public.price" if detailed else "price.priceFormatted")
    price = F.when((amount > 0) & shown.contains("€"), amount)
    final = (
        (flag("prices.isFinalPrice") & ~flag("prices.public.onRequestOnly")) if detailed else F.lit(True)
    )
    firm = ~tx.says(description, FINANCE) & ~tx.says(context, PART_PAYMENT) & F.coalesce(~flag("price.isConditionalPrice"), F.lit(False)) & F.coalesce(final, F.lit(False))
    now, search = flag("vehicle.rawData.condition.damage.isCurrentlyDamaged"), flag("vehicle.isCurrentlyDamaged")
    damaged = F.coalesce(now, F.lit(False)) | F.coalesce(search, F.lit(False))
    undamaged = F.coalesce(~now, F.lit(False)) | F.coalesce(~search, F.lit(False))
    seller = F.try_element_at(F.create_map(*[F.lit(x) for kv in SELLERS.items() for x in kv]), at("seller.type"))
    fields: dict[str, tuple[Column, str]] = {
        "make": (at("vehicle.make"), "vehicle.make"),
        "model": (at("vehicle.model"), "vehicle.model"),
        "version_text": (at("vehicle.modelVersionInput"), "vehicle.modelVersionInput"),
        "power_hp": (whole("vehicle.rawPowerInHp", 3000), "vehicle.rawPowerInHp"),
        "displacement_cc": (whole("vehicle.rawCylinderCapacity", 20_000), "vehicle.rawCylinderCapacity"),
        "generation": (at("vehicle.rawData.classification.modelGeneration.formatted"), "vehicle.rawData.classification.modelGeneration.formatted"),
        "trim": (at("vehicle.rawData.classification.trimLine.formatted"), "vehicle.rawData.classification.trimLine.formatted"),
        "fuel": (at("vehicle.fuelCategory.formatted" if detailed else "vehicle.fuel"), "vehicle.fuelCategory.formatted" if detailed else "vehicle.fuel"),
        "transmission": (at("vehicle.transmissionType" if detailed else "vehicle.transmission"), "vehicle.transmissionType" if detailed else "vehicle.transmission"),
        "mileage_km": (whole("vehicle.mileageInKmRaw" if detailed else "tracking.mileage", 2_000_000), "vehicle.mileageInKmRaw" if detailed else "tracking.mileage"),
        "year": (F.when(year.between(F.lit(1950), F.year(as_of) + 1), year), "vehicle.firstRegistrationDateRaw" if detailed else "tracking.firstRegistration"),
        "price_eur": (price, "prices.public.priceRaw" if detailed else "price.priceRaw"),
        "seller_type": (seller, "seller.type"),
        "city": (at("location.city"), "location.city"),
        "description": (description, "description"),
    }
    named = {k: F.nullif(v.cast("string"), F.lit("")) if k not in WHOLE else v for k, (v, _) in fields.items()}
    d = items.withColumns(named)
    d = d.withColumn("title", F.nullif(F.concat_ws(" ", "make", "model", "version_text"), F.lit("")))
    d = d.withColumn("image_urls", doc.at(item, "images", "array<string>")).withColumn("province", F.lit(None).cast("string"))
    d = d.withColumn("price_kind", F.when(F.col("price_eur").isNotNull() & firm, "total").otherwise("unknown"))
    d = d.withColumn("condition", F.when(damaged, "damaged").when(undamaged, "undamaged").otherwise("unknown"))
    provenance = [F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("field"), F.lit(p).alias("path"))) for k, (_, p) in fields.items()]
    missing = [F.when(F.col(k).isNull() if k != "image_urls" else F.coalesce(F.size(k) <= 0, F.lit(True)), F.lit(k)) for k in TRACKED]
    return d.withColumns({
        "field_provenance": F.map_from_entries(F.array_compact(F.array(*provenance))),
        "missing_fields": F.array_compact(F.array(*missing)),
        "country": at("location.countryCode"), "source_id": at("id"),
        "active": F.lit(True) if not detailed else at("status").eqNullSafe(F.lit("Active")),
    })


# Provider categories, goods that are not cars, accepted enumerations.
CAR_CATEGORIES = ("cars", "cars & trucks", "cars and trucks", "auto", "automobili", "auto e furgoni")
OTHER_GOODS = r"\b(?:ricambi|motore in vendita|vendo motore|smembro|monopattino|scooter|motocicletta)\b"
MAX_PRICE_EXCLUSIVE = 20_000


def provider_listing(rows: DataFrame, as_of: Column) -> DataFrame:
    """Third-party provider rows with ``issue``: NULL for rows fit to import.

    Expects location_issue, location_city and location_province from the registry join. Mileage is
    taken only when the description's kilometres equal the provider's own figure.
    """
    rows = tx.staged(rows, {"_name": ident.title_identity("title"), "_km": ident.mileage_claims("description")})
    name, km = F.col("_name"), F.col("_km")
    car = F.exists("breadcrumbs", lambda b: F.lower(F.trim(b)).isin(*CAR_CATEGORIES))
    inferred = (
        name.isNotNull() & (name["year"] <= F.year(as_of) + 1) & F.col("car_miles").between(0, 2_000_000)
        & F.col("transmission").isin("MANUAL", "AUTOMATIC") & F.col("condition").isin("USED", "NEW") & ~tx.says(F.col("description"), OTHER_GOODS)
    )
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"/+$", ""), "/"), -1)
    amount = F.coalesce("final_price", "initial_price").cast("decimal(20,6)")
    no = F.lit(False)
    issue = tx.first_failure(
        ("country code must be IT", ~F.col("country_code").eqNullSafe(F.lit("IT"))),
        ("location: unresolved", F.col("location_issue").isNotNull()),
        ("car category not verified", ~(F.coalesce(car, no) | F.coalesce(inferred, no))),
        ("listing id and url conflict", ~F.col("product_id").eqNullSafe(last)),
        ("title missing", ~tx.present("title")),
        ("explicit EUR required", ~F.col("currency").eqNullSafe(F.lit("EUR"))),
        ("invalid EUR price", ~F.coalesce((amount > 0) & (amount <= 10_000_000) & (amount == F.floor(amount)), no)),
        ("price not below 20000 EUR", amount >= MAX_PRICE_EXCLUSIVE),
        ("explicit sold status required", F.col("is_sold").isNull()),
        ("sold listing", F.col("is_sold")),
        ("unsupported images", F.coalesce((F.size("images") > 1000) | F.exists("images", lambda u: ~F.rlike(u, F.lit(r"^https://[^/?#\s]+"))), no)),
    )
    agreed = (F.size(km) == 1) & (F.element_at(km, 1).cast("double") == F.col("car_miles"))
    return rows.withColumn("issue", issue).withColumns({
        "source_id": F.col("product_id"), "make": name["make"], "model": name["model"], "model_year_from_title": name["year"],
        "price_eur": F.floor(amount).cast("bigint"), "price_kind": F.lit("unknown"), "active": ~F.col("is_sold"),
        "mileage_km": F.when(F.coalesce(agreed, no), F.col("car_miles").cast("bigint")),
        "vehicle_type_basis": F.when(F.coalesce(car, no), "provider_car_category").otherwise("inferred_from_title_and_vehicle_fields"),
    }).drop("_name", "_km")


def recover_seller_evidence(rows: DataFrame) -> DataFrame:
    """Fill make, model, year, mileage and fuel from a seller's own words, or name the conflict.

    Needs title, description, make, model, year, mileage_km and fuel. Disagreeing kilometres or
    fuels leave the field unknown.
    """
    name = ident.title_identity("title")
    d = tx.staged(rows, {
        "_t": name, "_km": ident.mileage_claims("description"), "_fuel": ident.fuel_claims(tx.full_text("title", "description"), F.col("fuel")),
    })
    corrected = (F.col("model") == "500") & F.col("_t.model").isin("500L", "500X")
    clash = lambda f, ok: F.col("_t").isNotNull() & F.col(f).isNotNull() & (F.col(f) != F.col(f"_t.{f}")) & ~ok
    km_all = F.array_distinct(F.concat("_km", F.when(F.col("mileage_km").isNotNull(), F.array("mileage_km")).otherwise(F.array().cast("array<bigint>"))))
    d = d.withColumn("_km", km_all).withColumn("seller_conflicts", tx.labels(
        make=clash("make", F.lit(False)), model=clash("model", F.coalesce(corrected, F.lit(False))),
        mileage_km=F.size(km_all) > 1, fuel=F.size("_fuel") > 1,
    ))
    return d.withColumns({
        "model": F.when(F.col("model").isNull() | F.coalesce(corrected, F.lit(False)), F.coalesce("_t.model", "model")).otherwise(F.col("model")),
        "make": F.coalesce("make", "_t.make"), "year": F.coalesce("year", "_t.year"),
        "mileage_km": F.when(F.size("_km") == 1, F.element_at("_km", 1)),
        "fuel": F.when(F.size("_fuel") == 1, F.element_at("_fuel", 1)),
    }).drop("_t", "_km", "_fuel")
