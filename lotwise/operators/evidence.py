"""Claims about a vehicle: collected per row, fused per field, checked against evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents, identity as ident, money, text as tx, urls
from .peers import all_equal_or_null

CLAIM = "array<struct<field:string,value:string,path:string,origin:string>>"
TEXT_ORIGINS = ("version_text", "title", "description")


def _claim(field: str, value: Column, path: str, origin: str) -> Column:
    return F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(path).alias("path"), F.lit(origin).alias("origin"))


def _read(field: str, values: Column, origin: str) -> Column:
    return F.transform(values, lambda v: _claim(field, ident.normalize_field(field, v), origin, "seller_text"))


def _field_claims(df: DataFrame, field: str, original: str | None) -> list[Column]:
    parts, fixed = [], []
    if original:
        at = lambda path: documents.at(original, path)
        for path in ident.SOURCE_PATHS[field]:
            value = ident.normalize_field(field, at(path))
            if path == "primaryFuel.formatted":
                # The component fuel speaks only when the category is silent.
                value = F.when(ident.normalize_field("fuel", at("fuelCategory.formatted")).isNull(), value)
            fixed.append(_claim(field, value, "original.vehicle." + path, "source_structured"))
    if field in df.columns:
        fixed.append(_claim(field, ident.normalize_field(field, field), "payload." + field, "normalized_source"))
    if fixed:
        parts.append(F.array(*fixed))
    if field in ident.TEXT_CLAIMS:
        parts += [_read(field, ident.text_claim_values(field, o), o) for o in TEXT_ORIGINS if o in df.columns]
    if "version_text" in df.columns and field in ("generation", "trim"):
        values = F.array(ident.generation_claim("version_text")) if field == "generation" else ident.trim_claims("version_text")
        if field in df.columns:
            values = F.when(F.col(field).isNull(), values).otherwise(F.array().cast("array<string>"))
        parts.append(_read(field, values, "version_text"))
    return parts


def _same(a: Column, b: Column, tolerant: Column) -> Column:
    x, y = a.try_cast("bigint"), b.try_cast("bigint")
    return F.when(tolerant & x.isNotNull() & y.isNotNull(), F.abs(x - y) <= 2).otherwise(a == b)


def _distinct_values(claims: Column, field: Column) -> Column:
    """Claimed values that differ beyond tolerance, in claim order."""
    tolerant = field.isin("power_hp", "power_kw")

    def merge(acc: Column, claim: Column) -> Column:
        value = claim["value"]
        # A seller's plain "automatic" does not contradict a semi-automatic gearbox.
        vague = (
            (field == "transmission") & (claim["origin"] == "seller_text") & (value == "automatic") & F.array_contains(acc, "semi_automatic")
        )
        return F.when(vague | F.exists(acc, lambda v: _same(v, value, tolerant)), acc).otherwise(F.concat(acc, F.array(value)))

    return F.aggregate(claims, F.array().cast("array<string>"), merge)


def resolve_identity(df: DataFrame, original: str | None = None) -> DataFrame:
    """Add ``identity``: one struct per field with value, status, recovery and claims.

    All claims of a row are one array and every field is judged by the same expression over it,
    inside the row: resolving costs no shuffle. ``identity_conflicts`` lists the fields in
    conflict, power by unit included.
    """
    names = list(ident.FIELDS)
    empty = F.array().cast(CLAIM)
    every = F.concat(*[F.coalesce(p.cast(CLAIM), empty) for f in names for p in _field_claims(df, f, original)])
    known = {f: ident.normalize_field(f, f) for f in names if f in df.columns}
    pairs = [x for f, v in known.items() for x in (F.lit(f), v)]
    d = tx.staged(df, {
        "_claims": F.array_distinct(F.filter(every, lambda c: c["value"].isNotNull())),
        "_known": (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>"),
    })
    per_field = F.transform(
        F.array(*[F.lit(f) for f in names]), lambda f: F.struct(f.alias("field"), F.filter("_claims", lambda c: c["field"] == f).alias("claims"))
    )
    d = tx.staged(d, {"_fields": per_field})
    d = tx.staged(d, {"_fields": F.transform("_fields", lambda s: F.struct(
        s["field"].alias("field"), s["claims"].alias("claims"), F.try_element_at(s["claims"], F.lit(1))["value"].alias("value"),
        (F.size(_distinct_values(s["claims"], s["field"])) > 1).alias("differs"), F.try_element_at(F.col("_known"), s["field"]).alias("existing"),
        F.exists(s["claims"], lambda c: c["origin"] == "source_structured").alias("structured"),
        F.size(F.array_distinct(F.transform(F.filter(s["claims"], lambda c: c["origin"] != "normalized_source"), lambda c: c["origin"]))).alias("origins"),
    ))})
    value_of = lambda f: F.element_at("_fields", names.index(f) + 1)["value"].try_cast("double")
    d = d.withColumn("_power", money.hp_kw_conflict(value_of("power_hp"), value_of("power_kw")))

    def judged(s: Column) -> Column:
        conflict = s["differs"] | (F.col("_power") & s["field"].isin("power_hp", "power_kw"))
        said = F.size(s["claims"]) > 0
        status = F.when(conflict, "conflict").when(~said, "missing").when(s["origins"] >= 2, "consistent").otherwise("declared")
        recovery = (
            F.when(s["structured"] & s["existing"].isNull(), "normalization_gap")
            .when(s["structured"] & (s["existing"] != s["value"]), "normalized_value_mismatch")
            .when(s["existing"].isNotNull(), "present").when(said, "seller_text_only").otherwise("absent_from_source")
        )
        return F.struct(
            s["field"].alias("field"), s["value"].alias("value"), status.alias("status"), recovery.alias("recovery_status"),
            F.size(s["claims"]).alias("claim_count"), s["claims"].alias("claims"),
        )

    conflicts = F.transform(F.filter("_fields", lambda s: s["differs"]), lambda s: s["field"])
    power = F.when(F.col("_power"), F.array(F.lit("power_hp/power_kw"))).otherwise(F.array().cast("array<string>"))
    d = tx.staged(d, {"identity": F.transform("_fields", judged), "identity_conflicts": F.concat(conflicts, power)})
    return d.drop("_claims", "_known", "_fields", "_power")


def identity_fields(resolved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per listing and field."""
    return resolved.select(*keys, F.explode("identity").alias("_f")).select(*keys, "_f.*")


def compatible_identity(fields: Sequence[str] = ident.FIELDS) -> Column:
    """Pair predicate: neither side in conflict and no known field differs."""
    clean = (F.size("identity_conflicts") == 0) & (F.size("p_identity_conflicts") == 0)
    return clean & all_equal_or_null(fields)


# Documents that may verify a field.
PROOF_ORIGINS = ("vehicle_document", "vin_report", "manufacturer_document")


def verified_overlay(fields: DataFrame, proofs: DataFrame, keys: Sequence[str], as_of: Column) -> DataFrame:
    """Upgrade matching, non-conflicting fields that a reviewed document states.

    ``proofs`` holds keys, field, value, origin, verified, verified_by, evidence_url, verified_at.
    """
    usable = proofs.filter(
        F.col("verified") & (F.trim("verified_by") != "") & urls.public_https("evidence_url")
        & (F.col("verified_at") <= as_of) & F.col("origin").isin(*PROOF_ORIGINS)
    )
    stated = usable.groupBy(*keys, "field").agg(F.max(F.col("value")).alias("_hi"), F.min(F.col("value")).alias("_lo"))
    joined = fields.join(stated, [*keys, "field"], "left")
    hit = (F.col("status") != "conflict") & ((F.col("value") == F.col("_hi")) | (F.col("value") == F.col("_lo")))
    return joined.withColumn("status", F.when(F.coalesce(hit, F.lit(False)), "verified").otherwise(F.col("status"))).drop("_hi", "_lo")


# Claim origins and fields that a picture alone cannot settle.
CLAIM_ORIGINS = ("photo", "document", "listing", "web")
NOT_VISUAL = ("engine_code", "trim", "transmission", "fuel", "year")


def judge_claims(claims: DataFrame, visited: DataFrame, specs: DataFrame, key: str = "listing_key") -> DataFrame:
    """Add ``reason`` to every external claim: NULL when accepted.

    ``visited``: key, urls, n_images, web_search_performed. ``specs``: key, field, spec_value.
    """
    d = claims.join(visited.withColumnRenamed("urls", "visited_urls"), key, "left").join(specs, [key, "field"], "left")
    no_index = (F.size("photo_indexes") <= 0) | F.exists("photo_indexes", lambda i: (i < 0) | (i >= F.col("n_images")))
    number = F.col("value").rlike(r"^\d+$") & (F.col("value").try_cast("bigint") <= 1_000_000)
    unseen = (F.size("urls") <= 0) | (F.size(F.array_except("urls", F.coalesce("visited_urls", F.array().cast("array<string>")))) > 0)
    reason = tx.first_failure(
        ("invalid claim", ~tx.present("value") | ~F.col("origin").isin(*CLAIM_ORIGINS)),
        ("mileage requires numeric vehicle evidence", (F.col("field") == "mileage_km") & (~F.coalesce(number, F.lit(False)) | (F.col("origin") == "web"))),
        ("image index unavailable", F.col("origin").isin("photo", "document") & F.coalesce(no_index, F.lit(True))),
        ("web evidence was not retrieved", (F.col("origin") == "web") & (~F.coalesce("web_search_performed", F.lit(False)) | F.coalesce(unseen, F.lit(True)))),
        ("appearance cannot identify this field", (F.col("origin") == "photo") & F.col("field").isin(*NOT_VISUAL)),
        ("claim absent from the listing", (F.col("origin") == "listing") & ~F.coalesce(tx.squash("spec_value") == tx.squash("value"), F.lit(False))),
    )
    return d.withColumn("reason", reason).drop("visited_urls", "n_images", "web_search_performed", "spec_value")


def propose_specs(judged: DataFrame, specs: DataFrame, key: str = "listing_key") -> DataFrame:
    """One value per listing and field from accepted vehicle evidence, or a conflict."""
    accepted = judged.filter(F.col("reason").isNull() & (F.col("origin") != "web")).select(key, "field", tx.squash("value").alias("value"))
    stated = specs.filter(tx.present("spec_value")).select(key, "field", tx.squash("spec_value").alias("value"))
    d = accepted.unionByName(stated).groupBy(key, "field").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count(F.lit(1)).alias("support")
    )
    conflict = F.col("_lo") != F.col("_hi")
    return d.select(key, "field", "support", conflict.alias("conflict"), F.when(~conflict, F.col("_lo")).alias("proposed"))


def reconcile_aliases(names: dict[str, Sequence[str]]) -> dict[str, Column]:
    """Several source columns for one field: their common value, or a conflict marker."""
    out = {}
    for field, columns in names.items():
        given = F.filter(F.array(*[F.trim(F.col(c).cast("string")) for c in columns]), lambda v: v.isNotNull() & (v != ""))
        differ = F.size(F.array_distinct(F.transform(given, lambda v: F.lower(v)))) > 1
        out[field] = F.when(~differ, F.try_element_at(given, F.lit(1)))
        out[field + "_conflict"] = differ
    return out


def damage_scope(observations: DataFrame, work: DataFrame, listings: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Checked damage observations, and inspected work split into necessary and cosmetic.

    ``listings`` carries keys, n_images and required_repairs.
    """
    o = observations.join(listings.select(*keys, "n_images"), list(keys))
    outside = F.exists("photo_indexes", lambda i: (i < 0) | (i >= F.col("n_images")))
    reason = tx.first_failure(
        ("needs a valid origin, finding and photo references", ~F.col("origin").isin("photo", "listing", "inspection") | ~tx.present("finding") | F.coalesce(outside, F.lit(False))),
        ("visible damage requires a photo", (F.col("origin") == "photo") & (F.size("photo_indexes") <= 0)),
    )
    w = work.join(listings.select(*keys, "required_repairs"), list(keys))
    refused = (
        ~F.array_contains("required_repairs", F.col("repair_id")) | ~F.col("category").isin("necessary", "cosmetic") | ~tx.present("explanation")
    )
    return o.withColumn("reason", reason).drop("n_images"), w.withColumn("accepted", ~F.coalesce(refused, F.lit(True))).drop("required_repairs")
