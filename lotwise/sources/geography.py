"""Published city text matched against a municipality registry table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Other names of regions, and of one province.
REGION_ALIASES = {"lombardy": "lombardia", "piedmont": "piemonte"}
PROVINCE_ALIASES = {"monza e brianza": "mb"}
CITY_ALIASES = {"milan": "milano"}


def _alias(column, table: dict[str, str]):
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), column)


def published_location(rows: DataFrame, registry: DataFrame, city: str = "city") -> DataFrame:
    """Add location_city, location_province and location_issue.

    ``registry``: city, province, province_name, region, ambiguous. Text like 'City (PR), Region'
    gives hints; conflicting hints, an ambiguous bare name or an unknown city are issues. Hints
    are resolved inside the registry rows of the city, so the rows are never multiplied.
    """
    parts = F.transform(F.split(F.col(city), ","), lambda p: F.coalesce(tx.fold(p), F.lit("")))
    head = F.get(parts, F.lit(0))
    code = F.regexp_extract(head, r"^(.+?)\s*\(([a-z]{2})\)$", 2)
    name = _alias(F.when(code != "", F.regexp_extract(head, r"^(.+?)\s*\(([a-z]{2})\)$", 1)).otherwise(head), CITY_ALIASES)
    labels = F.concat(F.slice(parts, F.lit(2), F.size(parts)), F.when(code != "", F.array(code)).otherwise(F.array().cast("array<string>")))
    d = rows.withColumn("_city", name).withColumn("_labels", F.transform(labels, lambda x: _alias(_alias(x, PROVINCE_ALIASES), REGION_ALIASES)))

    r = registry.select(
        tx.fold("city").alias("_city"), F.col("city").alias("_name"), F.lower("province").alias("_code"), F.col("province").alias("_prov"),
        tx.fold("province_name").alias("_pname"), tx.fold("region").alias("_region"), "ambiguous",
    )
    by_city = r.groupBy("_city").agg(
        F.collect_list(F.struct("_name", "_code", "_prov", "_pname", "_region")).alias("_options"), F.max("ambiguous").alias("_ambiguous")
    )
    # The codes and names of all provinces and regions: one row, a few hundred short texts.
    vocabulary = r.agg(
        F.collect_set(F.struct("_code", "_pname")).alias("_provinces"), F.collect_set("_region").alias("_regions")
    ).withColumn("_one", F.lit(1))
    d = d.withColumn("_one", F.lit(1)).join(F.broadcast(vocabulary), "_one").drop("_one")
    d = d.join(by_city, "_city", "left")

    hits = F.filter("_provinces", lambda p: F.array_contains(F.col("_labels"), p["_code"]) | F.array_contains(F.col("_labels"), p["_pname"]))
    d = d.withColumn("_hints", F.array_distinct(F.transform(hits, lambda p: p["_code"])))
    hinted = F.size("_hints") > 0
    left = F.filter("_options", lambda o: ~hinted | F.array_contains(F.col("_hints"), o["_code"]))
    d = d.withColumn("_left", left)
    chosen = F.try_element_at("_left", F.lit(1))
    said = F.filter("_labels", lambda x: F.array_contains(F.col("_regions"), x))
    issue = tx.first_failure(
        ("municipality missing", F.coalesce(F.col("_city") == "", F.lit(True))),
        ("municipality outside the registry", F.col("_options").isNull()),
        ("conflicting provinces", F.size("_hints") > 1),
        ("ambiguous municipality", ~hinted & F.coalesce(F.col("_ambiguous"), F.lit(False))),
        ("municipality and province conflict", F.size("_left") != 1),
        ("municipality and region conflict", F.exists(said, lambda x: x != chosen["_region"])),
    )
    fine = F.col("location_issue").isNull()
    return (
        d.withColumn("location_issue", issue)
        .withColumn("location_city", F.when(fine, chosen["_name"]))
        .withColumn("location_province", F.when(fine, chosen["_prov"]))
        .drop("_city", "_labels", "_options", "_ambiguous", "_provinces", "_regions", "_hints", "_left")
    )
