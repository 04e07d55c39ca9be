"""Negation, damage classes, claims, locations and HTML on small fixtures."""

from pyspark.sql import functions as F

from lotwise.functions import damage, identity as ident, text as tx, urls
from lotwise.sources import pages


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).collect()[0]["x"]


def test_negated_matches_are_consumed(spark):
    got = one(spark, "senza graffi, non è stata graffiata; graffi e airbag esplosi", damage.signals(F.col("t"), damage.MINIMAL))
    assert got == ["graffi"]


def test_inner_negation(spark):
    assert one(spark, "airbag mai esplosi", damage.signals(F.col("t"), damage.SEVERE)) == []


def test_damage_classes(spark):
    rows = [
        ("airbag esplosi", "unknown", "severe"), ("senza airbag esplosi", "undamaged", "clean"), ("lievi ammaccature", "unknown", "minimal"),
        ("paraurti da riparare", "unknown", "non_severe"), ("auto sinistrata", "unknown", "unknown"), ("auto in ottime condizioni", "unknown", "clean"), ("nessuna nota", "unknown", "unknown"),
    ]
    df = spark.createDataFrame(rows, "description string, condition string, want string").withColumn("title", F.lit(""))
    assert [(r["damage_category"], r["description"]) for r in damage.with_damage(df).collect()] == [(w, d) for d, _, w in rows]


def test_accents_and_placeholders(spark):
    assert one(spark, "  Citroën   C3 ", tx.fold("t")) == "citroen c3"
    assert one(spark, "Sconosciuto", tx.known("t")) is None


def test_title_families(spark):
    got = one(spark, "2018 Fiat 500 L trekking", ident.title_identity("t"))
    assert (got["make"], got["model"], got["year"]) == ("Fiat", "500L", 2018)
    assert one(spark, "2018 Lancia Delta", ident.title_identity("t")) is None


def test_mileage_ignores_service_notes(spark):
    assert one(spark, "km 85.000, cinghia cambiata a 60.000 km", ident.mileage_claims("t")) == [85_000]


def test_fiscal_power_is_not_power(spark):
    assert one(spark, "20 cv fiscali, bollo pagato fino a dicembre, 69 cv", ident.text_claim_values("power_hp", "t")) == ["69"]


def test_bi_fuel(spark):
    assert one(spark, "benzina e gpl", ident.fuel_claims("t")) == ["petrol_lpg"]


def test_public_urls(spark):
    rows = [("https://a.example/x", True), ("http://a.example", False), ("https://10.0.0.1/", False), ("https://u:p@a.example", False), ("https://host.local/", False), ("https://a.example:444/", False)]
    df = spark.createDataFrame(rows, "t string, want boolean").select(urls.public_https("t").alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())


def test_page_rules(spark):
    page = "<html lang='it'><script>var a='<h1>no</h1>'</script><h1>Fiat <b>Panda</b></h1><p>uno<br>due</p></html>"
    assert one(spark, page, pages.page_title("t")) == "Fiat Panda"
    assert one(spark, "<p>uno<br>due</p>", pages.plain_text("t")) == "uno\ndue"
    assert one(spark, "<h1>a</h1><h1>b</h1>", pages.page_title("t")) is None


def test_negation_looks_at_a_window_of_characters(spark):
    from lotwise.functions import damage, text

    cases = [
        ("non e e e e e e incendiata", []), ("non" + " " * 20 + "incendiata", []), ("non" + " " * 45 + "incendiata", ["incendiata"]),
        ("mai incendiata ma alluvionata, senza motore rotto", ["alluvionata"]), ("Incendiata. Non è stata incendiata.", ["Incendiata"]), ("nulla", []), (None, None),
    ]
    got = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(text.declared(F.col("t"), damage.SEVERE).alias("d")).collect()
    assert [r["d"] for r in got] == [d for _, d in cases]


def test_character_references(spark):
    from lotwise.sources.pages import unescape

    cases = [("perch&egrave; &#232; &#xE8; &euro;5", "perchè è è €5"), ("&amp;lt; &#38;lt; &lt;", "&lt; &lt; <"), ("&nosuch; & &#0; &#x1F600;", "&nosuch; & \ufffd 😀"), (None, None)]
    got = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(unescape(F.col("t")).alias("u")).collect()
    assert [r["u"] for r in got] == [u for _, u in cases]
