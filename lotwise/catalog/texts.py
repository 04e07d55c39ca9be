"""Text, HTML and identity rules over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import damage, identity as ident, terms, text as tx
from ..sources import pages as pg
from . import base as b
from .base import query

_BODY = "concat(title, ' ', description)"


@query("normalize_text", r"select doc_id, nullif(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')), '') as value from documents")
def normalize_text(spark, d):
    return b.table(spark, d, "documents").select("doc_id", tx.squash("text").alias("value"))


@query("fold_accents", r"select doc_id, length(value) as chars, md5(value) as digest from (select doc_id, strip_accents(nullif(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')), '')) as value from documents)")
def fold_accents(spark, d):
    v = tx.fold("text")
    return b.table(spark, d, "documents").select("doc_id", F.length(v).cast("bigint").alias("chars"), F.md5(v.cast("binary")).alias("digest"))


@query("normalize_fields", b.with_adverts(r"""select doc_id, case fuel when 'benzina' then 'petrol' when 'gasolio' then 'diesel' end as fuel, case transmission when 'cambio manuale' then 'manual' when 'semiautomatico' then 'semi_automatic' end as transmission,
 case displacement_cc when '1.242 cm³' then 1242 when '1600' then 1600 end as displacement_cc, power_hp from adverts"""))
def normalize_fields(spark, d):
    a = b.adverts(spark, d)
    return a.select(
        "doc_id", ident.normalize_field("fuel", "fuel").alias("fuel"), ident.normalize_field("transmission", "transmission").alias("transmission"),
        ident.normalized_number("displacement_cc", "displacement_cc").alias("displacement_cc"), ident.normalized_number("power_hp", "power_hp").alias("power_hp"),
    )


_SEVERE = (
    r"telaio\s+(?:piegato|danneggiato|deformato)|danni?\s+struttural\w*|airbag.{0,24}(?:esplos\w*|scoppi\w*|apert\w*|attivat\w*)|alluvionat\w*|incendiat\w*|motore\s+(?:rotto|fuso|da\s+(?:rifare|sostituire|cambiare|riparare))|"
    r"(?:guasto|problemi|rottura)\s+(?:al\s+|del\s+)?(?:motore|cambio)|non\s+marciante|gravemente\s+incidentat\w*|uso\s+ricambi"
)
_MINIMAL = r"graffi\w*|lievi\s+segni|piccol[ie]\s+segni|segni\s+superficiali|lievi\s+ammaccature|piccol[ae]\s+ammaccatur\w*"
_NON_SEVERE = (
    r"grandin\w*|(?:paraurti|parafango|portiera|cofano|carrozzeria|lamiera).{0,30}(?:da\s+(?:riparare|sistemare|verniciare|sostituire)|danneggiat\w*|rott\w*|crepa)|"
    r"(?:dann\w*|crepa|riparazione).{0,25}(?:paraurti|parafango|portiera|carrozzeria)|carrozzeria\s+scolorita"
)
_DISCLOSED = r"incidentat\w*|sinistrat\w*|danneggiat\w*"
_GOOD = r"(?:auto|vettura|macchina).{0,35}(?:in\s+)?(?:buone|ottime|perfette)\s+condizioni|(?:ottime|perfette)\s+condizioni\s+(?:generali|meccaniche)"
CATEGORY_SQL = f"""case when damage_severity = 'severe' or {b.declared_sql(_BODY, _SEVERE)} then 'severe' when damage_severity = 'moderate' or {b.declared_sql(_BODY, _NON_SEVERE)} then 'non_severe'
 when damage_severity = 'minor' or {b.declared_sql(_BODY, _MINIMAL)} then 'minimal' when condition = 'damaged' or {b.declared_sql(_BODY, _DISCLOSED)} then 'unknown' when condition = 'undamaged' or {b.declared_sql(_BODY, _GOOD)} then 'clean' else 'unknown' end"""


@query("declared_signals", b.with_adverts(f"""select doc_id, {b.declared_sql(_BODY, _SEVERE)} as severe, {b.declared_sql(_BODY, _MINIMAL)} as minimal, {b.declared_sql(_BODY, _DISCLOSED)} as disclosed from adverts"""))
def declared_signals(spark, d):
    body = tx.full_text("title", "description")
    said = lambda p: F.size(damage.signals(body, p)) > 0
    return b.adverts(spark, d).select("doc_id", said(damage.SEVERE).alias("severe"), said(damage.MINIMAL).alias("minimal"), said(damage.DISCLOSED).alias("disclosed"))


@query("damage_category", b.with_adverts(f"select doc_id, {CATEGORY_SQL} as damage_category from adverts"))
def damage_category(spark, d):
    return damage.with_damage(b.adverts(spark, d)).select("doc_id", "damage_category")


@query("damage_counts", b.with_adverts(f"select damage_category, count(*) as n from (select {CATEGORY_SQL} as damage_category from adverts) group by 1"))
def damage_counts(spark, d):
    return damage.with_damage(b.adverts(spark, d)).groupBy("damage_category").agg(F.count(F.lit(1)).alias("n"))


@query("version_signature", b.with_asks("""select source, source_id, version_key, case when p = 2 and starts_with(trim, concat(model, ' ')) then substr(trim, length(model) + 2) else trim end as label, case p when 0 then 'i' when 1 then 'iii' end as roman from (select *, mileage_km // 4000 % 3 as p from asks)"""))
def version_signature(spark, d):
    p = F.floor(F.col("mileage_km") / 4000) % 3
    roman = F.when(p == 0, F.lit("I 2019 ")).when(p == 1, F.lit("III ")).otherwise(F.lit(""))
    text = F.concat(F.upper("model"), F.lit(" "), F.col("model"), F.lit(" "), roman, F.col("trim"), F.lit(" "), F.col("year").cast("string"))
    sig = ident.version_signature(text, F.col("model"), F.col("year"))
    return b.asks(spark, d).select("source", "source_id", "version_key", sig["label"].alias("label"), sig["roman"].alias("roman"))


@query("text_claims", b.with_adverts(r"""select doc_id, field, value, count(*) as mentions from (
 select doc_id, 'power_hp' as field, unnest(regexp_extract_all(regexp_replace(phrases, '\d+ cv fiscali', '', 'g'), '(?:^|[^\pL\pN_])(\d{2,4})\s*(?:cv|hp|ps)', 1)) as value from adverts
 union all select doc_id, 'power_kw', unnest(regexp_extract_all(regexp_replace(phrases, 'ricarica \d+ kw', '', 'g'), '(?:^|[^\pL\pN_])(\d{2,4})\s*kw', 1)) from adverts
 union all select doc_id, 'displacement_cc', unnest(regexp_extract_all(phrases, '(\d{3,5})\s*(?:cc|cm3)', 1)) from adverts
 union all select doc_id, 'engine_code', unnest(regexp_extract_all(phrases, 'codice motore ([a-z0-9-]{3,15})', 1)) from adverts
 union all select doc_id, 'transmission', unnest(regexp_extract_all(phrases, 'cambio (automatico|manuale)', 1)) from adverts) group by all"""))
def text_claims(spark, d):
    a = b.adverts(spark, d)
    named = lambda f: lambda v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    parts = [F.transform(ident.text_claim_values(f, "description"), named(f)) for f in ident.TEXT_CLAIMS]
    return a.select("doc_id", F.explode(F.concat(*parts)).alias("c")).select("doc_id", "c.*").groupBy("doc_id", "field", "value").agg(F.count(F.lit(1)).alias("mentions"))


# Oracle text: the whole text in ASCII, character by character, so that word edges are those of Unicode. Other letters
# and digits are x, other spaces a space, other marks an exclamation mark; paragraph and section marks are free.
BOUND = r"\b"
_SPACE = r"[ \t\n\x0B\f\r]"


def _plain_sql(text: str) -> str:
    out = f"translate({text}, '\u212a\u017f\u0130\u0131\u0085\u2028\u2029', 'ksii' || repeat(chr(10), 3))"
    for found, instead in ((r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]", " "), (r"[^\x00-\x7F\pL\pM\p{Nd}\p{Pc}]", "!"), (r"[^\x00-\x7F]", "x")):
        out = f"regexp_replace({out}, '{found}', '{instead}', 'g')"
    return out


def _unpreceded_sql(text: str, pattern: str, window: int, ending: str) -> str:
    """The second group of every match of ``pattern``, if the ``window`` characters before it don't end with ``ending``.

    The first group is what stands before the match and isn't part of it. Matches are set between section
    marks; pieces at even places are the matches.
    """
    pieces = f"string_split(regexp_replace({text}, '{pattern}', '\\1§\\2§', 'g'), '§')"
    before = f"right(replace(array_to_string(pieces[1:2 * i - 1], ''), '¶', ''), {window})"
    return f"list_transform([{pieces}], lambda pieces: list_transform(list_filter(range(1, len(pieces) // 2 + 1), lambda i: not regexp_matches({before}, '(?i){ending}')), lambda i: pieces[2 * i]))[1]"


_KM_NUMBER = "(?:[0-9]{1,3}(?:[ .][0-9]{3})+|[0-9]{4,7})"
_KM_SERVICE = r"(?:distribuzion\w*|cinghia|tagliando|sostituit\w*|cambiat\w*|motore rifatto|batteria)[^\n\r]{0,45}\r?\n?$"
# A paragraph mark after a digit: neither a digit nor a point or comma and a digit follow. It is no word's edge.
_KM_ENDED = "regexp_replace(regexp_replace(plain, '([0-9])([^0-9.,]|$)', '\\1¶\\2', 'g'), '([0-9])([.,])([^0-9]|$)', '\\1¶\\2\\3', 'g')"
_KM_CLAIMS = " || ".join(
    f"list_transform({_unpreceded_sql(text, '(?i)' + pattern, 70, _KM_SERVICE)}, lambda v: cast(regexp_replace(v, '[^0-9]', '', 'g') as bigint) * {factor})"
    for text, pattern, factor in (
        ("plain", rf"(^|[^0-9])({_KM_NUMBER}{_SPACE}*(?:km|chilometri|kilometri)){BOUND}", 1),
        (_KM_ENDED, rf"(^|[^¶\w])((?:km|chilometri|kilometri){_SPACE}*[:=]?{_SPACE}*(?:[0-9]{{1,3}}(?:(?:¶ |[.])[0-9]{{3}})+|[0-9]{{4,7}})¶)", 1),
        ("plain", rf"(^|[^0-9])([0-9]{{1,3}}{_SPACE}*(?:mila|k){_SPACE}*(?:km|chilometri)){BOUND}", 1000),
    )
)


@query("mileage_claims", b.with_adverts(f"""select doc_id, array_to_string(list_sort(list_distinct(list_filter({_KM_CLAIMS}, lambda v: v between 0 and 1000000))), ',') as km
 from (select doc_id, {_plain_sql("description")} as plain from adverts)"""))
def mileage_claims(spark, d):
    return b.adverts(spark, d).select("doc_id", F.array_join(F.transform(ident.mileage_claims("description"), lambda v: v.cast("string")), ",").alias("km"))


_FUEL_WORDS = {"cng": "metano", "diesel": "diesel|gasolio", "electric": "elettrica|elettrico|electric", "lpg": "gpl", "petrol": "benzina|petrol|gasoline"}
_SAID = ", ".join(f"case when {_unpreceded_sql('plain', rf'(?i)()({BOUND}(?:{words})){BOUND}', 20, rf'{BOUND}(?:non|no|senza){_SPACE}*$')} <> [] then '{fuel}' end" for fuel, words in _FUEL_WORDS.items())


@query("fuel_claims", b.with_adverts(f"""select doc_id, array_to_string(list_sort(list_distinct(list_filter(list_append(case said when ['lpg', 'petrol'] then ['petrol_lpg'] when ['cng', 'petrol'] then ['petrol_cng'] else said end,
 case fuel when 'benzina' then 'petrol' when 'gasolio' then 'diesel' end), lambda x: x is not null))), ',') as fuels from (select doc_id, fuel, list_filter([{_SAID}], lambda x: x is not null) as said
 from (select doc_id, fuel, {_plain_sql("concat(title, ' ', description)")} as plain from adverts))"""))
def fuel_claims(spark, d):
    fuels = ident.fuel_claims(tx.full_text("title", "description"), F.col("fuel"))
    return b.adverts(spark, d).select("doc_id", F.array_join(fuels, ",").alias("fuels"))


@query("title_identity", b.with_adverts("""select doc_id, case doc_id % 12 when 0 then 'Fiat' when 1 then 'Fiat' when 2 then 'BMW' when 3 then 'Mercedes-Benz' when 4 then 'Volkswagen' when 5 then 'Citroen' when 6 then 'Ford' when 7 then 'Audi' when 8 then 'Toyota' when 9 then 'Renault' when 11 then 'Fiat' end as make,
 case doc_id % 12 when 0 then 'Panda' when 1 then '500L' when 2 then 'Serie 3' when 3 then 'Classe A' when 4 then 'Golf' when 5 then 'C3' when 6 then 'Fiesta' when 7 then 'A3' when 8 then 'Yaris' when 9 then 'Clio' when 11 then '500' end as model,
 case when doc_id % 12 <> 10 then 2001 + doc_id % 20 end as year from adverts"""))
def title_identity(spark, d):
    t = ident.title_identity("title")
    return b.adverts(spark, d).withColumn("t", t).select("doc_id", "t.make", "t.model", "t.year")


@query("family_aliases", """select p_partkey, case p_partkey % 5 when 0 then 'serie 3' when 1 then 'classe a' when 2 then 'golf' when 3 then '208' else lower(p_name) end as family from part""")
def family_aliases(spark, d):
    k = F.col("p_partkey") % 5
    make = F.when(k == 0, "BMW").when(k == 1, "Mercedes-Benz").otherwise("x")
    model = F.when(k == 0, "320d").when(k == 1, "A 180").when(k == 2, "Golf  Variant").when(k == 3, "208 GT").otherwise(F.col("p_name"))
    return b.table(spark, d, "part").select("p_partkey", ident.family_model(make, model).alias("family"))


@query("variant_tags", b.with_adverts(r"""select doc_id, array_to_string(list_filter([case when x like '%abarth%' then 'abarth' end, case when x like '%amg%' then 'amg' end, case when x like '%gti%' then 'gti' end], lambda v: v is not null), '|') as sport,
 case when x like '%quattro%' then 'awd' end as drive, case when x like '%touring%' or x like '% sw%' then 'wagon' end as body, cast(round(cast(nullif(regexp_extract(x, '(?:^|[^0-9.])([1-6][.][0-9])(?:$|[^0-9])', 1), '') as double) * 10) as bigint) as decilitres from (select doc_id, lower(title) x from adverts)"""))
def variant_tags(spark, d):
    none = F.lit(None).cast("string")
    v = ident.variant(F.col("title"), none, none, none, none)
    return b.adverts(spark, d).withColumn("v", v).select("doc_id", "v.sport", "v.drive", "v.body", F.round(F.col("v.litres") * 10).cast("bigint").alias("decilitres"))


@query("announcement_anomalies", b.with_adverts(r"""select doc_id, array_to_string(list_filter([case when regexp_matches(x, 'prezzo.{0,25}(?:solo|con|vincolato).{0,20}finanziamento|finanziamento obbligatorio') then 'conditional_financing_price' end,
 case when regexp_matches(x, 'prezzo.{0,15}(?:acconto|anticipo)|rata mensile') then 'deposit_or_installment' end, case when doc_id % 2 <> 0 and regexp_matches(x, 'solo (?:per )?ricambi|uso ricambi|non vend(?:o|esi) intera') then 'parts_only_vehicle' end,
 case when regexp_matches(x, 'km non (?:certificati|verificabili)') then 'unresolved_mileage' end, case when regexp_matches(x, 'senza documenti|documenti mancanti|fermo amministrativo') then 'documents_unavailable' end,
 case when price_kind <> 'total' then 'non_total_price' end], lambda v: v is not null), ',') as flags from (select *, lower(concat(title, ' ', description)) x from adverts)"""))
def announcement_anomalies(spark, d):
    resolved = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("parts_only_vehicle"), F.lit("non_total_price")))
    flags = terms.anomaly_flags(tx.full_text("title", "description"), F.col("price_kind"), F.lit(True), F.lit(False), resolved)
    return b.adverts(spark, d).select("doc_id", F.array_join(flags, ",").alias("flags"))


@query("page_fields", r"""select page_id, lower(regexp_extract(html, '<html[^>]*\slang="([a-zA-Z-]+)"', 1)) as page_lang, len(regexp_extract_all(html, '<h1')) as h1_count, html like '%__NEXT_DATA__%' as has_props from pages""")
def page_fields(spark, d):
    p = pg.extract_pages(b.table(spark, d, "pages"))
    h1 = F.size(F.regexp_extract_all("html", F.lit("<h1"), F.lit(0)))
    return p.select("page_id", "page_lang", h1.cast("bigint").alias("h1_count"), F.col("page_props").isNotNull().alias("has_props"))


_ENT = "replace(replace(replace(replace(replace(replace({x}, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query("page_title_text", r"""select page_id, case when n = 1 then trim(regexp_replace(""" + _ENT.format(x=r"regexp_replace(t, '<[^>]*>', ' ', 'g')") + r""", '[\s\x{a0}]+', ' ', 'g')) end as page_title from (
 select page_id, len(regexp_extract_all(html, '(?s)<h1[^>]*>.*?</h1>')) n, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) t from pages)""")
def page_title_text(spark, d):
    return b.table(spark, d, "pages").select("page_id", pg.page_title("html").alias("page_title"))


_BARE = "html"
for _pattern, _new in ((r"(?is)<script\b[^>]*>.*?</script\s*>", ""), (r"(?is)<style\b[^>]*>.*?</style\s*>", ""), ("(?s)<!--.*?-->", ""), (r"(?i)<(?:br|p|li)\b[^>]*>", "\n"), ("(?s)</?[a-zA-Z][^>]*>", "")):
    _BARE = f"regexp_replace({_BARE}, '{_pattern}', '{_new}', 'g')"
for _name, _char in (("nbsp", "\xa0"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("middot", "·"), ("copy", "©"), ("euro", "€"), ("#39", "''"), ("amp", "&")):
    _BARE = f"replace({_BARE}, '&{_name};', '{_char}')"


@query("page_visible_text", rf"select page_id, length(t) as chars, sha256(t) as digest from (select page_id, regexp_replace({_BARE}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') as t from pages)")
def page_visible_text(spark, d):
    text = pg.visible_text("html")
    return b.table(spark, d, "pages").withColumn("t", text).select("page_id", F.length("t").cast("bigint").alias("chars"), F.sha2("t", 256).alias("digest"))


@query("page_props_json", r"""select page_id, case when page_id % 3 <> 1 then 'it' end as country, case when page_id % 3 <> 1 then page_id end as ad_id from pages""")
def page_props_json(spark, d):
    # The data script a listing site embeds, placed inside each real page; every third is foreign or doubled.
    blob = F.concat(
        F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"id":'), F.col("page_id").cast("string"),
        F.lit(',"marketplace":{"country":{"iso":"'), F.when(F.col("page_id") % 6 == 1, "de").otherwise("it"), F.lit('"}}}}}</script>'),
    )
    html = F.concat("html", F.when(F.col("page_id") % 6 == 4, F.concat(blob, blob)).otherwise(blob))
    p = b.table(spark, d, "pages").select("page_id", pg.page_props(html).alias("p"))
    return p.select("page_id", F.try_variant_get("p", "$.marketplace.country.iso", "string").alias("country"), F.try_variant_get("p", "$.id", "bigint").alias("ad_id"))


@query("page_links", """select distinct page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1)) as href from pages""")
def page_links(spark, d):
    return pg.links(b.table(spark, d, "pages"), "page_id")
