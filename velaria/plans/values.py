"""Check digits, views, builders and one detector at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from velaria.functions import builders, checks, views
from velaria.functions.spans import piece
from velaria.functions.tables import DNI_LETTERS
from velaria.operators import detect
from velaria.plans import planted_sql as sql
from velaria.plans.registry import query, spread, table
from velaria.sources.corpus import corpus, gold_table

NAMES = (
    "dni", "wrong_dni", "nie", "nif_klm", "cif", "nss", "ccc", "iban_es", "card", "phone", "email",
    "address", "birth_date", "passport", "plate", "ip", "pt_nif", "fr_nir", "de_vat", "de_idnr",
    "codice_fiscale",
)


@query(
    "s09_builders",
    "select c_custkey as key, "
    + ", ".join(f"{sql.value(n, 'c_custkey')} as {n}" for n in NAMES)
    + " from customer",
)
def s09_builders(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("key"),
        *[getattr(builders, n)(key).alias(n) for n in NAMES],
    )


@query(
    "s08_corpus_texts",
    "with " + sql.corpus_cte("orders", "o_orderkey")
    + " select kind || '-' || cast(key as varchar) as name, kind, text from texts",
)
def s08_corpus_texts(spark, sf):
    return corpus(spread(table(spark, sf, "orders")), "o_orderkey").select("name", "kind", "text")


@query(
    "s08_corpus_gold",
    "with " + sql.corpus_cte("orders", "o_orderkey")
    + ' select key, start, "end", label from gold',
)
def s08_corpus_gold(spark, sf):
    docs = corpus(spread(table(spark, sf, "orders")), "o_orderkey")
    return gold_table(docs, ["o_orderkey"]).withColumnRenamed("o_orderkey", "key")


# --- Validators over a column of good and broken identifiers ----------------------------------
# One row in three of every identifier has its last character turned: digits 0..9 and letters
# along their control alphabet.
TURN_FROM, TURN_TO = "0123456789", "1234567890"
LETTERS_TO = DNI_LETTERS[1:] + DNI_LETTERS[0]


def _broken(value, letters: bool = False):
    source, target = (DNI_LETTERS, LETTERS_TO) if letters else (TURN_FROM, TURN_TO)
    last = F.translate(F.substring(value, F.length(value), F.lit(1)), source, target)
    return F.concat(F.substring(value, F.lit(1), F.length(value) - 1), last)


def _broken_sql(value, letters=False):
    source, target = (DNI_LETTERS, LETTERS_TO) if letters else (TURN_FROM, TURN_TO)
    return (
        f"(substr({value}, 1, length({value}) - 1) || "
        f"translate(substr({value}, length({value}), 1), '{source}', '{target}'))"
    )


def _validator(name, builder, check, letters=False):
    good = sql.value(builder, "o_orderkey")

    @query(
        name,
        f"with v as (select o_orderkey as key, {good} as good from orders) "
        f"select key, case when key % 3 = 0 then {_broken_sql('good', letters)} else good end as value, "
        "key % 3 <> 0 as valid from v",
    )
    def build(spark, sf):
        key = F.col("o_orderkey")
        good = getattr(builders, builder)(key)
        valued = spread(table(spark, sf, "orders")).select(
            key.alias("key"), F.when(key % 3 == 0, _broken(good, letters)).otherwise(good).alias("value")
        )
        return valued.withColumn("valid", check(F.col("value")))


_validator("v02_dni_valid", "dni", checks.dni, True)
_validator("v03_nie_valid", "nie", checks.nie, True)
_validator("v04_nif_klm_valid", "nif_klm", checks.nif_klm, True)
_validator("v06_nss_valid", "nss", checks.nss)
_validator("v08_iban_valid", "iban_es", checks.iban)
_validator("v09_luhn_valid", "card", checks.luhn)
_validator("v12_pt_nif_valid", "pt_nif", checks.pt_nif)
_validator("v12_fr_nir_valid", "fr_nir", checks.fr_nir)
_validator("v12_de_idnr_valid", "de_idnr", checks.de_idnr)
_validator("v11_eu_vat_valid", "de_vat", checks.eu_vat)


@query(
    "v01_compact",
    "select c_custkey as key, upper(translate(v, ' .-/' || chr(13) || chr(10), '')) as compact, "
    "regexp_full_match(upper(translate(v, ' .-/' || chr(13) || chr(10), '')), '[0-9]+') as is_digits "
    f"from (select c_custkey, case when c_custkey % 2 = 0 then {sql.nss('c_custkey')} else {sql.dni('c_custkey')} end as v from customer)",
)
def v01_compact(spark, sf):
    key = F.col("c_custkey")
    mixed = F.when(key % 2 == 0, builders.nss(key)).otherwise(builders.dni(key))
    compact = checks.compact_id(mixed)
    return table(spark, sf, "customer").select(
        key.alias("key"), compact.alias("compact"), checks.is_ascii_digits(compact).alias("is_digits")
    )


def _cif_shape(n):
    return (
        f"regexp_full_match({n}, '[ABCDEFGHJNPQRSUVW][0-9]{{7}}.') and substr({n}, 9, 1) in "
        f"(cast({sql.luhn_digit(f'substr({n}, 2, 7)')} as varchar), "
        f"substr('JABCDEFGHI', cast({sql.luhn_digit(f'substr({n}, 2, 7)')} as int) + 1, 1))"
    )


@query(
    "v05_cif_valid",
    f"with v as (select o_orderkey as key, {sql.cif('o_orderkey')} as good from orders), "
    "w as (select key, case when key % 3 = 0 then substr(good, 1, 8) || "
    "translate(substr(good, 9, 1), '0123456789JABCDEFGHI', '1234567890ABCDEFGHIJ') else good end as value from v) "
    f"select key, value, {_cif_shape('value')} as valid from w",
)
def v05_cif_valid(spark, sf):
    key = F.col("o_orderkey")
    good = builders.cif(key)
    last = F.translate(F.substring(good, 9, 1), "0123456789JABCDEFGHI", "1234567890ABCDEFGHIJ")
    valued = table(spark, sf, "orders").select(
        key.alias("key"),
        F.when(key % 3 == 0, F.concat(F.substring(good, 1, 8), last)).otherwise(good).alias("value"),
    )
    return valued.withColumn("valid", checks.cif(F.col("value")))


@query(
    "v07_ccc_valid",
    f"with v as (select o_orderkey as key, {sql.account('o_orderkey', 15)} as good from orders) "
    "select key, case when key % 3 = 0 then substr(good, 1, 8) || translate(substr(good, 9, 1), "
    "'0123456789', '1234567890') || substr(good, 10) else good end as value, key % 3 <> 0 as valid from v",
)
def v07_ccc_valid(spark, sf):
    key = F.col("o_orderkey")
    good = checks.compact_id(builders.ccc(key))
    turned = F.concat(
        F.substring(good, 1, 8), F.translate(F.substring(good, 9, 1), TURN_FROM, TURN_TO), F.substring(good, 10, 11)
    )
    valued = table(spark, sf, "orders").select(
        key.alias("key"), F.when(key % 3 == 0, turned).otherwise(good).alias("value")
    )
    return valued.withColumn("valid", checks.ccc(F.col("value")))


@query(
    "v10_card_prefix",
    "with v as (select l_orderkey, l_linenumber, l_partkey, cast((l_orderkey * 7919 + l_linenumber * 613 + l_partkey) % 10000 as int) as four from lineitem), "
    "w as (select lpad(cast(four as varchar), 4, '0') || '000000000' as digits, four, four // 100 as two, four // 10 as three from v) "
    "select digits, (four // 1000 = 4 or two between 51 and 55 or four between 2221 and 2720 or two in (34, 36, 37, 38, 62, 65) "
    "or four = 6011 or three between 644 and 649 or four between 3528 and 3589 or three between 300 and 305) as known_issuer, "
    "count(*) as n from w group by all",
)
def v10_card_prefix(spark, sf):
    four = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 613 + F.col("l_partkey")) % 10000
    digits = F.concat(F.lpad(four.cast("string"), 4, "0"), F.lit("000000000"))
    counted = table(spark, sf, "lineitem").select(digits.alias("digits")).groupBy("digits").agg(
        F.count("*").alias("n")
    )
    return counted.withColumn("known_issuer", checks.card_prefix(F.col("digits")))


@query(
    "v11_codice_fiscale_valid",
    f"with v as (select c_custkey as key, {sql.codice_fiscale('c_custkey')} as good from customer) "
    "select key, case when key % 3 = 0 then substr(good, 1, 15) || chr(65 + (unicode(substr(good, 16, 1)) - 64) % 26) else good end as value, "
    "key % 3 <> 0 as valid from v",
)
def v11_codice_fiscale_valid(spark, sf):
    key = F.col("c_custkey")
    good = builders.codice_fiscale(key)
    turned = F.concat(
        F.substring(good, 1, 15), F.char((F.ascii(F.substring(good, 16, 1)) - 64) % 26 + 65)
    )
    valued = table(spark, sf, "customer").select(
        key.alias("key"), F.when(key % 3 == 0, turned).otherwise(good).alias("value")
    )
    return valued.withColumn("valid", checks.codice_fiscale(F.col("value")))


@query(
    "v13_real_date",
    "with v as (select o_orderkey as key, cast(o_orderkey % 33 as varchar) as day, cast(o_orderkey // 33 % 14 as varchar) as month, "
    "case when o_orderkey % 2 = 0 then lpad(cast(o_orderkey // 7 % 100 as varchar), 2, '0') else cast(1890 + o_orderkey // 5 % 130 as varchar) end as year from orders) "
    "select key, day, month, year, case when length(year) = 4 then try_cast(lpad(year, 4, '0') || '-' || lpad(month, 2, '0') || '-' || lpad(day, 2, '0') as date) is not null "
    "else try_cast('19' || year || '-' || lpad(month, 2, '0') || '-' || lpad(day, 2, '0') as date) is not null or "
    "try_cast('20' || year || '-' || lpad(month, 2, '0') || '-' || lpad(day, 2, '0') as date) is not null end as real from v",
)
def v13_real_date(spark, sf):
    key = F.col("o_orderkey")
    parts = table(spark, sf, "orders").select(
        key.alias("key"),
        (key % 33).cast("string").alias("day"),
        (F.floor(key / 33) % 14).cast("string").alias("month"),
        F.when(key % 2 == 0, F.lpad((F.floor(key / 7) % 100).cast("string"), 2, "0"))
        .otherwise((1890 + F.floor(key / 5) % 130).cast("string"))
        .alias("year"),
    )
    return parts.withColumn(
        "real", checks.real_date(F.col("day"), F.col("month"), F.col("year"))
    )


# --- One detector at a time, over one planted text per customer -------------------------------
# (id, type, words before, builder, broken variant as (Column maker, SQL)).  Two rows in three
# hold a valid value; the third a value that must not be found.


DETECTOR_CASES = (
    ("d01_es_dni", "ES_DNI", "con DNI ", "dni", "letter"),
    ("d02_es_nie", "ES_NIE", "con NIE ", "nie", "letter"),
    ("d03_es_nif", "ES_NIF", "con NIF ", "nif_klm", "letter"),
    ("d04_es_cif", "ES_CIF", "con CIF ", "cif", "cif"),
    ("d05_es_nss", "ES_NSS", "con NSS ", "nss", "digit"),
    ("d06_es_ccc", "ES_CCC", "con cuenta ", "ccc", "glued"),
    ("d07_iban", "IBAN", "con IBAN ", "iban_es", "digit"),
    ("d08_codice_fiscale", "IT_CODICE_FISCALE", "con codice ", "codice_fiscale", "codice"),
    ("d09_eu_vat", "EU_VAT", "con VAT ", "de_vat", "digit"),
    ("d10_credit_card", "CREDIT_CARD", "con tarjeta ", "card", "digit"),
    ("d11_email_planted", "EMAIL", "con correo ", "email", "at"),
    ("d12_ip_planted", "IP", "desde ", "ip", "glued"),
    ("d13_phone", "PHONE", "con móvil ", "phone", "glued"),
    ("d14_passport", "ES_PASSPORT", "con pasaporte ", "passport", "word"),
    ("d15_plate", "ES_PLATE", "con matrícula ", "plate", "word"),
    ("d16_address", "ADDRESS", "que vive en ", "address", "street"),
    ("d17_birth_date", "DATE_OF_BIRTH", "con fecha de nacimiento ", "birth_date", "word"),
    ("d18_pt_nif", "PT_NIF", "contribuinte ", "pt_nif", "digit"),
    ("d19_fr_nir", "FR_NIR", "numéro NIR ", "fr_nir", "digit"),
    ("d20_de_idnr", "DE_IDNR", "mit IdNr ", "de_idnr", "digit"),
)
HEAD = "Ficha de "


def planted_text(key, before, builder, broken):
    """(text, start, end, whether it must be found) of one planted row."""
    value = getattr(builders, builder)(key)
    bad = key % 3 == 0
    if broken == "letter":
        shown = F.when(bad, _broken(value, True)).otherwise(value)
    elif broken == "digit":
        shown = F.when(bad, _broken(value)).otherwise(value)
    elif broken == "cif":
        last = F.translate(F.substring(value, 9, 1), "0123456789JABCDEFGHI", "1234567890ABCDEFGHIJ")
        shown = F.when(bad, F.concat(F.substring(value, 1, 8), last)).otherwise(value)
    elif broken == "codice":
        last = F.char((F.ascii(F.substring(value, 16, 1)) - 64) % 26 + 65)
        shown = F.when(bad, F.concat(F.substring(value, 1, 15), last)).otherwise(value)
    elif broken == "glued":
        shown = F.when(bad, F.concat(F.lit("x9"), value, F.lit("9x"))).otherwise(value)
    elif broken == "at":
        shown = F.when(bad, F.replace(value, F.lit("@"), F.lit(" at "))).otherwise(value)
    elif broken == "street":
        shown = F.when(bad, F.lit("Calle Mayor sin portal")).otherwise(value)
    else:
        shown = value
    words = F.when(bad, F.lit("con referencia ")).otherwise(before) if broken == "word" else F.lit(before)
    head = F.concat(F.lit(HEAD), F.col("c_name"), F.lit(" "), words)
    return F.concat(head, shown, F.lit(". Fin."))


def _detector_case(name, entity, before, builder, broken):
    value = sql.value(builder, "c_custkey")
    head = f"({sql.quoted(HEAD)} || c_name || ' ' || {sql.quoted(before)})"

    @query(
        name,
        f"select c_custkey as key, length({head})::int as start, (length({head}) + length({value}))::int as \"end\", "
        f"{value} as value from customer where c_custkey % 3 <> 0",
    )
    def build(spark, sf):
        texts = spread(table(spark, sf, "customer")).select(
            F.col("c_custkey").alias("key"),
            planted_text(F.col("c_custkey"), before, builder, broken).alias("text"),
        )
        found = detect.candidates(texts, "text", (entity,))
        rows = found.select("key", "text", F.explode_outer("candidates").alias("s")).filter("s is not null")
        return rows.select(
            "key",
            F.col("s.start").alias("start"),
            F.col("s.end").alias("end"),
            piece(F.col("text"), F.col("s.start"), F.col("s.end")).alias("value"),
        )


for _case in DETECTOR_CASES:
    _detector_case(*_case)


# --- Detectors over the whole documents and pages ---------------------------------------------
# SQL has no look-around: it takes the maximal runs of the characters that could belong to a
# value, with their places, and tests each run.
_RUNS = """
with runs as (
  select doc_id, text, unnest(regexp_extract_all(text, '{run}')) as run,
         unnest(string_split_regex(text, '{run}')[:-2]) as gap,
         generate_subscripts(regexp_extract_all(text, '{run}'), 1) as i
  from documents where len(regexp_extract_all(text, '{run}')) > 0
), placed as (
  select doc_id, run, text, i,
         (sum(length(gap) + length(run)) over (partition by doc_id order by i) - length(run))::int as start
  from runs
)
"""


@query(
    "d12_ip",
    _RUNS.format(run="[0-9A-Za-z.]+")
    + """, parts as (
  select doc_id, start, run, regexp_extract(run, '^([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)[.]*$', 1) as ip from placed
) select doc_id, start, (start + length(ip))::int as "end" from parts where ip <> '' and
  list_bool_and([regexp_full_match(o, '0|[1-9][0-9]{0,2}') and cast(o as int) <= 255 for o in string_split(ip, '.')])
""",
)
def d12_ip(spark, sf):
    found = detect.candidates(spread(table(spark, sf, "documents")), "text", ("IP",))
    rows = found.select("doc_id", F.explode_outer("candidates").alias("s")).filter("s is not null")
    return rows.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query(
    "d11_email",
        "with runs as (select doc_id, unnest(regexp_extract_all(text, '[^ \\n\\t,;:()<>\"\\[\\]]+@[^ \\n\\t,;:()<>\"\\[\\]]+')) as run from documents) "
        "select doc_id, regexp_extract(run, '[A-Za-z0-9_.!#$%&*+/=?^`{|}~-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,24}') as value, count(*) as n from runs "
        "where regexp_extract(run, '[A-Za-z0-9_.!#$%&*+/=?^`{|}~-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,24}') <> '' group by all",
)
def d11_email(spark, sf):
    found = detect.scan(spread(table(spark, sf, "documents")), "text", ("EMAIL",))
    return detect.value_table(found, ["doc_id"]).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


# --- Views ------------------------------------------------------------------------------------
@query(
    "n03_look_alikes",
    "select doc_id, translate(text, "
    + sql.quoted("".join(views.tables.look_alikes()))
    + ", "
    + sql.quoted("".join(views.tables.look_alikes().values()))
    + ") as folded from documents",
)
def n03_look_alikes(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", views.fold_look_alikes(F.col("text")).alias("folded")
    )


FOLDED_SQL = "trim(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '[\\t\\n\\x0B\\f\\r\\x1C-\\x1F ]+', ' ', 'g'))"


@query(
    "n04_guard_view",
    # Every text; the letters of the table fold as strip_accents has it.
    f"select doc_id, {FOLDED_SQL} as guard_view, strlen(text) = length(text) as is_ascii from documents",
)
def n04_guard_view(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", views.guard_view(F.col("text")).alias("guard_view"), views.is_ascii(F.col("text")).alias("is_ascii")
    )


@query(
    "n05_compact_view",
    f"select doc_id, regexp_replace({FOLDED_SQL}, '[^\\p{{L}}\\p{{N}}]+', '', 'g') as compact from documents",
)
def n05_compact_view(spark, sf):
    return table(spark, sf, "documents").select("doc_id", views.compact(views.guard_view(F.col("text"))).alias("compact"))


@query(
    "n10_escape",
    "select page_id, regexp_replace(html || '[[' || url || '[[[a] [[b]]', '(\\[\\[+)', '\\1!', 'g') as escaped from pages",
)
def n10_escape(spark, sf):
    text = F.concat(F.col("html"), F.lit("[["), F.col("url"), F.lit("[[[a] [[b]]"))
    return table(spark, sf, "pages").select("page_id", views.escape(text).alias("escaped"))


@query(
    "m10_utf16",
    "select doc_id, (length(t) + length(regexp_replace(t, '[\\x{1}-\\x{FFFF}]', '', 'g')))::int as units, "
    "(length(substr(t, 1, length(t) // 2)) + length(regexp_replace(substr(t, 1, length(t) // 2), '[\\x{1}-\\x{FFFF}]', '', 'g')))::int as middle "
    "from (select doc_id, '😀' || text || '𝒜b' as t from documents)",
)
def m10_utf16(spark, sf):
    text = F.concat(F.lit("😀"), F.col("text"), F.lit("𝒜b"))
    docs = table(spark, sf, "documents").select("doc_id", text.alias("t"))
    half = F.floor(F.length("t") / 2).cast("int")
    return docs.select(
        "doc_id",
        views.utf16_length(F.col("t")).alias("units"),
        views.utf16_offset(F.col("t"), half).alias("middle"),
    )


@query(
    "d25_keyword_context",
    "select o_orderkey, o_orderkey % 60 <= 32 and o_orderkey % 5 <> 4 as near from orders",
)
def d25_keyword_context(spark, sf):
    # "tel" 8 to 67 characters before the value; in one row of five it is the end of "hotel".
    key = F.col("o_orderkey")
    word = F.when(key % 5 == 4, "hotel").otherwise(" +tel")
    gap = F.rpad(F.lit(" "), (key % 60 + 5).cast("int"), ".")
    text = F.concat(F.lit("inicio del texto "), word, gap, F.lit("612345678"))
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    start = F.length("t") - 9
    return rows.select("o_orderkey", detect.has_context(F.col("t"), start, detect.PHONE_WORDS).alias("near"))


@query(
    "d24_hex_runs",
    "select o_orderkey, o_orderkey % 20 >= 7 and o_orderkey % 3 <> 1 as inside from orders",
)
def d24_hex_runs(spark, sf):
    # Nine hexadecimal characters with up to nineteen more before them; a letter past F in one
    # row of three.
    key = F.col("o_orderkey")
    left = F.when(key % 20 == 0, "").otherwise(F.repeat(F.lit("a"), (key % 20).cast("int")))
    right = F.when(key % 3 == 1, "z").otherwise("")
    text = F.concat(F.lit("- "), left, F.lit("12345678F"), right, F.lit(" -"))
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("t"), F.length(left).alias("n"))
    hit = F.struct((F.col("n") + 2).alias("start"), (F.col("n") + 11).alias("end"), F.lit("12345678F").alias("hit"))
    return rows.withColumn("h", hit).select("o_orderkey", detect.inside_hex_run(F.col("t"), F.col("h")).alias("inside"))
