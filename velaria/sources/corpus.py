"""A planted corpus: nine kinds of Spanish and Catalan texts with the place of every value known.

The corpus is a projection of any key table: one text per key, kinds in fixed proportions, every
value a function of the key.  Where a value was put is the running length of the pieces before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from velaria.functions import builders
from velaria.functions.builders import draw

# How many of every 600 texts are of each kind.
KINDS = {
    "email": 100, "ticket": 80, "payslip": 60, "contract": 60, "chat": 80, "csv": 60, "code": 60,
    "catalan": 60, "trap": 40,
}
CYCLE = sum(KINDS.values())

# Pieces of each kind.  A plain string is text; a tuple is (builder, label or None for text that
# is not annotated, place): values in different places differ.
TEXTS = {
    "email": (
        "Buenos días:\n\nLa factura del último trimestre ha llegado sin desglosar. Consta a nombre de ",
        ("first_name", None, 0), " ", ("surname", None, 0), ", documento ", ("dni", "ES_DNI", 0),
        ", y la copia corregida puede ir a ", ("email", "EMAIL", 0),
        ". Para cualquier duda, contesto en el ", ("phone", "PHONE", 0), ".\n\nUn saludo",
    ),
    "ticket": (
        "Revisión ", ("four", None, 0), " (caldera sin presión)\nLlamar antes al ", ("phone", "PHONE", 0),
        " o por escrito a ", ("email", "EMAIL", 0), "\nInstalada en ", ("address", "ADDRESS", 0),
        "\nVisita por la tarde, si es posible.",
    ),
    "payslip": (
        "Recibo de haberes\nCobra ", ("first_name", None, 0), " ", ("surname", None, 0), " [",
        ("dni", "ES_DNI", 0), "]\nPaga ", ("company", None, 0), " [", ("cif", "ES_CIF", 0),
        "]\nSe abona en ", ("iban_es", "IBAN", 0), "\nCotiza con el número ", ("nss", "ES_NSS", 0),
        "\nNeto: ", ("amount", None, 0), " euros",
    ),
    "contract": (
        "Alquiler de temporada. Ocupa la vivienda de ", ("address", "ADDRESS", 0), " quien firma abajo: ",
        ("first_name", None, 0), " ", ("surname", None, 0), ", nacimiento el ",
        ("birth_date", "DATE_OF_BIRTH", 0), ", identificación ", ("nie", "ES_NIE", 0),
        ". La renta se carga cada mes en ", ("ccc", "ES_CCC", 0), ", sin fianza.",
    ),
    "chat": (
        "> el paquete sale como devuelto\n< vaya, ¿con qué se pagó?\n> con esta: ",
        ("card", "CREDIT_CARD", 0), "\n< gracias, ¿y a qué número avisamos?\n> ", ("phone", "PHONE", 0),
        "\n< anotado, en un rato hay respuesta",
    ),
    "csv": (
        "correo;documento;persona;contacto\n",
        *(
            part
            for row in range(3)
            for part in (
                ("email", "EMAIL", row), ";", ("dni", "ES_DNI", row), ";", ("surname", None, row),
                ", ", ("first_name", None, row), ";", ("phone", "PHONE", row), "\n",
            )
        ),
    ),
    "code": (
        'open_session(origin="', ("ip", "IP", 0), '")\nsend_receipt(to="', ("email", "EMAIL", 0),
        '")\ntransfer(account="', ("iban_es", "IBAN", 0), '", euros=75)\n',
    ),
    "catalan": (
        "Hola,\n\nViatjo amb pasaporte ", ("passport", "ES_PASSPORT", 0), ", document ",
        ("dni", "ES_DNI", 0), ", i condueixo un cotxe amb matrícula ", ("plate", "ES_PLATE", 0),
        ".\nAra tinc casa al ", ("font", "ADDRESS", 0), ".\nAtentament, ", ("first_name", None, 0),
    ),
    "trap": (
        "Albarán ", ("eight", None, 0), ", lote ", ("six", None, 0), ", emitido el ",
        ("invoice_date", None, 0), ". La clave ", ("wrong_dni", None, 0),
        " parece un documento y no lo es. Titular ", ("nif_klm", "ES_NIF", 0), ". Se recoge en ",
        ("address", "ADDRESS", 0), ".",
    ),
}
PLACE_STEP = 1009  # the seed of a value's n-th place in its text

_OTHERS = {
    "four": lambda s: (draw(s, 80, 9000) + 1000).cast("string"),
    "company": lambda s: builders.pick(s, 81, builders.COMPANIES),
    "amount": lambda s: (draw(s, 82, 2601) + 900).cast("string"),
    "font": lambda s: F.concat(
        F.lit("Carrer de la Font "), (draw(s, 83, 90) + 1).cast("string")
    ),
    "eight": lambda s: builders.digits(s, 84, 8),
    "six": lambda s: builders.digits(s, 85, 6),
    "invoice_date": lambda s: F.concat(
        F.lpad((draw(s, 86, 28) + 1).cast("string"), 2, "0"),
        F.lit("/"),
        F.lpad((draw(s, 87, 12) + 1).cast("string"), 2, "0"),
        F.lit("/2025"),
    ),
}


def value(name: str, seed: Column) -> Column:
    return (_OTHERS.get(name) or getattr(builders, name))(seed)


def kind_of(key: Column) -> Column:
    out, below = None, 0
    for kind, count in KINDS.items():
        below += count
        test = key % CYCLE < below
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def _pieces(kind: str, seed: Column) -> Column:
    return F.array(
        *[
            F.struct(F.lit(p).alias("piece"), F.lit(None).cast("string").alias("label"))
            if isinstance(p, str)
            else F.struct(
                value(p[0], seed + p[2] * PLACE_STEP).alias("piece"),
                F.lit(p[1]).cast("string").alias("label"),
            )
            for p in TEXTS[kind]
        ]
    )


def gold_of(pieces: Column) -> Column:
    """array<struct<start,end,label>> of the labelled pieces, by the length of what is before."""
    kind = "array<struct<start:int,end:int,label:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("gold"))

    def step(acc, p):
        end = acc["at"] + F.length(p["piece"])
        here = F.struct(acc["at"].alias("start"), end.alias("end"), p["label"].alias("label"))
        gold = F.when(p["label"].isNull(), acc["gold"]).otherwise(
            F.concat(acc["gold"], F.array(here))
        )
        return F.struct(end.alias("at"), gold.alias("gold"))

    return F.aggregate(pieces, start, step, lambda acc: acc["gold"])


def corpus(keys: DataFrame, key: str) -> DataFrame:
    """corpus(key, name, kind, text, annotations): one planted text per key."""
    seed = F.col(key)
    kinded = keys.select(seed, kind_of(seed).alias("kind"))
    out = None
    for kind in KINDS:
        test = F.col("kind") == kind
        pieces = _pieces(kind, seed)
        out = F.when(test, pieces) if out is None else out.when(test, pieces)
    return kinded.withColumn("_pieces", out).select(
        key,
        F.concat_ws("-", "kind", seed.cast("string")).alias("name"),
        "kind",
        F.array_join(F.transform("_pieces", lambda p: p["piece"]), "").alias("text"),
        gold_of(F.col("_pieces")).alias("annotations"),
    )


def gold_table(documents: DataFrame, keys) -> DataFrame:
    """gold(keys, start, end, label): one row per annotation."""
    return (
        documents.select(*keys, F.explode_outer("annotations").alias("a"))
        .filter("a is not null")
        .select(*keys, "a.*")
    )
