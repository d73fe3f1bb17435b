"""Format-preserving pseudonyms for numbers, dates and addresses in texts, by keyed Feistel permutations in
DataFrame operations only.

Each kind of value has a domain whose size is a product; a Feistel network with modular addition and a
keyed SHA-256 round function permutes that domain exactly, so different values stay different, equal values
stay equal in all documents, and whoever has the key can go back.

* account numbers of 13 to 19 digits: all digits; where the check digit is right (Luhn), the others are
  permuted and it is computed anew
* telephone and social security numbers: all digits but the country code, the layout stays
* dates of the years 1800 to 2199 that exist: the 146,097 days of that cycle, 189 x 773
* IPv4 addresses with octets up to 255: 2^16 x 2^16
* e-mail addresses: the part before the @ becomes a keyed digest of fixed length

Null stays null, an empty text empty; repeated rows get equal results and an empty table an empty one.
Input columns named like results give way.  The key is part of the plan: keep plans as private as it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from velaria.llm import common

ROUNDS = 8
FIRST_DAY, CYCLE = "1800-01-01", (189, 773)
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
ADDRESS = rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?!\w|\.\d)"
PHONE = r"(?<![\w+])(?:\+[0-9]{1,3} ?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?!\w|-\d)"
SOCIAL = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
ISO = r"(?<![\w-])(?:1[89]|2[01])[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![\w-])"
LITTLE = r"(?<![\w./-])(?:0?[1-9]|[12][0-9]|3[01])[./](?:0?[1-9]|1[0-2])[./](?:1[89]|2[01])[0-9]{2}(?![\w/-])"
ACCOUNT = r"(?<![0-9A-Za-z_])(?:[0-9][ -]?){12,18}[0-9](?![0-9A-Za-z_])"
KINDS = [("email", EMAIL), ("address", ADDRESS), ("iso_date", ISO), ("date", LITTLE), ("social", SOCIAL), ("phone", PHONE), ("account", ACCOUNT)]
#: Any found value has one of these; most texts have none and are not searched further.
HINT = r"@|[0-9][^0-9A-Za-z]{0,2}[0-9]"
ANY = "|".join(f"(?:{p})" for _, p in KINDS)


def bind(value: Column, make: Callable[[Column], Column]) -> Column:
    """`make(value)`, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _round(key: str, label: str, i: Column, value: Column) -> Column:
    """A keyed function of 60 bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), i.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: str, label: str, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """Permutes pairs (a, b) of a below size_a and b below size_b, each of at most ten digits."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(pair: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, size_a).otherwise(size_b).cast("long")
        return F.struct(pair["b"].alias("a"), ((pair["a"] + _round(key, label, i, pair["b"]) % size) % size).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def digits(key: str, value: Column) -> Column:
    """A permutation of the digit strings of each length from 2 to 20."""
    n = F.length(value)
    head = (n / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    pair = feistel(
        key, "digits", value.substr(F.lit(1), head).cast("long"), value.substr(head + 1, n - head).cast("long"), ten(head), ten(n - head)
    )
    return bind(pair, lambda x: F.concat(F.lpad(x["a"].cast("string"), head, "0"), F.lpad(x["b"].cast("string"), n - head, "0")))


def _luhn(payload: Column) -> Column:
    """The digit that a payload needs after it."""
    places = F.sequence(F.lit(1), F.length(payload))

    def add(total: Column, i: Column) -> Column:
        d = payload.substr(F.length(payload) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return ((10 - F.aggregate(places, F.lit(0), add) % 10) % 10).cast("string")


def _laid_out(layout: Column, value: Column) -> Column:
    """The digits of `value` in the places of the digits of `layout`."""
    return bind(value, lambda v: _woven(layout, v))


def _woven(layout: Column, value: Column) -> Column:
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(done: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(done["out"], F.when(digit, value.substr(done["at"], F.lit(1))).otherwise(c)).alias("out"),
            (done["at"] + digit.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(layout, ""), start, step)["out"]


def _day(key: str, day: Column) -> Column:
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    pair = feistel(key, "days", (n / CYCLE[1]).cast("long"), n % CYCLE[1], F.lit(CYCLE[0]), F.lit(CYCLE[1]))
    return bind(pair, lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), (x["a"] * CYCLE[1] + x["b"]).cast("int")))


def pseudonym(key: str, value: Column) -> Column:
    """The pseudonym of one found value; a value that is not valid in its format stays."""
    only = F.regexp_replace(value, "[^0-9]", "")
    head, check = only.substr(F.lit(1), F.length(only) - 1), only.substr(F.length(only), F.lit(1))
    account = F.when(_luhn(head) == check, bind(digits(key, head), lambda p: F.concat(p, _luhn(p)))).otherwise(digits(key, only))
    code = F.regexp_extract(value, r"^(?:\+[0-9]{1,3} ?)?", 0)
    rest = value.substr(F.length(code) + 1, F.length(value))
    phone = F.concat(code, _laid_out(rest, digits(key, F.regexp_replace(rest, "[^0-9]", ""))))
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    pair = bind(octets, lambda x: feistel(key, "ipv4", x[0] * 256 + x[1], x[2] * 256 + x[3], F.lit(65536), F.lit(65536)))
    four = lambda x: [F.shiftright(x["a"], 8), x["a"] % 256, F.shiftright(x["b"], 8), x["b"] % 256]
    address = bind(pair, lambda x: F.concat_ws(".", *[o.cast("string") for o in four(x)]))
    iso = F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("date")
    sign = F.regexp_extract(value, "[./]", 0)
    plain = F.translate(value, "/", ".")
    little = F.try_to_timestamp(plain, F.lit("d.M.yyyy")).cast("date")
    written = lambda d: F.concat(F.date_format(d, "dd"), sign, F.date_format(d, "MM"), sign, F.date_format(d, "yyyy"))
    local = F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(value)), 256), 1, 12)
    # The pattern of each kind, without what stands around it.
    return (
        F.when(F.instr(value, "@") > 0, F.concat(F.lit("p"), local, F.lit("@"), F.substring_index(value, "@", -1)))
        .when(value.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), address)
        .when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.coalesce(F.date_format(_day(key, iso), "yyyy-MM-dd"), value))
        .when(
            value.rlike(r"^[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}$"),
            F.coalesce(bind(_day(key, little), written), value),
        )
        .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _laid_out(value, digits(key, only)))
        .when(value.rlike(r"^(\+[0-9]{1,3} ?)?(\([0-9]{2,4}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}$"), phone)
        .otherwise(_laid_out(value, account))
    )


def pseudonymise(df: DataFrame, key: str, text: str = "text", out: str = "text") -> DataFrame:
    """Rows with `out` in place of the text and `n_values`, the number of values found."""
    kept, _ = common.added(df.drop(text).schema if out != text else df.schema, f"`{out}` string, n_values long")
    body = F.col(f"`{text}`")
    kept = [c for c in kept if c.lower() != out.lower()]
    found = df.select(*[F.col(f"`{c}`") for c in kept], body.alias("__body"), F.when(body.rlike(HINT), F.regexp_extract_all(body, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>")).alias("__found"))
    gaps = F.split("__body", ANY, -1)
    # Values and gaps take turns; there is one gap more.
    woven = F.zip_with(gaps, F.transform("__found", lambda v: pseudonym(key, v)), lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
    return found.select(
        *[F.col(f"`{c}`") for c in kept],
        F.when(F.size("__found") > 0, F.array_join(woven, "")).otherwise(F.col("__body")).alias(out),
        F.when(F.col("__body").isNull(), F.lit(0)).otherwise(F.size("__found")).cast("long").alias("n_values"),
    )
