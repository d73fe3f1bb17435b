"""The planted values of the corpus, stated in SQL: what the oracles expect, by arithmetic."""

from __future__ import annotations

from velaria.functions import builders as b, tables
from velaria.sources import corpus


def draw(s, k, size):
    return (
        f"((({s}) % 1000003) * {7919 + 104729 * k} + {15485863 * k} + 97 * (({s}) % 7919)) % {size}"
    )


def digits(s, k, count):
    return f"lpad(cast({draw(s, k, 10**count)} as varchar), {count}, '0')"


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def pick(s, k, options):
    listed = ", ".join(quoted(o) for o in options)
    return f"([{listed}])[cast({draw(s, k, len(options))} as int) + 1]"


def dni_letter(number):
    return f"substr('{tables.DNI_LETTERS}', cast(cast({number} as bigint) % 23 as int) + 1, 1)"


def luhn_sum(number):
    one = f"cast(substr(reverse({number}), i + 1, 1) as int)"
    doubled = f"(2 * {one} - case when {one} > 4 then 9 else 0 end)"
    return (
        f"(list_sum(list_transform(range(length({number})), "
        f"lambda i: case when i % 2 = 0 then {one} else {doubled} end)) % 10)"
    )


def luhn_digit(number):
    return f"((10 - {luhn_sum(f'({number} || chr(48))')}) % 10)"


def ccc_control(ten):
    terms = " + ".join(
        f"cast(substr({ten}, {i}, 1) as int) * {w}" for i, w in enumerate(tables.CCC_WEIGHTS, 1)
    )
    rest = f"(({terms}) % 11)"
    return f"(case when {rest} < 2 then {rest} else 11 - {rest} end)"


def weighted(number, weights):
    return " + ".join(
        f"cast(substr({number}, {i}, 1) as int) * {w}" for i, w in enumerate(weights, 1)
    )


def mod11_10_digit(body):
    """The control digit of ISO 7064 mod 11,10 after `body`."""
    step = "(((case when p = 0 then 10 else p end) * 2) % 11 + c) % 10"
    rest = (
        f"list_reduce(list_prepend(5, list_transform(string_split({body}, ''), lambda d: cast(d as int))), "
        f"lambda p, c: {step})"
    )
    return f"((11 - ((case when {rest} = 0 then 10 else {rest} end) * 2) % 11) % 10)"


def dni(s):
    n = digits(s, 1, 8)
    return (
        f"(case {draw(s, 2, 4)} when 3 then substr({n}, 1, 2) || '.' || substr({n}, 3, 3) || '.' || substr({n}, 6, 3) "
        f"else {n} end || {pick(s, 2, ('', ' ', '-', ''))} || {dni_letter(n)})"
    )


def wrong_dni(s):
    n = digits(s, 3, 8)
    place = f"cast((cast({n} as bigint) + 1 + {draw(s, 4, 22)}) % 23 as int) + 1"
    return (
        f"(substr({n}, 1, 2) || '.' || substr({n}, 3, 3) || '.' || substr({n}, 6, 3) || '-' || "
        f"substr('{tables.DNI_LETTERS}', {place}, 1))"
    )


def nie(s):
    first, body, sign = draw(s, 5, 3), digits(s, 6, 7), pick(s, 7, ("", "-", " "))
    letter = dni_letter(f"(cast({first} as varchar) || {body})")
    return f"(substr('XYZ', cast({first} + 1 as int), 1) || {sign} || {body} || {sign} || {letter})"


def nif_klm(s):
    body = digits(s, 8, 7)
    return f"({pick(s, 9, 'KLM')} || {body} || {dni_letter(body)})"


def cif(s):
    letter, body = pick(s, 10, tables.CIF_ORGANISATIONS), digits(s, 11, 7)
    check = luhn_digit(body)
    return (
        f"({letter} || {body} || case when {letter} in ('P','Q','R','S','N','W') "
        f"then substr('{tables.CIF_LETTERS}', cast({check} as int) + 1, 1) else cast({check} as varchar) end)"
    )


def nss(s):
    province, number = f"({draw(s, 12, 52)} + 1)", f"({draw(s, 13, 10**8)})"
    control = (
        f"(case when {number} < 10000000 then ({number} + {province} * 10000000) % 97 "
        f"else ({province} * 100000000 + {number}) % 97 end)"
    )
    sep = pick(s, 14, (" ", "/", ""))
    return (
        f"(lpad(cast({province} as varchar), 2, '0') || {sep} || lpad(cast({number} as varchar), 8, '0') "
        f"|| {sep} || lpad(cast({control} as varchar), 2, '0'))"
    )


def account(s, k):
    bank, own = digits(s, k, 8), digits(s, k + 1, 10)
    first = ccc_control(f"('00' || {bank})")
    return f"({bank} || cast({first} as varchar) || cast({ccc_control(own)} as varchar) || {own})"


def ccc(s):
    n = account(s, 15)
    return (
        f"(case when {draw(s, 17, 2)} = 0 then {n} else substr({n}, 1, 4) || ' ' || substr({n}, 5, 4) "
        f"|| ' ' || substr({n}, 9, 2) || ' ' || substr({n}, 11, 10) end)"
    )


def fours(n, count):
    return " || ' ' || ".join(f"substr({n}, {1 + 4 * i}, 4)" for i in range(count))


def iban_es(s):
    own = account(s, 18)
    check = f"(98 - cast({own} || '142800' as hugeint) % 97)"
    n = f"('ES' || lpad(cast({check} as varchar), 2, '0') || {own})"
    return f"(case when {draw(s, 20, 2)} = 0 then {n} else {fours(n, 6)} end)"


def card(s):
    head = pick(s, 21, tuple(b.CARD_HEADS))
    size = f"(case when {head} = '34' then 15 else 16 end)"
    body = f"({head} || substr({digits(s, 22, 14)}, 1, {size} - length({head}) - 1))"
    n = f"({body} || cast({luhn_digit(body)} as varchar))"
    return f"(case when {draw(s, 23, 3)} = 0 then {n} else {fours(n, 4)} end)"


def phone(s):
    n = f"({pick(s, 24, ('61', '72', '94', '98', '85'))} || {digits(s, 25, 7)})"
    return (
        f"({pick(s, 27, ('', '+34 ', '0034 '))} || case {draw(s, 26, 3)} when 0 then {n} "
        f"when 1 then substr({n}, 1, 3) || '.' || substr({n}, 4, 3) || '.' || substr({n}, 7, 3) "
        f"else substr({n}, 1, 3) || ' ' || substr({n}, 4, 2) || ' ' || substr({n}, 6, 2) || ' ' || substr({n}, 8, 2) end)"
    )


def first_name(s):
    return pick(s, 27, b.FIRST_NAMES)


def surname(s):
    return pick(s, 28, b.SURNAMES)


def email(s):
    local = f"translate(lower({pick(s, 30, b.SURNAMES)} || '_' || {pick(s, 29, b.FIRST_NAMES)}), '{b.ACCENTS}', '{b.PLAIN}')"
    return f"({local} || cast({draw(s, 31, 99)} + 1 as varchar) || '@' || {pick(s, 32, b.DOMAINS)})"


def address(s):
    return (
        f"({pick(s, 33, b.STREETS)} || ' ' || cast({draw(s, 34, 120)} + 1 as varchar) || "
        f"case when {draw(s, 39, 2)} = 0 then ', ' || cast({draw(s, 35, 9)} + 1 as varchar) || 'º ' || "
        f"{pick(s, 36, 'ABCD')} else '' end || case when {draw(s, 40, 2)} = 0 then ', ' || "
        f"lpad(cast({draw(s, 37, 52)} + 1 as varchar), 2, '0') || {digits(s, 38, 3)} else '' end)"
    )


def birth_date(s):
    day, month, year = f"({draw(s, 41, 28)} + 1)", f"({draw(s, 42, 12)} + 1)", f"({draw(s, 43, 66)} + 1940)"
    return (
        f"(case when {draw(s, 44, 10)} < 7 then lpad(cast({day} as varchar), 2, '0') || '/' || "
        f"lpad(cast({month} as varchar), 2, '0') || '/' || cast({year} as varchar) else cast({day} as varchar) "
        f"|| ' de ' || {pick(s, 42, b.MONTH_NAMES)} || ' de ' || cast({year} as varchar) end)"
    )


def passport(s):
    return "(" + " || ".join(pick(s, 45 + i, b.PASSPORT_LETTERS) for i in range(3)) + f" || {digits(s, 48, 6)})"


def plate(s):
    return f"({digits(s, 49, 4)} || ' ' || " + " || ".join(
        pick(s, 50 + i, b.PLATE_LETTERS) for i in range(3)
    ) + ")"


def ip(s):
    return f"('192.0.2.' || cast({draw(s, 53, 254)} + 1 as varchar))"


def pt_nif(s):
    body = f"(cast({draw(s, 54, 9)} + 1 as varchar) || {digits(s, 55, 7)})"
    rest = f"(({weighted(body, range(9, 1, -1))}) % 11)"
    return f"({body} || cast(case when {rest} < 2 then 0 else 11 - {rest} end as varchar))"


def fr_nir(s):
    body = f"(cast({draw(s, 56, 2)} + 1 as varchar) || {digits(s, 57, 12)})"
    return f"({body} || lpad(cast(97 - cast({body} as bigint) % 97 as varchar), 2, '0'))"


def de_vat(s):
    body = f"(cast({draw(s, 58, 9)} + 1 as varchar) || {digits(s, 59, 7)})"
    return f"('DE' || {body} || cast({mod11_10_digit(body)} as varchar))"


def de_idnr(s):
    nine = f"substr('123456789123456789', cast({draw(s, 60, 9)} as int) + 1, 9)"
    body = f"({nine} || substr({nine}, cast({draw(s, 61, 9)} as int) + 1, 1))"
    return f"({body} || cast({mod11_10_digit(body)} as varchar))"


def codice_fiscale(s):
    letters = " || ".join(pick(s, 62 + i, "BCDFGLMNPRSTVZ") for i in range(6))
    head = (
        f"({letters} || lpad(cast({draw(s, 68, 80)} + 20 as varchar), 2, '0') || "
        f"{pick(s, 69, tables.CODICE_MONTHS)} || "
        f"lpad(cast({draw(s, 70, 28)} + 1 + 40 * ({draw(s, 71, 2)}) as varchar), 2, '0') || "
        f"{pick(s, 72, 'ABCDEFGHL')} || {digits(s, 73, 3)})"
    )
    keys = "".join(tables.CODICE_ODD_VALUES)
    values = ", ".join(map(str, tables.CODICE_ODD_VALUES.values()))
    total = (
        f"list_sum(list_transform(range(15), lambda i: case when i % 2 = 0 "
        f"then ([{values}])[strpos('{keys}', substr({head}, i + 1, 1))] "
        f"else (strpos('{keys}', substr({head}, i + 1, 1)) - 1) % 10 "
        f"+ case when strpos('{keys}', substr({head}, i + 1, 1)) > 20 then "
        f"10 * ((strpos('{keys}', substr({head}, i + 1, 1)) - 11) // 10) else 0 end end))"
    )
    return f"({head} || chr(65 + cast({total} % 26 as int)))"


OTHERS = {
    "four": lambda s: f"cast({draw(s, 80, 9000)} + 1000 as varchar)",
    "company": lambda s: pick(s, 81, b.COMPANIES),
    "amount": lambda s: f"cast({draw(s, 82, 2601)} + 900 as varchar)",
    "font": lambda s: f"('Carrer de la Font ' || cast({draw(s, 83, 90)} + 1 as varchar))",
    "eight": lambda s: digits(s, 84, 8),
    "six": lambda s: digits(s, 85, 6),
    "invoice_date": lambda s: (
        f"(lpad(cast({draw(s, 86, 28)} + 1 as varchar), 2, '0') || '/' || "
        f"lpad(cast({draw(s, 87, 12)} + 1 as varchar), 2, '0') || '/2025')"
    ),
}


def value(name, s):
    return (OTHERS.get(name) or globals()[name])(s)


def pieces_of(kind, s):
    """[(sql of the piece, label)] of one kind of text."""
    return [
        (quoted(p), None) if isinstance(p, str) else (value(p[0], f"({s} + {p[2] * corpus.PLACE_STEP})"), p[1])
        for p in corpus.TEXTS[kind]
    ]


def corpus_cte(source, key):
    """CTEs `piece(key, kind, ord, piece, label)`, `texts(key, kind, text)` and `gold(key, kind, start, end, label)`."""
    parts, low = [], 0
    for kind, count in corpus.KINDS.items():
        rows = ", ".join(
            f"{{'piece': {sql}, 'label': {'null' if label is None else quoted(label)}::varchar}}"
            for sql, label in pieces_of(kind, key)
        )
        parts.append(
            f"select {key} as key, '{kind}' as kind, unnest(range({len(corpus.TEXTS[kind])})) as ord, "
            f"unnest([{rows}]) as p from {source} where {key} % {corpus.CYCLE} between {low} and {low + count - 1}"
        )
        low += count
    return (
        "piece as (select key, kind, ord, p.piece as piece, p.label as label from ("
        + " union all ".join(parts)
        + ")), placed as (select *, coalesce(sum(length(piece)) over (partition by key order by ord "
        "rows between unbounded preceding and 1 preceding), 0)::int as start from piece), "
        "texts as (select key, kind, string_agg(piece, '' order by ord) as text from piece group by all), "
        "gold as (select key, kind, start, (start + length(piece))::int as \"end\", label, piece as value "
        "from placed where label is not null)"
    )
