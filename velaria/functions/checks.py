"""Check-digit tests as column expressions: any formatting in, true or false out, never an error.

They hold no state and no Python, so they run inside whole-stage code or inside the folds over a
row's candidates.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from velaria.functions import tables
from velaria.functions.spans import let


def compact_id(value: Column) -> Column:
    """Spaces, dots, hyphens, slashes and line breaks removed, upper case."""
    return F.upper(F.translate(value, " .-/\r\n", ""))


def is_ascii_digits(value: Column) -> Column:
    return F.rlike(value, F.lit(r"\A[0-9]+\z"))


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _shape(number: Column, pattern: str) -> Column:
    return F.rlike(number, F.lit(rf"\A(?:{pattern})\z"))


def _part(number: Column, first: int, size: int) -> Column:
    return F.substring(number, first, size)


def _int(digits: Column) -> Column:
    return digits.try_cast("bigint")


def _digit(number: Column, place: int) -> Column:
    return _int(_part(number, place, 1))


def _weighted(number: Column, weights, first: int = 1) -> Column:
    """Sum of digit times weight, the first weight at character `first`."""
    return reduce(
        lambda a, b: a + b,
        [_digit(number, first + i) * w for i, w in enumerate(weights) if w],
    )


def _checked(number: Column, shape: str, test: Column) -> Column:
    """The arithmetic is only evaluated for values of the right shape."""
    return _sure(F.when(_shape(number, shape), test).otherwise(False))


def dni_letter(digits: Column) -> Column:
    return F.substring(F.lit(tables.DNI_LETTERS), (_int(digits) % 23 + 1).cast("int"), F.lit(1))


def dni(value: Column) -> Column:
    def test(n):
        return _checked(n, r"[0-9]{8}[\s\S]", _part(n, 9, 1) == dni_letter(_part(n, 1, 8)))

    return let(compact_id(value), test)


def nie(value: Column) -> Column:
    def test(n):
        digits = F.translate(_part(n, 1, 8), "XYZ", "012")
        return _checked(n, r"[XYZ][0-9]{7}[\s\S]", _part(n, 9, 1) == dni_letter(digits))

    return let(compact_id(value), test)


def nif_klm(value: Column) -> Column:
    def test(n):
        return _checked(n, r"[KLM][0-9]{7}[\s\S]", _part(n, 9, 1) == dni_letter(_part(n, 2, 7)))

    return let(compact_id(value), test)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum mod 10: every second digit from the right counts as the digits of its double."""
    backwards = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(
            backwards,
            lambda d, i: F.when(i % 2 == 0, d)
            .otherwise(F.translate(d, "0123456789", "0246813579"))
            .try_cast("int"),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    return total % 10


def luhn_check_digit(digits: Column) -> Column:
    return (10 - luhn_sum(F.concat(digits, F.lit("0")))) % 10


def luhn(value: Column) -> Column:
    def test(n):
        return _checked(n, r"[0-9]{2,}", luhn_sum(n) == 0)

    return let(compact_id(value), test)


def cif(value: Column) -> Column:
    def test(n):
        check = luhn_check_digit(_part(n, 2, 7))
        letter = F.substring(F.lit(tables.CIF_LETTERS), (check + 1).cast("int"), F.lit(1))
        return _checked(
            n,
            rf"[{tables.CIF_ORGANISATIONS}][0-9]{{7}}[\s\S]",
            (_part(n, 9, 1) == check.cast("string")) | (_part(n, 9, 1) == letter),
        )

    return let(compact_id(value), test)


def nss_control(province: Column, number: Column) -> Column:
    return F.when(number < 10**7, (number + province * 10**7) % 97).otherwise(
        (province * 10**8 + number) % 97
    )


def nss(value: Column) -> Column:
    def test(n):
        control = nss_control(_int(_part(n, 1, 2)), _int(_part(n, 3, 8)))
        return _checked(n, r"[0-9]{12}", _int(_part(n, 11, 2)) == control)

    return let(compact_id(value), test)


def ccc_control(ten_digits: Column) -> Column:
    rest = _weighted(ten_digits, tables.CCC_WEIGHTS) % 11
    return F.when(rest < 2, rest).otherwise(11 - rest)


def ccc(value: Column) -> Column:
    def test(n):
        bank = ccc_control(F.concat(F.lit("00"), _part(n, 1, 8)))
        account = ccc_control(_part(n, 11, 10))
        return _checked(n, r"[0-9]{20}", _int(_part(n, 9, 2)) == bank * 10 + account)

    return let(compact_id(value), test)


def mod97(digits: Column) -> Column:
    """A number of any length modulo 97, nine digits at a time."""
    chunks = F.regexp_extract_all(digits, F.lit(r"[0-9]{1,9}"), F.lit(0))
    return F.aggregate(
        chunks,
        F.lit(0).cast("bigint"),
        lambda rest, c: (rest * F.pow(F.lit(10), F.length(c)).cast("bigint") + _int(c)) % 97,
    )


def _letters_as_numbers(text: Column) -> Column:
    """Each capital as 10..35."""
    return reduce(
        lambda t, i: F.replace(t, F.lit(chr(65 + i)), F.lit(str(10 + i))), range(26), text
    )


_PARTS = re.compile(r"(\d+)([nac])")
_CLASS = {"n": "[0-9]", "a": "[A-Z]", "c": "[A-Za-z0-9]"}


def iban_length_of(country: Column) -> Column:
    """Total length for a country of the registry, else null."""
    sizes = {
        code: 4 + sum(int(count) for count, _ in _PARTS.findall(parts))
        for code, parts in tables.IBAN_STRUCTURES.items()
    }
    by_size: dict[int, list[str]] = {}
    for code, size in sizes.items():
        by_size.setdefault(size, []).append(code)
    out = None
    for size, codes in sorted(by_size.items()):
        test = country.isin(codes)
        out = F.when(test, size) if out is None else out.when(test, size)
    return out


def iban_pattern() -> str:
    """One alternative per country: its letters, two check digits and its account structure."""
    shapes: dict[str, list[str]] = {}
    for code, parts in tables.IBAN_STRUCTURES.items():
        body = "".join(f"{_CLASS[kind]}{{{count}}}" for count, kind in _PARTS.findall(parts))
        shapes.setdefault(body, []).append(code)
    return "|".join(f"(?:{'|'.join(codes)})[0-9]{{2}}{body}" for body, codes in shapes.items())


def iban(value: Column) -> Column:
    def test(n):
        turned = F.concat(F.substring(n, F.lit(5), F.length(n)), _part(n, 1, 4))
        control = mod97(_letters_as_numbers(turned)) == 1
        spanish = F.when(_part(n, 1, 2) != "ES", True).otherwise(ccc(_part(n, 5, 20)))
        return _checked(n, iban_pattern(), control & spanish)

    return let(compact_id(value), test)


def card_prefix(digits: Column) -> Column:
    """Numbers of a known card issuer."""
    two, three, four = (_int(_part(digits, 1, size)) for size in (2, 3, 4))
    return _checked(
        digits,
        r"[0-9]{4,}",
        (_part(digits, 1, 1) == "4")
        | two.between(51, 55)
        | four.between(2221, 2720)
        | two.isin(34, 36, 37, 38, 62, 65)
        | (four == 6011)
        | three.between(644, 649)
        | four.between(3528, 3589)
        | three.between(300, 305),
    )


def real_date(day: Column, month: Column, year: Column) -> Column:
    """A calendar date; a two-digit year may be in the 1900s or the 2000s."""

    def valid(full_year):
        text = F.concat_ws("-", F.lpad(full_year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
        return F.when(_shape(text, r"[0-9]{4}-[0-9]{2}-[0-9]{2}") & (_int(full_year) > 0),
                      F.try_to_date(text, "yyyy-MM-dd").isNotNull()).otherwise(False)

    short = valid(F.concat(F.lit("19"), year)) | valid(F.concat(F.lit("20"), year))
    return _sure(F.when(F.length(year) == 4, valid(year)).otherwise(short))


def codice_letter(fifteen: Column) -> Column:
    keys = "".join(tables.CODICE_ODD_VALUES)
    values = list(tables.CODICE_ODD_VALUES.values())
    total = F.aggregate(
        F.transform(
            F.split(fifteen, ""),
            lambda c, i: F.when(i % 2 == 0, _lookup(keys, values, c)).otherwise(_even_value(c)),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    return F.char(F.lit(65) + total % 26)


def _lookup(keys: str, values, char: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.instr(F.lit(keys), char))


def _even_value(char: Column) -> Column:
    return F.when(F.rlike(char, F.lit("[0-9]")), char.try_cast("int")).otherwise(
        F.ascii(char) - 65
    )


def codice_fiscale(value: Column) -> Column:
    def test(n):
        digit = f"[0-9{tables.CODICE_OMOCODES}]"
        plain = F.translate(n, tables.CODICE_OMOCODES, "0123456789")
        day = _int(_part(plain, 10, 2)) % 40
        # The month letter stays a letter: only the digit places may hold an omocode.
        month = F.instr(F.lit(tables.CODICE_MONTHS), _part(n, 9, 1)).cast("string")
        born = real_date(day.cast("string"), month, _part(plain, 7, 2))
        return _checked(
            n,
            rf"[A-Z]{{6}}{digit}{{2}}[{tables.CODICE_MONTHS}]{digit}{{2}}[A-Z]{digit}{{3}}[A-Z]",
            born & (_part(n, 16, 1) == codice_letter(_part(n, 1, 15))),
        )

    return let(F.upper(F.translate(value, " .-/\r\n:", "")), test)


def mod11_10(digits: Column) -> Column:
    """ISO 7064 mod 11,10: true when the whole number checks."""
    rest = F.aggregate(
        F.split(digits, ""),
        F.lit(5),
        lambda p, c: (
            F.when(p == 0, 10).otherwise(p) * 2 % 11 + c.try_cast("int")
        ) % 10,
    )
    return rest == 1


def pt_nif(value: Column) -> Column:
    def test(n):
        rest = _weighted(n, range(9, 1, -1)) % 11
        return _checked(n, r"[1-9][0-9]{8}", _digit(n, 9) == F.when(rest < 2, 0).otherwise(11 - rest))

    return let(compact_id(value), test)


def fr_nir(value: Column) -> Column:
    """97 minus the first 13 characters mod 97; Corsican departments 2A and 2B count as 19, 18."""
    def test(n):
        body = F.replace(F.replace(_part(n, 1, 13), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
        return _checked(
            n,
            r"[0-9]{5}(?:[0-9][0-9]|2A|2B)[0-9]{8}",
            _int(_part(n, 14, 2)) == 97 - _int(body) % 97,
        )

    return let(compact_id(value), test)


def de_idnr(value: Column) -> Column:
    """Mod 11,10; among the first ten digits one appears twice or three times, the others once."""
    def test(n):
        ten = F.split(_part(n, 1, 10), "")
        kinds = F.array_distinct(ten)
        repeats = F.transform(kinds, lambda d: F.size(F.filter(ten, lambda x: x == d)))
        many = F.filter(repeats, lambda c: c > 1)
        return _checked(
            n,
            r"[1-9][0-9]{10}",
            (F.size(many) == 1) & F.exists(many, lambda c: c.isin(2, 3)) & mod11_10(n),
        )

    return let(compact_id(value), test)


# --- EU VAT, one public rule per country ------------------------------------------------------


def _sum_digits(value: Column) -> Column:
    return (value / 10).cast("int") + value % 10


def _born(year: Column, month: Column, day: Column) -> Column:
    """A real date of birth, from numbers."""
    return real_date(day.cast("string"), month.cast("string"), F.lpad(year.cast("string"), 4, "0"))


def bg_personal(n: Column) -> Column:
    """Ten digits: a citizen's number with a date of birth, a foreigner's, or another taxpayer's."""
    year, month, day = (_int(_part(n, i, 2)) for i in (1, 3, 5))
    # Months 21 to 32 are of the 1800s, 41 to 52 of the 2000s.
    century = F.when(month > 40, 2000).when(month > 20, 1800).otherwise(1900)
    within = month - F.when(month > 40, 40).when(month > 20, 20).otherwise(0)
    citizen = _born(century + year, within, day) & (
        _weighted(n, (2, 4, 8, 5, 10, 9, 7, 3, 6)) % 11 % 10 == _digit(n, 10)
    )
    foreigner = _weighted(n, (21, 19, 17, 13, 11, 9, 7, 3, 1)) % 10 == _digit(n, 10)
    other = (11 - _weighted(n, (4, 3, 2, 7, 6, 5, 4, 3, 2)) % 11) % 11 == _digit(n, 10)
    return citizen | foreigner | other


def birth_number(n: Column) -> Column:
    """Czech and Slovak birth numbers: nine digits up to 1953, ten with a check digit from 1954 on."""
    two, month, day = (_int(_part(n, i, 2)) for i in (1, 3, 5))
    ten = F.length(n) == 10
    year = F.when(ten, F.when(two < 54, two + 2000).otherwise(two + 1900)).otherwise(
        F.when(two >= 80, two + 1800).otherwise(two + 1900)
    )
    rest = _int(_part(n, 1, 9)) % 11
    checked = F.when(year < 1985, rest % 10).otherwise(rest) == _digit(n, 10)
    # Women's months are 50 higher; 20 more once a day's numbers are used up.
    return _born(year, month % 50 % 20, day) & F.when(ten, checked).otherwise(year <= 1953)


def lv_personal(n: Column) -> Column:
    """Eleven digits: date of birth and century, or 32 and no date."""
    day, month, two = (_int(_part(n, i, 2)) for i in (1, 3, 5))
    dated = _born(1800 + 100 * _digit(n, 7) + two, month, day)
    check = (1 + _weighted(n, (10, 5, 8, 4, 2, 1, 6, 3, 7, 9))) % 11 % 10 == _digit(n, 11)
    return (n.startswith("32") | dated) & check


def ro_personal(n: Column) -> Column:
    """Thirteen digits: sex and century, date of birth, county, number, check digit."""
    sign, two, month, day = _digit(n, 1), _int(_part(n, 2, 2)), _int(_part(n, 4, 2)), _int(_part(n, 6, 2))
    century = F.when(sign.isin(3, 4), 1800).when(sign.isin(5, 6), 2000).otherwise(1900)
    county = _int(_part(n, 8, 2))
    placed = county.between(1, 48) | county.isin(51, 52, 70) | county.between(80, 83)
    rest = _weighted(n, (2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9)) % 11
    return _born(century + two, month, day) & placed & (F.when(rest == 10, 1).otherwise(rest) == _digit(n, 13))


def vat_body_is_valid(country: Column, n: Column) -> Column:
    """`n` is the number after the country letters: company, personal and government forms."""

    def d(i):
        return _digit(n, i)

    at = d(2) + _sum_digits(d(3) * 2) + d(4) + _sum_digits(d(5) * 2) + d(6) + _sum_digits(
        d(7) * 2
    ) + d(8)
    be = F.lpad(n, 10, "0")
    bg1 = _weighted(n, range(1, 9)) % 11
    bg2 = _weighted(n, range(3, 11)) % 11 % 10
    cy_odd = F.array(*[F.lit(v) for v in (1, 0, 5, 7, 9, 13, 15, 17, 19, 21)])
    cy = reduce(
        lambda a, b: a + b,
        [
            F.element_at(cy_odd, (d(i) + 1).cast("int")).cast("bigint") if i % 2 else d(i)
            for i in range(1, 9)
        ],
    )
    cz = (11 - _weighted(n, range(8, 1, -1)) % 11) % 10
    cz = F.when(_weighted(n, range(8, 1, -1)) % 11 == 0, 1).otherwise(cz)
    ee = _weighted(n, (3, 7, 1, 3, 7, 1, 3, 7, 1))
    el = _weighted(n, (256, 128, 64, 32, 16, 8, 4, 2)) % 11 % 10
    siren = _part(n, 3, 9)
    fr_signs = F.lit("0123456789ABCDEFGHJKLMNPQRSTUVWXYZ")  # no I, no O
    fr_1, fr_2 = (F.instr(fr_signs, _part(n, i, 1)) - 1 for i in (1, 2))
    fr_key = F.when(fr_1 < 10, fr_1 * 24 + fr_2 - 10).otherwise(fr_1 * 34 + fr_2 - 100)
    ie_total = _weighted(n, range(8, 1, -1))
    ie_extra = F.when(F.length(n) == 9, (F.instr(F.lit("WABCDEFGHI"), _part(n, 9, 1)) - 1) * 9)
    ie_letter = F.substring(
        F.lit("WABCDEFGHIJKLMNOPQRSTUV"),
        ((ie_total + F.coalesce(ie_extra, F.lit(0))) % 23 + 1).cast("int"),
        F.lit(1),
    )
    # The older form has a letter or sign second, and its first digit counts last.
    ie_old = (_weighted(n, range(7, 2, -1), 3) + d(1) * 2) % 23
    cz_special = (8 - (10 - _weighted(n, range(8, 1, -1), 2) % 11) % 11) % 10

    def lt(size):
        first, second = (
            reduce(lambda a, b: a + b, [d(i) * ((i + k) % 9 + 1) for i in range(1, size)]) % 11 for k in (-1, 1)
        )
        return F.when(first == 10, second % 10).otherwise(first) == d(size)

    lu = _int(_part(n, 1, 6)) % 89 == _int(_part(n, 7, 2))
    nl_bsn = (_weighted(n, range(9, 1, -1)) - d(9)) % 11 == 0
    nl_97 = mod97(_letters_as_numbers(F.concat(F.lit("NL"), n))) == 1
    ro = F.lpad(n, 10, "0")
    ro_ok = _weighted(ro, (7, 5, 3, 2, 1, 7, 5, 3, 2)) * 10 % 11 % 10 == _digit(ro, 10)
    si = 11 - _weighted(n, range(8, 1, -1)) % 11
    xi = (_weighted(n, range(8, 1, -1)) + _int(_part(n, 8, 2))) % 97
    rules = {
        "AT": (r"U[0-9]{8}", (10 - (at + 4) % 10) % 10 == d(9)),
        "BE": (
            r"[01]?[0-9]{9}",
            (_int(_part(be, 1, 8)) > 0)
            & (97 - _int(_part(be, 1, 8)) % 97 == _int(_part(be, 9, 2))),
        ),
        "BG": (
            r"[0-9]{9,10}",
            F.when(F.length(n) == 10, bg_personal(n)).otherwise(F.when(bg1 == 10, bg2).otherwise(bg1) == d(9)),
        ),
        "CY": (r"(?!12)[0-9]{8}[A-Z]", F.char(65 + cy % 26) == _part(n, 9, 1)),
        "CZ": (
            r"(?!9)[0-9]{8}|[0-9]{9,10}",
            F.when(F.length(n) == 8, cz == d(8))
            .when((F.length(n) == 9) & n.startswith("6"), cz_special == d(9))
            .otherwise(birth_number(n)),
        ),
        "DE": (r"[1-9][0-9]{8}", mod11_10(n)),
        "DK": (r"[1-9][0-9]{7}", _weighted(n, (2, 7, 6, 5, 4, 3, 2, 1)) % 11 == 0),
        "EE": (r"[0-9]{9}", ee % 10 == 0),
        "EL": (r"[0-9]{9}", el == d(9)),
        "ES": (r"[0-9A-Z][0-9]{7}[0-9A-Z]", dni(n) | nie(n) | nif_klm(n) | cif(n)),
        "FI": (r"[0-9]{8}", _weighted(n, (7, 9, 10, 5, 8, 4, 2, 1)) % 11 == 0),
        "FR": (
            r"[0-9A-HJ-NP-Z]{2}[0-9]{9}",
            (luhn(siren) | siren.startswith("000"))
            & F.when(
                _shape(_part(n, 1, 2), "[0-9]{2}"),
                _int(F.concat(siren, F.lit("12"))) % 97 == _int(_part(n, 1, 2)),
            ).otherwise((_int(siren) + 1 + (fr_key - fr_key % 11) / 11) % 11 == fr_key % 11),
        ),
        "HR": (r"[0-9]{11}", mod11_10(n)),
        "HU": (r"[0-9]{8}", _weighted(n, (9, 7, 3, 1, 9, 7, 3, 1)) % 10 == 0),
        "IE": (
            r"[0-9]{7}[A-W][A-IW]?|[0-9][A-Z+*][0-9]{5}[A-W]",
            F.when(
                _shape(_part(n, 2, 1), "[0-9]"), ie_letter == _part(n, 8, 1)
            ).otherwise(F.substring(F.lit("WABCDEFGHIJKLMNOPQRSTUV"), (ie_old + 1).cast("int"), F.lit(1)) == _part(n, 8, 1)),
        ),
        "IT": (
            r"(?!0000000)[0-9]{7}(?:00[1-9]|0[1-9][0-9]|100|120|121|888|999)[0-9]",
            luhn(n),
        ),
        "LT": (r"[0-9]{7}1[0-9]|[0-9]{10}1[0-9]", F.when(F.length(n) == 12, lt(12)).otherwise(lt(9))),
        "LU": (r"[0-9]{8}", lu),
        "LV": (
            r"[0-9]{11}",
            F.when(d(1) < 4, lv_personal(n)).otherwise(_weighted(n, (9, 1, 4, 8, 3, 10, 2, 5, 7, 6, 1)) % 11 == 3),
        ),
        "MT": (r"[1-9][0-9]{7}", _weighted(n, (3, 4, 6, 7, 8, 9, 10, 1)) % 37 == 0),
        "NL": (r"(?!000000000)[0-9]{9}B(?!00)[0-9]{2}", nl_bsn | nl_97),
        "PL": (r"[0-9]{10}", (_weighted(n, (6, 5, 7, 2, 3, 4, 5, 6, 7)) - d(10)) % 11 == 0),
        "PT": (r"[1-9][0-9]{8}", pt_nif(n)),
        "RO": (r"[1-9][0-9]{1,9}|[1-9][0-9]{12}", F.when(F.length(n) == 13, ro_personal(n)).otherwise(ro_ok)),
        "SE": (r"[0-9]{10}01", luhn(_part(n, 1, 10))),
        "SI": (r"[1-9][0-9]{7}", F.when(si == 10, 0).otherwise(si) == d(8)),
        "SK": (
            r"[0-9]{10}",
            birth_number(n) | (_shape(n, r"[1-9][0-9][2-47-9][0-9]{7}") & (_int(n) % 11 == 0)),
        ),
        "XI": (
            r"[0-9]{9}(?:[0-9]{3})?|GD[0-4][0-9]{2}|HA[5-9][0-9]{2}|GD8888[0-4][0-9]{4}|HA8888[5-9][0-9]{4}",
            F.when(F.length(n) == 5, True)
            .when(_shape(n, "(?:GD|HA)8888[0-9]{5}"), _int(_part(n, 7, 3)) % 97 == _int(_part(n, 10, 2)))
            .when(_shape(n, "[0-9]+"), (xi == 0) | ((xi == 42) & ~_part(n, 1, 1).startswith("0")))
            .otherwise(False),
        ),
    }
    out = None
    for code, (shape, test) in rules.items():
        checked = F.when(_shape(n, shape), test).otherwise(False)
        out = F.when(country == code, checked) if out is None else out.when(country == code, checked)
    return _sure(out.otherwise(False))


def eu_vat(value: Column) -> Column:
    def body(n):
        number = F.substring(n, F.lit(3), F.length(n))
        return F.when(
            _part(n, 1, 2).isin(list(tables.EU_VAT_COUNTRIES)),
            let(number, lambda b: vat_body_is_valid(_part(n, 1, 2), b)),
        ).otherwise(False)

    return _sure(let(compact_id(value), body))
