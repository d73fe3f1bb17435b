"""Names, orders, weights and character tables that results depend on."""

from __future__ import annotations

import unicodedata
from functools import cache

# --- Fixed values: entity types in tie-breaking order, layers in priority order --------------
ENTITY_TYPES = (
    "ES_DNI", "ES_NIE", "ES_NIF", "ES_CIF", "ES_NSS", "ES_CCC", "IBAN", "IT_CODICE_FISCALE",
    "EU_VAT", "CREDIT_CARD", "EMAIL", "IP", "PHONE", "ES_PASSPORT", "ES_PLATE", "ADDRESS",
    "DATE_OF_BIRTH", "PT_NIF", "FR_NIR", "DE_IDNR", "PERSON",
)
LAYERS = ("VALIDATOR", "PATTERN", "NER")
ALLOWED_BY_DEFAULT = ("ES_CIF",)

# --- Fixed values: Cyrillic and Greek letters drawn like a Latin one --------------------------
LOOK_ALIKES = (
    "АA ВB ЕE КK МM НH ОO РP СC ТT ХX "
    "УY ЗZ "
    "аa вb еe кk мm нh оo рp сc тt хx "
    "уy зz "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP "
    "ΤT ΥY ΧX "
    "αa βb εe ζz ηh ιi κk μm νn οo ρp "
    "τt υy χx"
).split()

# --- Fixed values: characters read as a plain space, kept ordinals, blank letters -------------
ODD_SPACES = "\t    　" + "".join(map(chr, range(0x2000, 0x200B)))
ORDINALS = "ªº"
HANGUL_FILLERS = "ᅟᅠㅤﾠ"
INVISIBLE_CATEGORIES = ("Cf", "Mn")
# Blocks (first, last + 1) looked at for invisible characters and for one-character NFKC forms.
INVISIBLE_BLOCKS = ((0x0000, 0x10000), (0x1D100, 0x1D200), (0xE0000, 0xE0200))
WIDTH_BLOCKS = (
    (0x00A0, 0x0100), (0x2070, 0x20A0), (0x2100, 0x2150), (0x2460, 0x24F0), (0xFF00, 0xFF70),
    (0x1D400, 0x1D800),
)

@cache
def look_alikes() -> dict[str, str]:
    return {pair[0]: pair[1] for pair in LOOK_ALIKES}


@cache
def invisible() -> str:
    """Every character the detector view drops."""
    found = [
        chr(code)
        for low, high in INVISIBLE_BLOCKS
        for code in range(low, high)
        if unicodedata.category(chr(code)) in INVISIBLE_CATEGORIES
    ]
    return "".join(found) + HANGUL_FILLERS


@cache
def replaced() -> dict[str, str]:
    """Every character the detector view writes as another one."""
    table = {}
    for low, high in WIDTH_BLOCKS:
        for char in map(chr, range(low, high)):
            narrow = unicodedata.normalize("NFKC", char)
            if narrow != char and len(narrow) == 1 and narrow.isascii() and narrow.isalnum():
                table[char] = narrow
    for char in ORDINALS:
        table.pop(char, None)
    table |= look_alikes() | dict.fromkeys(ODD_SPACES, " ")
    for char in invisible():
        table.pop(char, None)
    return table


# --- Fixed values: control letters, weights and formats of the checked identifiers ------------
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CIF_ORGANISATIONS = "ABCDEFGHJNPQRSUVW"
CIF_LETTERS = "JABCDEFGHI"
CCC_WEIGHTS = (1, 2, 4, 8, 5, 10, 9, 7, 3, 6)
EU_VAT_COUNTRIES = (
    "AT", "BE", "BG", "CY", "CZ", "DE", "DK", "EE", "EL", "ES", "FI", "FR", "HR", "HU", "IE",
    "IT", "LT", "LU", "LV", "MT", "NL", "PL", "PT", "RO", "SE", "SI", "SK", "XI",
)
# Value of each character in an odd place (1st, 3rd...) of a codice fiscale.
CODICE_ODD_VALUES = {
    "0": 1, "1": 0, "2": 5, "3": 7, "4": 9, "5": 13, "6": 15, "7": 17, "8": 19, "9": 21,
    "A": 1, "B": 0, "C": 5, "D": 7, "E": 9, "F": 13, "G": 15, "H": 17, "I": 19, "J": 21,
    "K": 2, "L": 4, "M": 18, "N": 20, "O": 11, "P": 3, "Q": 6, "R": 8, "S": 12, "T": 14,
    "U": 16, "V": 10, "W": 22, "X": 25, "Y": 24, "Z": 23,
}
CODICE_MONTHS = "ABCDEHLMPRST"
CODICE_OMOCODES = "LMNPQRSTUV"  # written for 0..9

# IBAN registry (SWIFT, ISO 13616): account structure after the check digits, by country.
# n = digits, a = capitals, c = letters and digits; every part has a fixed length.
IBAN_STRUCTURES = {
    "AD": "4n4n12c", "AE": "3n16n", "AL": "8n16c", "AT": "5n11n", "AZ": "4a20c",
    "BA": "3n3n8n2n", "BE": "3n7n2n", "BG": "4a4n2n8c", "BH": "4a14c", "BI": "5n5n11n2n",
    "BR": "8n5n10n1a1c", "BY": "4c4n16c", "CH": "5n12c", "CR": "4n14n", "CY": "3n5n16c",
    "CZ": "4n6n10n", "DE": "8n10n", "DJ": "5n5n11n2n", "DK": "4n9n1n", "DO": "4c20n",
    "EE": "2n2n11n1n", "EG": "4n4n17n", "ES": "4n4n1n1n10n", "FI": "3n11n", "FK": "2a12n",
    "FO": "4n9n1n", "FR": "5n5n11c2n", "GB": "4a6n8n", "GE": "2a16n", "GI": "4a15c",
    "GL": "4n9n1n", "GR": "3n4n16c", "GT": "4c20c", "HN": "4a20n", "HR": "7n10n",
    "HU": "3n4n1n15n1n", "IE": "4a6n8n", "IL": "3n3n13n", "IQ": "4a3n12n", "IS": "4n2n6n10n",
    "IT": "1a5n5n12c", "JO": "4a4n18c", "KW": "4a22c", "KZ": "3n13c", "LB": "4n20c",
    "LC": "4a24c", "LI": "5n12c", "LT": "5n11n", "LU": "3n13c", "LV": "4a13c", "LY": "3n3n15n",
    "MC": "5n5n11c2n", "MD": "2c18c", "ME": "3n13n2n", "MK": "3n10c2n", "MN": "4n12n",
    "MR": "5n5n11n2n", "MT": "4a5n18c", "MU": "4a2n2n12n3n3a", "NI": "4a20n", "NL": "4a10n",
    "NO": "4n6n1n", "OM": "3n16c", "PK": "4a16c", "PL": "8n16n", "PS": "4a21c",
    "PT": "4n4n11n2n", "QA": "4a21c", "RO": "4a16c", "RS": "3n13n2n", "RU": "9n5n15c",
    "SA": "2n18c", "SC": "4a2n2n16n3a", "SD": "2n12n", "SE": "3n16n1n", "SI": "5n8n2n",
    "SK": "4n6n10n", "SM": "1a5n5n12c", "SO": "4n3n12n", "ST": "4n4n11n2n", "SV": "4a20n",
    "TL": "3n14n2n", "TN": "2n3n13n2n", "TR": "5n1n16c", "UA": "6n19c", "VA": "3n15n",
    "VG": "4a16n", "XK": "4n10n2n", "YE": "4a4n18c",
}
