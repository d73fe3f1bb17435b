"""Virtual keys: their written form, their checksum and their keyed hash, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

# --- Fixed values: the written form of a key --------------------------------------------------
PREFIX = "afz_"
BODY_CHARS = 43
CHECKSUM_CHARS = 6
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SHA256_BLOCK = 64


def checksum(head: Column) -> Column:
    """CRC32 of the prefix and body, as six base-62 characters."""
    number = F.crc32(F.encode(head, "UTF-8"))
    signs = [
        F.substring(
            F.lit(ALPHABET), (F.floor(number / 62**i).cast("bigint") % 62 + 1).cast("int"), F.lit(1)
        )
        for i in reversed(range(CHECKSUM_CHARS))
    ]
    return F.concat(*signs)


def key_from_body(body: Column) -> Column:
    head = F.concat(F.lit(PREFIX), body)
    return F.concat(head, checksum(head))


def is_well_formed(text: Column) -> Column:
    shape = rf"\A{PREFIX}[0-9A-Za-z]{{{BODY_CHARS + CHECKSUM_CHARS}}}\z"
    head = F.substring(text, 1, len(PREFIX) + BODY_CHARS)
    right = F.substring(text, len(PREFIX) + BODY_CHARS + 1, CHECKSUM_CHARS) == checksum(head)
    return F.coalesce(F.when(F.rlike(text, F.lit(shape)), right).otherwise(False), F.lit(False))


def _pads(pepper: bytes) -> tuple[bytes, bytes]:
    key = hashlib.sha256(pepper).digest() if len(pepper) > SHA256_BLOCK else pepper
    block = key.ljust(SHA256_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def digest(key: Column, pepper: bytes) -> Column:
    """HMAC-SHA256 of the key with one pepper, in two nested native hashes."""
    inner, outer = _pads(pepper)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(key, "UTF-8")), 256))
    return F.unhex(F.sha2(F.concat(F.lit(outer), first), 256))


def secret_part(key: Column) -> Column:
    """The key without its public prefix (`sk-`, `sk-proj-`, `sk-ant-api03-`...)."""
    return F.regexp_replace(
        key, r"\A(?:sk-ant-(?:[a-z]+[0-9]*-)?|(?!sk-ant-)sk-(?:(?:svcacct|proj|admin|None)-)?)", ""
    )
