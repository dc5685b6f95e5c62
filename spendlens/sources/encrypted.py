"""Encrypted payloads: AES-256-CBC with the key and IV in hexadecimal beside a base64 body; and the gate on types."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def decrypt(key: Column, iv: Column, body: Column) -> Column:
    """The plain bytes; the engine wants the IV ahead of the ciphertext. Null if it can't be decrypted."""
    return F.try_aes_decrypt(F.concat(F.unhex(iv), F.unbase64(body)), F.unhex(key), F.lit("CBC"), F.lit("PKCS"))


def encrypt(key: Column, iv: Column, plain: Column) -> Column:
    """The base64 body for a key and an IV."""
    sealed = F.aes_encrypt(plain, F.unhex(key), F.lit("CBC"), F.lit("PKCS"), F.unhex(iv))
    return F.base64(F.substring(sealed, F.lit(17), F.octet_length(sealed) - 16))


def accepted(mime: Column) -> Column:
    """Any application/* or image/* passes, and what has no type."""
    return mime.isNull() | mime.startswith("application/") | mime.startswith("image/")
