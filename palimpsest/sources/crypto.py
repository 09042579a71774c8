"""Keys, and the codec of encrypted rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError

MIN_PASSWORD = 10


def key_of_password(password: str) -> bytes:
    if len(password) < MIN_PASSWORD:
        raise ConfigurationError(f"a password has at least {MIN_PASSWORD} characters")
    return hashlib.sha256(password.encode()).digest()


def check_key(key: bytes) -> bytes:
    if len(key) != 32:
        raise ConfigurationError("a key has 32 bytes")
    return bytes(key)


def hidden(spark: SparkSession, key: bytes) -> Column:
    """The key as a scalar subquery over a local row: plans and event logs show where
    it comes from, and not, as they would of a literal, what it is."""
    return spark.createDataFrame([(key,)], "k binary").scalar()


def encrypt(payload: Column, key: Column, mode: str = "GCM") -> Column:
    """A random initial vector, then the cipher text."""
    return F.aes_encrypt(payload, key, F.lit(mode), F.lit("PKCS" if mode == "CBC" else "DEFAULT"))


def decrypt(payload: Column, key: Column, mode: str = "GCM") -> Column:
    """Null where the key doesn't fit.  (CBC isn't authenticated: about one in 256
    payloads opens to bytes without meaning, which the codec must tell.)"""
    return F.try_aes_decrypt(payload, key, F.lit(mode), F.lit("PKCS" if mode == "CBC" else "DEFAULT"))


def encrypted_length(n: Column, mode: str = "GCM") -> Column:
    """CBC: padded to blocks, and a 16-byte vector.  GCM: a 12-byte vector and a 16-byte tag."""
    return n + (16 - n % 16) + 16 if mode == "CBC" else n + 28
