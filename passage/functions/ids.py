"""Identifier hashing."""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F


def new_salt() -> str:
    """Random 32-byte hex salt; a new one per capture process unlinks hashes."""
    return secrets.token_hex(32)


def salted_sha256(identifier, salt) -> Column:
    """Hex SHA-256 of ``identifier || salt`` (salt a literal or a column)."""
    ident = F.col(identifier) if isinstance(identifier, str) else identifier
    s = salt if isinstance(salt, Column) else F.lit(salt)
    return F.sha2(F.concat(ident.cast("string"), s), 256)
