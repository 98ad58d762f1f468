"""HMAC-SHA256 signatures as pure Catalyst expressions (F8).

``HMAC(k, m) = H((k' ^ opad) || H((k' ^ ipad) || m))`` with ``k'`` the key padded
to the 64-byte block (keys longer than a block are hashed first). The padded
keys are constants computed once on the driver; per row it is two ``sha2`` calls
inside whole-stage codegen, no Python.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(key: str) -> tuple[bytes, bytes]:
    k = key.encode("utf-8")
    if len(k) > _BLOCK:
        k = hashlib.sha256(k).digest()
    k = k.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)


def hmac_sha256_hex(body: str | Column, key: str) -> Column:
    """Lower-case hex HMAC-SHA256 of the raw body bytes (UTF-8 for a string column)."""
    b = F.col(body) if isinstance(body, str) else body
    ipad, opad = _pads(key)
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(ipad)), b.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytearray(opad)), inner), 256)


def signature_ok(body: str | Column, signature: str | Column, key: str | None) -> Column:
    """Accept when no key is configured or no signature is given; else compare.

    The body must be the raw (decompressed) request body, never re-serialised JSON.
    """
    sig = F.col(signature) if isinstance(signature, str) else signature
    if not key:
        return F.lit(True)
    return F.when(sig.isNull() | (sig == ""), F.lit(True)).otherwise(sig == hmac_sha256_hex(body, key))
