"""Digests, identities, buckets and hashed features."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def text_digest(text: Column) -> Column:
    """H01"""
    return F.sha2(text, 256)


def canonical_digest(**fields: Column) -> Column:
    """SHA-256 of compact JSON with its keys in order; a null field stays in it as null."""
    s = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(s, {"ignoreNullFields": "false"}), 256)


def passage_id(digest: Column) -> Column:
    """H03"""
    return F.concat(F.lit("psg-"), F.left(digest, F.lit(40)))


def bucket(key: Column) -> Column:
    """The first 12 hex digits of the key's SHA-256 as a fraction of 16^12."""
    return F.conv(F.left(F.sha2(key, 256), F.lit(12)), 16, 10).cast("double") / float(16**12)


def reference(key: Column, salt: str, digits: int = 16) -> Column:
    """H06 without a secret: a short stable pseudonym."""
    return F.left(F.sha2(F.concat(F.lit(salt), key), 256), F.lit(digits))


def keyed_reference(key: Column, secret: bytes) -> Column:
    """HMAC-SHA-256 pseudonym."""

    @F.arrow_udf("string")
    def mac(a: pa.Array) -> pa.Array:
        import hmac

        return pa.array([None if s is None else hmac.new(secret, s.encode(), "sha256").hexdigest() for s in a.to_pylist()], pa.string())

    return mac(key)


def event_uuid(name: Column, space: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """Version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(space.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def hashed_features(text: Column, dim: int = 64) -> Column:
    """Unit vector of signed hashed words and word pairs (BLAKE2b of 8 bytes: index by the remainder, sign by the
    top bit); null for a text without words."""

    @F.arrow_udf("array<float>")
    def embed(a: pa.Array) -> pa.Array:
        import re

        word, seen, out = re.compile(r"[^\W_]+"), {}, []

        def place(s: str) -> tuple[int, float]:
            if s not in seen:
                h = int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big")
                seen[s] = (h % dim, -1.0 if h >> 63 else 1.0)
                if len(seen) > 500_000:
                    seen.clear()
                    return h % dim, -1.0 if h >> 63 else 1.0
            return seen[s]

        for s in a.to_pylist():
            t = [] if s is None else word.findall(s.lower())
            v = np.zeros(dim)
            for x in [*t, *(f"{p} {q}" for p, q in zip(t, t[1:]))]:
                k, sign = place(x)
                v[k] += sign
            n = np.linalg.norm(v)
            out.append((v / n).astype(np.float32).tolist() if n else None)
        return pa.array(out, pa.list_(pa.float32()))

    return embed(text)
