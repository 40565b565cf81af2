"""Canonical digests of nested values and name-based ids."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Ids of this library's own name space.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "caseloom")


def canonical(value: object, compact: bool = True) -> str:
    """JSON of sorted keys; compact or with blanks after commas and colons. NaN is refused."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":") if compact else (", ", ": "))


def _digested(text: str | None, compact: bool) -> str | None:
    try:
        return None if text is None else hashlib.sha256(canonical(json.loads(text), compact).encode()).hexdigest()
    except ValueError:
        return None


@F.pandas_udf(StringType())
def _compact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield pd.Series([_digested(x, True) for x in b], dtype="object")


@F.pandas_udf(StringType())
def _spaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield pd.Series([_digested(x, False) for x in b], dtype="object")


def json_digest(col: Column, compact: bool = True) -> Column:
    """SHA-256 of the canonical form of a JSON text, whatever its order of keys and blanks; null of null, of malformed JSON and of NaN."""
    return (_compact if compact else _spaced)(col)


def flat_digest(fields: dict[str, Column]) -> Column:
    """json_digest() of an object of strings, numbers and booleans (null where null), in built-in functions; keys are sorted here."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def stable_id(*parts: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The version 5 UUID of string parts, in built-in functions: of the name that joins the parts as a JSON array."""
    name = F.to_json(F.array(*parts))
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
