"""Canonical JSON (RFC 8785) and the identities made from it."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(x: float) -> str:
    """A double as ECMAScript prints it."""
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if len(text) <= point <= 21:
        body = text + "0" * (point - len(text))
    elif 0 < point <= 21:
        body = text[:point] + "." + text[point:]
    elif -6 < point <= 0:
        body = "0." + "0" * -point + text
    else:
        body = text[0] + ("." + text[1:] if len(text) > 1 else "") + ("e+" if point > 0 else "e-") + str(abs(point - 1))
    return "-" * sign + body


def dumps(value) -> str:
    """Canonical text: keys by UTF-16 code units, no white space, numbers as doubles."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{dumps(k)}:{dumps(value[k])}" for k in keys) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(dumps, value)) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return _number(float(value))


def identity(value, prefix: str = "") -> str:
    return prefix + hashlib.sha256(dumps(value).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_json(column: pd.Series) -> pd.Series:
    """JSON text to canonical JSON text, for any nesting."""
    return column.map(lambda s: None if s is None else dumps(json.loads(s)))


@F.pandas_udf(T.StringType())
def nfc(column: pd.Series) -> pd.Series:
    return column.map(lambda s: None if s is None else unicodedata.normalize("NFC", s.strip()))


def struct_json(**fields: Column) -> Column:
    """Canonical JSON of a flat record: fields in order of their names, nulls left out. Strings and integers below 2^53
    only, for which Spark's own JSON text is the canonical one (but for `/`-free escapes, which both leave alone)."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def struct_hash(prefix: str = "", **fields: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(struct_json(**fields), 256))


def prefix_hashes(values: Column, most: int = 8) -> Column:
    """Hashes of the JSON lists of the first 1, 2, ... values."""
    n = F.least(F.size(values), F.lit(most))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.sha2(F.to_json(F.slice(values, F.lit(1), i)), 256))).otherwise(F.array().cast("array<string>"))
