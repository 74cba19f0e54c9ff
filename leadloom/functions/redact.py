"""Masking of secrets in JSON text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.constants import MASK_TEXT, RUN_LOG_SECRET_KEYS
from leadloom.functions.text import col

def mask_scalars(c: Column | str, keys=RUN_LOG_SECRET_KEYS) -> Column:
    """Mask text, number and literal values of secret keys without leaving the JVM."""
    names = "|".join(re.escape(k) for k in keys)
    pattern = rf'(?i)("(?:{names})"\s*:\s*)("(?:[^"\\]|\\.)*"|[^\s"\[\]{{}},]+)'
    return F.regexp_replace(col(c), pattern, f'$1"{MASK_TEXT}"')


def mask_nested(c: Column, kind: T.DataType, keys=RUN_LOG_SECRET_KEYS) -> Column:
    """A typed value with all that stands under a secret key masked whole, at any depth.  The schema
    is walked here; the values stay in the JVM."""
    names = frozenset(k.lower() for k in keys)
    if isinstance(kind, T.StructType):
        fields = [
            F.when(c[f.name].isNotNull(), MASK_TEXT).alias(f.name) if f.name.lower() in names
            else mask_nested(c[f.name], f.dataType, keys).alias(f.name)
            for f in kind.fields
        ]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: mask_nested(x, kind.elementType, keys))
    if isinstance(kind, T.MapType):
        def masked(key: Column, value: Column) -> Column:
            secret = F.lower(key.cast("string")).isin(*names)
            if isinstance(kind.valueType, T.StringType):
                return F.when(secret, F.lit(MASK_TEXT)).otherwise(value)
            # values of another type share a map with the mask as JSON values
            inner = F.to_json(F.array(mask_nested(value, kind.valueType, keys)))
            plain = F.regexp_replace(inner, r"(?s)^\[(.*)\]$", "$1")
            return F.parse_json(F.when(secret, F.lit(f'"{MASK_TEXT}"')).otherwise(plain))

        return F.transform_values(c, masked)
    return c


def _masked_object(keys: frozenset[str]):
    """An object from its pairs, whole values of secret keys masked; the last of repeated keys counts."""
    return lambda pairs: {k: MASK_TEXT if k.lower() in keys else v for k, v in pairs}


@cache
def _decoder(keys: frozenset[str]) -> json.JSONDecoder:
    return json.JSONDecoder(object_pairs_hook=_masked_object(keys))


def mask_text(text: str | None, keys: frozenset[str]) -> str | None:
    """Mask whole values of secret keys anywhere in JSON text; text that is no JSON is passed on."""
    try:
        return json.dumps(_decoder(keys).decode(text), ensure_ascii=False)
    except RecursionError:
        return mask_nested_text(text, keys)
    except (TypeError, ValueError):
        return text


# Levels that the parser takes at a time, and what a byte outside of strings does to the level.
_LEVELS = 200
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1


@dataclass
class _Hole:
    """Where a part stands that was cut out of a text."""

    part: int


def mask_nested_text(text: str, keys: frozenset[str]) -> str:
    """`mask_text` for any depth: the text is cut where `_LEVELS` more levels open, the parser reads
    part by part, with a number of its own where a part was, and the masked parts are put together."""
    try:
        return "".join(_written(_parsed(text, keys)))
    except ValueError:
        return text


def _cuts(data: np.ndarray) -> list[tuple[int, bool]]:
    """Where parts begin (true) and end (false), in the order of the text."""
    quotes = np.flatnonzero(data == ord('"'))
    slash = data == ord("\\")
    if slash.any():
        # an odd run of backslashes escapes the quote behind it
        other = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
        quotes = quotes[(quotes - np.append(-1, other)[quotes]) % 2 == 1]
    place = np.flatnonzero(_STEP[data])
    place = place[np.searchsorted(quotes, place) % 2 == 0]
    step = _STEP[data[place]]
    level = np.cumsum(step, dtype=np.int64)
    if len(level) and (level[-1] != 0 or level.min() < 0):
        raise ValueError("no JSON")
    outside = level - (step > 0)  # of the container
    at = np.flatnonzero((outside > 0) & (outside % _LEVELS == 0))
    opens = step[at] > 0
    return list(zip((place[at] + ~opens).tolist(), opens.tolist(), strict=True))


def _parsed(text: str, keys: frozenset[str]) -> list:
    """The masked value of every part, holes in place of inner parts; the first is the outermost."""
    raw = text.encode("utf-8", "surrogatepass")
    pieces: list[list[str]] = [[]]  # of each part, the text around its holes
    inner: list[list[int]] = [[]]
    stack, start = [0], 0
    for place, opens in [*_cuts(np.frombuffer(raw, np.uint8)), (len(raw), False)]:
        pieces[stack[-1]].append(raw[start:place].decode("utf-8", "surrogatepass"))
        start = place
        if opens:
            inner[stack[-1]].append(len(pieces))
            stack.append(len(pieces))
            pieces.append([])
            inner.append([])
        else:
            stack.pop()
    mark = "0.1"  # a number that the text does not have
    while mark in text:
        mark += mark[2:]
    values = []
    for part, holes in zip(pieces, map(iter, inner), strict=True):
        part = f" {mark} ".join(part)
        lower = part.lower()
        # an escape may stand for a letter of a secret key
        secret = "\\" in part or any(key in lower for key in keys)
        decoder = json.JSONDecoder(
            parse_float=lambda s, holes=holes: _Hole(next(holes)) if s == mark else float(s),
            object_pairs_hook=_masked_object(keys) if secret else None,
        )
        values.append(decoder.decode(part))
    return values


def _dumped(value) -> tuple[list[str], list[int]]:
    """The text of a part around its holes, and the parts that go there."""
    mark = "-"
    while True:
        holes: list[int] = []

        def put(hole: _Hole, holes=holes, mark=mark) -> str:
            holes.append(hole.part)
            return mark

        pieces = json.dumps(value, ensure_ascii=False, default=put).split(f'"{mark}"')
        if len(pieces) == len(holes) + 1:
            return pieces, holes
        mark += mark  # the text has this string


def _written(values: list) -> Iterator[str]:
    """Pieces of the whole text.  The stack holds what is still to write: text, numbers of parts."""
    todo: list[str | int] = [0]
    while todo:
        piece = todo.pop()
        if isinstance(piece, str):
            yield piece
            continue
        pieces, holes = _dumped(values[piece])
        todo += [*chain.from_iterable(zip(reversed(pieces), reversed(holes))), pieces[0]]
