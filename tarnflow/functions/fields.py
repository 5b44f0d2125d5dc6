"""Positional fields of delimited text: selection specs and sort-key specs.

Both are parsed in Python into column expressions, so that rows stay in the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FieldList:
    """Field numbers in order, then all fields from ``rest`` on (none if negative)."""

    fields: tuple[int, ...]
    rest: int = -1

    @property
    def empty(self) -> bool:
        return not self.fields and self.rest < 0


def parse_field_list(spec: str) -> FieldList:
    """``n``, ``a-b``, ``-b`` (from 0) and ``n-`` (open), separated by commas."""
    fields: list[int] = []
    rest = -1
    for item in filter(None, spec.split(",")):
        first, dash, last = item.partition("-")
        if not dash:
            fields.append(int(first))
        elif last:
            fields += range(int(first or 0), int(last) + 1)
        else:
            rest = int(first or 0)
    return FieldList(tuple(fields), rest)


def parse_selection(spec: str) -> tuple[FieldList, FieldList]:
    """Key and value lists of ``keys:values``; a key list has no open range."""
    keys, _, values = spec.partition(":")
    return FieldList(parse_field_list(keys).fields), parse_field_list(values)


def _kept_fields(line: Column, separator: str) -> Column:
    """The fields of a line; empty ones at its end do not count."""
    quoted = re.escape(separator)
    return F.split(F.regexp_replace(line, f"({quoted})+$", ""), quoted)


def select_fields(line: Column, wanted: FieldList, separator: str = "\t") -> Column:
    """The wanted fields joined by ``separator``; a field that is not there is
    empty. Null if nothing is wanted."""
    if wanted.empty:
        return F.lit(None).cast("string")
    fields = _kept_fields(line, separator)
    picked = F.array(*(F.coalesce(F.get(fields, F.lit(k)), F.lit("")) for k in wanted.fields)) if wanted.fields else F.array().cast("array<string>")
    if wanted.rest >= 0:
        more = F.size(fields) - wanted.rest
        picked = F.concat(picked, F.when(more > 0, F.slice(fields, wanted.rest + 1, F.greatest(more, F.lit(0)))).otherwise(F.array().cast("array<string>")))
    return F.array_join(picked, separator)


def select_key_value(line: Column, spec: str, separator: str = "\t") -> tuple[Column, Column]:
    """Key and value of a line under ``spec``; without key fields the value becomes
    the key and the value is empty."""
    keys, values = parse_selection(spec)
    key, value = select_fields(line, keys, separator), select_fields(line, values, separator)
    if keys.empty:
        key, value = value, F.lit("")
    return F.coalesce(key, F.lit("")), F.coalesce(value, F.lit(""))


@dataclass(frozen=True)
class KeyPart:
    """From character ``start`` of field ``first`` to character ``end`` (0: last) of
    field ``last`` (0: to the end of the key). All counts start at 1."""

    first: int
    start: int
    last: int
    end: int
    numeric: bool
    reverse: bool


KEY_PART = re.compile(r"(\d+)(?:\.(\d+))?([nr]*)(?:,(\d+)(?:\.(\d+))?([nr]*))?$")


def parse_sort_spec(spec: str) -> list[KeyPart]:
    """Parts of ``-k f[.c][opts][,f[.c][opts]]`` and of the global options ``-n``, ``-r``."""
    words = spec.split()
    options, parts, at = "", [], 0
    while at < len(words):
        word = words[at]
        if word.startswith("-k"):
            at += word == "-k"
            body = words[at] if word == "-k" else word[2:]
            match = KEY_PART.match(body)
            if not match:
                raise ValueError(f"not a key: {body!r}")
            parts.append(match)
        elif re.fullmatch(r"-[nr]+", word):
            options += word[1:]
        else:
            raise ValueError(f"not an option: {word!r}")
        at += 1
    found = []
    for match in parts:
        own = (match[3] or "") + (match[6] or "") or options
        found.append(KeyPart(int(match[1]), int(match[2] or 1), int(match[4] or 0), int(match[5] or 0), "n" in own, "r" in own))
    return found or [KeyPart(1, 1, 0, 0, "n" in options, "r" in options)]


def key_part(line: Column, part: KeyPart, separator: str = "\t") -> Column:
    """The text of a part; null if the key has no such field or character."""
    fields = F.split(line, re.escape(separator), -1)
    size = F.size(fields)
    from_first = F.array_join(F.slice(fields, part.first, F.greatest(size - part.first + 1, F.lit(0))), separator)
    if part.last:
        between = F.slice(fields, part.first, F.greatest(F.least(size, F.lit(part.last)) - part.first + 1, F.lit(0)))
        whole = F.length(F.array_join(between, separator))
        last = F.coalesce(F.length(F.get(fields, F.lit(part.last - 1))), F.lit(0))
        stop = whole if not part.end else F.when(size >= part.last, whole - last + F.least(last, F.lit(part.end))).otherwise(whole)
    else:
        stop = F.length(from_first)
    text = F.substring(from_first, F.lit(part.start), F.greatest(stop - part.start + 1, F.lit(0)))
    return F.when((size >= part.first) & (F.length(from_first) >= part.start), text)


def leading_number(text: Column) -> Column:
    """The number that a text starts with: ``-``, digits, ``.`` and digits; else zero."""
    found = F.regexp_extract(text, r"^(-?\d*\.?\d*)", 1)
    return F.coalesce(found.try_cast("decimal(38,12)"), F.lit(0).cast("decimal(38,12)"))


def sort_columns(line: Column, spec: str, separator: str = "\t") -> list[Column]:
    """Sort expressions of a key spec, to be used with ``orderBy`` or
    ``sortWithinPartitions``. Keys without a part sort first (last if reversed)."""
    found = []
    for part in parse_sort_spec(spec):
        text = key_part(line, part, separator)
        value = F.when(text.isNotNull(), leading_number(text)) if part.numeric else text
        found.append(value.desc_nulls_last() if part.reverse else value.asc_nulls_first())
    return found


def partition_columns(line: Column, spec: str, separator: str = "\t") -> list[Column]:
    """The parts of a key spec as plain columns, for ``repartition``; a key without
    any part falls together with other such keys."""
    return [F.coalesce(key_part(line, part, separator), F.lit("")) for part in parse_sort_spec(spec)]


def byte_range(data: Column, left: int = 0, right: int = -1) -> Column:
    """Bytes ``left`` to ``right``, both inclusive, counted from the end if negative."""
    size = F.octet_length(data)
    low = F.lit(left) if left >= 0 else size + left
    high = F.lit(right) if right >= 0 else size + right
    low = F.greatest(low, F.lit(0))
    return F.substring(data, low + 1, F.greatest(F.least(high, size - 1) - low + 1, F.lit(0)))


def byte_hash(text: Column) -> Column:
    """The 32-bit hash of a text's bytes that the hash partitioner uses, without sign:
    from 1 on, 31 times the hash so far plus the byte (a signed one), for each byte."""
    digits = F.hex(F.encode(text, "utf-8"))
    size = F.octet_length(text)
    code = lambda k: F.conv(F.substring(digits, 2 * k - 1, F.lit(2)), 16, 10).cast("long")
    signed = lambda b: F.when(b > 127, b - 256).otherwise(b)
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(1).cast("long"), lambda h, k: F.pmod(31 * h + signed(code(k)), F.lit(1 << 32)))


def hash_partition(text: Column, parts: int) -> Column:
    """The partition of a text key: its hash without the sign bit, modulo ``parts``."""
    return byte_hash(text).bitwiseAND(F.lit((1 << 31) - 1)) % parts
