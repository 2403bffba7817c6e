"""Text forms of values, times, payloads and packets, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unsigned import decimal_text, floor_div, signed


def hex_text(x: Column, digits: int = 2) -> Column:
    text = F.hex(x)
    return F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)


def ascii_text(x: Column) -> Column:
    """The low byte as a character; control characters and bytes from 127 on are a dot."""
    low = x.bitwiseAND(F.lit(255))
    return F.when((low >= 32) & (low < 127), F.char(low)).otherwise(".")


def value_text(x: Column, form: str) -> Column:
    """A value as Hex (two digits at least), Binary, Octal, Decimal, ASCII or ``Hex + ASCII``."""
    forms = {
        "Hex": F.concat(F.lit("0x"), hex_text(x)),
        "Binary": F.concat(F.lit("0b"), F.bin(x)),
        "Octal": F.concat(F.lit("0o"), F.conv(decimal_text(x), 10, 8)),
        "Decimal": decimal_text(x),
        "ASCII": ascii_text(x),
    }
    forms["Hex + ASCII"] = F.concat(forms["Hex"], F.lit(" '"), forms["ASCII"], F.lit("'"))
    return forms[form]


def time_text(ns: Column) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds with 9, 6, 3 or 0 decimals, from their thresholds on."""

    def scaled(digits: int, unit: str) -> Column:
        size = F.abs(ns)
        text = floor_div(size, 10**digits).cast("string")
        rest = F.lpad(F.pmod(size, F.lit(10**digits)).cast("string"), digits, "0")
        return F.concat(F.when(ns < 0, "-").otherwise(""), text, F.lit("."), rest, F.lit(f" {unit}"))

    size = F.abs(ns)
    return (
        F.when(size >= 1_000_000_000, scaled(9, "s"))
        .when(size >= 1_000_000, scaled(6, "ms"))
        .when(size >= 1_000, scaled(3, "µs"))
        .otherwise(F.concat(ns.cast("string"), F.lit(" ns")))
    )


def byte_label(x: Column) -> Column:
    """Bytes as upper-case hex pairs joined by spaces."""
    return F.regexp_replace(F.hex(x), r"(..)(?!$)", "$1 ")


def word_list_label(values: Column, most: int = 8) -> Column:
    """``[0x01 0x02 … +n]`` of an array of values, at most ``most`` of them."""
    shown = F.array_join(F.transform(F.slice(values, 1, most), lambda x: F.concat(F.lit("0x"), hex_text(x))), " ")
    more = F.when(F.size(values) > most, F.concat(F.lit(" … +"), (F.size(values) - most).cast("string"))).otherwise("")
    return F.substring(F.concat(F.lit("["), shown, more, F.lit("]")), 1, 256)


def bytes_label(x: Column, most: int = 16) -> Column:
    """``[01 02 … +n]`` of a byte payload, at most ``most`` bytes of it."""
    shown = byte_label(F.substring(x, 1, most))
    more = F.when(F.length(x) > most, F.concat(F.lit(" … +"), (F.length(x) - most).cast("string"))).otherwise("")
    return F.substring(F.concat(F.lit("["), shown, more, F.lit("]")), 1, 256)


def i2c_label(kind: Column, value: Column) -> Column:
    """Text of a two-wire packet by its kind; one whose value is missing shows its kind."""
    number = hex_text(value)
    of = {"ADDRESS WRITE": ("Address 0x", " · Write"), "ADDRESS READ": ("Address 0x", " · Read"), "DATA WRITE": ("Write 0x", ""), "DATA READ": ("Read 0x", "")}
    text = F.when(kind == "START", "Start").when(kind == "START REPEAT", "Repeated start").when(kind == "STOP", "Stop").when(kind == "BITS", "Bits")
    for name, (front, back) in of.items():
        text = text.when((kind == name) & (value >= 0), F.concat(F.lit(front), number, F.lit(back)))
    return F.substring(text.otherwise(kind), 1, 256)


def spi_label(lines: dict[str, Column], word_bits: int, complete: Column, incomplete_bits: Column, most: int = 8) -> Column:
    """``MOSI [12 …] · MISO [34 …] · Incomplete (n bits)`` of a transaction; lines that are null are left out."""
    digits = max(1, -(-word_bits // 4))
    parts = []
    for name, values in lines.items():
        shown = F.array_join(F.transform(F.slice(values, 1, most), lambda x: hex_text(x, digits)), " ")
        more = F.when(F.size(values) > most, F.concat(F.lit(" … +"), (F.size(values) - most).cast("string"))).otherwise("")
        parts.append(F.when(values.isNotNull(), F.concat(F.lit(f"{name.upper()} ["), shown, more, F.lit("]"))))
    rest = F.when(incomplete_bits > 0, F.concat(F.lit("Incomplete ("), incomplete_bits.cast("string"), F.lit(" bits)"))).otherwise("Incomplete")
    parts.append(F.when(~complete, rest))
    return F.substring(F.concat_ws(" · ", *parts), 1, 256)


def container_label(x: Column, kind: str) -> Column:
    """``list[n]`` or ``map[n]``: what a packet shows whose value has no form of its own."""
    return F.concat(F.lit(f"{kind}["), F.size(x).cast("string"), F.lit("]"))


def template_parts(template: str, inputs: int) -> list[str | tuple[int, int]]:
    """Literal texts and (input, zero-padded width) of a template like ``frame_{0:04}``; ``{n}`` is input 0.

    Braces that name no input stay as they are.
    """
    parts: list[str | tuple[int, int]] = []
    at = 0
    for m in re.finditer(r"\{(n|\d+)(?::0(\d+))?\}", template):
        number = 0 if m[1] == "n" else int(m[1])
        if number < inputs:
            parts += [template[at : m.start()], (number, int(m[2] or 0))]
            at = m.end()
    return [*parts, template[at:]]


def template_text(template: str, columns: list[Column]) -> Column:
    """A template over integer columns; padding counts the sign."""

    def padded(x: Column, width: int) -> Column:
        text = F.abs(x).cast("string")
        room = F.lit(width) - F.when(x < 0, 1).otherwise(0)
        body = F.when(F.length(text) < room, F.lpad(text, width, "0")).otherwise(text)
        body = F.when((x < 0) & (F.length(text) < room), F.lpad(text, max(width - 1, 0), "0")).otherwise(body)
        return F.concat(F.when(x < 0, "-").otherwise(""), body)

    return F.concat(F.lit(""), *(F.lit(p) if isinstance(p, str) else padded(columns[p[0]], p[1]) for p in template_parts(template, len(columns))))


def little_endian(x: Column, width: int) -> Column:
    """The low ``width`` (1, 2 or 4) bytes of a number, least significant first."""
    bytes_ = [F.lpad(F.hex(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(width)]
    return F.unhex(F.concat(*bytes_))


def position_of(ns: Column, step_ns: int, rounded: bool = False) -> Column:
    """Sample position of a time: truncated, or rounded half up."""
    return floor_div(ns + (step_ns // 2 if rounded else 0), step_ns)


def step_of(samplerate_hz: float) -> int:
    """Whole nanoseconds of a sample, truncated."""
    return int(1e9 / samplerate_hz)


TAGS = {"start": signed((1 << 64) - 1), "stop": signed((1 << 64) - 2), "error": signed((1 << 64) - 3)}
