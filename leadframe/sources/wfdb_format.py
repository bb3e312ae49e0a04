"""Bytes of Waveform Database files: signal frames and annotation streams."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

from leadframe.functions.dims import ANNOTATIONS

#: Bytes of one sample; two channels of format 212 share three bytes.
SAMPLE_BYTES = {8: 1.0, 80: 1.0, 16: 2.0, 24: 3.0, 32: 4.0, 212: 1.5}
LIMITS = {8: (-128, 127), 80: (-128, 127), 16: (-32768, 32767), 24: (-8388608, 8388607), 32: (-2147483648, 2147483647), 212: (-2048, 2047)}

SYMBOL = {code: symbol for code, symbol, _, _ in ANNOTATIONS}
CODE = {symbol: code for code, symbol in SYMBOL.items()} | {"": 0}
# Annotation words that carry no mark of their own.
SKIP, NUM, SUB, CHN, AUX = 59, 60, 61, 62, 63


def layout(formats: Sequence[int]) -> tuple[list[tuple[int, int, int]], int]:
    """Per channel (format, first byte in the frame, place in a 212 pair), and the bytes of a frame."""
    out, at, i = [], 0, 0
    while i < len(formats):
        f = formats[i]
        if f not in SAMPLE_BYTES:
            raise ValueError(f"storage format {f} is not supported")
        if f == 212:
            if i + 1 >= len(formats) or formats[i + 1] != 212:
                raise ValueError("format 212 needs channels in adjacent pairs")
            out += [(212, at, 0), (212, at, 1)]
            at, i = at + 3, i + 2
        else:
            out.append((f, at, 0))
            at, i = at + int(SAMPLE_BYTES[f]), i + 1
    return out, at


def decode(data: bytes, formats: Sequence[int], wanted: Sequence[int] | None = None) -> np.ndarray:
    """Counts as (frames, channels); only the ``wanted`` channels (from 0, repeats allowed) are unpacked."""
    places, size = layout(formats)
    raw = np.frombuffer(data, np.uint8)
    raw = raw[: len(raw) // size * size].reshape(-1, size).astype(np.int32)
    columns = []
    for i in range(len(formats)) if wanted is None else wanted:
        f, at, half = places[i]
        if f == 212:
            v = raw[:, at] | (raw[:, at + 1] & 0x0F) << 8 if half == 0 else raw[:, at + 2] | (raw[:, at + 1] & 0xF0) << 4
            v = np.where(v > 2047, v - 4096, v)
        else:
            width = int(SAMPLE_BYTES[f])
            v = np.zeros(len(raw), np.int64)
            for k in range(width):
                v |= raw[:, at + k].astype(np.int64) << 8 * k
            v = np.where(v >= 1 << 8 * width - 1, v - (1 << 8 * width), v)
        columns.append(v.astype(np.int64))
    return np.stack(columns, axis=1) if columns else np.zeros((len(raw), 0), np.int64)


def encode(counts: np.ndarray, formats: Sequence[int]) -> bytes:
    """Frames of counts, each held within the range of its format."""
    places, size = layout(formats)
    out = np.zeros((len(counts), size), np.uint8)
    for i, (f, at, half) in enumerate(places):
        v = np.clip(np.asarray(counts[:, i], np.int64), *LIMITS[f])
        if f == 212:
            v &= 0xFFF
            out[:, at + 2 * half] = v & 0xFF
            out[:, at + 1] |= (v >> 8 << 4 * half).astype(np.uint8)
        else:
            for k in range(int(SAMPLE_BYTES[f])):
                out[:, at + k] = v >> 8 * k & 0xFF
    return out.tobytes()


def decode_annotations(data: bytes) -> list[dict]:
    """Marks of an annotation stream: sample, type, subtype, channel, number. An unknown code reads as ``?``."""
    out: list[dict] = []
    waiting = {"subtype": 0, "channel": 0, "number": 0}
    field = {NUM: "number", SUB: "subtype", CHN: "channel"}
    clock, at = 0, 0
    while at + 2 <= len(data):
        low, high = data[at], data[at + 1]
        at += 2
        code, interval = high >> 2, (high & 3) << 8 | low
        if code == 0 and interval == 0:
            break
        if code == SKIP:
            if at + 4 > len(data):
                break
            upper, lower = struct.unpack_from("<hH", data, at)
            clock += (upper << 16) + lower
            at += 4
        elif code in field:
            (out[-1] if out else waiting)[field[code]] = interval
        elif code == AUX:
            at += interval + interval % 2
        else:
            clock += interval
            out.append({"sample": clock, "type": SYMBOL.get(code, "?")} | waiting)
            waiting = {"subtype": 0, "channel": 0, "number": 0}
    return out


def encode_annotations(marks: Sequence[dict]) -> bytes:
    """The stream of marks in order of sample; of equal samples the given order stays."""
    out, clock = bytearray(), 0

    def word(code: int, value: int) -> None:
        out.extend((value & 0xFF, code << 2 | value >> 8))

    for m in sorted(marks, key=lambda m: m["sample"]):
        kind = (m.get("type") or "").strip() or (" " if m.get("type") == " " else "")
        if kind not in CODE:
            raise ValueError(f"unknown annotation type {kind!r}")
        step, code = int(m["sample"]) - clock, CODE[kind]
        if step < 0:
            raise ValueError("negative sample")
        if code == 0 and step == 0:
            raise ValueError("an annotation without a type at the last sample would end the file")
        if step > 1023:
            word(SKIP, 0)
            out.extend(struct.pack("<HH", step >> 16 & 0xFFFF, step & 0xFFFF))
            step = 0
            if code == 0:
                raise ValueError("an annotation without a type needs a short distance")
        word(code, step)
        for kind_code, name in ((SUB, "subtype"), (CHN, "channel"), (NUM, "number")):
            value = m.get(name)
            value = value if isinstance(value, int) else int(value) if isinstance(value, str) and value.lstrip("-").isdigit() else 0
            if not 0 <= value <= 1023:
                raise ValueError(f"{name} must be from 0 to 1023")
            if value:
                word(kind_code, value)
        clock = int(m["sample"])
    out.extend((0, 0))
    return bytes(out)
