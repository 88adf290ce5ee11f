"""The bytes of a backup chunk: a CBOR sequence of a header, stream sections of checked blocks, and a
completion record. Small helpers for single chunks; :mod:`tidelog.operators.backup` runs them over a log."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from tidelog.functions.checksum import crc32c

#: Fixed values of the format.
MAGIC = b"nxch"
FORMAT = 2
COMPLETION_TAG = 60000


class ChunkError(ValueError):
    """A chunk that is not complete and intact."""


class Torn(ChunkError):
    """The bytes end inside an item."""


def head(major: int, value: int) -> bytes:
    if value < 24:
        return bytes([major << 5 | value])
    for code, form, limit in ((24, ">B", 1 << 8), (25, ">H", 1 << 16), (26, ">I", 1 << 32), (27, ">Q", 1 << 64)):
        if value < limit:
            return bytes([major << 5 | code]) + struct.pack(form, value)
    raise ChunkError("integer too large")


def encode(value: object) -> bytes:
    if isinstance(value, int):
        return head(0, value)
    if isinstance(value, (bytes, bytearray)):
        return head(2, len(value)) + bytes(value)
    if isinstance(value, str):
        raw = value.encode()
        return head(3, len(raw)) + raw
    if isinstance(value, list):
        return head(4, len(value)) + b"".join(map(encode, value))
    if isinstance(value, dict):
        return head(5, len(value)) + b"".join(encode(k) + encode(v) for k, v in value.items())
    raise TypeError(type(value))


@dataclass
class Tagged:
    tag: int
    value: object


def decode(data: bytes, at: int, depth: int = 0) -> tuple[object, int]:
    """The item at a place and the place behind it. Only what the format uses is accepted."""
    if at >= len(data):
        raise Torn("no item")
    major, code, at = data[at] >> 5, data[at] & 31, at + 1
    if major == 7 and code == 22:
        return None, at
    if code < 24:
        value = code
    elif code <= 27:
        size = 1 << code - 24
        if at + size > len(data):
            raise Torn("short integer")
        value, at = int.from_bytes(data[at : at + size], "big"), at + size
    else:
        raise ChunkError("indefinite length")
    if major == 0:
        return value, at
    if major in (2, 3):
        if at + value > len(data):
            raise Torn("short string")
        raw = bytes(data[at : at + value])
        try:
            return (raw if major == 2 else raw.decode()), at + value
        except UnicodeDecodeError as e:
            raise ChunkError("text is not UTF-8") from e
    if depth > 8:
        raise ChunkError("nested too deep")
    if major == 4:
        items = []
        for _ in range(value):
            item, at = decode(data, at, depth + 1)
            items.append(item)
        return items, at
    if major == 5:
        found: dict = {}
        for _ in range(value):
            key, at = decode(data, at, depth + 1)
            item, at = decode(data, at, depth + 1)
            if not isinstance(key, int) or key in found or key >= 1 << 32:
                raise ChunkError("bad map key")
            found[key] = item
        return found, at
    if major == 6:
        item, at = decode(data, at, depth + 1)
        return Tagged(value, item), at
    raise ChunkError("unexpected item")


def block(version: int, schema: int, event_type: str, payload: bytes, metadata: bytes | None = None) -> bytes:
    body = {0: version, 1: schema, 2: event_type, **({} if metadata is None else {3: metadata}), 4: payload}
    raw = encode(body)
    return encode([crc32c(raw), raw])


def header(origin: bytes | None = None) -> bytes:
    return encode({0: MAGIC, 1: FORMAT, **({} if origin is None else {2: origin})})


def completion(sections: int, events: int, prefix: bytes) -> bytes:
    return head(6, COMPLETION_TAG) + encode([sections, events, len(prefix), crc32c(prefix)])


@dataclass
class Chunk:
    origin: bytes | None
    #: (stream id, [(version, schema, type, metadata, payload) or None for a corrupt block])
    sections: list[tuple[bytes, list[tuple | None]]] = field(default_factory=list)
    completion: str = "Complete"


def _event(raw: bytes) -> tuple:
    body, end = decode(raw, 0)
    if end != len(raw) or not isinstance(body, dict) or not {0, 1, 2, 4} <= set(body):
        raise ChunkError("bad block body")
    version, schema, event_type, metadata, payload = (body.get(k) for k in range(5))
    if not (isinstance(version, int) and isinstance(schema, int) and isinstance(event_type, str) and isinstance(payload, bytes)):
        raise ChunkError("bad field")
    if version < 1 or not 1 <= schema < 1 << 32 or (metadata is not None and (not isinstance(metadata, bytes) or not metadata)):
        raise ChunkError("bad field")
    return version, schema, event_type, metadata, payload


def salvage(data: bytes) -> Chunk:
    """What can be recovered: a torn last item is left out, blocks with a wrong checksum are marked."""
    first, at = decode(data, 0)
    if not isinstance(first, dict) or first.get(0) != MAGIC or first.get(1) not in (1, FORMAT):
        raise ChunkError("not a chunk")
    chunk, done, blocks = Chunk(first.get(2)), None, 0
    while at < len(data):
        start = at
        try:
            item, at = decode(data, at)
        except Torn:
            break
        if done is not None:
            chunk.completion = "Trailing"
            return chunk
        if isinstance(item, Tagged):
            good = item.tag == COMPLETION_TAG and item.value == [len(chunk.sections), blocks, start, crc32c(data[:start])]
            done = "Complete" if good else "Mismatch"
        elif isinstance(item, dict) and isinstance(item.get(0), bytes):
            chunk.sections.append((item[0], []))
        elif isinstance(item, list) and len(item) == 2 and isinstance(item[0], int) and isinstance(item[1], bytes) and chunk.sections:
            chunk.sections[-1][1].append(_event(item[1]) if crc32c(item[1]) == item[0] else None)
            blocks += 1
        else:
            raise ChunkError("unexpected item")
    chunk.completion = "Legacy" if first.get(1) == 1 else done or "Missing"
    return chunk


def strict(data: bytes) -> Chunk:
    """A complete, intact chunk, or ChunkError."""
    chunk = salvage(data)
    if chunk.completion != "Complete":
        raise ChunkError(chunk.completion)
    if any(e is None for _, events in chunk.sections for e in events):
        raise ChunkError("Corrupt")
    return chunk


def pack(sections: Iterator[tuple[bytes, list[bytes]]], origin: bytes | None = None) -> bytes:
    """A complete chunk of (stream id, encoded blocks)."""
    out, n, events = [header(origin)], 0, 0
    for stream, blocks in sections:
        out += [encode({0: stream}), *blocks]
        n, events = n + 1, events + len(blocks)
    prefix = b"".join(out)
    return prefix + completion(n, events, prefix)
