import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.functions import chunk
from tidelog.functions.checksum import _many, crc32c


def test_fixed_bytes():
    assert chunk.header(b"dev").hex(" ") == "a3 00 44 6e 78 63 68 01 02 02 43 64 65 76"
    assert chunk.block(1, 1, "E", b"hi").hex(" ") == "82 1a cf f9 cc 83 4c a4 00 01 01 01 02 61 45 04 42 68 69"
    assert crc32c(b"123456789") == 0xE3069283


@given(st.lists(st.binary(max_size=40), max_size=20))
def test_many_checksums(values):
    assert _many(values).tolist() == [crc32c(v) for v in values]


SECTIONS = [(b"a", [(1, 1, "E", None, b""), (2, 3, "Ü", b"m", b"\x00" * 300)]), (b"", []), (b"z" * 30, [(9, 1, "", None, b"x")])]


def packed():
    return chunk.pack(iter((s, [chunk.block(v, sv, t, p, m) for v, sv, t, m, p in es]) for s, es in SECTIONS), b"me")


def test_round_trip():
    got = chunk.strict(packed())
    assert (got.origin, got.sections) == (b"me", SECTIONS)


def test_every_torn_chunk_is_refused_and_salvaged():
    data = packed()
    for n in range(len(data)):
        with pytest.raises(chunk.ChunkError):
            chunk.strict(data[:n])
        if n >= len(chunk.header(b"me")):
            found = chunk.salvage(data[:n])
            assert found.completion == "Missing"
            assert all(full[: len(part)] == part for (_, part), (_, full) in zip(found.sections, SECTIONS))


def test_damaged_blocks_are_marked():
    data = bytearray(packed())
    at = bytes(data).index(b"\x00" * 300)
    data[at + 7] ^= 1
    found = chunk.salvage(bytes(data))
    assert found.sections[0][1] == [SECTIONS[0][1][0], None] and found.completion == "Mismatch"
    with pytest.raises(chunk.ChunkError):
        chunk.strict(bytes(data))
    assert chunk.salvage(packed() + b"\x00").completion == "Trailing"


@settings(max_examples=300)
@given(st.binary(max_size=80))
def test_any_bytes_give_a_chunk_or_its_error(data):
    for prefix in (b"", chunk.header()):
        try:
            chunk.salvage(prefix + data)
        except chunk.ChunkError:
            pass
