"""The decoder on streams that the repository's encoder didn't make: bits put together by hand from the format's text, and another encoder's file."""

import base64

import numpy as np
import pytest

from segmill.llm import webp as w


def file_of(fields: list[tuple[int, int]]) -> bytes:
    """(value, bits) fields, lowest bit first, as a lossless file."""
    value = place = 0
    for v, n in fields:
        value |= v << place
        place += n
    data = value.to_bytes((place + 7) // 8, "little")
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def head(width: int, height: int) -> list[tuple[int, int]]:
    return [(0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)]


def one(symbol: int) -> list[tuple[int, int]]:
    """A code of a single symbol: simple, one symbol, of eight bits."""
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def two(a: int, b: int) -> list[tuple[int, int]]:
    return [(1, 1), (1, 1), (1, 1), (a, 8), (b, 8)]


#: No transform, no cache, one group of codes.
PLAIN = [(0, 1), (0, 1), (0, 1)]
#: Green, red, blue, alpha and distance.
CODES = [*two(10, 200), *one(77), *one(1), *one(255), *one(0)]


def test_two_symbols_of_green():
    (px,) = w.decode(file_of(head(3, 1) + PLAIN + CODES + [(0, 1), (1, 1), (0, 1)]))
    assert px.tolist() == [[[255, 77, 10, 1], [255, 77, 200, 1], [255, 77, 10, 1]]]


def test_subtracted_green():
    (px,) = w.decode(file_of(head(2, 1) + [(1, 1), (2, 2)] + PLAIN + CODES + [(0, 1), (1, 1)]))
    assert px.tolist() == [[[255, 87, 10, 11], [255, (77 + 200) & 255, 200, 201]]]


def test_predicted_from_the_left():
    # Tiles of 4 x 4, all of mode 1 (left): an image of one tile whose green is the mode. The first pixel is predicted as opaque black.
    tiles = [(0, 1), *one(1), *one(0), *one(0), *one(0), *one(0)]
    (px,) = w.decode(file_of(head(3, 1) + [(1, 1), (0, 2), (0, 3)] + tiles + PLAIN + [*two(10, 20), *one(0), *one(3), *one(0), *one(0)] + [(0, 1), (1, 1), (1, 1)]))
    assert px.tolist() == [[[255, 0, 10, 3], [255, 0, 30, 6], [255, 0, 50, 9]]]


def test_palette_of_two_colours_in_one_byte():
    # Eight pixels to a byte; the second colour is a change against the first.
    table = [(0, 1), *two(10, 90), *one(0), *one(5), *one(255), *one(0), (0, 1), (1, 1)]
    (px,) = w.decode(file_of(head(5, 1) + [(1, 1), (3, 2), (1, 8)] + table + PLAIN + [*one(0b10110), *one(0), *one(0), *one(0), *one(0)]))
    first, second = [255, 0, 10, 5], [254, 0, 100, 10]
    assert px.tolist() == [[first, second, second, first, second]]


def test_another_encoders_file():
    # A well-known probe for lossless support: one transparent pixel.
    (px,) = w.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert px.shape == (1, 1, 4) and not px.any()


def test_many_together_as_one_by_one():
    files = [file_of(head(2, 1) + PLAIN + CODES + [(a, 1), (b, 1)]) for a in (0, 1) for b in (0, 1)] * 60
    assert all(np.array_equal(a[0], w.decode(f)[0]) for a, f in zip(w.decode_many(files), files))


def test_broken_streams_raise():
    with pytest.raises(ValueError):
        w.decode(file_of([(0x2E, 8), (0, 32)]))
