"""The WebP encoder: every part round trip, alone and in company, and what op5's tables make of it."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from segmill.llm import webp
from segmill.llm import webp_write as ww

RNG = np.random.default_rng(8)


def kinds():
    """Images of 192 columns that should each take a part, and the part."""
    noise = RNG.integers(0, 256, (9, 192, 3), dtype=np.uint8)
    green = noise[..., 1:2].astype(np.int64)
    ramp = np.cumsum(RNG.integers(0, 5, (12 * 192, 3)), axis=0).reshape(12, 192, 3)
    rows = np.repeat(RNG.integers(0, 256, (1, 192, 3)), 30, axis=0) + np.arange(30)[:, None, None] * [1, 3, 9]
    crossed = np.concatenate([(green.astype(np.uint8).view(np.int8).astype(np.int64) * 20 >> 5) + RNG.integers(0, 4, green.shape), green, RNG.integers(0, 9, green.shape)], axis=-1)
    return {
        "noise": (noise, "prefix codes"), "one": (np.full((3, 192, 3), 7, np.uint8), "palette"), "few": (RNG.choice([1, 200], (5, 192, 3)).astype(np.uint8), "palette"),
        "many": (RNG.integers(0, 256, (70, 3), dtype=np.uint8)[RNG.integers(0, 70, (40, 192))], "palette"), "ramp": (ramp.astype(np.uint8), "predictor"), "rows": (rows.astype(np.uint8), "predictor"),
        "grey": (np.repeat(noise[..., :1], 3, axis=-1), "subtract green"), "crossed": (crossed.astype(np.uint8), "cross-colour"),
        "text": (np.frombuffer((b"the same words come again and again, but not in the same order; " * 80)[:4608], np.uint8).reshape(8, 192, 3), "back-references"),
        "words": (np.frombuffer(b"".join(RNG.choice([b"aaa", b"bcd", b"qux", *(bytes(x) for x in RNG.integers(97, 123, (400, 3), dtype=np.uint8))], 192 * 12).tolist()), np.uint8).reshape(12, 192, 3), "cache"),
    }


@pytest.mark.parametrize("name", sorted(kinds()))
def test_parts_round_trip(name):
    image, part = kinds()[name]
    media, used = ww.encode_many([image])[0], {}
    assert (webp.decode(media, used)[0] == np.concatenate([np.full((*image.shape[:2], 1), 255), image], axis=-1)).all()
    assert part in used, used
    assert name == "noise" or len(media) < image.size


def test_company_changes_nothing():
    images = [x for x, _ in kinds().values()] * 12
    together = ww.encode_many(images)
    assert together[: len(images) // 12] == [ww.encode_many([x])[0] for x in images[: len(images) // 12]]
    # Enough of them to be read together, which must give what one by one gives.
    assert len(images) >= webp.FEW
    for found, media, image in zip(webp.decode_many(together), together, images):
        assert (found[0][..., 1:] == image).all() and (found[0] == webp.decode(media)[0]).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=3000) | st.text("ab \n", max_size=3000).map(str.encode), min_size=1, max_size=4), st.integers(1, 60))
def test_any_payload_round_trip(texts, copies):
    pays = [webp.pad(t) for t in texts] * copies
    media = webp.store_many(pays)
    assert [x.tobytes() for x in webp.load_many(media)] == pays
    assert len(set(media)) == len(set(pays))


def test_streams_of_other_encoders_are_read_together(monkeypatch):
    from tests.llm import test_media_html_chat_nearest as other

    monkeypatch.setattr(webp, "FEW", 2)
    px = [other.image(11, 13) for _ in range(5)]
    media = [other.stream(13, 11, lambda w, p=p: other.entropy_image(w, [("p", v) for v in other.argb(p)], main=True)) for p in px]
    tiled = np.tile(other.image(1, 5), (4, 1, 1))
    flat = other.argb(tiled)
    media.append(other.stream(5, 4, lambda w: other.entropy_image(w, [("p", v) for v in flat[:5]] + [("b", 5, 1), ("b", 10, 130)], main=True)))
    for found, want in zip(webp.decode_many(media), [*px, tiled]):
        assert (found[0] == want).all()


def kraft(lengths):
    return sum(2.0**-n for n in lengths)


@pytest.mark.parametrize("limit", [7, 15])
def test_code_lengths(limit):
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    lists = [[5], [3, 9], fibonacci if limit == 15 else fibonacci[:19], [1] * 19, RNG.integers(1, 1000, 17).tolist()]
    lane = np.repeat(np.arange(5), [len(x) for x in lists])
    size = ww.code_lengths(lane, np.concatenate([np.array(x) for x in lists]), 5, limit)
    for i, counts in enumerate(lists):
        mine = size[lane == i].tolist()
        assert max(mine) <= limit and (len(mine) < 2 or kraft(mine) == 1)
        if i == 4 and limit == 15:
            import heapq

            heap, best = counts[:], 0
            heapq.heapify(heap)
            while len(heap) > 1:
                x = heapq.heappop(heap) + heapq.heappop(heap)
                best += x
                heapq.heappush(heap, x)
            assert sum(a * b for a, b in zip(mine, counts)) == best


def test_damaged_streams_raise_or_differ():
    image = kinds()["words"][0]
    media = ww.encode_many([image])[0]
    for at in RNG.integers(30, len(media), 60).tolist():
        bad = media[:at] + bytes([media[at] ^ 1 << at % 8]) + media[at + 1 :]
        try:
            found = webp.decode(bad)
        except (ValueError, IndexError):
            continue
        assert all(f.shape[-1] == 4 for f in found)
    with pytest.raises(ValueError):
        webp.decode(media[: len(media) // 2])


def test_every_part_is_used_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    used, stored, raw = {}, 0, 0
    for r in webp.store_texts(docs).collect():
        webp.decode(r.media, used)
        stored, raw = stored + len(r.media), raw + r.n_bytes
    # Text has no use for groups of codes, and seldom for the spatial transforms; see the README for all of sf0.1.
    assert used["prefix codes"] >= docs.count() and used["back-references"] > 800 and used["cache"] > 500 and used["palette"] > 10, used
    assert stored < 0.6 * raw
