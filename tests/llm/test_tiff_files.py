"""TIFF files that this package didn't write, built by hand, and op1's columns against brute force."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from scenemill.llm import queries, tiff


def built(order, directories, blocks, circle=False):
    """A file of directories (tag -> (type, values)); "block" values are replaced by offsets of ``blocks``."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    places = []
    for block in blocks:
        places.append(len(out))
        out += block
    link, first = 4, None
    for tags in directories:
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            values = [places[v] if tag in (273, 324) else v for v in values]
            packed = struct.pack(f"{order}{len(values)}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", *values)
            if len(packed) > 4:
                at = len(out)
                out += packed
                packed = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        first = first or len(out)
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += bytes(4)
    if circle:
        struct.pack_into(order + "I", out, link, first)
    return bytes(out)


def tags(width, height, samples, bits, compression, predictor=1, planar=1, **more):
    found = {256: (4, [width]), 257: (4, [height]), 258: (3, [bits] * samples), 259: (3, [compression]), 277: (3, [samples]), 284: (3, [planar]), 317: (3, [predictor])}
    return found | {int(k[1:]): v for k, v in more.items()}


RNG = np.random.default_rng(3)


def strips(image, order, bits, compression, predictor, rows):
    kind = np.dtype(f"{order}u{bits // 8}")
    out = []
    for y in range(0, len(image), rows):
        part = image[y : y + rows]
        if predictor == 2:
            part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
        raw = part.astype(kind).tobytes()
        out.append(zlib.compress(raw) if compression == 8 else raw)
    return out


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("bits", (8, 16, 32))
@pytest.mark.parametrize("predictor", (1, 2))
def test_strips_of_both_byte_orders(order, bits, predictor):
    image = RNG.integers(0, 2**bits, (7, 5, 3), np.uint64).astype(f"u{bits // 8}")
    blocks = strips(image, order, bits, 8, predictor, 3)
    data = built(order, [tags(5, 7, 3, bits, 8, predictor, t273=(4, [0, 1, 2]), t278=(3, [3]), t279=(4, [len(b) for b in blocks]))], blocks)
    (page,) = tiff.pages_of(data)
    assert "error" not in page and page["samples"] == image.astype(f"{order}u{bits // 8}").tobytes()


@pytest.mark.parametrize("order", "<>")
def test_floating_point_predictor(order):
    image = RNG.normal(size=(4, 6, 1)).astype(">f4")
    rows = []
    for row in image:  # bytes of a row by significance, then differences of neighbours
        plain = np.frombuffer(row.tobytes(), np.uint8).reshape(6, 4).T.ravel()
        rows.append(np.concatenate([plain[:1], plain[1:] - plain[:-1]]).astype(np.uint8).tobytes())
    data = built(order, [tags(6, 4, 1, 32, 1, 3, t273=(4, [0]), t278=(3, [4]), t279=(4, [96]))], [b"".join(rows)])
    assert tiff.pages_of(data)[0]["samples"] == image.astype(f"{order}f4").tobytes()


def test_planar_tiles():
    image = RNG.integers(0, 256, (20, 37, 2)).astype(np.uint8)
    full = np.zeros((32, 48, 2), np.uint8)
    full[:20, :37] = image
    blocks = [full[y : y + 16, x : x + 16, s].tobytes() for s in range(2) for y in (0, 16) for x in (0, 16, 32)]
    data = built(">", [tags(37, 20, 2, 8, 1, planar=2, t322=(3, [16]), t323=(3, [16]), t324=(4, list(range(12))), t325=(4, [256] * 12))], blocks)
    (page,) = tiff.pages_of(data)
    assert page["tiled"] and page["planar"] == 2 and page["samples"] == image.tobytes()


def test_many_directories_circles_and_broken_files(spark):
    blocks = [bytes([k] * 12) for k in range(3)]
    pages = [tags(4, 3, 1, 8, 1, t273=(4, [k]), t278=(3, [3]), t279=(4, [12])) for k in range(3)]
    whole, round_ = built("<", pages, blocks), built("<", pages, blocks, circle=True)
    huge = built("<", [tags(2**31, 2**31, 1, 8, 8, t273=(4, [0]), t278=(4, [2**31]), t279=(4, [3]))], [b"abc"])
    media = [whole, round_, whole[: len(whole) - 40], b"", None, b"II*\0", huge, b"PK\3\4" + bytes(20), whole]
    rows = spark.createDataFrame(list(enumerate(media)), "doc_id long, media binary")
    found = {}
    for r in tiff.tiff_pages(rows).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert [bytes(r.samples) for r in sorted(found[0], key=lambda r: r.page)] == blocks == [bytes(r.samples) for r in sorted(found[8], key=lambda r: r.page)]
    assert [r.error is None for r in sorted(found[1], key=lambda r: r.page)] == [True] * 3 + [False]
    assert 4 not in found and all(any(r.error for r in found[k]) for k in (2, 3, 5, 6, 7))


def test_op1_columns(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op1_tiff_pages(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        media = tiff.text_to_tiff(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_bytes == len(media) and r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert r.feature == ";".join(tiff.feature(p) for p in tiff.pages_of(media)) and r.n_pages == len(tiff.pages_of(media))
