"""TIFF columns: image directories are walked, strips and tiles decoded, one row per page.

Read: both byte orders, any chain of directories, strips and tiles, chunky and planar samples of 8,
16 or 32 bits, no compression, LZW, deflate and PackBits, predictors 1 to 3. tiff_store() writes a
text losslessly as 8-bit RGB pages whose layout depends on the content alone. A page has PAGE_ROWS rows;
texts that would need over MOST_PAGES pages get higher ones, MOST_PAGES of them, and are stored whole too.

Cases: null media have no pages. Media that are not TIFF, or break off, give the pages before the
fault and one row whose ``error`` says what is wrong and whose samples are null. A directory that
is met twice ends the chain with such a row. An empty text is stored as one row of blanks. Repeated rows
give rows each, equal texts equal files; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped

# Fixed values of the format: tags, compressions, field types and their sizes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODE = {1: "B", 3: "H", 4: "I"}
CLEAR, END, FIRST = 256, 257, 258
LAST_ENTRY = 4094

# ---- LZW: codes between two clears have widths that depend on their number alone ----
_WIDTHS = np.array([9] * 254 + [10] * 512 + [11] * 1024 + [12] * (LAST_ENTRY - 2046 + 1), np.int64)
_PLACES = np.concatenate([[0], np.cumsum(_WIDTHS)])[:-1]
_SINGLE = [bytes([i]) for i in range(256)] + [b"", b""]


def lzw_codes(data: bytes) -> list[list[int]]:
    """The codes, one list for each filling of the table."""
    runs, codes, table, free = [], [], {}, FIRST
    if not data:
        return [[]]
    known, put, at = table.get, codes.append, data[0]
    for b in memoryview(data)[1:]:
        longer = known(key := at << 8 | b)
        if longer is not None:
            at = longer
            continue
        put(at)
        table[key] = free
        at = b
        free += 1
        if free > LAST_ENTRY:
            runs.append(codes)
            codes, table, free = [], {}, FIRST
            known, put = table.get, codes.append
    put(at)
    return [*runs, codes]


def lzw_encode(data: bytes) -> bytes:
    codes, widths = [CLEAR], [9]
    for i, run in enumerate(runs := lzw_codes(data)):
        ending = [CLEAR] if i + 1 < len(runs) or len(run) == len(_WIDTHS) - 1 else [END]
        codes += run + ending
        widths += _WIDTHS[: len(run) + 1].tolist()
    if codes[-1] == CLEAR:
        codes.append(END)
        widths.append(9)
    c, w = np.array(codes), np.array(widths)
    bits = (c[:, None] >> (w[:, None] - 1 - np.arange(12)).clip(0)) & 1
    return np.packbits(bits.astype(np.uint8)[np.arange(12) < w[:, None]]).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    padded = np.frombuffer(data + bytes(8), np.uint8).astype(np.int64)
    out, at, bits, got = [], 0, len(data) * 8, 0
    first = int.from_bytes(data[:2].ljust(2, b"\0"), "big") >> 7
    if first == CLEAR:
        at = 9
    while at + 9 <= bits and got < size:
        n = int(np.searchsorted(_PLACES + _WIDTHS, bits - at, "right"))
        place, width = at + _PLACES[:n], _WIDTHS[:n]
        byte = place >> 3
        window = padded[byte] << 24 | padded[byte + 1] << 16 | padded[byte + 2] << 8 | padded[byte + 3]
        codes = window >> (32 - (place & 7) - width) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        end = int(stops[0]) if len(stops) else n
        table, last = _SINGLE.copy(), b""
        for code in codes[:end].tolist():
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            out.append(entry)
            got += len(entry)
            if last:
                table.append(last + entry[:1])
            last = entry
        if not len(stops) or codes[end] == END:
            break
        at = int(at + _PLACES[end] + _WIDTHS[end])
    return b"".join(out)


# ---- PackBits ----
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(data: bytes, row: int) -> bytes:
    """Every row of so many bytes is packed for itself."""
    out = []

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            out.append(bytes([len(part[i : i + 128]) - 1]) + part[i : i + 128])

    for i in range(0, len(data), row):
        line, done = data[i : i + row], 0
        for m in _RUN.finditer(line):
            literal(line[done : m.start()])
            out.append(bytes([257 - (m.end() - m.start())]) + m[1])
            done = m.end()
        literal(line[done:])
    return b"".join(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, got = [], 0, 0
    while i < len(data) and got < size:
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + n + 2])
            i += n + 2
        elif n > 128:
            out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
        else:
            i += 1
            continue
        got += len(out[-1])
    return b"".join(out)


# ---- predictors ----
def difference(block: np.ndarray) -> np.ndarray:
    """Predictor 2 of rows x columns x samples."""
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def undo(block: bytes, predictor: int, rows: int, columns: int, samples: int, bits: int, order: str) -> bytes:
    if predictor == 1:
        return block
    if predictor == 2 and bits in (8, 16, 32):
        kind = np.dtype(f"{order}u{bits // 8}")
        pixels = np.frombuffer(block, kind).reshape(rows, columns, samples).astype(kind.newbyteorder("="))
        return np.cumsum(pixels, axis=1, dtype=pixels.dtype).astype(kind).tobytes()
    if predictor == 3 and bits == 32:
        plain = np.frombuffer(block, np.uint8).reshape(rows, -1, samples)
        plain = np.cumsum(plain, axis=1, dtype=np.uint8).reshape(rows, 4, columns * samples)
        return np.ascontiguousarray(plain.transpose(0, 2, 1)[:, :, :: 1 if order == ">" else -1]).tobytes()
    raise ValueError(f"predictor {predictor} of {bits} bits")


# ---- reading ----
def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple[int, ...]]]]:
    """Byte order and tags of each image directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the directories form a circle")
        seen.add(at)
        tags = {}
        (n,) = struct.unpack_from(order + "H", data, at)
        for i in range(n):
            place = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(order + "HHI", data, place)
            if kind in FIELD_CODE:
                inline = count * FIELD_BYTES[kind] <= 4
                start = place + 8 if inline else struct.unpack_from(order + "I", data, place + 8)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{FIELD_CODE[kind]}", data, start)
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def decompressed(part: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = part
    elif compression == LZW:
        out = lzw_decode(part, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompress(part)
    elif compression == PACKBITS:
        out = packbits_decode(part, size)
    else:
        raise ValueError(f"compression {compression}")
    if len(out) < size:
        raise ValueError(f"a block has {len(out)} of {size} bytes")
    return out[:size]


def page(data: bytes, order: str, tags: dict[int, tuple[int, ...]]) -> dict:
    """Size, layout and samples (rows x columns x samples, in the file's byte order) of a directory."""
    one = lambda tag, default: tags[tag][0] if tags.get(tag) else default
    width, height, samples, bits = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planar, tiled = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1), TILE_OFFSETS in tags
    if not width or not height or bits not in (8, 16, 32) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise ValueError(f"{width} x {height} with samples of {tags.get(BITS)} bits")
    b = bits // 8
    across, down = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    columns, rows, planes, inside = -(-width // across), -(-height // down), samples if planar == 2 else 1, 1 if planar == 2 else samples
    if min(len(offsets), len(counts)) < columns * rows * planes:
        raise ValueError("blocks are missing")
    raster = np.empty((height, width, samples * b), np.uint8)
    for k in range(columns * rows * planes):
        plane, r, c = k // (columns * rows), k // columns % rows, k % columns
        high = down if tiled else min(down, height - r * down)
        part = data[offsets[k] : offsets[k] + counts[k]]
        block = undo(decompressed(part, compression, high * across * inside * b), predictor, high, across, inside, bits, order)
        block = np.frombuffer(block, np.uint8).reshape(high, across, inside * b)
        y, x = r * down, c * across
        s = slice(plane * b, (plane + 1) * b) if planar == 2 else slice(None)
        raster[y : y + high, x : x + across, s] = block[: height - y, : width - x]
    return {"width": width, "height": height, "samples_per_pixel": samples, "bits": bits, "compression": compression, "predictor": predictor, "tiled": tiled, "planar": planar, "samples": raster.tobytes()}


def pages_of(data: bytes | None) -> list[dict]:
    """The pages of a file; a fault ends them with a page that has only an error."""
    found: list[dict] = []
    try:
        for order, tags in directories(data) if data is not None else ():
            found.append(page(data, order, tags) | {"page": len(found)})
    except (ValueError, KeyError, IndexError, struct.error, zlib.error, ZeroDivisionError, MemoryError, OverflowError) as e:
        found.append({"page": len(found), "error": f"{type(e).__name__}: {e}"})
    return found


# ---- writing ----
ROW = 192
ACROSS = 64
PAGE_ROWS, MOST_PAGES = 256, 16
#: compression, predictor, tiled: a page's layout is drawn from the content.
LAYOUTS = ((PACKBITS, 1, False), (DEFLATE, 2, True), (LZW, 1, False), (DEFLATE, 2, False), (PACKBITS, 1, True), (DEFLATE, 1, True))


def compressed(block: np.ndarray, compression: int, predictor: int) -> bytes:
    block = difference(block) if predictor == 2 else block
    raw = block.tobytes()
    if compression == LZW:
        return lzw_encode(raw)
    if compression == DEFLATE:
        return zlib.compress(raw, 6)
    if compression == PACKBITS:
        return packbits_encode(raw, block.shape[1] * block.shape[2])
    return raw


def padded(text: bytes, unit: int = ROW) -> bytes:
    return text + b" " * (max(unit, -(-len(text) // unit) * unit) - len(text))


def write(pages: list[tuple[np.ndarray, tuple[int, int, bool]]], order: str = "<", strip_rows: int = 64, tile: int = 32) -> bytes:
    """A file of 8-bit pages (rows x columns x samples), each with its layout."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image, (compression, predictor, tiled) in pages:
        height, width, samples = image.shape
        if tiled:
            full = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile, samples), np.uint8)
            full[:height, :width] = image
            blocks = [full[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            blocks = [image[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, counts = [], []
        for block in blocks:
            part = compressed(np.ascontiguousarray(block), compression, predictor)
            offsets.append(len(out))
            counts.append(len(part))
            out += part
        fields = {WIDTH: (4, [width]), LENGTH: (4, [height]), BITS: (3, [8] * samples), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        if tiled:
            fields |= {TILE_WIDTH: (3, [tile]), TILE_LENGTH: (3, [tile]), TILE_OFFSETS: (4, offsets), TILE_BYTES: (4, counts)}
        else:
            fields |= {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [strip_rows]), STRIP_BYTES: (4, counts)}
        entries = b""
        for tag, (kind, values) in sorted(fields.items()):
            packed = struct.pack(f"{order}{len(values)}{FIELD_CODE[kind]}", *values)
            if len(packed) > 4:
                out += bytes(len(out) % 2)
                packed, place = struct.pack(order + "I", len(out)), packed
                out += place
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        out += bytes(len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


def text_to_tiff(text: str | None) -> bytes:
    raster = np.frombuffer(padded((text or "").encode()), np.uint8).reshape(-1, ACROSS, 3)
    rows = max(PAGE_ROWS, -(-len(raster) // MOST_PAGES))
    turn = zlib.crc32(raster)
    return write([(raster[a : a + rows], LAYOUTS[(turn + k) % len(LAYOUTS)]) for k, a in enumerate(range(0, len(raster), rows))])


def feature(found: dict) -> str | None:
    """Size and 64-bit average hash of a page: which cells of an 8 x 8 grid are lighter than their mean."""
    if found.get("samples") is None:
        return None
    wide = found["samples_per_pixel"] * found["bits"] // 8
    light = np.frombuffer(found["samples"], np.uint8).reshape(found["height"], -1, wide).mean(axis=2)
    cells = np.array([[c.mean() if c.size else 0.0 for c in np.array_split(r, 8, axis=1)] for r in np.array_split(light, 8)])
    bits = "".join("1" if x else "0" for x in (cells > cells.mean()).ravel())
    return f"{found['width']}x{found['height']}:{int(bits, 2):016x}"


# ---- columns ----
_KINDS = {"int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "string": T.StringType()}
_FIELDS = "page int, width long, height long, samples_per_pixel int, bits int, compression int, predictor int, tiled boolean, planar int, samples binary, feature string, error string"
PAGE = T.StructType([T.StructField(n, _KINDS[k]) for n, k in map(str.split, _FIELDS.split(", "))])
SLICE = 64


def tiff_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media: each text as a TIFF file."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(text_to_tiff, part.column(1).to_pylist()), pa.binary())], ["doc_id", "media"])

    return mapped(read, store, T.StructType([read.schema["doc_id"], T.StructField("media", T.BinaryType())]))


def tiff_read(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, media and pages, an array of PAGE, of each file."""
    read = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([*read.schema.fields, T.StructField("pages", T.ArrayType(PAGE))])
    kind = to_arrow_type(T.ArrayType(PAGE))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = dict.fromkeys(PAGE.names)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                pages = [[blank | p | {"feature": feature(p)} for p in pages_of(m)] for m in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pages, kind)], ["doc_id", "media", "pages"])

    return mapped(read, decode, schema)


def tiff_pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page: doc_id and the fields of PAGE."""
    return tiff_read(media, id_col, media_col).select("doc_id", F.inline("pages"))
