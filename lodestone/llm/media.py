"""Media columns: Netpbm and BMP images as arrays, area-resized tiles and difference hashes.

A media column holds whole image files as bytes. Decoding covers Netpbm (P1 to P6, 8 bits) and
uncompressed BMP (1, 4, 8, 24 and 32 bits). An image is resized by area: its integral image is read
at fractional cell edges, which weighs every covered pixel by the part of it that a cell covers. The
tile is written as an NPY file into a binary column, and the difference hash compares neighbouring cells
of a 9 x 8 tile of the image's brightness.

Defined results: bytes that are no such image, whatever is wrong with them, give null features
(``decode`` raises ValueError); null text is empty; an image of no pixels has a tile of zeros; repeated
rows are processed alike; ``features`` keeps further columns.
"""

from __future__ import annotations

import hashlib
import io
import math
import re
import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batch, prepare
from lodestone.session import materialize

#: Bytes in a row of pixels of a stored text.
ROW = 64
_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary grey map (P5) of an array of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit BMP with a grey palette."""
    height, width = samples.shape
    pad = -width % 4
    rows = np.pad(samples[::-1], ((0, 0), (0, pad))).tobytes()
    palette = b"".join(bytes((k, k, k, 0)) for k in range(256))
    head = struct.pack("<2sIHHI", b"BM", 54 + 1024 + len(rows), 0, 0, 54 + 1024)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, len(rows), 2835, 2835, 256, 0) + palette + rows


#: Most pixels of an image that is decoded: a header may promise any number.
MOST_PIXELS = 1 << 31


def _bytes_at(raw: bytes, n: int, at: int) -> np.ndarray:
    if n < 0 or at < 0 or at + n > len(raw):
        raise ValueError("image is cut short")
    return np.frombuffer(raw, np.uint8, n, at)


def _netpbm(raw: bytes) -> np.ndarray:
    kind, at, fields = raw[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _FIELD.match(raw, at)) or len(m[1]) > 10:
            raise ValueError("netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, top = (*fields, 1)[:3]
    if not 0 < top < 256:
        raise ValueError("netpbm samples of more than 8 bits")
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    n = math.prod(shape)
    if n > MOST_PIXELS:
        raise ValueError("netpbm image of too many pixels")
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", raw[at:])
        words = re.findall(rb"[01]", body) if kind == b"P1" else body.split()
        if len(words) < n or max(map(len, words[:n]), default=0) > 10:
            raise ValueError("netpbm body")
        out = np.array([int(x) for x in words[:n]], np.int64)
    elif kind == b"P4":
        line = -(-width // 8)
        out = np.unpackbits(_bytes_at(raw, line * height, at + 1).reshape(height, line), axis=1)[:, :width]
    else:
        out = _bytes_at(raw, n, at + 1)
    if out.size and (out.min() < 0 or out.max() > top):
        raise ValueError("netpbm sample above its maximum")
    out = out.reshape(shape)
    if kind in (b"P1", b"P4"):
        return ((1 - out) * 255).astype(np.uint8)
    return out.astype(np.uint8) if top == 255 else np.rint(out * (255.0 / top)).astype(np.uint8)


def _bmp(raw: bytes) -> np.ndarray:
    body = struct.unpack_from("<I", raw, 10)[0]
    size, width, height, _, depth, packed = struct.unpack_from("<IiiHHI", raw, 14)
    colours = struct.unpack_from("<I", raw, 46)[0]
    if packed or depth not in (1, 4, 8, 24, 32) or width < 0:
        raise ValueError("BMP of an unsupported kind")
    rows, line = abs(height), -(-width * depth // 32) * 4
    if rows * width > MOST_PIXELS:
        raise ValueError("BMP of too many pixels")
    data = _bytes_at(raw, line * rows, body).reshape(rows, line)
    if depth <= 8:
        n = colours or 1 << depth
        if n > 1 << depth:
            raise ValueError("BMP palette")
        palette = _bytes_at(raw, 4 * n, 14 + size).reshape(n, 4)[:, 2::-1]
        if depth == 8:
            index = data[:, :width]
        else:
            per = 8 // depth
            shifts = np.arange(per - 1, -1, -1) * depth
            index = ((data[:, :, None] >> shifts) & ((1 << depth) - 1)).reshape(rows, line * per)[:, :width]
        if index.size and index.max() >= n:
            raise ValueError("BMP pixel beyond its palette")
        out = palette[index]
        if (palette == palette[:, :1]).all():
            out = out[:, :, 0]
    else:
        k = depth // 8
        out = data[:, : width * k].reshape(rows, width, k)[:, :, 2::-1]
    return np.ascontiguousarray(out[::-1] if height > 0 else out)


def decode(raw: bytes) -> np.ndarray:
    """An image file as uint8 (height, width) or (height, width, 3); ValueError for any other bytes."""
    try:
        if re.match(rb"P[1-6]\s", raw[:3]):
            return _netpbm(raw)
        if raw[:2] == b"BM":
            return _bmp(raw)
    except struct.error as e:
        raise ValueError("image is cut short") from e
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean brightness under each cell of an even grid, float64 (height, width)."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    h, w = grey.shape
    if not h or not w:
        return np.zeros((height, width))
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(grey, 0, dtype=np.float64), 1, out=total[1:, 1:])

    def along(sums: np.ndarray, cells: int) -> np.ndarray:
        at = np.arange(cells + 1) * (len(sums) - 1) / cells
        low = np.minimum(at.astype(np.int64), len(sums) - 2)
        part = (at - low)[:, None]
        return np.diff(sums[low] * (1 - part) + sums[low + 1] * part, axis=0)

    return along(along(total, height).T, width).T * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each cell of a 9 x 8 tile is brighter than its right neighbour."""
    tile = area_resize(image, 8, 9)
    return np.packbits(tile[:, :-1] > tile[:, 1:] + 1e-9).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 16) -> bytes:
    """A tile of ``side`` x ``side`` 8-bit samples as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(image, side, side)).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


ENCODERS = {"pgm": encode_pgm, "bmp": encode_bmp}


def store_texts(docs: DataFrame, formats: Sequence[str] = ("pgm", "bmp")) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, zeros to a multiple of 64, as a grey image 64 wide.

    Of several formats a text's own hash picks one, so equal texts are stored alike.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    encoders = [ENCODERS[f] for f in formats]

    def images(batches):
        for b in batches:
            raw = [(x or "").encode() for x in b.column("text").to_pylist()]
            media = []
            for x in raw:
                rows = max(1, -(-len(x) // ROW))
                encode = encoders[zlib.crc32(x) % len(encoders)]
                media.append(encode(np.frombuffer(x.ljust(rows * ROW, b"\0"), np.uint8).reshape(rows, ROW)))
            yield batch(schema, doc_id=b.column("doc_id"), n_bytes=[len(x) for x in raw], media=media)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(images, "doc_id long, n_bytes long, media binary")


def described(raw: bytes, side: int = 16) -> tuple:
    """(height, width, difference hash, NPY tile) of an image file, nulls if it is none."""
    try:
        image = decode(raw)
    except ValueError:
        return (None,) * 4
    return image.shape[0], image.shape[1], difference_hash(image), npy_tile(image, side)


FEATURES = pa.schema([("height", pa.int32()), ("width", pa.int32()), ("dhash", pa.string()), ("tile", pa.binary())])


def features(images: DataFrame, media: str = "media", side: int = 16) -> DataFrame:
    """``images`` with height, width, dhash and an NPY tile of each file in its media column."""
    prepare(images.sparkSession)
    names = images.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema)

    def add(batches):
        for b in batches:
            rows = [described(raw or b"", side) for raw in b.column(media).to_pylist()]
            more = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(FEATURES)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*names, *FEATURES.names])

    return images.mapInArrow(add, f"{kinds}, height int, width int, dhash string, tile binary")


def query(docs: DataFrame) -> DataFrame:
    """The contract's digest: images are stored and read back, their tiles are written and read back too."""
    stored = materialize(store_texts(docs), "media", "zstd")
    read_back = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("media_format", pa.string())]
    names = [*features(stored).drop("media").columns, *(n for n, _ in read_back)]

    def digest(batches):
        for b in batches:
            media = b.column("media").to_pylist()
            payload = [decode(x).tobytes() for x in media]
            own = ([len(x) for x in payload], [hashlib.sha256(x).hexdigest() for x in payload], [zlib.crc32(x[-ROW:]) for x in payload], [len(x) for x in media], [hashlib.sha256(x).hexdigest() for x in media], ["bmp" if x[:2] == b"BM" else "pgm" for x in media])
            more = [pa.array(x, t) for x, (_, t) in zip(own, read_back, strict=True)]
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(b.schema.names, b.columns, strict=True) if n != "media"), *more], names=names)

    kinds = "doc_id long, n_bytes long, height int, width int, dhash string, tile binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, media_format string"
    tiles = materialize(features(stored).mapInArrow(digest, kinds), "tiles", "zstd")

    @F.pandas_udf("mean_brightness double, tile_crc32 long")
    def of_tile(tile: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"mean_brightness": [float(np.load(io.BytesIO(x), allow_pickle=False).mean()) for x in tile], "tile_crc32": [zlib.crc32(x) for x in tile]})

    return tiles.withColumn("_tile", of_tile("tile")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.col("dhash").alias("feature"), "media_format", "height", "_tile.mean_brightness", "_tile.tile_crc32",
    )
