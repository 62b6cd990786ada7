"""Media columns: Netpbm and BMP images as arrays, area-resized, tiled and hashed."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from termloom.llm.common import map_texts

WIDTH = 64


def netpbm_fields(data: bytes, n: int) -> tuple[list[int], int]:
    """n decimal header fields after the magic, comments skipped; where the pixels begin."""
    at, out = 2, []
    while len(out) < n:
        m = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)").match(data, at)
        if not m:
            raise ValueError("broken header")
        out.append(int(m[1]))
        at = m.end()
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 to an array of height x width x channels."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456" or not kind:
        raise ValueError("not Netpbm")
    bitmap, channels = kind in b"14", 3 if kind in b"36" else 1
    fields, at = netpbm_fields(data, 2 if bitmap else 3)
    (w, h), top = fields[:2], 1 if bitmap else fields[2]
    if not 1 <= top <= 65535:
        raise ValueError("broken header")
    n = w * h * channels
    if kind in b"123":
        body = re.sub(rb"#[^\n\r]*", b"", data[at - 1 :])
        flat = np.array(list(body.translate(None, b" \t\r\n\x0b\x0c")[:n] if kind == b"1" else body.split()[:n]), dtype=np.int64)
        if kind == b"1":
            flat -= 48
    elif kind == b"4":
        row = (w + 7) // 8
        flat = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)[:, :w].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at)
    if flat.size != n:
        raise ValueError("too few pixels")
    if bitmap:
        flat, top = 1 - flat, 1  # 1 is black
    return flat.reshape(h, w, channels).astype(np.uint16 if top > 255 else np.uint8)


def encode_pgm(gray: np.ndarray) -> bytes:
    h, w = gray.shape[:2]
    return b"P5\n%d %d\n255\n" % (w, h) + gray.astype(np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits to height x width x 3."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    at, header, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("this BMP is not supported")
    row = (w * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, row * abs(h), at).reshape(abs(h), row)
    if bits >= 24:
        out = raw[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    else:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(used, 4)[:, 2::-1]
        index = np.unpackbits(raw, axis=1).reshape(abs(h), -1, bits)[:, :w] @ (1 << np.arange(bits)[::-1])
        out = palette[index]
    return np.ascontiguousarray(out[::-1] if h > 0 else out)


def encode_bmp(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, w * 3)
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + rows.size, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def gray(image: np.ndarray) -> np.ndarray:
    return image[:, :, 0].astype(np.int64) if image.shape[2] == 1 else (image.astype(np.int64) @ np.array([299, 587, 114])) // 1000


def area_resize(plane: np.ndarray, h: int, w: int) -> np.ndarray:
    """Exact area means: the integral image is read between pixels by linear weights."""
    integral = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1))
    np.cumsum(np.cumsum(plane, axis=0), axis=1, out=integral[1:, 1:])
    ys, xs = np.linspace(0, plane.shape[0], h + 1), np.linspace(0, plane.shape[1], w + 1)
    y0, x0 = np.minimum(ys.astype(int), plane.shape[0] - 1), np.minimum(xs.astype(int), plane.shape[1] - 1)
    fy, fx = (ys - y0)[:, None], xs - x0
    rows = integral[y0] * (1 - fy) + integral[y0 + 1] * fy
    at = rows[:, x0] * (1 - fx) + rows[:, x0 + 1] * fx
    return np.diff(np.diff(at, axis=0), axis=1) / (plane.shape[0] * plane.shape[1] / (h * w))


def difference_hash(plane: np.ndarray) -> str:
    """64 bits as hex: whether a cell of 8 x 9 area means is below its right neighbour."""
    small = np.round(area_resize(plane, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile)
    return out.getvalue()


def top_value(data: bytes) -> int:
    """The largest sample that the file's header allows."""
    if data[:2] == b"BM":
        return 255
    return 1 if data[1:2] in b"14" else netpbm_fields(data, 3)[0][2]


def npy_tile(image: np.ndarray, side: int = 16, top: int = 255) -> bytes:
    """The image as an area-resized NPY tile of 8-bit samples; `top`, the largest possible sample, becomes 255."""
    planes = [area_resize(image[:, :, c], side, side) for c in range(image.shape[2])]
    return npy(np.clip(np.rint(np.stack(planes, axis=2) * (255 / top)), 0, 255).astype(np.uint8))


def features(data: bytes) -> tuple[int, int, int, str, bytes, str | None]:
    """Height, width, channels, difference hash, NPY tile and error (None if it decodes) of one file."""
    try:
        image = decode(data)
        if not image.size:
            raise ValueError("no pixels")
    except (ValueError, struct.error, IndexError, OverflowError, MemoryError) as e:
        return 0, 0, 0, "", b"", str(e)
    return *image.shape, difference_hash(gray(image)), npy_tile(image, top=top_value(data)), None


def media_features(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Decode a column of Netpbm and BMP files.

    Returns the id, `height`, `width`, `channels`, `dhash`, `tile` (NPY bytes) and `error`. A null,
    empty or broken file has sizes 0, an empty hash and tile, and the error's text. Other columns
    are not read; repeated rows give repeated rows; an empty table gives an empty table.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([files.schema[id_col], *_parse_datatype_string("height int, width int, channels int, dhash string, tile binary, error string").fields])

    def run(batches):
        types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                got = [features(x or b"") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([g[i] for g in got], type=t) for i, t in enumerate(types))], names=schema.names)

    return files.select(files[id_col], files[media_col].alias("g_media")).mapInArrow(run, schema)


def text_image(text: str) -> tuple[int, bytes]:
    """The text's bytes, padded with 0 to a positive multiple of 64, as the rows of a PGM image; the unpadded size."""
    raw = text.encode()
    padded = raw + b"\0" * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))
    return len(raw), encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH))


def stored(texts: list[str]) -> list[list]:
    rows = []
    for t in texts:
        n, media = text_image(t)
        image = decode(media)
        payload = image.tobytes()
        tile = npy_tile(image)
        feature = f"{image.shape[0]}x{image.shape[1]}:{difference_hash(gray(image))}:{hashlib.sha256(tile).hexdigest()[:16]}"
        rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, tile))
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(8)]


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text as a PGM image 64 samples wide, read it back and compute its features.

    Returns the id, `n_bytes`, `payload_bytes`, `payload_sha256`, `tail_crc32`, `media_bytes`,
    `media_sha256`, `feature` (size, difference hash, digest of the tile) and `tile` (NPY bytes).
    A null or empty text is one row of zeros. Other columns are not read; equal texts give equal
    values; an empty table gives an empty table.
    """
    return map_texts(docs, id_col, text_col, stored, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")
