"""Media columns: Netpbm and BMP images as numpy arrays, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import raw_texts, shared_path, slices


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """A grey (h, w) or colour (h, w, 3) array of 8-bit samples as binary PGM or PPM."""
    pixels = np.ascontiguousarray(pixels, dtype=np.uint8)
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def decode_image(data: bytes) -> np.ndarray:
    """The samples of a Netpbm (P1 to P6) or an uncompressed BMP image (8, 24 or 32 bits a pixel);
    ValueError for anything else and for images that are cut short."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, head = int(data[1:2]), 2, []
    while len(head) < (2 if kind in (1, 4) else 3):  # width, height, largest value
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data) if data[at : at + 1] == b"#" else at + 1
        begin = at
        while data[at : at + 1].isdigit():
            at += 1
        if at == begin:
            raise ValueError("broken Netpbm header")
        head.append(int(data[begin:at]))
    width, height, most = head[0], head[1], head[2] if len(head) > 2 else 1
    if width < 1 or height < 1:
        raise ValueError("an image without pixels")
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    if kind == 1:
        values = np.array([int(c) for c in data[at:].decode("ascii") if c in "01"][:n], dtype=np.uint8)
    elif kind in (2, 3):
        values = np.array(data[at:].split()[:n], dtype=np.int64)
    elif kind == 4:
        rows = np.frombuffer(data, dtype=np.uint8, offset=at + 1)[: height * -(-width // 8)]
        values = np.unpackbits(rows.reshape(height, -1), axis=1)[:, :width].ravel() if len(rows) == height * -(-width // 8) else rows[:0]
    else:
        values = np.frombuffer(data[at + 1 : at + 1 + n * (1 + (most > 255))], dtype=">u2" if most > 255 else np.uint8)
    if len(values) < n:
        raise ValueError("image cut short")
    if kind in (1, 4):
        values = (1 - values) * 255  # 1 is black
    elif most != 255:
        values = values.astype(np.int64) * 255 // max(most, 1)
    return values.astype(np.uint8).reshape((height, width, 3) if depth == 3 else (height, width))


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("image cut short")
    begin, head, width, height = struct.unpack_from("<IIii", data, 10)
    bits, packed = struct.unpack_from("<HI", data, 28)
    if packed != 0 or bits not in (8, 24, 32) or width < 1 or height == 0:
        raise ValueError("a BMP of another kind")
    row = -(-width * bits // 32) * 4
    rows = np.frombuffer(data[begin : begin + row * abs(height)], dtype=np.uint8)
    if len(rows) < row * abs(height):
        raise ValueError("image cut short")
    rows = rows.reshape(abs(height), row)[:: -1 if height > 0 else 1, : width * bits // 8]
    if bits == 8:
        colours = data[14 + head : begin]
        palette = np.frombuffer(colours[: len(colours) // 4 * 4], dtype=np.uint8).reshape(-1, 4)[:, 2::-1]
        if rows.size and int(rows.max()) >= len(palette):
            raise ValueError("a pixel outside the palette")
        return palette[rows]
    return np.ascontiguousarray(rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1])


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype(np.float64) if pixels.ndim == 2 else pixels.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each cell of the result is the mean of the area of pixels under it, parts of pixels counted
    in part: differences of the integral image, taken between its rows and columns linearly."""
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    sums[1:, 1:] = pixels.cumsum(axis=0).cumsum(axis=1)

    def between(a: np.ndarray, n: int, cells: int) -> np.ndarray:
        at = np.arange(cells + 1) * (n / cells)
        low = np.minimum(at.astype(np.int64), n - 1)
        part = (at - low)[:, None]
        return a[low] * (1 - part) + a[low + 1] * part

    edges = between(between(sums, pixels.shape[0], height).T, pixels.shape[1], width).T
    area = pixels.shape[0] / height * pixels.shape[1] / width
    return (edges[1:, 1:] - edges[:-1, 1:] - edges[1:, :-1] + edges[:-1, :-1]) / area


def difference_hash(pixels: np.ndarray) -> str:
    """16 hexadecimal digits: whether each of 8 x 8 cells is darker than the one to its right."""
    small = area_resized(grey(pixels), 8, 9)
    return np.packbits(small[:, :-1] + 1e-6 < small[:, 1:]).tobytes().hex()


def npy_bytes(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(pixels), allow_pickle=False)
    return out.getvalue()


def npy_array(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def tiles(images: DataFrame, path: str, *, keep: list[str], data: str, size: tuple[int, int] | None = None) -> None:
    """Decodes a binary column of images and writes, to the folder path, a row for each: the keep
    columns, the NPY tile (area-resized to size where given, else as decoded) and its difference hash. A
    null or undecodable image has a null tile and hash. Nothing is shuffled."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "_data"):
            made, hashes = [], []
            for raw in s.column("_data").to_pylist():
                try:
                    pixels = decode_image(raw or b"")
                except ValueError:
                    made.append(None)
                    hashes.append(None)
                    continue
                if size:
                    full = pixels if pixels.ndim == 3 else pixels[:, :, None]
                    pixels = np.stack([np.rint(area_resized(full[:, :, c].astype(np.float64), *size)) for c in range(full.shape[2])], axis=2).astype(np.uint8).reshape(*size, *pixels.shape[2:])
                made.append(npy_bytes(pixels))
                hashes.append(difference_hash(pixels))
            yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), pa.array(made, pa.binary()), pa.array(hashes, pa.string())], [*keep, "tile", "dhash"])

    rows = images.select(*keep, F.col(data).cast("binary").alias("_data"))
    rows.mapInArrow(apply, _ddl(rows, keep) + ", tile binary, dhash string").write.option("compression", "zstd").parquet(path)


def text_images(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and image: the UTF-8 bytes of each text (null: none), zeros to a multiple of 64
    (64 at least), as a PGM image 64 samples wide. A row for each, null keys and repeated rows too."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "_text"):
            raw = raw_texts(s.column("_text"))
            images = [encode_netpbm(np.frombuffer(r.ljust(max(64, -(-len(r) // 64) * 64), b"\0"), dtype=np.uint8).reshape(-1, 64)) for r in raw]
            yield pa.RecordBatch.from_arrays([s.column(key), pa.array([len(r) for r in raw], pa.int64()), pa.array(images, pa.binary())], [key, "n_bytes", "image"])

    rows = docs.select(key, F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(apply, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_bytes bigint, image binary")


def text_media(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text as an image, written as NPY tiles and read back: key, n_bytes, tile,
    dhash. Null and empty texts are 64 zeros; texts of any length are one tile; repeated
    rows and null keys keep their rows; an empty table gives none; other columns are ignored.
    Nothing is shuffled; the tiles go through the shared folder."""
    path = shared_path(docs.sparkSession, "media")
    tiles(text_images(docs, key=key, text=text), path, keep=[key, "n_bytes"], data="image")
    return docs.sparkSession.read.parquet(path)


def tile_digests(media: DataFrame, *, keep: list[str]) -> DataFrame:
    """What a reader of the tiles finds: sizes and checksums of the samples and of the stored bytes;
    nulls for a null tile. Repeated rows stay, equal tiles get equal values, no tile gives no row;
    other columns than keep and tile are ignored. Nothing is shuffled."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "tile"):
            rows = []
            for raw in s.column("tile").to_pylist():
                if raw is None:
                    rows.append((None,) * len(names))
                    continue
                samples = npy_array(raw)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), difference_hash(samples)))
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*keep, *names])

    ddl = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select(*keep, "tile").mapInArrow(apply, f"{_ddl(media, keep)}, {ddl}")


def _ddl(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
