"""Media columns: TIFF files in a binary column, one row per page.

The reader walks the image directories of a classic TIFF of either byte order, undoes strips or tiles stored plain, as PackBits, LZW or
deflate, predictors 2 and 3, and planes, for samples of 1, 2, 4, 8, 16, 32 or 64 bits, whole or floating point. A page that it can't read
doesn't end the file. The writer makes such files from 8-bit samples and serves tests and the query.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

#: Fixed values of the format: tag numbers, codes of compressions, bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FILL_ORDER, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 266, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", PACKBITS: "packbits", OLD_DEFLATE: "deflate"}
SIZES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}
CLEAR, END = 256, 257
#: Format of floating point samples.
FLOAT = 3
#: How many times its stored bytes a strip or tile can hold at most, by compression: what a header promises beyond that is damage.
GROWTH = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040}
#: A page of more bytes than this, or a tile, isn't read; a column of Arrow's could hold it no more than twice.
MOST = 1 << 30
READ = {WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FILL_ORDER, FORMAT}


class TiffError(ValueError):
    """The bytes aren't a TIFF file that this reader understands."""


def packbits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, all else literally."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    lengths = np.diff(np.r_[starts, len(a)])
    out, done = bytearray(), 0

    def literal(end: int) -> None:
        for k in range(done, end, 128):
            part = data[k : min(k + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, n in zip(starts[lengths >= 3].tolist(), lengths[lengths >= 3].tolist(), strict=True):
        literal(start)
        done = start + n
        while n > 0:
            k = min(n, 128)
            out += bytes([257 - k if k > 1 else 0, data[start]])
            n -= k
    literal(len(a))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, k = bytearray(), 0
    while k < len(data) and len(out) < size:
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += 2 + n
        elif n == 128:
            k += 1
        else:
            out += data[k + 1 : k + 2] * (257 - n)
            k += 2
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, each width ending one code early; the table starts anew before it is full."""
    bits, n, out = 0, 0, bytearray()
    table: dict[bytes, int] = {}
    width, following = 9, 258
    single = [bytes([k]) for k in range(256)]

    def put(code: int) -> None:
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
        bits &= (1 << n) - 1

    def code_of(s: bytes) -> int:
        return s[0] if len(s) == 1 else table[s]

    put(CLEAR)
    held = b""
    for x in data:
        longer = held + single[x]
        if len(longer) == 1 or longer in table:
            held = longer
            continue
        put(code_of(held))
        table[longer] = following
        following += 1
        if following == 4095:
            put(CLEAR)
            table, width, following = {}, 9, 258
        elif following in (512, 1024, 2048):
            width += 1
        held = single[x]
    if held:
        put(code_of(held))
        following += 1
        if following in (512, 1024, 2048):
            width += 1
    put(END)
    if n:
        out.append(bits << 8 - n & 255)
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    out: list[bytes] = []
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, bits, n, last = start[:], 9, 0, 0, None
    for x in data:
        bits, n = bits << 8 | x, n + 8
        if n < width:
            continue
        n -= width
        code = bits >> n
        bits &= (1 << n) - 1
        if code == CLEAR:
            table, width, last = start[:], 9, None
            continue
        if code == END:
            break
        if last is None:
            now = table[code] if code < 256 else None
        elif code < len(table):
            now = table[code]
            table.append(last + now[:1])
        else:
            now = last + last[:1] if code == len(table) else None
            table.append(now or b"")
        if now is None:
            raise TiffError("an LZW code that isn't in the table")
        out.append(now)
        last = now
        if len(table) in (511, 1023, 2047):
            width += 1
    return b"".join(out)


def _packed(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1)}[compression](data)


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data
    elif compression == PACKBITS:
        out = unpackbits(data, size)
    elif compression == LZW:
        out = unlzw(data)
    else:
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(str(e)) from e
    if len(out) < size:
        raise TiffError("a strip or tile is too short")
    return out[:size]


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, strip_rows: int = 1024) -> bytes:
    """A little-endian file of pages, arrays of 8-bit samples by row and column; tile: the side of square tiles (a multiple of 16), else strips."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        h, w = page.shape
        if tile:
            padded = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile), np.uint8)
            padded[:h, :w] = page
            blocks = [padded[r : r + tile, c : c + tile] for r in range(0, h, tile) for c in range(0, w, tile)]
        else:
            blocks = [page[r : r + strip_rows] for r in range(0, h, strip_rows)]
        at, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            data = _packed(np.ascontiguousarray(block).tobytes(), compression)
            at.append(len(out))
            sizes.append(len(data))
            out += data
        layout = {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_OFFSETS: at, TILE_BYTES: sizes} if tile else {STRIP_OFFSETS: at, ROWS_PER_STRIP: [strip_rows], STRIP_BYTES: sizes}
        fields = sorted(({WIDTH: [w], HEIGHT: [h], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]} | layout).items())
        entries = b""
        for tag, values in fields:
            packed = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                place, packed = len(out), packed
                out += packed
                packed = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, 4, len(values)) + packed
        out += bytes(len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


def read_tiff(data: bytes) -> Iterator[tuple[dict, np.ndarray]]:
    """(facts, array by row, column and sample) of each page; TiffError for what isn't readable."""
    for page in read_pages(data):
        if isinstance(page, TiffError):
            raise page
        yield page


def read_pages(data: bytes) -> Iterator[tuple[dict, np.ndarray] | TiffError]:
    """read_tiff's pages, or the error of a page that isn't readable; TiffError where the next directory can't be found."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise TiffError("no TIFF header")
    seen: set[int] = set()
    try:
        (at,) = struct.unpack_from(f"{order}I", data, 4)
        while at:
            if at in seen:
                raise TiffError("image directories form a ring")
            seen.add(at)
            (n,) = struct.unpack_from(f"{order}H", data, at)
            try:
                page = _page(data, order, _tags(data, order, at, n))
            except TiffError as e:
                page = e
            except (struct.error, KeyError, IndexError, ValueError, ZeroDivisionError) as e:
                page = TiffError(f"a damaged image directory: {e}")
            yield page
            (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    except struct.error as e:
        raise TiffError(f"a damaged image directory: {e}") from e


def _tags(data: bytes, order: str, at: int, n: int) -> dict[int, list[int]]:
    tags: dict[int, list[int]] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, (place := at + 2 + 12 * k))
        if kind in SIZES and tag in READ and tag not in tags:
            size, code = SIZES[kind]
            where = place + 8 if size * count <= 4 else struct.unpack_from(f"{order}I", data, place + 8)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, where))
    return tags


def _samples(data: bytes, rows: int, columns: int, samples: int, bits: int, order: str, predictor: int) -> np.ndarray:
    """A block's samples as whole numbers: those of less than a byte are unpacked, high bits first, from rows of whole bytes, and predictors undone."""
    if bits < 8:
        each = np.unpackbits(np.frombuffer(data, np.uint8).reshape(rows, -1), axis=1)[:, : columns * samples * bits].reshape(rows, columns, samples, bits)
        return (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
    kind = np.dtype(f"{order}u{bits // 8}")
    if predictor == 3:
        # differences of bytes; each row has the first bytes of all samples, then the second ones, and so on, the highest first
        parts = np.cumsum(np.frombuffer(data, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, columns * samples)
        return np.ascontiguousarray(parts.transpose(0, 2, 1)).view(f">u{kind.itemsize}").reshape(rows, columns, samples)
    block = np.frombuffer(data, kind).reshape(rows, columns, samples)
    return np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else block


def _page(data: bytes, order: str, tags: dict[int, list[int]]) -> tuple[dict, np.ndarray]:
    w, h, samples, compression, predictor = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, [1])[0], tags.get(COMPRESSION, [NONE])[0], tags.get(PREDICTOR, [1])[0]
    widths, floating = {*tags.get(BITS, [1])}, tags.get(FORMAT, [1])[0] == FLOAT
    bits = min(widths)
    if len(widths) > 1 or bits not in ((16, 32, 64) if floating else (1, 2, 4, 8, 16, 32, 64)) or predictor not in (1, 2, 3) or predictor == 2 and bits < 8 or predictor == 3 and not floating or bits < 8 and tags.get(FILL_ORDER, [1])[0] != 1:
        raise TiffError(f"bits {sorted(widths)}, predictor {predictor}, format {tags.get(FORMAT, [1])[0]} or fill order {tags.get(FILL_ORDER, [1])[0]}")
    kind = np.dtype(f"{order}u{max(1, bits // 8)}")
    planes = samples if samples > 1 and tags.get(PLANAR, [1])[0] == 2 else 1
    inside = samples // planes
    if tags.get(TILE_OFFSETS):
        bw, bh, at, sizes = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        bw, bh, at, sizes = w, min(h, tags.get(ROWS_PER_STRIP, [h])[0]) or 1, tags[STRIP_OFFSETS], tags[STRIP_BYTES]
    across = -(-w // bw)
    blocks, line = across * -(-h // bh), -(-bw * inside * bits // 8)
    if min(len(at), len(sizes)) < blocks * planes:
        raise TiffError("strips or tiles are missing")
    if compression not in GROWTH:
        raise TiffError(f"compression {compression}")
    if max(h * w * samples * kind.itemsize, bh * line if TILE_OFFSETS in tags else 0) > MOST:
        raise TiffError(f"a page or tile of more than {MOST} bytes")
    stored = sum(max(0, min(n, len(data) - k)) for k, n in zip(at[: blocks * planes], sizes, strict=False))
    if planes * line * (blocks * bh if TILE_OFFSETS in tags else h) > GROWTH[compression] * stored:
        raise TiffError("a strip or tile is too short")
    out = np.empty((h, w, samples), kind)
    for k in range(blocks * planes):
        plane, cell = divmod(k, blocks)
        r, c = cell // across * bh, cell % across * bw
        rows = bh if TILE_OFFSETS in tags else min(bh, h - r)
        stored = _unpacked(data[at[k] : at[k] + sizes[k]], compression, rows * line)
        block = _samples(stored, rows, bw, inside, bits, order, predictor)
        out[r : r + bh, c : c + bw, plane * inside : (plane + 1) * inside] = block[: h - r, : w - c]
    if floating:
        out = out.view(f"{order}f{bits // 8}")
    return {"width": w, "height": h, "samples": samples, "bits": bits, "compression": NAMES[compression], "predictor": predictor, "blocks": blocks * planes, "tiled": TILE_OFFSETS in tags}, out


def features(facts: dict, pixels: np.ndarray) -> str:
    """JSON: the page's facts, mean and standard deviation of its samples, and the entropy in bits of their histogram.

    Whole numbers count by their highest byte. Floating point ones, if finite, give mean and deviation as they are and go to 256 equal bins between their ends.
    """
    flat = pixels.ravel()
    if flat.dtype.kind == "f":
        flat = flat[np.isfinite(flat)].astype(np.float64)
        # scaled first, so neither the range nor the squares overflow
        scale = float(np.abs(flat).max()) or 1.0 if flat.size else 1.0
        part = flat / scale
        counts = np.histogram(part, 256)[0] if flat.size and part.max() - part.min() > 1e-12 else np.array([flat.size])
        mean, spread = (float(part.mean()) * scale, float(part.std()) * scale) if flat.size else (0.0, 0.0)
    else:
        counts = np.bincount((flat >> 8 * (flat.itemsize - 1)).astype(np.int64), minlength=256) if flat.size else np.zeros(256, int)
        values = np.arange(256)
        mean = float((counts * values).sum() / max(1, flat.size))
        spread = float(np.sqrt(max(0.0, (counts * values**2).sum() / max(1, flat.size) - mean**2)))
    p = counts[counts > 0] / max(1, flat.size)
    return json.dumps(facts | {"mean": round(mean, 6), "sd": round(spread, 6), "entropy": round(float(-(p * np.log2(p)).sum()) + 0.0, 6)}, sort_keys=True)


PAGE = T.StructType([T.StructField(name, kind) for name, kind in (("page", T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("samples", T.IntegerType()), ("bits", T.IntegerType()), ("compression", T.StringType()), ("pixels", T.BinaryType()), ("feature", T.StringType()), ("error", T.StringType()))])


@arrow_udf(T.ArrayType(PAGE))
def _pages(files: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = to_arrow_type(T.ArrayType(PAGE))
    for batch in files:
        out = []
        for file in batch:
            pages: list[dict] = []
            data = file.as_py()
            try:
                for k, page in enumerate(read_pages(data) if data is not None else ()):
                    if isinstance(page, TiffError):
                        pages.append({"page": k, "error": str(page)})
                        continue
                    facts, a = page
                    pages.append({x: facts[x] for x in ("width", "height", "samples", "bits", "compression")} | {"page": k, "pixels": a.tobytes(), "feature": features(facts, a), "error": None})
            except TiffError as e:
                pages.append({"page": len(pages), "error": str(e)})
            out.append(pages)
        yield pa.array(out, kind)


def tiff_pages(files: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page of each TIFF file in the binary column media_col: the id, page (from 0), width, height, samples, bits, compression, pixels (row by row, in the file's byte order), feature, error.

    A page that can't be read gives a row with error and without pixels, and the next ones are read; a file that can't be followed to its end
    gives a last such row. Samples of less than a byte take a byte each in pixels, planes are joined by sample. Null gives no row, and so does an
    empty table. A page that its strips or tiles can't hold, or one of more than MOST bytes, can't be read. Repeated rows give repeated pages. Other columns are neither read nor returned.
    """
    return files.select(F.col(id_col).alias("_id"), F.explode(_pages(F.col(media_col))).alias("_page")).select(F.col("_id").alias(id_col), "_page.*")


#: Samples in each row of pages made from texts.
TEXT_WIDTH = 64


def text_tiff(payload: bytes) -> bytes:
    """The payload, a multiple of 64 bytes, as one page of 64 columns. Its CRC-32 chooses the layout, so that all that the reader knows is in use and equal payloads are stored alike."""
    compression, predictor, tile = [(DEFLATE, 2, 0), (DEFLATE, 2, 64), (LZW, 1, 0), (PACKBITS, 1, 0), (DEFLATE, 1, 0), (DEFLATE, 2, 32), (NONE, 1, 0), (DEFLATE, 2, 0)][zlib.crc32(payload) % 8]
    return write_tiff([np.frombuffer(payload, np.uint8).reshape(-1, TEXT_WIDTH)], compression, predictor, tile)


@arrow_udf(T.BinaryType())
def text_media(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A TIFF file of each text (null: empty) as UTF-8, filled up with bytes 0 to a positive multiple of 64."""
    for batch in texts:
        out = []
        for x in batch:
            data = (x.as_py() or "").encode()
            out.append(text_tiff(data + bytes(-len(data) % 64 if data else 64)))
        yield pa.array(out, pa.binary())


def text_features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as a TIFF file, reads the file back with tiff_pages and digests what was read.

    One row per row of documents, repeated ones included: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature. A null text is an empty one, a page of 64 bytes 0. Other columns of documents are neither read nor returned.
    """
    stored = documents.select(F.struct(F.col(id_col).alias("doc"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n"), text_media(F.col(text_col)).alias("media")).alias("f"))
    digest = stored.select(F.struct("f.doc", "f.n", F.octet_length("f.media").cast("long").alias("media_bytes"), F.sha2("f.media", 256).alias("media_sha256")).alias("key"), F.col("f.media").alias("media"))
    return tiff_pages(digest, "key", "media").select(
        F.col("key.doc").alias(id_col),
        F.col("key.n").alias("n_bytes"),
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        F.col("key.media_bytes").alias("media_bytes"),
        F.col("key.media_sha256").alias("media_sha256"),
        "feature",
    )

