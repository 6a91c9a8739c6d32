"""TIFF: reading pages out of image directories, and a writer for lossless 8-bit images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm.common import portions, whole

# Fixed values of the TIFF format: field types' sizes and codes, compression codes, tags.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, None), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d")}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_N, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILE_AT, TILE_N = 322, 323, 324, 325
CODECS = {"none": NONE, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + n + 2]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and data[i + run : i + run + 1] == data[i : i + 1]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        end = i + 1
        while end < len(data) and end - i < 128 and data[end : end + 1] != data[end + 1 : end + 2]:
            end += 1
        out.append(end - i - 1)
        out += data[i:end]
        i = end
    return bytes(out)


def unpack_lzw(data: bytes, most: int | None = None) -> bytes:
    """LZW with codes of 9 to 12 bits, high bit first; 256 clears, 257 ends, the width grows one code early. Stops after
    ``most`` bytes."""
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, last, width, held, bits, size = [], b"", 9, 0, 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            last, width = b"", 9
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of order")
        out.append(entry)
        size += len(entry)
        if most is not None and size >= most:
            break
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    held = bits = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    table, width, word = {bytes((i,)): i for i in range(256)}, 9, b""
    put(256, 9)
    free = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = free
        free += 1
        width = min(12, free.bit_length())
        if free == 4094:
            put(256, width)
            table, width, free = {bytes((k,)): k for k in range(256)}, 9, 258
        word = data[i : i + 1]
    if word:
        put(table[word], width)
        width = min(12, max(9, (free + 1).bit_length()))
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def inflate(codec: int, data: bytes, most: int) -> bytes:
    """The first ``most`` bytes of what was compressed."""
    if codec == NONE:
        return data
    if codec == LZW:
        return unpack_lzw(data, most)
    if codec in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    if codec == PACKBITS:
        return unpack_bits(data)
    raise ValueError(f"compression {codec} is not supported")


def deflate(codec: int, data: bytes, level: int = 1) -> bytes:
    return {NONE: lambda d: d, LZW: pack_lzw, DEFLATE: lambda d: zlib.compress(d, level), PACKBITS: pack_bits}[codec](data)


#: How many bytes one compressed byte can stand for.
GROWTH = {NONE: 1, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(f"{order}H", data, at)
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        size, code = TYPES.get(kind, (1, None))
        if code is None:
            continue
        place = at + 10 + 12 * k
        if size * count > 4:
            (place,) = struct.unpack_from(f"{order}I", data, place)
        if place + size * count > len(data):
            raise struct.error("a field lies outside the file")
        tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
    return tags, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _undo(block: np.ndarray, predictor: int) -> np.ndarray:
    """block: rows, columns, samples."""
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor != 1:
        raise ValueError(f"predictor {predictor} is not supported")
    return block


def _image(data: bytes, order: str, tags: dict[int, tuple]) -> np.ndarray:
    one = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, bits, samples = one(WIDTH, 0), one(HEIGHT, 0), one(BITS, 1), one(SAMPLES, 1)
    codec, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (1, 8, 16, 32) or not width or not height:
        raise ValueError(f"{width} x {height} with {bits} bits is not supported")
    if len(set(tags.get(BITS, (1,)))) > 1 or planar not in (1, 2) or not 0 < samples <= 65535:
        raise ValueError("samples of different kinds are not supported")
    kind = np.dtype({1: "u1", 8: "u1", 16: f"{order}u2", 32: f"{order}u4"}[bits])
    tiled = TILE_AT in tags
    bw, bh = (one(TILE_W, 0), one(TILE_H, 0)) if tiled else (width, min(one(ROWS, height), height))
    at, sizes = (tags[TILE_AT], tags[TILE_N]) if tiled else (tags[STRIP_AT], tags[STRIP_N])
    if bw <= 0 or bh <= 0:
        raise ValueError(f"strips or tiles of {bw} x {bh}")
    across, down = -(-width // bw), -(-height // bh)
    planes, per = (samples, 1) if planar == 2 else (1, samples)
    if len(at) != len(sizes) or len(at) != across * down * planes:
        raise ValueError(f"{len(at)} strips or tiles instead of {across * down * planes}")
    if any(start + size > len(data) for start, size in zip(at, sizes, strict=True)):
        raise ValueError("a strip or tile lies outside the file")
    tall = down * bh if tiled else height
    if tall * across * bw * samples * bits // 8 > GROWTH.get(codec, 1) * sum(sizes) + 64:
        raise ValueError("more pixels than the compressed bytes can hold")
    out = np.zeros((tall, across * bw, samples), kind.newbyteorder("="))
    for k, (start, size) in enumerate(zip(at, sizes, strict=True)):
        plane, place = divmod(k, across * down)
        y, x = divmod(place, across)
        rows = bh if tiled else min(bh, height - y * bh)
        line = -(-bw * per * bits // 8)
        raw = np.frombuffer(inflate(codec, data[start : start + size], rows * line), np.uint8)
        if bits == 1:
            block = np.unpackbits(raw[: rows * line].reshape(rows, line), axis=1)[:, : bw * per].reshape(rows, bw, per)
        else:
            block = raw[: rows * line].view(kind).reshape(rows, bw, per)
            block = _undo(block.astype(kind.newbyteorder("=")), predictor)
        where = slice(plane, plane + 1) if planes > 1 else slice(None)
        out[y * bh : y * bh + rows, x * bw : (x + 1) * bw, where] = block
    return out[:height, :width]


def read_pages(data: bytes) -> Iterator[dict]:
    """One dict per image directory, in file order. What cannot be read gives a page with ``error`` and no pixels."""
    try:
        order = {b"II*\0": "<", b"MM\0*": ">"}[bytes(data[:4])]
        (at,) = struct.unpack_from(f"{order}I", data, 4)
    except (KeyError, struct.error):
        yield {"page": 0, "error": "not a TIFF file"}
        return
    page, seen = 0, set()
    while at and at not in seen:
        seen.add(at)
        row: dict = {"page": page}
        try:
            tags, at = _directory(data, order, at)
        except struct.error:
            yield row | {"error": "broken image directory"}
            return
        try:
            image = _image(data, order, tags)
            row |= {"width": image.shape[1], "height": image.shape[0], "samples": image.shape[2], "bits": tags.get(BITS, (1,))[0]}
            row |= {"compression": tags.get(COMPRESSION, (NONE,))[0], "predictor": tags.get(PREDICTOR, (1,))[0], "image": image}
        except (KeyError, ValueError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as broken:
            row["error"] = f"{type(broken).__name__}: {broken}"
        yield row
        page += 1


def write_tiff(images: list[np.ndarray], codec: str = "deflate", predictor: int = 1, rows_per_strip: int = 128, tile: int = 0, level: int = 1, order: str = "<") -> bytes:
    """A TIFF file of 8-bit images (rows, columns[, samples]), one page each, in strips or in tiles of ``tile`` pixels."""
    out, code = bytearray(b"II*\0" if order == "<" else b"MM\0*") + bytes(4), CODECS[codec]
    link = 4
    for image in images:
        image = image[:, :, None] if image.ndim == 2 else image
        h, w, samples = image.shape
        bw, bh = (tile, tile) if tile else (w, rows_per_strip)
        at, sizes = [], []
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                block = image[y : y + bh, x : x + bw]
                if tile:
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                packed = deflate(code, np.ascontiguousarray(block).tobytes(), level)
                at.append(len(out))
                sizes.append(len(packed))
                out += packed + bytes(len(packed) % 2)
        fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [code]), (PHOTOMETRIC, 3, [1 if samples < 3 else 2])]
        fields += [(SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_W, 3, [tile]), (TILE_H, 3, [tile]), (TILE_AT, 4, at), (TILE_N, 4, sizes)] if tile else [(STRIP_AT, 4, at), (ROWS, 4, [bh]), (STRIP_N, 4, sizes)]
        entries = bytearray()
        for tag, kind, values in sorted(fields):
            body = struct.pack(f"{order}{len(values)}{TYPES[kind][1]}", *values)
            if len(body) > 4:
                place = len(out)
                out += body + bytes(len(body) % 2)
                body = struct.pack(f"{order}I", place)
            entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(fields)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


def average_hash(image: np.ndarray) -> str:
    """16 hex digits: which cells of an 8 x 8 grid are lighter than the mean cell."""
    flat = image.reshape(image.shape[0], -1).astype(np.float32)
    rows = np.linspace(0, flat.shape[0], 9).astype(int)
    cols = np.linspace(0, flat.shape[1], 9).astype(int)
    sums = np.zeros((9, 9), np.float64)
    sums[1:, 1:] = np.add.reduceat(np.add.reduceat(flat, np.minimum(rows[:-1], flat.shape[0] - 1), axis=0), np.minimum(cols[:-1], flat.shape[1] - 1), axis=1)
    cells = sums[1:, 1:] / np.maximum(1, np.diff(rows))[:, None] / np.maximum(1, np.diff(cols))
    return np.packbits(cells > cells.mean()).tobytes().hex()


PAGES = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, ahash string, error string"


def tiff_pages(media: DataFrame, id_col: str = "doc_id", content_col: str = "content", at_once: int = 16_000_000) -> DataFrame:
    """One row per page of every file in ``content_col``: its id and the columns of ``PAGES``.

    ``pixels`` holds the samples row by row. A null or broken file gives one row with ``error``; a broken page, or one that
    claims more pixels than its bytes can hold, gives a row with ``error`` and the other pages are read all the same.
    Repeated rows give repeated pages; other columns of ``media`` are dropped. Files are read one after the other, and what
    was read is handed on whenever it has ``at_once`` bytes.
    """
    kind = media.schema[id_col].dataType.simpleString()
    source = media.select(F.col(id_col).alias("id"), F.col(content_col).alias("content"))
    names = [x.split()[0] for x in PAGES.split(", ")]
    types = {"int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [pa.field(n, types[x.split()[1]]) for n, x in zip(names, PAGES.split(", "), strict=True)]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, owners, held = batch.column(0), [], [], 0

            def made(rows=rows, owners=owners, ids=ids) -> pa.RecordBatch:
                columns = [ids.take(pa.array(owners, pa.int32())), *(pa.array([r.get(f.name) for r in rows], f.type) for f in fields)]
                return pa.RecordBatch.from_arrays(columns, names=["id", *names])

            for k, file in enumerate(batch.column(1)):
                for row in read_pages(file.as_py() or b""):
                    image = row.pop("image", None)
                    if image is not None:
                        row |= {"pixels": image.tobytes(), "ahash": average_hash(image)}
                        held += image.nbytes
                    rows.append(row)
                    owners.append(k)
                    if held >= at_once or len(rows) >= 4096:
                        yield made()
                        held = 0
                        rows.clear()
                        owners.clear()
            if rows:
                yield made()

    return source.mapInArrow(decode, f"id {kind}, {PAGES}")


def text_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64, codec: str = "deflate", rows_per_strip: int = 256) -> DataFrame:
    """Every text as a TIFF file of 8-bit samples: its UTF-8 bytes, padded with zeros to whole rows (one at least).

    Returns id, ``n_bytes`` and ``content``. Null counts as empty and gives one black row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), whole(text_col).cast("binary").alias("bytes"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                sizes, files = [], []
                for value in part.column(1):
                    raw = value.as_py()
                    rows = max(1, -(-len(raw) // width))
                    image = np.frombuffer(raw.ljust(rows * width, b"\0"), np.uint8).reshape(rows, width)
                    sizes.append(len(raw))
                    files.append(write_tiff([image], codec, rows_per_strip=rows_per_strip))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["id", "n_bytes", "content"])

    return source.mapInArrow(encode, f"id {kind}, n_bytes bigint, content binary")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of a round trip: each text goes into a TIFF file, and what the file gives back is hashed.

    The unpadded length is read from the text itself, all other figures from the stored file.
    """
    stored = F.struct("id", "n_bytes", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha"))
    pages = tiff_pages(text_images(docs, id_col, text_col).select(stored.alias("key"), "content"), "key", "content")
    return pages.select(
        F.col("id.id").alias("doc_id"),
        F.col("id.n_bytes").alias("n_bytes"),
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        F.col("id.size").alias("media_bytes"),
        F.col("id.sha").alias("media_sha256"),
        F.concat_ws(" ", F.concat_ws("x", "width", "height"), F.concat(F.lit("c"), F.col("compression")), "ahash").alias("feature"),
    )
