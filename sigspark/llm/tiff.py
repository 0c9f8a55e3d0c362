"""TIFF media columns (operator 6): whole files in a binary column, decoded by walking their image directories.

Reads classic and big TIFF of either byte order: strips and tiles, samples of 1, 2, 4, 8, 16 or 32 bits or floating-point ones of 16, 32 or
64, in chunky or planar layout, stored plain, as PackBits, LZW or deflate, with or without the horizontal or the floating-point
predictor, any number of pages. One row is emitted per page. Sizes that a header claims are held against the data before
memory is taken, and decoders stop at the size of their strip. Writes single and multi-page files of 8-bit samples with the
same codecs.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import texts

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Tags of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
SAMPLE_FORMAT = 339
_TYPES = {1: ("B", 1), 2: ("B", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
#: Most bytes that one stored byte can stand for.
_MOST = {NONE: 1, PACKBITS: 64, LZW: 2560, DEFLATE: 1040, OLD_DEFLATE: 1040}


class TiffError(ValueError):
    pass


def unpack_bits(raw: bytes, most: int = 1 << 62) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw) and len(out) < most:
        n = raw[i]
        i += 1
        if n < 128:
            out += raw[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += raw[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def pack_bits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return b""
    edge = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1], [True]]))
    literal = bytearray()

    def flush():
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a < 3:
            literal.extend(raw[a:b])
            continue
        flush()
        for k in range(a, b, 128):
            n = min(128, b - k)
            if n == 1:
                literal.append(raw[k])
            else:
                out.append(257 - n)
                out.append(raw[k])
    flush()
    return bytes(out)


def _lzw_width(entries: int) -> int:
    """Code width once the table holds that many entries; widths grow one code early in this format."""
    return 9 if entries < 511 else 10 if entries < 1023 else 11 if entries < 2047 else 12


def lzw_decode(raw: bytes, most: int = 1 << 62) -> bytes:
    out, table, width, hold, bits, last = [], [], 9, 0, 0, None
    made = 0
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in raw:
        hold, bits = (hold << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = hold >> bits
        hold &= (1 << bits) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, last = list(first), 9, None
            continue
        if last is None:
            if code >= len(table):
                raise TiffError("LZW data begin without a clear code")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise TiffError("LZW code beyond the table")
            table.append(last + entry[:1])
            width = _lzw_width(len(table))
        out.append(entry)
        made += len(entry)
        if made >= most:
            break
        last = entry
    return b"".join(out)


def lzw_encode(raw: bytes) -> bytes:
    out, hold, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal hold, bits
        hold, bits = (hold << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((hold >> bits) & 255)
        hold &= (1 << bits) - 1

    table = {bytes([i]): i for i in range(256)}
    entries, width, run = 258, 9, b""
    put(256, 9)
    for k in range(len(raw)):
        longer = run + raw[k : k + 1]
        if longer in table:
            run = longer
            continue
        put(table[run], width)
        table[longer] = entries
        entries += 1
        width = _lzw_width(entries - 1)
        if entries > 4093:
            put(256, width)
            table = {bytes([i]): i for i in range(256)}
            entries, width = 258, 9
        run = raw[k : k + 1]
    if run:
        put(table[run], width)
        width = _lzw_width(entries)
    put(257, width)
    if bits:
        out.append((hold << (8 - bits)) & 255)
    return bytes(out)


def _decode(raw: bytes, codec: int, most: int) -> bytes:
    """At least the first `most` bytes of the decoded data, if there are so many."""
    if codec == NONE:
        return raw
    if codec in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(raw, max(most, 1))
    if codec == PACKBITS:
        return unpack_bits(raw, most)
    return lzw_decode(raw, most)


def _encode(raw: bytes, codec: int, level: int) -> bytes:
    return {NONE: lambda: raw, DEFLATE: lambda: zlib.compress(raw, level), PACKBITS: lambda: pack_bits(raw), LZW: lambda: lzw_encode(raw)}[codec]()


def write_tiff(pages: list[np.ndarray], codec: int = DEFLATE, predictor: bool = False, rows_per_strip: int = 1024, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    """The file of 8-bit pages of shape (height, width) or (height, width, samples), in strips or in tiles (width, height)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        image = page[:, :, None] if page.ndim == 2 else page
        h, w, s = image.shape
        step = (tile[1], tile[0]) if tile else (rows_per_strip, w)
        offsets, counts = [], []
        for y in range(0, h, step[0]):
            for x in range(0, w, step[1]):
                part = image[y : y + step[0], x : x + step[1]]
                if tile:
                    full = np.zeros((step[0], step[1], s), np.uint8)
                    full[: part.shape[0], : part.shape[1]] = part
                    part = full
                if predictor:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                raw = _encode(np.ascontiguousarray(part).tobytes(), codec, level)
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw
        tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8] * s), (COMPRESSION, 3, [codec]), (PHOTOMETRIC, 3, [2 if s == 3 else 1]), (SAMPLES, 3, [s])]
        tags += [(TILE_WIDTH, 4, [tile[0]]), (TILE_HEIGHT, 4, [tile[1]]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
        tags += [(PREDICTOR, 3, [2])] if predictor else []
        entries = bytearray()
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{_TYPES[kind][0]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) & 1)
                where, raw = len(out), out.extend(raw) or b""
                raw = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) & 1)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries) // 12) + entries + struct.pack(order + "I", 0)
        link = len(out) - 4
    return bytes(out)


def _directories(raw: bytes):
    """(byte order, tags) of each image directory."""
    if len(raw) < 8 or raw[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF header")
    order = "<" if raw[:2] == b"II" else ">"
    (magic,) = struct.unpack_from(order + "H", raw, 2)
    if magic not in (42, 43) or magic == 43 and len(raw) < 16:
        raise TiffError("no TIFF header")
    # number of entries, size of an entry, count and value of an entry
    number, size, word = ("H", 12, "I") if magic == 42 else ("Q", 20, "Q")
    wide = struct.calcsize(word)
    (at,) = struct.unpack_from(order + word, raw, 4 if magic == 42 else 8)
    seen = set()
    while at:
        if at in seen or at + struct.calcsize(number) > len(raw):
            raise TiffError("broken chain of directories")
        seen.add(at)
        (n,) = struct.unpack_from(order + number, raw, at)
        first = at + struct.calcsize("=" + number)
        if first + n * size + wide > len(raw):
            raise TiffError("a directory reaches beyond the file")
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HH" + word, raw, first + size * k)
            if kind in _TYPES:
                letter, each = _TYPES[kind]
                where = first + size * k + 4 + wide
                if each * count > wide:
                    (where,) = struct.unpack_from(order + word, raw, where)
                if where + each * count > len(raw):
                    raise TiffError("a tag's values reach beyond the file")
                tags[tag] = struct.unpack_from(f"{order}{count}{letter}", raw, where)
        yield order, tags
        (at,) = struct.unpack_from(order + word, raw, first + size * n)


def _samples(raw: bytes, order: str, rows: int, width: int, depth: int, bits: int, real: bool, predictor: int) -> np.ndarray:
    """The (rows, width, depth) samples of a decoded strip or tile."""
    if bits < 8:
        line = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : width * depth * bits].reshape(rows, -1, bits)
        return (line * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).astype(np.uint8).reshape(rows, width, depth)
    kind, size = ("f" if real else "u"), bits // 8
    if predictor == 3:
        # differences of bytes over the row, the most significant bytes of all samples first
        planes = np.frombuffer(raw, np.uint8).reshape(rows, size * width, depth).cumsum(axis=1, dtype=np.uint8)
        return np.ascontiguousarray(planes.reshape(rows, size, width * depth).transpose(0, 2, 1)).view(f">{kind}{size}").astype(f"{kind}{size}").reshape(rows, width, depth)
    out = np.frombuffer(raw, f"{order}{kind}{size}").reshape(rows, width, depth)
    if predictor == 2:
        out = out.view(f"{order}u{size}").astype(f"u{size}").cumsum(axis=1, dtype=f"u{size}").view(f"{kind}{size}")
    return out


def read_tiff(raw: bytes):
    """Yields an array (height, width, samples) for each page; samples of fewer than 8 bits have a byte each."""
    for order, tags in _directories(raw):
        one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
        w, h, s, codec, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
        bits, real = set(tags.get(BITS, (1,))), one(SAMPLE_FORMAT, 1) == 3
        if not w or not h or not s:
            raise TiffError("a page without width, height or samples")
        if len(bits) != 1 or not bits <= ({16, 32, 64} if real else {1, 2, 4, 8, 16, 32}):
            raise TiffError(f"samples of {sorted(bits)} bits")
        bits = bits.pop()
        if codec not in _MOST:
            raise TiffError(f"compression {codec}")
        if predictor not in (1, 2, 3) or predictor == 2 and (bits < 8 or real and bits == 64) or predictor == 3 and not real:
            raise TiffError(f"predictor {predictor} of {bits} bits")
        planes = s if one(PLANAR, 1) == 2 else 1
        depth = s // planes
        tiled = TILE_OFFSETS in tags
        offsets, counts = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS)
        if not offsets or not counts:
            raise TiffError("a page without data")
        tw, th = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (w, min(h, one(ROWS_PER_STRIP, h)))
        if not tw or not th:
            raise TiffError("tiles or strips without size")
        needed = planes * -(-h // th) * -(-w // tw)
        if min(len(offsets), len(counts)) < needed:
            raise TiffError("fewer strips or tiles than the page has")
        line = -(-tw * depth * bits // 8)
        parts, k = [], 0
        for plane in range(planes):
            for y in range(0, h, th):
                for x in range(0, w, tw):
                    rows = th if tiled else min(th, h - y)
                    if rows * line > _MOST[codec] * (counts[k] + 64):
                        raise TiffError("a strip or tile larger than its data can hold")
                    part = _decode(raw[offsets[k] : offsets[k] + counts[k]], codec, rows * line)[: rows * line]
                    if len(part) < rows * line:
                        raise TiffError("a strip or tile is too short")
                    parts.append((plane, y, x, _samples(part, order, rows, tw, depth, bits, real, predictor)))
                    k += 1
        image = np.zeros((h, w, s), parts[0][3].dtype.newbyteorder("="))
        for plane, y, x, part in parts:
            image[y : y + th, x : x + tw, plane * depth : (plane + 1) * depth] = part[: h - y, : w - x]
        yield image


def text_media(docs: DataFrame, codec: int = DEFLATE, predictor: bool = False) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a grey page of width 64.

    A null text is an empty one: one row of zeros. Equal texts give equal files, in any row; repeated rows are kept, rows without
    an id left out; other columns, whatever their names, are not read. A text of any length is one page. An empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                sizes.append(len(raw))
                payload = np.frombuffer(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), np.uint8)
                media.append(write_tiff([payload.reshape(-1, 64)], codec, predictor))
            for k in range(0, len(media), 512):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 512), pa.array(sizes[k : k + 512], pa.int64()), pa.array(media[k : k + 512], pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature_of(image: np.ndarray) -> str:
    """A digest of the look of a page: which of its 64 column means exceed the page's mean, as 16 hexadecimal digits,
    then the mean and the number of distinct sample values."""
    means = image.reshape(image.shape[0], -1).mean(axis=0)
    columns = np.array([part.mean() for part in np.array_split(means, 64)]) if len(means) >= 64 else np.resize(means, 64)
    bits = np.packbits(columns > columns.mean())
    return f"{bits.tobytes().hex()}-{image.mean():.4f}-{len(np.unique(image))}"


def media_pages(media: DataFrame, with_samples: bool = True) -> DataFrame:
    """One row per page of the files in the columns (doc_id, n_bytes, media): doc_id, page, width, height, samples, pixels,
    digests and feature, or one row with `error` where a file can't be read (after those of the pages before the fault). A null file gives a
    row with an error too. Repeated rows give repeated pages; rows without an id are kept; other columns are not read.
    """
    kept = [("pixels", pa.binary())] if with_samples else []
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), *kept]
    fields += [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())]
    schema = pa.schema(fields)
    names = [f[0] for f in fields]

    def rows_of(doc_id, n_bytes, raw):
        base = {"doc_id": doc_id, "n_bytes": n_bytes, "media_bytes": None if raw is None else len(raw), "media_sha256": None if raw is None else hashlib.sha256(raw).hexdigest()}
        try:
            if raw is None:
                raise TiffError("no file")
            for page, image in enumerate(read_tiff(raw)):
                payload = image.tobytes()
                yield base | {
                    "page": page, "width": image.shape[1], "height": image.shape[0], "samples": image.shape[2], "pixels": payload, "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "feature": feature_of(image),
                }
        except (ValueError, IndexError, OverflowError, MemoryError, zlib.error, struct.error) as e:
            yield base | {"error": (str(e) or type(e).__name__)[:200]}

    def run(batches):
        for batch in batches:
            held = []
            for doc_id, n_bytes, raw in zip(*(batch.column(k) for k in range(3))):
                held += rows_of(doc_id.as_py(), n_bytes.as_py(), raw.as_py())
                if len(held) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], schema.field(c).type) for c in names], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], schema.field(c).type) for c in names], schema=schema)

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in fields))


def op6_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents, stored as deflated TIFF and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = media_pages(text_media(docs, DEFLATE, predictor=True), with_samples=False)
    return pages.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat(F.lit("page-"), "page", F.lit("-"), "feature").alias("feature"))
