"""Media columns: baseline JPEG images whose DC-only luminance thumbnail holds a payload, and a decoder for such columns.

The encoder turns a payload into grey baseline JPEG frames: every 8 x 8 block is flat, its quantised DC coefficient is
one payload byte less 128 (DC quantiser 8), its AC coefficients are absent. A block row is one restart interval. The
Huffman table gives every block 16 bits, so that blocks begin at whole bytes and repeated text gives repeated bytes: media
are written as a Parquet column, whose compression then finds them. Shorter codes, about nine bits a block, leave it little.
The decoder parses the markers of any 8-bit baseline image (one or more components, any sampling, any Huffman and
quantiser tables, restart intervals), Huffman-decodes the scan and keeps the DC coefficients of the first component: the
thumbnail of one pixel per block. For flat blocks this is exact, so payloads survive byte for byte.

Restart intervals are independent, so all intervals of all images of an Arrow slice are decoded in lockstep: a numpy
step reads one Huffman symbol of every interval. Encoding is one table lookup per sample.
The operators are narrow Arrow stages: no shuffle, memory bounded by a slice of ``SLICE`` bytes or one payload.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, cut, texts_as_bytes

WIDTH = 192  #: blocks in a row of the encoder's frames
MAX_ROWS = 8191  #: block rows of a frame: 65,528 lines
SLICE = 2 << 20  #: payload bytes that are coded together

SAMPLE = 16  #: bits of a block: DC code, magnitude, end of block
# A DC category k has k bits of magnitude, the end of block one; the DC code takes the rest, and none is all ones.
AC_LENGTHS = {0x00: 1}
DC_LENGTHS = {k: SAMPLE - AC_LENGTHS[0x00] - k for k in range(9)}


def canonical(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """``symbol -> (code, bits)`` of a Huffman table given as numbers of codes of 1..16 bits and the symbols in order."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return out


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16 bits ahead: ``bits << 8 | symbol`` of the code they begin with, 0 where none does."""
    out = np.zeros(1 << 16, np.uint16)
    for s, (code, bits) in canonical(counts, symbols).items():
        out[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | s
    return out


def _table(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    return [sum(v == n for v in lengths.values()) for n in range(1, 17)], sorted(lengths, key=lambda s: (lengths[s], s))


def _sample_codes() -> np.ndarray:
    """The ``SAMPLE`` bits of every difference -255..255 (index + 255): DC code, magnitude, end of block."""
    dc, (eob, spare) = canonical(*_table(DC_LENGTHS)), canonical(*_table(AC_LENGTHS))[0]
    out = np.zeros(511, ">u2")
    for d in range(-255, 256):
        k = abs(d).bit_length()
        out[d + 255] = (dc[k][0] << k | (d if d >= 0 else d + (1 << k) - 1)) << spare | eob
    return out


SAMPLE_CODES = _sample_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def frame_header(rows: int, width: int = WIDTH) -> bytes:
    """SOI to SOS of a grey frame of ``rows`` x ``width`` blocks with a restart interval of one block row."""
    huffman = lambda where, lengths: bytes([where, *_table(lengths)[0], *_table(lengths)[1]])
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, bytes([0] + [8] * 64)),
            _segment(0xC0, bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * width).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
            _segment(0xC4, huffman(0x00, DC_LENGTHS) + huffman(0x10, AC_LENGTHS)),
            _segment(0xDD, width.to_bytes(2, "big")),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def pack_rows(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes of each row of ``uint8`` samples, with stuffed zeros, without restart markers."""
    diff = samples.astype(np.int16) - 128
    diff[:, 1:] -= diff[:, :-1].copy()
    raw, width = SAMPLE_CODES[diff + 255].tobytes(), samples.shape[1] * SAMPLE // 8
    return [raw[a : a + width].replace(b"\xff", b"\xff\x00") for a in range(0, len(raw), width)]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of ``WIDTH`` bytes, as one JPEG frame or several behind each other."""
    rows = pack_rows(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH))
    out, at = [], 0
    for p in payloads:
        left, parts = len(p) // WIDTH, []
        while left:
            n = min(left, MAX_ROWS)
            parts.append(frame_header(n))
            parts += [x for k in range(n) for x in ((rows[at + k], bytes([0xFF, 0xD0 + k % 8])) if k < n - 1 else (rows[at + k],))]
            parts.append(b"\xff\xd9")
            at, left = at + n, left - n
        out.append(b"".join(parts))
    return out


@dataclass
class Frame:
    """What the markers of one image say; ``units`` are (component, blocks) of an MCU in scan order."""

    height: int = 0
    width: int = 0
    interval: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quant: dict[int, int] = field(default_factory=dict)  # DC quantiser of each table
    huffman: dict[int, bytes] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # index in parts, DC table, AC table
    data: tuple[int, int] = (0, 0)


def parse_frames(media: bytes) -> list[Frame]:
    """The images that ``media`` holds, one behind the other. Raises ``ValueError`` for what is not baseline JPEG."""
    frames, at, n = [], 0, len(media)
    while at < n:
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        frame, first, at = Frame(), None, at + 2
        while True:  # segments and scans, up to the end of the image
            while media[at : at + 2] == b"\xff\xff":
                at += 1
            if media[at : at + 2] == b"\xff\xd9":
                break
            if at + 4 > n or media[at] != 0xFF:
                raise ValueError("markers end early")
            marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            body = media[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC0:
                if body[0] != 8:
                    raise ValueError("only 8-bit samples")
                frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                frame.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not a baseline frame")
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    frame.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    k = 17 + sum(body[1:17])
                    frame.huffman[body[0]] = bytes(body[1:k])
                    body = body[k:]
            elif marker == 0xDD:
                frame.interval = int.from_bytes(body, "big")
            elif marker == 0xDA:
                ids = [p[0] for p in frame.parts]
                frame.scan = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                end = at
                while True:  # a scan ends at the first marker that is neither a stuffed zero nor a restart
                    end = media.find(b"\xff", end)
                    if end < 0 or end + 1 >= n:
                        raise ValueError("the scan ends early")
                    if media[end + 1] != 0 and not 0xD0 <= media[end + 1] <= 0xD7:
                        break
                    end += 2
                frame.data = (at, end)
                if first is None and any(k == 0 for k, _, _ in frame.scan):  # the scan of the luminance, with its tables
                    first = replace(frame, quant=frame.quant, huffman=dict(frame.huffman))
                at = end
        if first is None:
            raise ValueError("no scan of the first component")
        frames.append(first)
        at += 2
    return frames


def _split_restarts(scan: np.ndarray) -> list[bytes]:
    """Entropy-coded intervals of a scan without restart markers and stuffed zeros."""
    marks = np.flatnonzero((scan[:-1] == 0xFF) & (scan[1:] >= 0xD0) & (scan[1:] <= 0xD7))
    raw = scan.tobytes()
    edges = [0, *(int(m) + 2 for m in marks), len(raw) + 2]
    return [raw[a : b - 2].replace(b"\xff\x00", b"\xff") for a, b in zip(edges, edges[1:])]


def _decode_lanes(lanes: list[bytes], blocks: np.ndarray, units: list[tuple[int, int, int]], tables: list[np.ndarray]) -> np.ndarray:
    """DC coefficients, ``lanes x most blocks``, of intervals that share an MCU layout.

    ``units``: for each block of an MCU its component, DC table and AC table (indices into ``tables``). ``blocks``: how
    many blocks each lane holds. A step reads one symbol of every lane that is not done.
    """
    size = np.array([len(x) for x in lanes], np.int64)
    start = np.concatenate([[0], np.cumsum(size + 16)])[:-1]
    data = np.frombuffer(b"".join(x + b"\xff" * 16 for x in lanes), np.uint8)
    ahead = np.ndarray(shape=(len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))
    n, most = len(lanes), int(blocks.max(initial=0))
    out = np.zeros((n, most), np.int32)
    stop = 8 * (start + size) + 7
    bit = 8 * start
    k = np.zeros(n, np.int64)  # coefficient that comes next
    done = np.zeros(n, np.int64)  # blocks done
    last = np.zeros((n, 1 + max(u[0] for u in units)), np.int32)
    which = np.array(units, np.int64)
    stack = np.stack(tables)
    simple = len({u for u in units}) == 1
    live = np.flatnonzero(blocks > 0)
    while len(live):
        b, c = bit[live], k[live]
        unit = which[done[live] % len(units)] if not simple else None
        word = ahead[b >> 3].astype(np.uint64) << (b & 7).astype(np.uint64)
        code = (word >> np.uint64(48)).astype(np.int64)
        dc = c == 0
        if simple:
            hit = np.where(dc, stack[units[0][1]][code], stack[units[0][2]][code])
        else:
            hit = stack[np.where(dc, unit[:, 1], unit[:, 2]), code]
        hit = hit.astype(np.int64)
        length, symbol = hit >> 8, hit & 0xFF
        if (length == 0).any() or (b > stop[live]).any():
            raise ValueError("no Huffman code")
        run, need = np.where(dc, 0, symbol >> 4), np.where(dc, symbol, symbol & 15)
        bit[live] = b + length + need
        if dc.any():
            here, w, m = live[dc], word[dc] << length[dc].astype(np.uint64), need[dc]
            value = np.where(m > 0, w >> np.minimum(64 - m, 63).astype(np.uint64), 0).astype(np.int64)
            value = np.where((m > 0) & (value < (1 << np.maximum(m - 1, 0))), value - (1 << m) + 1, value).astype(np.int32)
            part = 0 if simple else unit[dc, 0]
            last[here, part] += value
            out[here, done[here]] = last[here, part]
        ended = ~dc & (need == 0) & (run != 15)
        step = np.where(dc, 1, np.where(ended, 64, c + run + 1))
        finished = step > 63
        k[live] = np.where(finished, 0, step)
        done[live] += finished
        if finished.any():
            live = live[done[live] < blocks[live]]
    return out


def thumbnails(media: list[bytes]) -> list[list[np.ndarray]]:
    """For each value its images' DC-only luminance thumbnails, ``uint8`` of one pixel per block of the first component."""
    groups: dict[tuple, list] = {}
    shapes: list[list] = []
    for m, value in enumerate(media):
        shapes.append([])
        raw = np.frombuffer(value, np.uint8)
        for f, frame in enumerate(parse_frames(value)):
            single = len(frame.scan) == 1  # then an MCU is one block, whatever the sampling
            hmax, vmax = max(p[1] for p in frame.parts), max(p[2] for p in frame.parts)
            units = []
            for index, dc, ac in frame.scan:
                h, v = (1, 1) if single else frame.parts[index][1:3]
                units += [(index, frame.huffman[dc], frame.huffman[0x10 | ac])] * (h * v)
            if single:
                _, h, v, _ = frame.parts[frame.scan[0][0]]
                across, down = -(-(-(-frame.width * h // hmax)) // 8), -(-(-(-frame.height * v // vmax)) // 8)
            else:
                across, down = -(-frame.width // (8 * hmax)), -(-frame.height // (8 * vmax))
            mcus = across * down
            every = frame.interval or mcus
            lanes = _split_restarts(raw[slice(*frame.data)])
            if len(lanes) != -(-mcus // every):
                raise ValueError("restart intervals are missing")
            todo = [min(every, mcus - i * every) * len(units) for i in range(len(lanes))]
            groups.setdefault(tuple(units), []).append((m, f, lanes, todo))
            shapes[-1].append((frame, across, down, every * len(units)))
    found: dict[tuple[int, int], np.ndarray] = {}
    for units, items in groups.items():
        specs = list(dict.fromkeys(t for _, d, a in units for t in (d, a)))
        tables = [lookup(list(s[:16]), list(s[16:])) for s in specs]
        plan = [(c, specs.index(d), specs.index(a)) for c, d, a in units]
        values = _decode_lanes([x for *_, lanes, _ in items for x in lanes], np.array([t for *_, todo in items for t in todo], np.int64), plan, tables)
        at = 0
        for m, f, lanes, todo in items:
            part = values[at : at + len(lanes)]
            at += len(lanes)
            found[m, f] = np.concatenate([row[:t] for row, t in zip(part, todo)]) if len(set(todo)) > 1 else part[:, : todo[0]].reshape(-1)
    out = []
    for m, frames in enumerate(shapes):
        out.append([])
        for f, (frame, across, down, _) in enumerate(frames):
            units = [c for index, _, _ in frame.scan for c in [index] * (1 if len(frame.scan) == 1 else frame.parts[index][1] * frame.parts[index][2])]
            first = [i for i, c in enumerate(units) if c == frame.scan[0][0]]
            h, v = (1, 1) if len(frame.scan) == 1 else frame.parts[frame.scan[0][0]][1:3]
            dc = found[m, f].reshape(down, across, len(units))[:, :, first].reshape(down, across, v, h)
            dc = dc.transpose(0, 2, 1, 3).reshape(down * v, across * h)
            level = dc * frame.quant[frame.parts[frame.scan[0][0]][3]]
            out[-1].append(np.clip((level + 4 >> 3) + 128, 0, 255).astype(np.uint8))
    return out


def thumbnail_hash(images: list[np.ndarray]) -> str:
    """64-bit difference hash, as hex, of each thumbnail: means of an 8 x 9 grid of cells, compared along rows."""
    out = []
    for image in images:
        rows = np.linspace(0, image.shape[0], 9).astype(int)
        cols = np.linspace(0, image.shape[1], 10).astype(int)
        total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
        total[1:, 1:] = image.astype(np.float64).cumsum(axis=0).cumsum(axis=1)
        r0, r1, c0, c1 = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1), cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
        r1, c1 = np.minimum(r1, image.shape[0]), np.minimum(c1, image.shape[1])
        r0, c0 = np.minimum(r0, r1 - 1), np.minimum(c0, c1 - 1)
        sums = total[r1][:, c1] - total[r0][:, c1] - total[r1][:, c0] + total[r0][:, c0]
        grid = sums / np.outer(r1 - r0, c1 - c0)
        out.append(np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex())
    return "-".join(out)


def safe_thumbnails(media: list[bytes]) -> list[list[np.ndarray] | str]:
    """``thumbnails``, or the error's text for each value that is no baseline JPEG."""
    try:
        return thumbnails(media)
    except (ValueError, IndexError, KeyError) as e:
        if len(media) == 1:
            return [str(e) or type(e).__name__]
        return [x for m in media for x in safe_thumbnails([m])]


def encode_media(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_bytes long, media binary``: each whole text, padded with spaces to a positive multiple of 192 bytes.

    Null texts are stored as empty ones (192 spaces). Texts of any length are stored; beyond 8191 block rows in further
    frames. Null ids, repeated rows and empty tables pass through; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for keys, texts in byte_slices(batches, "doc_id", "text", limit=SLICE):
            payloads = [t + b" " * (-len(t) % width or width * (not t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batches_type[0]), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode_payloads(payloads), pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    batches_type = [to_arrow_type(kind)]
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return texts_as_bytes(docs, "doc_id").mapInArrow(run, schema)


def store_media(docs: DataFrame) -> DataFrame:
    """``encode_media`` written to the shared folder as a column of Parquet files, and read back from them."""
    return cut(encode_media(docs), "media")


def decode_media(rows: DataFrame) -> DataFrame:
    """Decode ``media`` of ``rows(doc_id, n_bytes, media)``: pixel dimensions, frames, thumbnail digests and its hash.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width,
    height, frames, error``; everything after ``n_bytes`` comes from the media bytes alone. ``feature`` is the size and the
    hash of every frame's thumbnail. Null media give nulls; so do values that are no baseline JPEG, with the reason in
    ``error``, and the rows beside them are decoded.
    """
    kind = rows.schema["doc_id"].dataType
    names = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, frames int, error string"
    schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string(names).fields])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for keys, n_bytes, media in byte_slices(batches, "doc_id", "n_bytes", "media", limit=SLICE * SAMPLE // 8):
            images = iter(safe_thumbnails([m for m in media if m is not None]))
            out = []
            for m in media:
                pictures = None if m is None else next(images)
                if not pictures or isinstance(pictures, str):
                    out.append([*[None] * 3, *([None] * 2 if m is None else [len(m), hashlib.sha256(m).hexdigest()]), *[None] * 4, pictures if isinstance(pictures, str) else None if m is None else "no image"])
                    continue
                payload = b"".join(p.tobytes() for p in pictures)
                across, down = 8 * max(p.shape[1] for p in pictures), 8 * sum(p.shape[0] for p in pictures)
                mark = thumbnail_hash(pictures)
                out.append([len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), f"{across}x{down}:{mark}", across, down, len(pictures), None])
            columns = [keys, n_bytes, *map(list, zip(*out))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], names=arrow.names)

    return rows.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
