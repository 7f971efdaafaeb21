import hashlib
import zlib

import numpy as np
import pytest

from tessera.llm import media_jpeg as mj
from tessera.llm import queries
from tests.llm import docs


def bits(codes):
    text = "".join(codes)
    text += "1" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")


def test_payloads_survive():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 192 * n, dtype=np.uint8).tobytes() for n in (1, 2, 9, 40)]
    media = mj.encode_payloads(payloads)
    assert [b"".join(p.tobytes() for p in x) for x in mj.thumbnails(media)] == payloads
    assert all(m[:2] == b"\xff\xd8" and m[-2:] == b"\xff\xd9" for m in media)


def test_blocks_are_whole_bytes():
    """Every difference has its own 16 bits, no DC code begins another, and blocks without stuffing lie two bytes apart."""
    assert len(set(mj.SAMPLE_CODES.tolist())) == 511
    codes = [format(c, f"0{n}b") for c, n in mj.canonical(*mj._table(mj.DC_LENGTHS)).values()]
    assert not any(a != b and b.startswith(a) for a in codes for b in codes) and not any(set(c) == {"1"} for c in codes)
    word = b"repeated words "
    row = mj.pack_rows(np.frombuffer((word * 13)[:192], np.uint8)[None])[0]
    assert b"\xff" not in row and len(row) == 384 and row[2:].count(row[32:60]) > 10


def test_payloads_beyond_one_frame():
    payload = bytes(range(192)) * (mj.MAX_ROWS + 3)
    images = mj.thumbnails(mj.encode_payloads([payload]))[0]
    assert len(images) == 2 and b"".join(p.tobytes() for p in images) == payload


def test_colour_image_with_subsampling_and_ac_symbols():
    """A hand-made 16 x 16 image: 2 x 2 luminance blocks and one block of each chroma, no restart interval."""
    dc = mj.canonical([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7, list(range(12)))
    ac_counts, ac_symbols = [0, 1, 2, 1] + [0] * 12, [0x00, 0x01, 0x11, 0xF0]
    ac = mj.canonical(ac_counts, ac_symbols)
    word = lambda table, s: format(table[s][0], f"0{table[s][1]}b")

    def number(table, d):
        k = abs(d).bit_length()
        return word(table, k) + (format(d if d > 0 else d + (1 << k) - 1, f"0{k}b") if k else "")

    out, last = [], [0, 0, 0]
    for part, value, extra in [(0, 10, 1), (0, -20, 0), (0, 30, 1), (0, 0, 0), (1, 5, 0), (2, -7, 1)]:
        out.append(number(dc, value - last[part]))
        last[part] = value
        if extra:  # a coefficient of 1, sixteen zeros, a run of one and -1
            out += [word(ac, 0x01) + "1", word(ac, 0xF0), word(ac, 0x11) + "0"]
        out.append(word(ac, 0x00))
    segment = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    media = b"".join(
        [
            b"\xff\xd8", segment(0xFE, b"a comment"), segment(0xDB, bytes([0] + [16] * 64) + bytes([1] + [9] * 64)),
            segment(0xC0, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])),
            segment(0xC4, bytes([0x00, 0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7 + list(range(12)))), segment(0xC4, bytes([0x10, *ac_counts, *ac_symbols])),
            segment(0xDA, bytes([3, 1, 0x00, 2, 0x00, 3, 0x00, 0, 63, 0])), bits(out), b"\xff\xd9",
        ]
    )
    image = mj.thumbnails([media])[0][0]
    assert image.tolist() == [[148, 88], [188, 128]]

    def scan(part, values):
        coded, before = [], 0
        for value in values:
            coded += [number(dc, value - before), word(ac, 0x00)]
            before = value
        return segment(0xDA, bytes([1, part, 0x00, 0, 63, 0])) + bits(coded)

    head = media[: media.index(b"\xff\xda")]
    several = head + scan(3, [-7]) + scan(1, [10, -20, 30, 0]) + segment(0xC4, bytes([0x00, 1, *[0] * 15, 0])) + scan(2, [0]) + b"\xff\xd9"
    assert mj.thumbnails([several])[0][0].tolist() == image.tolist(), "scans of one component each, tables redefined behind"


def test_what_is_not_baseline_is_refused():
    good = mj.encode_payloads([b"a" * 192])[0]
    for bad in (b"", b"GIF89a", good[:40], good.replace(b"\xff\xc0", b"\xff\xc2")):
        if bad:
            with pytest.raises(ValueError):
                mj.parse_frames(bad)


def test_awkward_rows(spark):
    got = mj.decode_media(mj.store_media(docs.table(spark))).collect()
    assert len(got) == len(docs.ROWS)
    for r in got:
        raw = [(t or "").encode() for i, t, *_ in docs.ROWS if i == r.doc_id and len((t or "").encode()) == r.n_bytes][0]
        payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        assert r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
    assert mj.decode_media(mj.store_media(docs.empty(spark))).count() == 0
    nothing = mj.decode_media(spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")).collect()[0]
    assert nothing.media_sha256 is None and nothing.error is None


def test_broken_values_and_all_frames(spark, monkeypatch):
    good = mj.encode_payloads([b"a" * 192, b"b" * 384])
    rows = [(1, 0, good[0]), (2, 0, b"GIF89a"), (3, 0, good[1][:-30]), (4, 0, good[1]), (5, 0, b"")]
    got = {r.doc_id: r for r in mj.decode_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert {i: r.payload_bytes for i, r in got.items()} == {1: 192, 2: None, 3: None, 4: 384, 5: None}
    assert {i for i, r in got.items() if r.error} == {2, 3, 5} and got[2].media_bytes == 6
    monkeypatch.setattr(mj, "MAX_ROWS", 2)
    wave = lambda k: bytes((i * k) % 251 for i in range(192 * 5))
    one, two = (mj.thumbnail_hash(mj.thumbnails(mj.encode_payloads([p]))[0]) for p in (wave(7), wave(7)[: 192 * 4] + wave(3)[:192]))
    assert len(one.split("-")) == 3 and one.split("-")[:2] == two.split("-")[:2] and one != two


def test_op3_equal_texts_equal_values(spark, small):
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    seen = {}
    for r in queries.op3_jpeg_media(spark, small).collect():
        raw = text[r.doc_id]
        payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        assert (r.n_bytes, r.payload_sha256) == (len(raw), hashlib.sha256(payload).hexdigest())
        assert seen.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
