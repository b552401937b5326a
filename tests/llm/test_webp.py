import hashlib
import zlib

import numpy as np
import pytest

from cairn.llm.webp import BLACK, PALETTE, PREDICTOR, _open, decode_bytes, decode_files, decode_images, encode_bytes, encode_image, frames, pad, palette_bits, read_media, store_texts, to_file

from .cases import edge_docs, edge_rows, empty_docs


def image(rng, kind):
    h, w = int(rng.integers(1, 20)), int(rng.integers(1, 24))
    colours = rng.integers(0, 2**32, [0, 40, 4, 2][kind] or 1, dtype=np.uint64).astype(np.uint32)
    return rng.choice(colours, (h, w)) if kind else rng.integers(0, 2**32, (h, w), dtype=np.uint64).astype(np.uint32)


def test_all_features_round_trip():
    rng = np.random.default_rng(0)
    for t in range(60):
        argb = image(rng, t % 4)
        h, w = argb.shape
        options, bits = {"bits": int(rng.integers(2, 4))}, None
        bits = options["bits"]
        if t % 4 and rng.random() < 0.6:
            options["palette"] = True
            k = palette_bits(len(np.unique(argb)))
            w = (w + (1 << k) - 1) >> k
        blocks = (h + (1 << bits) - 1) >> bits, (w + (1 << bits) - 1) >> bits
        if rng.random() < 0.6:
            options["predictor"] = rng.integers(0, 16, blocks)
        if rng.random() < 0.5:
            options["cross"] = BLACK | rng.integers(0, 2**24, blocks).astype(np.uint32)
        options["green"] = bool(rng.integers(2))
        options["cache_bits"] = int(rng.integers(0, 12))
        if rng.random() < 0.4:
            options |= {"meta": rng.integers(0, 3, ((h + 3) >> 2, (w + 3) >> 2)), "meta_bits": 2}
        assert (decode_images([encode_image(argb, **options)])[0] == argb).all()


def test_known_stream():
    # one green pixel, written bit by bit from the format's description
    bits, value, at = [(0x2F, 8), (0, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)], 0, 0
    for symbol in (200, 0, 0, 255):
        bits += [(1, 1), (0, 1), (1, 1), (symbol, 8)]
    bits += [(1, 1), (0, 1), (0, 1), (0, 1)]
    for x, n in bits:
        value |= x << at
        at += n
    assert decode_images([value.to_bytes((at + 7) // 8, "little")])[0].tolist() == [[0xFF00C800]]


def test_lanes_and_frames():
    raw = [b"", b"a", b"abc" * 9000, bytes(range(256)) * 50, b"\xff" * 576, b"x" * 100_000]
    files = encode_bytes([pad(x) for x in raw])
    assert decode_bytes(files) == [pad(x) for x in raw]
    assert [decode_files([f])[0].shape[1] for f in files] == [576] * len(raw)
    assert encode_bytes([]) == [] and decode_bytes([]) == []


def test_strips_choose_transforms():
    """Palettes and predictors where they make the file smaller, none for plain prose, and the same bytes back."""
    rng = np.random.default_rng(4)
    row = rng.integers(0, 256, 576)
    cases = {
        PALETTE: bytes(rng.choice(list(b"AB "), 576 * 20, p=(0.94, 0.04, 0.02)).astype(np.uint8)),
        PREDICTOR: (np.cumsum(rng.integers(0, 3, 576 * 30)) & 255).astype(np.uint8).tobytes(),
        "down": np.concatenate([(row + i + rng.integers(0, 2, 576)) & 255 for i in range(16)]).astype(np.uint8).tobytes(),
        None: bytes(rng.choice(list(b"etaoin shrdlu cmfwyp vbgkjq"), 576 * 16).astype(np.uint8)),
    }
    for want, raw in cases.items():
        file = encode_bytes([raw])[0]
        assert decode_bytes([file]) == [raw]
        kinds = {t[0] for _, _, c in frames(file)[1] for t in _open(c)[1]}
        assert kinds == (set() if want is None else {PREDICTOR if want == "down" else want})
        assert len(file) < len(raw) * (0.3 if want == PALETTE else 0.9)


def test_very_long_text():
    raw = pad(" ".join(f"word{i % 7919}" for i in range(300_000)).encode())
    assert decode_bytes(encode_bytes([raw])) == [raw]


def test_broken_files_are_refused():
    good = encode_bytes([pad(b"some text " * 90)])[0]
    for bad in (b"", b"RIFF", good[:40], good[:12] + b"JUNK" + good[16:], to_file([(0, 1, b"\x2f\0\0\0\0")], 1, 1)):
        with pytest.raises(ValueError):
            decode_files([bad])


def test_tables(spark):
    got = read_media(store_texts(edge_docs(spark)), digests=True).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        raw = (next(x[1] for x in edge_rows() if x[0] == r.doc_id) or "").encode()
        assert r.n_bytes == len(raw) and r.payload_sha256 == hashlib.sha256(pad(raw)).hexdigest() and r.tail_crc32 == zlib.crc32(pad(raw)[-32:])
        assert r.payload_bytes == len(pad(raw)) and r.id == "clash"
    back = read_media(store_texts(edge_docs(spark))).collect()
    assert {bytes(r.payload) for r in back} == {pad((x[1] or "").encode()) for x in edge_rows()}
    assert read_media(store_texts(empty_docs(spark)), digests=True).count() == 0
