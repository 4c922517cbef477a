import hashlib
import zlib

import numpy as np

from docframe.llm import media


def test_payloads_survive_exactly():
    rng = np.random.default_rng(1)
    payloads = [bytes(rng.integers(0, 256, 576 * k, dtype=np.uint8)) for k in (1, 2, 7, 40)] + [b"\xff" * 576, b"\x00" * 1152, bytes(range(256)) * 9, b"\x00\xff" * 288]
    for value, files in zip(payloads, media.thumbnails(media.encode_payloads(payloads))):
        assert b"".join(x.tobytes()[: i.payload] for i, x in files) == value


def test_large_payloads_take_more_columns_and_more_files(monkeypatch):
    monkeypatch.setattr(media, "MOST_BLOCKS", 48)
    value = bytes(np.random.default_rng(2).integers(0, 256, 576 * 9, dtype=np.uint8))
    made = media.encode_payloads([value])[0]
    files = media.thumbnails([made])[0]
    assert len(files) == 3 and b"".join(x.tobytes()[: i.payload] for i, x in files) == value


def test_texts_to_features(spark):
    texts = [None, "", "abc", "abc", "é" * 1000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in media.media_features(media.encode_media(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r["error"] is None and r["feature"]
    assert got[0]["feature"] == got[1]["feature"] and got[2]["media_sha256"] == got[3]["media_sha256"] and got[2]["feature"] != got[4]["feature"]
    assert media.media_features(media.encode_media(df.limit(0))).count() == 0


def test_damaged_values_do_not_spoil_the_batch(spark):
    good = media.encode_payloads([b"\x07" * 576])[0]
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no")), (3, None), (4, bytearray(good[:-40]))], "k int, media binary")
    got = {r["k"]: r for r in media.media_features(df).collect()}
    assert got[1]["error"] is None and all(got[k]["error"] for k in (2, 3, 4))


def bits_of(pairs):
    s = "".join(f"{v:0{n}b}" for v, n in pairs if n)
    s += "1" * (-len(s) % 8)
    return int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\x00")


def test_colour_with_subsampling_and_ac_coefficients():
    """A hand-made 32 x 16 file of three components, 4:2:0, whose luminance blocks carry an AC coefficient."""
    dc, _ = media.huffman(media.DC_COUNTS, media.DC_VALUES)
    ac_counts, ac_values = [0, 1, 2] + [0] * 13, [0x00, 0x01, 0x11]
    ac, _ = media.huffman(ac_counts, ac_values)
    want = [[10, -20, 30, 0], [5, 5, -60, 100]]
    out, pred = [], [0, 0, 0]

    def block(c, value, tail):
        d = value - pred[c]
        pred[c] = value
        cat = abs(d).bit_length()
        out.append(dc[cat])
        out.append((d if d >= 0 else d + (1 << cat) - 1, cat))
        for symbol, bits in tail:
            out.append(ac[symbol])
            out.append((bits, 1))
        out.append(ac[0])

    for mcu in want:
        for v in mcu:
            block(0, v, [(0x01, 1), (0x11, 0)])
        block(1, 3, [])
        block(2, -3, [(0x01, 0)])
    head = [
        b"\xff\xd8", media._marker(0xDB, bytes([0, 4] + [1] * 63)), media._marker(0xC0, b"\x08\x00\x10\x00\x20\x03" + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        media._marker(0xC4, bytes([0, *media.DC_COUNTS, *media.DC_VALUES])), media._marker(0xC4, bytes([0x10, *ac_counts, *ac_values])), media._marker(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
    ]
    (image, light), = media.thumbnails([b"".join(head) + bits_of(out) + b"\xff\xd9"])[0]
    assert (image.width, image.height, light.shape) == (32, 16, (2, 4))
    q = lambda v: min(255, max(0, (v * 4 + 4) // 8 + 128))
    assert light.tolist() == [[q(10), q(-20), q(5), q(5)], [q(30), q(0), q(-60), q(100)]]


def test_features_keep_other_columns_and_give_way_by_name(spark):
    df = spark.createDataFrame([(1, "text", "own", 7), (1, "text", "own", 7), (None, None, None, None)], "doc_id long, text string, feature string, extra int")
    held = media.encode_media(df)
    assert media.media_features(held.limit(0)).count() == 0
    wide = held.join(df.select("doc_id", "feature", "extra").distinct(), "doc_id")
    got = media.media_features(wide).collect()
    assert len(got) == 2 and all(r["extra"] == 7 and r["feature"] != "own" for r in got)
