"""Lossless round trips, RIFF structure and shots."""

import hashlib
import random
import struct
import zlib

import numpy as np

from quarry.llm import media


def scalar_decode(scan):
    """One frame, bit by bit, straight from the code lengths."""
    codes = {(n, c): k for k, (c, n) in media._codes(media.LENGTHS).items()}
    bits = "".join(f"{b:08b}" for b in scan.replace(b"\xff\x00", b"\xff"))
    out, at = [], 0
    for j in range(media.FRAME):
        n = 1
        while (n, int(bits[at : at + n], 2)) not in codes:
            n += 1
        k = codes[n, int(bits[at : at + n], 2)]
        at += n
        v = int(bits[at : at + k], 2) if k else 0
        at += k
        d = v if not k or v >> (k - 1) else v - (1 << k) + 1
        out.append((d + (out[j - 1] if j % 24 else out[j - 24] if j else 128)) % 256)
    return out


def test_frames_round_trip():
    rng = np.random.default_rng(1)
    frames = rng.integers(0, 256, (40, media.FRAME)).astype(np.uint8)
    frames[1], frames[2], frames[3, ::2] = 255, 0, 255
    frames[4] = np.resize([0, 255], media.FRAME)
    scans = media.encode_frames(frames)
    assert scalar_decode(scans[0]) == frames[0].tolist() and scalar_decode(scans[4]) == frames[4].tolist()
    whole = [media.jpeg_head() + s + b"\xff\xd9" for s in scans]
    assert (media.decode_frames(whole) == frames).all()


def test_index_leads_to_frames():
    scans = media.encode_frames(np.zeros((3, media.FRAME), np.uint8))
    data = media.avi(scans, 7)
    assert struct.unpack_from("<I", data, 4)[0] == len(data) - 8
    frames, rate, size = media.read_avi(data)
    assert (len(frames), rate, size) == (3, media.RATE, 7)
    assert all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in frames)


def test_shots_stand_out():
    dark, light = np.full((6, media.FRAME), 20, np.uint8), np.full((6, media.FRAME), 220, np.uint8)
    film = np.concatenate([dark, light, dark])
    first = np.zeros(18, bool)
    first[0] = True
    assert np.flatnonzero(media.shots(film, first)).tolist() == [0, 6, 12]


def test_documents(spark):
    rng = random.Random(2)
    texts = [None, "", "é", "x" * 576, "y" * 577, "".join(rng.choices("ab é\n🙂", k=30000)), "é"]
    df = spark.createDataFrame([(i if i else None, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    films = media.media_column(df)
    got = {str(r.doc_id): r for r in media.film_features(films).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[str(i if i else None)]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(full))
        assert r.payload_sha256 == hashlib.sha256(full).hexdigest() and r.tail_crc32 == zlib.crc32(full[-32:])
    assert got["2"].media_sha256 == got["6"].media_sha256 and got["2"].feature == got["6"].feature
    clips = media.clip_rows(films).collect()
    frames = {}
    for r in clips:
        frames[str(r.doc_id)] = frames.get(str(r.doc_id), 0) + r.end_frame - r.first_frame
    assert frames == {k: r.payload_bytes // 576 for k, r in got.items()}
    assert media.film_features(media.media_column(df.limit(0))).count() == 0


def test_rows_without_a_film(spark):
    docs = spark.createDataFrame([(1, "a" * 2000, "x"), (1, "a" * 2000, "y"), (2, None, "x"), (None, "b", "x")], "doc_id long, text string, media string")
    films = media.media_column(docs).unionByName(spark.createDataFrame([(9, None)], "doc_id long, media binary"))
    rows = media.film_features(films).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in rows) == [("1", 2000), ("1", 2000), ("2", 0), ("None", 1)]
    clips = media.clip_rows(films).collect()
    assert {str(r.doc_id) for r in clips} == {"1", "2", "None"} and all(r.first_frame < r.end_frame for r in clips)
    assert media.clip_rows(films.limit(0)).count() == media.film_features(films.limit(0)).count() == 0
