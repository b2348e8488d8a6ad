"""Media columns: motion-JPEG in AVI files, written, indexed, decoded and cut into shots.

A video is one binary value. Frames are grey 8-bit images in lossless JPEG
(process 14, SOF3, predictor 1: the left neighbour), so samples come back
exactly. The Huffman table gives the difference category s a code of 9 - s bits,
and s more bits follow, so a sample always takes nine bits and a whole frame
decodes with array operations; frames with other code lengths are decoded bit
by bit.

Shots: the grey histograms of consecutive frames are compared; a cut is where
their difference exceeds the mean of the last differences by a multiple of
their spread and a floor, so the threshold follows the scene.

Defined cases: a null or empty payload is 64 zero bytes; a null, truncated or
foreign video yields no frames and no clips; equal bytes give equal values; a
long payload has more frames, handled one by one. Other columns are not kept.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

WIDTH, HEIGHT, FPS, BLOCK = 64, 32, 25, 64
#: Shot detection: bins of a histogram, differences remembered, spreads above their mean, least difference of a cut.
BINS, MEMORY, SPREADS, FLOOR = 16, 8, 2.0, 0.15


# JPEG ---------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


# Nine categories, 0 to 8; category 8 has the shortest code.
_TABLE = _segment(0xC4, bytes([0x00]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
_SCAN = _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))


@functools.cache
def _nine_bits() -> np.ndarray:
    """For each difference -255..255 its nine bits, most significant first."""
    out = np.zeros((511, 9), np.uint8)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        extra = d if d > 0 else d + (1 << s) - 1
        code = ((1 << (9 - s)) - 2) << s | extra if s else 0b111111110
        out[d + 255] = [(code >> (8 - k)) & 1 for k in range(9)]
    return out


@functools.cache
def _differences() -> np.ndarray:
    """For each nine-bit value the difference that it stands for."""
    out = np.zeros(512, np.int64)
    for d, bits in zip(range(-255, 256), _nine_bits(), strict=True):
        out[int("".join(map(str, bits)), 2)] = d
    return out


def encode_frame(image: np.ndarray) -> bytes:
    """A grey uint8 image as a lossless JPEG."""
    x = image.astype(np.int16)
    d = np.empty_like(x)
    d[:, 1:] = x[:, 1:] - x[:, :-1]
    d[1:, 0] = x[1:, 0] - x[:-1, 0]
    d[0, 0] = x[0, 0] - 128
    bits = _nine_bits()[d.ravel() + 255].ravel()
    if pad := -len(bits) % 8:
        bits = np.concatenate([bits, np.ones(pad, np.uint8)])
    frame = _segment(0xC3, struct.pack(">BHHB", 8, *image.shape, 1) + bytes([1, 0x11, 0]))
    return b"\xff\xd8" + frame + _TABLE + _SCAN + np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def decode_frame(data: bytes) -> np.ndarray:
    """The image of a lossless grey JPEG with one component."""
    at, shape, codes, restored = 2, None, {}, b""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at + 4 <= len(data):
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC3:
            bits, high, wide, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise ValueError("one component of 8 bits is read")
            shape = (high, wide)
        elif marker == 0xC4:
            counts, symbols, code, k = body[1:17], body[17:], 0, 0
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    codes[(length, code)] = symbols[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xDA:
            if body[3] != 1:
                raise ValueError("predictor 1 is read")
            end = data.rfind(b"\xff\xd9")
            restored = data[at : end if end >= 0 else len(data)].replace(b"\xff\x00", b"\xff")
            break
    if shape is None or not restored or not codes:
        raise ValueError("no frame")
    n, stream = shape[0] * shape[1], np.unpackbits(np.frombuffer(restored, np.uint8))
    if all(length + s == 9 for (length, _), s in codes.items()) and sorted(codes.values()) == list(range(9)):
        if len(stream) < 9 * n:
            raise ValueError("truncated frame")
        weights = (1 << np.arange(8, -1, -1)).astype(np.int64)
        d = _differences()[stream[: 9 * n].reshape(n, 9) @ weights]
    else:
        d = _bit_by_bit(stream, codes, n)
    d = d.reshape(shape)
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0])
    return (np.cumsum(d, axis=1) & 0xFF).astype(np.uint8)


def _bit_by_bit(stream: np.ndarray, codes: dict[tuple[int, int], int], n: int) -> np.ndarray:
    out, at = np.zeros(n, np.int64), 0
    for i in range(n):
        code, length = 0, 0
        while (length, code) not in codes:
            if length > 16 or at >= len(stream):
                raise ValueError("truncated frame")
            code, length, at = code << 1 | int(stream[at]), length + 1, at + 1
        s, extra = codes[(length, code)], 0
        for b in stream[at : at + s]:
            extra = extra << 1 | int(b)
        at += s
        out[i] = 0 if s == 0 else extra if extra >> (s - 1) else extra - (1 << s) + 1
    return out


# AVI ----------------------------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """JPEG frames as an AVI file with an index."""
    main = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    movie, index, at = [], [], 4
    for frame in frames:
        movie.append(_chunk(b"00dc", frame))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(frame)))
        at += len(movie[-1])
    return _chunk(b"RIFF", b"AVI " + head + _list(b"movi", b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


def _children(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


def read_avi(data: bytes | None) -> tuple[float, list[tuple[int, int]]]:
    """Milliseconds a frame, and (offset, size) of each frame by the index, or by the chunks where there is none."""
    if not data or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return 0.0, []
    ms, movie, index = 1000 / FPS, None, []
    for name, at, end in _children(data, 12, len(data)):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            for inner, a, _ in _children(data, at + 4, end):
                if inner == b"avih":
                    ms = struct.unpack_from("<I", data, a)[0] / 1000
        elif name == b"LIST" and kind == b"movi":
            movie = (at, end)
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, x) for x in range(at, end - 15, 16)]
    if movie is None:
        return ms, []
    if index:
        # Offsets count from the movi list or from the start of the file.
        base = 0 if data[index[0][2] : index[0][2] + 4] == index[0][0] else movie[0]
        found = [(base + off + 8, size) for name, _, off, size in index if name[2:] == b"dc"]
    else:
        found = [(a, e - a) for name, a, e in _children(data, movie[0] + 4, movie[1]) if name[2:] == b"dc"]
    return ms, [(a, n) for a, n in found if a + n <= len(data)]


def decode_avi(data: bytes | None) -> tuple[float, list[np.ndarray]]:
    ms, places = read_avi(data)
    try:
        return ms, [decode_frame(data[a : a + n]) for a, n in places]
    except (ValueError, struct.error, IndexError):
        return ms, []


def store_payload(payload: bytes) -> bytes:
    """Bytes, a multiple of 64, as the samples of a video."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return write_avi([encode_frame(rows[i : i + HEIGHT]) for i in range(0, len(rows), HEIGHT)], WIDTH, HEIGHT)


# Shots --------------------------------------------------------------------------------------------------------


def detect_shots(frames: list[np.ndarray]) -> list[tuple[int, int, float]]:
    """(first frame, end, difference that opened it) of each shot."""
    if not frames:
        return []
    bars = np.array([np.bincount(f.ravel() * BINS // 256 if f.dtype != np.uint8 else f.ravel() >> 4, minlength=BINS) / f.size for f in frames])
    jumps = np.abs(np.diff(bars, axis=0)).sum(axis=1) / 2
    cuts, recent = [(0, 0.0)], []
    for i, jump in enumerate(jumps.tolist(), 1):
        limit = max(FLOOR, float(np.mean(recent)) + SPREADS * float(np.std(recent))) if len(recent) >= 2 else FLOOR
        if jump > limit:
            cuts.append((i, jump))
            recent = []
        else:
            recent = [*recent[-MEMORY + 1 :], jump]
    ends = [c for c, _ in cuts[1:]] + [len(frames)]
    return [(a, e, jump) for (a, jump), e in zip(cuts, ends, strict=True)]


CLIPS = "clip long, first_frame long, n_frames long, start_ms double, end_ms double, jump double, mean_grey double"


def media_clips(videos: DataFrame, id_col: str = "doc_id", video_col: str = "video") -> DataFrame:
    """Timed clip rows of a binary column of AVI files; each video is decoded where its row is."""
    kind = dict(videos.dtypes)[id_col]

    def clips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, video in zip(batch[id_col], batch[video_col], strict=True):
                ms, frames = decode_avi(video)
                for k, (a, e, jump) in enumerate(detect_shots(frames)):
                    grey = float(np.mean([f.mean() for f in frames[a:e]]))
                    rows.append((key, k, a, e - a, a * ms, e * ms, jump, grey))
            yield pd.DataFrame(rows, columns=[id_col, *(c.split()[0] for c in CLIPS.split(", "))])

    return videos.select(id_col, video_col).mapInPandas(clips, f"`{id_col}` {kind}, {CLIPS}")


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (-len(raw) % BLOCK if raw else BLOCK)


DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
    " media_bytes long, media_sha256 string, feature string, n_frames long, n_clips long"
)


def media_digest(docs: DataFrame) -> DataFrame:
    """Store each whole text as a video, read it back, and describe its shots."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DIGEST.split(",")]
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                n, payload = padded(text)
                video = store_payload(payload)
                _, frames = decode_avi(video)
                back = b"".join(f.tobytes() for f in frames)
                shots = detect_shots(frames)
                told = ";".join(f"{a}-{e}:{jump:.4f}" for a, e, jump in shots)
                rows.append((key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(video), hashlib.sha256(video).hexdigest(), f"{len(frames)} frames, shots {told}", len(frames), len(shots)))
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", "text").mapInPandas(digest, DIGEST)
