"""Matroska: packet tables from EBML, and a writer that stores a payload as 8-bit PCM.

The parser walks EBML elements with variable-length ids and sizes (also unknown sizes of segments and clusters), reads
tracks, clusters, simple blocks and block groups, undoes all three kinds of lacing, and reads the cues. Every frame is a
row: track, timestamp, place and length of its bytes in the file.

Defined results: a null file gives no packets; a file that ends early or is damaged gives the packets before that place
and a message in `error`; a null or empty text is stored as 64 zero bytes; equal texts give equal files; repeated rows
are parsed each by itself; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import _shared

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1
RATE, CHANNELS, BIT_DEPTH, TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0xB5, 0x9F, 0x6264, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
NO_LACING, XIPH, FIXED, EBML_LACING = range(4)
UNKNOWN = -1


class Damaged(ValueError):
    pass


def read_id(data, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise Damaged(f"no element id at {at}")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > len(data):
        raise Damaged(f"no element id at {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_size(data, at: int) -> tuple[int, int]:
    """Value of a variable-length integer and the place behind it; UNKNOWN if all its bits are set."""
    if at >= len(data) or not data[at]:
        raise Damaged(f"no size at {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise Damaged(f"no size at {at}")
    value = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (UNKNOWN if value == (1 << 7 * n) - 1 else value), at + n


def children(data, at: int, end: int):
    """(id, start, end) of each element in a range; one of unknown size ends where an element of its parent's level starts."""
    while at < end:
        kind, body = read_id(data, at)
        size, body = read_size(data, body)
        if size == UNKNOWN:
            if kind == SEGMENT:
                stop = end
            elif kind == CLUSTER:
                stop = body
                while stop < end:
                    inner, after = read_id(data, stop)
                    if inner in TOP:
                        break
                    length, after = read_size(data, after)
                    stop = after + length
            else:
                raise Damaged(f"unknown size at {at}")
        else:
            stop = body + size
        if stop > end:
            yield kind, body, end
            raise Damaged(f"element at {at} ends behind its parent")
        yield kind, body, stop
        at = stop


def number(data, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def lacing_sizes(data, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Frame sizes of a block and the place of its first frame."""
    if kind == NO_LACING:
        return [end - at], at
    if at >= end:
        raise Damaged(f"no lacing head at {at}")
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == FIXED:
        if (end - at) % n:
            raise Damaged(f"fixed lacing at {at} leaves a rest")
        return [(end - at) // n] * n, at
    for k in range(n - 1):
        if kind == XIPH:
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise Damaged("lacing head ends early")
            size, at = size + data[at], at + 1
        else:
            width = 9 - data[at].bit_length() if at < end and data[at] else 9
            if at + width > end:
                raise Damaged("lacing head ends early")
            value, at = read_size(data, at)
            value = (1 << 7 * width) - 1 if value == UNKNOWN else value
            size = value if not k else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged(f"lacing at {at} is longer than its block")
    return sizes, at


def parse(data) -> dict:
    """tracks, packets (track, timestamp in ns, start, length, cluster, block, lacing, keyframe), cues and error."""
    out = {"tracks": {}, "packets": [], "cues": [], "clusters": 0, "error": None}
    state = {"scale": 1_000_000, "blocks": 0}
    try:
        for kind, a, b in children(data, 0, len(data)):
            if kind == SEGMENT:
                _segment(data, a, b, out, state)
    except Damaged as e:
        out["error"] = str(e)
    return out


def _segment(data, a: int, b: int, out: dict, state: dict) -> None:
    for kind, s, e in children(data, a, b):
        if kind == INFO:
            for k, x, y in children(data, s, e):
                if k == TIMESTAMP_SCALE:
                    state["scale"] = number(data, x, y)
        elif kind == TRACKS:
            for k, x, y in children(data, s, e):
                if k == TRACK_ENTRY:
                    own = {k2: bytes(data[x2:y2]) for k2, x2, y2 in children(data, x, y)}
                    out["tracks"][int.from_bytes(own.get(TRACK_NUMBER, b"\0"), "big")] = {"codec": own.get(CODEC_ID, b"").decode("ascii", "replace"), "type": int.from_bytes(own.get(TRACK_TYPE, b"\0"), "big"), "frame_ns": int.from_bytes(own.get(DEFAULT_DURATION, b"\0"), "big")}
        elif kind == CLUSTER:
            time, at = 0, out["clusters"]
            out["clusters"] += 1
            for k, x, y in children(data, s, e):
                if k == CLUSTER_TIME:
                    time = number(data, x, y)
                elif k == SIMPLE_BLOCK:
                    _block(data, x, y, time, at, out, state, None)
                elif k == BLOCK_GROUP:
                    own = [*children(data, x, y)]
                    key = not any(k2 == REFERENCE for k2, _, _ in own)
                    for k2, x2, y2 in own:
                        if k2 == BLOCK:
                            _block(data, x2, y2, time, at, out, state, key)
        elif kind == CUES:
            for k, x, y in children(data, s, e):
                if k == CUE_POINT:
                    own = [*children(data, x, y)]
                    time = next((number(data, x2, y2) for k2, x2, y2 in own if k2 == CUE_TIME), 0)
                    for k2, x2, y2 in own:
                        if k2 == CUE_POSITIONS:
                            at = {k3: number(data, x3, y3) for k3, x3, y3 in children(data, x2, y2)}
                            out["cues"].append((time * state["scale"], at.get(CUE_TRACK, 0), a + at.get(CUE_CLUSTER, 0)))


def _block(data, a: int, b: int, time: int, cluster: int, out: dict, state: dict, key: bool | None) -> None:
    track, at = read_size(data, a)
    if at + 3 > b:
        raise Damaged(f"block at {a} has no head")
    flags = data[at + 2]
    lacing = flags >> 1 & 3
    sizes, start = lacing_sizes(data, at + 3, b, lacing)
    stamp = (time + int.from_bytes(data[at : at + 2], "big", signed=True)) * state["scale"]
    step = out["tracks"].get(track, {}).get("frame_ns", 0)
    for k, size in enumerate(sizes):
        out["packets"].append((track, stamp + k * step, start, size, cluster, state["blocks"], lacing, bool(flags & 0x80) if key is None else key))
        start += size
    state["blocks"] += 1


def size_bytes(n: int, width: int = 0) -> bytes:
    width = width or max(1, -(-(n + 1).bit_length() // 7))
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes(-(-kind.bit_length() // 8), "big") + size_bytes(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, -(-n.bit_length() // 8)), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Lacing head and frames."""
    if kind == NO_LACING:
        return frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(x) for x in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


#: Samples a millisecond; a frame of 1024 samples lasts 128 ms. Frames in a block, blocks in a cluster.
PER_MS, FRAME, LACED, BLOCKS = 8, 1024, 8, 8
_HEAD = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, FRAME // PER_MS * 1_000_000) + element(AUDIO, element(RATE, struct.pack(">d", 1000.0 * PER_MS)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """One track of 8-bit samples in laced blocks, with cues to each cluster. Equal frames are laced with fixed size,
    others by turns with EBML and Xiph sizes, a single one without."""
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) / PER_MS)) + element(MUXER, b"lodestar") + element(WRITER, b"lodestar"))
    parts, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    for c, a in enumerate(range(0, len(payload), FRAME * LACED * BLOCKS)):
        start, blocks = a // PER_MS, []
        for k, b in enumerate(range(a, min(len(payload), a + FRAME * LACED * BLOCKS), FRAME * LACED)):
            frames = [payload[x : x + FRAME] for x in range(b, min(len(payload), b + FRAME * LACED), FRAME)]
            kind = NO_LACING if len(frames) == 1 else (EBML_LACING, XIPH)[(c + k) % 2] if len(frames[-1]) < FRAME else FIXED
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b // PER_MS - start, 0x80 | kind << 1) + lace(frames, kind)))
        cluster = element(CLUSTER, uint(CLUSTER_TIME, start) + b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def packet_table(files: DataFrame, key: str, column: str) -> DataFrame:
    """One row per frame of the files in a binary column, in file order."""

    def run(batches):
        for batch in batches:
            for part, blobs in ((batch.slice(k, 1), batch.column(1)[k]) for k in range(batch.num_rows)):
                found = parse(memoryview(blobs.as_buffer()).cast("B")) if blobs.is_valid else {"packets": [], "error": None}
                rows = found["packets"]
                if rows or found["error"]:
                    n = max(1, len(rows))
                    cols = [*zip(*rows)] or [[None]] * 8
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([0] * n)), *(pa.array(list(x), t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()))), pa.array([found["error"]] * n, pa.string())], ["key", "track", "timestamp_ns", "start", "length", "cluster", "block", "lacing", "keyframe", "error"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, column).mapInArrow(run, f"key {kind}, track long, timestamp_ns long, start long, length long, cluster long, block long, lacing int, keyframe boolean, error string").withColumnRenamed("key", key)


def cue_table(files: DataFrame, key: str, column: str) -> DataFrame:
    """One row per cue: time, track and the place of its cluster in the file."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(1)[k].is_valid and (rows := parse(memoryview(batch.column(1)[k].as_buffer()).cast("B"))["cues"]):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(rows))), *(pa.array(list(x), pa.int64()) for x in zip(*rows))], ["key", "timestamp_ns", "track", "cluster_start"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, column).mapInArrow(run, f"key {kind}, timestamp_ns long, track long, cluster_start long").withColumnRenamed("key", key)


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + b"\0" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def store(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as a Matroska file: key, n_bytes, media."""

    def run(batches):
        for batch in batches:
            for part, column in _shared.slices(batch, text, 16 << 20):
                raws = [x.encode() for x in column.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raws], pa.int64()), pa.array([mux(padded(x)) for x in raws], pa.binary())], ["key", "n_bytes", "media"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def digest(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads stored files back: digests of payload and file, and features of packets and samples."""

    def run(batches):
        for batch in batches:
            rows = []
            for media in batch.column(2):
                data = memoryview(media.as_buffer()).cast("B")
                found = parse(data)
                if found["error"]:
                    raise Damaged(found["error"])
                payload = b"".join([data[s : s + n] for _, _, s, n, *_ in found["packets"]])
                samples = np.frombuffer(payload, np.uint8)
                last = found["packets"][-1]
                feature = f"codec={found['tracks'][1]['codec']};packets={len(found['packets'])};blocks={last[5] + 1};clusters={found['clusters']};cues={len(found['cues'])};last_ms={last[1] // 1_000_000};sum={int(samples.sum(dtype=np.int64))};peak={int(samples.max())};turns={int(np.count_nonzero(np.diff(samples > 96)))}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = [*zip(*rows)] or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(x), t) for x, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())))], ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = files.schema[key].dataType.simpleString()
    return files.mapInArrow(run, f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("key", key)


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store(_shared.table(spark, sf_dir, "documents")))
