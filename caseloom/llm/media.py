"""Matroska media columns: bytes to 8-bit PCM in Matroska, and Matroska to packet tables.

The writer stores a payload as unsigned 8-bit samples of one PCM track: frames of `frame` bytes laced into SimpleBlocks,
blocks in clusters, a cue for each cluster. The reader walks the variable-length EBML elements (unknown sizes included),
undoes Xiph, EBML and fixed-size lacing, and lists packets with track, timestamp and byte range, tracks and cues.

Null content has a defined result: the writer takes it as empty and pads it to one frame; the reader gives no packets.
Repeated rows each give their rows. Only the id and content columns are read. Malformed files raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_text, small_batches

FRAME, LACED, PACKETS, RATE = 192, 8, 1024, 8000
# Element identifiers of the Matroska specification (fixed values).
EBML, SEGMENT, INFO, TRACKS, ENTRY, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, GROUP, BLOCK, SIMPLE, CUES, CUE, CUE_TRACK = 0x1F43B675, 0xA0, 0xA1, 0xA3, 0x1C53BB6B, 0xBB, 0xB7
DOC_TYPE, SCALE, MUXER, WRITER, NUMBER, UID, KIND, CODEC, RATE_ID, CHANNELS, DEPTH = 0x4282, 0x2AD7B1, 0x4D80, 0x5741, 0xD7, 0x73C5, 0x83, 0x86, 0xB5, 0x9F, 0x6264
TIME, CUE_TIME, CUE_NUMBER, CUE_AT = 0xE7, 0xB3, 0xF7, 0xF1
PARENTS = frozenset({SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_TRACK})
TOP = frozenset({INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469})


class Packet(NamedTuple):
    track: int
    cluster: int
    ts_ms: float
    offset: int
    size: int
    keyframe: bool


class Media(NamedTuple):
    doc_type: str
    tracks: list[dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]


def number(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def size_of(n: int, width: int = 0) -> bytes:
    """A variable-length size; all ones are kept for "unknown"."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, data: bytes) -> bytes:
    return number(name) + size_of(len(data)) + data


def laced(frames: list[bytes], how: str) -> tuple[int, bytes]:
    """Flags and lace header of a block's frames; how: fixed, xiph or ebml."""
    if len(frames) == 1:
        return 0, b""
    sizes = [len(f) for f in frames]
    if how == "fixed":
        return 0x04, bytes([len(frames) - 1])
    if how == "xiph":
        return 0x02, bytes([len(frames) - 1]) + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    out = bytes([len(frames) - 1]) + size_of(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        out += size_of(b - a + (1 << 7 * width - 1) - 1, width)
    return 0x06, out


def write(payload: bytes, frame: int = FRAME, lace: int = LACED, packets: int = PACKETS, rate: int = RATE, how: str = "fixed") -> bytes:
    """A Matroska file of one unsigned 8-bit PCM track that holds the payload."""
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    info = element(INFO, element(SCALE, number(1_000_000)) + element(MUXER, b"caseloom") + element(WRITER, b"caseloom"))
    audio = element(AUDIO, element(RATE_ID, struct.pack(">f", rate)) + element(CHANNELS, b"\x01") + element(DEPTH, b"\x08"))
    tracks = element(TRACKS, element(ENTRY, element(NUMBER, b"\x01") + element(UID, b"\x01") + element(KIND, b"\x02") + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues, ms = [info, tracks], [], frame * 1000 // rate
    at = len(info) + len(tracks)
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    for c in range(0, len(frames), packets):
        blocks = [element(TIME, number(c * ms))]
        for k in range(c, min(c + packets, len(frames)), lace):
            part = frames[k : min(k + lace, c + packets)]
            flags, header = laced(part, how)
            blocks.append(element(SIMPLE, b"\x81" + struct.pack(">hB", (k - c) * ms, 0x80 | flags) + header + b"".join(part)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE, element(CUE_TIME, number(c * ms)) + element(CUE_TRACK, element(CUE_NUMBER, b"\x01") + element(CUE_AT, number(at)))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """A variable-length integer and where it ends; -1 if unknown. keep: with its marker, as identifiers are."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if not keep:
        n ^= 1 << 7 * width
        n = -1 if n == (1 << 7 * width) - 1 else n
    return n, at + width


def lace_sizes(data: bytes, at: int, end: int, flags: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first begins."""
    how = flags >> 1 & 3
    if not how:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    if how == 2:
        if (end - at) % count:
            raise ValueError("fixed-size lacing of unequal frames")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for k in range(count - 1):
        if how == 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        else:
            began = at
            n, at = vint(data, at)
            if k:
                n += sizes[-1] - ((1 << 7 * (at - began) - 1) - 1)
        sizes.append(n)
    rest = end - at - sum(sizes)
    if rest < 0 or min(sizes, default=0) < 0:
        raise ValueError("frames reach beyond their block")
    return [*sizes, rest], at


def read(data: bytes) -> Media:
    """The packet table, tracks and cues of a Matroska file; ValueError if it is malformed."""
    try:
        return parsed(data)
    except (struct.error, IndexError, UnicodeDecodeError) as e:
        raise ValueError(f"malformed file: {e}") from e


def parsed(data: bytes) -> Media:
    name, at = vint(data, 0, keep=True)
    if name != EBML:
        raise ValueError("not an EBML file")
    length, at = vint(data, at)
    doc_type, tracks, packets, cues = "", [], [], []
    scale, time, cluster = 1_000_000, 0, -1
    stack: list[tuple[int, int]] = [(EBML, at + length)]
    while at < len(data):
        while stack and at >= stack[-1][1]:
            stack.pop()
        name, at = vint(data, at, keep=True)
        n, at = vint(data, at)
        if n < 0 and name not in (SEGMENT, CLUSTER):
            raise ValueError("unknown size where it is not allowed")
        while name in TOP and stack and stack[-1][0] == CLUSTER:
            stack.pop()  # a cluster of unknown size ends where the next top element begins
        end = len(data) if n < 0 else at + n
        if end > len(data):
            raise ValueError(f"element {name:x} reaches beyond the file")
        if name in PARENTS:
            stack.append((name, end))
            if name == ENTRY:
                tracks.append({"number": 0, "kind": 0, "codec": "", "rate": 8000.0, "channels": 1, "depth": 0})
            elif name == CLUSTER:
                cluster += 1
            elif name == CUE:
                cues.append((0, 0, 0))
            continue
        if name in (SIMPLE, BLOCK):
            track, p = vint(data, at)
            if p + 3 > end:
                raise ValueError("a block without room for its header")
            rel, flags = struct.unpack_from(">hB", data, p)
            sizes, p = lace_sizes(data, p + 3, end, flags)
            if p + sum(sizes) > end:
                raise ValueError("frames reach beyond their block")
            one = next((t for t in tracks if t["number"] == track), None)
            step = 1000 / (one["rate"] * one["channels"] * max(1, one["depth"] // 8)) if one and one["depth"] else 0.0
            ms, key = (time + rel) * scale / 1e6, name == BLOCK or flags >= 128
            for s in sizes:
                packets.append(Packet(track, cluster, ms, p, s, key))
                p, ms = p + s, ms + s * step
        elif name == TIME:
            time = int.from_bytes(data[at:end], "big")
        elif name == SCALE:
            scale = int.from_bytes(data[at:end], "big")
        elif name == DOC_TYPE:
            doc_type = data[at:end].decode()
        elif tracks and name in (NUMBER, KIND, CHANNELS, DEPTH):
            tracks[-1][{NUMBER: "number", KIND: "kind", CHANNELS: "channels", DEPTH: "depth"}[name]] = int.from_bytes(data[at:end], "big")
        elif tracks and name == CODEC:
            tracks[-1]["codec"] = data[at:end].decode()
        elif tracks and name == RATE_ID:
            tracks[-1]["rate"] = struct.unpack(">f" if n == 4 else ">d", data[at:end])[0]
        elif cues and name in (CUE_TIME, CUE_NUMBER, CUE_AT):
            k = (CUE_TIME, CUE_NUMBER, CUE_AT).index(name)
            cues[-1] = (*cues[-1][:k], int.from_bytes(data[at:end], "big"), *cues[-1][k + 1 :])
        at = end
    return Media(doc_type, tracks, packets, cues)


def padded(data: bytes, frame: int = FRAME) -> bytes:
    return data + b" " * (max(1, -(-len(data) // frame)) * frame - len(data))


def feature(media: Media, samples: np.ndarray) -> str:
    """Packets, milliseconds, mean, RMS, peak and zero crossings of unsigned 8-bit samples, in whole thousandths."""
    x = samples.astype(np.int16) - 128
    last = media.packets[-1]
    ms = round(last.ts_ms + 1000 * last.size / media.tracks[0]["rate"])
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    squares = int(np.dot(x.astype(np.int64), x.astype(np.int64)))
    return f"packets={len(media.packets)};cues={len(media.cues)};ms={ms};mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};power={squares * 1000 // len(x)};peak={int(np.abs(x).max())};crossings={crossings}"


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME) -> DataFrame:
    """doc_id, media: each text's UTF-8 bytes, padded to whole frames, as a Matroska file."""
    small_batches(df.sparkSession)
    base = id_text(df, id_col, text_col)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [write(padded(t.encode(), frame), frame) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) for t in b.column("text").to_pylist()], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_bytes", "media"])

    return base.mapInArrow(files, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each packet: doc_id, packet, track, cluster, ts_ms, offset, size, keyframe; for a malformed file one row with its error alone."""
    base = df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    names = ["doc_id", "packet", *Packet._fields, "error"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.schema.field("doc_id").type
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True):
                if not data:
                    continue
                try:
                    found = read(data).packets
                except ValueError as e:
                    yield pa.RecordBatch.from_arrays([pa.array([doc], kind), *(pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())), pa.array([str(e)])], names)
                    continue
                if found:
                    cols = [*zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), kind), pa.array(range(len(found)), pa.int32()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5]), pa.nulls(len(found), pa.string())], names)

    return base.mapInArrow(rows, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, packet int, track int, cluster int, ts_ms double, offset bigint, size bigint, keyframe boolean, error string")


def digests(files: DataFrame) -> DataFrame:
    """What stored() returns -> digests and features of the payload read back through the packet table."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column("media").to_pylist():
                media = read(data)
                payload = b"".join([data[p.offset : p.offset + p.size] for p in media.packets])
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, np.frombuffer(payload, np.uint8))))
            cols = [*zip(*out, strict=True)] or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return files.mapInArrow(read_back, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
