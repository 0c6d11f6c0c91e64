"""Matroska files in pure Python: a small muxer for raw samples and a demuxer to packet tables.

The demuxer walks the EBML tree by element identifiers, follows unknown-size
segments and clusters, undoes Xiph, EBML and fixed lacing, and reports one row
per frame (track, timestamp, byte range) beside tracks and cues. Nothing is
guessed from the muxer: any file of these elements can be read.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

# Element identifiers of the EBML and Matroska specifications (fixed values).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
TOP_LEVEL = (INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469)


class MatroskaError(ValueError):
    """The bytes are not a file this reader can follow."""


def vint(value: int, width: int = 0) -> bytes:
    """An element size, as short as it goes unless a width is given."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def floating(ident: int, value: float) -> bytes:
    return element(ident, struct.pack(">d", value))


def laced(frames: list, how: int) -> bytes:
    """The lacing header that stands between a block's head and its frames."""
    if how == NO_LACING:
        return b""
    sizes = [len(f) for f in frames]
    head = bytearray([len(frames) - 1])
    if how == XIPH:
        for s in sizes[:-1]:
            head += b"\xff" * (s // 255) + bytes([s % 255])
    elif how == EBML_LACING:
        head += vint(sizes[0])
        for before, s in zip(sizes, sizes[1:-1], strict=False):
            diff = s - before
            width = next(w for w in range(1, 9) if abs(diff) < (1 << 7 * w - 1) - 1)
            head += vint(diff + (1 << 7 * width - 1) - 1, width)
    elif len(set(sizes)) > 1:
        raise MatroskaError("frames of different size cannot take fixed lacing")
    return bytes(head)


HEADER = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))


def mux(samples: bytes, rate: int = 8000, frame: int = 512, frames_in_block: int = 8, blocks_in_cluster: int = 4) -> bytes:
    """One 8-bit mono PCM track holding ``samples`` unchanged, with a cue for each cluster.

    Full blocks of equal frames take fixed lacing, other blocks of several
    frames EBML lacing, single frames none.
    """
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"lumetra") + element(WRITING_APP, b"lumetra") + floating(DURATION, len(samples) * 1000 / rate))
    audio = element(AUDIO, floating(SAMPLING_FREQUENCY, float(rate)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    entry = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, frame * 1_000_000_000 // rate) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    body = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues, view = sum(map(len, body)), [], memoryview(samples)
    block = frame * frames_in_block
    for begin in range(0, len(samples), block * blocks_in_cluster):
        time = begin * 1000 // rate
        parts = [uint(TIMESTAMP, time)]
        for start in range(begin, min(begin + block * blocks_in_cluster, len(samples)), block):
            chunk = view[start : start + block]
            frames = [chunk[i : i + frame] for i in range(0, len(chunk), frame)]
            how = NO_LACING if len(frames) == 1 else FIXED if len(frames[-1]) == frame else EBML_LACING
            head = b"\x81" + struct.pack(">hB", start * 1000 // rate - time, 0x80 | how << 1)
            parts.append(element(SIMPLE_BLOCK, b"".join([head, laced(frames, how), chunk])))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        cluster = element(CLUSTER, b"".join(parts))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return HEADER + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float = 0.0
    doc_type: str = ""
    tracks: list = field(default_factory=list)
    packets: list = field(default_factory=list)  # (track, timestamp_ns, offset, size, keyframe, lacing, cluster)
    cues: list = field(default_factory=list)  # (time_ns, track, absolute offset of the cluster)
    clusters: list = field(default_factory=list)  # (absolute offset, timestamp_ns)


def read_vint(data, at: int, end: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """Value, position after it, and its width; an identifier keeps its marker bit."""
    if at >= end or not data[at]:
        raise MatroskaError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise MatroskaError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    return (value if keep_marker else value & (1 << 7 * width) - 1), at + width, width


def children(data, at: int, end: int, parent: int):
    """(identifier, start of the element, start and end of its body) of each child.

    A segment or cluster of unknown size ends where an element begins that
    cannot be inside it, or with its parent.
    """
    while at < end:
        start = at
        ident, at, _ = read_vint(data, at, end, True)
        size, at, width = read_vint(data, at, end)
        if size == (1 << 7 * width) - 1:
            if ident not in (SEGMENT, CLUSTER):
                raise MatroskaError(f"element {ident:#x} may not have an unknown size")
            to = end
            if ident == CLUSTER:
                probe = at
                while probe < end:
                    inner, body, _ = read_vint(data, probe, end, True)
                    if inner in TOP_LEVEL:
                        to = probe
                        break
                    inner_size, body, _ = read_vint(data, body, end)
                    probe = body + inner_size
        else:
            to = at + size
        if to > end:
            raise MatroskaError(f"element {ident:#x} in {parent:#x} runs past its parent")
        yield ident, start, at, to
        at = to


def number(data, at: int, to: int) -> int:
    """An unsigned integer; the format has up to eight bytes, and what a long cannot hold is refused."""
    value = int.from_bytes(data[at:to], "big")
    if to - at > 8 or value >= 1 << 63:
        raise MatroskaError(f"no integer of a long at {at}")
    return value


def real(data, at: int, to: int) -> float:
    if to - at not in (0, 4, 8):
        raise MatroskaError(f"a real number of {to - at} bytes at {at}")
    return struct.unpack({0: ">", 4: ">f", 8: ">d"}[to - at], bytes(data[at:to]))[0] if to > at else 0.0


def name(data, at: int, to: int) -> str:
    text = bytes(data[at:to]).rstrip(b"\0")
    if not text.isascii():
        raise MatroskaError(f"a name that is not ASCII at {at}")
    return text.decode("ascii")


def frames_of(data, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and the (offset, size) of each frame of a block."""
    track, at, _ = read_vint(data, at, end)
    if at + 3 > end:
        raise MatroskaError("block without a head")
    relative, flags = struct.unpack(">hB", bytes(data[at : at + 3]))
    at += 3
    how = flags >> 1 & 3
    if how == NO_LACING:
        return track, relative, flags, [(at, end - at)]
    if at >= end:
        raise MatroskaError("laced block without a count")
    count, at = data[at] + 1, at + 1
    if how == FIXED:
        if (end - at) % count:
            raise MatroskaError("fixed lacing does not divide the block")
        sizes = [(end - at) // count] * count
    else:
        sizes = []
        for i in range(count - 1):
            if how == XIPH:
                size = 0
                while at < end and data[at] == 255:
                    size, at = size + 255, at + 1
                if at >= end:
                    raise MatroskaError("lacing runs past its block")
                size, at = size + data[at], at + 1
            else:
                value, at, width = read_vint(data, at, end)
                size = value if not i else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError("lacing runs past its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, relative, flags, out


def demux(data: bytes) -> Media:
    """Packet table, tracks, clusters and cues of a Matroska file."""
    media, durations = Media(), {}
    tops = list(children(data, 0, len(data), 0))
    if not tops or tops[0][0] != EBML:
        raise MatroskaError("no EBML header")
    for ident, _, at, to in children(data, tops[0][2], tops[0][3], EBML):
        if ident == DOC_TYPE:
            media.doc_type = name(data, at, to)
    for top, _, begin, end in tops[1:]:
        if top != SEGMENT:
            continue
        for ident, start, at, to in children(data, begin, end, SEGMENT):
            if ident == INFO:
                for i, _, a, z in children(data, at, to, INFO):
                    if i == TIMESTAMP_SCALE:
                        media.scale = number(data, a, z)
                    elif i == DURATION:
                        media.duration = real(data, a, z)
            elif ident == TRACKS:
                for i, _, a, z in children(data, at, to, TRACKS):
                    if i == TRACK_ENTRY:
                        media.tracks.append(track := {"number": 0, "type": 0, "codec": "", "rate": 8000.0, "channels": 1, "bits": 0})
                        for j, _, b, y in children(data, a, z, TRACK_ENTRY):
                            if j == TRACK_NUMBER:
                                track["number"] = number(data, b, y)
                            elif j == TRACK_TYPE:
                                track["type"] = number(data, b, y)
                            elif j == CODEC_ID:
                                track["codec"] = name(data, b, y)
                            elif j == DEFAULT_DURATION:
                                durations[track["number"]] = number(data, b, y)
                            elif j == AUDIO:
                                for k, _, c, x in children(data, b, y, AUDIO):
                                    if k == SAMPLING_FREQUENCY:
                                        track["rate"] = real(data, c, x)
                                    elif k == CHANNELS:
                                        track["channels"] = number(data, c, x)
                                    elif k == BIT_DEPTH:
                                        track["bits"] = number(data, c, x)
            elif ident == CLUSTER:
                time = 0
                nth = len(media.clusters)
                for i, _, a, z in children(data, at, to, CLUSTER):
                    if i == TIMESTAMP:
                        time = number(data, a, z)
                    elif i == SIMPLE_BLOCK:
                        add_block(media, data, a, z, time, nth, durations, None)
                    elif i == BLOCK_GROUP:
                        inner = {j: (b, y) for j, _, b, y in children(data, a, z, BLOCK_GROUP)}
                        if BLOCK in inner:
                            add_block(media, data, *inner[BLOCK], time, nth, durations, 0xFB not in inner)  # 0xFB: ReferenceBlock
                media.clusters.append((start, time * media.scale))
            elif ident == CUES:
                for i, _, a, z in children(data, at, to, CUES):
                    when, places = 0, []
                    for j, _, b, y in children(data, a, z, CUE_POINT):
                        if j == CUE_TIME:
                            when = number(data, b, y)
                        elif j == CUE_TRACK_POSITIONS:
                            got = {k: number(data, c, x) for k, _, c, x in children(data, b, y, j)}
                            places.append((got.get(CUE_TRACK, 0), begin + got.get(CUE_CLUSTER_POSITION, 0)))
                    media.cues += [(when * media.scale, track, place) for track, place in places]
    return media


def add_block(media: Media, data, at: int, to: int, cluster_time: int, cluster: int, durations: dict, keyframe) -> None:
    track, relative, flags, frames = frames_of(data, at, to)
    time = (cluster_time + relative) * media.scale
    each = durations.get(track, 0)
    if track >= 1 << 31 or max(abs(time), abs(time + (len(frames) - 1) * each)) >= 1 << 63:
        raise MatroskaError("a track or timestamp that is out of range")
    key = bool(flags & 0x80) if keyframe is None else keyframe
    media.packets += [(track, time + i * each, offset, size, key, flags >> 1 & 3, cluster) for i, (offset, size) in enumerate(frames)]
