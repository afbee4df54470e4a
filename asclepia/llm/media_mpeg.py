"""MPEG audio as a media column: bytes kept losslessly in Layer III frames, and a parser that measures any such stream.

Stored form: an ID3v2.3 tag, a Xing frame with frame count, byte count and a seek table, then MPEG-1 Layer III frames at 32 kHz, each with
a CRC-16. The frames' side information is empty, so that decoders play silence; the payload is in the main data. All
frames but the last have the highest bit rate; the last the lowest that fits, so the stream is of variable bit rate.

The parser walks any stream of MPEG-1, 2 or 2.5 audio of Layer I, II or III, also of free-format bit rates: it reads ID3v1, ID3v2 and APE tags, resynchronises
behind damage at the next header that is followed by another header or the end, reads the variable-bit-rate table (Xing, Info or VBRI),
verifies checksums, and gives the exact duration (each frame's samples over its rate) and the offset of each frame. It never fails.

Not decoded: the sound itself. Encrypted and compressed ID3v2 frames are skipped. A free-format stream needs two frames to be measured.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asclepia.llm._base import map_rows, written

# Fixed values of the format: kbit/s by index, for MPEG-1 and for MPEG-2 and 2.5, Layers I, II and III; sampling rates by index.
KBITS_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBITS_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
KBITS = {
    (3, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (3, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (3, 3): KBITS_1,
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): KBITS_2,
    (2, 3): KBITS_2,
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Bits of the allocation of Layer II's subbands, as (bits, subbands) in order, for the five tables of the standard.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "lower": ((4, 4), (3, 7), (2, 19)),
}
#: Every sampling rate divides this many ticks a second.
TICKS = 14_112_000
#: The longest frame that a free-format stream is searched for.
MAX_FREE = 8 << 10

SIDE = 32
HEAD = 4 + 2 + SIDE
UNIT = 64


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF, over the last two header bytes and the side information."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def crc16_bits(bits: str) -> int:
    """The same over single bits."""
    crc = 0xFFFF
    for bit in bits:
        top = crc >> 15 ^ (bit == "1")
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    kbits: int  # 0: free format
    rate: int
    padding: int
    mode: int
    bound: int
    protected: bool

    @property
    def mono(self) -> bool:
        return self.mode == 3

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version != 3 else 1152

    @property
    def slot(self) -> int:
        return 4 if self.layer == 1 else 1

    @property
    def length(self) -> int:
        """Bytes, 0 for free format."""
        return (self.samples // 8 // self.slot * self.kbits * 1000 // self.rate + self.padding) * self.slot if self.kbits else 0

    @property
    def side(self) -> int:
        """Bytes of Layer III's side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    @property
    def kind(self) -> str:
        return f"mpeg{ {3: '1', 2: '2', 0: '2.5'}[self.version] }-layer{self.layer}"


@lru_cache(4096)
def header(raw: bytes) -> Header | None:
    """The header in four bytes, or None if they are none."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer, index, rate = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or index == 15 or rate == 3 or raw[3] & 3 == 2:
        return None
    mode = raw[3] >> 6
    bound = ((raw[3] >> 4 & 3) + 1) * 4 if mode == 1 else 32
    return Header(version, layer, KBITS[3 if version == 3 else 2, layer][index], RATES[version][rate], raw[2] >> 1 & 1, mode, bound, not raw[1] & 1)


def _checked_bits(h: Header, data: bytes) -> int | None:
    """How many bits behind the checksum of a Layer I or II frame it covers; None if the frame is too short for them."""
    channels = 1 if h.mono else 2
    if h.layer == 1:
        bound = 32 if h.mono else min(h.bound, 32)
        return 4 * (channels * bound + (32 - bound))
    kbits = h.kbits // channels
    if h.version != 3:
        table = "lower"
    elif kbits >= 56 and (h.rate == 48000 or kbits <= 80):
        table = "a"
    elif h.rate != 48000 and (kbits >= 96 or not h.kbits):
        table = "b"
    else:
        table = "a" if not h.kbits else "d" if h.rate == 32000 else "c"
    bits = "".join(f"{b:08b}" for b in data[:64])
    at = chosen = band = 0
    for size, bands in ALLOCATION[table]:
        for _ in range(bands):
            for _ in range(channels if band < h.bound else 1):
                if at + size > len(bits):
                    return None
                used = "1" in bits[at : at + size]
                chosen += used * (channels if band >= h.bound else 1)
                at += size
            band += 1
    return at + 2 * chosen


def sound_checksum(h: Header, frame: bytes) -> bool:
    """Whether a protected frame's checksum is that of what it covers."""
    said = struct.unpack(">H", frame[4:6])[0]
    if h.layer == 3:
        return len(frame) >= 6 + h.side and said == crc16(frame[2:4] + frame[6 : 6 + h.side])
    n = _checked_bits(h, frame[6:])
    if n is None or n > 8 * (len(frame) - 6):
        return False
    return said == crc16_bits("".join(f"{b:08b}" for b in frame[2:4] + frame[6 : 6 + (n + 7) // 8])[: 16 + n])


def _frame_head(kbits: int) -> bytes:
    raw = bytes([0xFF, 0xFA, KBITS_1.index(kbits) << 4 | 2 << 2, 0x00])  # MPEG-1 Layer III with CRC, 32 kHz, stereo
    return raw + struct.pack(">H", crc16(raw[2:4] + bytes(SIDE))) + bytes(SIDE)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _text_frame(name: bytes, text: str) -> bytes:
    body = b"\0" + text.encode("latin-1", "replace")
    return name + struct.pack(">IH", len(body), 0) + body


def encode(payload: bytes, n_bytes: int | None = None) -> bytes:
    """The payload as an MPEG audio stream; ``n_bytes`` (default: all) is kept in the tag as what of it counts."""
    most, size = KBITS_1[-1], KBITS_1[-1] * 9 // 2
    room = size - HEAD
    whole = len(payload) // room
    rest = payload[whole * room :]
    frames = np.zeros((whole, size), np.uint8)
    frames[:, :HEAD] = np.frombuffer(_frame_head(most), np.uint8)
    frames[:, HEAD:] = np.frombuffer(payload, np.uint8, whole * room).reshape(whole, room)
    body = frames.tobytes()
    if rest:
        kbits = next(k for k in KBITS_1[1:] if k * 9 // 2 - HEAD >= len(rest))
        body += _frame_head(kbits) + rest + bytes(kbits * 9 // 2 - HEAD - len(rest))
    n_frames = whole + bool(rest)
    first = next(k for k in KBITS_1[1:] if k * 9 // 2 >= HEAD + 120) * 9 // 2
    total = first + len(body)
    toc = bytes(min(255, 256 * (first + min(i * n_frames // 100, whole) * size) // total) for i in range(100))
    xing = _frame_head(first * 2 // 9) + b"Xing" + struct.pack(">III", 15, n_frames, total) + toc + struct.pack(">I", 100)
    duration = Fraction(1152 * n_frames * 1000, 32000)
    tags = _text_frame(b"TLEN", str(int(duration))) + _text_frame(b"TXXX", f"payload\0{len(payload)}") + _text_frame(b"TXXX", f"counted\0{len(payload) if n_bytes is None else n_bytes}")
    return b"ID3\3\0\0" + _synchsafe(len(tags)) + tags + xing + bytes(first - len(xing)) + body


@dataclass
class Stream:
    """What a stream says and what its frames show."""

    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict | None = None
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # in ticks, when each frame ends
    kinds: set[str] = field(default_factory=set)
    samples: int = 0
    checked: int = 0
    damaged: list[int] = field(default_factory=list)
    skipped: int = 0

    @property
    def duration(self) -> Fraction:
        return Fraction(self.ends[-1], TICKS) if self.ends else Fraction(0)

    def seek(self, seconds: Fraction | float) -> int:
        """The offset of the frame that plays at ``seconds``, the first or last one for times outside; -1 without frames."""
        if not self.offsets:
            return -1
        return self.offsets[min(bisect_right(self.ends, Fraction(seconds) * TICKS), len(self.offsets) - 1)]

    def hint(self, seconds: Fraction | float) -> int | None:
        """Where the variable-bit-rate table says that ``seconds`` is: near ``seek``, for readers that don't walk the stream. None without a table."""
        if not self.vbr or not self.vbr.get("toc") or not self.duration:
            return None
        part = min(max(Fraction(seconds) / self.duration, 0), 1)
        toc, at = self.vbr["toc"], self.vbr["at"]
        if self.vbr["kind"] == "VBRI":
            return at + sum(toc[: int(part * len(toc))])
        return at + toc[min(int(part * 100), 99)] * self.vbr.get("bytes", 0) // 256

    @property
    def sound_table(self) -> bool:
        """Whether the table's frames and bytes are those of the stream."""
        return bool(self.vbr) and self.vbr.get("frames") == len(self.offsets) and self.vbr.get("bytes") == self.vbr["length"] + sum(self.lengths)


def _size(raw: bytes) -> int:
    return sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=False))


def _text(body: bytes) -> str:
    return body[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads an ID3v2 tag (2.2, 2.3 or 2.4) that may be at ``at``; gives where it ends."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or data[at + 3] not in (2, 3, 4):
        return at
    version, flags, size = data[at + 3], data[at + 5], _size(data[at + 6 : at + 10])
    end = at + 10 + size + (10 if version == 4 and flags & 0x10 else 0)
    body = data[at + 10 : at + 10 + size]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    p = 0
    if flags & 0x40 and version > 2 and len(body) >= 4:
        p = _size(body[:4]) if version == 4 else 4 + struct.unpack(">I", body[:4])[0]
    name_size, head = (3, 6) if version == 2 else (4, 10)
    while p + head <= len(body) and body[p]:
        name = body[p : p + name_size].decode("latin-1")
        raw = body[p + name_size : p + 2 * name_size]
        n = int.from_bytes(raw, "big") if version < 4 else _size(raw)
        text, more = body[p + head : p + head + n], body[p + 9] if version > 2 else 0
        p += head + n
        if version == 3 and more & 0xC0 or version == 4 and more & 0x0C:
            continue
        if version == 4 and more & 0x01:
            text = text[4:]
        if version == 4 and (more & 0x02 or flags & 0x80):
            text = text.replace(b"\xff\0", b"\xff")
        if name[0] == "T" and text:
            value = _text(text)
            key, _, value = value.partition("\0") if name in ("TXXX", "TXX") else (name, "", value)
            tags[key] = value.rstrip("\0")
    return end


def _ape(data: bytes, end: int, tags: dict[str, str]) -> int:
    """Reads an APE tag that may end at ``end``; gives where it begins."""
    foot = data[max(0, end - 32) : end]
    if foot[:8] != b"APETAGEX" or len(foot) < 32:
        return end
    _, size, count, flags = struct.unpack("<4I", foot[8:24])
    begin = end - size
    if size < 32 or begin < 0:
        return end
    p = begin
    for _ in range(count):
        name_end = data.find(b"\0", p + 8, end - 32)
        if p + 8 > end - 32 or name_end < 0:
            break
        n, kind = struct.unpack("<2I", data[p : p + 8])
        if not kind >> 1 & 3:
            tags.setdefault(data[p + 8 : name_end].decode("latin-1"), data[name_end + 1 : min(name_end + 1 + n, end - 32)].decode("utf-8", "replace"))
        p = name_end + 1 + n
    return begin - 32 if flags >> 31 and data[max(0, begin - 32) : begin][:8] == b"APETAGEX" else begin


def _vbr(h: Header, frame: bytes) -> dict | None:
    """The variable-bit-rate table that a frame has instead of sound, as far as the frame holds it."""
    mark = 4 + 2 * h.protected + h.side
    if frame[mark : mark + 4] in (b"Xing", b"Info") and len(frame) >= mark + 8:
        flags, p, out = struct.unpack(">I", frame[mark + 4 : mark + 8])[0], mark + 8, {"kind": frame[mark : mark + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit and p + 4 <= len(frame):
                out[name], p = struct.unpack(">I", frame[p : p + 4])[0], p + 4
        if flags & 4 and p + 100 <= len(frame):
            out["toc"], p = list(frame[p : p + 100]), p + 100
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, each = struct.unpack(">IIHHHH", frame[46:62])
        table = frame[62 : 62 + entries * width]
        toc = [int.from_bytes(table[i : i + width], "big") * scale for i in range(0, len(table) - width + 1, width)] if 0 < width <= 4 else []
        return {"kind": "VBRI", "bytes": size, "frames": frames, "toc": toc, "each": each}
    return None


def _free_length(data: bytes, at: int, end: int, h: Header) -> int:
    """The bytes of a free-format frame without padding: up to the next header of its kind that has another one as far behind it, or the end."""
    same = lambda x: x is not None and not x.kbits and (x.version, x.layer, x.rate) == (h.version, h.layer, h.rate)
    p = at + 4
    while 0 <= (p := data.find(b"\xff", p, min(end, at + MAX_FREE))):
        if same(x := header(data[p : p + 4])):
            length = p - at - h.padding * h.slot
            after = p + length + x.padding * x.slot
            if after == end or same(header(data[after : after + 4])):
                return length
        p += 1
    return 0


def _last_tags(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """Where the sound ends and the tags after it (APE, ID3v1) begin, and what these say."""
    end, tags = len(data), {}
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if value := data[end + a : end + b].partition(b"\0")[0].rstrip(b" ").decode("latin-1"):
                tags[name] = value
    return max(at, _ape(data, end, tags)), tags


def parse(data: bytes) -> Stream:
    """Measures a stream; never fails: what is no frame is counted in ``skipped``."""
    stream = Stream()
    at = 0
    while (after := _id3v2(data, at, stream.tags)) > at:
        at = after
    whole = len(data)
    end, last_tags = _last_tags(data, at)
    synced, ticks, free = True, 0, {}

    def measured(p: int, known_only: bool = False) -> tuple[Header | None, int]:
        h = header(data[p : p + 4]) if p + 4 <= end else None
        if h is None or h.kbits:
            return h, h.length if h else 0
        key = (h.version, h.layer, h.rate)
        if key not in free and not known_only and (length := _free_length(data, p, end, h)):
            free[key] = length
        return h, free[key] + h.padding * h.slot if key in free else 0

    while at + 4 <= end:
        h, length = measured(at)
        if h and synced and end < at + length <= whole and (at + length == whole or header(data[at + length : at + length + 4])):
            end, last_tags = whole, {}  # what looks like a tag is inside a frame
        if h and 4 < length <= end - at and (synced or at + length == end or measured(at + length, True)[0]):
            frame = data[at : at + length]
            if h.protected:
                stream.checked += 1
                if length < 6 or not sound_checksum(h, frame):
                    stream.damaged.append(at)
            table = _vbr(h, frame) if h.layer == 3 and stream.vbr is None and not stream.offsets else None
            if table is not None:
                stream.vbr = table | {"at": at, "length": length}
            else:
                stream.offsets.append(at)
                stream.lengths.append(length)
                stream.kinds.add(h.kind)
                stream.samples += h.samples
                ticks += h.samples * (TICKS // h.rate)
                stream.ends.append(ticks)
            at += length
            synced = True
            continue
        synced = False
        found = data.find(b"\xff", at + 1, end)
        stream.skipped += (end if found < 0 else found) - at
        at = end if found < 0 else found
    stream.skipped += max(0, end - at)
    stream.tags = last_tags | stream.tags
    return stream


def payload_of(data: bytes, stream: Stream | None = None) -> bytes:
    """The payload that ``encode`` stored."""
    stream = stream or parse(data)
    out = b"".join(data[o + HEAD : o + n] for o, n in zip(stream.offsets, stream.lengths, strict=True))
    size = stream.tags.get("payload", "")
    return out[: int(size)] if size.isascii() and size.isdigit() else out


def feature(stream: Stream) -> str:
    d, n = stream.duration, len(stream.offsets)
    seek = zlib.crc32(np.array(stream.offsets, "<u8").tobytes())
    return f"{'+'.join(sorted(stream.kinds)) or 'none'} frames={n} duration={d.numerator}/{d.denominator} crc={stream.checked - len(stream.damaged)}/{stream.checked} vbr={'sound' if stream.sound_table else 'off'} skipped={stream.skipped} seek={seek:08x}"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media, the text's UTF-8 bytes padded with 0 to a positive multiple of 64 as an MPEG audio stream.

    Null text counts as empty; an empty table gives no rows; repeated rows and null ids stay; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(ids: list, texts: list) -> dict:
        media = []
        for text in texts:
            raw = (text or "").encode()
            media.append(encode(raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)))
        return {"doc_id": ids, "media": media}

    return map_rows(rows, run, "doc_id long, media binary")


def media_features(media: DataFrame, with_frames: bool = False, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Of each stored stream: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and
    with ``with_frames`` the exact duration (numerator, denominator) and frame_offsets. Null media count as an empty stream."""
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))

    def run(ids: list, streams: list) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_num", "duration_den", "frame_offsets")}
        for data in streams:
            data = data or b""
            stream = parse(data)
            payload, counted = payload_of(data, stream), stream.tags.get("counted", "")
            for k, v in {
                "n_bytes": int(counted) if counted.isascii() and counted.isdigit() else 0, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
                "tail_crc32": zlib.crc32(payload[-UNIT:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature(stream),
                "duration_num": stream.duration.numerator, "duration_den": stream.duration.denominator, "frame_offsets": stream.offsets,
            }.items():
                out[k].append(v)
        return out | {"doc_id": ids}

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(rows, run, schema + ", duration_num long, duration_den long, frame_offsets array<long>" * with_frames)


def stored_media(docs: DataFrame, **options) -> DataFrame:
    """Stores ``docs`` as a table with a media column in the shared folder, reads it back and measures it."""
    return media_features(written(to_media(docs), "media"), **options)
