"""MPEG audio columns: writing, resynchronising and verifying streams held as bytes.

``store`` puts a payload losslessly into a stream of MPEG-1 Layer III frames: an
ID3v2 tag (payload length and CRC-32), a variable-bitrate table frame, silent
frames of variable bitrate whose ancillary bytes carry the payload, and an ID3v1
tag.  Such a stream is valid audio: no granule has main data.

``parse`` reads any stream of Layer I-III frames: it skips tags, finds frame
headers again after damage (there, a header counts where another of the same
kind, a tag or the end follows it), reads variable-bitrate tables (Xing, Info,
VBRI) and holds their seek points against the frames found, verifies the CRC-16 of
protected Layer I and III frames, and gives the exact duration in samples, with
the encoder's delay and padding where it states them, and the offset of every
frame.  Of tags it reads the text frames TXXX of ID3v2.3 and 2.4, past extended
headers and footers.  Not read: free-format frames, whose length no header gives,
and the checksums of Layer II, which counts them as unchecked.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import tidied, utf8
from .scratch import refuse_clash

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer), Hz by version bits.
BITRATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The MPEG audio checksum (polynomial 0x8005, start 0xFFFF)."""
    c = 0xFFFF
    for byte in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ byte]
    return c


@dataclass(frozen=True)
class Header:
    version: int  # version bits: 3 MPEG-1, 2 MPEG-2, 0 MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int
    joint: int = 32  # Layer I: the first subband that both channels share

    @property
    def kind(self) -> tuple[int, int, int]:
        return self.version, self.layer, self.rate

    @property
    def side(self) -> int:
        """Bytes of side information of Layer III."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    @property
    def guarded(self) -> int | None:
        """Bytes after the checksum that it covers; None where we don't know."""
        if self.layer == 3:
            return self.side
        return (16 if self.mono else (32 + self.joint) // 2) if self.layer == 1 else None


_HEADERS: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """A frame header from its 32 bits, None where it isn't one (free format isn't read)."""
    if word not in _HEADERS:
        if len(_HEADERS) > 4096:
            _HEADERS.clear()
        _HEADERS[word] = _header(word)
    return _HEADERS[word]


def _header(word: int) -> Header | None:
    version, layer = (word >> 19) & 3, 4 - ((word >> 17) & 3)
    bit, freq = (word >> 12) & 15, (word >> 10) & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or bit in (0, 15) or freq == 3:
        return None
    first = version == 3
    kbps, rate, pad = BITRATES[first, layer][bit], RATES[version][freq], (word >> 9) & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
    mode = (word >> 6) & 3
    return Header(version, layer, not (word >> 16) & 1, kbps, rate, mode == 3, length, samples, 4 * ((word >> 4) & 3) + 4 if mode == 1 else 32)


RATE = 32000  # of stored streams: MPEG-1 Layer III, mono, protected
_RATE_BITS = RATES[3].index(RATE)
_OVERHEAD = 4 + 2 + 17


def _word(bit: int) -> int:
    return 0x7FF << 21 | 3 << 19 | 1 << 17 | 0 << 16 | bit << 12 | _RATE_BITS << 10 | 3 << 6


def _frame_start(bit: int) -> bytes:
    """Header, checksum and empty side information of a silent frame."""
    word = struct.pack(">I", _word(bit))
    return word + struct.pack(">H", crc16(word[2:] + bytes(17))) + bytes(17)


_STARTS = [b"", *(_frame_start(b) for b in range(1, 15))]
_ROOM = [0, *(header(_word(b)).length - _OVERHEAD for b in range(1, 15))]


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def _text_frame(key: str, value: str) -> bytes:
    body = b"\0" + key.encode("latin-1") + b"\0" + value.encode("latin-1")
    return b"TXXX" + struct.pack(">IH", len(body), 0) + body


def store(payload: bytes) -> bytes:
    """The stream that holds a payload; equal payloads give equal streams."""
    tags = _text_frame("payload_bytes", str(len(payload))) + _text_frame("payload_crc32", f"{zlib.crc32(payload):08x}")
    frames, at = [], 0
    while at < len(payload):
        rest = len(payload) - at
        bit = next((b for b in range(1, 15) if _ROOM[b] >= rest), 14)
        part = payload[at : at + _ROOM[bit]]
        frames.append(_STARTS[bit] + part + bytes(_ROOM[bit] - len(part)))
        at += len(part)
    sizes = np.cumsum([0, *map(len, frames)])
    bit = 9
    head = _STARTS[bit]
    total = len(head) + _ROOM[bit] + int(sizes[-1])
    toc = bytes(min(255, int(256 * (len(head) + _ROOM[bit] + sizes[len(frames) * i // 100]) // total)) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    first = head + table + bytes(_ROOM[bit] - len(table))
    return b"ID3\x03\x00\x00" + _synchsafe(len(tags)) + tags + first + b"".join(frames) + b"TAG" + b"stored payload".ljust(125, b"\0")


@dataclass
class Stream:
    """What ``parse`` finds; offsets count from the first byte of the stream."""

    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    bitrates: set[int] = field(default_factory=set)
    checked: int = 0
    bad_checks: int = 0
    resyncs: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    id3v1: bool = False
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    table_at: int | None = None
    seek_points: list[tuple[float, int]] = field(default_factory=list)  # share of the frames, bytes after the table's frame
    seek_error: int = 0  # what its resolution allows
    delay: int = 0
    padding: int = 0
    ancillary: list[bytes] = field(default_factory=list)

    @property
    def trimmed(self) -> int:
        """Samples without what the encoder has added."""
        return max(0, self.samples - self.delay - self.padding)

    def consistent(self, size: int) -> bool:
        """Whether the variable-bitrate table, if there is one, agrees with the frames."""
        if self.vbr_frames is None:
            return True
        if self.vbr_frames != len(self.offsets) or (self.vbr_bytes or 0) > size:
            return False
        places = [*(x - self.table_at for x in self.offsets), size - self.table_at]
        n = len(self.offsets)
        return all(
            places[max(0, int(share * n) - 1)] - self.seek_error <= at <= places[min(n, int(share * n) + 1)] + self.seek_error for share, at in self.seek_points
        )

    def payload(self) -> bytes | None:
        """The stored payload if its tags are there and its checksum holds."""
        data = b"".join(self.ancillary)
        try:
            data = data[: int(self.tags["payload_bytes"])]
            return data if int(self.tags["payload_bytes"]) == len(data) and int(self.tags["payload_crc32"], 16) == zlib.crc32(data) else None
        except (KeyError, ValueError):
            return None


def parse(data: bytes) -> Stream:
    """Read a stream; bytes that belong to no frame or tag are skipped."""
    out, at, end = Stream(), 0, len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        out.id3v1, end = True, end - 128
    kind, lost = None, False
    while at + 4 <= end:
        if data[at : at + 3] == b"ID3" and at + 10 <= end and max(data[at + 6 : at + 10]) < 128:
            size = _unsafe(data[at + 6 : at + 10])
            _read_tags(data[at + 10 : at + 10 + size], out.tags, data[at + 3], data[at + 5])
            at += 10 + size + (10 if data[at + 3] == 4 and data[at + 5] & 0x10 else 0)
            lost = False
            continue
        h = header(int.from_bytes(data[at : at + 4], "big"))
        if h is None or (kind and h.kind != kind) or at + h.length > end or (lost or not kind) and not _follows(data, at + h.length, end, h.kind):
            if not lost:
                out.resyncs += 1
                lost = True
            found = data.find(b"\xff", at + 1, end)
            tag = data.find(b"ID3", at + 1, found if found >= 0 else end)
            at = tag if tag >= 0 else found if found >= 0 else end
            continue
        lost, kind = False, h.kind
        body = at + (6 if h.protected else 4)
        if h.protected and h.guarded is not None:
            out.checked += 1
            out.bad_checks += crc16(data[at + 2 : at + 4] + data[body : body + h.guarded]) != int.from_bytes(data[at + 4 : at + 6], "big")
        if h.layer == 3:
            after = body + h.side
            if not out.offsets and out.vbr_frames is None and (data[after : after + 4] in (b"Xing", b"Info") or data[at + 36 : at + 40] == b"VBRI"):
                out.table_at = at
                if data[at + 36 : at + 40] == b"VBRI":
                    _read_vbri(data[at + 36 : at + h.length], out)
                else:
                    _read_vbr(data[after : at + h.length], out)
                at += h.length
                continue
            if not any(data[body:after]):  # no main data: all the rest is ancillary
                out.ancillary.append(data[after : at + h.length])
        out.offsets.append(at)
        out.samples += h.samples
        out.rate = h.rate
        out.bitrates.add(h.kbps)
        at += h.length
    return out


def _follows(data: bytes, at: int, end: int, kind: tuple[int, int, int]) -> bool:
    if at + 4 > end or data[at : at + 3] == b"ID3":
        return True
    after = header(int.from_bytes(data[at : at + 4], "big"))
    return after is not None and after.kind == kind


def _unsafe(raw: bytes) -> int:
    """A number of four times seven bits."""
    return (raw[0] << 21) | (raw[1] << 14) | (raw[2] << 7) | raw[3]


def _read_tags(body: bytes, tags: dict[str, str], version: int = 3, flags: int = 0) -> None:
    at = 0
    number = _unsafe if version == 4 else lambda raw: int.from_bytes(raw, "big")
    if flags & 0x40 and len(body) >= 4:  # an extended header; only in 2.4 does its size include itself
        at = number(body[:4]) + (0 if version == 4 else 4)
    while at + 10 <= len(body) and body[at] != 0:
        size = number(body[at + 4 : at + 8])
        if body[at : at + 4] == b"TXXX" and body[at + 10 : at + 11] == b"\0":
            key, _, value = body[at + 11 : at + 10 + size].partition(b"\0")
            tags[key.decode("latin-1")] = value.decode("latin-1")
        at += 10 + size


def _read_vbr(table: bytes, out: Stream) -> None:
    """A Xing or Info table, and the delay and padding of an encoder's part behind it."""
    flags, at = int.from_bytes(table[4:8], "big"), 8
    out.vbr_frames = 0
    if flags & 1:
        out.vbr_frames, at = int.from_bytes(table[at : at + 4], "big"), at + 4
    if flags & 2:
        out.vbr_bytes, at = int.from_bytes(table[at : at + 4], "big"), at + 4
    if flags & 4:
        toc, at = table[at : at + 100], at + 100
        if out.vbr_bytes:
            out.seek_points = [(k / 100, x * out.vbr_bytes // 256) for k, x in enumerate(toc)]
            out.seek_error = out.vbr_bytes // 256 + 1
    at += 4 if flags & 8 else 0
    if table[at : at + 4] in (b"LAME", b"Lavc", b"Lavf") and len(table) >= at + 24:
        both = int.from_bytes(table[at + 21 : at + 24], "big")
        out.delay, out.padding = both >> 12, both & 0xFFF


def _read_vbri(table: bytes, out: Stream) -> None:
    """A VBRI table: its seek points are sizes of runs of frames."""
    if len(table) < 26:
        return
    out.delay, _, out.vbr_bytes, out.vbr_frames, entries, scale, width, each = struct.unpack(">HHIIHHHH", table[6:26])
    at = 0
    for k in range(entries if out.vbr_frames and len(table) >= 26 + entries * width else 0):
        at += int.from_bytes(table[26 + k * width : 26 + (k + 1) * width], "big") * scale
        out.seek_points.append((min(1.0, (k + 1) * each / out.vbr_frames), at))
    out.seek_error = scale * max(1, entries)


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def audio_from_text(docs: DataFrame, keep: list[Column | str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs with n_bytes and the column media; a null text is empty.

    Rows are stored each by itself; equal texts give equal media.  ``keep`` may
    not have n_bytes, media or _m_text; other columns of docs may.
    """
    refuse_clash(keep, "n_bytes", "media", "_m_text")
    kept = docs.select(*(keep or ["doc_id"]), F.col("text").alias("_m_text"))
    names = kept.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("_m_text"))
            at = offsets.tolist()
            media = [store(padded(data[a:b].tobytes())) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(len(names))), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], [*names, "n_bytes", "media"]
            )

    return kept.mapInArrow(tidied(run), f"{_schema(kept, names)}, n_bytes bigint, media binary")


PARSED = (
    "payload binary, media_bytes bigint, media_sha256 string, sample_rate int, samples bigint, frames bigint, seek_offsets array<bigint>, "
    "bad_checks bigint, resyncs bigint, vbr_consistent boolean"
)


def read_audio(media: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with what the stream in the column media holds.

    ``samples`` / ``sample_rate`` is the exact duration; ``seek_offsets`` has
    the byte offset of every frame.  payload is null where the stream has none
    or its checksum fails; a null media is an empty stream.  ``keep`` may not have
    the result's names or _m_media.
    """
    refuse_clash(keep, *(x.split()[0] for x in PARSED.split(", ")), "_m_media")
    taken = media.select(*keep, F.col("media").alias("_m_media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column("_m_media"):
                data = raw.as_py() or b""
                s = parse(data)
                whole = len(data) - (128 if s.id3v1 else 0)
                rows.append((
                    s.payload(), len(data), hashlib.sha256(data).hexdigest(), s.rate, s.samples, len(s.offsets), s.offsets, s.bad_checks, s.resyncs,
                    s.consistent(whole),
                ))
            columns = list(zip(*rows)) if rows else [()] * 10
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], [*keep, *(x.split()[0] for x in PARSED.split(", "))])

    return taken.mapInArrow(tidied(run), f"{_schema(taken, keep)}, {PARSED}")
