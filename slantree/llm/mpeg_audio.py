"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, durations and seek offsets.

`parse` reads MPEG-1/2/2.5 audio of any layer from a binary column.  It skips
ID3v2 and ID3v1 tags, resynchronises on frame headers (a header counts if the
next frame, or the end, follows where it says), verifies the CRC-16 of protected
Layer III frames, reads Xing/Info tables, and gives exact durations as samples
over rate.

`carry` stores arbitrary bytes losslessly in a valid silent stream: MPEG-2 Layer
III, mono, 16 kHz, 576 samples a frame, 576 payload bytes in the ancillary data
of each frame.  The bitrate varies: frames whose payload holds a byte 255 are
larger.  The stream starts with an ID3v2 tag and a Xing table.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

from slantree.llm.text_arrays import pieces

UNIT = 576
# Fixed values of the MPEG audio standards: bitrates (kbit/s) by (MPEG-1?, layer), and sample rates of MPEG-1.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = (44100, 48000, 32000)


def _crc_table() -> np.ndarray:
    """CRC-16 with polynomial 0x8005, most significant bit first."""
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1) ^ (0x8005 if value & 0x8000 else 0)
        table.append(value & 0xFFFF)
    return np.array(table, np.uint16)


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """Of each row of a byte matrix, from 0xFFFF on."""
    value = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        value = (value << np.uint16(8)) ^ _CRC[(value >> np.uint16(8)) ^ rows[:, k]]
    return value


class Header:
    """What four header bytes say; `size` is 0 if they are no frame header."""

    __slots__ = ("size", "samples", "rate", "bitrate", "protected", "side", "layer", "mono", "kind")

    def __init__(self, word: int):
        version, layer = (word >> 19) & 3, 4 - ((word >> 17) & 3)
        bitrate, rate = (word >> 12) & 15, (word >> 10) & 3
        self.size = 0
        if word >> 21 != 0x7FF or version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3:
            return
        first = version == 3
        self.layer, self.mono, self.protected = layer, (word >> 6) & 3 == 3, not (word >> 16) & 1
        self.rate = SAMPLE_RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
        self.bitrate = BITRATES[first, layer][bitrate]
        self.samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
        padding = (word >> 9) & 1
        if layer == 1:
            self.size = (12000 * self.bitrate // self.rate + padding) * 4
        else:
            self.size = self.samples // 8 * 1000 * self.bitrate // self.rate + padding
        self.side = 0 if layer != 3 else (17 if self.mono else 32) if first else (9 if self.mono else 17)
        self.kind = (version, layer, rate)


_headers: dict[int, Header] = {}


def header(word: int) -> Header:
    # Header words that occur are few; bits that do not matter (private, mode extension, ...) are masked out.
    word &= 0xFFFFFEC0
    if word not in _headers:
        if len(_headers) > 100_000:
            _headers.clear()
        _headers[word] = Header(word)
    return _headers[word]


def _synchsafe(raw: bytes) -> int:
    return (raw[0] & 127) << 21 | (raw[1] & 127) << 14 | (raw[2] & 127) << 7 | raw[3] & 127


def _tags(media: bytes) -> tuple[dict[str, str], int, int]:
    """Text tags, where the audio starts and where it ends; ID3v2 wins over ID3v1."""
    tags: dict[str, str] = {}
    start, end = 0, len(media)
    if media[:3] == b"ID3" and len(media) >= 10:
        start = min(len(media), 10 + _synchsafe(media[6:10]) + (10 if media[5] & 16 else 0))
        at, stop = 10, start
        while at + 10 <= stop and media[at] != 0:
            name = media[at : at + 4].decode("latin-1")
            size = _synchsafe(media[at + 4 : at + 8]) if media[3] == 4 else int.from_bytes(media[at + 4 : at + 8], "big")
            body = media[at + 10 : min(stop, at + 10 + size)]
            at += 10 + size
            if name[:1] == "T" and body:
                codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                text = body[1:].decode(codec, "replace").rstrip("\0")
                if name == "TXXX" and "\0" in text:
                    name, text = text.split("\0", 1)
                tags.setdefault(name, text)
    if end - start >= 128 and media[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if text := media[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(name, text)
    return tags, start, end


def frames(media: bytes, start: int, end: int) -> tuple[list[int], list[Header], int]:
    """Offsets and headers of all frames in media[start:end], and how many bytes belong to none."""
    offsets: list[int] = []
    found: list[Header] = []
    at, skipped, locked = start, 0, None
    while at + 4 <= end:
        one = header(int.from_bytes(media[at : at + 4], "big"))
        if one.size and at + one.size <= end:
            after = at + one.size
            fits = locked == one.kind or after == end
            if not fits and after + 4 <= end:
                other = header(int.from_bytes(media[after : after + 4], "big"))
                fits = other.size > 0 and other.kind == one.kind
            if fits:
                offsets.append(at)
                found.append(one)
                at, locked = after, one.kind
                continue
        locked = None
        to = media.find(b"\xff", at + 1, end)
        to = end if to < 0 else to
        skipped += to - at
        at = to
    return offsets, found, skipped + max(0, end - at)


_FRAME = StructType(
    [
        StructField("payload", BinaryType()),
        StructField("n_frames", LongType()),
        StructField("n_samples", LongType()),
        StructField("sample_rate", IntegerType()),
        StructField("seconds", DoubleType()),
        StructField("crc_checked", LongType()),
        StructField("crc_failed", LongType()),
        StructField("skipped_bytes", LongType()),
        StructField("table_frames", LongType()),
        StructField("table_bytes", LongType()),
        StructField("table_seek", ArrayType(IntegerType())),
        StructField("bitrates", ArrayType(IntegerType())),
        StructField("offsets", ArrayType(LongType())),
        StructField("tags", MapType(StringType(), StringType())),
    ]
)


def _parse(media: bytes) -> tuple[dict, list[int], list[Header]]:
    tags, start, end = _tags(media)
    offsets, found, skipped = frames(media, start, end)
    table_frames = table_bytes = table_seek = None
    if found and found[0].layer == 3:
        at = offsets[0] + 4 + 2 * found[0].protected + found[0].side
        vbri = offsets[0] + 36
        if media[at : at + 4] in (b"Xing", b"Info") and at + 16 <= end:
            flags = int.from_bytes(media[at + 4 : at + 8], "big")
            at += 8
            if flags & 1:
                table_frames, at = int.from_bytes(media[at : at + 4], "big"), at + 4
            if flags & 2:
                table_bytes, at = int.from_bytes(media[at : at + 4], "big"), at + 4
            if flags & 4:
                table_seek = list(media[at : at + 100])
            offsets, found = offsets[1:], found[1:]
        elif media[vbri : vbri + 4] == b"VBRI" and vbri + 26 <= end:
            table_bytes, table_frames = (int.from_bytes(media[vbri + k : vbri + k + 4], "big") for k in (10, 14))
            count, scale, width = (int.from_bytes(media[vbri + k : vbri + k + 2], "big") for k in (18, 20, 22))
            entries = media[vbri + 26 : vbri + 26 + count * width]
            table_seek = [scale * int.from_bytes(entries[k : k + width], "big") for k in range(0, len(entries) - width + 1, width)] if width else []
            offsets, found = offsets[1:], found[1:]
    samples = sum([h.samples for h in found])
    rate = found[0].rate if found else None
    units = [media[o + 6 + h.side : o + 6 + h.side + UNIT] for o, h in zip(offsets, found) if h.protected]
    row = {
        "payload": b"".join(units),
        "n_frames": len(found),
        "n_samples": samples,
        "sample_rate": rate,
        "seconds": samples / rate if rate else 0.0,
        "skipped_bytes": skipped,
        "table_frames": table_frames,
        "table_bytes": table_bytes,
        "table_seek": table_seek,
        "bitrates": sorted({h.bitrate for h in found}),
        "offsets": offsets,
        "tags": list(tags.items()),
    }
    return row, offsets, found


def _check(media: list[bytes], parsed: list[tuple[dict, list[int], list[Header]]]) -> None:
    """Fill crc_checked and crc_failed, for the protected Layer III frames of all streams at once."""
    groups: dict[int, list[tuple[int, bytes]]] = {}
    for k, (row, offsets, found) in enumerate(parsed):
        row["crc_checked"] = row["crc_failed"] = 0
        for o, h in zip(offsets, found):
            if h.protected and h.layer == 3:
                groups.setdefault(h.side, []).append((k, media[k][o + 2 : o + 6 + h.side]))
                row["crc_checked"] += 1
    for side, got in groups.items():
        raw = np.frombuffer(b"".join(x for _, x in got), np.uint8).reshape(len(got), 4 + side)
        said = raw[:, 2].astype(np.uint16) << np.uint16(8) | raw[:, 3]
        wrong = crc16(np.concatenate([raw[:, :2], raw[:, 4:]], 1)) != said
        for k in np.array([k for k, _ in got])[wrong]:
            parsed[k][0]["crc_failed"] += 1


@F.arrow_udf(_FRAME)
def parse_udf(media: pa.Array) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_schema

    out = []
    for part in pieces(media, 1 << 22):
        some = [m or b"" for m in part.to_pylist()]
        parsed = [_parse(m) for m in some]
        _check(some, parsed)
        out += [row for row, _, _ in parsed]
    schema = to_arrow_schema(_FRAME)
    return pa.StructArray.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in schema], fields=list(schema))


def parse(df: DataFrame, media_col: str = "media", into: str = "audio") -> DataFrame:
    """Add a struct column with what each stream holds; null, empty or non-audio bytes give zero frames.

    `offsets` are the byte positions of all audio frames, for seeking; a Xing,
    Info or VBRI frame is a table and not counted as audio: table_frames,
    table_bytes, and table_seek (Xing: 100 positions in 256ths of the file;
    VBRI: bytes from entry to entry).  `payload` joins the first
    UNIT bytes behind the side information of protected frames (what `carry`
    stored).
    """
    return df.withColumn(into, parse_udf(F.col(media_col)))


def _frame_start(bitrate: int) -> tuple[bytes, int]:
    """Header, CRC and empty side information of a protected mono MPEG-2 Layer III frame at 16 kHz, and its size."""
    index = BITRATES[False, 3].index(bitrate)
    word = 0x7FF << 21 | 2 << 19 | 1 << 17 | index << 12 | 2 << 10 | 3 << 6
    raw = struct.pack(">I", word)
    side = bytes(9)
    crc = int(crc16(np.frombuffer(raw[2:] + side, np.uint8)[None])[0])
    return raw + struct.pack(">H", crc) + side, Header(word).size


_PLAIN, _PLAIN_SIZE = _frame_start(144)
_WIDE, _WIDE_SIZE = _frame_start(160)
_PLAIN_FILL = bytes(_PLAIN_SIZE - len(_PLAIN) - UNIT)
_WIDE_FILL = bytes(_WIDE_SIZE - len(_WIDE) - UNIT)
#: The table's frame is unprotected (protection bit set), as encoders write it.
_TABLE = bytes([_PLAIN[0], _PLAIN[1] | 1, *_PLAIN[2:4]]) + bytes(9)


def padded(raw: bytes) -> bytes:
    """Bytes 255 are appended up to a positive multiple of UNIT."""
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def carried(raw: bytes) -> bytes:
    """A stream that holds `padded(raw)`."""
    payload = padded(raw)
    parts, sizes = [], []
    for at in range(0, len(payload), UNIT):
        unit = payload[at : at + UNIT]
        # The last frame is a wide one: its fill ends the stream, so that no payload can look like a tag there.
        if b"\xff" in unit or at + UNIT == len(payload):
            parts.append(_WIDE + unit + _WIDE_FILL)
        else:
            parts.append(_PLAIN + unit + _PLAIN_FILL)
        sizes.append(len(parts[-1]))
    total = _PLAIN_SIZE + sum(sizes)
    starts = np.cumsum([_PLAIN_SIZE, *sizes[:-1]])
    toc = (starts[np.arange(100) * len(sizes) // 100] * 256 // total).astype(np.uint8).tobytes()
    table = _TABLE + b"Xing" + struct.pack(">III", 7, len(sizes), total) + toc
    body = b"\x03payload_bytes\0" + str(len(raw)).encode()
    body = b"TXXX" + struct.pack(">I", len(body)) + b"\0\0" + body
    tag = b"ID3\x04\0\0" + bytes([len(body) >> 21 & 127, len(body) >> 14 & 127, len(body) >> 7 & 127, len(body) & 127]) + body
    return b"".join([tag, table.ljust(_PLAIN_SIZE, b"\0"), *parts])


@F.arrow_udf(BinaryType())
def carry_udf(content: pa.Array) -> pa.Array:
    return pa.array([carried(x or b"") for x in content.cast(pa.binary()).to_pylist()], pa.binary())


def carry(df: DataFrame, content_col: str, into: str = "media") -> DataFrame:
    """Add a valid audio stream holding each row's bytes (a text counts as its UTF-8, null as empty)."""
    return df.withColumn(into, carry_udf(F.col(content_col).cast("binary")))


