"""Media columns: MPEG transport streams.

``mux`` stores a byte string losslessly as a transport stream: a program association
table, a program map table and one private elementary stream whose access units carry
presentation timestamps; every eighth unit is a random-access point with a clock
reference.  ``demux`` parses any stream of that kind: program tables with their CRC,
continuity counters (repeats dropped, gaps counted), elementary packets put together
again, and the timeline of timestamps with random-access points.

Null payloads count as empty.  A stream that is not a whole number of 188-byte packets,
lost its sync bytes or has no valid tables gives ``ok = false`` and what could be read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from fuzzloom.llm.common import by_slice, quoted

PACKET, BODY = 188, 184
PMT_PID, ES_PID, PRIVATE = 0x1000, 0x0100, 0x06
UNIT, GROUP, TICKS = 16384, 8, 3600  # bytes of an access unit, units from one random-access point to the next, 90 kHz ticks of a unit


@functools.cache
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def psi_crc(data: bytes) -> int:
    """The CRC of program tables: 0 over a section with its CRC."""
    c, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ t[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    out = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return out + struct.pack(">I", psi_crc(out))


@functools.cache
def _table_packet(pid: int, counter: int) -> bytes:
    if pid == 0:
        section = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    else:
        section = _section(2, 1, struct.pack(">HH", 0xE000 | ES_PID, 0xF000) + struct.pack(">BHH", PRIVATE, 0xE000 | ES_PID, 0xF000))
    head = struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10 | counter)
    return (head + b"\0" + section).ljust(PACKET, b"\xff")


def _pts(value: int) -> bytes:
    v = value & 0x1FFFFFFFF
    return struct.pack(">BHH", 0x21 | (v >> 29) & 0x0E, (v >> 14) & 0xFFFE | 1, (v << 1) & 0xFFFE | 1)


def _pcr(base: int) -> bytes:
    return struct.pack(">IH", (base >> 1) & 0xFFFFFFFF, (base & 1) << 15 | 0x7E00)


def padded(data: bytes, unit: int = 64) -> bytes:
    """Zero bytes up to a positive multiple of the unit."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


def mux(payload: bytes) -> bytes:
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, max(len(payload), 1), UNIT)):
        unit, pts, entry = payload[at : at + UNIT], 90_000 + k * TICKS, k % GROUP == 0
        if entry:
            out += [_table_packet(0, tables & 15), _table_packet(PMT_PID, tables & 15)]
            tables += 1
        pes = b"\x00\x00\x01\xbd" + struct.pack(">HBBB", len(unit) + 8, 0x80, 0x80, 5) + _pts(pts) + unit
        field = b"\x50" + _pcr(pts) if entry else b""  # flags: random access, clock reference
        room = BODY - (len(field) + 1 if entry else 0)
        rest = max(0, len(pes) - room)
        n = 1 + -(-rest // BODY)
        rows = np.full((n, PACKET), 0xFF, np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2] = 0x47, ES_PID >> 8, ES_PID & 0xFF
        rows[0, 1] |= 0x40
        rows[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter = (counter + n) & 15
        data = np.frombuffer(pes, np.uint8)
        first = min(room, len(pes))
        fill = room - first  # of the first packet; there is a rest only if this is 0
        if entry or fill:
            length = BODY - first - 1
            rows[0, 3] |= 0x20
            rows[0, 4] = length
            if length:
                rows[0, 5] = 0
                rows[0, 5 : 5 + len(field)] = np.frombuffer(field, np.uint8)
        rows[0, PACKET - first :] = data[:first]
        full, tail = divmod(rest, BODY)
        rows[1 : 1 + full, 4:] = data[first : first + full * BODY].reshape(full, BODY)
        if tail:
            rows[-1, 3] |= 0x20
            rows[-1, 4] = BODY - tail - 1
            if BODY - tail - 1:
                rows[-1, 5] = 0
            rows[-1, PACKET - tail :] = data[len(pes) - tail :]
        out.append(rows.tobytes())
    return b"".join(out)


def _sections(rows: np.ndarray, starts: np.ndarray, own: np.ndarray):
    """The sections with a right CRC in the packets of one table's identifier, in order.

    A section may go on over packets, and others may follow it in the same one.  A lost packet
    loses the section that it belongs to."""
    held, last = None, None
    for i in own:
        body = rows[i, starts[i] :].tobytes()
        if not body or last is not None and (rows[i, 3:] == rows[last, 3:]).all():  # nothing, or a packet that is sent twice
            continue
        if last is not None and (int(rows[i, 3]) - int(rows[last, 3])) & 15 != 1:
            held = None
        last = i
        pieces = [(False, body)]
        if rows[i, 1] & 0x40:
            pieces = [(False, body[1 : 1 + body[0]]), (True, body[1 + body[0] :])]
        for new, data in pieces:
            held = data if new else None if held is None else held + data
            while held and held[0] != 0xFF:
                if len(held) < 3 or len(held) < (size := 3 + (struct.unpack(">H", held[1:3])[0] & 0xFFF)):
                    break
                if size >= 12 and psi_crc(held[:size]) == 0:
                    yield held[:size]
                held = held[size:]
            if not held or held[0] == 0xFF:
                held = None


def demux(media: bytes | None) -> dict:
    """Program tables, continuity, payload and timeline of a transport stream."""
    out = {"ok": False, "n_packets": 0, "pmt_pid": None, "streams": [], "gaps": 0, "repeats": 0, "payload": b"", "timeline": []}
    data = np.frombuffer(media or b"", np.uint8)
    if not len(data) or len(data) % PACKET:
        return out
    rows = data.reshape(-1, PACKET)
    out["n_packets"] = len(rows)
    if (rows[:, 0] != 0x47).any():
        return out
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    control, counter = rows[:, 3] >> 4 & 3, rows[:, 3] & 15
    has_field, has_body = control >= 2, (control & 1).astype(bool)
    starts = np.where(has_field, 5 + rows[:, 4].astype(np.int32), 4)
    starts = np.minimum(np.where(has_body, starts, PACKET), PACKET)
    flags = np.where(has_field & (rows[:, 4] > 0), rows[:, 5], 0)
    programs: dict[int, int] = {}
    for s in _sections(rows, starts, np.nonzero(pid == 0)[0]):
        if s[0] == 0:
            for at in range(8, len(s) - 4, 4):
                number, target = struct.unpack(">HH", s[at : at + 4])
                if number:
                    programs[number] = target & 0x1FFF
    streams: dict[int, int] = {}
    for target in programs.values():
        for s in _sections(rows, starts, np.nonzero(pid == target)[0]):
            if s[0] == 2:
                at = 12 + (struct.unpack(">H", s[10:12])[0] & 0xFFF)
                while at + 5 <= len(s) - 4:
                    kind, es, info = struct.unpack(">BHH", s[at : at + 5])
                    streams[es & 0x1FFF] = kind
                    at += 5 + (info & 0xFFF)
    if not streams:
        return out
    out["pmt_pid"], out["streams"] = min(programs.values()), sorted(streams.items())
    keep = np.ones(len(rows), bool)
    for p in [0, *programs.values(), *streams]:
        own = np.nonzero((pid == p) & has_body)[0]
        step = (counter[own][1:].astype(int) - counter[own][:-1]) & 15
        told = flags[own][1:] & 0x80 > 0  # a discontinuity that the stream itself announces
        same = (step == 0) & (rows[own[1:], 4:] == rows[own[:-1], 4:]).all(axis=1)
        out["repeats"] += int(same.sum())
        out["gaps"] += int(((step != 1) & ~same & ~told).sum())
        keep[own[1:][same]] = False
    payload, size = [], 0
    for p in streams:
        own = np.nonzero((pid == p) & has_body & keep)[0]
        if not len(own):
            continue
        lengths = PACKET - starts[own]
        begins = np.concatenate([[0], np.cumsum(lengths)])
        body = rows[own][np.arange(PACKET)[None, :] >= starts[own][:, None]].tobytes()
        heads = np.nonzero(rows[own, 1] & 0x40)[0]
        ends = [*begins[heads[1:]].tolist(), len(body)]
        for i, end in zip(heads.tolist(), ends, strict=True):
            pes = body[int(begins[i]) : int(end)]
            if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
                out["gaps"] += 1
                continue
            said = struct.unpack(">H", pes[4:6])[0]
            pes = pes[: 6 + said] if said else pes
            pts = None
            if pes[7] & 0x80 and len(pes) >= 14:
                a, b, c = struct.unpack(">BHH", pes[9:14])
                pts = (a >> 1 & 7) << 30 | (b >> 1) << 15 | c >> 1
            data_at = 9 + pes[8]
            out["timeline"].append((pts, int(own[i]), size, bool(flags[own[i]] & 0x40)))
            payload.append(pes[data_at:])
            size += len(payload[-1])
    out["payload"], out["ok"] = b"".join(payload), out["gaps"] == 0
    return out


MEDIA = "n_bytes long, media binary"
PARSED = "ok boolean, n_packets long, pmt_pid int, streams array<struct<pid:int,kind:int>>, gaps long, repeats long, payload binary, timeline array<struct<pts:long,packet:long,offset:long,random_access:boolean>>"


def _with(df: DataFrame, keep: list[str], added: str) -> StructType:
    clash = {*keep} & {x.name for x in _parse_datatype_string(added)}
    if clash:
        raise ValueError(f"kept columns have names of the result: {sorted(clash)}")
    return StructType([df.schema[k] for k in keep] + list(_parse_datatype_string(added)))


def store_text(df: DataFrame, key: str = "doc_id", text: str = "text", unit: int = 64) -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes, zero-padded to the unit, as a transport stream."""

    def make():
        def f(batch):
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            return {key: batch.column(0), "n_bytes": [len(x) for x in raw], "media": [mux(padded(x, unit)) for x in raw]}

        return f

    return by_slice(df.select(quoted(key), quoted(text)), make, _with(df, [key], MEDIA), 256)


def parse_media(df: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """The kept columns with everything that demux finds."""

    def make():
        def f(batch):
            found = [demux(x) for x in batch.column(len(keep)).to_pylist()]
            cols = {k: batch.column(i) for i, k in enumerate(keep)}
            for k in ("ok", "n_packets", "pmt_pid", "gaps", "repeats", "payload"):
                cols[k] = [x[k] for x in found]
            cols["streams"] = [[{"pid": a, "kind": b} for a, b in x["streams"]] for x in found]
            cols["timeline"] = [[dict(zip(("pts", "packet", "offset", "random_access"), y, strict=True)) for y in x["timeline"]] for x in found]
            return cols

        return f

    return by_slice(df.select(*[quoted(k) for k in keep], quoted(media)), make, _with(df, keep, PARSED), 256)


def media_digest(df: DataFrame) -> DataFrame:
    """One row per document: the digest of its stored form and of what was read back.

    Null and empty texts are 64 zero bytes.  Equal texts give equal values."""
    stored = store_text(df).withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    read = parse_media(stored, ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    line = F.transform("timeline", lambda x: F.coalesce(x["pts"], F.lit(-1)))
    entries = F.size(F.filter("timeline", lambda x: x["random_access"]))
    kinds = F.array_join(F.transform("streams", lambda x: F.concat_ws(":", x["pid"].cast("string"), x["kind"].cast("string"))), "+")
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(length(payload) - 63, 1), 64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(
            ";",
            F.concat(F.lit("ok="), F.col("ok").cast("string")),
            F.concat(F.lit("packets="), F.col("n_packets").cast("string")),
            F.concat(F.lit("streams="), kinds),
            F.concat(F.lit("units="), F.size("timeline").cast("string")),
            F.concat(F.lit("entries="), entries.cast("string")),
            F.concat(F.lit("pts="), F.array_min(line).cast("string"), F.lit("-"), F.array_max(line).cast("string")),
            F.concat(F.lit("gaps="), F.col("gaps").cast("string")),
        ).alias("feature"),
        "timeline",
    )


def brute_force(text: str | None) -> dict:
    """What a document's row must hold, from the text alone."""
    raw = (text or "").encode()
    data = padded(raw)
    return {"n_bytes": len(raw), "payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-64:])}
