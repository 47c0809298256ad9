"""MPEG transport streams as a media column: write payloads as packets, and read tables, counters, timestamps and payloads back.

A stream holds one program with one private-data elementary stream. The payload is cut into access units, each a
packetised elementary stream (PES) packet with a presentation timestamp; every ``GROUP``-th is a random-access point
before which the program tables are repeated.

Defined results: a null text counts as empty; null and repeated document ids pass through; an empty table gives an empty
result; columns other than the id and the text are not read. A damaged stream never raises: packets out of step or
flagged as wrong are counted and skipped, gaps of a continuity counter are counted, of the data and of the tables, and PES
packets that a gap touches are left out of the payload and counted.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
PRIVATE_DATA, PRIVATE_STREAM_1 = 0x06, 0xBD
BLOCK = 576
#: Payload bytes of an access unit, access units from one random-access point to the next, clock ticks between units.
UNIT, GROUP, TICKS = 32 * BLOCK, 8, 3600


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def section(table_id: int, key: int, body: bytes) -> bytes:
    """A program table section with its length, version 0 and checksum."""
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2) + key.to_bytes(2) + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4)


def table_packet(pid: int, sec: bytes) -> np.ndarray:
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + sec
    return np.frombuffer(packet.ljust(PACKET, b"\xff"), np.uint8)


PAT = table_packet(PAT_PID, section(0x00, 1, (1).to_bytes(2) + (0xE000 | PMT_PID).to_bytes(2)))
PMT = table_packet(PMT_PID, section(0x02, 1, (0xE000 | DATA_PID).to_bytes(2) + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2) + b"\xf0\x00"))


def timestamp_bytes(mark: int, ticks: int) -> bytes:
    return bytes([mark << 4 | ticks >> 29 & 0x0E | 1, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1])


def timestamp_of(raw: bytes) -> int:
    return (raw[0] >> 1 & 7) << 30 | raw[1] << 22 | raw[2] >> 1 << 15 | raw[3] << 7 | raw[4] >> 1


def unit_packets(pes: bytes, clock: int, random_access: bool) -> np.ndarray:
    """Transport packets of one PES packet; the first has the clock, the last is filled up in its adaptation field."""
    clock_field = bytes([0x10 | 0x40 * random_access]) + (clock << 15 | 0x7E00).to_bytes(6)
    room = 184 - 8
    n = 1 + max(0, -(-(len(pes) - room) // 184))
    out = np.full((n, PACKET), 0xFF, dtype=np.uint8)
    out[:, :4] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF, 0x10
    out[0, 1] |= 0x40
    first = min(room, len(pes))
    out[0, 3] = 0x30
    out[0, 4] = 183 - first
    out[0, 5:12] = np.frombuffer(clock_field, np.uint8)
    data = np.frombuffer(pes, np.uint8)
    out[0, PACKET - first :] = data[:first]
    if n > 1:
        full, rest = divmod(len(pes) - first, 184)
        out[1 : 1 + full, 4:] = data[first : first + 184 * full].reshape(full, 184)
        if rest:
            out[-1, 3] = 0x30
            out[-1, 4] = 183 - rest
            if rest < 183:
                out[-1, 5] = 0
            out[-1, PACKET - rest :] = data[len(pes) - rest :]
    return out


def write_stream(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    parts, tables = [], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        data, ticks = payload[at : at + UNIT], TICKS * k
        if k % GROUP == 0:
            pair = np.stack([PAT, PMT])
            pair[:, 3] |= tables & 15
            parts.append(pair)
            tables += 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(data) + 8).to_bytes(2) + b"\x84\x80\x05" + timestamp_bytes(2, ticks) + data
        parts.append(unit_packets(pes, ticks, k % GROUP == 0))
    out = np.concatenate(parts) if parts else np.empty((0, PACKET), np.uint8)
    mine = np.flatnonzero((out[:, 1].astype(np.int64) & 0x1F) << 8 | out[:, 2] == DATA_PID)
    out[mine, 3] |= (np.arange(len(mine)) & 15).astype(np.uint8)
    return out.tobytes()


@dataclass
class Stream:
    """What a transport stream holds: for each unit its timestamp, whether it is a random-access point, the number of its first packet, and its size."""

    program: int | None = None
    pid: int | None = None
    stream_type: int | None = None
    packets: int = 0
    out_of_step: int = 0
    flagged: int = 0
    gaps: int = 0
    table_gaps: int = 0
    broken_units: int = 0
    timestamps: list[int | None] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)
    first_packet: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    payload: bytes = b""

    @property
    def feature(self) -> str:
        known = [t for t in self.timestamps if t is not None]
        index = ";".join(f"{t}@{p}" for t, p, r in zip(self.timestamps, self.first_packet, self.random_access, strict=True) if r)
        return (
            f"program={self.program},pid={self.pid},type={self.stream_type},packets={self.packets},units={len(self.sizes)},access={sum(self.random_access)},"
            f"pts={known[0] if known else ''}-{known[-1] if known else ''},gaps={self.gaps},broken={self.broken_units},index={zlib.crc32(index.encode()):08x}"
        )


def in_step(media: bytes) -> tuple[np.ndarray, int]:
    """Packets, and how many bytes lay between or after them."""
    data = np.frombuffer(media, np.uint8)
    whole = len(data) // PACKET
    grid = data[: whole * PACKET].reshape(whole, PACKET)
    if len(data) == whole * PACKET and (grid[:, 0] == SYNC).all():
        return grid, 0
    starts, at = [], 0
    while at + PACKET <= len(data):
        if data[at] == SYNC and (at + PACKET == len(data) or data[at + PACKET] == SYNC):
            starts.append(at)
            at += PACKET
        else:
            at += 1
    rows = data[np.array(starts, dtype=np.int64)[:, None] + np.arange(PACKET)] if starts else np.empty((0, PACKET), np.uint8)
    return rows, len(data) - PACKET * len(starts)


def table_body(packet: np.ndarray) -> bytes | None:
    """Body of a checked table section that lies in one packet."""
    raw = packet.tobytes()
    at = 4 + (raw[4] + 1 if raw[3] & 0x20 else 0)
    if at >= PACKET:
        return None
    at += 1 + raw[at]
    size = int.from_bytes(raw[at + 1 : at + 3]) & 0xFFF if at + 3 <= PACKET else 0
    sec = raw[at : at + 3 + size]
    if size < 9 or len(sec) < 3 + size or (sec not in KNOWN and crc32_mpeg(sec)):
        return None
    return sec[8:-4]


KNOWN = {PAT[5 : 5 + 16].tobytes(), PMT[5 : 5 + 21].tobytes()}


def counter_gaps(packets: np.ndarray) -> int:
    """Breaks in the continuity of a table's packets: a counter that is neither the next one, nor the same of the same packet again."""
    step = np.diff(packets[packets[:, 3] & 0x10 != 0][:, 3].astype(np.int64) & 15) % 16
    return int(((step != 1) & (step != 0)).sum())


def read_stream(media: bytes) -> Stream:
    """Follow the program tables to the first elementary stream and reassemble its units."""
    out = Stream()
    rows, out.out_of_step = in_step(media)
    out.packets = len(rows)
    wrong = rows[:, 1] & 0x80 != 0
    out.flagged = int(wrong.sum())
    number = np.flatnonzero(~wrong)
    rows = rows[number]
    pids = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    start = rows[:, 1] & 0x40 != 0
    bodies = lambda pid: (b for i in np.flatnonzero((pids == pid) & start) if (b := table_body(rows[i])) is not None)
    for body in bodies(PAT_PID):
        entry = next((body[i : i + 4] for i in range(0, len(body) - 3, 4) if body[i : i + 2] != b"\0\0"), None)
        if entry:
            out.program, table = int.from_bytes(entry[:2]), int.from_bytes(entry[2:]) & 0x1FFF
            out.table_gaps = sum(counter_gaps(rows[pids == p]) for p in (PAT_PID, table))
            for inner in bodies(table):
                at = 4 + (int.from_bytes(inner[2:4]) & 0xFFF)
                if at + 5 <= len(inner):
                    out.stream_type, out.pid = inner[at], int.from_bytes(inner[at + 1 : at + 3]) & 0x1FFF
                    break
            break
    if out.pid is None:
        return out
    mine = pids == out.pid
    number, rows, start = number[mine], rows[mine], start[mine]
    has_field, has_data = rows[:, 3] & 0x20 != 0, rows[:, 3] & 0x10 != 0
    number, rows, start, has_field = number[has_data], rows[has_data], start[has_data], has_field[has_data]
    if not len(rows):
        return out
    counter = (rows[:, 3] & 15).astype(np.int64)
    step = np.diff(counter) % 16
    same = np.concatenate([[False], (step == 0) & (rows[1:] == rows[:-1]).all(axis=1)]) if (step == 0).any() else np.zeros(len(rows), bool)
    if same.any():
        number, rows, start, has_field, counter = (x[~same] for x in (number, rows, start, has_field, counter))
        step = np.diff(counter) % 16
    size = np.where(has_field, rows[:, 4].astype(np.int64) + 1, 0)
    flags = np.where(has_field & (rows[:, 4] > 0), rows[:, 5], 0)
    gap = np.concatenate([[False], (step != 1) & (flags[1:] & 0x80 == 0)])
    out.gaps = int(gap.sum())
    offset = np.minimum(4 + size, PACKET)
    data = rows[np.arange(PACKET) >= offset[:, None]].tobytes()
    edges = np.concatenate([[0], np.cumsum(PACKET - offset)])
    firsts = np.flatnonzero(start)
    payload = []
    for a, b in zip(firsts, [*firsts[1:], len(rows)], strict=True):
        pes = data[edges[a] : edges[b]]
        stated = int.from_bytes(pes[4:6]) if len(pes) >= 9 else 0
        body = 9 + pes[8] if len(pes) >= 9 else 0
        if len(pes) < 9 or pes[:3] != b"\0\0\1" or gap[a + 1 : b].any() or (stated and len(pes) != stated + 6):
            out.broken_units += 1
            continue
        out.timestamps.append(timestamp_of(pes[9:14]) if pes[7] & 0x80 else None)
        out.random_access.append(bool(flags[a] & 0x40))
        out.first_packet.append(int(number[a]))
        out.sizes.append(len(pes) - body)
        payload.append(pes[body:])
    out.payload = b"".join(payload)
    return out


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with bytes 255 up to a positive multiple of BLOCK, and their count before that."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK), len(raw)


def as_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a transport stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [padded(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [n for _, n in pairs], "media": [write_stream(p) for p, _ in pairs]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInPandas(run, "doc_id long, n_bytes long, media binary")


UNIT_COLUMNS = "unit int, timestamp long, random_access boolean, first_packet long, n_bytes long"


def media_units(media: DataFrame) -> DataFrame:
    """(doc_id, program, pid, stream_type, packets, gaps, broken_units, units array, payload) of every (doc_id, media)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read_stream(bytes(m or b"")) for m in batch["media"]]
            units = [[{"unit": i, "timestamp": t, "random_access": r, "first_packet": p, "n_bytes": n} for i, (t, r, p, n) in enumerate(zip(s.timestamps, s.random_access, s.first_packet, s.sizes, strict=True))] for s in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"]} | {k: pd.array([getattr(s, k) for s in found], dtype="Int64") for k in ("program", "pid", "stream_type", "packets", "gaps", "broken_units")} | {"units": units, "payload": [s.payload for s in found]})

    return media.select("doc_id", "media").mapInPandas(run, f"doc_id long, program long, pid long, stream_type long, packets long, gaps long, broken_units long, units array<struct<{UNIT_COLUMNS.replace(' ', ':').replace(',:', ',')}>>, payload binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Digests of every stored stream and of the payload read back from it, with the timestamps of its units and the places of its random-access points."""
    columns = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, table_gaps long, units long, timestamps array<long>, access_units array<int>, access_packets array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for blob in batch["media"]:
                blob = bytes(blob)
                found = read_stream(blob)
                access = [i for i, r in enumerate(found.random_access) if r]
                digest = len(found.payload), hashlib.sha256(found.payload).hexdigest(), zlib.crc32(found.payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest()
                out.append((*digest, found.feature, found.table_gaps, len(found.sizes), found.timestamps, access, [found.first_packet[i] for i in access]))
            digests = pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "table_gaps", "units", "timestamps", "access_units", "access_packets"])
            yield pd.concat([batch[["doc_id", "n_bytes"]].reset_index(drop=True), digests], axis=1)

    return media.select("doc_id", "n_bytes", "media").mapInPandas(run, columns)


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(cut(as_media(documents(spark, sf_dir)), "media"))
