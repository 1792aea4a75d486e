"""Blocks of token ids under an adaptive context-mixing range coder; numpy only, no Spark.

A block resets all of its model. Its ids are cut into lanes, equal runs that are coded in step: at step i the i-th
id of every lane is coded, each lane by a range coder of its own, and then the model that the lanes share
learns from all of them. The decoder sees the same ids in the same order, so it repeats every step.

Model of an id: the order-2 context (hashed) and the order-1 context each predict one id with a confidence. How
often each of them, or neither, was right is counted per pair of confidences; these counts mix them into the
probabilities of three events, and the last one's share of the range is split by the order-0 counts of the ids.

Layout, little-endian: magic QTB1; u32 documents, u64 ids, u32 lanes, u32 ids in the model, u32 crc32 of the ids as u32;
then three sections, each with a u64 length: document index (zlib: null flags, doc_ids, id counts), words per lane
(zlib u32), words (u16); last u32 crc32 of everything before it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"QTB1"
HEAD = struct.Struct("<4sIQIII")
LANES, LANE_IDS = 4096, 256
ORDER2_BITS = 18
#: Most steps between two renewals of the order-0 table, and of the event table.
RENEW, RECOUNT = 32, 4
#: Bits of an event's and of an order-0 frequency; a symbol's share of the range is their product.
EVENT_BITS, ID_BITS = 12, 18
_SHIFT = np.uint64(EVENT_BITS + ID_BITS)
_MASK, _TOP, _BOT = np.uint64((1 << 48) - 1), np.uint64(1 << 32), np.uint64(1 << 30)
_16, _32, _ID = np.uint64(16), np.uint64(32), np.uint64(ID_BITS)
_BINS = 128


def _lanes(n: int) -> tuple[int, int]:
    """(lanes, ids per lane); only the last lane may be shorter."""
    each = -(-n // max(1, min(LANES, n // LANE_IDS)))
    return -(-n // each), each


class Model:
    """What encoder and decoder share: contexts with their predictions and confidences, and counts.

    A context's entry is 8 times the predicted id plus one, plus the confidence from 1 to 7; 0 is unused.
    """

    def __init__(self, lanes: int, size: int) -> None:
        self.order1, self.order2 = np.zeros(size, np.int32), np.zeros(1 << ORDER2_BITS, np.int32)
        self.last, self.before = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.events = np.ones((_BINS, 3), np.int64)
        self.ids = np.ones(size, np.int64)
        self.seen: list[np.ndarray] = []
        self.missed: list[np.ndarray] = []
        self.steps = 0
        self.recount()
        self.renew()

    def recount(self) -> None:
        """Start and size of the three events of each bin, at 4 times the bin plus the event."""
        if self.seen:
            self.events += np.bincount(np.concatenate(self.seen), minlength=4 * _BINS).reshape(_BINS, 4)[:, :3]
            self.seen = []
            if self.events.max() > 1 << 16:
                self.events = (self.events >> 1) + 1
        share = 1 + self.events * ((1 << EVENT_BITS) - 3) // self.events.sum(1, keepdims=True)
        starts, sizes = np.zeros((_BINS, 4), np.uint64), np.zeros((_BINS, 4), np.uint64)
        starts[:, 1:] = share.cumsum(1)
        sizes[:, :3] = share
        self.event_starts, self.event_sizes = starts.ravel(), sizes.ravel()

    def renew(self) -> None:
        """Start and size of the ids by the order-0 counts, and the id at each place between them."""
        if self.missed:
            self.ids += 32 * np.bincount(np.concatenate(self.missed), minlength=len(self.ids))
            self.missed = []
        share = 1 + self.ids * ((1 << ID_BITS) - len(self.ids)) // self.ids.sum()
        ends = np.zeros(len(share) + 1, np.int64)
        np.cumsum(share, out=ends[1:])
        self.id_starts, self.id_sizes = ends[:-1].astype(np.uint64), share.astype(np.uint64)
        self.id_at: np.ndarray | None = None

    def id_of(self, at: np.ndarray) -> np.ndarray:
        """The ids at places between the bounds."""
        if self.id_at is None:
            self.id_at = np.repeat(np.arange(len(self.id_sizes), dtype=np.int32), self.id_sizes.astype(np.int64))
        return self.id_at[np.minimum(at, np.uint64(len(self.id_at) - 1))]

    def contexts(self, n: int) -> tuple[np.ndarray, ...]:
        """For the first n lanes: slots and entries of both orders, their predictions, and 4 times the bin of the events."""
        s1 = self.last[:n]
        s2 = (self.before[:n].view(np.uint32) * np.uint32(0x9E3779B1) ^ s1.view(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(32 - ORDER2_BITS)
        e1, e2 = self.order1[s1], self.order2[s2]
        p1, p2 = (e1 >> 3) - 1, (e2 >> 3) - 1
        return s1, s2, e1, e2, p1, p2, ((e1 & 7) << 2) | ((e2 & 7) << 5) | ((p1 == p2).astype(np.int32) << 8)

    def learn(self, n: int, state: tuple[np.ndarray, ...], ids: np.ndarray, slot: np.ndarray, missed: np.ndarray) -> None:
        s1, s2, e1, e2, p1, p2, _ = state
        fresh = (ids + 1) << 3 | 1
        for at, entry, guess, table in ((s1, e1, p1, self.order1), (s2, e2, p2, self.order2)):
            sure = entry & 7
            wrong = np.where(sure <= 1, fresh, entry - sure + (sure >> 1))
            table[at] = np.where(guess == ids, entry + (sure < 7), wrong)
        self.seen.append(slot)
        self.missed.append(missed)
        self.before[:n] = s1
        self.last[:n] = ids
        self.steps += 1
        if self.steps % RECOUNT == 0 or self.steps < RECOUNT:
            self.recount()
        if self.steps % RENEW == 0 or self.steps in (1, 2, 4, 8, 16):
            self.renew()


def _settle(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The lanes whose top word is decided; where the range got too narrow it is cut so that it is."""
    settled = (low ^ (low + span)) < _TOP
    narrow = span < _BOT
    if narrow.any():
        narrow &= ~settled
        span[narrow] = (~low[narrow] + np.uint64(1)) & (_BOT - np.uint64(1))
        settled |= narrow
    return np.flatnonzero(settled)


class _Encoder:
    def __init__(self, lanes: int, words: int) -> None:
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, _MASK)
        self.out, self.at = np.zeros((lanes, words), np.uint16), np.zeros(lanes, np.int64)
        self.written = 0

    def room(self) -> None:
        self.written += 1
        if self.written + 4 >= self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], 1)

    def put(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        """One symbol for each of the first n lanes, of frequency ``size`` after ``start``."""
        unit = self.range[:n] >> _SHIFT
        low, span = self.low[:n] + unit * start, unit * size
        while len(go := _settle(low, span)):
            self.room()
            some = low[go]
            self.out[go, self.at[go]] = some >> _32
            self.at[go] += 1
            low[go] = (some << _16) & _MASK
            span[go] <<= _16
        self.low[:n], self.range[:n] = low, span

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(self.at))
        for shift in (32, 16, 0):
            self.room()
            self.out[rows, self.at] = (self.low >> np.uint64(shift)) & np.uint64(0xFFFF)
            self.at += 1
        return self.at, self.out[np.arange(self.out.shape[1])[None, :] < self.at[:, None]]


class _Decoder:
    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        self.words = np.concatenate([words, np.zeros(4, np.uint16)]).astype(np.uint64)
        self.at = np.cumsum(sizes) - sizes
        self.low, self.range = np.zeros(len(sizes), np.uint64), np.full(len(sizes), _MASK)
        self.code = np.zeros(len(sizes), np.uint64)
        for _ in range(3):
            self.code = self.code << _16 | self.words[self.at]
            self.at += 1

    def seek(self, n: int) -> np.ndarray:
        """At which frequency the next symbol of each of the first n lanes lies."""
        self.unit = self.range[:n] >> _SHIFT
        return (self.code[:n] - self.low[:n]) // self.unit

    def take(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        low, span, code = self.low[:n] + self.unit * start, self.unit * size, self.code[:n]
        while len(go := _settle(low, span)):
            code[go] = ((code[go] << _16) & _MASK) | self.words[np.minimum(self.at[go], len(self.words) - 1)]
            self.at[go] += 1
            low[go] = (low[go] << _16) & _MASK
            span[go] <<= _16
        self.low[:n], self.range[:n] = low, span


def encode_ids(ids: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(lanes, ids in the model, words per lane, words) of ids below 2**(ID_BITS - 1)."""
    if not len(ids):
        return 0, 0, np.zeros(0, np.int64), np.zeros(0, np.uint16)
    size = int(ids.max()) + 1
    if size > 1 << (ID_BITS - 1):
        raise ValueError(f"ids of {1 << (ID_BITS - 1)} and more are not supported")
    lanes, each = _lanes(len(ids))
    grid = np.zeros(lanes * each, np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, each).T)
    last = len(ids) - (lanes - 1) * each
    model, coder = Model(lanes, size), _Encoder(lanes, each + 16)
    for step in range(each):
        n = lanes if step < last else lanes - 1
        now = grid[step, :n]
        state = model.contexts(n)
        event = (state[4] == now).astype(np.int32)
        event[state[5] == now] = 2
        slot = state[6] + event
        start, size = model.event_starts[slot], model.event_sizes[slot]
        miss = np.flatnonzero(event == 0)
        missed = now[miss]
        start <<= _ID
        share = size[miss]
        size <<= _ID
        start[miss] += share * model.id_starts[missed]
        size[miss] = share * model.id_sizes[missed]
        coder.put(n, start, size)
        model.learn(n, state, now, slot, missed)
    sizes, words = coder.end()
    return lanes, len(model.ids), sizes, words


def decode_ids(count: int, lanes: int, size: int, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    if not count:
        return np.zeros(0, np.int64)
    each = _lanes(count)[1]
    last = count - (lanes - 1) * each
    grid = np.zeros((each, lanes), np.int32)
    model, coder = Model(lanes, size), _Decoder(sizes, words)
    for step in range(each):
        n = lanes if step < last else lanes - 1
        state = model.contexts(n)
        at = coder.seek(n)
        whole, where = at >> _ID, state[6]
        slot = where + (whole >= model.event_starts[where + 1]) + (whole >= model.event_starts[where + 2])
        event = slot - where
        start, size = model.event_starts[slot] << _ID, model.event_sizes[slot]
        now = np.where(event == 2, state[5], state[4])
        miss = np.flatnonzero(event == 0)
        share = size[miss]
        size <<= _ID
        missed = model.id_of((at[miss] - start[miss]) // share)
        now[miss] = missed
        start[miss] += share * model.id_starts[missed]
        size[miss] = share * model.id_sizes[missed]
        coder.take(n, start, size)
        grid[step, :n] = now
        model.learn(n, state, now, slot, missed)
    return grid.T.ravel()[:count].astype(np.int64)


def write_block(doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A block of whole documents: their ids (int64, any value where ``null``), id counts and all token ids."""
    lanes, size, sizes, words = encode_ids(ids)
    head = HEAD.pack(MAGIC, len(counts), len(ids), lanes, size, zlib.crc32(ids.astype("<u4").tobytes()))
    index = zlib.compress(null.astype(np.uint8).tobytes() + doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes(), 1)
    parts = [head]
    for section in (index, zlib.compress(sizes.astype("<u4").tobytes(), 1), words.astype("<u2").tobytes()):
        parts += [struct.pack("<Q", len(section)), section]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``write_block`` was given; ValueError if a checksum doesn't fit."""
    if len(block) < HEAD.size + 28 or block[:4] != MAGIC or struct.unpack("<I", block[-4:])[0] != zlib.crc32(memoryview(block)[:-4]):
        raise ValueError("damaged block")
    _, docs, count, lanes, model, crc = HEAD.unpack_from(block)
    at, sections = HEAD.size, []
    for _ in range(3):
        (size,) = struct.unpack_from("<Q", block, at)
        sections.append(block[at + 8 : at + 8 + size])
        at += 8 + size
    index = zlib.decompress(sections[0])
    null = np.frombuffer(index, np.uint8, docs).astype(bool)
    doc_ids, counts = np.frombuffer(index, "<i8", docs, docs), np.frombuffer(index, "<u4", docs, 9 * docs)
    ids = decode_ids(count, lanes, model, np.frombuffer(zlib.decompress(sections[1]), "<u4").astype(np.int64), np.frombuffer(sections[2], "<u2"))
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("ids don't fit their checksum")
    return doc_ids.astype(np.int64), null, counts.astype(np.int64), ids
