"""Byte codecs of small things: varints, bit packing, run-length bitmaps, zstd."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

# Fixed values of the run-length encoding.
MOST_RAW, LEAST_REPEAT, MOST_REPEAT, MOST_GAP = 128, 18, 145, 255
SPARSE_FACTOR = 1.1


def compress(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def uncompress(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def varint(value: int) -> bytes:
    """Seven bits a byte, the lowest first, the high bit set on all but the last."""
    if not 0 <= value < 1 << 64:
        raise ValueError("varints hold 0 to 2**64 - 1")
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The value, and where the next begins."""
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return value, at


def put_string(text: bytes) -> bytes:
    return varint(len(text)) + text


def read_string(data: bytes, at: int = 0) -> tuple[bytes, int]:
    n, at = read_varint(data, at)
    return data[at : at + n], at + n


def put_number(value: int | float, kind: str) -> bytes:
    """kind: i4, u4, i8, u8, f4 or f8, little-endian."""
    return struct.pack("<" + {"i4": "i", "u4": "I", "i8": "q", "u8": "Q", "f4": "f", "f8": "d"}[kind], value)


def bit_width(value: int) -> int:
    return int(value).bit_length()


def max_bit_width(values: np.ndarray) -> int:
    return bit_width(int(values.max())) if len(values) else 0


def bytes_required(bits: int) -> int:
    return -(-bits // 8)


def bit_pack(values: np.ndarray, width: int) -> bytes:
    """The lowest width bits of each value, back to back, low bits first."""
    if width == 0 or not len(values):
        return b""
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def bit_unpack(data: bytes, width: int, count: int, start: int = 0) -> np.ndarray:
    """count values from number start on."""
    if width == 0:
        return np.zeros(count, dtype=np.uint64)
    first, last = start * width, (start + count) * width
    raw = np.frombuffer(data, np.uint8)[first // 8 : bytes_required(last)]
    bits = np.unpackbits(raw, bitorder="little")[first % 8 : first % 8 + count * width]
    weights = np.uint64(1) << np.arange(width, dtype=np.uint64)
    return (bits.reshape(count, width).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)


def dense_encode(bits: np.ndarray) -> bytes:
    """A bit count, then the bits packed."""
    return struct.pack("<I", len(bits)) + np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def dense_decode(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", data)
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=4), count=n, bitorder="little")


def runs_of(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bits of the runs of equal bits."""
    if not len(bits):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    edges = np.flatnonzero(np.diff(bits)) + 1
    starts = np.concatenate(([0], edges))
    return np.diff(np.append(starts, len(bits))), bits[starts]


def runs_between(ones: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """runs_of a bitmap of so many bits with these ones, from their places alone."""
    if not len(ones):
        return np.array([size] if size else [], np.int64), np.zeros(min(size, 1), np.uint8)
    breaks = np.flatnonzero(np.diff(ones) > 1)
    begins, ends = np.append(ones[0], ones[breaks + 1]), np.append(ones[breaks], ones[-1]) + 1
    edges = np.stack([begins, ends], axis=1).ravel()
    lengths = np.diff(edges, prepend=0, append=size)
    bits = np.arange(len(lengths)) % 2
    return lengths[lengths > 0].astype(np.int64), bits[lengths > 0].astype(np.uint8)


def sparse_gaps(ones: np.ndarray, size: int) -> np.ndarray:
    """Gaps from one to one up to 255 long; 0 skips 255 positions; a one behind the end is
    thought of, so that trailing zeros are kept."""
    gaps = np.diff(np.append(ones, size), prepend=-1)
    skips = (gaps - 1) // MOST_GAP
    out = np.zeros(len(gaps) + int(skips.sum()), np.uint64)
    out[np.arange(len(gaps)) + np.cumsum(skips)] = gaps - skips * MOST_GAP
    return out


def dense_runs(lengths: np.ndarray, bits: np.ndarray) -> list[tuple[str, int, int]]:
    """(`repeat`, bit, length) for long runs and (`raw`, start, length) for what lies between."""
    out: list[tuple[str, int, int]] = []
    raw_at, at = 0, 0

    def raw(until: int) -> None:
        nonlocal raw_at
        while raw_at < until:
            n = min(MOST_RAW, until - raw_at)
            out.append(("raw", raw_at, n))
            raw_at += n

    for n, bit in zip(lengths.tolist(), bits.tolist(), strict=True):
        left = n
        if n >= LEAST_REPEAT:
            raw(at)
            while left >= LEAST_REPEAT:
                k = min(MOST_REPEAT, left)
                out.append(("repeat", bit, k))
                left -= k
            raw_at = at + n - left
        at += n
    raw(at)
    return out


class RleBitmap:
    """An immutable compressed bitmap, sparse or dense, with offsets to skip to.

    Sparse where that is the smaller: fewer ones than 1.1 times the dense runs plus an eighth
    of the bits. Offsets are kept for about every square root of the runs. It is made from the
    places of the ones; a repeated bit stands among the raw bits, where its run begins."""

    def __init__(self, bits: np.ndarray) -> None:
        self._make(np.flatnonzero(np.asarray(bits)), len(bits))

    @classmethod
    def from_ones(cls, ones: np.ndarray, size: int) -> "RleBitmap":
        out = cls.__new__(cls)
        out._make(np.asarray(ones, np.int64), size)
        return out

    def _make(self, ones: np.ndarray, size: int) -> None:
        self.size = size
        self.sparse = len(ones) < size / 8
        if not self.sparse:
            dense = dense_runs(*runs_between(ones, size))
            self.sparse = len(ones) < SPARSE_FACTOR * len(dense) + size / 8
        if self.sparse:
            self.codes = sparse_gaps(ones, size)
            self.raw = b""
            steps = np.where(self.codes == 0, MOST_GAP, self.codes).astype(np.int64)
        else:
            codes, raw = [], []
            for kind, a, n in dense:
                if kind == "raw":
                    codes.append((n - 1) << 1)
                    part = np.zeros(n, np.uint8)
                    part[ones[np.searchsorted(ones, a) : np.searchsorted(ones, a + n)] - a] = 1
                    raw.append(part)
                else:
                    codes.append((n - LEAST_REPEAT) << 1 | 1)
                    raw.append(np.array([a], np.uint8))
            self.codes = np.array(codes, np.uint64)
            self.raw = np.packbits(np.concatenate(raw) if raw else np.zeros(0, np.uint8), bitorder="little").tobytes()
            steps = np.array([n for _, _, n in dense], np.int64)
        self.stride = max(1, int(np.sqrt(len(self.codes))))
        self.skips = np.concatenate(([0], np.cumsum(steps)))[:: self.stride]

    def encode(self) -> bytes:
        """Header, packed codes, packed skip offsets and raw bits, all in one."""
        width, skip_width = max_bit_width(self.codes), max_bit_width(self.skips)
        head = b"".join(varint(v) for v in (int(self.sparse), self.size, len(self.codes), width, len(self.skips), skip_width))
        return head + bit_pack(self.codes, width) + bit_pack(self.skips, skip_width) + self.raw

    @classmethod
    def decode(cls, data: bytes) -> "RleBitmap":
        at, head = 0, []
        for _ in range(6):
            v, at = read_varint(data, at)
            head.append(v)
        out = cls.__new__(cls)
        out.sparse, out.size, n, width, skips, skip_width = bool(head[0]), *head[1:]
        out.codes = bit_unpack(data[at:], width, n)
        at += bytes_required(n * width)
        out.skips = bit_unpack(data[at:], skip_width, skips).astype(np.int64)
        out.raw = data[at + bytes_required(skips * skip_width) :]
        out.stride = max(1, int(np.sqrt(n)))
        return out

    def extract(self, offset: int, size: int) -> np.ndarray:
        """Bits offset to offset + size - 1; decoding starts at the skip offset before them."""
        if offset < 0 or offset + size > self.size:
            raise IndexError("the slice leaves the bitmap")
        out = np.zeros(size, np.uint8)
        if not size:
            return out
        k = int(np.searchsorted(self.skips, offset, side="right")) - 1
        i, at = k * self.stride, int(self.skips[k])
        if self.sparse:
            at -= 1
            for code in self.codes[i:].tolist():
                at += code or MOST_GAP
                if code and at >= offset + size:
                    break
                if code and at >= offset:
                    out[at - offset] = 1
            return out
        before = self.codes[:i]
        raw_at = int(np.where(before & np.uint64(1), 1, (before >> np.uint64(1)) + np.uint64(1)).sum())
        raw = np.unpackbits(np.frombuffer(self.raw, np.uint8), bitorder="little")
        for code in self.codes[i:].tolist():
            if at >= offset + size:
                break
            if code & 1:
                n = (code >> 1) + LEAST_REPEAT
                part = np.full(n, raw[raw_at], np.uint8)
                raw_at += 1
            else:
                n = (code >> 1) + 1
                part = raw[raw_at : raw_at + n]
                raw_at += n
            lo, hi = max(at, offset), min(at + n, offset + size)
            if lo < hi:
                out[lo - offset : hi - offset] = part[lo - at : hi - at]
            at += n
        return out

    def ones(self) -> np.ndarray:
        """The places of all ones."""
        codes = self.codes.astype(np.int64)
        if self.sparse:  # the last one is the one thought of behind the end
            return (np.cumsum(np.where(codes == 0, MOST_GAP, codes)) - 1)[codes != 0][:-1]
        repeat, n = codes & 1 == 1, (codes >> 1) + np.where(codes & 1, LEAST_REPEAT, 1)
        used = np.where(repeat, 1, n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum(used) - used, n) + np.where(np.repeat(repeat, n), 0, within)
        return np.flatnonzero(np.unpackbits(np.frombuffer(self.raw, np.uint8), bitorder="little")[at])

    def get(self, pos: int) -> bool:
        return bool(self.extract(pos, 1)[0])


def roaring_containers(ones: np.ndarray) -> bytes:
    """The ones' containers back to back, without heads: for each 2**16 positions the least of a
    list of 16-bit places, 8192 bytes of bits, and runs (their number, starts and lengths)."""
    out = []
    edges = np.flatnonzero(np.diff(ones >> 16)) + 1
    for part in np.split(ones, edges) if len(ones) else []:
        low = (part & 0xFFFF).astype(np.int64)
        starts = np.flatnonzero(np.diff(low, prepend=-2) > 1)
        n, runs = len(low), len(starts)
        if 2 + 4 * runs < min(2 * n, 8192):
            lengths = np.diff(starts, append=n) - 1
            out.append(np.concatenate(([runs], np.stack([low[starts], lengths], axis=1).ravel())).astype("<u2").tobytes())
        elif 2 * n <= 8192:
            out.append(low.astype("<u2").tobytes())
        else:
            bits = np.zeros(1 << 16, np.uint8)
            bits[low] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
    return b"".join(out)
