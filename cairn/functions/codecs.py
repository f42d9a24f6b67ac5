"""Encodings of a sorted set of integer keys. Each has ``encode(sorted distinct keys) -> bytes`` and ``decode``.

All hold the same set exactly, so a lookup is a decode and a binary search; in the fast formats only of the runs that the keys
fall into (``FINDERS``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

COHORT = 128


def _deltas(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.zeros(1, dtype=keys.dtype))


def varints(values: np.ndarray) -> bytes:
    """Groups of seven bits, least first, the high bit set on all but the last byte; in passes over all values at once."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), dtype=np.int64)
    for g in range(1, 5):
        width += values >= (np.uint64(1) << np.uint64(7 * g))
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), dtype=np.uint8)
    for g in range(5):
        has = width > g
        group = ((values[has] >> np.uint64(7 * g)) & np.uint64(127)).astype(np.uint8)
        out[at[has] + g] = group | np.where(width[has] > g + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    last = (raw & np.uint64(128)) == 0
    group = np.concatenate([[0], np.cumsum(last)[:-1]]).astype(np.int64) if len(raw) else np.zeros(0, dtype=np.int64)
    start = np.zeros(int(last.sum()), dtype=np.int64)
    start[1:] = np.nonzero(last)[0][:-1] + 1
    out = np.zeros(len(start), dtype=np.uint64)
    np.add.at(out, group, (raw & np.uint64(127)) << ((np.arange(len(raw)) - start[group]) * 7).astype(np.uint64))
    return out.astype(np.int64)


def _vb(keys: np.ndarray) -> bytes:
    return varints(_deltas(keys))


def _from_vb(data: bytes) -> np.ndarray:
    return np.cumsum(from_varints(data))


def _vb_plus(keys: np.ndarray) -> bytes:
    """One byte for each delta below 255, else 255 and the rest as a varint."""
    d = _deltas(keys)
    wide = np.nonzero(d >= 255)[0]
    low = np.minimum(d, 255).astype(np.uint8).tobytes()
    out, at = [], 0
    for i, rest in zip(wide.tolist(), (d[wide] - 254).tolist(), strict=True):
        out += [low[at : i + 1], varints(np.array([rest]))]
        at = i + 1
    return b"".join([*out, low[at:]])


def _from_vb_plus(data: bytes) -> np.ndarray:
    """Stretches of single bytes are read at once, only wide deltas one by one."""
    out, i = [np.zeros(0, dtype=np.int64)], 0
    while i < len(data):
        wide = data.find(b"\xff", i)
        stop = len(data) if wide < 0 else wide
        out.append(np.frombuffer(data, dtype=np.uint8, count=stop - i, offset=i).astype(np.int64))
        i = stop
        if wide >= 0:
            d, shift = 254, 0
            while True:
                i += 1
                d += (data[i] & 127) << shift
                shift += 7
                if data[i] < 128:
                    break
            out.append(np.array([d], dtype=np.int64))
            i += 1
    return np.cumsum(np.concatenate(out))


def _packed(keys: np.ndarray) -> bytes:
    """Cohorts of deltas, each packed at the width of its widest; a byte gives the width (1 at least)."""
    out, d = [], _deltas(keys)
    for i in range(0, len(d), COHORT):
        part = d[i : i + COHORT]
        width = max(1, int(part.max()).bit_length())
        bits = (part[:, None] >> np.arange(width - 1, -1, -1)) & 1
        out.append(bytes([width]) + np.packbits(bits.astype(np.uint8).ravel()).tobytes())
    return b"".join(out)


def _from_packed(data: bytes) -> np.ndarray:
    out, i = [np.zeros(0, dtype=np.int64)], 0
    while i < len(data):
        width = data[i]
        whole = COHORT * width // 8
        body = data[i + 1 : i + 1 + whole]
        bits = np.unpackbits(np.frombuffer(body, dtype=np.uint8)).astype(np.int64)
        rows = bits[: len(bits) // width * width].reshape(-1, width)
        out.append(rows @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64)))
        i += 1 + whole
    # the padding of the last byte reads as repeats of the last key
    return np.unique(np.cumsum(np.concatenate(out)))


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First key, place and size of each run."""
    n = int.from_bytes(data[:4], "little")
    marks = np.frombuffer(data, dtype="<u4", count=2 * n, offset=4).reshape(n, 2).astype(np.int64)
    return marks[:, 0], 4 + 8 * n + np.cumsum(marks[:, 1]) - marks[:, 1], marks[:, 1]


def _with_marks(body: Callable, parts: Callable, every: int) -> tuple[Callable, Callable, Callable]:
    """A codec of runs of ``every`` keys, each with its first key and place up front, and a search that decodes only the runs it meets."""

    def encode(keys: np.ndarray) -> bytes:
        runs = [keys[i : i + every] for i in range(0, len(keys), every)]
        encoded = [body(r - r[0]) for r in runs]
        marks = np.array([[r[0], len(e)] for r, e in zip(runs, encoded, strict=True)], dtype="<u4").reshape(-1, 2)
        return len(runs).to_bytes(4, "little") + marks.tobytes() + b"".join(encoded)

    def run(data: bytes, first: int, at: int, size: int) -> np.ndarray:
        return parts(data[at : at + size]) + first

    def decode(data: bytes) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=np.int64), *(run(data, *m) for m in zip(*(x.tolist() for x in _marks(data)), strict=True))])

    def find(data: bytes, keys: np.ndarray) -> np.ndarray:
        firsts, at, sizes = _marks(data)
        out = np.zeros(len(keys), dtype=bool)
        own = np.searchsorted(firsts, keys, "right") - 1
        for i in np.unique(own[own >= 0]).tolist():
            here = np.nonzero(own == i)[0]
            out[here] = np.isin(keys[here], run(data, int(firsts[i]), int(at[i]), int(sizes[i])))
        return out

    return encode, decode, find


def _roaring(keys: np.ndarray) -> bytes:
    """256 keys a bucket: pairs (bucket, count) as varints, then the low bytes."""
    buckets, counts = np.unique(keys >> 8, return_counts=True)
    head = varints(np.column_stack([_deltas(buckets), counts]).ravel())
    return len(head).to_bytes(4, "little") + head + (keys & 255).astype(np.uint8).tobytes()


def _from_roaring(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    head = from_varints(data[4 : 4 + n]).reshape(-1, 2)
    low = np.frombuffer(data, dtype=np.uint8, offset=4 + n).astype(np.int64)
    return (np.repeat(np.cumsum(head[:, 0]), head[:, 1]) << 8) | low


def _bits(keys: np.ndarray) -> bytes:
    out = np.zeros(int(keys[-1]) + 1 if len(keys) else 0, dtype=np.uint8)
    out[keys] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _from_bits(data: bytes) -> np.ndarray:
    return np.nonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little"))[0].astype(np.int64)


_FAST_VB_PLUS, _FAST_PACKED = _with_marks(_vb_plus, _from_vb_plus, 1024), _with_marks(_packed, _from_packed, 1024)
BITMAPS: dict[str, tuple[Callable[[np.ndarray], bytes], Callable[[bytes], np.ndarray]]] = {
    "uncompressed": (_bits, _from_bits),
    "roar": (_roaring, _from_roaring),
    "vb": (_vb, _from_vb),
    "vb+": (_vb_plus, _from_vb_plus),
    "fast-vb+": _FAST_VB_PLUS[:2],
    "p-f-delta": (_packed, _from_packed),
    "fast-p-f-delta": _FAST_PACKED[:2],
}
FINDERS: dict[str, Callable[[bytes, np.ndarray], np.ndarray]] = {"fast-vb+": _FAST_VB_PLUS[2], "fast-p-f-delta": _FAST_PACKED[2]}
