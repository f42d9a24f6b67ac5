"""Approximate membership: Bloom and cuckoo filters over byte keys, and a registry of filter kinds."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import xxhash

from cairn.functions.codecs import BITMAPS, FINDERS

_LOW = 0xFFFFFFFF
STALL = 16  # moves in which a quarter of the entries in hand must find a home


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))


def _ranks(*by: np.ndarray) -> np.ndarray:
    """The place of each entry in its run of equal ones."""
    at = np.arange(len(by[0]))
    first = np.ones(len(at), dtype=bool)
    first[1:] = np.any([np.diff(x) != 0 for x in by], axis=0)
    return at - np.maximum.accumulate(np.where(first, at, 0))


class Filter:
    """A kind of filter: ``build(keys) -> bytes``; ``opened(data)`` is read once and then asked about any number of keys."""

    def opened(self, data: bytes) -> Callable[[list[bytes]], np.ndarray]:
        raise NotImplementedError

    def matches(self, data: bytes, keys: list[bytes]) -> np.ndarray:
        return self.opened(data)(keys)


class Bloom(Filter):
    """Bytes of bits, the last byte is the number of probes. Unreadable filters match everything."""

    def __init__(self, bits_per_key: int = 8):
        self.bits_per_key = bits_per_key

    def build(self, keys: Iterable[bytes]) -> bytes:
        keys = list(keys)
        size = (max(64, len(keys) * self.bits_per_key) + 7) // 8
        probes = min(int(self.bits_per_key * 0.69) + 1, 30)
        on = np.zeros(size * 8, dtype=np.uint8)
        if keys:
            on[self._places(keys, probes, size * 8).ravel()] = 1
        return np.packbits(on, bitorder="little").tobytes() + bytes([probes])

    @staticmethod
    def _places(keys: list[bytes], probes: int, bits: int) -> np.ndarray:
        h = _hashes(keys)
        first, step = h & np.uint64(_LOW), h >> np.uint64(32)
        return (((first[:, None] + np.arange(probes, dtype=np.uint64) * step[:, None]) & np.uint64(_LOW)) % np.uint64(bits)).astype(np.int64)

    def opened(self, data: bytes) -> Callable[[list[bytes]], np.ndarray]:
        if len(data) < 2 or data[-1] > 30:
            return lambda keys: np.ones(len(keys), dtype=bool)
        on = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=len(data) - 1), bitorder="little")
        return lambda keys: on[self._places(keys, data[-1], len(on))].all(axis=1)


class Bitmap(Filter):
    """An exact set of the keys' first four bytes (least first), in one of seven formats."""

    def __init__(self, fmt: str = "uncompressed", key_bits: int = 24):
        self.fmt, self.key_bits = fmt, key_bits

    def build(self, keys: Iterable[bytes]) -> bytes:
        ints = np.unique(np.array([int.from_bytes(k[:4], "little") for k in keys], dtype=np.int64))
        if len(ints) and ints[-1] >> self.key_bits:
            raise ValueError(f"a key does not fit {self.key_bits} bits")
        return BITMAPS[self.fmt][0](ints)

    def opened(self, data: bytes) -> Callable[[list[bytes]], np.ndarray]:
        ints = lambda keys: np.array([int.from_bytes(k[:4], "little") for k in keys], dtype=np.int64)
        if self.fmt in FINDERS:
            return lambda keys: FINDERS[self.fmt](data, ints(keys))
        held = BITMAPS[self.fmt][1](data)
        return lambda keys: np.isin(ints(keys), held)


def fingerprint(h: int, bits: int) -> int:
    """The top bits of the hash, never 0."""
    return (h >> (64 - bits)) or 1


def other_bucket(i: int, mark: int) -> int:
    """The second home of a mark; applied twice it leads back (modulo a power of two)."""
    return i ^ (mark * 0x5BD1E995 & _LOW)


@dataclass
class Cuckoo(Filter):
    """Four marks a bucket, each with a value of ``value_bits``; what finds no home goes to a further table."""

    mark_bits: int = 12
    value_bits: int = 0
    fill: float = 0.95
    max_moves: int = 500
    seed: int = 301

    def build_tables(self, items: Iterable[tuple[bytes, int]]) -> list[np.ndarray]:
        """Tables of (buckets, 4): mark and value in one integer, 0 where free."""
        items = list(items)
        h, tables = _hashes([k for k, _ in items]), []
        values = np.fromiter((v & ((1 << self.value_bits) - 1) for _, v in items), dtype=np.int64, count=len(items))
        rng = np.random.default_rng(self.seed)
        while len(h):
            # both homes of a mark hold eight entries of it, so a table is not made for more
            n, held = 1, int(np.minimum(np.unique(h, return_counts=True)[1], 8).sum())
            while n * 4 * self.fill < held:
                n *= 2
            table, h, values = self._filled(h, values, n, rng)
            tables.append(table)
        return tables

    def _filled(self, h: np.ndarray, values: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(table of ``n`` buckets, hashes and values of what found no home): all entries without a home move at once, round by round."""
        mark = self._marks(h)
        entry, at = mark << self.value_bits | values, (h & np.uint64(n - 1)).astype(np.int64)
        pair = np.minimum(at, self._others(at, mark, n))
        order = np.lexsort((entry, pair))
        new = np.ones(len(h), dtype=bool)  # an entry that both its homes know already says nothing
        new[1:] = (np.diff(pair[order]) != 0) | (np.diff(entry[order]) != 0)
        order = order[new]
        rank = _ranks(pair[order], mark[order])
        fits = rank < np.where(self._others(at[order], mark[order], n) == at[order], 4, 8)
        over = order[~fits]  # would only drive out others of its own mark
        order = np.sort(order[fits])
        entry, at = entry[order], at[order]
        table, used = np.zeros((n, 4), dtype=np.int64), np.zeros(n, dtype=np.int64)
        before = len(at)
        for move in range(self.max_moves):
            for _ in range(2):  # its home, or else the other one
                by = np.argsort(at, kind="stable")
                entry, at = entry[by], at[by]
                slot = used[at] + _ranks(at)
                free = slot < 4
                table[at[free], slot[free]] = entry[free]
                np.add.at(used, at[free], 1)
                entry, at = entry[~free], at[~free]
                at = self._others(at, entry >> self.value_bits, n)
            if not len(at):
                break
            if move % STALL == STALL - 1:  # keys of several values crowd some homes: what they have too many of would move for ever
                if len(at) > 0.75 * before:
                    break
                before = len(at)
            by = np.argsort(at, kind="stable")
            entry, at = entry[by], at[by]
            rank = _ranks(at)
            moved = np.nonzero(rank < 4)[0]  # each drives out another entry of its bucket
            place = at[moved], (rng.integers(4, size=len(at))[moved - rank[moved]] + rank[moved]) % 4
            entry[moved], table[place] = table[place], entry[moved]
            at[moved] = self._others(at[moved], entry[moved] >> self.value_bits, n)
        # bucket ``at`` is a home of the entry in hand: in a smaller table its homes are the low bits
        low = np.uint64((1 << (64 - self.mark_bits)) - 1)
        left = (entry >> self.value_bits).astype(np.uint64) << np.uint64(64 - self.mark_bits) | at.astype(np.uint64) & low
        return table, np.concatenate([h[over], left]), np.concatenate([values[over], entry & ((1 << self.value_bits) - 1)])

    def _marks(self, h: np.ndarray) -> np.ndarray:
        """``fingerprint`` of many hashes."""
        return np.maximum(h >> np.uint64(64 - self.mark_bits), np.uint64(1)).astype(np.int64)

    @staticmethod
    def _others(i: np.ndarray, mark: np.ndarray, n: int) -> np.ndarray:
        """``other_bucket`` of many marks in a table of ``n`` buckets."""
        return (i ^ (mark * 0x5BD1E995 & _LOW)) & (n - 1)

    def _hits(self, tables: list[np.ndarray], keys: list[bytes]) -> Iterable[tuple[np.ndarray, np.ndarray]]:
        """For each table and home bucket: (entries, whether they bear the key's mark), both (keys, 4)."""
        h = _hashes(keys)
        mark = self._marks(h)
        for t in tables:
            i = (h & np.uint64(len(t) - 1)).astype(np.int64)
            for home in (i, self._others(i, mark, len(t))):
                entries = t[home]
                yield entries, entries >> self.value_bits == mark[:, None]

    def values(self, tables: list[np.ndarray], key: bytes) -> list[int]:
        """Candidate values of a key; every value put in is among them."""
        return self.values_of(tables, [key])[0]

    def values_of(self, tables: list[np.ndarray], keys: list[bytes]) -> list[list[int]]:
        """Candidate values of each key, sorted."""
        found: list[list[int]] = [[] for _ in keys]
        for row, value in zip(*(x.tolist() for x in self.pairs_of(tables, keys)), strict=True):
            found[row].append(value)
        return found

    def pairs_of(self, tables: list[np.ndarray], keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(places of keys, candidate values), a pair for each of a key's values, sorted."""
        rows, values = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for entries, hit in self._hits(tables, keys):
            row, slot = np.nonzero(hit)
            rows.append(row)
            values.append(entries[row, slot] & ((1 << self.value_bits) - 1))
        row, value = np.concatenate(rows), np.concatenate(values)
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (np.diff(row) != 0) | (np.diff(value) != 0)
        return row[new], value[new]

    def build(self, keys: Iterable[bytes]) -> bytes:
        return self.build_values((k, 0) for k in keys)

    def build_values(self, items: Iterable[tuple[bytes, int]]) -> bytes:
        """A filter of (key, value) pairs; a key can have several values."""
        tables = self.build_tables(items)
        head = np.array([len(tables), *(len(t) for t in tables)], dtype="<u4")
        return head.tobytes() + b"".join(t.astype("<u8").tobytes() for t in tables)

    @staticmethod
    def load(data: bytes) -> list[np.ndarray]:
        n = int.from_bytes(data[:4], "little")
        sizes = np.frombuffer(data, dtype="<u4", count=n, offset=4).tolist()
        at, out = 4 + 4 * n, []
        for s in sizes:
            out.append(np.frombuffer(data, dtype="<u8", count=4 * s, offset=at).reshape(s, 4).astype(np.int64))
            at += 32 * s
        return out

    def opened(self, data: bytes) -> Callable[[list[bytes]], np.ndarray]:
        tables = self.load(data)

        def ask(keys: list[bytes]) -> np.ndarray:
            out = np.zeros(len(keys), dtype=bool)
            for _, hit in self._hits(tables, keys):
                out |= hit.any(axis=1)
            return out

        return ask


FILTERS = {"bloom": Bloom, "cuckoo": Cuckoo} | {f"bitmap-{f}": (lambda f=f, **kw: Bitmap(f, **kw)) for f in BITMAPS}
