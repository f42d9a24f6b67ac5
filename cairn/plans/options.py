"""Table options: the five key modes and the ``a=b&c=d`` option string."""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from enum import Enum

log = logging.getLogger(__name__)

_SUFFIXES = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
_TRUE, _FALSE = {"1", "true", "t", "yes", "y", "on"}, {"0", "false", "f", "no", "n", "off"}


class Mode(Enum):
    """How a table treats keys: (keeps every value, drops repeats within an epoch, keeps keys in order)."""

    MULTIMAP = (True, False, True)
    MULTIMAP_UNORDERED = (True, False, False)
    UNIQUE_DROP = (False, True, True)
    UNIQUE = (False, False, True)
    UNIQUE_UNORDERED = (False, False, False)

    @property
    def multi(self) -> bool:
        return self.value[0]

    @property
    def drops_repeats(self) -> bool:
        return self.value[1]

    @property
    def ordered(self) -> bool:
        return self.value[2]

    @classmethod
    def of(cls, multimap: bool = False, unordered: bool = False, drop: bool = False) -> Mode:
        if multimap:
            return cls.MULTIMAP_UNORDERED if unordered else cls.MULTIMAP
        return cls.UNIQUE_UNORDERED if unordered else cls.UNIQUE_DROP if drop else cls.UNIQUE


def pretty_number(text: str) -> int | None:
    """``16``, ``4k``, ``4KiB``, ``2MB``: powers of 1024; None if it is none of these."""
    m = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)(?:i?b)?\s*", text, re.IGNORECASE)
    return int(m[1]) * _SUFFIXES[m[2].lower()] if m else None


def pretty_bool(text: str) -> bool | None:
    low = text.strip().lower()
    return True if low in _TRUE else False if low in _FALSE else None


def _filter(text: str) -> str | None:
    return next((x for x in ("bloom", "bitmap") if text.startswith(x)), None)


def _compression(text: str) -> str | None:
    return "snappy" if text.startswith("snappy") else "uncompressed" if text.startswith("no") else None


BITMAP_FORMATS = ("uncompressed", "roar", "fast-vb+", "vb+", "vb", "fast-p-f-delta", "p-f-delta")


@dataclass(frozen=True)
class Options:
    """Options that change a plan here; the rest of an option string is accepted and kept in ``storage``."""

    lg_parts: int = 0
    num_epochs: int | None = None
    rank: int = 0
    total_memtable_budget: int = 4 << 20
    block_size: int = 32 << 10
    filter: str = "bloom"
    bf_bits_per_key: int = 8
    bm_fmt: str = "uncompressed"
    bm_key_bits: int = 24
    key_size: int = 8
    value_size: int = 32
    compression: str = "uncompressed"
    skip_sort: bool = False
    ignore_filters: bool = False
    paranoid_checks: bool = False
    fixed_kv: bool = False
    mode: Mode = Mode.UNIQUE
    storage: tuple[tuple[str, str], ...] = ()

    @property
    def parts(self) -> int:
        return 1 << self.lg_parts

    def clamped(self) -> Options:
        return replace(self, lg_parts=min(max(self.lg_parts, 0), 8), total_memtable_budget=min(max(self.total_memtable_budget, 1 << 20), 1 << 30), block_size=min(max(self.block_size, 1 << 10), 1 << 20))


#: Options about buffers and logs: Spark and Parquet own those; they are taken note of only. Readers heed those about checksums.
STORAGE_OPTIONS = frozenset(
    "compaction_buffer data_buffer min_data_buffer index_buffer min_index_buffer block_padding tail_padding verify_checksums skip_checksums "
    "parallel_reads epoch_log_rotation leveldb_compatible filter_bits_per_key index_compression force_compression".split()
)
_ALIASES = {"memtable_size": "total_memtable_budget"}
_CHOICES = {"filter": _filter, "compression": _compression, "bm_fmt": lambda x: x if x in BITMAP_FORMATS else None}


def parse_options(conf: str, base: Options | None = None) -> Options:
    """Read ``k1=v1&k2=v2``. Unknown keys and bad values are warned about and ignored."""
    out = base or Options()
    kinds = {f.name: type(getattr(Options(), f.name)) for f in fields(Options)} | {"num_epochs": int}
    for pair in filter(None, re.split(r"[&;,]", conf)):
        key, _, value = (x.strip() for x in pair.partition("="))
        key = _ALIASES.get(key, key)
        if key in STORAGE_OPTIONS:
            out = replace(out, storage=(*out.storage, (key, value)))
            continue
        if key in _CHOICES:
            parsed = _CHOICES[key](value)
        elif key in kinds and key not in ("mode", "storage"):
            parsed = pretty_bool(value) if kinds[key] is bool else pretty_number(value)
        else:
            parsed = None
        if parsed is None:
            log.warning("option %s=%s is not known and is ignored", key, value)
        else:
            out = replace(out, **{key: parsed})
    return out.clamped()


def with_environment(base: Options | None = None, environment: Mapping[str, str] | None = None) -> Options:
    """Options with those of the environment in place of their own: CAIRN_BLOCK_SIZE is ``block_size``."""
    environment = os.environ if environment is None else environment
    names = {f.name for f in fields(Options)} | set(_ALIASES) | STORAGE_OPTIONS
    found = [f"{n}={environment[f'CAIRN_{n.upper()}']}" for n in sorted(names) if f"CAIRN_{n.upper()}" in environment]
    return parse_options("&".join(found), base)
