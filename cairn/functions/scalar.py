"""Column functions: names, placement, mode bits, paths, little-endian keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, FloatType

REGULAR, DIRECTORY, INDEXED, PERMISSIONS = 0o100000, 0o040000, 0o1000000, 0o777


def placed(key: Column, parts: int) -> Column:
    """The partition of a key. Only where a key lives depends on it, never a result."""
    return F.pmod(F.hash(key), F.lit(parts))


def name_key(name: Column, size: int = 16) -> Column:
    """A file name as a binary key: the first bytes of its 128-bit hash."""
    return F.substring(F.unhex(F.md5(name.cast("binary"))), 1, size)


def epoch_label(epoch: Column) -> Column:
    return F.format_string("%04d", epoch)


def table_label(epoch: Column, table: Column) -> Column:
    return F.format_string("%04d-%04d", epoch, table)


def parsed_label(label: Column) -> tuple[Column, Column]:
    """(epoch, table) of a label; table is null for an epoch's label."""
    bits = F.split(label, "-")
    return bits[0].cast("int"), F.get(bits, F.lit(1)).cast("int")


def log_name(rank: Column, kind: str = "data", part: Column | None = None) -> Column:
    """Display name of a rank's log: data, index (with a part), plain, range, tree or side."""
    if kind == "index":
        return F.format_string("L-%08x.idx.%02x", rank, part)
    pattern = {"data": "L-%08x.dat", "plain": "PDB-%08x.tbl", "range": "RDB-%08x.tbl", "tree": "LSM-%08x", "side": "D-%08x.bin"}[kind]
    return F.format_string(pattern, rank)


def rotated_folder(epoch: Column) -> Column:
    return F.format_string("T-%04x", epoch)


# The prefix is a fixed value of the format.
def folder_name(key: Column) -> Column:
    return F.concat(F.lit("PlfsDir_"), F.hex(key))


def le32(value: Column) -> Column:
    """An integer below 2**32 as four bytes, least first."""
    v = value.cast("long")
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4))))


def from_le32(key: Column) -> Column:
    """The first four bytes, least first, as a long; absent bytes count as zero."""
    h = F.rpad(F.hex(F.substring(key, 1, 4)), 8, "0")
    return F.conv(F.concat(*(F.substring(h, 7 - 2 * i, 2) for i in range(4))), 16, 10).cast("long")


def bit_width(value: Column) -> Column:
    """Bits of the leftmost set bit; 0 for 0."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value.cast("long"))))


def varint_size(value: Column) -> Column:
    """Bytes of a value in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil(bit_width(value) / 7)).cast("int")


def is_regular(mode: Column) -> Column:
    return mode.bitwiseAND(0o170000) == REGULAR


def is_directory(mode: Column) -> Column:
    return mode.bitwiseAND(0o170000) == DIRECTORY


def is_indexed_dir(mode: Column) -> Column:
    """A directory whose files are keys of an indexed table."""
    return is_directory(mode) & (mode.bitwiseAND(INDEXED) == INDEXED)


def permissions_set(mode: Column, permissions: Column) -> Column:
    return mode.bitwiseAND(F.lit(~PERMISSIONS)).bitwiseOR(permissions.bitwiseAND(PERMISSIONS))


def masked(mode: Column, umask: int) -> Column:
    return mode.bitwiseAND(F.lit(~umask))


def allowed(mode: Column, uid: Column, gid: Column, user: int, group: int, bits: int) -> Column:
    """May ``user`` do ``bits`` (4 read, 2 write, 1 enter)? Owner, group and others are each tried in turn."""
    if user == 0:
        return F.lit(True)
    has = lambda shift: mode.bitwiseAND(bits << shift) == (bits << shift)
    return ((uid == user) & has(6)) | ((gid == group) & has(3)) | has(0)


def full_path(path: Column, cwd: str = "/", root: str = "/") -> Column:
    """Absolute below ``root``: relative paths start at ``cwd``, repeated and trailing slashes go."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(cwd.rstrip("/") + "/"), path))
    whole = F.concat(F.lit(root.rstrip("/")), whole)
    tidy = F.regexp_replace(F.regexp_replace(whole, "/+", "/"), "(?<=.)/$", "")
    return F.when(tidy == "", "/").otherwise(tidy)


def path_parts(path: Column) -> Column:
    """Names on the way down; empty names and ``.`` go, ``..`` takes back the name before it."""
    names = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(names, F.array().cast("array<string>"), step)


def stat_struct(ino: Column, mode: Column, uid: Column, gid: Column, size: Column, mtime: Column, ctime: Column) -> Column:
    """An inode as the fields of ``struct stat``: microseconds split into seconds and nanoseconds, access time as modification time."""
    parts = lambda t: (F.floor(t / 1000000).cast("long"), (F.pmod(t, F.lit(1000000)) * 1000).cast("long"))
    (ms, mn), (cs, cn) = parts(mtime), parts(ctime)
    fields = {"st_ino": ino, "st_mode": mode, "st_uid": uid, "st_gid": gid, "st_size": size, "st_mtime": ms, "st_mtime_nsec": mn, "st_atime": ms, "st_atime_nsec": mn, "st_ctime": cs, "st_ctime_nsec": cn}
    return F.struct(*(v.alias(k) for k, v in fields.items()))


@F.pandas_udf(BinaryType())
def float_le(value: pd.Series) -> pd.Series:
    """A 32-bit float as four bytes, least first; null stays null."""
    raw = value.to_numpy(dtype="<f4", na_value=np.nan).tobytes()
    return pd.Series([None if missing else raw[4 * i : 4 * i + 4] for i, missing in enumerate(value.isna())])


@F.pandas_udf(FloatType())
def from_float_le(data: pd.Series) -> pd.Series:
    """Four bytes, least first, as a 32-bit float; null and other lengths give null."""
    return pd.Series([None if x is None or len(x) != 4 else float(np.frombuffer(x, dtype="<f4")[0]) for x in data], dtype="object").astype("float32")
