"""A directory tree as a DataFrame of inodes, with path resolution, permissions, bulk changes and a client for single paths.

``inodes(dir_ino, name, ino, mode, uid, gid, size, zserver, mtime, ctime)``: a row for each entry, keyed by (dir_ino, name);
times are microseconds. The root is inode 0 and has no row. Bulk changes give a new DataFrame, so that readers keep the version
they have. ``Namespace`` is a client of a ``Tree``: single changes are kept in a short log over the table, which is merged and
written anew when it grows. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.scalar import DIRECTORY, INDEXED, PERMISSIONS, REGULAR, allowed, is_directory, is_regular, name_key, path_parts, permissions_set
from cairn.operators.prefix import numbered
from cairn.operators.streams import blocks_of, read_blocks
from cairn.plans.errors import AccessDenied, AlreadyExists, AssertionFailed, BadHandle, CairnError, DirExpected, FileExpected, InvalidArgument, NotFound, NotSupported, ReadOnly, TooManyOpens
from cairn.plans.options import Mode, Options
from cairn.session import scratch_path

SCHEMA = "dir_ino long, name string, ino long, mode int, uid int, gid int, size long, zserver int, mtime long, ctime long"
ROOT = 0
ROOT_MODE = DIRECTORY | 0o777
LIST_LIMIT = 1000
MOST_OPEN = 1000
LONGEST_NAME = 255
LOG_LIMIT = 1000


def server_of(name, servers: int):
    """The server that keeps a name. Only placement depends on it."""
    return F.pmod(F.hash(name), F.lit(servers))


def prefixes(paths: DataFrame, path: str) -> DataFrame:
    """(path, depth): every folder on the way to every path, the path itself included, once each."""
    parts = paths.select(path_parts(F.col(path)).alias("p")).where(F.size("p") > 0)
    some = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    return some.select(F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/")).alias("path"), "depth").distinct()


def folders_resolved(inodes: DataFrame, paths: DataFrame, path: str, user: int, group: int, most_depth: int) -> DataFrame:
    """(__folder, pid, status): every folder on the way to any of the paths, once each, with its inode.

    A level at a time, each an equi-join of that level's distinct folders; status is ok, not_found, dir_expected or access_denied.
    """
    above = paths.select(path_parts(F.col(path)).alias("p")).where(F.size("p") > 1).select(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))).alias("p")).distinct()
    level = inodes.select(F.col("dir_ino").alias("up"), F.col("name").alias("last"), "ino", "mode", "uid", "gid")
    joined = lambda n: F.array_join(F.slice("p", F.lit(1), n), "/")
    known = paths.sparkSession.range(1).select(F.lit("").alias("__folder"), F.lit(ROOT).cast("long").alias("pid"), F.lit("ok").alias("status"))
    levels = [known]
    for depth in range(1, most_depth):
        own = above.where(F.size("p") >= depth).select(joined(F.lit(depth - 1)).alias("__up"), F.get("p", F.lit(depth - 1)).alias("last"), joined(F.lit(depth)).alias("own")).distinct()
        found = own.join(levels[-1].select(F.col("__folder").alias("__up"), F.col("pid").alias("up"), F.col("status").alias("before")), "__up").join(level, ["up", "last"], "left")
        enter = allowed(F.col("mode"), F.col("uid"), F.col("gid"), user, group, 1)
        status = F.when(F.col("before") != "ok", F.col("before")).when(F.col("ino").isNull(), "not_found").when(~is_directory(F.col("mode")), "dir_expected").when(~enter, "access_denied").otherwise("ok")
        levels.append(found.select(F.col("own").alias("__folder"), F.col("ino").alias("pid"), status.alias("status")))
    return reduce(DataFrame.union, levels)


def resolved(inodes: DataFrame, paths: DataFrame, path: str = "path", user: int = 0, group: int = 0, most_depth: int | None = None) -> DataFrame:
    """``paths`` with pid (inode of the parent folder), name and status: ok, not_found, dir_expected, access_denied.

    The distinct folders are resolved first, as many levels as the deepest path has (counted, unless ``most_depth`` says); then
    each path is joined to its folder once. Every folder on the way must be a directory that ``user`` may enter.
    """
    todo = paths.withColumn("__parts", path_parts(F.col(path)))
    if most_depth is None:
        most_depth = todo.agg(F.coalesce(F.max(F.size("__parts")), F.lit(0))).first()[0]
    folders = folders_resolved(inodes, paths, path, user, group, most_depth)
    folder = F.array_join(F.slice("__parts", F.lit(1), F.greatest(F.size("__parts") - 1, F.lit(0))), "/")
    out = todo.withColumns({"__folder": folder, "name": F.try_element_at("__parts", F.lit(-1))}).join(folders, "__folder")
    return out.select(*paths.columns, "pid", "status", "name")


def all_paths(inodes: DataFrame, folder: str) -> DataFrame:
    """(path, ino, depth) of every entry below the root; ``folder`` takes a table for each level.

    A join of one level's folders with their entries at a time, so that a level's rows alone are in flight. Ends with the first
    level without entries.
    """
    spark = inodes.sparkSession
    now = inodes.where(F.col("dir_ino") == ROOT).select(F.concat(F.lit("/"), "name").alias("path"), "ino", F.col("mode").alias("m"))
    entries = inodes.select("dir_ino", "name", F.col("ino").alias("own"), F.col("mode").alias("m"))
    depth = 1
    while True:
        path = f"{folder}/depth={depth}"
        now.write.mode("overwrite").parquet(path)
        now = spark.read.parquet(path)
        folders = now.where(is_directory(F.col("m"))).select(F.col("ino").alias("dir_ino"), "path")
        if folders.isEmpty():
            break
        now = folders.join(entries, "dir_ino").select(F.concat("path", F.lit("/"), "name").alias("path"), F.col("own").alias("ino"), "m")
        depth += 1
    return spark.read.schema("path string, ino long, m int, depth int").parquet(folder).select("path", "ino", "depth")


def folders_created(inodes: DataFrame, paths: DataFrame, path: str, folder: str, now: int, first_ino: int, mode: int = 0o755, servers: int = 1) -> DataFrame:
    """Inodes with every folder on the way to the paths, the paths themselves included; those that are there stay as they are.

    A level at a time: its distinct folders are joined to their parents and to what is there, the missing ones are numbered, and
    the level is written below ``folder``. Entries below a regular file are left out.
    """
    spark = inodes.sparkSession
    wanted = prefixes(paths, path)
    deepest = wanted.agg(F.max("depth")).first()[0] or 0
    there = inodes.select(F.col("dir_ino").alias("pid"), F.col("name").alias("last"), F.col("ino").alias("old"), F.col("mode").alias("old_mode"))
    above = spark.range(1).select(F.lit("").alias("up"), F.lit(ROOT).cast("long").alias("pid"))
    made = []
    for depth in range(1, deepest + 1):
        own = wanted.where(F.col("depth") == depth).select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("up"), F.regexp_extract("path", "([^/]*)$", 1).alias("last"))
        found = own.join(above, "up").join(there, ["pid", "last"], "left")
        fresh = numbered(found.where(F.col("old").isNull()).select("path", "pid", "last"), ["pid", "last"], "ino", first_ino)
        place = f"{folder}/made={depth}"
        fresh.write.mode("overwrite").parquet(place)
        fresh = spark.read.parquet(place)
        first_ino += fresh.count()
        made.append(fresh)
        held = found.where(is_directory(F.col("old_mode"))).select(F.col("path").alias("up"), F.col("old").alias("pid"))
        above = held.union(fresh.select(F.col("path").alias("up"), F.col("ino").alias("pid")))
    if not made:
        return inodes
    zero, time = F.lit(0), F.lit(now).cast("long")
    rows = reduce(DataFrame.union, made).select(
        F.col("pid").alias("dir_ino"), F.col("last").alias("name"), F.col("ino").cast("long").alias("ino"), F.lit(DIRECTORY | mode & PERMISSIONS).alias("mode"), zero.alias("uid"), zero.alias("gid"),
        zero.cast("long").alias("size"), server_of(F.col("last"), servers).alias("zserver"), time.alias("mtime"), time.alias("ctime"),
    )
    return inodes.unionByName(rows)


def listing(inodes: DataFrame, limit: int = LIST_LIMIT, by: tuple[str, ...] = ("dir_ino",)) -> DataFrame:
    """(by, name): of every folder at most ``limit`` names of each server, the first ones in order of names."""
    place = F.row_number().over(Window.partitionBy(*by, "zserver").orderBy("name"))
    return inodes.withColumn("__place", place).where(F.col("__place") <= limit).select(*by, "name").distinct()


def changed(inodes: DataFrame, where, permissions: int | None = None, uid: int | None = None, gid: int | None = None, now: int = 0) -> DataFrame:
    """Inodes with new permissions, owner or group for the rows of ``where``; folders whose files are keys of a table stay."""
    here = where & ~(is_directory(F.col("mode")) & (F.col("mode").bitwiseAND(INDEXED) == INDEXED))
    new = {"ctime": F.lit(now).cast("long")}
    if permissions is not None:
        new["mode"] = permissions_set(F.col("mode"), F.lit(permissions)).cast("int")
    new |= {c: F.lit(v).cast("int") for c, v in (("uid", uid), ("gid", gid)) if v is not None}
    return inodes.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in new.items()})


def may_create(inodes: DataFrame, wanted: DataFrame, user: int, group: int) -> DataFrame:
    """``wanted`` (dir_ino, name) with status: ok, not_found (no such folder), dir_expected, access_denied, name_too_long."""
    folders = inodes.select(F.col("ino").alias("dir_ino"), F.col("mode").alias("__m"), F.col("uid").alias("__u"), F.col("gid").alias("__g"))
    out = wanted.join(folders, "dir_ino", "left")
    root = F.col("dir_ino") == ROOT
    may = root | allowed(F.col("__m"), F.col("__u"), F.col("__g"), user, group, 3)
    status = F.when(F.octet_length("name") > LONGEST_NAME, "name_too_long").when(~root & F.col("__m").isNull(), "not_found").when(~root & ~is_directory(F.col("__m")), "dir_expected").when(~may, "access_denied").otherwise("ok")
    return out.select(*wanted.columns, status.alias("status"))


def stat_many(inodes: DataFrame, paths: DataFrame, path: str = "path", user: int = 0, group: int = 0, most_depth: int | None = None) -> DataFrame:
    """``paths`` with status and the inode's columns. The root itself is made up."""
    at = resolved(inodes, paths, path, user, group, most_depth).select(*paths.columns, "pid", "name", "status")
    held = inodes.withColumnRenamed("dir_ino", "pid").withColumn("__hit", F.lit(True))
    out = at.join(held, ["pid", "name"], "left")
    root = F.col("name").isNull()
    made_up = {"ino": F.lit(ROOT).cast("long"), "mode": F.lit(ROOT_MODE), "uid": F.lit(0), "gid": F.lit(0), "size": F.lit(0).cast("long"), "zserver": F.lit(0), "mtime": F.lit(0).cast("long"), "ctime": F.lit(0).cast("long")}
    ok = F.col("status") == "ok"
    status = F.when(ok & ~root & F.col("__hit").isNull(), "not_found").otherwise(F.col("status"))
    return out.select(*paths.columns, status.alias("status"), *(F.when(root & ok, v).when(ok, F.col(c)).alias(c) for c, v in made_up.items()))


def dir_info(inodes: DataFrame) -> DataFrame:
    """(dir_ino, size, mtime): entries of each folder and the time of the last one."""
    return inodes.groupBy("dir_ino").agg(F.count("*").alias("size"), F.max("ctime").alias("mtime"))


def created(inodes: DataFrame, wanted: DataFrame, kind: int, now: int, first_ino: int, servers: int = 1) -> tuple[DataFrame, DataFrame]:
    """New inodes for ``wanted`` (dir_ino, name, mode, uid, gid), and those of ``wanted`` that are there already.

    Wanted twice counts once. Modes keep their permission bits; ``kind`` is the rest.
    """
    wanted = wanted.dropDuplicates(["dir_ino", "name"])
    there = wanted.join(inodes.select("dir_ino", "name"), ["dir_ino", "name"], "left_semi")
    fresh = numbered(wanted.join(inodes.select("dir_ino", "name"), ["dir_ino", "name"], "left_anti"), ["dir_ino", "name"], "ino", first_ino)
    rows = fresh.select(
        F.col("dir_ino").cast("long").alias("dir_ino"), "name", F.col("ino").cast("long").alias("ino"), F.col("mode").bitwiseAND(PERMISSIONS).bitwiseOR(F.lit(kind)).cast("int").alias("mode"),
        F.col("uid").cast("int").alias("uid"), F.col("gid").cast("int").alias("gid"), F.lit(0).cast("long").alias("size"), server_of(F.col("name"), servers).alias("zserver"), F.lit(now).cast("long").alias("mtime"), F.lit(now).cast("long").alias("ctime"),
    )
    return inodes.unionByName(rows), there


def without(inodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Inodes less the regular files among ``entries`` (dir_ino, name)."""
    gone = inodes.where(is_regular(F.col("mode"))).join(entries.select("dir_ino", "name").distinct(), ["dir_ino", "name"], "left_semi")
    return inodes.join(gone.select("dir_ino", "name"), ["dir_ino", "name"], "left_anti").select(*inodes.columns)


def with_data_stat(inodes: DataFrame, headers: DataFrame) -> DataFrame:
    """Inodes whose size and mtime come from their data where there is any; ``headers`` has (file_id, mtime, size)."""
    data = headers.select(F.col("file_id").alias("ino"), F.col("mtime").alias("__t"), F.col("size").alias("__s"))
    out = inodes.join(data, "ino", "left")
    return out.withColumns({"size": F.coalesce("__s", "size"), "mtime": F.coalesce("__t", "mtime")}).select(*inodes.columns)


class Tree:
    """What all clients share: the table of inodes, a short log of changes over it, and a folder for the files' data.

    ``blocks/file_id=I`` has the blocks of a regular file, ``indexed/I`` the epoch table of an indexed folder, ``inodes/N`` the
    versions of the table.
    """

    def __init__(self, spark: SparkSession, inodes: DataFrame | None = None, store: str | None = None, servers: int = 1, readonly: bool = False):
        self.spark, self.base, self.servers, self.readonly = spark, inodes, servers, readonly
        self.store = store or scratch_path(spark, "namespace")
        self.log: dict[tuple[int, str], dict | None] = {}
        self.next_ino, self.clock, self.version, self.writes = 1, 0, 0, 0
        self.writers: dict[int, object] = {}
        if inodes is not None:
            last = inodes.agg(F.max("ino"), F.max(F.greatest("ctime", "mtime"))).first()
            self.next_ino, self.clock = int(last[0] or 0) + 1, int(last[1] or 0)

    @property
    def inodes(self) -> DataFrame:
        """The table as it is now."""
        if not self.log:
            return self.base if self.base is not None else self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.createDataFrame([tuple(x[c.split()[0]] for c in SCHEMA.split(", ")) for x in self.log.values() if x], SCHEMA)
        if self.base is None:
            return rows
        gone = self.spark.createDataFrame(list(self.log), "dir_ino long, name string")
        return self.base.join(F.broadcast(gone), ["dir_ino", "name"], "left_anti").select(*rows.columns).union(rows)  # at most LOG_LIMIT rows

    def entry(self, pid: int, name: str) -> dict | None:
        if (pid, name) in self.log:
            return self.log[pid, name]
        found = self.base.where((F.col("dir_ino") == pid) & (F.col("name") == name)).first() if self.base is not None else None
        return found.asDict() if found else None

    def put(self, row: dict) -> dict:
        self._note(row["dir_ino"], row["name"], row)
        return row

    def drop(self, row: dict) -> None:
        self._note(row["dir_ino"], row["name"], None)

    def _note(self, pid: int, name: str, row: dict | None) -> None:
        if self.readonly:
            raise ReadOnly(name)
        self.log[pid, name] = row
        if len(self.log) >= LOG_LIMIT:
            self.compact()

    def compact(self) -> None:
        """Merge the log into a new version of the table."""
        path = f"{self.store}/inodes/{self.version}"
        self.inodes.write.parquet(path)
        self.base, self.log, self.version = self.spark.read.schema(SCHEMA).parquet(path), {}, self.version + 1

    def names(self, pid: int, limit: int) -> list[str]:
        """At most ``limit`` names of a folder for each server."""
        out = {r["name"] for r in listing(self.inodes.where(F.col("dir_ino") == pid), limit).collect()}  # limit times servers at most
        return sorted(out)

    def tick(self) -> int:
        self.clock += 1
        return self.clock


_ERRORS = {"not_found": NotFound, "dir_expected": DirExpected, "access_denied": AccessDenied}
_ROOT_ENTRY = {"dir_ino": ROOT, "name": None, "ino": ROOT, "mode": ROOT_MODE, "uid": 0, "gid": 0, "size": 0, "zserver": 0, "mtime": 0, "ctime": 0}


@dataclass
class Namespace:
    """A client of one tree: single-path calls, a working directory, handles. Calls that meet the log alone run no plan."""

    spark: SparkSession
    inodes_at_first: DataFrame | None = None
    user: int = 0
    group: int = 0
    cwd: str = "/"
    root: str = "/"
    mask: int = 0o022
    servers: int = 1
    tree: Tree | None = None
    inputs: tuple[str, ...] = ()
    output: str | None = None
    handles: dict[int, dict] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.tree = self.tree or Tree(self.spark, self.inodes_at_first, servers=self.servers)

    @property
    def inodes(self) -> DataFrame:
        return self.tree.inodes

    # --- paths and state of the client

    def _parts(self, path: str, below: list[str] | None = None) -> list[str]:
        """Names on the way down, from the tree's root."""
        start = [] if path.startswith("/") else below if below is not None else [x for x in self.cwd.split("/") if x]
        out = list(start)
        for x in path.split("/"):
            if x == "..":
                out = out[:-1]
            elif x not in ("", "."):
                out.append(x)
        return out

    def _done(self, op: str) -> None:
        self.counters[op] = self.counters.get(op, 0) + 1

    def _walk(self, parts: list[str]) -> dict:
        """The entry of a folder, every folder on the way being one that the user may enter."""
        at = dict(_ROOT_ENTRY)
        for x in [*(y for y in self.root.split("/") if y), *parts]:
            if not at["mode"] & DIRECTORY:
                raise DirExpected(x)
            if not self._may(at, 1):
                raise AccessDenied(x)
            found = self.tree.entry(at["ino"], x)
            if found is None:
                raise NotFound("/" + "/".join(parts))
            at = found
        return at

    def _find(self, path: str, folder: dict | None = None) -> tuple[dict, str | None, dict | None]:
        """(parent folder, name, entry or None) of a path, or of one below ``folder``."""
        parts = self._parts(path, [] if folder is not None else None)
        if not parts:
            at = folder or self._walk([])
            return at, None, at
        if folder is None:
            parent = self._walk(parts[:-1])
        else:
            if len(parts) > 1:
                raise NotSupported("one name below an open folder")
            parent = folder
        if not parent["mode"] & DIRECTORY:
            raise DirExpected(path)
        if not self._may(parent, 1):
            raise AccessDenied(path)
        return parent, parts[-1], self.tree.entry(parent["ino"], parts[-1])

    def _held(self, path: str) -> dict:
        entry = self._find(path)[2]
        if entry is None:
            raise NotFound(path)
        return entry

    def _may(self, entry: dict, bits: int) -> bool:
        if self.user == 0:
            return True
        mode = entry["mode"]
        return any(cond and mode >> shift & bits == bits for cond, shift in ((entry["uid"] == self.user, 6), (entry["gid"] == self.group, 3), (True, 0)))

    def chdir(self, path: str) -> None:
        if not self._held(path)["mode"] & DIRECTORY:
            raise DirExpected(path)
        self.cwd = "/" + "/".join(self._parts(path))

    def getcwd(self) -> str:
        return self.cwd

    def chroot(self, path: str) -> None:
        if not self._held(path)["mode"] & DIRECTORY:
            raise DirExpected(path)
        self.root, self.cwd = "/" + "/".join([*(y for y in self.root.split("/") if y), *self._parts(path)]), "/"

    def umask(self, mask: int) -> int:
        before, self.mask = self.mask, mask & PERMISSIONS
        return before

    def getinput(self, i: int = 0) -> str | None:
        """Where the snapshots that this job reads are."""
        return self.inputs[i] if i < len(self.inputs) else None

    def getoutput(self) -> str | None:
        """Where this job's snapshot goes."""
        return self.output

    # --- reading

    def stat(self, path: str) -> dict:
        out = self._held(path)
        self._done("stat")
        return out

    getattr = stat

    def lookup(self, path: str) -> dict:
        out = self._held(path)
        if not out["mode"] & DIRECTORY:
            raise DirExpected(path)
        self._done("lookup")
        return out

    def listdir(self, path: str, limit: int = LIST_LIMIT, filler: Callable[[str], object] | None = None) -> list[str]:
        """At most ``limit`` names of each server. ``filler(name)`` is called for each; what is not 0 or None ends the listing."""
        folder = self.lookup(path)
        if not self._may(folder, 4):
            raise AccessDenied(path)
        names = self.tree.names(folder["ino"], limit)
        self._done("listdir")
        if filler is None:
            return names
        out = []
        for x in names:
            out.append(x)
            if filler(x):
                break
        return out

    def readidx(self, path: str) -> bytes:
        """A bit for each server that may hold names of a folder."""
        self.lookup(path)
        bits = (1 << self.tree.servers) - 1
        return bits.to_bytes(-(-self.tree.servers // 8), "little")

    def access(self, path: str, bits: int) -> bool:
        return self._may(self._held(path), bits)

    def accessdir(self, path: str, bits: int) -> bool:
        return self._may(self.lookup(path), bits)

    # --- changing

    def _create(self, path: str, mode: int, kind: int, excl: bool, folder: dict | None = None) -> dict:
        parent, name, entry = self._find(path, folder)
        if entry is not None:
            if excl:
                raise AlreadyExists(path)
            if kind == REGULAR and not entry["mode"] & REGULAR == REGULAR:
                raise FileExpected(path)
            if kind != REGULAR and not entry["mode"] & DIRECTORY:
                raise DirExpected(path)
            return entry
        if len(name.encode()) > LONGEST_NAME:
            raise InvalidArgument("the name is too long")
        if not self._may(parent, 3):
            raise AccessDenied(path)
        now, ino = self.tree.tick(), self.tree.next_ino
        self.tree.next_ino += 1
        server = crc32(name.encode()) % self.tree.servers
        row = {"dir_ino": parent["ino"], "name": name, "ino": ino, "mode": kind | mode & ~self.mask & PERMISSIONS, "uid": self.user, "gid": self.group, "size": 0, "zserver": server, "mtime": now, "ctime": now}
        return self.tree.put(row)

    def mkfile(self, path: str, mode: int = 0o644, excl: bool = True) -> dict:
        out = self._create(path, mode, REGULAR, excl)
        self._done("mkfile")
        return out

    creat = mkfile

    def mkdir(self, path: str, mode: int = 0o755, excl: bool = True, indexed: bool = False) -> dict:
        out = self._create(path, mode, DIRECTORY | (INDEXED if indexed else 0), excl)
        self._done("mkdir")
        return out

    def mkdirs(self, path: str, mode: int = 0o755, indexed: bool = False) -> dict:
        """Missing folders on the way are made; only the last one can be indexed."""
        names = self._parts(path)
        for i in range(1, len(names)):
            self.mkdir("/" + "/".join(names[:i]), mode, excl=False)
        return self.mkdir(path, mode, excl=False, indexed=indexed)

    def unlink(self, path: str, must_exist: bool = True) -> dict | None:
        parent, name, entry = self._find(path)
        if entry is None:
            if must_exist:
                raise NotFound(path)
            return None
        if name is None or entry["mode"] & DIRECTORY:
            raise FileExpected(path)
        if not self._may(parent, 3):
            raise AccessDenied(path)
        self.tree.drop(entry)
        self._done("unlink")
        return entry

    def _change(self, path: str, regular_only: bool = False, owner_only: bool = False, **columns) -> dict:
        _, name, entry = self._find(path)
        if entry is None:
            raise NotFound(path)
        if name is None or regular_only and entry["mode"] & DIRECTORY:
            raise FileExpected(path) if regular_only else NotSupported(path)
        if owner_only and entry["mode"] & DIRECTORY and entry["mode"] & INDEXED == INDEXED:
            raise NotSupported("folders whose files are keys keep their permissions")
        if owner_only and self.user not in (0, entry["uid"]) or not owner_only and not self._may(entry, 2):
            raise AccessDenied(path)
        return self.tree.put(entry | {"ctime": self.tree.tick()} | columns)

    def chmod(self, path: str, mode: int) -> None:
        entry = self._held(path)
        self._change(path, owner_only=True, mode=entry["mode"] & ~PERMISSIONS | mode & PERMISSIONS)
        self._done("chmod")

    def chown(self, path: str, uid: int, gid: int) -> None:
        self._change(path, owner_only=True, uid=uid, gid=gid)
        self._done("chown")

    def utime(self, path: str, mtime: int) -> None:
        self._change(path, mtime=mtime)
        self._done("utime")

    def trunc(self, path: str, size: int, mtime: int) -> None:
        self._change(path, regular_only=True, size=size, mtime=mtime)
        self._done("trunc")

    # --- handles

    def open(self, path: str, create: bool = False, excl: bool = False, write: bool = False, mode: int = 0o644) -> int:
        """A handle of a file, of a folder, or of a file of an indexed folder."""
        return self._open(path, None, create, excl, write, mode)

    def openat(self, fd: int, name: str, create: bool = False, excl: bool = False, write: bool = False, mode: int = 0o644) -> int:
        """A handle of a name below an open folder."""
        folder = self._handle(fd)["entry"]
        if not folder["mode"] & DIRECTORY:
            raise DirExpected(name)
        return self._open(name, folder, create, excl, write, mode)

    def openstat(self, path: str, **options) -> tuple[int, dict]:
        """A handle and the entry it is of."""
        fd = self.open(path, **options)
        return fd, self.fstat(fd)

    def _open(self, path: str, folder: dict | None, create: bool, excl: bool, write: bool, mode: int) -> int:
        if len(self.handles) >= MOST_OPEN:
            raise TooManyOpens(path)
        parent, name, entry = self._find(path, folder)
        key_of = parent if name is not None and self._indexed(parent) else None
        if key_of is not None and entry is None:
            # files of an indexed folder are keys of its table: they have no inodes of their own
            if not self._may(key_of, 3 if write else 5):
                raise AccessDenied(path)
            entry = {"dir_ino": key_of["ino"], "name": name, "ino": None, "mode": REGULAR | 0o644, "uid": key_of["uid"], "gid": key_of["gid"], "size": 0, "mtime": 0, "ctime": 0}
        elif create:
            entry = self._create(path, mode, REGULAR, excl, folder)
        elif entry is None:
            raise NotFound(path)
        if write and entry["mode"] & DIRECTORY and not self._indexed(entry):
            raise FileExpected(path)
        if key_of is None and not self._may(entry, 2 if write else 4):
            raise AccessDenied(path)
        fd = next(i for i in range(len(self.handles) + 1) if i not in self.handles)
        self.handles[fd] = {"entry": entry, "write": write, "at": 0, "blocks": [], "key_of": key_of}
        self._done("open")
        return fd

    @staticmethod
    def _indexed(entry: dict) -> bool:
        return bool(entry["mode"] & DIRECTORY) and entry["mode"] & INDEXED == INDEXED

    def _writer(self, ino: int):
        from cairn.sources.epoch_table import EpochWriter

        if ino not in self.tree.writers:
            self.tree.writers[ino] = EpochWriter(self.spark, f"{self.tree.store}/indexed/{ino}", Options(key_size=16, mode=Mode.MULTIMAP))
        return self.tree.writers[ino]

    def _reader(self, ino: int):
        from cairn.sources.epoch_table import EpochReader

        return EpochReader(self.spark, f"{self.tree.store}/indexed/{ino}")

    def _handle(self, fd: int, write: bool | None = None) -> dict:
        h = self.handles.get(fd)
        if h is None:
            raise BadHandle(str(fd))
        if write and not h["write"]:
            raise AssertionFailed("the handle is not open for writing")
        return h

    def pwrite(self, fd: int, data: bytes, offset: int) -> int:
        """In an indexed folder the data is one more value of the file's key, whatever the offset."""
        h = self._handle(fd, write=True)
        if self._indexed(h["entry"]):
            raise FileExpected(h["entry"]["name"] or "/")
        h["blocks"].append((self.tree.writes, offset, bytes(data)))
        self.tree.writes += 1
        return len(data)

    def write(self, fd: int, data: bytes) -> int:
        h = self._handle(fd, write=True)
        n = self.pwrite(fd, data, h["at"])
        h["at"] += n
        return n

    def fdatasync(self, fd: int) -> None:
        """Write what a handle holds: blocks of a file, or values of a key (without ending the epoch)."""
        h = self._handle(fd)
        blocks, h["blocks"] = h["blocks"], []
        if not blocks:
            return
        if h["key_of"] is not None:
            values = [(h["entry"]["name"], bytearray(d), i) for i, _, d in blocks]
            writer = self._writer(h["key_of"]["ino"])
            writer.append(self.spark.createDataFrame(values, "name string, value binary, seq long"))
            writer.flush()
            return
        ino = h["entry"]["ino"]
        rows = self.spark.createDataFrame([(i, o, len(d), bytearray(d)) for i, o, d in blocks], "seq long, off long, len long, data binary")
        rows.coalesce(1).write.mode("append").parquet(f"{self.tree.store}/blocks/file_id={ino}")
        entry = self.tree.entry(h["entry"]["dir_ino"], h["entry"]["name"])
        if entry is not None and entry["ino"] == ino:
            size = max([entry["size"], *(o + len(d) for _, o, d in blocks)])
            h["entry"] = self.tree.put(entry | {"size": size, "mtime": self.tree.tick()})

    def flush(self, fd: int) -> None:
        """As ``fdatasync``; on an indexed folder it ends the epoch."""
        h = self._handle(fd)
        if self._indexed(h["entry"]):
            for i, other in list(self.handles.items()):
                if other["key_of"] is not None and other["key_of"]["ino"] == h["entry"]["ino"]:
                    self.fdatasync(i)
            if h["write"]:
                self._writer(h["entry"]["ino"]).epoch_flush()
            return
        self.fdatasync(fd)

    def blocks(self, fd: int) -> DataFrame:
        """(file_id, seq, off, len, data) of a file, with what the handle holds written first."""
        from cairn.sources.epoch_table import exists

        self.fdatasync(fd)
        ino = self._handle(fd)["entry"]["ino"]
        schema, path = "seq long, off long, len long, data binary, file_id long", f"{self.tree.store}/blocks"
        if not exists(self.spark, f"{path}/file_id={ino}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(f"{path}/file_id={ino}")

    def pread(self, fd: int, size: int, offset: int) -> bytes:
        h = self._handle(fd)
        if h["key_of"] is not None:
            return self._reader(h["key_of"]["ino"]).read(h["entry"]["name"])[offset : offset + size]
        if h["entry"]["mode"] & DIRECTORY:
            raise FileExpected(h["entry"]["name"] or "/")
        found = read_blocks(self.blocks(fd), offset, size).first()
        return bytes(found["data"]) if found else b""

    def read(self, fd: int, size: int) -> bytes:
        h = self._handle(fd)
        out = self.pread(fd, size, h["at"])
        h["at"] += len(out)
        return out

    def fstat(self, fd: int) -> dict:
        h = self._handle(fd)
        return h["entry"] | {"size": max([h["entry"]["size"], *(o + len(d) for _, o, d in h["blocks"])])}

    def close(self, fd: int) -> None:
        """Write what is left and free the handle; closing an indexed folder that was open for writing finishes its table."""
        h = self._handle(fd)
        if self._indexed(h["entry"]) and h["write"]:
            self.flush(fd)
            self._writer(h["entry"]["ino"]).finish()
            del self.tree.writers[h["entry"]["ino"]]
        elif not h["entry"]["mode"] & DIRECTORY:
            self.fdatasync(fd)
        del self.handles[fd]

    def truncate(self, path: str, size: int) -> None:
        raise NotSupported("block streams cannot be cut by path")

    def ftruncate(self, fd: int, size: int) -> None:
        self._handle(fd)
        raise NotSupported("block streams cannot be cut")

    # --- whole files

    def copy_in(self, source: str, folder: str, block: int = 4096) -> int:
        """Take the files of a folder or pattern that Spark can read into ``folder``, blocks and inodes in bulk; how many."""
        into = self.lookup(folder)
        if not self._may(into, 3):
            raise AccessDenied(folder)
        found = self.spark.read.format("binaryFile").load(source).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content"), F.col("length"))
        new = numbered(found, ["name"], "ino", self.tree.next_ino)
        path = f"{self.tree.store}/ingest/{self.tree.version}-{self.tree.next_ino}"
        new.write.parquet(path)
        new, now = self.spark.read.parquet(path), self.tree.tick()
        blocks_of(new, "ino", F.col("content"), block).write.mode("append").partitionBy("file_id").parquet(f"{self.tree.store}/blocks")
        rows = new.select(
            F.lit(into["ino"]).cast("long").alias("dir_ino"), "name", "ino", F.lit(REGULAR | 0o644 & ~self.mask).alias("mode"), F.lit(self.user).alias("uid"), F.lit(self.group).alias("gid"),
            F.col("length").cast("long").alias("size"), server_of(F.col("name"), self.tree.servers).cast("int").alias("zserver"), F.lit(now).cast("long").alias("mtime"), F.lit(now).cast("long").alias("ctime"),
        )
        if self.tree.readonly:
            raise ReadOnly(folder)
        there = self.tree.inodes
        self.tree.base, self.tree.log = there.join(rows.select("dir_ino", "name"), ["dir_ino", "name"], "left_anti").select(*there.columns).union(rows), {}
        self.tree.compact()
        n = self.tree.base.where(F.col("ino") >= self.tree.next_ino).count()
        self.tree.next_ino += n
        self.tree.writes += n << 20
        empty = self._without_bytes(source)
        for name in empty:
            self.mkfile(f"{folder}/{name}", excl=False)
        return n + len(empty)

    def _without_bytes(self, source: str) -> list[str]:
        """Names of the empty files of a folder or pattern, which Spark's readers pass over."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(source)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = list(store.globStatus(path) or [])
        if len(found) == 1 and found[0].isDirectory():
            found = list(store.listStatus(found[0].getPath()))
        return [x.getPath().getName() for x in found if x.isFile() and x.getLen() == 0]

    def cat(self, path: str) -> bytes:
        """All bytes of a file."""
        fd = self.open(path)
        try:
            key_of = self._handle(fd)["key_of"]
            return self._reader(key_of["ino"]).read(self._handle(fd)["entry"]["name"]) if key_of else self.pread(fd, self.fstat(fd)["size"], 0)
        finally:
            self.close(fd)

    def session(self, **state) -> Namespace:
        """Another client of the same tree."""
        return replace(self, handles={}, counters={}, **state)


def snapshot_store(conf: str) -> dict:
    """``type=posixfs,root=/x,metadata_folder=m,data_folder=d,readonly=true`` as (root, metadata, data, readonly); other types are not supported."""
    raw = {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in conf.replace("|", ",").replace(";", ",").split(",")) if k.strip()}
    if raw.get("type", "posixfs") != "posixfs":
        raise NotSupported(f"store {raw['type']}")
    root = raw.get("root", "").rstrip("/")
    if not root:
        raise InvalidArgument("a store needs a root")
    return {"metadata": f"{root}/{raw.get('metadata_folder', 'metadata')}", "data": f"{root}/{raw.get('data_folder', 'data')}", "readonly": "readonly" in raw and raw["readonly"].lower() not in ("false", "no", "0")}


def save_snapshot(tree: Tree, conf: str) -> None:
    """Write a tree's inodes to a store; its data stays in the folder that the tree has."""
    where = snapshot_store(conf)
    if where["readonly"]:
        raise ReadOnly(conf)
    tree.inodes.write.mode("overwrite").parquet(where["metadata"])


def load_snapshot(spark: SparkSession, conf: str, servers: int = 1) -> Tree:
    """The tree of a store; read-only ones refuse every change."""
    where = snapshot_store(conf)
    return Tree(spark, spark.read.schema(SCHEMA).parquet(where["metadata"]), where["data"], servers, where["readonly"])


class Watched:
    """A client whose calls are reported: ``tell(op, seconds, error or None)`` after each of them."""

    def __init__(self, client, tell: Callable[[str, float, CairnError | None], None]):
        self._client, self._tell = client, tell

    def __getattr__(self, op: str):
        from time import perf_counter

        own = getattr(self._client, op)
        if not callable(own):
            return own

        def call(*args, **kwargs):
            began, error = perf_counter(), None
            try:
                return own(*args, **kwargs)
            except CairnError as e:
                error = e
                raise
            finally:
                self._tell(op, perf_counter() - began, error)

        return call


def names_checked(rows: DataFrame, name: str = "name", key: str = "key", size: int = 16) -> DataFrame:
    """``rows``, failing on the first whose stored name does not hash to its key."""
    return rows.where(F.when(name_key(F.col(name), size) == F.col(key), True).otherwise(F.raise_error(F.concat(F.lit("the key of another name: "), F.col(name))).cast("boolean")))
