"""A repository: snapshots of a work tree in tables, changed by commits.

The data directory holds numbered commits; each is a small JSON file that names the tables in force, created
by one writer only (a second writer of the same number fails). Tables are written before the commit that
names them, so readers see a whole state or the one before.

What deletes folders (gc, delete_*, remove_loose_all) needs the data directory for itself: others hold it shared while
they run, and `reading` holds it for as long as a caller works with the DataFrames of a repository. Paths are any
bytes; where a line or a view shows them they are text.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import io
import json
import os
import shutil
import time
import uuid
import zipfile
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import create_once, get
from .functions.scalars import id_valid, is_loose, loose_path, snapshot_id
from .model import (
    CHANGES,
    COMPRESSION_LEVEL,
    FRAME_BYTES,
    LOOSE,
    LOOSE_PREFIX,
    NO_OBJECT,
    TABLES,
    AmbiguousSnapshot,
    BadIdentifier,
    CorruptHead,
    CorruptLog,
    DirtyWorkDir,
    InUse,
    LakeError,
    ObjectNotFound,
    PackNotFound,
    PathNotFound,
    ReadOnly,
    SnapshotAlreadyExists,
    SnapshotNotFound,
)
from .operators import catalog, diff, layout, log, store
from .session import ship
from .sinks.packs import join_frames, write_frames
from .sinks.worktree import remove_paths, write_file, write_tree
from .sources.packs import header, read_objects, read_times
from .sources.remotes import INDEX_TIMEOUT, Transport, fetch_checked, http_get, read_index, url_open
from .sources.worktree import clean_file_list, listed_files, worktree

#: Tables that an exported index holds.
INDEX = ("snapshots", "changes", "objects", "prints")


class Repo:
    """Reads give DataFrames; writes commit. spark's executors must see the directories."""

    def __init__(self, spark: SparkSession, root: str, data_dir: str | None = None, transport: Transport = url_open):
        ship(spark)
        self.spark, self.root, self.transport = spark, os.path.abspath(root), transport
        self.data = os.path.abspath(data_dir or os.environ.get("SNAPLAKE_DATA", os.path.join(root, "snaplake_data")))
        self.read_only = os.path.isdir(self.data) and not os.access(self.data, os.W_OK)

    # --- commits ---------------------------------------------------------------------------------

    def _commits(self) -> list[int]:
        top = os.path.join(self.data, "commits")
        return sorted(int(n[:-5]) for n in os.listdir(top) if n.endswith(".json") and n[:-5].isdigit()) if os.path.isdir(top) else []

    def state(self) -> dict:
        """The state in force: packs, loose_objects, head, remotes."""
        found = self._commits()
        if not found:
            return {"number": 0, "packs": {}, "loose_objects": [], "head": None, "remotes": {}}
        with open(os.path.join(self.data, "commits", f"{found[-1]:08d}.json")) as f:
            return json.load(f)

    def _commit(self, state: dict) -> None:
        if self.read_only:
            raise ReadOnly(self.data)
        os.makedirs(os.path.join(self.data, "commits"), exist_ok=True)
        state = {**state, "number": state["number"] + 1}
        if not create_once(os.path.join(self.data, "commits", f"{state['number']:08d}.json"), json.dumps(state).encode()):
            raise LakeError(f"commit {state['number']}: another writer was first")

    def _new(self, kind: str) -> str:
        if self.read_only:
            raise ReadOnly(self.data)
        path = os.path.join(self.data, kind, uuid.uuid4().hex)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return path

    @contextlib.contextmanager
    def _held(self, alone: bool):
        """The data directory, shared or alone. Those who come too late are told, they do not wait."""
        if self.read_only:
            yield
            return
        os.makedirs(self.data, exist_ok=True)
        with open(os.path.join(self.data, "lock"), "ab") as f:
            try:
                fcntl.flock(f, (fcntl.LOCK_EX if alone else fcntl.LOCK_SH) | fcntl.LOCK_NB)
            except OSError as e:
                raise InUse(self.data) from e
            yield

    def reading(self):
        """A context in which nothing that is read here can be deleted."""
        return self._held(False)

    # --- tables ----------------------------------------------------------------------------------

    def _pack(self, name: str, state: dict | None = None) -> dict:
        packs = (state or self.state())["packs"]
        if name not in packs:
            raise PackNotFound(name)
        return packs[name]

    def _read(self, table: str, packs: list[str] | None = None) -> DataFrame:
        """A table of all packs, or of those named: only their folders are opened."""
        state = self.state()
        paths = [f"file://{self._pack(p, state)['dir']}/{table}" for p in (sorted(state["packs"]) if packs is None else packs)]
        if not paths:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*paths)

    def snapshots(self, packs: list[str] | None = None) -> DataFrame:
        return self._read("snapshots", packs)

    def changes(self, packs: list[str] | None = None) -> DataFrame:
        return self._read("changes", packs)

    def loose_objects(self) -> DataFrame:
        paths = [f"file://{p}" for p in self.state()["loose_objects"]]
        return self.spark.read.schema(LOOSE).parquet(*paths) if paths else self.spark.createDataFrame([], LOOSE)

    def files(self, packs: list[str] | None = None) -> DataFrame:
        """Every snapshot's files."""
        return log.materialise_all(self.changes(packs), self.snapshots(packs))

    def fingerprints(self, packs: list[str] | None = None) -> DataFrame:
        """As they were told when the snapshots were written; computed for packs that tell none."""
        state = self.state()
        names = sorted(state["packs"]) if packs is None else packs
        told = [p for p in names if os.path.isdir(os.path.join(self._pack(p, state)["dir"], "prints"))]
        rest = [p for p in names if p not in set(told)]
        out = self._read("prints", told)
        return out.unionByName(diff.snapshot_checksum(self.files(rest), ["pack", "seq", "tag"])) if rest else out

    def register(self) -> None:
        """Temporary views snapshots, changes, files, objects, frames for SQL. Their paths are text."""
        text = F.col("path").cast("string")
        for name, df in (("snapshots", self.snapshots()), ("changes", self.changes().withColumn("path", text)), ("files", self.files().withColumn("path", text)), ("objects", self._read("objects")), ("frames", self._read("frames"))):
            df.createOrReplaceTempView(name)

    def verify(self, packs: list[str] | None = None) -> None:
        """An error if a log removes what is absent or adds what is present."""
        self._verified(self.changes(packs))

    @staticmethod
    def _verified(changes: DataFrame) -> None:
        bad = log.violations(changes).limit(1).collect()
        if bad:
            raise CorruptLog(f"{bad[0].pack} {bad[0].seq} {bad[0].op} {os.fsdecode(bytes(bad[0].path))}")

    # --- names -----------------------------------------------------------------------------------

    def find_snapshot(self, text: str) -> tuple[str, str]:
        """(pack, tag) of `pack:tag`, or of a bare tag: a loose pack first, then by name; contents must agree."""
        row = self.spark.range(1).select(snapshot_id(F.lit(text)).alias("id")).first()
        if row.id is not None:
            tags = self.snapshots([row.id.pack]).filter(F.col("tag") == row.id.tag).limit(1).count()
            if not tags:
                raise SnapshotNotFound(text)
            return row.id.pack, row.id.tag
        named = [r.pack for r in self.snapshots().filter(F.col("tag") == text).select("pack").distinct().collect()]  # one row a pack
        if not named:
            raise SnapshotNotFound(text)
        if len(named) == 1:
            return named[0], text
        prints = self.fingerprints(named).filter(F.col("tag") == text)
        found = catalog.resolve_tags(prints).first()
        if found.pack == catalog.AMBIGUOUS:
            raise AmbiguousSnapshot(text)
        return found.pack, text

    def snapshot_files(self, text: str) -> DataFrame:
        pack, tag = self.find_snapshot(text)
        seq = self.snapshots([pack]).filter(F.col("tag") == tag).agg(F.min("seq")).first()[0]
        return log.resolve(self.changes([pack]), seq)

    @staticmethod
    def _check_id(spark: SparkSession, text: str) -> None:
        if not text or not spark.range(1).select(id_valid(F.lit(text))).first()[0]:
            raise BadIdentifier(text)

    # --- writing ---------------------------------------------------------------------------------

    def store(self, tag: str, names: DataFrame | None = None) -> str:
        """Stores the work tree (or the names in a list) as loose/<tag>; an existing one is replaced.

        Every file is read once: the rows that name objects and the objects themselves are made from what that one reading wrote.
        """
        self._check_id(self.spark, tag)
        with self._held(False):
            state, pack = self.state(), LOOSE_PREFIX + tag
            tree = worktree(self.spark, self.root, self.data) if names is None else listed_files(clean_file_list(names, self.root, self.data), self.root)
            objects, folder = self._new("loose_objects"), self._new("packs")
            store.hashed(tree).write.parquet(f"file://{folder}/tree")
            hashed = self.spark.read.parquet(f"file://{folder}/tree")
            store.new_objects(hashed.filter("readable"), self.loose_objects()).write.parquet(f"file://{objects}")
            rows = hashed.select(F.lit(pack).alias("pack"), F.lit(0).alias("seq"), F.lit("A").alias("op"), "path", "checksum", "mode", "size")
            prints = diff.snapshot_checksum(rows.select("pack", "seq", F.lit(tag).alias("tag"), "path", "checksum", "mode"), ["pack", "seq", "tag"])
            self._write_pack(folder, pack, [(0, tag)], rows, None, None, prints)
            shutil.rmtree(os.path.join(folder, "tree"))
            state["packs"][pack] = {"dir": folder, "time": time.time(), "bytes": 0}
            state["loose_objects"].append(objects)
            state["head"] = {"pack": pack, "tag": tag, "time": time.time()}
            self._commit(state)
        return pack

    def _write_pack(self, folder, pack, snapshots, changes, objects, frames, prints) -> None:
        snaps = self.spark.createDataFrame([(pack, s, t) for s, t in snapshots], TABLES["snapshots"])
        changes.select(*CHANGES.names).write.parquet(f"file://{folder}/changes")
        snaps.coalesce(1).write.parquet(f"file://{folder}/snapshots")
        if objects is None:
            rows = self.spark.read.parquet(f"file://{folder}/changes").groupBy("pack", "checksum").agg(F.max("size").alias("size"))
            objects = rows.select("pack", "checksum", F.lit(None).cast("long").alias("offset"), "size")
        objects.select("pack", "checksum", "offset", "size").write.parquet(f"file://{folder}/objects")
        frames = frames if frames is not None else self.spark.createDataFrame([], TABLES["frames"])
        frames.select(*TABLES["frames"].names).coalesce(1).write.parquet(f"file://{folder}/frames")
        prints.select(*TABLES["prints"].names).coalesce(1).write.parquet(f"file://{folder}/prints")

    def is_pack(self, name: str) -> bool:
        return name in self.state()["packs"]

    def loose_packs(self) -> list[str]:
        """The loose packs, oldest first."""
        packs = self.state()["packs"]
        return sorted((p for p in packs if p.startswith(LOOSE_PREFIX)), key=lambda p: (packs[p]["time"], p))

    def chosen(self, packs: list[str] | None = None) -> list[str]:
        """What would be packed: the loose packs named, or all of them, oldest first."""
        found = self.loose_packs() if packs is None else packs
        if not found:
            raise LakeError("nothing to pack")
        if any(not p.startswith(LOOSE_PREFIX) for p in found):
            raise LakeError("only loose snapshots can be packed")
        return found

    def pack(self, name: str, packs: list[str] | None = None, frames: int = 0, level: int = COMPRESSION_LEVEL) -> None:
        """Packs loose snapshots (all, oldest first, unless named) into one series of deltas and compressed frames."""
        self._check_id(self.spark, name)
        with self._held(False):
            self._pack_all(name, packs, frames, level)

    def _pack_all(self, name: str, packs: list[str] | None, frames: int, level: int) -> None:
        state = self.state()
        chosen = self.chosen(packs)
        order = self.spark.createDataFrame([(p, i) for i, p in enumerate(chosen)], "pack string, place int")
        snaps = store.union_packs(self.snapshots(chosen), order)
        twice = store.duplicate_tags(snaps).limit(1).collect()
        if twice:
            raise SnapshotAlreadyExists(f"{name}:{twice[0].tag}")
        states = self.files(chosen).drop("tag").withColumnRenamed("seq", "old_seq").join(snaps.select("pack", "old_seq", "seq"), ["pack", "old_seq"])
        states = states.select(F.lit(name).alias("pack"), "seq", "path", "checksum", "mode", "size")
        numbered = snaps.select(F.lit(name).alias("pack"), "seq", "tag")
        folder = self._new("packs")
        log.delta_encode(states, numbered).write.parquet(f"file://{folder}/deltas")
        changes = self.spark.read.parquet(f"file://{folder}/deltas")
        sizes = changes.groupBy("pack", "checksum").agg(F.max("size").alias("size"))
        total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        layout.object_layout(sizes).write.parquet(f"file://{folder}/layout")
        placed = layout.frames_by_boundaries(self.spark.read.parquet(f"file://{folder}/layout"), frames or max(1, -(-total // FRAME_BYTES)))
        placed.write.parquet(f"file://{folder}/placed")
        placed = self.spark.read.parquet(f"file://{folder}/placed")
        unread = F.col("checksum") == NO_OBJECT
        held = placed.filter(~unread).join(self.loose_objects().select("checksum", "content"), "checksum", "left")
        missing = held.filter("content is null").select("checksum").limit(1).collect()
        if missing:
            raise ObjectNotFound(missing[0].checksum)
        made = write_frames(held, f"file://{folder}/data", level, total).withColumn("pack", F.lit(name))
        # contents are what they were: so are their fingerprints
        prints = self.fingerprints(chosen).select("pack", F.col("seq").alias("old_seq"), "fingerprint").join(snaps, ["pack", "old_seq"])
        prints = prints.select(F.lit(name).alias("pack"), "seq", "tag", "fingerprint")
        self._write_pack(folder, name, [(r.seq, r.tag) for r in numbered.collect()], changes, placed, made, prints)
        for t in ("deltas", "layout", "placed"):
            shutil.rmtree(os.path.join(folder, t))
        size = self.spark.read.parquet(f"file://{folder}/frames").agg(F.coalesce(F.sum("frame_size"), F.lit(0))).first()[0]
        state["packs"][name] = {"dir": folder, "time": time.time(), "bytes": size}
        head = state["head"]
        if head and head["pack"] in chosen:
            state["head"] = {**head, "pack": name}
        self._commit(state)

    def contents(self, pack: str, wanted: DataFrame, verify: bool = True) -> DataFrame:
        """checksum and content of the wanted checksums, from loose objects or the pack's frames."""
        want = wanted.select("checksum").distinct()
        if pack.startswith(LOOSE_PREFIX):
            out = want.join(self.loose_objects(), "checksum").select("checksum", "content")
            if verify:
                bad = F.raise_error(F.concat(F.lit("damaged object "), F.col("checksum"))).cast("binary")
                out = out.withColumn("content", F.when(F.sha1("content") == F.col("checksum"), F.col("content")).otherwise(bad))
            return out
        self._fetch(pack)
        frames = self._read("frames", [pack])
        index = layout.assign_frames(self._read("objects", [pack]).join(want, "checksum", "left_semi"), frames)
        return read_objects(index, frames, verify).select("checksum", "content")

    def extract(self, text: str, reset: bool = False, force: bool = False, verify: bool = True) -> dict[str, int]:
        """Makes the work tree the snapshot's: only what differs from HEAD is written or deleted. Numbers of files by kind: A, D, M."""
        try:
            pack, tag = self.find_snapshot(text)
        except SnapshotNotFound:
            if ":" in text or not self.state()["remotes"]:
                raise
            self.update()
            pack, tag = self.find_snapshot(text)
        with self._held(False):
            return self._extract(pack, tag, reset, force, verify)

    def _extract(self, pack: str, tag: str, reset: bool, force: bool, verify: bool) -> dict[str, int]:
        state, head = self.state(), self.state()["head"]
        if head and (head["pack"], head["tag"]) == (pack, tag) and not reset:
            return {"A": 0, "D": 0, "M": 0}
        new = self.snapshot_files(f"{pack}:{tag}")
        if head and not reset:
            if head["pack"] not in state["packs"]:
                raise CorruptHead(f"{head['pack']}:{head['tag']}")
            old = self.snapshot_files(f"{head['pack']}:{head['tag']}")
        else:
            old = new.limit(0)
        changes = diff.entry_diff(old, new)
        plan = diff.extract_plan(old, new)
        counts = {"A": 0, "D": 0, "M": 0} | {r.kind: r.files for r in diff.extract_counts(plan).collect()}
        if not force and not reset:
            tree = worktree(self.spark, self.root, self.data, content=False).select("path", "last_modified")
            bad = diff.dirty(old, plan, tree, F.lit(datetime.fromtimestamp(head["time"], UTC)) if head else F.lit(None).cast("timestamp")).limit(1).collect()
            if bad:
                raise DirtyWorkDir(f"{os.fsdecode(bytes(bad[0].path))}: {bad[0].reason}")
        gone = plan.filter("kind = 'D'").select("path")
        remove_paths(gone, diff.empty_dirs(gone, new.select("path")), self.root)
        entries = changes.filter("change = 'added'").select("path", "checksum", "mode")
        empty = entries.filter(F.col("checksum") == NO_OBJECT).select("path", F.lit(None).cast("binary").alias("content"), "mode")
        real = entries.filter(F.col("checksum") != NO_OBJECT)
        full = real.join(self.contents(pack, real, verify), "checksum", "left")
        lost = F.raise_error(F.concat(F.lit("object not found: "), F.col("checksum"))).cast("binary")
        full = full.select("path", F.coalesce("content", lost).alias("content"), "mode")
        write_tree(full.union(empty), self.root)
        if not self.read_only:
            self._commit({**self.state(), "head": {"pack": pack, "tag": tag, "time": time.time()}})
        return counts

    # --- reading ---------------------------------------------------------------------------------

    def list(self, packs: list[str] | None = None, template: str = "%s") -> DataFrame:
        return catalog.snapshot_lines(log.running_totals(self.changes(packs), self.snapshots(packs)), template).orderBy("line")

    def list_packs(self, template: str = "%p") -> DataFrame:
        sizes = [(p, v["bytes"]) for p, v in self.state()["packs"].items()]
        return catalog.list_packs(self.snapshots(), self.spark.createDataFrame(sizes, "pack string, bytes long"), template).orderBy("line")

    def list_files(self, text: str, template: str = "%o %b %f") -> DataFrame:
        return catalog.list_files(self.snapshot_files(text), template).orderBy("line")

    def find(self, term: str = "") -> DataFrame:
        return catalog.find_snapshots(self.snapshots(), term).orderBy("pack", "seq").select("tag", "pack")

    def show_rows(self, text: str, args: DataFrame) -> DataFrame:
        """args: place, path. place, path, checksum and content of each, as a table; a path that the snapshot lacks is an error."""
        pack, _ = self.find_snapshot(text)
        args = args.select("place", F.col("path").cast("binary").alias("path"))
        met = args.join(self.snapshot_files(text).select("path", "checksum"), "path", "left")
        missing = met.filter("checksum is null").select("path").limit(1).collect()
        if missing:
            raise PathNotFound(os.fsdecode(bytes(missing[0].path)))
        return met.join(self.contents(pack, met), "checksum", "left").select("place", "path", "checksum", "content")

    def show(self, text: str, paths: list[str]) -> bytes:
        """The files' bytes, one after another in the order given."""
        args = self.spark.createDataFrame([(i, os.fsencode(p)) for i, p in enumerate(paths)], "place int, path binary")
        rows = self.show_rows(text, args).orderBy("place").select("content").collect()  # what the caller asked to hold
        return b"".join(bytes(r.content or b"") for r in rows)

    def read_times(self, pack: str, wanted: DataFrame) -> DataFrame:
        """Where the time goes when wanted checksums are read from a pack: phase, seconds, share."""
        self._fetch(pack)
        frames = self._read("frames", [pack])
        return read_times(layout.assign_frames(self._read("objects", [pack]).join(wanted.select("checksum").distinct(), "checksum", "left_semi"), frames), frames)

    # --- garbage ---------------------------------------------------------------------------------

    def gc(self, snapshots: bool = False, objects: bool = False, dry_run: bool = False, parity: bool = False) -> dict:
        """Removes redundant loose snapshots (of the same tag, unless parity), then loose objects no remaining loose snapshot names."""
        if not snapshots and not objects:
            raise LakeError("say what to collect")
        with self._held(not dry_run):
            return self._gc(snapshots, objects, dry_run, parity)

    def _gc(self, snapshots: bool, objects: bool, dry_run: bool, parity: bool) -> dict:
        state = self.state()
        gone: list[tuple[str, str]] = []
        if snapshots:
            rule = catalog.redundant_loose if parity else catalog.redundant_same_tag
            gone = [(r.pack, r.tag) for r in rule(self.fingerprints()).collect()]  # one row a loose snapshot
        out = {"snapshots": sorted(f"{p}:{t}" for p, t in gone), "objects": 0, "bytes": 0}
        state["packs"] = {p: v for p, v in state["packs"].items() if p not in {g for g, _ in gone}}
        if objects:
            roots = [p for p in state["packs"] if p.startswith(LOOSE_PREFIX)]
            named = self.changes(roots).select("pack", "checksum") if roots else self.spark.createDataFrame([], "pack string, checksum string")
            have = self.loose_objects()
            lost = catalog.unreferenced(have.select("checksum", "size"), named)
            stats = lost.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
            out |= {"objects": stats.n, "bytes": stats.b}
            if not dry_run and stats.n:
                kept = self._new("loose_objects")
                have.join(named.select("checksum").distinct(), "checksum", "left_semi").write.parquet(f"file://{kept}")
                state["loose_objects"] = [kept]
        if not dry_run:
            head = state["head"]
            if head and head["pack"] in {g for g, _ in gone}:
                state["head"] = None
                same = self.snapshots([p for p in state["packs"]]).filter((F.col("tag") == head["tag"]) & ~is_loose(F.col("pack"))).limit(1).collect() if state["packs"] else []
                if same:
                    state["head"] = {**head, "pack": same[0].pack}
            self._replace(state)
        return out

    def _replace(self, state: dict) -> None:
        """Commits the state, then deletes the folders that it no longer names."""
        before = self.state()
        self._commit(state)
        keep = set(state["loose_objects"]) | {v["dir"] for v in state["packs"].values()}
        for path in [*before["loose_objects"], *[v["dir"] for v in before["packs"].values()]]:
            if path not in keep:
                shutil.rmtree(path, ignore_errors=True)

    def delete_pack(self, pack: str) -> None:
        """Removes a pack, loose or not. HEAD, if it is in it, is unset. Loose objects stay (see gc)."""
        with self._held(True):
            state = self.state()
            self._pack(pack, state)
            del state["packs"][pack]
            if state["head"] and state["head"]["pack"] == pack:
                state["head"] = None
            self._replace(state)

    def delete_objects(self, checksums: DataFrame) -> int:
        """Removes loose objects (checksum), whoever names them; how many there were."""
        with self._held(True):
            state, have = self.state(), self.loose_objects()
            gone = have.join(checksums.select("checksum").distinct(), "checksum", "left_semi").count()
            if gone:
                kept = self._new("loose_objects")
                have.join(checksums.select("checksum").distinct(), "checksum", "left_anti").write.parquet(f"file://{kept}")
                self._replace({**state, "loose_objects": [kept]})
        return gone

    def remove_loose_all(self) -> None:
        """Removes all loose snapshots and objects. HEAD, if it is one of them, is unset."""
        with self._held(True):
            state = self.state()
            head = state["head"]
            packs = {p: v for p, v in state["packs"].items() if not p.startswith(LOOSE_PREFIX)}
            self._replace({**state, "packs": packs, "loose_objects": [], "head": head if head and head["pack"] in packs else None})

    def head(self) -> str | None:
        """pack:tag of what was stored or extracted last."""
        head = self.state()["head"]
        return f"{head['pack']}:{head['tag']}" if head else None

    def update_head(self, text: str) -> None:
        """Says that the work tree is this snapshot, as of now."""
        pack, tag = self.find_snapshot(text)
        self._commit({**self.state(), "head": {"pack": pack, "tag": tag, "time": time.time()}})

    def explode(self, pack: str, to: str) -> int:
        """Every object of a pack as a file ab/cd/rest below to."""
        objects = self.contents(pack, self._read("objects", [pack]))
        return write_tree(objects.select(loose_path(F.col("checksum")).alias("path"), "content", F.lit(0o644).alias("mode")), to)

    # --- exchange --------------------------------------------------------------------------------

    def export(self, pack: str, folder: str) -> tuple[str, str]:
        """<pack>.pack (one file of frames) and <pack>.pack.idx (its tables) in folder; their SHA-1s, index first."""
        info, stem = self._pack(pack), os.path.join(folder, pack)
        frames = self._read("frames", [pack]).orderBy("frame").collect()
        join_frames([(r.path, r.frame_size, r.decompressed_size) for r in frames], stem + ".pack")
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            for t in INDEX:
                for n in sorted(os.listdir(os.path.join(info["dir"], t))):
                    if n.endswith(".parquet"):
                        z.writestr(zipfile.ZipInfo(f"{t}/{n}"), get(os.path.join(info["dir"], t, n)))
            z.writestr(zipfile.ZipInfo("frames.json"), json.dumps([[r.frame, r.frame_size, r.decompressed_size] for r in frames]))
        write_file(os.fsencode(stem + ".pack.idx"), buf.getvalue(), 0o644)
        return hashlib.sha1(buf.getvalue()).hexdigest(), hashlib.sha1(get(stem + ".pack")).hexdigest()

    def add_remote(self, name: str, url: str) -> None:
        text = (http_get(url, None, INDEX_TIMEOUT, self.transport) or b"").decode()
        read_index(text, name)
        state = self.state()
        state["remotes"][name] = {"url": url, "text": text, "time": time.time()}
        self._commit(state)
        self.update()

    def update(self) -> list[str]:
        """Refreshes all remotes and the indexes that changed; a broken one is skipped. Names of those skipped."""
        state, skipped = self.state(), []
        for name, remote in sorted(state["remotes"].items()):
            try:
                body = http_get(remote["url"], datetime.fromtimestamp(remote["time"], UTC), INDEX_TIMEOUT, self.transport)
                if body is not None:
                    read_index(body.decode(), name)
                    state["remotes"][name] = remote | {"text": body.decode(), "time": time.time()}
            except (OSError, LakeError):
                skipped.append(name)
            for index_sum, pack_sum, url in read_index(state["remotes"][name]["text"], name)[2]:
                pack = url.rsplit("/", 1)[-1].removesuffix(".pack")
                have = state["packs"].get(pack)
                if have and have.get("index") == index_sum:
                    continue
                try:
                    state["packs"][pack] = self._take_index(pack, fetch_checked(url + ".idx", index_sum, self.transport, INDEX_TIMEOUT)) | {"index": index_sum, "url": url, "sha1": pack_sum}
                except (OSError, LakeError):
                    skipped.append(pack)
        self._commit(state)
        return skipped

    def _take_index(self, pack: str, body: bytes) -> dict:
        folder = self._new("packs")
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            for n in z.namelist():
                if ".." in n or n.startswith("/"):
                    raise LakeError(f"{pack}: bad index")
            z.extractall(folder)
            frames = json.loads(z.read("frames.json"))
        self._verified(self.spark.read.schema(CHANGES).parquet(f"file://{folder}/changes"))
        return {"dir": folder, "time": time.time(), "bytes": sum(f[1] for f in frames), "frames": frames}

    def _fetch(self, pack: str) -> None:
        """A pack known by its index alone is fetched, checked and its frames found, when first needed."""
        state = self.state()
        info = self._pack(pack, state)
        if os.path.isdir(os.path.join(info["dir"], "frames")):
            return
        to = os.path.join(info["dir"], pack + ".pack")
        write_file(os.fsencode(to), fetch_checked(info["url"], info["sha1"], self.transport), 0o644)
        rows = [(pack, i, size, data, f"file://{to}", start) for i, (start, size, data) in enumerate(header(to))]
        frames = self.spark.createDataFrame(rows, TABLES["frames"])
        frames.coalesce(1).write.parquet(f"file://{info['dir']}/frames")

    @classmethod
    def clone(cls, spark: SparkSession, url: str, directory: str, transport: Transport = url_open) -> Repo:
        """A new repository in a new directory, with one remote."""
        if os.path.exists(directory):
            raise LakeError(f"{directory} exists")
        own = f"{directory.rstrip('/')}.{uuid.uuid4().hex}"
        os.makedirs(own)
        try:
            # tables name their folders, so the clone is made in place once the remote has answered
            read_index((http_get(url, None, INDEX_TIMEOUT, transport) or b"").decode(), url)
            os.rename(own, directory)
        except BaseException:
            shutil.rmtree(own, ignore_errors=True)
            raise
        repo = cls(spark, directory, transport=transport)
        repo.add_remote("origin", url)
        return repo
