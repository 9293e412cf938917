"""Whole repositories in temporary directories: store, pack, extract, show, gc, exchange."""

import hashlib
import os
import random
import shutil
import threading

import pytest

from snaplake import cli
from snaplake.files import create_once
from snaplake.model import AmbiguousSnapshot, BadIdentifier, CorruptLog, CorruptPack, DirtyWorkDir, InUse, LakeError, PackNotFound, PathNotFound, SnapshotAlreadyExists, SnapshotNotFound
from snaplake.repo import Repo


def put(root, path, data, mode=0o644):
    at = os.path.join(root, path)
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, "wb") as f:
        f.write(data)
    os.chmod(at, mode)


def tree(root):
    out = {}
    for here, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d != "snaplake_data"]
        for n in names:
            p = os.path.join(here, n)
            with open(p, "rb") as f:
                out[os.path.relpath(p, root)] = (f.read(), os.stat(p).st_mode & 0o777)
    return out


def scribble(root, rng, n=20):
    """Random creations and deletions in two levels of short names, so that files and directories change places."""
    for _ in range(n):
        path = "/".join("".join(rng.choices("abcd", k=1)) for _ in range(rng.randint(1, 3)))
        at = os.path.join(root, path)
        if rng.random() < 0.3 and os.path.lexists(at):
            shutil.rmtree(at) if os.path.isdir(at) else os.unlink(at)
            continue
        top = root
        for part in path.split("/")[:-1]:
            top = os.path.join(top, part)
            if os.path.isfile(top):
                os.unlink(top)
        if os.path.isdir(at):
            shutil.rmtree(at)
        put(root, path, rng.randbytes(rng.choice([0, 1, 100])), rng.choice([0o644, 0o755]))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_history_survives_packing(spark, tmp_path, seed):
    root, rng, want = str(tmp_path / "w"), random.Random(seed), {}
    os.makedirs(root)
    repo = Repo(spark, root)
    for i in range(3):
        scribble(root, rng)
        repo.store(f"s{i}")
        want[f"s{i}"] = tree(root)
    assert repo.extract("loose/s0:s0", force=True) and tree(root) == want["s0"]
    repo.pack("all", frames=3)
    for tag in ("s2", "s1", "s0", "s2"):
        repo.extract(f"all:{tag}", force=True)
        assert tree(root) == want[tag], tag
        listed = {r.line for r in repo.list_files(tag, "%o %f").collect()}
        assert listed == {f"{hashlib.sha1(d).hexdigest()} {p}" for p, (d, _) in want[tag].items()}


@pytest.fixture
def repo(spark, tmp_path):
    root = str(tmp_path / "w")
    put(root, "a/x", b"1" * 1000)
    put(root, ".hidden", b"")
    put(root, "b/_y", b"two", 0o755)
    put(root, "x%b", b"same")
    r = Repo(spark, root)
    r.store("one")
    put(root, "a/x", b"changed")
    os.unlink(os.path.join(root, "x%b"))
    r.store("two")
    return r


def test_listing_and_show(repo):
    assert [r.line for r in repo.list().collect()] == ["loose/one:one", "loose/two:two"]
    assert [r.line for r in repo.list(template="%t %n %b").collect()] == ["one 4 1007", "two 3 10"]
    assert [(r.tag, r.pack) for r in repo.find("w").collect()] == [("two", "loose/two")]
    assert repo.show("one", ["b/_y", "x%b", "b/_y"]) == b"twosametwo"
    with pytest.raises(PathNotFound):
        repo.show("two", ["x%b"])
    assert [r.line for r in repo.list_files("one", "%f").collect()] == [".hidden", "a/x", "b/_y", "x4"]  # a path's %b is replaced too


def test_errors(repo):
    for name in ("no", "loose/one:no"):
        with pytest.raises(SnapshotNotFound):
            repo.extract(name)
    with pytest.raises(BadIdentifier):
        repo.store("a b")
    with pytest.raises(LakeError):
        repo.pack("p", ["nothing"])
    with pytest.raises(LakeError):
        repo.gc()


def test_touched_files_block_extraction(repo):
    put(repo.root, "a/x", b"mine")
    os.utime(os.path.join(repo.root, "a/x"), (2e9 * 2, 2e9 * 2))
    with pytest.raises(DirtyWorkDir):
        repo.extract("one")
    assert repo.extract("one", force=True) == {"A": 1, "D": 0, "M": 1}
    assert repo.extract("one") == {"A": 0, "D": 0, "M": 0}


def test_pack_gc_and_head(repo):
    repo.pack("p")
    assert repo.state()["head"]["pack"] == "p"
    dry = repo.gc(snapshots=True, objects=True, dry_run=True)
    assert dry["snapshots"] == ["loose/one:one", "loose/two:two"] and len(repo.list().collect()) == 4
    done = repo.gc(snapshots=True, objects=True)
    assert (done["snapshots"], done["objects"]) == (dry["snapshots"], 5)
    assert [r.line for r in repo.list().collect()] == ["p:one", "p:two"]
    assert repo.extract("one", force=True)["A"] == 1


def test_ambiguous_and_duplicate_tags(repo):
    repo.pack("p", ["loose/one"])
    put(repo.root, "new", b"new")
    repo.store("one")  # replaces the loose one
    with pytest.raises(AmbiguousSnapshot):
        repo.find_snapshot("one")
    assert repo.find_snapshot("p:one") == ("p", "one")
    state = repo.state()
    state["packs"]["loose/again"] = state["packs"]["loose/one"]
    repo._commit(state)
    with pytest.raises((SnapshotAlreadyExists, LakeError)):
        repo.pack("q", ["loose/one", "loose/one"])


def test_damage_is_found(repo):
    repo.pack("p", frames=1)
    folder = repo.state()["packs"]["p"]["dir"] + "/data"
    name = os.path.join(folder, sorted(n for n in os.listdir(folder) if n.endswith(".zst"))[0])
    with open(name, "r+b") as f:
        f.seek(os.path.getsize(name) // 2)
        f.write(b"\xff\xff")
    with pytest.raises(Exception) as e:
        repo.contents("p", repo.changes(["p"])).collect()
    assert CorruptPack.__name__ in str(e.value) or "zstd" in str(e.value).lower() or "ZstdError" in str(e.value)


def test_explode_and_exchange(spark, repo, tmp_path):
    repo.pack("p", frames=2)
    assert repo.explode("p", str(tmp_path / "exploded")) == 5
    h = hashlib.sha1(b"two").hexdigest()
    assert (tmp_path / "exploded" / h[:2] / h[2:4] / h[4:]).read_bytes() == b"two"
    out = str(tmp_path / "out")
    index, pack = repo.export("p", out)
    esi = f"meta v1\nurl http://host/dir/r.esi\n{index} {pack} p.pack\n{'0' * 40} {'0' * 40} broken.pack\n"
    asked = []

    def transport(url, headers, timeout):
        asked.append(url)
        name = url.rsplit("/", 1)[-1]
        if name == "r.esi":
            return (304, b"") if headers else (200, esi.encode())
        path = os.path.join(out, name)
        return (200, open(path, "rb").read()) if os.path.exists(path) else (404, b"")

    clone = Repo.clone(spark, "http://host/dir/r.esi", str(tmp_path / "clone"), transport)
    assert [r.line for r in clone.list().collect()] == ["p:one", "p:two"]
    assert not any(u.endswith(".pack") for u in asked)  # packs come when needed
    clone.extract("one")
    assert tree(clone.root)["b/_y"] == (b"two", 0o755)
    assert clone.update() == ["broken"]
    with pytest.raises(LakeError):
        Repo.clone(spark, "http://host/dir/r.esi", str(tmp_path / "clone"), transport)


def test_command_line(spark, repo, capsys, tmp_path):
    def call(*argv):
        cli.run(cli.parser().parse_args(argv), spark, repo.root)
        return capsys.readouterr()

    assert call("list").out.split() == ["loose/one:one", "loose/two:two"]
    assert call("find", "on").out.split() == ["one", "loose/one"]
    call("pack", "p", "--frames", "2")
    assert call("list-packs", "--format", "%p %c").out.splitlines()[-1] == "p 2"
    assert "A 1\tD 0\tM 1" in call("extract", "p:one", "--verify").err
    names = tmp_path / "names"
    names.write_bytes(b"a/x\0\0b/_y\0")
    call("store", "some", "--files0-from", str(names))
    assert call("list-files", "some", "--format", "%f").out.split() == ["a/x", "b/_y"]


def test_one_writer_wins(tmp_path):
    for i in range(20):
        won = []
        threads = [threading.Thread(target=lambda n=n, i=i: won.append(n) if create_once(str(tmp_path / f"f{i}"), str(n).encode()) else None) for n in range(16)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(won) == 1 and (tmp_path / f"f{i}").read_text() == str(won[0])
    assert len(os.listdir(tmp_path)) == 20


def test_names_of_any_bytes(spark, tmp_path):
    """Names that are not UTF-8 through store, pack, diff, show and extract, in directories that come and go."""
    root = os.fsencode(str(tmp_path / "w"))
    names = [b"d\xff/\xfe.txt", b"d\xff/sub\x80/x", b"caf\xc3\xa9", b"\xc3", b"plain"]
    for i, n in enumerate(names):
        at = os.path.join(root, n)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(b"body%d" % i)
    repo = Repo(spark, os.fsdecode(root))
    repo.store("full")
    assert {bytes(r.path) for r in repo.snapshot_files("full").collect()} == set(names)
    for n in names[:2]:
        os.unlink(os.path.join(root, n))
    repo.store("less")
    repo.pack("p")
    assert repo.show("p:full", [os.fsdecode(n) for n in names[:2]]) == b"body0body1"
    other = Repo(spark, str(tmp_path / "other"), repo.data)
    for tag in ("full", "less", "full"):
        other.extract(f"p:{tag}", force=True, reset=tag == "full")
        held = {os.path.relpath(os.path.join(h, n), os.fsencode(other.root)) for h, _, f in os.walk(os.fsencode(other.root)) for n in f}
        assert held == (set(names) if tag == "full" else set(names[2:]))
        assert os.path.isdir(os.path.join(os.fsencode(other.root), b"d\xff")) == (tag == "full")
    names_file = tmp_path / "names"
    names_file.write_bytes(b"\0".join(names[2:4]) + b"\0")
    from snaplake.sources.worktree import file_list

    repo.store("some", file_list(spark, str(names_file), nul=True))
    assert {bytes(r.path) for r in repo.snapshot_files("loose/some:some").collect()} == set(names[2:4])


def test_files_that_change_while_they_are_stored(spark, tmp_path, monkeypatch):
    """What a snapshot names is what was read: a change after that is no part of it."""
    root = str(tmp_path / "w")
    put(root, "a", b"before")
    repo = Repo(spark, root)
    whole = repo._write_pack

    def late(*args):
        put(root, "a", b"after, and longer")
        return whole(*args)

    monkeypatch.setattr(repo, "_write_pack", late)
    repo.store("s")
    monkeypatch.undo()
    assert repo.show("s", ["a"]) == b"before"
    objects = {r.checksum: r.size for r in repo.loose_objects().collect()}
    assert {(r.checksum, r.size) for r in repo.snapshot_files("s").collect()} == set(objects.items())


def test_deletes_and_locks(repo):
    repo.pack("p", ["loose/one"])
    assert repo.head() == "loose/two:two"
    other = Repo(repo.spark, repo.root, repo.data)
    with repo.reading(), repo.reading():
        for f in (lambda: other.gc(snapshots=True), lambda: other.delete_pack("p"), other.remove_loose_all, lambda: other.delete_objects(repo.loose_objects())):
            with pytest.raises(InUse):
                f()
        assert other.gc(snapshots=True, dry_run=True)["snapshots"] == ["loose/one:one"]
    x = hashlib.sha1(b"changed").hexdigest()
    assert other.delete_objects(repo.loose_objects().filter(f"checksum = '{x}'")) == 1
    assert other.delete_objects(repo.loose_objects().filter(f"checksum = '{x}'")) == 0
    with pytest.raises(Exception, match="object not found"):
        Repo(repo.spark, repo.root + "2", repo.data).extract("two", reset=True)
    other.update_head("p:one")
    other.remove_loose_all()
    assert other.head() == "p:one" and [r.line for r in other.list().collect()] == ["p:one"]
    assert other.extract("p:one", reset=True)["A"] == 4 and tree(repo.root)["a/x"][0] == b"1" * 1000
    other.delete_pack("p")
    assert other.head() is None and other.list().count() == 0
    with pytest.raises(PackNotFound):
        other.delete_pack("p")


def test_fingerprints_are_told_once(repo):
    from snaplake.operators.diff import snapshot_checksum

    repo.pack("p")
    told = {(r.pack, r.tag): r.fingerprint for r in repo.fingerprints().collect()}
    assert told == {(r.pack, r.tag): r.fingerprint for r in snapshot_checksum(repo.files(), ["pack", "seq", "tag"]).collect()} and len(told) == 4
    shutil.rmtree(repo.state()["packs"]["loose/one"]["dir"] + "/prints")
    assert told == {(r.pack, r.tag): r.fingerprint for r in repo.fingerprints().collect()}


def test_a_corrupt_log_is_told(spark, repo):
    repo.pack("p")
    repo.verify()
    folder = repo.state()["packs"]["p"]["dir"] + "/changes"
    twice = repo.changes(["p"]).filter("op = 'A'").limit(1).collect()
    spark.createDataFrame(twice, repo.changes(["p"]).schema).write.mode("append").parquet(f"file://{folder}")
    with pytest.raises(CorruptLog):
        repo.verify(["p"])
    with pytest.raises(Exception, match="corrupt log"):
        repo.list_files("p:two").collect()
