"""Operators of the build-farm tools: commit lists, line sampling, compilation databases."""

from __future__ import annotations

import itertools
import os
import re
import shlex

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import with_prefix


def commits_between(commits: DataFrame, since: str, until: str) -> DataFrame:
    """The mainline commits after the first one of the day `since` and before the day `until` (UTC, yyyy-MM-dd). commits: sha, ts, place (rises from parents to children), mainline.

    Clocks are not trusted to rise along the history, so what opens the range is a place, not a time; if no commit has that day there is no range.
    """
    line = commits.filter(F.col("mainline") & (F.col("ts") < F.lit(until).cast("timestamp")))
    opens = line.filter(F.to_date("ts") == F.lit(since).cast("date")).agg(F.min("place").alias("__opens"))
    return line.join(F.broadcast(opens), F.col("place") > F.col("__opens")).drop("__opens")  # one row


def commit_list(commits: DataFrame, wanted: DataFrame, since: str | None = None, until: str | None = None, digits: int | None = None) -> DataFrame:
    """sha, line and n of the wanted commits. A line has the date, generation number (place among all commits of the range, counted before filtering), time, short sha. commits: sha, ts, place, and mainline where a range is asked for.

    The number has five digits or as many as it needs; with digits it has that many in the line, a longer one its first ones, as SQL's lpad gives it.
    """
    if since and until:
        commits, order = commits_between(commits, since, until), ["place"]
        grains = [F.floor(F.col("place") / 65536)]
    else:
        order, grains = ["ts", "place"], [F.date_format("ts", "yyyyMM"), F.date_format("ts", "yyyyMMddHH")]
    numbered = with_prefix(commits.withColumn("__one", F.lit(1)).withColumn("__all", F.lit(0)), ["__all"], order, "__one", "__before", *grains)
    number = F.col("__before") + 1
    shown = F.format_string("%05d", number) if digits is None else F.lpad(number.cast("string"), digits, "0")
    line = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("-"), shown, F.lit("T"), F.date_format("ts", "HHmmss"), F.lit("-"), F.substring("sha", 1, 15))
    return numbered.join(wanted.select("sha"), "sha", "left_semi").select("sha", line.alias("line"), number.alias("n"))


def _beginnings(text: str) -> list[Column]:
    """Ever longer beginnings of a text column: grains of its order."""
    return [F.substring(F.col(text), 1, n) for n in (4, 16, 64)]


def numbered_lines(lines: DataFrame, line: str, name: str = "n") -> DataFrame:
    """lines with their number in order, from 1: a total order, but no task sees all of them."""
    rows = lines.withColumn("__one", F.lit(1).cast("long")).withColumn("__all", F.lit(0))
    rows = with_prefix(rows, ["__all"], [line], "__one", name, *_beginnings(line))
    return rows.withColumn(name, F.col(name) + 1).drop("__one", "__all")


def every_nth(lines: DataFrame, line: str, n: int) -> DataFrame:
    return numbered_lines(lines, line).filter(F.col("n") % n == 0)


def split_by_bytes(lines: DataFrame, line: str, parts: int) -> DataFrame:
    """Parts of about equal bytes, lines kept whole: a line goes where its first byte falls."""
    rows = lines.withColumn("__len", F.octet_length(line).cast("long") + 1).withColumn("__all", F.lit(0))
    rows = with_prefix(rows, ["__all"], [line], "__len", "__before", *_beginnings(line))
    total = rows.agg(F.sum("__len").alias("__total"))
    part = F.least(F.expr(f"__before * {parts} div __total"), F.lit(parts - 1)).cast("int")
    return rows.join(F.broadcast(total)).select(line, part.alias("part"))  # one row


def month_plan(commits: DataFrame, since: str, until: str, every: int = 1, parts: int = 20, most: int | None = None) -> DataFrame:
    """The commits of a range that are built: sha, line, n and part. Of the first `most` ones (if there is a limit) each `every`-th, in parts of about equal bytes of list."""
    listed = commit_list(commits, commits, since, until)
    if most is not None:
        listed = listed.filter(F.col("n") <= most)
    listed = listed.filter(F.col("n") % every == 0).withColumn("__len", F.octet_length("line").cast("long") + F.octet_length("sha") + 2).withColumn("__all", F.lit(0))
    rows = with_prefix(listed, ["__all"], ["n"], "__len", "__before", F.floor(F.col("n") / 65536))
    total = listed.agg(F.sum("__len").alias("__total"))
    part = F.least(F.expr(f"__before * {parts} div __total"), F.lit(parts - 1)).cast("int")
    return rows.join(F.broadcast(total)).select("sha", "line", "n", part.alias("part"))  # one row


COMMANDS = "kind string, output string, args array<string>, place long"

# How commands of a build are told by their base names, and where CMake's links lie.
ARCHIVE_COMMANDS = ("ar", r"llvm-ar.*")
LIBTOOL_COMMANDS = ("libtool",)
LINK_COMMANDS = (r"c\+\+.*", r"clang(\+\+)?(-\d+)?")
SYMLINK_COMMANDS = ("cmake",)
CMAKE_LINKS = {"cmake_symlink_library": "lib/", "cmake_symlink_executable": "bin/", "create_symlink": "bin/"}
CMAKE_LINKS_OF_MANY = ("cmake_symlink_library",)


def _calls(command: str) -> list[list[str]]:
    """The simple commands of a shell line."""
    lexer = shlex.shlex(command, posix=True, punctuation_chars="();<>|&\n")
    lexer.whitespace_split = True
    lexer.commenters = ""
    calls: list[list[str]] = [[]]
    for word in lexer:
        if word and set(word) <= set("();|&\n"):
            calls.append([])
        else:
            calls[-1].append(word)
    return [c for c in calls if c]


class _Call:
    """A simple command: its words after the name, apart from the values that options take."""

    def __init__(self, words: list[str], output: str, pwd: str):
        self.name, self.words, self.output, self.pwd = os.path.basename(words[0]), words[1:], output, pwd

    def option(self, flag: str) -> tuple[str, list[str]]:
        """The value of an option, and the words that are neither it nor its value nor other options."""
        at = self.words.index(flag) if flag in self.words[:-1] else len(self.words)
        rest = [w for k, w in enumerate(self.words) if k - at not in (0, 1) and w[:1] != "-"]
        return "".join(self.words[at + 1 : at + 2]), rest

    def archive(self) -> list[tuple]:
        names = [w for w in self.words[1:] if w[:1] != "-"]  # the first word says what to do
        return [("archive", names[0], names[1:])] if names else []

    def libtool(self) -> list[tuple]:
        to, members = self.option("-o")
        return [("archive", to, [m for m in members if m != self.name])]

    def link(self) -> list[tuple]:
        return [("link", self.output, [re.sub(r"-\d+$", "", self.name), *self.words])]

    def symlink(self) -> list[tuple]:
        mode, kind, *names = [*self.words, "", ""][: max(2, len(self.words))]
        if mode != "-E" or kind not in CMAKE_LINKS or len(names) < 2:
            return []
        where = CMAKE_LINKS[kind]
        if kind in CMAKE_LINKS_OF_MANY:  # a chain of versions, each pointing to the next
            return [("symlink", a.removeprefix(where), [b]) for a, b in itertools.pairwise(names) if a != b]
        to = names[1]
        return [("symlink", names[0].removeprefix(where), [os.path.relpath(to, self.pwd) if os.path.isabs(to) else to])]


_RULES = [(re.compile("|".join(f"(?:{n})" for n in names)), read) for names, read in ((LIBTOOL_COMMANDS, _Call.libtool), (ARCHIVE_COMMANDS, _Call.archive), (LINK_COMMANDS, _Call.link), (SYMLINK_COMMANDS, _Call.symlink))]


def _classified(words: list[str], output: str | None, pwd: str) -> list[tuple]:
    """(kind, output, args) of what a simple command makes, by the first rule its name matches; nothing for other commands."""
    call = _Call(words, output or "", pwd)
    return next((read(call) for names, read in _RULES if names.fullmatch(call.name)), [])


def parse_commands(db: DataFrame, pwd: str = "/") -> DataFrame:
    """db: command, output, place. Rows of kind archive (output holds args), link (args make output) and symlink (output, as the reader wrote it, points to args[0])."""

    def run(batches):
        for b in batches:
            rows = []
            for command, output, place in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for call in _calls(command or ""):
                    rows += [(k, o, a, place) for k, o, a in _classified(call, output, pwd)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "output", "args", "place"])

    return db.select("command", "output", F.col("place").cast("long")).mapInArrow(run, COMMANDS)


def _archives(commands: DataFrame) -> DataFrame:
    """The members of each archive, as the last command that makes it says."""
    return commands.filter("kind = 'archive'").groupBy("output").agg(F.max_by("args", "place").alias("objects")).withColumnRenamed("output", "arg")


def expand_archives(commands: DataFrame) -> DataFrame:
    """Links with archives replaced by their members: output, n (order), arg. Of a link's members each counts where it comes first; other arguments stay."""
    links = commands.filter("kind = 'link'").select("output", "place", F.posexplode("args").alias("i", "arg"))
    met = links.join(_archives(commands), "arg", "left")
    out = met.select("output", "place", "i", F.col("objects").isNotNull().alias("member"), F.posexplode(F.coalesce("objects", F.array("arg"))).alias("j", "arg"))
    first = F.row_number().over(Window.partitionBy("output", "place", "member", "arg").orderBy("i", "j"))
    out = out.withColumn("__first", F.when(F.col("member"), first).otherwise(1)).filter("__first = 1")
    return out.select("output", "place", "i", "j", "arg")


def build_lines(commands: DataFrame, prune: list[str], prefix_output: bool = False) -> DataFrame:
    """One quoted command line a link, without arguments that start with a pruned prefix."""
    rows = expand_archives(commands)
    for p in prune:
        rows = rows.filter(~F.startswith("arg", F.lit(p)))
    line = rows.groupBy("output", "place").agg(F.array_sort(F.collect_list(F.struct("i", "j", quoted(F.col("arg")).alias("q")))).alias("a"))
    text = F.array_join(F.transform("a", lambda x: x["q"]), " ")
    return line.select("output", (F.concat_ws(" ", F.regexp_extract("output", "[^/]*$", 0), text) if prefix_output else text).alias("line"))


def quoted(arg: Column) -> Column:
    return F.when(arg.rlike("^[A-Za-z0-9_@%+=:,./-]+$"), arg).otherwise(F.concat(F.lit("'"), F.replace(arg, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def dump_objects(commands: DataFrame, outputs: list[str] | None = None) -> DataFrame:
    """Objects that the chosen links use, directly or in archives, in order."""
    links = commands.filter("kind = 'link'")
    if outputs:
        links = links.filter(F.col("output").isin(outputs))
    args = links.select(F.explode("args").alias("arg"))
    inside = args.join(_archives(commands), "arg").select(F.explode("objects").alias("object"))
    return args.filter(F.endswith("arg", F.lit(".o"))).select(F.col("arg").alias("object")).union(inside).distinct().orderBy("object")


def brace(names: list[str]) -> str:
    """Names as one shell brace expression that shares their beginnings: x.o, lib1.a and lib2.a give {lib{1.a,2.a},x.o}."""
    names = sorted(set(names))
    if not names:
        return ""
    lead = os.path.commonprefix(names)
    rest = [n[len(lead) :] for n in names]
    out = shlex.quote(lead) if lead else ""
    if rest == [""]:
        return out
    parts = [brace(list(g)) for _, g in itertools.groupby(rest, lambda r: r[:1])]
    return out + "{" + ",".join(parts) + "}"


def expand_braces(text: str) -> list[str]:
    """The words that a shell makes of a brace expression as `brace` writes it."""

    def words(at: int) -> tuple[list[str], int]:
        done, now = [], [""]
        while at < len(text) and text[at] != "}":
            if text[at] == ",":
                done, now, at = done + now, [""], at + 1
            elif text[at] == "{":
                inner, at = words(at + 1)
                now = [a + b for a in now for b in inner]
                at += 1
            else:
                end = at
                while end < len(text) and text[end] not in "{},":
                    end += 1
                now = [a + "".join(shlex.split(text[at:end])) for a in now]
                at = end
        return done + now, at

    return words(0)[0]
