"""Remote catalogues: index files of packs that others hold, and how they are fetched."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BadRemoteIndex, CorruptPack

SEPARATORS = "[ \t]+"
HEX = "^[0-9a-fA-F]{40}$"


def _fields(line: Column) -> Column:
    return F.filter(F.split(line, SEPARATORS), lambda x: x != "")


def remote_lines(spark: SparkSession, path: str) -> DataFrame:
    """remote (file name without ending), number (from 1) and text of each line of the index files."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)(\.esi)?$", 1).alias("remote"), F.col("value"))
    return lines_of(whole)


def lines_of(whole: DataFrame) -> DataFrame:
    """whole: remote, value (a file's text)."""
    lines = whole.select("remote", F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("number", "line"))
    return lines.select("remote", (F.col("number") + 1).alias("number"), "line")


def parse_remotes(lines: DataFrame) -> DataFrame:
    """One row a line that says something: remote, number, kind (meta, url or pack), value, index_checksum, pack_checksum, error (null if the line is well formed)."""
    f = _fields(F.col("line"))
    n = F.size(f)
    keyed = F.when(F.col("number") == 1, F.lit("meta")).when(F.col("number") == 2, F.lit("url"))
    rows = lines.withColumn("f", f).withColumn("n", n).withColumn("kind", F.coalesce(keyed, F.lit("pack")))
    rows = rows.filter((F.col("kind") != "pack") | (F.length("line") > 0))
    at = lambda i: F.get("f", F.lit(i))
    first = F.col("kind") != "pack"
    error = (
        F.when(first & ((F.col("n") < 1) | (at(0) != F.col("kind"))), F.concat(F.lit("the line must begin with "), F.col("kind")))
        .when(first & (F.col("n") < 2), F.concat(F.lit("nothing follows "), F.col("kind")))
        .when(first & (F.col("n") > 2), F.lit("the line goes on after its last field"))
        .when(~first & (F.col("n") < 3), F.lit("a pack line is index checksum, pack checksum, URL"))
        .when(~first & (F.col("n") > 3), F.lit("the line goes on after its last field"))
        .when(~first & ~at(0).rlike(HEX), F.lit("the first field is no checksum"))
        .when(~first & ~at(1).rlike(HEX), F.lit("the second field is no checksum"))
    )
    value = F.when(first, at(1)).otherwise(at(2))
    return rows.select("remote", "number", "kind", value.alias("value"), F.when(~first, F.lower(at(0))).alias("index_checksum"), F.when(~first, F.lower(at(1))).alias("pack_checksum"), error.alias("error"))


def remote_packs(parsed: DataFrame) -> DataFrame:
    """remote, line, index_checksum, pack_checksum, url (absolute). A malformed line is an error that names its file and line."""
    bad = F.raise_error(F.concat_ws(" ", F.col("error"), F.lit("in"), F.col("remote"), F.lit("line"), F.col("number"))).cast("string")
    good = parsed.withColumn("value", F.when(F.col("error").isNotNull(), bad).otherwise(F.col("value")))
    base = good.filter("kind = 'url'").select("remote", F.col("value").alias("base"))
    met = good.filter("kind = 'pack'").join(base, "remote", "left")
    return met.select("remote", F.col("number").alias("line"), "index_checksum", "pack_checksum", joined(F.col("base"), F.col("value")).alias("url"))


def joined(base: Column, url: Column) -> Column:
    """url against base: absolute URLs stay, /paths replace the base's path, other paths its last part. Dots are not folded."""
    root = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1)
    folder = F.when(F.length(base) > F.length(root), F.regexp_extract(base, "^(.*/)[^/]*$", 1)).otherwise(F.concat(root, F.lit("/")))
    return F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), url).when(F.startswith(url, F.lit("/")), F.concat(root, url)).otherwise(F.concat(folder, url))


#: (url, headers, timeout) -> (status, body)
Transport = Callable[[str, dict, float | None], tuple[int, bytes]]
INDEX_TIMEOUT = 15.0  # seconds; packs have none


def url_open(url: str, headers: dict, timeout: float | None) -> tuple[int, bytes]:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


def http_get(url: str, since=None, timeout: float | None = None, transport: Transport = url_open) -> bytes | None:
    """The body; None if it has not changed since."""
    headers = {"If-Modified-Since": since.strftime("%a, %d %b %Y %H:%M:%S GMT")} if since else {}
    status, body = transport(url, headers, timeout)
    if status == 304:
        return None
    if status != 200:
        raise OSError(f"{url}: HTTP status {status}")
    return body


def fetch_checked(url: str, checksum: str, transport: Transport = url_open, timeout: float | None = None) -> bytes:
    body = http_get(url, None, timeout, transport) or b""
    if hashlib.sha1(body).hexdigest() != checksum:
        raise CorruptPack(f"{url}: the checksum is not {checksum}")
    return body


def read_index(text: str, source: str = "") -> tuple[str, str, list[tuple[str, str, str]]]:
    """(meta, url, packs) of one index on the driver: the same rules as parse_remotes, for a file or two."""
    lines = text.split("\n")
    head = []
    for number, key in enumerate(("meta", "url")):
        f = lines[number].split() if number < len(lines) else []
        if len(f) != 2 or f[0] != key:
            raise BadRemoteIndex(f"{source} line {number + 1}: must be {key} and one value")
        head.append(f[1])
    if not urlsplit(head[1]).scheme:
        raise BadRemoteIndex(f"{source} line 2: not a URL: {head[1]}")
    packs = []
    for number, line in enumerate(lines[2:], 3):
        f = line.split()
        if not f:
            continue
        if len(f) != 3 or any(len(x) != 40 or not all(c in "0123456789abcdefABCDEF" for c in x) for x in f[:2]):
            raise BadRemoteIndex(f"{source} line {number}: a pack line is index checksum, pack checksum, URL")
        packs.append((f[0].lower(), f[1].lower(), urljoin(head[1], f[2])))
    return head[0], head[1], packs
