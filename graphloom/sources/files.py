"""Finding source files: one distributed listing, ignore rules as one regular expression, content hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders and files that are never source.
ALWAYS_IGNORED = "node_modules/** .git/** dist/** build/** coverage/** **/*.min.js **/*.map **/*.lock".split()


def glob_regex(pattern: str) -> str:
    """A glob over relative paths: ** spans folders, * and ? don't, {a,b} are alternatives."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in pattern[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def ignore_globs(gitignore: str) -> list[str]:
    """Lines of an ignore file as globs: without a slash they hold in any folder, with one at the end for all below."""
    out = []
    for line in gitignore.splitlines():
        rule = line.strip()
        if not rule or rule.startswith(("#", "!")):
            continue
        anchored, folder = "/" in rule.rstrip("/"), rule.endswith("/")
        rule = rule.strip("/")
        for head in [rule] if anchored else [rule, f"**/{rule}"]:
            out += [f"{head}/**"] if folder else [head, f"{head}/**"]
    return out


def ignored(path: Column, globs: list[str]) -> Column:
    return F.regexp_like(path, F.lit("|".join(map(glob_regex, globs)))) if globs else F.lit(False)


def scan(spark: SparkSession, root: str, pattern: str = "*", gitignore: str = "", ignore: list[str] = ALWAYS_IGNORED) -> DataFrame:
    """path (below root), size, modified, content and hash of all files that no rule ignores."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    )
    below = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    files = found.select(
        below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content"
    ).filter(~ignored(F.col("path"), [*ignore, *ignore_globs(gitignore)]))
    return files.withColumn("hash", F.sha2("content", 256))
