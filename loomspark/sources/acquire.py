"""Getting a repository's tree, and keeping a commit's tree as one archive."""

from __future__ import annotations

import io
import os
import re
import subprocess
import tarfile
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..functions.scalars import IGNORED_DIRS

#: Commits of trees that have none.
UNKNOWN, WORKING_TREE = "unknown", "local-working-tree"


@dataclass(frozen=True)
class Acquired:
    path: str
    commit_sha: str


def is_address(source: str) -> bool:
    """Whether a source is to be cloned: http(s), ssh and git addresses, and user@host:path."""
    return bool(re.match(r"(https?|ssh|git)://|[\w.-]+@[\w.-]+:", source))


def authorised(address: str, token: str | None, user: str = "oauth2") -> str:
    """An https address with the token before its host; others stay."""
    return re.sub(r"^https://(?:[^@/]*@)?", f"https://{user}:{token}@", address) if token and address.startswith("https://") else address


def head(path: str) -> str | None:
    said = subprocess.run(["git", "-C", path, "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    return said.stdout.strip() or None if said.returncode == 0 else None


def acquire(source: str, target: str, ref: str | None = None, token: str | None = None) -> Acquired:
    """A shallow clone of an address below ``target``; a local folder is used where it is."""
    if not is_address(source):
        if not os.path.isdir(source):
            raise FileNotFoundError(source)
        return Acquired(source, head(source) or WORKING_TREE)
    command = ["git", "clone", "--depth", "1", *(["--branch", ref] if ref else []), "--", authorised(source, token), target]
    said = subprocess.run(command, capture_output=True, text=True, check=False, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
    if said.returncode:
        raise RuntimeError(said.stderr.replace(token, "***") if token else said.stderr)  # the token isn't told on
    return Acquired(target, head(target) or UNKNOWN)


def archive(spark: SparkSession, tree: str, target: str, repo_id: str, commit_sha: str) -> str | None:
    """``target``/repo/commit.tar.gz of a local tree without ignored folders; None, and no error, where that fails.

    The tree is one checked-out commit on the driver; the archive goes out through Hadoop's file systems, block by block.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    name = f"{target.rstrip('/')}/{repo_id}/{commit_sha}.tar.gz"
    try:
        at = jvm.org.apache.hadoop.fs.Path(name)
        stream = at.getFileSystem(conf).create(at, True)
        try:
            with tarfile.open(fileobj=_Out(stream), mode="w|gz", bufsize=1 << 20) as tar:
                for folder, names, files in os.walk(tree):
                    names[:] = sorted(n for n in names if n not in IGNORED_DIRS)
                    for f in sorted(files):
                        path = os.path.join(folder, f)
                        if os.path.isfile(path) and not os.path.islink(path):
                            tar.add(path, os.path.relpath(path, tree))
        finally:
            stream.close()
        return name
    except Exception:  # noqa: BLE001  a snapshot that fails must not fail the run
        return None


class _Out(io.RawIOBase):
    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytearray(data))
        return len(data)
