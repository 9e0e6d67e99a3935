import os
import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class GitRepo:
    """A throwaway repository made of raw objects."""

    def __init__(self, path: Path):
        self.path = str(path)
        subprocess.run(["git", "init", "-q", "-b", "master", self.path], check=True, capture_output=True)

    def git(self, *args: str, data: bytes = b"") -> str:
        env = {"PATH": os.environ["PATH"], "HOME": self.path, "GIT_CONFIG_NOSYSTEM": "1"}
        return subprocess.run(["git", "-C", self.path, *args], input=data, check=True, capture_output=True, env=env).stdout.decode().strip()

    def put(self, kind: str, data: bytes) -> str:
        return self.git("hash-object", "-w", "-t", kind, "--stdin", "--literally", data=data)

    def tree(self, *entries: tuple[str, str, str]) -> str:
        return self.put("tree", b"".join(f"{mode} {name}\0".encode() + bytes.fromhex(oid) for mode, name, oid in entries))

    def commit(self, tree: str, *parents: str, at: int = 1112911993) -> str:
        who = f"Example <example@example.com> {at} -0700"
        lines = [f"tree {tree}", *(f"parent {p}" for p in parents), f"author {who}", f"committer {who}"]
        return self.put("commit", ("\n".join(lines) + "\n\nTest message.\n").encode())

    def tag(self, name: str, oid: str, kind: str) -> str:
        return self.put("tag", f"object {oid}\ntype {kind}\ntag {name}\ntagger Example <example@example.com> 1112911993 -0700\n\nexample\n".encode())

    def ref(self, name: str, oid: str) -> None:
        self.git("update-ref", name, oid)


@pytest.fixture
def git_repo(tmp_path):
    return GitRepo(tmp_path / "repo")
