"""Source trees as tables: a Python data source that sees every file, hidden and underscored names included.

Batch: spark.read.format("source_tree").option("root", ...).load(). Stream: whenever the tree has
changed, its whole listing comes as a batch, to be compared with what is indexed.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import FILES, LISTING

# File types that are indexed, folders that are not, and what marks a project's root.
EXTENSIONS = (
    ".py", ".pyi", ".pyx",
    ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs",
    ".html", ".htm", ".css", ".scss", ".sass", ".less", ".vue", ".svelte",
    ".c", ".h", ".cpp", ".hpp", ".cc", ".cs",
    ".java", ".kt", ".kts",
    ".go", ".rs", ".swift",
    ".rb", ".php", ".pl", ".pm",
    ".sh", ".bash", ".zsh", ".bat", ".cmd", ".ps1",
    ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".env", ".xml",
    ".md", ".txt", ".rst", ".csv",
    ".gradle", ".cmake", ".makefile", ".dockerfile",
    ".sql",
    ".lua", ".r", ".dart",
    ".graphql", ".gql", ".proto",
)
EXCLUDED = (".venv", "venv", "node_modules", "artifacts", ".corvine", "__pycache__", ".git", ".agents", ".vscode")
ROOT_MARKERS = (".git", "requirements.txt", "package.json", "setup.py", "pyproject.toml", "Cargo.toml", "go.mod", "Gemfile", "pom.xml", "build.gradle")

ROOT_VARIABLE = "CORVINE_PROJECT_ROOT"
FILES_PER_PARTITION = 256
#: Listed paths are so many times as many in a partition as read files.
LISTED = 64


def project_root(start: str | None = None) -> Path:
    """The given folder, else the environment's, else the nearest ancestor of the working folder with a marker, else that folder."""
    if start or os.environ.get(ROOT_VARIABLE):
        return Path(start or os.environ[ROOT_VARIABLE]).resolve()
    here = Path.cwd().resolve()
    for folder in (here, *here.parents):
        if folder != folder.parent and any((folder / m).exists() for m in ROOT_MARKERS):
            return folder
    return here


def is_source(name: str) -> bool:
    """By suffix, as it is written; names without one, dotfiles among them, aren't sources. Scans and streams share this rule."""
    return Path(name).suffix in EXTENSIONS


def walk(root: str) -> Iterator[tuple[str, os.stat_result]]:
    """Relative paths with / and their state, sorted within folders; neither links nor excluded folders are followed, and what vanishes meanwhile is left out."""
    stack = [""]
    while stack:
        folder = stack.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except FileNotFoundError:
            continue
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_symlink():
                continue
            if e.is_dir():
                if e.name not in EXCLUDED:
                    stack.append(path)
            elif is_source(e.name):
                try:
                    yield path, e.stat()
                except FileNotFoundError:
                    continue


def file_row(root: str, path: str) -> tuple:
    """A file as a row of FILES. Its time is read before its content, so that a later change shows."""
    mtime = os.stat(os.path.join(root, path)).st_mtime_ns
    content = Path(root, path).read_bytes()
    return path, Path(path).suffix, content, len(content), hashlib.md5(content).hexdigest(), mtime


class TreePart(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, root: str, per_partition: int):
        self.root, self.per_partition = root, per_partition

    def partitions(self):
        paths = sorted(p for p, _ in walk(self.root))
        return [TreePart(paths[i : i + self.per_partition]) for i in range(0, len(paths), self.per_partition)] or [TreePart([])]

    def read(self, part):
        for path in part.paths:
            yield file_row(self.root, path)


class ListPart(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class TreeStream(DataSourceStreamReader):
    """A new offset when any path, size or time of the tree is new: a digest of its listing, whatever the tree's size. A batch is the whole listing."""

    def __init__(self, root: str, per_partition: int):
        self.root, self.per_partition = root, per_partition

    def _rows(self) -> list[tuple]:
        return sorted((path, state.st_size, state.st_mtime_ns) for path, state in walk(self.root))

    def initialOffset(self):
        return {"state": ""}

    def latestOffset(self):
        digest = hashlib.md5()
        for row in self._rows():
            digest.update(json.dumps(row).encode())
        return {"state": digest.hexdigest()}

    def partitions(self, start, end):
        rows, n = self._rows(), LISTED * self.per_partition
        return [ListPart(rows[i : i + n]) for i in range(0, len(rows), n)] or [ListPart([])]

    def read(self, part):
        yield from part.rows


class SourceTree(DataSource):
    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return LISTING if self.options.get("listing") else FILES

    def reader(self, schema):
        return TreeReader(self.options["root"], int(self.options.get("files_per_partition", FILES_PER_PARTITION)))

    def streamReader(self, schema):
        return TreeStream(self.options["root"], int(self.options.get("files_per_partition", FILES_PER_PARTITION)))


def read_tree(spark: SparkSession, root: str):
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("root", root).load()


def stream_tree(spark: SparkSession, root: str):
    spark.dataSource.register(SourceTree)
    return spark.readStream.format("source_tree").option("root", root).option("listing", "true").load()
