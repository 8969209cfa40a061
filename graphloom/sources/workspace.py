"""A workspace of repositories: a small TOML file, and a table of its repositories."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.files import discover


@dataclass
class Workspace:
    name: str
    repos: list[dict] = field(default_factory=list)  # path, name

    def add(self, path: str, name: str | None = None) -> None:
        """A path is held once."""
        if all(r["path"] != path for r in self.repos):
            self.repos.append({"path": path, "name": name or os.path.basename(path.rstrip("/"))})

    def remove(self, path: str) -> bool:
        """By the stored path, or one that leads to the same place."""
        left = [r for r in self.repos if r["path"] != path and os.path.realpath(r["path"]) != os.path.realpath(path)]
        found = len(left) < len(self.repos)
        self.repos = left
        return found

    def find(self, name: str) -> dict | None:
        return next((r for r in self.repos if r["name"] == name), None)

    def save(self, path: str) -> None:
        lines = [f"name = {json.dumps(self.name)}", ""]
        for repo in self.repos:
            lines += ["[[repos]]", f"path = {json.dumps(repo['path'])}", f"name = {json.dumps(repo['name'])}", ""]
        with open(path, "w") as file:
            file.write("\n".join(lines))

    @classmethod
    def load(cls, path: str) -> Workspace:
        with open(path, "rb") as file:
            found = tomllib.load(file)
        return cls(found["name"], found.get("repos", []))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r["name"], r["path"]) for r in self.repos], "repo string, path string")

    def discover(self, spark: SparkSession, **options) -> DataFrame:
        """The files of all repositories."""
        found = [discover(spark, r["path"], **options) for r in self.repos]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out
