"""The rule catalogue: each rule has a code, a version and the hash of its definition; a changed definition needs a new version."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    code: str
    kind: str
    version: str
    sha256: str


def rule(code: str, kind: str, version: str, *parts: Callable | str) -> Rule:
    """A rule made of functions (by their source) and texts."""
    text = "\n".join([code, version, *(p if isinstance(p, str) else inspect.getsource(p) for p in parts)])
    return Rule(code, kind, version, hashlib.sha256(text.encode()).hexdigest())


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.code, r.kind, r.version, r.sha256) for r in rules], "code string, kind string, version string, sha256 string")


def register(catalogue: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules to append; raises if a code and version is known under another definition."""
    known = catalogue.select("code", "version", catalogue["sha256"].alias("known"))
    changed = rules.join(known, ["code", "version"]).where("sha256 <> known").take(1)
    if changed:
        raise ValueError(f"rule {changed[0]['code']} changed without a new version")
    return rules.join(known, ["code", "version"], "left_anti")
