"""Placement rules: first-match collections compiled to Boolean columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.functions.paths import contains_any, extension

KEEP_LOCAL = ("cloud_only", "prefer", "required")
DEFAULT_COLLECTION = "default"


@dataclass(frozen=True)
class Policy:
    keep_local: str = "prefer"
    min_replicas: int = 1
    cloud_choice: str = "most_free"
    clouds: tuple[str, ...] = ()
    local_targets: tuple[str, ...] = ()
    pin_local: bool = False
    dest_subdir: str | None = None

    def __post_init__(self) -> None:
        if self.keep_local not in KEEP_LOCAL:
            raise ValueError(f"keep_local must be one of {KEEP_LOCAL}: {self.keep_local}")
        if self.min_replicas < 1:
            raise ValueError("min_replicas is at least 1")
        if self.cloud_choice not in ("most_free", "specific", "any"):
            raise ValueError(f"unknown cloud choice: {self.cloud_choice}")


@dataclass(frozen=True)
class Rule:
    name: str
    match: Mapping
    policy: Policy = field(default_factory=Policy)


# Columns that the tests read. They are computed once per row, ahead of the tests, because a long
# chain of repeated string calls makes a generated method too large for the JVM to compile.
MATCH_INPUTS = ("_path", "_extension", "_mime")


def with_match_inputs(files: DataFrame) -> DataFrame:
    return files.withColumns({
        "_path": F.lower("path"), "_extension": extension(F.col("path")), "_mime": F.lower("mime")})


def compile_match(match: Mapping) -> Column:
    """Boolean column of nested ``any`` / ``all`` / ``not`` over the leaf tests; never NULL.

    Reads the columns of :func:`with_match_inputs`.
    """
    if len(match) != 1:
        raise ValueError(f"one test per node expected: {sorted(match)}")
    (test, arg), = match.items()
    if test in ("any", "all"):
        out = F.lit(test == "all")
        for child in arg:
            out = (out & compile_match(child)) if test == "all" else (out | compile_match(child))
        return out
    if test == "not":
        return ~compile_match(arg)
    if test == "always":
        return F.lit(bool(arg))
    values = [arg] if isinstance(arg, str) else arg
    if test == "path_contains":
        return contains_any(F.col("_path"), values)
    if test == "extension":
        return F.coalesce(F.col("_extension").isin(*[v.lower().lstrip(".") for v in values]), F.lit(False))
    if test == "mime_prefix":
        hit = F.lit(False)
        for value in values:
            hit = hit | F.col("_mime").startswith(value.lower())
        return F.coalesce(hit, F.lit(False))
    raise ValueError(f"unknown match test: {test}")


def collection_of(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that matches, in document order; reads the match inputs."""
    chain: Column | None = None
    for rule in rules:
        hit = compile_match(rule.match)
        chain = F.when(hit, F.lit(rule.name)) if chain is None else chain.when(hit, F.lit(rule.name))
    default = F.lit(DEFAULT_COLLECTION)
    return default if chain is None else chain.otherwise(default)


def rules_from_document(collections: Iterable[Mapping]) -> list[Rule]:
    """Rules from the parsed ``collections`` list of a configuration document."""
    rules = []
    for entry in collections:
        body = dict(entry.get("policy") or {})
        cloud = body.get("cloud") or {}
        choice, clouds = next(iter(cloud.items()), ("most_free", []))
        rules.append(Rule(entry["name"], entry["match"], Policy(
            keep_local=body.get("keep_local", "prefer"),
            min_replicas=int(body.get("min_replicas", 1)),
            cloud_choice=choice,
            clouds=tuple([clouds] if isinstance(clouds, str) else clouds),
            local_targets=tuple(body.get("prefer_local") or ()),
            pin_local=bool(body.get("pin_local", False)),
            dest_subdir=body.get("dest_subdir"),
        )))
    return rules


# The example policy. Archives come first, so that an archived clip is not kept local.
_ARCHIVE_PATHS = ["\\Archive\\", "\\Archives\\", "\\OldClips\\", "/Archive/", "/Archives/", "/OldClips/"]
EXAMPLE_COLLECTIONS = [
    {"name": "Archives",
     "match": {"any": [{"path_contains": _ARCHIVE_PATHS}, {"extension": ["zip", "7z", "rar"]}]},
     "policy": {"keep_local": "cloud_only", "min_replicas": 1, "cloud": {"specific": "gdrive"},
                "dest_subdir": "Archives"}},
    {"name": "Gaming Clips",
     "match": {"all": [{"any": [{"mime_prefix": "video/"}, {"extension": ["mp4", "mkv", "mov", "webm", "avi"]}]},
                       {"not": {"path_contains": _ARCHIVE_PATHS}}]},
     "policy": {"keep_local": "prefer", "pin_local": False, "min_replicas": 2, "prefer_local": ["local-d"],
                "cloud": {"most_free": ["gdrive", "onedrive"]}, "dest_subdir": "Gaming/Clips"}},
    {"name": "Documents",
     "match": {"any": [{"extension": ["pdf", "docx", "xlsx", "txt", "md"]}, {"mime_prefix": "application/pdf"}]},
     "policy": {"keep_local": "prefer", "min_replicas": 2, "prefer_local": ["local-d"],
                "cloud": {"most_free": ["gdrive", "onedrive"]}, "dest_subdir": "Documents"}},
    {"name": "default",
     "match": {"any": [{"always": True}]},
     "policy": {"keep_local": "prefer", "min_replicas": 1, "cloud": {"most_free": ["gdrive", "onedrive"]}}},
]


def example_rules() -> list[Rule]:
    return rules_from_document(EXAMPLE_COLLECTIONS)
