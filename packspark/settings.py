"""Settings of an engine: defaults, overrides from a TOML file, and the paths that follow from them."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from collections.abc import Callable, Mapping
from pathlib import Path

#: Environment variable, TOML file and TOML section that set a workspace up.
WORKSPACE_VARIABLE = "PACKSPARK_WORKSPACE"
SETTINGS_FILE, SETTINGS_SECTION = "packspark.toml", "packspark"

#: Names that are never scanned.
IGNORED = (".git", "node_modules", "dist", "build", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".packspark")

#: Intent -> (recommended, least, most) tokens.
INTENT_BUDGETS = {
    "debug": (6000, 3000, 9000),
    "implement": (8000, 4000, 12000),
    "explain": (4000, 2000, 6000),
    "refactor": (10000, 5000, 15000),
    "review": (5000, 2500, 8000),
}


@dataclasses.dataclass(frozen=True)
class Weights:
    """What each feature counts in a chunk's score (fixed values)."""

    keyword_match: float = 0.4
    path_mention: float = 0.3
    import_proximity: float = 0.2
    recency: float = 0.1


@dataclasses.dataclass(frozen=True)
class Settings:
    """Defaults are fixed values. Settings files may have the keys of IGNORED_KEYS too: no query reads them."""

    workspace_root: str = "."
    ignore_globs: tuple[str, ...] = IGNORED
    default_max_tokens: int = 8000
    intent_budgets: Mapping[str, tuple[int, int, int]] = dataclasses.field(default_factory=lambda: dict(INTENT_BUDGETS))
    grep_context_lines: int = 8
    max_grep_candidates: int = 50
    enable_anchor_inference: bool = True
    max_inferred_anchor_files: int = 3
    inferred_anchor_min_score: float = 1.0
    legacy_query_length_floors: bool = False
    min_chunk_score: float = 0.15
    max_optional_chunks: int | None = None
    max_optional_chunks_upper: int = 4
    max_optional_chunks_floor: int = 1
    events_path: str | None = None
    ml_model_path: str | None = None
    enable_embedding_retriever: bool = False
    manifest_auto_build: bool = True
    weights: Weights = Weights()
    hard_ceiling_factor: float = 1.5
    case_sensitive: bool = False

    @property
    def state_dir(self) -> str:
        return f"{self.workspace_root}/.packspark"

    @property
    def manifest_path(self) -> str:
        return f"{self.state_dir}/manifest.json"

    @property
    def events(self) -> str:
        return self.events_path or f"{self.state_dir}/events.jsonl"

    @property
    def model_path(self) -> str:
        return self.ml_model_path or f"{self.workspace_root}/ml/models/budget_rf_v2"


IGNORED_KEYS = ("max_inferred_anchor_files_upper", "min_label_recall", "label_hard_ceiling_factor", "budget_source", "embedding_model_name")

_Cast = Callable[[object], object]
#: Which keys a TOML file may set, and how their values are taken; bool("false") is True, as in Python.
OVERRIDES: dict[str, _Cast] = {
    "ignore_globs": lambda v: tuple(str(x) for x in v),  # type: ignore[attr-defined]
    "intent_budgets": lambda v: INTENT_BUDGETS | {k: tuple(int(x) for x in b) for k, b in v.items()},  # type: ignore[attr-defined]
    **{k: int for k in ("default_max_tokens", "grep_context_lines", "max_grep_candidates", "max_inferred_anchor_files", "max_optional_chunks", "max_optional_chunks_upper", "max_optional_chunks_floor")},
    **{k: float for k in ("inferred_anchor_min_score", "min_chunk_score")},
    **{k: bool for k in ("enable_anchor_inference", "legacy_query_length_floors", "enable_embedding_retriever", "manifest_auto_build")},
    **{k: str for k in ("ml_model_path",)},
}


def resolve_workspace(root: str | None = None) -> str:
    """The given root, else the one from the environment, else the current folder."""
    return str(Path(root or os.environ.get(WORKSPACE_VARIABLE) or os.getcwd()).expanduser().resolve())


def load(root: str | None = None) -> Settings:
    """Defaults, with the overrides of a settings file at the root; an unreadable file counts as none."""
    where = resolve_workspace(root)
    try:
        with open(Path(where) / SETTINGS_FILE, "rb") as f:
            found = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        found = {}
    section = found.get(SETTINGS_SECTION, found)
    return Settings(workspace_root=where, **{k: cast(section[k]) for k, cast in OVERRIDES.items() if k in section})
