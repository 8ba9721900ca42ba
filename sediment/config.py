"""Thresholds and fixed lists of the analytics operators."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

#: Directories and file names that are left out.
EXCLUDED_DIRS = ("node_modules", ".git", "__pycache__", ".pytest_cache", "dist", "build", ".next", ".nuxt", "out", "venv", ".venv", "env", ".env", "vendor", "target", ".cargo", "coverage", ".nyc_output", "htmlcov", ".tox", "site-packages", ".mypy_cache", ".ruff_cache", ".hypothesis")
EXCLUDED_NAMES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "Cargo.lock", "go.sum", "go.mod", ".DS_Store", "Thumbs.db")
#: Language by extension.
LANGUAGES = {".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".go": "Go", ".rs": "Rust", ".java": "Java", ".c": "C", ".h": "C/C++ Header", ".cpp": "C++", ".hpp": "C++ Header", ".md": "Markdown", ".yml": "YAML", ".yaml": "YAML", ".toml": "TOML"}
#: Languages that are parsed and scored, that are cut into chunks, and that do not count as code.
PARSEABLE = ("Python", "JavaScript", "TypeScript", "Go", "Rust", "Java", "C", "C++", "C/C++ Header", "C++ Header")
CHUNKABLE = ("Python", "JavaScript", "TypeScript")
NOT_CODE = ("Markdown", "YAML", "TOML", "Unknown")
#: Fixed value: size beyond which a file is left out.
MAX_FILE_BYTES = 150_000
#: Phases of a job in order, and weights of risk levels.
PHASES = ("ingestion", "parsing", "graph", "complexity", "rag", "explain", "docs")
RISK_WEIGHT = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "UNKNOWN": 0}


@dataclass(frozen=True)
class Limits:
    """File counts of the analysis tiers; MAX_FULL_, WARNING_ and SAMPLED_ANALYSIS_FILES override them."""

    full: int = field(default_factory=lambda: int(os.environ.get("MAX_FULL_ANALYSIS_FILES", 300)))
    warning: int = field(default_factory=lambda: int(os.environ.get("WARNING_ANALYSIS_FILES", 1000)))
    sampled: int = field(default_factory=lambda: int(os.environ.get("SAMPLED_ANALYSIS_FILES", 3000)))


@dataclass(frozen=True)
class Risk:
    """Bounds of the risk levels; all are reached at equality."""

    critical_max: float = 21
    high_max: float = 11
    high_avg: float = 10.0
    high_coupling: int = 8
    high_undocumented: float = 0.8
    high_lines: int = 600
    medium_avg: float = 6.0
    medium_coupling: int = 4
    medium_undocumented: float = 0.6
    medium_lines: int = 300
    least_functions: int = 3
