"""Lineage: input hashes, frozen specifications, holdout protection, budgets."""

from __future__ import annotations

import hashlib
import platform
import subprocess
from typing import Any

import pyspark

from ..sources import files
from ..sources.sinks import stable_json


def path_sha256(path: str) -> str:
    """Digest of a file, or of the names and digests of a folder's part files, on any file system that Spark reads."""
    return files.sha256(path)


def verify_inputs(expected: dict[str, str]) -> None:
    """Error unless every input has the digest that the configuration tells."""
    wrong = sorted(p for p, digest in expected.items() if not files.exists(p) or path_sha256(p) != digest)
    if wrong:
        raise ValueError(f"inputs changed or missing: {', '.join(wrong)}")


def register_sources(paths: dict[str, str], registry: dict[str, str]) -> dict[str, str]:
    """The registry with the digests of further artifacts; one that is registered with another digest is an error (drift)."""
    found = {name: path_sha256(path) for name, path in paths.items()}
    drifted = sorted(n for n, digest in found.items() if registry.get(n, digest) != digest)
    if drifted:
        raise ValueError(f"artifacts have drifted: {', '.join(drifted)}")
    return registry | found


def config_hash(config: Any) -> str:
    return hashlib.sha256(stable_json(config).encode()).hexdigest()


def protect_holdout(splits: set[str], frozen: dict | None) -> None:
    """The holdout is evaluated only under a frozen specification."""
    if "holdout" in splits and not (frozen and frozen.get("frozen")):
        raise ValueError("the holdout needs a frozen specification")


def refuse_change(frozen: dict, proposed: dict, volatile: tuple[str, ...] = ("created_at", "git", "platform")) -> None:
    """A frozen specification never changes, but for volatile keys."""
    keep = lambda d: {k: v for k, v in d.items() if k not in volatile}
    if stable_json(keep(frozen)) != stable_json(keep(proposed)):
        raise ValueError("the frozen specification would change")


def check_budget(spent: float, planned: float, limit: float) -> None:
    if spent + planned > limit:
        raise ValueError(f"budget exceeded: {spent:.6f} + {planned:.6f} > {limit:.6f}")


def provenance(root: str = ".") -> dict[str, str]:
    def git(*args: str) -> str:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
        return done.stdout.strip() if not done.returncode else "unknown"

    return {"commit": git("rev-parse", "HEAD"), "dirty": str(bool(git("status", "--porcelain"))), "python": platform.python_version(), "platform": platform.platform(), "spark": pyspark.__version__}
