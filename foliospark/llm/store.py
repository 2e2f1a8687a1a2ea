"""Intermediate tables in the folder that every executor shares: the engine's own, under the name used here."""

from __future__ import annotations

from ..store import delete, exists, materialize, new_path, release, shared_dir

__all__ = ["delete", "exists", "materialize", "new_path", "release", "shared_dir"]
