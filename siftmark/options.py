"""Run parameters, with the ranges in which they take effect."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

# The modules in the order in which they run; the index is a module's number.
MODULES = ("ByteDiff", "FuzzyHash", "Format", "Entropy", "Patterns")
# Names under which a module can be asked for.
MODULE_ALIASES = {
    "bytediff": "ByteDiff", "byte": "ByteDiff", "diff": "ByteDiff",
    "fuzzy": "FuzzyHash", "fuzzyhash": "FuzzyHash", "hash": "FuzzyHash",
    "format": "Format", "pe": "Format", "elf": "Format",
    "entropy": "Entropy",
    "patterns": "Patterns", "pattern": "Patterns", "sig": "Patterns",
}


def next_pow2(x: int) -> int:
    """The smallest power of two >= x, at most 2**30."""
    return min(1 << 30, 1 << max(0, (max(1, x) - 1).bit_length()))


@dataclass(frozen=True)
class CompareOptions:
    """Defaults are those of the two-file tool; clamped values come from the properties."""

    modules: frozenset[str] = frozenset(MODULES)
    chunk_min: int = 512
    chunk_avg: int = 2048
    chunk_max: int = 8192
    shingle_k: int = 8
    sketch_size: int = 128
    pattern_length: int = 16
    min_occurrences: int = 2
    max_patterns: int = 50
    entropy_block: int = 256
    max_profile_points: int = 512
    high_entropy: float = 7.0
    weights: dict[str, float] = field(default_factory=lambda: {"ByteDiff": 1.0, "FuzzyHash": 1.0, "Format": 1.0, "Entropy": 0.5, "Patterns": 0.5})
    large_file_bytes: int = 256 * 1024 * 1024
    max_distinct_patterns: int = 2_000_000

    @property
    def cdc(self) -> tuple[int, int, int]:
        """Least chunk, largest chunk, boundary mask."""
        least = max(1, self.chunk_min)
        return least, max(least, self.chunk_max), next_pow2(self.chunk_avg) - 1

    @property
    def shingle(self) -> int:
        return max(1, self.shingle_k)

    @property
    def sketch(self) -> int:
        return max(1, self.sketch_size)

    @property
    def block(self) -> int:
        return max(1, self.entropy_block)

    @property
    def kept_patterns(self) -> int:
        return max(0, self.max_patterns)

    def weight(self, module: str) -> float | None:
        """A module's weight; None where it takes no part: not positive, or not finite."""
        w = self.weights.get(module, 1.0)
        return w if w > 0 and math.isfinite(w) else None

    def with_values(self, **values) -> CompareOptions:
        return replace(self, **values)


def parse_modules(names: str) -> frozenset[str]:
    """Modules of a comma-separated list; an empty one means all.  Unknown names raise ValueError."""
    asked = [n.strip() for n in names.split(",") if n.strip()]
    unknown = [n for n in asked if n.lower() not in MODULE_ALIASES]
    if unknown:
        raise ValueError(f"there is no module {unknown[0]!r}")
    return frozenset(MODULE_ALIASES[n.lower()] for n in asked) or frozenset(MODULES)
