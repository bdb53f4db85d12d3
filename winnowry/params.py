"""Parameters of an analysis, validated when made."""

from __future__ import annotations

from dataclasses import dataclass

#: Bases and moduli of the two polynomial hashes.
BASES = (131_071, 524_287)
MODULI = (1_000_000_007, 998_244_353)

MAX_SOURCE_BYTES = 262_144
MAX_SUBMISSIONS = 5_000
GZIP_OVER_BYTES = 65_536


@dataclass(frozen=True)
class Params:
    k: int = 17
    w: int = 4
    max_freq: float = 0.5
    min_shared: int = 5
    flag_threshold: float = 0.35
    corpus_cap: int = 100
    max_regions: int = 200

    def __post_init__(self):
        if self.k < 1 or self.w < 1:
            raise ValueError("k and w must be positive")
        if not 0 <= self.flag_threshold <= 1:
            raise ValueError("flag_threshold must lie in [0, 1]")
        if self.max_freq < 0 or self.min_shared < 0 or self.corpus_cap < 1 or self.max_regions < 1:
            raise ValueError("limits must be positive")
