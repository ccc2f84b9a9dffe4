"""Run parameters with the published defaults."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class SearchParams:
    """Cutoffs of the interactive search."""

    max_desc_dist: float = 2.0
    min_iface: float = 0.75
    min_score: float = 0.8
    min_desc_score: float = 0.0
    max_ca_clashes: float = 0
    max_heavy_clashes: float = 5
    clash_radius: float = 2.0
    outward_shift: float = 0.25
    flip_normals: bool = True
    target_variant: str = "flipped"
    region_radius: float = 10.0
    sites: int = 1
    attempts: int = 1
    vote_rounds: int = 2000
    vote_inlier: float = 1.5
    refine_rounds: int = 5
    min_fitness: float = 0.3
    max_members: int = 200

    def overridden(self, **custom) -> "SearchParams":
        return replace(self, **custom)

    def similarity_mode(self) -> "SearchParams":
        """Search for look-alikes: nothing is flipped or shifted, clashes and scores do not limit."""
        return replace(
            self, flip_normals=False, target_variant="straight", outward_shift=0.0, max_ca_clashes=math.inf, max_heavy_clashes=math.inf, min_score=-1.0, min_desc_score=-1.0
        )


# Presets of the published searches.
HELIX_SEARCH = SearchParams(min_score=0.9)
SHEET_SEARCH = SearchParams(min_iface=0.8, min_score=0.9)
RECOVERY = SearchParams(max_desc_dist=3.0, min_iface=0.0, sites=3)
LARGE_SCAN = SearchParams(max_desc_dist=1.7, min_iface=0.8, min_score=0.9)
