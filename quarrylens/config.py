"""Thresholds of all signals, in one frozen object that operators take as a default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # commits: one that touches more files than this is bulk, and says nothing about coupling
    bulk_min: int = 8
    bulk_fraction: float = 0.2
    bulk_cap: int = 200
    # activity
    bucket_days: int = 30
    buckets: int = 24
    heat_half_life: float = 30.0
    # size and change
    hotspot_fraction: float = 0.05
    oversized_percentile: float = 0.95
    oversized_loc: int = 400
    stale_days: float = 180.0
    owner_away_days: float = 180.0
    knowledge_share: float = 0.5
    # defects
    bugprone_fraction: float = 0.05
    bugprone_fixes: int = 2
    bugprone_ratio: float = 0.25
    defect_percentile: float = 0.9
    defect_commits: int = 5
    defect_fixes: int = 2
    defect_ratio: float = 0.3
    # trend
    trend_buckets: int = 3
    trend_commits: int = 10
    trend_span_days: float = 150.0
    # imports
    hub_percentile: float = 0.9
    hub_degree: int = 3
    # tenants and novelty
    sole_share: float = 0.9
    sole_commits: int = 3
    new_fraction: float = 0.1
    new_days: float = 30.0
    # downtown
    downtown_fraction: float = 0.05
    downtown_files: int = 3
    weight_coupling: float = 0.35
    weight_imports: float = 0.35
    weight_heat: float = 0.20
    weight_authors: float = 0.10
    # archetypes
    tower_cut: float = 0.75
    slab_cut: float = 0.40
    # folders
    folder_pairs: int = 12
    zone_distance: float = 0.5
    zone_classes: int = 2
    zone_coupling: int = 3
    cooks_months: int = 3
    cooks_authors: int = 5
    cooks_share: float = 0.4
    # hidden coupling
    hidden_commits: int = 3
    hidden_share: float = 0.5
    hidden_pairs: int = 200
    per_file: int = 8
    # owners
    expert_half_life: float = 180.0
    experts: int = 3
    shares: int = 5
    aligned_share: float = 0.10
    # clones
    clone_lines: int = 6
    clone_window: int = 4
    clone_line_chars: int = 6
    clone_source_chars: int = 400_000
    clone_idiom_files: int = 12
    clone_ratio: float = 0.5
    clone_shared: int = 12
    # tests, lists, deltas
    brace_complexity: int = 15
    list_limit: int = 15
    growth_lines: int = 10
    growth_fraction: float = 0.1
    census: int = 30
    packages: int = 40
    debt_per_file: int = 50


DEFAULT = Thresholds()
