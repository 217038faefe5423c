"""Thresholds of the route, transit and grid operators, as one frozen object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Radii in metres, distances in kilometres, angles in degrees.
    station_radius_m: float = 5000.0
    bus_radius_m: float = 2000.0
    gtfs_radius_m: float = 150.0
    poi_radius_m: float = 3000.0
    landmark_count: int = 12
    least_trains: int = 2
    sample_step_m: float = 50.0
    refine_step_m: float = 150.0
    bbox_side_deg: float = 3.0
    step_min_km: float = 8.0
    step_max_km: float = 25.0
    skip_connector_m: float = 100.0
    gap_deg: float = 0.05
    spurious_km: float = 10.0
    spurious_share: float = 0.05
    gain_threshold_m: float = 5.0
    walk_kmh: float = 4.0
    climb_m_per_h: float = 300.0
    descend_m_per_h: float = 450.0
    steep_percent: float = 10.0
    grid_pad_deg: float = 0.02
    degree_m: float = 111_320.0
    degree_lon_m: float = 77_400.0
    flat_degree_m: float = 111_000.0
    earth_m: float = 6_371_000.0


CONFIG = Config()
