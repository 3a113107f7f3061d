"""Default parameters of every operator.

Each operator takes its parameters as keyword arguments; these are only the
defaults, grouped by subject.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Record conventions shared with the producers of the input tables.
CLASS_NAMES = {0: "disc", 1: "player"}
VIDEO_EXTENSIONS = ("mp4", "avi", "mov", "mkv", "wmv", "flv", "webm")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tiff", "tif")
JERSEY_MIN, JERSEY_MAX = 0, 99
UNKNOWN = "Unknown"
FIELD_LENGTH_M, FIELD_WIDTH_M, END_ZONE_M = 100, 37, 25
DEFAULT_FPS, MIN_FPS, MAX_FPS = 25.0, 1.0, 120.0


@dataclass(frozen=True)
class DetectionDefaults:
    thresholds: dict = field(default_factory=lambda: {"player_model": 0.5, "disc_model": 0.3})
    max_det: dict = field(default_factory=lambda: {"player_model": 50, "disc_model": 5})
    nms_iou: float = 0.45


@dataclass(frozen=True)
class TrackDefaults:
    max_age: int = 10
    n_init: int = 5
    max_cosine_distance: float = 0.2
    max_iou_distance: float = 0.7
    gallery_size: int = 100
    history_length: int = 300


@dataclass(frozen=True)
class JerseyDefaults:
    window: int = 30
    decay: float = 0.95
    center_bonus: float = 0.3
    center_width: float = 0.4
    weight_recent: float = 1.0
    weight_old: float = 0.5
    smoothing: float = 0.1
    min_probability: float = 0.1
    min_ocr_confidence: float = 0.5
    primary_probability: float = 0.5


@dataclass(frozen=True)
class CropDefaults:
    top_fraction: float = 0.45
    min_width: int = 25
    min_height: int = 25


@dataclass(frozen=True)
class FieldDefaults:
    min_contour_area: float = 5000.0
    simplify_epsilon: float = 0.0001
    max_point_distance: float = 20.0
    min_point_distance: float = 3.0
    num_lines: int = 4
    line_distance: float = 5.0
    min_samples: int = 2
    trials: int = 20
    edge_margin: float = 15.0


@dataclass(frozen=True)
class CalibrationDefaults:
    buffer_factor: float = 1.8
    aspect_ratio: float = 3.0
    align_tolerance: float = 5.0
    align_min_length: float = 10.0
    orient_tolerance: float = 15.0
    orient_min_length: float = 20.0
    missing_orientation_penalty: float = 0.5
    expected_ratio: float = 2.7
    ratio_tolerance: float = 0.5
    optimal_coverage: float = 0.75
    luma_threshold: float = 10.0
    max_perspective: float = 0.2
    weights: dict = field(
        default_factory=lambda: {
            "alignment": 0.35,
            "coverage": 0.2,
            "visibility": 0.15,
            "proportion": 0.1,
            "distortion": 0.05,
            "orientation": 0.15,
        }
    )


@dataclass(frozen=True)
class SearchDefaults:
    population: int = 20
    elites: int = 2
    tournament: int = 3
    mutation_rate: float = 0.2
    mutation_amount: float = 0.1
    seed_mutation_rate: float = 1.0
    seed_mutation_amount: float = 0.3
    crossover_rate: float = 0.7
    fitness_goal: float = 0.95
    max_generations: int = 200
    main_range: tuple = (-100.0, 100.0)
    offset_range: tuple = (-10000.0, 10000.0)
    perspective_range: tuple = (-0.2, 0.2)


@dataclass(frozen=True)
class TelemetryDefaults:
    history: int = 120
    fps_samples: int = 30
    recent: int = 10


DETECTION = DetectionDefaults()
TRACK = TrackDefaults()
JERSEY = JerseyDefaults()
CROP = CropDefaults()
FIELD = FieldDefaults()
CALIBRATION = CalibrationDefaults()
SEARCH = SearchDefaults()
TELEMETRY = TelemetryDefaults()
