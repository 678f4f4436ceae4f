"""Thresholds of the engine: immutable, handed to operators as plan literals."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Segment:
    rule_kernel_width: int = 60
    margin_kernel_height: int = 60
    rule_merge_gap: int = 8
    line_gap: int = 14
    min_row_ink: int = 12
    min_line_ink: int = 150
    word_gap: int = 3
    min_col_ink: int = 3
    min_word_width: int = 4
    crop_left: int = 0
    crop_right: int = 0
    crop_top: int = 0
    crop_bottom: int = 0


@dataclass(frozen=True)
class Weights:
    gap: float = 0.55
    indent: float = 0.25
    density: float = 0.20

    def normalized(self) -> Weights:
        """Summing to one; the defaults where the sum isn't positive."""
        total = self.gap + self.indent + self.density
        return Weights(self.gap / total, self.indent / total, self.density / total) if total > 0 else Weights()


@dataclass(frozen=True)
class ParagraphRule:
    weights: Weights = field(default_factory=Weights)
    gap_multiple: float = 3.0
    threshold: float = 0.5


@dataclass(frozen=True)
class QuestionRule:
    header_factor: float = 4.0
    max_gap: int = 45
    short_ratio: float = 0.7


@dataclass(frozen=True)
class AnswerRule:
    density_ratio: float = 0.25
    scribble_px: int = 60
    min_ink: int = 800


@dataclass(frozen=True)
class HighlightRule:
    hue: tuple[int, int] = (18, 40)
    saturation: tuple[int, int] = (60, 255)
    value: tuple[int, int] = (120, 255)
    cleanup: int = 5
    min_area: int = 400
    polygon_off: float = 4.0


@dataclass(frozen=True)
class Preprocess:
    denoise_h: int = 10
    clahe_clip: float = 2.0
    clahe_grid: int = 8
    max_deskew: float = 15.0
    block_size: int = 31
    c: int = 15
    close: int = 3
    open: int = 2

    def odd(self) -> int:
        """The threshold's neighbourhood has to be odd."""
        return self.block_size | 1


@dataclass(frozen=True)
class Review:
    accept: float = 0.90
    review: float = 0.70


@dataclass(frozen=True)
class Transcription:
    model: str = "stub"
    provider: str = "stub"
    endpoint: str = ""
    api_key_env: str = ""
    max_calls_per_page: int = 100
    in_flight: int = 4
    per_second: float = 0.0
    retries: int = 2
    first_pause: float = 0.5
    longest_pause: float = 30.0
    cache: bool = True
    schema_version: str = "line-transcription-v1"
    prompt: str = "Transcribe the handwritten line as it is written. Keep spelling, strike-throughs and insertions; mark what can't be read. Reply in JSON."


@dataclass(frozen=True)
class Config:
    segment: Segment = field(default_factory=Segment)
    paragraph: ParagraphRule = field(default_factory=ParagraphRule)
    question: QuestionRule = field(default_factory=QuestionRule)
    answer: AnswerRule = field(default_factory=AnswerRule)
    highlight: HighlightRule = field(default_factory=HighlightRule)
    preprocess: Preprocess = field(default_factory=Preprocess)
    review: Review = field(default_factory=Review)
    transcription: Transcription = field(default_factory=Transcription)
    render_dpi: int = 150


def from_mapping(values: dict) -> Config:
    """A configuration from nested mappings (as a YAML file gives them); unknown names raise TypeError, absent ones keep their defaults."""
    base = Config()
    parts = {}
    for name, inner in values.items():
        now = getattr(base, name)
        if isinstance(inner, dict):
            inner = {k: Weights(**v).normalized() if k == "weights" else tuple(v) if isinstance(v, list) else v for k, v in inner.items()}
            parts[name] = type(now)(**{**vars(now), **inner})
        else:
            parts[name] = inner
    return Config(**{**vars(base), **parts})


def from_yaml(path: str) -> Config:
    """A configuration from a YAML file over the defaults."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f) or {})


CONFIG = Config()
