"""Thresholds of the document engine, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """Fixed values that decide results; lengths are points, ratios are fractions."""

    page_height: float = 842.0
    page_width: float = 595.0
    header_band: float = 0.13
    footer_band: float = 0.13
    furniture_ratio: float = 0.30
    furniture_key_length: int = 260
    body_size_low: float = 8.0
    body_size_high: float = 16.0
    body_text_length: int = 20
    body_size_default: float = 12.0
    span_step: float = 0.5
    span_overlap: float = 0.92
    overlay_dy: float = 1.5
    overlay_short: float = 0.85
    overlay_dx: float = 3.0
    overlay_look_back: int = 8
    region_overlap: float = 0.72
    image_in_table: float = 0.85
    region_mutual: float = 0.92
    image_min_area: float = 0.008
    box_tolerance: float = 2.0
    run_dtop: float = 1.6
    run_gap: float = 8.0
    run_gap_size: float = 0.85
    run_line_tolerance: float = 2.0
    heading_length: int = 150
    left_size: float = 1.15
    left_length: int = 8
    left_default: float = 48.0
    indent: float = 12.0
    gap_plain: float = 0.72
    gap_legal: float = 1.05
    gap_callout: float = 0.65
    callout_outdent: float = 15.0
    list_outdent: float = 7.0
    list_hanging: float = 6.0
    base_margin: float = 6.0
    line_min: float = 10.0
    line_factor: float = 1.15
    number_dy: float = 2.5
    number_wider: float = 2.0
    question_length: int = 120
    question_bold: float = 0.30
    edge_gap: float = 4.0
    edge_token_length: int = 24
    edge_tokens: int = 2
    color_saturation: float = 0.30
    color_spread: int = 24
    color_value: int = 48
    near_white: int = 245
    colors: bool = True
    drop_patterns: tuple[str, ...] = ()
    rights_patterns: tuple[str, ...] = ()
    table_pages: tuple[int, ...] = ()
    skip_pages: tuple[int, ...] = ()
    headings: tuple[tuple[int, str, int], ...] = field(default=())
    image_regions: tuple[tuple[int, tuple[float, float, float, float], str], ...] = ()
    title: str = ""
    area: str = ""
    author: str = ""
    title_skip: tuple[str, ...] = ("livro eletrônico",)
    title_blanks: bool = False
    author_skip: tuple[str, ...] = ("CÓDIGO", "PRESIDENTE")
    plain_phrases: tuple[str, ...] = ()
    box_exclusions: tuple[tuple[int | None, str], ...] = ()


DEFAULT = Config()
