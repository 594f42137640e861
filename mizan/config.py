"""Settings: defaults, then the environment (MIZAN_<NAME>), then what the caller gives; checked once."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


# How much a model may reason.
EFFORTS = ("none", "minimal", "low", "medium", "high", "xhigh", "max")


@dataclass(frozen=True)
class Settings:
    auto_accept_score: int = 90
    candidate_display_count: int = 3
    search_candidate_limit: int = 5
    search_retry_rounds: int = 1
    min_candidates_before_fallback: int = 3
    min_cases_for_activation: int = 20
    min_candidates_per_subject: int = 1
    required_subject_coverage_percent: int = 100
    max_document_failure_ratio: float = 0.35
    keep_inactive_generations: int = 2
    stale_max_age_hours: int = 6
    progress_interval_seconds: float = 3.0
    stream_idle_seconds: float = 180.0
    reservation_ttl_minutes: int = 30
    pdf_max_bytes: int = 50 * 1024 * 1024
    pdf_max_pages: int = 1500
    compilation_page_threshold: int = 60
    commentary_input_max_chars: int = 70_000
    commentary_min_text_chars: int = 500
    parser_version: int = 6
    reasoning_effort: str = "high"

    def __post_init__(self) -> None:
        if not 0 <= self.auto_accept_score <= 100:
            raise ValueError("auto_accept_score is 0 to 100")
        if not 1 <= self.required_subject_coverage_percent <= 100:
            raise ValueError("required_subject_coverage_percent is 1 to 100")
        if not 0 <= self.max_document_failure_ratio < 1:
            raise ValueError("max_document_failure_ratio is at least 0 and less than 1")
        object.__setattr__(self, "reasoning_effort", self.reasoning_effort.strip().lower())
        if self.reasoning_effort not in EFFORTS:
            raise ValueError(f"reasoning_effort is one of {', '.join(EFFORTS)}")
        for f in fields(self):
            if f.name not in ("auto_accept_score", "max_document_failure_ratio", "reasoning_effort") and getattr(self, f.name) < 1:
                raise ValueError(f"{f.name} is at least 1")


def load(environment: Mapping[str, str] | None = None, **given: object) -> Settings:
    env = os.environ if environment is None else environment
    found = {f.name: type(f.default)(env[key]) for f in fields(Settings) if (key := f"MIZAN_{f.name.upper()}") in env}
    return Settings(**found | given)
