"""Constants that define results, and the settings of a run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Ranking:
    """Weighted BM25 and the relaxation policy."""

    weight_title: float = 10.0
    weight_body: float = 1.0
    k1: float = 1.2
    b: float = 0.75
    idf_floor: float = 1e-6
    threshold: int = 7
    limit: int = 10
    rrf_k: int = 60
    rrf_weights: tuple[float, float, float] = (4.0, 1.0, 0.5)


@dataclass(frozen=True)
class AuditConfig:
    """Thresholds of the content-loss audit; ``min_run`` 0 stands for ``n``."""

    n: int = 5
    max_df: int = 4
    content_min_df: int = 5
    min_run: int = 0
    ratio_factor: float = 0.4
    ratio_gate_factor: float = 0.25
    ratio_min_tokens: int = 30
    max_quotes: int = 5

    def __post_init__(self) -> None:
        if self.n < 1:
            raise ValueError("n must be 1 or more")
        if min(self.max_df, self.max_quotes, self.ratio_min_tokens, self.min_run, self.ratio_factor, self.ratio_gate_factor) < 0:
            raise ValueError("audit thresholds must not be negative")
        if self.content_min_df != self.max_df + 1:
            raise ValueError("content_min_df must be max_df + 1")

    @property
    def run(self) -> int:
        return self.min_run or self.n


RANKING = Ranking()
AUDIT = AuditConfig()

#: Bytes after which a quote is cut.
QUOTE_BYTES = 200
#: Largest side, in rows, that an operator broadcasts; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
