"""Settings of mining and checking."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class MiningConfig:
    """Training settings are those that change what is counted; the rest only matters when asking."""

    min_support: int = 10
    max_transaction_size: int = 30
    max_examples_per_pair: int = 10
    default_min_confidence: float = 0.6
    fail_confidence: float = 0.7
    facet_floor: float = 0.6
    min_facet_support: int = 5
    facet_candidate_floor: float = 0.5
    max_facets_per_entity: int = 64
    facet_max_depth: int = 3
    history_window: int = 0
    unit_history_window: int = 5000
    unit_min_support: int = 10
    unit_max_transaction_size: int = 50
    example_count: int = 3

    TRAINING = (
        "min_support", "max_transaction_size", "max_examples_per_pair", "facet_candidate_floor", "max_facets_per_entity",
        "facet_max_depth", "history_window",
    )

    def __post_init__(self) -> None:
        for name in ("default_min_confidence", "fail_confidence", "facet_floor", "facet_candidate_floor"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie above 0, and at 1 at most")
        for name in ("min_support", "max_examples_per_pair", "min_facet_support", "max_facets_per_entity", "facet_max_depth", "unit_min_support",
                     "max_transaction_size", "unit_max_transaction_size"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.history_window < 0 or self.unit_history_window < 0:
            raise ValueError("a history window can't be negative; 0 means all")

    def training(self) -> dict[str, float]:
        """The settings under which stored counts stay valid."""
        return {k: v for k, v in asdict(self).items() if k in self.TRAINING}

    def for_units(self) -> MiningConfig:
        """The same settings one level down."""
        return MiningConfig(**asdict(self) | {
            "min_support": self.unit_min_support, "max_transaction_size": self.unit_max_transaction_size,
            "history_window": self.unit_history_window,
        })
