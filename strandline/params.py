"""Settings of a run, with the defaults of each sequencing platform."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from strandline.functions.sequence import thresholds

PLATFORMS = ("subread", "ccs", "ont")
# Those that the ccs platform takes where the default was left.
CCS = {"min_shared": 2, "max_pos_rep": 1, "min_lrt": 1.0, "min_cut_size": 2}


class EmptyStageError(ValueError):
    """A stage found nothing, so that later ones have no input."""


@dataclass(frozen=True)
class Params:
    """coverage is the mean depth and must be over 0; min_cov and max_cov follow from it unless given."""

    coverage: float
    platform: str = "subread"
    min_aln: int = 3000
    min_cov: int | None = None
    max_cov: int | None = None
    min_lrt: float = 1.5
    min_shared: int = 5
    max_pos_rep: int = 3
    min_cut_size: int = 4
    min_cut_len: int = 9000
    restarts: int = 10
    keep: str | None = None  # a folder in which the tables between stages stay under their names; without one they are temporary

    def __post_init__(self):
        if not self.coverage or self.coverage < 0:
            raise ValueError("coverage must be over 0")
        object.__setattr__(self, "platform", str(self.platform).lower())  # SUBREAD, CCS and ONT are the same
        if self.platform not in PLATFORMS:
            raise ValueError(f"platform must be one of {', '.join(PLATFORMS)}")

    def for_platform(self) -> Params:
        """The same with the platform's values in place of untouched defaults."""
        if self.platform != "ccs":
            return self
        default = {f.name: f.default for f in fields(self)}
        return replace(self, **{k: v for k, v in CCS.items() if getattr(self, k) == default[k]})

    @property
    def accuracy(self) -> float:
        return 0.98 if self.platform == "ccs" else 0.8

    @property
    def limits(self) -> dict[str, int]:
        """min_cov, max_cov, min_total and min_reads."""
        out = thresholds(self.coverage)
        given = {"min_cov": self.min_cov, "max_cov": self.max_cov}
        out |= {k: v for k, v in given.items() if v is not None}
        return out | {"min_reads": int(out["min_cov"] / 2)}
