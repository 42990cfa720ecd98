"""Parameters of the analyses, one frozen dataclass for each."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class ReadFilterConfig:
    """max_splits_base, max_splits_kb: supplementary alignments that a read may have, and more for each 1000 bases of it."""

    max_splits_base: float = 3.0
    max_splits_kb: float = 0.05
    include_all_reads: bool = False
    excluded_flags: int = 0x904


@dataclass(frozen=True)
class BaseErrorConfig:
    window: int = 50
    low_depth_fraction: float = 0.1
    depth_cap: float = 1000.0
    terminal: int = 10_000
    mono_ratio: float = 0.9
    mono_gc_ratio: float = 0.6
    gc_ratio: float = 0.9
    relative_support: float = 0.1
    hifi_support: int = 4
    ont_support: int = 3


@dataclass(frozen=True)
class StructuralErrorConfig:
    window: int = 2000
    min_indel: int = 50
    terminal: int = 10_000
    low_depth: float = 0.2
    high_depth: float = 2.0
    event_ratio: float = 0.5
    clean_ratio: float = 0.1
    spanning_window: int = 30_000
    spanning_step: int = 2000


@dataclass(frozen=True)
class RepeatConfig:
    k: int = 150


@dataclass(frozen=True)
class PipelineConfig:
    """Inputs and outputs of a whole run; reads may be BAM or Parquet, masks any number of BED files."""

    short_reads: str
    hifi_reads: str
    ont_reads: str
    reference: str
    output_dir: str
    reference_index: str | None = None
    masks: tuple[str, ...] = ()
    additional_bed: str | None = None
    skip_filter: bool = False
    base_errors: bool = True
    structural_errors: bool = True
    identical_regions: bool = False
    reads: ReadFilterConfig = field(default_factory=ReadFilterConfig)
    be: BaseErrorConfig = field(default_factory=BaseErrorConfig)
    se: StructuralErrorConfig = field(default_factory=StructuralErrorConfig)
    repeats: RepeatConfig = field(default_factory=RepeatConfig)

    def as_dict(self) -> dict:
        return asdict(self)
