"""All constants and options, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

# The sequences of the two adapters that codes select.
ADAPTERS = {
    "n": "GTCAGACACGCAACAGGGGATAGGCAAGGCACACAGGGGATAGG",
    "s": "CTGAGACACGCAACAGGGGATAGGCAAGGCACACAGGGGATAGG",
}


@dataclass(frozen=True)
class Settings:
    """Options of an assembly; the names follow the domain, the comments give the units."""

    pssm_depth: int = 15
    cutoff_buffer: int = 80  # per cent of the slope, as a fallback
    first_score: int = 2000
    gap_open: int = 1000
    gap_extend: int = 200
    flat_match: int = 200
    flat_mismatch: int = -600
    read_n_score: int = -100
    ref_n_score: int = -10
    trim_score: int = 1000
    max_rounds: int = 30
    realign_buffer: int = 50
    qual_offset: int = 33
    min_alignable: int = 15
    min_cons_score: int = -399
    min_cons_lead: int = 2400
    gap_per_cent: int = 50
    max_insert: int = 512
    max_read: int = 256
    max_id: int = 100
    max_desc: int = 128
    kmer_positions: int = 128
    kmer_longest: int = 14
    kmer_saturate: int = 128
    mask_buffer: int = 10
    line_width: int = 60

    kmer: int | None = None  # seed length; None: no seed filter
    soft_mask: bool = False
    circular: bool = False
    distant: bool = False
    homopolymer: bool = False
    iterate: bool = True
    delta: bool = True  # later rounds align only reads that may move
    cons_code: int = 1
    dedup: str | None = None  # None, "score" or "quality"
    adapter_aware: bool = False
    tolerance: int = 0
    collapse: bool = False
    trim: bool = False
    adapter: str = "n"
    hard_cut: int = 0
    slope: float | None = None
    intercept: float | None = None

    def __post_init__(self) -> None:
        if self.hard_cut < 0:
            raise ValueError("the hard cut must be above zero")
        if (self.slope is None) != (self.intercept is None):
            raise ValueError("slope and intercept come together")
        if self.kmer is not None and not 1 <= self.kmer <= self.kmer_longest:
            raise ValueError(f"the seed length must lie in 1..{self.kmer_longest}")

    @property
    def adapter_sequence(self) -> str:
        """A single letter selects a known adapter, longer text is the adapter itself."""
        if len(self.adapter) > 127:
            return ADAPTERS["s"]
        if len(self.adapter) > 1:
            return self.adapter
        return ADAPTERS["n" if self.adapter in ("n", "N") else "s"]
