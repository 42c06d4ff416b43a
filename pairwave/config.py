"""Settings of the two programs."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class BuildConfig:
    """A paired-signal dataset build. The defaults are fixed values."""

    speech_dir: str = ""
    noise_dir: str = ""
    rir_dir: str = ""  # empty: room responses are simulated
    output_dir: str = "./dataset"
    total_samples: int = 10_000
    train_ratio: float = 0.80
    val_ratio: float = 0.10
    test_ratio: float = 0.10
    target_sr: int = 48_000
    segment_duration: float = 4.0
    snr_min: float = -5.0
    snr_max: float = 20.0
    room_dim_range: tuple[tuple[float, float], ...] = ((4.0, 10.0), (4.0, 8.0), (2.5, 4.0))
    rt60_range: tuple[float, float] = (0.15, 0.9)
    nearfield_dist: tuple[float, float] = (0.3, 1.0)
    farfield_dist: tuple[float, float] = (2.0, 6.0)
    seed: int = 42
    output_format: str = "wav"
    output_subtype: str = "PCM_16"
    peak_norm_target: float = 0.95
    segment_samples: int = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "segment_samples", int(self.target_sr * self.segment_duration))
        if abs(self.train_ratio + self.val_ratio + self.test_ratio - 1.0) >= 1e-6:
            raise ValueError("the split ratios must sum to 1")

    def sizes(self) -> dict[str, int]:
        train, val = int(self.total_samples * self.train_ratio), int(self.total_samples * self.val_ratio)
        return {"train": train, "val": val, "test": self.total_samples - train - val}

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class StreamConfig:
    """Block processing of a live stream. The defaults are fixed values."""

    sample_rate: int = 48_000
    block_size: int = 1024
    channels: int = 1
    input_device: int | None = None
    output_device: int | None = None
    enabled: bool = True
    strength: float = 1.0
    gain_db: float = 0.0
    model_path: str | None = None
    status_interval: float = 0.05
