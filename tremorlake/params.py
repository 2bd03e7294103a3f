"""Settings of each stage; one pinned set of values."""

from __future__ import annotations

from dataclasses import dataclass

KM_PER_DEGREE = 111.0


@dataclass(frozen=True)
class Association:
    """Grid search over origin-time clusters."""

    xy_margin: float = 0.1
    xy_grid: float = 0.02
    z_grids: tuple[float, ...] = (2.0, 5.0, 8.0, 11.0, 14.0, 17.0)
    vp: float = 5.9
    vs: float = 3.45
    ot_dev: float = 2.0
    max_res: float = 1.5
    max_drop: int = 1
    min_sta: int = 4

    @property
    def ot_dev_us(self) -> int:
        return round(self.ot_dev * 1e6)


@dataclass(frozen=True)
class Picking:
    """Trigger, P and S picking on three components; seconds but where said."""

    win_sta: tuple[float, float, float] = (0.8, 0.4, 1.0)
    win_lta: tuple[float, float, float] = (6.0, 2.0, 2.0)
    trig_thres: float = 12.0
    p_win: tuple[float, float] = (0.5, 1.0)
    s_win: float = 10.0
    pca_win: float = 1.0
    pca_range: tuple[float, float] = (0.0, 2.0)
    win_kurt: tuple[float, float] = (5.0, 1.0)
    fd_thres: float = 2.5
    amp_ratio_thres: tuple[float, float, float] = (5.0, 8.0, 3.0)
    amp_win: tuple[float, float] = (1.0, 5.0)
    det_gap: float = 5.0
    max_gap: float = 5.0
    freq_band: tuple[float | None, float | None] = (1.0, 20.0)
    vp: float = 5.9
    vs: float = 3.45


@dataclass(frozen=True)
class Neural:
    """Sliding windows and steps of the neural picker."""

    samp_rate: float = 100.0
    win_len: float = 20.0
    win_stride: float = 10.0
    step_len: float = 0.5
    step_stride: float = 0.1
    trig_thres: float = 0.5
    tp_dev: float = 1.5
    ts_dev: float = 1.5
    amp_win: tuple[float, float] = (1.0, 5.0)
    amp_ratio_thres: tuple[float, float, float] = (5.0, 8.0, 3.0)
    rm_glitch: bool = True
    win_peak: float = 1.0

    @property
    def steps(self) -> int:
        return int((self.win_len - self.step_len) / self.step_stride) + 1


@dataclass(frozen=True)
class Pairing:
    """Event pairs and cross-correlation differential times."""

    loc_dev: tuple[float, float, float] = (5.0, 5.0, 5.0)  # km: latitude, longitude, depth
    num_sta: int = 4
    max_nbr: int = 100
    max_sta: int = 15
    cc_thres: float = 0.3
    dt_thres: tuple[float, float] = (0.5, 0.8)
    win_data_p: tuple[float, float] = (1.0, 2.0)
    win_data_s: tuple[float, float] = (1.0, 3.0)
    win_temp_p: tuple[float, float] = (0.5, 1.0)
    win_temp_s: tuple[float, float] = (0.2, 1.8)
    samp_rate: float = 100.0
    dep_dev: float = 5.0
    epi_max: float = 80.0
    pair_max: float = 4.0


@dataclass(frozen=True)
class Grid:
    """Cells of the relocation region; intervals are (low, high]."""

    lat: tuple[float, float]
    lon: tuple[float, float]
    num: tuple[int, int] = (1, 1)
    pad: tuple[float, float] = (0.0, 0.0)
