"""Parameters of the speech operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    rate: int = 16_000
    frame: int = 400
    hop: int = 160
    n_fft: int = 512
    n_mels: int = 80
    vad_frame: int = 320
    calib_frames: int = 50
    start_frames: int = 5
    end_frames: int = 30
    mode: int = 2
    factor: float | None = None  # overrides the factor of ``mode``
    blank_id: int = 0
    beam_size: int = 1
    block: int = 65_536  # samples in a block of a clip, about

    @property
    def vad_factor(self) -> float:
        """Energy over noise floor that counts as speech: 4, for mode 3 it is 8, for mode 1 it is 2 (mode 0: 4)."""
        return self.factor if self.factor is not None else {3: 8.0, 1: 2.0}.get(self.mode, 4.0)
