"""Sub-pixel registration by Fourier cross-correlation: NumPy inside Arrow batches of frame rows (g, h, w, pix).

Frames and template are real, so half of a spectrum in single precision says all: the cross-correlation and its refinement by two small matrices
come from half spectra; only the moved frame is made from the whole one, since its highest frequencies leave the real line.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


#: Points a pixel on which a refinement looks first.
COARSE = 25


class Template:
    """A template's half spectrum, and what depends on the frame size alone."""

    def __init__(self, image: np.ndarray):
        self.h, self.w = image.shape
        self.spectrum = np.fft.rfft2(image.astype(np.float32))
        self.rows = np.fft.fftfreq(self.h).astype(np.float32)
        self.cols = np.fft.fftfreq(self.w).astype(np.float32)[: self.w // 2 + 1]
        # columns that stand for two count twice
        self.weight = np.full(self.w // 2 + 1, 2, np.float32)
        self.weight[0] = 1
        if self.w % 2 == 0:
            self.weight[-1] = 1

    def shift_of(self, spectrum: np.ndarray, factor: int) -> tuple[float, float]:
        """The move (rows, columns) that brings a frame with this half spectrum onto the template."""
        cross = self.spectrum * np.conj(spectrum)
        surface = np.abs(np.fft.irfft2(cross, s=(self.h, self.w)))
        r, c = np.unravel_index(int(np.argmax(surface)), surface.shape)
        r, c = (r - self.h if r > self.h // 2 else r), (c - self.w if c > self.w // 2 else c)
        return self.refined(cross, r, c, factor) if factor > 1 else (float(r), float(c))

    def refined(self, cross: np.ndarray, row: float, col: float, factor: int) -> tuple[float, float]:
        """The peak within 0.75 around (row, col) on a grid of 1 / factor; a fine grid is first seen on every few of its points, which a smooth peak spans."""
        n = math.ceil(1.5 * factor)
        steps = np.arange(n) - n // 2
        rows, cols = np.round(row * factor) + steps, np.round(col * factor) + steps
        every = max(1, factor // COARSE)
        if every > 1:
            i, j = self._best(cross, rows[::every] / factor, cols[::every] / factor)
            around = lambda at: slice(max(0, (at - 2) * every), (at + 2) * every + 1)
            rows, cols = rows[around(i)], cols[around(j)]
        i, j = self._best(cross, rows / factor, cols / factor)
        return float(rows[i] / factor), float(cols[j] / factor)

    def _best(self, cross: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[int, int]:
        left = np.exp((2j * np.pi) * np.outer(rows, self.rows)).astype(np.complex64)
        right = np.exp((2j * np.pi) * np.outer(self.cols, cols)).astype(np.complex64) * self.weight[:, None]
        score = np.abs(((left @ cross) @ right).real)
        i, j = np.unravel_index(int(np.argmax(score)), score.shape)
        return int(i), int(j)

    def moved(self, spectrum: np.ndarray, row: float, col: float) -> np.ndarray:
        """The frame moved by a phase ramp, magnitudes of the inverse. The other half of the spectrum mirrors this one."""
        whole = np.empty((self.h, self.w), np.complex64)
        k = spectrum.shape[1]
        whole[:, :k] = spectrum
        mirror = spectrum[:, self.w - k : 0 : -1]
        whole[0, k:], whole[1:, k:] = np.conj(mirror[0]), np.conj(mirror[:0:-1])
        whole *= np.exp(-2j * np.pi * self.rows * row).astype(np.complex64)[:, None]
        whole *= np.exp(-2j * np.pi * np.fft.fftfreq(self.w) * col).astype(np.complex64)[None, :]
        return np.abs(np.fft.ifft2(whole))


def register(frames: DataFrame, template: np.ndarray, factor: int = 50, shifts_only: bool = False) -> DataFrame:
    """Frames (g, h, w, pix array in row order) on the template: g, shift_r, shift_c, pix. Rows stay in their partitions; the template goes with the closure.

    A frame whose size isn't the template's, or that lacks pixels, raises.
    """
    ship(frames.sparkSession)
    fixed = template.astype(np.float32)
    schema = "g long, shift_r double, shift_c double" + ("" if shifts_only else ", pix array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Template(fixed)
        for b in batches:
            pix = b.column(3)
            values, starts = pix.values.to_numpy(zero_copy_only=False), pix.offsets.to_numpy()
            size = t.h * t.w
            rows, cols, out = np.empty(b.num_rows), np.empty(b.num_rows), None if shifts_only else np.empty((b.num_rows, size))
            for i, (h, w) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if (h, w) != (t.h, t.w) or starts[i + 1] - starts[i] != size:
                    raise ValueError(f"frame {b.column(0)[i].as_py()} has {starts[i + 1] - starts[i]} pixels of {h} x {w}; the template has {t.h} x {t.w}")
                spectrum = np.fft.rfft2(values[starts[i] : starts[i + 1]].reshape(h, w).astype(np.float32))
                rows[i], cols[i] = t.shift_of(spectrum, factor)
                if out is not None:
                    out[i] = t.moved(spectrum, rows[i], cols[i]).ravel()
            columns, names = [b.column(0), pa.array(rows), pa.array(cols)], ["g", "shift_r", "shift_c"]
            if out is not None:
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * size, pa.int32()), pa.array(out.ravel())))
                names.append("pix")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return frames.select(F.col("g").cast("long"), F.col("h").cast("int"), F.col("w").cast("int"), F.col("pix").cast("array<float>")).mapInArrow(run, schema)
