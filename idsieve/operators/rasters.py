"""Operators over whole images: one row per image, its planes as arrays of numbers in row order.

An image is bounded by the intake limit, so everything that looks at neighbouring pixels happens inside its row:
stencils run over bands of rows with one halo row on each side, tiles and bands of the page keep three sums
each, and only a few numbers per image come out. No pixel is ever shuffled. The cell operators give
the same results for images that come as tables of cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idsieve.functions.fixed import HEAT_WEIGHTS, HOTSPOT_MIN

BAND = 256


@dataclass(frozen=True)
class Raster:
    tile: int = 32  # of noise
    local_tile: int = 48
    ela_tile: int | None = None  # by default a twelfth of the shorter side, 24 pixels at least
    block: int = 8
    block_step: int | None = None  # by default every second block
    grid: int = 24
    copy_guard: int = 48
    levels: float = 8.0
    edge_threshold: float = 160.0
    copies_of: str = "gray"


def stencil(v: np.ndarray, band: int = BAND) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, values, laplacian, residual, gradient) by bands of rows.

    Residual is the distance to a 3x3 binomial blur. Beyond a border stands the pixel inside of it (reflect-101).
    """
    h, w = v.shape

    def before_after(n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(n)
        back, on = at - 1, at + 1
        back[0], on[-1] = min(1, n - 1), max(n - 2, 0)
        return back, on

    left, right = before_after(w)
    up, down = before_after(h)
    for top in range(0, h, band):
        rows = np.arange(top, min(top + band, h))
        # The band and its halo; the horizontal step is done once per row of it.
        lo, hi = min(rows[0], up[rows].min()), max(rows[-1], down[rows].max()) + 1
        x = v[lo:hi].astype(np.float64)
        across = (x[:, left] + 2 * x + x[:, right]) / 4
        here, above, below = rows - lo, up[rows] - lo, down[rows] - lo
        c = x[here]
        blur = (across[above] + 2 * across[here] + across[below]) / 4
        l, r = c[:, left], c[:, right]
        yield top, c, l + r + x[above] + x[below] - 4 * c, np.abs(c - blur), np.abs(r - l) + np.abs(x[below] - x[above])


class Tiles:
    """Sums over tiles of ``size`` taken every ``step``; a tile starts before max(1, side - size), so the ragged border is left out."""

    def __init__(self, h: int, w: int, size: int, step: int):
        self.size, self.step = size, step
        self.rows, self.cols = (np.arange(0, max(1, n - size), step) for n in (h, w))
        keep = np.arange(w)
        self.keep = keep[(keep % step < size) & (keep // step < len(self.cols))]
        self.starts = np.searchsorted(self.keep, self.cols)
        self.n, self.s, self.q = (np.zeros((len(self.rows), len(self.cols))) for _ in range(3))

    def add(self, top: int, x: np.ndarray) -> None:
        at = np.arange(top, top + len(x))
        ok = (at % self.step < self.size) & (at // self.step < len(self.rows))
        x, tile = x[ok][:, self.keep], at[ok] // self.step
        if len(tile):
            for total, part in ((self.n, np.ones_like(x)), (self.s, x), (self.q, x * x)):
                np.add.at(total, tile, np.add.reduceat(part, self.starts, axis=1))

    @property
    def mean(self) -> np.ndarray:
        return self.s / self.n

    @property
    def var(self) -> np.ndarray:
        return np.maximum(self.q / self.n - self.mean ** 2, 0)


class Moments:
    """Sums of what is added: mean and population variance."""

    def __init__(self):
        self.n, self.s, self.q = 0, 0.0, 0.0

    def add(self, x: np.ndarray) -> None:
        self.n, self.s, self.q = self.n + x.size, self.s + float(x.sum()), self.q + float((x * x).sum())

    @property
    def mean(self) -> float | None:
        return self.s / self.n if self.n else None

    @property
    def var(self) -> float | None:
        return max(self.q / self.n - (self.s / self.n) ** 2, 0.0) if self.n else None


def spread(x: np.ndarray) -> float:
    """clip(std / mean / 5) of tile statistics."""
    return float(np.clip(x.std() / (x.mean() + 1e-6) / 5, 0, 1))


def max_z(x: np.ndarray) -> float:
    sd = x.std()
    return float((x.max() - x.mean()) / (sd + 1e-6)) if sd > 1e-6 else 0.0


def _third(side: int, n: int, parts: int) -> int:
    return side * n // parts


def gray_measures(v: np.ndarray, how: Raster) -> dict[str, float | None]:
    """Pixel statistics, tile inconsistencies and edge bands of a gray plane, in one pass over its bands."""
    h, w = v.shape
    noise, local = Tiles(h, w, how.tile, how.tile), Tiles(h, w, how.local_tile, how.local_tile)
    blocks = Tiles(h, w, how.block, how.block_step or 2 * how.block)
    m = {k: Moments() for k in ("value", "lap", "res", "left", "right", "top", "mid", "bottom", "upper", "lower")}
    rows_of = {"top": (0, max(1, _third(h, 1, 5))), "mid": (_third(h, 1, 3), _third(h, 2, 3)), "bottom": (_third(h, 4, 5), h),
               "upper": (0, max(1, _third(h, 1, 3))), "lower": (_third(h, 2, 3), h)}
    for top, c, lap, res, grad in stencil(v):
        noise.add(top, lap)
        local.add(top, res)
        blocks.add(top, res)
        for k, x in (("value", c), ("lap", lap), ("res", res), ("left", c[:, :_third(w, 1, 3)]), ("right", c[:, _third(w, 2, 3):])):
            m[k].add(x)
        edge = (grad > how.edge_threshold).astype(np.float64)
        for k, (a, b) in rows_of.items():
            m[k].add(edge[max(a - top, 0):max(b - top, 0)])
    lv, rv = m["left"].var or 0.0, m["right"].var or 0.0
    energy = lambda k: None if m[k].mean is None else 255.0 * m[k].mean
    upper, lower = m["upper"].mean, m["lower"].mean
    return {
        "mean_brightness": m["value"].mean, "contrast_std": m["value"].var ** 0.5, "noise_level": m["res"].mean, "laplacian_variance": m["lap"].var,
        "noise_inconsistency": spread(noise.var ** 0.5), "compression_inconsistency": spread(blocks.var), "local_max_z": max_z(local.mean),
        "top_edge": energy("top"), "mid_edge": energy("mid"), "bottom_edge": energy("bottom"),
        "photo_left_bias": float(np.clip((rv - lv) / (rv + lv + 1e-6), -1, 1)),
        "edge_inconsistency": None if upper is None or lower is None else float(np.clip(abs(upper - lower) * 4, 0, 1))}


def blockiness(v: np.ndarray, block: int = 8) -> float:
    """Mean step across block borders over mean step inside blocks, by grid lines of both directions."""
    h, w = (n - n % block for n in v.shape)
    v = v[:h, :w].astype(np.float64)
    border, inside = [], []
    for x in (v, v.T):
        lines = np.abs(np.diff(x, axis=1)).mean(axis=0) if min(x.shape) else np.zeros(0)  # line at - 1 is the step onto column at
        at = np.arange(1, len(lines) + 1)
        border.append(lines[(at % block == 0) & (at >= block)])
        inside.append(lines[(at % block == 2) & (at > block) & (at + 1 < x.shape[1])])
    b, i = np.concatenate(border), np.concatenate(inside)
    return float((b.mean() if len(b) else 0.0) / ((i.mean() if len(i) else 1.0) + 1e-6))


def ela_measures(v: np.ndarray, how: Raster) -> dict[str, float]:
    h, w = v.shape
    size = how.ela_tile or max(24, min(h, w) // 12)
    tiles, all_of = Tiles(h, w, size, size), Moments()
    for top in range(0, h, BAND):
        x = v[top:top + BAND].astype(np.float64)
        tiles.add(top, x)
        all_of.add(x)
    return {"ela_mean": all_of.mean, "ela_max_z": max_z(tiles.mean)}


def normalised(v: np.ndarray) -> np.ndarray:
    """Values scaled by their 5th to 95th percentile, clipped; a flat plane gives 0."""
    lo, hi = np.percentile(v, [5, 95])
    return np.zeros(v.shape) if hi - lo < 1e-6 else np.clip((v - lo) / (hi - lo + 1e-6), 0, 1)


def heat(planes: dict[str, np.ndarray]) -> np.ndarray:
    """The weighted blend of the normalised planes, normalised again."""
    return normalised(sum(HEAT_WEIGHTS[k] * normalised(v) for k, v in planes.items()))


def half_up(x: np.ndarray, n: int = 4) -> np.ndarray:
    return np.floor((x + 1e-9) * 10 ** n + 0.5) / 10 ** n


def grid_scores(score: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean score, pixels) per grid cell."""
    h, w = score.shape
    gr, gc = (((np.arange(n) + 1) * parts - 1) // n for n, parts in ((h, rows), (w, cols)))
    total, count = np.zeros((rows, cols)), np.zeros((rows, cols))
    for top in range(0, h, BAND):
        across = np.zeros((len(score[top:top + BAND]), cols))
        np.add.at(across.T, gc, score[top:top + BAND].T)
        np.add.at(total, gr[top:top + BAND], across)
    np.add.at(count, (gr[:, None], gc[None, :]), 1)
    return half_up(np.divide(total, count, out=np.zeros_like(total), where=count > 0)), count


def block_copies(v: np.ndarray, block: int, guard: int, levels: float) -> float | None:
    """How alike the farthest copies of a repeated block are; None where none is ``guard`` pixels apart.

    Blocks with the same pattern (offsets from their mean in steps of ``levels``) are copies. Two copies that far
    apart exist exactly when the outermost ones along rows or columns are, so no pairs are formed.
    """
    h, w = (n // block for n in v.shape)
    if not h or not w:
        return None
    b = v[:h * block, :w * block].astype(np.float64).reshape(h, block, w, block).transpose(0, 2, 1, 3).reshape(h * w, -1)
    mean, sd = b.mean(axis=1), b.std(axis=1)
    rich = np.flatnonzero(sd > 1e-6)
    if not len(rich):
        return None
    off = (b[rich] - mean[rich, None]) / levels
    # Half steps go away from zero.
    sign = np.ascontiguousarray(np.trunc(off + np.copysign(0.5, off)).astype(np.int16))
    _, of, count = np.unique(sign.view(np.dtype((np.void, sign.shape[1] * 2))).ravel(), return_inverse=True, return_counts=True)
    br, bc = rich // w, rich % w
    best = None
    for first, second in ((br, bc), (bc, br)):
        order = np.lexsort((second, first, of))
        start = np.searchsorted(of[order], np.arange(len(count)))
        a, z = order[start], order[np.r_[start[1:], len(order)] - 1]
        far = (count > 1) & (np.maximum(abs(br[a] - br[z]), abs(bc[a] - bc[z])) * block >= guard)
        a, z = rich[a[far]], rich[z[far]]
        if len(a):
            alike = ((b[a] - mean[a, None]) * (b[z] - mean[z, None])).sum(axis=1) / (b.shape[1] * sd[a] * sd[z])
            best = max(float(alike.max()), -1.0 if best is None else best)
    return None if best is None else float(np.clip(best, 0, 1))


def planes_of(batch: pa.RecordBatch, names: list[str]) -> Iterator[dict[str, np.ndarray | None]]:
    """Each row's planes as two-dimensional arrays, without a copy; a null plane or one of another size is None."""
    h, w = (batch.column(c).to_pylist() for c in ("img_h", "img_w"))
    columns = {k: batch.column(k) for k in names}
    for i in range(batch.num_rows):
        out = {}
        for k, c in columns.items():
            x = c[i].values if c[i].is_valid else None
            ok = x is not None and h[i] and w[i] and len(x) == h[i] * w[i]
            out[k] = x.to_numpy(zero_copy_only=False).reshape(h[i], w[i]) if ok else None
        yield out


SIGNALS = ("ela_inconsistency", "compression_inconsistency", "noise_inconsistency", "edge_inconsistency", "local_image_anomaly", "copy_move_indicators")
STATS = ("mean_brightness", "contrast_std", "noise_level", "laplacian_variance", "noise_inconsistency", "compression_inconsistency", "local_max_z",
         "top_edge", "mid_edge", "bottom_edge", "photo_left_bias", "edge_inconsistency")


def _mapped(images: DataFrame, planes: list[str], schema: str, measure) -> DataFrame:
    """``measure(planes) -> tuple`` for each image; the result has doc_id and the columns of ``schema``."""
    kind = images.schema["doc_id"].dataType.simpleString()
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = [measure(p) for p in planes_of(b, planes)]
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, 256), *[pa.array([None if r is None else r[k] for r in rows[i:i + 256]], t) for k, t in enumerate(types)]],
                    ["doc_id", *names])

    arrow = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}
    types = [arrow[c.strip().split(" ")[1]] for c in schema.split(", ")]
    return images.select("doc_id", "img_h", "img_w", *planes).mapInArrow(run, f"doc_id {kind}, {schema}")


def stencils(images: DataFrame, plane: str = "gray") -> DataFrame:
    """(doc_id, laplacian, residual, gradient): arrays as long as the plane."""

    def measure(p):
        if p[plane] is None:
            return None
        parts = [x[2:] for x in stencil(p[plane])]
        return tuple(np.concatenate([x[k] for x in parts]).ravel() for k in range(3))

    return _mapped(images, [plane], "laplacian array<double>, residual array<double>, gradient array<double>", measure)


def statistics(images: DataFrame, how: Raster = Raster(), plane: str = "gray") -> DataFrame:
    """(doc_id and STATS) of a plane."""

    def measure(p):
        return None if p[plane] is None else tuple(gray_measures(p[plane], how)[k] for k in STATS)

    return _mapped(images, [plane], ", ".join(f"{k} double" for k in STATS), measure)


def block_steps(images: DataFrame, block: int = 8, plane: str = "gray") -> DataFrame:
    return _mapped(images, [plane], "blockiness double", lambda p: None if p[plane] is None else (blockiness(p[plane], block),))


def copies(images: DataFrame, how: Raster = Raster(), plane: str = "gray") -> DataFrame:
    """(doc_id, copy_move_indicators), null without a copy."""
    return _mapped(images, [plane], "copy_move_indicators double",
                   lambda p: None if p[plane] is None else (block_copies(p[plane], how.block, how.copy_guard, how.levels),))


def normals(images: DataFrame, planes: list[str]) -> DataFrame:
    """(doc_id, and each plane normalised by its percentiles)."""
    return _mapped(images, planes, ", ".join(f"{k} array<double>" for k in planes),
                   lambda p: tuple(None if p[k] is None else normalised(p[k]).ravel() for k in planes))


def heat_maps(images: DataFrame, rows: int = 24, cols: int = 24, pixels: bool = False) -> DataFrame:
    """(doc_id, grid, peak_score, mean_score, high_anomaly_coverage, score): the grid row by row, null where a cell has no pixel.

    ``score`` has all pixels, if wanted.
    """
    names = list(HEAT_WEIGHTS)

    def measure(p):
        if any(p[k] is None for k in names):
            return None
        score = heat(p)
        cells, count = grid_scores(score, rows, cols)
        flat = [x if n else None for x, n in zip(cells.ravel().tolist(), count.ravel(), strict=True)]
        summary = half_up(np.array([np.clip(score.max(), 0, 1), np.clip(score.mean(), 0, 1), (score >= HOTSPOT_MIN).mean()]))
        return flat, *summary.tolist(), score.ravel() if pixels else None

    return _mapped(images, names, "grid array<double>, peak_score double, mean_score double, high_anomaly_coverage double, score array<double>", measure)


def tamper_signals(images: DataFrame, how: Raster = Raster()) -> DataFrame:
    """(doc_id, the six signals, hotspot_count, heat summary) in one pass over each image, without any exchange.

    images: doc_id, img_h, img_w, gray, ela, hf, noise. A missing plane leaves its signals null.
    """
    names = ["gray", *HEAT_WEIGHTS, *([how.copies_of] if how.copies_of != "gray" else [])]

    def measure(p):
        gray = gray_measures(p["gray"], how) if p["gray"] is not None else {}
        ela = ela_measures(p["ela"], how) if p["ela"] is not None else None
        source = p[how.copies_of]
        one = lambda x: float(np.clip(x, 0, 1))
        signals = (
            None if ela is None else one(0.55 * (ela["ela_mean"] / 25.0) + 0.45 * (ela["ela_max_z"] / 6.0)),
            gray.get("compression_inconsistency"), gray.get("noise_inconsistency"), gray.get("edge_inconsistency"),
            one(gray["local_max_z"] / 6.0) if gray else None,
            None if source is None else block_copies(source, how.block, how.copy_guard, how.levels))
        if any(p[k] is None for k in HEAT_WEIGHTS):
            return *signals, 0, None, None, None
        score = heat({k: p[k] for k in HEAT_WEIGHTS})
        cells, count = grid_scores(score, how.grid, how.grid)
        summary = half_up(np.array([np.clip(score.max(), 0, 1), np.clip(score.mean(), 0, 1), (score >= HOTSPOT_MIN).mean()]))
        return *signals, int(((cells >= HOTSPOT_MIN) & (count > 0)).sum()), *summary.tolist()

    return _mapped(images, names, ", ".join([*(f"{k} double" for k in SIGNALS), "hotspot_count long", "peak_score double", "mean_score double",
                                             "high_anomaly_coverage double"]), measure)


def cells_of(images: DataFrame, arrays: list[str]) -> DataFrame:
    """Arrays of images as rows (doc_id, r, c and one column per array), without an exchange."""
    zipped = F.arrays_zip(*arrays)
    return images.select("doc_id", "img_w", F.posexplode(zipped).alias("pos", "x")).select(
        "doc_id", F.floor(F.col("pos") / F.col("img_w")).cast("int").alias("r"), (F.col("pos") % F.col("img_w")).cast("int").alias("c"),
        *[F.col("x")[a].alias(a) for a in arrays])
