"""Image kernels against the cell operators, plain formulas, and each other in bands."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from idsieve.operators import cells as oc, rasters as ra


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(3)
    out = {1: rng.integers(0, 256, (37, 41)), 2: rng.integers(0, 40, (16, 70)) * 3, 3: np.full((20, 20), 7), 4: rng.integers(0, 256, (1, 9)), 5: rng.integers(0, 256, (9, 1))}
    out[6] = out[1].copy()
    out[6][28:36, 32:40] = out[6][0:8, 0:8]
    return {k: v.astype(float) for k, v in out.items()}


@pytest.fixture(scope="module")
def images(spark, pictures):
    rows = [(k, *v.shape, v.ravel().tolist(), abs(v - 100).ravel().tolist(), (v % 17).ravel().tolist(), (v % 5).ravel().tolist()) for k, v in pictures.items()]
    rows += [(7, 2, 2, None, None, None, None), (8, 3, 3, [1.0], [1.0], [1.0], [1.0])]
    return spark.createDataFrame(rows, "doc_id long, img_h int, img_w int, gray array<double>, ela array<double>, hf array<double>, noise array<double>")


@pytest.fixture(scope="module")
def cells(images):
    whole = images.filter("doc_id < 7")
    d = ra.cells_of(whole, ["gray"]).join(whole.select("doc_id", "img_h", "img_w"), "doc_id")
    return d.withColumn("plane", F.lit("gray")).withColumnRenamed("gray", "value")


def close(got, want, names):
    got, want = ({r["doc_id"]: r for r in d.collect()} for d in (got, want))
    for k, w in want.items():
        for n in names:
            assert got[k][n] == (pytest.approx(w[n], abs=1e-7) if w[n] is not None else None), (k, n)


@pytest.mark.parametrize("band", [1, 2, 7, 1000])
def test_bands_join_up(pictures, band):
    for v in pictures.values():
        whole, parts = ([np.concatenate([x[k] for x in ra.stencil(v, b)]) for k in range(1, 5)] for b in (10_000, band))
        assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_stencils_equal_the_cell_operators(images, cells):
    kernel = ra.cells_of(ra.stencils(images).join(images.select("doc_id", "img_w"), "doc_id"), ["laplacian", "residual", "gradient"])
    got = {(r.doc_id, r.r, r.c): (r.laplacian, r.residual, r.gradient) for r in kernel.collect()}
    want = {(r.doc_id, r.r, r.c): (r.laplacian, r.residual, r.gradient) for r in oc.neighbours(cells).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_statistics_equal_the_cell_operators(images, cells, monkeypatch):
    monkeypatch.setattr(ra, "BAND", 5)
    how = ra.Raster(tile=5, local_tile=4, block=3, edge_threshold=120.0)
    got, m = ra.statistics(images, how), oc.neighbours(cells)
    close(got, oc.pixel_stats(m), ["mean_brightness", "contrast_std", "noise_level", "laplacian_variance"])
    close(got, oc.tile_cv(oc.tiles(m, "laplacian", 5, 5), "tile_std", "noise_inconsistency"), ["noise_inconsistency"])
    close(got, oc.tile_cv(oc.tiles(m, "residual", 3, 6), "tile_var", "compression_inconsistency"), ["compression_inconsistency"])
    close(got, oc.tile_max_z(oc.tiles(m, "residual", 4, 4), "tile_mean", "local_max_z"), ["local_max_z"])
    close(got, oc.edge_bands(m, 120.0), ["top_edge", "bottom_edge", "photo_left_bias", "edge_inconsistency"])
    close(ra.block_steps(images, 4), oc.blockiness(cells.filter("doc_id < 4"), 4), ["blockiness"])


def test_copies(images, cells):
    how = ra.Raster(block=4, copy_guard=12, levels=8.0)
    got = {r.doc_id: r.copy_move_indicators for r in ra.copies(images, how).collect()}
    want = {r.doc_id: r.copy_move_indicators for r in oc.block_copies(cells, 4, 12, 8.0).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {k: pytest.approx(v) for k, v in want.items() if v is not None} and got[6] == pytest.approx(1.0)
    assert got[1] is None and got[7] is None


def test_heat_equals_the_cell_operators(spark, images, pictures):
    planes = [(k, p, r, c, float(x)) for k, v in pictures.items() for p, f in (("ela", abs(v - 100)), ("hf", v % 17), ("noise", v % 5))
              for r, line in enumerate(f) for c, x in enumerate(line)]
    d = spark.createDataFrame(planes, "doc_id long, plane string, r int, c int, value double")
    size = images.select("doc_id", "img_h", "img_w")
    blend = oc.heat_blend(d).join(size, "doc_id")
    maps = ra.heat_maps(images, 4, 5)
    close(maps, oc.heat_summary(blend), ["peak_score", "mean_score", "high_anomaly_coverage"])
    grid = {(r.doc_id, r.grid_row * 5 + r.grid_col): r.score for r in oc.grid(blend, 4, 5).collect()}
    got = {(r.doc_id, i): x for r in maps.collect() for i, x in enumerate(r.grid or []) if x is not None}
    assert got.keys() == grid.keys() and all(got[k] == pytest.approx(grid[k], abs=1.01e-4) for k in grid)


def test_a_large_image_in_one_pass_without_exchange(spark):
    side = 2_000
    made = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(side).alias("img_h"), F.lit(side).alias("img_w"),
                                 F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: (F.pmod(F.xxhash64(i), F.lit(256))).cast("double")).alias("gray"))
    made = made.withColumns({p: F.transform("gray", lambda x, k=k: x * k % 97) for k, p in ((3, "ela"), (5, "hf"), (7, "noise"))})
    out = ra.tamper_signals(made)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    r = out.first()
    assert r.ela_inconsistency is not None and r.hotspot_count == 0 and 0 < r.mean_score < 1 and r.copy_move_indicators is None
