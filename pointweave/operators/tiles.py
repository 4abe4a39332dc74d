"""Dense tiles with a halo, for kernels that need whole neighbourhoods.

A raster of at most TILE x TILE cells is one tile, and the kernel's result is exact. A larger one is cut into tiles that
overlap by HALO cells on each side; each tile's core is kept. Order-dependent kernels may differ near borders there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.schema import Frame

TILE, HALO = 2048, 256


#: Side of the tiles of window kernels, whose halo is their reach.
WINDOW_TILE = 256


def on_windows(layers: dict[str, DataFrame], frame: Frame, reach: int, kernel: Callable[..., np.ndarray]) -> DataFrame:
    """Cells (row, col, v) of kernel(**arrays) on tiles with a halo of ``reach``; 0 is a void. Exact for every raster whose
    cells depend on no cell farther away. One shuffle, in which only cells near a border go twice. Arrays end at the
    raster's edge."""
    return on_tiles(layers, frame, lambda **dense: {"v": kernel(**dense)}, ["v"], "int", WINDOW_TILE, reach)


def around(z: np.ndarray, r: int, outside: int, rows: bool = True, cols: bool = True):
    """The array moved to each place of a window; ``outside`` beyond its edge."""
    h, w = z.shape
    wide = np.pad(z, r, constant_values=outside)
    for i in range(2 * r + 1) if rows else (r,):
        for j in range(2 * r + 1) if cols else (r,):
            yield wide[i : i + h, j : j + w]


def on_tiles(layers: dict[str, DataFrame], frame: Frame, kernel: Callable[..., dict[str, np.ndarray]], outputs: list[str], kind: str = "long", side: int = TILE, halo: int = HALO) -> DataFrame:
    """layers: cells by name. kernel(**arrays) returns arrays by output name. Result: row, col and the outputs, non-zero
    in at least one."""
    table = None
    for name, cells in layers.items():
        one = cells.select("row", "col", F.lit(name).alias("layer"), F.col("v").cast("long").alias("v"))
        table = one if table is None else table.unionAll(one)
    if frame.height <= side and frame.width <= side:
        halo = 0
    tile = lambda c: F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side))
    table = table.withColumn("tr", F.explode(tile("row"))).withColumn("tc", F.explode(tile("col")))
    last = (frame.height - 1) // side, (frame.width - 1) // side
    table = table.where(F.col("tr").between(0, last[0]) & F.col("tc").between(0, last[1]))
    names, height, width = list(layers), frame.height, frame.width

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
        r0, c0 = max(0, tr * side - halo), max(0, tc * side - halo)
        r1, c1 = min(height, (tr + 1) * side + halo), min(width, (tc + 1) * side + halo)
        dense = {n: np.zeros((r1 - r0, c1 - c0), np.int64) for n in names}
        for n, own in pdf.groupby("layer"):
            dense[n][own["row"].to_numpy() - r0, own["col"].to_numpy() - c0] = own["v"].to_numpy()
        made = kernel(**dense)
        keep = np.zeros((r1 - r0, c1 - c0), bool)
        keep[tr * side - r0 : (tr + 1) * side - r0, tc * side - c0 : (tc + 1) * side - c0] = True
        keep &= np.any([made[o] != 0 for o in outputs], axis=0)
        row, col = np.nonzero(keep)
        return pd.DataFrame({"row": row + r0, "col": col + c0, **{o: made[o][row, col] for o in outputs}})

    return table.groupBy("tr", "tc").applyInPandas(run, f"row int, col int, {', '.join(f'{o} {kind}' for o in outputs)}")
