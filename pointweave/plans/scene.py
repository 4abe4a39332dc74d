"""Scene classifier: points (or a surface raster) to surface, terrain, intensity, classes, buildings and outlines.

Products are lazy and remembered; ones that several others need are written to the shared folder once.
"""

from __future__ import annotations

import re
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.dense import classify_ground, refine_objects
from pointweave.operators import algebra, classify, components, focal, grid, pyramid, vector
from pointweave.operators.tiles import on_tiles
from pointweave.plans.storage import store
from pointweave.schema import CloudMeta, Raster, SceneParams
from pointweave.sources import files

#: Products in order, with the suffixes of their outputs.
PRODUCTS = {
    "DSM": "_DSM", "MIN": "_MIN", "DTM0": "_DTM0", "DTM": "_DTM", "DSM2": "_DSM2", "INT": "_INT", "MINAGL": "_MINAGL", "LABEL0": "_LABEL0", "LABEL": "_LABEL", "CLASS": "_class", "BUILDING": "_building",
    "LABELS": "_blabels", "LABELS3": "_blabels3", "OUTLINES": "_outlines",
}
DEFAULT_PRODUCTS = ("DSM", "MIN", "DTM", "INT", "CLASS", "BUILDING", "OUTLINES")


def parse_bounds(text: str) -> tuple[float, float, float, float]:
    """([xmin, xmax], [ymin, ymax]) or four numbers xmin, xmax, ymin, ymax."""
    numbers = [float(x) for x in re.findall(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", text)]
    if len(numbers) != 4:
        raise ValueError(f"bounds need four numbers: {text!r}")
    return tuple(numbers)


class Scene:
    def __init__(self, points: DataFrame | None = None, params: SceneParams | None = None, surface: Raster | None = None, terrain: Raster | None = None, zone: int = 0):
        if points is None and surface is None:
            raise ValueError("a scene needs points or a surface raster")
        self.points, self.params, self._surface, self._terrain, self._zone = points, params or SceneParams(), surface, terrain, zone

    def _kept(self, r: Raster, name: str) -> Raster:
        return r.with_cells(store(r.cells.select("row", "col", "v"), name))

    @cached_property
    def meta(self) -> CloudMeta:
        return grid.cloud_meta(self.points, self._zone)

    @property
    def reach(self) -> int:
        return max(1, int(self.params.dh / self.dsm.frame.gsd))

    @cached_property
    def dsm(self) -> Raster:
        p = self.params
        if self.points is None:
            return self._surface
        raw = grid.grid(self.points, self.meta, p.dh, "max", p.bounds)
        smooth = focal.quantile(raw, 1, 0.4, raw.frame.units(p.agl))
        return self._kept(pyramid.fill(focal.wells(smooth, p), levels=2), "dsm")

    @cached_property
    def low(self) -> Raster:
        p = self.params
        if self.points is None:
            raw = focal.minimum(self.dsm, 4, self.dsm.frame.units(p.agl))
        else:
            raw = grid.grid(self.points, self.meta, p.dh, "min", p.bounds)
            raw = focal.quantile(raw, 2, 0.33, raw.frame.units(p.agl))
        low = pyramid.fill(raw, levels=2)
        if self._terrain is not None:
            low = algebra.at_least(low, self._given_terrain)
        return self._kept(low, "min")

    @cached_property
    def dsm2(self) -> Raster:
        return self._kept(focal.tree_voids(self.dsm, self.low, self.params), "dsm2")

    @cached_property
    def _given_terrain(self) -> Raster:
        """A supplied terrain in the surface's scale. Its frame has to be the surface's."""
        t, f = self._terrain.frame, self.dsm.frame
        if (t.gsd, t.easting, t.northing, t.width, t.height) != (f.gsd, f.easting, f.northing, f.width, f.height):
            raise ValueError("the terrain raster's frame differs from the surface's")
        return algebra.rescale(self._terrain, f.offset, f.scale)

    @cached_property
    def _ground(self) -> tuple[Raster, DataFrame]:
        p, dsm = self.params, self.dsm
        nothing = dsm.cells.sparkSession.createDataFrame([], "row int, col int, v long")
        if self._terrain is not None:
            return self._given_terrain, nothing
        if p.ground_label >= 0:
            own = grid.crop_to_class(self.points, p.ground_label)
            raw = grid.grid(own, grid.cloud_meta(own), p.dh, "max", like=dsm.frame)
            filled = pyramid.fill(algebra.rescale(raw, dsm.frame.offset, dsm.frame.scale), smooth=True)
            return self._kept(algebra.void_where_void(filled, dsm), "dtm0"), nothing
        gsd, reach, dz = dsm.frame.gsd, self.reach, dsm.frame.units(p.dz)

        def kernel(surface, low):
            terrain, labels = classify_ground(surface, low, gsd, reach, dz)
            return {"terrain": terrain, "label": labels}

        both = store(on_tiles({"surface": self.dsm2.cells, "low": self.low.cells}, dsm.frame, kernel, ["terrain", "label"]), "ground")
        terrain = dsm.with_cells(both.where("terrain != 0").select("row", "col", F.col("terrain").cast("int").alias("v")))
        terrain = focal.median(algebra.void_where_void(terrain, self.low), 1, dsm.frame.units(p.dz))
        return self._kept(terrain, "dtm0"), both.where("label = 1").select("row", "col", F.col("label").alias("v"))

    @cached_property
    def dtm0(self) -> Raster:
        return self._ground[0]

    @cached_property
    def label0(self) -> DataFrame:
        """Cells with v = 1 for object candidates of the ground step; with a given terrain none is known."""
        return self._ground[1]

    @cached_property
    def labels(self) -> DataFrame:
        p, f = self.params, self.dsm.frame
        every = self._terrain is not None or p.ground_label >= 0  # then every cell is a candidate
        gsd, dz, agl, area = f.gsd, f.units(p.dz), f.units(p.agl), p.area

        def kernel(surface, terrain, label):
            from pointweave.schema import GROUND

            start = label * 0 + 1 if every else label
            import numpy as np

            out = refine_objects(surface, terrain, np.where(start != 0, 1, GROUND), gsd, dz, agl, area)
            return {"v": np.where(out == GROUND, 0, 1)}

        return store(on_tiles({"surface": self.dsm2.cells, "terrain": self.dtm0.cells, "label": self.label0}, f, kernel, ["v"]), "labels")

    @cached_property
    def dtm(self) -> Raster:
        return self._kept(pyramid.fill(self.dtm0, levels=2), "dtm")

    @cached_property
    def intensity(self) -> Raster:
        if self.points is None:
            raise ValueError("intensity needs points")
        return self._kept(pyramid.fill(grid.intensity(self.points, self.meta, self.dsm, self.params), levels=2), "int")

    @cached_property
    def min_agl(self) -> Raster:
        p = self.params
        low = grid.lowest_above_raster(self.dsm, self.dtm, p) if self.points is None else grid.lowest_above(self.points, self.meta, self.dsm, self.dtm, p)
        return focal.agl_median(low, p)

    @cached_property
    def classes(self) -> DataFrame:
        base = store(classify.base_classes(self.dsm, self.dsm2, self.dtm, self.labels, self.params), "classes")
        grown = focal.building_majority(focal.grow_buildings(base, self.dsm, self.params), self.dsm.frame)
        return store(components.fill_inside_buildings(store(grown, "classes"), self.dsm.frame), "classes")

    @cached_property
    def buildings(self) -> DataFrame:
        return classify.building_mask(self.classes)

    @cached_property
    def building_labels(self) -> DataFrame:
        return store(components.labelled_with_holes(self.buildings, self.dsm.frame), "building-labels")

    @cached_property
    def outlines(self) -> DataFrame:
        """Simplified polygons of the labels, traced on cells of a third of the size."""
        return vector.building_outlines(self.building_labels)

    def product(self, name: str):
        plain = {
            "DSM": lambda: self.dsm, "MIN": lambda: self.low, "DTM0": lambda: self.dtm0, "DTM": lambda: self.dtm, "DSM2": lambda: self.dsm2, "INT": lambda: self.intensity, "MINAGL": lambda: self.min_agl,
            "LABEL0": lambda: self.label0, "LABEL": lambda: self.labels, "CLASS": lambda: self.classes, "BUILDING": lambda: self.buildings, "LABELS": lambda: self.building_labels,
            "LABELS3": lambda: algebra.upsample(self.building_labels, 3), "OUTLINES": lambda: self.outlines,
        }
        if name not in plain:
            raise ValueError(f"unknown product {name!r}")
        return plain[name]()

    @property
    def outline_frame(self):
        f = self.dsm.frame
        return replace(f, gsd=f.gsd / 3, width=3 * f.width, height=3 * f.height)

    def run(self, products: dict[str, str]) -> dict[str, bool]:
        """Write products, in product order, to their paths. A blank path skips; a failure is reported, not raised."""
        for name in products:
            if name not in PRODUCTS:
                raise ValueError(f"unknown product {name!r}")
        done = {}
        for name in (n for n in PRODUCTS if products.get(n)):
            try:
                made, path = self.product(name), products[name]
                if name == "OUTLINES":
                    done[name] = files.write_outlines(made, self.outline_frame, path)
                    continue
                files.write_raster(made if isinstance(made, Raster) else Raster(made, self.dsm.frame), path)
                done[name] = True
            except Exception as e:  # noqa: BLE001  one product's failure leaves the others
                print(f"{name} was not written: {e}")
                done[name] = False
        return done


def output_paths(base: str, products=DEFAULT_PRODUCTS, from_points: bool = True, terrain_given: bool = False) -> dict[str, str]:
    """Default paths: the base and each product's suffix; a single product gets the base itself."""
    if len(products) == 1:
        return {products[0]: base}
    skip = (set() if from_points else {"DSM", "INT"}) | ({"DTM"} if terrain_given else set())
    return {p: base + PRODUCTS[p] for p in products if p not in skip}
