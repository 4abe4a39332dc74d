"""Command line: the scene classifier and the aligner over files.

    python -m pointweave scene INPUT DH=1 DZ=1 AGL=2 [AREA=50] [EGM96] [BOUNDS=xmin,xmax,ymin,ymax] [GND_LABEL=2] [DTM=file] [OUT=base]
    python -m pointweave align REFERENCE TARGET [gsd=1] [maxdz=2] [maxt=10]

Inputs are what ``sources.files.load`` reads. Outputs lie beside the input: its name without extension and a product's suffix.
CONVERT is accepted and does nothing, as no converter is run.
"""

from __future__ import annotations

import sys
import time
from dataclasses import replace

from pyspark.sql import SparkSession

from pointweave.plans.alignment import align_files
from pointweave.plans.scene import Scene, output_paths, parse_bounds
from pointweave.schema import AlignParams, Raster, SceneParams
from pointweave.sources import files

#: Option names with the parameter that each sets and its type.
SCENE_OPTIONS = {"dh": ("dh", float), "dz": ("dz", float), "agl": ("agl", float), "area": ("area", float), "gnd_label": ("ground_label", int), "bounds": ("bounds", parse_bounds)}
ALIGN_OPTIONS = {"gsd": ("gsd", float), "maxdz": ("maxdz", float), "maxt": ("maxt", float)}


def options(words: list[str], known: dict) -> tuple[dict, dict]:
    """Parameters by name, and what else was given (flags as True). ValueError for a value that cannot be read."""
    found, other = {}, {}
    for word in words:
        name, given, value = word.partition("=")
        if name.lower() in known and given:
            field, read = known[name.lower()]
            found[field] = read(value)
        else:
            other[name.lower()] = value if given else True
    return found, other


def scene(spark: SparkSession, words: list[str]) -> dict[str, bool]:
    """Writes the default products of a point cloud or surface raster; says which were written."""
    source, (given, other) = words[0], options(words[1:], SCENE_OPTIONS)
    params = replace(SceneParams(egm96="egm96" in other), **given)
    data, terrain = files.load(spark, source), files.read_raster(spark, other["dtm"]) if "dtm" in other else None
    from_points = not isinstance(data, Raster)
    made = Scene(data, params, terrain=terrain) if from_points else Scene(None, params, surface=data, terrain=terrain)
    last = source.rstrip("/").rsplit("/", 1)[-1]
    base = other.get("out") or (source.rstrip("/").rsplit(".", 1)[0] if "." in last else source.rstrip("/"))
    return made.run(output_paths(base, from_points=from_points, terrain_given=terrain is not None))


def align(spark: SparkSession, words: list[str]) -> dict:
    """Writes the offsets and the moved target; returns the offsets."""
    given, _ = options(words[2:], ALIGN_OPTIONS)
    return align_files(spark, words[0], words[1], replace(AlignParams(), **given))


def main(words: list[str], spark: SparkSession | None = None) -> int:
    """Exit code: 0 when all was written, 1 when something was not, 2 for wrong arguments."""
    least = {"scene": 4, "align": 3}
    if not words or words[0] not in least or len(words) < least[words[0]]:
        print(__doc__)
        return 2
    began, spark = time.time(), spark or SparkSession.builder.appName("pointweave").getOrCreate()
    try:
        done = scene(spark, words[1:]) if words[0] == "scene" else align(spark, words[1:])
    except ValueError as e:
        print(f"Error: {e}")
        return 2
    print(done)
    print(f"Total time elapsed = {time.time() - began:f} seconds")
    return 0 if done.get("ok", True) and all(v is not False for v in done.values()) else 1


def command() -> None:
    sys.exit(main(sys.argv[1:]))


if __name__ == "__main__":
    command()
