"""Hand-written placement worlds; each has a library of its own, so one job plans all of them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from stowline.operators.policy import MEMBER_SCHEMA, POLICY_SCHEMA

GIB = 1 << 30
REPLICA_SCHEMA = ("library_id long, blob_id long, file_id long, location_id string, location_kind string, size long, state string, "
                  "hydration string, is_online boolean, path string, collection string")
LOCATION_SCHEMA = ("library_id long, location_id string, kind string, free_bytes long, is_online boolean, is_final boolean, "
                   "is_shuttle boolean, is_overlay boolean")


def gib(x: float) -> int:
    return round(x * GIB)


class Worlds:
    def __init__(self) -> None:
        self.replicas, self.locations, self.policies, self.members = [], [], [], []

    def place(self, lib, name, free, online=True, final=True, shuttle=False, overlay=False):
        kind = "cloud" if name in ("gdrive", "onedrive") else "volume"
        size = free if isinstance(free, int) and free > 1 << 20 else gib(free)
        self.locations.append((lib, name, kind, size, online, final and kind == "volume", shuttle and kind == "volume", overlay))

    def file(self, lib, blob, size, location, path, state="verified", collection="c", hydration=None, online=True, file_id=None):
        cloud = location in ("gdrive", "onedrive")
        nbytes = size if isinstance(size, int) and size > 1 << 20 or size is None else gib(size)
        self.replicas.append((lib, blob, file_id or len(self.replicas) + 1, location, "cloud" if cloud else "volume", nbytes, state,
                              hydration or ("cloud_native" if cloud else "local_full"), online, path, collection))

    def policy(self, lib, name, keep, minimum, choice, clouds, locals_=(), pin=False, subdir=None, order=0):
        self.policies.append((lib, name, order, keep, minimum, choice, pin, subdir))
        self.members += [(lib, name, "cloud", i, c) for i, c in enumerate(clouds)]
        self.members += [(lib, name, "local", i, c) for i, c in enumerate(locals_)]

    def frames(self, spark: SparkSession):
        make = spark.createDataFrame
        return (make(self.replicas, REPLICA_SCHEMA), make(self.policies, POLICY_SCHEMA), make(self.members, MEMBER_SCHEMA),
                make(self.locations, LOCATION_SCHEMA))


def golden(w: Worlds, lib: int, extra_required: bool = False) -> None:
    w.place(lib, "local-d", 4.0)
    w.place(lib, "gdrive", 15.0)
    w.place(lib, "onedrive", 40.0)
    clouds = ["gdrive", "onedrive"]
    w.policy(lib, "Archives", "cloud_only", 1, "specific", ["gdrive"], subdir="Archives")
    w.policy(lib, "Gaming Clips", "prefer", 2, "most_free", clouds, ["local-d"], subdir="Gaming/Clips", order=1)
    w.policy(lib, "Must", "required", 2, "most_free", clouds, ["local-d"], subdir="Must", order=2)
    gaming = {"collection": "Gaming Clips"}
    w.file(lib, 1, 5.5, "local-d", "D:\\Videos\\Captures\\boss.mp4", **gaming)
    w.file(lib, 2, 3.5, "local-d", "D:\\OldClips\\old.mp4", collection="Archives")
    w.file(lib, 3, 0.8, "local-d", "D:\\Videos\\Captures\\tiny.mp4", **gaming)
    w.file(lib, 4, 2.2, "gdrive", "/clips/g1.mp4", "suspect", **gaming)
    w.file(lib, 5, 1.8, "gdrive", "/clips/g2.mp4", "suspect", **gaming)
    w.file(lib, 6, 2.0, "onedrive", "/clips/o1.mp4", "suspect", **gaming)
    w.file(lib, 7, 7.0, "gdrive", "/Archives/cutscene.mp4", "suspect", collection="Archives")
    if extra_required:
        w.file(lib, 8, 1.0, "onedrive", "/clips/o2.mp4", "suspect", collection="Must")
