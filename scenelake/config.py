"""Settings of a build, with stated defaults; key=value strings override them."""

from __future__ import annotations

import dataclasses


@dataclasses.dataclass
class Config:
    dataset: str = "replica"
    root: str = ""
    scene: str = "scene"
    output: str = "output"
    #: Every k-th frame is fused; voxels and depths in metres.
    fuse_every: int = 10
    voxel: float = 0.05
    min_depth: float = 0.3
    max_depth: float = 4.0
    #: segment: storeys and rooms from the cloud; single: one floor, one room.
    mode: str = "segment"
    min_cluster_size: int = 15
    rotation_weight: float = 1.5
    points_in_room: float = 0.5
    merge_threshold: float = 0.5
    merge_again_threshold: float = 0.65
    max_frames: int = 0
    top_k_objects: int = 10
    top_k_frames: int = 4
    expand: int = 10
    provider: str = "offline"
    #: Stages that are read rather than run where they are on disk.
    load: str = "segmentation,objects,descriptions"

    @classmethod
    def of(cls, *settings: str) -> Config:
        out = cls()
        kinds = {f.name: type(getattr(out, f.name)) for f in dataclasses.fields(out)}
        for s in settings:
            key, eq, value = s.partition("=")
            if not eq or key not in kinds:
                raise ValueError(f"{s} is no setting")
            setattr(out, key, kinds[key](value))
        return out

    @property
    def folder(self) -> str:
        return f"{self.output.rstrip('/')}/{self.dataset}/{self.scene}"
