"""Engine configuration: one immutable value passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass

#: Namespaces that would collide with other parts of a slide's store.
RESERVED_NAMESPACES = ("features", "metadata", "latent_features")
#: Extensions of slide files, in the order in which a sibling is looked up.
SLIDE_EXTENSIONS = (".ndpi", ".vms", ".vmu", ".scn", ".mrxs", ".bif", ".svs", ".svslide", ".tif", ".tiff", ".ome.tiff", ".ome.tif")
#: File types by extension.
FILE_TYPES = {"wsi": (".ndpi", ".svs"), "hdf5": (".h5",), "image": (".bmp", ".gif", ".icns", ".ico", ".jpg", ".jpeg", ".png", ".tif", ".tiff")}
#: Tile presets: embedding dimension, channel means, channel deviations.
IMAGENET = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
TILE_PRESETS = {
    "uni": (1024, *IMAGENET),
    "uni2": (1536, *IMAGENET),
    "gigapath": (1536, *IMAGENET),
    "virchow": (1280, *IMAGENET),
    "virchow2": (1280, *IMAGENET),
    "h-optimus-0": (1536, (0.707223, 0.578729, 0.703617), (0.211883, 0.230117, 0.177517)),
    "conch15": (1024, *IMAGENET),
    "conch15_768": (768, *IMAGENET),
    "midnight": (1536, (0.5, 0.5, 0.5), (0.5, 0.5, 0.5)),
    "phikon2": (1024, *IMAGENET),
}
#: Slide presets and the tile presets whose features they take.
SLIDE_PRESETS = {"titan": ("conch15_768",)}
#: Colours of clusters, taken by cluster id modulo their number.
PALETTE = (
    "#1f77b4", "#aec7e8", "#ff7f0e", "#ffbb78", "#2ca02c", "#98df8a", "#d62728", "#ff9896", "#9467bd", "#c5b0d5",
    "#8c564b", "#c49c94", "#e377c2", "#f7b6d2", "#7f7f7f", "#c7c7c7", "#bcbd22", "#dbdb8d", "#17becf", "#9edae5",
)


@dataclass(frozen=True)
class EngineConfig:
    patch_size: int = 256
    target_mpp: float = 0.5
    seed: int = 42
    variance: float = 0.95
    resolution: float = 1.0
    n_neighbors: int = 15
    min_dist: float = 0.1
    default_preset: str = "uni2"
    #: Rows of one block of the blocked neighbour search.
    block_rows: int = 4096
