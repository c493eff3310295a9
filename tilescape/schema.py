"""Logical schema: typed tables instead of a file per slide. Missing results are absent rows or nulls."""

from __future__ import annotations

TILE_FEATURES = "slide_id long, model string, tile_id long, x int, y int, features array<float>"
SLIDES = "slide_id long, patch_size int, path string, original_mpp double, original_width long, original_height long, mpp double, cols int, rows int, patch_count long"
LEVELS = "slide_id long, ordinal int, page_index int, width int, height int, downsample double"
TILES = "slide_id long, patch_size int, tile_id long, x int, y int, height int, width int, channels int, rgb binary"
ASSIGNMENTS = "model string, namespace string, filter_path string, slide_id long, tile_id long, cluster int"
SCORES = "model string, namespace string, filter_path string, name string, slide_id long, tile_id long, values array<double>"
SLIDE_EMBEDDINGS = "slide_id long, tile_model string, slide_preset string, feature array<double>"
RUNS = "run_id string, kind string, model string, namespace string, filter_path string, params map<string,string>, status string, created timestamp"
LATENT = "slide_id long, model string, tile_id long, tokens array<array<float>>"
EDGES = "src long, dst long, weight double"

#: Partition columns of the stored tables.
PARTITIONS = {"tile_features": ("model", "slide_id"), "assignments": ("model", "namespace", "filter_path"), "scores": ("model", "namespace", "filter_path", "name"), "tiles": ("patch_size", "slide_id"), "slides": ("patch_size", "slide_id"), "slide_embeddings": ("tile_model", "slide_preset"), "latent_features": ("model", "slide_id")}
