"""Settings of a run, with the defaults of the batch job."""

from __future__ import annotations

from dataclasses import dataclass, field

# The lookup tables a run can write.
LOOKUP_TABLES = (
    "cluster_to_flattened",
    "cluster_to_key",
    "cluster_to_phash",
    "cluster_to_ward",
    "flattened_to_cluster",
    "flattened_to_key",
    "flattened_to_phash",
    "key_to_cluster",
    "key_to_phash",
    "phash_to_cluster",
    "phash_to_flattened",
    "phash_to_key",
    "ward_to_cluster",
    "ward_to_key",
)

# The steps of a run, in order.
ACTIONS = ("map_each_image", "kmeans", "find_similar")


@dataclass(frozen=True)
class Config:
    """All settings of measuring, clustering and searching.

    Nothing is left out by default: every file, pixel and token takes part.
    """

    # which steps to run, and where
    actions: tuple[str, ...] = ACTIONS
    root: str = ""
    test_name: str = "t4"
    candidate_batch: str = "c4"
    input_glob: str = "*"
    candidate_glob: str = "*"
    candidate_has_mapped: bool = False

    # selections
    max_patches: int = 4
    patch_fraction: tuple[float, float] = (0.5, 0.5)
    patch_seed: int = 0
    quadrants: bool = False

    # measures
    x_down: int = 32
    ward_x_down: int = 16
    phash_bits: int = 256
    phash_chunk_len: int = 2
    # pixels of a selection that its centroids use; None: all
    kmeans_sample: int | None = None
    max_iterations: int = 15
    n_clusters: int = 12
    ward_clusters: int = 5
    quantiles: tuple[float, ...] = (5, 15, 25, 50, 75, 85, 95)

    # clustering of all images
    n_clusters_group: int = 8
    max_iter_group: int = 3
    kmeans_group_converge: float | None = None
    # counted tokens kept per group, for callers that ask for it; None: all
    in_memory_set_len: int | None = None
    kmeans_output: tuple[str, ...] = field(default=LOOKUP_TABLES)

    # search
    search_sample_step: int = 100
    search_rounds: int = 1
    vote_mode: str = "weighted"

    @property
    def token_caps(self) -> dict[str, int] | None:
        """Largest number of counted tokens per group, for each token kind."""
        if self.in_memory_set_len is None:
            return None
        per_group = self.in_memory_set_len // self.n_clusters_group
        ward = per_group // 2
        return {"phash": per_group - ward, "ward": ward}
