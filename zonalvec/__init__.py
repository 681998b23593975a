"""zonalvec: zonal pooling of embedding grids, probes and reports on Spark DataFrames.

The public names are imported when they are first used, so that a task that needs one module does not load all.
"""

from importlib import import_module

_PUBLIC = {
    "functions.codecs": "minmax_vector percentile_stretch quantise_offset quantise_power recode_u8 sanitize scale_clip stride_sample",
    "model": "assemble patches_to_long pixels_to_long",
    "operators.estimators": "Codebook CodebookModel PrincipalComponents PrincipalComponentsModel",
    "operators.fitted": "PCA BoVW NotFitted fit_mini_batch fit_wide seeded_centres",
    "operators.metrics": "METRICS class_scores confusion metrics summary",
    "operators.pool": "POOLERS TRAINING_FREE Mergeable Pooler average_deviation covariance covariance_by_pairs custom custom_mergeable features gem output_dim percentiles pool_long pool_many signed_gem",
    "operators.probe": "bootstrap_knn bootstrap_linear bootstrap_sweep distances evaluate_knn evaluate_linear linear_sweep neighbours replaced searched standardise standardiser sweep",
    "operators.sampling": "bootstrap bootstrap_in_place quotas size_curve subsample",
    "sources.manifest": "decode_labels encode_labels entries load load_pooled lookup quarantine read_lines split",
    "sources.tables": "inventory read_pooled read_results write_pooled write_results",
}
_WHERE = {name: module for module, names in _PUBLIC.items() for name in names.split()}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
