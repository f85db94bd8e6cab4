"""Classification-uncertainty analytics over Spark DataFrames.

The main functions can be taken from here by their customary names.  They are looked up
on first use, so that a Python worker which needs one module does not load the others.
"""

from __future__ import annotations

import importlib

#: customary name: (module, function)
_EXPORTS = {
    "load_posteriors": ("operators.filters", "load_posteriors"),
    "alr_transform": ("functions.simplex", "alr"),
    "inverse_alr": ("functions.simplex", "inverse_alr"),
    "simplex_drop_last": ("functions.simplex", "drop_coordinate"),
    "fit_gmm": ("operators.gmm", "fit"),
    "gmm_diagnostics": ("operators.gmm", "diagnostics"),
    "monte_carlo_confusion": ("operators.confusion", "monte_carlo_confusion"),
    "gmm_confusion_equalprior": ("operators.confusion", "equal_prior_confusion"),
    "bhattacharyya_pairwise": ("operators.confusion", "pairwise"),
    "hard_assignment_confusion": ("operators.confusion", "hard_confusion"),
    "analytical_pairwise_confusion": ("operators.confusion", "analytical_pairwise"),
    "analytical_multiclass_confusion": ("operators.confusion", "analytical_multiclass"),
    "soft_posterior_confusion": ("operators.confusion", "soft_posterior_confusion"),
    "observed_populations": ("operators.populations", "observed"),
    "deconvolve_populations": ("operators.populations", "deconvolve"),
    "bootstrap_population_ci_analytical": ("operators.resample", "replicate_populations"),
    "bootstrap_gmm_parameters": ("operators.resample", "refit"),
    "class_repetition_analysis": ("operators.gmm", "repetition"),
}

__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, function = _EXPORTS[name]
    return getattr(importlib.import_module(f"{__name__}.{module}"), function)


def __dir__() -> list[str]:
    return sorted({*globals(), *__all__})
