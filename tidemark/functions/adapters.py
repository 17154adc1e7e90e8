"""Adapters for feature packages (none of which is needed to import this module)."""

from __future__ import annotations

import ast
import importlib
from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd

from ..model import FuncWrapper, name_of


def seglearn_wrapper(func: Callable, func_name: str | None = None) -> FuncWrapper:
    """A function of (n, samples) arrays; one with ``bins`` has an output per bin."""
    name = func_name or name_of(func)
    bins = getattr(func, "bins", None)

    def run(x):
        return np.asarray(func(np.asarray(x).reshape(1, -1))).ravel().tolist()

    return FuncWrapper(run, [f"{name}_bin{i + 1}" for i in range(bins)] if bins else [name])


def seglearn_feature_dict_wrapper(features: Mapping[str, Callable]) -> list[FuncWrapper]:
    return [seglearn_wrapper(f, n) for n, f in features.items()]


def tsfel_feature_dict_wrapper(config: Mapping[str, Mapping], module=None) -> list[FuncWrapper]:
    """Functions of a feature configuration; parameters that are texts are read as literals where they name outputs."""
    module = module or importlib.import_module("tsfel.feature_extraction")
    out = []
    for domain in config.values():
        for spec in domain.values():
            if spec.get("use", "yes") != "yes":
                continue
            short, params, n = str(spec["function"]).rsplit(".", 1)[-1], dict(spec.get("parameters") or {}), spec.get("n_features", 1)
            if isinstance(n, str):
                value = params[n]
                value = ast.literal_eval(value) if isinstance(value, str) else value
                names = [f"{short}_{i + 1}" for i in range(value)] if isinstance(value, int) else [f"{short}_{n}={v}" for v in value]
            else:
                names = [f"{short}_{i + 1}" for i in range(n)]
            out.append(FuncWrapper(getattr(module, short), [short] if len(names) == 1 and not isinstance(n, str) else names, **params))
    return out


def tsfresh_combiner_wrapper(func: Callable, param: list[dict]) -> FuncWrapper:
    """A function that yields (name, value) pairs for a list of parameters."""
    wants_index = hasattr(func, "index_type")

    def run(x):
        return [v for _, v in func(x, param)]

    return FuncWrapper(run, [f"{name_of(func)}_{p}" for p in param], input_type=pd.Series if wants_index else np.ndarray)


def tsfresh_settings_wrapper(settings: Mapping[str, object], module=None) -> list[FuncWrapper]:
    """Simple, parametrised and combining functions of a settings dict."""
    module = module or importlib.import_module("tsfresh.feature_extraction.feature_calculators")
    out = []
    for name, params in settings.items():
        func = getattr(module, name)
        if params is None:
            out.append(FuncWrapper(func, [name]))
        elif getattr(func, "fctype", "simple") == "combiner":
            out.append(tsfresh_combiner_wrapper(func, params))
        else:
            out += [FuncWrapper(func, [f"{name}_{p}"], **p) for p in params]
    return out


def catch22_wrapper(catch22_all: Callable, **kwargs) -> FuncWrapper:
    """All features of one call; the names come from a call on a short series."""
    names = catch22_all(list(map(float, range(10))), **kwargs)["names"]

    def run(x):
        return catch22_all(list(map(float, x)), **kwargs)["values"]

    return FuncWrapper(run, list(names))
