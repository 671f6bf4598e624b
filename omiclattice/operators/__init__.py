"""Operators: plain functions from DataFrames and parameters to DataFrames."""


def catalog() -> dict:
    """Every public operator by ``module.function`` name."""
    import importlib
    import inspect

    names = ["align", "clean", "communities", "corr", "enrich", "evidence", "knowledge", "latent", "motifs", "network", "spectra", "stats", "subspace", "text"]
    out = {}
    for n in names:
        mod = importlib.import_module(f"omiclattice.operators.{n}")
        for name, fn in inspect.getmembers(mod, inspect.isfunction):
            if fn.__module__ == mod.__name__ and not name.startswith("_"):
                out[f"{n}.{name}"] = fn
    return out
