"""Rule files (YAML or JSON) into small dimension tables.

Rule files are curated by hand, a few kilobytes each; they are the only input
read on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

try:
    import yaml
except ImportError:  # JSON rules still work
    yaml = None


def read_rules(path: str) -> dict:
    with open(path, encoding="utf-8") as fh:
        if path.endswith(".json"):
            return json.load(fh)
        if yaml is None:
            raise RuntimeError("YAML rules need PyYAML")
        return yaml.safe_load(fh)


def compound_rules(spark: SparkSession, files: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``classes, fragments, losses`` from class files ``name -> path``.

    A file holds a list of classes under its own name and shared
    ``neutral_losses``.
    """
    classes, frags, losses = [], [], []
    for name, path in files.items():
        rules = read_rules(path)
        for c in rules.get(name, []):
            key = c.get("class", "")
            mass = c.get("mass")
            classes.append((key, name, c.get("confidence", "medium"), c.get("formula"), float(mass) if mass else None,
                            c.get("pathway", ""), list(c.get("known_metabolites", []))))
            frags += [(key, float(f["mz"]), f.get("annotation", "")) for f in c.get("fragments", [])]
            losses += [(key, float(n["delta"]), n.get("annotation", "")) for n in rules.get("neutral_losses", [])]
    return (
        spark.createDataFrame(classes, "class string, class_file string, confidence string, formula string, "
                                       "class_mass double, pathway string, known_metabolites array<string>"),
        spark.createDataFrame(frags, "class string, ref_mz double, annotation string"),
        spark.createDataFrame(losses, "class string, delta double, annotation string"),
    )


def family_rules(spark: SparkSession, path: str) -> DataFrame:
    """``family, rule, pfam`` from a rule file with a ``families`` mapping."""
    rules = read_rules(path)
    rows = [(f, r["rule"], list(r["pfam"])) for f, r in rules.get("families", rules).items()]
    return spark.createDataFrame(rows, "family string, rule string, pfam array<string>")
