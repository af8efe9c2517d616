"""Settings of the chain, with the defaults that results are comparable at, read from a JSON file."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    # fixed values: sizes and thresholds of the chain
    top_k_candidates: int = 50
    max_fused_candidates: int = 15
    top_preserved: int = 30
    weak_seed_threshold: int = 4
    genre_boost_factor: int = 15
    max_history_turns: int = 5
    serialisation_format: int = 1
    fuzzy_cutoff_entity: float = 0.92
    fuzzy_cutoff_title: float = 0.85
    person_match_threshold: float = 85
    n_fusion_titles: int = 3
    k_values: tuple[int, ...] = (1, 10, 50)


def read_settings(spark: SparkSession, path: str) -> Settings:
    """The settings of a JSON document, which must name every one; a missing or an unknown one is an error."""
    given = json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))
    names = {f.name for f in fields(Settings)}
    if wrong := names ^ set(given):
        raise KeyError(f"missing or unknown settings in {path}: {', '.join(sorted(wrong))}")
    return Settings(**given | {"k_values": tuple(given["k_values"])})
