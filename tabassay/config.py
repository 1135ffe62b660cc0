"""Declarative description of a dataset."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import yaml


#: The keys of target_binarize.
BINARIZE_KEYS = frozenset({"source_column", "threshold"})


@dataclass
class DatasetConfig:
    """Roles of a dataset's columns and how it is sampled and split. Names and defaults of the settings are fixed: files name them."""

    name: str
    data_path: str
    target_variable: str
    subgroup_column: str
    categorical_columns: list[str]
    continuous_columns: list[str]
    target_binarize: dict | None = None
    weight_column: str | None = None
    train_fraction: float = 0.7
    sample_size: int | None = None
    random_state: int = 42
    preprocessing: str | None = None
    strict_columns: bool = False

    def faults(self) -> list[str]:
        """What is wrong with the settings, one sentence each; empty if they can be used."""
        columns = [*self.categorical_columns, *self.continuous_columns]
        twice = sorted({c for c in columns if columns.count(c) > 1})
        missing = sorted(BINARIZE_KEYS.difference(self.target_binarize)) if self.target_binarize is not None else []
        rules = [
            (0 < self.train_fraction < 1, f"train_fraction must lie between 0 and 1, not {self.train_fraction}"),
            (not missing, f"target_binarize lacks {missing}"),
            (bool(columns), "no categorical or continuous column is named"),
            (not twice, f"columns are named twice: {twice}"),
            (self.sample_size is None or self.sample_size > 0, f"sample_size must be positive, not {self.sample_size}"),
        ]
        return [text for holds, text in rules if not holds]

    def validate(self) -> None:
        """ValueError with all faults() together."""
        if found := self.faults():
            raise ValueError("; ".join(found))

    def roles(self) -> list[tuple[str, str]]:
        """(column, the setting that names it); a binarised target is made later and need not exist."""
        named = [] if self.target_binarize else [(self.target_variable, "target_variable")]
        named += [(self.subgroup_column, "subgroup_column")]
        named += [(c, "categorical_columns") for c in self.categorical_columns] + [(c, "continuous_columns") for c in self.continuous_columns]
        named += [(self.target_binarize["source_column"], "target_binarize.source_column")] if self.target_binarize else []
        return named + ([(self.weight_column, "weight_column")] if self.weight_column else [])

    def validate_against_data(self, df) -> None:
        """ValueError naming every configured column that df lacks, with its setting; looks at names only."""
        if lacking := [f"'{column}' ({setting})" for column, setting in self.roles() if column not in df.columns]:
            raise ValueError(f"Not in the data: {', '.join(lacking)}. Available columns: {sorted(df.columns)}")


def load_config(path: str | Path) -> DatasetConfig:
    """The validated settings of a YAML file."""
    with open(path, encoding="utf-8") as file:
        settings = DatasetConfig(**yaml.safe_load(file))
    settings.validate()
    return settings


def default_config_path() -> Path:
    """The bundled description of the California census sample."""
    return Path(__file__).parent / "configs" / "acs_pums.yaml"
