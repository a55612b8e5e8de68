"""Preparation plan (what to do per column) and preparation spec (what was learned at fit time).

``PrepPlan`` is the user-facing configuration; ``PrepSpec`` is frozen after ``fit_prep`` and round-trips through JSON,
so batch and streaming scoring apply exactly the statistics learned at training time.
"""

from __future__ import annotations

import copy
import dataclasses
import json
from dataclasses import dataclass, field

IMPUTE_STRATEGIES = ("mean", "median", "mode", "constant")
ENCODE_STRATEGIES = ("onehot", "ordinal", "target")
SCALE_STRATEGIES = ("standard", "minmax", "robust", "none")

# Categorical text columns with more distinct values than this are dropped by the inferred plan (ID-like columns).
MAX_ONEHOT_CARDINALITY = 50
# Category lists longer than this are kept out of the query plan literals; a lookup table is joined instead.
MAX_LITERAL_CATEGORIES = 200


@dataclass
class PrepPlan:
    drop_cols: list[str] = field(default_factory=list)
    datetime_cols: list[str] = field(default_factory=list)
    mixed_numeric_cols: list[str] = field(default_factory=list)
    impute: dict[str, str] = field(default_factory=dict)
    fill_values: dict[str, object] = field(default_factory=dict)  # for impute == "constant"
    encode: dict[str, str] = field(default_factory=dict)
    scale_strategy: str = "standard"
    iqr_k: float | None = 1.5
    clip_encoded: bool = False      # True: also clip one-hot / ordinal / target-encoded and <= 2-value columns
    impute_all: bool = False        # True: every numeric feature gets a fill, even without nulls at fit time
    dedupe: str = "after_drop"      # or "before_drop"
    quantiles: str = "exact"        # "exact" (bounded memory; "auto" and "bracket" are other names) | "approx"

    def copy(self) -> "PrepPlan":
        return copy.deepcopy(self)

    def validate(self, target: str) -> None:
        if target in self.drop_cols:
            raise ValueError(f"drop_cols must not contain the target column '{target}'.")
        for c, s in self.impute.items():
            if s not in IMPUTE_STRATEGIES:
                raise ValueError(f"'{s}' is no way to fill column '{c}'; choose one of {IMPUTE_STRATEGIES}")
            if s == "constant" and c not in self.fill_values:
                raise ValueError(f"a constant fill needs a value (column '{c}')")
        for c, s in self.encode.items():
            if s not in ENCODE_STRATEGIES:
                raise ValueError(f"'{s}' is no encoder for column '{c}'; choose one of {ENCODE_STRATEGIES}")
        if self.scale_strategy not in SCALE_STRATEGIES:
            raise ValueError(f"'{self.scale_strategy}' is no scaler; choose one of {SCALE_STRATEGIES}")

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> "PrepPlan":
        return cls(**d)


@dataclass
class PrepSpec:
    target: str
    input_columns: list[str] = field(default_factory=list)
    input_types: dict[str, str] = field(default_factory=dict)     # column -> Spark simple type string at fit time
    dropped_columns: list[str] = field(default_factory=list)
    datetime_columns: list[str] = field(default_factory=list)
    coerced_columns: list[str] = field(default_factory=list)
    bool_columns: list[str] = field(default_factory=list)
    fills: dict[str, object] = field(default_factory=dict)
    onehot: dict[str, list] = field(default_factory=dict)
    ordinal: dict[str, object] = field(default_factory=dict)        # col -> categories, or {"path", "size"} of a code table
    target_maps: dict[str, dict] = field(default_factory=dict)      # col -> {"values": [...], "means": [...], "global_mean": x}
    clip_bounds: dict[str, list[float]] = field(default_factory=dict)
    scalers: dict[str, list] = field(default_factory=dict)          # col -> [strategy, center, scale]
    output_columns: list[str] = field(default_factory=list)
    encoded_columns: list[str] = field(default_factory=list)
    sources: dict[str, str] = field(default_factory=dict)           # prepared feature -> raw column, where they differ
    dedupe: str = "after_drop"
    plan: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "PrepSpec":
        return cls(**json.loads(text))

    @property
    def features(self) -> list[str]:
        return [c for c in self.output_columns if c != self.target]
