"""Parameters with types and constraints, and command-line parsers made from them."""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Parameter:
    default: Any
    type: str = "integer"
    min: float | None = None
    max: float | None = None
    options: tuple | None = None
    description: str = ""


# Parameter names, defaults and constraints.
SEQUENCE = {
    "segmentation": {
        "type": Parameter("contiguous", "string", options=("contiguous", "random"), description="Windows end to end, or sampled by coverage"),
        "min_length": Parameter(0, min=0, description="Shorter segments are dropped"),
        "max_length": Parameter(512, min=0, description="Longest segment"),
        "coverage": Parameter(1.0, "float", 0.0, 100.0, description="Expected times a base is sampled"),
    },
    "tokenization": {
        "type": Parameter("lca", "string", options=("lca",)),
        "kmer": Parameter(6, options=tuple(range(1, 10)), description="Bases in a token"),
        "shift": Parameter(1, min=0, description="Bases between the starts of tokens"),
        "max_segment_length": Parameter(2050, min=6, max=4294967296, description="Longest segment in bases"),
        "token_limit": Parameter(4096, min=1, max=4294967296, description="Most tokens, CLS and SEP included"),
        "max_unknown_token_proportion": Parameter(0.9999, "float", 0, 1, description="More unknown tokens empty the sentence"),
        "vocabfile": Parameter("auto", "str"),
        "vocabmap": Parameter({}, "dict"),
        "isPaddingToMaxLength": Parameter(False, "bool", options=(True, False)),
        "add_special_token": Parameter(True, "bool", options=(True, False)),
    },
    "computation": {
        "cpu_cores_for_segmentation": Parameter(10, min=1),
        "cpu_cores_for_tokenization": Parameter(-1),
        "batch_size_tokenization": Parameter(10000, min=1),
        "batch_size_fasta_segmentation": Parameter(3, min=1),
        "numpy_token_integer_prec_byte": Parameter(2, options=(1, 2, 4, 8)),
    },
}
PRETRAINING = {
    "data_collator": {
        "mask_to_left": Parameter(3, min=0),
        "mask_to_right": Parameter(2, min=0),
        "mlm_probability": Parameter(0.05, "float", 0.0, 1.0),
        "replace_prob": Parameter(0.8, "float", 0.0, 1.0),
        "random_prob": Parameter(0.01, "float", 0.0, 1.0),
    },
    "model": {
        "model_name": Parameter("mini", "string"),
        "vocab_size": Parameter(4101),
        "hidden_size": Parameter(384),
        "num_hidden_layers": Parameter(6),
        "num_attention_heads": Parameter(6),
        "max_position_embeddings": Parameter(1024),
        "intermediate_size": Parameter(2048),
        "position_embedding_type": Parameter("relative_key_query", "string"),
    },
    "dataset": {"input_batch_size": Parameter(10000, "int"), "dataset_iteration_batch_offset": Parameter(0, "int", min=0), "max_iteration_over_dataset": Parameter(10, "int", min=0)},
}
#: Bytes of an integer to Spark's type of that width.
INTEGER_TYPES = {1: "tinyint", 2: "smallint", 4: "int", 8: "bigint"}

_CASTS = {"integer": int, "int": int, "float": float, "string": str, "str": str}
#: Types whose values are taken as they are or not at all.
_KINDS = {"list": list, "tuple": tuple, "set": set, "dict": dict}


class Config:
    """Groups of parameters: casting, checks, defaults and command-line arguments."""

    def __init__(self, groups: dict[str, dict[str, Parameter]]) -> None:
        self.groups = groups

    def _spec(self, group: str, name: str) -> Parameter:
        if name not in self.groups.get(group, {}):
            raise ValueError(f"The parameter {name} is not known in {group}")
        return self.groups[group][name]

    def get_parameter(self, group: str, name: str) -> Any:
        return self._spec(group, name).default

    def describe(self, group: str, name: str) -> str:
        return self._spec(group, name).description

    def cast_to_expected_type(self, group: str, name: str, value: Any) -> Any:
        kind = self._spec(group, name).type
        try:
            if kind in ("bool", "boolean"):
                return {"true": True, "false": False}[str(value).lower()]
            if kind == "type":
                return value if isinstance(value, type) else {"int": int, "float": float, "str": str}[str(value)]
            if kind in _KINDS:
                if not isinstance(value, _KINDS[kind]):
                    raise TypeError(kind)
                return value
            return _CASTS[kind](value)
        except (KeyError, TypeError, ValueError) as e:
            raise ValueError(f"{name}: {value!r} is no {kind}") from e

    def validate_type(self, group: str, name: str, value: Any) -> bool:
        """Only the spellings integer, float and string are checked; an int is no float."""
        wanted = {"integer": int, "float": float, "string": str}.get(self._spec(group, name).type)
        return wanted is None or (isinstance(value, wanted) and not (wanted is int and isinstance(value, bool)))

    def validate_value(self, group: str, name: str, value: Any) -> bool:
        p = self._spec(group, name)
        if p.options is not None and value not in p.options:
            return False
        return not ((p.min is not None and value < p.min) or (p.max is not None and value > p.max))

    def validate(self, group: str, name: str, value: Any) -> None:
        if not self.validate_type(group, name, value):
            raise TypeError(f"{name}: {value!r} is not of type {self._spec(group, name).type}")
        if not self.validate_value(group, name, value):
            raise ValueError(f"{name}: {value!r} breaks its constraints")

    def parameters(self, group: str, given: dict | None = None) -> dict:
        """Defaults of a group with ``given`` values checked and put in."""
        out = {n: p.default for n, p in self.groups[group].items()}
        for name, value in (given or {}).items():
            self.validate(group, name, value)
            out[name] = value
        return out

    def argument_names(self, groups: list[str] | None = None) -> dict[str, tuple[str, str]]:
        """Argument to (group, parameter); a name that two groups share is led by its group."""
        chosen = {g: self.groups[g] for g in (groups or self.groups)}
        names = [n for ps in chosen.values() for n in ps]
        return {(f"{g}_{n}" if names.count(n) > 1 else n): (g, n) for g, ps in chosen.items() for n in ps}

    def parser(self, groups: list[str] | None = None) -> argparse.ArgumentParser:
        out = argparse.ArgumentParser()
        for arg, (g, n) in self.argument_names(groups).items():
            out.add_argument(f"--{arg}", default=self.groups[g][n].default, type=lambda v, g=g, n=n: self.cast_to_expected_type(g, n, v), help=self.groups[g][n].description)
        return out

    def from_arguments(self, argv: list[str], groups: list[str] | None = None) -> dict[str, dict]:
        """Each group's parameters with the arguments of a command line."""
        parsed, parser = vars(self.parser(groups).parse_args(argv)), self.parser(groups)
        given = user_provided(argparse.Namespace(**parsed), parser)
        out = {}
        for g in groups or self.groups:
            out[g] = self.parameters(g, {n: given[a] for a, (h, n) in self.argument_names(groups).items() if h == g and a in given})
        return out


def user_provided(args: argparse.Namespace, parser: argparse.ArgumentParser) -> dict:
    """The arguments that differ from the parser's defaults."""
    return {k: v for k, v in vars(args).items() if parser.get_default(k) != v}


SEQUENCE_CONFIG, PRETRAINING_CONFIG = Config(SEQUENCE), Config(PRETRAINING)


def segmentation_parameters(given: dict) -> dict:
    """Checked segmentation parameters; a ``seed`` passes through."""
    seed = {k: v for k, v in given.items() if k == "seed"}
    return SEQUENCE_CONFIG.parameters("segmentation", {k: v for k, v in given.items() if k != "seed"}) | seed


def tokenization_parameters(given: dict) -> dict:
    """Checked tokenization parameters; the shift must stay below six whatever the k-mer is."""
    out = SEQUENCE_CONFIG.parameters("tokenization", given)
    if not 1 <= out["shift"] <= 5 and "shift" in given:
        raise ValueError(f"shift: {out['shift']} breaks its constraints")
    return out


def max_segment_length_from_tokens(tokens: int, shift: int, k: int) -> int:
    return (tokens - 3) * shift + k


def max_tokens_from_length(length: int, shift: int, k: int) -> int:
    return -(-(length - k) // shift) + 3
