"""Settings of a prediction run, from several places with a fixed precedence."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Settings for which the file beside a checkpoint counts before the checkpoint itself.
SIDECAR_FIRST = ("wmin_base", "wmin_floor", "lenfeat_scale", "k_sigma", "pos_channel", "coarse_stride", "tau_len_gamma", "tau_len_ref")

#: Settings by their names in checkpoints, and the fields of operators.model.Weights that they set.
WEIGHT_FIELDS = {
    "tau": "tau",
    "tau_len_gamma": "tau_gamma",
    "tau_len_ref": "tau_reference",
    "wmin_base": "least_base",
    "wmin_floor": "least_width",
    "k_sigma": "k_sigma",
    "alpha_cap": "alpha_most",
    "lenfeat_scale": "length_scale",
    "coarse_stride": "coarse",
    "temperature": "temperature",
}


def resolved(checkpoint: dict, sidecar: dict | None = None, given: dict | None = None) -> dict:
    """The settings in force: what is given and not None, then the checkpoint's, then the sidecar's; for SIDECAR_FIRST the sidecar's before the checkpoint's."""
    sidecar, given = sidecar or {}, {k: v for k, v in (given or {}).items() if v is not None}
    out = {**sidecar, **checkpoint}
    out.update({k: sidecar[k] for k in SIDECAR_FIRST if k in sidecar})
    return {**out, **given}


def weight_settings(settings: dict) -> dict:
    """The keywords of Weights that settings set; others are left out."""
    return {field: settings[name] for name, field in WEIGHT_FIELDS.items() if settings.get(name) is not None}


@dataclass(frozen=True)
class Options:
    """What a run does: chunking, checks of sequences, the least P of a feature, and the size of micro-batches."""

    chunk_len: int = 2000
    chunk_overlap: int = 128
    strict: bool = False
    least_length: int = 8
    most_fixed: float = 0.2
    least_p: float = 0.5
    most_tokens: int = 80_000
    tries: int = 3

    @classmethod
    def of(cls, settings: dict) -> Options:
        """The options among settings; unknown names are left out."""
        return cls(**{f.name: settings[f.name] for f in fields(cls) if settings.get(f.name) is not None})
