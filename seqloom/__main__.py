"""`python -m seqloom FASTA... --weights W.npz --embedder module:function --gff FOLDER`: FASTA files to features."""

from __future__ import annotations

import argparse
import importlib
import json

from .api import fasta_to_features
from .operators.model import Weights
from .session import local_session
from .settings import Options, resolved, weight_settings
from .sources.tabular import resolve_weights


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="seqloom", description="FASTA files to features")
    parser.add_argument("fasta", nargs="+")
    parser.add_argument("--weights", help=".npz of arrays; else SEQLOOM_WEIGHTS")
    parser.add_argument("--embedder", required=True, help="module:function, which makes an embedder")
    parser.add_argument("--settings", help="JSON object of settings of the checkpoint")
    parser.add_argument("--sidecar", help="JSON object of settings beside it")
    parser.add_argument("--gff", required=True)
    parser.add_argument("--attention")
    parser.add_argument("--logits")
    parser.add_argument("--least-p", type=float)
    parser.add_argument("--chunk-len", type=int)
    parser.add_argument("--chunk-overlap", type=int)
    parser.add_argument("--temperature", type=float)
    parser.add_argument("--strict", action="store_true", default=None)
    parser.add_argument("--cpus", default="*")
    a = parser.parse_args(arguments)

    def read(path: str | None) -> dict:
        if path is None:
            return {}
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    given = {"least_p": a.least_p, "chunk_len": a.chunk_len, "chunk_overlap": a.chunk_overlap, "temperature": a.temperature, "strict": a.strict}
    settings = resolved(read(a.settings), read(a.sidecar), given)
    module, _, name = a.embedder.partition(":")
    embed = getattr(importlib.import_module(module), name)()
    weights = Weights.load(resolve_weights(a.weights, None), **weight_settings(settings))
    found = fasta_to_features(local_session(a.cpus), a.fasta, embed, weights, a.gff, a.attention, a.logits, Options.of(settings))
    print(f"{found.count()} features in {a.gff}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
