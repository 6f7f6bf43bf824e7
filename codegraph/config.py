"""Options, read from the environment under their upper-case names where set."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    grep_max_hits: int = 50
    traversal_depth: int = 3
    leiden_max_levels: int = 10
    leiden_gamma: float = 1.5
    leiden_relationships: str = "CALLS,INJECTS,IMPLEMENTS,EXTENDS,DEPENDS_ON,DECLARES,HAS_METHOD,REMOTE_CALLS,OVERRIDES"
    flow_max_pairs: int = 200
    flow_max_nodes: int = 15
    candidates: int = 20
    context_lines: int = 6
    stack_packages: str = ""
    text_model: str = "offline"
    text_model_name: str = ""
    embedder: str = "offline"
    embedding_size: int = 384
    embedding_batch_size: int = 64

    @classmethod
    def load(cls) -> Options:
        have = {f.name: os.environ[f.name.upper()] for f in fields(cls) if f.name.upper() in os.environ}
        kinds = {"int": int, "float": float, "str": str}
        return cls(**{f.name: kinds[str(f.type)](have[f.name]) for f in fields(cls) if f.name in have})

    def relationships(self) -> tuple[str, ...]:
        """Edge types that communities are found in."""
        return tuple(x.strip() for x in self.leiden_relationships.split(",") if x.strip())
