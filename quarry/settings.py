"""Settings of an engine: fixed once made, read from the environment where it says so."""

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Defaults as the service documents them; any may be set by QUARRY_<NAME>."""

    data_dir: str = "data"
    embedding_dim: int = 384
    search_k: int = 20
    final_k: int = 5
    hybrid_cut: float = 2.0
    vector_cut: float = 1.5
    rerank_keep: int = 3
    graph_chunks: int = 2
    prompt_turns: int = 6
    history_turns: int = 10
    rate_limit: int = 10
    rate_window: float = 60.0
    embedding_cache: int = 2048
    query_cache: int = 256
    query_ttl: float = 300.0
    public: bool = False

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Settings":
        """Settings with what the environment gives; a value of the wrong kind raises ValueError."""
        env = dict(os.environ) if env is None else env
        given = {}
        for f in fields(cls):
            text = env.get(f"QUARRY_{f.name.upper()}")
            if text is not None:
                kind = type(f.default)
                given[f.name] = text.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)
        return cls(**given)

    def table(self, name: str) -> str:
        """Where a table of the index lies."""
        return f"{self.data_dir.rstrip('/')}/{name}"
