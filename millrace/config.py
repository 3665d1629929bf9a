"""Settings of an index and of its answers."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Index:
    """What an export says about itself."""

    repo_id: str
    total_vectors: int
    vector_dimension: int
    embedding_model: str = "unknown"
    index_type: str = "flat"
    dataset_name: str = "embeddings"
    repo_type: str = "dataset"
    files: dict[str, str] = field(default_factory=dict)
    completion_timestamp: str | None = None

    @classmethod
    def from_json(cls, text: str) -> Index:
        """Reads a run's summary; it must say that the run is complete and hold the sections huggingface and embeddings_info."""
        data = json.loads(text)
        if not (data.get("step03_completed") or data.get("step02_completed")):
            raise ValueError("the run isn't complete")
        missing = [k for k in ("huggingface", "embeddings_info") if k not in data]
        if missing:
            raise ValueError(f"missing: {', '.join(missing)}")
        hub, info = data["huggingface"], data["embeddings_info"]
        return cls(
            hub.get("repo_id", ""), int(info["total_vectors"]), int(info["vector_dimension"]), info.get("embedding_model", "unknown"), info.get("faiss_index_type", "flat"),
            hub.get("dataset_name", "embeddings"), hub.get("repo_type", "dataset"), hub.get("files", {}), data.get("completion_timestamp"),
        )

    def to_json(self) -> str:
        mine = asdict(self)
        hub = {k: mine[k] for k in ("repo_id", "dataset_name", "repo_type", "files")}
        info = {k: mine[k] for k in ("total_vectors", "vector_dimension", "embedding_model")} | {"faiss_index_type": self.index_type}
        return json.dumps({"step03_completed": True, "completion_timestamp": self.completion_timestamp, "huggingface": hub, "embeddings_info": info}, ensure_ascii=False, indent=2)


@dataclass(frozen=True)
class Answers:
    """How questions are answered."""

    initial_k: int = 20
    final_k: int = 3
    use_reranking: bool = True
    similarity_threshold: float | None = None


def described(index: Index) -> str:
    """What an export holds, in lines for a reader."""
    rows = [
        ("Repository", index.repo_id), ("Vectors", f"{index.total_vectors:,}"), ("Dimension", str(index.vector_dimension)), ("Model", index.embedding_model),
        ("File", index.files.get("embeddings", "")), ("Completed", index.completion_timestamp or "unknown"),
    ]
    return "\n".join(f"{name}: {value}" for name, value in rows)


def download_instructions(index: Index, local: str = "export") -> dict[str, str]:
    """How to get an export and read it: by command, by address, and in Python."""
    return {
        "cli_download": f"huggingface-cli download {index.repo_id} --repo-type {index.repo_type}",
        "repo_url": f"https://huggingface.co/{index.repo_type}s/{index.repo_id}",
        "python_code": f"from millrace.operators import export\n\nvectors, about = export.load(spark, {local!r})  # {index.total_vectors} x {index.vector_dimension}",
    }


def missing_parts(there: set[str]) -> list[str]:
    """What an index folder with the entries ``there`` lacks before it can answer questions."""
    return [part for part in ("vectors", "manifest") if part not in there]
