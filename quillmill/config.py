"""Knobs of the engine with their defaults."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    topic: str = "doc.events.v1"
    schema_versions: tuple[int, ...] = (1,)
    max_attempts: int = 5
    base_delay_seconds: int = 30
    max_file_bytes: int = 209_715_200
    parse_timeout_seconds: float = 60.0
    download_timeout_seconds: float = 30.0
    strategy: str = "FIXED_TOKEN"
    max_tokens: int = 512
    overlap: int = 64
    max_chunks: int = 5_000
    max_total_tokens: int = 2_000_000
    dimensions: int = 1536
    sweep_limit: int = 50
    sweep_seconds: int = 60
    health_check_seconds: float = 5.0
    tokenizer: str = "word"
    worker_id: str = "quillmill"


DEFAULT = Config()
