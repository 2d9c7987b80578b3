"""The numbers an installation may change, with their defaults."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Ingest.
    max_upload_bytes: int = 10 * 1024 * 1024
    chunk_size: int = 1600
    chunk_overlap: int = 240
    summary_token_budget: int = 200_000
    lease_minutes: int = 10
    max_attempts: int = 3
    # Digits of a content's hash that name its part of the blob store; never changed once it is used.
    blob_digits: int = 2

    # Search.
    units_per_path: int = 100
    page_size: int = 20
    max_assets: int = 100
    rerank_candidates: int = 20
    max_query_chars: int = 500

    # Rows a side of a join may have to be broadcast; past it the shuffling form of the operator runs.
    max_broadcast_rows: int = 200_000
    # And bytes, where rows hold texts of any length.
    max_broadcast_bytes: int = 64 << 20
    # Query vectors that may be sent whole to every task (200 MB at 1,024 dimensions).
    max_broadcast_vectors: int = 25_000
    # Rows of one key that a single task joins where a join cannot broadcast.
    rows_per_part: int = 1_000_000
    # Units and queries in one cell of the shuffled vector search.
    units_per_cell: int = 50_000
    queries_per_cell: int = 2_000


DEFAULTS = Settings()
