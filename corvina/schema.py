"""Table schemas, closed value sets and option records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOMAIN = "id string, name string, description string, chunk_strategy string, structural_variant string"
TAG = "id string, domain_id string, name string, description string, path string"
DOCUMENT = (
    "id string, domain_id string, title string, author string, source_filename string, source_path string, source_type string, tags array<string>,"
    " ingestion_status string, ingestion_error string, ingested_at timestamp, chunk_strategy string, structural_variant string"
)
CHUNK = (
    "id string, document_id string, domain_id string, tag_paths array<string>, content string, embedding array<float>, chunk_index int,"
    " chunk_strategy string, page_number int, token_count int, created_at timestamp, lexemes array<struct<lexeme:string,pos:int>>"
)
VALUES = {
    "chunk_strategy": ("TOKEN", "SEMANTIC", "STRUCTURAL"),
    "structural_variant": ("GENERIC", "COOKBOOK", "ACADEMIC"),
    "source_type": ("PDF", "EPUB"),
    "ingestion_status": ("PENDING", "IN_PROGRESS", "COMPLETED", "FAILED"),
}
KEYS = {"domain": ("id",), "tag": ("domain_id", "path"), "document": ("domain_id", "source_filename"), "chunk": ("document_id", "chunk_index")}


class NotFound(LookupError):
    """A domain, tag, document or chunk that doesn't exist."""


class Unsupported(ValueError):
    """An upload of a kind that isn't read."""


@dataclass(frozen=True)
class Boundary:
    """What may start a structural chunk, and how long titles and chunks may be."""

    max_title: int = 80
    min_chars: int = 200
    max_chars: int = 4000
    numbered: bool = True
    level: int = 2
    excluded: tuple[str, ...] = ()


_COOKBOOK = "do ahead,make ahead,storage,variations,tips,for the,for serving,to make,to finish,to serve,equipment,yield,cook time,prep time,servings,makes,serves,preparation,note,notes,methods,method,directions,instructions,ingredients"
VARIANTS = {"GENERIC": Boundary(), "COOKBOOK": Boundary(numbered=False, excluded=tuple(_COOKBOOK.split(","))), "ACADEMIC": Boundary(max_title=120, min_chars=300)}


@dataclass(frozen=True)
class Semantic:
    window: int = 2
    percentile: float = 0.85
    min_chars: int = 300
    max_chars: int = 4000


@dataclass(frozen=True)
class Options:
    """Defaults of the whole engine. ``strict_parity`` brings back the reference's odd corners."""

    chunk_strategy: str = "STRUCTURAL"
    chunk_tokens: int = 600
    #: A ``tokenizers`` file whose tokens are counted; without one, words and signs are.
    vocabulary: str | None = None
    overlap_chars: int = 200
    pool: int = 50
    rrf_k: int = 60
    page_size: int = 20
    candidates: int = 15
    context_chunks: int = 5
    rerank: bool = False
    strict_parity: bool = False
    semantic: Semantic = field(default_factory=Semantic)


def invalid_values(df: DataFrame) -> DataFrame:
    """Rows with a value outside a closed set; nulls pass where the column may be null."""
    bad = F.lit(False)
    for name, allowed in VALUES.items():
        if name in df.columns:
            bad = bad | (F.col(name).isNotNull() & ~F.col(name).isin(*allowed))
    return df.filter(bad)


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    """Key values that come more than once."""
    return df.groupBy(*KEYS[table]).count().filter("count > 1")
