"""The registered queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import OP5_SQL, op5_decontamination
from .embeddings import OP4_SQL, op4_embeddings
from .langid import op2_language
from .licenses import op6_licenses
from .mixing import OP3_SQL, op3_mixing
from .quality import op1_quality
from .simhash import op8_simhash
from .tokens import op7_tokens
from .toxicity import op10_toxicity
from .warc import OP9_SQL, op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_quality, op2_language, op3_mixing, op4_embeddings, op5_decontamination, op6_licenses, op7_tokens, op8_simhash, op9_warc, op10_toxicity)
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op4_embeddings": OP4_SQL, "op5_decontamination": OP5_SQL, "op9_warc": OP9_SQL}
