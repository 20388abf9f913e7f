"""Reranking and answers: the model is a callable; everything around it is data."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Options
from .search import hybrid_search

T = TypeVar("T")
Chat = Callable[[str, str], str]
PASSAGE_CHARS = 1000


def parse_order(answer: str, n: int) -> list[int]:
    """Passage numbers in a free answer, in range, first mention only; over-long digit runs don't count."""
    import re

    return list(dict.fromkeys(int(x) for x in re.findall(r"\d+", answer) if len(x) < 10 and int(x) < n))


def rerank(query: str, candidates: list[T], top_k: int, content_of: Callable[[T], str], chat: Chat, strict_parity: bool = False) -> list[T]:
    """Reorder by the model's list. Without a usable list the order stays; passages it leaves out follow, or go with ``strict_parity``."""
    if len(candidates) <= top_k:
        return candidates
    shown = "\n\n".join(f"[{i}] {content_of(c)[:PASSAGE_CHARS]}" for i, c in enumerate(candidates))
    order = parse_order(chat("Order these passages from most to least useful for the question. Give a JSON list of their numbers and nothing else.", f"Question: {query}\n\n{shown}"), len(candidates))
    if not order:
        return candidates[:top_k]
    rest = [] if strict_parity else [i for i in range(len(candidates)) if i not in set(order)]
    return [candidates[i] for i in [*order, *rest]][:top_k]


def apply_order(ranked: DataFrame, order: list[int], top_k: int) -> DataFrame:
    """``ranked`` (rank 1..) in the order of zero-based positions, as a join on position."""
    wanted = ranked.sparkSession.createDataFrame([(p + 1, i + 1) for i, p in enumerate(order)], "rank int, new_rank int")
    return ranked.join(F.broadcast(wanted), "rank").filter(F.col("new_rank") <= top_k).drop("rank").withColumnRenamed("new_rank", "rank")


def contents(results: DataFrame, chunk: DataFrame) -> DataFrame:
    """Results with their chunks' content, or the headline where the chunk has gone."""
    c = chunk.select(F.col("id").alias("chunk_id"), "content").join(F.broadcast(results.select("chunk_id").distinct()), "chunk_id", "left_semi")  # a page of them
    return results.join(c, "chunk_id", "left").withColumn("content", F.coalesce("content", "headline"))


def context(results: DataFrame) -> DataFrame:
    """One row: the passages in rank order, each under its title."""
    part = F.concat(F.lit("### "), F.coalesce("document_title", F.lit("")), F.lit("\n"), F.col("content"))
    parts = results.groupBy().agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("x"))
    return parts.select(F.array_join(F.transform("x", lambda x: x["part"]), "\n\n").alias("context"))


def rag_answer(chunk: DataFrame, document: DataFrame, query: str, embed: Callable[[str], list[float]], domain_id: str, chat: Chat, options: Options = Options()) -> dict:
    """Answer with sources: candidates, reranked where wanted, their contents as the model's context."""
    found = hybrid_search(chunk, document, query, embed, domain_id, size=options.candidates, options=options)
    page = chunk.sparkSession.createDataFrame(found.results.collect(), found.results.schema)  # one page
    rows = contents(page, chunk).orderBy("rank").collect()
    if options.rerank:
        rows = rerank(query, rows, options.context_chunks, lambda r: r["content"], chat, options.strict_parity)
    rows = rows[: options.context_chunks]
    text = "\n\n".join(f"### {r['document_title']}\n{r['content']}" for r in rows)
    return {"answer": chat(f"Answer from these passages only, and say so where they don't suffice.\n\n{text}", query), "sources": [r.asDict() for r in rows], "context": text}


def canned_chat(system: str, user: str) -> str:
    """The offline default: a list of the passages' numbers, or the first passage."""
    if system.startswith("Order"):
        return json.dumps(list(range(user.count("\n\n["))))
    return system.partition("### ")[2].partition("\n")[2][:240]
