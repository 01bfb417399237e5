"""The searches as tools that a model can call by name, with their descriptions and a dispatcher."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import search


def _tool(name: str, about: str, **parameters: tuple[str, str]) -> dict[str, Any]:
    properties = {key: {"type": kind, "description": text} for key, (kind, text) in parameters.items()}
    return {"name": name, "description": about, "parameters": {"type": "object", "properties": properties, "required": ["query"]}}


TOOLS = [
    _tool("search_terms", "Terms for a word or phrase, by words, meaning or both.", query=("string", "what to look for"), mode=("string", "words, meaning or both"), limit=("integer", "how many")),
    _tool("lookup_term", "One term, exactly as it is written.", query=("string", "the term")),
    _tool("suggest_translations", "Approved translations of terms that mean nearly the same.", query=("string", "the term"), limit=("integer", "how many")),
]


class SearchTools:
    """Searches over one terminology table, of one document if it is given.

    ``embed`` turns a query into a vector; without it only words are searched.
    Every search has ``id``, ``term``, ``translation``, ``frequency``, ``context`` and ``score``.
    """

    def __init__(self, terms: DataFrame, lang: str = "en", embed: Callable[[str], list[float]] | None = None, document_id: int | None = None) -> None:
        self.terms = terms if document_id is None else terms.where(F.col("document_id") == document_id)
        self.translation, self.embed = f"translation_{lang}", embed

    def _rows(self, scored: DataFrame, score: str) -> DataFrame:
        found = self.terms.select("id", "term", F.col(self.translation).alias("translation"), "frequency", "context")
        return found.join(F.broadcast(scored.select("id", F.col(score).alias("score"))), "id").orderBy(F.desc("score"), "id")

    def search_terms(self, query: str, mode: str = "both", limit: int = 10) -> DataFrame:
        if mode not in ("words", "meaning", "both"):
            raise ValueError(f"unknown mode: {mode}")
        by_words = search.bm25(self.terms, "id", ["term", "context"], query)
        if self.embed is None or mode == "words":
            return self._rows(search.top(by_words, "score", limit), "score")
        by_meaning = search.semantic(self.terms, "id", "embedding", self.embed(query))
        if mode == "meaning":
            return self._rows(search.top(by_meaning, "similarity", limit), "similarity")
        return self._rows(search.hybrid(by_words, by_meaning, limit), "combined_score")

    def lookup_term(self, query: str) -> DataFrame:
        rows = self.terms.where(F.col("term") == query).orderBy(F.desc(F.coalesce("approved", F.lit(False))), "id").limit(1)
        return rows.select("id", "term", F.col(self.translation).alias("translation"), "frequency", "context", F.lit(1.0).alias("score"))

    def suggest_translations(self, query: str, limit: int = 5) -> DataFrame:
        if self.embed is None:
            raise ValueError("suggestions need vectors of queries")
        near = search.similar(self.terms, "id", "embedding", self.embed(query), 20, 0.2)
        return search.suggestions(near, self.terms, "id", self.translation, F.coalesce("approved", F.lit(False)), limit)

    def call(self, name: str, arguments: dict[str, Any]) -> list[dict[str, Any]] | dict[str, str]:
        """The rows of a tool, a short list, or what is wrong with the call."""
        if name not in {t["name"] for t in TOOLS}:
            return {"error": f"unknown tool: {name}"}
        try:
            return [r.asDict() for r in getattr(self, name)(**arguments).collect()]
        except (TypeError, ValueError) as wrong:
            return {"error": str(wrong)}
