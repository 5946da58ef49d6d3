"""Feature spaces of a profile: word, character and embedding blocks side by side, as long weights or as vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import materialize
from . import features as FE
from .linear import packed


@dataclass(frozen=True)
class Profile:
    """What a space is made of. ``char_chars`` 0 leaves the character block out."""

    name: str
    word_chars: int = 2500
    pairs: bool = True
    min_df: int = 3
    max_features: int = 300_000
    char_chars: int = 0
    char_min_df: int = 3
    char_max_features: int = 300_000
    embeddings: bool = True
    scale: float = 0.6
    size: int = 64


class Space:
    """A fitted space: ``terms(block, term, df, idf)``; blocks are ``w`` (words and pairs) and ``c`` (characters)."""

    def __init__(self, profile: Profile, terms: DataFrame):
        self.profile, self.terms = profile, terms
        self._index: DataFrame | None = None

    @classmethod
    def fit(cls, profile: Profile, docs: DataFrame) -> Space:
        """Fit on ``docs(row_id, text)``."""
        n = docs.count()
        out = None
        for block, column, least, most in cls._blocks(profile):
            t = FE.fit(FE.term_counts(docs, column), n, least, most).select(F.lit(block).alias("block"), "term", "df", "idf")
            out = t if out is None else out.unionByName(t)
        return cls(profile, materialize(out, f"space-{profile.name}"))

    @staticmethod
    def _blocks(p: Profile) -> list[tuple]:
        out = [("w", FE.word_terms(chars=p.word_chars, two=p.pairs), p.min_df, p.max_features)]
        return out + [("c", FE.char_terms(chars=p.char_chars), p.char_min_df, p.char_max_features)] * bool(p.char_chars)

    def weights(self, docs: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
        """(row_id, term, w), terms with their block's prefix; ``embeddings(row_id, embedding)`` are scaled."""
        blocks = []
        for block, column, *_ in self._blocks(self.profile):
            own = self.terms.filter(F.col("block") == block)
            blocks.append((f"{block}:", FE.transform(FE.term_counts(docs, column), own), 1.0))
        if embeddings is not None and self.profile.embeddings:
            blocks.append(("e:", FE.dense_block(embeddings, "row_id", "embedding"), self.profile.scale))
        return FE.stack(*blocks)

    def index(self) -> DataFrame:
        """(term, i) of all blocks: words, characters, then the components of the embedding."""
        if self._index is None:
            from ..plans.runtime import ranked

            all_ = self.terms.select(F.concat("block", F.lit(":"), "term").alias("term"))
            if self.profile.embeddings:
                all_ = all_.unionByName(all_.sparkSession.range(self.profile.size).select(F.concat(F.lit("e:"), F.col("id").cast("string")).alias("term")))
            self._index = materialize(ranked(all_, [F.col("term")], "i"), "numbered")
        return self._index

    def vectors(self, weights: DataFrame, docs: DataFrame) -> DataFrame:
        """(row_id, features) of every document, the empty vector for one without any term."""
        return packed(weights, self.index(), docs=docs)

    def describe(self) -> dict:
        n = {r.block: r.n for r in self.terms.groupBy("block").agg(F.count("*").alias("n")).collect()}
        e = self.profile.size if self.profile.embeddings else 0
        return {"profile": self.profile.name, "word_features": n.get("w", 0), "char_features": n.get("c", 0), "embedding_dim": e, "dimension": sum(n.values()) + e}
