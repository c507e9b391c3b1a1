"""The library's face: each method gives a DataFrame (or several)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import markdown as md
from .operators import agent, ask, blocks, graph, health, knowledge, memory, search, vault
from .sources import files


class Vault:
    """Notes (path, content, mtime) and all that is derived from them."""

    def __init__(self, notes: DataFrame):
        self.notes, self.parsed = notes, md.parsed(notes)

    @classmethod
    def scan(cls, spark: SparkSession, folder: str) -> Vault:
        return cls(files.scan(spark, folder))

    def diff(self, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What changed against ``state`` (path, hash), and which changes are renames."""
        found = vault.inventory_diff(state, self.notes.select("path", F.sha2("content", 256).alias("hash")))
        return found, vault.renames(found)

    def blocks(self) -> DataFrame:
        return blocks.block_rows(self.notes)

    def chunks(self) -> DataFrame:
        return blocks.chunk_rows(self.notes)

    def claims(self) -> DataFrame:
        return knowledge.claims(self.parsed)

    def relationships(self) -> DataFrame:
        return knowledge.relationships(self.parsed)

    def entities(self) -> DataFrame:
        return knowledge.entities(self.parsed)

    def links(self) -> DataFrame:
        return knowledge.resolved_links(self.parsed)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return graph.nodes(self.parsed, self.links()), graph.edges(self.parsed, self.links())

    def broken_links(self) -> DataFrame:
        return health.broken_links(self.links())

    def orphans(self) -> DataFrame:
        return health.orphans(self.parsed, self.links())

    def duplicates(self) -> DataFrame:
        return vault.duplicates(self.notes)

    def health(self) -> DataFrame:
        """One row: notes, entities, claims, candidates for memories, broken links, orphans and duplicates."""
        return health.summary(self.notes)

    def embedding_status(self, vectors: DataFrame) -> DataFrame:
        """One row: chunks in all, those with one of ``vectors`` (chunk_id, v), and those without."""
        return health.embedding_status(self.chunks(), vectors)


class Search:
    """Ranked chunks for a table of queries (query_id, query). ``embed`` is a function of a text column, such as a pandas UDF that gives vectors; without one, hashed words re-rank."""

    MOST = 100

    def __init__(self, v: Vault, analyzer: str = "porter", embed=None, index: search.Index | None = None):
        """``index``: one that is kept (``segments.Segments``), in place of one built anew."""
        self.vault, self.embed = v, embed
        self.index = index or search.Index.build(v.notes, analyzer)
        self.names = knowledge.mentions(v.parsed)

    def _limit(self, limit: int) -> int:
        return max(1, min(limit, self.MOST))

    def query(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        """The blend, or the lexical hits where the embedder fails."""
        return search.found(self.index, queries, self.names, self._limit(limit), self.embed)

    def lexical(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        return search.lexical(self.index, queries, self._limit(limit))

    def by_place(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        """For queries without hits: chunks by their heading or note path."""
        return search.fallback(self.index, queries, self._limit(limit))

    def vectors(self) -> tuple[DataFrame, DataFrame]:
        """Vectors of all chunks, and jobs for those that the embedder failed on."""
        return search.embedded(self.index, self.embed)

    def note_context(self, most: int = 3) -> DataFrame:
        """For each note, by its title, the best chunks of other notes."""
        t = self.vault.parsed.select(F.xxhash64("path").alias("query_id"), F.col("title").alias("query"), F.col("path").alias("own"))
        return search.context(self.index, t, self.names, most).join(t.select("query_id", "own"), "query_id").drop("query_id")


class Memory:
    """Memories (path, content, type, status, ...) made of claims, and contradictions between these."""

    def __init__(self, v: Vault):
        self.vault = v

    def candidates(self, stored: DataFrame | None = None) -> DataFrame:
        """New candidates: what ``stored`` (path, content; of any status) has is never proposed again."""
        found = memory.candidates(self.vault.claims())
        return found if stored is None else memory.unseen(found, stored)

    def contradictions(self) -> DataFrame:
        return memory.contradictions(self.vault.claims())

    def contradiction_heads(self) -> DataFrame:
        return memory.contradiction_heads(self.vault.claims())

    def stale(self, memories: DataFrame) -> DataFrame:
        """Memories whose note is gone."""
        return memories.join(self.vault.notes.select("path"), "path", "left_anti")

    replay = staticmethod(memory.fold_states)
    decide = staticmethod(memory.decided)
    update = staticmethod(memory.updated)
    supersede = staticmethod(memory.superseded)
    listed = staticmethod(memory.listed)
    next_jobs = staticmethod(memory.next_jobs)


class Ask:
    """Questions to a vault: ``context`` gathers the evidence, ``answer`` makes answers of it, by ``generate`` (a function of a prompt column) if there is one."""

    MOST = 20

    def __init__(self, v: Vault, embed=None, generate=None):
        self.vault, self.embed, self.generate = v, embed, generate
        self.index = search.Index.build(v.notes)

    def classify(self, queries: DataFrame) -> DataFrame:
        return queries.select("query_id", ask.kind(F.col("query")).alias("kind"))

    def context(self, queries: DataFrame, limit: int = ask.CONTEXT) -> ask.Context:
        return ask.Context(self.vault.notes, queries, self.index, max(1, min(limit, self.MOST)), self.embed)

    def answer(self, queries: DataFrame, limit: int = ask.CONTEXT) -> DataFrame:
        return self.context(queries, limit).answers(self.generate)

    def memories(self, queries: DataFrame, most: int = 3) -> DataFrame:
        return ask.relevant(queries, Memory(self.vault).candidates(), "content", "content", most)

    check = staticmethod(ask.checked)


class Agent:
    """Checks of proposed operations, their plans, their undoing, and their audit."""

    def __init__(self, v: Vault):
        self.vault = v

    def plan(self, request: str, **how) -> DataFrame:
        """The edits that a request asks for (see ``agent.planned``)."""
        return agent.planned(self.vault.notes, request, **how)

    def plan_merge(self, paths: list[str], into: str) -> DataFrame:
        return agent.merged(self.vault.notes, paths, into)

    def plan_link(self, target: str, most: int = 5) -> DataFrame:
        return agent.linked(self.vault.notes, target, most)

    def plan_metadata(self, most: int = 5) -> DataFrame:
        return agent.headed(self.vault.notes, most)

    def tools(self) -> DataFrame:
        return agent.agent_tools(self.vault.notes.sparkSession, "")

    gate = staticmethod(agent.gated)
    decide = staticmethod(agent.decided)
    preview = staticmethod(agent.previewed)
    prepare = staticmethod(agent.prepare)
    version_check = staticmethod(agent.version_check)
    verify_applied = staticmethod(agent.misapplied)
    rollback = staticmethod(agent.rollback)
    listed = staticmethod(agent.listed)
    chain = staticmethod(agent.chain)
    verify = staticmethod(agent.verify)
