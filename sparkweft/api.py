"""The engine as one object: tables in, batch answers out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import CONFIG, EngineConfig
from .functions import code
from .operators import cochange, feedback, graph, payload, retrieval, selection, semantic, structure, tree


class Engine:
    """Holds a graph and a corpus; each verb answers for all requests of its input at once."""

    def __init__(self, items: DataFrame, edges: DataFrame, documents: DataFrame | None = None, config: EngineConfig = CONFIG):
        self.items, self.edges, self.documents, self.config = items, edges, documents, config
        self.hooks: dict[str, list[Callable[[DataFrame], DataFrame]]] = {"pre_context": [], "post_context": [], "post_build": [], "post_update": []}

    @classmethod
    def build(cls, items: DataFrame, baskets: DataFrame, basket_items: DataFrame, documents: DataFrame | None = None, config: EngineConfig = CONFIG, hooks: dict[str, list] | None = None) -> Engine:
        engine = cls(items, cochange.cochange_edges(baskets, basket_items, config.max_basket), documents, config)
        for when, fns in (hooks or {}).items():
            for fn in fns:
                engine.hook(when, fn)
        engine.edges = engine._run("post_build", engine.edges)
        return engine

    def _with(self, edges: DataFrame) -> Engine:
        out = Engine(self.items, edges, self.documents, self.config)
        out.hooks = self.hooks
        return out

    def hook(self, when: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        self.hooks[when].append(fn)

    def _run(self, when: str, df: DataFrame) -> DataFrame:
        for fn in self.hooks[when]:
            df = df.transform(fn)
        return df

    def update(self, baskets: DataFrame, basket_items: DataFrame) -> Engine:
        new = cochange.cochange_edges(baskets, basket_items, self.config.max_basket)
        return self._with(self._run("post_update", cochange.merge_edges(self.edges, new)))

    def decay_sweep(self, now: int) -> Engine:
        return self._with(cochange.decayed(self.edges, now, self.config.time_constant_days, self.config.prune_below))

    def maybe_decay(self, now: int, last: int | None, interval: int = 86_400) -> tuple[Engine, int]:
        """A sweep if the last one is an interval ago, and when the last one was then."""
        return (self, last) if last is not None and now - last < interval else (self.decay_sweep(now), now)

    def neighbours(self, seeds: DataFrame) -> DataFrame:
        return cochange.neighbours(self.edges, seeds, self.config.min_weight)

    def blast(self, seeds: DataFrame) -> DataFrame:
        c = self.config
        return graph.blast_radius(self.edges, seeds, min_weight=c.min_weight, max_depth=c.max_depth, max_results=c.max_results)

    def explore(self, seeds: DataFrame) -> DataFrame:
        return graph.walk_scores(self.edges, seeds, restart=self.config.restart, k=self.config.top_k)

    def stats(self) -> DataFrame:
        return cochange.graph_stats(self.items, self.edges)

    def hotspots(self, n: int = 20) -> DataFrame:
        return cochange.hotspots(self.edges, n)

    def communities(self, max_size: int = 50) -> DataFrame:
        return graph.communities(graph.connected_components(self.edges, min_weight=self.config.min_weight), max_size=max_size)

    def list_subsystems(self) -> DataFrame:
        return structure.subsystem_summary(self.items, cochange.degrees(self.edges).select("item_id", "degree"))

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        return retrieval.bm25_of(self.documents, queries, k=k)

    def learn(self, events: DataFrame) -> DataFrame:
        return feedback.learned_weights(feedback.fold(feedback.deduplicated(events)))

    def affected_tests(self, links: DataFrame, changed: DataFrame) -> DataFrame:
        return tree.affected_tests(self.items.select("path"), links, changed)

    def search_symbols(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """Over the symbols of the documents, whose doc_id is their path."""
        symbols = code.symbols(self.documents.select(F.col("doc_id").alias("path"), "text"))
        return semantic.symbol_bm25(symbols, queries, k=k)

    def search_identifiers(self, queries: DataFrame, k: int = 20) -> DataFrame:
        return semantic.identifier_search(self.documents, queries, k=k)

    def report(self, title: str = "Architecture") -> str:
        hubs = cochange.hotspots(self.edges).join(self.items, "item_id").select("path", "degree")
        groups = tree.assigned_subsystems(self.items.select("path"), {}).groupBy("subsystem").agg(F.count("*").alias("files"))
        return tree.report(title, groups, hubs, self.stats())

    def compress(self, entries: DataFrame, aggressive: bool = False) -> DataFrame:
        return payload.compressed(entries, aggressive=aggressive)

    def context(self, seeds: DataFrame, budget: int, tokens: F.Column, have: DataFrame | None = None) -> DataFrame:
        """What matters for the seeds and is not had yet (request_id, path), ranked by graph and community, diverse at the tail, within a budget."""
        found = self._run("pre_context", self.blast(seeds)).join(self.items, "item_id")
        if have is not None:
            found = found.join(have.select("request_id", "path"), ["request_id", "path"], "left_anti")
        members = graph.connected_components(self.edges, self.items, min_weight=self.config.min_weight)
        found = selection.community_boost(found, members, seeds).withColumn("relevance", F.col("weight") + F.col("boost"))
        order = retrieval.mmr(found, lam=self.config.mmr_lambda, protect=self.config.mmr_protect, limit=self.config.max_results)
        ranked = order.withColumnRenamed("position", "rank").withColumn("tokens", tokens)
        return self._run("post_context", retrieval.budget_pack(ranked, "request_id", "tokens", budget))
