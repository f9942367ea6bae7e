"""Readers of the graph formats."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import json_nan_to_null, nan_to_null, content_id, first_present, float_or, norm_key, present, strip
from graphloom.operators import merge as M
from graphloom.operators.graph import PropertyGraph, canonical_format, first_wins, last_wins
from graphloom.operators.vector import VectorIndex, edge_documents
from graphloom.sources.base import GraphSource, GraphSourceError, UnsupportedSourceError, as_path, field, graph, lines, merged_json, numbered, other_fields


def exists(source, *names: str) -> bool:
    try:
        return all((as_path(source) / n).exists() for n in names)
    except Exception:
        return False


def manifest(source) -> dict:
    """The manifest beside a component graph, also under its misspelt name; empty if there is none."""
    for name in ("manifest.json", "menifest.json"):
        path = as_path(source) / name
        if path.exists():
            return json.loads(path.read_text())
    return {}


class NativeSource(GraphSource):
    """``{path}_nodes.parquet`` and ``{path}_edges.parquet`` with all columns of both; NaN in them is null."""

    name = "native"

    def can_read(self, source):
        return Path(f"{source}_nodes.parquet").exists() and Path(f"{source}_edges.parquet").exists()

    def read(self, spark, source, **options):
        if "://" not in str(source) and not self.can_read(source):
            raise FileNotFoundError(f"{source}_nodes.parquet and {source}_edges.parquet")
        nodes, edges = (spark.read.parquet(f"{source}_{part}.parquet") for part in ("nodes", "edges"))
        if nodes.schema["text"].dataType.typeName() in ("double", "float"):  # a column of NaN only
            nodes = nodes.withColumn("text", F.lit(None).cast("string"))
        if "ord" not in nodes.columns:
            nodes = nodes.withColumn("ord", F.monotonically_increasing_id())
        nodes, edges = (f.select(*[nan_to_null(F.col(c.name), c.dataType).alias(c.name) for c in f.schema]) for f in (nodes, edges))
        nodes, edges = (f.withColumn("metadata", json_nan_to_null(F.col("metadata"))) if "metadata" in f.columns and f.schema["metadata"].dataType.typeName() == "string" else f for f in (nodes, edges))
        nodes, edges = (f.withColumn("metadata", F.to_json("metadata", {"ignoreNullFields": "false"})) if "metadata" in f.columns and f.schema["metadata"].dataType.typeName() in ("struct", "map") else f for f in (nodes, edges))
        return graph(last_wins(nodes, "id", "ord"), edges)


class ComponentSource(GraphSource):
    """``nodes.jsonl`` and ``edges.jsonl``; edges are objects or arrays and carry no relation or weight."""

    name = "component_graph"

    def can_read(self, source):
        return exists(source, "nodes.jsonl", "edges.jsonl")

    def read(self, spark, source, *, keep_source_reference=False, attach=None, **options):
        """``attach``: parquet of an index, else the manifest's ``vector_store.path`` if it is parquet."""
        rows = lines(spark, f"{source}/nodes.jsonl").withColumn("id", F.get_json_object("value", "$.id")).filter("id is not null")
        nodes = last_wins(rows.select("id", F.coalesce(F.get_json_object("value", "$.type"), F.lit("Chunk")).alias("type"), F.get_json_object("value", "$.text").alias("text"), other_fields(F.col("value"), ("id", "text", "type")).alias("metadata"), "ord"), "id", "ord")
        is_list = F.trim("value").startswith("[")
        listed = F.from_json("value", "array<string>")
        ends = {side: F.when(is_list, F.get(listed, F.lit(i))).otherwise(F.coalesce(F.get_json_object("value", f"$.{short}"), F.get_json_object("value", f"$.{side}"))) for i, (side, short) in enumerate((("source", "src"), ("target", "tgt")))}
        edges = lines(spark, f"{source}/edges.jsonl").select(ends["source"].alias("source"), ends["target"].alias("target"), F.col("ord").alias("edge_idx")).filter("source is not null and target is not null")
        out = self.stamped(graph(nodes, edges), source, keep_source_reference)
        store = (manifest(source) if "://" not in str(source) else {}).get("vector_store", {})
        path = attach or (store.get("path") if str(store.get("path", "")).endswith(".parquet") else None)
        if path:
            index = VectorIndex.read(spark, path, options.get("distance_metric", store.get("distance_metric", "cosine")))
            out = out.attach("node_vector", index).attach(options.get("collection_name", store.get("collection_name", "node_vector")), index)
        return out


class AttributeBundleSource(GraphSource):
    """``vdb_entities.json`` and ``vdb_relationships.json``: records and, by position, a matrix of vectors."""

    name = "attribute_bundle_graph"

    def can_read(self, source):
        return exists(source, "vdb_entities.json", "vdb_relationships.json")

    @staticmethod
    def records(spark: SparkSession, path: str, load_embeddings: bool = True) -> DataFrame:
        """value (JSON text), ord, vector: items of ``data`` with their vectors.

        A file is one JSON document and so one task; convert large ones to lines once."""
        whole = spark.read.text(path, wholetext=True)
        items = F.from_json(F.get_json_object("value", "$.data"), "array<string>")
        matrix = F.from_json(F.get_json_object("value", "$.matrix"), "array<array<float>>")
        any_row = F.exists(F.coalesce(matrix, F.array().cast("array<array<float>>")), lambda r: r.isNotNull())
        # Parsed before the records are listed, so once per file and not per record.
        listed = whole.select(items.alias("items"), any_row.alias("any_row")).select(F.posexplode("items").alias("ord", "value"), "any_row")
        rows = listed.filter(F.trim("value").startswith("{"))
        if not load_embeddings:
            return rows.select("value", F.col("ord").cast("long").alias("ord"), F.lit(None).cast("array<float>").alias("vector"))
        encoded = M.decoded_vector(field("value", "__vector__", "embedding", "vector"))
        by_place = whole.select(F.posexplode(matrix).alias("ord", "row"))
        return rows.join(by_place, "ord", "left").select("value", F.col("ord").cast("long").alias("ord"), F.when(F.col("any_row"), F.col("row")).otherwise(encoded).alias("vector"))

    def read(self, spark, source, *, keep_source_reference=False, load_embeddings=True, key_by_name=False, **options):
        """``key_by_name``: nodes are keyed by entity_name, which is what the edges refer to."""
        rows = self.records(spark, f"{source}/vdb_entities.json", load_embeddings)
        keys = ("entity_name", "id", "__id__") if key_by_name else ("id", "__id__")
        known = ("id", "__id__", "content", "__vector__", "embedding", "vector")
        nodes = rows.select(field("value", *keys).alias("id"), F.coalesce(field("value", "type"), F.lit("Entity")).alias("type"), F.get_json_object("value", "$.content").alias("text"), F.col("vector").alias("embedding"), other_fields(F.col("value"), known).alias("metadata"), "ord").filter("id is not null")
        nodes = last_wins(nodes, "id", "ord")
        links = self.records(spark, f"{source}/vdb_relationships.json", load_embeddings)
        edges = links.select(
            field("value", "src_id", "source", "src").alias("source"),
            field("value", "tgt_id", "target", "tgt").alias("target"),
            F.coalesce(field("value", "relation"), F.lit("RELATED")).alias("relation"),
            float_or(F.get_json_object("value", "$.weight"), 1.0).alias("weight"),
            other_fields(F.col("value"), ("src_id", "source", "src", "tgt_id", "target", "tgt", "relation", "weight", "__vector__", "embedding", "vector")).alias("metadata"),
            F.col("ord").alias("edge_idx"),
            F.col("vector"),
        ).filter("source is not null and target is not null")
        out = self.stamped(graph(nodes, edges.drop("vector")), source, keep_source_reference)
        if load_embeddings:
            out = out.attach("node_vector", node_index(out.nodes)).attach("edge_vector", VectorIndex(edge_documents(edges).join(edges.select(F.col("edge_idx").alias("ord"), F.col("vector").alias("embedding")), "ord"), name="edge_vector"))
        return out


def node_index(nodes: DataFrame, metric: str = "cosine") -> VectorIndex:
    """The index of the nodes that have an embedding."""
    return VectorIndex(nodes.filter("embedding is not null").select("id", F.col("text").alias("document"), "metadata", "embedding", "ord"), metric, "node_vector")


class TopologySource(GraphSource):
    """Entity, chunk and fact stores, an open-extraction file and topology edges converted to parquet.

    Stages: entities, chunks, chunk links, placeholders for names that no entity has, fact edges,
    topology edges.  ``topology.parquet`` (src, dst, weight) stands for the pickled graph, which is
    never unpickled here; without it there are no topology edges."""

    name = "topology_semantic_graph"
    STORES = {"entity": "entity_embeddings/vdb_entity.parquet", "chunk": "chunk_embeddings/vdb_chunk.parquet", "fact": "fact_embeddings/vdb_fact.parquet"}

    def can_read(self, source):
        return exists(source, self.STORES["entity"]) or exists(source, "topology.parquet")

    @staticmethod
    def working_dir(source) -> Path:
        """The folder with the topology: the source, or its only child that has one."""
        path = as_path(source)
        if (path / "topology.parquet").exists() or (path / "entity_embeddings").exists():
            return path
        children = [p for p in sorted(path.iterdir()) if (p / "topology.parquet").exists() or (p / "entity_embeddings").exists()]
        if len(children) != 1:
            raise GraphSourceError(f"{len(children)} graphs under {path}")
        return children[0]

    @staticmethod
    def store(spark: SparkSession, path: Path) -> DataFrame:
        """id, text, embedding, ord of a store; empty where the file is missing."""
        if not path.exists():
            return spark.createDataFrame([], "id string, text string, embedding array<float>, ord long")
        rows = spark.read.parquet(str(path))
        vector = F.col("embedding").cast("array<float>") if "embedding" in rows.columns else F.lit(None).cast("array<float>")
        return rows.select(F.col("hash_id").alias("id"), F.col("content").alias("text"), vector.alias("embedding"), F.monotonically_increasing_id().alias("ord"))

    @staticmethod
    def openie(spark: SparkSession, given, *folders: Path) -> DataFrame | None:
        """One row per document: idx, passage, entities, triples, ord, of the last file by name in the first folder that has one."""
        found = next((f for folder in folders if (f := sorted(folder.glob("openie_results_ner_*.json")))), [])
        if not given and not found:
            return None
        whole = spark.read.text(str(given or found[-1]), wholetext=True)
        docs = F.from_json(F.get_json_object("value", "$.docs"), "array<struct<idx:string,passage:string,extracted_entities:array<string>,extracted_triples:array<array<string>>>>")
        rows = whole.select(F.posexplode(docs).alias("ord", "d"))
        entities = F.filter("d.extracted_entities", lambda e: strip(e) != "")
        triples = F.filter("d.extracted_triples", lambda t: F.size(t) == 3)
        return rows.select(F.col("d.idx").alias("idx"), F.col("d.passage").alias("passage"), entities.alias("entities"), triples.alias("triples"), F.col("ord").cast("long").alias("ord"))

    def read(self, spark, source, *, keep_source_reference=False, load_embeddings=True, openie_path=None, **options):
        work = self.working_dir(source)
        stores = {k: self.store(spark, work / p) for k, p in self.STORES.items()}
        if not load_embeddings:
            stores = {k: v.withColumn("embedding", F.lit(None).cast("array<float>")) for k, v in stores.items()}
        step = 1 << 52
        told = lambda **more: F.to_json(F.struct(F.col("id").alias("hash_id"), *[F.lit(v).alias(k) for k, v in more.items()]))
        typed = lambda rows, kind, stage: rows.select("id", F.lit(kind).alias("type"), "text", "embedding", told(node_type=kind).alias("metadata"), (F.col("ord") + stage * step).alias("ord"))
        nodes = typed(stores["entity"], "Entity", 0).unionByName(typed(stores["chunk"], "Chunk", 1))
        edges = []
        bare = []
        docs = self.openie(spark, openie_path, work.parent)
        if docs is not None:
            last = docs.filter("idx != ''").withColumnRenamed("idx", "chunk_id").groupBy("chunk_id").agg(F.max_by(F.struct("entities", "ord"), "ord").alias("d"))
            known = last.join(stores["chunk"].select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
            named = known.select("chunk_id", F.posexplode("d.entities").alias("i", "name"), F.col("d.ord").alias("doc")).withColumn("ord", F.col("doc") * (1 << 20) + F.col("i"))
            resolved = M.resolve_names(named, stores["entity"])
            bare.append(resolved.filter("placeholder").select(F.col("resolved").alias("id"), F.col("name").alias("text"), "ord", F.lit(2).alias("stage")))
            links = M.chunk_links(resolved.select("chunk_id", F.col("resolved").alias("entity_id"), "ord"))
            passage = F.when(F.col("relation") == "mentions", F.col("source")).otherwise(F.col("target"))
            edges.append(links.withColumns({"weight": F.lit(1.0), "stage": F.lit(0), "metadata": F.to_json(F.struct(F.lit("openie").alias("source"), passage.alias("openie_passage_id")))}))
            open_triples = docs.select("ord", F.posexplode("triples").alias("i", "t")).select(F.col("t")[0].alias("head"), F.col("t")[1].alias("relation"), F.col("t")[2].alias("tail"), (F.col("ord") * (1 << 20) + F.col("i")).alias("ord"))
        else:
            open_triples = spark.createDataFrame([], "head string, relation string, tail string, ord long")
        parsed = stores["fact"].select("ord", F.col("id").alias("fact_id"), F.col("text").alias("fact"), F.col("embedding").alias("fact_embedding"), M.fact_triple("text").alias("t")).select("t.head", strip(F.col("t.relation")).alias("relation"), "t.tail", "ord", "fact_id", "fact", "fact_embedding").filter(norm_key(F.col("head")) != "").filter(norm_key(F.col("tail")) != "")
        sides = M.resolve_names(parsed, stores["entity"], "head").withColumnsRenamed({"resolved": "source", "placeholder": "new_source"})
        sides = M.resolve_names(sides, stores["entity"], "tail").withColumnsRenamed({"resolved": "target", "placeholder": "new_target"})
        for end, name in (("source", "head"), ("target", "tail")):
            bare.append(sides.filter(f"new_{end}").select(F.col(end).alias("id"), norm_key(F.col(name)).alias("text"), "ord", F.lit(3).alias("stage")))
        facts = first_wins(sides.select("source", "target", "relation", "ord", "fact_id", "fact", "fact_embedding"), ["source", "target", "relation"], "ord")
        edges.append(facts.select("source", "target", "relation", F.lit(1.0).alias("weight"), F.col("ord").alias("edge_idx"), F.lit(1).alias("stage"), F.to_json(F.struct(F.lit("vdb_fact").alias("source"), F.col("fact_id").alias("fact_hash_id"))).alias("metadata")))
        placeholders = bare[0]
        for more in bare[1:]:
            placeholders = placeholders.unionByName(more)
        placeholders = first_wins(placeholders.withColumn("ord", F.col("ord") + F.col("stage") * step), ["id"], "ord").join(nodes.select("id"), "id", "left_anti")
        inferred = F.when(F.col("stage") == 2, told(inferred_from_openie_entity=True)).otherwise(told(inferred_from_fact=True))
        nodes = nodes.unionByName(placeholders.select("id", F.lit("Entity").alias("type"), "text", F.lit(None).cast("array<float>").alias("embedding"), inferred.alias("metadata"), "ord"))
        if (work / "topology.parquet").exists():
            topology = spark.read.parquet(str(work / "topology.parquet")).select(F.col("src").alias("source"), F.col("dst").alias("target"), float_or(F.col("weight").cast("string"), 1.0).alias("weight"), F.monotonically_increasing_id().alias("ord"))
            named = M.topology_edges(topology, facts, open_triples, nodes.select("id", "text"))
            edges.append(named.withColumnRenamed("ord", "edge_idx").withColumns({"stage": F.lit(2), "metadata": F.lit('{"source":"igraph"}')}))
            # Without any store the vertices themselves are the nodes.
            ends = topology.select(F.explode(F.array("source", "target")).alias("id"), "ord").groupBy("id").agg(F.min("ord").alias("ord"))
            none = ends.join(nodes.limit(1).select(F.lit(True).alias("_any")), F.col("_any"), "left_anti")  # one row at most
            fallback = none.select("id", F.lit("Unknown").alias("type"), F.col("id").alias("text"), F.lit(None).cast("array<float>").alias("embedding"), told().alias("metadata"), (F.col("ord") + 4 * step).alias("ord"))
            nodes = nodes.unionByName(fallback)
        every = edges[0]
        for more in edges[1:]:
            every = every.unionByName(more)
        placed = every.withColumn("edge_idx", F.col("edge_idx") + F.col("stage") * step)
        merged = placed.groupBy("source", "relation", "target").agg(F.max("weight").alias("weight"), F.min_by("metadata", "edge_idx").alias("metadata"), F.min("edge_idx").alias("edge_idx"))
        out = self.stamped(graph(last_wins(nodes, "id", "ord"), merged), source, keep_source_reference)
        if not load_embeddings:
            return out
        described = F.to_json(F.struct("source", "target", "relation", F.col("fact_id").alias("fact_hash_id")))
        vectors = facts.filter("fact_embedding is not null").select(F.col("fact_id").alias("id"), F.col("fact").alias("document"), described.alias("metadata"), F.col("fact_embedding").alias("embedding"), "ord")
        return out.attach("node_vector", node_index(out.nodes)).attach("edge_vector", VectorIndex(vectors, name="edge_vector"))


class OpenExtractionSource(GraphSource):
    """Only the open-extraction file: nodes and edges from its triples, passages in the metadata of both."""

    name = "openie"

    def can_read(self, source):
        try:
            return any(as_path(source).glob("openie_results_ner_*.json"))
        except Exception:
            return False

    def read(self, spark, source, *, keep_source_reference=False, openie_path=None, **options):
        docs = TopologySource.openie(spark, openie_path, as_path(source), as_path(source).parent)
        if docs is None:
            raise UnsupportedSourceError(f"no open-extraction file at {source}")
        triples = docs.select("ord", F.posexplode("triples").alias("i", "t"), "passage", "idx").select(F.col("t")[0].alias("head"), F.col("t")[1].alias("relation"), F.col("t")[2].alias("tail"), (F.col("ord") * (1 << 20) + F.col("i")).alias("ord"), present(F.col("passage")).alias("passage"), present(F.col("idx")).alias("openie_passage_id"))
        nodes, edges = M.triples_to_graph(triples, "entity", normalised=False)
        # A node's place is twice its triple's, or one more.
        seen = triples.select(F.col("ord").alias("_t"), "passage", "openie_passage_id")
        nodes = nodes.join(seen, F.floor(F.col("ord") / 2) == F.col("_t")).select("id", "text", "ord", F.to_json(F.struct(F.lit(True).alias("inferred_from_openie"), F.col("id").alias("original_label"), "openie_passage_id", "passage")).alias("metadata"))
        edges = edges.join(seen, F.col("edge_idx") == F.col("_t")).select("source", "target", "relation", "edge_idx", F.to_json(F.struct(F.lit("openie").alias("source"), "passage", "openie_passage_id"), {"ignoreNullFields": "false"}).alias("metadata"))
        return self.stamped(graph(nodes, edges), source, keep_source_reference)


class SubgraphUnionSource(GraphSource):
    """One CSV of nodes and one of edges per graph, merged, or just ``nodes.csv`` and ``edges.csv``; vectors from ``embeddings.parquet`` by row.

    The flat files are one graph, whose id is the folder's name (``graph_id`` names another)."""

    name = "subgraph_union_graph"

    def can_read(self, source):
        return exists(source, "nodes", "edges") or exists(source, "nodes.csv", "edges.csv")

    @staticmethod
    def table(spark: SparkSession, path: str, graph_id: str | None) -> DataFrame:
        """All columns as text, gid (the file's stem), row_idx (the row's place in its file) and ord."""
        flat = "://" not in path and not Path(path).exists() and Path(f"{path}.csv").exists()
        where = f"{path}.csv" if flat else f"{path}/{graph_id}.csv" if graph_id else path
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True).csv(where)
        named = raw.select("*", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_i"))
        # A multi-line file is read by one task, so its rows are numbered without gaps.
        first = named.groupBy("_f").agg(F.min("_i").alias("_o"))
        gid = F.lit(graph_id or Path(path).parent.name) if flat else F.regexp_extract("_f", r"([^/]+)\.csv(/[^/]+)?$", 1)
        placed = named.join(first, "_f").withColumns({"gid": gid, "row_idx": F.col("_i") - F.col("_o")}).drop("_o")
        return numbered(placed, ["_f", "_i"])

    def read(self, spark, source, *, keep_source_reference=False, graph_id=None, **options):
        nodes = self.table(spark, f"{source}/nodes", graph_id)
        edges = self.table(spark, f"{source}/edges", graph_id)
        both = nodes.select("gid").intersect(edges.select("gid"))
        nodes, edges = (t.join(both, "gid", "left_semi") for t in (nodes, edges))
        path = as_path(source) / "embeddings.parquet"
        vectors = spark.read.parquet(str(path)) if path.exists() else spark.createDataFrame([], "gid string, kind string, row_idx long, embedding array<float>")
        col = lambda t, *names: F.coalesce(*[present(F.col(n)) for n in names if n in t.columns], F.lit(None).cast("string"))
        known = ("node_id", "id", "node_attr", "text", "type", "gid", "row_idx", "ord")
        other = F.to_json(F.struct(*[c for c in nodes.columns if c not in known])) if set(nodes.columns) - set(known) else F.lit("{}")
        rows = nodes.join(vectors.filter("kind = 'x'").drop("kind"), ["gid", "row_idx"], "left").select("gid", col(nodes, "node_id", "id").alias("local_id"), col(nodes, "type").alias("type"), col(nodes, "node_attr", "text").alias("text"), "embedding", other.alias("metadata"), "ord").filter("local_id is not null")
        merged, local = M.merge_subgraph_nodes(rows)
        links = edges.select("gid", col(edges, "src", "source").alias("source"), col(edges, "dst", "target").alias("target"), F.coalesce(col(edges, "edge_attr", "relation"), F.lit("")).alias("relation"), float_or(col(edges, "weight"), 1.0).alias("weight"), F.col("ord").alias("edge_idx")).filter("source is not null and target is not null")
        joined = M.merge_subgraph_edges(links, local)
        meta = F.to_json(F.struct("graph_ids", "original_node_ids"))
        out_nodes = merged.withColumn("metadata", merged_json(F.col("metadata"), meta)).drop("graph_ids", "original_node_ids")
        out_edges = joined.withColumn("metadata", F.to_json(F.struct(F.col("graph_ids"), F.col("original_edge_ids"))))
        out = self.stamped(graph(out_nodes, out_edges.select("source", "target", "relation", "weight", "edge_idx", "metadata")), source, keep_source_reference)
        return out.attach("node_vector", node_index(out.nodes))


class TripleTextSource(GraphSource):
    """A TSV with a column ``graph`` of ``(head; relation; tail)`` texts."""

    name = "expla_graphs"

    @staticmethod
    def file(source) -> Path:
        path = as_path(source)
        return path / "train_dev.tsv" if path.is_dir() else path

    def can_read(self, source):
        try:
            return self.file(source).suffix == ".tsv" and self.file(source).exists()
        except Exception:
            return False

    def read(self, spark, source, *, keep_source_reference=False, **options):
        rows = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(str(self.file(source)))
        listed = rows.select(M.parsed_triples(F.col("graph")).alias("t"), F.monotonically_increasing_id().alias("row")).select(F.posexplode("t").alias("i", "t"), "row")
        nodes, edges = M.triples_to_graph(numbered(listed.select("t.head", "t.relation", "t.tail", "row", "i"), ["row", "i"]), "node", F.lit("entity"))
        nodes = nodes.withColumn("metadata", F.to_json(F.struct(F.col("id").alias("original_label"))))
        return self.stamped(graph(nodes, edges), source, keep_source_reference)


class TripleListSource(GraphSource):
    """Parquet with a column ``graph`` of lists of triples, one file or folder per split."""

    name = "freebasekg"
    SPLITS = ("train", "validation", "test")

    def can_read(self, source):
        try:
            path = as_path(source)
            return path.suffix == ".parquet" or any(path.glob("*.parquet"))
        except Exception:
            return False

    def read(self, spark, source, *, keep_source_reference=False, splits=None, **options):
        path = as_path(source)
        if not self.can_read(source):
            raise FileNotFoundError(path)
        found = [path] if path.suffix == ".parquet" else [p for s in splits or self.SPLITS for p in sorted(path.glob(f"{s}*.parquet"))]
        rows = None
        for k, part in enumerate(found):
            one = spark.read.parquet(str(part)).select("graph", F.lit(k).alias("file"), F.monotonically_increasing_id().alias("row"))
            rows = one if rows is None else rows.unionByName(one)
        listed = rows.select(F.posexplode("graph").alias("i", "t"), "file", "row").filter(F.size("t") == 3)
        ordered = numbered(listed.select(F.col("t")[0].alias("head"), F.col("t")[1].alias("relation"), F.col("t")[2].alias("tail"), "file", "row", "i"), ["file", "row", "i"])
        nodes, edges = M.triples_to_graph(ordered)
        return self.stamped(graph(nodes, edges), source, keep_source_reference)


class ExploredPathsSource(GraphSource):
    """Explored paths: searched entities, each with relations and the entities at their other end."""

    name = "tog"
    ENTITY = "id:string,entity_id:string,qid:string,name:string,entity_name:string,label:string"
    RIGHT = f"array<struct<{ENTITY},related_paragraphs:variant>>"
    RELATION = f"array<struct<current_relation:struct<{ENTITY},relation:string,head:boolean>,right_entity:{RIGHT}>>"
    SEARCH = f"array<struct<depth:int,each_relation_right_entityList:{RELATION}>>"
    PLACE = ("record", "s", "r", "i")

    def can_read(self, source):
        try:
            return as_path(source).suffix in (".json", ".jsonl") and as_path(source).exists()
        except Exception:
            return False

    @staticmethod
    def records(spark: SparkSession, source) -> DataFrame:
        """value, record: the objects of an object, a list or lines of JSON, numbered from 0."""
        if str(source).endswith(".jsonl"):
            rows = lines(spark, str(source))
            objects = rows.filter(F.trim("value").startswith("{"))
            # A log of exploration runs: numbering it takes one ordered pass over the numbers only.
            places = objects.select("ord", (F.row_number().over(Window.orderBy("ord")) - 1).cast("long").alias("record"))
            return objects.join(places, "ord").select("value", "record")
        whole = spark.read.text(str(source), wholetext=True)
        text = F.trim("value")
        items = F.when(text.startswith("["), F.filter(F.from_json("value", "array<string>"), lambda x: F.trim(x).startswith("{"))).otherwise(F.array("value"))
        return whole.select(F.posexplode(items).alias("record", "value")).select("value", F.col("record").cast("long").alias("record"))

    @staticmethod
    def paragraphs(given: str, order: str, first: str) -> Column:
        """Aggregate, as JSON: the paragraphs told of a node, in order.

        Alone they stay as given, a text or a list, if the node was first seen with them.  Else they
        are a list that others are appended to, each once."""
        told = F.transform(F.array_sort(F.collect_list(F.when(F.col(given).isNotNull(), F.struct(order, given)))), lambda x: x[given])
        born = F.min_by(F.col(given), F.col(order)).isNotNull()
        head = F.when(born, F.coalesce(F.transform(F.from_json(told[0], "array<variant>"), lambda x: F.to_json(x)), F.slice(told, 1, 1))).otherwise(F.slice(told, 1, 1))
        listed = F.concat(F.lit("["), F.array_join(F.array_distinct(F.concat(head, F.slice(told, 2, F.greatest(F.size(told) - 1, F.lit(0))))), ","), F.lit("]"))
        return F.when(F.size(told) == 0, F.lit(None)).when(born & (F.size(told) == 1), F.get(told, F.lit(0))).otherwise(listed).alias(first)

    def read(self, spark, source, *, keep_source_reference=False, **options):
        found = self.records(spark, source).select("record", F.to_json(F.try_variant_get(F.try_parse_json("value"), "$.question", "variant")).alias("question"), F.posexplode(F.from_json(F.get_json_object("value", "$.search_entity_list"), self.SEARCH)).alias("s", "search"))
        relations = found.select("record", "question", "s", F.col("search.depth").alias("depth"), F.posexplode("search.each_relation_right_entityList").alias("r", "e"))
        name = lambda c: F.coalesce(F.col(f"{c}.name"), F.col(f"{c}.entity_name"), F.col(f"{c}.label"))
        given = lambda c, f: F.when(strip(F.col(f"{c}.{f}")) != "", F.col(f"{c}.{f}"))
        named = lambda c: present(strip(F.coalesce(f"{c}.name", f"{c}.entity_name")))
        key = lambda c: F.coalesce(*[given(c, f) for f in ("id", "entity_id", "qid")], F.concat(F.lit("name:"), named(c)))
        current = relations.select("record", "s", "r", F.lit(-1).alias("i"), "question", "depth", F.col("e.current_relation").alias("rel"), "e.right_entity").filter(key("rel").isNotNull())
        pairs = current.select("record", "s", "r", F.posexplode("right_entity").alias("i", "right"), "depth", key("rel").alias("a"), F.coalesce("rel.relation", F.lit("related")).alias("relation"), F.coalesce("rel.head", F.lit(True)).alias("head")).filter(key("right").isNotNull())
        none = F.lit(None).cast("string")
        present_json = lambda v: F.when(F.schema_of_variant(v) != "VOID", F.to_json(v))
        ends = current.select(*self.PLACE, key("rel").alias("id"), name("rel").alias("text"), F.when(F.col("question") != "null", F.col("question")).alias("question"), none.alias("told"))
        ends = ends.unionByName(pairs.select(*self.PLACE, key("right").alias("id"), name("right").alias("text"), none.alias("question"), present_json(F.col("right.related_paragraphs")).alias("told")))
        ends = numbered(ends, list(self.PLACE))
        nodes = ends.groupBy("id").agg(M.first_known("text", "ord").alias("text"), F.min_by("question", "ord").alias("question"), self.paragraphs("told", "ord", "told"), F.min("ord").alias("ord"))
        member = lambda k, c: F.coalesce(F.concat(F.lit(f'{{"{k}":'), F.col(c), F.lit("}")), F.lit("{}"))
        nodes = nodes.select("id", "text", "ord", merged_json(member("question", "question"), member("related_paragraphs", "told")).alias("metadata"))
        directed = numbered(pairs.select(*self.PLACE, F.when(F.col("head"), F.col("a")).otherwise(key("right")).alias("source"), F.when(F.col("head"), key("right")).otherwise(F.col("a")).alias("target"), "relation", "depth", F.col("record").alias("record_index"), F.lit(1.0).alias("weight")), list(self.PLACE), "edge_idx")
        merged = directed.groupBy("source", "relation", "target").agg(F.max("weight").alias("weight"), F.min("edge_idx").alias("edge_idx"), M.append_unique("depth", "edge_idx").alias("depths"), M.append_unique("record_index", "edge_idx").alias("record_indices"))
        edges = merged.select("source", "target", "relation", "weight", "edge_idx", F.to_json(F.struct("record_indices", F.when(F.size("depths") > 0, F.col("depths")).alias("depths"))).alias("metadata"))
        return self.stamped(graph(nodes, edges), source, keep_source_reference)


SOURCES: dict[str, GraphSource] = {s.name: s for s in (NativeSource(), ComponentSource(), AttributeBundleSource(), TopologySource(), OpenExtractionSource(), SubgraphUnionSource(), TripleTextSource(), TripleListSource(), ExploredPathsSource())}


def read_graph(spark: SparkSession, format: str, source, *, into: PropertyGraph | None = None, mode: str = "replace", **options) -> PropertyGraph:
    """A graph in one of ``SOURCES``; with ``into`` and mode ``append`` its rows are added to that graph."""
    key = canonical_format(format)
    if key not in SOURCES:
        raise UnsupportedSourceError(f"unknown format {format!r}")
    got = SOURCES[key].read(spark, source, **options)
    if into is None or mode == "replace":
        return got
    return into.upsert_nodes(got.nodes).append_edges(got.edges)

