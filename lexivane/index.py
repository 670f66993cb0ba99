"""Indexes and datasets: the operators behind one object each, saved as Parquet tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.config import Configuration
from lexivane.functions.quantise import quantise
from lexivane.operators import blocks as blocking
from lexivane.operators import knn as graphs
from lexivane.operators import prune, search, summaries, vectors
from lexivane.session import cut
from lexivane.sources import records as sources

#: Nominal bytes of a row beside its texts.
_WIDTHS = {"forward": 8, "postings": 8, "blocks": 8, "codes": 9, "knn": 8}
RECORD = "rec_no long, id string, content string, vector map<string,float>"


def space_usage(**tables: DataFrame | None) -> DataFrame:
    """part, n_rows, n_bytes of each table: rows times nominal width, and the bytes of texts for token_map and doc_map."""
    rows = []
    for name, df in tables.items():
        if df is None:
            continue
        if name == "token_map":
            size = F.sum(F.octet_length("token") + 4)
        elif name == "doc_map":
            texts = [F.octet_length("doc_id")] + ([F.coalesce(F.octet_length("content"), F.lit(0))] if "content" in df.columns else [])
            size = F.sum(reduce(lambda a, b: a + b, texts))
        else:
            size = F.count(F.lit(1)) * _WIDTHS[name]
        rows.append(df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes")).select(F.lit(name).alias("part"), "n_rows", "n_bytes"))
    return reduce(DataFrame.unionByName, rows)


def query_frame(spark: SparkSession, query_ids: Sequence[str], components: Sequence[Sequence], values: Sequence[Sequence[float]]) -> DataFrame:
    """id and vector of queries given as parallel lists; of a token given twice in a query the values are added up."""
    rows = []
    for q, cs, vs in zip(query_ids, components, values, strict=True):
        vector: dict[str, float] = {}
        for c, v in zip(cs, vs, strict=True):
            vector[str(c)] = vector.get(str(c), 0.0) + float(v)
        rows.append((str(q), vector))
    return spark.createDataFrame(rows, "id string, vector map<string,double>")


class RawIndex:
    """An index over numbered components. forward: rec_no, component, w."""

    def __init__(self, forward: DataFrame, postings: DataFrame, blocks: DataFrame, codes: DataFrame, config: Configuration, knn: DataFrame | None = None, dim: int | None = None) -> None:
        self.forward, self.postings, self.blocks, self.codes, self.config, self.knn, self._dim = forward, postings, blocks, codes, config, knn, dim
        self.spark = forward.sparkSession

    # building

    @classmethod
    def build(cls, forward: DataFrame, config: Configuration | None = None, dim: int | None = None, n_records: int | None = None, **kept) -> RawIndex:
        """Prunes, blocks, summarises, and links neighbours if the configuration says so.

        The structure is built from the weights as given; fixedu8, fixedu16 and packed8 then only change the weights that
        scores are made of, while f32, f16 and bf16 hold for both. Negative weights are refused.
        """
        config = config or Configuration()
        checked = F.when(F.col("w") < 0, F.raise_error(F.lit("weights must not be negative"))).otherwise(F.col("w"))
        forward = forward.select("rec_no", F.col("component").cast("int").alias("component"), checked.cast("double").alias("w"))
        late = config.value_type in ("fixedu8", "fixedu16", "packed8")
        forward = cut(forward if late else quantise(forward, "w", config.value_type), "forward")
        if dim is None:
            largest = forward.agg(F.max("component")).first()[0]
            dim = 0 if largest is None else largest + 1
        p, b, s = config.pruning, config.blocking, config.summarization
        if p.kind == "fixed":
            postings = prune.prune_fixed(forward, p.n_postings)
        elif p.kind == "global":
            postings = prune.prune_global(forward, p.n_postings, p.max_fraction, dim)
        else:
            postings = prune.prune_coi(forward, p.alpha, p.n_postings)
        postings = cut(postings, "postings")
        if b.kind == "fixed":
            blocks = cut(blocking.block_fixed(postings, b.block_size), "blocks")
            maxima = summaries.block_max(blocks, forward)
            short = summaries.summary_fixed(maxima, s.n_components) if s.kind == "fixed" else summaries.summary_energy(maxima, s.energy)
            codes = cut(summaries.quantise_summaries(short), "codes")
        else:
            kept_by = (None, s.n_components) if s.kind == "fixed" else (s.energy, 0)
            both = cut(blocking.summarised_kmeans(postings, forward, b.centroid_fraction, b.min_cluster_size, b.algorithm, b.doc_cut, b.pruning_factor, *kept_by), "clusters")
            blocks = both.select("component", "block", F.explode("rec_nos").alias("rec_no"))
            codes = both.select("component", "block", F.explode(F.arrays_zip("c", "code")).alias("e"), "low", "step").select("component", "block", "e.c", "e.code", "low", "step")
        index = cls(forward, postings, blocks, codes, config, None, dim, **kept)
        if late:
            index = index.convert(config.value_type)
        if config.knn.knn_path:
            index.load_knn(config.knn.knn_path, config.knn.nknn or None)
        elif config.knn.nknn:
            index.build_knn(config.knn.nknn)
        return index

    def _kept(self) -> dict:
        return {}

    def convert(self, value_type: str) -> RawIndex:
        """The same postings and summaries over weights held as value_type."""
        forward = cut(quantise(self.forward, "w", value_type), "forward")
        return type(self)(forward, self.postings, self.blocks, self.codes, self.config.with_value_type(value_type), self.knn, self._dim, **self._kept())

    # neighbours

    def build_knn(self, nknn: int) -> None:
        self.knn = cut(graphs.knn_graph(self.forward, self.blocks, self.codes, nknn), "knn")

    def add_knn(self, graph: DataFrame) -> None:
        self.knn = graph

    def save_knn(self, path: str) -> str:
        if self.knn is None:
            raise ValueError("the index has no neighbours to save")
        path = f"{path}.knn"
        self.knn.write.mode("overwrite").parquet(path)
        return path

    def load_knn(self, path: str, nknn: int | None = None) -> None:
        graph = self.spark.read.parquet(path)
        self.knn = graph if nknn is None else graphs.limit_graph(graph, nknn)

    @property
    def knn_len(self) -> int:
        return graphs.knn_len(self.knn)

    # facts

    @property
    def dim(self) -> int:
        return self._dim

    @property
    def len(self) -> int:
        """Records with entries."""
        return self.forward.select("rec_no").distinct().count()

    @property
    def nnz(self) -> int:
        return self.forward.count()

    @property
    def is_empty(self) -> bool:
        return self.forward.isEmpty()

    def get_doc_ids_in_postings(self, component: int) -> list[int]:
        return [r[0] for r in self.postings.where(F.col("component") == component).orderBy("pos").select("rec_no").collect()]

    def get(self, rec_no: int) -> tuple[list[int], list[float]]:
        row = vectors.get_vector(self.forward, rec_no).first()
        return (row.components, row.vals) if row else ([], [])

    def space_usage(self) -> DataFrame:
        return space_usage(forward=self.forward, postings=self.postings, blocks=self.blocks, codes=self.codes, knn=self.knn)

    def print_space_usage_byte(self) -> int:
        rows = self.space_usage().collect()
        for r in rows:
            print(f"{r.part}: {r.n_bytes} bytes in {r.n_rows} rows")
        return sum(r.n_bytes for r in rows)

    # search

    def search_frame(self, queries: DataFrame, k: int, query_cut: int, heap_factor: float, n_knn: int = 0, sorted: bool = True) -> DataFrame:
        """query_id, rec_no, score, rank for queries as query_id, component, qw; one job for all of them."""
        hits = search.skipping_topk(queries, self.blocks, self.codes, self.forward, k, query_cut, heap_factor, sorted).drop("n_skipped")
        if n_knn and self.knn is not None:
            hits = search.refine(hits, self.knn, queries, self.forward, k, n_knn)
        return hits

    @cached_property
    def lists(self) -> DataFrame:
        """The posting lists with their vectors and summaries, as pruned_search_frame reads them; written once."""
        return cut(search.lists_of(self.blocks, self.forward, self.codes), "lists")

    def pruned_search_frame(self, queries: DataFrame, k: int, query_cut: int, heap_factor: float, n_knn: int = 0, sorted: bool = True) -> DataFrame:
        """As search_frame, but in two rounds that save the work they skip (see search.pruned_topk)."""
        hits = search.pruned_topk(queries, self.lists, k, query_cut, heap_factor, sorted).drop("n_scored", "n_inside")
        if n_knn and self.knn is not None:
            hits = search.refine(hits, self.knn, queries, self.forward, k, n_knn)
        return hits

    def batch_search(self, query_ids: Sequence[str], components: Sequence[Sequence[int]], values: Sequence[Sequence[float]], k: int, query_cut: int, heap_factor: float, n_knn: int = 0, sorted: bool = True) -> list[list[tuple]]:
        frame = query_frame(self.spark, query_ids, components, values)
        long = frame.select(F.col("id").alias("query_id"), F.explode("vector").alias("c", "qw")).select("query_id", F.col("c").cast("int").alias("component"), F.col("qw").cast("double").alias("qw"))
        return self._collected(query_ids, self.search_frame(long, k, query_cut, heap_factor, n_knn, sorted), "rec_no")

    def batch_search_file(self, path: str, k: int, query_cut: int, heap_factor: float, n_knn: int = 0, sorted: bool = True) -> DataFrame:
        """The queries of a binary vector file, numbered from 0 on."""
        long = sources.read_inner(self.spark, path).select(F.col("ordinal").cast("string").alias("query_id"), F.explode(F.arrays_zip("components", "vals")).alias("e"))
        queries = long.select("query_id", F.col("e.components").cast("int").alias("component"), F.col("e.vals").cast("double").alias("qw"))
        return self.search_frame(queries, k, query_cut, heap_factor, n_knn, sorted)

    def search(self, query_id: str, components: Sequence, values: Sequence[float], k: int, query_cut: int, heap_factor: float, n_knn: int = 0, sorted: bool = True) -> list[tuple]:
        """(query_id, score, record) of the k best, best first."""
        return self.batch_search([query_id], [components], [values], k, query_cut, heap_factor, n_knn, sorted)[0]

    @staticmethod
    def _collected(query_ids: Sequence[str], hits: DataFrame, what: str) -> list[list[tuple]]:
        out: dict[str, list[tuple]] = {str(q): [] for q in query_ids}
        for r in hits.orderBy("query_id", "rank").collect():
            out[r.query_id].append((r.query_id, r.score, r[what]))
        return [out[str(q)] for q in query_ids]

    # storage

    _TABLES = ["forward", "postings", "blocks", "codes"]

    def save(self, path: str) -> str:
        """Writes every table below <path>.index and returns that path. What belongs to a component lies together, in the order of
        components, so that files and row groups tell by their bounds whether a list is in them."""
        path = f"{path}.index"
        for name in self._TABLES:
            df = getattr(self, name)
            if name in ("postings", "blocks", "codes"):
                df = df.repartitionByRange("component").sortWithinPartitions("component")
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        if self.knn is not None:
            self.knn.write.mode("overwrite").parquet(f"{path}/knn")
        facts = json.dumps({"config": self.config.to_dict(), "dim": self._dim, "knn": self.knn is not None})
        self.spark.createDataFrame([(facts,)], "facts string").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RawIndex:
        facts = json.loads(spark.read.parquet(f"{path}/config").first()[0])
        frames = {name: spark.read.parquet(f"{path}/{name}") for name in cls._TABLES}
        knn = spark.read.parquet(f"{path}/knn") if facts["knn"] else None
        return cls(**frames, config=Configuration.from_dict(facts["config"]), knn=knn, dim=facts["dim"])


class SparseIndex(RawIndex):
    """An index over records with text ids, tokens and contents. doc_map: rec_no, doc_id, content; token_map: token, component."""

    _TABLES = [*RawIndex._TABLES, "token_map", "doc_map"]

    def __init__(self, *args, token_map: DataFrame, doc_map: DataFrame, **kwargs) -> None:
        super().__init__(*args, **kwargs)
        self.token_map, self.doc_map = token_map, doc_map

    def _kept(self) -> dict:
        return {"token_map": self.token_map, "doc_map": self.doc_map}

    @classmethod
    def from_records(cls, records: DataFrame, config: Configuration | None = None, token_map: DataFrame | None = None, load_content: bool = True) -> SparseIndex:
        """records: rec_no, id, content, vector. Tokens that a given token_map lacks raise an error."""
        long = vectors.entries(records)
        strict = token_map is not None
        tokens = cut(token_map if strict else vectors.token_map(long), "tokens")
        docs = cut(vectors.doc_map(records, load_content), "docs")
        return cls.build(vectors.encode(long, tokens, strict), config, tokens.count(), token_map=tokens, doc_map=docs)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, config: Configuration | None = None, token_map: DataFrame | None = None, load_content: bool = True) -> SparseIndex:
        return cls.from_records(sources.number(sources.read_records(spark, path)), config, token_map, load_content)

    @classmethod
    def from_dataset(cls, dataset: SparseDataset, config: Configuration | None = None) -> SparseIndex:
        return cls.from_records(dataset.records, config)

    @property
    def len(self) -> int:
        return self.doc_map.count()

    def search_tokens(self, queries: DataFrame, k: int, query_cut: int, heap_factor: float, n_knn: int = 0, sorted: bool = True) -> DataFrame:
        """query_id, doc_id, score, rank for queries as id, vector; unknown tokens are left out."""
        return search.remap(self.search_frame(search.resolve(queries, self.token_map), k, query_cut, heap_factor, n_knn, sorted), self.doc_map)

    def batch_search(self, query_ids, components, values, k, query_cut, heap_factor, n_knn=0, sorted=True) -> list[list[tuple]]:
        frame = query_frame(self.spark, query_ids, components, values)
        return self._collected(query_ids, self.search_tokens(frame, k, query_cut, heap_factor, n_knn, sorted), "doc_id")

    def get_doc_text(self, doc_id: str) -> str | None:
        """The content of the first record with doc_id."""
        if "content" not in self.doc_map.columns:
            return None
        row = self.doc_map.where(F.col("doc_id") == doc_id).agg(F.min_by("content", "rec_no")).first()
        return row[0]

    def space_usage(self) -> DataFrame:
        return super().space_usage().unionByName(space_usage(token_map=self.token_map, doc_map=self.doc_map))


class PackedIndex(SparseIndex):
    """SparseIndex with weights in packed 8-bit form: no single vectors, no neighbours of its own making (they can be loaded)."""

    @classmethod
    def from_records(cls, records, config=None, token_map=None, load_content=True):
        return super().from_records(records, (config or Configuration()).with_value_type("packed8"), token_map, load_content)

    def get(self, rec_no: int):
        raise NotImplementedError("a packed index doesn't give single vectors")

    def build_knn(self, nknn: int) -> None:
        raise NotImplementedError("a packed index doesn't build neighbours; load them")


class SparseDataset:
    """Records that can grow, searched exactly. Weights are held as f16."""

    def __init__(self, spark: SparkSession, records: DataFrame | None = None) -> None:
        self.spark = spark
        self.records = records if records is not None else spark.createDataFrame([], RECORD)
        self._pending: list[tuple] = []

    def add_document(self, doc_id: str, components: Sequence[str], values: Sequence[float], content: str | None = None) -> None:
        """Adds a record; tokens given twice are refused. Added rows are kept on the driver until flush or the next read."""
        if len(components) != len(set(components)) or len(components) != len(values):
            raise ValueError("tokens must be distinct, one value each")
        self._pending.append((str(doc_id), content, dict(zip(map(str, components), map(float, values)))))
        if len(self._pending) >= 10_000:
            self.flush()

    def add_records(self, records: DataFrame) -> None:
        """Adds records (id, content, vector) in bulk; they are numbered after those that are there."""
        self.flush()
        start = (self.records.agg(F.max("rec_no")).first()[0] or 0) + 1
        self.records = cut(self.records.unionByName(sources.number(records, start)), "dataset")

    def flush(self) -> None:
        if self._pending:
            rows, self._pending = self._pending, []
            start = (self.records.agg(F.max("rec_no")).first()[0] or 0) + 1
            added = self.spark.createDataFrame([(start + i, *r) for i, r in enumerate(rows)], RECORD)
            self.records = cut(self.records.unionByName(added), "dataset")

    @property
    def len(self) -> int:
        self.flush()
        return self.records.count()

    @property
    def token_map(self) -> DataFrame:
        self.flush()
        return vectors.token_map(vectors.entries(self.records))

    def search_frame(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, score, rank by exact search; queries: id, vector."""
        self.flush()
        rounded = vectors.entries(self.records).withColumn("w", F.col("w"))
        held = quantise(rounded, "w", "f16").groupBy("rec_no").agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("vector"))
        return search.remap(search.exact_topk(held, queries, k), vectors.doc_map(self.records))

    def batch_search(self, query_ids: Sequence[str], components: Sequence[Sequence[str]], values: Sequence[Sequence[float]], k: int) -> list[list[tuple]]:
        return RawIndex._collected(query_ids, self.search_frame(query_frame(self.spark, query_ids, components, values), k), "doc_id")

    def search(self, query_id: str, components: Sequence[str], values: Sequence[float], k: int) -> list[tuple]:
        return self.batch_search([query_id], [components], [values], k)[0]

    def get_doc_text(self, doc_id: str) -> str | None:
        self.flush()
        return self.records.where(F.col("id") == doc_id).agg(F.min_by("content", "rec_no")).first()[0]


#: Components are INT everywhere, so the classes for large vocabularies are the same ones.
SparseIndexLV, RawIndexLV, SparseDatasetLV = SparseIndex, RawIndex, SparseDataset


def string_dtype() -> str:
    """The type of query ids and tokens: strings of any length."""
    return "string"


def as_record_maps(rows: Sequence[Mapping]) -> list[tuple]:
    """(id, content, vector) of records given as mappings with id, vector and optionally content."""
    return [(str(r["id"]), r.get("content"), {str(t): float(w) for t, w in r["vector"].items()}) for r in rows]
