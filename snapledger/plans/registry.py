"""Models by name: each builds a DataFrame from the sources and models it references."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from graphlib import CycleError, TopologicalSorter
from threading import local
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from snapledger.operators.snapshots import latest_load_per_group, newest_loads


class Model(NamedTuple):
    """A named table. `kind` is how it is published; a `stored` one is written when built; `needs` are the models it asks for."""

    name: str
    layer: str
    kind: str
    stored: bool
    needs: tuple[str, ...]
    build: Callable[[Context], DataFrame]


MODELS: dict[str, Model] = {}
#: Models that are built at the same time, at most.
AT_ONCE = 8


def model(layer: str, kind: str, stored: bool | None = None, needs: Sequence[str] = ()):
    """Register a function as a "view" or "table" of a layer that asks for the models it `needs`.

    Tables are stored. A view that many models read can be stored too, so that its typing work
    is done once.
    """

    def register(build):
        keep = kind == "table" if stored is None else stored
        MODELS[build.__name__] = Model(build.__name__, layer, kind, keep, tuple(needs), build)
        return build

    return register


def store(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at `path` and read it back, one folder per load date where it has one.

    Queries on the newest snapshot then read one folder. The rebalance step merges small files
    and cuts a large date into several.
    """
    writer = df.write
    if "load_date" in df.columns:
        writer = df.hint("rebalance", "load_date").write.partitionBy("load_date")
    writer.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def needed(*names: str) -> dict[str, tuple[str, ...]]:
    """The named models and all that they need, directly or not, each with its needs."""
    found: dict[str, tuple[str, ...]] = {}
    open_ = list(names)
    while open_:
        name = open_.pop()
        if name not in found:
            found[name] = MODELS[name].needs
            open_ += found[name]
    return found


def build_order(*names: str) -> TopologicalSorter:
    """The named models, or all, and what they need, as a prepared graph; a cycle fails here and is named."""
    graph = TopologicalSorter(needed(*(names or MODELS)))
    try:
        graph.prepare()
    except CycleError as error:
        raise ValueError("models need each other: " + " -> ".join(reversed(error.args[1]))) from None
    return graph


class Context:
    """Resolves references. A model is built once per context, after the models it asks for.

    `sources` maps a raw table's name to a function that returns it. With a `warehouse` path,
    stored models are written to `<warehouse>/<layer>/<name>` and read back, which also keeps
    each table's plan free of its parents' plans. `loads` may give the partitions (group columns, load date) that a raw
    table has, from a listing; the newest ones are then read without a look at the others.
    """

    def __init__(
        self,
        spark: SparkSession,
        sources: Callable[[str], DataFrame],
        warehouse: str | None = None,
        seeds: Callable[[str], DataFrame] | None = None,
        loads: Callable[[str], DataFrame] | None = None,
    ):
        self.spark = spark
        self.warehouse = warehouse
        self._sources = sources
        self._seeds = seeds
        self._loads = loads
        self._built: dict[str, DataFrame] = {}
        self.edges: dict[str, list[str]] = {}
        self._here = local()  # the model that a thread is building

    def source(self, name: str) -> DataFrame:
        return self._sources(name)

    def newest(self, name: str, group: Sequence[str], load_col: str = "load_date") -> DataFrame:
        """Rows of a source from the newest load of each group."""
        if self._loads is None:
            return latest_load_per_group(self.source(name), group, load_col)
        return newest_loads(self.source(name), self._loads(name), group, load_col)

    def seed(self, name: str) -> DataFrame:
        if self._seeds is None:
            raise KeyError(name)
        return self._seeds(name)

    def ref(self, name: str) -> DataFrame:
        """A model. One that is being built may ask only for models that it says it needs."""
        asking = getattr(self._here, "model", None)
        if asking is not None:
            if name not in MODELS[asking].needs:
                raise ValueError(f"{asking} asks for {name}, which it does not say it needs")
            self.edges.setdefault(asking, []).append(name)
        if name not in self._built:
            self.build(name)
        return self._built[name]

    def build(self, *names: str) -> dict[str, DataFrame]:
        """Build the named models, or all, and what they need: each as soon as its needs are met, several at once.

        Every model runs in a scheduler pool of its own, so that under fair scheduling a large one does not hold up the others.
        """
        graph = build_order(*names)
        started: dict[Future, str] = {}
        with ThreadPoolExecutor(AT_ONCE) as pool:
            while graph.is_active():
                for name in graph.get_ready():
                    target = inheritable_thread_target(self.spark)(self._build_one)
                    started[pool.submit(target, name)] = name
                done, _ = wait(started, return_when=FIRST_COMPLETED)
                for future in done:
                    future.result()
                    graph.done(started.pop(future))
        return {name: self._built[name] for name in names or MODELS}

    def _build_one(self, name: str) -> None:
        if name in self._built:
            return
        entry = MODELS[name]
        outer = getattr(self._here, "model", None)
        self._here.model = name
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            df = entry.build(self)
            if entry.stored and self.warehouse:
                df = store(df, f"{self.warehouse}/{entry.layer}/{name}")
        finally:
            self._here.model = outer
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        self._built[name] = df

    def publish(self, *names: str) -> None:
        """Register models in the catalog, in the database of their layer, for every session that shares it.

        A stored model's rows are registered where they lie, with their folders per load date, and not written again; other
        rows are stored for it. A view is a view over its rows, which are registered under its name with `_rows` behind.
        """
        for name, df in self.build(*names).items():
            entry = MODELS[name]
            where = f" location '{self.warehouse}/{entry.layer}'" if self.warehouse else ""
            self.spark.sql(f"create database if not exists {entry.layer}{where}")
            shown = f"{entry.layer}.{name}"
            table = shown if entry.kind == "table" else f"{shown}_rows"
            if self.warehouse:
                path = f"{self.warehouse}/{entry.layer}/{name}"
                if not entry.stored:
                    df = store(df, path)
                self.spark.sql(f"drop table if exists {table}")
                self.spark.catalog.createTable(table, path=path, source="parquet")
                if "load_date" in df.columns:
                    self.spark.catalog.recoverPartitions(table)
            else:
                df.write.mode("overwrite").saveAsTable(table)
            if entry.kind == "view":
                self.spark.sql(f"create or replace view {shown} as select * from {table}")
