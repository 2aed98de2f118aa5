"""Running a graph of table-making nodes.

A spec is ``{"nodes": [{"id", "type", "table_name", "config"}], "edges": [{"source",
"target"}]}``. Edges set the order; SQL refers to other nodes by table name.

Each node's rows are written once under a fingerprint of what they depend on: the node's
own inputs, the files behind a source, the fingerprints of its parents and the tables its
SQL resolves to, with their files. A later run finds them there, in this session or
another; a change anywhere upstream gives another fingerprint, so nothing has to be
invalidated. Rows made anew under the same fingerprint are a further version, and the
newest finished one counts. Databases are read on every run unless the node names a
``version`` of its data, and queries over time or chance are always run again. With
``materialize=False`` nodes stay views, and an export runs as one plan from the sources.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import storage, tables
from millrace.names import dedupe, quote, safe_path_part
from millrace.operators.export import export_csv
from millrace.operators.transform import query
from millrace.session import shared_root, tune
from millrace.sources import excel, preprocess
from millrace.sources.programs import Program
from millrace.sources.csv import read_csv_lines
from millrace.sources.jdbc import read_db_source

NODE_TYPES = ("csv_source", "excel_source", "db_source", "transform", "export")

RESULT_SCHEMA = (
    "node_id string, table_name string, type string, status string, reused boolean, "
    "row_count bigint, column_count int, columns array<string>, error string, "
    "execution_time_ms double, started_at string, finished_at string"
)


@dataclass
class NodeResult:
    node_id: str
    table_name: str
    type: str
    status: str = "success"
    reused: bool = False
    row_count: int | None = None
    column_count: int | None = None
    columns: list[str] | None = None
    error: str | None = None
    execution_time_ms: float = 0.0
    started_at: str = field(default_factory=lambda: _now())
    finished_at: str | None = None


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def parents_of(spec: Mapping) -> dict[str, list[str]]:
    known = {n["id"] for n in spec["nodes"]}
    parents: dict[str, list[str]] = {n["id"]: [] for n in spec["nodes"]}
    for edge in spec.get("edges", ()):
        missing = [edge[end] for end in ("source", "target") if edge[end] not in known]
        if missing:
            raise ValueError(f"edge {edge} names unknown nodes {missing}")
        parents[edge["target"]].append(edge["source"])
    return parents


def run_order(spec: Mapping) -> list[str]:
    """Node ids, parents first."""
    try:
        return list(TopologicalSorter(parents_of(spec)).static_order())
    except CycleError as e:
        raise ValueError(f"the nodes form a cycle: {' -> '.join(e.args[1])}") from None


def ancestors(spec: Mapping, node_id: str) -> set[str]:
    parents = parents_of(spec)
    if node_id not in parents:
        raise ValueError(f"unknown node {node_id!r}")
    found, todo = set(), [node_id]
    while todo:
        fresh = [p for p in parents[todo.pop()] if p not in found]
        found.update(fresh)
        todo.extend(fresh)
    return found


# --- what a node depends on ------------------------------------------------------------


def node_inputs(node: Mapping) -> dict:
    """The parts of a node that decide its rows; labels and positions are not among them."""
    config = node.get("config") or {}
    kind = node["type"]
    if kind in ("csv_source", "excel_source"):
        names = ("file_path", "selected_sheet", "schema")
        picked = {k: config[k] for k in names if config.get(k)}
        program = Program.of(config.get("preprocessing"))
        return picked | {"preprocessing": program and program.identity}
    if kind == "transform":
        return {"sql": config.get("sql")}
    return dict(config)


def changed_nodes(old: Mapping, new: Mapping) -> list[str]:
    """Nodes of ``old`` that are gone from ``new`` or differ in inputs or table name."""
    after = {n["id"]: (n["table_name"], node_inputs(n)) for n in new["nodes"]}
    return [n["id"] for n in old["nodes"] if after.get(n["id"]) != (n["table_name"], node_inputs(n))]


def drop_changed(spark: SparkSession, old: Mapping, new: Mapping) -> list[str]:
    """Drop the tables of changed nodes. Rows are found or made anew by fingerprint, so
    this only keeps an outdated table from being read by name before the next run."""
    changed = set(changed_nodes(old, new))
    for n in old["nodes"]:
        if n["id"] in changed:
            tables.drop(spark, n["table_name"])
    return sorted(changed)


def files_stamp(spark: SparkSession, path: str | list[str]) -> str:
    """Hash of the names, lengths and times of the files under ``path``; reads no content."""
    listed = spark.read.format("binaryFile").load(path)
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return str(list(listed.agg(F.count(F.lit(1)), F.sum(mark)).first()))


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


# --- building one node -----------------------------------------------------------------


def _source_path(spark: SparkSession, config: Mapping) -> str:
    """Where a file source's rows come from: its files, or its program's kept output."""
    path = str(config.get("file_path", "")).strip()
    program = Program.of(config.get("preprocessing"))
    if path and program:
        kept = preprocess.kept_at(spark, path, program)
        return kept if storage.complete(spark, kept) else path
    return path


def _read_excel(spark: SparkSession, config: Mapping) -> DataFrame:
    sheet = str(config.get("selected_sheet", "")).strip()
    path = str(config.get("file_path", "")).strip()
    if not sheet:
        raise ValueError("an Excel node needs the name of a sheet in selected_sheet")
    if not path:
        raise ValueError("an Excel node needs its workbooks in file_path")
    files = excel.workbook_files(spark, path)
    program = Program.of(config.get("preprocessing"))
    if program is None:
        return excel.read_excel(files, sheet)
    return read_csv_lines(preprocess.reviewed_lines(spark, f"{path}#{sheet}", program))


def prepare_excel(spark: SparkSession, config: Mapping) -> str:
    """Run an Excel source's program on the CSV text of its sheet, streamed to its standard input."""
    path, sheet = config["file_path"], config["selected_sheet"]
    program = Program.of(config["preprocessing"])
    text = excel.sheet_csv_lines(excel.workbook_files(spark, path), sheet)
    target = preprocess.kept_at(spark, f"{path}#{sheet}", program)
    preprocess.run_on_lines(text, program).write.mode("overwrite").parquet(target)
    return target


def build_node(spark: SparkSession, node: Mapping, credentials: Mapping | None = None) -> DataFrame:
    """The node's rows, not yet computed."""
    config, kind = node.get("config") or {}, node["type"]
    if kind == "csv_source":
        return preprocess.read_csv_source(spark, config)
    if kind == "excel_source":
        return _read_excel(spark, config)
    if kind == "db_source":
        return read_db_source(spark, config, (credentials or {}).get(node["id"]))
    if kind == "transform":
        return query(spark, config["sql"])
    raise ValueError(f"unknown node type {kind!r}")


def _writable(df: DataFrame) -> DataFrame:
    """Distinct column names, and a type for columns that are nothing but NULL."""
    df = df.toDF(*dedupe(df.columns))
    untyped = {
        f.name: F.col(quote(f.name)).cast("int")
        for f in df.schema
        if isinstance(f.dataType, T.NullType)
    }
    return df.withColumns(untyped) if untyped else df


_VOLATILE = re.compile(
    r"\b(rand|randn|random|uuid|shuffle|now|current_(date|time|timestamp)|curdate|localtimestamp|unix_timestamp"
    r"|monotonically_increasing_id|spark_partition_id|input_file_(name|block_start|block_length)"
    r"|current_(user|catalog|database|schema)|session_user|tablesample)\b",
    re.I,
)


def query_stamp(df: DataFrame) -> str:
    """What a query reads: its plan, and the names, lengths and times of the files it comes to."""
    folders = sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    return _digest(df.semanticHash(), folders, files_stamp(df.sparkSession, folders) if folders else "")


def _stamp(spark: SparkSession, node: Mapping) -> str | None:
    """``None`` if the node's rows may differ from run to run, so that they are never reused."""
    config = node.get("config") or {}
    if node["type"] == "csv_source":
        return files_stamp(spark, _source_path(spark, config))
    if node["type"] == "excel_source":
        return files_stamp(spark, config["file_path"])
    if node["type"] == "transform":
        if _VOLATILE.search(config["sql"]):
            return None
        return query_stamp(query(spark, config["sql"]))
    return _digest(config["version"]) if config.get("version") is not None else None


def _write(df: DataFrame, path: str) -> int:
    """Write and count in one pass."""
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").parquet(path)
    return seen.get["rows"]


# --- running ---------------------------------------------------------------------------


def run_dag(
    spark: SparkSession,
    spec: Mapping,
    force: bool = False,
    only: str | None = None,
    materialize: bool = True,
    credentials: Mapping | None = None,
    on_node_start: Callable[[str, str], None] | None = None,
    on_node_finish: Callable[[NodeResult], None] | None = None,
) -> DataFrame:
    """Run the nodes, parents first; returns one row per node.

    A failed node is recorded and the run goes on; nodes below it are ``skipped``, since
    what they would read is missing or out of date. ``force`` makes all rows anew. ``only``
    runs one node again, after whichever nodes above it are not there already.
    """
    tune(spark)
    order = run_order(spec)
    wanted = set(order) if only is None else ancestors(spec, only) | {only}
    nodes = {n["id"]: n for n in spec["nodes"]}
    parents = parents_of(spec)
    results: dict[str, NodeResult] = {}
    prints: dict[str, str] = {}
    for node_id in (n for n in order if n in wanted):
        node = nodes[node_id]
        result = NodeResult(node_id, node["table_name"], node["type"])
        if on_node_start:
            on_node_start(node_id, result.started_at)
        start = time.perf_counter()
        failed = [p for p in parents[node_id] if results[p].status != "success"]
        if failed:
            result.status, result.error = "skipped", f"not run: {', '.join(failed)} failed"
        else:
            try:
                upstream = [prints[p] for p in parents[node_id]]
                fresh = force or node_id == only
                prints[node_id] = _run_node(
                    spark,
                    node,
                    [nodes[p] for p in parents[node_id]],
                    upstream,
                    result,
                    fresh,
                    materialize,
                    credentials,
                )
            except Exception as e:  # noqa: BLE001 - any fault of a node is its result
                result.status, result.error = "error", str(e)
        result.execution_time_ms = (time.perf_counter() - start) * 1000
        result.finished_at = _now()
        results[node_id] = result
        if on_node_finish:
            on_node_finish(result)
    rows = [tuple(asdict(r).values()) for r in results.values()]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def run_node(
    spark: SparkSession, node: Mapping, credentials: Mapping | None = None
) -> DataFrame:
    """Run one node by itself, whatever there is from earlier runs."""
    return run_dag(spark, {"nodes": [node], "edges": []}, force=True, credentials=credentials)


def _run_node(
    spark, node, parents, upstream, result, fresh, materialize, credentials
) -> str:
    name = node["table_name"]
    if node["type"] == "export":
        _export(spark, node, parents)
        result.row_count, result.column_count, result.columns = 0, 0, []
        return _digest("export", upstream)
    if node["type"] not in NODE_TYPES:
        raise ValueError(f"unknown node type {node['type']!r}")
    if not materialize:
        df = tables.register(_writable(build_node(spark, node, credentials)), name)
        result.column_count, result.columns = len(df.columns), df.columns
        return _digest(node["id"], upstream)
    try:
        stamp = _stamp(spark, node)
    except Exception:  # noqa: BLE001 - building the node reports what is wrong
        stamp = None
    print_ = _digest(node["type"], node_inputs(node), upstream, stamp)
    versions = f"{shared_root(spark)}/nodes/{print_}"
    version = None if fresh or stamp is None else newest_version(spark, versions)
    if version:
        df = spark.read.parquet(f"{versions}/{version}")
        result.reused, result.row_count = True, df.count()
    else:
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        built = _writable(build_node(spark, node, credentials))
        result.row_count = _write(built, f"{versions}/{version}")
        df = spark.read.parquet(f"{versions}/{version}")
    # Registered as rows, not as files: whoever appends to the table gets a copy of it.
    tables.register(df, name)
    result.column_count, result.columns = len(df.columns), df.columns
    return _digest(print_, version)


def newest_version(spark: SparkSession, folder: str) -> str | None:
    """The last written of the finished results in ``folder``."""
    done = [v for v in storage.names(spark, folder) if storage.complete(spark, f"{folder}/{v}")]
    return max(done, default=None)


def _export(spark: SparkSession, node: Mapping, parents: list[Mapping]) -> None:
    """Write the tables above the node as CSV: to ``path``, or a folder below it each when
    there are several."""
    config = node.get("config") or {}
    kind = config.get("format", "csv")
    if kind != "csv":
        raise ValueError(f"unknown export format {kind!r}")
    if not config.get("path"):
        return
    for parent in parents:
        path = config["path"]
        if len(parents) > 1:
            path = f"{path}/{safe_path_part(parent['table_name'])}"
        df = spark.table(quote(parent["table_name"]))
        export_csv(df, path, single_file=bool(config.get("single_file")))
