"""Driver queries over the sources and sinks that read and write folders."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package
from ..sources.files import ingest_tree, unreadable
from ..sources.tree import open_store
from .registry import query
from .tables import table

#: Where a document's text lies in the tree, by doc_id modulo their number; the last one is reached through a link.
PLACES = ["docs/_x/d{}.md", "a/.d{}", "src/pkg/d{}.py", "a/b/c/d/d{}.GO", "__init__/_d{}", "links/d{}.txt"]
#: Folders that the walk never enters; each holds a copy of every 7th document.
PRUNED = ["node_modules/m", "src/.hidden", "vendor", "a/b/build/x"]


def _write_tree(root: str):
    """Stand-in input: the tree that the job is to find, one file per document; a plain file where links can't be made."""

    def put(store, path: str, data: bytes) -> None:
        store.create_dir(os.path.dirname(path))
        with store.open_output_stream(path) as h:
            h.write(data)

    def run(batches):
        store, inner = open_store(root)
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = text.encode()
                path = f"{inner}/{PLACES[i % len(PLACES)].format(i)}"
                if i % len(PLACES) == len(PLACES) - 1 and isinstance(store, pa.fs.LocalFileSystem):
                    put(store, f"{inner}/.store/{i}", data)
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    if not os.path.islink(path):  # a task that is tried again finds it
                        os.symlink(f"../.store/{i}", path)
                else:
                    put(store, path, data)
                if i % 7 == 0:
                    for p in PRUNED:
                        put(store, f"{inner}/{p}/d{i}.py", b"pruned")
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    return run


def document_tree(spark, sf_dir: str) -> str:
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/codecensus-tree-{uuid.uuid4().hex}/project"
    ship_package(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter("doc_id is not null and text is not null")
    docs.mapInArrow(_write_tree(root), "n long").agg(F.sum("n")).collect()
    return root


_PLACE = "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN '{p.split('{}')[0]}' || doc_id || '{p.split('{}')[1]}'" for k, p in enumerate(PLACES)) + " END"
_TREE = f"""WITH t AS (SELECT doc_id, {_PLACE} AS rel_path, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"""


@query("ingest_tree", f"""{_TREE} SELECT rel_path, '/project/' || rel_path AS abs_path, regexp_extract(rel_path, '[^/]*$') AS base,
    lower(regexp_extract(regexp_extract(rel_path, '[^/]*$'), '(\\.[^.]*)$', 1)) AS ext, strlen(text)::BIGINT AS n_bytes, md5(text) AS content FROM t""")
def ingest(spark, sf_dir):
    """Documents written as a tree with dot files, underscored and pruned folders and links, listed and read back whole."""
    files = ingest_tree(spark, document_tree(spark, sf_dir), "documents", "s1")
    return files.select("rel_path", "abs_path", "base", "ext", "n_bytes", F.md5("content").alias("content"))


@query("ingest_by_extension", f"{_TREE} SELECT rel_path, md5(text) AS content FROM t WHERE doc_id % 6 IN (2, 3)")
def ingest_by_extension(spark, sf_dir):
    """The same tree, of which only the files with two extensions are opened: the filter is the reader's."""
    files = ingest_tree(spark, document_tree(spark, sf_dir), "documents", "s1").filter(F.col("ext").isin(".py", ".go"))
    return files.select("rel_path", F.md5("content").alias("content"))


@query("ingest_counts", f"{_TREE} SELECT 'documents' AS repo_id, 's1' AS snapshot_id, count(*) AS n_files, 0::BIGINT AS n_unreadable FROM t")
def ingest_counts(spark, sf_dir):
    return unreadable(ingest_tree(spark, document_tree(spark, sf_dir), "documents", "s1"))
