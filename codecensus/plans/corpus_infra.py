"""Corpus I: infrastructure config files derived from ``orders``.

repo = 'r' || (o_custkey); format = (o_orderkey div 17) % 4 (compose,
env, terraform, k8s); service word = vocabulary[o_orderkey % 17]; one file
per (repo, format, o_orderkey div 5000), one entry per order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import with_path_columns
from .tables import table

CHUNK = 5000
# Words written into the files, and the service the vocabulary must report for each.
WORDS = [("postgres", "postgres"), ("mysql", "mysql"), ("mariadb", "mariadb"), ("redis", "redis"), ("mongo", "mongodb"),
         ("rabbitmq", "rabbitmq"), ("kafka", "kafka"), ("zookeeper", "zookeeper"), ("elasticsearch", "elasticsearch"),
         ("opensearch", "opensearch"), ("clickhouse", "clickhouse"), ("nginx", "nginx"), ("minio", "minio"),
         ("memcached", "memcached"), ("mssql", "sqlserver"), ("k8s", "kubernetes"), ("terraform", "terraform")]
FORMATS = ["compose", "env", "terraform", "k8s"]


def _c(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def infra_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .materialize import corpus
    return corpus(spark, sf_dir, "infra", lambda: _infra_corpus(spark, sf_dir))


def _infra_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    word = F.element_at(F.array(*[F.lit(w) for w, _ in WORDS]), (F.col("o_orderkey") % 17 + 1).cast("int"))
    ok = F.col("o_orderkey").cast("string")
    rows = o.select(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("repo_id"),
                    F.expr("(o_orderkey div 17) % 4").cast("int").alias("fmt"), F.expr(f"o_orderkey div {CHUNK}").alias("chunk"),
                    "o_orderkey", ok.alias("o"), word.alias("w"))
    g = rows.groupBy("repo_id", "fmt", "chunk").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o", "w"))).alias("r"))

    def body(fn):
        return F.array_join(F.transform("r", fn), "\n")
    compose = _c("version: '3.8'\nservices:\n",
                 body(lambda x: _c("  svc", x.o, ":\n    image: ",
                                   F.when(x.o_orderkey % 5 == 0, _c("\"", x.w, ":latest\"")).otherwise(_c(x.w, ":16")),
                                   "\n    restart: always")),
                 "\nvolumes:\n  data: {}\n")
    env = body(lambda x: F.when(x.o_orderkey % 2 == 1, _c("export SVC", x.o, "_URL=", x.w, "://host:1234"))
               .otherwise(_c("# entry ", x.o, "\nSVC", x.o, "_URL=\"", x.w, "://host\"")))
    tf = _c("provider \"aws\" {\n  region = \"eu-west-1\"\n}\n",
            body(lambda x: _c("resource \"null_resource\" \"", x.w, "_", x.o, "\" {}")), "\n")
    k8s = _c("apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: app\nspec:\n  template:\n    spec:\n      containers:\n",
             body(lambda x: _c("        - name: c", x.o, "\n          image: ", x.w, ":1")), "\n")
    content = F.when(F.col("fmt") == 0, compose).when(F.col("fmt") == 1, env).when(F.col("fmt") == 2, tf).otherwise(k8s)
    fname = F.element_at(F.array(F.lit("docker-compose.yml"), F.lit(".env"), F.lit("main.tf"), F.lit("k8s/deploy.yaml")), F.col("fmt") + 1)
    files = g.select("repo_id", F.lit("s1").alias("snapshot_id"), F.col("repo_id").alias("project_name"),
                     _c("c", F.col("chunk").cast("string"), "/", fname).alias("rel_path"), content.alias("content"))
    return with_path_columns(files)


def oracle_cte() -> str:
    words = ",".join(f"({i}, '{s}')" for i, (_, s) in enumerate(WORDS))
    return f"""
iw(k, service) AS (VALUES {words}),
io AS (SELECT 'r' || CAST(o_custkey AS VARCHAR) AS repo_id, CAST((o_orderkey // 17) % 4 AS INTEGER) AS fmt,
              iw.service FROM orders JOIN iw ON o_orderkey % 17 = iw.k)"""
