"""Driver queries over corpus I."""

from __future__ import annotations

from ..operators import infra as I
from .corpus_infra import infra_corpus, oracle_cte
from .registry import query

WITH = "WITH " + oracle_cte()


def _q(name, fmt, fn):
    @query(name, f"{WITH} SELECT DISTINCT repo_id, service FROM io WHERE fmt = {fmt}")
    def q(spark, sf_dir):
        return fn(infra_corpus(spark, sf_dir)).select("repo_id", "service").distinct()
    q.__name__ = name
    return q


infra_compose = _q("infra_compose", 0, I.compose_services)
infra_env = _q("infra_env", 1, I.env_services)


@query("infra_k8s", f"""{WITH}
SELECT DISTINCT repo_id, service FROM (SELECT repo_id, service FROM io WHERE fmt = 3
  UNION ALL SELECT repo_id, 'kubernetes' FROM io WHERE fmt = 3) x""")
def infra_k8s(spark, sf_dir):
    return I.k8s_services(infra_corpus(spark, sf_dir)).select("repo_id", "service").distinct()


@query("infra_terraform", f"""{WITH}
SELECT DISTINCT repo_id, service FROM (SELECT repo_id, service FROM io WHERE fmt = 2
  UNION ALL SELECT repo_id, 'terraform' FROM io WHERE fmt = 2) x""")
def infra_terraform(spark, sf_dir):
    return I.terraform_services(infra_corpus(spark, sf_dir)).select("repo_id", "service").distinct()


@query("infra_by_repo", f"""{WITH}
SELECT DISTINCT repo_id, service FROM (
  SELECT repo_id, service FROM io
  UNION ALL SELECT repo_id, CASE fmt WHEN 0 THEN 'docker' WHEN 1 THEN 'env-file' WHEN 2 THEN 'terraform' ELSE 'kubernetes' END FROM io) x""")
def infra_by_repo(spark, sf_dir):
    return I.infrastructure(infra_corpus(spark, sf_dir)).select("repo_id", "service")
