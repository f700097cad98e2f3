"""Infrastructure services from config files.

Stateless rules (env, terraform, k8s lines) are narrow line filters; the
compose indentation machine is a fold over one file's lines inside its row
(no shuffle).  ``infrastructure`` (I6) unions every source, distinct per
snapshot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import paths as P
from ..functions.text import drop_prefix, trim_chars, trim_space
from ..sources.files import FILE_KEY, SNAP_KEY
from ..sources.lines import explode_lines, nonblank


# I1
_SERVICES = list(dict.fromkeys(svc for svc, _ in fixed.INFRA_VOCABULARY))


def _bit(service: str) -> Column:
    return F.lit(1 << _SERVICES.index(service)).cast("bigint")


def _vocabulary() -> Column:
    return F.array(*[F.struct(F.lit(svc).alias("service"), _bit(svc).alias("bit"), F.array(*[F.lit(t) for t in trig]).alias("triggers"))
                     for svc, trig in fixed.INFRA_VOCABULARY])


def _first_entry(value) -> Column:
    """First entry of the fixed vocabulary whose trigger occurs in lower(value); NULL if none.

    Written as one array filter (a compact expression: the 17-way CASE inflates
    generated code past the JVM method limit when used several times per row).
    """
    v = F.lower(F.col(value) if isinstance(value, str) else value)
    hits = F.filter(_vocabulary(), lambda s: F.exists(s.triggers, lambda t: F.instr(v, t) > 0))
    return F.try_element_at(hits, F.lit(1))


def detect_service(value) -> Column:
    """The service that a value names; NULL if none."""
    return _first_entry(value).getField("service")


def _service_bits(value) -> Column:
    """The service that a value names as a bit of a set of services; 0 if none."""
    return F.coalesce(_first_entry(value).getField("bit"), F.lit(0).cast("bigint"))


# I7
def leading_indent(raw) -> Column:
    """Spaces count 1, tabs 2, up to the first other character."""
    lead = F.regexp_extract(F.col(raw) if isinstance(raw, str) else raw, r"^[ \t]*", 0)
    return F.length(F.replace(lead, F.lit("\t"), F.lit("  ")))


def is_yaml_key(trimmed: Column) -> Column:
    return trimmed.endswith(":") & ~trimmed.contains(" ")


def _scan(files: DataFrame, cond: Column) -> DataFrame:
    return nonblank(explode_lines(files.filter(cond)), ("#",))


def _hits(df: DataFrame, svc: Column, source: str) -> DataFrame:
    return df.select(*FILE_KEY, svc.alias("service")).filter(F.col("service").isNotNull()) \
        .withColumn("source", F.lit(source))


# I2
def _compose_step(acc: Column, e: Column) -> Column:
    """One event line; the state is a flag, two indents and a bit per service found, whatever the file's length."""
    def st(ins, si, ci, found):
        return F.struct(ins.alias("ins"), si.alias("si"), ci.alias("ci"), found.alias("found"))
    enter = st(F.lit(True), e.indent, acc.ci, acc.found)
    outside = F.when(e.t == "services:", enter).otherwise(acc)
    leave = st(F.lit(False), acc.si, acc.ci, acc.found)
    service = st(acc.ins, acc.si, e.indent, acc.found.bitwiseOR(_service_bits(F.substring(e.t, 1, F.length(e.t) - 1))))
    ci = F.when((acc.ci != -1) & (e.indent <= acc.ci), F.lit(-1)).otherwise(acc.ci)
    img = _service_bits(trim_chars(trim_space(e.t.substr(F.lit(7), F.length(e.t))), "\"'"))
    image = F.when((ci != -1) & e.t.startswith("image:"), acc.found.bitwiseOR(img)).otherwise(acc.found)
    inside = (F.when((e.indent <= acc.si) & ~e.t.startswith("-"), leave)
              .when(is_yaml_key(e.t) & (e.indent == acc.si + 2), service)
              .otherwise(st(acc.ins, acc.si, ci, image)))
    return F.when(~acc.ins, outside).otherwise(inside)


def compose_services(files: DataFrame) -> DataFrame:
    f = files.filter(P.is_config_file() & F.lower("rel_path").contains("docker-compose"))
    raw = F.transform(F.split(F.col("content"), "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    ev = F.transform(raw, lambda x: F.struct(trim_space(x).alias("t"), leading_indent(x).alias("indent")))
    ev = F.filter(ev, lambda e: (e.t != "") & ~e.t.startswith("#"))
    init = F.struct(F.lit(False).alias("ins"), F.lit(-1).alias("si"), F.lit(-1).alias("ci"),
                    F.lit(0).cast("bigint").alias("found"))
    found = f.select(*FILE_KEY, F.aggregate(ev, init, _compose_step).getField("found").alias("found")).filter("found <> 0")
    known = F.array(*[F.struct(F.lit(s).alias("service"), _bit(s).alias("bit")) for s in _SERVICES])
    out = found.select(*FILE_KEY, F.explode(F.filter(known, lambda k: k.bit.bitwiseAND(F.col("found")) != 0)).alias("k"))
    return out.select(*FILE_KEY, "k.service", F.lit("compose").alias("source"))


# I3
def env_services(files: DataFrame) -> DataFrame:
    ln = _scan(files, P.is_config_file() & P.is_env_file())
    line = drop_prefix(F.col("line"), "export ")
    kv = ln.select(*FILE_KEY, line.alias("l")).filter(F.col("l").contains("="))
    key = trim_space(F.substring_index("l", "=", 1))
    val = trim_chars(trim_space(F.col("l").substr(F.instr("l", "=") + 1, F.length("l"))), "\"'")
    return _hits(kv.select(*FILE_KEY, F.explode(F.array(key, val)).alias("v")), detect_service("v"), "env")


# I4
def terraform_services(files: DataFrame) -> DataFrame:
    ln = _scan(files, P.is_config_file() & P.is_terraform_file())
    low = F.lower("line")
    ln = ln.select(*FILE_KEY, low.alias("l")).filter(~F.col("l").startswith("//"))
    l_ = F.col("l")
    k8s = reduce(lambda a, b: a | b, [l_.contains(h) for h in fixed.TERRAFORM_K8S_HINTS])
    found = F.array(detect_service(l_),
                    F.when(l_.contains("terraform {") | l_.contains('provider "'), F.lit("terraform")),
                    F.when(k8s, F.lit("kubernetes")),
                    F.when(l_.contains("aws_elasticache"), F.lit("redis")),
                    F.when(l_.contains("aws_mq_broker"), F.lit("rabbitmq")))
    return _hits(ln.select(*FILE_KEY, F.explode(found).alias("v")), F.col("v"), "terraform")


# I5
def k8s_services(files: DataFrame) -> DataFrame:
    f = files.filter(P.is_config_file() & P.is_k8s_candidate())
    ln = _scan(f, F.lit(True))
    line, low = F.col("line"), F.lower("line")
    image = trim_chars(trim_space(drop_prefix(line, "image:")), "\"'")
    name = trim_space(drop_prefix(low, "name:"))
    v = F.when(low.startswith("image:"), detect_service(image)).when(low.startswith("name:"), detect_service(name))
    per_line = _hits(ln, v, "k8s")
    flags = ln.groupBy(*FILE_KEY).agg(F.bool_or(low.startswith("apiversion:")).alias("a"), F.bool_or(low.startswith("kind:")).alias("k"))
    kube = flags.filter("a and k").select(*FILE_KEY, F.lit("kubernetes").alias("service"), F.lit("k8s").alias("source"))
    return per_line.unionByName(kube)


# I6
def infrastructure_hits(files: DataFrame) -> DataFrame:
    """Long (repo, snapshot, rel_path, service, source) from every rule, before the distinct."""
    cfg = files.filter(P.is_config_file())
    low = F.lower("rel_path")
    docker = cfg.filter(low.contains("docker-compose") | low.contains("dockerfile")).select(
        *FILE_KEY, F.lit("docker").alias("service"), F.lit("path").alias("source"))
    env = cfg.filter(P.is_env_file()).select(*FILE_KEY, F.lit("env-file").alias("service"), F.lit("path").alias("source"))
    parts = [docker, env, compose_services(files), env_services(files), terraform_services(files), k8s_services(files)]
    return reduce(DataFrame.unionByName, parts)


def infrastructure(files: DataFrame) -> DataFrame:
    """(repo_id, snapshot_id, service) distinct."""
    return infrastructure_hits(files).select(*SNAP_KEY, "service").distinct()
