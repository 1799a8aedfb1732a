"""Cloud and forge JSON as flat rows: one reader driven by a schema and a list of paths for each kind of answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import count_by, top_k

#: Answers by kind: the schema, the arrays to go down, and the columns as expressions over the innermost element ``x``.
ANSWERS: dict[str, tuple[str, tuple[str, ...], dict[str, str]]] = {
    "ec2-instances": ("Reservations array<struct<Instances:array<struct<InstanceId:string,InstanceType:string,State:struct<Name:string>,PrivateIpAddress:string,Tags:array<struct<Key:string,Value:string>>>>>>", ("Reservations", "Instances"), {"id": "x.InstanceId", "type": "x.InstanceType", "state": "x.State.Name", "address": "x.PrivateIpAddress", "name": "element_at(transform(filter(x.Tags, t -> t.Key = 'Name'), t -> t.Value), 1)"}),
    "rds-instances": ("DBInstances array<struct<DBInstanceIdentifier:string,Engine:string,EngineVersion:string,DBInstanceClass:string,DBInstanceStatus:string>>", ("DBInstances",), {"id": "x.DBInstanceIdentifier", "engine": "concat_ws(' ', x.Engine, x.EngineVersion)", "class": "x.DBInstanceClass", "state": "x.DBInstanceStatus"}),
    "stacks": ("StackSummaries array<struct<StackName:string,StackStatus:string,CreationTime:string,LastUpdatedTime:string>>", ("StackSummaries",), {"id": "x.StackName", "state": "x.StackStatus", "day": "left(coalesce(x.LastUpdatedTime, x.CreationTime), 10)"}),
    "functions": ("Functions array<struct<FunctionName:string,Runtime:string,MemorySize:int,Timeout:int,LastModified:string>>", ("Functions",), {"id": "x.FunctionName", "runtime": "x.Runtime", "memory_mb": "x.MemorySize", "timeout_s": "x.Timeout", "day": "left(x.LastModified, 10)"}),
    "roles": ("Roles array<struct<RoleName:string,CreateDate:string,AssumeRolePolicyDocument:string>>", ("Roles",), {"id": "x.RoleName", "day": "left(x.CreateDate, 10)"}),
    "users": ("Users array<struct<UserName:string,CreateDate:string>>", ("Users",), {"id": "x.UserName", "day": "left(x.CreateDate, 10)"}),
    "ecs-services": ("services array<struct<serviceName:string,status:string,runningCount:int,desiredCount:int,launchType:string>>", ("services",), {"id": "x.serviceName", "state": "x.status", "running": "x.runningCount", "desired": "x.desiredCount", "launch": "x.launchType"}),
    "s3-objects": ("Contents array<struct<Key:string,Size:bigint,LastModified:string>>", ("Contents",), {"id": "x.Key", "size": "x.Size", "day": "left(x.LastModified, 10)"}),
    "pull-requests": ("items array<struct<number:bigint,title:string,state:string,author:struct<login:string>,updatedAt:string>>", ("items",), {"id": "concat('#', x.number)", "title": "x.title", "state": "x.state", "author": "x.author.login", "day": "left(x.updatedAt, 10)"}),
    "merge-requests": ("items array<struct<iid:bigint,title:string,state:string,author:struct<username:string>,updated_at:string>>", ("items",), {"id": "concat('!', x.iid)", "title": "x.title", "state": "x.state", "author": "x.author.username", "day": "left(x.updated_at, 10)"}),
    "runs": ("items array<struct<databaseId:bigint,displayTitle:string,status:string,conclusion:string,workflowName:string>>", ("items",), {"id": "x.databaseId", "title": "x.displayTitle", "workflow": "x.workflowName", "state": "coalesce(nullif(x.conclusion, ''), x.status)"}),
}


def rows(df: DataFrame, kind: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Elements of an answer as rows (answer, at, ...). A bare array at the top is taken as ``items``."""
    schema, path, columns = ANSWERS[kind]
    text = F.when(F.ltrim(F.col(text_col)).startswith("["), F.concat(F.lit('{"items":'), F.col(text_col), F.lit("}"))).otherwise(F.col(text_col))
    d = df.select(F.col(id_col).alias("answer"), F.from_json(text, schema).alias("x"), F.array().cast("array<int>").alias("at"))
    for step in path:
        d = d.select("answer", "at", F.posexplode(f"x.{step}").alias("k", "x")).select("answer", F.concat("at", F.array("k")).alias("at"), "x")
    return d.select("answer", "at", *[F.expr(e).alias(n) for n, e in columns.items()])


def listing(r: DataFrame, columns: list[str], cap: int = 20, label: str = "more") -> DataFrame:
    """An answer's rows as text: columns joined by spaces, capped with the number left out. Rows are ranked first, so only those shown are gathered."""
    line = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    shown = top_k(r.select("answer", "at", line.alias("t")), cap, [F.col("at")], ["answer"])
    g = shown.groupBy("answer").agg(F.sort_array(F.collect_list(F.struct("at", "t"))).alias("l"))
    left = F.when(F.col("n") > cap, F.concat(F.lit("\n... +"), (F.col("n") - cap).cast("string"), F.lit(f" {label}"))).otherwise("")
    return g.join(count_by(r, "answer"), "answer").select("answer", F.concat(F.array_join(F.transform("l", lambda x: x["t"]), "\n"), left).alias("text"))


def log_events(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Log events with their time of day in UTC, ``??:??:??`` where there is none; adjacent repeats dropped."""
    e = df.select(F.col(id_col).alias("answer"), F.posexplode(F.from_json(F.col(text_col), "events array<struct<timestamp:bigint,message:string>>")["events"]).alias("at", "e"))
    clock = F.when(F.col("e.timestamp") > 0, F.date_format(F.timestamp_millis("e.timestamp"), "HH:mm:ss")).otherwise("??:??:??")
    e = e.select("answer", "at", clock.alias("clock"), T.utrim("e.message").alias("message"))
    w = Window.partitionBy("answer").orderBy("at")
    return e.withColumn("was", F.lag("message").over(w)).where("NOT message <=> was").drop("was")


def query_results(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Rows of {field, value} pairs as k=v text, without record pointers."""
    r = df.select(F.col(id_col).alias("answer"), F.posexplode(F.from_json(F.col(text_col), "results array<array<struct<field:string,value:string>>>")["results"]).alias("at", "r"))
    pairs = F.transform(F.filter("r", lambda p: p["field"] != "@ptr"), lambda p: F.concat(p["field"], F.lit("="), p["value"]))
    return r.select("answer", "at", F.array_join(pairs, " ").alias("text"))


def transfers(x: Column | str) -> Column:
    """Tally of transfer lines by verb, and errors."""
    a = T.lines(x)
    n = lambda p: F.size(F.filter(a, lambda s: s.rlike(p)))
    return F.struct(*[n(rf"^{v}: ").alias(v) for v in ("upload", "download", "delete", "copy", "move")], n(r"(?i)error|failed").alias("errors"))
