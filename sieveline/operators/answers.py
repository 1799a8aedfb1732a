"""Answers of cloud and forge programs as short text: one answer (JSON or plain) to one text, as Column expressions.

Lists show 20 items. Fields that hold secrets or long opaque values aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import json_tokens as JT
from ..functions import text as T
from .reading import markdown_body
from .scan import begins, bound, fold, has, kept, listed, more, none, text

LIST = 20


def _or(x: Column, other: str = "?") -> Column:
    return F.coalesce(x, F.lit(other))


def _n(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def _day(x: Column) -> Column:
    return F.left(_or(x), F.lit(10))


def _each(items: Column, what: str, line: Callable[[Column], Column]) -> Column:
    """A line an item, 20 at most; null where the answer has no such list."""
    rows = F.transform(F.slice(items, 1, LIST), line)
    return F.concat(F.array_join(rows, "\n"), F.when(F.size(items) > LIST, text("\n… +", F.size(items) - LIST, f" {what}")).otherwise(""))


def _read(x: Column | str, schema: str) -> Column:
    return F.from_json(T.c(x), schema)


def identity(x: Column | str) -> Column:
    j = _read(x, "Account string, Arn string")
    return F.when(j.isNotNull(), text("AWS: ", _or(j["Account"]), " ", _or(j["Arn"])))


def bucket_lines(x: Column | str) -> Column:
    a = T.lines(x)
    return listed(a, LIST + 10, "more items", lead="\n")


def service_names(x: Column | str) -> Column:
    return _each(_read(x, "serviceArns array<string>")["serviceArns"], "services", lambda s: T.short_arn(_or(s)))


def services(x: Column | str) -> Column:
    j = _read(x, "services array<struct<serviceName:string,status:string,runningCount:bigint,desiredCount:bigint,launchType:string>>")
    return _each(j["services"], "services", lambda s: text(_or(s["serviceName"]), " ", _or(s["status"]), " ", _n(s["runningCount"]), "/", _n(s["desiredCount"]), " (", _or(s["launchType"]), ")"))


def databases(x: Column | str) -> Column:
    j = _read(x, "DBInstances array<struct<DBInstanceIdentifier:string,Engine:string,EngineVersion:string,DBInstanceClass:string,DBInstanceStatus:string,Endpoint:struct<Address:string,Port:bigint>>>")
    return _each(j["DBInstances"], "instances", lambda d: text(
        _or(d["DBInstanceIdentifier"]), " ", _or(d["Engine"]), " ", _or(d["EngineVersion"]), " ", _or(d["DBInstanceClass"]), " ", _or(d["DBInstanceStatus"]), " ", _or(d["Endpoint"]["Address"], "-"), ":", _n(d["Endpoint"]["Port"])))


def instances(x: Column | str) -> Column:
    j = _read(x, "Reservations array<struct<Instances:array<struct<InstanceId:string,State:struct<Name:string>,InstanceType:string,PrivateIpAddress:string,PublicIpAddress:string,SubnetId:string,VpcId:string,Tags:array<struct<Key:string,Value:string>>,SecurityGroups:array<struct<GroupId:string>>>>>>")
    all_ = F.flatten(F.transform(j["Reservations"], lambda r: F.coalesce(r["Instances"], F.array().cast("array<struct<InstanceId:string,State:struct<Name:string>,InstanceType:string,PrivateIpAddress:string,PublicIpAddress:string,SubnetId:string,VpcId:string,Tags:array<struct<Key:string,Value:string>>,SecurityGroups:array<struct<GroupId:string>>>>"))))

    def line(i: Column) -> Column:
        name = F.coalesce(F.try_element_at(F.filter(i["Tags"], lambda t: t["Key"] == "Name"), F.lit(1))["Value"], F.lit("-"))
        groups = F.array_compact(F.transform(F.coalesce(i["SecurityGroups"], F.array().cast("array<struct<GroupId:string>>")), lambda g: g["GroupId"]))
        return text(
            "  ", _or(i["InstanceId"]), " ", _or(i["State"]["Name"]), " ", _or(i["InstanceType"]), " ", _or(i["PrivateIpAddress"], "-"), " pub:", _or(i["PublicIpAddress"], "-"), " vpc:", _or(i["VpcId"], "-"),
            " subnet:", _or(i["SubnetId"], "-"), " sg:[", F.when(F.size(groups) > 0, F.array_join(groups, ",")).otherwise("-"), "] (", name, ")")

    rows = F.transform(F.slice(all_, 1, LIST), line)
    return text("EC2: ", F.size(all_), " instances", F.when(F.size(all_) > 0, text("\n", F.array_join(rows, "\n"))).otherwise(""), F.when(F.size(all_) > LIST, text("\n  … +", F.size(all_) - LIST, " more")).otherwise(""))


_STACK = "StackName:string,StackStatus:string,LastUpdatedTime:string,CreationTime:string"


def _stack(s: Column) -> Column:
    return text(_or(s["StackName"]), " ", _or(s["StackStatus"]), " ", _day(F.coalesce(s["LastUpdatedTime"], s["CreationTime"])))


def stacks(x: Column | str) -> Column:
    return _each(_read(x, f"StackSummaries array<struct<{_STACK}>>")["StackSummaries"], "stacks", _stack)


def stack_details(x: Column | str) -> Column:
    """Stacks with their outputs."""
    j = _read(x, f"Stacks array<struct<{_STACK},Outputs:array<struct<OutputKey:string,OutputValue:string>>>>")
    return _each(j["Stacks"], "stacks", lambda s: F.concat(_stack(s), F.coalesce(F.array_join(F.transform(s["Outputs"], lambda o: text("\n  ", _or(o["OutputKey"]), "=", _or(o["OutputValue"]))), ""), F.lit(""))))


def stack_events(x: Column | str) -> Column:
    """Failed events with their reasons, and how many went well."""
    e = _read(x, "StackEvents array<struct<ResourceStatus:string,LogicalResourceId:string,ResourceType:string,Timestamp:string,ResourceStatusReason:string>>")["StackEvents"]
    bad = F.filter(e, lambda v: has(_or(v["ResourceStatus"]), "FAILED", "ROLLBACK"))
    good = F.size(e) - F.size(bad)
    line = lambda v: text("  ", _day(v["Timestamp"]), " ", _or(v["LogicalResourceId"]), " ", F.regexp_replace(_or(v["ResourceType"]), "^AWS::", ""), " ", _or(v["ResourceStatus"]), F.when(_or(v["ResourceStatusReason"], "") != "", text(" REASON: ", v["ResourceStatusReason"])).otherwise(""))
    return text(
        "CloudFormation: ", F.size(e), " events (", F.size(bad), " failed, ", good, " successful)", F.when(F.size(bad) > 0, text("\n--- FAILURES ---\n", F.array_join(F.transform(F.slice(bad, 1, LIST), line), "\n"))).otherwise(""),
        F.when(good > 0, text("\n+ ", good, " successful resources")).otherwise(""))


def functions(x: Column | str) -> Column:
    j = _read(x, "Functions array<struct<FunctionName:string,Runtime:string,MemorySize:bigint,Timeout:bigint,State:string>>")
    return _each(j["Functions"], "functions", lambda f: text(_or(f["FunctionName"]), " ", _or(f["Runtime"]), " ", _n(f["MemorySize"]), "MB ", _n(f["Timeout"]), "s ", _or(f["State"], "active")))


def function_details(x: Column | str) -> Column:
    """One function with the names of its layers."""
    c = _read(x, "Configuration struct<FunctionName:string,Runtime:string,Handler:string,MemorySize:bigint,Timeout:bigint,State:string,LastModified:string,Layers:array<struct<Arn:string>>>")["Configuration"]
    arns = F.array_compact(F.transform(F.coalesce(c["Layers"], F.array().cast("array<struct<Arn:string>>")), lambda v: v["Arn"]))
    layers = F.transform(arns, lambda a: F.when(a.contains(":"), F.regexp_extract(a, r"([^:]*:[^:]*)\z", 1)).otherwise(a))
    head = text(_or(c["FunctionName"]), " ", _or(c["Runtime"]), " ", _or(c["Handler"]), " ", _n(c["MemorySize"]), "MB ", _n(c["Timeout"]), "s ", _or(c["State"], "active"), " ", _day(c["LastModified"]))
    return F.concat(head, F.when(F.size(arns) > 0, text("\n  layers: ", F.array_join(layers, ", "))).otherwise(""))


def principals(document: Column) -> Column:
    """Who may take on a role, by its policy (JSON text): services, and accounts by the end of their name; neighbours that repeat once."""
    statements = F.from_json(document, "Statement array<struct<Principal:string>>")["Statement"]

    def of(s: Column) -> Column:
        p = s["Principal"]
        one = lambda k: F.get_json_object(p, f"$.{k}")
        many = lambda k: F.when(one(k).startswith("["), F.from_json(one(k), "array<string>")).when(one(k).isNotNull(), F.array(one(k)))
        return F.coalesce(F.when(~F.ltrim(p).startswith("{"), F.array(p)), many("Service"), F.transform(many("AWS"), T.short_arn), none())

    a = F.flatten(F.transform(F.coalesce(statements, F.array().cast("array<struct<Principal:string>>")), of))
    return F.filter(a, lambda v, i: (i == 0) | (v != F.coalesce(F.try_element_at(a, F.greatest(i, F.lit(1))), F.lit(""))))


def roles(x: Column | str) -> Column:
    j = _read(x, "Roles array<struct<RoleName:string,CreateDate:string,Description:string,AssumeRolePolicyDocument:string>>")

    def line(r: Column) -> Column:
        who = principals(r["AssumeRolePolicyDocument"])
        return text(_or(r["RoleName"]), " ", _day(r["CreateDate"]), F.when(_or(r["Description"], "") != "", text(" [", r["Description"], "]")).otherwise(""), F.when(F.size(who) > 0, text(" assume:[", F.array_join(who, ","), "]")).otherwise(""))

    return _each(j["Roles"], "roles", line)


def users(x: Column | str) -> Column:
    return _each(_read(x, "Users array<struct<UserName:string,CreateDate:string>>")["Users"], "users", lambda u: text(_or(u["UserName"]), " created:", _day(u["CreateDate"])))


def tasks(x: Column | str) -> Column:
    j = _read(x, "tasks array<struct<taskArn:string,lastStatus:string,stoppedReason:string,containers:array<struct<name:string,lastStatus:string,exitCode:bigint>>>>")
    box = lambda c: text(_or(c["name"]), ":", _or(c["lastStatus"]), F.when(c["exitCode"].isNotNull(), text("(exit:", c["exitCode"], ")")).otherwise(""))
    return _each(j["tasks"], "tasks", lambda t: text(T.short_arn(_or(t["taskArn"])), " ", _or(t["lastStatus"]), " containers:[", F.coalesce(F.array_join(F.transform(t["containers"], box), ", "), F.lit("")), "]", F.when(_or(t["stoppedReason"], "") != "", text(" reason:", t["stoppedReason"])).otherwise("")))


_RULE = "struct<IpProtocol:string,FromPort:bigint,ToPort:bigint,IpRanges:array<struct<CidrIp:string>>,Ipv6Ranges:array<struct<CidrIpv6:string>>,UserIdGroupPairs:array<struct<GroupId:string>>>"


def rule(p: Column) -> Column:
    """A firewall rule: protocol, port or range, and where from."""
    port = F.when(p["FromPort"].isNull() | p["ToPort"].isNull(), "*").when(p["FromPort"] == p["ToPort"], p["FromPort"].cast("string")).otherwise(text(p["FromPort"], "-", p["ToPort"]))
    of = lambda a, k: F.coalesce(F.array_compact(F.transform(a, lambda r: r[k])), none())
    groups = F.coalesce(F.transform(p["UserIdGroupPairs"], lambda g: _or(g["GroupId"])), none())
    sources = F.concat(of(p["IpRanges"], "CidrIp"), of(p["Ipv6Ranges"], "CidrIpv6"), groups)
    src = F.when(F.size(sources) > 0, F.array_join(sources, ",")).otherwise("?")
    protocol = _or(p["IpProtocol"])
    return F.when(protocol.isin("-1", "all"), text("all<-", src)).otherwise(text(protocol, "/", port, "<-", src))


def security_groups(x: Column | str) -> Column:
    j = _read(x, f"SecurityGroups array<struct<GroupName:string,GroupId:string,IpPermissions:array<{_RULE}>,IpPermissionsEgress:array<{_RULE}>>>")
    side = lambda a: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, F.array_join(F.transform(a, rule), ", ")).otherwise("none")
    return _each(j["SecurityGroups"], "groups", lambda g: text(_or(g["GroupName"]), " (", _or(g["GroupId"]), ") ingress: ", side(g["IpPermissions"]), " | egress: ", side(g["IpPermissionsEgress"])))


def objects(x: Column | str) -> Column:
    c = F.coalesce(_read(x, "Contents array<struct<Key:string,Size:bigint,LastModified:string>>")["Contents"], F.array().cast("array<struct<Key:string,Size:bigint,LastModified:string>>"))
    return _each(c, "objects", lambda o: text(_or(o["Key"]), " ", T.human_bytes(F.greatest(_n(o["Size"]), F.lit(0))), " ", _day(o["LastModified"])))


def cluster(x: Column | str) -> Column:
    c = _read(x, "cluster struct<name:string,status:string,version:string,endpoint:string>")["cluster"]
    return text(_or(c["name"]), " ", _or(c["status"]), " k8s/", _or(c["version"]), " ", _or(c["endpoint"]))


def messages(x: Column | str) -> Column:
    m = F.coalesce(_read(x, "Messages array<struct<MessageId:string,Body:string>>")["Messages"], F.array().cast("array<struct<MessageId:string,Body:string>>"))
    return _each(m, "messages", lambda v: text(F.left(_or(v["MessageId"]), F.lit(8)), " ", T.ellipsis(_or(v["Body"]), 200)))


def transfer_report(x: Column | str) -> Column:
    """Tally of a long transfer by verb, and its first ten errors; short output as it is."""
    a = T.lines(x)
    n = lambda verb: F.size(F.filter(a, lambda s: s.startswith(verb + ":")))
    counts = [F.when(n(v) > 0, text(n(v), f" {done}")) for v, done in (("upload", "uploaded"), ("download", "downloaded"), ("delete", "deleted"), ("copy", "copied"), ("move", "moved"))]
    parts = F.array_compact(F.array(*counts))
    errors = F.filter(a, lambda s: ~begins(s, "upload:", "download:", "delete:", "copy:", "move:") & has(s, "error", "failed"))
    head = F.when(F.size(parts) > 0, F.array(text("S3 transfer: ", F.array_join(parts, ", "), ", ", F.size(errors), " errors"))).otherwise(none())
    rows = F.concat(head, F.slice(errors, 1, 10))
    return F.when((F.size(a) < 10) | (F.size(rows) == 0), T.c(x)).otherwise(F.array_join(rows, "\n"))


def is_structured(arguments: Column) -> Column:
    """Whether an operation answers in JSON."""
    op = F.coalesce(F.try_element_at(arguments, F.lit(1)), F.lit(""))
    return begins(op, "describe-", "list-", "get-") | op.isin("scan", "query", "receive-message")


def ymd(days: Column | str) -> Column:
    """Year, month and day of a number of days since 1970."""
    d = F.date_add(F.lit("1970-01-01").cast("date"), T.c(days).cast("int"))
    return F.struct(F.year(d).alias("year"), F.month(d).alias("month"), F.day(d).alias("day"))


# forges

#: Marks by state, long and short.
STATES = {"OPEN": ("[open]", "O"), "MERGED": ("[merged]", "M"), "CLOSED": ("[closed]", "C")}
MERGE_STATES = {"opened": ("[open]", "O"), "merged": ("[merged]", "M"), "closed": ("[closed]", "C")}
PIPELINES = {
    "success": ("[ok]", "+"), "failed": ("[fail]", "x"), "canceled": ("[cancel]", "X"), "cancelled": ("[cancel]", "X"), "running": ("[run]", "~"), "pending": ("[pend]", "~"), "skipped": ("[skip]", "-"),
}


def icon(state: Column, marks: dict[str, tuple[str, str]], other: str, short: bool = False) -> Column:
    return F.coalesce(*[F.when(state == k, F.lit(v[short])) for k, v in marks.items()], F.lit("?" if short else other))


def state_icon(state: Column, short: bool = False) -> Column:
    return icon(state, STATES, "[unknown]", short)


def pipeline_icon(status: Column, short: bool = False) -> Column:
    return icon(status, PIPELINES, "?", short)


def _listing(items: Column, head: str, empty: str, line: Callable[[Column], Column], cap: int = LIST) -> Column:
    rows = F.array_join(F.transform(F.slice(items, 1, cap), lambda i: F.concat(line(i), F.lit("\n"))), "")
    return F.when(F.size(items) == 0, empty).otherwise(text(head + "\n", rows, more(F.size(items), cap, "more\n", "  … +")))


def _indented(body: Column, pad: str) -> Column:
    return F.array_join(F.transform(T.lines(body), lambda s: text(pad, s, "\n")), "")


def pull_requests(x: Column | str, short: bool = False) -> Column:
    a = _read(x, "array<struct<number:bigint,title:string,state:string,author:struct<login:string>>>")
    line = lambda p: text("  ", state_icon(_or(p["state"], "???"), short), " #", _n(p["number"]), " ", T.ellipsis(_or(p["title"], "???"), 60), " (", _or(p["author"]["login"], "???"), ")")
    return _listing(a, "PRs" if short else "Pull Requests", "No PRs\n" if short else "No Pull Requests\n", line)


_CHECKS = "statusCheckRollup:array<struct<conclusion:string,state:string>>"


def check_counts(checks: Column) -> tuple[Column, Column]:
    """Passed and failed of a list of checks."""
    n = lambda s: F.size(F.filter(checks, lambda c: (_or(c["conclusion"], "") == s) | (_or(c["state"], "") == s)))
    return n("SUCCESS"), n("FAILURE")


def pull_request(x: Column | str, short: bool = False) -> Column:
    """One pull request: state, reviews, checks and its text without badges and comments."""
    p = _read(x, f"number bigint, title string, state string, author struct<login:string>, body string, url string, mergeable string, reviews struct<nodes:array<struct<state:string>>>, {_CHECKS.replace(':', ' ', 1)}")
    state = _or(p["state"], "???")
    merge = F.when(p["mergeable"] == "MERGEABLE", "[ok]").when(p["mergeable"] == "CONFLICTING", "[x]").otherwise("?")
    votes = lambda s: F.size(F.filter(p["reviews"]["nodes"], lambda r: r["state"] == s))
    yes, change = votes("APPROVED"), votes("CHANGES_REQUESTED")
    reviews = F.when((yes > 0) | (change > 0), text("  Reviews: ", yes, " approved, ", change, " changes requested\n")).otherwise("")
    passed, failed = check_counts(p["statusCheckRollup"])
    all_ = F.size(p["statusCheckRollup"])
    if short:
        checks = F.when(failed > 0, text("  [x]", passed, "/", all_, "  ", failed, " fail\n")).otherwise(text("  ", passed, "/", all_, "\n"))
    else:
        checks = text("  Checks: ", passed, "/", all_, " passed\n", F.when(failed > 0, text("  [warn] ", failed, " checks failed\n")).otherwise(""))
    body = markdown_body(p["body"])
    shown = F.when(_or(p["body"], "") == "", "").when(body != "", F.concat(F.lit("\n"), _indented(body, "  "))).otherwise("\n  (body contained only badges/images/comments)\n")
    return text(
        state_icon(state, short), " PR #", _n(p["number"]), ": ", _or(p["title"], "???"), "\n  ", _or(p["author"]["login"], "???"), "\n  ", state, " | ", merge, "\n",
        F.when(p["reviews"]["nodes"].isNotNull(), reviews).otherwise(""), F.when(p["statusCheckRollup"].isNotNull(), checks).otherwise(""), "  ", _or(p["url"], ""), "\n", shown)


def pull_request_status(x: Column | str) -> Column:
    entry_type = f"struct<number:bigint,title:string,reviewDecision:string,{_CHECKS}>"
    j = _read(x, f"currentBranch {entry_type}, createdBy array<{entry_type}>")

    def entry(p: Column) -> Column:
        passed, failed = check_counts(p["statusCheckRollup"])
        checks = F.when(F.coalesce(F.size(p["statusCheckRollup"]), F.lit(0)) > 0, text(" checks ", passed, "/", F.size(p["statusCheckRollup"]), F.when(failed > 0, text(" fail ", failed)).otherwise(""))).otherwise("")
        return text("  #", _n(p["number"]), " ", T.ellipsis(_or(p["title"], "???"), 50), " [", _or(p["reviewDecision"], "PENDING"), "]", checks, "\n")

    here = F.when(j["currentBranch"].isNotNull(), text("Current Branch\n", entry(j["currentBranch"]), "\n")).otherwise("")
    own = F.when(j["createdBy"].isNotNull(), text("Your PRs (", F.size(j["createdBy"]), "):\n", F.array_join(F.transform(F.slice(j["createdBy"], 1, 5), entry), ""))).otherwise("")
    return F.concat(here, own)


def issues(x: Column | str, number: str = "number", opened: str = "OPEN", short: bool = False) -> Column:
    """Issues of either forge: ``number`` and ``opened`` are its words."""
    a = _read(x, f"array<struct<{number}:bigint,title:string,state:string>>")
    mark = lambda s: F.when(s == opened, "O" if short else "[open]").otherwise("C" if short else "[closed]")
    return _listing(a, "Issues", "No Issues\n", lambda i: text("  ", mark(i["state"]), " #", _n(i[number]), " ", T.ellipsis(_or(i["title"], "???"), 60)))


def issue(x: Column | str) -> Column:
    j = _read(x, "number bigint, title string, state string, author struct<login:string>, body string, url string")
    return _issue(j["number"], j["title"], j["state"], j["author"]["login"], j["url"], j["body"], "OPEN", "\n  Description: (body contained only badges/images/comments)\n")


def merge_issue(x: Column | str) -> Column:
    j = _read(x, "iid bigint, title string, state string, author struct<username:string>, description string, web_url string")
    return _issue(j["iid"], j["title"], j["state"], j["author"]["username"], j["web_url"], j["description"], "opened", "")


def _issue(number: Column, title: Column, state: Column, author: Column, url: Column, body: Column, opened: str, only_badges: str) -> Column:
    clean = markdown_body(body)
    shown = F.when(_or(body, "") == "", "").when(clean != "", text("\n  Description:\n", _indented(clean, "    "))).otherwise(only_badges)
    mark = F.when(state == opened, "[open]").otherwise("[closed]")
    return text(mark, " Issue #", _n(number), ": ", _or(title, "???"), "\n  Author: @", _or(author, "???"), "\n  Status: ", _or(state, "???"), "\n  URL: ", _or(url, ""), "\n", shown)


def runs(x: Column | str, short: bool = False) -> Column:
    a = _read(x, "array<struct<databaseId:bigint,name:string,status:string,conclusion:string>>")
    marks = ("[ok]", "[x]", "X", "~", "?") if short else ("[ok]", "[FAIL]", "[X]", "[time]", "[pending]")
    mark = lambda r: F.when(r["conclusion"] == "success", marks[0]).when(r["conclusion"] == "failure", marks[1]).when(r["conclusion"] == "cancelled", marks[2]).when(r["status"] == "in_progress", marks[3]).otherwise(marks[4])
    return text("Runs\n" if short else "Workflow Runs\n", F.array_join(F.transform(a, lambda r: text("  ", mark(r), " ", T.ellipsis(_or(r["name"], "???"), 50), " [", _n(r["databaseId"]), "]\n")), ""))


def run_view(x: Column | str, run: Column | str | None = None) -> Column:
    """Status lines of a run, and jobs that failed."""
    rows = fold(T.lines(x), {"jobs": F.lit(False), "out": none()}, lambda s, line: {
        "jobs": s["jobs"] | line.contains("JOBS"),
        "out": F.concat(s["out"], F.when((s["jobs"] | line.contains("JOBS")) & ~has(line, "✓", "success") & has(line, "[x]", "fail"), F.array(text("  [FAIL] ", T.utrim(line), "\n")))
                        .when(~s["jobs"] & ~line.contains("JOBS") & has(line, "Status:", "Conclusion:"), F.array(text("  ", T.utrim(line), "\n"))).otherwise(none()))}, lambda s: s["out"])
    head = F.lit("Workflow Run\n") if run is None else text("Workflow Run #", T.c(run), "\n")
    return F.concat(head, F.array_join(rows, ""))


def repository(x: Column | str) -> Column:
    j = _read(x, "name string, owner struct<login:string>, description string, url string, stargazerCount bigint, forkCount bigint, isPrivate boolean")
    about = F.when(_or(j["description"], "") != "", text("  ", T.ellipsis(j["description"], 80), "\n")).otherwise("")
    return text(_or(j["owner"]["login"], "???"), "/", _or(j["name"], "???"), "\n  ", F.when(j["isPrivate"], "[private]").otherwise("[public]"), "\n", about, "  ", _n(j["stargazerCount"]), " stars | ", _n(j["forkCount"]), " forks\n  ", _or(j["url"], ""), "\n")


def _text_or(x: Column, other: str = "???") -> Column:
    return F.when(_or(x, "") == "", other).otherwise(x)


def merge_requests(x: Column | str, short: bool = False) -> Column:
    a = _read(x, "array<struct<iid:bigint,title:string,state:string,author:struct<username:string>>>")
    line = lambda m: text("  ", icon(_text_or(m["state"]), MERGE_STATES, "?", short), " !", _n(m["iid"]), " ", T.ellipsis(_text_or(m["title"]), 60), " (", _or(m["author"]["username"], "???"), ")")
    return _listing(a, "MRs" if short else "Merge Requests", "No MRs\n" if short else "No Merge Requests\n", line)


def merge_request(x: Column | str, short: bool = False) -> Column:
    m = _read(x, "iid bigint, title string, state string, author struct<username:string>, web_url string, merge_status string, source_branch string, target_branch string, labels array<string>, reviewers array<struct<username:string>>, head_pipeline struct<status:string>, description string")
    names = F.transform(F.filter(m["reviewers"], lambda r: _or(r["username"], "") != ""), lambda r: F.concat(F.lit("@"), r["username"]))
    some = lambda a, label: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, text(f"  {label}: ", F.array_join(a, ", "), "\n")).otherwise("")
    status = _text_or(m["head_pipeline"]["status"], "unknown")
    body = markdown_body(m["description"])
    return text(
        icon(_text_or(m["state"]), MERGE_STATES, "?", short), " MR !", _n(m["iid"]), ": ", _text_or(m["title"]), "\n  ", _or(m["author"]["username"], "???"), "\n  ", _text_or(m["state"]), " | ",
        F.when(m["merge_status"] == "can_be_merged", "[ok]").when(m["merge_status"] == "cannot_be_merged", "[conflict]").otherwise("[?]"), "\n  ", _text_or(m["source_branch"]), " -> ", _text_or(m["target_branch"]), "\n",
        some(m["labels"], "Labels"), some(names, "Reviewers"), F.when(m["head_pipeline"].isNotNull(), text("  Pipeline: ", pipeline_icon(status, short), " ", status, "\n")).otherwise(""),
        "  ", _or(m["web_url"], ""), "\n", F.when((_or(m["description"], "") != "") & (body != ""), F.concat(F.lit("\n"), _indented(body, "  "))).otherwise(""))


def pipelines(x: Column | str, short: bool = False) -> Column:
    a = _read(x, "array<struct<id:bigint,status:string,ref:string>>")
    return _listing(a, "Pipelines", "No Pipelines\n", lambda p: text("  ", pipeline_icon(_text_or(p["status"]), short), " #", _n(p["id"]), " ", _text_or(p["status"]), " (", _text_or(p["ref"]), ")"), 10)


def pipeline_status(x: Column | str, short: bool = False) -> Column:
    """Status lines with their marks; as it is where no line says one."""
    a = F.filter(F.transform(F.split(T.c(x), "\n"), T.utrim), lambda s: s != "")
    words = (("passed|success", "success"), ("failed", "failed"), ("running", "running"), ("pending", "pending"), ("cancell?ed", "canceled"))
    mark = lambda s: F.coalesce(*[F.when(s.rlike(p), F.lit(PIPELINES[k][short])) for p, k in words])
    rows = F.array_join(F.transform(a, lambda s: text(F.coalesce(mark(s), F.lit(" ")), " ", s, "\n")), "")
    return F.when(F.exists(a, lambda s: mark(s).isNotNull()), rows).otherwise(T.c(x))


#: How lines of a runner's own begin.
_RUNNER = (
    "Running with gitlab-runner", "Using Docker executor", "Using Shell", "Running on ", "Preparing the", "Preparing environment", "Getting source from", "Resolving secrets", "Cleaning up", "Uploading artifacts",
    "Downloading artifacts", "Runtime platform", "Fetching changes with git", "Initialized empty Git", "Created fresh repository", "Checking out ", "Skipping Git submodules",
)


def job_trace(x: Column | str) -> Column:
    """A job's own output: without colours, section marks and the runner's lines."""
    raw = T.strip_ansi(x)
    for pattern in (r"\[[\d;]+[A-Za-z]", r"section_(?:start|end):\d+:[a-z0-9_]+(?:\x1b\[0K|\[0K)*"):
        raw = F.regexp_replace(raw, pattern, "")
    a = F.filter(F.transform(F.split(raw, "\n"), T.utrim), lambda s: (s != "") & ~begins(s, *_RUNNER) & ~(s.startswith("on ") & s.contains("system ID:")))
    return F.array_join(F.transform(a, lambda s: F.concat(s, F.lit("\n"))), "")


def releases(x: Column | str) -> Column:
    """Names, tags and dates of releases (tab separated, below a header); as it is where there are none."""
    a = F.transform(F.split(T.c(x), "\n"), T.utrim)
    head = F.array_position(F.transform(a, lambda s: begins(s, "Name\t", "NAME\t")), F.lit(True)).cast("int")
    rows = F.filter(F.transform(F.when(head > 0, F.slice(a, head + 1, F.size(a))).otherwise(none()), lambda s: F.transform(F.split(s, "\t"), T.utrim)), lambda r: F.size(r) >= 3)
    line = lambda r: F.when(r[0] == r[1], text("  ", r[0], " (", r[2], ")\n")).otherwise(text("  ", r[0], " [", r[1], "] (", r[2], ")\n"))
    return F.when(F.size(rows) == 0, T.c(x)).otherwise(F.concat(F.lit("Releases\n"), F.array_join(F.transform(F.slice(rows, 1, LIST), line), "")))


def release(x: Column | str) -> Column:
    """A release without its archives, images, comments and rules."""

    def step(s: Column, line: Column) -> tuple[Column, dict[str, Column]]:
        t = T.utrim(line)
        head, link = t == "SOURCES", begins(t, "http://", "https://")
        drop = (t.startswith("![") & t.endswith(")") & t.contains("](")) | (t.startswith("Image:") & t.contains("→")) | (t.startswith("<!--") & t.endswith("-->")) | t.rlike("^-{3,}$")
        return ~head & ~(s["on"] & link) & ~drop, {"on": head | (s["on"] & link)}

    rows = kept(F.split(T.c(x), "\n", -1), {"on": F.lit(False)}, step)
    return F.regexp_replace(F.array_join(F.transform(rows, lambda s: F.concat(s, F.lit("\n"))), ""), "\n{3,}", "\n\n")


def generic(x: Column | str, max_depth: int = 4) -> Column:
    """Any program's answer: in short if it is JSON, else as it is."""
    return F.coalesce(JT.compact(x, max_depth), T.c(x))


def secret(x: Column | str) -> Column:
    """A secret's name, and its value with each field masked; null where a text isn't an answer with one of them.

    Values aren't told, whatever their length: a shorter text of a secret is as much of a leak as a longer one.
    """
    held = "STRUCT<Name: STRING, SecretString: STRING>"

    def value(s: Column) -> Column:
        fields = F.map_keys(F.from_json(s, "map<string,string>"))
        shown = F.array_join(F.transform(fields, lambda k: F.concat(F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]\z", 1), F.lit(':"****"'))), ",")
        return F.when(JT.is_object(s) & F.try_parse_json(s).isNotNull(), F.concat(F.lit("{"), shown, F.lit("}"))).otherwise("****")

    def told(r: Column) -> Column:
        lines = F.array_compact(F.array(F.concat(F.lit("Name: "), r["Name"]), F.when(r["SecretString"].isNotNull(), F.concat(F.lit("Secret: "), value(r["SecretString"])))))
        return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))

    return F.when(F.try_parse_json(T.c(x)).isNotNull(), bound(F.from_json(T.c(x), held), told))
