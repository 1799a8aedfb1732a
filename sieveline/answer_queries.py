"""Queries over answers of cloud and forge programs: JSON is written from a hundred parts at a time, and the report is held against one made from the same parts in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import answers as AN
from .parser_queries import _k, _s
from .queries import query, table
from .report_queries import NL, _each, _first, _pick, _report, _rows, _sql


def _items(spark, sf_dir, item: Column) -> DataFrame:
    """(id, items): the items of a hundred parts, in order."""
    g = table(spark, sf_dir, "part").groupBy(F.floor(_k() / 100).alias("id")).agg(F.sort_array(F.collect_list(F.struct(_k().alias("k"), item.alias("i")))).alias("l"))
    return g.select("id", F.transform("l", lambda x: x["i"]).alias("items"))


def _answer(spark, sf_dir, report, item: Column, name: str | None) -> DataFrame:
    d = _items(spark, sf_dir, item)
    text = F.to_json(F.struct(F.col("items").alias(name))) if name else F.to_json("items")
    return d.select("id", report(text).alias("report"))


def _list(line: str, what: str) -> str:
    return _sql(f"list({line} ORDER BY k) AS l", _first("l", 20, NL, f"{NL} || '… +' || # || ' {what}'"))


def _st(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def _odd(v: Column, n: int = 2) -> Column:
    """A value that every n-th part lacks."""
    return F.when(_k() % n != 0, v)


@query(_list("'svc' || k", "services"))
def answer_service_names(spark, sf_dir):
    return _answer(spark, sf_dir, AN.service_names, _s("arn:aws:ecs:eu:1:service/c/svc", _k()), "serviceArns")


@query(_list("'s' || k || ' ' || CASE WHEN k % 2 = 0 THEN '?' ELSE 'ACTIVE' END || ' ' || (k % 5) || '/7 (FARGATE)'", "services"))
def answer_services(spark, sf_dir):
    return _answer(spark, sf_dir, AN.services, _st(serviceName=_s("s", _k()), status=_odd(F.lit("ACTIVE")), runningCount=_k() % 5, desiredCount=7, launchType="FARGATE"), "services")


@query(_list("'d' || k || ' pg 16 db.t3 up ' || CASE WHEN k % 2 = 0 THEN '-:0' ELSE 'h' || k || ':5432' END", "instances"))
def answer_databases(spark, sf_dir):
    end = _odd(_st(Address=_s("h", _k()), Port=5432))
    return _answer(spark, sf_dir, AN.databases, _st(DBInstanceIdentifier=_s("d", _k()), Engine="pg", EngineVersion="16", DBInstanceClass="db.t3", DBInstanceStatus="up", Endpoint=end), "DBInstances")


@query(_sql("list('  i-' || k || ' running t3 10.0.0.' || (k % 250) || ' pub:' || CASE WHEN k % 2 = 0 THEN '-' ELSE '1.2.3.4' END || ' vpc:v subnet:- sg:[' || CASE WHEN k % 3 = 0 THEN '-' ELSE 'sg1,sg' || k END || '] (' || CASE WHEN k % 2 = 0 THEN '-' ELSE 'n' || k END || ')' ORDER BY k) AS l",
            f"'EC2: ' || len(l) || ' instances' || {NL} || " + _first("l", 20, NL, f"{NL} || '  … +' || # || ' more'")))
def answer_instances(spark, sf_dir):
    tags = F.when(_k() % 2 != 0, F.array(_st(Key="x", Value="y"), _st(Key="Name", Value=_s("n", _k()))))
    groups = F.when(_k() % 3 != 0, F.array(_st(GroupId="sg1"), _st(GroupId=_s("sg", _k()))))
    item = F.array(_st(InstanceId=_s("i-", _k()), State=_st(Name="running"), InstanceType="t3", PrivateIpAddress=_s("10.0.0.", _k() % 250), PublicIpAddress=_odd(F.lit("1.2.3.4")), VpcId="v", Tags=tags, SecurityGroups=groups))
    return _answer(spark, sf_dir, AN.instances, F.struct(item.alias("Instances")), "Reservations")


def _stack_item(**more) -> Column:
    return _st(StackName=_s("st", _k()), StackStatus="OK", LastUpdatedTime=_odd(F.lit("2024-05-06T07:08:09Z")), CreationTime=F.when(_k() % 4 != 0, F.lit("2023-01-02T00:00:00Z")), **more)


_STACK_SQL = "'st' || k || ' OK ' || CASE WHEN k % 2 <> 0 THEN '2024-05-06' WHEN k % 4 <> 0 THEN '2023-01-02' ELSE '?' END"


@query(_list(_STACK_SQL, "stacks"))
def answer_stacks(spark, sf_dir):
    return _answer(spark, sf_dir, AN.stacks, _stack_item(), "StackSummaries")


@query(_list(f"{_STACK_SQL} || CASE WHEN k % 3 = 0 THEN {NL} || '  Url=u' || k ELSE '' END", "stacks"))
def answer_stack_details(spark, sf_dir):
    return _answer(spark, sf_dir, AN.stack_details, _stack_item(Outputs=F.when(_k() % 3 == 0, F.array(_st(OutputKey="Url", OutputValue=_s("u", _k()))))), "Stacks")


@query(_sql("list('  2024-05-06 L' || k || ' S3::Bucket ' || CASE WHEN k % 4 = 0 THEN 'CREATE_FAILED' ELSE 'ROLLBACK_DONE' END || CASE WHEN k % 4 = 0 THEN ' REASON: r' || k ELSE '' END ORDER BY k) FILTER (k % 4 <= 1) AS f, count(*) AS n",
            f"'CloudFormation: ' || n || ' events (' || len(f) || ' failed, ' || (n - len(f)) || ' successful)' || {NL} || '--- FAILURES ---' || {NL} || array_to_string(f[1:20], {NL}) || CASE WHEN n > len(f) THEN {NL} || '+ ' || (n - len(f)) || ' successful resources' ELSE '' END"))
def answer_stack_events(spark, sf_dir):
    item = _st(ResourceStatus=_pick(4, F.lit("CREATE_FAILED"), F.lit("ROLLBACK_DONE"), F.lit("CREATE_COMPLETE"), F.lit("UPDATE_COMPLETE")), LogicalResourceId=_s("L", _k()), ResourceType="AWS::S3::Bucket", Timestamp="2024-05-06T01:02:03Z", ResourceStatusReason=F.when(_k() % 4 == 0, _s("r", _k())))
    return _answer(spark, sf_dir, AN.stack_events, item, "StackEvents")


@query(_list("'f' || k || ' py3 ' || (k % 9) || 'MB 3s ' || CASE WHEN k % 2 = 0 THEN 'active' ELSE 'Failed' END", "functions"))
def answer_functions(spark, sf_dir):
    return _answer(spark, sf_dir, AN.functions, _st(FunctionName=_s("f", _k()), Runtime="py3", MemorySize=_k() % 9, Timeout=3, State=_odd(F.lit("Failed")), Environment=_st(Secret="hidden")), "Functions")


@query(_each(f"'f' || k || ' py3 a.b 128MB 3s active ' || CASE WHEN k % 2 = 0 THEN '?' ELSE '2024-01-02' END || CASE WHEN k % 3 = 0 THEN {NL} || '  layers: base:' || k || ', x:1' ELSE '' END"))
def answer_function_details(spark, sf_dir):
    arn = lambda n, v: _st(Arn=_s("arn:aws:lambda:eu:1:layer:", n, ":", v))
    c = _st(FunctionName=_s("f", _k()), Runtime="py3", Handler="a.b", MemorySize=128, Timeout=3, LastModified=_odd(F.lit("2024-01-02T00:00Z")), Layers=F.when(_k() % 3 == 0, F.array(arn("base", _k()), arn("x", "1"))))
    return _rows(spark, sf_dir, AN.function_details(F.to_json(F.struct(c.alias("Configuration")))))


@query(_list("'r' || k || ' 2024-01-02' || CASE WHEN k % 2 = 0 THEN '' ELSE ' [about ' || k || ']' END || CASE k % 4 WHEN 0 THEN ' assume:[ec2.amazonaws.com]' WHEN 1 THEN ' assume:[a.com,b.com]' WHEN 2 THEN ' assume:[u' || k || ']' ELSE '' END", "roles"))
def answer_roles(spark, sf_dir):
    policy = _pick(
        4, F.lit('{"Statement":[{"Principal":{"Service":"ec2.amazonaws.com"}},{"Principal":{"Service":"ec2.amazonaws.com"}}]}'), F.lit('{"Statement":[{"Principal":{"Service":["a.com","b.com"]}}]}'),
        _s('{"Statement":[{"Principal":{"AWS":"arn:aws:iam::1:user/u', _k(), '"}}]}'), F.lit("{}"))
    return _answer(spark, sf_dir, AN.roles, _st(RoleName=_s("r", _k()), CreateDate="2024-01-02T03:04:05Z", Description=_odd(_s("about ", _k())), AssumeRolePolicyDocument=policy), "Roles")


@query(_list("'u' || k || ' created:' || CASE WHEN k % 2 = 0 THEN '?' ELSE '2024-01-02' END", "users"))
def answer_users(spark, sf_dir):
    return _answer(spark, sf_dir, AN.users, _st(UserName=_s("u", _k()), CreateDate=_odd(F.lit("2024-01-02T00:00Z"))), "Users")


@query(_list("'t' || k || ' STOPPED containers:[a:RUNNING, b:STOPPED(exit:' || (k % 3) || ')]' || CASE WHEN k % 2 = 0 THEN '' ELSE ' reason:r' || k END", "tasks"))
def answer_tasks(spark, sf_dir):
    boxes = F.array(_st(name="a", lastStatus="RUNNING", exitCode=F.lit(None).cast("long")), _st(name="b", lastStatus="STOPPED", exitCode=(_k() % 3).cast("long")))
    return _answer(spark, sf_dir, AN.tasks, _st(taskArn=_s("arn:x/t", _k()), lastStatus="STOPPED", containers=boxes, stoppedReason=_odd(_s("r", _k()))), "tasks")


@query(_list("'g' || k || ' (sg-' || k || ') ingress: ' || CASE k % 3 WHEN 0 THEN 'tcp/443<-0.0.0.0/0,::/0' WHEN 1 THEN 'tcp/1-' || (k + 2) || '<-sg-x, all<-?' ELSE 'none' END || ' | egress: all<-0.0.0.0/0'", "groups"))
def answer_security_groups(spark, sf_dir):
    kind = AN._RULE
    rule = lambda text: F.from_json(text, kind)
    web = rule(F.lit('{"IpProtocol":"tcp","FromPort":443,"ToPort":443,"IpRanges":[{"CidrIp":"0.0.0.0/0"}],"Ipv6Ranges":[{"CidrIpv6":"::/0"}]}'))
    span = rule(_s('{"IpProtocol":"tcp","FromPort":1,"ToPort":', _k() + 2, ',"UserIdGroupPairs":[{"GroupId":"sg-x"}]}'))
    every, out = rule(F.lit('{"IpProtocol":"-1"}')), rule(F.lit('{"IpProtocol":"-1","IpRanges":[{"CidrIp":"0.0.0.0/0"}]}'))
    ingress = _pick(3, F.array(web), F.array(span, every), F.array().cast(f"array<{kind}>"))
    return _answer(spark, sf_dir, AN.security_groups, _st(GroupName=_s("g", _k()), GroupId=_s("sg-", _k()), IpPermissions=ingress, IpPermissionsEgress=F.array(out)), "SecurityGroups")


@query(_list("'k/' || k || ' ' || CASE WHEN k * 100 < 1024 THEN (k * 100) || ' B' WHEN k * 100 < 1048576 THEN printf('%.1f', k * 100 / 1024.0) || ' KB' ELSE printf('%.1f', k * 100 / 1048576.0) || ' MB' END || ' 2024-01-02'", "objects"))
def answer_objects(spark, sf_dir):
    return _answer(spark, sf_dir, AN.objects, _st(Key=_s("k/", _k()), Size=_k() * 100, LastModified="2024-01-02T00:00:00Z"), "Contents")


@query(_each("'AWS: ' || k || ' ' || CASE WHEN k % 2 = 0 THEN '?' ELSE 'arn' || k END || '|c' || k || ' ACTIVE k8s/1.30 ?'"))
def answer_identity_and_cluster(spark, sf_dir):
    who = AN.identity(F.to_json(_st(Account=_s(_k()), Arn=_odd(_s("arn", _k())))))
    return _rows(spark, sf_dir, _s(who, "|", AN.cluster(F.to_json(F.struct(_st(name=_s("c", _k()), status="ACTIVE", version="1.30").alias("cluster"))))))


@query(_list("left('m' || k || 'abcdefghij', 8) || ' ' || CASE WHEN k % 2 = 0 THEN repeat('x', 197) || '...' ELSE 'b' || k END", "messages"))
def answer_messages(spark, sf_dir):
    return _answer(spark, sf_dir, AN.messages, _st(MessageId=_s("m", _k(), "abcdefghij"), Body=F.when(_k() % 2 == 0, F.repeat(F.lit("x"), 300)).otherwise(_s("b", _k())), ReceiptHandle="long"), "Messages")


@query(_sql("count(*) FILTER (k % 3 = 0) AS u, count(*) FILTER (k % 3 = 1) AS d, list('fatal error ' || k ORDER BY k) FILTER (k % 3 = 2) AS e", f"CASE WHEN u + d + len(e) < 10 THEN 'short' ELSE 'S3 transfer: ' || u || ' uploaded, ' || d || ' deleted, ' || len(e) || ' errors' || {NL} || array_to_string(e[1:10], {NL}) END"))
def answer_transfers(spark, sf_dir):
    return _report(spark, sf_dir, AN.transfer_report, _pick(3, _s("upload: a", _k()), F.lit("delete: failed"), _s("fatal error ", _k())))


@query(_sql("list('p/' || k ORDER BY k) AS l", _first("l", 30, NL, f"{NL} || '… +' || # || ' more items'")))
def answer_bucket_lines(spark, sf_dir):
    return _report(spark, sf_dir, AN.bucket_lines, _s("p/", _k()))


@query(_each("(k % 4 < 3)::VARCHAR || ' ' || strftime(DATE '1970-01-01' + (k * 7)::INT, '%Y-%-m-%-d')"))
def answer_operations_and_days(spark, sf_dir):
    d = AN.ymd(_k() * 7)
    op = F.array(_pick(4, F.lit("describe-x"), F.lit("list-y"), F.lit("scan"), F.lit("sync")))
    return _rows(spark, sf_dir, _s(AN.is_structured(op), " ", d["year"], "-", d["month"], "-", d["day"]))


# forges

_TITLE = "CASE WHEN k % 2 = 0 THEN 'title ' || k ELSE repeat('t', 57) || '...' END"


def _title() -> Column:
    return F.when(_k() % 2 == 0, _s("title ", _k())).otherwise(F.repeat(F.lit("t"), 90))


def _forge(head: str, line: str, cap: int = 20) -> str:
    return _sql(f"list({line} ORDER BY k) AS l", f"'{head}' || {NL} || " + _first("l", cap, NL, f"{NL} || '  … +' || # || ' more'") + f" || {NL}")


@query(_forge("Pull Requests", f"'  ' || CASE k % 4 WHEN 0 THEN '[open]' WHEN 1 THEN '[merged]' WHEN 2 THEN '[closed]' ELSE '[unknown]' END || ' #' || k || ' ' || {_TITLE} || ' (' || CASE WHEN k % 3 = 0 THEN '???' ELSE 'me' END || ')'"))
def forge_pull_requests(spark, sf_dir):
    item = _st(number=_k(), title=_title(), state=_pick(4, F.lit("OPEN"), F.lit("MERGED"), F.lit("CLOSED"), F.lit("X")), author=_odd(_st(login="me"), 3))
    return _answer(spark, sf_dir, AN.pull_requests, item, None)


@query(_forge("Merge Requests", f"'  ' || CASE k % 3 WHEN 0 THEN '[open]' WHEN 1 THEN '[merged]' ELSE '?' END || ' !' || k || ' ' || {_TITLE} || ' (me)'"))
def forge_merge_requests(spark, sf_dir):
    return _answer(spark, sf_dir, AN.merge_requests, _st(iid=_k(), title=_title(), state=_pick(3, F.lit("opened"), F.lit("merged"), F.lit("x")), author=_st(username="me")), None)


@query(_forge("Issues", f"'  ' || CASE WHEN k % 3 = 0 THEN '[open]' ELSE '[closed]' END || ' #' || k || ' ' || {_TITLE}"))
def forge_issues(spark, sf_dir):
    return _answer(spark, sf_dir, AN.issues, _st(number=_k(), title=_title(), state=F.when(_k() % 3 == 0, "OPEN").otherwise("CLOSED")), None)


@query(_forge("Issues", f"'  ' || CASE WHEN k % 3 = 0 THEN '[open]' ELSE '[closed]' END || ' #' || k || ' ' || {_TITLE}"))
def forge_merge_issues(spark, sf_dir):
    return _answer(spark, sf_dir, lambda x: AN.issues(x, "iid", "opened"), _st(iid=_k(), title=_title(), state=F.when(_k() % 3 == 0, "opened").otherwise("closed")), None)


@query(_forge("Pipelines", "'  ' || CASE k % 7 WHEN 0 THEN '[ok]' WHEN 1 THEN '[fail]' WHEN 2 THEN '[cancel]' WHEN 3 THEN '[run]' WHEN 4 THEN '[pend]' WHEN 5 THEN '[skip]' ELSE '?' END || ' #' || k || ' ' || CASE k % 7 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'canceled' WHEN 3 THEN 'running' WHEN 4 THEN 'pending' WHEN 5 THEN 'skipped' ELSE '???' END || ' (b' || k || ')'", 10))
def forge_pipelines(spark, sf_dir):
    status = _pick(7, *[F.lit(s) for s in ("success", "failed", "canceled", "running", "pending", "skipped", "")])
    return _answer(spark, sf_dir, AN.pipelines, _st(id=_k(), status=status, ref=_s("b", _k())), None)


@query(_sql("list('  ' || CASE k % 5 WHEN 0 THEN '[ok]' WHEN 1 THEN '[FAIL]' WHEN 2 THEN '[X]' WHEN 3 THEN '[time]' ELSE '[pending]' END || ' w' || k || ' [' || k || ']' ORDER BY k) AS l", f"'Workflow Runs' || {NL} || array_to_string(l, {NL}) || {NL}"))
def forge_runs(spark, sf_dir):
    item = _st(databaseId=_k(), name=_s("w", _k()), status=_pick(5, F.lit("done"), F.lit("done"), F.lit("done"), F.lit("in_progress"), F.lit("queued")), conclusion=_pick(5, F.lit("success"), F.lit("failure"), F.lit("cancelled"), F.lit(None).cast("string"), F.lit("")))
    return _answer(spark, sf_dir, AN.runs, item, None)


@query(_each(
    f"'[open] PR #' || k || ': t' || k || {NL} || '  me' || {NL} || '  OPEN | ' || CASE k % 3 WHEN 0 THEN '[ok]' WHEN 1 THEN '[x]' ELSE '?' END || {NL} || CASE WHEN k % 2 = 0 THEN '  Reviews: 1 approved, 1 changes requested' || {NL} ELSE '' END || '  Checks: 1/3 passed' || {NL} || '  [warn] 1 checks failed' || {NL} || '  u' || k || {NL} || "
    f"CASE k % 3 WHEN 0 THEN {NL} || '  Body ' || k || {NL} WHEN 1 THEN {NL} || '  (body contained only badges/images/comments)' || {NL} ELSE '' END"))  # fmt: skip
def forge_pull_request(spark, sf_dir):
    reviews = _st(nodes=F.when(_k() % 2 == 0, F.array(_st(state="APPROVED"), _st(state="CHANGES_REQUESTED"), _st(state="COMMENTED"))))
    checks = F.array(_st(conclusion="SUCCESS", state=F.lit(None).cast("string")), _st(conclusion=F.lit(None).cast("string"), state="FAILURE"), _st(conclusion="NEUTRAL", state=""))
    pr = _st(number=_k(), title=_s("t", _k()), state="OPEN", author=_st(login="me"), url=_s("u", _k()), mergeable=_pick(3, F.lit("MERGEABLE"), F.lit("CONFLICTING"), F.lit("UNKNOWN")), reviews=reviews, statusCheckRollup=checks, body=_pick(3, _s("Body ", _k()), F.lit("<!-- only -->"), F.lit("")))
    return _rows(spark, sf_dir, AN.pull_request(F.to_json(pr)))


@query(_sql("list('  #' || k || ' t' || k || ' [' || CASE WHEN k % 2 = 0 THEN 'PENDING' ELSE 'APPROVED' END || ']' || CASE WHEN k % 3 = 0 THEN ' checks 1/2 fail 1' ELSE '' END ORDER BY k) AS l", f"'Your PRs (' || len(l) || '):' || {NL} || array_to_string(l[1:5], {NL}) || {NL}"))
def forge_pull_request_status(spark, sf_dir):
    checks = F.when(_k() % 3 == 0, F.array(_st(conclusion="SUCCESS"), _st(conclusion="FAILURE")))
    return _answer(spark, sf_dir, AN.pull_request_status, _st(number=_k(), title=_s("t", _k()), reviewDecision=_odd(F.lit("APPROVED")), statusCheckRollup=checks), "createdBy")


_ISSUE_SQL = f"CASE WHEN k % 2 = 0 THEN '[open]' ELSE '[closed]' END || ' Issue #' || k || ': t' || k || {NL} || '  Author: @me' || {NL} || '  Status: ' || CASE WHEN k % 2 = 0 THEN '#' ELSE 'x' END || {NL} || '  URL: u' || {NL} || CASE k % 3 WHEN 0 THEN {NL} || '  Description:' || {NL} || '    About ' || k || {NL} WHEN 1 THEN "


@query(_each(_ISSUE_SQL.replace("#'", "OPEN'", 2).replace("Issue OPEN'", "Issue #'") + f"{NL} || '  Description: (body contained only badges/images/comments)' || {NL} ELSE '' END"))
def forge_issue(spark, sf_dir):
    i = _st(number=_k(), title=_s("t", _k()), state=F.when(_k() % 2 == 0, "OPEN").otherwise("x"), author=_st(login="me"), url="u", body=_pick(3, _s("About ", _k()), F.lit("<!-- x -->"), F.lit("")))
    return _rows(spark, sf_dir, AN.issue(F.to_json(i)))


@query(_each(_ISSUE_SQL.replace("#'", "opened'", 2).replace("Issue opened'", "Issue #'") + "'' ELSE '' END"))
def forge_merge_issue(spark, sf_dir):
    i = _st(iid=_k(), title=_s("t", _k()), state=F.when(_k() % 2 == 0, "opened").otherwise("x"), author=_st(username="me"), web_url="u", description=_pick(3, _s("About ", _k()), F.lit("<!-- x -->"), F.lit("")))
    return _rows(spark, sf_dir, AN.merge_issue(F.to_json(i)))


@query(_each(
    f"'[open] MR !' || k || ': t' || k || {NL} || '  me' || {NL} || '  opened | ' || CASE k % 3 WHEN 0 THEN '[ok]' WHEN 1 THEN '[conflict]' ELSE '[?]' END || {NL} || '  a -> b' || {NL} || CASE WHEN k % 2 = 0 THEN '  Labels: x, l' || k || {NL} || '  Reviewers: @r' || k || {NL} ELSE '' END || "
    f"CASE WHEN k % 3 = 0 THEN '  Pipeline: [ok] success' || {NL} ELSE '' END || '  u' || {NL} || CASE WHEN k % 3 = 1 THEN {NL} || '  Why ' || k || {NL} ELSE '' END"))  # fmt: skip
def forge_merge_request(spark, sf_dir):
    m = _st(
        iid=_k(), title=_s("t", _k()), state="opened", author=_st(username="me"), web_url="u", merge_status=_pick(3, F.lit("can_be_merged"), F.lit("cannot_be_merged"), F.lit("checking")), source_branch="a", target_branch="b",
        labels=F.when(_k() % 2 == 0, F.array(F.lit("x"), _s("l", _k()))), reviewers=F.when(_k() % 2 == 0, F.array(_st(username=_s("r", _k())), _st(username=""))), head_pipeline=F.when(_k() % 3 == 0, _st(status="success")), description=F.when(_k() % 3 == 1, _s("Why ", _k())))
    return _rows(spark, sf_dir, AN.merge_request(F.to_json(m)))


@query(_each(f"'me/r' || k || {NL} || '  ' || CASE WHEN k % 2 = 0 THEN '[public]' ELSE '[private]' END || {NL} || CASE WHEN k % 3 = 0 THEN '' ELSE '  about' || {NL} END || '  ' || k || ' stars | 0 forks' || {NL} || '  u' || {NL}"))
def forge_repository(spark, sf_dir):
    r = _st(name=_s("r", _k()), owner=_st(login="me"), description=_odd(F.lit("about"), 3), url="u", stargazerCount=_k(), isPrivate=_k() % 2 == 1)
    return _rows(spark, sf_dir, AN.repository(F.to_json(r)))


@query(_sql("list('  [FAIL] job ' || k || ' fail' ORDER BY k) FILTER (k % 3 = 0) AS f", f"'Workflow Run #7' || {NL} || '  Status: done' || {NL} || array_to_string(f, {NL}) || {NL}"))
def forge_run_view(spark, sf_dir):
    return _report(spark, sf_dir, lambda x: AN.run_view(x, F.lit("7")), F.when(_k() % 3 == 0, _s("  job ", _k(), " fail")).otherwise("✓ job"), "x fail\n Status: done\nJOBS\n")


@query(_sql("list(CASE k % 6 WHEN 0 THEN '[ok] (' || k || ') passed' WHEN 1 THEN '[fail] failed' WHEN 2 THEN '[run] running' WHEN 3 THEN '[pend] pending' WHEN 4 THEN '[cancel] cancelled' ELSE '  other' END ORDER BY k) AS l", f"array_to_string(l, {NL}) || {NL}"))
def forge_pipeline_status(spark, sf_dir):
    return _report(spark, sf_dir, AN.pipeline_status, _pick(6, _s("(", _k(), ") passed"), F.lit(" failed"), F.lit("running"), F.lit("pending\n"), F.lit("cancelled"), F.lit("other")))


@query(_sql("list('step ' || k ORDER BY k) FILTER (k % 3 = 0) AS l", f"array_to_string(l, {NL}) || {NL}"))
def forge_job_trace(spark, sf_dir):
    return _report(spark, sf_dir, AN.job_trace, _pick(3, _s("\x1b[32;1m step ", _k(), "\x1b[0m"), _s("Fetching changes with git ", _k()), _s("section_start:", _k(), ":prep_x\x1b[0K")))


@query(_sql("list(CASE WHEN k % 2 = 0 THEN '  v' || k || ' (today)' ELSE '  n' || k || ' [v' || k || '] (today)' END ORDER BY k) AS l", f"'Releases' || {NL} || array_to_string(l[1:20], {NL}) || {NL}"))
def forge_releases(spark, sf_dir):
    return _report(spark, sf_dir, AN.releases, _s(F.when(_k() % 2 == 0, "v").otherwise("n"), _k(), "\tv", _k(), "\ttoday"), "Showing releases\n\nName\tTag\tCreated\n")


@query(_sql(f"list('line ' || k || CASE WHEN k % 3 = 0 THEN {NL} ELSE '' END ORDER BY k) FILTER (k % 3 <= 1) AS l", f"array_to_string(l, {NL}) || {NL} || 'end' || {NL}"))
def forge_release(spark, sf_dir):
    return _report(spark, sf_dir, AN.release, _pick(3, _s("line ", _k(), "\n\n\n"), _s("line ", _k()), F.lit("![a](b)\nImage: x → y\n<!-- z -->\n-----")), "", "\nSOURCES\nhttps://x\nhttp://y\nend")
