"""What the reports leave of verbose output, against the floors that are known: bytes over four, or words by white space."""

import json

import pytest
from pyspark.sql import functions as F

from sieveline.functions import json_shape as JS
from sieveline.functions import text as T
from sieveline.operators import answers as AN
from sieveline.operators import cloud as CL
from sieveline.operators import linters as LN
from sieveline.operators import listings as LI
from sieveline.operators import reading as RD
from sieveline.operators import runners as RU
from sieveline.operators import tools as TO
from sieveline.plans import named


def many(n, line):
    return "".join(line.replace("#", str(k)) + "\n" for k in range(n))


def answer(name, item, n=30):
    return json.dumps({name: [json.loads(json.dumps(item).replace("#", str(k))) for k in range(n)]})


FRAMES = "\tat org.junit.Assert.fail(Assert.java:88)\n\tat java.base/x.Y.run(Y.java:1)\n" * 8
CLOSE = "Tests run: 3, Failures: #, Errors: 0, Skipped: 0, Time elapsed: 0.1 s"
MVN = many(60, "[INFO] Running a.b.T#\nnoise of a test that passes and says a lot about it\n[INFO] " + CLOSE.replace("#", "0") + " -- in a.b.T#")
MVN_FAIL = MVN + "[INFO] Running a.b.F\n[ERROR] " + CLOSE.replace("#", "1") + " <<< FAILURE! -- in a.b.F\n[ERROR] a.b.F.x -- Time elapsed: 0 s <<< FAILURE!\njava.lang.E: m\n" + FRAMES + "\tat a.b.F.x\n\n[INFO] Results:\n[ERROR] Tests run: 183, Failures: 1, Errors: 0, Skipped: 0\n[INFO] BUILD FAILURE\n"
TAGS = {"Tags": [{"Key": "Name", "Value": "web"}, {"Key": "env", "Value": "prod"}], "NetworkInterfaces": [{"Description": "a primary interface", "MacAddress": "0a:1b:2c:3d:4e:5f", "Attachment": {"AttachTime": "2024-01-01T00:00:00Z", "DeleteOnTermination": True}}], "MetadataOptions": {"HttpTokens": "optional", "State": "applied", "HttpEndpoint": "enabled"}, "Placement": {"AvailabilityZone": "eu-1a", "Tenancy": "default"}}
ISSUE = {"iid": 1, "number": 1, "title": "t #", "state": "opened", "author": {"username": "me", "avatar_url": "https://x/" + "a" * 80}, "web_url": "https://x/y/z/#", "created_at": "2024-01-01T00:00:00Z", "labels": ["a", "b"], "description": "words " * 30}
RSPEC = "Randomized with seed 1\n" + "." * 400 + "\n"

#: number in the table of floors: (report, output, floor, bytes or words)
CASES = {
    1: (AN.instances, json.dumps({"Reservations": [{"Instances": [{"InstanceId": f"i-{k}", "InstanceType": "t3", "State": {"Name": "running", "Code": 16}, **TAGS} for k in range(10)]}]}), 60, "bytes"),
    2: (AN.identity, '{\n    "UserId": "AIDAEXAMPLEUSERID1234",\n    "Account": "123456789012",\n    "Arn": "arn:aws:iam::123456789012:user/me"\n}\n', 50, "bytes"),
    4: (AN.stack_events, answer("StackEvents", {"StackId": "arn:x/y", "EventId": "#", "ResourceStatus": "CREATE_COMPLETE", "LogicalResourceId": "L#", "ResourceType": "AWS::S3::Bucket", "Timestamp": "2024-01-01T00:00:00Z"}), 40, "bytes"),
    5: (AN.functions, answer("Functions", {"FunctionName": "f#", "FunctionArn": "arn:aws:lambda:eu:1:function:f#", "Runtime": "python3.12", "Role": "arn:aws:iam::1:role/r", "CodeSha256": "a" * 44, "MemorySize": 128, "Timeout": 3, "Environment": {"Variables": {"A": "b" * 40}}}), 60, "bytes"),
    6: (AN.roles, answer("Roles", {"Path": "/", "RoleName": "r#", "RoleId": "AROA" + "X" * 17, "Arn": "arn:aws:iam::1:role/r#", "CreateDate": "2024-01-01T00:00:00Z", "AssumeRolePolicyDocument": {"Version": "2012-10-17", "Statement": [{"Effect": "Allow", "Principal": {"Service": "ec2.amazonaws.com"}, "Action": "sts:AssumeRole"}]}, "MaxSessionDuration": 3600}), 60, "bytes"),
    8: (AN.security_groups, answer("SecurityGroups", {"Description": "a group of the web servers", "GroupName": "g#", "OwnerId": "1", "GroupId": "sg-#", "VpcId": "vpc-1", "IpPermissions": [{"FromPort": 443, "IpProtocol": "tcp", "IpRanges": [{"CidrIp": "0.0.0.0/0", "Description": "all the world"}], "Ipv6Ranges": [], "PrefixListIds": [], "ToPort": 443, "UserIdGroupPairs": []}], "IpPermissionsEgress": [], "Tags": [{"Key": "a", "Value": "b"}]}), 60, "bytes"),
    10: (RD.markdown_body, "# T\n" + many(20, "<!-- a comment of the template that says what to write here, number # -->\n![badge](https://x/#.svg)\n---\n") + "text that stays", 30, "words"),
    12: (TO.push_report, many(20, "Enumerating objects: #, done.\nCounting objects: 100% (5/5), done.\nCompressing objects: 100% (3/3), done.\nWriting objects: 100% (3/3), 400 bytes, done.") + "To x\n   a..b  main -> main\n", 60, "words"),
    13: (AN.merge_requests, json.dumps([ISSUE] * 10), 60, "bytes"),
    14: (lambda x: AN.issues(x, "iid", "opened"), json.dumps([ISSUE] * 10), 60, "bytes"),
    15: (AN.releases, "Showing 30 releases on the project\n\nName\tTag\tCreated\n" + many(30, "v1.#\tv1.#\tabout 3 days ago"), 20, "bytes"),
    16: (AN.job_trace, many(5, "\x1b[0KRunning with gitlab-runner 17\nPreparing the \"docker\" executor\nUsing Docker executor with image x\nFetching changes with git depth set to 20\nChecking out abc as main\nsection_start:1:get_sources\x1b[0K") + "$ make\nok\n", 30, "bytes"),
    17: (AN.release, "v1\n" + many(6, "![image #](https://x/uploads/a/long/path/#.png)\n<!-- c # -->\n--------") + "text\nSOURCES\nhttps://x/a.zip\nhttps://x/a.tar.gz\n", 20, "bytes"),
    19: (RD.gradle_build, many(80, "> Task :app:step#") + "\nBUILD SUCCESSFUL in 3s\n80 actionable tasks: 80 executed\n", 70, "words"),
    20: (RD.gradle_build, many(40, "> Configure project :p#\n> Task :p#:dokkaHtml\n") + "BUILD SUCCESSFUL in 3s\n", 60, "words"),
    22: (RU.gradle_test, many(60, "A > test number # works PASSED") + "A > x FAILED\n    java.lang.E: m\n        at a.B.c(B.java:3)\n61 tests completed, 1 failed\n", 60, "words"),
    23: (RU.gradle_dependencies, "compileClasspath - Compile classpath for source set 'main'.\n" + many(5, "+--- g:a#:1\n|    +--- g:b:1\n|    |    +--- g:c:1 -> 2 (*)\n|    |    \\--- g:d:1 -> 2 (*)\n|    \\--- g:e:1 (*)"), 60, "words"),
    26: (RU.gradle_lint, many(40, "> Task :app:lintDebug#\n   an explanation of what lint does, which nobody reads") + "/a/B.java:3: Error: bad [Id]\n   code\n2 errors, 0 warnings\n", 60, "words"),
    27: (TO.stack_log, many(60, "◉ branch-# me@x.org a few words about what was changed here"), 60, "words"),
    28: (TO.stack_submit, many(20, "Validating that this stack is ready to submit and that nothing is in the way, step #") + "Pushed branch a\nCreated pull request #3 for a: https://x/3\n", 60, "words"),
    29: (TO.stack_sync, many(20, "Pulling main from remote and looking at what has been merged since, step #") + "Synced with remote\nDeleted branch old\n", 60, "words"),
    30: (TO.stack_create, many(10, "Checking the working tree and the stack for what is needed, step #") + "Created branch feat/x\n", 60, "words"),
    31: (TO.stack_restack, many(20, "Restacked branch b# on main without any conflicts at all"), 60, "words"),
    32: (RU.mvn_tests, MVN + "[INFO] Results:\n[INFO] Tests run: 180, Failures: 0, Errors: 0, Skipped: 0\n[INFO] BUILD SUCCESS\n", 50, "words"),
    33: (RU.mvn_tests, MVN_FAIL, 30, "words"),
    35: (RU.mvn_compile, many(40, "[INFO] Copying # resources from a to b\n[WARNING] /a/B.java:[#,1] deprecated API is in use here") + "[ERROR] /a/C.java:[1,1] bad\n[INFO] BUILD FAILURE\n", 30, "words"),
    36: (lambda x: RU.mvn_tests(x, True), MVN + many(20, "[INFO] Nothing to do in step # of this plugin at all") + "[INFO] Building jar: /a/t.jar\n[INFO] BUILD SUCCESS\n", 50, "words"),
    37: (RU.mvn_tests, MVN * 5 + "[INFO] BUILD SUCCESS\n", 90, "words"),
    38: (lambda x: RU.mvn_tests(x, True), MVN * 5 + "[INFO] Installing a to b\n[INFO] BUILD SUCCESS\n", 85, "words"),
    39: (RU.mvn_quiet, "[ERROR] a.b.F.x -- Time elapsed: 0 s <<< FAILURE!\njava.lang.E: m\n" + FRAMES * 4 + "\tat a.b.F.x\n\n" + many(6, "[ERROR] For more information about the errors and solutions, see #\n[ERROR] See /x/dump#"), 50, "words"),
    40: (lambda x: named.apply_named("grep", x), many(300, "src/a.py:#:    some matched line of code with a few words"), 40, "words"),
    41: (lambda x: named.apply_named("find", x), many(400, "src/dir/file#.py"), 40, "words"),
    42: (TO.psql_report, " id | name | about\n----+------+------\n" + many(80, " # | n# | a few words") + "(80 rows)\n", 40, "words"),
    43: (TO.psql_report, many(60, "-[ RECORD # ]-----\nid | #\nname | n\nabout | some words"), 60, "words"),
    44: (RU.minitest_report, "Run options: --seed 1\n\n# Running:\n\n" + many(30, ". . . . . . .") + "\nFinished in 0.1s\n\n210 runs, 300 assertions, 0 failures, 0 errors, 0 skips\n", 80, "words"),
    47: (RU.rspec_text, RSPEC + "Failures:\n\n  1) A does\n     Failure/Error: x\n" + many(12, "     # /usr/lib/gems/rspec-core/lib/rspec/core/example.rb:#:in `run'") + "     # ./spec/a_spec.rb:3\n\n3 examples, 1 failure\n".replace("1 failure", "1 failures"), 30, "bytes"),
    7: (JS.items_report, json.dumps({"Items": [{"id": {"S": f"user-{i}"}, "age": {"N": str(i)}, "on": {"BOOL": True}, "tags": {"L": [{"S": "a"}, {"S": "b"}]}} for i in range(15)], "Count": 15, "ScannedCount": 15}, indent=2), 30, "bytes"),
    9: (LN.pods_report, json.dumps({"items": [{"metadata": {"name": f"p{i}", "namespace": "n", "labels": {"app": "x"}}, "status": {"phase": "Running", "containerStatuses": [{"restartCount": 0, "state": {"running": {"startedAt": "x"}}}]}} for i in range(10)]}, indent=1), 60, "words"),
    18: (lambda x: LN.golangci_report(x, 2), json.dumps({"Issues": [{"FromLinter": "errcheck", "Text": "Error return value is not checked", "SourceLines": ["\tf()"], "Pos": {"Filename": "a.go", "Line": i, "Column": 1}} for i in range(20)]}, indent=1), 60, "words"),
    45: (LN.rspec_report, json.dumps({"examples": [{"id": f"./s.rb[{i}]", "full_description": f"A does {i}", "status": "passed", "file_path": "./s.rb", "line_number": i, "run_time": 0.01} for i in range(20)], "summary": {"duration": 0.2, "example_count": 20, "failure_count": 0, "pending_count": 0, "errors_outside_of_examples_count": 0}}), 60, "bytes"),
    46: (LN.rspec_report, json.dumps({"examples": [{"id": f"./s.rb[{i}]", "full_description": f"A does {i}", "status": "failed" if i < 2 else "passed", "file_path": "./s.rb", "line_number": i, "exception": {"class": "A::E", "message": "expected 1", "backtrace": ["/gems/x.rb:1"] * 8 + ["./s.rb:2"]} if i < 2 else None} for i in range(12)], "summary": {"duration": 0.2, "example_count": 12, "failure_count": 2, "pending_count": 0, "errors_outside_of_examples_count": 0}}), 60, "bytes"),
    48: (LN.rubocop_report, json.dumps({"files": [{"path": f"app/models/m{i}.rb", "offenses": [{"severity": "convention", "message": f"Line is too long in place {i}.{j}", "cop_name": "Layout/LineLength", "correctable": True, "location": {"start_line": j, "start_column": 1, "last_line": j, "last_column": 99, "length": 99}} for j in range(8)]} for i in range(12)], "summary": {"offense_count": 96, "inspected_file_count": 12}}), 60, "bytes"),
    49: (LN.ruff_report, json.dumps([{"code": "F401", "message": f"`os{i}` imported but unused and never read again", "filename": "/w/src/a.py", "location": {"row": i, "column": 1}, "end_location": {"row": i, "column": 9}, "url": "x", "fix": {"applicability": "safe", "message": "Remove unused import of this name here", "edits": [{"content": "", "location": {"row": i, "column": 1}}]}} for i in range(1, 81)], indent=1), 60, "words"),
}


@pytest.mark.parametrize("number", sorted(CASES))
def test_savings_reach_their_floor(spark, number):
    report, output, floor, unit = CASES[number]
    got = spark.createDataFrame([(output,)], "t string").select(report(F.col("t")).alias("out"), T.est_tokens("t").alias("raw"), T.est_tokens(report(F.col("t"))).alias("kept")).first()
    assert got.out and got.out != output
    raw, kept = (got.raw, got.kept) if unit == "bytes" else (len(output.split()), len(got.out.split()))
    assert 100 - 100 * kept / raw >= floor, (number, raw, kept, got.out[:300])


GRADLE = many(60, "> Task :app:compile#Kotlin UP-TO-DATE") + many(20, "> Configure project :m#")
MODULES = "".join(f"[INFO] m{k} .................. {state} [  1.0 s]\n" for k, state in enumerate(("SUCCESS", "FAILURE", "SKIPPED")))
LATER = {
    21: (RD.gradle_build, GRADLE + "\nBUILD SUCCESSFUL in 12s\n40 actionable tasks: 3 executed\n", 70),
    24: (RD.gradle_build, GRADLE + "e: /src/A.kt: (3, 5): Unresolved reference: x\n\nFAILURE: Build failed with an exception.\n\n* What went wrong:\nExecution failed for task ':app:compileKotlin'.\n\n* Try:\n> Run with --stacktrace option.\n\nBUILD FAILED in 3s\n", 70),
    25: (RU.gradle_test, GRADLE + many(30, "com.a.B# > works PASSED") + "com.a.C > breaks FAILED\n    java.lang.AssertionError: expected 1\n        at org.junit.Assert.fail(Assert.java:88)\n        at com.a.C.breaks(C.kt:9)\n31 tests completed, 1 failed\nBUILD FAILED in 3s\n", 60),
    34: (RU.mvn_tests, MVN_FAIL + "[INFO] Reactor Summary for parent 1.0:\n[INFO] \n" + MODULES + "[INFO] BUILD FAILURE\n", 30),
}


@pytest.mark.parametrize("number", sorted(LATER))
def test_builds_save_words(spark, number):
    report, output, floor = LATER[number]
    got = spark.createDataFrame([(output,)], "t string").select(report(F.col("t")).alias("out")).first().out
    assert got and 100 - 100 * len(got.split()) / len(output.split()) >= floor, got[:500]
    assert all(word in got for word in {21: ["BUILD SUCCESSFUL"], 24: ["Unresolved reference", "BUILD FAILED"], 25: ["breaks FAILED", "expected 1", "C.kt:9"], 34: ["Reactor Summary", "m1 ", "FAILURE"]}[number])


def test_log_events_save_tokens(spark):
    raw = json.dumps({"events": [{"timestamp": 1_700_000_000_000 + 1000 * i, "message": f"request {i} served in time", "ingestionTime": 1_700_000_000_500 + 1000 * i} for i in range(20)], "nextForwardToken": "f/3"})
    rows = CL.log_events(spark.createDataFrame([(1, raw)], "id int, text string")).orderBy("clock").collect()
    out = "\n".join(f"{r.clock} {r.message}" for r in rows)
    assert len(rows) == 20 and 1 - (len(out.encode()) // 4) / (len(raw.encode()) // 4) >= 0.15


def test_pod_report_saves_words(spark):
    pod = {"metadata": {"namespace": "n", "name": "p", "labels": {"a": "b"}, "annotations": {"c": "d e f"}}, "status": {"phase": "Running", "containerStatuses": [{"restartCount": 0, "state": {"running": {"startedAt": "x"}}}], "conditions": [{"type": "Ready", "status": "True"}] * 4}}
    raw = json.dumps({"items": [pod] * 20}, indent=1)
    r = LI.pod_report(LI.pods(spark.createDataFrame([(1, raw)], "id int, text string"))).first()
    assert r.pods == 20 and len(" ".join(map(str, r)).split()) < 0.4 * len(raw.split())
