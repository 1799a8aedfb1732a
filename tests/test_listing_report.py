"""Long listings as short text."""

from pyspark.sql import functions as F

from sieveline.operators import listings as L

RAW = """total 48
drwxr-xr-x  2 me staff   64 Jan  1 12:00 .
drwxr-xr-x  2 me staff   64 Jan  1 12:00 ..
drwxr-xr-x  2 me staff   64 Jan  1 12:00 src
drwxr-xr-x  2 me staff   64 Jan  1 2024 node_modules
-rw-r--r--  1 me staff 1234 Jan  1 12:00 main file.rs
-rwsr-xr-t  1 me staff  5 Feb 28 12:00 run
-rw-r--r--@ 1 me staff 2097152 Mar 3 09:10 b.tar.gz
lrwxrwxrwx  1 me staff 7 Mar 3 09:10 link.rs -> main.rs
odd line
"""


def report(spark, raw, **k):
    return tuple(spark.range(1).select(L.ls_report(F.lit(raw), **k)).first()[0])


def test_listing(spark):
    entries = "src/\nmain file.rs  1.2K\nrun  5B\nb.tar.gz  2.0M\nlink.rs -> main.rs  7B\n"
    assert report(spark, RAW, noise=("node_modules",)) == (entries, "\nSummary: 4 files, 1 dirs (2 .rs, 1 .gz, 1 no ext)\n", 6)
    assert report(spark, RAW, noise=("node_modules",), show_all=True)[0].startswith("src/\nnode_modules/\n")
    assert report(spark, RAW, modes=True)[0] == "755  src/\n755  node_modules/\n644  main file.rs  1.2K\n5755  run  5B\n644  b.tar.gz  2.0M\n777  link.rs -> main.rs  7B\n"


def test_empty_and_unread(spark):
    assert report(spark, "") == ("(empty)\n", "", 0) == report(spark, "total 0\n") == report(spark, "drwx 2 me me 64 Jan 1 12:00 .\ndrwx 2 me me 64 Jan 1 12:00 ..\n")
    assert report(spark, "nothing of the kind\n") == ("", "", 0) and report(spark, "drwxr-xr-x 2 me staff 64 Jan 1 12:00 dist\n", noise=("dist",)) == ("(empty)\n", "", 0)


def test_many_extensions(spark):
    raw = "".join(f"-rw-r--r-- 1 me staff 1 Jan 1 12:00 f{i}.e{i % 7}\n" for i in range(9))
    assert report(spark, raw)[1] == "\nSummary: 9 files, 0 dirs (2 .e0, 2 .e1, 1 .e2, 1 .e3, 1 .e4, +2 more)\n"
