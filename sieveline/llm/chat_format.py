"""Tool-call linking for chat transcripts, in DataFrame operations only.

Calls and results are hash-joined by conversation and identifier. Arguments are parsed and checked
against the schema of their tool. Messages are put into an order in which every call comes after what it
depends on and every result after its call: where all of a conversation's edges point forward that
is the order as written, and only conversations with an edge that points back are sorted by levels, a
round per level, over tables. Records are serialised as canonical JSON: keys sorted, no spaces.
Positions are counted in buckets whose sizes are summed first, so that a conversation that holds a third
of all messages is spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, scratch

#: A tool's schema: field -> (type, required); types as in JSON schema.
Schema = dict[str, tuple[str, bool]]
_VARIANT_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def argument_errors(tool: Column, arguments: Column, tools: dict[str, Schema]) -> Column:
    """A sorted array of what is wrong with a call's arguments (JSON text); empty if they are valid."""
    parsed = F.try_parse_json(arguments)
    whole = F.schema_of_variant(parsed)
    checks = [F.when(~F.coalesce(tool.isin(*tools), F.lit(False)), F.lit("unknown tool")), F.when(parsed.isNull(), F.lit("not JSON")).when(~whole.startswith("OBJECT"), F.lit("not an object"))]
    for name, schema in sorted(tools.items()):
        for field, (kind, required) in sorted(schema.items()):
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            got = F.schema_of_variant(value)
            good = reduce(lambda a, t: a | got.startswith(t), _VARIANT_TYPES[kind], F.lit(False))
            missing = value.isNull() | got.isin("VOID")
            wrong = F.when(missing, F.lit(f"missing {field}") if required else F.lit(None)).when(~good, F.lit(f"{field} is no {kind}"))
            checks.append(F.when((tool == name) & whole.startswith("OBJECT"), wrong))
    return F.array_sort(F.array_compact(F.array(*checks)))


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and without spaces; null where the text isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def ranks(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """Adds the position (from 0) among the rows of the same keys by (bucket, order): a bucket's rows are numbered in one task, a key's buckets summed."""
    dealt = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(lambda a, c: a & c, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_bucket"]])
    starts = cut(dealt.groupBy(*keys, "_bucket").count().select(*keys, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    return own.alias("l").join(starts.alias("r"), same).select("l.*", (F.col("_before") + F.col("_own") - 1).alias(name)).drop("_bucket", "_own")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) of messages that need sorting: 0 without open parents, else one more than the last parent; null on a cycle.

    nodes: (node); edges: (parent, node). Nodes are numbers of messages, so null conversations need no care here. A round per level.
    """
    open_, done, level = cut(nodes.select("node").distinct()), [], 0
    edges = cut(edges.select("parent", "node").distinct())
    while True:
        waits = edges.join(open_.select(F.col("node").alias("parent")), "parent", "left_semi").select("node").distinct()
        ready = cut(open_.join(waits, "node", "left_anti").withColumn("level", F.lit(level)))
        if not ready.limit(1).count():
            return reduce(DataFrame.unionByName, [*done, open_.withColumn("level", F.lit(None).cast("int"))])
        done.append(ready)
        left = cut(open_.join(ready, "node", "left_anti"))
        discard(open_)
        open_, level = left, level + 1


#: Messages of a conversation that is sorted in one row.
SHORT = 200


def levels_in_row(conversations: DataFrame) -> DataFrame:
    """The same for conversations of at most ``SHORT`` messages: (nodes, edges), sorted arrays of numbers and of (parent, node), to (node, level)."""
    # levels rise from those of the parents, as many times as there are messages at most; what rises beyond is on a cycle or behind one
    nodes, edges = F.col("nodes"), F.col("edges")
    start = F.transform(nodes, lambda n: F.struct(n.alias("node"), F.lit(0).alias("level")))

    def risen(at: Column, _: Column) -> Column:
        up = F.map_from_arrays(F.transform(at, lambda x: x["node"]), F.transform(at, lambda x: x["level"]))
        last = lambda n: F.array_max(F.transform(F.filter(edges, lambda e: e["node"] == n), lambda e: F.try_element_at(up, e["parent"]) + 1))
        return F.transform(at, lambda x: F.struct(x["node"].alias("node"), F.coalesce(last(x["node"]), F.lit(0)).alias("level")))

    steps = F.aggregate(F.sequence(F.lit(1), F.size(nodes)), start, risen)
    placed = conversations.select(F.size("nodes").alias("n"), F.explode(steps).alias("x"))
    return placed.select("x.node", F.when(F.col("x.level") < F.col("n"), F.col("x.level")).alias("level"))


def sorted_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) for nodes (key, node) and edges (key, parent, node): short conversations in one row each, long ones in rounds over tables."""
    sizes = cut(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    long, short = (sizes.where(x).select("key") for x in (f"n > {SHORT}", f"n <= {SHORT}"))
    # at most SHORT messages a key, so the arrays are bounded; edges are distinct pairs of them
    few = nodes.join(short, "key").groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    pairs = edges.join(short, "key").groupBy("key").agg(F.collect_set(F.struct("parent", "node")).alias("edges"))
    out = levels_in_row(few.join(pairs, "key"))
    if not long.limit(1).count():
        return out
    return out.unionByName(levels(nodes.join(long, "key"), edges.join(long, "key")))


def link(messages: DataFrame, tools: dict[str, Schema], bucket_width: int = 64) -> DataFrame:
    """messages: (conv, pos, kind, id, tool, payload, after), with kind call, result or message; ``after`` lists the ids a call depends on.

    Gives one row per message: conv, pos, order_no (topological, from 0), kind, id, tool, status, errors,
    record (canonical JSON). Status: linked, call_without_result, result_without_call, duplicate_id (a
    call whose id an earlier call of the conversation has), cycle, or message. Where several results
    have one id, the last links and the others are superseded. Null conversations make one conversation;
    null ids link with nothing. Rows that repeat are kept and ordered next to each other. Payloads of any length are
    parsed whole; extra columns are ignored. An empty table gives no rows.
    """
    with scratch(messages.sparkSession) as keep:
        return _linked(messages, tools, bucket_width, keep)


def _linked(messages: DataFrame, tools: dict[str, Schema], bucket_width: int, keep) -> DataFrame:
    m = messages.withColumn("uid", F.monotonically_increasing_id())
    m = cut(m)
    calls, results = m.where("kind = 'call' AND id IS NOT NULL"), m.where("kind = 'result' AND id IS NOT NULL")
    first = calls.groupBy("conv", "id").agg(F.min(F.struct("pos", "uid")).alias("f")).select("conv", "id", F.col("f.pos").alias("call_pos"), F.col("f.uid").alias("call_uid"))
    last = results.groupBy("conv", "id").agg(F.max(F.struct("pos", "uid")).alias("f")).select("conv", "id", F.col("f.pos").alias("result_pos"), F.col("f.uid").alias("result_uid"))
    both = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.id") == F.col(f"{b}.id"))
    known = cut(
        first.alias("a").join(last.alias("b"), both("a", "b"), "full")
        .select(F.coalesce("a.conv", "b.conv").alias("conv"), F.coalesce("a.id", "b.id").alias("id"), "call_pos", "call_uid", "result_pos", "result_uid")
    )
    seen = m.alias("m").join(known.alias("k"), both("m", "k"), "left").select("m.*", "call_pos", "call_uid", "result_pos", "result_uid")
    status = (
        F.when(F.col("kind") == "call", F.when((F.col("uid") != F.col("call_uid")) & F.col("id").isNotNull(), "duplicate_id").when(F.col("result_uid").isNotNull(), "linked").otherwise("call_without_result"))
        .when(F.col("kind") == "result", F.when(F.col("call_uid").isNull(), "result_without_call").when(F.col("uid") != F.col("result_uid"), "superseded").otherwise("linked"))
        .otherwise("message")
    )
    seen = cut(seen.withColumn("status", status))
    # edges by id; those that point back name the conversations to sort
    of_call = seen.where("kind = 'result' AND call_uid IS NOT NULL").select("conv", F.col("call_uid").alias("parent"), F.col("uid").alias("node"), F.col("call_pos").alias("from"), F.col("pos").alias("to"))
    asks = seen.where("kind = 'call'").select("conv", "uid", "pos", F.explode("after").alias("id"))
    of_after = asks.alias("a").join(known.alias("k"), both("a", "k")).select(
        "a.conv", F.coalesce("result_uid", "call_uid").alias("parent"), F.col("uid").alias("node"), F.coalesce("result_pos", "call_pos").alias("from"), F.col("pos").alias("to"))
    edges = cut(of_call.unionByName(of_after).where("parent IS NOT NULL"))
    odd = cut(edges.where(F.coalesce(F.col("from") >= F.col("to"), F.lit(False))).select("conv").distinct())
    if odd.limit(1).count():
        key = lambda df: df.select(F.struct(F.col("conv").isNull().alias("none"), "conv").alias("key"), "*")
        in_odd = lambda df: key(df).join(key(odd).select("key"), "key", "left_semi")
        sorted_ = cut(sorted_levels(in_odd(seen.select("conv", F.col("uid").alias("node"))), in_odd(edges.select("conv", "parent", "node"))))
        seen = seen.join(sorted_.select(F.col("node").alias("uid"), "level", F.lit(True).alias("was_odd")), "uid", "left")
        seen = seen.withColumn("status", F.when(F.col("was_odd") & F.col("level").isNull(), "cycle").otherwise(F.col("status"))).withColumn("level", F.when(F.col("was_odd"), F.coalesce("level", F.lit(1 << 30))).otherwise(0)).drop("was_odd")
        seen = cut(seen)
    else:
        seen = seen.withColumn("level", F.lit(0))
    bucket = F.struct("level", F.floor(F.coalesce(F.col("pos"), F.lit(-1)) / bucket_width).alias("b"))
    placed = ranks(seen, ["conv"], ["level", "pos", "uid"], bucket, "order_no")
    is_call = F.col("kind") == "call"
    errors = F.when(is_call, argument_errors(F.col("tool"), F.col("payload"), tools)).otherwise(F.array().cast("array<string>"))
    # variants keep their keys sorted, so the arguments stand in the record as JSON with sorted keys; what isn't JSON stands there raw
    arguments = F.when(is_call, F.coalesce(F.try_parse_json("payload"), F.to_variant_object(F.struct(F.col("payload").alias("raw")))))
    # fields in the order of their names, so that the text is canonical
    record = F.to_json(F.struct(
        arguments.alias("arguments"), F.when(~is_call, F.col("payload")).alias("content"), F.col("id"), F.col("kind"), F.col("status"), F.when(is_call, F.col("tool")).alias("tool"),
    ))
    return keep(cut(placed.select("conv", "pos", "order_no", "kind", "id", "tool", "status", F.array_join(errors, "; ").alias("errors"), record.alias("record"))))


#: The tool that conversations without explicit calls are read as: a turn of the user asks for a reply.
REPLY: dict[str, Schema] = {"reply": {"chars": ("integer", True), "text": ("string", True)}}


def from_turns(turns: DataFrame) -> DataFrame:
    """Conversation turns (conv_id, turn, role, text) as messages: a user's turn calls ``reply``, the assistant's next turn is its result, the rest are messages.

    The call's identifier is conv_id:turn; a result names the call of the turn before it.
    """
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    ident = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    payload = F.when(user, F.to_json(F.struct(F.char_length("text").alias("chars"), F.col("text")))).otherwise(F.col("text"))
    return turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("pos"), F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        F.when(known & user, ident(F.col("turn"))).when(known & assistant, ident(F.col("turn") - 1)).alias("id"),
        F.when(user, "reply").alias("tool"), payload.alias("payload"),
        F.when(user & known & (F.col("turn") >= 2), F.array(ident(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
