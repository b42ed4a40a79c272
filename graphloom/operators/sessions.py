"""Analytics over session logs: pairs of requests and responses, steps, counts, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_TS = (1 << 63) - 1
#: The error code of an unknown method.
METHOD_NOT_FOUND = "-32601"


def pair_requests(messages: DataFrame) -> DataFrame:
    """Requests (sender, id, method, pos, ts_ms) with the other side's first response of that id, or nulls. Ids are
    compared as JSON text."""
    answers = messages.where("kind = 'response'").groupBy("sender", "id").agg(F.min(F.struct("pos", "ts_ms", "body")).alias("r"))
    answers = answers.select(F.col("sender").alias("answerer"), F.col("id").alias("rid"), "r")
    asked = messages.where("kind = 'request'")
    met = (F.col("id") == F.col("rid")) & (F.col("sender") != F.col("answerer"))
    return asked.join(answers, met, "left").select("sender", "id", "method", "pos", "ts_ms", F.col("r.pos").alias("answer_pos"), (F.col("r.ts_ms") - F.col("ts_ms")).alias("latency_ms"), F.col("r.body").alias("answer"))


def latency_stats(exchanges: DataFrame) -> DataFrame:
    """method, answered, least, median (the upper one), most, in ms. Latencies are counted by value before the shuffle,
    and the median's rank is found in the running count, so no method's latencies are gathered."""
    n = exchanges.where("latency_ms IS NOT NULL").groupBy("method", "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("method").orderBy("latency_ms")
    ranked = n.withColumn("upto", F.sum("n").over(running)).withColumn("total", F.sum("n").over(Window.partitionBy("method")))
    middle = F.floor(F.col("total") / 2)  # from 0
    return ranked.groupBy("method").agg(F.sum("n").alias("answered"), F.min("latency_ms").alias("least"), F.min(F.when(F.col("upto") > middle, F.col("latency_ms"))).alias("median"), F.max("latency_ms").alias("most"))


def notification_counts(messages: DataFrame) -> DataFrame:
    return messages.where("kind = 'notification'").groupBy("sender", "method").agg(F.count(F.lit(1)).alias("n"))


SYNC = ("didOpen", "didChange", "didSave", "didClose")
#: Methods that a step lists one by one (fixed values).
SYNC_METHODS = (*[f"textDocument/{s}" for s in SYNC], "workspace/didChangeWatchedFiles")


def document_sync_pivot(messages: DataFrame) -> DataFrame:
    """uri with its counts of each document-sync notification of the client."""
    short = F.element_at(F.split("method", "/"), -1)
    return messages.where("sender = 'client'").withColumn("what", short).where(F.col("what").isin(*SYNC)).groupBy("uri").agg(*[F.count_if(F.col("what") == s).alias(s) for s in SYNC])


def answers_by_method(exchanges: DataFrame) -> DataFrame:
    """method, answers: its distinct answers in the order in which they were first seen. A report's list, one row per
    method; `first_answers` gives the same with a row for each answer."""
    first = exchanges.where("answer IS NOT NULL").groupBy("method", "answer").agg(F.min("pos").alias("pos"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "answer")))
    return first.groupBy("method").agg(F.transform(ordered, lambda x: x["answer"]).alias("answers"))


def first_answers(exchanges: DataFrame) -> DataFrame:
    """method, answer, pos: its distinct answers, whole, each with the position at which it was first asked for."""
    return exchanges.where("answer IS NOT NULL").groupBy("method", "answer").agg(F.min("pos").alias("pos"))


def step_bounds(marks: DataFrame) -> DataFrame:
    """Adds `end_ms`: the next mark, or the largest number for the last. The marks of a session are few."""
    return marks.withColumn("end_ms", F.lead("ts_ms", 1, MAX_TS).over(Window.orderBy("ts_ms", "step")))


def assign_step(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Adds `step`: that of the latest mark at or before the message, or `startup`. Messages and marks are merged in
    buckets of time: a bucket's messages see its own marks and the last one before it."""
    width = 60_000
    bounds = step_bounds(marks)
    spans = bounds.select("step", F.col("ts_ms").alias("from_ms"), "end_ms")
    last = messages.agg(F.max("ts_ms").alias("m")).first()["m"] or 0  # one number
    upper = F.least(F.col("end_ms") - 1, F.lit(last))
    touched = F.when(upper >= F.col("from_ms"), F.sequence(F.floor(F.col("from_ms") / width), F.floor(upper / width)))
    dealt = spans.withColumn("bucket", F.explode(touched))
    met = (F.floor(F.col("ts_ms") / width) == F.col("bucket")) & (F.col("ts_ms") >= F.col("from_ms")) & (F.col("ts_ms") < F.col("end_ms"))
    return messages.join(dealt, met, "left").withColumn("step", F.coalesce("step", F.lit("startup"))).drop("from_ms", "end_ms", "bucket")


def step_summary(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """step with sync, requests and notifications of the client, for `startup` and each mark. sync: document-sync
    notifications with their uri, in order; the others: distinct methods in first-seen order. Each is `none` where empty.
    A step's text is as long as its sync notifications, which the report lists one by one."""
    short = F.element_at(F.split("method", "/"), -1)
    said = F.when(F.col("method").isin(*SYNC_METHODS), "sync").when(F.col("kind").isin("request", "notification"), F.col("kind"))
    own = assign_step(messages.where("sender = 'client'"), marks).withColumn("what", said).where("what IS NOT NULL")
    sync = own.where("what = 'sync'").select("step", "what", F.concat_ws(" ", short, F.coalesce("uri", F.lit("?"))).alias("item"), "pos")
    other = own.where("what <> 'sync'").groupBy("step", "what", F.col("method").alias("item")).agg(F.min("pos").alias("pos"))
    listed = sync.unionByName(other).groupBy("step", "what").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("items"))
    text = F.array_join(F.transform("items", lambda x: x["item"]), ", ")
    per = listed.groupBy("step").agg(*[F.max(F.when(F.col("what") == w, text)).alias(c) for w, c in (("sync", "sync"), ("request", "requests"), ("notification", "notifications"))])
    steps = marks.select("step").union(marks.sparkSession.range(1).select(F.lit("startup"))).distinct()
    return steps.join(per, "step", "left").select("step", *[F.coalesce(c, F.lit("none")).alias(c) for c in ("sync", "requests", "notifications")])


def gap_verdicts(exchanges: DataFrame) -> DataFrame:
    """method, verdict: CONFIRMED when all answers say that the method is unknown, REFUTED when some don't, NOT OBSERVED
    when none came."""
    unknown = F.coalesce(F.col("answer").contains(METHOD_NOT_FOUND), F.lit(False))
    n = exchanges.groupBy("method").agg(F.count("answer").alias("answered"), F.count_if(unknown).alias("unknown"))
    return n.select("method", F.when(F.col("answered") == 0, "NOT OBSERVED").when(F.col("answered") == F.col("unknown"), "CONFIRMED").otherwise("REFUTED").alias("verdict"))


#: Requests of a server of which a report tells whether the client knows them (fixed values).
SERVER_REQUESTS = ("client/registerCapability", "window/workDoneProgress/create", "workspace/configuration")
WATCHED_FILES = "workspace.didChangeWatchedFiles"


def session_verdicts(messages: DataFrame) -> DataFrame:
    """session, check, verdict, detail of each session of messages (session, pos, sender, kind, method, id, msg as JSON).
    The checks: the client doesn't say that it can watch files; its root is null; each of SERVER_REQUESTS is answered as
    unknown; no opened document is changed after it was opened. Sessions are told apart by extremes and counts, so none
    is gathered."""
    rows = messages.withColumn("msg", F.try_parse_json("msg"))
    client, said = F.col("sender") == "client", lambda m: (F.col("method") == m)
    sessions = messages.select("session").distinct()

    first = rows.where(client & said("initialize")).groupBy("session").agg(F.min_by(F.to_json("msg"), "pos").alias("init"))
    at = lambda p: F.try_variant_get(F.parse_json("init"), "$.params." + p, "variant")
    watched, root, none = at("capabilities." + WATCHED_FILES), at("rootUri"), F.lit(None).cast("string")
    checks = sessions.join(first, "session", "left").select("session", F.explode(F.array(
        F.struct(F.lit(WATCHED_FILES).alias("check"), F.when(F.col("init").isNull(), "NOT OBSERVED").when(watched.isNull(), "CONFIRMED").otherwise("REFUTED").alias("verdict"), F.coalesce(F.to_json(watched), F.when(F.col("init").isNull(), "no initialize").otherwise("absent")).alias("detail")),
        F.struct(F.lit("rootUri").alias("check"), F.when(F.col("init").isNull(), "NOT OBSERVED").when(root.isNull() | F.is_variant_null(root), "CONFIRMED").otherwise("REFUTED").alias("verdict"), F.coalesce(F.to_json(root), F.when(F.col("init").isNull(), "no initialize").otherwise("absent")).alias("detail")),
    )).alias("c")).select("session", "c.*")

    code = F.try_variant_get("msg", "$.error.code", "long")
    answers = rows.where((F.col("kind") == "response") & client).groupBy("session", "id").agg(F.min_by(F.coalesce(code == int(METHOD_NOT_FOUND), F.lit(False)), "pos").alias("unknown"))
    asked = rows.where((F.col("kind") == "request") & (F.col("sender") == "server") & F.col("method").isin(*SERVER_REQUESTS)).select("session", "id", "method")
    counts = asked.join(answers, ["session", "id"], "left").groupBy("session", "method").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("unknown")).alias("unknown"))
    every = sessions.select("session", F.explode(F.array(*map(F.lit, SERVER_REQUESTS))).alias("method")).join(counts, ["session", "method"], "left")
    part = F.concat_ws(" of ", F.col("unknown").cast("string"), F.col("n").cast("string"))
    requests = every.select("session", F.col("method").alias("check"), F.when(F.col("n").isNull(), "NOT OBSERVED").when(F.col("n") == F.col("unknown"), "CONFIRMED").otherwise("REFUTED").alias("verdict"), F.when(F.col("n").isNull(), none).otherwise(part).alias("detail"))

    uri = F.coalesce(F.try_variant_get("msg", "$.params.textDocument.uri", "string"), F.lit(""))
    opened = rows.where(client & F.col("method").isin("textDocument/didOpen", "textDocument/didChange")).groupBy("session", uri.alias("uri")).agg(F.min(F.when(said("textDocument/didOpen"), F.col("pos"))).alias("open"), F.max(F.when(said("textDocument/didChange"), F.col("pos"))).alias("change"))
    changed = opened.where("open IS NOT NULL").groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("change") > F.col("open")).alias("changed"))
    part = F.concat_ws(" of ", F.col("changed").cast("string"), F.col("n").cast("string"))
    last = sessions.join(changed, "session", "left").select("session", F.lit("didChange after didOpen").alias("check"), F.when(F.col("n").isNull(), "NOT OBSERVED").when(F.col("changed") == 0, "CONFIRMED").otherwise("REFUTED").alias("verdict"), F.when(F.col("n").isNull(), none).otherwise(part).alias("detail"))
    return checks.unionByName(requests).unionByName(last)


def lifecycle_events(events: DataFrame) -> DataFrame:
    """ts_ms, event, value of the starts, ends of streams, exits and malformed streams of a session, to be read in the
    order of ts_ms."""
    return events.where(F.col("event").isin("start", "eof", "exit", "malformed")).select("ts_ms", "event", "value")


def session_summary(messages: DataFrame) -> DataFrame:
    return messages.groupBy("sender").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("kind") == "request").alias("requests"), F.sum("bytes").alias("bytes"))
