"""Quotation linking of conversations.

Lines that begin with '>' marks are quoted, and their number is the nested level. Runs of lines at one level are
passages; their normalised text is hashed and joined to the earliest message of the conversation that holds it, as its
whole own text or as one of its lines. What no message holds so is looked for as a run of tokens (words, ideographs and
marks) in the messages' own texts, whatever their line breaks: runs of up to 8 tokens meet by themselves, longer ones by
the 8-token run of theirs that the conversation holds least often, and are then compared. Each text that a conversation
quotes is looked for once, however many of its messages quote it. A message replies to the latest message that its level-1 passages come from.
Messages leave in reply order, without quotes: by conversation, by the first message of their thread, by turn.

Defined results: null text is the empty message; a passage that no earlier message of its conversation holds is counted
but not linked; a passage links as a whole if it can, or else by its lines, of which those under 12 characters link only
to equal lines; rows that repeat (conv_id, turn) are handled one
by one and share links; a null conv_id or turn links with nothing and comes first; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import let, staged

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
#: The shortest line of a longer passage that links to a part of a line, in characters.
LEAST_LINE = 12
#: Tokens: ideographs and kana one by one, words, and other marks one by one. Most tokens of an anchor.
IDEOGRAPH = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
TOKEN = rf"{IDEOGRAPH}|(?:(?!{IDEOGRAPH})[\p{{L}}\p{{M}}\p{{N}}_])+|\S"
ANCHOR = 8


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def quoted_lines(text: Column) -> Column:
    """An array of (level, line) of a text; the line is without its marks."""
    each = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")))
    return each


def own_lines(lines: Column) -> Column:
    """The unquoted lines, without those that announce the quote after them."""
    announces = lambda x, i: x["line"].rlike(r"(?i)\b(wrote|writes|schrieb|écrit|escribió)\s*:\s*$") & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)
    return F.transform(F.filter(lines, lambda x, i: (x["level"] == 0) & ~announces(x, i)), lambda x: x["line"])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def held_parts(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: conv_id, turn, t. Adds part_turn, the earliest turn before whose message's own text holds t's tokens in a
    row; rows without one go. Only conversations in `wanted` are cut into runs, of the lengths asked for there. The
    earliest message of all that holds a text tells it for every turn that wants it, so texts are looked for by
    conversation, not by turn. Runs meet by their hashes, and what meets is compared by its tokens."""
    hashed = lambda w, at, k: F.xxhash64(F.slice(w, at + 1, k))
    runs = lambda w, k: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: hashed(w, i, k))
    want = wanted.select("conv_id", "t").distinct().withColumn("w", tokens(F.col("t"))).withColumn("n", F.size("w")).where("n > 0").withColumn("k", F.least("n", F.lit(ANCHOR)))
    want = staged(want.withColumn("wid", F.monotonically_increasing_id()), "quoted-parts")

    needs = want.groupBy("conv_id").agg(F.collect_set("k").alias("ks"))  # at most ANCHOR numbers
    held = staged(base.join(needs, "conv_id").select("mid", "conv_id", F.col("turn").alias("part_turn"), "ks", tokens(F.array_join("own", " ")).alias("held")), "held-tokens")
    dealt = held.select("mid", "conv_id", "part_turn", "held", F.explode("ks").alias("k")).where(F.size("held") >= F.col("k"))
    grams = lambda df: df.select("mid", "conv_id", "part_turn", "k", F.posexplode(runs(F.col("held"), F.col("k"))).alias("pos", "gram"))

    # A short text meets the messages as a whole, a longer one at its run that is held least often; a run that none holds
    # rules it out.
    short = want.where(F.col("n") <= ANCHOR).select("wid", "conv_id", "k", F.lit(0).alias("at"), hashed(F.col("w"), F.lit(0), F.col("k")).alias("gram"))
    places = grams(dealt.where(F.col("k") == ANCHOR)).groupBy("conv_id", "gram").agg(F.count(F.lit(1)).alias("places"))
    long = want.where(F.col("n") > ANCHOR).select("wid", "conv_id", F.posexplode(runs(F.col("w"), F.lit(ANCHOR))).alias("at", "gram")).join(places.hint("merge"), ["conv_id", "gram"], "left")  # many more than their table's bytes tell
    rank = F.coalesce("places", F.lit(0)) * F.lit(1 << 31) + F.col("at")  # fewest places, then first; one number is the least without a sort
    rarest = long.groupBy("wid").agg(F.min(rank).alias("rank")).where(F.col("rank") >= 1 << 31).select("wid", F.expr("cast(rank & 2147483647 as int)").alias("at"))
    anchored = short.unionByName(want.join(rarest, "wid").select("wid", "conv_id", F.lit(ANCHOR).alias("k"), "at", hashed(F.col("w"), F.col("at"), F.lit(ANCHOR)).alias("gram")))
    met = anchored.join(grams(dealt), ["conv_id", "k", "gram"]).where("pos >= at").select("mid", "wid", "part_turn", (F.col("pos") - F.col("at")).alias("start"))
    met = met.join(want.select("wid", "conv_id", "t", "w", "n").hint("merge"), "wid").join(held.select("mid", "held").hint("merge"), "mid")
    met = met.where(F.slice("held", F.col("start") + 1, F.col("n")) == F.col("w")).groupBy("conv_id", "t").agg(F.min("part_turn").alias("part_turn"))
    return wanted.distinct().join(met, ["conv_id", "t"]).where("part_turn < turn").select("conv_id", "turn", "t", "part_turn")


def link_quotations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, n_linked, parent_turn, root_turn, depth, in reply order."""
    base = messages.select("conv_id", "turn", "role", quoted_lines(F.col("text")).alias("lines"))
    base = base.select(F.monotonically_increasing_id().alias("mid"), "conv_id", "turn", "role", "lines", let(F.col("lines"), own_lines).alias("own"))
    base = staged(base, "messages")  # also fixes mid

    # The earliest message for each text, summed before the shuffle: a common first turn is one row for its conversation.
    whole = normal(F.array_join("own", " "))
    texts = base.select("conv_id", "turn", F.explode(F.array_append(F.transform("own", normal), whole)).alias("t")).where("t <> ''")
    originals = texts.groupBy("conv_id", F.xxhash64("t").alias("h"), F.col("t").alias("original")).agg(F.min("turn").alias("source_turn"))

    quoting = base.where(F.exists("lines", lambda x: x["level"] > 0)).select("mid", "conv_id", "turn", F.posexplode("lines").alias("pos", "x"))
    in_order = Window.partitionBy("mid").orderBy("pos")  # a message's own lines
    starts = (F.lag("x.level", 1, 0).over(in_order) != F.col("x.level")).cast("int")
    runs = quoting.withColumn("new", starts).withColumn("passage", F.sum("new").over(in_order)).where("x.level > 0")
    passages = runs.groupBy("mid", "conv_id", "turn", "passage").agg(F.first("x.level").alias("level"), F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("x.line").alias("line")))), lambda x: x["line"]).alias("quoted"))
    keys = F.array_append(F.transform("quoted", normal), normal(F.array_join("quoted", " ")))
    tried = passages.select("mid", "conv_id", "turn", "passage", "level", F.posexplode(F.reverse(keys)).alias("line", "t"))  # 0: the whole
    same = (tried["conv_id"] == originals["conv_id"]) & (F.xxhash64("t") == originals["h"]) & (F.col("t") == F.col("original")) & (F.col("source_turn") < tried["turn"])
    matched = staged(tried.join(originals, same, "left").select("mid", tried["conv_id"], tried["turn"], "passage", "level", "line", tried["t"], "source_turn"), "passages")
    parts = held_parts(base, matched.where((F.col("line") == 0) | (F.length("t") >= LEAST_LINE)).where("source_turn IS NULL AND conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "t"))
    found = matched.join(parts, ["conv_id", "turn", "t"], "left")
    whole_by = lambda c: F.max(F.when(F.col("line") == 0, F.col(c)))
    found = found.groupBy("mid", "passage").agg(F.first("level").alias("level"), whole_by("source_turn").alias("by_whole"), whole_by("part_turn").alias("by_part"), F.max(F.coalesce("source_turn", "part_turn")).alias("by_line"))
    found = found.withColumn("source", F.coalesce("by_whole", "by_part", "by_line"))
    per_message = staged(found.groupBy("mid").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("source").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("source"))).alias("parent_turn")), "quotations")

    links = per_message.where("parent_turn IS NOT NULL").join(base.select("mid", "conv_id", "turn"), "mid").groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("up"))
    jumps = staged(links.withColumn("hops", F.lit(1)), "jumps")
    while True:  # pointers double: as many rounds as the logarithm of the longest chain of replies
        upper = jumps.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("hops").alias("hops2"))
        joined = jumps.join(upper, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t")), "left")
        jumps = staged(joined.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.col("up2").isNotNull().alias("more")), "jumps")
        if jumps.where("more").isEmpty():
            break
        jumps = jumps.drop("more")
    roots = jumps.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("root"), "hops")
    out = base.join(per_message, "mid", "left").join(roots, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    zero = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)).alias(c)
    out = out.select("conv_id", "turn", "role", F.trim(F.array_join("own", "\n")).alias("text"), zero("n_quotes", "long"), zero("n_linked", "long"), "parent_turn", F.coalesce("root", "turn").alias("root_turn"), F.coalesce(F.col("hops").cast("long"), F.lit(0)).alias("depth"))
    return out.orderBy("conv_id", "root_turn", "turn")


def op1_quotations(spark, sf_dir):
    return link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def derived_quotes(conversations: DataFrame) -> DataFrame:
    """`conversations` whose messages quote the message before them: by turn the whole text, its last line, or its first
    120 characters in lines of 40, below an announcement or between the message's own lines."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.withColumn("before", before)
    first = F.substring("before", 1, 120)
    pick = F.when(F.col("turn") % 3 == 1, F.col("before")).when(F.col("turn") % 3 == 2, F.element_at(F.split("before", "\n"), -1)).otherwise(F.regexp_replace(first, "(.{40})", "$1\n"))
    quoted = F.array_join(F.transform(F.split(pick, "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")
    text = F.when(F.col("before").isNull(), F.col("text")).otherwise(F.concat(F.when(F.col("turn") % 2 == 0, "A wrote:\n").otherwise(""), quoted, F.lit("\n"), F.coalesce("text", F.lit(""))))
    return rows.withColumn("text", text).drop("before")


def quotations_derived(spark, sf_dir):
    """Linking over messages that do quote: the given table's hold no quotes."""
    return link_quotations(derived_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
