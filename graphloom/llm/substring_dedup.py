"""Removal of repeated spans with suffix automata of reference shards.

A window is 20 consecutive words of a document. Each word goes that a window covers whose words also start earlier (in a
smaller doc_id, or earlier in the same document). In short:

1. Every window is given to an anchor, the 6-word run in it with the least hash, so that equal windows share their
   anchor's hash; consecutive windows with one anchor form a region. A document has about one region for 8 words.
2. Regions are grouped by anchor hash. A region equal to an earlier one goes whole. Regions that are alone with their
   anchor hash stay whole.
3. The others, different regions with one anchor hash, are dealt to shards by that hash. Each shard builds the suffix
   automaton of its regions in document order and streams each region through it first: where the matching statistic
   reaches 20 words, an earlier region holds that window. Shards have a bounded number of regions.
4. An anchor hash with more regions than HOT_REGIONS, counted before anything is gathered by it, is resolved window by
   window instead: windows are grouped by hash, summed before the shuffle, and joined to their first occurrence.

All shards of a corpus of any size can't be broadcast to all documents, so regions travel to the shard of their anchor.

Defined results: null, empty and short texts lose nothing; a null doc_id is smaller than any other; rows that repeat a
doc_id with the same text are judged as one document (each keeps what it keeps); rows that repeat it with other texts
are separate documents in the order of a hash of their texts; an empty table gives an empty table; extra columns pass
through `remove_repeats` unchanged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.llm.shared import give_back, light_batches, once, staged, unstaged
from graphloom.llm.tokens import WordEncoder, slices
from graphloom.llm.wordhash import Runs, mix, words_of

#: Words of a window, and of an anchor.
WINDOW, ANCHOR = 20, 6
#: Regions that a task combines before they are shuffled, regions in a shard on average, and the most of one anchor
#: hash that meet in a task (after equal regions are combined where they are made).
COMBINE, SHARD_REGIONS, HOT_REGIONS = 250_000, 2_000, 20_000


def regions_of(words: np.ndarray, first: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """(h, rh, text, lo, hi): anchor hash, hash of the region's words, text number, first and last window start."""
    n = len(words)
    starts = np.arange(max(n - window + 1, 0))
    text = np.searchsorted(first, starts, "right") - 1
    valid = starts + window <= first[text + 1]
    starts, text = starts[valid], text[valid]
    if not len(starts):
        return [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
    runs, at = Runs(words), np.arange(n - anchor + 1)
    grams = runs.hash(at, at + anchor)
    span = window - anchor + 1
    least = np.lib.stride_tricks.sliding_window_view(grams, span)[starts].argmin(1) if len(starts) < 200_000 else np.concatenate(
        [np.lib.stride_tricks.sliding_window_view(grams, span)[s].argmin(1) for s in np.array_split(starts, len(starts) // 100_000)]
    )
    place = starts + least
    new = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]))
    lo = starts[new]
    hi = starts[np.append(new[1:], True)]
    return mix(grams[place[new]], 1), runs.hash(lo, hi + window, 2), text[new], lo - first[text[new]], hi - first[text[new]]


def spans(doc: np.ndarray, th: np.ndarray, lo: np.ndarray, end: np.ndarray):
    """Overlapping and touching spans of a document as one."""
    order = np.lexsort((lo, th, doc))
    doc, th, lo, end = doc[order], th[order], lo[order], end[order]
    if not len(doc):
        return doc, th, lo, end
    change = np.append(True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]))
    group = np.cumsum(change)
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)  # the furthest end so far in the document
    new = change | np.append(True, lo[1:] > reach[:-1])
    return doc[new], th[new], lo[new], reach[np.append(new[1:], True)]


def anchored(docs: DataFrame) -> DataFrame:
    """Region rows h, rh, id, th, lo, hi, sure. Equal regions that meet in a task are combined: all but the first become
    `sure` spans, so that a region which a third of all documents hold leaves each task once."""

    def run(batches):
        import pyarrow as pa

        WordEncoder.leave()
        give_back()
        names = ["h", "rh", "id", "th", "lo", "hi", "sure"]

        def combined(held):
            h, rh, doc, th, lo, hi = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((lo, th, doc, rh, h))
            h, rh, doc, th, lo, hi = (c[order] for c in (h, rh, doc, th, lo, hi))
            first = np.append(True, (h[1:] != h[:-1]) | (rh[1:] != rh[:-1]))[: len(h)]
            d, t, a, e = spans(doc[~first], th[~first], lo[~first], hi[~first] + WINDOW)
            own = mix(mix(d.view(np.uint64)) ^ a.astype(np.uint64), 3)  # spreads sure spans over all partitions
            columns = [np.append(h[first], own).view(np.int64), np.append(rh[first], np.zeros(len(d), np.uint64)).view(np.int64), np.append(doc[first], d), np.append(th[first], t), np.append(lo[first], a).astype(np.int32), np.append(hi[first], e - WINDOW).astype(np.int32), np.append(np.zeros(first.sum(), bool), np.ones(len(d), bool))]
            for at in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names)

        held, n = [], 0
        for batch in batches:
            for part in slices(batch):
                h, rh, text, lo, hi = regions_of(*words_of(part["text"]))
                held.append((h, rh, part["id"].to_numpy()[text], part["th"].to_numpy()[text], lo, hi))
                n += len(h)
                if n > COMBINE:
                    yield from combined(held)
                    held, n = [], 0
        if held:
            yield from combined(held)

    return docs.mapInArrow(run, "h long, rh long, id long, th long, lo int, hi int, sure boolean")


class SuffixAutomaton:
    """Online suffix automaton over words of several texts. stream() gives the matching statistic of each position
    against the texts added before."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word) -> int:
        """The state for the longest text of p and `word`, out of q, which also holds longer ones."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            cur, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = cur

    def stream(self, words: list) -> list[int]:
        """For each position, how many words up to it (included) some earlier text holds in a row."""
        out, state, n = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if word in self.next[state]:
                state, n = self.next[state][word], n + 1
            else:
                n = 0
            out.append(n)
        return out


def repeated_in_shard(rows: list[tuple], window: int = WINDOW):
    """rows: (id, th, lo, words) in document order. Yields (id, th, start, end) of maximal spans of repeated windows."""
    automaton = SuffixAutomaton()
    for doc, th, lo, words in rows:
        match = automaton.stream(words)
        hits = {e - window + 1 for e, n in enumerate(match) if n >= window}
        seen: set[tuple] = set()
        for s in range(len(words) - window + 1):  # a region may also repeat its own windows
            w = tuple(words[s : s + window])
            if w in seen:
                hits.add(s)
            seen.add(w)
        automaton.add(words)
        start = end = -1
        for s in sorted(hits):
            if s > end:
                if end >= 0:
                    yield doc, th, lo + start, lo + end
                start = s
            end = s + window
        if end >= 0:
            yield doc, th, lo + start, lo + end


SPANS = "id long, th long, lo int, end int"


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs: id, th, text, one row for each (id, th). The spans (id, th, lo, end) of words to remove; they may overlap."""
    regions = staged(anchored(docs), "anchored")
    # An anchor hash of very many regions isn't gathered: its regions are dealt by their own hashes and are all doubtful.
    hot = regions.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_REGIONS).select("h", F.lit(True).alias("hot"))
    dealt = regions.join(staged(hot, "hot-anchors"), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    dealt = dealt.withColumn("own", F.when(F.col("hot"), F.col("rh")).otherwise(F.lit(0))).repartition("h", "own")  # serves both windows
    same = Window.partitionBy("h", "own", "rh").orderBy("id", "th", "lo")
    alike = Window.partitionBy("h", "own")
    ranked = dealt.withColumn("nth", F.row_number().over(same)).withColumn("kinds", F.sum(F.when((F.col("nth") == 1) & ~F.col("sure"), 1)).over(alike))
    flagged = staged(ranked.where(F.col("sure") | (F.col("nth") > 1) | (F.col("kinds") > 1) | F.col("hot")).drop("own", "kinds"), "regions")
    unstaged(regions)
    whole = flagged.where(F.col("sure") | (F.col("nth") > 1)).select("id", "th", "lo", (F.col("hi") + WINDOW).alias("end"))
    doubtful = flagged.where(~F.col("sure") & (F.col("nth") == 1)).select("h", "id", "th", "lo", "hi", "hot")
    n_shards = max(1, -(-doubtful.count() // SHARD_REGIONS))
    per_doc = doubtful.groupBy("id", "th").agg(F.collect_list(F.struct("h", "lo", "hi", "hot")).alias("regions"))  # bounded by the document

    def cut(batches):
        import pyarrow as pa

        give_back()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, th, text, regions in zip(*(part[c].to_pylist() for c in ("id", "th", "text", "regions")), strict=True):
                    words = text.encode().split()
                    for r in regions:
                        lo, hi = r["lo"], r["hi"]
                        if r["hot"]:
                            rows.extend((r["h"], doc, th, s, True, b" ".join(words[s : s + WINDOW])) for s in range(lo, hi + 1))
                        else:
                            rows.append((r["h"], doc, th, lo, False, b" ".join(words[lo : hi + WINDOW])))
                if rows:
                    h, doc, th, lo, hot, words = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(lo, pa.int32()), pa.array(hot), pa.array(words, pa.binary())], ["h", "id", "th", "lo", "hot", "words"])

    def stream(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["id", "th", "lo"])
        rows = [(d, t, lo, w.split()) for d, t, lo, w in zip(pdf["id"], pdf["th"], pdf["lo"], pdf["words"], strict=True)]
        return pd.DataFrame(list(repeated_in_shard(rows)), columns=["id", "th", "lo", "end"])

    texts = staged(docs.join(per_doc, ["id", "th"]).select("id", "th", "text", "regions").mapInArrow(cut, "h long, id long, th long, lo int, hot boolean, words binary"), "region-words")
    shard = F.pmod(F.col("h"), F.lit(n_shards))
    by_automaton = texts.where(~F.col("hot")).select(shard.alias("shard"), "id", "th", "lo", "words").groupBy("shard").applyInPandas(stream, SPANS)
    windows = texts.where("hot").select(F.md5("words").alias("w"), F.struct("id", "th", "lo").alias("at"))
    first = windows.groupBy("w").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    by_window = windows.join(first, "w").where("at > first").select("at.id", "at.th", "at.lo", (F.col("at.lo") + WINDOW).alias("end"))
    return whole.unionByName(by_automaton).unionByName(by_window)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with all their columns and n_words, n_removed and kept (the kept words joined by one space)."""
    light_batches(docs.sparkSession)
    own = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.col("text").alias("text"))
    repeats = rows.groupBy("id").count().where("count > 1").limit(1).count() > 0
    rows = rows.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))) if repeats else F.lit(0).cast("long"))
    # The text column travels once: it is put back in its place at the end.
    text_at = own.index("text")
    rows = rows.drop(f"c{text_at}")
    judged = rows.select("id", "th", "text")  # a second row of a document would count as a repeat of the first
    found = repeated_spans(once(judged, "id", "th") if repeats else judged).groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("lo", "end"))).alias("spans"))
    joined = rows.join(found, ["id", "th"], "left")
    others = [f"c{i}" for i in range(len(own)) if i != text_at]
    kinds = dict(joined.dtypes)

    def run(batches):
        import pyarrow as pa

        give_back()
        for batch in batches:
            for part in slices(batch):
                n_words, n_removed, kept = [], [], []
                for text, gone in zip(part["text"].to_pylist(), part["spans"].to_pylist(), strict=True):
                    words = text.encode().split() if text else []
                    n_words.append(len(words))
                    if gone:
                        keep, at = [], 0
                        for s in gone:
                            keep += words[at : s["lo"]]
                            at = max(at, s["end"])
                        words = keep + words[at:]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([*[part[c] for c in [*others, "text"]], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*others, "text", "n_words", "n_removed", "kept"])

    out = joined.select(*others, "text", "spans").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in [*others, "text"]) + ", n_words long, n_removed long, kept string")
    names = [F.col("text") if i == text_at else F.col(f"c{i}").alias(c) for i, c in enumerate(own)]
    return out.select(*[n for n, c in zip(names, own, strict=True) if c not in ("n_words", "n_removed", "kept")], "n_words", "n_removed", "kept")


def op10_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM d, unnest(range(1, len(w) - 18)) AS u(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM rep, unnest(range(0, 20)) AS u(k)),
each AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
