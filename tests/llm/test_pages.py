"""Operators over pages and conversations, and the pipeline."""

import gzip
import os
import random
from collections import defaultdict
from glob import glob
from hashlib import sha1

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import html_text, jaccard_join, quotations, warc
from graphloom.llm.shared import new_folder

PAGE = "page_id long, url string, html string, payload_digest string, revisit string, refers_to string"


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>" + "é x" * 600 + "\r\n\r\nWARC/1.1\r\n</p>", "<p>" + "y z" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://b/9", big), (3, "http://a/\r\n3", other), (4, None, "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (9, "http://b/9", big), (None, "u", big), (None, None, None), (8, "u", "q" * 999), (10, "u", "q" * 999), (11, "u", "r" * 1000), (12, "u", "r" * 1000)]
    return spark.createDataFrame([(*r, "d", "r", "x") for r in rows], PAGE).repartition(3)


def test_warc_round_trip(spark, pages):
    folder = new_folder(spark, "warc")
    warc.write_archives(pages, folder)
    got = warc.read_archives(spark, folder).collect()
    rows = pages.collect()
    top = defaultdict(lambda: -1)
    for r in rows:
        raw = (r["html"] or "").encode()
        if len(raw) >= 1000 and r["page_id"] is not None:
            top[raw] = max(top[raw], r["page_id"])
    want = []
    for r in rows:
        raw = (r["html"] or "").encode()
        to = top[raw] if len(raw) >= 1000 and (r["page_id"] is None or r["page_id"] < top[raw]) else None
        want.append((r["page_id"], len(raw), sha1(raw).hexdigest(), "response" if to is None else "revisit", to, raw if to is None else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got), key=repr) == sorted(want, key=repr)
    raw = b"".join(gzip.open(f).read() for f in glob(folder.removeprefix("file://") + "/*.gz"))
    heads = [h for h, _ in warc.records([raw])]
    assert len(heads) == len(rows) and all(h["warc-record-id"].startswith("<urn:uuid:") for h in heads)


def test_warc_files_are_bounded_by_bytes(spark, pages, tmp_path, monkeypatch):
    """Several files of one task, each of few bytes of payloads or of one long one; all is read back."""
    import random

    monkeypatch.setattr(warc, "SMALL", 1_000)
    monkeypatch.setattr(warc, "FILE_BYTES", 8_000)
    r = random.Random(3)
    rows = [(i, f"http://a/{i % 50}", "".join(r.choice("abc ") for _ in range(r.choice([0, 10, 900, 1000, 1001, 3000, 5000, 20_000])))) for i in range(200)] + [(500, "u", "x" * 40_000), (501, "v", "x" * 40_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, f"{tmp_path}/w")
    got = {x["page_id"]: x for x in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert {i: len(x["payload"]) for i, x in got.items() if i != 500} == {i: len(h) for i, _, h in rows if i != 500} and got[500]["refers_to"] == 501
    files = [gzip.open(f).read() for f in glob(f"{tmp_path}/w/*.gz")]
    heads = [[(h, len(b)) for h, b in warc.records([f])] for f in files]
    assert all(len(x) == 1 or sum(n for _, n in x) < 8_000 + 200 * len(x) for x in heads) and len(heads) > 20
    revisit = next(h for x in heads for h, _ in x if h["warc-type"] == "revisit")
    assert revisit["warc-refers-to-target-uri"] == "v"


def test_warc_records_in_pieces():
    record = lambda n, body: b"WARC/1.1\r\nX: %d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, len(body), body)
    bodies = [b"", b"\r\n\r\nWARC/1.1", bytes(3_000_000), b"end"]
    raw = b"".join(record(n, b) for n, b in enumerate(bodies))
    whole = gzip.compress(raw[:50]) + gzip.compress(raw[50:])
    assert max(map(len, warc.inflated(whole))) <= warc.PIECE
    for pieces in (warc.inflated(whole), [raw], (raw[i : i + 7] for i in range(0, len(raw), 7))):
        assert [(h["x"], b) for h, b in warc.records(pieces)] == [(str(n), b) for n, b in enumerate(bodies)]
    for cut in (3, len(raw) - 6):
        with pytest.raises(ValueError):
            list(warc.records([raw[:cut]]))
    with pytest.raises(ValueError):
        list(warc.inflated(whole[:-20]))


def test_warc_of_nothing(spark, pages):
    folder = new_folder(spark, "warc")
    warc.write_archives(pages.limit(0), folder)
    assert warc.read_archives(spark, folder).count() == 0


ARTICLE = "<article><h1>Head &amp; line</h1><p>First  paragraph\nof <b>bold</b> and <a href='x'>linked</a> text, long enough to count.<p>Second one<br>with a break.</p><pre>x\n y</pre></article>"


@pytest.mark.parametrize(
    "around",
    [
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a><li><a>More</a></ul></nav>{}<footer>foot &copy;</footer></body></html>",
        "<body><div id=sidebar><p>side text that is quite long and has no links at all in it, really</p></div><main>{}</main><section class='comments'><p>nice post, I liked reading all of it</p></section>",
        "{}<aside>aside</aside><form><input><p>subscribe now</p></form><div class=\"cookie-notice\">we use cookies</div><!-- <p>hidden</p> -->",
        "<div><div class='ad'>buy</div><div>{}</div></div><script>unclosed <p>x",
    ],
)
def test_main_text(around):
    assert html_text.main_text(around.replace("{}", ARTICLE)) == "Head & line First paragraph of bold and linked text, long enough to count. Second one with a break. x y"


def test_main_text_without_an_article():
    body = "".join(f"<p>Paragraph {i} has plain words, and enough of them to be dense text.</p>" for i in range(6))
    links = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(20))
    got = html_text.main_text(f"<body><ul>{links}</ul><div><div>{body}</div></div><ul>{links}</ul></body>")
    assert got.startswith("Paragraph 0") and got.endswith("dense text.") and "link" not in got


def test_extract_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain &lt;text&gt; &eacute;"), (4, "u", "<div>" * 3000 + "deep" + "</div>" * 10), (None, "u", "<p>a<p>b"), (5, "u", "<"), (6, "u", "</p></div><b>x"), (7, "u", "<p>" + "w " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got == {1: "", 2: "", 3: "plain <text> é", 4: "deep", None: "a b", 5: "<", 6: "x", 7: " ".join(["w"] * 50_000)}
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["related-study", "header-study", "footer-study", "share-study", "notice-study", "comment-study"])
def test_names_that_only_hold_a_word_of_furniture_stay(name):
    inside = f"<article><p>Some words come first here.</p><div class='{name}'><p>A study of many words, and of few links.</p></div></article>"
    assert html_text.main_text(inside) == "Some words come first here. A study of many words, and of few links."
    assert html_text.main_text(f"<div id='{name}'><p>All that is here.</p></div>") == "All that is here."
    assert html_text.main_text(inside.replace(name, name.split("-")[0] + "-list")) == "Some words come first here."


def test_what_furniture_is_cut():
    links = "".join(f"<li><a href='/{i}'>another story {i}</a></li>" for i in range(9))
    for cut in ("<div class='comments'><p>I like it.</p></div>", "<div class='box sidebar'>x y</div>", f"<div class='related-stories'><ul>{links}</ul></div>", "<p id='cookie-notice'>We bake.</p>", "<aside>x</aside>", "<div role=navigation>x</div>"):
        assert html_text.main_text(f"<article><p>Words of the story.</p>{cut}</article>") == "Words of the story."
    assert html_text.main_text("<div class='banner'><p>Nothing else is here.</p></div>") == "Nothing else is here."
    assert html_text.main_text("<article><p data-id='ad'>Kept.</p><p title=it's>Kept, too.</p></article>") == "Kept. Kept, too."


ODD_MARKUP = {
    "quotes": ('<a href="x ', ""), "stray": ("<div>", "</section></b>"), "deep": ("<div>", ""), "inline": ("<b>", "</i>"), "half": ("<!x", ""), "open": ("<b x='", ""), "comments": ("<!--", ""), "script": ("<p>a<script>", ""),
    "lists": ("<ul><li>a", ""), "heads": ("<h3>3 comments</h3>", ""), "replies": ("<div><a>reply</a>", ""),
}


@pytest.mark.parametrize("name", ODD_MARKUP)
def test_odd_markup_takes_linear_time(name):
    import time

    def seconds(size):
        before, after = ODD_MARKUP[name]
        n = size // len(before + after)
        page, least = "<div><p>a" + before * n + after * n, []
        for _ in range(3):
            start = time.process_time()
            html_text.main_text(page)
            least.append(time.process_time() - start)
        return min(least)

    seconds(10_000)
    assert seconds(400_000) < 10 * seconds(100_000) + 0.2  # four times as long; sixteen times where a scan starts over at each tag


def grown(r, depth):
    out = "w" * r.randrange(0, 30)
    for _ in range(r.randrange(0, 4) if depth else 0):
        tag = r.choice(["div", "a", "b", "section"])
        out += f"<{tag}{r.choice(['', '', ' class=widget', ' id=comments'])}>{grown(r, depth - 1)}</{tag}>" + "v" * r.randrange(0, 9)
    return out


def test_densities_and_content_against_all_descendants():
    import math

    r = random.Random(4)
    for _ in range(60):
        page = html_text.parse(grown(r, 4))
        found = html_text.measured(page)
        nodes = [i for i in range(len(page.tags)) if not page.cut[i]]
        up = {i: [] for i in nodes}
        for i in nodes:
            at = i
            while at:
                at = page.parents[at]
                up[i].append(at)
        below = {i: [j for j in nodes if i in up[j]] for i in nodes}
        children = {i: [j for j in below[i] if page.parents[j] == i] for i in nodes}
        own = lambda i: sum(len(x.strip()) for x, o in zip(page.pieces, page.owners, strict=True) if o == i)
        chars = lambda js: sum(map(own, js))
        linked = lambda i: [j for j in [i, *below[i]] if any(page.tags[k] == "a" for k in [j, *up[j]][: len(up[j]) + 1 - len(up[i])])]
        body = chars(linked(0)) / max(chars(nodes), 1)
        density = {}
        for i in nodes:
            c, t, lc = chars([i, *below[i]]), len(below[i]), chars(linked(i))
            lt = t if page.tags[i] == "a" else len([j for j in below[i] if j in linked(i)])
            assert (found.chars[i], found.inner[i], found.link_chars[i], found.link_tags[i]) == (c, t, lc, lt)
            density[i] = 0.0
            if c:
                base = math.log(c / max(c - lc, 1) * lc + body * c + math.e)
                ratio = max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)
                weight = math.log(ratio) / math.log(base) if base > 1.0 + 1e-9 else math.log(max(c * max(t, 1), 1.0))
                density[i] = c / max(t, 1) * weight * (0.1 if any(page.names[k] >= html_text.HEADER for k in [i, *up[i]]) else 1)
            assert found.density[i] == pytest.approx(density[i])
        sums = {i: sum(found.density[j] for j in reversed(children[i])) for i in nodes}  # in the order of the one loop
        best = lambda i: max([i, *below[i]], key=lambda j: (sums[j], -j))
        assert found.sums[:1] == [sums[0]] and all(found.sums[i] == sums[i] and found.best_in[i] == best(i) for i in nodes)
        top = best(0)
        threshold = min(found.density[i] for i in [top, *up[top]])

        def chosen(i):
            if i and found.density[i] >= threshold and found.chars[i] and i not in up[top]:
                return [i if sums[i] == 0 or i == top else best(i)]
            return [top] if i == top else [x for j in children[i] for x in chosen(j)]

        assert html_text.content(found) == chosen(0)


STORY = "<article>{}<p>Some words come first here, quite a few of them in fact.</p><p>And a second paragraph with more plain words in it.</p>{}</article>"
STORY_TEXT = "Some words come first here, quite a few of them in fact. And a second paragraph with more plain words in it."


@pytest.mark.parametrize("head", ["<h1 class='header'>Head</h1>", "<div class='article-header'><h1>Head</h1></div>", "<h2 class='section-header'>Head</h2>", "<header><h1>Head</h1></header>", "<div class=banner><h1>Head</h1></div>", "<h2 class=related>Head</h2>"])
def test_headings_of_an_article_stay(head):
    assert html_text.main_text(f"<body><nav>x</nav>{STORY.format(head, '')}</body>") == f"Head {STORY_TEXT}"


@pytest.mark.parametrize("name", ["main banner", "widget main-content"])
def test_no_name_cuts_the_content(name):
    page = STORY.replace("article", "div").format("<h1>Title</h1>", "").replace("<div>", f"<div class='{name}'>")
    assert html_text.main_text(f"<body><p>ten chars.</p>{page}</body>").endswith(f"Title {STORY_TEXT}")
    wrapped = "<form action=/><div><p>Words on a page that one form wraps.</p><p>There are more words to come.</p></div><input></form>"
    assert html_text.main_text(wrapped) == "Words on a page that one form wraps. There are more words to come."


@pytest.mark.parametrize(
    "comments",
    [
        "<div id='reader-reviews'><p>I like this one a lot.</p></div>", "<div class='replies'><div>Nice one.</div></div>", "<div id='discussion'><p>One. Two.</p><p>What?</p></div>", "<section><h3>3 comments</h3><p>So nice.</p><p>So bad.</p></section>",
        "<section><h3>No comments</h3></section>", "<h3>2 Kommentare</h3><ul><li>Ja.<li>Nein.</ul>", "<ol><li>Ann: hi <a href=#>Reply</a><li>Bob: ho <a href=#>Reply</a></ol>",
        "<div class=x><div class=c><p>hi there</p><p><span><a>reply</a></span></p></div><div class=c><p>hi again</p><p><a>reply</a></p></div></div>", "<div class=comments>" + "<p>A very long comment, longer than the story itself.</p>" * 40 + "</div>",
    ],
)
def test_reader_comments_go(comments):
    assert html_text.main_text(STORY.format("<h1>T</h1>", comments)) == f"T {STORY_TEXT}"


def test_headings_that_only_sound_like_comments_stay():
    page = STORY.format("<h1>Comments on the budget</h1>", "<h2>Discussion</h2><p>The results agree.</p><h2>3 reviews of a book</h2><p>It is good.</p>")
    assert html_text.main_text(page).endswith("Discussion The results agree. 3 reviews of a book It is good.")


MESSAGE = "conv_id long, turn long, role string, text string, lines string, own string"


def test_quotations(spark):
    rows = [
        (1, 0, "user", "How do I join two tables?\nThey are both very large."),
        (1, 1, "assistant", "> How do I join two tables?\nUse a shuffle join on the key."),
        (1, 2, "user", "A wrote:\n> > how do i   join two TABLES?\n> Use a shuffle join on the key.\nThanks a lot"),
        (1, 3, "user", "An unrelated question"),
        (1, 4, "user", "> never written before by anyone\n> ok\nHm"),
        (1, 5, "assistant", "> Thanks a lot\n\nYou are welcome"),
        (1, 5, "assistant", "> Thanks a lot\n\nYou are welcome"),
        (2, 0, "user", "> How do I join two tables?"),
        (2, 1, "user", None),
        (None, None, None, "> x"),
        (3, 0, "user", ""),
    ]
    df = spark.createDataFrame([(*r, "l", "o") for r in rows], MESSAGE).repartition(3)
    got = quotations.link_quotations(df).collect()
    assert [(r["conv_id"], r["turn"]) for r in got] == [(None, None), (1, 0), (1, 1), (1, 2), (1, 5), (1, 5), (1, 3), (1, 4), (2, 0), (2, 1), (3, 0)]
    by = {(r["conv_id"], r["turn"]): r for r in got}
    links = {k: (r["n_quotes"], r["n_linked"], r["parent_turn"], r["root_turn"], r["depth"]) for k, r in by.items()}
    assert links[1, 1] == (1, 1, 0, 0, 1) and links[1, 2] == (2, 2, 1, 0, 2) and links[1, 5] == (1, 1, 2, 0, 3)
    assert links[1, 3] == (0, 0, None, 3, 0) and links[1, 4] == (1, 0, None, 4, 0) and links[2, 0] == (1, 0, None, 0, 0)
    assert by[1, 2]["text"] == "Thanks a lot" and by[1, 1]["text"] == "Use a shuffle join on the key." and by[2, 1]["text"] == ""
    assert quotations.link_quotations(df.limit(0)).count() == 0


def test_quotations_of_parts(spark):
    """Short, rewrapped and partial quotes link to the message that holds them."""
    long = "The first part of a message that goes on for more than eight words, and then\nends on its second line."
    rows = [
        (1, 0, "user", "Shall we go?\nSay when.\n- tea\n- milk\n- rye"),
        (1, 1, "assistant", "Well, yes, please do. 我们明天去北京吧"),
        (1, 2, "user", long),
        (1, 3, "user", "> yes, please\nGood"),
        (1, 4, "user", "> - tea\n> - milk\nBought"),
        (1, 5, "user", "> goes on for more than\n> eight words, and then ends\n> on its\nRight"),
        (1, 6, "user", "> 明天去北京\nOK"),
        (1, 7, "user", "> goes on for more than eight words, and then stops on its second\nNo"),
        (1, 8, "user", "> - rye\n> - tea\nOut of order"),
        (1, 9, "user", "> later words\nx"),
        (1, 10, "user", "later words"),
        (2, 0, "user", "> yes, please\nfrom elsewhere"),
    ]
    df = spark.createDataFrame([(*r, "l", "o") for r in rows], MESSAGE).repartition(3)
    by = {(r["conv_id"], r["turn"]): (r["n_quotes"], r["n_linked"], r["parent_turn"]) for r in quotations.link_quotations(df).collect()}
    assert [by[1, t] for t in (3, 4, 5, 6, 8)] == [(1, 1, 1), (1, 1, 0), (1, 1, 2), (1, 1, 1), (1, 1, 0)]
    assert by[1, 7] == by[1, 9] == by[2, 0] == (1, 0, None)


def test_pipeline(spark, tmp_path):
    from tests.llm.conftest import text_of
    from tests.llm.test_documents import kept_words, words

    passage, leak = text_of(70, 55), text_of(71, 30)
    texts = [text_of(100 + i, 120) for i in range(60)]
    texts[10] = texts[9]
    texts[11] = texts[9].replace(texts[9].split()[60], "other")
    texts[20], texts[21] = texts[20] + " " + passage, passage + " " + texts[21]
    texts[30] = texts[30] + " " + leak
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)] + [(97, None, "en", "src", 0), (98, "123 456", "en", "src", 7), (99, "", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
    kept = [{r["doc_id"] for r in seen[n]} for n, _ in corpus_pipeline.STAGES]
    assert kept[0] == set(range(60)) and kept[1] == set(range(60)) - {10, 11}
    stage_in = [(r["doc_id"], r["text"]) for r in seen["n-gram Jaccard join"]]
    want = {d: t for d, n, gone, t in kept_words(stage_in)}
    assert {r["doc_id"]: " ".join(words(r["text"])) for r in seen["substring dedup"]} == {d: t for d, t in want.items() if t}
    assert all(r["n_chars"] == len(r["text"]) for r in seen["substring dedup"])
    assert kept[3] == kept[2] - {30}
    assert kept[4] == kept[3] and {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[3]


def test_pipeline_keeps_one_of_repeated_rows(spark, tmp_path):
    from tests.llm.conftest import text_of

    texts = [text_of(400 + i, 120) for i in range(30)]
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[7], (None, *rows[8][1:]), (None, *rows[8][1:])]
    rows[8] = (8, *rows[9][1:])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    want = [(i, t) for i, t in enumerate(texts) if i not in (8, 9)] + [(8, texts[9]), (None, texts[8])]
    assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr) == sorted(want, key=repr)


def test_pipeline_keeps_nothing_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert jaccard_join.keep_one(empty).select(F.count("*")).first()[0] == 0


def linked_by_scan(rows):
    """n_quotes, n_linked, parent, root, depth and text of (conv_id, turn, role, text), by scans of each conversation."""
    import re

    import regex

    han = r"[\p{Han}\p{Hiragana}\p{Katakana}]"
    tokens = lambda t: regex.findall(rf"{han}|(?:(?!{han})[\p{{L}}\p{{M}}\p{{N}}_])+|\S", t.lower())
    normal = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", " ", t.lower()).strip(" ")
    says = {}
    for conv, turn, _, text in rows:
        marked = [re.match(r"((?:[ \t]*>)+)[ \t]?", line) for line in text.split("\n")]
        lines = [(m[1].count(">"), line[m.end() :]) if m else (0, line) for m, line in zip(marked, text.split("\n"), strict=True)]
        announces = [bool(re.search(r"(?i)\bwrote\s*:\s*$", x)) and i + 1 < len(lines) and lines[i + 1][0] > 0 for i, (_, x) in enumerate(lines)]
        says[conv, turn] = lines, [x for (level, x), a in zip(lines, announces, strict=True) if level == 0 and not a]

    texts = {k: {*map(normal, own), normal(" ".join(own))} for k, (_, own) in says.items()}

    def equal(conv, turn, t):
        return min((u for (c, u), held_texts in texts.items() if c == conv and u < turn and t and t in held_texts), default=None)

    spaced = lambda ws: " " + " ".join(ws) + " "  # noqa: E731 no token holds a space
    held = {k: spaced(tokens(" ".join(own))) for k, (_, own) in says.items()}

    def part(conv, turn, t):
        w = tokens(t)
        return min((u for (c, u), text in held.items() if c == conv and u < turn and w and spaced(w) in text), default=None)

    first = lambda *xs: next((x for x in xs if x is not None), None)
    out, parents = {}, {}
    for (conv, turn), (lines, own) in says.items():
        passages, previous = [], 0
        for level, x in lines:
            if level and level == previous:
                passages[-1][1].append(x)
            elif level:
                passages.append((level, [x]))
            previous = level
        sources = []
        for level, quoted in passages:
            whole = normal(" ".join(quoted))
            each = [first(equal(conv, turn, q), part(conv, turn, q) if len(q) >= 12 else None) for q in map(normal, quoted)]
            by_line = max((s for s in each if s is not None), default=None)
            sources.append((level, first(equal(conv, turn, whole), part(conv, turn, whole), by_line)))
        parents[conv, turn] = max((s for level, s in sources if level == 1 and s is not None), default=None)
        out[conv, turn] = len(sources), sum(s is not None for _, s in sources), parents[conv, turn], "\n".join(own).strip(" ")
    got = []
    for (conv, turn), (n, linked, parent, text) in out.items():
        root, depth = turn, 0
        while parents[conv, root] is not None:
            root, depth = parents[conv, root], depth + 1
        got.append((conv, turn, n, linked, parent, root, depth, text))
    return sorted(got, key=lambda r: (r[0], r[5], r[1]))


def test_quotations_of_a_common_line(spark):
    """Every turn quotes one phrase, within other words and by itself; the phrase is looked for once."""
    phrase = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, 0, "u", f"start {phrase} end")] + [(1, t, "u", f"> {phrase}\nword{t} {phrase} tail{t}\n> {phrase} tail{t - 1}") for t in range(1, 60)]
    rows += [(2, 0, "u", "x"), (2, 1, "u", f"> {phrase}\nnobody said so {phrase}"), (2, 2, "u", f"> so {phrase}")]
    got = quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    got = [(x["conv_id"], x["turn"], x["n_quotes"], x["n_linked"], x["parent_turn"], x["root_turn"], x["depth"], x["text"]) for x in got]
    assert got == linked_by_scan(rows)


def test_derived_quotes_link(spark):
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    rows = [tuple(r) for r in quotations.derived_quotes(spark.read.parquet(f"{path}/conversations.parquet")).select("conv_id", "turn", "role", "text").collect()]
    got = [(x["conv_id"], x["turn"], x["n_quotes"], x["n_linked"], x["parent_turn"], x["root_turn"], x["depth"], x["text"]) for x in quotations.quotations_derived(spark, path).collect()]
    assert got == linked_by_scan(rows) and sum(x[3] for x in got) > len(rows) // 2


def test_quotations_of_the_given_conversations(spark):
    """Each turn of the given table quotes turns before it, whole, in part, rewrapped, nested or altered."""
    path = "/root/testdata/sf0.01/conversations.parquet"
    if not os.path.isfile(path):
        pytest.skip("no test tables here")
    r, told, rows = random.Random(5), {}, []
    for x in spark.read.parquet(path).orderBy("conv_id", "turn").collect():
        before, text = told.setdefault(x["conv_id"], []), x["text"] or ""
        for _ in range(r.choice([0, 1, 1, 2]) if before else 0):
            source = r.choice(before)
            w = source[:3000].split(" ")
            at, n = r.randrange(len(w)), r.choice([1, 3, 7, 8, 9, 25, 400])
            piece = [source[:3000], " ".join(w[at : at + n]), " ".join(w[at : at + n]).upper(), "\n".join(" ".join(w[i : i + 6]) for i in range(at, min(at + n, len(w)), 6)), " ".join([*w[at : at + n], "zzz"])][r.randrange(5)]
            text = r.choice(["", "A wrote:\n"]) + "\n".join("> " + line for line in piece.split("\n")) + "\n" + r.choice(["", "\n"]) + text
        before.append(text)
        rows.append((x["conv_id"], x["turn"], x["role"], text))
    got = quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    got = [(x["conv_id"], x["turn"], x["n_quotes"], x["n_linked"], x["parent_turn"], x["root_turn"], x["depth"], x["text"]) for x in got]
    assert got == linked_by_scan(rows)
    assert sum(x[3] for x in got) > len(rows) // 3 and any(x[3] < x[2] for x in got) and max(x[6] for x in got) > 2


def test_runs_of_quoted_parts_meet_by_hashes_of_tokens_cut_once(spark):
    """Texts are cut into tokens once, runs aren't built as strings, and counts of runs aren't broadcast."""
    base = spark.createDataFrame([(1, 1, 0, ["a b c d e f g h i j"]), (2, 1, 1, ["x"])], "mid long, conv_id long, turn long, own array<string>")
    wanted = spark.createDataFrame([(1, 1, t) for t in ("c d", "b c d e f g h i j", "b c d e f g h i x")], "conv_id long, turn long, t string")
    got = quotations.held_parts(base, wanted)
    assert sorted(x["t"] for x in got.collect()) == ["b c d e f g h i j", "c d"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "regexp_extract_all" not in plan and "strategy=merge" in plan
