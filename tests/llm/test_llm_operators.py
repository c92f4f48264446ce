"""Training-data operators against brute force, round trips and edge cases."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexaudit.llm import chat, common, dart, html, jpeg, kneser, media, mixing, near, packing, registry, rules, substrings, warc
from lexaudit.llm.common import vocabulary
from lexaudit.llm.suffix import suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, node string, block string, kept string, n string"


def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns that clash with the operators' own."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(200)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(120)
    near_copy = base.split()
    near_copy[60] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near_copy), "en", "b"), (4, None, None, None), (5, "", "de", "b"), (6, "one two", "de", "b"),
        (7, text(3000), "en", "a"), (7, text(40), "en", "c"), (8, base, "en", "a"), (8, base, "en", "a"), (None, base, "en", "a"), (9, "x" * 5000, "fr", "c"), (10, "\n\n a a a a a a\n a a a a a a\n", "fr", None),
        (11, text(50) + " | " + base[100:400] + " 世界 🙂 ́", "en", "a"), (12, "a\tb\x0bc d", "en", "a"), (13, "Straße IT'S it's 12,5% --''s <|endoftext|> _x_", "en", "b"),
    ]
    return spark.createDataFrame([(*x, None if x[1] is None else len(x[1]), "s", "t", "n", "b", "k", "1") for x in rows], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return odd_documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


# ---------------------------------------------------------------- chat


def test_chat_round_trip(spark):
    turns = [(1, 2, "user", "b\\<|im_sep|>"), (1, 1, "user", "a"), (1, 3, "assistant", None), (1, None, None, "</s>[INST] \\\\x"), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (None, 0, "<|im_end|>", "<|im_open\n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chat(df)
    read = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in formatted.select("conv_id", chat.read_chat(F.col("formatted")).alias("t")).collect()}
    assert read[1] == [("", "</s>[INST] \\\\x"), ("user", "a"), ("user", "b\\<|im_sep|>"), ("assistant", "")]
    assert read[2] == [("assistant", ""), ("assistant", "")]
    assert read[None] == [("<|im_end|>", "<|im_open\n")]
    for r in formatted.collect():
        inner = r["formatted"]
        for mark in (chat.OPEN, chat.BODY, chat.SEP, chat.END):
            inner = inner.replace(mark, "")
        assert not any(c in inner for c in chat.CONTROL)
    d = {r["conv_id"]: r for r in chat.chat_digest(formatted).collect()}
    assert d[1]["n_turns"] == 4 and d[1]["turns_sha256"] == hashlib.sha256("\n</s>[INST] \\\\x\nuser\na\nuser\nb\\<|im_sep|>\nassistant\n\n".encode()).hexdigest()
    assert chat.chat_digest(chat.format_chat(df.limit(0))).count() == 0


# ---------------------------------------------------------------- rules


def brute_rules(text):
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_rules(docs, none):
    got = rules.quality_rules(docs, vocabulary(rules.VOCABULARY), min_class=2).collect()
    want = Counter((d, *brute_rules(t)) for d, t in rows_of(docs))
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert rules.quality_rules(none, vocabulary(rules.VOCABULARY)).count() == 0


def test_small_classes_are_judged(spark):
    r = random.Random(8)
    words = ["the", "house", "water", "people", "green", "small", "river", "under", "music", "paper", "winter", "garden", "between", "morning", "of", "and", "in"]
    good = lambda n: " ".join(r.choice(words) + str(r.randrange(10)) for _ in range(n))
    junk = lambda n: " ".join("".join(chr(r.randrange(0x10900, 0x10A00)) for _ in range(5)) for _ in range(n))
    rows = [(i, good(r.randint(80, 100)), "en") for i in range(200)]
    rows += [(1000, good(3000), "en"), (1001, junk(400), "en"), (1002, good(90), "xx"), (1003, junk(400), "xx"), (1004, junk(90), None), (1005, good(12), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["kept"] for x in rules.quality_rules(df, vocabulary(rules.VOCABULARY)).collect()}
    assert len(got) == len(rows) and not any(got[i] for i in (1001, 1003, 1004))
    assert got[1000] and got[1002] and got[1005] and all(got[i] for i in range(200))
    few = spark.createDataFrame(rows[:30] + rows[201:202], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["kept"] for x in rules.quality_rules(few, vocabulary(rules.VOCABULARY)).collect()}
    assert not got.pop(1001) and all(got.values())


def test_fence_by_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = rules.quality_rules(d, vocabulary(rules.VOCABULARY)).filter("not base_failed").join(labels.select("doc_id", "quality"), "doc_id")
    rates = {x["quality"]: x["r"] for x in judged.groupBy("quality").agg(F.avg((~F.col("kept")).cast("int")).alias("r")).collect()}
    assert rates[0] > 0.8 and rates[1] < 0.05


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeated_words(words):
    assert rules.repeated_words(words) == brute_rules(" ".join(words))[4]


def test_repeated_words_of_long_texts():
    r = random.Random(1)
    words = [r.choice("abcdefghij") for _ in range(rules._LONG + 500)]
    assert rules.repeated_words(words) == brute_rules(" ".join(words))[4]


# ---------------------------------------------------------------- mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
        open_ -= over
    return target


def test_mixing(spark, docs, none):
    r = random.Random(2)
    many = spark.createDataFrame([(i, " ".join("w" for _ in range(r.randint(0, 60))), r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(3000)], "doc_id long, text string, source string")
    small = spark.createDataFrame([(5000 + i, "w w w", "tiny") for i in range(4)], "doc_id long, text string, source string")
    df = many.unionByName(small)
    got = mixing.mix(df, shard_docs=100).collect()
    sizes = Counter()
    for x in got:
        sizes[x["source"]] += x["size"]
    want = brute_targets(sizes)
    taken = Counter()
    for x in got:
        taken[x["source"]] += x["taken"]
        assert 0 <= x["taken"] <= 3 * x["size"] and x["source_size"] == sizes[x["source"]]
        assert abs(x["target"] - want[x["source"]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= mixing.BLOCK_WORDS
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5), shard_docs=100).collect()), key=str)
    assert mixing.mix(docs, keep=("text", "n_chars")).count() == docs.count()
    assert mixing.mix(none).count() == 0


def test_sainte_lague(spark):
    r = random.Random(3)
    rows = [(g, str(i), float(r.choice([0, 1, 1, 2, 3, 5, 1000, 7.5]))) for g in "ab" for i in range(20)]
    df = spark.createDataFrame(rows, "g string, i string, share double")
    for seats in (0, 1, 17, 1000):
        got = {(x["g"], x["i"]): x["won"] for x in mixing.sainte_lague(df, F.lit(seats), ["g"], ["i"], "share", "won").collect()}
        for g in "ab":
            quotients = sorted(((-s / (2 * k + 1), i, k) for h, i, s in rows if h == g and s > 0 for k in range(seats + 1)))[:seats]
            want = Counter(i for _, i, _ in quotients)
            mine = {i: n for (h, i), n in got.items() if h == g}
            assert sum(mine.values()) == seats
            share = {i: s for h, i, s in rows if h == g}
            worst = min((share[i] / (2 * n - 1) for i, n in mine.items() if n), default=math.inf)
            best = max((share[i] / (2 * n + 1) for i, n in mine.items()), default=0)
            assert worst >= best - 1e-9 and sorted(want.values()) == sorted(n for n in mine.values() if n)


# ---------------------------------------------------------------- packing


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = vocabulary(packing.VOCABULARY)
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for d, t in rows_of(docs):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[d, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.pack(packing.tokenized_pieces(docs, path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 4096) + 1
    assert packing.pack(packing.tokenized_pieces(none, path)).count() == 0


def test_packing_of_documents_takes_one_worker_a_task(docs, none, monkeypatch):
    path = vocabulary(packing.VOCABULARY)
    want = packing.pack(packing.tokenized_pieces(docs, path)).collect()
    steps = []
    monkeypatch.setattr(packing, "arrow_map", lambda df, run, kind: steps.append(kind) or common.arrow_map(df, run, kind))
    assert Counter(packing.pack_documents(docs, path).collect()) == Counter(want)
    assert len(steps) == 1
    assert packing.pack_documents(none, path).count() == 0


def test_workers_keep_a_tokenizer_until_they_turn_to_another_step():
    path = vocabulary(packing.VOCABULARY)
    first = packing.word_tokenizer(path)
    common.trim()  # its task ends
    assert packing.word_tokenizer(path) is first
    common.trim()
    common.trim()  # a task of another step ends
    assert not packing._TOKENIZERS



def sequences(pieces, **options):
    got = packing.pack(pieces, **options).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count(F.lit(1)).alias("k")).collect()
    assert all(x["n"] == x["end"] <= 4096 for x in got)
    return len(got), sum(x["k"] for x in got)


@pytest.mark.parametrize("lengths", ["mixed", "over half", "half full", "equal"])
def test_tree_of_bins(spark, monkeypatch, lengths):
    r = random.Random(4)
    kinds = {"mixed": lambda: r.choice([r.randint(1, 4096), r.randint(1, 300)]), "over half": lambda: r.choice([r.randint(2049, 4000), r.randint(2049, 4000), r.randint(1, 900)]), "half full": lambda: r.randint(1000, 2200), "equal": lambda: 1500}
    rows = [(i, 0, 0, kinds[lengths](), i) for i in range(5000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(40)
    n, k = sequences(pieces, fan_in=3)
    assert k == len(rows)
    _, _, fill = packing.best_fit(np.array([x[3] for x in rows]))  # all at once
    assert n <= 1.02 * len(fill) + 1
    monkeypatch.setattr(packing, "reach", lambda fan_in, levels: 1 << 40)  # every bin goes on
    assert sequences(pieces, fan_in=3) == (n, k)
    monkeypatch.undo()
    monkeypatch.setattr(packing, "CHUNK", 7)  # bins stay open from chunk to chunk
    m, k = sequences(pieces.coalesce(2), fan_in=3)
    assert k == len(rows) and m <= 1.1 * len(fill) + 1


# ---------------------------------------------------------------- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header class="site"><p>Site name</p></header><nav><ul><li><a>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><aside><p>More</p></aside><{tag}><h1>Head {i}</h1><p>First &amp; <b>bold{i}</b>
 text&nbsp;end.<p>Second {i} <script>var x = "</p>";</script></p><div class="ad">Buy</div><form><p>Name</p></form></{tag}>
<section id="comments"><article class="comment"><p>Nice {i}</p></article></section><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(tag="article" if i % 2 else 'div class="story"', i=i)) for i in range(8)]
    rows += [(8, None, None), (9, "http://one.example/", "<p>alone<br>here <"), (9, "http://one.example/", "<p>alone<br>here <"), (None, "x", ""), (11, "http://h0.example/t", "<article><p>cut &am")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    got = html.extract(df).collect()
    by = {r["page_id"]: r["text"] for r in got}
    for i in range(8):
        assert by[i] == f"Head {i}\nFirst & bold{i} text end.\nSecond {i}"
    assert by[8] == "" and by[9] == "alone here <" and by[11] == "cut &am" and len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(df.limit(0)).count() == 0
    assert {r["host"] for r in html.templates(df).collect() if r["main"] is not None} >= {"h0.example", "h1.example"}


def extracted(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in sorted(html.extract(df).collect(), key=lambda r: r["page_id"])], df


def test_html_template_decides(spark):
    """What tags and names alone don't tell: a frame of plain elements, a form around all, a telling class inside the article; a line that all articles have stays."""
    plain = "<html><body><div><div><p>Our shop {x}</p></div><div><p>Text {i} of page {i} goes on {i}.</p><p>Bye {i}</p></div><div><p>Made by us</p></div></div></body></html>"
    pages = [("http://plain/", plain.format(i=i, x="")) for i in range(6)]
    form = "<body><form><nav><a href=x>Home {i}</a></nav><div class='box'><h1>Title {i}</h1><p>Words {i} of a long article that goes on {i} and on.</p><div class='share-price'>Price {i}</div></div></form><footer>f {i}</footer></body>"
    pages += [("http://form/", form.format(i=i)) for i in range(5)]
    note = "<body><article><h1>Head {i}</h1><p>Please read our terms</p><p>A long text {i} {i} of many words, {i} more words and {i} still more, so that the constant line is small beside it: {j}.</p></article></body>"
    pages += [("http://note/", note.format(i=i, j="x" * (200 + i))) for i in range(5)]
    got, df = extracted(spark, pages)
    assert got[:6] == [f"Text {i} of page {i} goes on {i}.\nBye {i}" for i in range(6)]
    assert got[6:11] == [f"Title {i}\nWords {i} of a long article that goes on {i} and on.\nPrice {i}" for i in range(5)]
    assert got[11:] == [f"Head {i}\nPlease read our terms\nA long text {i} {i} of many words, {i} more words and {i} still more, so that the constant line is small beside it: {'x' * (200 + i)}." for i in range(5)]
    without = ["\n".join(html.by_rules(html.parse(h))) for _, h in pages]
    assert without[6:] == got[6:] and all(a != b for a, b in zip(without[:6], got[:6], strict=True))
    twice, _ = extracted(spark, [p for p in pages for _ in range(2)])  # equal pages count once
    assert twice == [t for t in got for _ in range(2)]
    few = [p for p in pages if p[0] == "http://plain/"][:2] * 4
    assert extracted(spark, few)[0][0] == without[0]  # two different pages make no template


def test_html_near_copies_keep_their_text(spark):
    page = "<body><nav><ul><li>Menu</li></ul></nav><article><h1>One story</h1>{p}<p>changed {i}</p></article></body>"
    body = "".join(f"<p>Paragraph {k} that all copies share word by word.</p>" for k in range(5))
    got, _ = extracted(spark, [("http://c/", page.format(p=body, i=i)) for i in range(6)])
    assert got == ["\n".join(["One story", *(f"Paragraph {k} that all copies share word by word." for k in range(5)), f"changed {i}"]) for i in range(6)]


def test_html_keeps_what_articles_share(spark):
    """A dateline, a paragraph and a licence line that all articles of a host have, with and without an article element."""
    shared = ["Berlin, Monday", "A paragraph that every page of the host tells again.", "Licensed under terms that are the same everywhere."]
    for tag in ("article", "div"):
        page = "<body><div><p>Our site</p></div><" + tag + "><h1>Head {i}</h1><p>Berlin, Monday</p><p>A paragraph that every page of the host tells again.</p>{own}<p>Licensed under terms that are the same everywhere.</p></" + tag + "><div><p>Made by us</p></div></body>"
        own = lambda i: [f"Own paragraph {k} of page {i}, with words {i * k} of its own and more of them {i + k}." for k in range(6)]
        got, _ = extracted(spark, [(f"http://{tag}/{i}", page.format(i=i, own="".join(f"<p>{p}</p>" for p in own(i)))) for i in range(8)])
        assert got == ["\n".join([f"Head {i}", *shared[:2], *own(i), shared[2]]) for i in range(8)], tag


def test_html_names(spark):
    rows = [("share-price", True), ("noticeable", True), ("cookie-notice", False), ("related-posts", False), ("ad", False), ("download-form-help", True)]
    for name, stays in rows:
        page = html.parse(f"<article><h1>T</h1><p>long text of the article</p><div class='{name}'>inner</div></article>")
        assert ("inner" in html.by_rules(page)) == stays, name
    assert html.by_rules(html.parse("<form><h1>T</h1><p>all of it</p></form>")) == ["T", "all of it"]
    assert html.by_rules(html.parse("<div><h1>T</h1><p>text text text text</p><form><p>Name</p></form></div>")) == ["T", "text text text text"]
    assert html.by_rules(html.parse("<p>a <b>b<br>c</p><table><tr><td>x<td>y</tr></table><p>z <span hidden>no</span>q")) == ["a b c", "x y", "z q"]


def test_html_classes_against_brute_force(spark):
    r = random.Random(9)
    parts = ["<div class='top'><p>Same</p></div>", "<ul><li>a</li><li>b</li></ul>", "<section><p>x{i}</p></section>", "<div><p>{i}</p></div>", "<aside>s</aside>", "<p>Same</p>"]
    pages = [(f"http://h{h}/{k}", "<html><body>" + "".join(r.choice([p, p, ""]) if n % 2 else p for n, p in enumerate(r.sample(parts, len(parts)) if h == 2 else parts)).replace("{i}", str(k)) + "</body></html>") for h in range(3) for k in range(9)]
    pages += [(f"http://h3/{k}", "<body>" + "".join(r.sample(parts, len(parts))).replace("{i}", str(k)) + "</body>") for k in range(9)]  # in no order
    pages += pages[:5]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    found = html.page_tokens(df).cache()
    made = html.classes(found).cache()
    got = {(c["host"], frozenset(m["token"] for m in x["members"])) for c in made.collect() for x in c["classes"]}
    valid = {(v["host"], v["class"]): v["n"] for v in html.valid_classes(found, made).collect()}
    got_valid = {(c["host"], frozenset(m["token"] for m in x["members"]), valid[c["host"], x["class"]]) for c in made.collect() for x in c["classes"] if (c["host"], x["class"]) in valid}
    want, want_valid = set(), set()
    for host in {html.host(u) for u, _ in pages}:
        unique = [html.tokens(html.parse(h)) for h in dict.fromkeys(h for u, h in pages if html.host(u) == host)]
        vectors: dict = defaultdict(dict)
        wholes: dict = defaultdict(set)
        for k, page in enumerate(unique):
            for t in page:
                vectors[t["token"]][k] = t["n"]
                wholes[t["token"]].add(t["whole"])
        by = defaultdict(set)
        tags = {t["token"]: t["tag"] for page in unique for t in page}
        for t, v in vectors.items():
            by_turn = tags[t] is not None and max(v.values()) == 1 and max(wholes[t]) > 1
            if len(v) >= 3 and 2 * len(v) >= len(unique) and not (by_turn and len(wholes[t]) > 1):
                by[tuple(sorted(v.items()))].add(t)
        for v, members in by.items():
            want.add((host, frozenset(members)))
            orders = Counter()
            for k, _ in v:
                line = [t for _, t in sorted((p, t["token"]) for t in unique[k] if t["token"] in members for p in t["places"])]
                rounds = [tuple(line[i : i + len(members)]) for i in range(0, len(line), len(members))]
                if len(set(rounds)) == 1 and len(set(rounds[0])) == len(members):
                    orders[rounds[0]] += 1
            if len(members) > 1 and orders and 2 * max(orders.values()) > len(v):
                want_valid.add((host, frozenset(members), max(orders.values())))
    assert got == want and got_valid == want_valid and len(want_valid) >= 3 and any(len(m) > 1 and (h, m) not in {x[:2] for x in want_valid} for h, m in want)


def test_html_long_page(spark):
    page = "<body><nav><p>menu</p></nav><article><h1>Long</h1>" + "".join(f"<p>{i} {'word ' * 30}</p>" for i in range(40_000)) + "</article></body>"
    got, _ = extracted(spark, [("http://l/1", page), ("http://l/2", "<body><article><p>short</p></article></body>")])
    assert got[0].startswith("Long\n0 word") and got[0].count("\n") == 40_000 and got[1] == "short"


# ---------------------------------------------------------------- media


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=5))
def test_media_round_trip(texts):
    files = media.pack_texts(texts)
    for t, im in zip(texts, jpeg.decode_coefficients(files), strict=True):
        payload, n = media.unpack(im)
        assert n == len(t) and payload == t.ljust(max(64, -(-n // 64) * 64), b"\0")


def test_colour_and_interleaved_scans():
    r = np.random.default_rng(0)
    y, cb, cr = (r.integers(-30, 30, (n, 64)).astype(np.int16) for n in (24, 6, 6))
    im = jpeg.decode_coefficients([jpeg.encode(48, 32, [jpeg.Component(y, 2, 2), jpeg.Component(cb), jpeg.Component(cr)])])[0]
    assert all((a == b).all() for a, b in zip(im.coefficients, (y, cb, cr), strict=True))
    assert jpeg.rgb(im).shape == (32, 48, 3)
    flat = np.zeros((6, 64), np.int16)
    grey = jpeg.decode_coefficients([jpeg.encode(24, 16, [jpeg.Component(flat)])])[0]
    assert (jpeg.rgb(grey) == 128).all()


def test_inverse_transform_is_orthonormal():
    assert np.allclose(jpeg._INVERSE.T @ jpeg._INVERSE, np.eye(64))
    assert sorted(jpeg.ZIGZAG) == list(range(64)) and list(jpeg.ZIGZAG[:6]) == [0, 1, 8, 16, 9, 2]


def test_media_chroma_is_upsampled_into_a_stored_tensor(spark):
    texts = ["", "x" * 64, "né " * 700, "a longer text, of several units. " * 300]
    stored = media.with_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in media.with_tensors(stored).collect()}
    features = {r["doc_id"]: r["feature"] for r in media.media_digest(stored).collect()}
    files = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    for i, r in rows.items():
        im = jpeg.decode_coefficients([files[i]])[0]
        assert im.factors == [(2, 2), (1, 1), (1, 1)]
        tensor = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)
        y, cb, cr = (jpeg.plane(im.coefficients[k], *im.grid(k), np.ones(64)).astype(float) for k in range(3))
        assert y.shape == (2 * cb.shape[0], 2 * cb.shape[1]) == tensor.shape[:2]
        for px, py in {(0, 0), (r["width"] - 1, r["height"] - 1), (r["width"] // 2, 5)}:  # each chroma sample holds for four pixels
            b, c = cb[py // 2, px // 2] - 128, cr[py // 2, px // 2] - 128
            want = [y[py, px] + 1.402 * c, y[py, px] - 0.344136 * b - 0.714136 * c, y[py, px] + 1.772 * b]
            assert np.abs(np.clip(want, 0, 255) - tensor[py, px]).max() <= 0.51
        assert features[i] == media.feature(tensor) and features[i].startswith(f"{r['width']}x{r['height']}:")
        assert media.unpack(im)[0].rstrip(b"\0") == texts[i].encode()


def test_media_images_are_transformed_together(monkeypatch):
    rng = random.Random(5)
    files = media.pack_texts([rng.randbytes(n) for n in (0, 1, 63, 64, 500, 3000, 20_000, 7)])
    images = jpeg.decode_coefficients(files)
    alone = [jpeg.rgb(im) for im in images]
    calls = []
    transform = jpeg._samples
    monkeypatch.setattr(jpeg, "_samples", lambda blocks: calls.append(len(blocks)) or transform(blocks))
    found = jpeg.tensors(images)
    assert len(calls) == 1
    for im, x, y in zip(images, alone, found, strict=True):
        assert np.array_equal(x, y) and x.shape == (im.height, im.width, 3)
        planes = [jpeg.plane(c, *im.grid(i), np.ones(64)).astype(float) for i, c in enumerate(im.coefficients)]
        cb, cr = (np.kron(p - 128, np.ones((2, 2))) for p in planes[1:])
        green = planes[0] + np.floor(-0.344136 * cb - 0.714136 * cr + 0.5 + 1e-6)
        assert np.array_equal(x[..., 1], np.clip(green, 0, 255)[: im.height, : im.width])


def test_media_codes_are_written_bit_by_bit():
    rng = random.Random(6)
    seg = np.sort([rng.randrange(40) for _ in range(3000)] + list(range(40)))
    length = np.array([rng.randrange(1, 49) for _ in seg])
    value = np.array([rng.getrandbits(int(n)) for n in length])
    data, starts = jpeg._write(value, length, seg, 40)
    for s in range(40):
        bits = "".join(format(v, f"0{n}b") for v, n in zip(value[seg == s].tolist(), length[seg == s].tolist(), strict=True))
        bits += "1" * (-len(bits) % 8)
        assert data[starts[s] : starts[s + 1]].tobytes() == int(bits, 2).to_bytes(len(bits) // 8)



def test_media_query(docs, none):
    got = media.media_digest(media.with_media(docs)).collect()
    want = Counter()
    for d, t in rows_of(docs):
        p = t.encode()
        full = p.ljust(max(64, -(-len(p) // 64) * 64), b"\0")
        want[d, len(p), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    same = defaultdict(set)
    for r in got:
        same[r["payload_sha256"], r["n_bytes"]].add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in same.values())
    assert media.media_digest(media.with_media(none)).count() == 0


# ---------------------------------------------------------------- near duplicates


def test_dart_minhash_estimates_weighted_jaccard():
    r = np.random.default_rng(1)
    a, b = r.random(300) * 3, r.random(300) * 3
    own = np.repeat([0, 1], 300)
    sig = dart.signatures(own, np.tile(np.arange(300), 2), np.concatenate([a, b]), 3, 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    assert (sig[:2] != 0).all() and not sig[2].any()


def test_dart_minhash_costs_no_more_beside_a_small_set():
    """A set of one element has a thousand rank cells; the others aren't gone through for each of them."""
    n, k = 100_000, 144
    element, one = np.arange(n + 1), np.ones(n + 1)
    large = np.arange(n) // 1000
    with_small = np.append(large, 100)

    def took(own):
        best = np.inf
        for _ in range(3):
            began = time.process_time()
            sig = dart.signatures(own, element[: len(own)], one[: len(own)], 101, k)
            best = min(best, time.process_time() - began)
        return best, sig

    alone, sig = took(large)
    beside, both = took(with_small)
    assert beside < 3 * alone
    assert np.array_equal(sig[:100], both[:100])
    assert np.array_equal(both[100:], dart.signatures(np.zeros(1, int), element[n:], one[n:], 1, k))



def brute_components(rows):
    """Rows by component of texts that are equal or have five-word shingles at a similarity of 0.8."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = []
    for _, t in rows:
        w = WORD.findall(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][1] == rows[j][1] or (sets[i] and sets[j] and both >= 0.8 * len(sets[i] | sets[j])):
                parent[find(i)] = find(j)
    out = {}
    for i, row in enumerate(rows):
        out.setdefault(find(i), []).append(row)
    return list(out.values())


def brute_classes(rows):
    out = Counter()
    for part in brute_components(rows):
        low = min((d for d, _ in part if d is not None), default=None)
        out.update((d, low) for d, _ in part)
    return out


def brute_kept(rows):
    """Of each class the row with the smallest id, ties to the text with the least MD5."""
    parts = brute_components(rows)
    return Counter(min(((d, hashlib.md5(t.encode()).hexdigest(), t) for d, t in part))[::2] for part in parts)


@pytest.mark.parametrize("small", [48, 2])
def test_near_classes(spark, docs, none, small):
    r = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    out, i = [], 0
    for _ in range(6):
        base = [r.choice(words) for _ in range(80)]
        for _ in range(25):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                w[r.randrange(80)] = r.choice(words)
            out.append((i, " ".join(w)))
            i += 1
    df = spark.createDataFrame(out, "doc_id long, text string")
    got = Counter((x["doc_id"], x["class_id"]) for x in near.near_classes(df, small=small).collect())
    assert got == brute_classes(out)
    odd = Counter((x["doc_id"], x["class_id"]) for x in near.near_classes(docs).collect())
    assert odd == brute_classes(rows_of(docs))
    assert near.near_classes(none).count() == 0


def classes_of_variants(texts):
    """Classes of unweighted shingle sets by all pairs: a label for each text."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    number: dict = {}
    ids = [[number.setdefault(s, len(number)) for s in x] for x in sets]
    seen = Counter(i for x in ids for i in x)
    n = np.array([len(x) for x in sets], np.float32)
    place = {i: k for k, i in enumerate(i for i, c in seen.items() if c > 1)}
    has = np.zeros((len(sets), len(place)), np.float32)
    for row, x in enumerate(ids):
        has[row, [place[i] for i in x if i in place]] = 1
    both = has @ has.T
    linked = both >= 0.8 * (n[:, None] + n[None, :] - both) - 1e-3
    label = np.full(len(sets), -1)
    for i in range(len(sets)):
        todo = [i] if label[i] < 0 else []
        while todo:
            k = todo.pop()
            new = np.flatnonzero(linked[k] & (label < 0))
            label[new] = i
            todo += new.tolist()
    return label


@pytest.mark.parametrize("block", [near.BLOCK, 40_000])
def test_near_classes_of_thousands_of_variants(spark, block):
    r = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    base = [r.choice(words) for _ in range(150)]
    texts = []
    for _ in range(3000):
        w = list(base)
        for k in r.sample(range(150), r.choice([2, 3])):
            w[k] = r.choice(words)
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["class_id"] for x in near.near_classes(df, block=block).collect()}
    want = dict(enumerate(classes_of_variants(texts).tolist()))
    assert got == want


# ---------------------------------------------------------------- warc


def test_arc_versions():
    records = [("http://a/%20b", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody\nWARC/1.1\r\n\r\n"), ("dns:x", "0.0.0.0", "bad", "text/dns", b""), ("http://c/", "::1", "20010203040506", "text/plain", "é\r\n\r\n".encode())]
    for version in (1, 2):
        got = list(warc.parse_arc(warc.write_arc(records, version)))
        assert [(r.url, r.ip, r.date, r.mime, r.body) for r in got] == records and {r.version for r in got} == {version}
        out = b"".join(warc.to_warc(r) + warc.TERMINATOR for r in got)
        read = list(warc.parse_warc(out))
        assert [f["WARC-Type"] for f, _ in read] == ["response", "resource", "resource"]
        assert [b for _, b in read] == [r[4] for r in records]
        assert read[0][0]["WARC-Date"] == "2001-02-03T04:05:06Z" and read[1][0]["WARC-Date"] == "1970-01-01T00:00:00Z"
    assert len({f["WARC-Record-ID"] for f, _ in read}) == 3
    with pytest.raises(ValueError, match="declares"):
        list(warc.parse_arc(warc.write_arc(records)[:-3]))


def test_warc_revisits(spark, tmp_path):
    big = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(3, "http://a", big), (1, "http://b", big), (2, None, "tiny"), (5, "http://c c", "tiny"), (4, "http://d", None), (1, "http://b", big), (None, "http://e", big), (6, "http://f", "é" * 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    warc.write_archives(df, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    n = len(big.encode())
    assert kinds == Counter([(3, "revisit", 1, n), (1, "response", None, n), (1, "response", None, n), (None, "revisit", 1, n), (2, "response", None, 4), (5, "response", None, 4), (4, "response", None, 0), (6, "response", None, 120)])
    for file_bytes, files in ((warc.FILE_BYTES, 1), (1, 8)):  # files end after so many bytes
        at = str(tmp_path / f"f{file_bytes}")
        warc.write_archives(df.coalesce(1).withColumn("page", F.lit("clash")).withColumn("file", F.lit("clash")), at, file_bytes=file_bytes)
        contents = [r["content"] for r in spark.read.format("binaryFile").load(at).collect() if r["content"]]
        assert len(contents) == files
        fields = [f for c in contents for f, _ in warc.parse_warc(c)]
        ids = {f["WARC-Record-ID"]: (f["X-Page-Id"], f["WARC-Target-URI"], f["WARC-Date"]) for f in fields}
        revisits = [f for f in fields if f["WARC-Type"] == "revisit"]
        assert len(revisits) == 2
        for f in revisits:
            assert ids[f["WARC-Refers-To"]] == (f["X-Refers-To-Page"], f["WARC-Refers-To-Target-URI"], f["WARC-Refers-To-Date"]) == ("1", "http://b", f["WARC-Date"])
    warc.write_archives(df.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


# ---------------------------------------------------------------- suffix arrays


@settings(max_examples=120, deadline=None)
@given(st.text("ab", max_size=90) | st.text("abcd", max_size=60), st.sampled_from([0, 60, 1 << 20]))
def test_suffix_array(text, memory):
    b = text.encode()
    sa, lcp = suffix_array(np.frombuffer(b, np.uint8), 20, memory)
    want = sorted(range(len(b)), key=lambda i: b[i:])
    assert sa.tolist() == want
    for k in range(1, len(want)):
        x, y = b[want[k - 1] :], b[want[k] :]
        n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert lcp[k] == min(n, 20)


def brute_removal(rows):
    first = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - 49):
            if d is not None:
                first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    out = Counter()
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def test_substrings(spark, docs, none):
    r = random.Random(8)
    pool = ["".join(r.choice("abcdefgh é") for _ in range(r.randint(30, 120))) for _ in range(12)]
    rows = [(r.randint(0, 50), "".join(r.choice(pool) if r.random() < 0.6 else "".join(r.choice("xyz ") for _ in range(20)) for _ in range(6))) for _ in range(60)]
    rows += [(90, "a" * 400), (91, "a" * 300 + "b"), (92, "ab" * 100), (93, "ab" * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def got(x):
        return Counter((y["doc_id"], y["n_bytes"], y["n_removed"], y["n_spans"], y["kept_sha256"]) for y in substrings.remove_repeats(x, memory=1000).collect())

    assert got(df) == brute_removal(rows)
    assert got(docs) == brute_removal(rows_of(docs))
    assert substrings.remove_repeats(none).count() == 0
    kept = substrings.remove_repeats(df, with_text=True).collect()
    assert all(len(x["kept"]) == x["n_bytes"] - x["n_removed"] for x in kept)
    with pytest.raises(ValueError, match="made here"):
        substrings.remove_repeats(df.withColumn("n_bytes", F.lit(1)), keep=("n_bytes",))


def test_substrings_where_nothing_repeats(spark):
    r = random.Random(12)
    rows = [(i, " ".join(str(r.random()) for _ in range(20))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.remove_repeats(df).collect()
    assert len(got) == 30 and all(x["n_removed"] == x["n_spans"] == 0 for x in got)


def test_blocks_of_ids_in_even_steps():
    block = substrings._dealt(np.arange(10_000) * 49, 49)
    assert np.bincount(block, minlength=49).max() < 300


# ---------------------------------------------------------------- perplexity


def symbols_of(text, unit):
    return list(text) if unit == "char" else WORD.findall(text)


def brute_kneser(train, grams, unit, order):
    """Interpolated modified Kneser-Ney probabilities of n-grams (tuples), straight from the definition."""
    pad = [kneser.START] * (order - 1)
    top = Counter(tuple(s[i - order + 1 : i + 1]) for t in train for s in [pad + symbols_of(t, unit)] for i in range(order - 1, len(s)))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    tables = {}
    for n, c in counts.items():
        k = Counter(c.values())
        if k[1] and k[2]:
            y = k[1] / (k[1] + 2 * k[2])
            raw = [1 - 2 * y * k[2] / k[1], 2 - 3 * y * k[3] / k[2], 3 - 4 * y * k[4] / k[3] if k[3] else 1.5]
        else:
            raw = [0.5, 1.0, 1.5]
        tables[n] = [max(0.05, min(i + 0.95, x)) for i, x in enumerate(raw)]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        n, ctx = len(g), g[:-1]
        near_ = {h: c for h, c in counts[n].items() if h[:-1] == ctx}
        if not near_:
            return p(g[1:])
        total, d = sum(near_.values()), tables[n]
        own = max(near_.get(g, 0) - d[min(near_.get(g, 1), 3) - 1], 0) if g in near_ else 0
        gamma = sum(d[min(c, 3) - 1] for c in near_.values()) / total
        return own / total + gamma * p(g[1:])

    return {g: p(g) for g in grams}


@pytest.mark.parametrize("unit, order", [("char", 4), ("char", 5), ("word", 3)])
def test_kneser_ney(spark, unit, order):
    train = ["the cat sat on the mat and the rat", "a cat and a rat sat", "the mat the mat the cat", "zzz 🙂\U0002f81a\0 z"]
    ask = ["the rat", "xyz the", "zzzz", "", "a", "🙂\U0002f81b\0 the cat sat", None]
    docs = spark.createDataFrame([("en", t) for t in train], "lang string, text string")
    model = kneser.train(kneser.corpus_grams(docs, unit, order), unit, order)
    rows = spark.createDataFrame([(i, "en", t) for i, t in enumerate(ask)] + [(90, "xx", "no model")], "_id long, _lang string, text string").coalesce(1)
    pad = [kneser.START] * (order - 1)
    want = {90: None}
    for i, t in enumerate(ask):
        s = pad + symbols_of(t or "", unit)
        grams = [tuple(s[j - order + 1 : j + 1]) for j in range(order - 1, len(s))]
        want[i] = -sum(math.log(brute_kneser(train, [g], unit, order)[g]) for g in grams) / len(grams) if grams else None
    for block_bytes in (1 << 20, 3):
        scored = kneser.block_scores(rows, model, ("_id", "text"), block_bytes)
        got = {r["_id"]: r for r in kneser.row_scores(scored, {"_id": "long", "text": "string"}).collect()}
        assert got.keys() == want.keys() and got[6]["text"] is None
        for i, x in want.items():
            assert got[i]["_n"] == len(symbols_of((ask[i] or "") if i < 90 else "no model", unit))
            assert (got[i]["_nll"] is None) == (x is None) and (x is None or abs(got[i]["_nll"] / got[i]["_n"] - x) < 1e-5), (i, got[i], x)
    some = {("the" if unit == "word" else "e") for _ in "x"}
    lead = tuple("the") + tuple(" " * max(0, order - 4)) if unit == "char" else ("and",) * (order - 1)
    total = brute_kneser(train, [(*lead[: order - 1], c) for c in sorted({x for t in train for x in symbols_of(t, unit)} | some)], unit, order)
    assert sum(total.values()) < 1 + 1e-9


def test_numbers_beyond_63_bits():
    texts = ["".join(chr(0x4E00 + i) for i in range(3000)), "ab\0"]
    for order in (4, 6):
        numbers = kneser.Numbers(texts, "char", order)
        assert numbers.exact == (order == 4)
        keys, n = numbers.read(texts)
        pad = kneser.START * (order - 1)
        grams = [(pad + t)[i : i + order] for t in texts for i in range(len(t))]
        assert n.tolist() == [3000, 3] and (numbers.of_grams(grams) == keys).all() and len(set(keys.tolist())) == len(set(grams))
        if numbers.exact:
            assert numbers.written(keys) == grams
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x", "x"]), pa.array(texts)], ["_lang", "text"])
    exact, hashed = ({g: c for _, grams, n in kneser._distinct(batch, "char", o) for g, c in zip(grams, n.tolist(), strict=True)} for o in (4, 6))
    assert sum(exact.values()) == sum(hashed.values()) == 3003 and kneser.START * 5 + "a" in hashed


def test_thresholds_are_of_held_out_documents(spark):
    words = ["the", "court", "held", "that", "law", "is", "clear", "and", "so"]
    rows = [(i, " ".join(random.Random(i).choice(words) for _ in range(random.Random(-i).randint(3, 80))), "en" if i % 3 else None) for i in range(300)] + [(900, "zz zz zz zz zz zz zz zz", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in kneser.classify(df, labels, quantile=0.9).collect()}
    part = {r["i"]: r["p"] for r in spark.createDataFrame([(i,) for i in got], "i long").select("i", kneser._part("i").alias("p")).collect()}
    for lang in ("en", None):
        own = [r for r in got.values() if r["lang"] == lang]
        held = [r for r in own if r["doc_id"] < 200 and part[r["doc_id"]] >= kneser.TRAIN_SHARE]
        assert 4 < len(held) < 60
        centre = sum(r["mean_nll"] * r["n_scored"] for r in held) / sum(r["n_scored"] for r in held)
        score = {r["doc_id"]: (r["mean_nll"] * r["n_scored"] + 64 * centre) / (r["n_scored"] + 64) for r in own}
        limit = sorted(score[r["doc_id"]] for r in held)[math.ceil(0.9 * len(held)) - 1] * kneser.MARGIN
        for r in own:
            assert abs(r["score"] - score[r["doc_id"]]) < 1e-6 and abs(r["threshold"] - limit) < 1e-6 and r["kept"] == (r["score"] <= r["threshold"])
    assert not got[900]["kept"]


def test_classifier(spark, docs, none):
    good = [" ".join(random.Random(i).choice(["the", "court", "held", "that", "law", "is", "clear"]) for _ in range(60)) for i in range(120)]
    bad = ["#$%&" * 60, "qqq zzz xxx " * 20]
    rows = [(i, t, "en") for i, t in enumerate(good + bad)] + [(500, None, "en"), (501, "?!", "xx"), (None, good[0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(1, 1, None), (120, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in kneser.classify(df, labels).collect()}
    assert not got[120] and not got[121] and got[500] and got[501] and got[None]
    assert sum(got[i] for i in range(120)) >= 117
    only = kneser.classify(df, labels, columns=("doc_id", "text", "lang"), scores=(), kept_only=True)
    assert only.columns == ["doc_id", "text", "lang"] and only.count() == sum(got.values())
    assert kneser.classify(none.select("doc_id", "text", "lang"), labels).count() == 0
    assert kneser.classify(docs, labels.limit(0)).filter("not kept").count() == 0


def test_rare_language_has_threshold_and_model(spark):
    ids = [r[0] for r in spark.range(12_000).orderBy(F.xxhash64("id")).collect()]
    rare, words = set(ids[-5:]), ["la", "maison", "est", "grande", "et", "belle"]
    text = lambda i: " ".join(random.Random(i).choice(words) for _ in range(40 if i in rare else 4))
    rows = [(i, text(i), "yy" if i in rare else "en") for i in ids] + [(20_000, "#$%&" * 60, "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).cache()
    labels = spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id long, quality int, toxic int")
    for most in ({}, {"max_trusted": 2000}):
        got = {r["doc_id"]: r for r in kneser.classify(df, labels, **most).filter("lang = 'yy'").collect()}
        assert all(r["threshold"] is not None for r in got.values())
        assert not got[20_000]["kept"] and all(got[i]["kept"] for i in rare)
    assert kneser._shares({"a": 5, None: 100, "b": 1000}, 105) == {"a": 1.0, None: 0.5, "b": 0.05}
    assert kneser._shares({"a": 100, "b": 200}, 1000) == {"a": 0.75, "b": 0.75}


# ---------------------------------------------------------------- registry and pipeline


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in registry.QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    source = spark.read.parquet(f"{sf}/documents.parquet")
    got = p.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(got.columns)
    assert got.count() > 0 and got.select("doc_id").subtract(source.select("doc_id")).count() == 0
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, source, sf)
        assert out.dtypes == source.dtypes, name


def test_pipeline_stages_against_brute_force(spark, docs):
    import corpus_pipeline as p

    named = docs.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id is not null")
    rows = [(r["doc_id"], r["text"] or "") for r in named.collect()]
    kept = p.near_dedup(spark, named, "").collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in kept) == brute_kept(rows)
    texts = Counter((r["doc_id"], r["text"]) for r in p.suffix_dedup(spark, named, "").collect())
    first: dict = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    want = Counter()
    for d, t in rows:
        b, gone = t.encode(), set()
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone.update(range(i, i + 50))
        left = bytes(x for i, x in enumerate(b) if i not in gone).decode("utf-8", "ignore")
        if not gone or left.strip(" "):
            want[d, left] += 1
    assert texts == want
    mixed = Counter(r["doc_id"] for r in p.source_mix(spark, named, "").collect())
    assert set(mixed) <= {d for d, _ in rows} and max(mixed.values()) <= 3 * max(Counter(d for d, _ in rows).values())


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    columns = ("doc_id", "text", "lang", "source", "n_chars")
    odd = odd_documents(spark).select(*columns).union(spark.createDataFrame([(None, None, None, None, None), (None, "a null id", "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long"))
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        docs.coalesce(2).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (7, 1, None), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        got = Counter(r["doc_id"] for r in p.run(spark, str(tmp_path / name)).filter("piece = 0").collect())
        ids = {r["doc_id"] for r in docs.collect()}
        assert (not got) if name == "empty" else 4 in got and len(got) > 3 and set(got) <= ids  # 4 has no words: the mix takes it once


def test_near_dedup_keeps_one_of_each_class(spark, docs):
    import corpus_pipeline as p

    named = docs.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id is not null")
    kept = Counter(x["doc_id"] for x in p.near_dedup(spark, named, "").collect())
    assert kept[7] == 2 and kept[1] == 1 and not kept[2] and not kept[8]  # doc_id 7 has two unrelated texts
    texts = [" ".join(f"t{i}w{k}" for k in range(60)) for i in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (5, texts[4]), (6, texts[4]), (None, texts[5]), (9, texts[5]), (None, None), (None, "")]
    df = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    got = Counter((x["doc_id"], x["text"] or "") for x in p.near_dedup(spark, df, "").collect())
    assert got == Counter([(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (9, texts[5]), (None, "")])
