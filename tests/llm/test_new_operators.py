"""Byte-level BPE, phrase collocations and fill-in-middle against a public library and brute force, and on odd tables."""

import base64
import functools
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexaudit.llm import bpe, fim
from lexaudit.llm import collocations as co
from lexaudit.llm.common import vocabulary
from tests.llm.test_llm_operators import odd_documents

PATH = vocabulary(bpe.VOCABULARY)
TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \t\n\x0b\r\x1c\x85\xa0ab<PSM>'sé世🙂1"), st.characters(exclude_categories=["Cs"])), max_size=80)


@pytest.fixture(scope="module")
def docs(spark):
    return odd_documents(spark).repartition(3).cache()


@functools.cache
def _library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.public_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return _library()


# ---------------------------------------------------------------- byte-level BPE


def test_perfect_hash_is_minimal_and_exact():
    r = random.Random(1)
    keys = list({bytes(r.randrange(256) for _ in range(r.randint(1, 9))) for _ in range(5000)})
    h = bpe.PerfectHash(keys)
    assert sorted(h.order.tolist()) == list(range(len(keys)))  # as many numbers as keys
    assert h.find(pa.array(keys, pa.binary())).tolist() == list(range(len(keys)))
    others = [k + b"x" for k in keys if k + b"x" not in set(keys)] + [b"", b"y" * 40]
    assert (h.find(pa.array(others, pa.binary())) == -1).all()
    with pytest.raises(ValueError, match="different"):
        bpe.PerfectHash([b"a", b"a"])
    one = bpe.PerfectHash([b"only"])
    assert one.find(pa.array([b"only", b"none"], pa.binary())).tolist() == [0, -1]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_bpe_equals_the_library(texts):
    vocab, lib = bpe.load(PATH, bpe.public_pattern()), _library()
    ids, sizes = vocab.encode(texts)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == [lib.encode_ordinary(t) for t in texts]


def test_bpe_of_long_texts_and_runs(library):
    r = random.Random(2)
    vocab = bpe.load(PATH, bpe.public_pattern())
    run = "".join(r.choice("abcdeé世") for _ in range(20_000))
    texts = [run, " ".join(run[i : i + 9] for i in range(0, len(run), 9)), "a" * 3000, " " * 5000, ""]
    was, bpe.BLOCK = bpe.BLOCK, 1000
    try:
        ids, sizes = vocab.encode(texts)
    finally:
        bpe.BLOCK = was
    edges = np.concatenate([[0], np.cumsum(sizes)])
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]


def test_bpe_heaps_of_short_matches_advance_together(monkeypatch):
    vocab = bpe.Vocabulary(PATH, bpe.public_pattern())
    some = random.Random(7)
    words = [bytes(some.choices(b"abe \xd0\xbe\xd1\x82\xe4\xb8\x96", k=some.randint(1, 90))) for _ in range(400)] + [b"a" * 64, b"a" * 65, "не".encode() * 16, b"\xff"]
    own = [vocab.merged(w) for w in words]
    ids, sizes = vocab._all_merged(pa.array(words, pa.binary()))
    assert np.split(ids, np.cumsum(sizes)[:-1])[0].tolist() == own[0] and ids.tolist() == [i for x in own for i in x] and sizes.tolist() == list(map(len, own))

    def alone(match):
        raise AssertionError(f"{match} is merged alone")

    short = pa.array([w for w in words if len(w) <= bpe.WIDE], pa.binary())
    monkeypatch.setattr(vocab, "merged", alone)
    assert vocab.encode_matches(short)[1].sum() > 0


def test_bpe_of_odd_and_empty_tables(spark, docs, library):
    encoded = bpe.encode(docs, PATH, keep=("doc_id", "text", "size"))
    rows = encoded.collect()
    assert len(rows) == docs.count() and all(r["ids"] == library.encode_ordinary(r["text"] or "") for r in rows)
    decoded = bpe.decode(encoded, PATH, keep=("doc_id", "text")).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in decoded)
    digests = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.bpe_digest(bpe.encode(docs, PATH), PATH).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == Counter((r["doc_id"], len(r["ids"]), sha(",".join(map(str, r["ids"])).encode()), sha((r["text"] or "").encode())) for r in rows)
    assert bpe.bpe_digest(bpe.encode(docs.limit(0), PATH), PATH).count() == 0
    with pytest.raises(ValueError, match="clash"):
        bpe.encode(docs.withColumn("ids", F.lit(1)), PATH, keep=("ids",))
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe.decode(nulls, PATH).collect()] == [b"", b""]
    with pytest.raises(Exception, match="vocabulary has"):
        bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), PATH).collect()


# ---------------------------------------------------------------- collocations


def brute_collocations(rows, min_count, max_words, subsume, top):
    f: dict = {}
    for text, lang in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            for n in range(1, max_words + 1):
                for i in range(len(words) - n + 1):
                    key = (lang or "und", tuple(words[i : i + n]))
                    f[key] = f.get(key, 0) + 1
    out = []
    for lang in {k[0] for k in f}:
        n = sum(v for (own, w), v in f.items() if own == lang and len(w) == 1)
        known = {w: v for (own, w), v in f.items() if own == lang and len(w) > 1 and v >= min_count}
        kept = []
        for w, a in known.items():
            if any(len(o) > len(w) and any(o[i : i + len(w)] == w for i in range(len(o))) and 100 * b >= subsume * a for o, b in known.items()):
                continue
            score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return sorted(out)


def phrase_rows(seed, n=60):
    r = random.Random(seed)
    words = [*(f"w{i}" for i in range(25)), "É", "ab_c", "%x", "\x0b", "\x85", "Zz"]
    phrases = ["New York City", "new york", "of the", "a b c d", "a b c"]
    join = lambda: r.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", "!"])
    return [("".join((r.choice(phrases) if r.random() < 0.4 else r.choice(words)) + join() for _ in range(r.randint(0, 60))), r.choice(["en", "en", "en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize(("width", "max_words", "top"), [(8, 3, 2000), (64, 4, 2000), (1 << 16, 3, 7)])
def test_collocations_against_brute_force(spark, width, max_words, top):
    rows = phrase_rows(max_words)
    df = spark.createDataFrame([(i, t, g, "x") for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, phrase string").repartition(5)
    got = sorted(tuple(r) for r in co.collocations(df, 5, max_words, 50, top, width).collect())
    assert got == brute_collocations(rows, 5, max_words, 50, top) and len(got) > 5


def test_collocations_in_small_blocks(spark, monkeypatch):
    """Texts cut where pieces end, in one task."""
    rows = phrase_rows(9, 30)
    for size in (1, 7, 50):
        data, offsets = fim.text_bytes(pa.array([t for t, _ in rows]))
        cuts = list(co._chunks(data, offsets, size))
        assert cuts[0][0] == 0 and cuts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
        total: Counter = Counter()
        for a, b in cuts:
            lo, hi = np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b)
            block = co.Block(data[a:b], np.clip(offsets[lo : hi + 1], a, b) - a, np.zeros(hi - lo, np.int64), np.ones(1, np.uint64), 3)
            for n, g in enumerate(block.grams, 1):
                total.update(dict(zip(block.phrases(n, np.arange(len(g.counts))).to_pylist(), g.counts.tolist(), strict=True)))
        want: Counter = Counter()
        for t, _ in rows:
            for piece in re.split("[.,;:!?\n-\r]", t.translate({c: c + 32 for c in range(65, 91)})):
                w = re.findall("[^ \t]+", piece)
                want.update(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
        assert total == want


def test_collocations_score_beyond_64_bits(spark):
    big = 3 * 10**9
    counts = spark.createDataFrame([("en", 0, "", 10**11), ("en", 1, "a", big), ("en", 1, "b", big + 7), ("en", 2, "a b", big - 5)], "lang string, words int, phrase string, f long")
    r = co.scored(counts).first()
    assert r["score"] == 1000000 * (big - 5) ** 2 // (big * (big + 7)) and (r["l"], r["r"]) == (big, big + 7)


def test_collocations_of_odd_and_empty_tables(spark, docs):
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    got = sorted(tuple(r) for r in co.collocations(docs, 2).collect())
    assert got == brute_collocations(rows, 2, 3, 50, 2000) and got
    none = co.collocations(docs.limit(0))
    assert none.count() == 0 and none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    with pytest.raises(ValueError, match="power of two"):
        co.ngram_counts(docs, width=100)
    with pytest.raises(ValueError, match="1 to 255"):
        co.ngram_counts(docs, min_count=300, width=64)


# ---------------------------------------------------------------- fill-in-middle


def brute_cut(text, unit, k):
    units = re.findall("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text) if unit == "token" else list(text)
    return len(units), len("".join(units[:k]).encode())


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6), st.sampled_from(["token", "char"]), st.integers(0, 1 << 32), st.integers(0, 1 << 32))
def test_fim_runs_find_every_cut(texts, unit, one, two):
    data, offsets = fim.text_bytes(pa.array(texts, pa.string()))
    runs = fim.Runs(data, offsets, unit)
    assert runs.n.tolist() == [brute_cut(t, unit, 0)[0] for t in texts]
    for h in (one, two):
        cut = h % (runs.n + 1)
        assert (runs.place(cut) - offsets[:-1]).tolist() == [brute_cut(t, unit, k)[1] for t, k in zip(texts, cut.tolist(), strict=True)]


def brute_fim(doc_id, text, unit):
    t = text or ""
    units = re.findall("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", t) if unit == "token" else list(t)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, t
    form = "spm" if h4 % 100 < 80 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["token", "char"])
def test_fim_against_brute_force(spark, docs, unit):
    r = random.Random(7)
    rows = [(i, "".join(r.choice(["a", "b ", " \n", "é", "世", "<", "P", "S>", "<P", "🙂", "\t", "<M>" if i % 9 == 0 else "M>"]) for _ in range(r.randint(0, 40)))) for i in range(300)]
    more = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, size string")
    both = docs.select("doc_id", "text", "size").unionByName(more)
    got = fim.fill_in_middle(both, keep=("doc_id", "text", "size"), unit=unit).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == both.count() and {g["form"] for g in got} == {"plain", "psm", "spm"}
    for g in got:
        assert (g["n"], g["form"], g["prefix_chars"], g["middle_chars"], g["output"]) == brute_fim(g["doc_id"], g["text"], unit)
        assert g["back"] == (g["text"] or "")


def test_fim_of_empty_and_clashing_tables(docs):
    assert fim.fim_digest(fim.fill_in_middle(docs.limit(0))).count() == 0
    with pytest.raises(ValueError, match="clash"):
        fim.fill_in_middle(docs, keep=("n",))
    with pytest.raises(ValueError, match="unit"):
        fim.fill_in_middle(docs, unit="word")
    got = fim.fim_digest(fim.fill_in_middle(docs))  # with columns of clashing names beside
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] and got.count() == docs.count()
