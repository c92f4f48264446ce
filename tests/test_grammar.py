"""Golden texts of the citation grammar."""

import pytest

from lexaudit.functions import grammar as G
from lexaudit.functions.diff import word_diff


def found(sentence):
    return [(c.provision_type, c.provision_number, c.subsection, c.act_norm) for c in G.citations(sentence)]


IPC, CRPC = "indian penal code 1860", "code of criminal procedure 1973"


@pytest.mark.parametrize(
    "name, norm",
    [
        ("The Indian Penal Code, 1860", IPC),
        ("The Indian Penal Code (IPC), 1860", IPC),
        ("The   Arms  Act,   1959", "arms act 1959"),
        ("IPC", IPC),
        ("the Evidence Act", "indian evidence act 1872"),
        ("Constitution", "constitution of india"),
        ("Narcotic Drugs and Psychotropic Substances Act, 1985", "narcotic drugs and psychotropic substances act 1985"),
    ],
)
def test_normal_act(name, norm):
    assert G.normal_act(name) == norm


@pytest.mark.parametrize(
    "sentence, expected",
    [
        ("Section 302 of the Indian Penal Code, 1860 prescribes death.", [("Section", "302", None, IPC)]),
        ("Sections 302 and 34 of the Indian Penal Code, 1860 apply.", [("Section", "302", None, IPC), ("Section", "34", None, IPC)]),
        ("Articles 1A, 31A, 31B, and 31C of the Constitution of India protect laws.", [("Article", n, None, "constitution of india") for n in ("1A", "31A", "31B", "31C")]),
        ("Art.227 of the Constitution of India guarantees it.", [("Article", "227", None, "constitution of india")]),
        ("Section 304, Part II of the Indian Penal Code, 1860 applies.", [("Section", "304", "Part II", IPC)]),
        ("Section 5(2) of the Prevention of Corruption Act, 1947 applies.", [("Section", "5", "2", "prevention of corruption act 1947")]),
        ("The Indian Penal Code, 1860 governs murder (Section 302).", [("Section", "302", None, IPC)]),
        ("Murder (Section 302) is grave.", [("Section", "302", None, "")]),
        ("Section 100 CrPC applies.", [("Section", "100", None, CRPC)]),
        ("Section 302, IPC applies.", [("Section", "302", None, IPC)]),
        ("The Regulations 2000 apply.", []),
        (
            "Sections 120-B and 471 of the Indian Penal Code and Section 5(2) of the Prevention of Corruption Act, 1947 apply.",
            [("Section", "120-B", None, IPC), ("Section", "471", None, IPC), ("Section", "5", "2", "prevention of corruption act 1947")],
        ),
        ("Subsection 2 is void.", [("Section", "2", None, "")]),
    ],
)
def test_citations(sentence, expected):
    assert found(sentence) == expected


def test_sentences_keep_abbreviated_articles():
    assert G.sentences("The court read Art. 32 widely. It held so. Arts. 14 and 21 apply.") == ["The court read Art. 32 widely.", "It held so.", "Arts. 14 and 21 apply."]
    assert G.sentences("  ") == []


def test_respectively_gives_number_and_item():
    s = "The sections 302, 149, 323, and 34 of the Indian Penal Code, 1860, which respectively deal with murder, criminal conspiracy, hurt, and common intention apply."
    claims = G.sentence_claims(s)
    assert [c.citation.provision_number for c in claims] == ["302", "149", "323", "34"]
    s = "The court applied sections 302, 149 and 34, which deal with murder, unlawful assembly and common intention respectively."
    spans = [c.spans for c in G.sentence_claims(s)]
    assert spans[0][0] == "302" and len(spans) == 3 and spans[2] == ["34", "common intention"]


def test_clauses():
    s = "Section 302 of the Indian Penal Code prescribes death, while Section 34 of the Indian Penal Code deals with common intention."
    a, b = G.sentence_claims(s)
    assert a.assertion == "Section 302 of the Indian Penal Code prescribes death"
    assert b.assertion == "Section 34 of the Indian Penal Code deals with common intention."
    s = "Sections 302 (murder), 34 (common intention) apply."
    assert [c.assertion for c in G.sentence_claims(s)] == ["Sections 302 (murder)", "34 (common intention)"]


@pytest.mark.parametrize("text", ["", None, "No law here.", "Section 1 of the A Act; Section 2 of the B Act; and Section 3."])
def test_invariants(text):
    for _, c in G.claims_of(text):
        assert c.assertion in c.sentence
        assert c.citation.act_norm is not None
        assert all(s in c.sentence for s in c.spans)


def test_word_diff():
    assert word_diff("a b c", "a x c") == [{"type": "same", "text": "a "}, {"type": "removed", "text": "b "}, {"type": "added", "text": "x "}, {"type": "same", "text": "c"}]
    assert word_diff(None, "") == []


def test_word_diff_keeps_as_many_words_as_can_be():
    import random

    from lexaudit.functions.diff import _TOKEN

    r = random.Random(4)
    for n in (0, 1, 2, 5, 17, 40):
        for _ in range(20):
            a, b = ("".join(r.choice(["a ", "b ", "c  ", "d\n"]) for _ in range(r.randint(0, n))) for _ in range(2))
            if r.random() < 0.5:
                b = a[: len(a) // 2 * 2] + b
            x, y = _TOKEN.findall(a), _TOKEN.findall(b)
            best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i in range(len(x) - 1, -1, -1):
                for j in range(len(y) - 1, -1, -1):
                    best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
            want, i, j = [], 0, 0
            while i < len(x) or j < len(y):
                if i < len(x) and j < len(y) and x[i] == y[j]:
                    kind, word, i, j = "same", x[i], i + 1, j + 1
                elif i < len(x) and (j == len(y) or best[i + 1][j] >= best[i][j + 1]):
                    kind, word, i = "removed", x[i], i + 1
                else:
                    kind, word, j = "added", y[j], j + 1
                if want and want[-1]["type"] == kind:
                    want[-1]["text"] += word
                else:
                    want.append({"type": kind, "text": word})
            assert word_diff(a, b) == want


def test_word_diff_of_long_texts_in_bounded_memory():
    import random
    import tracemalloc

    r = random.Random(5)
    a = [f"w{r.randint(0, 3000)} " for _ in range(12_000)]
    b = [w for w in a if r.random() > 0.02]
    for _ in range(200):
        b.insert(r.randrange(len(b)), "new ")
    tracemalloc.start()
    got = word_diff("".join(a), "".join(b))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    kept = sum(len(s["text"].split()) for s in got if s["type"] == "same")
    assert kept >= len([w for w in b if w != "new "]) and most < 60 << 20  # a full matrix has 550 MB
    assert "".join(s["text"] for s in got if s["type"] != "added") == "".join(a) and "".join(s["text"] for s in got if s["type"] != "removed") == "".join(b)
