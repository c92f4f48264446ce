"""The cell index against all pairs, and cosines in linkage."""

import numpy as np
import pytest

from lexaudit.operators import retrieval, vectors


def all_pairs(queries, items, k):
    out = set()
    for q, v in queries:
        if v is None:
            continue
        like = []
        for i, w in items:
            if w is not None:
                a, b = np.asarray(v, float), np.asarray(w, float)
                size = np.sqrt((a * a).sum() * (b * b).sum())
                like.append((-round(float(a @ b / size), 6) if size else 0.0, i))
        out |= {(q, i, -s + 0.0, r) for r, (s, i) in enumerate(sorted(like)[:k], 1)}
    return out


def tables(spark, seed, n, groups, noise):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, 16))
    rows = [(i, (centres[i % groups] + noise * r.normal(size=16)).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, rows[0][1]), (n + 3, rows[0][1])]
    asked = [(i, v) for i, v in rows if i % 7 == 0] + [(10**6, [0.0] * 16), (10**6 + 1, None)]
    make = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<double>").repartition(4)
    return asked, rows, make(asked), make(rows)


@pytest.mark.parametrize(("groups", "noise"), [(25, 0.03), (3, 5.0)])
def test_index_equals_all_pairs(spark, monkeypatch, groups, noise):
    monkeypatch.setattr(vectors, "ROWS", 40)  # cells and their queries in several shares
    monkeypatch.setattr(vectors, "QUERIES", 9)
    asked, rows, q, items = tables(spark, groups, 600, groups, noise)
    index = vectors.cell_index(items)
    found, products = vectors.search(index, q, 5)
    assert {tuple(r) for r in found.collect()} == all_pairs(asked, rows, 5)
    if noise < 1:
        assert products < 0.3 * len(asked) * len(rows)
    more, _ = vectors.search(index, q, 1000)  # more than there are
    assert {tuple(r) for r in more.collect()} == all_pairs(asked, rows, 1000)


def test_bounds_spare_most_products_of_clustered_vectors(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(60, 32))
    rows = [(i, (centres[i % 60] + 0.05 * r.normal(size=32)).tolist()) for i in range(6000)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = items.filter("vec_id % 50 = 0")
    found, products = vectors.search(vectors.cell_index(items), q, 5, probes=2)
    assert {tuple(x) for x in found.collect()} == all_pairs([x for x in rows if x[0] % 50 == 0], rows, 5)
    assert products < 0.1 * 120 * 6000


def test_index_of_odd_tables(spark):
    _, _, q, items = tables(spark, 1, 20, 2, 1.0)
    assert vectors.search(vectors.cell_index(items.limit(0)), q, 5)[0].count() == 0
    assert vectors.search(vectors.cell_index(items), q.limit(0), 5)[0].count() == 0
    assert retrieval.nearest(q, items, 3).columns == ["query_id", "id", "similarity", "rank"]
    with pytest.raises(ValueError, match="numbers"):
        vectors.cell_index(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_three_methods_over_name_pairs(spark):
    acts = spark.createDataFrame([(a,) for a in ("indian penal code 1860", "code of criminal procedure 1973", "code of civil procedure 1908", "arms act 1959")], "act_norm string")
    pairs = retrieval.name_pairs(acts)
    spelled = sorted({r["query"] for r in pairs.collect()} | {r["act_norm"] for r in acts.collect()})
    embedded = spark.createDataFrame([(n, [1.0, float("civil" in n), float("criminal" in n)]) for n in spelled if "arms" not in n], "name string, vector array<double>")
    got = {r["method"]: r for r in retrieval.method_report(retrieval.pair_similarities(pairs, retrieval.bm25_index(acts), embedded)).collect()}
    assert got.keys() == {"jaccard", "bm25", "embedding"} and len({r["n_positive"] for r in got.values()}) == 1
    assert got["embedding"]["rejected_right"] == got["embedding"]["n_negative"]  # civil and criminal are apart
    assert got["embedding"]["accepted_right"] == got["embedding"]["n_positive"] - 1  # no vector for the arms act


def test_linkage_with_many_records_of_a_provision(spark, monkeypatch):
    """Blocks of a provision's records give what one block of all gives, and what a plain search gives."""
    import random

    from pyspark.sql import functions as F

    from lexaudit.operators import evidence

    r = random.Random(2)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    act = lambda: " ".join(r.sample(words, r.randint(2, 5))) + r.choice(["", " 1950", " 1960"])
    records = [(f"K{i}", f"Act {i}", "Section", "7" if i % 50 else "8", r.choice([None, None, "1"]), "text", i, act()) for i in range(6000)]
    pool = spark.createDataFrame(records, "dataset_citation_key string, act string, provision_type string, provision_number string, subsection string, canonical_text string, pool_ord long, act_norm string")
    cited = [("Section", r.choice(["7", "7", "8", "9"]), r.choice([None, "1", "2"]), r.choice([x[7] for x in records[:40]]) if r.random() < 0.3 else act()) for _ in range(150)] + [("Section", "7", None, ""), ("Section", "7", None, None), ("Section", None, None, "worda")]
    c = spark.createDataFrame([(i, x) for i, x in enumerate(cited)], "id int, citation struct<provision_type: string, provision_number: string, subsection: string, act_norm: string>")
    look = lambda: {x["id"]: (x["match_method"], x["k"], x["fuzzy_score"], x["name_overlap"]) for x in evidence.match_evidence(c, pool).select("id", "match_method", F.col("evidence.dataset_citation_key").alias("k"), "fuzzy_score", "name_overlap").collect()}
    got = look()
    monkeypatch.setattr(evidence, "BLOCK", 10**9)
    assert look() == got
    monkeypatch.setattr(evidence, "BLOCK", 37)
    assert look() == got
    for i, (_, number, sub, name) in enumerate(cited):
        same = [x for x in records if x[3] == number]
        own = [x for x in same if name and x[7] == name]
        exact = [x for x in own if x[4] == sub] or [x for x in own if x[4] is None]
        if exact:
            assert got[i] == ("exact_normalized", exact[-1][0], None, None)
            continue
        if not same or not name:
            assert got[i][0] == "no_evidence" and got[i][1] is None
            continue
        split = lambda t: ({w for w in t.split() if w[0] == "w"}, {w for w in t.split() if w[0] != "w"})
        mine, years = split(name)
        like = lambda x: len(mine & split(x[7])[0]) / len(mine | split(x[7])[0])  # noqa: E731, B023
        open_ = [x for x in same if not (years and split(x[7])[1] and not years & split(x[7])[1])]
        best = max(open_, key=lambda x: (like(x), -x[6]))
        assert abs(got[i][2] - like(best)) < 1e-12 and abs(got[i][3] - max(map(like, same))) < 1e-12
        assert got[i][:2] == (("fuzzy", best[0]) if like(best) >= 0.8 else ("no_evidence", None))
