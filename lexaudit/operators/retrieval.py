"""Name retrieval: BM25 over act names, cosine over vectors, top-k suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexaudit.functions import text as T
from lexaudit.operators import vectors
from lexaudit.session import grown

#: Public defaults of the Okapi scoring: term saturation, length weight, share of the mean idf given to common terms.
K1, B, EPSILON = 1.5, 0.75, 0.25


def bm25_index(names: DataFrame, name: str = "act_norm", k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """(doc, term, weight): what a query term adds to a name's score. Names count once.

    A term in over half of the names has a negative idf and gets a share of the mean idf instead."""
    docs = names.select(F.col(name).alias("doc")).distinct().withColumn("terms", T.significant_words(F.col("doc")))
    size = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("terms")).alias("mean_len"))
    terms = docs.select("doc", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    df = terms.groupBy(F.col("term").alias("t")).agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(size).select("t", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    fixed = idf.join(mean).select("t", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    weight = F.col("idf") * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    return terms.join(fixed, F.col("term") == F.col("t")).join(size).select("doc", "term", weight.alias("weight"))


def bm25_scores(queries: DataFrame, index: DataFrame, query: str = "query") -> DataFrame:
    """(query, doc, score) of all names that share a term with the query."""
    asked = queries.select(F.col(query).alias("query"), F.explode(T.significant_words(F.col(query))).alias("q"))
    return asked.join(index, F.col("q") == F.col("term")).groupBy("query", "doc").agg(F.sum("weight").alias("score"))


def bm25_similarity(queries: DataFrame, index: DataFrame, query: str = "query") -> DataFrame:
    """Scores as a share of the score a name gets for itself, at most 1; 0 where that isn't positive."""
    own = index.groupBy(F.col("doc").alias("d")).agg(F.sum("weight").alias("self"))  # a name has all of its terms
    scored = bm25_scores(queries, index, query).join(own, F.col("doc") == F.col("d"))
    return scored.select("query", "doc", F.when(F.col("self") > 0, F.least(F.lit(1.0), F.col("score") / F.col("self"))).otherwise(F.lit(0.0)).alias("similarity"))


def bm25_among(queries: DataFrame, names: DataFrame, index: DataFrame, *by: str) -> DataFrame:
    """(query, doc, similarity) of the names that share ``by`` with a query, by the self-score ratio of ``bm25_similarity``.

    ``queries``: query and ``by``; ``names``: doc and ``by``. Only such pairs are scored."""
    own = index.groupBy(F.col("doc").alias("d")).agg(F.sum("weight").alias("self"))  # a name has all of its terms
    pairs = queries.join(grown(names.distinct()), list(by)).select("query", "doc").distinct()
    asked = pairs.select("query", "doc", F.explode(T.significant_words(F.col("query"))).alias("q"))
    weights = index.select(F.col("doc").alias("i"), "term", "weight")
    scored = asked.join(grown(weights), (F.col("doc") == F.col("i")) & (F.col("q") == F.col("term"))).groupBy("query", "doc").agg(F.sum("weight").alias("score")).join(grown(own), F.col("doc") == F.col("d"))
    return scored.select("query", "doc", F.when(F.col("self") > 0, F.least(F.lit(1.0), F.col("score") / F.col("self"))).otherwise(F.lit(0.0)).alias("similarity"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def nearest(queries: DataFrame, items: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k most similar items of each query vector: (query_id, id, similarity, rank); ties by id.

    By an index of cells that is exact by bounds (``vectors``); its jobs run while the result is planned. Null
    vectors are like nothing."""
    return vectors.search(vectors.cell_index(items, ident, vector), queries, k, ident, vector)[0]


def cosine_among(queries: DataFrame, names: DataFrame, embedded: DataFrame, *by: str) -> DataFrame:
    """(query, doc, similarity) of the names that share ``by`` with a query, by the cosine of their vectors.

    ``queries``: query and ``by``; ``names``: doc and ``by``; ``embedded``: name, vector (one a name). Names without a
    vector, or with one of no length, are like nothing: 0. Such scores take the place of word overlap in linkage."""
    pairs = queries.join(grown(names.distinct()), list(by)).select("query", "doc").distinct()
    a = embedded.select(F.col("name").alias("_a"), F.col("vector").alias("_v"))
    b = embedded.select(F.col("name").alias("_b"), F.col("vector").alias("_w"))
    both = pairs.join(grown(a), F.col("query") == F.col("_a"), "left").join(grown(b), F.col("doc") == F.col("_b"), "left")
    return both.select("query", "doc", F.coalesce(cosine(F.col("_v"), F.col("_w")), F.lit(0.0)).alias("similarity"))


def suggest(similar: DataFrame, evidence: DataFrame, k: int = 5) -> DataFrame:
    """Records of the k acts most like each query, in the acts' order, cut to k: (query, ..., rank)."""
    acts = similar.withColumn("act_rank", F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "doc"))).filter(F.col("act_rank") <= k)
    rows = acts.join(evidence, F.col("doc") == F.col("act_norm"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("act_rank", "pool_ord"))).filter(F.col("rank") <= k)


# ---- fixed values: act names a citation may use, with a part of the act's name that it means, or must not be taken for
SAME_ACT = (
    ("Evidence Act", "indian evidence"), ("the Indian Evidence Act", "indian evidence"), ("Penal Code", "indian penal code"), ("Code of Criminal Procedure", "code of criminal procedure"),
    ("Criminal Procedure Code", "code of criminal procedure"), ("Code of Civil Procedure", "code of civil procedure"), ("Civil Procedure Code", "code of civil procedure"),
    ("Prevention of Corruption Act", "prevention of corruption"), ("Corruption Act", "prevention of corruption"), ("Arbitration and Conciliation Act", "arbitration and conciliation"),
    ("Transfer of Property Act", "transfer of property"), ("Negotiable Instruments Act", "negotiable instruments"), ("Industrial Disputes Act", "industrial disputes"), ("Land Acquisition Act", "land acquisition"),
    ("Limitation Act", "limitation act"), ("Customs Act", "customs act"), ("Income Tax Act", "income tax act"), ("Essential Commodities Act", "essential commodities"),
    ("Representation of the People Act", "representation of the people"), ("General Clauses Act", "general clauses"), ("Arms Act", "arms act"),
)
OTHER_ACT = (
    ("Code of Civil Procedure", "code of criminal procedure"), ("Code of Criminal Procedure", "code of civil procedure"), ("Civil Procedure Code", "code of criminal procedure"),
    ("Prevention of Corruption Act", "prevention of food adulteration"), ("Prevention of Food Adulteration Act", "prevention of corruption"), ("Arbitration Act, 1940", "arbitration and conciliation"),
    ("Arbitration and Conciliation Act, 1996", "arbitration act 1940"), ("Income Tax Act", "income tax rules"), ("Income Tax Rules", "income tax act 1961"),
)
# ---- end of fixed values


def name_pairs(acts: DataFrame, name: str = "act_norm") -> DataFrame:
    """(query, doc, should_match): the name pairs, each with the first act of ``acts`` whose name has the part."""
    spark = acts.sparkSession
    pairs = F.broadcast(spark.createDataFrame([(q, p, True) for q, p in SAME_ACT] + [(q, p, False) for q, p in OTHER_ACT], "raw string, part string, should_match boolean"))
    docs = acts.select(F.col(name).alias("doc")).distinct()
    found = docs.join(pairs, F.contains("doc", F.col("part"))).groupBy("raw", "part", "should_match").agg(F.min("doc").alias("doc"))
    return found.select(T.normal_act(F.col("raw")).alias("query"), "doc", "should_match")


def pair_similarities(pairs: DataFrame, index: DataFrame, embedded: DataFrame | None = None) -> DataFrame:
    """Name pairs by each method: word overlap, BM25's self-score ratio and, given vectors (name, vector), their cosine: adds ``method`` and ``similarity``."""
    overlap = T.token_overlap(T.significant_words(F.col("query")), T.significant_words(F.col("doc")))
    out = pairs.withColumn("method", F.lit("jaccard")).withColumn("similarity", overlap)
    asked, named = pairs.select("query", F.lit(1).alias("k")).distinct(), pairs.select(F.lit(1).alias("k"), "doc")
    others = {"bm25": bm25_among(asked, named, index, "k")}
    if embedded is not None:
        others["embedding"] = cosine_among(asked, named, embedded, "k")
    for method, scored in others.items():
        s = scored.select(F.col("query").alias("_q"), F.col("doc").alias("_d"), "similarity")
        own = pairs.withColumn("method", F.lit(method)).join(s, (F.col("query") == F.col("_q")) & (F.col("doc") == F.col("_d")), "left").drop("_q", "_d")
        out = out.unionByName(own.withColumn("similarity", F.coalesce("similarity", F.lit(0.0))))
    return out


def method_report(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Name pairs (query, doc, should_match, method, similarity): accepted and rejected by method."""
    hit = F.coalesce("similarity", F.lit(0.0)) >= threshold
    return pairs.groupBy("method").agg(
        F.count_if(F.col("should_match")).alias("n_positive"), F.count_if(F.col("should_match") & hit).alias("accepted_right"),
        F.count_if(~F.col("should_match")).alias("n_negative"), F.count_if(~F.col("should_match") & ~hit).alias("rejected_right"),
    )
