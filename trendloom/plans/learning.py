"""Text analytics and models (family M), and trend ideas (F31)."""

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.splits import channel_split
from trendloom.functions.text import let, phrase_counts, tokens, words
from trendloom.operators import acceptance as A
from trendloom.operators import models as L
from trendloom.operators import similarity as Y
from trendloom.operators import textml as X
from trendloom.operators import tiles as T
from trendloom.operators.components import checkpointed
from trendloom.plans.registry import query
from trendloom.sources.views import Views

c = F.col
TOP = "v AS (SELECT term FROM terms GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 50)"


def vocabulary(v: Views, n: int = 50):
    """The most frequent terms: a table of fixed size."""
    every = v.transcripts.select(F.explode(tokens(c("text"))).alias("term"))
    return every.groupBy("term").agg(F.count("*").alias("f")).orderBy(F.desc("f"), "term").limit(n).select("term")


def counted_terms(v: Views, names: list[str]):
    """(dataset_id, total, found): of each text with terms their number and the counts of the named ones, in one pass over the texts."""
    rows = v.transcripts.select("dataset_id", tokens(c("text")).alias("ws")).where(F.size("ws") > 0)
    rows = rows.select("dataset_id", F.size("ws").cast("long").alias("total"), F.filter("ws", lambda w: w.isin(*names)).alias("ws"))
    return rows.select("dataset_id", "total", phrase_counts(c("ws")).alias("found"))


@query("WITH " + TOP + ", s AS (SELECT dataset_id, sum(tf) AS total FROM terms GROUP BY 1) SELECT dataset_id, term, tf / total::DOUBLE AS weight FROM terms SEMI JOIN v USING (term) JOIN s USING (dataset_id)")
def m01_tf_vectors(v: Views):
    names = [r[0] for r in vocabulary(v).collect()]  # fifty words
    texts = counted_terms(v, names).groupBy("dataset_id").agg(F.sum("total").alias("total"), F.flatten(F.collect_list("found")).alias("found"))
    return texts.select("dataset_id", "total", F.inline("found")).select("dataset_id", c("value").alias("term"), (c("n") / c("total")).alias("weight"))


@query()
def m02_kmeans_texts(v: Views):
    terms = [r[0] for r in vocabulary(v, 20).orderBy("term").collect()]  # twenty words
    rows = counted_terms(v, terms).select("dataset_id", "total", F.map_from_arrays("found.value", "found.n").alias("found"))
    share = lambda t: F.sum(F.coalesce(F.try_element_at("found", F.lit(t)), F.lit(0))) / F.sum("total")
    tf = checkpointed(rows.groupBy("dataset_id").agg(*[share(t).alias(f"t{i}") for i, t in enumerate(terms)]))  # read again by every step of k-means
    return L.clusters(tf, [f"t{i}" for i in range(len(terms))], 4).groupBy("cluster").agg(F.count("*").alias("n"), F.min("dataset_id").alias("first_id"))


@query()
def m04_performance_clusters(v: Views):
    rows = v.content.select("dataset_id", F.log1p("views").alias("x"), F.log1p("likes").alias("y"), "views", "likes")
    got = L.clusters(rows, ["x", "y"], 2).groupBy("cluster").agg(F.count("*").alias("n"), F.avg("views").alias("mean_views"), F.avg("likes").alias("mean_likes"))
    order = F.row_number().over(Window.orderBy("mean_views"))  # two rows
    return got.select(F.when(order == 1, "low").otherwise("high").alias("level"), "n", "mean_views", "mean_likes")


TFIDF = """n AS (SELECT count(*) AS n FROM transcripts), df AS (SELECT term, count(*) AS df FROM terms GROUP BY 1), r AS (SELECT dataset_id, term, (1 + ln(tf::DOUBLE)) * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w FROM terms JOIN df USING (term), n),
nm AS (SELECT dataset_id, sqrt(sum(w * w)) AS norm FROM r GROUP BY 1), x AS (SELECT dataset_id, term, w / norm AS w FROM r JOIN nm USING (dataset_id)) """


CLOSE, POINTS = 0.6, 3


@query("WITH RECURSIVE " + TFIDF + f""", s AS MATERIALIZED (SELECT a.dataset_id AS a, b.dataset_id AS b, round(sum(a.w * b.w), 6) AS similarity FROM x a JOIN x b ON a.term = b.term WHERE a.dataset_id <> b.dataset_id GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 6) >= {CLOSE}),
core AS MATERIALIZED (SELECT a AS id FROM s GROUP BY 1 HAVING count(*) + 1 >= {POINTS}), e AS MATERIALIZED (SELECT a, b FROM s SEMI JOIN core c1 ON c1.id = a SEMI JOIN core c2 ON c2.id = b),
reach AS (SELECT id AS root, id FROM core UNION SELECT root, b FROM reach JOIN e ON reach.id = e.a AND root < b), named AS (SELECT id, min(root) AS cluster FROM reach GROUP BY 1),
border AS (SELECT a AS id, arg_min(cluster, (-similarity, b)) AS cluster FROM s JOIN named ON named.id = b ANTI JOIN core ON core.id = a GROUP BY 1)
SELECT d.dataset_id, coalesce(named.cluster, border.cluster, -1) AS cluster, CASE WHEN named.id IS NOT NULL THEN 'core' WHEN border.id IS NOT NULL THEN 'border' ELSE 'noise' END AS role
FROM (SELECT DISTINCT dataset_id FROM terms) d LEFT JOIN named ON named.id = d.dataset_id LEFT JOIN border ON border.id = d.dataset_id""")
def m03_density_groups(v: Views):
    """Density groups of texts by TF-IDF cosine: cores, borders and noise. Texts without terms have no vector and no row."""
    x = X.tfidf(v.terms, v.transcripts.agg(F.count("*").alias("n")))
    return Y.density_of(Y.folded(x, norm=True), CLOSE, POINTS).select(c("id").alias("dataset_id"), "cluster", "role")


@query("WITH " + TFIDF + """, s AS (SELECT a.dataset_id AS q_id, b.dataset_id, round(sum(a.w * b.w), 6) AS similarity FROM x a JOIN x b ON a.term = b.term WHERE a.dataset_id % 20 = 0 AND a.dataset_id <> b.dataset_id GROUP BY 1, 2)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, dataset_id) <= 5""")
def m05_tfidf_cosine(v: Views):
    """The five nearest texts of every query, the ids divisible by 20, against all texts."""
    x = X.tfidf(v.terms, v.transcripts.agg(F.count("*").alias("n")))
    return X.nearest_vectors(T.sorted_lists(x, norm=True), c("dataset_id") % 20 == 0, 5)


CENT = """u AS (SELECT vec_id, label, list_transform(vec, lambda y: y / sqrt(list_sum(list_transform(vec, lambda z: z * z)))) AS vec FROM vectors),
f AS (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM u), m AS (SELECT label, i, avg(x) AS x FROM f GROUP BY 1, 2), cen AS (SELECT label, list(x ORDER BY i) AS cvec FROM m GROUP BY 1) """


@query("WITH f AS (SELECT label, vec_id % 7 + 1 AS w, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vectors), m AS (SELECT label, i, sum(w * x) / sum(w) AS x FROM f GROUP BY 1, 2) SELECT label, i - 1 AS place, round(x, 6) AS x FROM m")
def m07_weighted_pooling(v: Views):
    w = c("vec_id") % 7 + 1
    flat = v.vectors.select("label", w.alias("w"), F.posexplode("vec").alias("place", "x"))
    return flat.groupBy("label", c("place").cast("long").alias("place")).agg(F.round(F.sum(c("w") * c("x")) / F.sum("w"), 6).alias("x"))


@query("""WITH q AS (SELECT vec_id AS q_id, vec AS q FROM vectors WHERE vec_id % 20 = 0), s AS (SELECT q_id, vec_id, round(list_sum(list_transform(range(1, len(q) + 1), lambda k: q[k] * vec[k])), 6) AS sim FROM q, vectors WHERE vec_id <> q_id)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, vec_id) <= 5""")
def m08_nearest_vectors(v: Views):
    queries = v.vectors.where("vec_id % 20 = 0").select(c("vec_id").alias("q_id"), c("vec").alias("q"))  # the stated query set, against all rows
    return X.nearest(v.vectors, queries, 5)


#: fixed values: words that mark a leaf by rule, in the order in which ties are decided
MARKERS = {"en": ("the", "and", "of"), "de": ("der", "die", "und"), "fr": ("les", "des", "une"), "es": ("que", "los", "las")}
RULE_BONUS = 0.08
SMALL = 200_000  #: rows of leaf and term that go to every task; more of them are shuffled
marked = lambda m: lambda w: w.isin(*m)
_MARKED = ", ".join(f"len(list_filter(ws, lambda x: x IN {m})) AS {leaf}" for leaf, m in MARKERS.items())
_MOST = f"greatest({', '.join(MARKERS)})"
_RULE = " ".join(f"WHEN {leaf} = {_MOST} THEN '{leaf}'" for leaf in MARKERS)


@query(r"""WITH p AS (SELECT leaf, term, sum(tf)::DOUBLE AS w FROM terms GROUP BY 1, 2), pn AS (SELECT leaf, sqrt(sum(w * w)) AS norm FROM p GROUP BY 1), dn AS (SELECT dataset_id, sqrt(sum(tf::DOUBLE * tf)) AS norm FROM terms GROUP BY 1),
z AS (SELECT leaf, count(*) AS size FROM transcripts GROUP BY 1),
s AS (SELECT t.dataset_id, p.leaf, round(sum(t.tf * w) / any_value(pn.norm) / any_value(dn.norm), 9) AS score FROM terms t JOIN p USING (term) JOIN pn ON pn.leaf = p.leaf JOIN dn ON dn.dataset_id = t.dataset_id GROUP BY 1, 2),
m AS (SELECT dataset_id, MARKED FROM (SELECT dataset_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS ws FROM transcripts)),
r AS (SELECT dataset_id, CASE WHEN MOST = 0 THEN NULL RULE END AS rule_leaf FROM m),
u AS (SELECT dataset_id, leaf, sum(score) AS score FROM (SELECT * FROM s UNION ALL SELECT dataset_id, rule_leaf, BONUS::DOUBLE FROM r) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, size DESC, leaf) AS place FROM u JOIN z USING (leaf)),
b AS (SELECT dataset_id, max(leaf) FILTER (place = 1) AS predicted, max(score) AS score, sum(score) AS total FROM k WHERE place <= 5 GROUP BY 1)
SELECT dataset_id, predicted, round(score, 6) AS score, round(least(1.0::DOUBLE, CASE WHEN total > 0 THEN score / total ELSE 0 END + CASE WHEN predicted IS NOT DISTINCT FROM rule_leaf THEN BONUS::DOUBLE ELSE 0 END), 6) AS confidence FROM b JOIN r USING (dataset_id)""".replace(
    "MARKED", _MARKED).replace("MOST", _MOST).replace("RULE END", f"{_RULE} END").replace("BONUS", str(RULE_BONUS)))
def m09_centroid_classifier(v: Views):
    """The leaf of the highest score: cosine with its centroid, and 0.08 more for the leaf that the rule names.

    The confidence is its share of the five highest scores, 0.08 more if the rule names it, at most 1. Ties go to the larger
    leaf, then by name; a text without terms that no rule places has no row.
    """
    p = checkpointed(v.transcripts.select("leaf", F.explode(tokens(c("text"))).alias("term")).groupBy("leaf", "term").agg(F.count("*").cast("double").alias("w")))
    pn = p.groupBy("leaf").agg(F.sqrt(F.sum(c("w") * c("w"))).alias("pnorm"))
    own = F.array(F.struct(F.lit(None).cast("string").alias("leaf"), F.lit(None).cast("double").alias("w")))  # of each term, for the length of the text itself
    by_term = p.groupBy("term").agg(F.concat(F.collect_list(F.when(c("leaf").isNotNull(), F.struct("leaf", "w"))), own).alias("x"))
    if p.count() <= SMALL:
        by_term = F.broadcast(by_term)
    sums = v.terms.select("dataset_id", "term", "tf").join(by_term, "term").select("dataset_id", "tf", F.inline("x")).groupBy("dataset_id", "leaf")
    sums = checkpointed(sums.agg(F.sum(c("tf") * F.coalesce("w", c("tf").cast("double"))).alias("s")))
    dn = sums.where("leaf is null").select("dataset_id", F.sqrt("s").alias("dnorm"))
    s = sums.where("leaf is not null").join(pn, "leaf").join(dn, "dataset_id").select("dataset_id", "leaf", F.round(c("s") / c("pnorm") / c("dnorm"), 9).alias("score"))
    counts = lambda ws: F.struct(*[F.size(F.filter(ws, marked(m))).alias(leaf) for leaf, m in MARKERS.items()])
    most = lambda n: F.greatest(*[n[leaf] for leaf in MARKERS])
    named = lambda n: F.coalesce(*[F.when((n[leaf] == most(n)) & (n[leaf] > 0), leaf) for leaf in MARKERS])
    rule = v.transcripts.select("dataset_id", let(F.filter(words(c("text")), marked(sum(MARKERS.values(), ()))), lambda ws: let(counts(ws), named)).alias("rule_leaf"))
    rule = checkpointed(rule)  # read twice below
    scores = s.unionByName(rule.select("dataset_id", c("rule_leaf").alias("leaf"), F.lit(RULE_BONUS).alias("score"))).groupBy("dataset_id", "leaf").agg(F.sum("score").alias("score"))
    sizes = v.transcripts.groupBy("leaf").agg(F.count("*").alias("size"))
    five = X.top_per(scores.join(sizes, "leaf"), ["dataset_id"], [F.desc("score"), F.desc("size"), "leaf"], 5)
    best = five.groupBy("dataset_id").agg(F.max(F.when(c("place") == 1, c("leaf"))).alias("predicted"), F.max("score").alias("score"), F.sum("score").alias("total")).join(rule, "dataset_id")
    share = F.when(c("total") > 0, c("score") / c("total")).otherwise(0.0) + F.when(c("predicted").eqNullSafe(c("rule_leaf")), RULE_BONUS).otherwise(0.0)
    return best.select("dataset_id", "predicted", F.round("score", 6).alias("score"), F.round(F.least(F.lit(1.0), share), 6).alias("confidence"))


def labelled(v: Views):
    return L.examples(v.transcripts.select("dataset_id", "channel", "split", "leaf", "text"), "leaf")


@query()
def m10_text_classifiers(v: Views):
    """Four classifiers on words and character runs, or on supplied vectors, each with its best parameter by grouped folds of the training rows."""
    texts = L.hashed(labelled(v))
    given = v.vectors.select(c("vec_id").alias("dataset_id"), F.concat(F.lit("ch"), c("vec_id") % 40).alias("channel"), array_to_vector("vec").alias("vector"), c("label").cast("double").alias("y"))
    given = checkpointed(given.withColumn("split", channel_split(c("channel"))))
    by_fold, out = L.scales(texts.where("split = 'train'")), []
    for kind, rows in (("nb", texts), ("lr", texts), ("svm", texts), ("vectors", given)):
        value, _ = L.grid_search(rows.where("split = 'train'"), kind, by_fold=by_fold)
        rows = L.scaled(rows, kind, by_fold[None])
        scored = L.classifier(kind, value).fit(rows.where("split = 'train'")).transform(rows.where("split <> 'train'"))
        out.append(L.macro_recall(scored, ["split"]).select("split", "n", "accuracy", "macro_recall", F.lit(kind).alias("model"), F.lit(value).alias("value")))
    return reduce(DataFrame.unionByName, out)


@query()
def m11_grouped_cross_validation(v: Views):
    return L.cross_validated(labelled(v), "nb").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("channel").alias("channels"), F.avg((c("y") == c("prediction")).cast("double")).alias("accuracy"))


@query()
def m12_predict_with_unknown(v: Views):
    rows = labelled(v)
    model = L.text_pipeline("lr").fit(rows.where("split = 'train'"))
    got = model.transform(rows).select("dataset_id", F.array_max(vector_to_array("probability")).alias("confidence"), "prediction", "labels")
    return got.select("dataset_id", "confidence", F.when(c("confidence") >= 0.6, F.get("labels", c("prediction").cast("int"))).otherwise("unknown").alias("predicted"))


SCOPE = ("en", "de", "fr")  #: labels in scope; others are unknown
SURE = 0.4
SIMILARITIES, MARGINS = [i / 20 for i in range(20)], [0.0, 0.05, 0.1]  #: fixed values: cutoffs that are tried
_IN_SCOPE = {leaf: m for leaf, m in MARKERS.items() if leaf in SCOPE}
_COUNTS = ", ".join(f"len(list_filter(ws, lambda x: x IN {m})) AS {leaf}" for leaf, m in _IN_SCOPE.items())
_SUM, _TOP = " + ".join(SCOPE), f"greatest({', '.join(SCOPE)})"
_PICK = " ".join(f"WHEN {leaf} = {_TOP} THEN '{leaf}'" for leaf in SCOPE)
SUPPORT = rf"""d AS MATERIALIZED (SELECT dataset_id, channel, split, text, CASE WHEN leaf IN {SCOPE} THEN leaf ELSE 'unknown' END AS gold, regexp_replace(lower(text), '\s+', ' ', 'g') AS low, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') AS ws FROM transcripts),
p AS MATERIALIZED (SELECT dataset_id, CASE {_PICK} END AS predicted, CASE WHEN {_SUM} = 0 THEN 0.0::DOUBLE ELSE {_TOP} / ({_SUM})::DOUBLE END AS confidence FROM (SELECT dataset_id, {_COUNTS} FROM d)),
g AS MATERIALIZED (SELECT dataset_id, term, count(*) AS n FROM (SELECT dataset_id, unnest(list_transform(range(1, length(low) - k + 2), lambda i: substr(low, i, k))) AS term FROM d, (VALUES (3), (4), (5)) z(k) WHERE split = 'ASKED' OR split = 'train' AND gold <> 'unknown') GROUP BY 1, 2),
tr AS MATERIALIZED (SELECT dataset_id, gold FROM d WHERE split = 'train' AND gold <> 'unknown'),
voc AS MATERIALIZED (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM tr)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM g SEMI JOIN tr USING (dataset_id) GROUP BY term ORDER BY sum(n) DESC, term LIMIT 30000),
rw AS MATERIALIZED (SELECT dataset_id, term, (1 + ln(n::DOUBLE)) * idf AS w FROM g JOIN voc USING (term)), xn AS (SELECT dataset_id, sqrt(sum(w * w)) AS norm FROM rw GROUP BY 1), x AS MATERIALIZED (SELECT dataset_id, term, w / norm AS w FROM rw JOIN xn USING (dataset_id)),
xq AS MATERIALIZED (SELECT dataset_id, term, w FROM x SEMI JOIN (SELECT dataset_id FROM d WHERE split = 'ASKED') USING (dataset_id)), xt AS MATERIALIZED (SELECT dataset_id AS other_id, term, w FROM x SEMI JOIN tr USING (dataset_id)),
dots AS MATERIALIZED (SELECT xq.dataset_id, other_id, sum(xq.w * xt.w) AS s FROM xq JOIN xt USING (term) GROUP BY 1, 2), sims AS (SELECT dots.dataset_id, tr.gold, s FROM dots JOIN tr ON tr.dataset_id = other_id),
sc AS MATERIALIZED (SELECT d.dataset_id, any_value(d.text) AS text, any_value(d.gold) AS gold, any_value(p.predicted) AS predicted, any_value(p.confidence) AS confidence, round(coalesce(max(s) FILTER (sims.gold = p.predicted), 0), 6) AS support,
 round(round(coalesce(max(s) FILTER (sims.gold = p.predicted), 0), 6) - round(coalesce(max(s) FILTER (sims.gold <> p.predicted), 0), 6), 6) AS margin FROM d JOIN p USING (dataset_id) LEFT JOIN sims USING (dataset_id) WHERE d.split = 'ASKED' GROUP BY 1)"""


def predicted_scope(v: Views):
    """Texts with gold, and the label of most marker words with its share of them: a predictor that needs no training."""
    n = F.struct(*[F.size(F.filter("ws", marked(m))).alias(leaf) for leaf, m in _IN_SCOPE.items()])
    most, total = F.greatest(*[c(f"n.{leaf}") for leaf in SCOPE]), c(f"n.{SCOPE[0]}") + c(f"n.{SCOPE[1]}") + c(f"n.{SCOPE[2]}")
    label = F.coalesce(*[F.when(c(f"n.{leaf}") == most, leaf) for leaf in SCOPE])
    rows = v.transcripts.select("dataset_id", "channel", "split", "text", F.when(c("leaf").isin(*SCOPE), c("leaf")).otherwise(A.UNKNOWN).alias("gold"), words(c("text")).alias("ws")).withColumn("n", n)
    return rows.select("dataset_id", "channel", "split", "text", "gold", label.alias("predicted"), F.when(total == 0, 0.0).otherwise(most / total).alias("confidence"))


def supported(rows, split: str):
    """The rows of a split with support and margin by the training rows in scope."""
    train = rows.where("split = 'train'").where(c("gold") != A.UNKNOWN)
    return A.Index(train.select(c("gold").alias("label"), "text")).support(rows.where(c("split") == split))


_TRY = "(SELECT a / 20.0::DOUBLE AS similarity, b::DOUBLE AS least_margin FROM range(0, 20) u(a), (VALUES (0.0), (0.05), (0.1)) w(b))"
_F1 = " + ".join(f"coalesce(2 * tp_{x} / nullif(g_{x} + s_{x}, 0)::DOUBLE, 0)" for x in SCOPE)


@query("WITH " + SUPPORT.replace("ASKED", "validation") + f""", fin AS (SELECT similarity, least_margin, gold, CASE WHEN confidence >= {SURE} AND support >= similarity AND margin >= least_margin THEN predicted ELSE 'unknown' END AS final FROM sc, {_TRY}),
k AS (SELECT similarity, least_margin, {', '.join(f"count(*) FILTER (gold = '{x}' AND final = '{x}') AS tp_{x}, count(*) FILTER (gold = '{x}') AS g_{x}, count(*) FILTER (gold <> 'unknown' AND final = '{x}') AS s_{x}" for x in SCOPE)},
 count(*) FILTER (gold = 'unknown' AND final = 'unknown') AS uk, count(*) FILTER (gold = 'unknown') AS ur FROM fin GROUP BY 1, 2),
m AS (SELECT similarity, least_margin, round(({_F1}) / 3, 9) AS macro_f1, CASE WHEN {' AND '.join(f"g_{x} > 0" for x in SCOPE)} THEN round(least({', '.join(f"tp_{x} / nullif(g_{x}, 0)::DOUBLE" for x in SCOPE)}), 9) END AS least_recall, round(uk / nullif(ur, 0)::DOUBLE, 9) AS unknown_recall FROM k),
q AS (SELECT *, coalesce(least_recall >= 0.8 AND unknown_recall >= 0.8 AND macro_f1 >= 0.8, false) AS passes FROM m)
SELECT *, row_number() OVER (ORDER BY passes DESC, round((macro_f1 + unknown_recall) / 2, 9) DESC NULLS LAST, least_recall DESC NULLS LAST, unknown_recall DESC NULLS LAST, similarity, least_margin) AS place FROM q""")
def m13_acceptance_grid(v: Views):
    """Cutoffs of support similarity and contrast margin, fitted on validation rows against the training texts, the best first."""
    return A.fit_cutoffs(supported(predicted_scope(v), "validation"), list(SCOPE), SURE, SIMILARITIES, MARGINS)


@query("WITH " + SUPPORT.replace("ASKED", "test") + f""", r AS (SELECT *, CASE WHEN trim(text) = '' THEN 'no_transcript' WHEN confidence < {SURE} THEN 'low_confidence' WHEN support < 0.2 THEN 'outside_training_support' WHEN margin < 0.05 THEN 'ambiguous_training_support' ELSE 'accepted' END AS reason FROM sc)
SELECT dataset_id, support, margin, CASE WHEN reason = 'accepted' THEN predicted ELSE 'unknown' END AS decision, reason FROM r""")
def p17_acceptance(v: Views):
    """Decisions on test rows under fixed cutoffs, each with its reason."""
    scored = supported(predicted_scope(v), "test").withColumn("reason", A.reason(SURE, 0.2, 0.05, SCOPE))
    return scored.select("dataset_id", "support", "margin", F.when(c("reason") == "accepted", c("predicted")).otherwise(A.UNKNOWN).alias("decision"), "reason")


def outcomes(v: Views):
    n = F.count("*").over(Window.partitionBy("channel"))
    return v.content.select(
        "dataset_id", "channel", "leaf", "format", channel_split(c("channel")).alias("split"), (c("likes") > 750).cast("double").alias("y"), (c("duration") / 50).alias("x1"),
        (c("comments") / 40).alias("x2"), (F.lit(1.0) / n).alias("w"),
    )


def scored_outcomes(v: Views):
    rows = checkpointed(outcomes(v))
    fit, tune = rows.where("split = 'train'"), rows.where("split = 'validation'")
    best = None
    for reg in (0.001, 0.1):
        model = L.outcome_model(reg).fit(fit)
        brier = model.transform(tune).agg(F.avg(F.pow(L.probability(tune) - c("y"), 2))).first()[0]
        if best is None or (brier is not None and brier < best[0]):
            best = (brier if brier is not None else 9.0, model)
    return best[1].transform(rows).withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")


@query()
def m14_outcome_model(v: Views):
    return scored_outcomes(v).groupBy("split").agg(F.count("*").alias("n"), F.avg(F.pow(c("p") - c("y"), 2)).alias("brier"), F.avg(F.pow(F.lit(0.5) - c("y"), 2)).alias("baseline"))


@query()
def m15_platt_calibration(v: Views):
    rows = scored_outcomes(v)
    return L.platt(rows.where("split = 'validation'"))(rows).select("dataset_id", "split", "p", "calibrated")


@query()
def m16_batch_scoring(v: Views):
    rows = scored_outcomes(v)
    seen = rows.where("split = 'train'").groupBy("leaf", "format").agg(F.count_distinct("dataset_id").alias("nv"), F.count_distinct("channel").alias("nc"))
    ok = F.coalesce((c("nv") >= 2) & (c("nc") >= 2), F.lit(False))
    return rows.where("split <> 'train'").join(seen, ["leaf", "format"], "left").select("dataset_id", F.when(ok, c("p")).alias("p"), F.when(~ok, "unsupported").alias("reason"))


@query()
def m17_scenario_scoring(v: Views):
    rows = checkpointed(outcomes(v))
    model = L.outcome_model(0.01).fit(rows.where("split = 'train'"))
    flipped = rows.withColumn("format", F.when(c("format") == "short", "long").otherwise("short"))
    before = model.transform(rows).select("dataset_id", vector_to_array("probability")[1].alias("before"))
    after = model.transform(flipped).select("dataset_id", vector_to_array("probability")[1].alias("after"))
    return before.join(after, "dataset_id").withColumn("difference", c("after") - c("before"))


#: fixed values: words that tell variants of a product apart
VARIANTS = ("pro", "max", "ultra", "plus", "lite", "mini", "air", "small", "large", "new", "old")


@query(f"""WITH e AS MATERIALIZED (SELECT min(dataset_id) AS id, title || ' ' || duration AS label, min(dataset_id) % 4 = 0 AS known FROM content GROUP BY title, duration),
g AS (SELECT id, substr(label, i, 3) AS term, count(*) AS n FROM (SELECT id, label, unnest(range(1, length(label) - 1)) AS i FROM e) GROUP BY 1, 2), nm AS (SELECT id, sqrt(sum(n::DOUBLE * n)) AS norm FROM g GROUP BY 1), x AS MATERIALIZED (SELECT id, term, round(n / norm, 12) AS w FROM g JOIN nm USING (id)),
s AS (SELECT p.id AS a, q.id AS b, round(sum(p.w * q.w), 6) AS similarity FROM x p JOIN x q ON p.term = q.term AND p.id < q.id GROUP BY 1, 2 HAVING round(sum(p.w * q.w), 6) >= 0.82),
j AS (SELECT a, b, l.label AS "left", r.label AS "right", similarity, regexp_extract_all(l.label, '[0-9]+') <> regexp_extract_all(r.label, '[0-9]+') OR list_sort(list_distinct(list_filter(string_split(l.label, ' '), lambda w: w IN {VARIANTS}))) <> list_sort(list_distinct(list_filter(string_split(r.label, ' '), lambda w: w IN {VARIANTS}))) AS conflict
 FROM s JOIN e l ON l.id = a JOIN e r ON r.id = b WHERE NOT (l.known AND r.known) AND NOT EXISTS (SELECT 1 FROM (SELECT id FROM e WHERE id % 7 = 0) n WHERE n.id = a AND b = a + 7))
SELECT a, b, "left", "right", similarity, CASE WHEN conflict THEN 'different_product_variant' WHEN 1 - levenshtein("left", "right") / greatest(length("left"), length("right"))::DOUBLE >= 0.65 THEN 'possible_alias' ELSE 'related_only' END AS relation FROM j""")
def m18_alias_pairs(v: Views):
    """Labels (title and size) whose vectors of three-character runs have a cosine of 0.82 or more; every fourth is a known topic."""
    e = v.content.groupBy("title", "duration").agg(F.min("dataset_id").alias("id")).select("id", F.concat_ws(" ", "title", "duration").alias("label"), (c("id") % 4 == 0).alias("known"))
    never = e.where("id % 7 = 0").select(c("id").alias("a"), (c("id") + 7).alias("b"))
    return Y.alias_suggestions(e, Y.unit(Y.gram_counts(e, c("label"))), never, VARIANTS)


@query("""SELECT vec_id, round(vec[1] + CASE WHEN label % 2 = 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN label > 6 THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN label < 2 THEN 0.1::DOUBLE ELSE 0 END, 6) AS boosted FROM vectors""")
def m19_semantic_boost(v: Views):
    boost = c("vec")[0] + F.when(c("label") % 2 == 0, 0.25).otherwise(0.0) + F.when(c("label") > 6, 0.1).otherwise(0.0) - F.when(c("label") < 2, 0.1).otherwise(0.0)
    return v.vectors.select("vec_id", F.round(boost, 6).alias("boosted"))


@query("WITH p AS (SELECT p_type AS family, p_name AS aspect, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1, 2) SELECT family, aspect, n, brands FROM p QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC, aspect) <= 4")
def f31_trend_ideas(v: Views):
    p = v.table("part").groupBy(c("p_type").alias("family"), c("p_name").alias("aspect")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))
    return X.top_per(p, ["family"], [F.desc("n"), "aspect"], 4).drop("place")
