"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are matches of fixed rules. The words around a seed are a lexical pattern. Patterns and identifier-like tokens form
a bipartite graph, which Spark scores in rounds: a pattern by the mean score of its instances, an instance by its best
pattern. Patterns of high confidence then give spans that no rule matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .spans import between, cut, let, places, spans, written

#: Fixed rules. Possessive loops and look-behinds keep matching linear and change no match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
KINDS = ("email", "ip", "card", "phone")
#: What a token needs to count for a kind when only its context speaks for it.
SHAPES = {
    "email": r"^[^@\s]+@[^@\s]{2,}",
    "ip": r"[0-9]+[.:][0-9]+[.:][0-9]+",
    "card": r"(?:[0-9][ -]?){12}",
    "phone": r"(?:[0-9][ ().-]*+){7}",
}
ROUNDS, SUPPORT, CONFIDENCE = 3, 3, 0.8


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.filter(F.split(F.reverse(number), ""), lambda d: d != "")
    worth = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the fixed rules, by kind; matches that fail a kind's test are dropped."""
    octet = lambda hit: F.forall(F.split(hit, "[.]"), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    size = lambda hit: F.length(digits(hit))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    digit = lambda found: F.when(text.rlike("[0-9]"), found).otherwise(none)
    return {
        "email": F.when(text.contains("@"), spans(text, EMAIL)).otherwise(none),
        "ip": F.filter(digit(spans(text, IP)), lambda s: octet(s["hit"])),
        "card": F.filter(digit(spans(text, CARD)), lambda s: size(s["hit"]).between(16, 19) & luhn(digits(s["hit"]))),
        "phone": F.filter(F.when(text.contains("+"), spans(text, PHONE)).otherwise(none), lambda s: size(s["hit"]).between(8, 15)),
    }


def candidates(text: Column) -> Column:
    """array<struct<start, end, token, left, right>>: tokens with a digit or @, and the words next to them."""
    shape = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "#")

    def with_context(x: Column) -> Column:
        return F.transform(
            between(x["gaps"], x["hits"]),
            lambda s, i: F.struct(
                s["start"].alias("start"), s["end"].alias("end"),
                F.regexp_replace(s["hit"], r"[.,;:!?)\]}]+$", "").alias("token"),
                shape(F.regexp_extract(F.right(F.get(x["gaps"], i), F.lit(80)), r"((?:\S+\s+)?\S+)\s*$", 1)).alias("left"),
                shape(F.regexp_extract(F.substring(F.get(x["gaps"], i + 1), 1, 40), r"^\s*(\S+)", 1)).alias("right"),
            ),
        )

    # a text without digit or @ has none, which a search for one character tells
    return F.when(text.rlike("[0-9@]"), let(cut(text, CANDIDATE), with_context)).otherwise(F.array())


def hashed(found: Column) -> Column:
    """The spans with a digest for their text, by which copies count as one instance."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.md5(s["hit"]).alias("hash")))


def extract(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Base spans and candidate tokens of every row, written once; ``row`` tells repeated rows apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = base_spans(text)
    return materialize(
        docs.select(
            "doc_id", F.monotonically_increasing_id().alias("row"), *[hashed(c).alias(k) for k, c in base.items()], candidates(text).alias("candidates")
        )
    )


def instances(extracted: DataFrame) -> DataFrame:
    """(row, start, end, token, instance, pattern, seed): up to three patterns for a candidate.

    seed: the kind of the base span that begins in the token, whose whole text then is the instance. Tokens further
    inside a base span are left out.
    """
    one = extracted.select("row", *KINDS, F.inline("candidates"))
    begins = lambda k: F.filter(k, lambda s: (s["start"] >= F.col("start")) & (s["start"] < F.col("end")))
    inside = lambda k: F.exists(k, lambda s: (s["start"] < F.col("start")) & (s["end"] > F.col("start")))
    first = F.coalesce(*[F.when(F.size(begins(k)) > 0, F.struct(F.lit(k).alias("kind"), F.get(begins(k), F.lit(0))["hash"].alias("hash"))) for k in KINDS])
    one = one.where(~(inside("email") | inside("ip") | inside("card") | inside("phone"))).withColumn("first", first)
    patterns = F.filter(
        F.array(
            F.when(F.col("left").rlike(r"\s"), F.concat(F.lit("l:"), F.regexp_replace("left", r"\s+", " "))),
            F.when(F.col("left").rlike("[:=#]$"), F.concat(F.lit("k:"), F.regexp_extract("left", r"(\S+)$", 1))),  # a label such as tel:
            F.when((F.col("left") != "") & (F.col("right") != ""), F.concat(F.lit("m:"), F.regexp_extract("left", r"(\S+)$", 1), F.lit(" _ "), "right")),
        ),
        lambda p: p.isNotNull(),
    )
    return one.select("row", "start", "end", "token", F.coalesce("first.hash", F.md5("token")).alias("instance"), F.col("first.kind").alias("seed"), F.explode(patterns).alias("pattern"))


def scored_patterns(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, confidence) after some rounds over the graph; ``edges``: pattern, instance, seed."""
    graph = materialize(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    seeds = graph.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    scores, patterns = seeds, None
    for _ in range(rounds):
        held = graph.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("hits"))
        patterns = materialize(
            held.where(F.col("hits") >= support).join(sizes, "pattern").select("pattern", "kind", (F.col("mass") / F.col("n")).alias("confidence"))
        )
        reached = graph.join(patterns.where(F.col("confidence") >= CONFIDENCE), "pattern").groupBy("instance", "kind").agg(F.max("confidence").alias("score"))
        scores = seeds.unionByName(reached).groupBy("instance", "kind").agg(F.max("score").alias("score"))
    return patterns


def discover(extracted: DataFrame, confidence: float = CONFIDENCE, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """(row, kind, start, end, pattern, confidence): identifiers that no fixed rule matched but a confident pattern points at."""
    cand = instances(extracted)
    best = scored_patterns(cand.select("pattern", "instance", "seed"), rounds, support).where(F.col("confidence") >= confidence)
    fits = F.expr(" or ".join(f"(kind = '{k}' and token rlike r'{p}')" for k, p in SHAPES.items()))
    return (
        cand.where("seed is null").join(best, "pattern").where(fits)
        .groupBy("row", "start", "end")
        .agg(F.max(F.struct("confidence", "kind", "pattern")).alias("best"), F.max(F.length("token")).alias("size"))
        .select("row", "best.kind", "start", (F.col("start") + F.col("size")).alias("end"), "best.pattern", "best.confidence")
    )


def per_document(docs: DataFrame, text_col: str = "text", confidence: float = CONFIDENCE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, base counts, base digest and all spans.

    Null and empty texts have no spans. Repeated rows are kept and get equal values. Equal starts within a kind cannot
    occur; a tie between patterns of equal confidence goes to the kind, then the pattern, that sorts last. An empty table
    gives an empty result; further columns are ignored.
    """
    extracted = extract(docs, text_col)
    more = discover(extracted, confidence).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    rows = extracted.drop("candidates").join(more, "row", "left")
    text = F.concat(*[written(F.col(k), k) for k in KINDS])
    extra = lambda k: F.transform(F.filter(F.coalesce("more", F.array()), lambda s: s["kind"] == k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    every = F.concat(*[written(F.array_sort(F.concat(places(F.col(k)), extra(k))), k) for k in KINDS])
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(text, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"),
    )
