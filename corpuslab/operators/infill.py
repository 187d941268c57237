"""Filling masks from candidate tokens, and scoring the result.

``restrict``, ``pick`` and ``choose`` work on the short candidate arrays that a
model provider returns; ``distribution`` does the same on rows, for the corpus'
own followers, of which a word may have millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T

START = "<s>"
STRATEGIES = ("greedy", "top_k", "top_p", "top_k_top_p", "temperature")
#: What stands for any word before a mask, and the most cells that a word's candidates are dealt into.
_ANY, _CELLS = "\x00any", 1024


def bigram_model(sentences: DataFrame, text_col: str = "sentence") -> DataFrame:
    """``prev, token, c``: how often each word follows another; all of them."""
    tokens = T.whitespace_tokens(F.lower(text_col))
    both = T.let(F.concat(F.array(F.lit(START)), tokens), lambda t: F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t)), lambda a, b: F.struct(a.alias("prev"), b.alias("token"))))
    pairs = sentences.select(F.explode(both).alias("p"))
    return pairs.select("p.*").groupBy("prev", "token").agg(F.count("*").alias("c"))


def unigram_model(sentences: DataFrame, text_col: str = "sentence") -> DataFrame:
    """``token, c``: the words of the whole corpus."""
    return sentences.select(F.explode(T.whitespace_tokens(F.lower(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("c"))


def distribution(counts: DataFrame, strategy: str = "greedy", *, top_k: int = 10, top_p: float = 0.9, temperature: float = 1.0) -> DataFrame:
    """``prev, token, rank, p, lo, hi``: the candidates that a strategy leaves after each word.

    Temperature, top-k and nucleus cuts come in this order, over all followers
    of a word, renormalised after each; the nucleus holds the first candidates
    until their sum reaches ``top_p``.  A draw ``u`` takes the candidate with
    ``lo <= u < hi``.  Candidates are rows, so that a word may have any number
    of them, in the order of their counts and then of themselves.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    own = Window.partitionBy("prev")
    ordered = own.orderBy(F.desc("c"), "token")
    # weights are powers of counts, whose sums are exact as long as both are whole
    rows = counts.withColumn("rank", F.row_number().over(ordered)).withColumn("_w", F.col("c").cast("double"))
    if strategy == "greedy":
        rows = rows.withColumn("p", F.col("_w") / F.sum("_w").over(own))
        return rows.filter("rank = 1").select("prev", "token", "rank", "p", F.lit(0.0).alias("lo"), F.lit(2.0).alias("hi"))
    if temperature != 1.0:
        rows = rows.withColumn("_w", F.pow("_w", F.lit(1.0 / temperature)))
    if "top_k" in strategy:
        rows = rows.filter(F.col("rank") <= top_k)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_w").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    if "top_p" in strategy:
        rows = rows.withColumn("_all", F.sum("_w").over(own)).filter(F.col("_before") / F.col("_all") < F.lit(top_p - 1e-12))
    rows = rows.withColumn("_all", F.sum("_w").over(own))
    last = F.col("rank") == F.max("rank").over(own)
    return rows.select(
        "prev", "token", "rank", (F.col("_w") / F.col("_all")).alias("p"), (F.col("_before") / F.col("_all")).alias("lo"), F.when(last, F.lit(2.0)).otherwise((F.col("_before") + F.col("_w")) / F.col("_all")).alias("hi")
    )


def _total(cands: Column) -> Column:
    return F.aggregate(cands, F.lit(0.0), lambda s, c: s + c["p"])


def restrict(cands: Column, *, top_k: int | None = None, top_p: float | None = None, temperature: float = 1.0) -> Column:
    """Candidates after temperature, top-k and nucleus cuts, renormalised after each.

    The nucleus holds the first candidates until their sum reaches ``top_p``.
    """
    norm = lambda x: T.let(x, lambda y: T.let(_total(y), lambda t: F.transform(y, lambda c: F.struct((c["p"] / t).alias("p"), c["token"].alias("token")))))
    out = cands
    if temperature != 1.0:
        out = norm(F.transform(out, lambda c: F.struct(F.pow(c["p"], F.lit(1.0 / temperature)).alias("p"), c["token"].alias("token"))))
    if top_k is not None:
        out = norm(F.slice(out, 1, top_k))
    if top_p is not None:
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
        size = lambda x: F.aggregate(x, zero, lambda a, c: F.when(a["s"] < top_p - 1e-12, F.struct((a["s"] + c["p"]).alias("s"), (a["n"] + 1).alias("n"))).otherwise(a))["n"]
        out = norm(T.let(out, lambda x: F.slice(x, F.lit(1), size(x))))
    return out


def pick(cands: Column, u: Column | None = None) -> Column:
    """The best candidate, or that whose cumulative probability passes ``u``."""
    if u is None:
        return F.get(cands, F.lit(0))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    step = lambda a, c: F.when(a["s"] + c["p"] <= u, F.struct((a["s"] + c["p"]).alias("s"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(2.0).alias("s"), a["n"].alias("n")))
    return T.let(cands, lambda x: F.get(x, F.least(F.aggregate(x, zero, step)["n"], F.size(x) - 1)))


def choose(cands: Column, strategy: str = "greedy", u: Column | None = None, *, top_k: int = 10, top_p: float = 0.9, temperature: float = 1.0) -> Column:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "greedy":
        return pick(cands)
    return pick(restrict(cands, top_k=top_k if "top_k" in strategy else None, top_p=top_p if "top_p" in strategy else None, temperature=temperature), u)


def fill_masks(pairs: DataFrame, bigrams: DataFrame, unigrams: DataFrame, *, id_col: str = "pair_id", strategy: str = "greedy", seed: int = 42, **params: float) -> DataFrame:
    """Add ``infilled, infill_score, sampling_strategy, sampling_params``.

    Each exact ``<mask>`` token takes a candidate that follows the token before
    it (the whole corpus' words where that is unknown or a mask).
    ``infill_score`` is the mean log probability; without masks it is null.

    A word's candidates are dealt into cells of ``[0, 1)`` by their intervals,
    as many cells as candidates, so a draw only meets the few of its own cell.
    """
    tokens = pairs.select(id_col, F.posexplode(F.concat(F.array(F.lit(START)), T.whitespace_tokens(F.col("masked")))).alias("i", "token"))
    prev = F.lag("token").over(Window.partitionBy(id_col).orderBy("i"))
    holes = tokens.withColumn("prev", F.lower(prev)).filter((F.col("token") == T.MASK) & (F.col("i") > 0))
    holes = holes.select(id_col, "i", "prev", T.hash_unit(F.lit(str(seed)), F.col(id_col), F.col("i").cast("string")).alias("_u"))
    counts = bigrams.select("prev", "token", "c").unionByName(unigrams.select(F.lit(_ANY).alias("prev"), "token", "c"))
    cut = distribution(counts, strategy, **{k: v for k, v in params.items() if k in ("top_k", "top_p", "temperature")})
    cells = cut.groupBy("prev").agg(F.least(F.count("*"), F.lit(_CELLS)).alias("_cells"))
    known = holes.join(cells, "prev", "left")
    unknown = cells.filter(F.col("prev") == _ANY).select(F.col("_cells").alias("_any"))
    asked = known.join(F.broadcast(unknown), F.lit(True), "left").select(
        id_col, "i", "_u", F.when(F.col("_cells").isNull(), F.lit(_ANY)).otherwise(F.col("prev")).alias("prev"), F.floor(F.col("_u") * F.coalesce("_cells", "_any")).alias("_cell")
    )
    ends = F.floor(F.least("hi", F.lit(1.0 - 1e-9)) * F.col("_cells")), F.floor(F.least("lo", F.lit(1.0 - 1e-9)) * F.col("_cells"))
    offered = cut.join(cells, "prev").select("prev", "token", "p", "lo", "hi", F.explode(F.sequence(ends[1], F.greatest(*ends))).alias("_cell"))
    chosen = asked.join(offered, ["prev", "_cell"]).filter((F.col("lo") <= F.col("_u")) & (F.col("_u") < F.col("hi"))).select(id_col, "i", F.col("token").alias("new"), F.ln("p").alias("lp"))
    filled = tokens.filter("i > 0").join(chosen, [id_col, "i"], "left").groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("new", "token").alias("t")))), lambda x: x["t"]), " ").alias("infilled"), F.round(F.avg("lp"), 6).alias("infill_score")
    )
    settings = F.create_map(*[x for k, v in sorted(params.items()) for x in (F.lit(k), F.lit(float(v)))]) if params else F.create_map().cast("map<string,double>")
    return pairs.join(filled, id_col, "left").withColumn("sampling_strategy", F.lit(strategy)).withColumn("sampling_params", settings)


def text_cosine(a: Column, b: Column) -> Column:
    """The cosine of the texts' word counts, the default semantic similarity where no sentence vectors are given; 0 for a text without words."""
    words = lambda c: T.whitespace_tokens(F.lower(c))
    count = lambda x, w: F.size(F.filter(x, lambda v: v == w))
    dot = lambda x, y: F.aggregate(F.transform(F.array_distinct(x), lambda w: count(x, w) * count(y, w)), F.lit(0), lambda s, v: s + v)
    share = lambda x, y: T.let(F.sqrt(dot(x, x).cast("double")) * F.sqrt(dot(y, y).cast("double")), lambda n: F.when(n > 0, dot(x, y) / n).otherwise(F.lit(0.0)))
    return T.let(words(a), lambda x: T.let(words(b), lambda y: share(x, y)))


def token_jaccard(a: Column, b: Column) -> Column:
    words = lambda c: F.array_distinct(T.whitespace_tokens(F.lower(c)))
    share = lambda x, y: T.let(F.size(F.array_union(x, y)), lambda n: F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(F.lit(0.0)))
    return T.let(words(a), lambda x: T.let(words(b), lambda y: share(x, y)))


def length_ratio(a: Column, b: Column) -> Column:
    x, y = (F.size(T.whitespace_tokens(c)) for c in (a, b))
    return F.when(F.greatest(x, y) > 0, F.least(x, y) / F.greatest(x, y)).otherwise(F.lit(0.0))


def hybrid_score(semantic: Column, lexical: Column, structural: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    """A weighted sum of semantic, lexical and structural similarity; the weights are this library's choice."""
    return sum((F.lit(w) * c for w, c in zip(weights[1:], (lexical, structural))), F.lit(weights[0]) * semantic)
