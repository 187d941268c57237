"""Topic keywords in paragraphs: matching, span selection and masked variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as T


#: Phrases of one topic, and of all topics, up to which they are looked up in a broadcast set.
MAX_PHRASES, MAX_BROADCAST_PHRASES = 200, 200_000
_TOKEN = r"(?U)(\w+|[^\w\s])\s*"


def _windows(text: Column, lengths: Sequence[int]) -> Column:
    """``(phrase, start, end, text)`` of all runs of as many tokens as ``lengths`` say.

    Words and single other signs are tokens.  ``long`` holds them with the white
    space behind, so that windows are put together from shifted arrays.
    """

    def build(short: Column, long: Column, start: Column) -> Column:
        out = []
        end = F.zip_with(start, short, lambda s, w: s + F.length(w))
        for n in lengths:
            m = F.greatest(F.size(short) - (n - 1), F.lit(0))
            own = lambda a, k: F.slice(a, F.lit(k + 1), m)  # noqa: B023, E731
            phrase, raw = F.transform(own(short, 0), F.lower), own(short, 0)
            for k in range(1, n):
                phrase = F.zip_with(phrase, F.transform(own(short, k), F.lower), lambda a, b: F.concat(a, F.lit(" "), b))
                raw = F.zip_with(own(long, k - 1), own(short, k), lambda a, b: F.concat(a, b)) if k == 1 else F.zip_with(F.zip_with(raw, _gap(own(long, k - 1), own(short, k - 1)), lambda a, b: F.concat(a, b)), own(short, k), lambda a, b: F.concat(a, b))
            out.append(F.zip_with(F.zip_with(phrase, raw, lambda p, r: F.struct(p.alias("p"), r.alias("r"))), F.zip_with(own(start, 0), own(end, n - 1), lambda s, e: F.struct(s.alias("s"), e.alias("e"))),
                                  lambda x, y: F.struct(x["p"].alias("phrase"), y["s"].alias("start"), y["e"].alias("end"), x["r"].alias("text"))))
        return F.flatten(F.array(*out))

    def with_offsets(short: Column, long: Column) -> Column:
        lead = F.length(F.regexp_extract(text, r"(?U)^\s*", 0))
        starts = F.transform(T.prefix_sums(F.transform(long, F.length)), lambda s: s + lead)
        return T.let(starts, lambda at: build(short, long, at))

    found = lambda group: F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(group))
    return T.let(found(1), lambda short: T.let(found(0), lambda long: with_offsets(short, long)))


def _gap(long: Column, short: Column) -> Column:
    """The white space behind each token."""
    return F.zip_with(long, short, lambda a, b: F.substring(a, F.length(b) + 1, F.length(a)))


def match_phrases(paragraphs: DataFrame, keywords: DataFrame, *, id_col: str = "paragraph_id", topic_col: str = "topic_id", text_col: str = "paragraph_text", lengths: Sequence[int] | None = None) -> DataFrame:
    """All occurrences of a topic's keywords in its paragraphs: ``id, topic, start, end, text``.

    Tokens are compared in small letters; keywords may have several tokens and
    occurrences may overlap.  Few keywords, counted first, go to all tasks as a
    set for each topic, and only windows that match are emitted.  More of them
    meet all windows of the lengths that keywords have by an equi-join on topic
    and phrase.  ``lengths`` names these where they are known, which saves a job.
    """
    phrase = F.array_join(F.regexp_extract_all(F.lower("word"), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)), " ")
    wanted = keywords.select(F.col(topic_col).alias("_topic"), phrase.alias("_phrase")).filter("_phrase <> ''").distinct()
    if lengths is None:
        lengths = [r[0] for r in wanted.select(F.size(F.split("_phrase", " ")).alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return paragraphs.select(id_col, topic_col, F.lit(0).alias("start"), F.lit(0).alias("end"), F.col(text_col).alias("text")).filter(F.lit(False))
    sets = wanted.groupBy("_topic").agg(F.collect_set("_phrase").alias("_phrases"))
    size = sets.agg(F.max(F.size("_phrases")).alias("most"), F.sum(F.size("_phrases")).alias("all"), F.count("*").alias("topics")).first()
    if size["most"] <= MAX_PHRASES and size["all"] <= MAX_BROADCAST_PHRASES:
        # only what matches leaves a paragraph's array of windows
        near = paragraphs.join(F.broadcast(sets), F.col(topic_col) == F.col("_topic"))
        hits = F.filter(_windows(F.col(text_col), lengths), lambda w: F.array_contains(F.col("_phrases"), w["phrase"]))
        return near.select(id_col, topic_col, F.explode(hits).alias("w")).select(id_col, topic_col, "w.start", "w.end", "w.text")
    rows = paragraphs.select(id_col, topic_col, F.explode(_windows(F.col(text_col), lengths)).alias("w")).select(id_col, topic_col, "w.*")
    return rows.join(wanted, (F.col(topic_col) == F.col("_topic")) & (F.col("phrase") == F.col("_phrase"))).select(id_col, topic_col, "start", "end", "text")


def collect_spans(matches: DataFrame, id_col: str = "paragraph_id", topic_col: str = "topic_id") -> DataFrame:
    return matches.distinct().groupBy(id_col, topic_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("spans"))


def choose_spans(spans: Column, compat: bool = False) -> Column:
    """Longest spans first, then leftmost, each kept if it meets none kept before; in text order.

    ``compat`` only rejects a span inside which an end of a kept one lies, so
    that nested spans survive.
    """
    longest = F.array_sort(spans, lambda a, b: F.when(a["end"] - a["start"] > b["end"] - b["start"], -1).when(a["end"] - a["start"] < b["end"] - b["start"], 1)
                           .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))

    def clash(kept: Column, s: Column) -> Column:
        inside = lambda p: (s["start"] < p) & (p < s["end"])
        return F.exists(kept, lambda k: inside(k["start"]) | inside(k["end"]) if compat else (k["start"] < s["end"]) & (s["start"] < k["end"]))

    kind = "array<struct<start:int,end:int,text:string>>"
    kept = F.aggregate(longest, F.array().cast(kind), lambda acc, s: F.when(clash(acc, s), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(kept, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def mask_variants(paragraphs: DataFrame, *, id_col: str = "paragraph_id", text_col: str = "paragraph_text", spans_col: str = "spans", variants: int = 6, seed: int = 42) -> DataFrame:
    """``variants`` masked texts of each paragraph; one with the text itself where there is no span.

    A variant masks 1 to ``round(sqrt(tokens))`` spans (all, if fewer), number
    and choice drawn by md5 of seed, paragraph and variant.
    """
    n_spans = F.coalesce(F.size(spans_col), F.lit(0))
    most = F.least(F.greatest(F.lit(1), F.round(F.sqrt(F.size(T.whitespace_tokens(F.col(text_col))))).cast("int")), n_spans)
    base = paragraphs.withColumn("_n", n_spans).withColumn("_most", most)
    rows = base.withColumn("variant_no", F.explode(F.when(F.col("_n") > 0, F.sequence(F.lit(1), F.lit(variants))).otherwise(F.array(F.lit(1)))))
    name = lambda *x: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("variant_no").cast("string"), *x))
    draw = F.conv(F.substring(name(F.lit("k")), 1, 8), 16, 10).cast("bigint")
    k = (F.lit(1) + F.pmod(draw, F.greatest("_most", F.lit(1)))).cast("int")
    keyed = F.array_sort(F.transform(spans_col, lambda s: F.struct(name(s["start"].cast("string")).alias("h"), s.alias("s"))), lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0))
    chosen = F.when(F.col("_n") > 0, F.slice(F.transform(keyed, lambda x: x["s"]), F.lit(1), k)).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))
    rows = rows.withColumn("_chosen", F.array_sort(chosen, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)))
    return rows.select(
        *paragraphs.columns, "variant_no", T.content_id(F.lit(str(seed)), F.col(id_col).cast("string"), F.col("variant_no").cast("string")).alias("variant_id"),
        F.transform("_chosen", lambda s: s["text"]).alias("masked_tokens"), T.apply_mask(F.col(text_col), F.col("_chosen")).alias("masked_text"),
        F.transform("_chosen", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("offsets"),
    )


def masking_report(variants: DataFrame, id_col: str = "paragraph_id") -> DataFrame:
    """Paragraphs with spans, variants, and masks a variant (2 digits)."""
    return variants.agg(
        F.countDistinct(F.when(F.size("masked_tokens") > 0, F.col(id_col))).alias("paragraphs_processed"), F.count("*").alias("variants"),
        T.round_half_even(F.sum(F.size("masked_tokens")) / F.greatest(F.count("*"), F.lit(1)), 2).alias("avg_masks"),
    )
