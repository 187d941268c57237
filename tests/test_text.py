import pytest
from pyspark.sql import functions as F

from corpuslab.config import PIPELINE, PreprocessConfig
from corpuslab.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Won't you? I won't. John's can't, 's WON'T don't I'll", "Wo not you? I will not. John is cannot, 's WON'T do not I will"),
        ("they've he'd I'm we're", "they have he would I am we are"),
        ("", ""),
    ],
)
def test_contractions(spark, given, wanted):
    assert one(spark, T.expand_contractions, given) == wanted


def test_hyphens(spark):
    assert one(spark, T.normalize_hyphens, "To-morrow a well-known-fact") == "tomorrow a wellknown-fact"


def test_normalize_blank(spark):
    assert one(spark, T.normalize_text, None) == ""
    assert one(spark, T.normalize_text, " \n\t ") == ""


@pytest.mark.parametrize("word, ok", [("noon", False), ("papa", False), ("ship", True), ("a", False), ("b2b", False), ("aaaa", False), ("été", True)])
def test_valid_words(spark, word, ok):
    assert one(spark, lambda c: T.is_valid_word(c, PIPELINE), word) is ok


def test_preprocess(spark):
    assert one(spark, lambda c: T.preprocess_text(c, PIPELINE), "The ships won't sail to-morrow; 12 men are well-known.") == "ships sail tomorrow men wellknown"
    assert one(spark, lambda c: T.preprocess_text(c, PIPELINE, lemmatize=T.plural_lemma), "ships churches ladies glass") == "ship church lady glass"
    assert one(spark, lambda c: T.preprocess_text(c, PreprocessConfig(remove_short_sentences=True)), "one ship") == ""
    with pytest.raises(ValueError):
        T.preprocess_text(F.lit("x"), PreprocessConfig(allowed_pos=frozenset({"noun"})))


@pytest.mark.parametrize("s, ok", [("CHAPTER I", False), ("CHAPTER 12.", True), ("The End.", True), ("ENDING", False), ("book", True), ("CHAPTER é", False)])
def test_headings(spark, s, ok):
    assert one(spark, T.is_heading, s) is ok


@pytest.mark.parametrize("s, ok", [("STOP NOW", True), ("Stop NOW", False), ("1 2", False), ("A B C D E F G", False)])
def test_caps(spark, s, ok):
    assert one(spark, T.is_all_caps_short, s) is ok


def test_mask_ratio(spark):
    assert one(spark, T.mask_ratio, "the <mask> ran <mask>, home") == pytest.approx(0.2)
    assert one(spark, T.mask_ratio, "  ") == 0


def spans(*pairs):
    return F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in pairs])


def test_apply_mask(spark):
    assert one(spark, lambda c: T.apply_mask(c, spans((0, 1), (2, 3), (4, 5))), "a b c") == "<mask> <mask>"
    assert one(spark, lambda c: T.apply_mask(c, spans((4, 14), (10, 14))), "the space ship engine hummed") == "the <mask>k> engine hummed"


@pytest.mark.parametrize("s, ok", [("a <mask>", True), ("ok", False), ("<task>", True), ("<desk>", True), ("<extra_id_7>", True)])
def test_residual(spark, s, ok):
    assert one(spark, T.has_residual_mask, s) is ok


def test_numbers_and_rounding(spark):
    assert one(spark, T.to_number, "score") is None
    assert one(spark, T.to_number, " 3 ") == 3.0
    assert one(spark, T.to_number, "NaN") is None


def test_pair_and_preview(spark):
    assert one(spark, lambda c: T.pair_string(c, F.lit("b")), None) == "nan [SEP] b"
    assert one(spark, T.preview, "x" * 201) == "x" * 200 + "..."
    assert one(spark, lambda c: T.story_id(F.lit(7)), "") == "story_00007"


def test_predicates_on_null(spark):
    assert one(spark, T.starts_with_error, None) is False
    assert one(spark, T.mentions_chapter, None) is False
    assert one(spark, T.starts_with_error, "Answer: x") is True


def test_resolve():
    assert T.resolve_column(["score", "text1"], ("sent1", "text1")) == "text1"
    with pytest.raises(ValueError):
        T.resolve_column(["a"], ("b",))
