"""Text functions on columns: all of them built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.config import DEFAULT, PreprocessConfig

# ---- Fixed values: contractions and their expansions, in the order of application.
CONTRACTIONS = {
    "won't": "will not", "can't": "cannot", "n't": " not", "'ll": " will", "'re": " are",
    "'ve": " have", "'d": " would", "'m": " am", "'s": " is",
}
# ---- Fixed values: hyphenated spellings of old prose.
KNOWN_HYPHENS = {
    "to-morrow": "tomorrow", "to-day": "today", "to-night": "tonight", "every-thing": "everything", "some-thing": "something",
    "any-thing": "anything", "every-one": "everyone", "some-one": "someone", "any-one": "anyone", "every-where": "everywhere",
    "some-where": "somewhere", "any-where": "anywhere", "no-thing": "nothing", "no-one": "noone", "no-where": "nowhere",
}
# ---- Fixed values: English function words, then words of the corpus domain.
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down in out
on off over under again further then once here there when where why how all any both each few more most other some such
no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't
mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()
DOMAIN_STOPWORDS = ("amazing", "stories", "volume", "issue")
# ---- Fixed values: patterns and prefixes of the quality rules.
HEADING = r"(?iU)^(CHAPTER|BOOK|PART|SECTION|THE END|END)\b[\s\W\d]*$"
RESIDUAL_MASK = r"(?iU)<mask>|<extra_id_\d+>|<\w*mask\w*>|<\w*sk\w*>"
ERROR_PREFIXES = ("Answer:", "Sentence:", "The most appropriate", "Rewritten sentence:")
MASK = "<mask>"

_SPAN = "array<struct<start:int,end:int,text:string>>"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is evaluated once, however often ``fn`` and its lambdas name it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def prefix_sums(lengths: Column, block: int = 64) -> Column:
    """The sum of what stands before each element: by blocks, so that no long array is copied for each."""

    def within(part: Column) -> Column:
        return F.aggregate(part, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, F.lit(-1)) + x)))

    def joined(inner: Column) -> Column:
        offsets = F.aggregate(inner, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, F.lit(-1)) + F.element_at(p, F.lit(-1)))))
        return F.flatten(F.zip_with(inner, F.slice(offsets, F.lit(1), F.size(inner)), lambda p, o: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x + o)))

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / block).cast("int") - 1, F.lit(0))), lambda b: F.slice(x, b * block + 1, block))

    return let(F.transform(let(lengths, blocks), within), joined)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def expand_contractions(text: Column) -> Column:
    """Expand contractions as written in small letters; a leading apostrophe needs a word before it."""
    for short, long in CONTRACTIONS.items():
        text = F.regexp_replace(text, rf"(?U){'(?<=\\w)' if short[0] == chr(39) else ''}{short}\b", long)
    return text


def normalize_hyphens(text: Column) -> Column:
    """Known spellings become one word; then two parts of three letters or more are joined, once from left to right."""
    for old, new in KNOWN_HYPHENS.items():
        text = F.regexp_replace(text, rf"(?i)\b{old}\b", new)
    return F.regexp_replace(text, r"\b([a-zA-Z]{3,})-([a-zA-Z]{3,})\b", "$1$2")


def normalize_text(text: Column, cfg: PreprocessConfig = DEFAULT) -> Column:
    """Contractions, hyphens and white space; null and blank texts become empty."""
    out = F.coalesce(text, F.lit(""))
    out = expand_contractions(out) if cfg.normalize_contractions else out
    out = normalize_hyphens(out) if cfg.normalize_hyphens else out
    return collapse_whitespace(out)


def is_valid_word(word: Column, cfg: PreprocessConfig = DEFAULT, letters_only: bool = False) -> Column:
    """Long enough, mostly letters, and of more than two distinct characters when over three long.

    ``letters_only`` says that the word is known to consist of letters.
    """
    n = F.length(word)
    rules = [n >= F.lit(max(1, cfg.min_word_length))]
    if cfg.remove_single_chars and cfg.min_word_length < 2:
        rules.append((n != 1) | F.lower(word).isin("a", "i"))
    rules.append((n <= 3) | ~F.lower(word).rlike(r"^(.)\1*(?:(.)(?:\1|\2)*)?$"))
    if not letters_only:
        letters = F.length(F.regexp_replace(word, r"\P{L}", ""))
        if cfg.min_alpha_ratio > 0:
            rules.append(letters / n >= F.lit(cfg.min_alpha_ratio))
        rules.append((n <= 1) | ((n - letters) <= n * F.lit(0.5)))
    return F.coalesce(reduce(lambda a, b: a & b, rules), F.lit(False))


def stopwords(extra: Iterable[str] = ()) -> list[str]:
    """The stop words, with lower-cased extra ones (blank entries don't count)."""
    return sorted({w.strip().lower() for w in (*ENGLISH_STOPWORDS, *DOMAIN_STOPWORDS, *extra) if w.strip()})


def word_tokens(text: Column) -> Column:
    """The default tokenizer: runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def clean_tokens(
    text: Column,
    cfg: PreprocessConfig = DEFAULT,
    *,
    extra_stopwords: Iterable[str] = (),
    tokenize: Callable[[Column], Column] = word_tokens,
    lemmatize: Callable[[Column], Column] | None = None,
    tag: Callable[[Column], Column] | None = None,
) -> Column:
    """The kept tokens: alphabetic (or numbers, if allowed), valid before and after the lemma, no stop words."""
    normal = normalize_text(text, cfg)
    tokens = tokenize(F.lower(normal) if cfg.lowercase else normal)
    shape = (lambda w: w.rlike(r"^\p{L}+$")) if cfg.remove_numbers else (lambda w: w.rlike(r"^(?:\p{L}+|\p{N}+)$"))
    words = stopwords(extra_stopwords) if cfg.remove_stopwords else []
    plain = (lambda w: ~F.lower(w).isin(*words)) if words else (lambda w: F.lit(True))
    tokens = F.filter(tokens, lambda w: plain(w) & shape(w) & is_valid_word(w, cfg, letters_only=cfg.remove_numbers))
    if cfg.allowed_pos:
        if tag is None:
            raise ValueError("allowed_pos needs a tagger: pass tag=")
        tokens = F.filter(tokens, lambda w: tag(w).isin(*sorted(cfg.allowed_pos)))
    if cfg.lemmatize and lemmatize is not None:
        tokens = F.filter(F.transform(tokens, lambda w: lemmatize(F.lower(w))), lambda w: is_valid_word(w, cfg))
    return tokens


def preprocess_text(text: Column, cfg: PreprocessConfig = DEFAULT, **providers) -> Column:
    """The kept tokens joined by blanks; empty if too few are left and the config says so."""
    tokens = clean_tokens(text, cfg, **providers)
    joined = F.array_join(tokens, " ")
    return F.when(F.size(tokens) < 3, F.lit("")).otherwise(joined) if cfg.remove_short_sentences else joined


def plural_lemma(word: Column) -> Column:
    """A rule lemma for nouns: the usual plural endings."""
    return (
        F.when(word.rlike("(?:ss|us|is)$") | (F.length(word) < 4), word)
        .when(word.rlike("[^aeiou]ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(?:ches|shes|xes|sses|zes)$"), F.regexp_replace(word, "es$", ""))
        .otherwise(F.regexp_replace(word, "s$", ""))
    )


def split_sentences(text: Column) -> Column:
    """Sentences end at ``. ! ?`` before white space."""
    return F.split(strip(text), r"(?U)(?<=[.!?])\s+")


def whitespace_tokens(text: Column) -> Column:
    """Tokens between white space (none in a blank text)."""
    return F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """The default counter of sub-word tokens: words and single punctuation marks."""
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]"))


def mask_ratio(masked: Column) -> Column:
    """The share of whitespace tokens that are exactly the mask."""
    return let(whitespace_tokens(masked), lambda t: F.when(F.size(t) > 0, F.size(F.filter(t, lambda w: w == MASK)) / F.size(t)).otherwise(F.lit(0.0)))


def is_heading(sentence: Column) -> Column:
    return strip(sentence).rlike(HEADING)


def is_all_caps_short(sentence: Column, max_len: int = 6) -> Column:
    s = strip(sentence)
    return (F.size(whitespace_tokens(s)) <= max_len) & (F.upper(s) == s) & (F.lower(s) != s)


def has_word_of(sentence: Column, lexicon: Sequence[str]) -> Column:
    """The default verb test: any word of a lexicon."""
    return F.arrays_overlap(word_tokens(F.lower(sentence)), F.array(*[F.lit(w) for w in lexicon]))


def apply_mask(text: Column, spans: Column) -> Column:
    """Replace ``(start, end)`` character spans from right to left by the mask, then merge neighbours once."""
    ordered = F.reverse(F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)))
    masked = F.aggregate(
        ordered, text, lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"]), F.lit(MASK), F.substring(acc, s["end"] + 1, F.length(acc)))
    )
    return F.replace(masked, F.lit(f"{MASK} {MASK}"), F.lit(MASK))


def has_residual_mask(text: Column) -> Column:
    return text.rlike(RESIDUAL_MASK)


def pair_string(a: Column, b: Column) -> Column:
    """``a [SEP] b``, with ``nan`` for nulls."""
    return F.concat(F.coalesce(a.cast("string"), F.lit("nan")), F.lit(" [SEP] "), F.coalesce(b.cast("string"), F.lit("nan")))


def starts_with_error(text: Column, prefixes: Sequence[str] = ERROR_PREFIXES) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.startswith(text, F.lit(p)) for p in prefixes]), F.lit(False))


def mentions_chapter(text: Column) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit("chapter")), F.lit(False))


def preview(text: Column, limit: int = 200) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def round_half_even(value: Column, digits: int) -> Column:
    """Rounded as the exact binary value asks, and to the even digit where that is a tie.

    The value is cut into two halves whose products with the power of ten are
    exact, so that the sign of the distance to the tie is.
    """
    scale = F.lit(float(10**digits))

    def done(x: Column) -> Column:
        big = x * F.lit(134217729.0)
        high = big - (big - x)
        whole = F.floor(x * scale).cast("double")
        beyond = (high * scale - whole - F.lit(0.5)) + (x - high) * scale
        return (whole + F.when(beyond > 0, 1.0).when(beyond < 0, 0.0).otherwise(whole % 2)) / scale

    return let(value.cast("double"), done)


def story_id(n: Column) -> Column:
    return F.format_string("story_%05d", n)


def to_number(text: Column) -> Column:
    """A number, or null where there is none (NaN becomes null too)."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def not_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def content_id(*parts: Column) -> Column:
    """A reproducible id: the md5 of the parts."""
    return F.md5(F.concat_ws("\x01", *parts))


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) that the parts decide: 32 bits of their md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def first_author(authors: Column) -> Column:
    return F.coalesce(F.get(authors, F.lit(0)), F.lit("Unknown"))


def resolve_column(columns: Sequence[str], candidates: Sequence[str]) -> str:
    """The first candidate that is a column."""
    for name in candidates:
        if name in columns:
            return name
    raise ValueError(f"none of {list(candidates)} among {list(columns)}")
