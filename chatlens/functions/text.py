"""Text rules as Column builders: no Python code runs per row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens import fixed_values as fv
from chatlens.operators.joins import attach_by_key
from chatlens.session import materialise

_NOT_IN_WORD_BEFORE = f"(?<![{fv.WORD_CLASS}])"
_NOT_IN_WORD_AFTER = f"(?![{fv.WORD_CLASS}])"
_ASSISTANT_PATTERN = (
    f"(?iu)^(?:{fv.ASSISTANT_OPENERS}){_NOT_IN_WORD_AFTER}|" + "|".join(fv.ASSISTANT_TEMPLATES)
)
# These patterns expect text in which every blank is a space. The e-mail rule
# removes each unbroken run with an inner "@"; anchoring it at the start of the
# run keeps the cost linear on long runs.
_URL_PATTERN = r"https?://[!$-_a-z]+"
_EMAIL_PATTERN = r"(?<![^ ])[^ ][^ @]*+@[^ ]+"
_NUMBER_PATTERN = rf"(?=\p{{Nd}}){_NOT_IN_WORD_BEFORE}\p{{Nd}}+{_NOT_IN_WORD_AFTER}"


def evaluated_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters must not recompute.

    The optimizer moves a filter below a projection by repeating the expression
    inside the filter. For costly text rules that doubles the work, so they are
    produced by a one-element generator, which filters do not pass.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def bound_to(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Trim Unicode blanks; null becomes the empty string."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(fv.BLANK_CHARS))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def spaced(text: Column) -> Column:
    """Turn every blank character into a space, which keeps later patterns cheap."""
    return F.translate(F.coalesce(text, F.lit("")), fv.BLANK_CHARS, " " * len(fv.BLANK_CHARS))


def _split_words(text: Column) -> Column:
    return F.split(F.btrim(spaced(text), F.lit(" ")), " +")


def tokens(text: Column) -> Column:
    """Tokens between runs of blanks, without empty tokens."""
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(_split_words(text))


def token_count(text: Column) -> Column:
    return F.when(is_blank(text), 0).otherwise(F.size(_split_words(text)))


def latin_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), 0)


def count_in(words: Column, listed: Iterable[str]) -> Column:
    """How many elements of ``words`` are listed (with repeats)."""
    values = list(listed)
    return F.size(F.filter(words, lambda w: w.isin(values)))


def english_ratio(words: Column, english: Sequence[str] = fv.ENGLISH_WORDS) -> Column:
    """Share of words that are listed as they are or without their trailing ``s``."""
    listed = list(english)
    known = F.filter(words, lambda w: w.isin(listed) | F.rtrim(w, F.lit("s")).isin(listed))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.size(known) / F.size(words))


def has_indic(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(fv.INDIC_PATTERN)


def has_latin(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("[A-Za-z]")


def is_ascii(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"[^\x00-\x7F]")


def add_language_flags(df: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """Add the language flags of one text column.

    Words, hits and ratio are computed once per row and then reused.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, hits, ratio = f"{prefix}_words", f"{prefix}_hits", f"{prefix}english_ratio"
    df = evaluated_once(df, **{words: latin_words(text)})
    df = evaluated_once(df, **{hits: count_in(F.col(words), fv.ROMANISED_HINDI_WORDS),
                               ratio: english_ratio(F.col(words))})
    probably_english = (text != "") & is_ascii(text) & (F.col(ratio) >= fv.ENGLISH_MIN_RATIO)
    romanised_hindi = (F.col(hits) >= fv.HINDI_MIN_HITS) | (
        (F.col(hits) == 1) & (F.col(ratio) < fv.HINDI_SINGLE_HIT_MAX_RATIO)
    )
    return df.select(
        *[c for c in df.columns if c not in (words, hits)],
        has_indic(text).alias(f"{prefix}has_indic"),
        has_latin(text).alias(f"{prefix}has_latin"),
        probably_english.alias(f"{prefix}is_english"),
        romanised_hindi.alias(f"{prefix}is_romanised_hindi"),
    )


_FLAGS = ("english_ratio", "has_indic", "has_latin", "is_english", "is_romanised_hindi")


def flag_retranslation(df: DataFrame, original: str, translated: str, out: str = "needs_retranslation") -> DataFrame:
    """Say which translations are not acceptable English."""
    flagged = add_language_flags(add_language_flags(df, original, "_o_"), translated, "_t_")
    lost_english = (F.col("_o_english_ratio") - F.col("_t_english_ratio")) >= fv.ENGLISH_MAX_DROP
    verdict = (
        F.when(is_blank(F.col(translated)), ~is_blank(F.col(original)))
        .when(F.col("_t_has_indic"), True)
        .when(F.col("_o_has_latin") & ~F.col("_t_has_latin"), True)
        .when(F.col("_o_is_english"), F.col("_t_is_romanised_hindi") | lost_english)
        .otherwise(False)
    )
    return flagged.withColumn(out, verdict).drop(*[p + f for p in ("_o_", "_t_") for f in _FLAGS])


def _drop_repeats(spaced: Column) -> Column:
    """Drop each token that is followed by an equal token; needs single spaces."""
    return F.regexp_replace(spaced, r"(?<![^ ])([^ ]++) (?=\1(?![^ ]))", "")


def collapse_repeats(text: Column) -> Column:
    """Drop a token that equals the one before it; blank text stays as it is."""
    return F.when(is_blank(text), text).otherwise(_drop_repeats(F.array_join(tokens(text), " ")))


def is_assistant_like(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(_ASSISTANT_PATTERN)


def preprocess(text: Column) -> Column:
    """Remove addresses and stand-alone numbers, squeeze blanks, lower-case, collapse repeats."""
    out = spaced(text)
    # Each search runs only where a string that every match holds occurs, which costs much less.
    for part, pattern in (("://", _URL_PATTERN), ("@", _EMAIL_PATTERN), (None, _NUMBER_PATTERN), ("  ", " {2,}")):
        instead = " " if part == "  " else ""
        replaced = lambda t: F.regexp_replace(t, pattern, instead)  # noqa: B023, E731
        out = replaced(out) if part is None else bound_to(out, lambda t: F.when(t.contains(part), replaced(t)).otherwise(t))  # noqa: B023
    return _drop_repeats(F.btrim(F.lower(out), F.lit(" ")))


def merge_phrases(text: Column, phrases: Sequence[tuple[str, str]] = fv.PHRASE_TOKENS) -> Column:
    """Replace each listed phrase by its token, in list order.

    Rules may feed each other, so they are applied one after the other, but
    only on rows in which one combined search finds any phrase.
    """
    def whole_words(phrase: str) -> str:
        return f"{_NOT_IN_WORD_BEFORE}{phrase}{_NOT_IN_WORD_AFTER}"

    merged = text
    for phrase, token in phrases:
        merged = F.regexp_replace(merged, whole_words(phrase), token)
    any_phrase = whole_words("(?:" + "|".join(phrase for phrase, _ in phrases) + ")")
    # Most characters begin no phrase; a look at one of them costs less than a look behind it.
    if phrases and all(re.fullmatch("[a-z0-9][a-z0-9_ ]*", phrase) for phrase, _ in phrases):
        any_phrase = f"(?=[{''.join(sorted({phrase[0] for phrase, _ in phrases}))}]){any_phrase}"
    return F.when(text.rlike(any_phrase), merged).otherwise(text)


def lemma(word: Column, irregular: Mapping[str, str] = fv.IRREGULAR_NOUNS, unchanged: Sequence[str] = fv.UNCHANGED_NOUNS) -> Column:
    """Singular form of an English noun by two short lists and suffix rules.

    Two letters go only after a hissing sound that needs the extra syllable
    (classes, boxes, branches); words in -se, -ze or -ce lose one (houses, sizes).
    """
    length = F.length(word)
    singulars = F.create_map(*[F.lit(part) for pair in irregular.items() for part in pair])
    return (
        F.when(word.isin(list(irregular)), F.element_at(singulars, word))
        .when((length <= 3) | word.isin(list(unchanged)), word)
        .when(word.endswith("ies") & (length > 4), F.concat(_without_last(word, 3), F.lit("y")))
        .when(word.rlike("(?:sses|xes|zzes|ches|shes)$"), _without_last(word, 2))
        .when(word.rlike("(?:ss|us|is|[^a-z]s)$"), word)
        .when(word.endswith("s"), _without_last(word, 1))
        .otherwise(word)
    )


def _without_last(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def lemmatise(text: Column, irregular: Mapping[str, str] = fv.IRREGULAR_NOUNS) -> Column:
    # Only words in -s and irregular ones change; the others, which are most, skip the rules.
    irregular_only = [w for w in irregular if not w.endswith("s")]
    changes = lambda w: w.endswith("s") | w.isin(irregular_only) if irregular_only else w.endswith("s")
    return F.array_join(F.transform(tokens(text), lambda w: F.when(changes(w), lemma(w, irregular)).otherwise(w)), " ")


def lemmatise_with(df: DataFrame, id_col: str, text_col: str, dictionary: DataFrame) -> DataFrame:
    """Lemmatise with a dictionary table ``(form, lemma)`` of any size; ``id_col`` must be unique.

    Each distinct word is looked up once; a form with several lemmas gets the
    shortest, then the first in order. Words outside the dictionary stay as they
    are. Frequent words are split in the join back, and the regrouping is by row,
    so no task holds all uses of a word and no group is longer than one text.
    """
    return _replace_words(df, id_col, text_col, _word_counts(df, text_col), dictionary)


def _word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """Stored table ``(form, n_rows)`` of the distinct words, so that the texts are split once for it."""
    words = df.select(F.explode(tokens(F.col(text_col))).alias("form"))
    return materialise(words.groupBy("form").agg(F.count("*").alias("n_rows")), "word-counts")


def _replace_words(df: DataFrame, id_col: str, text_col: str, counted: DataFrame, dictionary: DataFrame) -> DataFrame:
    words = df.select(id_col, F.posexplode_outer(tokens(F.col(text_col))).alias("_pos", "form"))
    entries = dictionary.groupBy("form").agg(F.min(F.struct(F.length("lemma"), "lemma"))["lemma"].alias("lemma"))
    # Words that stay as they are need no entry; the others are stored, so that Spark knows how few they are.
    counts = materialise(counted.join(entries, "form").filter(F.col("lemma") != F.col("form")), "lemmas")
    found = attach_by_key(words, counts.select("form", "lemma"), "form", counts.select("form", "n_rows"), (id_col, "_pos"))
    joined = found.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("lemma", "form").alias("w")))).alias("_parts")
    ).select(id_col, F.array_join(F.col("_parts.w"), " ").alias("_lemmas"))
    return df.join(joined, id_col, "left").withColumn(text_col, F.coalesce("_lemmas", F.lit(""))).drop("_lemmas")


def lexicon_lemmas(
    words: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None,
    detachments: Sequence[tuple[str, str]] = fv.DETACHMENTS,
) -> DataFrame:
    """``form, lemma`` of the distinct ``words(form)`` that ``lexicon(word)`` confirms.

    Candidates of a form are the form itself and what each detachment rule leaves of it. An entry of
    ``exceptions(form, lemma)`` decides first; else the shortest candidate that the lexicon lists
    counts, ties in alphabetical order. Forms without a confirmed candidate have no row. All
    candidates are exploded once, so lexicon and exceptions may be of any size.
    """
    form = F.col("form")
    stem = lambda ending, instead: F.concat(_without_last(form, len(ending)), F.lit(instead))
    tried = F.array_compact(F.array(form, *[
        F.when(form.endswith(ending) & (F.length(form) > len(ending) - len(instead)), stem(ending, instead)) for ending, instead in detachments]))
    distinct = words.select("form").filter(form.isNotNull() & (form != "")).distinct()
    candidates = distinct.select("form", F.explode(F.array_distinct(tried)).alias("lemma"))
    found = candidates.join(lexicon.select(F.col("word").alias("lemma")).distinct(), "lemma", "left_semi").groupBy("form").agg(
        F.min(F.struct(F.length("lemma").alias("n"), "lemma"))["lemma"].alias("lemma"))
    if exceptions is None:
        return found
    first = exceptions.groupBy("form").agg(F.min(F.struct(F.length("lemma").alias("n"), "lemma"))["lemma"].alias("lemma"))
    # Only confirmed forms and exceptions are joined, never all words.
    first = first.filter(F.col("lemma").isNotNull())
    return first.join(distinct, "form", "left_semi").unionByName(found.join(first, "form", "left_anti"))


def lemmatise_by_lexicon(
    df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, exceptions: DataFrame | None = None,
    detachments: Sequence[tuple[str, str]] = fv.DETACHMENTS,
) -> DataFrame:
    """Lemmatise with base forms instead of a finished dictionary; unknown words stay as they are."""
    counted = _word_counts(df, text_col)
    return _replace_words(df, id_col, text_col, counted, lexicon_lemmas(counted, lexicon, exceptions, detachments))


def clean_message(
    df: DataFrame, text_col: str, out: str = "cleaned", dictionary: DataFrame | None = None, id_col: str = "row_index"
) -> DataFrame:
    """The full topic preparation; assistant-like text becomes blank.

    Lemmas come from the built-in rules, or from a ``dictionary(form, lemma)``
    if one is given; then ``id_col`` must be unique.
    """
    df = evaluated_once(df, _pre=preprocess(F.col(text_col)))
    df = evaluated_once(df, _mrg=merge_phrases(F.col("_pre")))
    if dictionary is None:
        df = evaluated_once(df, _lem=lemmatise(F.col("_mrg")))
    else:
        df = lemmatise_with(df.withColumn("_lem", F.col("_mrg")), id_col, "_lem", dictionary)
    cleaned = F.when(is_assistant_like(F.col("_lem")), F.lit("")).otherwise(F.col("_lem"))
    return evaluated_once(df, **{out: cleaned}).drop("_pre", "_mrg", "_lem")


def squeeze(text: Column) -> Column:
    """Replace runs of two or more blanks by one space and trim."""
    blank = f"[{fv.BLANK_CLASS}]"
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), f"{blank}{blank}+", " "))


def truncate_tokens(text: Column, limit: int = fv.AGENCY_MAX_TOKENS) -> Column:
    """The first ``limit`` tokens joined by one space; shorter text is unchanged."""
    return F.when(token_count(text) > limit, F.array_join(F.slice(tokens(text), 1, limit), " ")).otherwise(text)


def iso_datetime(ts: Column) -> Column:
    micros = F.date_format(ts, "SSSSSS")
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == "000000", seconds).otherwise(F.concat_ws(".", seconds, micros))


def escape_cell(text: Column) -> Column:
    """Make text safe for one cell of a pipe table."""
    escaped = F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.replace(escaped, F.lit("\n"), F.lit(" "))


def clip(text: Column, limit: int = 75) -> Column:
    """Cut long text and mark the cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)
