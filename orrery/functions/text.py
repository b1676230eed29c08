"""Expressions on texts. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marks that the tokeniser turns into spaces, the words of the stop-word share, and the patterns of three features
#: (the first two on the lower-cased text).
PUNCTUATION = r"""[,\.\(\);:!\?\"\'\[\]\{\}<>\/\\\-]"""
STOP_WORDS = ("a", "an", "the", "of", "in", "on", "for", "and", "or", "to", "is", "are", "with", "by")
REVIEW_WORDS = r"\b(review|survey|overview|state.of.the.art|advances)\b"
QUESTION_WORDS = r"\b(how|what|which|why|compare|versus|vs)\b"
YEAR = r"\b(19|20)\d{2}\b"
#: What Python calls white space, as members of a class.
SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Marks and white space together: what stands between two tokens.
BETWEEN = PUNCTUATION[:-1] + SPACES + "]+"


def tokens(text: Column) -> Column:
    """Lower-cased words, punctuation as space. A text without words gives one empty token."""
    # Without marks at either end there is nothing to filter, and an empty text splits into one empty token.
    inner = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"^{BETWEEN}|{BETWEEN}\z", "")
    return F.split(inner, BETWEEN)


def words(text: Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")


def long_words(text: Column) -> Column:
    """Lower-cased runs of two word characters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\b\w\w+\b)"), F.lit(1))


def word_grams(terms: Column, n: int) -> Column:
    """Runs of n terms, joined by spaces. Give it a column that holds the terms: an expression is made anew for each run."""
    last = F.size(terms) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(terms, i, n), " "))).otherwise(F.array().cast("array<string>"))


def char_grams(text: Column, n: int) -> Column:
    """Runs of n characters inside the words of a text, a space on either side of each word."""

    def of_word(word: Column) -> Column:
        edged = F.concat(F.lit(" "), word, F.lit(" "))
        last = F.greatest(F.length(edged) - (n - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(edged, i, F.lit(n)))

    return F.flatten(F.transform(words(F.lower(text)), of_word))


def query_features(text: Column, w: Column) -> dict[str, Column]:
    """The twelve figures on a query's surface; w: a column of its words."""
    n = F.size(w)
    per = F.greatest(n, F.lit(1))
    count = lambda test: F.size(F.filter(w, test))
    return {
        "n_tokens": n.cast("double"),
        "n_chars": F.length(text).cast("double"),
        "mean_token_len": F.when(n > 0, F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / n).otherwise(F.lit(0.0)),
        "n_digits": F.length(F.regexp_replace(text, r"[^\p{Nd}]", "")).cast("double"),
        "n_caps": count(lambda x: (F.length(x) > 1) & (F.upper(x) == x) & (F.lower(x) != x)).cast("double"),
        "is_review": F.regexp_like(F.lower(text), F.lit(REVIEW_WORDS)).cast("double"),
        "is_question": F.regexp_like(F.lower(text), F.lit(QUESTION_WORDS)).cast("double"),
        "unique_ratio": F.size(F.array_distinct(F.transform(w, F.lower))) / per,
        "has_year": F.regexp_like(text, F.lit(YEAR)).cast("double"),
        "stop_ratio": count(lambda x: F.lower(x).isin(*STOP_WORDS)) / per,
        "capital_ratio": count(lambda x: F.regexp_like(x, F.lit(r"^\p{Lu}"))) / per,
        "n_hyphenated": count(lambda x: F.contains(x, F.lit("-"))).cast("double"),
    }


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts' text: the same in any engine, without a generator's state."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 4294967296.0


def drop_words(text: Column, key: Column, share: float, seed: int = 42) -> Column:
    """The text without about `share` of its words; if none is left, its first word stays."""
    w = words(text)
    kept = F.filter(w, lambda x, i: hash_unit(F.lit(seed), key, i) > share)
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(F.slice(w, 1, 1)), " ")


def normalised_doi(doi: Column) -> Column:
    """A DOI without its resolver's address, lower-cased."""
    return F.lower(F.replace(doi, F.lit("https://doi.org/"), F.lit("")))


def normalised_pmid(address: Column) -> Column:
    """The last segment of a PubMed record's address."""
    return F.substring_index(F.rtrim(F.coalesce(address, F.lit("")), F.lit("/")), "/", -1)


def corpus_key(number: Column) -> Column:
    """The key under which a literature service knows a corpus number."""
    return F.concat(F.lit("CorpusId:"), number.cast("string"))


def without_prefix(key: Column, prefix: str = "MED-") -> Column:
    """A key without the collection's prefix."""
    return F.replace(key, F.lit(prefix), F.lit(""))


def decimals(x: Column, places: int = 4) -> Column:
    """A number's text with this many decimals, null as a dash."""
    return F.coalesce(F.format_string(f"%.{places}f", x), F.lit("-"))


def percent(x: Column, places: int = 1) -> Column:
    """A share's text in percent."""
    return F.coalesce(F.format_string(f"%.{places}f%%", 100 * x), F.lit("-"))


def p_text(p: Column) -> Column:
    """A p-value's text: three decimals, or below a thousandth two and a power of ten."""
    return F.when(p < 0.001, F.format_string("%.2e", p)).otherwise(decimals(p, 3))


def year_of(date: Column) -> Column:
    """The year that a date's text begins with; null if it doesn't begin with four digits."""
    return F.when(F.regexp_like(date, F.lit(r"^\d{4}")), F.substring(date, 1, 4).cast("int"))


def citation_numbers(answer: Column, n_context: Column) -> Column:
    """Different numbers [n] of an answer that lie in 1 to n_context."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= n_context)))


def judged_scores(answer: Column) -> Column:
    """The first {...} of a judge's answer as relevance and faithfulness; nulls where it has none."""
    found = F.from_json(F.regexp_extract(answer, r"(\{[^{}]*\})", 1), "relevance int, faithfulness int")
    both = found["relevance"].isNotNull() & found["faithfulness"].isNotNull()
    return F.struct(F.when(both, found["relevance"]).alias("relevance"), F.when(both, found["faithfulness"]).alias("faithfulness"))


def action_label(signal: Column, weight: Column) -> Column:
    """An action's name: signal, a colon, the weight with two decimals."""
    return F.format_string("%s:%.2f", signal, weight)
