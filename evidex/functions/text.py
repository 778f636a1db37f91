"""Tokens, stems and short generated texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words ignored in a lexical question.
QUESTION_STOPWORDS = (
    "when", "did", "the", "person", "what", "was", "were", "where",
    "show", "me", "please", "this", "that", "with", "from", "into",
    "does", "happen", "happened", "someone", "something",
)
# Question words that demand an action hit.
ACTION_HINTS = (
    "open", "opening", "close", "closing", "sit", "sitting", "stand",
    "standing", "take", "taking", "pick", "picking", "put", "putting",
    "hold", "holding", "carry", "carrying", "walk", "walking", "eat",
    "eating", "drink", "drinking", "look", "looking", "fix", "fixing",
)
# Words ignored when resolving an action label.
LABEL_STOPWORDS = (
    "a", "an", "the", "person", "someone", "some", "when", "did", "what", "is",
    "are", "was", "were", "to", "of", "on", "in", "with", "from", "then",
)
# Verbs too general to decide a label on their own.
GENERIC_ACTION_TERMS = (
    "hold", "holding", "take", "taking", "put", "putting",
    "open", "opening", "close", "closing", "person", "someone",
    "happen", "happened", "going", "go", "doing", "time",
)
# Words that never become an object prompt.
PROMPT_STOPWORDS = (
    "when", "what", "where", "which", "does", "did", "someone", "person",
    "people", "they", "them", "this", "that", "from", "into", "with", "about",
    "show", "find", "happen", "happened", "there", "their", "have", "holding",
    "opening", "closing", "taking", "putting", "some", "the", "and", "near",
    "relevant", "event", "action", "actions", "visible", "visibility", "eating",
    "eat", "ate", "anything", "something",
)
# Characters stripped from both ends of a query word / a label.
WORD_EDGES = ".,?!:;()[]{}"
LABEL_EDGES = " \t\r\n.,;:!?()[]{}\"'"


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column) -> Column:
    """Distinct runs of lower-case letters and digits (case is not folded)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), F.lit(1)))


def question_terms(query: Column) -> Column:
    """Longer tokens of the raw query that are not stopwords."""
    return F.array_except(
        F.filter(tokens(query), lambda t: F.length(t) > 2), strings(QUESTION_STOPWORDS)
    )


def token_variants(words: Column, exclusive: bool = False) -> Column:
    """Words plus crude stems of ``-ing`` and ``-ed`` forms."""

    def stems(word: Column) -> Column:
        ing = word.endswith("ing") & (F.length(word) > 5)
        ed = word.endswith("ed") & (F.length(word) > 4)
        stem = F.substring(word, F.lit(1), F.length(word) - 3)
        doubled = (F.length(stem) > 2) & (F.substring(stem, -1, 1) == F.substring(stem, -2, 1))
        return F.array(
            word,
            F.when(ing, stem),
            F.when(ing & doubled, F.substring(stem, F.lit(1), F.length(stem) - 1)),
            F.when(ed & ~ing if exclusive else ed, F.substring(word, F.lit(1), F.length(word) - 2)),
        )

    expanded = F.flatten(F.transform(words, stems))
    return F.array_distinct(F.filter(expanded, lambda t: t.isNotNull()))


def label_tokens(text: Column) -> Column:
    kept = F.array_except(
        F.filter(tokens(F.lower(text)), lambda t: F.length(t) > 2), strings(LABEL_STOPWORDS)
    )
    return token_variants(kept, exclusive=True)


def window_text(action_names: Column, description: Column, objects: Column) -> Column:
    """Caption of a window: its actions, else description, else objects."""
    clean = lambda xs: F.filter(
        F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))),
        lambda x: x != "",
    )
    names, things = clean(action_names), clean(objects)
    return (
        F.when(F.size(names) > 0, F.concat(F.lit("A person is "), F.array_join(names, " and "), F.lit(".")))
        .when(F.trim(F.coalesce(description, F.lit(""))) != "", F.trim(description))
        .when(F.size(things) > 0, F.concat(F.lit("A video showing "), F.array_join(things, ", "), F.lit(".")))
        .otherwise("A video showing an office activity.")
    )


def strip_edges(text: Column, edges: str) -> Column:
    return F.btrim(text, F.lit(edges))


def normalise_label(value: Column) -> Column:
    spaced = F.regexp_replace(F.replace(F.lower(value), F.lit("_"), F.lit(" ")), r"\s+", " ")
    return strip_edges(F.trim(spaced), LABEL_EDGES)
