"""Word and template expressions: escapes, variables, restoring messages, distances. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The wildcard of templates and the characters that are escaped in words. Fixed values.
WILDCARD = "**"
ESCAPED = r"([\\*@])"


def escape(text: Column) -> Column:
    r"""Prefix ``\``, ``*`` and ``@`` with a backslash, so that no word can equal the wildcard."""
    return F.regexp_replace(text, ESCAPED, r"\\$1")


def unescape(text: Column) -> Column:
    """Undo ``escape``."""
    return F.regexp_replace(text, r"\\([\\*@])", "$1")


def escape_words(words: Column) -> Column:
    return F.transform(words, escape)


def split_unescaped(text: Column, separator: str = "@@") -> Column:
    """Split at unescaped separators; an empty text gives an empty array."""
    marked = F.regexp_replace(text, r"((?:\\.|(?!" + separator + r")[^\\])*)(?:" + separator + r"|$)", "$1\u0001")
    parts = F.split(F.rtrim(marked, F.lit("\u0001")), "\u0001")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(parts)


def join_words(words: Column, separator: str = "@@") -> Column:
    return F.array_join(words, separator)


def is_variable(word: Column, typed: bool = False) -> Column:
    """Whether a template word stands for a variable; ``typed`` also takes labelled ones like ``*ipaddr*``."""
    return word.rlike(r"^\*[A-Za-z]*\*$") if typed else word == WILDCARD


def variables(words: Column, template: Column) -> Column:
    """The words at the template's wildcards; wildcards themselves if the message has no words."""
    pairs = F.zip_with(words, template, lambda w, t: F.struct(w.alias("w"), t.alias("t")))
    kept = F.transform(F.filter(pairs, lambda p: p["t"] == WILDCARD), lambda p: p["w"])
    return F.when(F.size(words) == 0, F.filter(template, lambda t: t == WILDCARD)).otherwise(kept)


def variable_places(template: Column) -> Column:
    places = F.transform(template, lambda t, i: F.when(t == WILDCARD, i))
    return F.filter(places, lambda i: i.isNotNull())


def description(template: Column) -> Column:
    return F.filter(template, lambda t: t != WILDCARD)


def restore_message(words: Column, symbols: Column, keep_escapes: bool = False) -> Column:
    """Interleave symbols and words; without symbols the words are put together as they are."""
    plain = words if keep_escapes else F.transform(words, unescape)
    longer = F.concat(plain, F.array(F.lit("")))
    mixed = F.zip_with(symbols, longer, lambda s, w: F.concat(F.coalesce(s, F.lit("")), F.coalesce(w, F.lit(""))))
    return F.when(symbols.isNull() | (F.size(symbols) == 0), F.array_join(plain, "")).otherwise(F.array_join(mixed, ""))


def restore_line(dt: Column, host: Column, message: Column) -> Column:
    return F.concat_ws(" ", F.date_format(dt, "yyyy-MM-dd HH:mm:ss"), host, message)


def matches_template(words: Column, template: Column) -> Column:
    """Equal lengths, and every place equal or a wildcard in the template."""
    same = F.forall(F.zip_with(words, template, lambda w, t: (t == WILDCARD) | (w == t)), lambda x: x)
    return (F.size(words) == F.size(template)) & same


def literal_bits(template: Column) -> Column:
    """1 for each literal, 0 for each wildcard: the larger string is preferred where several templates match."""
    return F.array_join(F.transform(template, lambda t: F.when(t == WILDCARD, "0").otherwise("1")), "")


def merge_templates(a: Column, b: Column) -> Column:
    """Place by place the common word, else a wildcard; null if the lengths differ."""
    merged = F.zip_with(a, b, lambda x, y: F.when(x == y, x).otherwise(WILDCARD))
    return F.when(F.size(a) == F.size(b), merged)


def word_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over words, where a wildcard equals any word, as one nested fold."""
    first = F.transform(F.concat(F.array(F.lit("")), b), lambda x, i: i)

    def row(previous: Column, x: Column) -> Column:
        start = F.array(F.element_at(previous, 1) + 1)
        return F.aggregate(
            F.transform(b, lambda y, j: F.struct(j.alias("j"), ((x != y) & (x != WILDCARD) & (y != WILDCARD)).cast("int").alias("c"))),
            start,
            lambda acc, y: F.concat(
                acc,
                F.array(F.least(F.element_at(acc, -1) + 1, F.element_at(previous, y["j"] + 2) + 1, F.element_at(previous, y["j"] + 1) + y["c"])),
            ),
        )

    return F.element_at(F.aggregate(a, first, row), -1)


def length_cosine(a: Column, b: Column) -> Column:
    """Cosine of the vectors of word lengths; null if the numbers of words differ."""
    la, lb = F.transform(a, F.length), F.transform(b, F.length)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(la, lb, lambda x, y: (x * y).cast("double")))
    norms = [F.sqrt(total(F.transform(x, lambda v: (v * v).cast("double")))) for x in (la, lb)]
    return F.when(F.size(a) == F.size(b), dot / (norms[0] * norms[1]))


def ngrams(words: Column, n: int, drop_last: bool = False) -> Column:
    """Slices of ``n`` words; drop_last leaves the last one out, as one grouping method does."""
    count = F.size(words) - n + (0 if drop_last else 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(words, i, n))).otherwise(F.array().cast("array<array<string>>"))


def fold_digits(word: Column) -> Column:
    r"""Runs of digits become ``\d``."""
    return F.regexp_replace(word, "[0-9]+", r"\\d")


def valid_text(value: Column) -> Column:
    """Drop undecodable bytes."""
    return F.regexp_replace(F.make_valid_utf8(value), "\\uFFFD", "")
