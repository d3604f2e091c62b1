"""Text cleaning and tokenisation as native Spark column expressions (TXT-1 … TXT-13).

Whitespace is spelled out as an explicit ASCII class because ``\\s`` differs between Java
regex, RE2 and Python; ``.`` is written ``[^\\n]`` for the same reason.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import english_stop_words, named_entities

WS = r"[ \t\n\r\f\x0B]"
WORD = r"[\p{L}\p{N}_]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _codepoint_to_char(num: Column) -> Column:
    """Unicode code point (int column) → one-character string, via UTF-32 decoding."""
    return F.decode(F.unhex(F.lpad(F.hex(num), 8, "0")), "UTF-32")


def _valid_codepoint(num: Column) -> Column:
    return (num <= 0x10FFFF) & ~num.between(0xD800, 0xDFFF)


_REFERENCE = r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#x[0-9a-fA-F]{1,6});"


def _decoded(ref: Column) -> Column:
    """The character that a reference ``&…;`` stands for; one that is unknown stays as it is."""
    body = F.substring(ref, F.lit(2), F.length(ref) - 2)
    number = F.when(body.startswith("#x"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10)) \
        .otherwise(F.substring(body, F.lit(2), F.length(body))).cast("int")
    names = F.array(*[F.lit(n) for n, _ in named_entities()])
    chars = F.array(*[F.lit(c) for _, c in named_entities()])
    return F.when(body.startswith("#"), F.when(_valid_codepoint(number), _codepoint_to_char(number)).otherwise(ref)) \
        .otherwise(F.coalesce(F.get(chars, (F.array_position(names, body) - 1).cast("int")), ref))


def unescape_entities(col) -> Column:
    """TXT-1: replace named, decimal and (lower-case x) hex character references; unknown references
    stay as they are.  The text is cut once into references and what lies between them, so that each
    reference is looked up by itself and nothing is decoded twice."""
    text = _c(col)
    pieces = F.regexp_extract_all(text, F.lit(_REFERENCE + "|[^&]+|&"), 0)
    decoded = F.transform(pieces, lambda p: F.when(p.startswith("&") & (F.length(p) > 1), _decoded(p)).otherwise(p))
    return F.when(F.instr(text, "&") > 0, F.array_join(decoded, "")).otherwise(text)


def strip_html(col, comments: bool = False) -> Column:
    """TXT-2: optionally turn ``<!--…-->`` into a space, then drop ``<…>`` (not across lines)."""
    out = _c(col)
    if comments:
        out = F.regexp_replace(out, r"<!--[^\n]*?-->", " ")
    return F.regexp_replace(out, r"<[^\n]*?>", "")


def collapse_spaces(col) -> Column:
    return F.regexp_replace(_c(col), WS + "{2,}", " ")


def clean_news(col) -> Column:
    """TXT-3: literal backslash-n and backslashes → space, ``#123;`` → space, entities, tags,
    runs of whitespace → one space."""
    out = F.replace(_c(col), F.lit("\\n"), F.lit(" "))
    out = F.replace(out, F.lit("\\"), F.lit(" "))
    out = F.regexp_replace(out, r"#[0-9]{1,};", " ")
    out = unescape_entities(out)
    out = strip_html(out)
    return collapse_spaces(out)


def clean_answers(col) -> Column:
    """TXT-4: collapse repeated ``?``/``!``/``.``, literal backslash-n → space, tags, spaces."""
    out = F.regexp_replace(_c(col), r"\?{2,}", "?")
    out = F.regexp_replace(out, r"!{2,}", "!")
    out = F.regexp_replace(out, r"\.{2,}", ".")
    out = F.replace(out, F.lit("\\n"), F.lit(" "))
    out = strip_html(out)
    return collapse_spaces(out)


def keep_ascii(col) -> Column:
    """TXT-5: drop every character at or above code point 128."""
    return F.regexp_replace(_c(col), r"[^\x00-\x7F]", "")


def split_sentences(col) -> Column:
    """TXT-6: tab-separated pieces, each cut after ``.``, ``!`` or ``?`` followed by whitespace.
    Returns ARRAY<STRING> without empty pieces."""
    marked = F.regexp_replace(_c(col), r"([.!?])" + WS + "+", "$1\t")
    return F.filter(F.split(marked, "\t"), lambda s: s != F.lit(""))


TOKEN_PATTERN = WORD + "+|[^ \t\n\r\f\x0B\\p{L}\\p{N}_]"


def tokenize_sentences(sentences) -> Column:
    """Per sentence, word runs and single punctuation characters as tokens."""
    return F.transform(_c(sentences), lambda s: F.regexp_extract_all(s, F.lit(TOKEN_PATTERN), 0))


def tokenize_rejoin(col) -> Column:
    """TXT-7: tokens joined by space within a sentence, sentences joined by tab."""
    toks = tokenize_sentences(split_sentences(col))
    return F.array_join(F.filter(F.transform(toks, lambda t: F.array_join(t, " ")),
                                 lambda s: s != F.lit("")), "\t")


VECTORIZER_PATTERN = "(" + WORD + "{2,})"


def vectorizer_tokens(col, stop_words=None) -> Column:
    """TXT-8 + FLT-2: lower-case words of two or more word characters, stop words removed
    (order and duplicates kept)."""
    toks = F.regexp_extract_all(F.lower(_c(col)), F.lit(VECTORIZER_PATTERN), 1)
    return remove_words(toks, english_stop_words() if stop_words is None else stop_words)


def whitespace_tokens(col) -> Column:
    """TXT-9: lower-case, split on whitespace runs, no minimum length."""
    return F.filter(F.split(F.lower(_c(col)), WS + "+"), lambda t: t != F.lit(""))


def remove_words(tokens, words) -> Column:
    """FLT-2: drop listed words from a token array (InSet membership, duplicates kept)."""
    words = list(words)
    if not words:
        return _c(tokens)
    return F.filter(_c(tokens), lambda t: ~t.isin(words))


def wrap_sentinels(tokens, start: str = "<s>", end: str = "</s>") -> Column:
    """TXT-10: ``<s>`` + tokens + ``</s>``; a sentence with no known token becomes [``</s>``]."""
    t = _c(tokens)
    return F.when(F.size(t) == 0, F.array(F.lit(end))).otherwise(
        F.concat(F.array(F.lit(start)), t, F.array(F.lit(end))))


def relative_position(tokens, word) -> Column:
    """TXT-11: zero-based index of the first occurrence / number of tokens (null if absent)."""
    t = _c(tokens)
    pos = F.array_position(t, word if isinstance(word, Column) else F.lit(word))
    return F.when(pos > 0, (pos - 1).cast("double") / F.size(t))


def format_mean_std(pairs) -> Column:
    """TXT-12: ``$m\\pm s\\%$`` (two decimals of value·100) for each (mean, std), joined by ' | '."""
    parts = [F.format_string("$%.2f\\pm%.2f\\%%$", _c(m) * 100, _c(s) * 100) for m, s in pairs]
    return F.concat_ws(" | ", *parts)


def to_json_doc(*cols) -> Column:
    """TXT-13: JSON text of a record."""
    return F.to_json(F.struct(*cols))


def from_json_doc(col, schema: str) -> Column:
    return F.from_json(_c(col), schema)
