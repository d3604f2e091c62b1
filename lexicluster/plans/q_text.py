"""Queries: text cleaning and tokenisation functions (TXT-1 … TXT-13, FLT-2, FLT-5, FLT-7)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import named_entities, sql_string
from ..functions import text as T
from ..session import table
from . import fixtures as fx
from .registry import register
from .sqlparts import WORD, corpus_cte, stop_list, tokens_cte, with_

WS = r"[ \t\n\r\f\x0B]"


def sql_unescape(expr: str) -> str:
    out = expr
    amp = None
    for name, ch in named_entities():
        if name == "amp":
            amp = ch
            continue
        out = f"replace({out}, {sql_string('&' + name + ';')}, {sql_string(ch)})"
    cp_ok = "({v} <= 1114111 AND NOT ({v} BETWEEN 55296 AND 57343))"
    dec_v = "CAST(n AS INTEGER)"
    out = (f"list_reduce(list_prepend({out}, list_distinct(regexp_extract_all({out}, '&#([0-9]{{1,7}});', 1))), "
           f"lambda acc, n: CASE WHEN {cp_ok.format(v=dec_v)} THEN replace(acc, '&#' || n || ';', chr({dec_v})) "
           f"ELSE acc END)")
    hex_v = "CAST(('0x' || h) AS INTEGER)"
    out = (f"list_reduce(list_prepend({out}, list_distinct(regexp_extract_all({out}, '&#x([0-9a-fA-F]{{1,6}});', 1))), "
           f"lambda acc, h: CASE WHEN {cp_ok.format(v=hex_v)} THEN replace(acc, '&#x' || h || ';', chr({hex_v})) "
           f"ELSE acc END)")
    return f"replace({out}, '&amp;', {sql_string(amp)})"


def sql_strip_html(expr: str, comments: bool = False) -> str:
    if comments:
        expr = f"regexp_replace({expr}, '<!--[^\\n]*?-->', ' ', 'g')"
    return f"regexp_replace({expr}, '<[^\\n]*?>', '', 'g')"


def sql_collapse(expr: str) -> str:
    return f"regexp_replace({expr}, '{WS}{{2,}}', ' ', 'g')"


def sql_clean_news(expr: str) -> str:
    out = f"replace(replace({expr}, '\\n', ' '), '\\', ' ')"
    out = f"regexp_replace({out}, '#[0-9]{{1,}};', ' ', 'g')"
    return sql_collapse(sql_strip_html(sql_unescape(out)))


def sql_clean_answers(expr: str) -> str:
    out = f"regexp_replace({expr}, '\\?{{2,}}', '?', 'g')"
    out = f"regexp_replace({out}, '!{{2,}}', '!', 'g')"
    out = f"regexp_replace({out}, '\\.{{2,}}', '.', 'g')"
    out = f"replace({out}, '\\n', ' ')"
    return sql_collapse(sql_strip_html(out))


def sql_split_sentences(expr: str) -> str:
    marked = f"regexp_replace({expr}, '([.!?]){WS}+', '\\1' || chr(9), 'g')"
    return f"list_filter(string_split({marked}, chr(9)), lambda s: s <> '')"


TOKEN_PATTERN_SQL = WORD + "+|[^ \\t\\n\\r\\f\\x0B\\p{L}\\p{N}_]"


def sql_tokenize_rejoin(expr: str) -> str:
    sents = sql_split_sentences(expr)
    per = f"list_transform({sents}, lambda s: array_to_string(regexp_extract_all(s, '{TOKEN_PATTERN_SQL}', 0), ' '))"
    return f"array_to_string(list_filter({per}, lambda s: s <> ''), chr(9))"


def sql_whitespace_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '{WS}+'), lambda t: t <> '')"


@register("unescape_entities", lambda: f"SELECT page_id, {sql_unescape('html')} AS text FROM pages")
def q_unescape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.unescape_entities("html").alias("text"))


@register("strip_html", lambda: f"SELECT page_id, {sql_strip_html('html', True)} AS text FROM pages")
def q_strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html("html", comments=True).alias("text"))


@register("clean_news", lambda: f"SELECT page_id, {sql_clean_news('html')} AS text FROM pages")
def q_clean_news(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_news("html").alias("text"))


@register("clean_answers", lambda: "SELECT conv_id, turn, " + sql_clean_answers("text") + " AS text FROM conversations")
def q_clean_answers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_answers("text").alias("text"))


@register("keep_ascii", "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS text FROM documents")
def q_keep_ascii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.keep_ascii("text").alias("text"))


@register("split_sentences", lambda: "SELECT doc_id, CAST(sent_no AS INTEGER) AS sent_no, sentence FROM ("
          f"SELECT doc_id, unnest({sql_split_sentences('text')}) AS sentence, "
          f"generate_subscripts({sql_split_sentences('text')}, 1) - 1 AS sent_no FROM documents)")
def q_split_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.split_sentences("text")).alias("sent_no", "sentence"))


@register("tokenize_rejoin", lambda: f"SELECT doc_id, {sql_tokenize_rejoin('text')} AS text FROM documents")
def q_tokenize_rejoin(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.tokenize_rejoin("text").alias("text"))


@register("vectorizer_tokens", lambda: with_(corpus_cte(), tokens_cte()) +
          "SELECT doc_id, CAST(pos AS INTEGER) AS pos, token FROM (SELECT doc_id, unnest(tokens) AS token, "
          "generate_subscripts(tokens, 1) - 1 AS pos FROM tokens)")
def q_vectorizer_tokens(spark, sf_dir):
    return fx.tokens(spark, sf_dir).select("doc_id", F.posexplode("tokens").alias("pos", "token"))


@register("filter_stop_tokens", lambda: with_(corpus_cte(), tokens_cte()) +
          "SELECT doc_id, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS text FROM tokens")
def q_filter_stop_tokens(spark, sf_dir):
    t = fx.tokens(spark, sf_dir)
    return t.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("text"))


@register("whitespace_tokens", lambda: "SELECT doc_id, CAST(pos AS INTEGER) AS pos, token FROM ("
          f"SELECT doc_id, unnest({sql_whitespace_tokens('text')}) AS token, "
          f"generate_subscripts({sql_whitespace_tokens('text')}, 1) - 1 AS pos FROM documents)")
def q_whitespace_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(T.whitespace_tokens("text")).alias("pos", "token"))


@register("docs_containing_token", lambda:
          "WITH w AS (SELECT doc_id, " + sql_whitespace_tokens("text") + " AS toks FROM documents), "
          "top AS (SELECT token FROM (SELECT unnest(toks) AS token FROM w) GROUP BY token "
          "ORDER BY count(*) DESC, token LIMIT 20) "
          "SELECT top.token AS word, w.doc_id FROM w JOIN top ON list_contains(w.toks, top.token)")
def q_docs_containing_token(spark, sf_dir):
    from ..operators.filters import docs_containing_tokens
    d = table(spark, sf_dir, "documents")
    toks = d.select("doc_id", T.whitespace_tokens("text").alias("toks"))
    words = (toks.select(F.explode("toks").alias("token")).groupBy("token").count()
             .orderBy(F.col("count").desc(), "token").limit(20).select(F.col("token").alias("word")))
    return docs_containing_tokens(toks, words, "toks").select("word", "doc_id")


@register("relative_position", lambda:
          "WITH w AS (SELECT doc_id, " + sql_whitespace_tokens("text") + " AS toks FROM documents), "
          "top AS (SELECT token FROM (SELECT unnest(toks) AS token FROM w) GROUP BY token "
          "ORDER BY count(*) DESC, token LIMIT 20) "
          "SELECT top.token AS word, w.doc_id, round((list_position(w.toks, top.token) - 1) / len(w.toks), 6) AS rel_pos "
          "FROM w JOIN top ON list_contains(w.toks, top.token)")
def q_relative_position(spark, sf_dir):
    from ..operators.filters import docs_containing_tokens
    d = table(spark, sf_dir, "documents")
    toks = d.select("doc_id", T.whitespace_tokens("text").alias("toks"))
    words = (toks.select(F.explode("toks").alias("token")).groupBy("token").count()
             .orderBy(F.col("count").desc(), "token").limit(20).select(F.col("token").alias("word")))
    hits = docs_containing_tokens(toks, words, "toks")
    return hits.select("word", "doc_id", F.round(T.relative_position("toks", F.col("word")), 6).alias("rel_pos"))


@register("to_json_doc", lambda: with_(corpus_cte()) +
          "SELECT doc_id, CAST(json_object('text', text, 'cluster', label) AS VARCHAR) AS json FROM corpus")
def q_to_json(spark, sf_dir):
    c = fx.corpus(spark, sf_dir)
    return c.select("doc_id", T.to_json_doc(F.col("text"), F.col("label").alias("cluster")).alias("json"))


@register("from_json_doc", lambda: with_(corpus_cte()) +
          "SELECT doc_id, text, label AS cluster FROM corpus")
def q_from_json(spark, sf_dir):
    c = fx.corpus(spark, sf_dir)
    j = c.select("doc_id", T.to_json_doc(F.col("text"), F.col("label").alias("cluster")).alias("json"))
    return j.select("doc_id", T.from_json_doc("json", "text string, cluster int").alias("r")).select(
        "doc_id", "r.text", "r.cluster")
