"""SQL building blocks for the DuckDB oracles (same rules as ``fixtures.py``)."""
from __future__ import annotations

from ..constants import LANG_LABELS, english_stop_words, sql_string_list

WORD = r"[\p{L}\p{N}_]"


def stop_list() -> str:
    return sql_string_list(english_stop_words())


def corpus_cte() -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(LANG_LABELS.items()))
    return f"corpus AS (SELECT doc_id, CAST(CASE lang {cases} END AS INTEGER) AS label, text FROM documents)"


def tokens_cte() -> str:
    return (f"tokens AS MATERIALIZED (SELECT doc_id, label, list_filter(regexp_extract_all(lower(text), "
            f"'({WORD}{{2,}})', 1), lambda t: NOT list_contains({stop_list()}, t)) AS tokens FROM corpus)")


def feat_cte() -> str:
    return "feat AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def shuffle_key(id_expr: str, seed: int = 42) -> str:
    return f"md5('{seed}-' || CAST({id_expr} AS VARCHAR))"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def sq_dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(generate_series(1, len({a})), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(generate_series(1, len({a})), lambda i: {a}[i] * {b}[i]))"


def centers_cte(max_label: int = 10, name: str = "centers", src: str = "feat") -> str:
    """Per-label mean vectors as (center_id, center DOUBLE[])."""
    return (f"{name}_long AS (SELECT label AS center_id, d, avg(v) AS v FROM (SELECT label, "
            f"unnest(x) AS v, generate_subscripts(x, 1) AS d FROM {src} WHERE label < {max_label}) GROUP BY label, d),\n"
            f"{name} AS (SELECT center_id, list(v ORDER BY d) AS center FROM {name}_long GROUP BY center_id)")


def pred_cte(max_label: int = 10, name: str = "pred", centers: str = "centers") -> str:
    """Nearest centre per feat row, ties → lowest centre id."""
    return (f"{name} AS (SELECT vec_id, label, x, CAST(arg_min(center_id, struct_pack(d := dist, c := center_id)) AS INTEGER) AS pred, "
            f"min(dist) AS dist2 FROM (SELECT f.vec_id, f.label, f.x, c.center_id, {sq_dist('f.x', 'c.center')} AS dist "
            f"FROM feat f, {centers} c WHERE f.label < {max_label}) GROUP BY vec_id, label, x)")


def trials_cte(k: int = 10, n_trials: int = 10, max_label: int = 10) -> str:
    return (f"tc AS (SELECT CAST((rn - 1) // {k} AS INTEGER) AS trial, CAST((rn - 1) % {k} AS INTEGER) AS center_id, x AS center "
            f"FROM (SELECT x, row_number() OVER (ORDER BY {shuffle_key('vec_id')}, vec_id) AS rn FROM feat "
            f"WHERE label < {max_label}) WHERE rn <= {k * n_trials}),\n"
            f"trials AS (SELECT trial, vec_id, label, CAST(arg_min(center_id, struct_pack(d := dist, c := center_id)) AS INTEGER) AS pred "
            f"FROM (SELECT t.trial, f.vec_id, f.label, t.center_id, {sq_dist('f.x', 't.center')} AS dist "
            f"FROM feat f, tc t WHERE f.label < {max_label}) GROUP BY trial, vec_id, label)")


def long_form(id_cols: str, arr: str, src: str, value: str = "value") -> str:
    return (f"SELECT {id_cols}, CAST(dim AS INTEGER) AS dim, round(v, 6) AS {value} FROM (SELECT {id_cols}, "
            f"unnest({arr}) AS v, generate_subscripts({arr}, 1) - 1 AS dim FROM {src})")


def vocab_ctes() -> list[str]:
    return ["pairs AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tokens) GROUP BY doc_id, term)",
            "stats AS (SELECT term, sum(tf) AS total FROM pairs GROUP BY term)",
            "vocab AS MATERIALIZED (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx FROM (SELECT * FROM stats ORDER BY total DESC, term LIMIT 2000))",
            "wv AS MATERIALIZED (SELECT v.term AS word, v.idx, f.x AS vec FROM vocab v JOIN feat f ON f.vec_id = v.idx % (SELECT count(*) FROM embeddings))"]


def wv_ctes() -> list[str]:
    return [corpus_cte(), tokens_cte(), feat_cte(), *vocab_ctes(),
            "trows AS MATERIALIZED (SELECT doc_id, label, CAST(generate_subscripts(tokens, 1) - 1 AS INTEGER) AS pos, unnest(tokens) AS token FROM tokens)"]


def cluster_words_ctes(k: int = 20) -> list[str]:
    return [*wv_ctes(),
            "cw0 AS MATERIALIZED (SELECT label AS cluster, token AS word, count(*) AS count FROM trows WHERE token IN (SELECT word FROM wv) GROUP BY label, token)",
            f"cw AS (SELECT c.cluster, c.word, c.count, w.vec FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY count DESC, word) AS rank "
            f"FROM cw0) c JOIN wv w USING (word) WHERE rank <= {k})"]


def explain_tokens_cte() -> str:
    from ..constants import PUNCTUATION
    ws = r"[ \t\n\r\f\x0B]+"
    excl = sql_string_list(list(english_stop_words()) + list(PUNCTUATION))
    return ("et AS MATERIALIZED (SELECT doc_id, label, toks, list_filter(toks, lambda t: NOT list_contains(" + excl + ", t)) AS tokens FROM "
            f"(SELECT doc_id, label, list_filter(regexp_split_to_array(lower(text), '{ws}'), lambda t: t <> '') AS toks FROM corpus))")


def norm_expr(v: str) -> str:
    return f"list_transform({v}, lambda e: e / sqrt({dot(v, v)}))"
