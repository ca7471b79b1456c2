"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from weftline.functions.text import PUNCTUATION, SPACE

_PUNCT = PUNCTUATION.replace("'", "''")


def clean(x: str) -> str:
    return f"lower(translate(regexp_replace({x}, '<[^>]*>', '', 'g'), '{_PUNCT}', ''))"


def tokens(x: str, shortest: int = 2, banned: tuple[str, ...] = ("href", "https")) -> str:
    keep = "".join(f" AND NOT contains(w, '{b}')" for b in banned)
    words = f"list_transform(string_split_regex(coalesce({x}, ''), '{SPACE}'), lambda w: lower(translate(w, '{_PUNCT}', '')))"
    return f"list_filter({words}, lambda w: length(w) >= {shortest} AND regexp_matches(w, '^\\p{{L}}+$'){keep})"


#: Captions: a user's turn is the reference, the assistant's answer the prediction.
PAIRS = """
pairs AS (
  SELECT u.conv_id || ':' || u.turn AS pair_id, u.text AS ref_text, a.text AS pred_text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""

PAIR_TOKENS = f"""{PAIRS},
tok AS (SELECT pair_id, {tokens('ref_text')} AS ref, {tokens('pred_text')} AS pred FROM pairs)"""

#: n-gram counts of both sides of each pair.
GRAMS = f"""{PAIR_TOKENS},
grams AS (
  SELECT pair_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g, p
  FROM (SELECT pair_id, ref AS w, 0 AS p FROM tok UNION ALL SELECT pair_id, pred, 1 FROM tok),
       unnest([1, 2, 3, 4]) AS o(n), unnest(range(1, len(w) - n + 2)) AS q(i)
),
per_gram AS (SELECT pair_id, n, g, sum(p)::BIGINT AS hyp, sum(1 - p)::BIGINT AS ref FROM grams GROUP BY ALL),
overlap AS (
  SELECT pair_id, n, sum(least(hyp, ref))::BIGINT AS clip, sum(hyp)::BIGINT AS pred_total, sum(ref)::BIGINT AS ref_total
  FROM per_gram GROUP BY ALL
)"""

#: The split of the documents, and the words of the training part.
SPLIT = """
split AS (
  SELECT *, CASE WHEN r <= floor(0.75 * n) THEN 'TRAIN' WHEN r <= floor((0.75 + 0.05) * n) THEN 'VAL' ELSE 'TEST' END AS part
  FROM (SELECT *, row_number() OVER (ORDER BY md5('0|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)
)"""

#: Vocabulary of the answers, numbered by first occurrence.
ANSWERS = f"""
answers AS (
  SELECT conv_id * 1000 + turn AS id, {tokens('text')} AS w FROM conversations WHERE role = 'assistant'
),
places AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM answers),
vocab AS (
  SELECT word, n, row_number() OVER (ORDER BY f) AS ix
  FROM (SELECT word, count(*) AS n, min({{'id': id, 'pos': pos}}) AS f FROM places GROUP BY word HAVING count(*) >= 2)
)"""

ENCODED = f"""{ANSWERS},
encoded AS (
  SELECT a.id, coalesce(list(v.ix ORDER BY p.pos) FILTER (v.ix IS NOT NULL), []) AS seq
  FROM answers a LEFT JOIN places p USING (id) LEFT JOIN vocab v USING (word) GROUP BY a.id
)"""
