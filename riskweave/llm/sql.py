"""Checking SQL of the operators that plain SQL can follow, written independently of their plans."""

from __future__ import annotations

from .licences import MIN_SHARE, TEMPLATES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


def _licences() -> str:
    rows = [
        (t, k, word, template.label, int(template.base), int(k in template.key_words()))
        for t, template in enumerate(TEMPLATES)
        for k, word in enumerate(template.words())
    ]
    values = ", ".join(f"({t}, {k}, '{w}', '{label}', {base}, {key})" for t, k, w, label, base, key in rows)
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all({_low("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
tokens AS (SELECT d, unnest(words) AS word, unnest(range(len(words))) AS i FROM docs),
templates(t, k, word, label, base, is_key) AS (VALUES {values}),
sizes AS (SELECT t, count(*) AS size, sum(is_key) AS keys FROM templates GROUP BY t),
aligned AS (
  SELECT d, t, i - k AS start, any_value(label) AS label, any_value(base) AS base,
         count(*) AS matched, sum(is_key) AS keys
  FROM tokens JOIN templates USING (word) GROUP BY d, t, i - k),
places AS (
  SELECT d, start, label, base, matched, size
  FROM aligned JOIN sizes ON aligned.t = sizes.t AND aligned.keys = sizes.keys
  WHERE base = 1 OR 100 * matched >= {MIN_SHARE} * size),
found AS (
  SELECT d, count(*) FILTER (base = 1) AS n_base, min(start) FILTER (base = 1) AS first_word,
         max(start) FILTER (base = 1) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base = 1) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(CAST(matched AS DOUBLE) / size * (1 - power(2.0, -least(matched, 50)))) AS score
  FROM places GROUP BY d)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN found USING (d)"""


def _collocations(count: int = 2000, least: int = 100) -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, concat_ws(' ', {', '.join(f'w{k}' for k in range(1, m + 1))}) AS phrase, {m} AS words"
        f" FROM ahead WHERE w{m} IS NOT NULL"
        for m in range(1, 6)
    )
    cuts = " UNION ALL ".join(
        f"SELECT lang, phrase, words, a, {k} AS k, array_to_string(string_split(phrase, ' ')[:{k}], ' ') AS head,"
        f" array_to_string(string_split(phrase, ' ')[{k + 1}:], ' ') AS tail FROM f WHERE words > {k}"
        for k in range(1, 5)
    )
    leads = ", ".join(f"lead(word, {k}) OVER piece AS w{k + 1}" for k in range(1, 5))
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         regexp_split_to_array({_low("text")}, '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
pieces AS (SELECT d, lang, unnest(pieces) AS piece, unnest(range(len(pieces))) AS p FROM texts),
words AS (
  SELECT d, lang, p, unnest(regexp_extract_all(piece, '[^\x20\x09]+')) AS word,
         unnest(range(len(regexp_extract_all(piece, '[^\x20\x09]+')))) AS i
  FROM pieces),
ahead AS (SELECT lang, word AS w1, {leads} FROM words WINDOW piece AS (PARTITION BY d, p ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, phrase, words, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
sizes AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
longer AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[:words - 1], ' ') AS phrase, a FROM f WHERE words > 2
  UNION ALL
  SELECT lang, array_to_string(string_split(phrase, ' ')[2:], ' ') AS phrase, a FROM f WHERE words > 2),
covered AS (SELECT DISTINCT f.lang, f.phrase FROM f JOIN longer USING (lang, phrase) WHERE longer.a >= f.a),
scored AS (
  SELECT c.lang, c.phrase, c.a, n, k, h.a AS l, t.a AS r,
         (1000::HUGEINT * c.a * n) // (h.a::HUGEINT * t.a) AS score
  FROM ({cuts}) c
  JOIN f h ON h.lang = c.lang AND h.phrase = c.head
  JOIN f t ON t.lang = c.lang AND t.phrase = c.tail
  JOIN sizes s ON s.lang = c.lang),
lowest AS (
  SELECT * FROM scored ANTI JOIN covered USING (lang, phrase)
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= {count}"""


def _search() -> str:
    term = rf"regexp_extract_all({_low('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {term} AS terms FROM documents),
totals AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms)) AS n_terms FROM docs),
lengths AS (
  SELECT d, doc_id, CAST(50 + (50 * len(terms) * n_docs) // n_terms AS BIGINT) AS m
  FROM docs, totals WHERE len(terms) > 0),
counts AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY d, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, totals GROUP BY term, n_docs),
asked AS (SELECT DISTINCT item_id, unnest({term}) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, d, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (d)
  GROUP BY item_id, doc_id, d),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, d) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50"""


def texts() -> dict[str, str]:
    """Name of a query to its SQL."""
    return {"op11_licences": _licences(), "op12_collocations": _collocations(), "op13_search": _search()}
