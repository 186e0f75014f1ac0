"""SQL of spelling variants, licence scans and divergence audits, for small tables."""

from __future__ import annotations

from ledgerlens.llm import licences
from ledgerlens.llm.divergence import Settings as Audit

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


# -- spelling variants


def spelling(least_length: int = 7, least: int = 2, ratio: int = 10, spoiled: int = 31) -> str:
    """Words that meet on what is left when one character is deleted, the neighbours verified by that."""
    # CRC-32 byte by byte, over the remainders that its polynomial gives.
    steps = ", ".join(
        f"t{k + 1} AS (SELECT i, CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END AS b FROM t{k})"
        for k in range(8)
    )
    # A run's characters are ASCII or take two bytes that begin with 195.
    characters = "[unicode(run[k]) FOR k IN range(1, length(run) + 1)]"
    wide = f"flatten([CASE WHEN c < 128 THEN [c] ELSE [195, c - 64] END FOR c IN {characters}])"
    narrow = "[unicode(told[k]) FOR k IN range(1, length(told) + 1)]"
    return f"""
WITH RECURSIVE t0 AS (SELECT i, i AS b FROM (SELECT unnest(range(256)) AS i)),
{steps},
crc AS (SELECT list(CAST(b AS BIGINT) ORDER BY i) AS remainders FROM t8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS told, {_lower("run")} AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= {least_length}),
hashed AS (
  SELECT run, xor(list_reduce({narrow} || {wide},
    lambda h, x: xor(h >> 8, remainders[xor(h & 255, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM runs, crc),
spelt AS (
  SELECT CASE WHEN h % {spoiled} = 0
    THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
    ELSE run END AS word FROM hashed),
words AS MATERIALIZED (
  SELECT word, COUNT(*) AS n FROM spelt WHERE length(word) >= {least_length}
  GROUP BY word HAVING COUNT(*) >= {least}),
gaps AS MATERIALIZED (
  SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
pairs AS (
  SELECT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n
  FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.k = b.k AND a.word < b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word),
near AS (SELECT a AS word, a_n AS n, b AS other, b_n AS other_n FROM pairs
         UNION ALL SELECT b, b_n, a, a_n FROM pairs),
best AS (
  SELECT word, COUNT(*) AS n_near, arg_min(other, (-other_n, other)) AS other, MAX(other_n) AS other_n
  FROM near GROUP BY word),
found AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN other_n >= {ratio} * n THEN other END AS form,
         CASE WHEN other_n >= {ratio} * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, form AS so_far, 1 AS depth FROM found WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, found.form, depth + 1
  FROM chain JOIN found ON found.word = chain.so_far WHERE found.form IS NOT NULL),
ends AS (SELECT word, arg_max(so_far, depth) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM found LEFT JOIN ends USING (word)"""


# -- licence scan


def _values(rows: list[tuple]) -> str:
    def literal(x) -> str:
        return f"'{x}'" if isinstance(x, str) else str(x)

    return ", ".join(f"({', '.join(map(literal, r))})" for r in rows)


def licence_scan(s: licences.Settings = licences.Settings()) -> str:
    templates = licences.BASE + licences.TEXTS
    heads, postings, phrases = [], [], []
    for i, t in enumerate(templates):
        some = 1 if not t.phrases else max(s.rare, t.votes)
        heads.append((i, t.label, len(t.words), t.votes, some, s.slack if t.phrases else 0, len(t.mandatory)))
        postings += [(i, k, w) for k, w in enumerate(t.words)]
        phrases += [
            (i, p, len(part), at + k, w) for p, (at, part) in enumerate(t.mandatory) for k, w in enumerate(part)
        ]
    return f"""
WITH head(template, label, size, votes, leads, slack, phrases) AS (VALUES {_values(heads)}),
post(template, place, word) AS (VALUES {_values(postings)}),
phrase(template, phrase, size, place, word) AS (VALUES {_values(phrases)}),
rows AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex({_lower("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'),
                     lambda x: x <> '') AS ws FROM documents),
tok AS MATERIALIZED (
  SELECT r, pos, word FROM (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM rows)
  WHERE word IN (SELECT word FROM post)),
docs AS (SELECT word, COUNT(DISTINCT r) AS docs FROM tok GROUP BY word),
rare AS (
  SELECT template, word FROM (
    SELECT template, word, row_number() OVER (PARTITION BY template ORDER BY coalesce(docs, 0), word) AS k
    FROM (SELECT DISTINCT template, word FROM post) LEFT JOIN docs USING (word)) JOIN head USING (template)
  WHERE k <= leads),
voted AS MATERIALIZED (
  SELECT r, template, pos - place AS start FROM tok JOIN post USING (word) JOIN rare USING (template, word)
  JOIN head USING (template) GROUP BY r, template, start HAVING COUNT(*) >= any_value(votes)),
stands AS (
  SELECT voted.r, template, start, p.phrase, shift, COUNT(*) = any_value(p.size) AS whole
  FROM voted JOIN head USING (template) JOIN phrase p USING (template)
  JOIN (SELECT unnest(range(-{s.slack}, {s.slack} + 1)) AS shift) ON abs(shift) <= slack
  JOIN tok ON tok.r = voted.r AND tok.pos = start + p.place + shift AND tok.word = p.word
  GROUP BY voted.r, template, start, p.phrase, shift),
verified AS (
  SELECT r, template, start FROM stands JOIN head USING (template) WHERE whole
  GROUP BY r, template, start HAVING COUNT(DISTINCT phrase) = any_value(phrases)),
placed AS (
  SELECT v.r, v.template, v.start, any_value(label) AS label, CAST(COUNT(*) AS DOUBLE) / any_value(head.size) AS share
  FROM verified v JOIN head USING (template) JOIN post p USING (template)
  JOIN tok ON tok.r = v.r AND tok.pos = v.start + p.place AND tok.word = p.word
  GROUP BY v.r, v.template, v.start),
told AS (
  SELECT r, COUNT(*) FILTER (template < {len(licences.BASE)}) AS n_base,
         MIN(start) FILTER (template < {len(licences.BASE)}) AS first_word,
         MAX(start) FILTER (template < {len(licences.BASE)}) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (template < {len(licences.BASE)}) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, MAX(share) AS score
  FROM placed GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM rows LEFT JOIN told USING (r)"""


# -- divergence audit


def divergence_audit(s: Audit = Audit()) -> str:
    def scaled(n: str, total: str) -> str:
        return f"CAST(1 + (1000000000 * CAST({n} + {s.smooth} AS HUGEINT)) // {total} AS BIGINT)"

    return f"""
WITH rows AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     coalesce(text, '') AS text FROM documents),
tok AS (SELECT r, lang, source, unnest(list_filter(
          string_split_regex({_lower("text")}, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS term
        FROM rows),
kept AS MATERIALIZED (SELECT lang, term, COUNT(*) AS lang_n FROM tok GROUP BY lang, term
                      HAVING COUNT(DISTINCT r) >= {s.least_documents}),
v AS (SELECT lang, COUNT(*) AS v, SUM(lang_n) AS held FROM kept GROUP BY lang),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM rows),
counts AS MATERIALIZED (SELECT lang, source, term, COUNT(*) AS n FROM tok JOIN kept USING (lang, term)
                        GROUP BY lang, source, term),
full_counts AS (SELECT lang, source, term, lang_n, coalesce(n, 0) AS n
                FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
priced AS MATERIALIZED (
  SELECT lang, source, term, n, {scaled("n", f"(SUM(n) OVER (PARTITION BY lang, source) + {s.smooth} * v)")} AS p,
         {scaled("lang_n", f"(held + {s.smooth} * v)")} AS q
  FROM full_counts JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(SUM(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN priced y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source)
SELECT lang, source, 'pair' AS part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', term, p - q,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS INTEGER) AS rank
FROM priced WHERE n > 0 AND p > q QUALIFY rank <= {s.most_terms}"""


ORACLES = {
    "op11_spelling_variants": spelling(),
    "op12_license_scan": licence_scan(),
    "op13_divergence_audit": divergence_audit(),
}
