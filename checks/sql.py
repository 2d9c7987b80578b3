"""The views of `views.py` in SQL, and a way to put together a query from them."""

import re

from trovelight.fixed_values import STOP_WORDS
from trovelight.functions.text import NOT_SPACE, SPACE

WS = SPACE
STOPS = ", ".join(f"'{word}'" for word in STOP_WORDS)


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '\A{WS}+|{WS}+\z', '', 'g')"


def collapse(text: str) -> str:
    return strip(f"regexp_replace({text}, '{WS}+', ' ', 'g')")


# name -> (names it reads, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, sql: str, *reads: str) -> None:
    VIEWS[name] = (list(reads), sql)


def query(final: str, *reads: str) -> str:
    """`final` with every view it reads, and every view those read, put before it."""
    ordered: list[str] = []

    def visit(name):
        if name in ordered:
            return
        for other in VIEWS[name][0]:
            visit(other)
        ordered.append(name)

    for name in reads:
        visit(name)
    parts = [f"{name} AS MATERIALIZED (\n{VIEWS[name][1]}\n)" if name != "cuts" else f"{VIEWS[name][1]}" for name in ordered]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + final


# --- files and assets --------------------------------------------------------------------------

view(
    "uploads",
    """SELECT doc_id AS upload_id, doc_id AS arrival, lang AS collection,
       source || '-' || doc_id || '.txt' AS filename, text, sha256(text) AS sha256,
       strlen(text)::INT AS size_bytes
FROM documents WHERE strlen(text) > 0 AND NOT contains(text, chr(0))""",
)
view(
    "assets_text",
    """SELECT min(upload_id) AS asset_id, collection, sha256, min(arrival) AS arrival,
       arg_min(filename, upload_id) AS filename, min(size_bytes) AS size_bytes
FROM uploads GROUP BY collection, sha256""",
    "uploads",
)
view(
    "texts",
    """SELECT a.asset_id, a.collection, u.text FROM assets_text a JOIN uploads u ON u.upload_id = a.asset_id""",
    "assets_text",
    "uploads",
)
view(
    "descriptions",
    r"""SELECT source || '-' || doc_id || '.txt' AS filename,
       '  Note ' || doc_id || ' of ' || source || chr(10) AS title,
       'A text in ' || lang || ' of quality ' || quality || '. ' AS description,
       [upper(lang), '  Text ' || chr(9) || ' ' || source, lang, 'Document',
        CASE WHEN toxic = 1 THEN 'Rude' ELSE ' ' END, repeat(source, 20)] AS tags,
       '' AS visible_text, NULL::VARCHAR AS image_type
FROM documents JOIN labels USING (doc_id)""",
)
view(
    "raw_images",
    r"""SELECT page_id + 10000000 AS asset_id, 'web' AS collection, 'IMG_' || page_id || '.jpg' AS filename,
       'image' AS asset_type, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url AS description,
       string_split(regexp_extract(url, '//([^/]+)', 1), '.') AS tags,
       regexp_replace(html, '<[^>]*>', ' ', 'g') AS visible_text,
       (['photo', 'screenshot', 'document', 'diagram', NULL])[page_id % 5 + 1] AS image_type
FROM pages""",
)
view(
    "raw_assets",
    """SELECT a.asset_id, a.collection, a.filename, 'text' AS asset_type,
       CASE WHEN d.filename IS NULL THEN a.filename ELSE d.title END AS title,
       CASE WHEN d.filename IS NULL THEN 'An uploaded text file.' ELSE d.description END AS description,
       CASE WHEN d.filename IS NULL THEN []::VARCHAR[] ELSE d.tags END AS tags,
       '' AS visible_text, NULL::VARCHAR AS image_type
FROM assets_text a LEFT JOIN descriptions d ON a.filename = d.filename
WHERE NOT contains(a.filename, 'invalid')
UNION ALL
SELECT asset_id, collection, filename, asset_type, title, description, tags, visible_text, image_type FROM raw_images""",
    "assets_text",
    "descriptions",
    "raw_images",
)

TIDY = f"list_transform(tags, lambda t: {collapse('lower(' + strip('t') + ')')})"
FITTING = f"list_filter({TIDY}, lambda t: t <> '' AND length(t) <= 50)"
# list_distinct does not keep the order, so a tag stays where no equal one stands before it.
FIRST_OF_EQUALS = "list_filter({0}, lambda t, i: list_position({0}, t) = i)"
view("tidy_tags", f"SELECT *, {FITTING} AS fitting FROM raw_assets", "raw_assets")
view(
    "model_tags",
    f"""SELECT * EXCLUDE (fitting),
       ({FIRST_OF_EQUALS.format("fitting")})[1:CASE WHEN asset_type = 'image' THEN 20 ELSE 15 END] AS kept,
       CASE WHEN asset_type = 'image' THEN coalesce(image_type, 'other') END AS kept_image_type
FROM tidy_tags""",
    "tidy_tags",
)
view(
    "typed",
    """SELECT *, CASE WHEN asset_type = 'text' THEN ['text', 'text file', 'document']
       WHEN kept_image_type = 'photo' THEN ['image', 'picture', 'photo', 'photograph']
       WHEN kept_image_type = 'screenshot' THEN ['image', 'picture', 'screenshot']
       WHEN kept_image_type = 'document' THEN ['image', 'picture', 'document', 'scan']
       WHEN kept_image_type = 'diagram' THEN ['image', 'picture', 'diagram', 'drawing']
       ELSE ['image', 'picture'] END AS fixed_tags FROM model_tags""",
    "model_tags",
)
view(
    "assets",
    f"""SELECT asset_id, collection, filename, asset_type,
       substr({strip("title")}, 1, 120) AS title, substr({strip("description")}, 1, 1000) AS description,
       kept || list_filter(fixed_tags, lambda t: NOT list_contains(kept, t)) AS tags,
       CASE WHEN asset_type = 'image' THEN substr({strip("visible_text")}, 1, 10000) END AS visible_text,
       kept_image_type AS image_type FROM typed""",
    "typed",
)
view(
    "assets_state",
    """SELECT doc_id AS asset_id, lang AS collection, source || '-' || doc_id || '.txt' AS filename,
       strlen(text)::INT AS size_bytes,
       (['pending', 'processing', 'ready', 'failed'])[doc_id % 4 + 1] AS status,
       CASE WHEN doc_id % 4 = 3 THEN 'OSError: gone' END AS error,
       CASE WHEN doc_id % 4 = 1 THEN TIMESTAMP '2026-01-01 00:00:00' + to_minutes(doc_id) END AS started_at,
       ((doc_id // 4) % 4)::INT AS attempts,
       CASE WHEN doc_id % 4 = 2 THEN 'Title ' || doc_id END AS title,
       CASE WHEN doc_id % 4 = 2 THEN source END AS description,
       CASE WHEN doc_id % 4 = 2 THEN [lang, source] END AS tags,
       CASE WHEN doc_id % 4 = 2 THEN 'fake-vision' END AS vision_model,
       TIMESTAMP '2026-01-01 00:00:00' + to_minutes(doc_id) AS created_at
FROM documents""",
)

# --- passages ----------------------------------------------------------------------------------

# A window's end: its last space after its first character, else its whole length. The tail after the
# last space is measured; reversing the text would take characters apart.
CUT_END = """CASE WHEN {start} + {size} >= n THEN n
       WHEN regexp_matches(substr(text, ({start} + 2)::INT, {size} - 1), ' ')
       THEN {start} + {size} - length(regexp_extract(substr(text, ({start} + 2)::INT, {size} - 1), ' [^ ]*\\z'))
       ELSE {start} + {size} END"""
CUT_NEXT = """CASE WHEN instr(substr(text, (greatest(stop - {overlap}, start + 1) + 1)::INT,
                              (stop - greatest(stop - {overlap}, start + 1))::INT), ' ') > 0
       THEN greatest(stop - {overlap}, start + 1)
            + instr(substr(text, (greatest(stop - {overlap}, start + 1) + 1)::INT,
                           (stop - greatest(stop - {overlap}, start + 1))::INT), ' ')
       ELSE stop END"""


def cuts(texts: str = "texts", size: int = 1600, overlap: int = 240) -> str:
    following = CUT_NEXT.format(overlap=overlap)
    return f"""cuts AS (
SELECT asset_id, 0::BIGINT AS start, {CUT_END.format(start="0", size=size)} AS stop, n
FROM (SELECT asset_id, text, length(text) AS n FROM {texts}) WHERE n > 0
UNION ALL
SELECT asset_id, start, {CUT_END.format(start="start", size=size)} AS stop, n
FROM (SELECT t.asset_id, t.text, c.n, {following.replace("text", "t.text").replace("start", "c.start").replace("stop", "c.stop")} AS start
      FROM cuts c JOIN {texts} t ON t.asset_id = c.asset_id WHERE c.stop < c.n)
)"""


VIEWS["cuts"] = (["texts"], cuts())
view(
    "chunks",
    f"""SELECT asset_id, collection, (row_number() OVER (PARTITION BY asset_id ORDER BY start) - 1)::INT AS unit_index,
       (start + length(w) - length(regexp_replace(w, '\\A{WS}+', '')))::INT AS start_char,
       (start + length(regexp_replace(w, '{WS}+\\z', '')))::INT AS end_char, {strip("w")} AS text
FROM (SELECT c.asset_id, t.collection, c.start, substr(t.text, (c.start + 1)::INT, (c.stop - c.start)::INT) AS w
      FROM cuts c JOIN texts t USING (asset_id))
WHERE {strip("w")} <> ''""",
    "cuts",
    "texts",
)

# --- units, postings, vectors ------------------------------------------------------------------

view(
    "unit_parts",
    r"""SELECT asset_id, collection, asset_type, 'metadata' AS kind, 0 AS number, 0 AS unit_index,
       NULL::INT AS start_char, NULL::INT AS end_char,
       title || chr(10) || chr(10) || description || chr(10) || chr(10) || 'tags: ' || array_to_string(tags, ', ') AS body
FROM assets
UNION ALL
SELECT asset_id, collection, asset_type, 'filename', 1, 0, NULL, NULL,
       filename || ' ' || array_to_string(regexp_extract_all(filename, '[\p{L}\p{N}]+'), ' ') FROM assets
UNION ALL
SELECT asset_id, collection, asset_type, 'image', 2, 0, NULL, NULL, NULL FROM assets WHERE asset_type = 'image'
UNION ALL
SELECT asset_id, collection, asset_type, 'visible_text', 3, 0, NULL, NULL, visible_text
FROM assets WHERE asset_type = 'image' AND visible_text <> ''
UNION ALL
SELECT asset_id, collection, 'text', 'content', 4, unit_index, start_char, end_char, text FROM chunks""",
    "assets",
    "chunks",
)
view(
    "units",
    """SELECT asset_id * 1000000 + number * 100000 + unit_index AS unit_id, asset_id, collection, asset_type, kind,
       unit_index, start_char, end_char, body FROM unit_parts""",
    "unit_parts",
)
view(
    "postings",
    rf"""SELECT collection, word AS term, unit_id, asset_id, kind, asset_type, count(*)::INT AS tf,
       list(position::INT ORDER BY position) AS positions
FROM (SELECT collection, unit_id, asset_id, kind, asset_type, unnest(words) AS word,
             unnest(range(1, len(words) + 1)) AS position
      FROM (SELECT *, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS words FROM units WHERE body IS NOT NULL))
WHERE word NOT IN ({STOPS})
GROUP BY collection, word, unit_id, asset_id, kind, asset_type""",
    "units",
)


def hashed(rows: str, key: str, text: str, dims: int = 64) -> str:
    """(key, bucket, n): how often a word of the text falls into a bucket."""
    return rf"""SELECT {key}, bucket, count(*) AS n
FROM (SELECT {key}, ('0x' || right(sha256(word), 7))::BIGINT % {dims} AS bucket
      FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')) AS word FROM {rows}
            WHERE {text} IS NOT NULL))
GROUP BY {key}, bucket"""


def dense(counts: str, key: str, dims: int = 64) -> str:
    """(key, embedding): the counts as a vector of floats of length 1."""
    return f"""SELECT {key}, list_transform(range({dims}), lambda b: (coalesce(m[b], 0) / sqrt(squares))::FLOAT) AS embedding
FROM (SELECT {key}, map(list(bucket), list(n)) AS m, sum(n * n)::DOUBLE AS squares FROM {counts} GROUP BY {key})"""


view("unit_counts", hashed("units", "unit_id", "body"), "units")
view("unit_dense", dense("unit_counts", "unit_id"), "unit_counts")
view(
    "vectors",
    """SELECT u.unit_id, u.asset_id, u.collection, u.asset_type, u.kind, d.embedding, 'hashed-64' AS embedding_model
FROM units u JOIN unit_dense d USING (unit_id)
UNION ALL
SELECT u.unit_id, u.asset_id, u.collection, u.asset_type, u.kind, e.embedding, 'given-64'
FROM units u JOIN embeddings e ON e.vec_id + 10000000 = u.asset_id WHERE u.kind = 'image'""",
    "units",
    "unit_dense",
)

# --- queries -----------------------------------------------------------------------------------

view(
    "queries",
    """SELECT item_id AS query_id, (['en', 'fr', 'de', 'es', 'web'])[item_id % 5 + 1] AS collection, text AS q,
       (['relevance', 'exact_first', 'tiered', 'blended'])[item_id % 4 + 1] AS "order",
       CASE WHEN item_id % 3 = 2 THEN 2 ELSE 1 END AS page,
       CASE WHEN item_id % 7 = 3 THEN ['exact', 'partial'] END AS match_kinds,
       CASE WHEN item_id % 11 = 5 THEN ['text'] END AS asset_types,
       CASE WHEN item_id % 13 = 4 THEN ['content', 'metadata'] END AS unit_kinds
FROM benchmark""",
)
view("asked", f"SELECT * REPLACE ({collapse('q')} AS q) FROM queries", "queries")
view("query_counts", hashed("asked", "query_id", "q"), "asked")
view("query_vectors", dense("query_counts", "query_id"), "query_counts")
view(
    "query_words",
    rf"""SELECT query_id, collection, literal, unnest(words) AS word, unnest(range(len(words))) AS position
FROM (SELECT query_id, collection, unnest(range(len(tokens))) AS literal,
             unnest(list_transform(tokens, lambda t: regexp_extract_all(t, '[\p{{L}}\p{{N}}]+'))) AS words
      FROM (SELECT query_id, collection, regexp_extract_all(lower(q), '{NOT_SPACE}+') AS tokens FROM asked))""",
    "asked",
)
view(
    "query_terms",
    f"SELECT query_id, collection, literal, word AS term, position FROM query_words WHERE word NOT IN ({STOPS})",
    "query_words",
)
view(
    "n_terms",
    "SELECT query_id, count(DISTINCT term) AS n_terms FROM query_terms GROUP BY query_id",
    "query_terms",
)
# Every literal of a plain query that a unit holds whole.
view(
    "whole_literals",
    """SELECT DISTINCT query_id, unit_id FROM (
  SELECT q.query_id, q.literal, p.unit_id, count(DISTINCT q.term) AS held
  FROM query_terms q JOIN postings p ON p.collection = q.collection AND p.term = q.term
  GROUP BY q.query_id, q.literal, p.unit_id)
JOIN (SELECT query_id, literal, count(DISTINCT term) AS needed FROM query_terms GROUP BY query_id, literal)
USING (query_id, literal) WHERE held = needed""",
    "query_terms",
    "postings",
)
view(
    "matched",
    """SELECT t.query_id, p.unit_id, p.asset_id, p.kind, p.asset_type, count(*) = any_value(n.n_terms) AS all_words,
       round(sum(list_sum(list_transform(range(1, p.tf + 1), lambda j: 1.0::DOUBLE / (j * j)))) / any_value(n.n_terms), 9) AS keyword_score
FROM (SELECT DISTINCT query_id, collection, term FROM query_terms) t
JOIN postings p ON p.collection = t.collection AND p.term = t.term
JOIN n_terms n ON n.query_id = t.query_id
GROUP BY t.query_id, p.unit_id, p.asset_id, p.kind, p.asset_type""",
    "query_terms",
    "postings",
    "n_terms",
)
view(
    "keyword_matches",
    "SELECT m.* FROM matched m JOIN whole_literals USING (query_id, unit_id)",
    "matched",
    "whole_literals",
)
view(
    "keyword_hits",
    """SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id
       ORDER BY all_words DESC, keyword_score DESC, unit_id))::INT AS rank FROM keyword_matches) WHERE rank <= 100""",
    "keyword_matches",
)
# --- stems -------------------------------------------------------------------------------------

# Porter's published steps, over the distinct words, with conditions on a word's letters written as a
# string of c and v. "y" is a vowel after a consonant, which is told from left to right.


def letters(word: str) -> str:
    made = f"regexp_replace(translate({word}, 'aeioubcdfghjklmnpqrstvwxz', 'vvvvvcccccccccccccccccccc'), '^y', 'c')"
    for _ in range(4):
        made = f"regexp_replace(regexp_replace({made}, 'cy', 'cv', 'g'), 'vy', 'vc', 'g')"
    return made


def measure(word: str) -> str:
    return f"len(regexp_extract_all({letters(word)}, 'v+c+'))"


def short_end(word: str) -> str:
    return f"(regexp_matches({letters(word)}, 'cvc$') AND right({word}, 1) NOT IN ('w', 'x', 'y'))"


def suffix_step(before: str, pairs: str, least: int, more: str = "TRUE") -> str:
    """The word with its suffix (the longest that fits) replaced where the rest has a measure over `least`."""
    table = dict(pair.split(":") for pair in pairs.split())
    ends = "|".join(sorted(table, key=len, reverse=True))
    cases = " ".join(f"WHEN '{end}' THEN '{to}'" for end, to in table.items())
    return f"""SELECT word, CASE WHEN suffix <> '' AND {measure("rest")} > {least} AND {more}
  THEN rest || CASE suffix {cases} END ELSE w END AS w
FROM (SELECT *, left(w, length(w) - length(suffix)) AS rest FROM (SELECT *, regexp_extract(w, '({ends})$') AS suffix FROM ({before})))"""


PLURALS = """SELECT word, CASE WHEN regexp_matches(word, '(sses|ies)$') THEN left(word, length(word) - 2)
  WHEN regexp_matches(word, '[^s]s$') THEN left(word, length(word) - 1) ELSE word END AS w
FROM (SELECT DISTINCT term AS word FROM (SELECT term FROM postings UNION ALL SELECT term FROM query_terms))
WHERE regexp_full_match(word, '[a-z]{3,}')"""
DOUBLES = "|".join(letter * 2 for letter in "bcdfghjkmnpqrtvwx")
PAST = f"""SELECT word, CASE
  WHEN ending = 'eed' THEN CASE WHEN {measure("rest")} > 0 THEN left(w, length(w) - 1) ELSE w END
  WHEN ending = '' OR NOT contains({letters("rest")}, 'v') THEN w
  WHEN regexp_matches(rest, '(at|bl|iz)$') THEN rest || 'e'
  WHEN regexp_matches(rest, '({DOUBLES})$') THEN left(rest, length(rest) - 1)
  WHEN {measure("rest")} = 1 AND {short_end("rest")} THEN rest || 'e' ELSE rest END AS w
FROM (SELECT *, left(w, length(w) - length(ending)) AS rest FROM (SELECT *, regexp_extract(w, '(eed|ed|ing)$') AS ending FROM ({PLURALS})))"""
FINAL_I = f"""SELECT word, CASE WHEN right(w, 1) = 'y' AND contains({letters("left(w, length(w) - 1)")}, 'v')
  THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM ({PAST})"""
LONG_TO_SHORT = suffix_step(
    FINAL_I,
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate "
    "ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble",
    0,
)
SHORTER = suffix_step(LONG_TO_SHORT, "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:", 0)
WITHOUT = suffix_step(
    SHORTER,
    "al: ance: ence: er: ic: able: ible: ant: ement: ment: ent: ion: ou: ism: ate: iti: ous: ive: ize:",
    1,
    "(suffix <> 'ion' OR right(rest, 1) IN ('s', 't'))",
)
WITHOUT_E = f"""SELECT word, CASE WHEN right(w, 1) = 'e' AND ({measure("rest")} > 1 OR ({measure("rest")} = 1 AND NOT {short_end("rest")}))
  THEN rest ELSE w END AS w FROM (SELECT *, left(w, length(w) - 1) AS rest FROM ({WITHOUT}))"""
view(
    "stems",
    f"""SELECT word, CASE WHEN right(w, 2) = 'll' AND {measure("w")} > 1 THEN left(w, length(w) - 1) ELSE w END AS stem FROM ({WITHOUT_E})""",
    "postings",
    "query_terms",
)
view(
    "postings_stemmed",
    """SELECT collection, coalesce(stem, term) AS term, unit_id, asset_id, kind, asset_type, sum(tf)::INT AS tf,
       list_sort(flatten(list(positions))) AS positions
FROM postings LEFT JOIN stems ON word = term GROUP BY ALL""",
    "postings",
    "stems",
)
view(
    "query_terms_stemmed",
    """SELECT query_id, collection, literal, coalesce(stem, term) AS term, position FROM query_terms LEFT JOIN stems ON word = term""",
    "query_terms",
    "stems",
)
# The keyword path over stems is the one above over other tables.
for name in ("n_terms", "whole_literals", "matched", "keyword_matches", "keyword_hits"):
    read, text = VIEWS[name]
    for table in ("query_terms", "postings", "n_terms", "whole_literals", "matched", "keyword_matches"):
        text = re.sub(rf"\b{table}\b", f"{table}_stemmed", text)
    view(f"{name}_stemmed", text, *[f"{other}_stemmed" for other in read])

view(
    "similarity_pairs",
    """SELECT q.query_id, v.unit_id, v.asset_id, v.kind, v.asset_type,
       round(list_cosine_similarity(v.embedding::DOUBLE[], w.embedding::DOUBLE[]), 6) AS similarity
FROM asked q JOIN query_vectors w USING (query_id)
JOIN vectors v ON v.collection = q.collection AND v.embedding_model = 'hashed-64'""",
    "asked",
    "query_vectors",
    "vectors",
)
view(
    "vector_hits",
    """SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, unit_id))::INT AS rank
FROM similarity_pairs) WHERE rank <= 100""",
    "similarity_pairs",
)

# --- fusion ------------------------------------------------------------------------------------

view(
    "fused",
    """SELECT coalesce(k.query_id, v.query_id) AS query_id, coalesce(k.unit_id, v.unit_id) AS unit_id,
       coalesce(k.asset_id, v.asset_id) AS asset_id, coalesce(k.kind, v.kind) AS kind,
       coalesce(k.asset_type, v.asset_type) AS asset_type, k.rank AS keyword_rank, v.rank AS vector_rank,
       coalesce(1.0::DOUBLE / (60 + k.rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + v.rank), 0.0::DOUBLE) AS score,
       CASE WHEN k.all_words THEN 'exact' WHEN k.unit_id IS NOT NULL THEN 'partial' ELSE 'semantic' END AS match
FROM keyword_hits k FULL OUTER JOIN vector_hits v ON k.query_id = v.query_id AND k.unit_id = v.unit_id""",
    "keyword_hits",
    "vector_hits",
)
view(
    "scaled",
    "SELECT *, score / max(score) OVER (PARTITION BY query_id) AS relative_score FROM fused",
    "fused",
)
view(
    "kept_units",
    """SELECT s.*, q."order", q.page, q.match_kinds, q.collection, q.q FROM scaled s JOIN asked q USING (query_id)
WHERE (q.asset_types IS NULL OR list_contains(q.asset_types, s.asset_type))
  AND (q.unit_kinds IS NULL OR list_contains(q.unit_kinds, s.kind))""",
    "scaled",
    "asked",
)
TIER = "CASE match WHEN 'exact' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END"
view(
    "grouped",
    f"""SELECT query_id, asset_id, any_value("order") AS "order", any_value(page) AS page,
       any_value(match_kinds) AS match_kinds, any_value(collection) AS collection, any_value(q) AS q,
       arg_min(unit_id, (tier, -relative_score, unit_id)) AS unit_id,
       arg_min(unit_id, (-relative_score, unit_id)) AS best_unit_id,
       max(relative_score) AS score, arg_min(match, tier) AS match, min(tier) AS tier
FROM (SELECT *, {TIER} AS tier FROM kept_units) GROUP BY query_id, asset_id""",
    "kept_units",
)
view(
    "ordered",
    """SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY
       CASE "order" WHEN 'exact_first' THEN least(tier, 1) WHEN 'tiered' THEN tier ELSE 0 END, score DESC, best_unit_id))::INT AS position
FROM grouped WHERE match_kinds IS NULL OR list_contains(match_kinds, match)""",
    "grouped",
)
view(
    "capped",
    """SELECT *, (count(*) OVER (PARTITION BY query_id))::INT AS n_matches FROM ordered WHERE position <= 100""",
    "ordered",
)
view(
    "shown",
    """SELECT *, n_matches > page * 20 AS has_more FROM capped
WHERE CASE WHEN (page - 1) * 20 < 20 THEN position <= greatest(20, page * 20)
           ELSE position > (page - 1) * 20 AND position <= page * 20 END""",
    "capped",
)
view(
    "fetched",
    """SELECT s.query_id, s.q, s."order", s.page, s.position, s.asset_id, s.unit_id, s.score, s.match, s.has_more,
       a.filename, a.asset_type, a.title, a.description, a.visible_text, u.kind AS snippet_kind,
       CASE WHEN u.kind = 'content' THEN u.body WHEN u.kind IN ('metadata', 'image') THEN a.description
            WHEN u.kind = 'visible_text' THEN a.visible_text ELSE a.filename END AS snippet_text,
       u.start_char, u.end_char
FROM shown s JOIN units u USING (unit_id) JOIN assets a ON a.asset_id = s.asset_id""",
    "shown",
    "units",
    "assets",
)
WORD_SHARE = f"""len(list_filter(regexp_extract_all(lower(q), '{NOT_SPACE}+'), lambda w: contains(lower(snippet_text), w)))::DOUBLE
       / len(regexp_extract_all(lower(q), '{NOT_SPACE}+'))"""
view(
    "scored",
    f"""SELECT *, CASE WHEN page = 1 AND position <= 20 THEN {WORD_SHARE} END AS relevance FROM fetched""",
    "fetched",
)
view(
    "reranked",
    """SELECT * EXCLUDE (final) REPLACE (final AS position) FROM (
  SELECT *, CASE WHEN page = 1 THEN (row_number() OVER (PARTITION BY query_id ORDER BY position > 20,
       CASE WHEN position <= 20 AND "order" = 'relevance' THEN -relevance ELSE 0 END, position))::INT
       ELSE position END AS final FROM scored)
WHERE final > (page - 1) * 20 AND final <= page * 20""",
    "scored",
)

# --- sentences ---------------------------------------------------------------------------------


# What cuts and keeps sentences, stated for SQL alone: fixed values. \x01 stands for a dot that ends nothing, \x02
# for the end of a sentence.
NEVER_ENDS = r"Mr|Mrs|Ms|Dr|Prof|St|Mt|Gen|Col|Capt|Lt|Sgt|Gov|Sen|Rep|Rev|Hon|Jr|Sr|No|Fig|vs|e\.g|i\.e"
ENDS_BEFORE_CAPITALS = (
    r"etc|Inc|Ltd|Co|Corp|Bros|dept|Dept|est|approx|min|max|Ave|Blvd|Rd|a\.m|p\.m|"
    r"Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
)


def sentence_cuts(text: str) -> str:
    """The text with a mark after every sentence: dots of list numbers, titles, short forms and initials are hidden first."""
    numbers = rf"regexp_replace({text}, '(^|\n|\r)([ \t]*\d{{1,3}})\.([ \t])', '\1\2' || chr(1) || '\3', 'g')"
    titles = rf"regexp_replace({numbers}, '\b({NEVER_ENDS})\.', '\1' || chr(1), 'g')"
    shortened = rf"regexp_replace({titles}, '\b({ENDS_BEFORE_CAPITALS})\.({WS}+(?:\p{{Ll}}|[0-9]))', '\1' || chr(1) || '\2', 'g')"
    initials = rf"regexp_replace({shortened}, '\b([A-Z])\. ', '\1' || chr(1) || ' ', 'g')"
    closing = "(?:[\"')\\]”’])*".replace("'", "''")
    ended = rf"regexp_replace({initials}, '((?:\.|!|\?)+{closing}{WS}+)', '\1' || chr(2), 'g')"
    return rf"regexp_replace({ended}, '((?:\n|\r)+)', '\1' || chr(2), 'g')"


def sentences(rows: str, keys: str, text: str) -> str:
    """(keys, start_at, end_at, sentence): offsets from the lengths of all pieces before."""
    return rf"""SELECT {keys}, (before + length(piece) - length(regexp_replace(piece, '\A{WS}+', '')))::INT AS start_at,
       (before + length(regexp_replace(piece, '{WS}+\z', '')))::INT AS end_at,
       substr({text}, (before + length(piece) - length(regexp_replace(piece, '\A{WS}+', '')) + 1)::INT,
              length({strip("piece")})::INT) AS sentence
FROM (SELECT {keys}, {text}, piece,
             coalesce(sum(length(piece)) OVER (PARTITION BY {keys} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT {keys}, {text}, unnest(pieces) AS piece, unnest(range(len(pieces))) AS place
            FROM (SELECT {keys}, {text}, string_split({sentence_cuts(text)}, chr(2)) AS pieces FROM {rows})))
WHERE regexp_matches(piece, '[\p{{L}}\p{{N}}]')"""


view(
    "semantic",
    "SELECT query_id, asset_id, snippet_text FROM reranked WHERE match = 'semantic'",
    "reranked",
)
view("result_sentences", sentences("semantic", "query_id, asset_id", "snippet_text"), "semantic")
view(
    "numbered_sentences",
    "SELECT *, row_number() OVER (ORDER BY query_id, asset_id, start_at) AS sentence_id FROM result_sentences",
    "result_sentences",
)
view("sentence_counts", hashed("numbered_sentences", "sentence_id", "sentence"), "numbered_sentences")
view("sentence_vectors", dense("sentence_counts", "sentence_id"), "sentence_counts")
view(
    "closest",
    """SELECT query_id, asset_id, arg_min(start_at, (-similarity, start_at)) AS sentence_start,
       arg_min(end_at, (-similarity, start_at)) AS sentence_end
FROM (SELECT s.query_id, s.asset_id, s.start_at, s.end_at,
             round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity
      FROM numbered_sentences s JOIN sentence_vectors v USING (sentence_id) JOIN query_vectors q USING (query_id))
GROUP BY query_id, asset_id""",
    "numbered_sentences",
    "sentence_vectors",
    "query_vectors",
)
