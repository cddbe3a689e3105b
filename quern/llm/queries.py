"""The queries of this subpackage: each operator with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, fill_middle, hmm_lm, language_id, line_dedup, mixing, quality_rules, quotation, simhash, token_output, url_filter, vector_codes, winnowing
from quern.llm.common import table

VOCABULARY, END_ID = "word_bpe_49k.json", 2


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document read back from the coded token file. Null text: the end id alone; empty table: no rows."""
    return token_output.token_digests(table(spark, sf_dir, "documents"), vocabulary(), END_ID)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by rules, then by the model. Null url: empty host and path, judged by the model."""
    return url_filter.judged_pages(table(spark, sf_dir, "pages"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints, positions and likenesses of every document, its edited text and the next. Null text: empty."""
    return winnowing.edited_documents(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and empty texts have fingerprint zero; null ids name no component."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from other rows. Null text or none of Unicode category L: und, score 0."""
    return language_id.identified_documents(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document. Null text: statistics of 0, scored like any other."""
    return quality_rules.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in reply order without linked quotations. Null conv_id or turn: a conversation of its own."""
    return quotation.conversations(table(spark, sf_dir, "conversations"))


def op8_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log-probabilities of every document. Null text: the end alone."""
    return hmm_lm.scored_documents(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. Null text: size 0; null source: a source of its own, last."""
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document. Null text: no words; null item_id: hits, but isn't listed."""
    return decontaminate.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every whole vector with its errors. Null vectors or components, NaN and infinities: left out; null labels: one label."""
    return vector_codes.coded_vectors(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document rearranged and put back. Null text: empty, which is plain."""
    return fill_middle.middle_documents(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that other documents keep. Null text: one empty line."""
    return line_dedup.line_deduplicated(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py on all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (op1_token_output, op2_url_filter, op3_winnowing, op4_simhash, op5_language_id, op6_quality_rules, op7_quotation, op8_hmm_lm, op9_mixing, op10_decontaminate, op11_vector_codes, op12_fill_in_middle, op13_line_dedup)}
    return {**found, "pipeline": pipeline}


#: Words, windows and occurrences spelled out; windows meet documents by their text.
OP10_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM starts),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT p.doc_id, p.s, p.n, win.item_id FROM places p JOIN win ON win.n = p.n AND win.win = array_to_string(p.w[p.s:p.s + p.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
  coalesce(items.h, sha256('')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: Passages, their units, links, replies and the walk through the tree spelled out; quotations meet own words by their text.
OP7_SQL = r"""
WITH RECURSIVE n AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations)),
l AS (SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM n),
k AS (SELECT *, len(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \t]*(?:>[ \t]?)+', '') AS bare, regexp_full_match(line, '[\x20\x09-\x0D]*') AS blank FROM l),
c AS (SELECT *, coalesce(lag(level) OVER w <> level, false)::int AS new, coalesce(lag(blank) OVER w <> blank, false)::int AS gap FROM k WINDOW w AS (PARTITION BY id ORDER BY pos)),
g AS (SELECT *, sum(new) OVER w AS place, sum(gap) OVER w AS par FROM c WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
p AS MATERIALIZED (SELECT id, conv_id, turn, place, level, string_agg(line, chr(10) ORDER BY pos) AS raw, trim(regexp_replace(lower(string_agg(bare, ' ' ORDER BY pos)), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM g GROUP BY ALL),
spoken AS (SELECT conv_id, turn, norm AS u FROM p WHERE level = 0 UNION ALL SELECT conv_id, turn, trim(regexp_replace(lower(bare), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') FROM g WHERE level = 0
  UNION ALL SELECT conv_id, turn, trim(regexp_replace(lower(string_agg(bare, ' ' ORDER BY pos)), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') FROM g WHERE level = 0 AND NOT blank GROUP BY conv_id, turn, id, place, par),
own AS MATERIALIZED (SELECT DISTINCT conv_id, turn, u FROM (SELECT * FROM spoken UNION ALL SELECT conv_id, turn, trim(unnest(regexp_extract_all(u, '[^.!?]+[.!?]*')), ' ') FROM spoken) WHERE u <> ''),
q AS (SELECT * FROM p WHERE level > 0 AND norm <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
whole AS MATERIALIZED (SELECT q.id, q.place, q.conv_id, q.turn, q.level, length(norm) AS n, max(own.turn) AS source FROM q JOIN own ON own.conv_id = q.conv_id AND own.u = q.norm AND own.turn < q.turn GROUP BY ALL),
part AS (SELECT id, place, conv_id, turn, level, trim(unnest(regexp_extract_all(norm, '[^.!?]+[.!?]*')), ' ') AS u FROM q ANTI JOIN whole USING (id, place)),
piece AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM part WHERE u <> ''),
near AS (SELECT piece.r, max(own.turn) AS source FROM piece JOIN own ON own.conv_id = piece.conv_id AND own.u = piece.u AND own.turn < piece.turn GROUP BY 1),
best AS (SELECT id, place, source, sum(length(u)) AS got FROM piece JOIN near USING (r) GROUP BY id, place, source QUALIFY row_number() OVER (PARTITION BY id, place ORDER BY sum(length(u)) DESC, source DESC) = 1),
linked AS MATERIALIZED (SELECT * FROM whole UNION ALL SELECT id, place, conv_id, turn, level, sum(length(u)) AS n, any_value(source) FROM piece JOIN best USING (id, place) GROUP BY id, place, conv_id, turn, level HAVING any_value(got) * 2 >= n),
quoted AS (SELECT conv_id, turn, source FROM linked GROUP BY conv_id, turn, level, source QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, sum(n) DESC, source DESC) = 1),
t AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, min(turn) OVER (PARTITION BY conv_id) AS thread FROM (SELECT DISTINCT conv_id, turn FROM n WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
a AS MATERIALIZED (SELECT t.*, coalesce(quoted.source, prev) AS parent, quoted.source IS NOT NULL AS quoting FROM t LEFT JOIN quoted USING (conv_id, turn)),
tree AS (SELECT conv_id, turn, thread, quoting, [turn] AS path FROM a WHERE parent IS NULL UNION ALL SELECT a.conv_id, a.turn, a.thread, a.quoting, list_append(tree.path, a.turn) FROM tree JOIN a ON a.conv_id = tree.conv_id AND a.parent = tree.turn),
kept AS (SELECT id, string_agg(raw, chr(10) ORDER BY place) AS text FROM p ANTI JOIN linked USING (id, place) GROUP BY id),
said AS (SELECT n.conv_id, n.turn, role, '<|' || role || '|>' || chr(10) || trim(coalesce(kept.text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM n LEFT JOIN kept USING (id)),
number AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY path, role, said) - 1 AS i FROM said JOIN tree USING (conv_id, turn))
SELECT conv_id, thread, i // 1024 AS block, count(*) AS n_messages, count(*) FILTER (quoting) AS n_quoting, string_agg(said, chr(10) ORDER BY i) AS chat FROM number GROUP BY conv_id, thread, block
UNION ALL SELECT conv_id, turn, CASE WHEN turn IS NOT NULL THEN 0 END, 1, 0, said FROM said WHERE conv_id IS NULL OR turn IS NULL
"""


_NEAREST = "arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT v.id, v.p, c.e, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN {c} c USING (p, i) GROUP BY ALL) GROUP BY id, p"


def _round(old: str, new: str) -> str:
    """A round's assignments and the codebooks after it. Sums are divided downwards."""
    return f"""{new}n AS MATERIALIZED (SELECT id, p, {_NEAREST.format(c=old)}), {new}s AS (SELECT v.p, e, i, sum(x)::bigint AS s, count(*) AS n FROM {new}n JOIN v USING (id, p) GROUP BY ALL),
{new} AS MATERIALIZED (SELECT p, e, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM {old} LEFT JOIN {new}s USING (p, e, i))"""


#: Two rounds of assignment and the last one, a row a component.
OP11_SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT id, g.i // (len(embedding) // 16) AS p, g.i % (len(embedding) // 16) AS i, floor(256 * embedding[g.i + 1]::double)::bigint AS x FROM k, range(len(k.embedding)) g(i)),
c0 AS MATERIALIZED (SELECT p, id AS e, i, x FROM v WHERE id < 64),
{_round("c0", "c1")},
{_round("c1", "c2")},
a AS MATERIALIZED (SELECT id, p, {_NEAREST.format(c="c2")}),
r AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::bigint AS error FROM a GROUP BY id),
h AS (SELECT sha256(string_agg(x::varchar, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256 FROM r JOIN k USING (id), h
"""

#: Units, draws and pieces spelled out; what is restored is the text.
OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || coalesce(doc_id::varchar, '')) AS d FROM documents),
h AS (SELECT *, len(w)::bigint AS n, ('0x' || d[1:8])::bigint % (len(w) + 1) AS a, ('0x' || d[9:16])::bigint % (len(w) + 1) AS b, ('0x' || d[17:24])::bigint % 100 AS h3, ('0x' || d[25:32])::bigint % 100 AS h4 FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form, least(a, b) AS u, greatest(a, b) AS v FROM h),
c AS (SELECT *, array_to_string(w[1:u], '') AS p, array_to_string(w[u + 1:v], '') AS m, array_to_string(w[v + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::bigint END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::bigint END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(CASE WHEN form = 'plain' THEN text ELSE p || m || s END) AS restored_sha256 FROM c
"""

#: Lines, their keys, and the documents that hold them.
OP13_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
o AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.top AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM o GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_quotation": OP7_SQL, "op10_decontaminate": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_line_dedup": OP13_SQL}
