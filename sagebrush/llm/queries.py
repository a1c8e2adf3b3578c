"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, language, licenses, line_dedup, ngram_join, pieces, quality, scoring, sharding, spelling, token_counts, whitening
from .tables import table

N_SHARDS = 40
TOKEN_LIMIT = 512


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM d, (SELECT DISTINCT m FROM bw) AS ms, unnest(range(1, len(w) - m + 2)) AS t(i)),
hit AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, s)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + m)) AS u(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_back(chat.format_trees(chat.linear_trees(turns)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
formed AS (
  SELECT *, 12 + length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '%', '%25'), chr(10), '%0A')) + 1
       + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11 AS chars FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM formed GROUP BY conv_id
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/thousand/id.txt."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    out = licenses.scan(docs.select("doc_id", path.alias("path"), "text"))
    return out.select("doc_id", "license", F.round("cosine", 6).alias("cosine"), "how", "license_dir", "n_header_lines")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PASSAGE_ROWS = ", ".join(f"({_quoted(f'{name} {k}')}, {_quoted(name)}, {_quoted(text)})" for name, texts in licenses.PASSAGES.items() for k, text in enumerate(texts))
_N_PASSAGES = sum(map(len, licenses.PASSAGES.values()))
_TERMS = "list_filter(list_transform(regexp_split_to_array(lower({}), '[^a-z0-9.+-]+'), lambda w: regexp_replace(w, '^[.+-]+|[.-]+$', '', 'g')), lambda w: w <> '')"
_CUES = _quoted(licenses.CUES)


def _holds_sql(text: str, has: tuple[str, ...], lacks: str | None) -> str:
    held = [f"regexp_matches({text}, {_quoted(p)})" for p in has] + ([f"NOT regexp_matches({text}, {_quoted(lacks)})"] if lacks else [])
    return " AND ".join(held)


_TOLD_APART = "CASE license " + " ".join(f"WHEN {_quoted(k)} THEN {_holds_sql('unit', *rule)}" for k, rule in licenses.IN_UNIT.items()) + " ELSE true END"
_NOT_BARRED = "CASE license " + " ".join(f"WHEN {_quoted(k)} THEN {_holds_sql('lower(notice)', *rule)}" for k, rule in licenses.IN_NOTICE.items()) + " ELSE true END"
_SENTENCES = r"string_split(regexp_replace({}, '([.;:!?])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10))"
OP3_SQL = f"""
WITH passages AS (SELECT passage, license, {_TERMS.format("t")} AS w FROM (VALUES {_PASSAGE_ROWS}) AS v(passage, license, t)),
split AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'unknown') || '/' || CAST(floor(doc_id / 1000) AS BIGINT) AS dir,
  string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
flagged AS (SELECT *, list_transform(lines, lambda x: regexp_matches(x, {_CUES})) AS flags FROM split),
files AS (SELECT doc_id, text, dir, list_filter(lines, lambda x: regexp_matches(x, {_CUES})) AS cues, array_to_string(list_filter(lines,
  lambda x, i: coalesce(list_bool_or(flags[greatest(i - {licenses.AFTER}, 1):i + {licenses.BEFORE}]), false)), chr(10)) AS notice FROM flagged),
h AS (SELECT notice, count(*) AS n, {_TERMS.format("notice")} AS w, regexp_replace(notice, '{licenses.OPENS}', ' ', 'g') AS plain FROM files WHERE len(cues) > 0 GROUP BY notice),
pieces AS (
  SELECT notice, array_to_string(w[i:i + {licenses.SPAN - 1}], ' ') AS unit FROM (SELECT notice, {_TERMS.format("plain")} AS w FROM h), unnest(range(1, greatest(1, len(w) - {licenses.STEP}) + 1, {licenses.STEP})) AS u(i)
  UNION SELECT notice, array_to_string({_TERMS.format("x")}, ' ') FROM (SELECT notice, unnest({_SENTENCES.format("plain")}) AS x FROM h)),
stated AS (SELECT notice, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(notice, {_quoted(licenses.EXPRESSION)}, 1),
  lambda e: regexp_replace(regexp_replace(e, '-only|-or-later|[+]', '', 'g'), '[.-]+$|^[(]([^()]*)[)]$', '\\1', 'g')), lambda e: e NOT IN ('', 'NONE', 'NOASSERTION')))) AS e FROM h),
tagged AS (SELECT notice, array_to_string(list_transform(e, lambda x: CASE WHEN len(e) > 1 AND contains(x, ' OR ') THEN '(' || x || ')' ELSE x END), ' AND ') AS license FROM stated WHERE len(e) > 0),
units AS (SELECT * FROM pieces WHERE regexp_matches(unit, {_CUES})),
seen AS (SELECT unit, term, 1 + ln(count(*)) AS tf FROM (SELECT unit, unnest(string_split(unit, ' ')) AS term FROM (SELECT DISTINCT unit FROM units)) GROUP BY ALL),
known AS (SELECT passage, term, 1 + ln(count(*)) AS tf FROM (SELECT passage, unnest(w) AS term FROM passages) GROUP BY ALL),
df AS (SELECT term, sum(n) AS df FROM (SELECT n, unnest(list_distinct(w)) AS term FROM h UNION ALL SELECT 1, term FROM known) GROUP BY term),
total AS (SELECT coalesce(sum(n), 0) + {_N_PASSAGES} AS total FROM h),
idf AS (SELECT term, ln((1.0 + total) / (1.0 + df)) + 1 AS idf FROM df, total),
l AS (SELECT unit, term, tf * idf AS w FROM seen JOIN idf USING (term)),
r AS (SELECT passage, term, tf * idf AS w FROM known JOIN idf USING (term)),
ln_ AS (SELECT unit, sqrt(sum(w * w)) AS n FROM l GROUP BY unit),
rn_ AS (SELECT passage, sqrt(sum(w * w)) AS n FROM r GROUP BY passage),
s AS (SELECT unit, passage, round(sum(l.w * r.w) / any_value(ln_.n) / any_value(rn_.n), 9) AS cosine
  FROM l JOIN r USING (term) JOIN ln_ USING (unit) JOIN rn_ USING (passage) GROUP BY unit, passage),
best AS (SELECT notice, license, cosine FROM (SELECT notice, license, cosine, row_number() OVER (PARTITION BY notice ORDER BY cosine DESC, license DESC) AS k
  FROM units JOIN s USING (unit) JOIN passages USING (passage) WHERE {_TOLD_APART} AND {_NOT_BARRED} AND notice NOT IN (SELECT notice FROM tagged))
  WHERE k = 1 AND cosine >= {licenses.THRESHOLD} UNION ALL SELECT notice, license, 1.0 FROM tagged),
own AS (SELECT f.*, license, cosine, len(cues) > 0 AND 2 * length(regexp_replace(array_to_string(list_filter({_SENTENCES.format("array_to_string(cues, chr(10))")}, lambda x: regexp_matches(x, {_CUES})), ''), '[ \t\r\n]', '', 'g'))
  >= length(regexp_replace(f.text, '[ \t\r\n]', '', 'g')) AS is_file FROM files f LEFT JOIN best b ON b.notice = f.notice AND len(cues) > 0),
holders AS (SELECT dir, license, cosine FROM (SELECT dir, license, cosine, row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license DESC) AS k FROM own WHERE is_file AND license IS NOT NULL) WHERE k = 1),
above AS (SELECT dir, dir AS at, 2 AS depth FROM own UNION SELECT dir, string_split(dir, '/')[1], 1 FROM own UNION SELECT dir, '', 0 FROM own),
nearest AS (SELECT a.dir, a.at, hd.license, hd.cosine FROM (SELECT a.*, row_number() OVER (PARTITION BY a.dir ORDER BY depth DESC) AS k FROM above a JOIN holders hd ON hd.dir = a.at) a JOIN holders hd ON hd.dir = a.at WHERE k = 1)
SELECT doc_id, coalesce(o.license, n.license) AS license, round(coalesce(o.cosine, n.cosine), 6) AS cosine,
  CASE WHEN o.license IS NOT NULL THEN 'header' WHEN n.license IS NOT NULL THEN 'inherited' END AS how,
  CASE WHEN o.license IS NULL THEN n.at END AS license_dir, CAST(len(cues) AS BIGINT) AS n_header_lines
FROM own o LEFT JOIN nearest n USING (dir)
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    clean = F.coalesce("clean_text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length(clean).cast("long").alias("clean_chars"), F.sha2(clean, 256).alias("clean_sha256"))


OP4_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
l AS (SELECT doc_id, i, p[i] AS line, list_filter(regexp_split_to_array(p[i], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM parts, unnest(range(1, len(p) + 1)) AS t(i)),
c AS (SELECT doc_id, i, array_to_string(w, ' ') AS s, len(w) AS n, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l),
solid AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM c WHERE n > 0),
win AS (SELECT a.doc_id, a.i AS i, b.i AS j FROM solid a JOIN solid b ON a.doc_id = b.doc_id AND b.i >= a.i
  AND b.upto - a.upto + a.n >= 50 AND (b.upto - b.n - a.upto + a.n < 50 OR b.upto - a.upto < 50 OR (b.r = a.r + 1 AND a.n >= 50))),
content AS (SELECT w.doc_id, w.i, w.j, string_agg(c.s, chr(10) ORDER BY c.i) AS s
  FROM win w JOIN c ON c.doc_id = w.doc_id AND c.i BETWEEN w.i AND w.j AND c.n > 0 GROUP BY ALL),
later AS (SELECT doc_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM content) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, u.x AS i FROM later, unnest(range(i, j + 1)) AS u(x)),
made AS (SELECT doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS clean
  FROM l LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(coalesce(clean, '')) AS clean_chars, sha256(coalesce(clean, '')) AS clean_sha256
FROM documents LEFT JOIN made USING (doc_id)
"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out())
    model = language.train(docs.filter("NOT held_out").select("text", "lang"))
    out = language.identify(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_chars")


_WORD = r"[\x20\x09-\x0D]+"
_SYMBOL = f"[{quality.SYMBOLS}]"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WORD}'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) AS u(i) WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM win) WHERE k > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM twice, unnest(range(i, i + 8)) AS v(j) GROUP BY doc_id),
line AS (SELECT doc_id, x, len(list_filter(regexp_split_to_array(x, '{_WORD}'), lambda w: w <> '')) AS n,
  len(regexp_extract_all(x, '{_SYMBOL}')) AS symbols, len(regexp_extract_all(x, '[|>]')) AS bars
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
judged AS (SELECT doc_id, x, (symbols > 0 AND (4 * symbols >= n OR 4 * bars >= n))
  OR (NOT regexp_matches(x, {_quoted(quality.END)}) AND (n < {quality.LONG_LINE} OR NOT regexp_matches(x, '[{quality.MARKS}]')))
  OR 3 * (length(x) - length(regexp_replace(x, {_quoted(quality.PHRASE)}, '', 'g'))) >= length(x) AS failed FROM line),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines, count(*) FILTER (failed) AS n_failed_lines,
  sum(length(x)) AS chars, coalesce(sum(length(x)) FILTER (failed), 0) AS lost FROM judged GROUP BY doc_id),
base AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '{_SYMBOL}')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_failed_lines, 0) AS n_failed_lines, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars, coalesce(chars, 0) AS chars
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
said AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 2 * lost_chars <= chars AS kept,
  n_lines, n_failed_lines, lost_chars FROM said
"""


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


_SOLID = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SOLID} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = doc_id GROUP BY doc_id
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(rows).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learns = scoring.learns()
    return scoring.score(docs, learns).select("doc_id", (~learns).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), drop_every=spelling.DROP_EVERY)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_license_scan": op3_license_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_sharding": op9_sharding,
    "op10_ngram_join": op10_ngram_join,
    "op11_whitening": op11_whitening,
    "op12_scoring": op12_scoring,
    "op13_spelling": op13_spelling,
}
SQL = {"op1_decontamination": OP1_SQL, "op2_chat_formatting": OP2_SQL, "op3_license_scan": OP3_SQL, "op4_line_dedup": OP4_SQL, "op7_quality_rules": OP7_SQL, "op10_ngram_join": OP10_SQL}
