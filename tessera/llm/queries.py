"""The registered queries of the corpus operators, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, filter_audit, kneser_ney, language_id, media_jpeg, mixing, near_dedup, secret_scan, substring_dedup, token_binary, token_counts, warc_zip
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def remainder(k: int):
    """Whether a document's crc32(doc_id as text) mod 5 is ``k``; rows without id are in no such fold."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == k, F.lit(False))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; one that the scan reads in fewer partitions than there are cores is dealt out to all of them."""
    return table(spark, sf_dir, name, least_parts=spark.sparkContext.defaultParallelism)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; null, empty and very long texts, null and repeated ids are a row each."""
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids in the files; a null text has the end id alone, null ids first."""
    return token_binary.token_files(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text written as JPEG media and what the stored files give; a null text is stored as an empty one."""
    return media_jpeg.decode_media(media_jpeg.store_media(read(spark, sf_dir, "documents"))).drop("error")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document over links of 0.75; texts without words stand alone."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document; null and empty texts have none, items without id are not listed."""
    found = decontaminate.judged(decontaminate.contamination(read(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    names = F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, counted from the output shards; null sources are one source, the last."""
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines, paragraphs and passages of over 50 words that every document loses; null texts lose nothing."""
    return substring_dedup.deduplicated(read(spark, sf_dir, "documents"), passage=51)


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages as read back from archives; a null page is an empty payload."""
    return warc_zip.archive_pages(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them; texts without letters are ``und``."""
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~remainder(0)))
    return language_id.predict(docs, model).select("doc_id", remainder(0).alias("held_out"), "lang_pred", "score")


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of four fifths of them; null and empty texts are the end token alone."""
    docs = read(spark, sf_dir, "documents")
    scored = kneser_ney.score(docs, kneser_ney.fit(docs.where(~remainder(1))))
    names = "n_tokens", "n_known", "train_tokens"
    return scored.select("doc_id", remainder(1).alias("held_out"), *names, F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document as spans; null and empty texts have none."""
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select("doc_id", *[count(k) for k in secret_scan.BASE], F.sha2(named(base), 256).alias("base_sha256"), named("spans").alias("spans"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation; a null conv_id is a conversation of its own."""
    conversations = read(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(conversations), conversations.select("conv_id").distinct())


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every language in each of their orders; null languages are the part ''."""
    return filter_audit.audit(read(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_token_files, op3_jpeg_media, op4_near_duplicates, op5_decontamination, op6_source_mix, op7_substring_dedup, op8_warc_archives, op9_language_id, op10_kneser_ney, op11_secret_scan, op12_conversation_repair, op13_filter_audit)}

_WARC = """
WITH p AS (
  SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY sha1(payload)) AS first FROM p
), b AS (
  SELECT *, list_transform(range(0, 40, 5), lambda i: ('0x' || substr(hex, (i + 1)::INT, 5))::BIGINT) AS parts FROM d
)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(parts, lambda v: list_reduce(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1)), lambda a, c: a || c)), lambda a, c: a || c) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_NEAR = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * i >= 75 * (na.n + nb.n - i)
), reach AS (
  SELECT doc_id, doc_id AS r FROM w
  UNION
  SELECT doc_id, b AS r FROM reach JOIN links ON r = a
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

_DECONTAMINATION = f"""
WITH i AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), dw AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw USING (n, g)
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: crc32 of doc_id as text, bit by bit; DuckDB has no such function.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: CASE WHEN d % 2 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295)"
)

_KNESER_NEY = """
WITH w AS (
  SELECT doc_id, pmod5, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), '') AS w
  FROM (SELECT *, CRC_VALUE % 5 AS pmod5 FROM documents)
), t AS (
  SELECT doc_id, pmod5 <> 1 AS train, unnest(w) AS w, unnest(list_prepend(NULL, w[:len(w) - 1])) AS h, unnest(range(len(w))) AS p FROM w
), u AS (
  SELECT w, count(*) AS c FROM t WHERE train GROUP BY w
), tot AS (
  SELECT sum(c) AS n, count(*) AS v FROM u
), b AS (
  SELECT h, w, count(*) AS c FROM t WHERE train GROUP BY h, w
), r AS (
  SELECT w, count(*) AS a FROM b GROUP BY w
), nb AS (
  SELECT count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c = 4) AS n4 FROM b
), nr AS (
  SELECT count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 2) AS n2, count(*) FILTER (a = 3) AS n3, count(*) FILTER (a = 4) AS n4, count(*) FILTER (a > 2) AS more, sum(a)::DOUBLE AS al FROM r
), y AS (
  SELECT 'b' AS k, n1 / (n1 + 2 * n2) AS y, n1, n2, n3, n4 FROM nb UNION ALL SELECT 'r', n1 / (n1 + 2 * n2), n1, n2, n3, n4 FROM nr
), d AS (
  SELECT k,
    least(greatest(CASE WHEN n1 > 0 AND n2 > 0 THEN 1 - 2 * y * n2 / n1 ELSE 0.5 END, 0.05), 1)::DOUBLE AS d1,
    least(greatest(CASE WHEN n2 > 0 AND n3 > 0 THEN 2 - 3 * y * n3 / n2 ELSE 1.0 END, 0.05), 2)::DOUBLE AS d2,
    least(greatest(CASE WHEN n3 > 0 AND n4 > 0 THEN 3 - 4 * y * n4 / n3 ELSE 1.5 END, 0.05), 3)::DOUBLE AS d3 FROM y
), db AS (SELECT * FROM d WHERE k = 'b'), dr AS (SELECT * FROM d WHERE k = 'r'
), eps AS (
  SELECT (d1 * n1 + d2 * n2 + d3 * more) / al / (v + 1) AS e FROM nr, dr, tot
), pc AS (
  SELECT w, (a - CASE a WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) / al + e AS pc FROM r, dr, nr, eps
), g AS (
  SELECT h, sum(c) AS c, sum(CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) / sum(c) AS g FROM b, db GROUP BY h
), s AS (
  SELECT t.doc_id, t.train, u.c AS uc, n, v,
    coalesce((b.c - CASE b.c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) / g.c, 0) + coalesce(g.g, 1) * coalesce(pc.pc, e) AS p
  FROM t CROSS JOIN tot CROSS JOIN db CROSS JOIN eps
  LEFT JOIN u ON u.w = t.w LEFT JOIN pc ON pc.w = t.w LEFT JOIN g ON g.h IS NOT DISTINCT FROM t.h
  LEFT JOIN b ON b.w = t.w AND b.h IS NOT DISTINCT FROM t.h
)
SELECT doc_id, NOT any_value(train) AS held_out, count(*) AS n_tokens, count(uc) AS n_known, any_value(n)::BIGINT AS train_tokens,
  round(sum(log10((coalesce(uc, 0) + 0.5) / (n + 0.5 * (v + 1)))), 6) AS base_score, round(sum(log10(p)), 6) AS score
FROM s GROUP BY doc_id
""".replace("CRC_VALUE", _CRC)

#: Spans of a pattern: the text is marked around each match and cut behind it, so positions are sums of the pieces' lengths.
_SPANS_OF = """
  SELECT doc_id, row_id, 'KIND' AS kind, ORDINAL AS k, start, start + length(run) AS stop, run FROM (
    SELECT doc_id, row_id, substr(piece, strpos(piece, chr(57344)) + 1) AS run,
      (sum(length(piece) - 1) OVER (PARTITION BY row_id ORDER BY n) - (length(piece) - strpos(piece, chr(57344))))::BIGINT AS start
    FROM (SELECT doc_id, row_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS n FROM (
      SELECT doc_id, row_id, string_split(regexp_replace(t, '(PATTERN)', chr(57344) || '\\1' || chr(57345), 'g'), chr(57345)) AS pieces FROM t))
    WHERE strpos(piece, chr(57344)) > 0)
"""
_QUOTE = "[\"'']?"
_NAMES = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) + q for w, q in (("password", ""), ("passwd", ""), ("secret", ""), ("token", ""))) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_GIVEN = f"{_NAMES}{_QUOTE}\\x20*[:=]\\x20*{_QUOTE}"


def _spans_of(kind: str, ordinal: int, pattern: str) -> str:
    return _SPANS_OF.replace("KIND", kind).replace("ORDINAL", str(ordinal)).replace("PATTERN", pattern)


_SECRETS = f"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS t FROM documents
), base AS (
  SELECT * FROM ({_spans_of("assign", 1, _GIVEN + "[A-Za-z0-9+/_.=-]+")}) WHERE length(regexp_replace(run, '^{_GIVEN}', '')) >= 12
  UNION ALL SELECT * FROM ({_spans_of("access", 2, "AKIA[A-Z0-9]+")}) WHERE length(run) >= 18
  UNION ALL SELECT * FROM ({_spans_of("hex", 3, "[0-9a-f]+")}) WHERE length(run) >= 16
), runs AS (
  SELECT *, 24 AS size, 3.0 AS bits, 2 AS kinds FROM ({_spans_of("hexrun", 4, "[0-9a-fA-F]+")})
  UNION ALL SELECT *, 24, 4.0, 3 FROM ({_spans_of("random", 5, "[A-Za-z0-9+/_-]+")})
), wanted AS (
  SELECT * FROM runs WHERE length(run) >= size AND NOT regexp_matches(run, '(?i)example|placeholder|changeme|dummy|sample|xxxx|abcdefghij|0123456789')
    AND NOT regexp_matches(run, '^[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}$')
    AND NOT regexp_matches(run, '^(?:[A-Z]?[a-z]*[0-9]{{0,4}}[/_+-])*[A-Z]?[a-z]*[0-9]{{0,4}}$')
), windows AS (
  SELECT doc_id, row_id, kind, k, size, bits, kinds, start + i AS a, substr(run, i + 1, size) AS w FROM (SELECT *, unnest(range(length(run) - size + 1)) AS i FROM wanted)
), found AS (
  SELECT doc_id, row_id, kind, k, a, a + size AS b FROM windows
  WHERE regexp_matches(w, '[a-z]')::INT + regexp_matches(w, '[A-Z]')::INT + regexp_matches(w, '[0-9]')::INT >= kinds
    AND list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: round((size - length(replace(w, c, ''))) * log2(size - length(replace(w, c, ''))) * 1048576)::BIGINT))
      <= round(size * log2(size) * 1048576)::BIGINT - round(bits * size * 1048576)::BIGINT
), islands AS (
  SELECT *, sum(CASE WHEN a <= reached THEN 0 ELSE 1 END) OVER (PARTITION BY row_id, k ORDER BY a) AS island
  FROM (SELECT *, max(b) OVER (PARTITION BY row_id, k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM found)
), s AS (
  SELECT row_id, kind, k, start, stop FROM base UNION ALL SELECT row_id, any_value(kind), k, min(a), max(b) FROM islands GROUP BY row_id, k, island
), named AS (
  SELECT row_id, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 4) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans
  FROM s GROUP BY row_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN named USING (row_id)
"""

_AUDIT = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), m AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)::INT AS m FROM d
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m LEFT JOIN l USING (doc_id) GROUP BY part, m
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS filter, 1 << (ascii(filter) - 65) AS bit, list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65))) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, filter, sum(n) FILTER (m & bit = 0 AND m & b = 0) AS kept, sum(n) FILTER (m & bit > 0 AND m & b = 0) AS removed, sum(n) FILTER (m & bit > 0 AND m & b > 0) AS redundant,
    sum(n) FILTER (m = bit) AS unique_fails, sum(g) FILTER (m & bit > 0 AND m & b = 0) AS good_lost, sum(x) FILTER (m & bit > 0 AND m & b = 0) AS toxic_lost
  FROM c, (SELECT *, coalesce(before, 0)::INT AS b FROM s) GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley
FROM r
"""

_BEST = "list_sort(list_filter([{}], lambda x: x IS NOT NULL))[1]"


def _edit(cost: str, letter: str, line: str, then: str) -> str:
    return f"{{'c': {cost} + {then}.c, 'a': '{letter}' || {then}.a, 't': {line} || {then}.t}}"


def _row_edits(state: str, keeps: dict[str, str], role: str, to: str) -> str:
    """The best of the edits that use a turn up in one state of the grammar."""
    line = "chr(10) || role || ':' || text"
    kept = ", ".join(f"CASE WHEN NOT must AND initial = '{i}' THEN {_edit('cut', 'K', line, s)} END" for i, s in keeps.items())
    given = f"CASE WHEN NOT must THEN {_edit('3 + cut', 'R', f"chr(10) || '{role}:' || text", to)} END"
    return _BEST.format(f"{_edit('4', 'D', "''", state)}, {kept}, {given}")


_REPAIR = f"""
WITH RECURSIVE x AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CRC_VALUE % 20 AS fault FROM conversations
), y AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM x
), z AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank FROM y
), o AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS seen, lag(initial) OVER (PARTITION BY conv_id ORDER BY p) || initial AS two FROM z
), f AS (
  SELECT *, NOT blank AND NOT seen AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS truncated, blank OR seen AS must, CASE WHEN truncated THEN 3 ELSE 0 END AS cut FROM o
), r AS (
  SELECT conv_id, max(p) AS p, {{'c': 0, 'a': '', 't': ''}} AS s0, {{'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s1,
    {{'c': 3, 'a': 'I', 't': chr(10) || 'assistant:'}} AS s2, {{'c': 0, 'a': '', 't': ''}} AS s3 FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, p, {_BEST.format("g0, " + _edit("3", "I", "chr(10) || 'user:'", "c2"))}, {_BEST.format("g1, " + _edit("3", "I", "chr(10) || 'user:'", "c2"))}, c2, c3 FROM (
    SELECT *, {_BEST.format("g2, " + _edit("3", "I", "chr(10) || 'assistant:'", "g3"))} AS c2, {_BEST.format("g3, " + _edit("3", "I", "chr(10) || 'user:'", "g2"))} AS c3 FROM (
      SELECT f.conv_id, f.p - 1 AS p, {_row_edits("s0", {"s": "s1", "u": "s2"}, "user", "s2")} AS g0, {_row_edits("s1", {"u": "s2"}, "user", "s2")} AS g1,
        {_row_edits("s2", {"a": "s3"}, "assistant", "s3")} AS g2, {_row_edits("s3", {"u": "s2"}, "user", "s2")} AS g3
      FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.p = r.p
    )
  )
), n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit, sha256(substr(coalesce(s0.t, ''), 2)) AS repaired_sha256
FROM ids LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM ids.conv_id AND r.p = 0
""".replace("CRC_VALUE", _CRC.replace("doc_id::VARCHAR", "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))

ORACLES = {"op10_kneser_ney": _KNESER_NEY, "op4_near_duplicates": _NEAR, "op5_decontamination": _DECONTAMINATION, "op8_warc_archives": _WARC, "op11_secret_scan": _SECRETS, "op12_conversation_repair": _REPAIR, "op13_filter_audit": _AUDIT}
