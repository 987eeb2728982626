"""The opN queries: each applies its operator, with production parameters, to
its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import over_batches, pick, record, table


def op1_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train(docs))


def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judge(table(spark, sf_dir, "documents")).drop("longest_repeat", "n_repeats")


def op3_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op4_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from . import tokencount

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))


def op5_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_chat_schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    rows = rows.select(*[F.col(c).cast(t) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]).unionByName(more)
    digests = chat.digests(chat.format_turns(chat.canonical_turns(_in_layouts(rows))))
    return digests.withColumn("conv_id", F.col("conv_id").cast("long"))


def _in_layouts(turns: DataFrame) -> DataFrame:
    """One JSON record for each turn, written in one of six layouts by a hash of it."""
    role, text = F.col("role"), F.col("text")
    called = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    says = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    part = F.struct(F.lit("text").alias("type"), text.alias("text"))
    layouts = [
        (says(role=role, text=text),), (says(messages=F.array(says(role=role, content=text))),), (says(messages=F.array(says(role=role, content=F.array(part)))),),
        (says(conversations=F.array(says(**{"from": called, "value": text}))),), (says(turns=F.array(says(speaker=role, utterance=text))),), (says(role=role, text=text, meta=F.lit("x")),),
    ]
    write = lambda body: F.to_json(F.struct("conv_id", "turn", body.alias("b")), {"ignoreNullFields": "false"})
    kind = F.when(role.isin("user", "assistant", "system"), F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(len(layouts)))).otherwise(0)
    record = F.lit(None).cast("string")
    for k, (body,) in enumerate(layouts):
        # the fields of the body stand beside the id and the turn
        record = F.when(kind == k, F.regexp_replace(write(body), r'(?s)^(.*?),"b":\{(.*)\}\}$', r"$1,$2}")).otherwise(record)
    return turns.select(record.alias("record"))


def op7_language_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op8_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    found = decontam.decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("longest_match", "longest_item", "longest_at")


def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from . import packing

    return packing.pack(spark, table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


def op10_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op11_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lexical

    return lexical.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import periodic

    return periodic.report(_with_planted_runs(table(spark, sf_dir, "documents")))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents; those whose crc32 of the id ends in 0 repeat a few of their words
    from some word on."""
    import pyarrow as pa

    schema = [("doc_id", pa.int64()), ("text", pa.string())]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        for k, doc_id in enumerate(batch.column(0).to_pylist()):
            h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
            words = (texts[k] or "").encode().split() if h % 10 == 0 else []
            if words:
                n, g = len(words), h // 10
                a = g % n
                period = words[a : a + 1 + (n - a) // (3 + g % 8)]
                texts[k] = b" ".join(words[:a] + (period * (n // len(period) + 1))[: n - a]).decode()
        return record(schema, batch.column(0), texts)

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return over_batches(rows, run, "doc_id long, text string")


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 finds by its fixed patterns alone, which SQL can say too."""
    from . import pii

    return pii.detect(table(spark, sf_dir, "documents"), pii.Weights()).drop("spans", "n_added")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if (name.startswith("op") or name == "pii_base_spans") and callable(fn)}


_WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f"""

_CHAT_ESCAPE = "replace({0}, chr(92), chr(92) || chr(92))"
for _control in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
    _CHAT_ESCAPE = f"replace({_CHAT_ESCAPE}, '{_control}', '{_control[0]}' || chr(92) || '{_control[1:]}')"

_CHAT_SQL = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length({_CHAT_ESCAPE.format('role')}) + length({_CHAT_ESCAPE.format('text')}) + 24) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


_WORD = r"'[^\x20\x09-\x0D]+'"


def _spans_sql(kind: str, pattern: str, test: str) -> str:
    """(doc_id, kind, start, end) of the matches m of a pattern that pass a test."""
    return f"""SELECT doc_id, '{kind}' AS kind, start, start + length(m) AS stop FROM (
      SELECT doc_id, m, CAST(sum(length(piece) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(m) AS BIGINT) AS start FROM (
        SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(list_slice(string_split_regex(t, '{pattern}'), 1, -2)) AS piece,
               unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS k FROM d)) WHERE {test}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum([CASE WHEN i % 2 = 0 THEN CAST(reverse({_DIGITS})[i + 1] AS INT) WHEN CAST(reverse({_DIGITS})[i + 1] AS INT) > 4
    THEN 2 * CAST(reverse({_DIGITS})[i + 1] AS INT) - 9 ELSE 2 * CAST(reverse({_DIGITS})[i + 1] AS INT) END FOR i IN range(length({_DIGITS}))]) % 10 = 0"""
_PII_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_spans_sql('email', r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', 'true')}
  UNION ALL {_spans_sql('ip', r'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', "list_max([CAST(x AS DOUBLE) FOR x IN string_split(m, '.')]) <= 255")}
  UNION ALL {_spans_sql('card', r'[0-9]([\x20-]?[0-9])+', f'length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}')}
  UNION ALL {_spans_sql('phone', r'\+[0-9][\x20().0-9-]+[0-9]', f'length({_DIGITS}) BETWEEN 9 AND 15')}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY list_position(['email', 'ip', 'card', 'phone'], kind), start) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM documents LEFT JOIN g USING (doc_id)"""


def _window_sql(name: str, size: int, rows: str, value: str) -> str:
    """A table of the windows of `size` words from each word of `rows` on."""
    said = " || ' ' || ".join([value] + [f"lead({value}, {k}) OVER w" for k in range(1, size)])
    return f"{name} AS (SELECT rid, pos, {said} AS v FROM {rows} WINDOW w AS (PARTITION BY rid ORDER BY pos))"


def _twice_sql(name: str, of: str, size: int) -> str:
    """Words inside windows that occur twice or more in their text."""
    return f"""{name} AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(pos, pos + {size})) AS p FROM {of}
    WHERE v IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, v) > 1) GROUP BY rid)"""


# 51 words are windows of 16 at 0, 16, 32 and of 3 at 48
_QUALITY_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT *, regexp_extract_all(t, {_WORD}) AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines FROM d),
w AS (SELECT rid, unnest(words) AS said, unnest(range(len(words))) AS pos FROM c),
{_window_sql('w3', 3, 'w', 'said')}, {_window_sql('w8', 8, 'w', 'said')}, {_twice_sql('r3', 'w3', 3)}, {_twice_sql('r8', 'w8', 8)},
h AS (SELECT rid, pos, md5(v) AS said FROM w8 WHERE v IS NOT NULL), t AS (SELECT rid, pos, md5(v) AS said FROM w3 WHERE v IS NOT NULL),
long AS (SELECT DISTINCT rid FROM (SELECT a.rid, a.said || b.said || c.said || e.said || f.said || g.said || t.said AS v FROM h a
  JOIN h b ON b.rid = a.rid AND b.pos = a.pos + 8 JOIN h c ON c.rid = a.rid AND c.pos = a.pos + 16 JOIN h e ON e.rid = a.rid AND e.pos = a.pos + 24
  JOIN h f ON f.rid = a.rid AND f.pos = a.pos + 32 JOIN h g ON g.rid = a.rid AND g.pos = a.pos + 40 JOIN t ON t.rid = a.rid AND t.pos = a.pos + 48
  WHERE a.rid IN (SELECT rid FROM r8)) QUALIFY count(*) OVER (PARTITION BY rid, v) > 1),
n AS (SELECT doc_id, rid, len(words) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN words]), 0) AS BIGINT) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(r3.n, 0) AS n_repeat_words, coalesce(r8.n, 0) AS covered_words FROM c LEFT JOIN r3 USING (rid) LEFT JOIN r8 USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, covered_words,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered_words <= CAST(0.12 AS DOUBLE) * n_words AND rid NOT IN (SELECT rid FROM long) AS kept
FROM n"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_DECONTAM_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS words FROM benchmark),
w AS (SELECT rid, unnest(words) AS said, unnest(range(len(words))) AS pos FROM d),
i AS (SELECT row_number() OVER () AS rid, item_id, words FROM b WHERE len(words) >= 13),
iw AS (SELECT rid, unnest(words) AS said, unnest(range(len(words))) AS pos FROM i),
{_window_sql('dv', 13, 'w', 'said')}, {_window_sql('bv', 13, 'iw', 'said')},
hits AS (SELECT DISTINCT dv.rid, dv.pos, 13 AS size, i.item_id FROM dv JOIN bv ON bv.v = dv.v JOIN i ON i.rid = bv.rid
  UNION ALL SELECT DISTINCT w.rid, w.pos, len(b.words) AS size, b.item_id FROM w JOIN b ON len(b.words) BETWEEN 1 AND 12 AND w.said = b.words[1]
    JOIN d ON d.rid = w.rid WHERE d.words[w.pos + 1 : w.pos + len(b.words)] = b.words),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + size)) AS p FROM hits) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)"""

_NEARDUP_SQL = f"""WITH RECURSIVE c AS (SELECT doc_id AS rid, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORD}) AS words FROM documents),
w AS (SELECT rid, unnest(words) AS said, unnest(range(len(words))) AS pos FROM c WHERE len(words) >= 5),
{_window_sql('w5', 5, 'w', 'said')},
s AS (SELECT DISTINCT rid, v FROM w5 WHERE v IS NOT NULL UNION ALL SELECT rid, len(words) || ':' || array_to_string(words, ' ') FROM c WHERE len(words) BETWEEN 1 AND 4),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
l AS (SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS both_have FROM s x JOIN s y ON x.v = y.v AND x.rid < y.rid GROUP BY ALL) p
  JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * both_have >= 75 * (na.n + nb.n - both_have)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT c.rid AS doc_id, coalesce(n.n, 0) AS n_shingles, least(c.rid, coalesce(m.b, c.rid)) AS component_id, c.rid <= coalesce(m.b, c.rid) AS kept
FROM c LEFT JOIN n ON n.rid = c.rid LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = c.rid"""


_SEARCH_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS words FROM documents),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(words) AS term FROM d) GROUP BY ALL),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d WHERE len(words) > 0),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS words FROM benchmark),
q AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(words) AS term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM t, g WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
m AS (SELECT rid, doc_id, 75 + (25 * len(words) * n_docs) // n_terms AS m FROM d, g WHERE len(words) > 0),
s AS (SELECT item, rid, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT item, rid, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s JOIN m USING (rid) WHERE score > 0 QUALIFY rank <= 20)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r JOIN i USING (item) JOIN m USING (rid)"""


# crc32 of a decimal number: each byte joins the state, then eight shifts (-1)
_CRC = """xor(list_reduce([CASE WHEN k % 9 = 0 THEN CAST(ord(substr(CAST(doc_id AS VARCHAR), k // 9 + 1, 1)) AS BIGINT) ELSE -1 END FOR k IN range(9 * length(CAST(doc_id AS VARCHAR)))],
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, CAST(4294967295 AS BIGINT)), 4294967295)"""
# a run has 16 places or more whose word returns one period later, so eight in a row; these in a row give its ends
_RUNS_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS words, coalesce({_CRC}, 1) AS h FROM documents),
a AS (SELECT *, len(words) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM d),
m AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN words ELSE list_concat(words[1:a], [words[a + 1 + i % (1 + (n - a) // (3 + g % 8))] FOR i IN range(n - a)]) END AS ws FROM a),
w AS (SELECT rid, unnest(ws) AS said, unnest(range(n)) AS pos, n FROM m),
{_window_sql('w8', 8, 'w', 'said')},
s AS (SELECT rid, pos, md5(v) AS v FROM w8 WHERE v IS NOT NULL),
again AS (SELECT x.rid, x.pos, y.pos - x.pos AS p FROM s x JOIN s y ON x.rid = y.rid AND x.v = y.v AND x.pos < y.pos),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY rid, p ORDER BY pos) AS island FROM again),
f AS (SELECT rid, p, min(pos) AS start, count(*) + 7 + p AS length FROM i GROUP BY rid, p, island HAVING count(*) + 7 + p >= greatest(24, 3 * p)),
r AS (SELECT rid, start, length, min(p) AS p FROM f GROUP BY rid, start, length),
b AS (SELECT rid, start, length, p FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length / CAST(p AS DOUBLE) DESC, start, p) = 1),
t AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || p || chr(10), '' ORDER BY start, p) AS lines FROM r GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + p, start + length)) AS pos FROM r),
k AS (SELECT rid, string_agg(said, ' ' ORDER BY pos) AS kept FROM w ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, p AS period, 1000 * length // p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM m LEFT JOIN t USING (rid) LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_repetition": _QUALITY_SQL, "op3_warc_boundary_chain": _WARC_SQL, "op6_chat_schema_fingerprint": _CHAT_SQL,
        "op8_suffix_array_decontamination": _DECONTAM_SQL, "op10_minhash_bayes": _NEARDUP_SQL, "op12_lexical_search": _SEARCH_SQL, "op13_periodic_runs": _RUNS_SQL, "pii_base_spans": _PII_SQL,
    }
