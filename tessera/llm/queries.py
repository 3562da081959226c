"""One query per operator over its whole table, with DuckDB SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from . import chat, exact_dedup, html_text, lexical, line_dedup, packing, prefix_trie, severity, simhash, subword, suffix_dedup, token_store, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@_query("op1_site_style_tree")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


@_query("op2_exact_dedup", """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h FROM documents),
g AS (SELECT h, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g ON d.h = g.h""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


@_query("op3_minimum_bin_slack")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


@_query("op4_subword_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op5_token_store")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    token_store.write_store(_table(spark, sf_dir, "documents"), path)
    return token_store.read_index(spark, path)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@_query("op6_winnowing", f"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, 1 + greatest(len(w) - 9, 1))) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
dwin AS (SELECT rid, s, m, array_to_string(w[s:s + m - 1], ' ') AS t
         FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM dw, sizes WHERE len(w) >= m)),
hit AS (SELECT dwin.rid, dwin.s, dwin.m, win.item_id FROM dwin JOIN win ON dwin.m = win.m AND dwin.t = win.t),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + m)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY rid)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(cov.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov ON dw.rid = cov.rid LEFT JOIN its ON dw.rid = its.rid""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op7_ordinal_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity.severities(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op8_simhash_pigeonhole")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"), shingle=3, distance=2)


@_query("op9_line_edit_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(_table(spark, sf_dir, "documents"))


#: the conversation of the contract whose texts hold control strings
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _escaped_length(column: str) -> str:
    grown = {"&": 4, "<s>": 3, "</s>": 3, "[INST]": 5, "[/INST]": 5}  # code points an escape adds
    return " + ".join([f"length({column})", *[f"{n} * ((length({column}) - length(replace({column}, '{s}', ''))) // {len(s)})" for s, n in grown.items()]])


@_query("op10_chat_windows", f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (SELECT *, {_escaped_length('role')} + {_escaped_length('text')} + 20 AS size FROM c),
k AS (SELECT *, CAST(ceil(size / 4.0) AS BIGINT) AS tok FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
             sum(tok) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - tok AS before,
             max(tok) OVER (PARTITION BY conv_id) AS longest FROM k),
first AS (SELECT conv_id, min(pos) AS spos FROM o WHERE role = 'system' GROUP BY conv_id),
head AS (SELECT o.conv_id, o.pos AS spos, o.tok AS stok, o.size AS ssize FROM o JOIN first ON o.conv_id = first.conv_id AND o.pos = first.spos),
room AS (SELECT o.*, head.spos, head.ssize, 2048 - coalesce(head.stok, 0) - o.longest AS room FROM o LEFT JOIN head ON o.conv_id = head.conv_id),
kept AS (SELECT *, greatest(0, least(256, floor(room / 2.0))) AS keep FROM room),
s AS (SELECT *, floor(before / greatest(1, room - keep)) AS span FROM kept),
ends AS (SELECT conv_id, span, max(before + tok) AS fin, min(pos) AS fp, max(spos) AS spos, max(ssize) AS ssize FROM s GROUP BY conv_id, span),
follow AS (SELECT *, lead(span) OVER (PARTITION BY conv_id ORDER BY span) AS nxt FROM ends),
body AS (SELECT s.conv_id, count(*) AS n_turns, sha256(string_agg(s.role || chr(10) || s.text || chr(10), '' ORDER BY s.pos)) AS turns_sha256,
                coalesce(string_agg(CASE WHEN s.role = 'assistant' THEN s.text END, '' ORDER BY s.pos), '') AS loss,
                sum(s.size) + sum(CASE WHEN f.fin - s.before <= s.keep AND f.nxt IS NOT NULL AND s.pos IS DISTINCT FROM s.spos THEN s.size ELSE 0 END) AS chars
         FROM s JOIN follow f ON s.conv_id = f.conv_id AND s.span = f.span GROUP BY s.conv_id),
heads AS (SELECT conv_id, sum(CASE WHEN spos < fp THEN ssize ELSE 0 END) AS chars FROM follow GROUP BY conv_id)
SELECT body.conv_id, body.n_turns, body.turns_sha256, CAST(length(body.loss) AS BIGINT) AS loss_chars, sha256(body.loss) AS loss_sha256,
       CAST(body.chars + heads.chars AS BIGINT) AS formatted_chars
FROM body JOIN heads ON body.conv_id = heads.conv_id""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back_digest(chat.chat_windows(rows))


@_query("op11_limited_accumulators", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT rid, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
st AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM x),
i AS (SELECT row_number() OVER () AS q, item_id, unnest({_WORDS}) AS t FROM benchmark),
it AS (SELECT q, item_id, t, count(*) AS c FROM i GROUP BY ALL),
p AS (SELECT rid, doc_id, n, t, count(*) AS tf FROM (SELECT rid, doc_id, n, unnest(w) AS t FROM x) SEMI JOIN (SELECT DISTINCT t FROM it) USING (t) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM p GROUP BY t),
s AS (SELECT it.q, it.item_id, p.rid, p.doc_id,
             CAST(sum(it.c * CAST(floor(1000 * ln((2 * nd + 2) / (2 * df.df + 1))) AS BIGINT)
                      * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // nt)))) AS BIGINT) AS score
      FROM it JOIN p USING (t) JOIN df USING (t), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 20""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


@_query("op12_monoid_prefixes", """
WITH RECURSIVE
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
             sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
crc_of_byte(n, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL
             SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM crc_of_byte WHERE k < 8),
crc(c, i, v) AS (SELECT DISTINCT c, 0, 4294967295 FROM t UNION ALL
             SELECT crc.c, i + 1, xor(b.v, crc.v >> 8) FROM crc JOIN crc_of_byte b ON b.k = 8 AND b.n = xor(crc.v & 255, ascii(substr(CAST(crc.c AS VARCHAR), i + 1, 1)))
             WHERE i < length(CAST(crc.c AS VARCHAR))),
convs AS (SELECT c, c - c % 5 AS base, xor(v, 4294967295) % 9 AS h FROM crc WHERE i = length(CAST(c AS VARCHAR))),
heads AS (SELECT convs.c, t.pos AS d, t.h, t.size FROM convs JOIN t ON t.c = convs.base AND t.pos <= convs.h),
taken AS (SELECT c, count(*) AS n FROM heads GROUP BY c),
built AS (SELECT * FROM heads UNION ALL
          SELECT t.c, coalesce(taken.n, 0) + t.pos - convs.h, t.h, t.size FROM t JOIN convs ON t.c = convs.c LEFT JOIN taken ON taken.c = t.c WHERE t.pos > convs.h),
paths AS (SELECT c, d, size, sha256(string_agg(h, ',') OVER (PARTITION BY c ORDER BY d)) AS path, d = max(d) OVER (PARTITION BY c) AS last FROM built
          UNION ALL SELECT c, 0, 0, '', c NOT IN (SELECT c FROM built) FROM convs),
named AS (SELECT *, min(c) OVER (PARTITION BY d, path) AS node FROM paths),
links AS (SELECT DISTINCT a.node, a.d, b.node AS parent FROM named a JOIN named b ON a.c = b.c AND a.d = b.d + 1),
nodes AS (SELECT node, d, count(*) AS n_convs, any_value(size) AS size, string_agg(CAST(CASE WHEN last THEN c END AS VARCHAR), ',' ORDER BY c) AS ends FROM named GROUP BY node, d),
kids AS (SELECT parent, d - 1 AS d, count(*) AS n FROM links GROUP BY ALL),
below AS (SELECT DISTINCT a.node, a.d, b.node AS low, b.d AS low_d FROM named a JOIN named b ON a.c = b.c AND b.d >= a.d),
sums AS (SELECT below.node, below.d, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.size) AS saved
         FROM below JOIN nodes x ON below.low = x.node AND below.low_d = x.d LEFT JOIN kids ON kids.parent = x.node AND kids.d = x.d GROUP BY ALL)
SELECT nodes.node AS conv_id, CAST(nodes.d AS BIGINT) AS depth, links.parent AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children, sums.n_leaves,
       CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(nodes.ends, '')) AS ends_sha256
FROM nodes JOIN sums ON sums.node = nodes.node AND sums.d = nodes.d LEFT JOIN links ON links.node = nodes.node AND links.d = nodes.d
LEFT JOIN kids ON kids.parent = nodes.node AND kids.d = nodes.d""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), base_of=c - c % 5, head_of=F.crc32(c.cast("string").cast("binary")) % 9)


@_query("op13_difference_cover")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_digest(_table(spark, sf_dir, "documents"), length=200)
