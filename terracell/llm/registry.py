"""The registered queries of this subpackage: each operator with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html, langid, lz, minhash, mixing, parity_join, pii, resample, topk, trie, urls
from .common import cut

RULES = (
    urls.Rule("allow", "org/"), urls.Rule("block", "example.org/es/"), urls.Rule("block", "example.org/en/1"),
    urls.Rule("allow", "com/fr/"), urls.Rule("block", "com/de/"),
)
SHINGLES = parity_join.Join(ngram=3, num=90, den=100)
NEAR_DEDUP = minhash.NearDedup(ngram=4, num=80, den=100, passes=2)
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def rank_file(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(RANK_FILE), "rb") as f:
        return f.read()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex(binary: Column) -> Column:
    return F.sha2(binary, 256)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, counts = _table(spark, sf_dir, "pages").select("page_id", "url"), cut(urls.unigrams(_table(spark, sf_dir, "documents")))
    return urls.judge_urls(pages, RULES, counts, urls.learn(pages, RULES, counts)).select("page_id", "host", "path", "rule", "verdict")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip_documents(_table(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), _hex("ids").alias("ids_sha256"), _hex("decoded").alias("decoded_sha256"))


def op3_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = lz.fingerprints(table).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
    edited = lz.edited_by_next(docs, carry=["n_chars", "fingerprint"], ids=table)
    both = lz.fingerprints(edited, "edited", "edited_fingerprint")
    return both.select(
        "doc_id", "n_chars", _hex(F.col("edited").cast("binary")).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        lz.likeness("fingerprint", "edited_fingerprint").alias("near_edited"), lz.likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_turns(rows.union(more)))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(_table(spark, sf_dir, "documents"))
    per = [(i, m.plan.sizes[i], float(m.plan.targets[i])) for i in range(len(m.plan.sources))]
    facts = spark.createDataFrame(per, "source_no bigint, source_size bigint, target double")
    out = m.docs.join(mixing.taken(m), ["source_no", "first"], "left") if per else m.docs.withColumn("taken", F.lit(0))
    out = out.join(mixing.small(facts, m.plan), "source_no", "left")
    return out.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("bigint").alias("taken"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.groups(_table(spark, sf_dir, "documents"), SHINGLES)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.withColumn("base", base).select("doc_id", *counts, _hex(listed(F.col("base")).cast("binary")).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return pages.withColumn("n_chars", F.length("text").cast("bigint"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    rows = docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out"))
    return langid.identify(rows, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    made = resample.drawn(resample.weighted(docs, resample.learn(docs, target)))
    return made.select("doc_id", "n_features", "weight", "score", "rank")


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(_table(spark, sf_dir, "documents"), NEAR_DEDUP)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(trie.turns(_table(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_url_filter, op2_byte_bpe, op3_lz_fingerprint, op4_chat_format, op5_mix_sources, op6_ngram_join, op7_pii, op8_html_text, op9_top_k, op10_language, op11_importance_resampling, op12_minhash_dedup, op13_conversation_trie, pipeline)
    return {f.__name__: f for f in ops}


def _escaped(text: str) -> str:
    return f"replace(replace(replace({text}, '\\', '\\\\'), '<turn:', '<\\turn:'), '</turn>', '<\\/turn>')"


OP4_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn:' || replace({_escaped("role")}, '>', '\\>') || '>' || chr(10) || {_escaped("text")} || '</turn>' || chr(10)))::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(role || ',', '' ORDER BY turn, role, text), '(system,)?user,(assistant,user,)*(assistant,)?') AS valid
FROM rows GROUP BY conv_id
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


#: CRC-32 of short ASCII text: eight shifts a byte.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length({0}) + 1), lambda i: ord(substr({0}, i, 1))::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

OP13_SQL = f"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT c, c - (c % 5 + 5) % 5 AS base, {_CRC.format("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM own)
), taken AS (SELECT v.c, o.pos, o.role, o.text FROM convs v JOIN own o ON o.c = v.base AND o.pos <= v.h
), whole AS (
  SELECT * FROM taken
  UNION ALL SELECT o.c, o.pos - v.h + coalesce(n, 0), o.role, o.text FROM own o JOIN convs v USING (c) LEFT JOIN (SELECT c, count(*) AS n FROM taken GROUP BY 1) USING (c) WHERE o.pos > v.h
), paths AS (
  SELECT c, pos AS depth, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY pos)) AS node, strlen(text) AS bytes FROM whole
  UNION ALL SELECT c, 0, 'root', 0 FROM convs
), nodes AS (SELECT depth, node, min(c) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes FROM paths GROUP BY 1, 2
), family AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN paths p ON p.c = n.conv_id AND p.depth = n.depth - 1
), kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM family WHERE depth > 0 GROUP BY 1, 2
), facts AS (SELECT f.*, coalesce(k.n, 0) AS n_children FROM family f LEFT JOIN kids k USING (depth, node)
), sums AS (
  SELECT p.depth, p.node, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.bytes)::BIGINT AS saved_tokens
  FROM facts u JOIN paths p ON p.c = u.conv_id AND p.depth <= u.depth GROUP BY 1, 2
), last AS (SELECT c, max(depth) AS depth FROM paths GROUP BY 1
), ended AS (SELECT p.depth, p.node, sha256(string_agg(p.c::VARCHAR, ',' ORDER BY p.c)) AS ends_sha256 FROM paths p JOIN last l ON l.c = p.c AND l.depth = p.depth GROUP BY 1, 2)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM facts f JOIN sums s USING (depth, node) LEFT JOIN nodes q ON q.depth = f.depth - 1 AND q.node = f.parent LEFT JOIN ended e ON e.depth = f.depth AND e.node = f.node
"""


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _join_sql(join: parity_join.Join, columns: str) -> str:
    """Links of equal or overlapping sets by their common shingles, and all that each one reaches."""
    n = join.ngram
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWERED}, '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram}))) END AS s FROM words
), nodes AS (SELECT s, row_number() OVER () AS node, min(doc_id) AS least, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), grams AS (SELECT node, n, unnest(s) AS g FROM nodes
), links AS (
  SELECT a.node AS a, b.node AS b FROM grams a JOIN grams b ON a.g = b.g AND a.node < b.node AND least(a.n, b.n) * {join.den} >= greatest(a.n, b.n) * {join.num}
  GROUP BY a.node, b.node, a.n, b.n HAVING {join.den} * count(*) >= {join.num} * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT node, node FROM nodes
), reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b
), firsts AS (SELECT r.a AS node, min(n.least) AS first FROM reach r JOIN nodes n ON n.node = r.b GROUP BY 1
), found AS (SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(first, doc_id) AS component_id FROM sets LEFT JOIN nodes USING (s) LEFT JOIN firsts USING (node))
SELECT {columns} FROM found"""


def _crc_table() -> list[int]:
    """CRC-32 of each byte: eight shifts."""
    out = list(range(256))
    for _ in range(8):
        out = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in out]
    return out


def _nibble(at: str) -> str:
    return f"(ord(substr(h, {at}, 1)) & 15) + CASE WHEN ord(substr(h, {at}, 1)) > 57 THEN 9 ELSE 0 END"


def _resample_sql(r: resample.Resampler) -> str:
    """Features as text, the CRC-32 of each different one by a table of bytes, and the rest by the contract's formulas."""
    size = [f"greatest(len(w) - {k}, 0)" for k in range(r.ngram)]
    runs = ", ".join(f"list_transform(range(1, len(w) - {k - 1}), lambda i: " + " || ' ' || ".join(f"w[i + {j}]" for j in range(k + 1)) + ")" for k in range(r.ngram))
    return f"""
WITH texts AS (SELECT 'raw' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'target', item_id, text FROM benchmark
), words AS (
  SELECT side, id, row_number() OVER () AS row, list_filter(string_split_regex({_LOWERED}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM texts
), runs AS (SELECT side, row, unnest(list_concat({runs})) AS f FROM words
), counted AS (SELECT side, row, f, count(*) AS n FROM runs GROUP BY ALL
), hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(h), 2), lambda i: 16 * ({_nibble("i")}) + {_nibble("i + 1")})),
    lambda a, b: xor(a >> 8, list_extract({_crc_table()}::BIGINT[], (xor(a, b) & 255) + 1)))) % {r.buckets} AS bucket FROM hexed
), sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'raw'), 0) AS s, coalesce(sum(n) FILTER (side = 'target'), 0) AS t FROM counted JOIN hashed USING (f) GROUP BY 1
), gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {r.buckets})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {r.buckets})::DOUBLE)))::BIGINT AS g FROM sums
), weights AS (SELECT row, sum(n * g) AS weight FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY 1
), scored AS (
  SELECT id AS doc_id, len(w) AS n_words, ({" + ".join(size)})::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{r.seed}:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5e0) / 4294967296e0)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (row) WHERE side = 'raw'
), placed AS (SELECT *, CASE WHEN n_words >= {r.least_words} THEN row_number() OVER (PARTITION BY n_words >= {r.least_words} ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_words >= {r.least_words}) OVER () AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {r.percent} * most // 100 THEN place END AS rank FROM placed"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_format": OP4_SQL, "op6_ngram_join": _join_sql(SHINGLES, "doc_id, n_shingles, component_id"), "op9_top_k": OP9_SQL,
        "op11_importance_resampling": _resample_sql(resample.Resampler()),
        "op12_minhash_dedup": _join_sql(NEAR_DEDUP, "doc_id, n_shingles, component_id, coalesce(doc_id = component_id, component_id IS NULL) AS kept"), "op13_conversation_trie": OP13_SQL,
    }
